"""Syllables of Chinese words: clean text, spelling, phones, from lexicons given as tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of finals behind an initial, of whole syllables without one, and of first letters without one.
BEHIND = {"uei": "ui", "iou": "iu", "uen": "un"}
ALONE = {"ing": "ying", "i": "yi", "in": "yin", "u": "wu"}
FIRST = {"v": "yu", "e": "e", "i": "y", "u": "w"}


def han_only(text: Column) -> Column:
    """Han characters alone; what else stands between them is one comma, but only behind at least two characters of output; none at the ends."""
    x = F.regexp_replace(F.regexp_replace(text, "[^一-龥]+", ","), "^,", "")
    return F.regexp_replace(F.regexp_replace(x, "^(.),", "$1"), ",$", "")


def wrapped(runs: Column, sounds: Column) -> Column:
    """Runs (script, run) as one text: Han runs as their sounds ` <p1> <p2> `, in order, all else as it is. sounds: an array of arrays, one for each Han run."""
    order = lambda i: F.size(F.filter(F.slice(runs, 1, i), lambda r: r["script"] == "zh"))
    said = lambda i: F.concat(F.lit(" "), F.array_join(F.transform(F.get(sounds, order(i)), lambda p: F.concat(F.lit("<"), p, F.lit(">"))), " "), F.lit(" "))
    return F.array_join(F.transform(runs, lambda r, i: F.when(r["script"] == "zh", said(i)).otherwise(r["run"])), "")


def toned(lexicon: DataFrame, syllable: str) -> DataFrame:
    """Every syllable with every tone 1 to 5, as `<syllable tone>`."""
    tones = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("tone")
    return lexicon.select(syllable, tones).select(syllable, "tone", F.concat(F.lit("<"), F.col(syllable), F.col("tone").cast("string"), F.lit(">")).alias("symbol"))


def phones(syllables: DataFrame, parts: DataFrame, toned_syllable: str) -> DataFrame:
    """syllables (toned, as `ma3`) that are in parts (pinyin, initial, final), with their two phones; others are dropped."""
    x = F.col(toned_syllable)
    rows = syllables.withColumn("_p", F.expr(f"left({toned_syllable}, length({toned_syllable}) - 1)")).withColumn("_t", F.right(x, F.lit(1)))
    return rows.join(parts, rows["_p"] == parts["pinyin"]).withColumn("phones", F.array("initial", F.concat("final", "_t"))).drop("_p", "_t", *parts.columns)


def spelled(initial: Column, final: Column) -> Column:
    """The syllable of an initial (empty or null for none) and a final without its tone, as it is written."""
    behind, alone, first = final, F.lit(None).cast("string"), F.lit(None).cast("string")
    for a, b in BEHIND.items():
        behind = F.when(final == a, F.lit(b)).otherwise(behind)
    for a, b in ALONE.items():
        alone = F.when(final == a, F.lit(b)).otherwise(alone)
    for a, b in FIRST.items():
        first = F.when(F.substring(final, 1, 1) == a, F.concat(F.lit(b), F.substring(final, F.lit(2), F.length(final)))).otherwise(first)
    return F.when(F.coalesce(initial, F.lit("")) != "", F.concat(initial, behind)).otherwise(F.coalesce(alone, first, final))


def aligned(words: DataFrame, table: DataFrame, key: str, initials: str, finals: str) -> DataFrame:
    """(key, phones, counts): each character's consonant and toned vowel from a table (syllable, consonant, vowel); marks, whose initial equals their final, are one phone.

    A syllable that the table lacks is an error. counts says how many phones each
    character has, and sums up to the number of phones. A row is a sentence.
    """
    rows = words.select(key, F.posexplode(F.arrays_zip(initials, finals)).alias("i", "x")).select(key, "i", F.col(f"x.{initials}").alias("c"), F.col(f"x.{finals}").alias("v"))
    mark = F.col("c") == F.col("v")
    rows = rows.withColumn("syllable", F.when(~mark, spelled(F.col("c"), F.regexp_replace("v", "[1-5]$", ""))))
    joined = rows.join(table, "syllable", "left")
    missing = F.raise_error(F.concat(F.lit("no phones for "), F.col("syllable"))).cast("array<string>")
    one = F.when(mark, F.array("c")).when(F.col("vowel").isNotNull(), F.array("consonant", F.concat("vowel", F.right("v", F.lit(1))))).otherwise(missing)
    kept = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", one.alias("p")))).alias("_s"))
    return kept.select(key, F.flatten(F.col("_s.p")).alias("phones"), F.transform("_s", lambda s: F.size(s["p"])).alias("counts"))


def by_language(runs: DataFrame, key: str, order: str, script: str, text: str, said: dict[str, Column]) -> DataFrame:
    """(key, phones): runs of a text said by the function of their script (an array column each), in their order; without one, or where it gives null, the run is a phone itself."""
    x = F.lit(None).cast("array<string>")
    for k, c in said.items():
        x = F.when(F.col(script) == k, c).otherwise(x)
    rows = runs.select(key, order, F.coalesce(x, F.array(text)).alias("p"))
    kept = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "p"))).alias("_s"))
    return kept.select(key, F.flatten(F.col("_s.p")).alias("phones"))
