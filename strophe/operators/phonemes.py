"""From words to phones: Chinese words with their syllables, English tokens with lexicons."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.operators import lexicons, pinyin, tones
from strophe.operators.arrays import let

# Words whose pronunciation goes by the tag, with the phones under a tag that begins so, and the others.
HOMOGRAPHS = (("read", "VBP", ("R", "IY1", "D"), ("R", "EH1", "D")), ("complex", "JJ", ("K", "AH0", "M", "P", "L", "EH1", "K", "S"), ("K", "AA1", "M", "P", "L", "EH0", "K", "S")))
# Words that are no entries of the lexicon.
REMOVED = ("ae", "ai", "ar", "ios", "hud", "os")
#: Between a character's initial and its final while words are merged.
_CUT = "|"


def chinese_phones(sentences: DataFrame, table: DataFrame, key: str, always: list[str] | tuple[()] = ()) -> DataFrame:
    """(key, phones, counts): sentences (words, tags, initials, finals, splits, parallel arrays; the initials and finals are arrays of a word's characters) as they are spoken.

    Words tagged eng are left out. The others are merged, the tone rules are
    applied to each, and every syllable is looked up in table (syllable,
    consonant, vowel); one that it lacks is an error. A split is the length of the
    first of a word's two parts, null for a word that is one; a merged word is
    split where its first word ends. counts are the phones of each character; that
    they add up to the phones is checked. Null arrays count as empty; a sentence
    without words has no row. One shuffle, on the key; a row is a sentence.
    """
    c = lambda n: F.col(n)
    zipped = F.arrays_zip(c("words").alias("w"), c("tags").alias("p"), c("initials").alias("i"), c("finals").alias("f"))
    coded = lambda x: F.zip_with(x["i"], x["f"], lambda a, b: F.concat(a, F.lit(_CUT), b))
    spoken = F.filter(zipped, lambda x: F.coalesce(x["p"] != "eng", F.lit(True)))
    seg = F.transform(spoken, lambda x: tones.word(x["w"], x["p"], coded(x)))
    rows = sentences.select(key, F.posexplode(tones.merge(seg)).alias("at", "m"), F.arrays_zip("words", "splits").alias("given"))
    # a word that came as it is has its own split, a merged one that of its first word
    own = F.get(F.filter("given", lambda x: x["words"] == F.col("m.word")), 0)["splits"]
    first = F.get(F.filter("given", lambda x: F.col("m.word").startswith(x["words"])), 0)["words"]
    split = F.coalesce(own, F.length(first), F.length("m.word"))
    said = rows.select(key, "at", tones.spoken(F.col("m.word"), F.col("m.pos"), F.col("m.finals"), split, always).alias("f"))
    whole = said.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("s")).select(key, F.flatten("s.f").alias("f"))
    parts = whole.select(key, F.transform("f", lambda x: F.substring_index(x, _CUT, 1)).alias("initials"), F.transform("f", lambda x: F.substring_index(x, _CUT, -1)).alias("finals"))
    out = pinyin.aligned(parts, table, key, "initials", "finals")
    return out.select(key, checked(F.col("phones"), F.col("counts")).alias("phones"), "counts")


def checked(phones: Column, counts: Column) -> Column:
    """The phones; an error if the counts don't add up to them."""
    total = F.aggregate(counts, F.lit(0), lambda a, n: a + n)
    return F.when(total == F.size(phones), phones).otherwise(F.raise_error(F.lit("phones and counts don't agree")).cast("array<string>"))


def lexicon_entries(lexicon: DataFrame, hot: DataFrame | None = None, removed: tuple[str, ...] = REMOVED) -> DataFrame:
    """A lexicon (word, phones) in lower case, with the hot words in place of its own and without those removed."""
    low = lambda d: d.select(F.lower("word").alias("word"), "phones")
    base = lexicons.override(low(lexicon), low(hot)) if hot is not None else low(lexicon)
    return base.where(~F.col("word").isin(*removed))


def english_phones(tokens: DataFrame, lexicon: DataFrame, names: DataFrame, compounds: DataFrame, token: str = "token", tag: str = "tag") -> DataFrame:
    """tokens with phones, by the first that holds: without a letter the token itself, one letter (a lone A is EY1) by the lexicon, homographs by their tag, then the lexicon, the names (title case), the letters of up to three, the stem of a possessive, the parts of a compound (word, parts).

    Stems and parts are looked up alike, once: by the lexicon, or letter by letter
    up to three. What none of it covers has null phones, for a predictor. Lexicon
    and names are (word, phones) in lower case. Tokens are resolved once each
    (distinct token and tag) and joined back; lexicons are joined, so of any size.
    """
    distinct = tokens.select(F.col(token).alias("o"), F.col(tag).alias("g")).where("o is not null").distinct().withColumn("w", F.lower("o"))
    one = lexicon.groupBy("word").agg(F.min("phones").alias("phones"))
    letters = one.where(F.length("word") == 1).agg(F.map_from_entries(F.collect_list(F.struct("word", "phones"))).alias("letters"))  # one row, a map of some dozen letters
    spell = lambda w: F.flatten(F.transform(F.regexp_extract_all(w, F.lit("(?s)."), F.lit(0)), lambda x: F.when(x == "a", F.array(F.lit("EY1"))).otherwise(F.col("letters")[x])))
    stem = F.regexp_extract("w", "^([a-z]+)'s$", 1)
    pieces = distinct.join(compounds.select(F.col("word").alias("w"), "parts").dropDuplicates(["w"]), "w", "left")
    pieces = pieces.withColumn("x", F.when(stem != "", F.array(stem)).otherwise(F.coalesce("parts", F.array().cast("array<string>"))))
    looked = lambda d, w, name: d.join(one.select(F.col("word").alias(w), F.col("phones").alias(name)), w, "left")
    split = looked(pieces.select("o", "g", F.posexplode("x").alias("i", "y")), "y", "q").join(F.broadcast(letters))
    parts = split.select("o", "g", "i", F.when(F.length("y") > 1, F.coalesce("q", F.when(F.length("y") <= 3, spell(F.col("y"))))).otherwise(spell(F.col("y"))).alias("q"))
    joined = parts.groupBy("o", "g").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("s"), F.count_if(F.col("q").isNull()).alias("unknown"))
    joined = joined.select("o", F.col("g").alias("g2"), F.when(F.col("unknown") == 0, F.flatten("s.q")).alias("pieces"))
    rows = looked(distinct, "w", "own").join(names.groupBy("word").agg(F.min("phones").alias("named")).withColumnRenamed("word", "w"), "w", "left")
    rows = rows.join(joined.withColumnRenamed("o", "o2"), (F.col("o") == F.col("o2")) & F.col("g").eqNullSafe(F.col("g2")), "left").join(F.broadcast(letters))
    homograph = F.lit(None).cast("array<string>")
    for w, begins, first, other in HOMOGRAPHS:
        under = F.coalesce(F.col("g").startswith(begins) | (F.lit(begins).startswith(F.col("g")) & (F.length("g") < len(begins))), F.lit(False))
        homograph = F.when(F.col("w") == w, F.when(under, F.array(*map(F.lit, first))).otherwise(F.array(*map(F.lit, other)))).otherwise(homograph)
    title = F.col("o").rlike("^[A-Z][a-z']*$")
    several = F.coalesce(homograph, "own", F.when(title, F.col("named")), F.when(F.length("w") <= 3, spell(F.col("w"))), F.when(stem != "", let(F.col("pieces"), lexicons.possessive)).otherwise(F.col("pieces")))
    phones = F.when(~F.col("w").rlike("[a-z]"), F.array("w")).when(F.length("w") == 1, F.when(F.col("o") == "A", F.array(F.lit("EY1"))).otherwise(F.col("own"))).otherwise(several)
    known = rows.select(F.col("o").alias("_o"), F.col("g").alias("_g"), phones.alias("phones"))
    return tokens.join(known, (F.col(token) == F.col("_o")) & F.col(tag).eqNullSafe(F.col("_g")), "left").drop("_o", "_g")


def sentence_phones(tokens: DataFrame, key: str, order: str, phones: str = "phones") -> DataFrame:
    """(key, phones): the phones of a sentence's tokens in order, a blank between tokens."""
    rows = tokens.select(key, order, F.concat(F.array(F.lit(" ")), F.coalesce(phones, F.array().cast("array<string>"))).alias("p"))
    kept = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "p"))).alias("s"))
    return kept.select(key, let(F.flatten("s.p"), lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))).alias("phones"))


def resolved(tokens: DataFrame, symbols: DataFrame, said: DataFrame, key: str, order: str, token: str = "token") -> DataFrame:
    """(key, text): tokens in order, blank between, of which those that are no symbol (symbols: token), tag or empty are replaced by said (token, text) where it has them."""
    s = symbols.select(F.col("token").alias("_s")).distinct()
    t = said.groupBy("token").agg(F.min("text").alias("_x")).withColumnRenamed("token", "_t")
    rows = tokens.join(s, F.col(token) == F.col("_s"), "left").join(t, F.col(token) == F.col("_t"), "left")
    plain = F.col("_s").isNotNull() | F.col(token).rlike(r"^\[\w+\]$") | (F.col(token) == "")
    rows = rows.select(key, order, F.when(plain, F.col(token)).otherwise(F.coalesce("_x", token)).alias("x"))
    kept = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "x"))).alias("s"))
    return kept.select(key, F.array_join("s.x", " ").alias("text"))
