"""Lexicons as tables: reading, combining, and looking words up."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Phones that are dropped, and how others are written.
CONTROL = (" ", "<pad>", "UW", "</s>", "<s>")
RENAMED = {"<unk>": "UNK", "'": "-"}


def add_absent(base: DataFrame, more: DataFrame, key: str = "word") -> DataFrame:
    """base with the rows of more whose key it lacks; of repeated keys in more the smallest row stays."""
    new = more.join(base.select(key), key, "left_anti").select(*base.columns)
    rest = [c for c in base.columns if c != key]
    first = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *(F.col(f"_r.{c}") for c in rest))
    return base.unionByName(first)


def override(base: DataFrame, hot: DataFrame, key: str = "word") -> DataFrame:
    """base with every row of hot in place of those with its key."""
    return base.join(hot.select(key), key, "left_anti").select(*base.columns).unionByName(hot.select(*base.columns))


def remove(base: DataFrame, words: DataFrame, key: str = "word") -> DataFrame:
    """base without the keys of words."""
    return base.join(words.select(key), key, "left_anti")


def missing(base: DataFrame, words: DataFrame, key: str = "word") -> DataFrame:
    """Keys of words that base lacks; removing them is an error for callers that check."""
    return words.select(key).distinct().join(base.select(key), key, "left_anti")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *(F.col(f"_r.{c}") for c in rest))


def read_pairs(spark: SparkSession, path: str, separator: str = "\t", names: tuple[str, str] = ("syllable", "value")) -> DataFrame:
    """Two columns of a text file with one pair a line, split at the first separator; lines without one are left out."""
    x = F.split("value", separator, 2)
    return spark.read.text(path).select(x.alias("x")).where(F.size("x") == 2).select(F.get("x", 0).alias(names[0]), F.get("x", 1).alias(names[1]))


def read_pronunciations(spark: SparkSession, path: str, skip: int = 0, separator: str = "  ") -> DataFrame:
    """(word, phones) of a pronunciation file: word, separator, phones with blanks between; the last of a repeated word counts. skip: lines of its head.

    A single file is numbered line by line, so it is one task; lexicons are small.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where(F.col("n") >= skip)
    x = F.split("line", separator, 2)
    rows = lines.select("n", x.alias("x")).where(F.size("x") == 2).select(F.get("x", 0).alias("word"), F.split(F.trim(F.get("x", 1)), " +").alias("phones"), "n")
    return last_wins(rows, "word", "n").select("word", "phones")


def lookup(tokens: DataFrame, lexicon: DataFrame, names: DataFrame, word: str = "token") -> DataFrame:
    """tokens with phones: from the lexicon, else from the names if the token is in title case, else null."""
    a = lexicon.select(F.col("word").alias("_w"), F.col("phones").alias("_p"))
    b = names.select(F.col("word").alias("_w2"), F.col("phones").alias("_p2"))
    title = F.col(word).rlike("^[A-Z][a-z']*$")
    out = tokens.join(a, F.lower(word) == F.col("_w"), "left").join(b, (F.lower(word) == F.col("_w2")) & title, "left")
    return out.withColumn("phones", F.coalesce("_p", "_p2")).drop("_w", "_p", "_w2", "_p2")


def known_phones(phones: Column, symbols: Column) -> Column:
    """Phones that are symbols, apostrophes written as dashes, the rest and control phones dropped."""
    out = phones

    def renamed(p: Column) -> Column:
        for a, b in RENAMED.items():
            p = F.when(p == a, F.lit(b)).otherwise(p)
        return p

    out = F.transform(out, renamed)
    return F.filter(out, lambda p: ~p.isin(*CONTROL) & F.array_contains(symbols, p))


def possessive(phones: Column) -> Column:
    """The phones of a word with 's, by the last phone of its stem."""
    last = F.element_at(phones, -1)
    tail = F.when(last.isin("P", "T", "K", "F", "TH", "HH"), F.array(F.lit("S"))).when(last.isin("S", "Z", "SH", "ZH", "CH", "JH"), F.array(F.lit("AH0"), F.lit("Z"))).otherwise(F.array(F.lit("Z")))
    return F.concat(phones, tail)


def hash_bucket(word: Column, size: int) -> Column:
    """SHA-256 of the word as a number, modulo size (less than 2**27)."""
    digits = F.split(F.sha2(word, 256), "")
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: F.when(d == "", a).otherwise((a * 16 + F.conv(d, 16, 10).cast("bigint")) % size))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The lexicon at a path (Parquet); built and written there first if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
