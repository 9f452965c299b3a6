"""Copies that differ only in formatting, found by progressive partition refinement."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from strophe.functions.characters import has_words
from strophe.llm.lookalike import skeletons
from strophe.session import stage

#: Letters (and one Han character) whose counts make the histogram; any would do, these tell texts apart well.
HISTOGRAM = "eanos的"
#: Up to so many keys of members of classes (8 bytes each) are broadcast to pick their texts; beyond, they are joined.
BROADCAST_KEYS = 1_000_000


def letters(form: Column) -> Column:
    """Letters, digits and unattached accents alone, without case."""
    return F.replace(F.regexp_replace(F.lower(form), r"[^\p{L}\p{M}\p{N}]+", ""), F.lit("ß"), F.lit("ss"))


@pandas_udf(StringType())
def _lyrics_of(line: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        try:
            y = json.loads(x)
            return y["lyrics"] if isinstance(y["lyrics"], str) else None
        except (TypeError, ValueError, KeyError, RecursionError):
            return None

    return pd.Series([one(x) for x in line], dtype=object)


def records_of(songs: DataFrame, raw_lines: DataFrame) -> DataFrame:
    """(row_id, lyrics) of songs and of the readable JSON records, whatever the order, spacing or escapes of their fields.

    Lines that are null, blank, cut off, no JSON object or without a string of
    lyrics give a null text.
    """
    return songs.select("row_id", "lyrics").unionByName(raw_lines.select("row_id", _lyrics_of("line").alias("lyrics")))


def copies(df: DataFrame, key: str = "row_id", text: str = "lyrics") -> DataFrame:
    """(keep, key, copies): every row with words, the smallest key of its group and the group's size.

    A group is all texts with the same letters and digits in the same order once
    look-alikes are equal and case, blanks, punctuation and other signs are
    ignored. Null keys and null, empty or wordless texts have no row; repeated
    rows count as so many copies of one key.

    Refinement: stripped length and letter counts first; only rows of classes
    with several members are hashed (SHA-256), and only those hashes are grouped.
    Aggregates combine map-side, so a group that holds a third of all rows is a
    third of nobody's task; the join back is split by AQE. Texts are shuffled only
    where more than BROADCAST_KEYS rows are in classes of several.
    """
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & has_words(F.col("t")))
    clean = lambda d: skeletons(d, "t", "form").select("k", letters(F.col("form")).alias("z"))
    count = lambda x: F.length("z") - F.length(F.replace("z", F.lit(x), F.lit("")))
    cheap = stage(clean(src).select("k", F.length("z").alias("n"), F.xxhash64(*(count(x) for x in HISTOGRAM)).alias("h")), "invariants")
    several = cheap.groupBy("n", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("n", "h")
    members = stage(cheap.join(several, ["n", "h"], "left_semi").select("k").distinct(), "members")
    # members are picked before their texts are cleaned again
    few = members.count() <= BROADCAST_KEYS
    costly = stage(clean(src.join(F.broadcast(members) if few else members, "k", "left_semi")).select("k", F.unhex(F.sha2("z", 256)).alias("s")), "hashes")
    groups = costly.groupBy("s").agg(F.min("k").alias("keep"), F.count(F.lit(1)).alias("copies"))
    found = costly.join(groups, "s").select("keep", F.col("k"), "copies")
    alone = cheap.join(members, "k", "left_anti").select(F.col("k").alias("keep"), "k", F.lit(1).cast("bigint").alias("copies"))
    return found.unionByName(alone).select("keep", F.col("k").alias(key), "copies")


def extra_copies(df: DataFrame, key: str = "row_id", text: str = "lyrics") -> DataFrame:
    """(keep_id, key): the rows that `copies` collapses, each with the row that stays."""
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return copies(src, "k", "t").where("copies > 1 and k <> keep").select(F.col("keep").alias("keep_id"), F.col("k").alias(key)).distinct()


def kept_records(df: DataFrame, key: str = "row_id", text: str = "lyrics") -> DataFrame:
    """(key, copies): one record of each group, the one with the smallest key, and how many copies it had."""
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return copies(src, "k", "t").where("k = keep").select(F.col("k").alias(key), "copies").distinct()
