"""Song records: reading them strictly, and writing results."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Required fields of a record; extra ones are ignored, any JSON scalar serves as idx.
RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("idx", "lyrics", "prompt_wav")])


def read_songs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(idx, lyrics, prompt_wav) of JSON lines. Strict: a broken or blank line, or a record without a required field, is an error when it is read; else such lines are dropped."""
    lines = spark.read.text(path)
    x = F.from_json("value", T.StructType([*RECORD.fields, T.StructField("_broken", T.StringType())]), {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    rows = lines.select("value", x.alias("r"))
    bad = F.col("r").isNull() | F.col("r._broken").isNotNull() | F.col("r.idx").isNull() | F.col("r.lyrics").isNull() | F.col("r.prompt_wav").isNull()
    if not strict:
        return rows.where(~bad).select("r.idx", "r.lyrics", "r.prompt_wav")
    idx = F.when(bad, F.raise_error(F.concat(F.lit("not a song record: "), F.substring("value", 1, 100))).cast("string")).otherwise(F.col("r.idx"))
    return rows.select(idx.alias("idx"), F.col("r.lyrics").alias("lyrics"), F.col("r.prompt_wav").alias("prompt_wav"))


def write_songs(df: DataFrame, path: str) -> None:
    """JSON lines; the folder may exist."""
    df.write.mode("append").json(path)


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON configuration (one object)."""
    row = spark.read.option("multiLine", True).json(path).first()
    return row.asDict(recursive=True) if row else {}
