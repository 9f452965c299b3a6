"""The text operators over streams, and state that is kept from record to record."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strophe.operators.lyrics import clean_lyrics
from strophe.sources.records import RECORD


def song_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records that arrive as JSON lines in a folder, with their sheets cleaned."""
    return spark.readStream.schema(RECORD).json(folder).withColumn("lyrics", clean_lyrics(F.col("lyrics")))


def arrivals(stream: DataFrame, at: str, source: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Records by source and event-time window; those later than the watermark no longer count."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), source).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", source, "n")


OFFSETS = "song_id string, first bigint, tokens bigint"


def running_offsets(stream: DataFrame, key: str = "song_id", tokens: str = "tokens") -> DataFrame:
    """(song_id, first, tokens): for every batch of a song's tokens, the position of its first token over all batches so far. The state is a number a song."""

    def step(k: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else 0
        n = sum(len(x) for part in parts for x in part[tokens])
        state.update((first + n,))
        yield pd.DataFrame({"song_id": [k[0]], "first": [first], "tokens": [n]})

    return stream.groupBy(key).applyInPandasWithState(step, OFFSETS, "n bigint", "append", GroupStateTimeout.NoTimeout)
