"""Where external models plug in: codecs, step-wise generators, lyric processors. No model is part of the engine."""

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Codec(ABC):
    """What a codec must tell and do; its instances are shipped to the workers."""

    sample_rate: int
    channels: int
    frame_rate: float
    dim: int
    split_bands: bool = False

    @abstractmethod
    def encode(self, wav: list[list[float]]) -> list[list[float]]: ...

    @abstractmethod
    def decode(self, latent: list[list[float]]) -> list[list[float]]: ...


def encoded(df: DataFrame, codec: Codec, key: str, wav: str, shortest: int = 2048) -> DataFrame:
    """(key, latent): mono is repeated to the codec's channels, less than shortest samples give no latent steps; null gives null."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            out = []
            for w in rows[wav]:
                if w is None:
                    out.append(None)
                    continue
                w = [list(c) for c in w]
                w = w * codec.channels if len(w) == 1 else w
                out.append(codec.encode(w) if w and len(w[0]) >= shortest else [])
            yield pd.DataFrame({key: rows[key], "latent": out})

    kind = df.schema[key].dataType
    return df.select(key, wav).mapInPandas(run, T.StructType([T.StructField(key, kind), T.StructField("latent", T.ArrayType(T.ArrayType(T.DoubleType())))]))


def generated(df: DataFrame, step: Callable[[list[int]], list[int]], key: str, prompt: str, eos: int, limit: int) -> DataFrame:
    """(key, tokens): a prompt continued block by block until a block holds eos or the limit is reached; one row a record, records in parallel. The block with eos is cut before it."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            out = []
            for p in rows[prompt]:
                tokens = [int(x) for x in p] if p is not None else []
                while len(tokens) < limit:
                    block = step(tokens)
                    if eos in block:
                        tokens += block[: block.index(eos)]
                        break
                    if not block:
                        break
                    tokens += block
                out.append(tokens[:limit])
            yield pd.DataFrame({key: rows[key], "tokens": out})

    kind = df.schema[key].dataType
    return df.select(key, prompt).mapInPandas(run, T.StructType([T.StructField(key, kind), T.StructField("tokens", T.ArrayType(T.IntegerType()))]))


PROCESSORS: dict[str, Callable[[Column], Column]] = {"none": lambda c: c}


def processor(name: str, f: Callable[[Column], Column]) -> None:
    """Register a lyric processor under a name; the last one counts."""
    PROCESSORS[name] = f


def processed(df: DataFrame, name: str | None, text: str) -> DataFrame:
    """df with its text processed; without a name it stays, an unknown one is an error."""
    key = name or "none"
    if key not in PROCESSORS:
        raise KeyError(f"no lyric processor {key}; there are {', '.join(sorted(PROCESSORS))}")
    return df.withColumn(text, PROCESSORS[key](F.col(text)))
