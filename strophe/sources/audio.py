"""PCM WAV files as rows of samples, and back; other codecs need an external decoder."""

import io
import os
import uuid
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WAVES = "path string, sample_rate int, channels int, pcm array<array<float>>, error string"


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples (channels x time) in [-1, 1) of 8, 16 or 32-bit PCM."""
    with wave.open(io.BytesIO(content)) as w:
        n, width, rate = w.getnchannels(), w.getsampwidth(), w.getframerate()
        raw = w.readframes(w.getnframes())
    kind, zero, full = {1: (np.uint8, 128, 128), 2: ("<i2", 0, 1 << 15), 4: ("<i4", 0, 1 << 31)}[width]
    return rate, ((np.frombuffer(raw, kind).astype(np.float64) - zero) / full).astype(np.float32).reshape(-1, n).T


def encode_wav(pcm: np.ndarray, rate: int) -> bytes:
    """16-bit PCM of samples (channels x time), clipped to [-1, 1]."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(pcm))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(pcm, -1, 1) * 32767).round().astype("<i2").T.tobytes())
    return out.getvalue()


def read_audio(spark: SparkSession, path: str, decode: Callable[[bytes], tuple[int, np.ndarray]] = decode_wav, seconds: float | None = None) -> DataFrame:
    """(path, sample_rate, channels, pcm, error) of files; at most so many seconds of each. A file that can't be decoded has its error and no samples."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            out = []
            for p, content in zip(df.path, df.content):
                try:
                    rate, x = decode(content)
                    x = x[:, : int(seconds * rate)] if seconds else x
                    out.append((p, rate, len(x), [c.tolist() for c in x], None))
                except Exception as e:
                    out.append((p, None, None, None, repr(e)))
            yield pd.DataFrame(out, columns=["path", "sample_rate", "channels", "pcm", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, WAVES)


def down_mixed(df: DataFrame) -> DataFrame:
    """df with its channels averaged into one; null stays null."""
    total = F.aggregate(F.slice("pcm", 2, F.greatest(F.size("pcm"), F.lit(1))), F.get("pcm", 0), lambda a, c: F.zip_with(a, c, lambda x, y: x + y))
    mono = F.when(F.col("pcm").isNotNull(), F.array(F.transform(total, lambda x: x / F.size("pcm"))))
    return df.withColumn("pcm", mono).withColumn("channels", F.when(F.col("pcm").isNotNull(), F.lit(1)))


def write_waves(df: DataFrame, folder: str, name: str = "name", pcm: str = "pcm", rate: str = "sample_rate") -> DataFrame:
    """(name, bytes): writes a 16-bit WAV file <name>.wav for each row into a folder that all executors share, when the result is read. A row is written whole under another name and then renamed, so a task that runs twice leaves one file; null samples give no file."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            out = []
            for n, x, r in zip(rows[name], rows[pcm], rows[rate]):
                if x is None or len(x) == 0:
                    continue
                content = encode_wav(np.stack([np.asarray(c, np.float64) for c in x]), int(r))
                part = os.path.join(folder, f".{n}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(folder, f"{n}.wav"))
                out.append((n, len(content)))
            yield pd.DataFrame(out, columns=["name", "bytes"])

    os.makedirs(folder, exist_ok=True)
    return df.select(name, pcm, rate).mapInPandas(run, "name string, bytes bigint")
