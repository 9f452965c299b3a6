"""Byte-level BPE encoding with a public vocabulary, by segment trees.

A piece of text is a row of byte positions. A segment tree over them stores, for
every range, the lowest rank of a pair that begins in it; going down from the root
to the left wherever the left child is no larger finds the leftmost lowest pair.
A merge changes the leaves of at most three live neighbours, each a logarithmic
update. All pieces of a batch that have the same tree size merge in step, as rows of
one array.
"""

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.session import ship

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern of pieces that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
#: Tree leaves held at once.
LEAVES = 1 << 20
#: Pieces remembered by a worker between batches.
REMEMBERED = 200_000
_PIECES = regex.compile(PATTERN)
_LOADED: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """ids of whole tokens, and every pair of tokens that makes up a third one, with its rank (which is that token's id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self.keys = np.fromiter((k for k, _ in pairs), np.int64, len(pairs))
        self.ranks = np.fromiter((r for _, r in pairs), np.int32, len(pairs))
        self.byte = np.fromiter((ranks[bytes([i])] for i in range(256)), np.int32, 256)
        self.seen: dict[str, list[int]] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _merge(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Ids of pieces of at most size bytes; size is a power of two."""
        p = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, p)
        flat = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        sym = np.full((p, size + 1), -1, np.int32)
        inside = np.arange(size + 1) < n[:, None]
        sym[inside] = flat
        after = np.tile(np.arange(1, size + 2, dtype=np.int32), (p, 1))
        before = np.tile(np.arange(-1, size, dtype=np.int32), (p, 1))
        tree = np.full((p, 2 * size), NONE, np.int32)
        both = inside[:, :-1] & inside[:, 1:]
        tree[:, size:][both] = self.rank(sym[:, :-1][both], sym[:, 1:][both])
        at = size
        while at > 1:
            tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
            at //= 2
        alive = inside.copy()
        rows = np.nonzero(tree[:, 1] != NONE)[0]
        while len(rows):
            best = tree[rows, 1]
            node = np.ones(len(rows), np.int64)
            while node[0] < size:
                node *= 2
                node += tree[rows, node] != best
            pos = node - size
            gone = after[rows, pos]
            then = after[rows, gone]
            sym[rows, pos] = best
            alive[rows, gone] = False
            after[rows, pos] = then
            some = then < n[rows]
            before[rows[some], then[some]] = pos[some]
            prev = before[rows, pos]
            tree[rows, size + gone] = NONE
            tree[rows, size + pos] = NONE
            tree[rows[some], size + pos[some]] = self.rank(best[some], sym[rows[some], then[some]])
            has = prev >= 0
            tree[rows[has], size + prev[has]] = self.rank(sym[rows[has], prev[has]], best[has])
            for leaf, who in ((gone, rows), (pos, rows), (prev[has], rows[has])):
                k = (size + leaf).astype(np.int64) >> 1
                while len(k) and k[0]:
                    tree[who, k] = np.minimum(tree[who, 2 * k], tree[who, 2 * k + 1])
                    k >>= 1
            rows = rows[tree[rows, 1] != NONE]
        counts = alive.sum(1)
        ids = sym[alive].tolist()
        out, at = [], 0
        for c in counts.tolist():
            out.append(ids[at : at + c])
            at += c
        return out

    def learn(self, pieces: set[str]) -> None:
        """Ids of the pieces into self.seen."""
        by: dict[int, list[tuple[str, bytes]]] = {}
        for x in pieces:
            b = x.encode()
            if (i := self.ids.get(b)) is not None:
                self.seen[x] = [i]
            else:
                by.setdefault(max(4, 1 << (len(b) - 1).bit_length()), []).append((x, b))
        for size, some in by.items():
            step = max(1, LEAVES // size)
            for at in range(0, len(some), step):
                part = some[at : at + step]
                self.seen.update(zip((x for x, _ in part), self._merge([b for _, b in part], size)))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        cut = [_PIECES.findall(t) if t else [] for t in texts]
        new = set().union(*cut)
        if len(self.seen) > REMEMBERED:  # only here, before the unseen pieces are picked: learn() must keep what this batch needs
            self.seen.clear()
        self.learn({x for x in new if x not in self.seen})
        seen = self.seen
        return [[i for x in pieces for i in seen[x]] for pieces in cut]


def load(spark: SparkSession, name: str = "byte_bpe_50k", directory: str = TOKENIZERS) -> Broadcast:
    """The ranks of a vocabulary file (half a megabyte), broadcast."""
    ship(spark)
    with open(f"{directory}/{name}.tiktoken", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def vocabulary(content: bytes) -> Vocabulary:
    """The vocabulary of a file of base64 tokens and ranks; made once a worker."""
    key = hashlib.md5(content).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())})
    return _LOADED[key]


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for at in range(0, whole.num_rows, 500):
            yield whole.slice(at, 500)


def _encode(it: Iterator[pa.RecordBatch], content: Broadcast) -> Iterator[pa.RecordBatch]:
    v = vocabulary(content.value)
    for b in _batches(it):
        ids = v.encode(b.column(1).to_pylist())
        at = np.r_[0, np.cumsum(list(map(len, ids)))].astype(np.int32)
        flat = pa.array(np.fromiter((i for x in ids for i in x), np.int32, int(at[-1])))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), flat)], ["k", "ids"])


def _count(it: Iterator[pa.RecordBatch], content: Broadcast) -> Iterator[pa.RecordBatch]:
    v = vocabulary(content.value)
    for b in _batches(it):
        n = np.fromiter(map(len, v.encode(b.column(1).to_pylist())), np.int64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["k", "tokens"])


def encode(df: DataFrame, content: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): each text's token ids, without special tokens; strings of special tokens are ordinary text.

    Null and empty texts have an empty list, never null. Keys may be null or
    repeat; every row gives one row. Texts of any length are encoded whole; other
    columns are left out. One pass, no shuffle.
    """
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    return src.mapInArrow(partial(_encode, content=content), f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def sizes(df: DataFrame, content: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): each text's number of tokens, 0 for null and empty ones."""
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    return src.mapInArrow(partial(_count, content=content), f"k {kind}, tokens bigint").withColumnRenamed("k", key)
