"""Near-duplicate texts by blocks of minima over the runs of words that define the similarity.

A fingerprint has BLOCKS symbols, each made of the minima of MINIMA hash functions
of its own over the text's runs of three words. Two texts of similarity s share one
symbol with probability s ** MINIMA, so joining on symbols misses a pair with
probability (1 - s ** MINIMA) ** BLOCKS. Several minima a symbol split the blocks of
stock phrases, which are in too many texts to compare all of them; a block that holds
more than HOT texts all the same is split by DEEPER further symbols, up to LEVELS
times, before all of its pairs are compared. Every pair that shares a block is a
candidate; most of those that share only stock phrases are told by one bit of each
minimum, and an exact comparison of the shingle sets follows.

The bits travel with the blocks, packed in arrays, and are compared where a block is
gathered: pairs that only share a block, whose number grows faster than the texts',
are never written, and what is on disk at once follows the number of texts.
Fingerprints are kept as arrays of up to SLICE texts, so that the turns that read
them again take no time for each text and column outside numpy.
"""

import re
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.functions.characters import TAGS, has_words
from strophe.llm.lookalike import skeleton
from strophe.session import ship, stage, unstage

#: At a similarity of 0.5 a pair is missed with probability 0.875 ** 140, which is less than 1 in 10^8; at 0.6, 3 in 10^15.
BLOCKS, MINIMA = 140, 3
#: Longs of one bit of each of the first minima, and how many of the bits at least agree: at a similarity of 0.5, fewer do with probability 1 in 10^9.
BITS, AGREE = 6, 235
#: Blocks are gathered in up to so many turns, one more for each so many classes; each turn frees its shuffle files.
TURNS, TURN_CLASSES = 18, 10_000
#: Most texts of a block that are compared with each other at once; for so many that takes as long as to split the block (some ns a pair, 1 to 2 us a row and symbol).
#: A larger block is split by this many of the following symbols, up to so many times;
#: a pair at 0.5 that shares the block is then missed with probability 0.875 ** 32, so over all blocks with 1 in 10^8 as before.
HOT, DEEPER, LEVELS = 8_000, 32, 3
#: Tasks that share the pairs of a block that is hot after the last level.
SALTS = 16
#: Up to so many ids are broadcast; beyond, they are joined.
BROADCAST_IDS = 500_000
#: Texts whose fingerprints are made and kept together: as many as a processor's cache holds the words of, and a power of two.
SLICE = 512
#: Rows of blocks that a task gathers at about 64 bytes, and texts whose blocks are packed together.
TASK_ROWS, PACKED = 300_000, 10_000
#: Pairs that are packed together, and that a task rids of repeated ones at 16 bytes.
PACKED_PAIRS, TASK_PAIRS = 500_000, 2_000_000
#: Up to so many texts of a block are compared by shifting the block against itself, larger ones by squares of so many.
SHIFTED, SQUARE = 48, 256
#: The sets of candidates are compared in turns of so many pairs, or a quarter of the classes if that is more.
TURN_PAIRS = 100_000

_HAN = "㐀-鿿豈-﫿"
_WORD = re.compile(rf"\[(?:{'|'.join(TAGS)})\]|[{_HAN}]|[^\W_{_HAN}]+")
_LOWER_TAG = re.compile(rf"\[(?:{'|'.join(TAGS)})\]")
_WIDE = re.compile("[^\x00-\xff‘’“”…–—•]")
_APOSTROPHES = ("'", "’", "‘", "ʼ", "`", "´")
_ODD = np.random.default_rng(20240607).integers(0, 2**31, (BLOCKS, MINIMA), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Two symbols each.
_SYMBOLS = [f"s{i}" for i in range(BLOCKS // 2)]
#: Latin-1 bytes that are no part of a word; they become blanks.
_SIGNS = bytes(c for c in range(256) if not chr(c).isalnum())
_BLANKED = bytes(32 if c in _SIGNS else c for c in range(256))


class _Hashes(dict):
    """Word to 64-bit hash, forgotten when there are too many."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = v = xxhash.xxh64_intdigest(w)
        return v


_HASH = _Hashes()


def words(text: str) -> tuple[list[str], str]:
    """The words of a text as the similarity has them, and its letters and digits, tags included."""
    if text.isascii():
        t = text.lower().replace("'", "").replace("`", "")
    else:
        t = skeleton(text).lower().replace("ß", "ss")
        for a in _APOSTROPHES:
            t = t.replace(a, "")
        if _WIDE.search(t):
            found = _WORD.findall(t)
            return [x for x in found if x[0] != "["], "".join(found).replace("[", "").replace("]", "")
    latin = lambda x, *how: x.encode("latin-1", "replace").translate(*how).decode("latin-1")
    return latin(_LOWER_TAG.sub(" ", t), _BLANKED).split(), latin(t, None, _SIGNS)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _windows(h: np.ndarray, lengths: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k[i] successive words of text i, and the texts' offsets in them. h: word hashes, texts end to end."""
    if not len(h):
        return h, np.zeros(len(lengths) + 1, np.int64)
    p = _powers(len(h) + 1)
    inverse = np.full(len(h) + 1, pow(_BASE, -1, 2**64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[:-1], out=total[1:])
    n = np.maximum(lengths - k + 1, 0)
    n[lengths == 0] = 0
    offsets = np.r_[0, np.cumsum(n)]
    at = np.repeat(np.r_[0, np.cumsum(lengths)][:-1] - offsets[:-1], n) + np.arange(offsets[-1])
    x = (total[at + np.repeat(k, n)] - total[at]) * inverse[at]
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x, offsets


def _read(b: pa.RecordBatch) -> tuple[list, list[list[str]], list[str]]:
    got = [words(t) for t in b.column(1).to_pylist()]
    return b.column(0), [w for w, _ in got], [s for _, s in got]


def _flat(ws: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    return np.fromiter(map(_HASH.__getitem__, chain.from_iterable(ws)), np.uint64, int(lengths.sum())), lengths


def _fingerprints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each slice, whose columns are arrays with a number for each text, BITS of them in the column of bits."""
    for whole in it:
        for at in range(0, whole.num_rows, SLICE):
            ids, ws, signs = _read(whole.slice(at, SLICE))
            h, lengths = _flat(ws)
            x, offsets = _windows(h, lengths, np.full(len(ws), 3))  # of one length in all texts, else equal runs have other hashes
            x = (x >> np.uint64(32)).astype(np.uint32)
            some = np.nonzero(lengths >= 3)[0]
            if not len(some):
                continue
            starts = offsets[some]
            y, least = np.empty_like(x), np.empty((BLOCKS * MINIMA, len(some)), np.uint32)
            for i, odd in enumerate(_ODD.ravel()):
                np.minimum.reduceat(np.multiply(x, odd, out=y), starts, out=least[i])
            least ^= least >> np.uint32(15)  # the lowest bit of a product alone is that of x
            bits = np.zeros((BITS, len(some)), np.uint64)
            for i in range(64 * BITS):
                bits[i // 64] |= (least[i] & np.uint32(1)).astype(np.uint64) << np.uint64(i % 64)
            least = least.reshape(BLOCKS, MINIMA, -1)
            symbols = np.zeros((BLOCKS, len(some)), np.uint64)
            for i in range(MINIMA):
                symbols = (symbols ^ least[:, i]) * _MIX
                symbols ^= symbols >> np.uint64(29)
            symbols >>= np.uint64(32)
            digest = b"".join(xxhash.xxh3_128_digest(signs[i]) for i in some)
            g = np.frombuffer(digest, np.int64).reshape(-1, 2)
            w = np.fromiter((xxhash.xxh64_intdigest(" ".join(ws[i])) for i in some), np.uint64, len(some))
            two = symbols[::2] | symbols[1::2] << np.uint64(32)
            k = ids.to_numpy(zero_copy_only=False)[some]
            columns = [k, g[:, 0], g[:, 1], w, bits, *two]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["k", "g1", "g2", "w", "bits", *_SYMBOLS])


def _numbers(u: int, n: int) -> np.ndarray:
    """The numbers of the texts of slice u: its partition in the upper 31 bits, as Spark numbers rows."""
    low = (1 << 33) - 1
    return np.arange(n, dtype=np.int64) + ((u & ~low) | (u & low) * SLICE)


def _texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, k, g1, g2, w) for each text of the slices."""
    for b in it:
        for u, *columns in zip(b.column(0).to_pylist(), *b.columns[1:]):
            columns = [np.frombuffer(c.as_buffer(), np.int64) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (_numbers(u, len(columns[0])), *columns)], ["u", "k", "g1", "g2", "w"])


def _slices(it: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(u, k, bits, symbols) of up to so many texts of the slices, symbols two by two."""
    for b in it:
        for start in range(0, b.num_rows, max(1, most // SLICE)):
            own = b.slice(start, max(1, most // SLICE))
            k, bits, *two = ([np.frombuffer(x.as_buffer(), np.int64) for x in c] for c in own.columns[1:])
            u = np.concatenate([_numbers(x, len(y)) for x, y in zip(own.column(0).to_pylist(), k)])
            k = np.concatenate(k)
            bits = np.concatenate([x.reshape(BITS, -1) for x in bits], axis=1)
            two = np.stack([np.concatenate(x) for x in two])
            for at in range(0, len(u), most):
                yield u[at : at + most], k[at : at + most], bits[:, at : at + most], two[:, at : at + most]


def _shingles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, s): the set of each text's runs as an array of 32-bit numbers in order."""
    for whole in it:
        for at in range(0, whole.num_rows, 2000):
            _, ws, _ = _read(b := whole.slice(at, 2000))
            h, lengths = _flat(ws)
            x, offsets = _windows(h, lengths, np.full(len(ws), 3))
            # text and shingle in one number: sorted once for all texts
            both = np.sort(np.repeat(np.arange(len(ws), dtype=np.uint64), np.diff(offsets)) << np.uint64(32) | x >> np.uint64(32))
            both = both[np.r_[True, both[1:] != both[:-1]][: len(both)]]
            ends = 4 * np.searchsorted(both, np.arange(len(ws) + 1, dtype=np.uint64) << np.uint64(32))
            values = both.astype(np.uint32)
            sets = pa.Array.from_buffers(pa.binary(), len(ws), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["k", "s"])


def _alike(it: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(a, b, similarity) of the pairs (a, b, sa, sb) whose sets are alike."""
    for whole in it:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            sets = [np.frombuffer(x.as_buffer(), np.uint32) for side in ("sa", "sb") for x in b[side]]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            both = np.sort(np.repeat(np.tile(np.arange(b.num_rows, dtype=np.uint64), 2), sizes) << np.uint64(32) | np.concatenate(sets))
            common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=b.num_rows)
            every = sizes.reshape(2, -1).sum(axis=0) - common
            some = np.nonzero(every)[0]
            similarity = common[some] / every[some]
            some, similarity = some[similarity >= least], similarity[similarity >= least]
            yield pa.RecordBatch.from_arrays([b["a"].take(pa.array(some)), b["b"].take(pa.array(some)), pa.array(similarity)], ["a", "b", "similarity"])


def classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(u, k, g1, g2, w) of each text of three words or more: a number, its key and the hashes of its letters and of its words. Before it the staged table that this is read from, of slices of texts with their fingerprints."""
    ship(df.sparkSession)
    src = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & has_words(F.col("t")))
    found = src.mapInArrow(_fingerprints, ", ".join(f"{x} binary" for x in ("k", "g1", "g2", "w", "bits", *_SYMBOLS)))
    slices = stage(found.withColumn("u", F.monotonically_increasing_id()), "fingerprints", **{"parquet.enable.dictionary": "false"})
    return slices, slices.select("u", "k", "g1", "g2", "w").mapInArrow(_texts, "u bigint, k bigint, g1 bigint, g2 bigint, w bigint")


class _Chosen:
    """Tells which numbers are among those of a column; it holds one bit a number."""

    def __init__(self, df: DataFrame, column: str):
        u = F.col(column)
        found = df.groupBy(F.shiftright(u, 15).alias("at")).agg(F.bitmap_construct_agg(u.bitwiseAND(F.lit(32767).cast("bigint"))).alias("bits")).collect()
        found.sort(key=lambda r: r["at"])
        self.at = np.array([r["at"] for r in found], np.int64)
        self.bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in found), np.uint8).reshape(-1, 4096)

    def __call__(self, u: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.zeros(len(u), bool)
        at = np.minimum(np.searchsorted(self.at, u >> 15), len(self.at) - 1)
        low = u & 32767
        return (self.at[at] == u >> 15) & (self.bits[at, low >> 3] >> (low & 7).astype(np.uint8) & 1 > 0)


def _mixed(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.uint64)
    y ^= y >> np.uint64(32)
    y *= _MIX
    y ^= y >> np.uint64(29)
    y *= np.uint64(_BASE)
    y ^= y >> np.uint64(32)
    return y.view(np.int64)


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where x has one of the values, which are sorted."""
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _own_blocks(symbols: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, block) of symbols that begin with number a."""
    blocks = np.arange(a, a + len(symbols), dtype=np.int64)[:, None] << 32 | symbols.astype(np.int64)
    return np.tile(np.arange(symbols.shape[1]), len(symbols)), blocks.ravel()


def _split(symbols: np.ndarray, at: tuple, level: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks at (first symbol, text, block) split by some of the symbols that the level adds, which the block doesn't have yet."""
    j, text, block = at
    i = (j[:, None] + 1 + level * DEEPER + some) % BLOCKS
    new = _mixed(block[:, None] ^ _mixed(i << 32 | symbols[i, text[:, None]].astype(np.int64)))
    return np.repeat(j, len(some)), np.repeat(text, len(some)), new.ravel()


def _deeper_blocks(symbols: np.ndarray, hot: list[np.ndarray], some: np.ndarray, salted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text, block) of blocks that are hot at all levels, split by some further symbols or, if salted, repeated for some salts, which are their last 16 bits."""
    js = np.unique(hot[0] >> 32)
    blocks = js[:, None] << 32 | symbols[js].astype(np.int64)
    j, text = np.nonzero(_among(blocks, hot[0]))
    at = js[j], text, blocks[j, text]
    for level, more in enumerate(hot[1:]):
        at = _split(symbols, at, level, np.arange(DEEPER))
        at = tuple(x[keep] for x in at) if not (keep := _among(at[2], more)).all() else at
    if salted:
        return np.repeat(at[1], len(some)), ((_mixed(at[2])[:, None] & ~0xFFFF) | some).ravel()
    return _split(symbols, at, len(hot) - 1, some)[1:]


def _packed(it: Iterator[pa.RecordBatch], chosen: _Chosen, of: Callable, parts: int, most: int) -> Iterator[pa.RecordBatch]:
    """(p, rows): block, key and bits of the chosen texts for every part, column by column."""
    for u, k, bits, two in _slices(it, most):
        keep = chosen(u)
        k, bits, two = k[keep], bits[:, keep], two[:, keep].view(np.uint64)
        symbols = np.stack([two & np.uint64(0xFFFFFFFF), two >> np.uint64(32)], axis=1).reshape(2 * len(two), -1)
        text, block = of(symbols)
        if not len(text):
            continue
        part = ((_mixed(block).view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.min_scalar_type(parts))
        order = np.argsort(part, kind="stable")
        text = text[order]
        rows = np.empty((2 + BITS, len(text)), np.int64)
        rows[0], rows[1] = block[order], k[text]
        for i in range(BITS):
            np.take(bits[i], text, out=rows[2 + i], mode="clip")
        ends = np.r_[0, np.cumsum(np.bincount(part, minlength=parts))]
        p = np.nonzero(np.diff(ends))[0]
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array([rows[:, ends[x] : ends[x + 1]].tobytes() for x in p], pa.binary())], ["p", "rows"])


def _sizes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks of a sorted array begin, and their sizes."""
    starts = np.nonzero(np.r_[True, block[1:] != block[:-1]])[0] if len(block) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(block)])


def _gathered(it: Iterator[pa.RecordBatch], hot: int | None, least: int = 1) -> tuple[np.ndarray, dict[int, int]]:
    """The rows of a part by block, without those of blocks of more than hot texts, and the sizes of these blocks. Blocks of fewer than least rows are left out too."""
    held, n, room, larger = [np.empty((2 + BITS, 0), np.int64)], 0, 4 * TASK_ROWS, {}

    def sort(least: int) -> np.ndarray:
        block = np.concatenate([x[0] for x in held])
        order = np.argsort(block)
        starts, sizes = _sizes(block[order])
        first, keep = block[order[starts]], sizes >= least
        if hot is not None:
            over = (sizes > hot) | _among(first, np.sort(np.fromiter(larger, np.int64))) if larger else sizes > hot
            for x, m in zip(first[over].tolist(), sizes[over].tolist()):
                larger[x] = larger.get(x, 0) + m
            keep &= ~over
        kept = np.zeros(len(block), bool)
        kept[order[np.repeat(keep, sizes)]] = True  # most rows are alone in their blocks: only the rest are moved
        ends = np.cumsum([x.shape[1] for x in held])
        rows = np.concatenate([x[:, kept[z - x.shape[1] : z]] for x, z in zip(held, ends)], axis=1)
        return rows[:, np.argsort(rows[0])]

    for b in it:
        for x in b.column(1):
            held.append(np.frombuffer(x.as_buffer(), np.int64).reshape(2 + BITS, -1))
            n += held[-1].shape[1]
        if n > room:  # rows of a block that is in a large part of the texts aren't kept
            held[:] = [sort(1)]
            n = held[0].shape[1]
            room = max(room, 2 * n)
    return sort(least), larger


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits differ; x and y: a row for each 64 of them. Of a signed number numpy would count the absolute value's bits."""
    count = lambda part: reduce(np.add, (np.bitwise_count((a ^ b).view(np.uint64)) for a, b in part))
    both = list(zip(x, y))
    return sum(count(both[i : i + 3]).astype(np.uint16) for i in range(0, BITS, 3))


def _pairs(rows: np.ndarray, lefts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of rows of one block that agree in enough bits: of all pairs, or of all with a left one."""
    bits = rows[2:]
    own = np.arange(rows.shape[1]) if lefts is None else lefts
    for a in range(0, len(own), SQUARE):
        x = bits[:, own[a : a + SQUARE], None]
        for b in range(a if lefts is None else 0, rows.shape[1], SQUARE):
            i, j = np.nonzero(_differ(x, bits[:, None, b : b + SQUARE]) <= 64 * BITS - AGREE)
            yield own[i + a], j + b


def _once(pair: np.ndarray) -> np.ndarray:
    """The different columns, sorted."""
    pair = pair[:, np.lexsort(pair)]
    return pair[:, np.r_[True, (pair[:, 1:] != pair[:, :-1]).any(axis=0)][: pair.shape[1]]]


def _compared(it: Iterator[pa.RecordBatch], hot: int | None) -> Iterator[pa.RecordBatch]:
    """(a, b) of the keys of a block whose bits agree, and (block, n) of blocks of more than hot texts; without hot, blocks are salted."""
    rows, larger = _gathered(it, hot, 2)
    starts, sizes = _sizes(rows[0])
    found = []
    if hot is not None:
        left = np.repeat(starts + sizes, sizes) - np.arange(rows.shape[1]) - 1  # further rows of the block
        i = np.nonzero(np.repeat(sizes <= SHIFTED, sizes))[0]
        for d in range(1, SHIFTED):
            i = i[left[i] >= d]
            for at in range(0, len(i), 100_000):
                x = i[at : at + 100_000]
                x = x[_differ(rows[2:, x], rows[2:, x + d]) <= 64 * BITS - AGREE]
                found.append((x, x + d))
    for at, m in zip(starts.tolist(), sizes.tolist()) if hot is None else zip(starts[sizes > SHIFTED].tolist(), sizes[sizes > SHIFTED].tolist()):
        block = rows[:, at : at + m]
        lefts = np.nonzero(_mixed(block[1]) % SALTS == block[0, 0] & 0xFFFF)[0] if hot is None else None
        found += [(i + at, j + at) for i, j in _pairs(block, lefts) if len(i)]
    pair = np.sort(rows[1][np.concatenate([np.stack(x) for x in found], axis=1)] if found else np.empty((2, 0), np.int64), axis=0)
    pair = _once(pair[:, pair[0] != pair[1]])
    none = pa.nulls(pair.shape[1], pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), none, none], ["a", "b", "block", "n"])
    none = pa.nulls(len(larger), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, pa.array(list(larger), pa.int64()), pa.array(list(larger.values()), pa.int64())], ["a", "b", "block", "n"])


def _found(it: Iterator[pa.RecordBatch], hot: int | None) -> Iterator[pa.RecordBatch]:
    """(pairs, block, n): what _compared finds, with the pairs in arrays."""
    met, larger = _compared(it, hot)
    pair = np.stack([met[x].to_numpy(zero_copy_only=False) for x in ("a", "b")])
    for at in range(0, pair.shape[1], PACKED_PAIRS):
        yield pa.RecordBatch.from_arrays([pa.array([pair[:, at : at + PACKED_PAIRS].tobytes()], pa.binary()), *2 * [pa.nulls(1, pa.int64())]], ["pairs", "block", "n"])
    yield pa.RecordBatch.from_arrays([pa.nulls(larger.num_rows, pa.binary()), larger["block"], larger["n"]], ["pairs", "block", "n"])


def _dealt(it: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(p, pairs): the pairs by part."""
    for b in it:
        for x in b.column(0):
            pair = np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1)
            part = (_mixed(pair[0] ^ _mixed(pair[1])).view(np.uint64) % np.uint64(parts)).astype(np.min_scalar_type(parts))
            pair = pair[:, np.argsort(part, kind="stable")]
            ends = np.r_[0, np.cumsum(np.bincount(part, minlength=parts))]
            p = np.nonzero(np.diff(ends))[0]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array([pair[:, ends[i] : ends[i + 1]].tobytes() for i in p], pa.binary())], ["p", "pairs"])


def _distinct(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of a part, once each."""
    held, n, room = [np.empty((2, 0), np.int64)], 0, 2 * TASK_PAIRS
    for b in it:
        for x in b.column(1):
            held.append(np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1))
            n += held[-1].shape[1]
        if n > room:
            held = [_once(np.concatenate(held, axis=1))]
            n = held[0].shape[1]
            room = max(room, 2 * n)
    pair = _once(np.concatenate(held, axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])


class _Candidates:
    """Pairs of classes that share a block and AGREE bits, gathered turn by turn."""

    def __init__(self, slices: DataFrame, chosen: _Chosen, n: int):
        """slices: of texts with fingerprints, of which n are chosen, one a class."""
        self.slices, self.chosen, self.n = slices, chosen, n
        self.found: list[DataFrame] = []

    def _turn(self, columns: list[str], of: Callable, total: int, most: int = PACKED, salted: bool = False) -> None:
        """Pairs of about so many rows of blocks, which `of` makes of the symbols of these columns."""
        parts = max(1, -(-total // TASK_ROWS), min(self.slices.sparkSession.sparkContext.defaultParallelism, -(-total // 20_000)))
        packed = self.slices.select("u", "k", "bits", *columns).mapInArrow(partial(_packed, chosen=self.chosen, of=of, parts=parts, most=most), "p int, rows binary")
        met = packed.repartitionById(parts, "p").mapInArrow(partial(_found, hot=None if salted else HOT), "pairs binary, block bigint, n bigint")
        self.found.append(stage(met, "candidates"))

    def _all(self, start: int = 0) -> DataFrame:
        """All turns from one on, read together: of a union, each would have tasks of its own."""
        some = self.found[start:]
        return self.slices.sparkSession.read.schema(some[0].schema).parquet(*(x._strophe[0] for x in some))

    def gather(self) -> DataFrame:
        """(a, b), a < b; staged."""
        turns = max(1, min(TURNS, len(_SYMBOLS), 1 + self.n // TURN_CLASSES))
        a_turn = max(self.n, TURN_CLASSES) * BLOCKS // turns
        for turn in range(turns):
            a, z = len(_SYMBOLS) * turn // turns, len(_SYMBOLS) * (turn + 1) // turns
            self._turn(_SYMBOLS[a:z], partial(_own_blocks, a=2 * a), 2 * (z - a) * self.n)
        hot, start = [], 0
        for level in range(1, LEVELS + 1):
            larger = sorted((r["n"], r["block"]) for r in self._all(start).where("block is not null").select("block", "n").collect())
            if not larger:
                break
            start, salted = len(self.found), level == LEVELS
            fan = SALTS if salted else DEEPER
            group, total = [], 0
            for i, (n, block) in enumerate(larger):  # blocks are split together as long as that takes no more room than any turn
                group.append(block)
                total += n
                if i + 1 == len(larger) or (total + larger[i + 1][0]) * fan > a_turn:
                    of = partial(_deeper_blocks, hot=[*hot, np.sort(np.array(group, np.int64))], salted=salted)
                    for some in np.array_split(np.arange(fan), min(fan, -(-total * fan // a_turn))):
                        self._turn(_SYMBOLS, partial(of, some=some), total * len(some), 1000, salted)
                    group, total = [], 0
            hot.append(np.sort(np.array([x for _, x in larger], np.int64)))
        pairs = self._all().where("pairs is not null").select("pairs")
        total = (pairs.agg(F.sum(F.octet_length("pairs"))).first()[0] or 0) // 16
        parts = max(1, -(-total // TASK_PAIRS), min(pairs.sparkSession.sparkContext.defaultParallelism, -(-total // 20_000)))
        dealt = pairs.mapInArrow(partial(_dealt, parts=parts), "p int, pairs binary")
        out = stage(dealt.repartitionById(parts, "p").mapInArrow(_distinct, "a bigint, b bigint"), "candidates")
        unstage(*self.found)
        return out


def near_pairs(df: DataFrame, key: str = "row_id", text: str = "lyrics", similarity: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) between class representatives, and membership (k, rep, g1, g2); both staged.

    A class is all texts with the same words in the same order and the same
    letters (tags included); its representative has the smallest key. Every two
    classes whose shingle sets (runs of three words) have at least the given
    Jaccard similarity are a pair, if their fingerprints share a symbol and AGREE
    bits (at 0.5 all but 1 in 10^8 do).
    Null keys, null or wordless texts and texts under three words are in no class;
    repeated rows and copies fall into one class, so no group is expanded. A key
    with several texts is in the class of each, and its sets are those of one.

    Shuffles: keys of classes, 64 bytes for each block of a class (TURNS shuffles, of
    which one is kept at a time), candidate pairs, and the shingle sets of candidates
    only, in turns too. No block of more than HOT texts is compared at once (see
    _Candidates). A bit for each text goes to the driver and to the workers.
    """
    slices, rows = classes(df, key, text)
    reps = stage(rows.groupBy("g1", "g2", "w").agg(F.min("k").alias("rep"), F.min_by("u", "k").alias("u")), "representatives")
    members = stage(rows.select("k", "g1", "g2", "w").join(reps.select("rep", "g1", "g2", "w"), ["g1", "g2", "w"]).select("k", "rep", "g1", "g2"), "members")
    n = reps.count()
    cand = _Candidates(slices, _Chosen(reps, "u"), n).gather()
    unstage(slices, reps)
    ids = stage(cand.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "candidate-ids")
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    src = src.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "k", "left_semi")
    sets = src.mapInArrow(_shingles, "k bigint, s binary")
    turns = 1 + cand.count() // max(TURN_PAIRS, n // 4)
    if turns > 1:
        sets = stage(sets, "sets")
    close = []
    for turn in range(turns):
        some = cand.where(F.pmod(F.xxhash64("a"), F.lit(turns)) == turn)
        sides = some.select(F.explode(F.array(F.struct(F.col("a").alias("k"), F.lit(True).alias("first")), F.struct(F.col("b").alias("k"), F.lit(False).alias("first")))).alias("x"), "a", "b").select("x.k", "x.first", "a", "b")
        # one row a pair, with the sets of both sides; a repeated key counts once
        of = lambda side: F.max(F.when(F.col("first") == side, F.col("s")))
        both = sides.join(sets, "k").groupBy("a", "b").agg(of(True).alias("sa"), of(False).alias("sb"))
        alike = both.where("sa is not null and sb is not null").mapInArrow(partial(_alike, least=similarity), "a bigint, b bigint, similarity double")
        close.append(stage(alike, "close"))
    unstage(cand, ids)
    if turns > 1:
        parts, close = close, [stage(reduce(DataFrame.union, close), "close")]
        unstage(sets, *parts)
    return close[0], members


def near_duplicates(df: DataFrame, key: str = "row_id", text: str = "lyrics", similarity: float = 0.5) -> DataFrame:
    """(key_a, key_b), key_a < key_b: the pairs of similar texts whose letters and digits aren't the same in the same order.

    Texts of equal words but other tags count too. Expands the pairs between
    classes to their members, as the query asks; see near_pairs for the cases.
    """
    close, members = near_pairs(df, key, text, similarity)
    tagged = members.groupBy("rep").agg(F.first("g1").alias("g1"), F.first("g2").alias("g2"))
    g = lambda x: tagged.select(F.col("rep").alias(x), F.col("g1").alias(f"{x}1"), F.col("g2").alias(f"{x}2"))
    far = close.join(g("a"), "a").join(g("b"), "b").where("a1 <> b1 or a2 <> b2").select("a", "b")
    m = lambda x: members.select(F.col("rep").alias(x), F.col("k").alias(f"k{x}"))
    out = far.join(m("a"), "a").join(m("b"), "b")
    return out.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()


def near_groups(df: DataFrame, key: str = "row_id", text: str = "lyrics", similarity: float = 0.5) -> DataFrame:
    """(key, group_id, links): each text of three words or more, its group and its class's number of similar classes.

    Groups are connected components, named by their smallest key: every round
    takes the smallest label of the neighbours, then the label's own label, until
    nothing changes. Only labels are aggregated (map-side), each round is written
    to the shared folder and the one before removed, and no group is ever
    gathered. Copies share a row's links.
    """
    close, members = near_pairs(df, key, text, similarity)
    edges = stage(close.select("a", "b").union(close.select("b", "a")), "edges")
    unstage(close)
    label = stage(edges.select(F.col("a").alias("v")).distinct().withColumn("l", F.col("v")), "labels")
    while True:
        near = edges.join(label, edges.b == label.v).groupBy("a").agg(F.min("l").alias("n"))
        step = label.join(near, label.v == near.a).select("v", F.least("l", "n").alias("l"), (F.col("n") < F.col("l")).alias("changed"))
        step = stage(step, "labels")
        unstage(label)
        if step.where("changed").isEmpty():
            label = step
            break
        jump = step.select(F.col("v").alias("u"), F.col("l").alias("root"))
        label = stage(step.join(jump, step.l == jump.u).select("v", F.least("l", "root").alias("l")), "labels")
        unstage(step)
    links = edges.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    found = label.join(links, label.v == links.a).select("v", "l", "links")
    return members.join(found, members.rep == found.v, "left").select(
        F.col("k").alias(key), F.coalesce("l", "rep").alias("group_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links")
    ).distinct()
