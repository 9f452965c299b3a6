"""Several values packed in one field, one row per value with its position kept.

The Arrow string buffer of a batch is scanned as one array of bytes: masks of
tags, quotes and delimiters, quote parity by cumulative sums, and from them the
byte ranges of all values at once. The values are gathered into a child array
under list offsets, which are flattened with the ordinals of their parents.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.functions.characters import BLANKS as WIDE_BLANKS
from strophe.functions.characters import TAGS, plain_tags
from strophe.session import ship

# The tags of vocal sections.
VOCAL = ("verse", "chorus", "bridge")
# Marks that end a value, those that don't between digits, and commas.
MARKS = "\n\r\t\u2028\u2029;|/.•·；｜／．。｡¦"
IN_NUMBERS = "/.／．"
COMMAS = ",，、"
# Pairs of quotes; the straight one is its own partner, and an apostrophe is none.
PAIRS = ("“”", "«»", "「」", "『』", "„“", "‹›")
BLANKS = " \t\n\r\v\f\u0085\u200b\u2060\ufeff" + "".join(chr(c) for a, z in WIDE_BLANKS for c in range(a, z + 1))
#: Bytes scanned at once, a bound on the memory of the masks.
CHUNK = 8 << 20


def _mask(b: np.ndarray, char: str) -> np.ndarray:
    """Where a character begins. b ends in padding."""
    e = char.encode()
    m = b[: len(b) - 4] == e[0]
    if len(e) > 1 and m.any():
        at = np.nonzero(m)[0]
        for i, x in enumerate(e[1:], 1):
            at = at[b[at + i] == x]
        m = np.zeros(len(b) - 4, bool)
        m[at] = True
    elif len(e) > 1:
        m = np.zeros(len(b) - 4, bool)
    return m


def _spread(m: np.ndarray, n: int) -> np.ndarray:
    out = m.copy()
    for i in range(1, n):
        out[i:] |= m[:-i]
    return out


def _any(b: np.ndarray, chars: str, whole: bool = False) -> np.ndarray:
    out = np.zeros(len(b) - 4, bool)
    for c in chars:
        m = _mask(b, c)
        out |= _spread(m, len(c.encode())) if whole else m
    return out


def _tags(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and names (index in TAGS) of the tags, in order."""
    low = np.where((b >= 65) & (b <= 90), b + 32, b)
    open_ = np.nonzero(b[: len(b) - 4] == ord("["))[0]
    got = []
    padded = np.r_[low, np.zeros(16, np.uint8)]
    for k, t in enumerate(TAGS):
        at = open_
        for i, x in enumerate(f"{t}]".encode(), 1):
            at = at[padded[at + i] == x]
        got.append(np.stack([at, at + len(t) + 2, np.full(len(at), k)]))
    s, e, k = np.concatenate(got, axis=1)
    o = np.argsort(s, kind="stable")
    return s[o], e[o], k[o]


def _quoted(b: np.ndarray, section: np.ndarray) -> np.ndarray:
    """Bytes inside quotes; in a section whose quotes of a kind don't pair up, the last straight quote, or that kind, counts for nothing."""
    n = len(b) - 4
    m = b[:n] == ord('"')
    slash = np.r_[False, b[: n - 1] == ord("\\")]
    at = np.nonzero(m & ~slash)[0]
    sec = section[at]
    last = np.r_[sec[1:] != sec[:-1], True][: len(at)]
    count = np.bincount(sec, minlength=1) if len(at) else np.zeros(1, int)
    at = at[~(last & (count[sec] % 2 == 1))] if len(at) else at
    step = np.zeros(n + 1, np.int32)
    step[at] = 1
    inside = np.cumsum(step)[:n] % 2 == 1  # every section has an even number, so parity starts anew in each
    for a, z in PAIRS[:4]:
        x, y = _mask(b, a), _mask(b, z)
        if not x.any() or not y.any():
            continue
        k = int(section[-1]) + 1 if n else 1
        even = np.bincount(section[x], minlength=k) == np.bincount(section[y], minlength=k)
        depth = np.cumsum((x & even[section]).astype(np.int32) - (y & even[section]))
        inside |= depth > 0
    return inside


def _gather(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.StringArray:
    n = e - s
    to = np.r_[0, np.cumsum(n)].astype(np.int32)
    src = np.repeat(s - to[:-1], n) + np.arange(to[-1])
    return pa.StringArray.from_buffers(len(s), pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(b[src])))


def _unquote(v: pa.StringArray) -> pa.Array:
    """Values without enclosing quotes, inner ones once and unescaped."""
    for a, z in PAIRS[:4]:
        both = pc.and_(pc.starts_with(v, a), pc.ends_with(v, z))
        if pc.any(both).as_py():
            inner = pc.utf8_slice_codeunits(v, 1, -1)
            v = pc.if_else(pc.and_(both, pc.invert(pc.or_(pc.match_substring(inner, a), pc.match_substring(inner, z)))), inner, v)
    both = pc.and_(pc.and_(pc.starts_with(v, '"'), pc.ends_with(v, '"')), pc.greater(pc.utf8_length(v), 1))
    inner = pc.utf8_slice_codeunits(v, 1, -1)
    bare = pc.replace_substring(pc.replace_substring(inner, '\\"', ""), '""', "")
    v = pc.if_else(pc.and_(both, pc.invert(pc.match_substring(bare, '"'))), inner, v)
    v = pc.replace_substring(pc.replace_substring(v, '\\"', '"'), '""', '"')
    return pc.utf8_trim(v, BLANKS)


def unpack_array(texts: pa.Array) -> pa.ListArray:
    """Each text as the list of its values; null and empty texts give empty lists."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    rows = len(texts)
    if not rows:
        return pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array([], pa.string()))
    texts = pa.concat_arrays([texts])  # a buffer of its own, from offset 0
    offsets = np.frombuffer(texts.buffers()[1], np.int32, rows + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0]) if texts.buffers()[2] else np.empty(0, np.uint8)
    offsets -= offsets[0]
    n = len(data)
    b = np.r_[data, np.zeros(4, np.uint8)]
    ts, te, tk = _tags(b)
    # sections: a row's beginning and every tag open one
    opens = np.zeros(n + 1, np.int32)
    np.add.at(opens, offsets[:-1], 1)
    np.add.at(opens, ts, 1)
    section = np.cumsum(opens)[:n]
    edge = np.unique(np.r_[offsets, ts])
    kind = np.zeros(len(edge), bool)
    kind[np.searchsorted(edge, ts)] = np.isin(tk, [TAGS.index(x) for x in VOCAL])
    vocal = kind[np.searchsorted(edge, np.arange(n), side="right") - 1] if n else np.zeros(0, bool)
    quoted = _quoted(b, section) if n else np.zeros(0, bool)
    digit = (b[:n] >= 48) & (b[:n] <= 57)
    wide = _any(b, "０１２３４５６７８９")
    ends, starts = np.r_[False, digit | np.r_[False, False, wide][:n]], np.r_[digit | wide, np.zeros(4, bool)]
    cut = np.zeros(n + 1, bool)
    for c in MARKS:
        m = _mask(b, c) & ~quoted
        w = len(c.encode())
        if c in IN_NUMBERS:
            m &= ~(ends[:n] & starts[w : n + w])
        cut[:n] |= _spread(m, w)
    cut[:n] |= np.cumsum(np.bincount(ts, minlength=n + 1) - np.bincount(te, minlength=n + 1))[:n] > 0
    blank = _any(b, BLANKS, True)
    # commas between a value and a tag or an end of the text, with nothing but blanks and marks around
    comma = _any(b, COMMAS, True) & ~quoted
    flesh = np.nonzero(~(cut[:n] | blank | comma))[0]
    at = np.nonzero(comma)[0]
    stop, start = np.unique(np.r_[ts, offsets[1:]]), np.unique(np.r_[te, offsets[:-1]])
    far = np.r_[-1, flesh, n]
    ahead = stop[np.minimum(np.searchsorted(stop, at), len(stop) - 1)] <= far[np.searchsorted(flesh, at) + 1]
    behind = start[np.maximum(np.searchsorted(start, at, side="right") - 1, 0)] > far[np.searchsorted(flesh, at)]
    cut[at[ahead | behind]] = True
    # values: stretches without a cut, within one vocal section, trimmed
    free = ~cut[:n] & vocal
    other = section[1:] != section[:-1]
    first = free & np.r_[True, ~free[:-1] | other][:n]
    last = free & np.r_[~free[1:] | other, True][:n]
    s, e = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    solid = np.nonzero(~blank)[0]
    far = np.r_[-1, solid, n]
    s, e = far[np.searchsorted(solid, s) + 1], far[np.searchsorted(solid, e)] + 1
    ok = s < e
    s, e = s[ok], e[ok]
    v = _unquote(_gather(b, s, e)) if len(s) else pa.array([], pa.string())
    parent = np.searchsorted(offsets, s, side="right") - 1
    full = np.asarray(pc.greater(pc.utf8_length(v), 0)) if len(s) else np.zeros(0, bool)
    counts = np.bincount(parent[full], minlength=rows)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), v.filter(pa.array(full)))


def _unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in it:
        at = 0
        while at < whole.num_rows:
            step = max(1, min(whole.num_rows - at, int(CHUNK * whole.num_rows / max(1, whole.nbytes))))
            b = whole.slice(at, step)
            at += step
            lists = unpack_array(b.column(1))
            parents = pc.list_parent_indices(lists)
            first = np.asarray(lists.offsets)[np.asarray(parents)]
            pos = pa.array((np.arange(len(parents)) - first + 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0).take(parents), pos, lists.flatten()], ["k", "pos", "line"])


def unpack(df: DataFrame, key: str, text: str, pos: str = "pos", line: str = "line") -> DataFrame:
    """(key, pos, line): one row per sung line of a packed song sheet, numbered from 1 through the whole text.

    Lines are the values of vocal sections. They end at any of MARKS outside
    quotes, of which IN_NUMBERS don't count between two digits; a comma ends one
    only next to a tag or at an end of the text. Values are trimmed, freed of
    enclosing quotes, inner quotes unescaped; empty ones have no row and no
    position. Null, empty and tag-only texts give no row; null keys are kept;
    repeated rows give repeated lines; other columns of df are left out. No
    shuffle: a text is scanned where it is read, in pieces of CHUNK bytes.
    """
    ship(df.sparkSession)
    src = df.select(F.col(key).alias("k"), plain_tags(F.col(text)).alias("t")).where("t is not null")
    kind = src.schema["k"].dataType.simpleString()
    return src.mapInArrow(_unpack, f"k {kind}, pos int, line string").select(F.col("k").alias(key), F.col("pos").alias(pos), F.col("line").alias(line))
