"""The language of each song and of each vocal section, by a byte convolutional network.

The network reads bytes as symbols, has filters of several widths over them, takes
each filter's maximum over a window and a softmax over languages; it is trained in
numpy. A filter's output at a byte is the sum of one entry of a table over the first
two symbols and one of a table over the next two, so a window costs two look-ups a
byte for all filters at once.
"""

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.functions.characters import DIRTY_PY, TAGS, has_words
from strophe.llm.fitting import smallest
from strophe.llm.lookalike import skeleton
from strophe.operators.unpack import VOCAL, _any, _tags
from strophe.session import ship

LANGS = ("en", "zh", "es", "fr", "de", "pt")
# What a label may call each language, besides its two-letter code, with or without a region.
NAMES = {
    "en": "eng english anglais inglés inglês englisch 英语 英文",
    "zh": "zho chi cmn yue chinese mandarin cantonese 中文 汉语 漢語 普通话 国语 华语",
    "es": "spa esl spanish castilian español espanol castellano 西班牙语",
    "fr": "fra fre french français francais 法语",
    "de": "deu ger german deutsch 德语",
    "pt": "por portuguese português portugues brazilian 葡萄牙语",
}
CODE = {n: k for k, v in NAMES.items() for n in [k, *v.split()]}
#: Bytes of a window, and windows evaluated at once (so that their filters' outputs stay in the processor's cache).
WINDOW, BATCH = 47, 400
#: Filters of width 2, 3 and 4.
FILTERS = {2: 8, 3: 16, 4: 16}
#: Most labelled songs, and most clean lines, that the network is fitted on; they're those with the smallest hashes.
FIT_SONGS, FIT_LINES = 1_500, 5_000
#: A line weighs as its length in bytes up to this many, so that interjections weigh little.
FULL_LINE = 24
_ENDS = "\n\r\t|;/.•。；!?！？、，"


def _symbols() -> np.ndarray:
    """Byte to one of 64 symbols: letters without case, apostrophe, continuation bytes by their low bits, lead bytes by kind, blank for the rest."""
    s = np.zeros(256, np.uint8)
    for i in range(26):
        s[65 + i] = s[97 + i] = 1 + i
    s[ord("'")] = 27
    s[0x80:0xC0] = 28 + (np.arange(64) & 31)
    s[0xC2:0xC4] = 60
    s[0xC4:0xE2] = 61
    s[0xE2] = 62
    s[0xE3:0xF5] = 63
    return s


SYMBOL = _symbols()


class Network:
    """W[k] are the taps (symbols x filters), V and c the softmax layer."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = sum(FILTERS.values())
        width = np.repeat(list(FILTERS), list(FILTERS.values()))
        self.live = np.stack([k < width for k in range(4)])[:, None, :]
        self.w = (r.normal(0, 0.3, (4, 64, f)) * self.live).astype(np.float32)
        self.bias = np.zeros(f, np.float32)
        self.v = r.normal(0, 0.1, (f, len(LANGS))).astype(np.float32)
        self.c = np.zeros(len(LANGS), np.float32)
        self.tables()
        self.freeze()

    def tables(self) -> None:
        self.a = (self.w[0][:, None] + self.w[1][None]).reshape(4096, -1)
        self.b = (self.w[2][:, None] + self.w[3][None]).reshape(4096, -1)

    def freeze(self) -> "Network":
        """Tables of 16-bit integers for scores()."""
        self.scale = 32_000 / float(np.abs(self.a).max() + np.abs(self.b).max() + 1e-6)
        self.ia, self.ib = (np.rint(t * self.scale).astype(np.int16) for t in (self.a, self.b))
        return self

    def scores(self, m: np.ndarray) -> np.ndarray:
        """Log-probabilities of the languages for windows, one a row of symbols."""
        f = self.ia.shape[1]
        top = np.empty((len(m), f), np.float32)
        x, y = np.empty((BATCH * (WINDOW + 1), f), np.int16), np.empty((BATCH * (WINDOW + 1), f), np.int16)
        for at in range(0, len(m), BATCH):
            part = m[at : at + BATCH].astype(np.int32)
            pair = part[:, :-1] * 64 + part[:, 1:]
            n = len(part) * (WINDOW + 1)
            np.take(self.ia, pair[:, :-2].ravel(), axis=0, out=x[:n], mode="clip")
            np.take(self.ib, pair[:, 2:].ravel(), axis=0, out=y[:n], mode="clip")
            z = np.add(x[:n], y[:n], out=x[:n]).reshape(len(part), WINDOW + 1, f)
            while z.shape[1] % 2 == 0:
                half = z.shape[1] // 2
                z = np.maximum(z[:, :half], z[:, half:])
            top[at : at + BATCH] = z.max(1)
        h = np.maximum(top / self.scale + self.bias, 0) @ self.v + self.c
        h -= h.max(1, keepdims=True)
        return h - np.log(np.exp(h).sum(1, keepdims=True))

    def fit(self, lines: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int, rate: float = 0.01, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        params = [self.w, self.bias, self.v, self.c]
        m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = r.permutation(len(lines))
            for at in range(0, len(order), 128):
                ids = order[at : at + 128]
                m = windows([cropped(lines[i], r) for i in ids])
                pair = m[:, :-1].astype(np.int32) * 64 + m[:, 1:]
                x = self.a[pair[:, :-2]] + self.b[pair[:, 2:]]
                arg = x.argmax(1)
                z = x.max(1) + self.bias
                h = np.maximum(z, 0) * (keep := (r.random(z.shape) > 0.2) / 0.8).astype(np.float32)
                o = h @ self.v + self.c
                o = np.exp(o - o.max(1, keepdims=True))
                g = o / o.sum(1, keepdims=True)
                g[np.arange(len(ids)), y[ids]] -= 1
                g *= (weight[ids] / len(ids))[:, None]
                gh = (g @ self.v.T) * (z > 0) * keep
                gw = np.zeros_like(self.w)
                cols = np.broadcast_to(np.arange(z.shape[1]), arg.shape)
                for k in range(4):
                    np.add.at(gw[k], (np.take_along_axis(m, arg + k, 1), cols), gh)
                grads = [gw * self.live + 1e-5 * self.w, gh.sum(0), h.T @ g + 1e-4 * self.v, g.sum(0)]
                step += 1
                for p, d, a, b in zip(params, grads, m1, m2):
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    p -= (rate * (0.97**epoch) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                self.tables()
        self.freeze()


def cropped(line: bytes, r: np.random.Generator) -> bytes:
    """A window of the line, now and then a shorter one."""
    n = min(len(line), WINDOW)
    if n > 16 and r.random() < 0.5:
        n = int(r.integers(12, n + 1))
    at = int(r.integers(0, len(line) - n + 1))
    return line[at : at + n]


def windows(lines: list[bytes]) -> np.ndarray:
    """Symbols of pieces of at most WINDOW bytes, one a row: a blank before, blanks behind."""
    flat = np.frombuffer(b"".join(lines), np.uint8)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    m = np.zeros((len(lines), WINDOW + 4), np.uint8)
    at = np.arange(WINDOW) < n[:, None]
    m[:, 1 : WINDOW + 1][at] = SYMBOL[flat]
    return m


def _normal(t: str) -> bytes:
    return (skeleton(t) if DIRTY_PY.search(t) else t).replace("’", "'").encode()


def parse(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Bytes of the texts, each behind a line break, and per line: start, end, text, number of its vocal section (0: in none). Then the vocal sections of each text."""
    data = b"\n" + b"\n".join(texts) + b"\n"
    b = np.r_[np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]
    n = len(data)
    begins = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)  # the break before each text
    ts, te, tk = _tags(b)
    vocal = np.isin(tk, [TAGS.index(v) for v in VOCAL])
    cut = _any(b, _ENDS, True)
    cut |= np.cumsum(np.bincount(ts, minlength=n + 1) - np.bincount(te, minlength=n + 1))[:n] > 0
    free = ~cut
    s = np.nonzero(free & np.r_[True, cut[:-1]])[0]
    e = np.nonzero(free & np.r_[cut[1:], True])[0] + 1
    letter = (SYMBOL[b[:n]] > 0) & (b[:n] != ord("'"))
    count = np.cumsum(np.r_[0, letter])
    ok = count[e] - count[s] > 1
    s, e = s[ok], e[ok]
    text = np.searchsorted(begins, s, side="right") - 1
    tag_text = np.searchsorted(begins, ts, side="right") - 1
    number = np.cumsum(vocal)
    first = np.searchsorted(tag_text, np.arange(len(texts)))
    base = np.r_[0, number][first]
    last = np.searchsorted(ts, s, side="right") - 1
    inside = (last >= 0) & (tag_text[last] == text) & vocal[last] if len(ts) else np.zeros(len(s), bool)
    section = np.where(inside, (number[last] if len(ts) else 0) - base[text], 0)
    return b, s, e, text, section, np.bincount(tag_text[vocal], minlength=len(texts))


def line_scores(net: Network, b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Log-probabilities of the languages for every line: the mean over its windows, weighted by length; equal lines are read once."""
    raw = b.tobytes()
    lines = [raw[i:j] for i, j in zip(s.tolist(), e.tolist())]
    index: dict[bytes, int] = {}
    which = np.fromiter((index.setdefault(x, len(index)) for x in lines), np.int64, len(lines))
    pieces, owner = [], []
    for i, x in enumerate(index):
        for at in range(0, len(x), WINDOW):
            pieces.append(x[at : at + WINDOW])
            owner.append(i)
    owner = np.array(owner, np.int64)
    share = np.fromiter(map(len, pieces), np.float32, len(pieces))
    share /= np.bincount(owner, share, minlength=len(index))[owner]
    got = net.scores(windows(pieces)) * share[:, None]
    out = np.stack([np.bincount(owner, got[:, k], minlength=len(index)) for k in range(len(LANGS))], axis=1)
    return out[which]


def judge(net: Network, texts: list[bytes]):
    """Per (text, section): section 0 is the whole text, by the language of most lines; others are its vocal sections with words. Gives text, section, language, confidence."""
    b, s, e, text, section, _ = parse(texts)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    score = np.maximum(line_scores(net, b, s, e), -6.0)
    score *= (np.minimum(e - s, FULL_LINE) / FULL_LINE)[:, None]
    key = text * (int(section.max()) + 2) + section
    keys, at = np.unique(key, return_inverse=True)
    total = np.zeros((len(keys), len(LANGS)))
    np.add.at(total, at, score)
    lines = np.bincount(at)
    mean = total / lines[:, None]
    # a line's language, leaning to that of its section, votes for the whole
    vote = (score + mean[at]).argmax(1)
    votes = np.zeros((len(texts), len(LANGS)))
    np.add.at(votes, (text, vote), 1.0)
    whole = np.zeros((len(texts), len(LANGS)))
    np.add.at(whole, text, score / 1e3)
    have = np.nonzero(votes.sum(1))[0]
    main = (votes + whole)[have].argmax(1)
    share = votes[have, main] / votes[have].sum(1)
    kt, ks = keys // (int(section.max()) + 2), keys % (int(section.max()) + 2)
    p = np.exp(mean - mean.max(1, keepdims=True))
    vocal = ks > 0
    return (
        np.r_[have, kt[vocal]], np.r_[np.zeros(len(have), np.int64), ks[vocal]],
        np.r_[main, total.argmax(1)[vocal]], np.r_[share, (p.max(1) / p.sum(1))[vocal]],
    )


def normal_label(label: str | None) -> str | None:
    """The language that a label names, whatever its spelling; None if it names none of LANGS."""
    x = (label or "").strip().lower()
    return CODE.get(x) or CODE.get(re.split(r"[-_ (]", x)[0])


def _judge(it: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for at in range(0, whole.num_rows, 2000):
            rows = whole.slice(at, 2000)
            text, section, lang, sure = judge(net, [_normal(t) for t in rows.column(1).to_pylist()])
            label = [normal_label(x) for x in rows.column(2).to_pylist()]
            cols = [rows.column(0).take(pa.array(text)), pa.array(section.astype(np.int32)), pa.array([LANGS[i] for i in lang], pa.string()), pa.array(sure.astype(np.float64)), pa.array([label[i] for i in text], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["k", "section", "lang", "confidence", "label"])


def train(samples: DataFrame, songs: DataFrame | None = None, text: str = "lyrics", label: str = "lang", key: str = "row_id", fit_songs: int = FIT_SONGS) -> Network:
    """A network fitted on at most FIT_LINES clean labelled lines (lang, text), then on lines of at most fit_songs labelled songs.

    Lines and songs are those with the smallest hashes, so the fit doesn't depend
    on partitioning, and the driver gets no more than them. Their labels may be wrong: a line counts only if the network, as
    fitted on the clean lines, finds the labelled language at least as likely as 0.3.
    Null keys, null or unknown labels and null texts are left out; without clean lines the
    songs' labels are taken as they are.
    """
    given = smallest(samples.select("text", "lang").where("text is not null and lang is not null"), F.xxhash64(F.lit(13), "text", "lang"), FIT_LINES)
    clean = [(_normal(r.text), LANGS.index(normal_label(r.lang))) for r in sorted(given.collect()) if normal_label(r.lang)]
    net = Network()
    lines, y = [x for x, _ in clean], np.array([k for _, k in clean], np.int64)
    if lines:
        net.fit(lines, y, np.ones(len(y), np.float32), 30)
    if songs is None:
        return net
    labelled = songs.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.xxhash64(F.lit(11), key, text).alias("h"), F.col(text).alias("t"), F.col(label).alias("l"))
    some = sorted(smallest(labelled, F.col("h"), fit_songs).collect())
    known = [(r.t, normal_label(r.l)) for r in some]
    known = [(t, k) for t, k in known if k]
    if not known:
        return net
    b, s, e, owner, _, _ = parse([_normal(t) for t, _ in known])
    lab = np.array([LANGS.index(k) for _, k in known])[owner]
    raw = b.tobytes()
    if lines:
        p = np.exp(line_scores(net, b, s, e))
        keep = p[np.arange(len(lab)), lab] > 0.3
        # lines of another language, where the network is sure, teach that language
        sure = ~keep & (p.max(1) > 0.97) & (e - s > 20)
        lab = np.where(sure, p.argmax(1), lab)
        keep |= sure
    else:
        keep = np.ones(len(lab), bool)
    chosen = np.nonzero(keep)[0]
    _, first = np.unique([raw[s[i]:e[i]] for i in chosen], return_index=True)
    chosen = chosen[first]
    lines += [raw[s[i] : e[i]] for i in chosen]
    y = np.r_[y, lab[chosen]]
    weight = (len(y) / (len(LANGS) * np.maximum(np.bincount(y, minlength=len(LANGS)), 1)))[y].astype(np.float32)
    net = Network()
    net.fit(lines, y, np.minimum(weight, 5), 6)
    return net


def languages(df: DataFrame, net: Network, key: str = "row_id", text: str = "lyrics", label: str = "lang") -> DataFrame:
    """(key, section, lang, confidence, label): section 0 for each text with words, then each of its vocal sections.

    Section 0 has the language of most lines and their share; other sections have
    the language of their lines together, and its probability, so neither an
    interjection nor a single line changes it. label is the language the delivered
    label names, null if none. Null or wordless texts give no row; null keys are
    kept; a section without words has no row but keeps its number; texts of any
    length are read whole. One pass, no shuffle; the network is 60 kB.
    """
    ship(df.sparkSession)
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l")).where(has_words(F.col("t")))
    kind = src.schema["k"].dataType.simpleString()
    out = src.mapInArrow(partial(_judge, net=net), f"k {kind}, section int, lang string, confidence double, label string")
    return out.withColumnRenamed("k", key)


def _wrong(it: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    """The rows of `_judge` that correct a label or tell the sections of a mixed song apart; a text's rows are in one batch."""
    for rows in it:
        for at in range(0, rows.num_rows, 2000):
            part = rows.slice(at, 2000)
            text, section, lang, _ = judge(net, [_normal(t) for t in part.column(1).to_pylist()])
            label = np.array([LANGS.index(k) if (k := normal_label(x)) else -1 for x in part.column(2).to_pylist()])
            sung = section > 0
            lo, hi = np.full(part.num_rows, 99), np.full(part.num_rows, -1)
            np.minimum.at(lo, text[sung], lang[sung])
            np.maximum.at(hi, text[sung], lang[sung])
            keep = np.where(sung, lo[text] != hi[text], lang != label[text])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(text[keep])), pa.array(section[keep].astype(np.int32)), pa.array([LANGS[i] for i in lang[keep]], pa.string())], ["k", "section", "lang"]
            )


def corrections(df: DataFrame, net: Network, key: str = "row_id", text: str = "lyrics", label: str = "lang") -> DataFrame:
    """(key, section, lang): section 0 where the label names no or another language than the main one; all vocal sections where they differ in language."""
    ship(df.sparkSession)
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l")).where(has_words(F.col("t")))
    kind = src.schema["k"].dataType.simpleString()
    return src.mapInArrow(partial(_wrong, net=net), f"k {kind}, section int, lang string").withColumnRenamed("k", key)
