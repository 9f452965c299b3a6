"""Abusive, hateful, threatening or sexual lines, by weak supervision.

Voters (lexicons by category, patterns, statistics of the labelled songs, and the
songs' labels themselves, whose accuracy is known) vote on the lines of songs. A generative model
estimates, without line labels, how each voter votes on abusive and on harmless
lines, and how far voters repeat each other; its posteriors are the soft labels of
a linear classifier over words and pairs of words, which scores every line.
"""

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.functions.characters import DIRTY_PY, has_words
from strophe.llm.fitting import smallest
from strophe.llm.lookalike import skeleton
from strophe.session import ship

CATEGORIES = ("insult", "hate", "threat", "sexual")
#: Most labelled songs that the model is fitted on (those with the smallest hashes), songs that it is fitted on at least, and most terms.
FIT_SONGS, LEAST_SONGS, MOST_TERMS = 6_000, 1_500, 100_000
#: Abusive lines of a flagged song, and how much rarer they are in unlabelled songs than in the labelled ones.
ABUSIVE_LINES, UNLABELLED = 1.0, 0.2
#: A song with a line of at least this probability is abusive.
THRESHOLD = 0.5
# Words that address someone, in the six languages.
ADDRESS = "you your you're youre u du dich dir dein deine tu te ti tus toi ta ton tes vous você voce vc seu sua teu tua 你 您".split()
# Signs written for letters.
LEET = dict(zip("013456789@$!+€", "oieasgtbgasite"))
_MASKS = "*#_%&?"
_HAN = "㐀-鿿"
_BREAK = re.compile(r"[\n\r\t|;/.•。；?？！!\[\]]|,(?=\s*\[)")
_TOKEN = re.compile(rf"[{_HAN}]|[^\W\d_{_HAN}]+|[\n\r\t|;/.•。；?？！!\[\]]")
_TAG = re.compile(r"\[(?:intro|verse|chorus|bridge|inst|outro|silence)\]")
_SPACED = re.compile(r"(?<![\w@$*#])[\w@$!*#]([ \-_.*~])(?:[\w@$!*#]\1)+[\w@$!*#](?![\w@$*#])")
_HAN_CUT = re.compile(rf"(?<=[{_HAN}])[_*~^#+\-·]+(?=[{_HAN}])")
_HAN_SPACED = re.compile(rf"[{_HAN}](?: [{_HAN}]){{2,}}")
_WRITTEN = re.compile(r"[^\s\[\]/|;,.。；•\"“”«»「」()]+")
_BREAKS = frozenset("\n\r\t|;/.•。；?？！![]")


def bare(word: str) -> str:
    """A lower-case word without accents, and every run of a letter as one."""
    w = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)) if not word.isascii() else word
    return re.sub(r"([^\W\d_])\1+", r"\1", w) if not re.match(f"[{_HAN}]", w) else w


class Decoder:
    """Undoes signs written for letters; masked letters are looked up among known words."""

    def __init__(self, known: dict[str, float]):
        self.known = known
        self.masked: dict[str, str] = {}
        for w in sorted(known, key=lambda w: (known[w], w)):
            if 3 <= len(w) <= 16:
                for i in range(len(w)):
                    self.masked[w[:i] + "*" + w[i + 1 :]] = w

    def word(self, x: str) -> str:
        letters = sum(c.isalpha() for c in x)
        signs = [c for c in x if c in LEET or c in _MASKS]
        if not signs or not letters and sum(c.isdigit() for c in x) < 3 or letters and x.lstrip("0123456789").isalpha():
            return x
        tail = ""
        while len(x) > 1 and x[-1] in "!?":
            x, tail = x[:-1], x[-1] + tail
        x = x.strip("-'’")
        best = ""
        for one in "il":
            y = "".join(LEET.get(c, c) if c != "1" else one for c in x)
            y = re.sub(r"[^\w*#%&?]", "", y) if "-" not in y else y
            z = "".join("*" if c in _MASKS else c for c in y)
            z = "".join(c for c in unicodedata.normalize("NFD", z) if not unicodedata.combining(c))
            z = re.sub(r"([^\W\d_])\1+", r"\1", z)
            if z in self.known:
                return y + tail
            if "*" in z:
                if (w := self.masked.get(z) or self.known.get(z.replace("*", "")) is not None and z.replace("*", "")):
                    return w + tail
            best = best or y.replace("*", "")
        return best + tail

    def text(self, t: str) -> str:
        t = _SPACED.sub(lambda m: m[0].replace(m[1], ""), t)
        t = _HAN_SPACED.sub(lambda m: m[0].replace(" ", ""), _HAN_CUT.sub("", t))
        return _WRITTEN.sub(lambda m: self.word(m[0]), t)


def _kinds() -> np.ndarray:
    """What a byte may be: 1 a letter, 2 a sign for one, 4 an ASCII letter, 8 between letters set apart, 16 the lead of a Han character."""
    k = np.zeros(256, np.uint8)
    k[97:123] |= 5
    k[128:] |= 1
    k[list(b"0123456789@$!*#_%&")] |= 2
    k[list(b" _*~^#+-")] |= 8
    k[0xE3:0xEA] |= 16
    return k


_KIND = _kinds()


def disguised(texts: list[str]) -> np.ndarray:
    """Which lower-case texts may write words in other ways: a sign for a letter beside one, letters set apart, or a letter three times."""
    data = b"\n\n\n\n" + b"\n\n\n\n\n\n".join(t.encode() for t in texts) + b"\n\n\n\n\n\n"
    b = np.frombuffer(data, np.uint8)
    kind = _KIND[b]
    letter, sign = kind & 1, (kind & 2) > 0
    letter = letter > 0
    hit = np.zeros(len(b), bool)
    hit[1:-1] = sign[1:-1] & (letter[:-2] & (b[1:-1] != 33) | letter[2:])
    same = b[1:] == b[:-1]
    hit[2:] |= same[1:] & same[:-1] & ((kind[2:] & 4) > 0)
    lone = letter.copy()
    lone[1:] &= ~letter[:-1]
    lone[:-1] &= ~letter[1:]
    hit[4:] |= lone[4:] & lone[2:-2] & lone[:-4]
    # Han characters set apart: a blank or sign between two characters of three bytes
    hit[1:-1] |= ((kind[1:-1] & 8) > 0) & (b[:-2] >= 128) & ((kind[2:] & 16) > 0)
    starts = np.r_[4, 4 + np.cumsum([len(t.encode()) + 6 for t in texts])[:-1]].astype(np.int64) if texts else np.zeros(0, np.int64)
    return np.logical_or.reduceat(hit, starts) if texts else np.zeros(0, bool)


class Words(dict):
    """Written word to number; new words get numbers while growing, else 0. Breaks are -1."""

    def __init__(self, numbers: dict[str, int] | None = None):
        super().__init__()
        self.growing = numbers is None
        self.numbers = {"": 0} if numbers is None else numbers

    def __missing__(self, w: str) -> int:
        if w in _BREAKS:
            v = -1
        else:
            k = bare(w)
            v = self.numbers.setdefault(k, len(self.numbers)) if self.growing else self.numbers.get(k, 0)
        if len(self) > 300_000:
            self.clear()
        self[w] = v
        return v


def tokens(texts: list[str], decoder: Decoder | None, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of all texts end to end (a -1 before each and at breaks), the text of each, and which texts were decoded."""
    low = [(skeleton(t) if DIRTY_PY.search(t) else t).lower() for t in texts]
    odd = disguised(low)
    if decoder:
        low = [decoder.text(t) if o else t for t, o in zip(low, odd)]
    get = words.__getitem__
    found = [_TOKEN.findall(_TAG.sub("[", t)) for t in low]
    n = np.fromiter((len(f) + 1 for f in found), np.int64, len(found))
    flat = np.fromiter((i for f in found for i in (-1, *map(get, f))), np.int64, int(n.sum()))
    return flat, np.repeat(np.arange(len(found)), n), odd


class Model:
    """A weight per word, per pair of adjacent words, and a bias."""

    def __init__(self, numbers: dict[str, int], uni: np.ndarray, pairs: np.ndarray, pair_weights: np.ndarray, bias: float, decoder: Decoder):
        self.numbers, self.uni, self.pairs, self.pair_weights, self.bias, self.decoder = numbers, uni, pairs, pair_weights, bias, decoder
        self.words: Words | None = None

    def _table(self) -> None:
        """The pairs' weights in a hash table with as many slots a bucket as its fullest needs."""
        self.bits = max(4, (2 * len(self.pairs)).bit_length())
        bucket = self._bucket(self.pairs)
        order = np.argsort(bucket, kind="stable")
        rank = np.arange(len(order)) - np.searchsorted(bucket[order], bucket[order])
        depth = int(rank.max()) + 1 if len(order) else 1
        self.slots = np.full((depth, 1 << self.bits), -1, np.int64)
        self.held = np.zeros((depth, 1 << self.bits))
        self.slots[rank, bucket[order]] = self.pairs[order]
        self.held[rank, bucket[order]] = self.pair_weights[order]

    def _bucket(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair(self, key: np.ndarray) -> np.ndarray:
        b = self._bucket(key)
        return sum(np.where(s[b] == key, h[b], 0.0) for s, h in zip(self.slots, self.held))

    def scores(self, texts: list[str]) -> np.ndarray:
        """The highest probability of any line of each text."""
        if self.words is None:
            self.words = Words(self.numbers)
            self._table()
        ids, owner, _ = tokens(texts, self.decoder, self.words)
        if not len(ids):
            return np.zeros(len(texts))
        w = np.where(ids > 0, self.uni[np.maximum(ids, 0)], 0.0)
        both = (ids[:-1] > 0) & (ids[1:] > 0)
        at = np.nonzero(both)[0]
        w[at + 1] += self._pair(ids[at] * len(self.uni) + ids[at + 1])
        starts = np.nonzero(ids == -1)[0]
        line = np.add.reduceat(w, starts)
        top = np.full(len(texts), -50.0)
        np.maximum.at(top, owner[starts], line)
        return 1 / (1 + np.exp(-(top + self.bias)))


def _lines(ids: np.ndarray, owner: np.ndarray) -> tuple[list[tuple[int, ...]], list[int]]:
    starts = np.nonzero(ids == -1)[0]
    out, who = [], []
    for s, e in zip(starts, np.r_[starts[1:], len(ids)]):
        if e - s > 1:
            out.append(tuple(ids[s + 1 : e].tolist()))
            who.append(int(owner[s]))
    return out, who


def label_model(votes: np.ndarray, prior: float = 0.05, rounds: int = 40, known: dict[int, tuple[float, float, float]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, tables P(vote | class) as (voter, vote + 1, class), and correlations of voters given the class.

    Expectation maximisation over votes in {-1, 0, 1}; prior is the share of the
    class. After a first fit, each voter counts with weight 1 / (1 + its positive
    correlations with the others given the class), so voters that repeat each
    other share one voice. known: the log-likelihood ratios of voters that aren't
    estimated, by vote; they count in full.
    """
    n, m = votes.shape
    known = known or {}
    free = [j for j in range(m) if j not in known]
    table = np.empty((m, 3, 2))
    table[:, :, 1] = (0.1, 0.4, 0.5)
    table[:, :, 0] = (0.5, 0.4, 0.1)
    weight = np.ones(m)
    given = sum((np.array(r)[votes[:, j] + 1] for j, r in known.items()), np.zeros(n))
    cor = np.eye(m)
    for turn in range(2):
        for _ in range(rounds):
            ratio = np.log(table[:, :, 1] / table[:, :, 0])
            z = sum((weight[j] * ratio[j][votes[:, j] + 1] for j in free), given) + np.log(prior / (1 - prior))
            post = 1 / (1 + np.exp(np.clip(-z, -50, 50)))
            for j in free:
                for v in range(3):
                    hit = votes[:, j] == v - 1
                    table[j, v, 1] = (post[hit].sum() + 1.0) / (post.sum() + 3)
                    table[j, v, 0] = ((1 - post)[hit].sum() + 1.0) / ((1 - post).sum() + 3)
                if table[j, 2, 1] * table[j, 0, 0] < table[j, 2, 0] * table[j, 0, 1]:  # a voter is never taken for its opposite
                    table[j, :, 0] = table[j, :, 1] = table[j].mean(1)
        if turn == 0:
            mean = [(votes * p[:, None]).sum(0) / max(p.sum(), 1e-9) for p in (1 - post, post)]
            rest = votes - ((1 - post)[:, None] * mean[0] + post[:, None] * mean[1])
            sd = rest.std(0) + 1e-9
            cor = (rest / sd).T @ (rest / sd) / max(n, 1)
            own = np.maximum(cor - np.eye(m), 0).clip(0, 1)[:, free].sum(1)
            weight = 1 / (1 + own)
    return post, table, cor


def fit(songs: DataFrame, labels: DataFrame, terms: DataFrame, fit_songs: int = FIT_SONGS) -> Model:
    """A model from labelled songs (row_id, lyrics; row_id, flagged) and terms (term, category).

    At most fit_songs labelled songs, those with the smallest hashes, are taken to
    the driver; where there are less than LEAST_SONGS, unlabelled ones (with an
    unknown label) make up for them, so that few labels don't make usual words look
    abusive. Null keys, texts, labels and terms are left out; over MOST_TERMS
    terms are an error. Without labelled songs the terms alone are the model.
    """
    given = terms.where("term is not null").select("term", "category").distinct().limit(MOST_TERMS + 1).collect()
    if len(given) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms")
    lexicon = sorted((r.term.lower(), r.category or "") for r in given)
    texts = songs.select("row_id", "lyrics").where("row_id is not null and lyrics is not null")
    known = labels.where("flagged is not null").select("row_id", "flagged").distinct()
    hashed = F.xxhash64(F.lit(3), "row_id", "lyrics")
    rows = sorted(smallest(texts.join(known, "row_id"), hashed, fit_songs).select(hashed.alias("h"), "row_id", "lyrics", "flagged").collect())
    more: list[str] = []
    if lack := max(0, min(LEAST_SONGS, fit_songs) - len(rows)):
        others = texts.where(has_words(F.col("lyrics"))).join(labels.select("row_id"), "row_id", "left_anti")
        more = [r.lyrics for r in sorted(smallest(others, hashed, lack).select(hashed.alias("h"), "row_id", "lyrics").collect())]
    return learn([r.lyrics for r in rows], np.array([r.flagged for r in rows], bool), lexicon, more)


def learn(texts: list[str], flagged: np.ndarray, lexicon: list[tuple[str, str]], background: list[str] | tuple[()] = ()) -> Model:
    """A model from labelled texts, and unlabelled ones that show which words are usual; lexicon: terms with their categories."""
    label = np.r_[np.where(flagged, 1, -1), np.zeros(len(background), np.int64)].astype(np.int64)
    texts = [*texts, *background]
    plain = Words()
    ids, owner, _ = tokens(texts, None, plain)
    seen = Counter(ids[(ids > 0) & (label[owner] > 0)].tolist()) if len(texts) else Counter()
    names = {v: k for k, v in plain.numbers.items()}
    # words that masked ones may stand for, the likelier abusive the better
    clean = Counter(ids[(ids > 0) & (label[owner] <= 0)].tolist()) if len(texts) else Counter()
    known = {names[i]: (n + 0.5) / (clean[i] + 0.5) for i, n in seen.items() if len(names[i]) > 2}
    for term, _ in lexicon:
        known |= {bare(w): 1e6 for w in _TOKEN.findall(term) if len(w) > 2}
    decoder = Decoder(known)
    words = Words()
    ids, owner, odd = tokens(texts, decoder, words)
    lines, who = _lines(ids, owner)
    # songs that hold a word or a pair, flagged or not; unlabelled ones count as not
    uni, pair = (defaultdict(lambda: [0, 0]) for _ in range(2))
    words_of, pairs_of = defaultdict(set), defaultdict(set)
    for x, s in zip(lines, who):
        words_of[s].update(x)
        pairs_of[s].update(zip(x, x[1:]))
    for store, of in ((uni, words_of), (pair, pairs_of)):
        for s, keys in of.items():
            f = int(label[s] > 0)
            for k in keys:
                store[k][f] += 1
    nf, nu = max(1, int((label > 0).sum())), max(1, int((label <= 0).sum()))
    # how much likelier a word or pair is in flagged songs; a song's own use says nothing about it
    ratio = lambda c, f: math.log((c[1] - f + 0.5) / nf) - math.log((c[0] - (not f) + 0.5) / nu)
    clean_lines = {x for x, s in zip(lines, who) if label[s] < 0}
    address = {words[w] for w in ADDRESS}
    lex = defaultdict(list)
    for term, category in lexicon:
        if (k := tuple(words[w] for w in _TOKEN.findall(term))) and category in CATEGORIES:
            lex[k[0]].append((k, CATEGORIES.index(category)))
    lone = {k for k, x in lex.items() if any(len(t) == 1 for t, _ in x)}
    mean = lambda x: sum(x) / len(x)
    votes = np.zeros((len(lines), len(CATEGORIES) + 8), np.int64)
    telling = np.zeros(len(lines))
    for i, (x, s) in enumerate(zip(lines, who)):
        any_term = False
        for at, t in enumerate(x):
            for k, j in lex.get(t, ()):
                if x[at : at + len(k)] == k:
                    votes[i, j] = any_term = True
        f = label[s] > 0
        u = [ratio(uni[k], f) for k in x]
        p = [ratio(pair[k], f) for k in zip(x, x[1:])]
        top, usual = max(u), x in clean_lines
        telling[i] = mean(p + u) if len(x) > 2 and not usual else -9.0
        votes[i, 4:] = (
            1 if any_term and address.intersection(x) else -1 if not any_term and top < 0.7 else 0,
            1 if top > 2.5 else -1 if top < 1 else 0,
            (1 if sum(q > 1.5 for q in p) > 1 else -1 if max(p) < 0.7 else 0) if p else 0,
            -1 if usual else 1 if mean(p or u) > 1.2 else 0,
            1 if mean(u) > 1.5 else -1 if mean(u) < 0.5 else 0,
            1 if odd[s] and top > 2 else 0,
            label[s],  # the song's label: no line of an unflagged song is abusive
            0,
        )
    # a flagged song has an abusive line: the one with the most telling words gets a vote
    best: dict[int, int] = {}
    for i, s in enumerate(who):
        if label[s] > 0 and telling[i] > telling[best.setdefault(s, i)]:
            best[s] = i
    votes[[i for i in best.values() if telling[i] > 0], -1] = 1
    # the song's label is the voter whose accuracy is known: abusive lines are in flagged songs alone, about ABUSIVE_LINES in each
    line_label = votes[:, -2]
    bad, good = int((line_label > 0).sum()), int((line_label < 0).sum())
    share = min(0.3, ABUSIVE_LINES * nf / max(1, bad + good))  # nf is at least 1
    known = {votes.shape[1] - 2: (-8.0, math.log(UNLABELLED), math.log(max(1, bad + good) / max(1, bad)))}
    post = label_model(votes, share, known=known)[0] if len(lines) else np.zeros(0)
    return _classifier(words, decoder, lines, post, lone)


def _classifier(words: Words, decoder: Decoder, lines: list[tuple[int, ...]], post: np.ndarray, lone: set[int], epochs: int = 20) -> Model:
    """Logistic regression on soft labels, by Adagrad over batches; a pair must be in two lines, equal lines with equal labels count once."""
    merged: dict[tuple[int, ...], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for x, p in zip(lines, post):
        merged[x][0] += p
        merged[x][1] += 1
    size = len(words.numbers)
    count = Counter(k for x in merged for k in set(zip(x, x[1:])))
    pairs = sorted(a * size + b for (a, b), n in count.items() if n > 1)
    at = {k: i for i, k in enumerate(pairs)}
    rows, cols, y, weight = [], [], [], []
    for i, (x, (p, n)) in enumerate(merged.items()):
        f = [*x, *(size + at[k] for k in (a * size + b for a, b in zip(x, x[1:])) if k in at)]
        rows += [i] * len(f)
        cols += f
        y.append(p / n)
        weight.append(min(n, 3.0))
    w, bias = np.zeros(size + len(pairs)), -2.0
    w[list(lone)] = 1.5
    prior = w.copy()
    rows, cols, y, weight = np.array(rows, np.int64), np.array(cols, np.int64), np.array(y), np.array(weight)
    edge = np.searchsorted(rows, np.arange(len(y) + 1))
    weight = weight * np.where(y > 0.5, 2.0, 1.0)
    g2, gb = np.full(len(w), 0.1), 0.1
    r = np.random.default_rng(5)
    order = r.permutation(len(y))
    blocks = [order[i : i + 512] for i in range(0, len(order), 512)]
    prepared = []
    for ids in blocks:
        idx = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in ids])
        prepared.append((ids, cols[idx], np.repeat(np.arange(len(ids)), edge[ids + 1] - edge[ids])))
    for _ in range(epochs if len(y) else 0):
        for ids, c, o in prepared:
            z = np.bincount(o, w[c], minlength=len(ids)) + bias
            d = (1 / (1 + np.exp(-z)) - y[ids]) * weight[ids]
            g = np.bincount(c, d[o], minlength=len(w)) / 8 + 2e-4 * (w - prior)
            g2 += g * g
            w -= 0.3 * g / np.sqrt(g2)
            b = d.sum() / 8
            gb += b * b
            bias -= 0.3 * b / np.sqrt(gb)
    return Model(words.numbers, w[:size], np.array(pairs, np.int64), w[size:], float(bias), decoder)


def _score(it: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    m = model.value
    for whole in it:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m.scores(b.columns[-1].to_pylist()))], [*b.schema.names[:-1], "score"])


def score(df: DataFrame, model: Model, key: str = "row_id", text: str = "lyrics", *also: str) -> DataFrame:
    """(key, also..., score): for every text with words, the highest probability that one of its lines is abusive.

    Null and wordless texts have no row; null keys and repeated rows are kept;
    texts are read whole, in any disguise of their words. One pass, no shuffle;
    the model (words and pairs of at most FIT_SONGS songs) is broadcast.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(F.col(key).alias("k"), *(F.col(c) for c in also), F.col(text).alias("t")).where(has_words(F.col("t")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score(it, shared)

    return src.mapInArrow(run, f"{schema}, score double").withColumnRenamed("k", key)


def scores(songs: DataFrame, labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(row_id, score) of every song with words."""
    return score(songs, fit(songs, labels, terms))


def unlabelled_abuse(songs: DataFrame, labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(row_id) of the abusive songs that have no label."""
    found = score(songs, fit(songs, labels, terms)).where(F.col("score") >= THRESHOLD).select("row_id")
    return found.join(labels.select("row_id"), "row_id", "left_anti").distinct()


def rates(songs: DataFrame, labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(source, songs, abusive, rate): of each source (null is one), its songs with words and the share of abusive ones."""
    scored = score(songs, fit(songs, labels, terms), "row_id", "lyrics", "source")
    n, a = F.count(F.lit(1)), F.count_if(F.col("score") >= THRESHOLD)
    return scored.groupBy("source").agg(n.alias("songs"), a.alias("abusive"), (a / n).alias("rate"))
