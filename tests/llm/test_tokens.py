"""Encoding, packing and sampling: exact comparisons and properties."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strophe.llm import bpe, packing, sampling

need = pytest.mark.skipif(not os.path.isfile(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary")


@pytest.fixture(scope="module")
def vocab():
    with open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return bpe.vocabulary(f.read())


@pytest.fixture(scope="module")
def public(vocab):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=vocab.ids, special_tokens={})


@need
def test_fixed_texts(vocab, public):
    texts = ["Hello world", "<|endoftext|>", "a" * 3000, "中文歌词" * 200, "  \n\n\t x", "é́🎵", "don't WE'LL 12345 !!!", "".join(random.Random(1).choices("abcdefgh", k=4000))]
    assert vocab.encode(texts) == [public.encode_ordinary(t) for t in texts]
    assert vocab.encode([None, "", "x"])[:2] == [[], []]


@need
@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(vocab, public, x):
    if any(0xD800 <= ord(c) < 0xE000 for c in x):
        return
    assert vocab.encode([x]) == [public.encode_ordinary(x)]
    back = {v: k for k, v in vocab.ids.items()}
    assert b"".join(back[i] for i in vocab.encode([x])[0]).decode() == x


@need
def test_forgotten_pieces(vocab, public, monkeypatch):
    """A batch that comes when more pieces are remembered than the cap, and shares some of them."""
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    vocab.seen.clear()
    for i in range(30):
        text = f"on the hill {chr(97 + i % 26) * (3 + i // 26)}"
        assert vocab.encode([text]) == [public.encode_ordinary(text)]


@need
def test_tables(spark):
    df = spark.createDataFrame([(1, "a b", "q"), (2, None, "q"), (3, "", "q"), (None, "a b", "q"), (1, "a b", "q")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in bpe.encode(df, bpe.load(spark)).collect()]
    assert sorted((i or 0, x) for i, x in got) == [(0, [64, 275]), (1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert {(r.doc_id, r.tokens) for r in bpe.sizes(df, bpe.load(spark)).collect()} == {(1, 2), (2, 0), (3, 0), (None, 2)}
    assert bpe.encode(df.limit(0), bpe.load(spark)).collect() == []


def test_packing(spark):
    r = np.random.default_rng(2)
    n = [int(x) for x in r.gamma(2, 120, 2500)] + [0, 5000, 1024, 512]
    items = spark.createDataFrame([*enumerate(n), (9001, None), (None, 7)], "doc_id bigint, tokens bigint")
    caps = spark.createDataFrame([("s", 512), ("l", 2048), ("bad", 0), ("none", None)], "pack_name string, capacity int")
    rows = packing.pack(items, caps).collect()
    assert {x.pack_name for x in rows} == {"s", "l"}
    for name, cap in (("s", 512), ("l", 2048)):
        mine = [x for x in rows if x.pack_name == name]
        fill, size, parts = {}, {}, {}
        for x in mine:
            fill[x.container] = fill.get(x.container, 0) + x.tokens
            size[x.doc_id] = size.get(x.doc_id, 0) + x.tokens
            parts.setdefault(x.doc_id, []).append(x.part)
        assert max(fill.values()) <= cap
        assert size == dict(enumerate(n)) | {9001: 0, None: 7}
        assert all(p == [0] if size[i] <= cap else sorted(p) == list(range(1, -(-size[i] // cap) + 1)) for i, p in parts.items())
        assert len(fill) <= 1.02 * -(-sum(size.values()) // cap) + 1
    again = {tuple(x) for x in packing.pack(items.repartition(7), caps).collect()}
    assert again == {tuple(x) for x in rows}
    assert packing.pack(items.limit(0), caps).collect() == []


def test_crossover_keeps_every_item():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 60, 200)
    a, b = (packing._seed(sizes, 100, r, False) for _ in range(2))
    for _ in range(20):
        child = packing._cross(sizes, a, b, 100, r)
        assert sorted(j for x in child for j in x) == list(range(200)) and max(sizes[x].sum() for x in child) <= 100
        a, b = b, child


def test_permutation_is_one_to_one(spark):
    df = spark.range(20_000).select(sampling.permuted(F.col("id")).alias("p"))
    r = df.agg(F.count_distinct("p").alias("n"), F.min("p").alias("a"), F.max("p").alias("b")).first()
    assert r.n == 20_000 and 0 <= r.a and r.b < 1 << 2 * sampling.HALF


def test_sample(spark):
    rows = [(i, f"song{i}", 1) for i in range(4000)] + [(5000, None, 1), (5001, "", 1), (5002, " Untitled ", 1), (None, None, 1), (6000, "song7", 1), (6001, "song7", 1)]
    df = spark.createDataFrame(rows, "row_id bigint, idx string, n int")
    chosen = lambda d, rate: {(r.row_id, r.idx) for r in sampling.sample(d, rate).collect()}
    tenth = chosen(df, 0.1)
    assert 320 < len(tenth) < 480
    assert chosen(df.repartition(9), 0.1) == tenth
    early = chosen(df.where("row_id < 2000"), 0.1)
    assert early == {x for x in tenth if x[0] is not None and x[0] < 2000}  # more data displaces nothing
    assert tenth <= chosen(df, 0.2)
    assert len({x[0] in {r[0] for r in tenth} for x in rows if x[1] == "song7"}) == 1
    assert chosen(df, 0) == set() and len(chosen(df, 1)) == len(set(map(lambda r: r[:2], rows)))
    assert chosen(df.limit(0), 0.5) == set()
    with pytest.raises(ValueError):
        sampling.sample(df, 1.5)
