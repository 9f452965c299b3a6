"""Hot groups, large-table branches and bounds, on small data with small settings."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strophe.llm import abuse, bpe, dedup, fitting, langid, lookalike, neardup, packing, reading
from strophe.session import stage, unstage
from tests.llm.test_lookalike import brute, corpus, songs


def test_smallest(spark):
    df = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    want = [r.id for r in df.orderBy("h").limit(70).collect()]
    for parts in (1, 9):
        got = fitting.smallest(df.repartition(parts), F.col("h"), 70)
        assert sorted(r.id for r in got.collect()) == sorted(want)
    assert fitting.smallest(df, F.col("h"), 5000).count() == 5000
    assert fitting.smallest(df.limit(0), F.col("h"), 3).count() == 0
    assert fitting.smallest(df.withColumn("h", F.lit(1).cast("bigint")), F.col("h"), 3).count() == 5000  # equal hashes stay together


def test_models_are_kept(spark, tmp_path):
    texts = ["[verse] you rotten loser", "[verse] the river bends", "[verse] a lantern for the river", "[verse] you are a loser"] * 5
    for i, (model, judge) in enumerate([
        (abuse.learn(texts, np.array([True, False, False, True] * 5), [("loser", "insult")]), lambda m: m.scores(texts).tolist()),
        (reading.Models([(1, "cat", 3), (5, "endures", 2)], {1: 1, 5: 1}), lambda m: m.grade("cat endures cat")),
        (langid.Network(), lambda m: m.scores(langid.windows([b"hello there"])).tolist()),
    ]):
        want = judge(model)
        fitting.save(spark, model, str(tmp_path / str(i)))
        assert judge(fitting.load(spark, str(tmp_path / str(i)))) == want


def test_unstage(spark):
    df = stage(spark.range(3), "x")
    assert df.count() == 3
    unstage(df)
    with pytest.raises(Exception):
        df.count()


@pytest.mark.parametrize("bound", [0, 500_000])
def test_repair_branches(spark, monkeypatch, bound):
    monkeypatch.setattr(lookalike, "BROADCAST_WORDS", bound)
    rows = [(1, "[verse] the сat sat"), (2, "a cat"), (3, "qxх once")]
    assert {r.row_id: r.form for r in lookalike.repair(songs(spark, rows)).collect()} == {1: "[verse] the cat sat", 2: "a cat", 3: "qxх once"}


def test_many_copies_and_a_variant(spark):
    """20,000 copies of one string and one of another: as many pairs, in linear time."""
    df = spark.range(20_000).select(F.col("id").alias("row_id"), F.lit("[verse] a cat").alias("lyrics")).union(spark.createDataFrame([(50_000, "[verse] a саt")], "row_id bigint, lyrics string"))
    got = lookalike.same_looking(df)
    assert got.count() == 20_000 and got.where("row_id_b <> 50000").isEmpty()


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_copies_branches(spark, monkeypatch, bound):
    monkeypatch.setattr(dedup, "BROADCAST_KEYS", bound)
    rows = [(1, "A, b!"), (2, "a b"), (3, "c"), (4, "aab"), (5, "baa")]
    assert {tuple(r) for r in dedup.extra_copies(songs(spark, rows)).collect()} == {(1, 2)}


@pytest.mark.parametrize("small,hot", [(500_000, 3), (0, 1_000), (0, 3)])
def test_near_duplicates_branches(spark, monkeypatch, small, hot):
    """Joined instead of broadcast, and blocks split by further symbols down to the last level."""
    monkeypatch.setattr(neardup, "BROADCAST_IDS", small)
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "LEVELS", 2)
    base = [f"w{i}" for i in range(60)]
    family = [(9000 + i, " ".join(base[:50] + [f"x{i}y{k}" for k in range(6)])) for i in range(8)]  # similar to each other
    rows = corpus()[:60] + family
    assert {tuple(r) for r in neardup.near_duplicates(songs(spark, rows)).collect()} == brute(rows)


def test_line_that_a_third_of_the_songs_share(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 20)
    rows = [(i, "[verse] " + ("we all sing this one line together now. " if i % 3 == 0 else "") + " ".join(f"s{i}w{k}" for k in range(25))) for i in range(600)]
    rows += [(1000, rows[0][1] + " again"), (1001, rows[1][1] + " again")]
    assert {tuple(r) for r in neardup.near_duplicates(songs(spark, rows)).collect()} == {(0, 1000), (1, 1001)}


def test_blocks_are_compared_where_they_are_gathered(spark, monkeypatch):
    """Pairs that only share a block are never joined or written, whether classes are few or many, and sets are compared in turns."""
    plans, real = [], neardup.stage

    def watched(df, name, **options):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name, **options)

    monkeypatch.setattr(neardup, "stage", watched)
    for name, value in [("BROADCAST_IDS", 0), ("TURN_CLASSES", 40), ("TURN_PAIRS", 10)]:
        monkeypatch.setattr(neardup, name, value)
    rows = corpus()[:60]
    assert {tuple(r) for r in neardup.near_duplicates(songs(spark, rows)).collect()} == brute(rows)
    gathered = [p for name, p in plans if name == "candidates"]
    assert len(gathered) > 1 and not any("Join" in p or "Generate" in p for p in gathered)
    assert sum(name == "close" for name, _ in plans) > 2


def test_gathered_blocks():
    """Rows of too large blocks go early, but are counted; numbers are chosen by bits; signed numbers have all their bits."""
    r = np.random.default_rng(5)
    block = r.permutation(np.r_[np.full(900, 7), np.full(5, 8), np.arange(100, 200)])
    rows = np.stack([block, np.arange(len(block)), *(np.zeros_like(block) for _ in range(neardup.BITS))])
    batches = [pa.RecordBatch.from_arrays([pa.array([0]), pa.array([rows[:, i : i + 50].tobytes()], pa.binary())], ["p", "rows"]) for i in range(0, len(block), 50)]
    for room in (25, neardup.TASK_ROWS):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(neardup, "TASK_ROWS", room)
            left, larger = neardup._gathered(iter(batches), 60)
        assert larger == {7: 900} and sorted(left[0]) == sorted(block[block != 7])
    x, y = r.integers(-(2**63), 2**63, (2, neardup.BITS, 50))
    assert neardup._differ(x, y).tolist() == [sum((int(a) ^ int(b)).__and__(2**64 - 1).bit_count() for a, b in zip(x[:, i], y[:, i])) for i in range(50)]


def test_compared_blocks():
    """Blocks of all sizes, also beyond those that are shifted and those that are compared in squares, give all pairs that agree."""
    r = np.random.default_rng(6)
    sizes = [1, 2, 40, neardup.SHIFTED + 1, 3 * neardup.SQUARE + 5]
    block = np.repeat(np.arange(len(sizes)), sizes)
    base = r.integers(-(2**63), 2**63, (neardup.BITS, 9))
    bits = base[:, r.integers(0, 9, len(block))] ^ (1 << r.integers(0, 62, (neardup.BITS, len(block))))
    rows = np.concatenate([block[None], r.permutation(len(block))[None], bits])
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([np.ascontiguousarray(rows).tobytes()], pa.binary())], ["p", "rows"])
    got = {(a, b) for x in neardup._compared(iter([batch]), 10_000) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist())}
    i, j = np.nonzero(np.triu(block[:, None] == block, 1) & (np.bitwise_count((bits[:, :, None] ^ bits[:, None]).view(np.uint64)).sum(axis=0, dtype=int) <= 64 * neardup.BITS - neardup.AGREE))
    assert got == {tuple(sorted(x)) for x in zip(rows[1, i].tolist(), rows[1, j].tolist())} and len(got) > 10_000


def test_fingerprints_are_kept_in_slices(spark):
    """The turns read a row for each slice of texts, not for each text; every text has a number of its own."""
    rows = [(i, f"[verse] a{i} b{i} c{i} d") for i in range(1200)] + [(2000, "too short")]
    slices, texts = neardup.classes(songs(spark, rows).coalesce(1), "row_id", "lyrics")
    assert slices.count() == -(-len(rows) // neardup.SLICE)
    got = texts.collect()
    assert sorted(r.k for r in got) == list(range(1200)) and len({r.u for r in got}) == 1200
    assert neardup._numbers(3 << 33 | 2, 2).tolist() == [(3 << 33) + 2 * neardup.SLICE + i for i in range(2)]
    unstage(slices)


def test_turns_are_read_together(spark):
    """The tables of several turns are one scan, whose tasks read several small files."""
    found = neardup._Candidates(spark.range(1), None, 1)
    rows = [(bytes(16), None, None), (None, 5, 9)]
    found.found = [stage(spark.createDataFrame(rows, "pairs binary, block bigint, n bigint").coalesce(1), "x") for _ in range(6)]
    assert found._all().count() == 12 and found._all(4).count() == 4
    assert "Union" not in found._all()._jdf.queryExecution().executedPlan().toString()
    unstage(*found.found)


def test_sets_are_compared_as_arrays():
    """Sizes of sets and of what they share, also of empty sets, as with Python's sets."""
    r = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in np.cumsum(r.random(n) < p)) for n in (0, 2, 3, 40, 90) for p in (1, 0.9, 0.8, 0.8)]
    s = next(neardup._shingles(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"])])))["s"]
    a, b = (x.ravel() for x in np.triu_indices(len(texts)))
    pairs = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), s.take(pa.array(a)), s.take(pa.array(b))], ["a", "b", "sa", "sb"])
    got = {(x["a"], x["b"]): x["similarity"] for y in neardup._alike(iter([pairs]), 0.4) for x in y.to_pylist()}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in zip(a.tolist(), b.tolist()) if sets[i] | sets[j]}
    assert got == {x: y for x, y in want.items() if y >= 0.4} and len(got) > 12


def test_groups_are_components(spark):
    rows = corpus()[:50]
    got = {r.row_id: r.group_id for r in neardup.near_groups(songs(spark, rows)).collect()}
    parent = {i: i for i in got}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    texts = {i: neardup.words(t) for i, t in rows}
    same = [(a, b) for a, b in itertools.combinations(sorted(got), 2) if texts[a] == texts[b]]
    for a, b in [*brute(rows), *same]:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {i: root(i) for i in got}
    assert all((got[a] == got[b]) == (linked[a] == linked[b]) for a, b in itertools.combinations(sorted(got), 2))


def test_packing_of_equal_items(spark):
    """A third of the items has a null key and one size; repeated rows of an item that is split don't share containers."""
    items = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 90).cast("bigint").alias("tokens"))
    items = items.union(spark.createDataFrame([(7, 250), (7, 250), (None, 250)], "doc_id bigint, tokens bigint"))
    caps = spark.createDataFrame([("s", 100)], "pack_name string, capacity int")
    got = packing.pack(items, caps).collect()
    fill = {}
    for x in got:
        fill[x.container] = fill.get(x.container, 0) + x.tokens
    want = items.agg(F.sum("tokens")).first()[0]
    assert max(fill.values()) <= 100 and sum(fill.values()) == want and len(fill) <= 1.02 * -(-want // 100) + 1
    assert sum(x.doc_id is None and x.part == 0 for x in got) == 2000 and sum(x.tokens == 100 for x in got if x.container.startswith("full")) == 6


def test_numbered_runs(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 4)
    df = spark.createDataFrame([(None, 5)] * 9 + [(1, 5)], "k bigint, n bigint")
    assert sorted((r.k or 0, r.o) for r in packing._numbered(df).collect()) == [(0, i) for i in range(9)] + [(1, 0)]


def test_too_many_kinds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(packing, "CAPACITIES", 2)
    monkeypatch.setattr(abuse, "MOST_TERMS", 2)
    caps = spark.createDataFrame([(str(i), 10 + i) for i in range(3)], "pack_name string, capacity int")
    with pytest.raises(ValueError, match="kinds of containers"):
        packing.pack(spark.createDataFrame([(1, 5)], "doc_id bigint, tokens bigint"), caps)
    terms = spark.createDataFrame([(f"t{i}", "hate") for i in range(3)], "term string, category string")
    with pytest.raises(ValueError, match="terms"):
        abuse.fit(songs(spark, []), spark.createDataFrame([], "row_id bigint, flagged int"), terms)


def test_short_texts_have_levels(spark):
    df = spark.createDataFrame([(1, "easy cat sat", 1), (2, "hard epistemology endures", 5)], "doc_id bigint, text string, grade int")
    got = {r.doc_id: r.grade for r in reading.levels(df.select("doc_id", "text"), reading.fit(df)).collect()}
    assert got == {1: 1, 2: 5}


def test_fit_on_part_of_the_documents(spark, monkeypatch):
    monkeypatch.setattr(reading, "FIT_DOCUMENTS", 40)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "easy cat").otherwise("hard epistemology").alias("text"), F.when(F.col("id") % 2 == 0, 1).otherwise(5).alias("grade"))
    a, b = reading.fit(df), reading.fit(df.repartition(7))
    assert a.like == b.like and a.prior == b.prior and a.grade("cat")[0] == 1


def test_label_voter_with_known_accuracy():
    r = np.random.default_rng(1)
    y = r.random(3000) < 0.05
    votes = np.stack([np.where(r.random(3000) < 0.9, np.where(y, 1, -1), 0) for _ in range(3)] + [np.where(y, 1, np.where(r.random(3000) < 0.8, -1, 0))], axis=1)
    post, _, _ = abuse.label_model(votes, known={3: (-8.0, 0.0, 2.0)})
    assert post[votes[:, 3] == -1].max() < 0.5 and ((post > 0.5) == y).mean() > 0.97


def test_forgotten_pieces_by_thousands(monkeypatch):
    """1,000 distinct pieces with room for 10."""
    import os

    if not os.path.isfile(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"):
        pytest.skip("no vocabulary")
    import tiktoken

    with open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        v = bpe.vocabulary(f.read())
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=v.ids, special_tokens={})
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    texts = [" ".join(f"qx{i}z{k}" for k in range(25)) for i in range(40)]
    for at in range(0, 40, 4):
        assert v.encode(texts[at : at + 4]) == [public.encode_ordinary(t) for t in texts[at : at + 4]]
