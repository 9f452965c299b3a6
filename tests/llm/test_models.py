"""Language, abuse and reading level: edge cases and held-out accuracy."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from strophe.llm import abuse, langid, queries, reading

DATA = "/root/testdata/sf0.01"
need = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(name, *cols):
    t = pq.read_table(f"{DATA}/{name}.parquet", columns=list(cols))
    return list(zip(*(t[c].to_pylist() for c in cols)))


@pytest.fixture(scope="module")
def net():
    data = rows("lang_samples", "lang", "text", "sample_no")
    n = langid.Network()
    fit = [(langid._normal(t), langid.LANGS.index(k)) for k, t, i in data if i % 5]
    n.fit([x for x, _ in fit], np.array([k for _, k in fit]), np.ones(len(fit), np.float32), 30)
    return n


@need
def test_languages_held_out(net):
    held = [(t, k) for k, t, i in rows("lang_samples", "lang", "text", "sample_no") if i % 5 == 0]
    right = 0
    for t, k in held:
        _, section, lang, _ = langid.judge(net, [langid._normal(t)])
        right += langid.LANGS[lang[section == 0][0]] == k
    assert right >= 0.9 * len(held)


def test_labels():
    for x, want in {"EN": "en", "en_GB": "en", "Chinese": "zh", "zh-Hans": "zh", "por": "pt", "und": None, "": None, None: None, "auto": None, "xx": None}.items():
        assert langid.normal_label(x) == want


@need
def test_language_rows(spark, net):
    en, zh = "[verse] Half an oar and a whole secondhand feather. Let the velvet guard the ribbon. ", "[chorus] 我们想念明亮的铁轨.一半是果园一半是果园.固执的山谷点燃果园 "
    data = [(1, en, "en"), (2, en + zh, "en_US"), (3, en, "de"), (4, en, None), (5, None, "en"), (6, "", "en"), (7, "[verse]", "en"), (None, en, "de"), (8, en + "[bridge] ... ", "en"), (9, en * 3000, "en"), (1, en, "en")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in data], "row_id bigint, lyrics string, lang string, section int, confidence double")
    got = {(r.row_id, r.section, r.lang) for r in langid.corrections(df, net).collect()}
    assert got == {(2, 0, "zh"), (2, 1, "en"), (2, 2, "zh"), (3, 0, "en"), (4, 0, "en"), (None, 0, "en")}
    every = langid.languages(df, net).collect()
    assert all(0 <= r.confidence <= 1 for r in every) and {r.row_id for r in every} == {1, 2, 3, 4, 8, 9, None}
    assert langid.corrections(df.limit(0), net).collect() == []


def test_training_without_samples(spark):
    empty = spark.createDataFrame([], "lang string, sample_no int, text string")
    songs = spark.createDataFrame([(i, "[verse] let the velvet guard the ribbon" if i % 2 else "[verse] 我们想念明亮的铁轨", "en" if i % 2 else "zh") for i in range(40)], "row_id bigint, lyrics string, lang string")
    n = langid.train(empty, songs)
    assert {r.lang for r in langid.corrections(songs.where("row_id < 2").withColumn("lang", songs.row_id.cast("string")), n).collect()} == {"en", "zh"}
    langid.train(empty)


def test_decoder():
    d = abuse.Decoder({"loser": 9.0, "nipples": 9.0, "tits": 9.0, "filthy": 9.0, "parasite": 1e6})
    for x, want in {"you l0s3r": "you loser", "n i p p l e s now": "nipples now", "t1t5": "tits", "f!lthy pig": "filthy pig", "par*site": "parasite", "go 24/7 at 9.45": "go 24/7 at 9.45", "维_兰_人": "维兰人", "m-o-r-o-n": "moron"}.items():
        assert d.text(x) == want, x


@need
def test_abuse_separates_songs():
    """On the labelled songs themselves; held-out figures at a larger scale are in the README."""
    label = dict(rows("song_labels", "row_id", "flagged"))
    data = [(t, label[i]) for i, t in rows("songs", "row_id", "lyrics") if i in label and t]
    lexicon = [(t.lower(), c) for t, c in rows("flag_terms", "term", "category")]
    flagged = np.array([f for _, f in data], bool)
    m = abuse.learn([t for t, _ in data], flagged, lexicon)
    p = m.scores([t for t, _ in data])
    assert (p[flagged] >= 0.5).mean() > 0.9 and (p[~flagged] < 0.5).mean() > 0.95
    assert m.scores(["", "[verse] 一"]).max() < 0.5


def test_label_model_finds_the_good_voters():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.1
    votes = np.stack([np.where(r.random(4000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in (0.95, 0.9, 0.85, 0.6)], axis=1)
    post, table, _ = abuse.label_model(votes)
    assert ((post > 0.5) == y).mean() > 0.95 and table[0, 2, 1] > table[3, 2, 1]


def test_abuse_tables(spark):
    songs = spark.createDataFrame([(i, f"[verse] you are a rotten loser. line {i} of song" if i % 4 == 0 else f"[verse] the river bends {i}. nothing but a lantern", "s") for i in range(80)] + [(100, None, None), (101, "", "s"), (None, "you rotten loser", "s"), (102, "[verse] you are a r0tten l0s3r", None)], "row_id bigint, lyrics string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(70, None)], "row_id bigint, flagged int")
    terms = spark.createDataFrame([("loser", "insult"), (None, "hate"), ("x", None)], "term string, category string")
    got = {r.row_id for r in abuse.unlabelled_abuse(songs, labels, terms).collect()}
    assert {60, 64, 68, 72, 76, 102} <= got and not got & set(range(60))
    rate = {r.source: (r.songs, r.abusive) for r in abuse.rates(songs, labels, terms).collect()}
    assert rate["s"][0] == 81 and rate["s"][1] >= 20 and rate[None] == (1, 1)
    abuse.unlabelled_abuse(songs.limit(0), labels.limit(0), terms.limit(0)).collect()


@need
def test_reading_held_out(spark):
    grade = dict(rows("level_labels", "doc_id", "grade"))
    data = [(i, t, grade[i]) for i, t in rows("documents", "doc_id", "text") if i in grade and t]
    df = spark.createDataFrame(data, "doc_id bigint, text string, grade int")
    m = reading.fit(df.where("doc_id % 3 <> 0"))
    held = [(m.grade(t)[0], g) for i, t, g in data if i % 3 == 0]
    assert np.mean([a == b for a, b in held]) >= 0.9 and all(abs(a - b) <= 1 for a, b in held)


def test_reading_edges(spark):
    df = spark.createDataFrame([(1, "easy cat sat", 1), (2, "hard epistemology endures", 5), (3, None, 2), (4, "x", 9), (5, "y", None)], "doc_id bigint, text string, grade int")
    m = reading.fit(df)
    docs = spark.createDataFrame([(1, "cat " * 60, 9), (2, "epistemology " * 20, 9), (3, None, 9), (4, "", 9), (5, "short", 9), (None, "cat " * 60, 9), (6, "§" * 300, 9), (7, "cat " * 200_000, 9)], "doc_id bigint, text string, grade int")
    got = {r.doc_id: r.grade for r in reading.levels(docs, m, least=200).collect()}
    assert got[1] == 1 and got[2] == 5 and got[None] == 1 and got[7] == 1 and set(got) == {1, 2, None, 6, 7}
    assert reading.levels(docs.limit(0), reading.fit(df.limit(0))).collect() == []


def test_every_document_has_a_level(tmp_path, spark):
    docs = spark.createDataFrame([(1, "easy cat sat", "en"), (2, "hard epistemology endures", "en"), (3, "cat", "en"), (4, "el cat duerme", "es"), (5, "epistemology", None), (6, "猫", "zh"), (7, None, "en"), (8, "", "en"), (9, "cat " * 100, "en")], "doc_id bigint, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 5)], "doc_id bigint, grade int").write.parquet(f"{tmp_path}/level_labels.parquet")
    got = {r.doc_id: (r.grade, r.known) for r in queries.p10_levels(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 3), 2: (5, 3), 3: (1, 1), 4: (1, 1), 5: (5, 1), 6: (None, 0), 7: (None, 0), 8: (None, 0), 9: (1, 100)}
