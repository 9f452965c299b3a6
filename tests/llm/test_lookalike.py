"""Look-alikes, formatting copies and near-duplicates."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from strophe.functions.characters import FOLDED_TAG
from strophe.llm import dedup, lookalike, neardup

SCHEMA = "row_id bigint, lyrics string, form string, k string, t string"  # with clashing names


def songs(spark, rows):
    return spark.createDataFrame([(i, t, "f", "k", "t") for i, t in rows], SCHEMA)


def test_fold():
    assert lookalike.fold("ｆｕｌｌ　ｗｉｄｔｈ！") == "full width!"
    assert lookalike.fold("café ​na­ïve ﬁn ⽊ 金") == "café naïve fin 木 金"
    assert lookalike.fold("“x” … ½ ②") == "“x” … ½ ②"  # visible differences stay


@pytest.mark.parametrize(
    "token,main,want", [("сaf", "latin", "caf"), ("дом", "latin", "дом"), ("дoм", "latin", "дом"), ("а", "latin", "a"), ("а", "cyrillic", "а"), ("Κόσμος", "latin", "Κόσμος"), ("Τuesday", "latin", "Tuesday")]
)
def test_propose(token, main, want):
    assert lookalike.propose(token, main) == want


def test_repair_asks_the_vocabulary(spark):
    rows = [(1, "[verse] the сat sat"), (2, "a cat"), (3, "zyх alone"), (4, "zух alone"), (5, "qxх once"), (6, "мой дом"), (7, None), (8, ""), (9, "plain")]
    got = {r.row_id: r.form for r in lookalike.repair(songs(spark, rows)).collect()}
    assert got == {1: "[verse] the cat sat", 2: "a cat", 3: "zyx alone", 4: "zyx alone", 5: "qxх once", 6: "мой дом", 8: "", 9: "plain"}


def test_same_looking(spark):
    rows = [(1, "[verse] a cat"), (2, "[verse] а саt"), (3, "[verse] a cat"), (4, "[verse] a cat​"), (5, "[verse] A cat"), (6, "[verse] a  cat"), (7, None), (8, ""), (9, "[verse]"), (10, "[vеrse]"), (None, "[verse] a cat")]
    got = {tuple(r) for r in lookalike.same_looking(songs(spark, rows)).collect()}
    same = {1: "x", 2: "y", 3: "x", 4: "z"}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(same), 2) if same[a] != same[b]}
    assert lookalike.same_looking(songs(spark, [])).collect() == []


@pytest.mark.parametrize("word", ["ｎｏｔｈｈｉｎｇ", "no\u200bthhing", "no\u00adthhing"])
def test_vocabulary_of_folded_texts(spark, word):
    """The only copy of a rare word without foreign letters is written full-width or with a character that takes no room."""
    rows = [(1, "the n\u043ethhing cat"), (2, f"the {word} cat")]
    assert [tuple(r) for r in lookalike.same_looking(songs(spark, rows)).collect()] == [(1, 2)]


def test_no_words_of_split_parts(spark):
    rows = [(1, "so n\u043e"), (2, "the no\u200bthing")]
    assert {r.row_id: r.form for r in lookalike.repair(songs(spark, rows)).collect()} == {1: "so n\u043e", 2: "the nothing"}


def test_same_looking_twice_the_same_row(spark):
    rows = [(1, "a cat"), (1, "a cat"), (2, "a саt")]
    assert [tuple(r) for r in lookalike.same_looking(songs(spark, rows)).collect()] == [(1, 2)]


def test_copies(spark):
    rows = [(1, "[Verse] Don't go, STRASSE"), (2, "[verse]dont go straße"), (3, "[verse] don’t gо, straße!"), (4, "[chorus] dont go straße"), (5, None), (6, ""), (7, "[verse]"), (8, "..."), (None, "dont"), (9, "cafe"), (10, "café"), (11, "x" * 200_000), (12, "X" * 200_000)]
    df = songs(spark, rows)
    assert {tuple(r) for r in dedup.extra_copies(df).collect()} == {(1, 2), (1, 3), (11, 12)}
    kept = {r.row_id: r.copies for r in dedup.kept_records(df).collect()}
    assert kept == {1: 3, 4: 1, 9: 1, 10: 1, 11: 2}
    assert dedup.extra_copies(songs(spark, [])).collect() == []


def test_records(spark):
    raw = spark.createDataFrame([(10, '{"lyrics": "a b", "idx": 5}'), (11, ' {"x": null, "lyrics":"A\\u00a0B"} '), (12, '{"lyrics": "a b"'), (13, None), (14, ""), (15, "null"), (16, '{"lyrics": 5}'), (17, '[1]'), (18, '{"idx": "q"}')], "row_id bigint, line string")
    df = dedup.records_of(songs(spark, [(1, "A, b!")]), raw)
    assert {tuple(r) for r in dedup.extra_copies(df).collect()} == {(1, 10), (1, 11)}


def brute(rows, least=0.5):
    out = set()
    sets = {}
    for i, t in rows:
        if i is None or not t or not re.search(r"\w", FOLDED_TAG.sub("", t)):
            continue
        w, signs = neardup.words(t)
        sets[i] = ({tuple(w[k : k + 3]) for k in range(len(w) - 2)}, signs)
    for a, b in itertools.combinations(sorted(sets), 2):
        (x, p), (y, q) = sets[a], sets[b]
        if p != q and x and y and len(x & y) / len(x | y) >= least:
            out.add((a, b))
    return out


def corpus():
    import random

    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        lines = [" ".join(r.choices(vocabulary, k=7)) for _ in range(16)]
        base = "[verse] " + ". ".join(lines)
        rows.append((100 * i, base))
        moved = lines[5:] + lines[:5]
        rows.append((100 * i + 1, "[verse] " + ". ".join(moved)))
        edited = base.split(" ")
        for k in range(0, len(edited), 14):
            edited[k] = edited[k] if edited[k].startswith("[") else "new"
        rows.append((100 * i + 2, " ".join(edited)))
        rows.append((100 * i + 3, base.upper().replace("[VERSE]", "[Verse]")))  # a copy of the first
        rows.append((100 * i + 4, "[chorus] " + ". ".join(lines[:5] + [" ".join(r.choices(vocabulary, k=7)) for _ in range(11)])))  # shares some lines
    return rows + [(7001, None), (7002, ""), (7003, "one two"), (7004, "[verse]"), (None, rows[0][1])]


def test_near_duplicates_against_all_pairs(spark):
    rows = corpus()
    got = {tuple(r) for r in neardup.near_duplicates(songs(spark, rows)).collect()}
    want = brute(rows)
    assert got <= want and len(want) > 100
    assert len(got) >= 0.99 * len(want)
    assert neardup.near_duplicates(songs(spark, [])).collect() == []


def edited_songs():
    """Pairs (2i, 2i + 1): lines reordered, one word or Han character in ten changed, short texts with one change in the middle."""
    import random

    r = random.Random(9)
    out = []
    for i in range(20):
        v = [f"v{i}x{k}" for k in range(400)]
        lines = [" ".join(v[7 * k : 7 * k + 7]) for k in range(20)]
        out.append((". ".join(lines), ". ".join(lines[1::2][::-1] + lines[::2])))
        out.append((" ".join(v[:150]), " ".join(f"new{k}" if k % 10 == 5 else x for k, x in enumerate(v[:150]))))
        han = "".join(chr(c) for c in r.sample(range(0x4E00, 0x9000), 200))
        out.append((han, "".join("一" if k % 10 == 5 else x for k, x in enumerate(han))))
        out.append((" ".join(v[200:215]), " ".join(v[200:207] + ["other"] + v[208:215])))
        out.append((han[:19], han[:9] + "丁" + han[10:19]))
    return [(2 * i + k, t) for i, pair in enumerate(out) for k, t in enumerate(pair)]


def test_near_duplicates_without_common_windows(spark):
    rows = edited_songs()
    want = brute(rows)
    assert {(a, a + 1) for a in range(0, 200, 2)} <= want
    assert {tuple(r) for r in neardup.near_duplicates(songs(spark, rows)).collect()} == want


def test_near_duplicates_of_other_word_lengths(spark):
    """Short texts of 7 and 8 words, and texts of two scripts on both sides of the old bound of 1.5 letters a word."""
    english, han = " ".join(f"word{k}" for k in range(20)), "".join(map(chr, range(0x4E00, 0x4EF0)))
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, f"{han} {english}"), (4, f"{han} {english} " + " ".join(f"more{k}" for k in range(30)))]
    assert {tuple(r) for r in neardup.near_duplicates(songs(spark, rows)).collect()} == brute(rows) == {(1, 2), (3, 4)}


def test_near_groups(spark):
    rows = corpus()
    got = {r.row_id: (r.group_id, r.links) for r in neardup.near_groups(songs(spark, rows)).collect()}
    parent = {i: i for i in got}
    for a, b in brute(rows):
        ra, rb = got[a][0], got[b][0]
        assert ra == rb
    assert got[0][0] == got[3][0] == 0 and got[4][0] == 4 and 7003 not in got and None not in got
    assert parent


def test_a_third_of_all_rows_in_one_group(spark):
    """A hot group of copies: one class for the fingerprints, one hash for the copies, no gathering."""
    base = "[verse] " + " ".join(f"w{i}" for i in range(60))
    rows = [(i, base if i % 2 else base.upper()) for i in range(1500)] + [(2000 + i, f"[verse] other song number {i} with words of its own {i * 7}") for i in range(3000)]
    df = songs(spark, rows)
    assert dedup.copies(df).where("copies = 1500").count() == 1500
    got = neardup.near_groups(df).groupBy("group_id").count().orderBy(F.desc("count")).first()
    assert got["count"] >= 1500
