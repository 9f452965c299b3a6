"""Phoneme pipelines, chunks, sections, conditions, and sinks: cases that the queries' SQL doesn't have."""

import math
import os

import pytest
from pyspark.sql import functions as F

from strophe.functions import chinese, english
from strophe.operators import arrays, attributes, lexicons, lyrics, phonemes, selection, sequences
from strophe.sources import audio


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


LEXICON = [("cat", ["K", "AE1", "T"]), ("dog", ["D", "AO1", "G"]), ("a", ["AH0"]), ("x", ["EH1", "K", "S"]), ("b", ["B", "IY1"]), ("bus", ["B", "AH1", "S"]), ("ai", ["AY1"]), ("read", ["?"])]
TOKENS = [
    ("Cat", "NN", ["K", "AE1", "T"]), ("A", "DT", ["EY1"]), ("a", "DT", ["AH0"]), ("7", "CD", ["7"]), ("...", ":", ["..."]), ("xab", "NN", ["EH1", "K", "S", "EY1", "B", "IY1"]), ("cat's", "NN", ["K", "AE1", "T", "S"]), ("bus's", "NN", ["B", "AH1", "S", "AH0", "Z"]), ("dog's", "NN", ["D", "AO1", "G", "Z"]),
    ("read", "VBP", ["R", "IY1", "D"]), ("read", "VB", ["R", "IY1", "D"]), ("read", "VBD", ["R", "EH1", "D"]), ("read", None, ["R", "EH1", "D"]), ("catdog", "NN", ["K", "AE1", "T", "D", "AO1", "G"]), ("Maria", "NNP", ["M"]), ("maria", "NN", None), ("unknownword", "NN", None), ("ai", "NN", ["EY1", None]), (None, "NN", None),
]


def test_english_phones(spark):
    lexicon = phonemes.lexicon_entries(spark.createDataFrame(LEXICON, "word string, phones array<string>"))
    names = spark.createDataFrame([("maria", ["M"])], "word string, phones array<string>")
    compounds = spark.createDataFrame([("catdog", ["cat", "dog"]), ("unknownword", ["unknown", "word"])], "word string, parts array<string>")
    tokens = spark.createDataFrame([(i, t, g) for i, (t, g, _) in enumerate(TOKENS) if t != "ai"], "n int, token string, tag string")
    got = {r.n: r.phones for r in phonemes.english_phones(tokens, lexicon, names, compounds).collect()}
    assert got == {i: p for i, (t, _, p) in enumerate(TOKENS) if t != "ai"}
    assert phonemes.english_phones(tokens.limit(0), lexicon, names, compounds).collect() == []
    said = spark.createDataFrame([(1, 0, ["A", "B"]), (1, 1, None), (1, 2, ["C"])], "k int, i int, phones array<string>")
    assert phonemes.sentence_phones(said, "k", "i").first().phones == ["A", "B", " ", " ", "C"]


def test_hot_words_replace_entries(spark):
    lexicon = spark.createDataFrame(LEXICON, "word string, phones array<string>")
    hot = spark.createDataFrame([("CAT", ["HOT"])], "word string, phones array<string>")
    got = {r.word: r.phones for r in phonemes.lexicon_entries(lexicon, hot).collect()}
    assert got["cat"] == ["HOT"] and "ai" not in got and len(got) == len(LEXICON) - 1


def test_chinese_phones_edges(spark):
    schema = "id int, words array<string>, tags array<string>, initials array<array<string>>, finals array<array<string>>, splits array<int>"
    table = spark.createDataFrame([("ma", "m", "a")], "syllable string, consonant string, vowel string")
    df = spark.createDataFrame([(1, None, None, None, None, None), (2, [], [], [], [], []), (3, ["妈妈"], ["n"], [["m", "m"]], [["a1", "a1"]], [None]), (4, ["妈", "妈"], ["n", "n"], [["m"], ["m"]], [["a1"], ["a1"]], [None, None])], schema)
    got = {r.id: r.phones for r in phonemes.chinese_phones(df, table, "id").collect()}
    assert got == {3: ["m", "a1", "m", "a5"], 4: ["m", "a1", "m", "a5"]}
    with pytest.raises(Exception, match="no phones for"):
        phonemes.chinese_phones(spark.createDataFrame([(1, ["你"], ["r"], [["n"]], [["i3"]], [None])], schema), table, "id").collect()
    with pytest.raises(Exception, match="don't agree"):
        one(spark, phonemes.checked(F.array(F.lit("a")), F.array(F.lit(2))))


def test_simple_characters_before_the_numbers():
    assert chinese.normalise_sentence("３個", simple={ord("個"): "个"}) == "三个"
    assert chinese.normalise_sentence("a　b") == "a b"


@pytest.mark.parametrize("x,want", [("1,234,567", "one million two hundred thirty-four thousand five hundred sixty-seven"), ("1905", "nineteen oh five"), ("1900", "nineteen hundred"), ("2000", "two thousand"), ("2010", "twenty ten"), ("3000", "three thousand"), ("1st 2nd 3rd 12th 20th", "first second third twelfth twentieth"), ("$0.05", "five cents"), ("$1", "one dollar"), ("£5", "five pounds"), ("0", "zero"), ("10.50", "ten point five zero")])
def test_english_numbers(x, want):
    assert english.say_numbers(x) == want


def test_chunks(spark):
    x = list(range(300))
    df = spark.createDataFrame([(x,)], "x array<int>").select(sequences.split_chunks(F.col("x"), 128, 32).alias("c"))
    assert [c.start for c in df.first().c] == [0, 96, 172]
    changed = F.transform("c", lambda c, i: F.struct(c["start"].alias("start"), F.transform(c["values"], lambda v: v * 10 + i).alias("values")))
    got = df.select(sequences.stitched(changed, 32).alias("x")).first().x
    owner = one(spark, sequences.chunk_owner(F.lit(300), 128, 32))
    assert got == [v * 10 + o for v, o in zip(x, owner)]
    with pytest.raises(Exception, match="less than a chunk"):
        one(spark, sequences.split_chunks(F.array(F.lit(1)), 2, 0))


def test_sections_stretched(spark):
    rows = [("s", 0, [5, 6], 0.0, 1.0), ("s", 1, [7], 1.0, 1.6)]
    schema = "k string, n int, t array<int>, st double, et double"
    df = lyrics.stretched(spark.createDataFrame(rows, schema), "k", "n", "t", "st", "et", 0.2, F.lit(0))
    assert df.first().t == [5, 5, 6, 6, 0, 7, 7, 7]
    with pytest.raises(Exception, match="without tokens"):
        lyrics.stretched(spark.createDataFrame([("s", 0, [], 0.0, 1.0)], schema), "k", "n", "t", "st", "et", 0.2, F.lit(0)).collect()


def test_discrepancy(spark):
    lit = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    a, b = [[0.0, 0.0], [1.0, 1.0]], [[0.0, 2.0]]
    k = lambda p, q: math.exp(-sum((x - y) ** 2 for x, y in zip(p, q)) / 2 / 2)
    m = lambda p, q: sum(k(x, y) for x in p for y in q) / len(p) / len(q)
    assert abs(one(spark, arrays.discrepancy(lit(a), lit(b))) - (m(a, a) + m(b, b) - 2 * m(a, b))) < 1e-12
    assert abs(one(spark, arrays.discrepancy(lit(a), lit(a)))) < 1e-12
    with pytest.raises(ValueError, match="interpolation"):
        arrays.rotary_angles(F.lit(1), 8, interpolation=0.5)
    with pytest.raises(Exception, match="beyond the table"):
        one(spark, arrays.embedded([lit(a)], [F.lit(5)]))


def test_attributes_checked(spark, monkeypatch):
    with pytest.raises(ValueError, match="unknown conditions: z"):
        attributes.assembled({"z": F.lit("a")}, {}, ("a",))
    monkeypatch.setattr(attributes, "MOST_CODES", 1)
    book = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "code int, vector array<double>")
    with pytest.raises(ValueError, match="codebook"):
        attributes.nearest_code(book, book, "vector")
    df = spark.createDataFrame([(None, [1.0]), (None, [1.0, 2.0]), ("a", [])], "g string, x array<double>")
    assert sorted((r.g or "", r.length, r.x) for r in attributes.padded_batch(df, "g", "x").collect()) == [("", 1, [1.0, 0.0]), ("", 2, [1.0, 2.0]), ("a", 0, [])]


def test_pool_filled_with_eos(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(4)], "g string, p int, t int")
    got = {r.p: r.pool for r in selection.repetition_window(df, "g", "p", "t", 2, eos=9).collect()}
    assert got == {0: [9], 1: [0, 9], 2: [0, 1], 3: [1, 2]}


def test_waves_written(spark, tmp_path):
    rows = [("s1_s0", [[0.0, 0.5]], 8000), ("s1_s1", [[0.1], [0.2]], 8000), ("s2_s0", None, 8000)]
    df = spark.createDataFrame(rows, "name string, pcm array<array<double>>, sample_rate int")
    folder = str(tmp_path / "out")
    for _ in range(2):  # a second run leaves the same files
        assert {r.name: r.bytes > 44 for r in audio.write_waves(df, folder).collect()} == {"s1_s0": True, "s1_s1": True}
    assert sorted(os.listdir(folder)) == ["s1_s0.wav", "s1_s1.wav"]
    assert {r.channels for r in audio.read_audio(spark, folder).collect()} == {1, 2}


def test_cached_lexicon(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("a", 1)], "word string, n int")

    for _ in range(2):
        assert [tuple(r) for r in lexicons.cached(spark, str(tmp_path / "lexicon"), build).collect()] == [("a", 1)]
    assert built == [1]


def test_command_line(spark, tmp_path):
    from strophe.__main__ import main

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    main(["required_fields", "--input", d, "--output", str(tmp_path / "out"), "--format", "json"])
    assert spark.read.json(str(tmp_path / "out")).count() == spark.read.parquet(f"{d}/songs.parquet").count()
    with pytest.raises(SystemExit):
        main(["no_such_query", "--input", d, "--output", "x"])
