"""Core operators against fixed values and plain scans."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strophe.functions import chinese
from strophe.operators import attributes, lexicons, lyrics, selection, sequences

NUMBERS = {"0": "零", "000": "零", "007": "七", "10": "十", "11": "十一", "20": "二十", "101": "一百零一", "110": "一百一十", "1001": "一千零一", "1010": "一千零一十", "10010": "一万零一十", "110000": "十一万", "100000000": "一亿", "12345678": "一千二百三十四万五千六百七十八", "3.20": "三点二", "3.00": "三", ".22": "零点二二", "10001000": "一千万一千", "100001000": "一亿零一千"}
SENTENCES = {"1995年3月1日": "一九九五年三月一日", "2021-03-04": "二零二一年三月四日", "12:05": "十二点零五分", "8:30": "八点半", "0:00": "零点", "10:00:09": "十点零九秒", "8:30-12:15": "八点半至十二点半", "8:10-12:30": "八点十分至十二点三十分", "-10°C": "零下十度", "7/12": "十二分之七", "62%": "百分之六十二", "0421-33441122": "零四二幺，三三四四幺幺二二", "12~23": "十二到二十三", "1+2=3": "一加二等于三", "583分": "五百八十三分", "3+个": "三多个", "27149": "二七幺四九", "00078": "零零零七八"}


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("x", NUMBERS)
def test_numbers(x):
    assert chinese.number(x) == NUMBERS[x]


@pytest.mark.parametrize("x", SENTENCES)
def test_sentences(x):
    assert chinese.normalise_sentence(x) == SENTENCES[x]


def test_two_points_are_an_error():
    with pytest.raises(ValueError):
        chinese.number("1.2.3")


def test_cardinals_as_expressions(spark):
    values = [*range(1200), 10010, 110000, 10**8, 10**8 + 1000, 10001000, 99999999, 10**11, 123456789012, 1234567890123, 10**12, 10**13 + 5, 2 * 10**15 + 10**8, 10**16 - 1, 10**16, 123456789012345678]
    df = spark.createDataFrame([(str(v),) for v in values], "v string").select("v", chinese.cardinal_words(F.col("v")).alias("x"))
    assert all(r.x == chinese.cardinal(r.v) for r in df.collect())


def test_units(spark):
    assert one(spark, chinese.unit_names(F.lit("3mm"))) == "3米米"
    assert one(spark, chinese.half_width(F.lit("１２Ａｚ％"))) == "12Az％"
    assert chinese.post_replace("a/b①Ω-") == "a每b一欧米伽"


#: Sheets and what the rules make of them, worked out by hand.
SHEETS = {
    "[Verse] hello, world! [chorus] hi": "[verse] hello. world, [chorus] hi",
    "中 文 字": "中.文 字",
    "": "",
    "[intro] [intro] , [verse] Red lamp. Blue door , [inst] [inst] , [chorus] Sing low": "[intro] [intro] , [verse] Red lamp. Blue door , [inst] [inst] , [chorus] Sing low",
    '[x] [verse] (a) "b"': "[x] , [verse] a b",
    "[outro]": "[outro]",
    "a [inst] b [bridge], c": "a , [inst] , b , [bridge] c",
    "[intro] [verse] a.. b , [chorus] [outro]": "[intro] , [verse] a. b , [chorus] , [outro]",
    "Wait... no;yes [VERSE]，好 了 吗？ [inst]": "Wait. no.yes , [verse] 好.了 吗, [inst]",
    " \u3000[verse]\n\tone  two\n three ": "[verse] one two three",
    "[verse] x [verse] y": "[verse] x , [verse] y",
    "x , y": "x . y",
    "a [b] c": "a[b]c",
    '[inst] "" [outro]': "[inst] , , [outro]",
    '[verse] "" b': "[verse] b",
}


def test_clean_lyrics(spark):
    df = spark.createDataFrame([(t,) for t in [*SHEETS, None]], "t string").select("t", lyrics.clean_lyrics(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == SHEETS | {None: None}


def merged(rows):
    """Runs by a left-to-right scan."""
    out, i = [], 0
    while i < len(rows):
        j = i
        while j + 1 < len(rows) and rows[j + 1][2] == rows[i][2]:
            j += 1
        if rows[i][2] in sequences.VOCAL:
            out += [(rows[k][0], rows[min(k + 1, j)][1], rows[k][2]) for k in range(i, j + 1)]
        else:
            out.append((rows[i][0], rows[j][1], rows[i][2]))
        i = j + 1
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["verse", "chorus", "inst", "intro", None]), min_size=1, max_size=12))
def test_merge_runs(spark, names):
    rows = [(float(i), float(i + 1), s) for i, s in enumerate(names)]
    df = spark.createDataFrame([("a", i, *r, "x") for i, r in enumerate(rows)], "g string, seq int, st double, et double, s string, l string")
    got = sequences.merge_runs(df, "g", ["seq"], "st", "et", "s", "l").orderBy("st").collect()
    assert [(r.st, r.et, r.s) for r in got] == merged(rows)


def test_tokens(spark):
    vocab = spark.createDataFrame(list(enumerate(["", ",", ".", "[verse]", "[chorus]", "a", "b", "a"])), "id int, token string")
    df = spark.createDataFrame([(1, "[verse] a . b zz , [chorus] a"), (2, None), (3, "")], "row_id bigint, lyrics string")
    got = sequences.annotate_tokens(df, vocab, "row_id", "lyrics").orderBy("row_id", "pos").collect()
    assert [r.token_id for r in got] == [3, 5, 2, 6, 1, 4, 5]
    assert [r.special_id for r in got] == [3, 3, 2, 3, 1, 4, 4]
    assert [r.sentence for r in got] == [0, 1, 0, 2, 0, 0, 1]


def test_arrays(spark):
    lit = lambda x: F.array(*map(F.lit, x))
    assert one(spark, sequences.third_tones(lit([3, 3, 3, 2]))) == [2, 2, 3, 2]
    assert one(spark, sequences.merge_repeated(lit(["A", "A", "A"]))) == ["AA", "A"]
    assert one(spark, sequences.targets(lit([7, 8]), 4, F.lit(1), F.lit(2))) == [7, 8, 1, 2]
    assert one(spark, sequences.stretch(lit([0, 1, 2]), F.lit(7))) == [0, 0, 1, 1, 1, 2, 2]
    assert one(spark, sequences.stretch(lit([0, 1, 2]), F.lit(7), False)) == [0, 0, 0, 1, 1, 2, 2]
    assert one(spark, sequences.mask(F.lit(3), 5)) == [1, 1, 1, 0, 0]
    assert one(spark, sequences.pad(lit([1, 2]), 1, F.lit(0))) == [1]


@pytest.mark.parametrize("n", [128, 129, 200, 224, 300, 1000])
def test_chunks(spark, n):
    chunks = sequences.overlapped_chunks(n, 128, 32)
    owner = [max(k for k, (_, a, z) in enumerate(chunks) if a <= p < z) for p in range(n)]
    assert one(spark, sequences.chunk_owner(F.lit(n), 128, 32)) == owner


def test_blocks_keep_their_type(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [])], "k int, x array<int>").select("k", sequences.blocks(F.col("x"), 2).alias("b"), sequences.previous_blocks(sequences.blocks(F.col("x"), 2), F.array(F.lit(0), F.lit(0))).alias("p"), sequences.interleave(F.col("x"), F.array(F.lit(8), F.lit(9)), 2).alias("i"))
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "array<array<int>>", "array<array<int>>", "array<int>"]
    assert [tuple(r) for r in df.collect()] == [(1, [[1, 2], [3]], [[0, 0], [1, 2]], [1, 2, 8, 3, 9]), (2, [], [], [])]


def test_short_chunk_is_an_error():
    with pytest.raises(ValueError):
        sequences.overlapped_chunks(127, 128, 32)


def test_selection(spark):
    df = spark.createDataFrame([("g", 1, 0.4), ("g", 2, 0.3), ("g", 3, 0.3)], "g string, t int, p double")
    assert {r.t for r in selection.top_k(df, ["g"], "p", 2).collect()} == {1, 2, 3}
    assert {r.t for r in selection.top_p(df, ["g"], "p", 0.5, "t").collect()} == {1, 2}
    assert selection.greedy(df, ["g"], "p", "t").first().t == 1
    assert selection.draw(df.withColumn("u", F.lit(0.65)), ["g"], "p", "t", "u").first().t == 2
    assert abs(sum(r.p for r in selection.choose(df, ["g"], "p", "t", k=2).collect()) - 1) < 1e-9


def test_lexicons(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "word string, phones string")
    more = spark.createDataFrame([("b", "9"), ("c", "3"), ("c", "4")], "word string, phones string")
    assert {tuple(r) for r in lexicons.add_absent(base, more).collect()} == {("a", "1"), ("b", "2"), ("c", "3")}
    assert {tuple(r) for r in lexicons.override(base, more.limit(1)).collect()} == {("a", "1"), ("b", "9")}
    assert one(spark, lexicons.possessive(F.array(F.lit("K"), F.lit("S")))) == ["K", "S", "AH0", "Z"]
    assert one(spark, lexicons.known_phones(F.array(*map(F.lit, ["'", "UW", "<unk>", "XX", "AA"])), F.array(*map(F.lit, ["-", "UNK", "AA", "UW"])))) == ["-", "UNK", "AA"]


def test_attributes(spark):
    m = F.create_map(F.lit("a"), F.lit("1"))
    flat = attributes.flatten({"text": m, "wav": F.lit(None).cast("map<string,string>")})
    assert one(spark, flat) == {"text.a": "1"}
    assert one(spark, attributes.unflatten(flat, "text")) == {"a": "1"}
    assert one(spark, attributes.without(m, "a")) == {"a": None}
    with pytest.raises(Exception, match="no attribute"):
        one(spark, attributes.without(m, "b"))
    assert one(spark, attributes.zip_member(F.lit("a:b:c"))) is None


def test_queries_run(spark):
    """Every core query on the smallest tables, if they are there."""
    import os

    from strophe.plans import catalog

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    for name, q in catalog.queries().items():
        df = q(spark, d)
        assert df.columns and df.count() >= 0, name
