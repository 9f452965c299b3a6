"""Song sheets with varying marks and quotes."""

import pyarrow as pa
import pytest

from strophe.operators.unpack import unpack, unpack_array

CASES = [
    ("[verse] a b | c d / e", ["a b", "c d", "e"]),
    ('[verse] "one; two" ; three', ["one; two", "three"]),
    ('[verse] "say ""hi""" // x \\"q\\" y', ['say "hi"', 'x "q" y']),
    ('[verse] "then go \\"look around\\"" / b', ['then go "look around"', "b"]),
    ("[verse] at 9.45 we go. 7/8 time. 3.5 km", ["at 9.45 we go", "7/8 time", "3.5 km"]),
    ("[verse] a, b ,\n[chorus] c ,", ["a, b", "c"]),
    ("[verse] a |  | b |, [outro] z", ["a", "b"]),
    ("[intro] x [inst] y [bridge]«p; q» • r", ["p; q", "r"]),
    ("[VERSE]\n一。二；三", ["一", "二", "三"]),
    ("[verse] 「等等 | 看吧」 | b", ["等等 | 看吧", "b"]),
    ('[verse] "a" and "b" / c', ['"a" and "b"', "c"]),
    ('[verse] 7" single / b [chorus] "x / y"', ['7" single', "b", "x / y"]),
    ("no tags / at all", []),
    ("[verse]", []),
    ("", []),
    (None, []),
    ("[verse] " + " / ".join(f"l{i}" for i in range(20_000)), [f"l{i}" for i in range(20_000)]),
]


@pytest.mark.parametrize("text,lines", CASES, ids=[str(i) for i in range(len(CASES))])
def test_lines(text, lines):
    assert unpack_array(pa.array([text], pa.string())).to_pylist() == [lines]


def test_batch_keeps_texts_apart():
    texts = pa.array([t for t, _ in CASES], pa.string())
    assert unpack_array(texts).to_pylist() == [x for _, x in CASES]
    assert unpack_array(texts.slice(3, 5)).to_pylist() == [x for _, x in CASES[3:8]]
    assert unpack_array(pa.array([], pa.string())).to_pylist() == []


def test_rows(spark):
    rows = [(i, t, "x", 1) for i, (t, _) in enumerate(CASES)] + [(None, "[verse] a", "x", 1), (0, CASES[0][0], "x", 1)]
    df = spark.createDataFrame(rows, "row_id bigint, lyrics string, line string, pos int")  # clashing names
    got = sorted((r.row_id if r.row_id is not None else -1, r.pos, r.line) for r in unpack(df, "row_id", "lyrics").collect())
    want = [(i, k, v) for i, (_, x) in enumerate(CASES) for k, v in enumerate(x, 1)] + [(-1, 1, "a")] + [(0, k, v) for k, v in enumerate(CASES[0][1], 1)]
    assert got == sorted(want)


def test_unusual_tags(spark):
    df = spark.createDataFrame([(1, "[ver​se] a / b ［сhorus］ c")], "row_id bigint, lyrics string")
    assert [r.line for r in unpack(df, "row_id", "lyrics").orderBy("pos").collect()] == ["a", "b", "c"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id bigint, lyrics string")
    assert unpack(df, "row_id", "lyrics").collect() == []
