"""Files in and out, streams, plugged-in models, and tone rules."""

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.operators import arrays, attributes, models, pinyin, sequences, tones
from strophe.sources import audio, records
from strophe.streaming import lyrics as streams

GOOD = '{"idx": "s1", "lyrics": "[Verse] a, b", "prompt_wav": "p.wav", "extra": 1}\n{"prompt_wav": "q", "lyrics": "x", "idx": 5}\n'


def test_songs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(GOOD)
    got = {tuple(r) for r in records.read_songs(spark, str(tmp_path / "a.jsonl")).collect()}
    assert got == {("s1", "[Verse] a, b", "p.wav"), ("5", "x", "q")}
    records.write_songs(records.read_songs(spark, str(tmp_path / "a.jsonl")), str(tmp_path / "out"))
    assert {tuple(r) for r in records.read_songs(spark, str(tmp_path / "out")).collect()} == got


@pytest.mark.parametrize("line", ["", "{", '{"idx": "a", "lyrics": "b"}', "null", "[1]"])
def test_broken_songs(spark, tmp_path, line):
    (tmp_path / "a.jsonl").write_text(GOOD + line + "\n")
    with pytest.raises(Exception, match="not a song record"):
        records.read_songs(spark, str(tmp_path / "a.jsonl")).collect()
    assert records.read_songs(spark, str(tmp_path / "a.jsonl"), strict=False).count() == 2


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{\n"a": {"b": 1}}')
    assert records.read_config(spark, str(tmp_path / "c.json")) == {"a": {"b": 1}}


def test_audio(spark, tmp_path):
    x = np.stack([np.sin(np.arange(4000) / 20), np.zeros(4000)]).astype(np.float32) * 0.5
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(x, 8000))
    (tmp_path / "b.wav").write_bytes(b"nothing")
    got = {r.path.rpartition("/")[2]: r for r in audio.down_mixed(audio.read_audio(spark, str(tmp_path), seconds=0.25)).collect()}
    assert got["b.wav"].error and got["b.wav"].pcm is None
    assert got["a.wav"].sample_rate == 8000 and np.allclose(got["a.wav"].pcm[0], x[:, :2000].mean(0), atol=1e-3)
    assert wave.open(str(tmp_path / "a.wav")).getnchannels() == 2


class Halves(models.Codec):
    sample_rate, channels, frame_rate, dim = 8000, 2, 1.0, 1

    def encode(self, wav):
        return [[sum(c) for c in wav]]

    def decode(self, latent):
        return latent


def test_models(spark):
    df = spark.createDataFrame([(1, [[1.0] * 3000]), (2, [[1.0] * 10]), (3, None)], "k bigint, wav array<array<double>>")
    assert {r.k: r.latent for r in models.encoded(df, Halves(), "k", "wav").collect()} == {1: [[3000.0, 3000.0]], 2: [], 3: None}
    df = spark.createDataFrame([(1, [1]), (2, None), (3, [9])], "k bigint, prompt array<int>")
    got = models.generated(df, lambda x: [len(x), len(x) + 1] if len(x) < 6 else [99], "k", "prompt", 99, 8)
    assert {r.k: r.tokens for r in got.collect()} == {1: [1, 1, 2, 3, 4, 5, 6], 2: [0, 1, 2, 3, 4, 5], 3: [9, 1, 2, 3, 4, 5, 6]}
    models.processor("upper", F.upper)
    assert models.processed(spark.createDataFrame([("a",)], "t string"), "upper", "t").first().t == "A"
    with pytest.raises(KeyError):
        models.processed(df, "missing", "prompt")


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(GOOD)
    q = streams.song_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.lyrics for r in spark.table("cleaned").collect()} == {"[verse] a. b", "x"}


def test_offsets(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema("song_id string, tokens array<int>").option("maxFilesPerTrigger", 1).json(str(folder))
    for i, rows in enumerate(([("a", [1, 2]), ("b", [1])], [("a", [3, 4, 5])])):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"song_id": s, "tokens": x}) for s, x in rows))
        q = streams.running_offsets(stream).writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(90)
    got = sorted((r.song_id, r["first"], r.tokens) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0, 2), ("a", 2, 3), ("b", 0, 1)]


def test_arrivals(spark, tmp_path):
    spark.createDataFrame([("a", i) for i in range(3)], "source string, n int").select("source", F.lit("2024-01-01").cast("timestamp").alias("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, at timestamp").parquet(str(tmp_path / "in"))
    q = streams.arrivals(stream, "at", "source").writeStream.format("memory").outputMode("complete").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.source, r.n) for r in spark.table("arrived").collect()] == [("a", 3)]


#: Words with their tags, finals and splits, and the finals as they are spoken.
SPOKEN = [
    ("看不懂", "v", "an4 u4 ong3", 2, "an4 u5 ong3"), ("不怕", "v", "u4 a4", 1, "u2 a4"), ("不好", "a", "u4 ao3", 1, "u4 ao3"),
    ("看一看", "v", "an4 i1 an4", 1, "an4 i5 an4"), ("一段", "m", "i1 uan4", 1, "i2 uan4"), ("一天", "m", "i1 ian1", 1, "i4 ian1"), ("第一", "m", "i4 i1", 1, "i4 i1"), ("一零零", "m", "i1 ing2 ing2", 1, "i1 ing2 ing2"), ("一，", "m", "i1 ，", 1, "i1 ，"),
    ("奶奶", "n", "ai3 ai3", 1, "ai3 ai5"), ("哈哈", "n", "a1 a1", 1, "a1 a5"), ("量子", "n", "iang4 i3", 1, "iang4 i3"), ("桌子", "n", "uo1 i3", 1, "uo1 i5"), ("好哈", "y", "ao3 a1", 1, "ao3 a5"), ("家里", "s", "ia1 i3", 1, "ia1 i5"), ("上来", "v", "ang4 ai2", 1, "ang4 ai5"), ("了", "ul", "e4", 1, "e5"), ("三个", "m", "an1 e4", 1, "an1 e5"), ("麻烦", "a", "a2 an2", 2, "a2 an5"), ("闹麻烦了", "v", "ao4 a2 an2 e4", 1, "ao4 a2 an2 e4"), ("闹麻烦", "v", "ao4 a2 an2", 1, "ao4 a2 an5"),
    ("老虎", "n", "ao3 u3", 1, "ao2 u3"), ("蒙古包", "n", "eng3 u3 ao1", 2, "eng2 u3 ao1"), ("展览馆", "n", "an3 an3 uan3", 2, "an2 an2 uan3"), ("纸老虎", "n", "i3 ao3 u3", 1, "i3 ao2 u3"), ("好喜欢", "v", "ao3 i3 uan1", 1, "ao2 i3 uan1"), ("岂有此理", "i", "i3 ou3 i3 i3", 2, "i2 ou3 i2 i3"),
]


def test_tone_rules(spark):
    df = spark.createDataFrame([(*r[:2], r[2].split(" "), r[3]) for r in SPOKEN] + [(None, "n", ["a1"], 1), ("", "x", [], 0)], "w string, p string, f array<string>, s int")
    got = [r.x for r in df.coalesce(1).select(tones.spoken(F.col("w"), F.col("p"), F.col("f"), F.col("s"), ["麻烦"]).alias("x")).collect()]
    assert [" ".join(x) for x in got[:-2]] == [r[4] for r in SPOKEN] and got[-2:] == [None, []]


#: Sentences (word/tag/finals) and their words after the merges.
MERGED = [
    ("不/d/u4 去/v/v4 不/d/u4", "不去/v 不/d"), ("不/d/u4 不/d/u4 去/v/v4", "不不/d 去/v"), ("A/x/a1 A/x/a1 A/x/a1", "AA/x A/x"),
    ("听/v/ing1 一/m/i1 听/v/ing1", "听一听/v"), ("看/v/an4 一/m/i1 看/n/an4", "看/v 一看/m"), ("看/n/an4 一/m/i1 看/v/an4 书/n/u1", "看/n 一书/m"),
    ("看/v/an4 一/m/i1 看/v/an4 听/v/ing1 一/m/i1 听/v/ing1", "看/v 一/m 看/v 听/v 一/m 听/v"),  # the second merge fails, so the step leaves all as it is
    ("花/n/ua1 儿/r/er2", "花儿/n"), ("我/r/uo3 很/d/en3 好/a/ao3", "我很好/r"), ("小/a/iao3 雨伞/n/v3,an3", "小雨伞/a"), ("好好/a/ao3,ao3 想/v/iang3", "好好/a 想/v"), ("买/v/ai3 苹/n/", "买/v 苹/n"),
]


def test_merges(spark):
    words = [[w.split("/") for w in s.split(" ")] for s, _ in MERGED]
    rows = [(i, [w[0] for w in s], [w[1] for w in s], [w[2].split(",") if w[2] else None for w in s]) for i, s in enumerate(words)]
    df = spark.createDataFrame([*rows, (99, None, None, None), (100, [], [], [])], "k int, words array<string>, tags array<string>, finals array<array<string>>")
    got = {r.k: " ".join(f"{x.word}/{x.pos}" for x in r.merged) for r in tones.merged_words(df, "k").collect()}
    assert got == {i: want for i, (_, want) in enumerate(MERGED)} | {99: "", 100: ""}


def test_syllables(spark):
    table = spark.createDataFrame([("ma", "m", "a"), ("dui", "d", "ui"), ("yi", "y", "i")], "syllable string, consonant string, vowel string")
    df = spark.createDataFrame([(1, ["m", "d", ",", ""], ["a3", "uei4", ",", "i1"]), (2, [], [])], "k bigint, initials array<string>, finals array<string>")
    got = {r.k: (r.phones, r.counts) for r in pinyin.aligned(df, table, "k", "initials", "finals").collect()}
    assert got == {1: (["m", "a3", "d", "ui4", ",", "y", "i1"], [2, 2, 1, 2])}
    with pytest.raises(Exception, match="no phones for"):
        pinyin.aligned(spark.createDataFrame([(1, ["x"], ["a1"])], "k bigint, initials array<string>, finals array<string>"), table, "k", "initials", "finals").collect()
    x = spark.createDataFrame([("a中文 b 字。",), ("中",), ("",), (None,), (",中,文,字",)], "t string").select("t", pinyin.han_only(F.col("t")).alias("x"))
    assert {r.t: r.x for r in x.collect()} == {"a中文 b 字。": "中文,字", "中": "中", "": "", None: None, ",中,文,字": "中文,字"}


def test_parts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(sequences.split_word(F.lit("abcde"), F.array(F.lit("de"), F.lit("abc")))) == ["abc", "de"]
    assert sequences.summaries(10, 3) == [3, 7]
    assert one(attributes.masked_length(F.array(F.lit(1), F.lit(1), F.lit(0)))) == 2
    with pytest.raises(Exception, match="holes"):
        one(attributes.masked_length(F.array(F.lit(0), F.lit(1))))
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    assert one(attributes.by_kind({"a": "sum", "b": "cross"}, m, "sum")) == {"a": "1"}
    with pytest.raises(Exception, match="unknown condition"):
        one(attributes.by_kind({"a": "sum"}, m, "sum"))
    table = F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0)))
    assert one(arrays.table_row(table, F.lit(1), 3.0)) == [6.0]
    with pytest.raises(Exception, match="beyond the table"):
        one(arrays.table_row(table, F.lit(2), 3.0))
    runs = sequences.script_runs(F.lit("ok 你好, 吧"))
    assert one(pinyin.wrapped(runs, F.array(F.array(F.lit("ni3"), F.lit("hao3")), F.array(F.lit("ba5"))))) == "ok  <ni3> <hao3> ,  <ba5> "
