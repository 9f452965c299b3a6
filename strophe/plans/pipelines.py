"""Queries of the phoneme pipelines and of operators on songs, segments, words and vectors.

Operators whose rules SQL can't say run on fixed rows, against readings worked out by hand.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.functions import chinese, english
from strophe.operators import arrays, attributes, lexicons, phonemes, pinyin, selection, sequences, tones
from strophe.plans.arrays import _E, _R, _SEQ, by_user, rounded, sequence, vectors
from strophe.plans.registry import Tables, query
from strophe.plans.text import _WORDS, words


def _literal(x) -> str:
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def fixed_sql(names: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({names})"


# Sentences and how they are read, by hand.
READ = [
    ("1995年3月1日", "一九九五年三月一日"), ("2021-03-04", "二零二一年三月四日"), ("2021.03.04", "二零二一年三月四日"), ("12:05", "十二点零五分"), ("8:30", "八点半"), ("0:00", "零点"), ("10:00:09", "十点零九秒"), ("8:30-12:15", "八点半至十二点半"), ("8:10-12:30", "八点十分至十二点三十分"),
    ("3°C~5°C", "三度至五度"), ("-10°C", "零下十度"), ("7/12", "十二分之七"), ("-1/2", "负二分之一"), ("62%", "百分之六十二"), ("13812345678", "幺三八幺二三四五六七八"), ("0421-33441122", "零四二幺，三三四四幺幺二二"), ("400-123-4567", "四零零，幺二三，四五六七"), ("12~23", "十二到二十三"), ("-3~4", "负三到四"),
    ("1+2=3", "一加二等于三"), ("-5", "负五"), ("3.20", "三点二"), (".22", "零点二二"), ("583分", "五百八十三分"), ("3+个", "三多个"), ("300封", "三百封"), ("20多岁", "二十多岁"), ("27149", "二七幺四九"), ("00078", "零零零七八"), ("42", "四十二"), ("3mm", "三米米"), ("Ａ１２", "A十二"),
]
# Traditional characters and simplified ones, of which the last of a repeated one counts.
PAIRS = [("開", "幵"), ("開", "开"), ("門", "门"), ("這", "这"), ("個", "个")]


@query(fixed_sql("said, read", READ))
def chinese_sentences(t: Tables) -> DataFrame:
    """Dates, times, ranges, quantities, phones, arithmetic and other numbers, each as a sentence."""
    rows = t.spark.createDataFrame([(a,) for a, _ in READ], "said string")
    return rows.select("said", F.array_join(chinese.normalise("said"), "").alias("read"))


# Texts and what the phoneme stage takes of them, by hand.
STAGE = [("這個開門 3个。", "这个开门三个."), ("嗯，8:30！好？", "恩,八点半!好?"), ("a中b、文", "中,文"), ("", ""), ("12:05；7/12", "十二点零五分,十二分之七")]


@query(fixed_sql("text, spoken", STAGE))
def chinese_spoken_text(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(a,) for a, _ in STAGE], "text string")
    return rows.select("text", chinese.spoken_text(F.col("text"), chinese.normaliser(PAIRS)).alias("spoken"))


@query("SELECT row_id, translate(lyrics, '開門這個', '开门这个') AS lyrics FROM songs")
def simplified_text(t: Tables) -> DataFrame:
    return t.songs.select("row_id", chinese.simplified(F.col("lyrics"), PAIRS).alias("lyrics"))


# Words with tags, finals and splits, and the finals as they are spoken, by hand.
TONES = [
    ("看不懂", "v", ["an4", "u4", "ong3"], 2, ["an4", "u5", "ong3"]), ("不怕", "v", ["u4", "a4"], 1, ["u2", "a4"]), ("看一看", "v", ["an4", "i1", "an4"], 1, ["an4", "i5", "an4"]), ("一段", "m", ["i1", "uan4"], 1, ["i2", "uan4"]), ("一天", "m", ["i1", "ian1"], 1, ["i4", "ian1"]),
    ("第一", "m", ["i4", "i1"], 1, ["i4", "i1"]), ("一零零", "m", ["i1", "ing2", "ing2"], 1, ["i1", "ing2", "ing2"]), ("奶奶", "n", ["ai3", "ai3"], 1, ["ai3", "ai5"]), ("量子", "n", ["iang4", "i3"], 1, ["iang4", "i3"]), ("桌子", "n", ["uo1", "i3"], 1, ["uo1", "i5"]), ("好哈", "y", ["ao3", "a1"], 1, ["ao3", "a5"]),
    ("家里", "s", ["ia1", "i3"], 1, ["ia1", "i5"]), ("三个", "m", ["an1", "e4"], 1, ["an1", "e5"]), ("老虎", "n", ["ao3", "u3"], 1, ["ao2", "u3"]), ("展览馆", "n", ["an3", "an3", "uan3"], 2, ["an2", "an2", "uan3"]), ("纸老虎", "n", ["i3", "ao3", "u3"], 1, ["i3", "ao2", "u3"]), ("岂有此理", "i", ["i3", "ou3", "i3", "i3"], 2, ["i2", "ou3", "i2", "i3"]),
]


@query(fixed_sql("word, pos, spoken", [(w, p, s) for w, p, _, _, s in TONES]))
def tone_rules(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([r[:4] for r in TONES], "word string, pos string, f array<string>, s int")
    return rows.select("word", "pos", tones.spoken(F.col("word"), F.col("pos"), F.col("f"), F.col("s")).alias("spoken"))


# Sentences (words, tags, finals) and their words after the merges, by hand.
MERGES = [
    (1, ["不", "去", "不"], ["d", "v", "d"], [["u4"], ["v4"], ["u4"]], ["不去", "不"]), (2, ["A", "A", "A"], ["x", "x", "x"], [["a1"]] * 3, ["AA", "A"]), (3, ["听", "一", "听"], ["v", "m", "v"], [["ing1"], ["i1"], ["ing1"]], ["听一听"]), (4, ["看", "一", "看"], ["v", "m", "n"], [["an4"], ["i1"], ["an4"]], ["看", "一看"]),
    (5, ["看", "一", "看", "听", "一", "听"], ["v", "m", "v", "v", "m", "v"], [["an4"], ["i1"], ["an4"], ["ing1"], ["i1"], ["ing1"]], ["看", "一", "看", "听", "一", "听"]), (6, ["花", "儿"], ["n", "r"], [["ua1"], ["er2"]], ["花儿"]), (7, ["我", "很", "好"], ["r", "d", "a"], [["uo3"], ["en3"], ["ao3"]], ["我很好"]), (8, ["小", "雨伞"], ["a", "n"], [["iao3"], ["v3", "an3"]], ["小雨伞"]),
]


@query(fixed_sql("id, merged", [(r[0], r[4]) for r in MERGES]))
def word_merges(t: Tables) -> DataFrame:
    """Words of sentences after the merges before the tone rules."""
    rows = t.spark.createDataFrame([r[:4] for r in MERGES], "id int, words array<string>, tags array<string>, finals array<array<string>>")
    return tones.merged_words(rows, "id").select("id", F.col("merged.word").alias("merged"))


# An invented table of syllables, a sentence of words, and its phones.
SYLLABLES = [("ni", "n", "i"), ("hao", "h", "ao"), ("bu", "b", "u"), ("pa", "p", "a"), ("yi", "y", "i"), ("dui", "d", "ui")]
SPOKEN = [
    (1, ["你好", "，", "ok", "不", "怕"], ["v", "x", "eng", "d", "v"], [["n", "h"], ["，"], ["o"], ["b"], ["p"]], [["i3", "ao3"], ["，"], ["o5"], ["u4"], ["a4"]], [1, None, None, None, None], ["n", "i2", "h", "ao3", "，", "b", "u2", "p", "a4"], [2, 2, 1, 2, 2]),
    (2, ["一对"], ["m"], [["", "d"]], [["i1", "uei4"]], [1], ["y", "i2", "d", "ui4"], [2, 2]),
]


@query(fixed_sql("id, phones, counts", [(r[0], r[6], r[7]) for r in SPOKEN]))
def chinese_word_phones(t: Tables) -> DataFrame:
    """Segmented words to phones: merges, tone rules, syllables."""
    rows = t.spark.createDataFrame([r[:6] for r in SPOKEN], "id int, words array<string>, tags array<string>, initials array<array<string>>, finals array<array<string>>, splits array<int>")
    table = t.spark.createDataFrame(SYLLABLES, "syllable string, consonant string, vowel string")
    return phonemes.chinese_phones(rows, table, "id")


# English texts with numbers, and how they are read.
NUMBERS = [("2,500 birds", "twenty-five hundred birds"), ("in 1984", "in nineteen eighty-four"), ("in 2007", "in two thousand seven"), ("$3.50", "3 dollars, 50 cents"), ("21st", "twenty-first"), ("40th", "fortieth"), ("3.14", "three point one four"), ("7", "seven"), ("1000001", "one million one"), ("no number", "no number")]
NUMBERS[3] = ("$3.50", "three dollars, fifty cents")


@query(fixed_sql("text, said", NUMBERS))
def english_numbers(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(a,) for a, _ in NUMBERS], "text string").select("text", english.numbers_said(F.col("text")).alias("said"))


_TOKENS = "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+(?:''s)?|[0-9]+')) AS token FROM documents WHERE lang = 'en' AND kind = 'review'"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _lexicon_words(t: Tables) -> DataFrame:
    long = words(t, "guide").where(F.length("word") > 1)
    letters = t.spark.createDataFrame([(c,) for c in _LETTERS], "word string")
    return long.union(letters).select("word", F.array(F.concat(F.lit("G_"), F.upper("word")), F.lit("T")).alias("phones"))


@query(f"""WITH tokens AS ({_TOKENS}), lex AS (SELECT word, ['G_' || upper(word), 'T'] AS phones FROM ({_WORDS.format(kind='guide')} ) WHERE length(word) > 1), names AS (SELECT word, ['N_' || word] AS phones FROM ({_WORDS.format(kind='note')})),
    homographs AS (SELECT * FROM (VALUES ('read', ['R', 'EH1', 'D']), ('complex', ['K', 'AA1', 'M', 'P', 'L', 'EH0', 'K', 'S'])) h(word, phones)),
    x AS (SELECT token, lower(token) AS w, regexp_extract(lower(token), '^([a-z]+)''s$', 1) AS stem FROM tokens),
    y AS (SELECT x.*, l.phones AS own, n.phones AS named, h.phones AS homograph, s.phones AS stemmed, regexp_matches(token, '^[A-Z][a-z'']*$') AS title,
          list_concat([], flatten(list_transform(regexp_extract_all(w, '.'), lambda c: CASE WHEN c = 'a' THEN ['EY1'] ELSE ['G_' || upper(c), 'T'] END))) AS spelled, list_concat([], flatten(list_transform(regexp_extract_all(stem, '.'), lambda c: CASE WHEN c = 'a' THEN ['EY1'] ELSE ['G_' || upper(c), 'T'] END))) AS stemspelled
          FROM x LEFT JOIN lex l ON x.w = l.word LEFT JOIN names n ON x.w = n.word LEFT JOIN homographs h ON x.w = h.word LEFT JOIN lex s ON x.stem = s.word)
    SELECT token, CASE WHEN NOT regexp_matches(w, '[a-z]') THEN [w] WHEN length(w) = 1 THEN CASE WHEN token = 'A' THEN ['EY1'] ELSE ['G_' || upper(w), 'T'] END WHEN homograph IS NOT NULL THEN homograph WHEN own IS NOT NULL THEN own WHEN title AND named IS NOT NULL THEN named WHEN length(w) <= 3 THEN spelled
      WHEN stem <> '' AND length(stem) = 1 THEN CASE WHEN stem = 'a' THEN ['EY1', 'Z'] ELSE list_append(['G_' || upper(stem), 'T'], 'S') END WHEN stemmed IS NOT NULL THEN list_append(stemmed, 'S') WHEN stem <> '' AND length(stem) <= 3 THEN list_append(stemspelled, CASE WHEN stem LIKE '%a' THEN 'Z' ELSE 'S' END) END AS phones FROM y""")
def english_word_phones(t: Tables) -> DataFrame:
    """Tokens of the reviews through all tiers, with the words of guides and notes as lexicons."""
    found = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+(?:'s)?|[0-9]+"), 0))
    tokens = t.documents.where("lang = 'en' and kind = 'review'").select(found.alias("token")).distinct().withColumn("tag", F.lit("NN"))
    names = words(t, "note").select("word", F.array(F.concat(F.lit("N_"), "word")).alias("phones"))
    none = t.spark.createDataFrame([], "word string, parts array<string>")
    return phonemes.english_phones(tokens, _lexicon_words(t), names, none).select("token", "phones")


@query(f"SELECT word, list_concat([upper(left(word, 1)), upper(right(word, 1))], CASE WHEN right(word, 1) IN ('p', 't', 'k', 'f') THEN ['S'] WHEN right(word, 1) IN ('s', 'z') THEN ['AH0', 'Z'] ELSE ['Z'] END) AS phones FROM ({_WORDS.format(kind='note')})")
def possessive_phones(t: Tables) -> DataFrame:
    ends = F.array(F.upper(F.left("word", F.lit(1))), F.upper(F.right("word", F.lit(1))))
    return words(t, "note").select("word", lexicons.possessive(ends).alias("phones"))


@query(f"SELECT word, list_filter([CASE WHEN word LIKE 'a%' THEN '-' END, 'AA', CASE WHEN length(word) > 5 THEN 'UNK' END], lambda p: p IS NOT NULL) AS phones FROM ({_WORDS.format(kind='note')})")
def known_phone_filter(t: Tables) -> DataFrame:
    """An apostrophe becomes a dash, <unk> UNK; control phones and phones that are no symbol go."""
    given = F.array(F.when(F.col("word").startswith("a"), "'").otherwise("</s>"), F.lit("UW"), F.lit("AA"), F.when(F.length("word") > 5, "<unk>").otherwise("XX"))
    symbols = F.array(*map(F.lit, ("-", "UNK", "AA", "UW", "</s>")))
    return words(t, "note").select("word", lexicons.known_phones(given, symbols).alias("phones"))


@query(f"SELECT word, CASE WHEN length(word) > 4 THEN [left(word, length(word) - 2), right(word, 2)] ELSE [left(word, 1), substr(word, 2)] END AS parts FROM ({_WORDS.format(kind='note')}) WHERE length(word) > 1 AND instr(word, right(word, 2)) = length(word) - 1")
def sub_word_split(t: Tables) -> DataFrame:
    """A word cut at its shortest part."""
    w = words(t, "note").where("length(word) > 1 and instr(word, right(word, 2)) = length(word) - 1")
    n = F.length("word")
    parts = F.when(n > 4, F.array(F.expr("left(word, length(word) - 2)"), F.right("word", F.lit(2)))).otherwise(F.array(F.left("word", F.lit(1)), F.col("word")))
    return w.select("word", sequences.split_word(F.col("word"), parts).alias("parts"))


@query("""SELECT row_id, string_agg(CASE WHEN token = '' OR regexp_matches(token, '^\\[\\w+\\]$') OR token IN (SELECT token FROM vocab) OR f.category IS NULL THEN token ELSE '<' || f.category || '>' END, ' ' ORDER BY k) AS text
    FROM (SELECT row_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS k FROM (SELECT row_id, string_split_regex(trim(lyrics), ' +') AS ts FROM songs WHERE lyrics IS NOT NULL)) x
    LEFT JOIN (SELECT term, min(category) AS category FROM flag_terms GROUP BY term) f ON x.token = f.term GROUP BY row_id""")
def tokens_resolved(t: Tables) -> DataFrame:
    """Tokens that are no symbol said otherwise where a table has them, and the text put together again."""
    tokens = t.songs.where("lyrics is not null").select("row_id", F.posexplode(F.split(F.trim("lyrics"), " +")).alias("k", "token"))
    said = t.flag_terms.select(F.col("term").alias("token"), F.concat(F.lit("<"), "category", F.lit(">")).alias("text"))
    return phonemes.resolved(tokens, t.vocab, said, "row_id", "k")


_RUNS = """WITH s AS (SELECT DISTINCT * FROM segments),
    a AS (SELECT *, row_number() OVER w AS n, CASE WHEN row_number() OVER w > 1 AND lag(structure) OVER w IS NOT DISTINCT FROM structure THEN 0 ELSE 1 END AS fresh FROM s WHERE song_id <> 'untitled'
          WINDOW w AS (PARTITION BY song_id ORDER BY seq NULLS FIRST, start_time NULLS FIRST, end_time NULLS FIRST, structure NULLS FIRST, lyric NULLS FIRST)),
    b AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY song_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM a),
    c AS (SELECT *, lead(end_time) OVER (PARTITION BY song_id, run ORDER BY n) AS nxt, lead(1) OVER (PARTITION BY song_id, run ORDER BY n) AS more, last(end_time) OVER (PARTITION BY song_id, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final, coalesce(structure IN ('verse', 'chorus', 'bridge'), false) AS sung FROM b)
    SELECT song_id, run, start_time, CASE WHEN NOT sung THEN final WHEN more = 1 THEN nxt ELSE end_time END AS end_time, structure, lyric FROM c WHERE sung OR fresh = 1
    UNION ALL SELECT song_id, 1, start_time, end_time, structure, lyric FROM s WHERE song_id IS NULL OR song_id = 'untitled'"""


@query(_RUNS)
def segments_merge(t: Tables) -> DataFrame:
    """Runs of one structure in songs. A placeholder is no song: each of its rows is a run of its own, so it makes no hot window."""
    rows = t.segments.distinct()
    real = F.col("song_id").isNotNull() & (F.col("song_id") != "untitled")
    own = F.when(real, F.concat(F.lit("="), "song_id")).otherwise(F.concat(F.lit("#"), F.to_json(F.struct(*rows.columns))))
    merged = sequences.merge_runs(rows.withColumn("key", own), "key", ["seq"], "start_time", "end_time", "structure", "lyric")
    song = F.when(F.col("key").startswith("="), F.expr("substr(key, 2)")).otherwise(F.get_json_object(F.expr("substr(key, 2)"), "$.song_id"))
    return merged.select(song.alias("song_id"), "run", "start_time", "end_time", "structure", "lyric")


@query(f"SELECT vec_id, x AS stitched, CAST(len(x) AS INTEGER) AS n FROM {_E}")
def chunks_stitched(t: Tables) -> DataFrame:
    """Vectors split into overlapping chunks and put together again."""
    c = sequences.split_chunks(F.col("x"), 24, 8)
    return vectors(t).select("vec_id", c.alias("c"), F.size("x").alias("n")).select("vec_id", sequences.stitched(F.col("c"), 8).alias("stitched"), "n")


@query(f"SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN i <= vec_id % 65 THEN x[i] ELSE 0.0 END) AS kept, CAST(least(vec_id % 7, 5) AS INTEGER) AS pairs FROM {_E}")
def masked_and_zipped(t: Tables) -> DataFrame:
    m = sequences.mask((F.col("vec_id") % 65).cast("int"), 64)
    short = F.slice("x", F.lit(1), (F.col("vec_id") % 7).cast("int"))
    return vectors(t).select("vec_id", F.transform(arrays.masked(F.col("x"), m), lambda e: e + 0.0).alias("kept"), F.size(sequences.zipped(short, F.slice("x", 1, 5))).alias("pairs"))


@query(f"SELECT vec_id, list_transform(range(0, 5), lambda i: CASE WHEN i < vec_id % 8 THEN [x[i + 1], x[i + 2]] ELSE [0.0, 0.0] END) AS rows, list_transform(range(0, 5), lambda i: CAST(i < vec_id % 8 AS INTEGER)) AS mask FROM {_E}")
def padded_rows(t: Tables) -> DataFrame:
    pairs = F.transform(F.slice("x", F.lit(1), (F.col("vec_id") % 8).cast("int")), lambda e, i: F.array(e, F.get("x", i + 1)))
    p = sequences.pad_rows(pairs, 5, F.array(F.lit(0.0), F.lit(0.0)))
    return vectors(t).select("vec_id", p["rows"].alias("rows"), p["mask"].alias("mask"))


@query("SELECT DISTINCT i, round(list_sum(list_transform(range(0, 12), lambda k: ((i >> k) & 1) / pow(2.0, k + 1))), 9) AS even, round(1 / (1 + exp(-(i / 100.0))), 9) AS time FROM (SELECT vec_id % 1000 AS i FROM embeddings)")
def time_samples(t: Tables) -> DataFrame:
    i = t.embeddings.select((F.col("vec_id") % 1000).alias("i")).distinct()
    return i.select("i", F.round(arrays.low_discrepancy(F.col("i")), 9).alias("even"), F.round(arrays.logit_normal(F.col("i") / 100), 9).alias("time"))


@query(f"SELECT DISTINCT p, {_R.format(x='list_transform(range(0, 8), lambda i: p / 2.0 * pow(10000.0, -((i % 4) * 2.0 / 8)))')} AS angles, {_R.format(x='list_transform(range(0, 8), lambda i: pow(((i % 4) * 2 + 3.2) / 11.2, (p - 100) / 512.0))')} AS scale FROM (SELECT vec_id % 200 AS p FROM embeddings)")
def rotary_decay(t: Tables) -> DataFrame:
    p = t.embeddings.select((F.col("vec_id") % 200).alias("p")).distinct()
    return p.select("p", rounded(arrays.rotary_angles(F.col("p"), 8, interpolation=2.0)).alias("angles"), rounded(arrays.rotary_scale(F.col("p"), F.lit(200), 8)).alias("scale"))


@query(f"SELECT DISTINCT t, round(t, 6) AS back FROM (SELECT (vec_id % 100) / 100.0 AS t FROM embeddings)")
def schedule_inverse(t: Tables) -> DataFrame:
    rows = t.embeddings.select(((F.col("vec_id") % 100) / 100).alias("t")).distinct()
    half = F.col("t") * F.acos(F.lit(-1.0)) / 2
    return rows.select("t", F.round(arrays.schedule_time(F.cos(half), F.sin(half)), 6).alias("back"))


@query(f"SELECT vec_id, [round(x[1] + 10 + vec_id % 3, 5), round(x[1] + 20 + vec_id % 3, 5)] AS added, [10 + vec_id % 3, 20 + vec_id % 3] AS joined FROM {_E}".replace("[10 + vec_id % 3, 20 + vec_id % 3]", "[CAST(10 + vec_id % 3 AS DOUBLE), CAST(20 + vec_id % 3 AS DOUBLE)]"))
def embedding_tables(t: Tables) -> DataFrame:
    """Rows of embedding tables by their ids, added up or joined."""
    table = F.array(*(F.array(F.lit(10.0 + k), F.lit(20.0 + k)) for k in range(3)))
    own = F.array(F.array(F.get("x", 0), F.get("x", 0)))
    k = (F.col("vec_id") % 3).cast("int")
    rows = vectors(t).select("vec_id", arrays.embedded([table, own], [k, F.lit(0)]).alias("s"), arrays.embedded([table], [k], "concat").alias("joined"))
    return rows.select("vec_id", F.transform("s", lambda e: F.round(e, 5)).alias("added"), "joined")


_B2 = "(SELECT label, list_transform(range(1, 9), lambda i: 0.0 + label * {a} + i * {b}) AS v FROM (SELECT DISTINCT label FROM embeddings))"


@query(f"""WITH e AS (SELECT vec_id, x[1:8] AS y FROM {_E}), b1 AS {_B2.format(a='0.1', b='0.01')}, b2 AS {_B2.format(a='0.03', b='-0.02')},
    one AS (SELECT vec_id, any_value(y) AS y, arg_min(label, [round(d, 9), label]) AS c1, arg_min(v, [round(d, 9), label]) AS v1 FROM (SELECT vec_id, y, label, v, list_sum(list_transform(range(1, 9), lambda i: (y[i] - v[i]) * (y[i] - v[i]))) AS d FROM e, b1) GROUP BY vec_id),
    r AS (SELECT vec_id, c1, list_transform(range(1, 9), lambda i: y[i] - v1[i]) AS z FROM one)
    SELECT vec_id, [c1, arg_min(label, [round(d, 9), label])] AS codes FROM (SELECT vec_id, c1, label, list_sum(list_transform(range(1, 9), lambda i: (z[i] - v[i]) * (z[i] - v[i]))) AS d FROM r, b2) GROUP BY vec_id, c1""")
def residual_quantised(t: Tables) -> DataFrame:
    """Two levels of residual quantisation."""
    labels = t.embeddings.select(F.col("label").alias("code")).distinct()
    book = lambda a, b: labels.select("code", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.col("code") * a + i * b).alias("vector"))
    rows = vectors(t).select("vec_id", F.slice("x", 1, 8).alias("y"))
    return attributes.residual_codes(rows, [book(0.1, 0.01), book(0.03, -0.02)], "y").select("vec_id", "codes")


@query(f"SELECT event_id, CAST(len(list_distinct(CASE WHEN pos < 10 THEN list_append(pool, 99) ELSE pool END)) AS INTEGER) AS pool FROM (SELECT event_id, pos, coalesce(list(token) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS pool FROM {_SEQ})")
def repetition_padded(t: Tables) -> DataFrame:
    return selection.repetition_window(sequence(t), "user_id", "pos", "token", 10, eos=99).select("event_id", F.size("pool").alias("pool"))


@query(f"""WITH s AS {_SEQ}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id) SELECT q.user_id, q.pos, round(sum(e * value) / sum(e), 6) AS out FROM (SELECT q.user_id, q.pos, k.value, exp((q.token * k.token + 1.0) / 100 / sqrt(2)) AS e FROM s q JOIN n USING (user_id) JOIN s k ON q.user_id = k.user_id
    AND k.pos >= greatest(0, least(q.pos - 2, n.n - 5)) AND k.pos < greatest(0, least(q.pos - 2, n.n - 5)) + 5) q GROUP BY 1, 2""")
def neighbourhood_attention(t: Tables) -> DataFrame:
    """Attention over the five events around each, the window kept within the user's events."""
    x = F.array(F.col("token") / 10, F.lit(0.1))
    rows = sequence(t).select("user_id", "pos", x.alias("x"), "value")
    return attributes.neighbourhood(rows, "user_id", "pos", "x", "x", "value", 5).select("user_id", "pos", F.round("out", 6).alias("out"))


@query("SELECT event_id, ['kind', 'props'] AS names, event_type AS kind, CAST(NULL AS VARCHAR) AS dropped FROM events")
def attribute_listing(t: Tables) -> DataFrame:
    """Names of a kind, one kind's entries alone, and one of them nulled."""
    flat = attributes.flatten({"text": F.create_map(F.lit("props"), F.col("props"), F.lit("kind"), F.col("event_type")), "wav": F.create_map(F.lit("path"), F.lit("p"))})
    rows = t.events.select("event_id", flat.alias("flat"))
    text = attributes.unflatten(F.col("flat"), "text")
    return rows.select("event_id", attributes.names(F.col("flat"), "text").alias("names"), text["kind"].alias("kind"), attributes.without(text, "props")["props"].alias("dropped"))


@query("SELECT row_id, lyrics AS text, CASE WHEN prompt_wav IS NULL THEN 0 ELSE 7 END AS length FROM songs")
def condition_assembly(t: Tables) -> DataFrame:
    """The conditions of a song: its text, and its prompt or the null wave."""
    null = attributes.null_wave()
    wave = F.when(F.col("prompt_wav").isNotNull(), null.withField("length", F.lit(7).cast("bigint")).withField("path", F.col("prompt_wav")))
    c = attributes.assembled({"lyrics": F.col("lyrics")}, {"prompt": wave}, ("lyrics", "prompt"))
    return t.songs.select("row_id", c.alias("c")).select("row_id", F.col("c.text")["lyrics"].alias("text"), F.col("c.wav")["prompt"]["length"].cast("int").alias("length"))


@query(f"SELECT user_id, list_transform(range(0, len(x)), lambda i: (i + 1) % 5 = 0) AS summary FROM (SELECT user_id, list(token ORDER BY pos) AS x FROM {_SEQ} GROUP BY user_id)")
def block_summaries(t: Tables) -> DataFrame:
    """Which outputs sum up a block of four."""
    return by_user(t, (F.col("event_id") % 17).cast("int")).select("user_id", F.transform("x", lambda _, i: (i + 1) % 5 == 0).alias("summary"))


@query(r"""SELECT doc_id, string_agg(CASE WHEN regexp_matches(run, '^[一-龥]') THEN ' <' || length(run) || '> ' ELSE run END, '' ORDER BY k) AS wrapped
    FROM (SELECT doc_id, unnest(rs) AS run, generate_subscripts(rs, 1) AS k FROM (SELECT doc_id, regexp_extract_all(replace(text, chr(10), '.'), '[一-龥]+|[,.!?…\-]|[^一-龥,.!?…\-]+') AS rs FROM documents WHERE text IS NOT NULL)) GROUP BY doc_id""")
def han_wrapped(t: Tables) -> DataFrame:
    """Han runs given as their sounds in angle brackets (here their lengths), all else as it is."""
    rows = t.documents.where("text <> ''").select("doc_id", sequences.script_runs(F.col("text")).alias("runs"))
    sounds = F.transform(F.filter("runs", lambda r: r["script"] == "zh"), lambda r: F.array(F.length(r["run"]).cast("string")))
    return rows.select("doc_id", sounds.alias("sounds"), "runs").select("doc_id", pinyin.wrapped(F.col("runs"), F.col("sounds")).alias("wrapped"))
