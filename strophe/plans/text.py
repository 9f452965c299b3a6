"""Queries of the text operators: sheets, tokens, lexicons, number words."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.functions import chinese, english
from strophe.operators import attributes, lexicons, lyrics, pinyin, sequences, unpack
from strophe.plans import readings
from strophe.plans.registry import Tables, query
from strophe.session import spread
from strophe.sources.records import RECORD

#: Words of the English documents, as a lexicon would list them, and those of the notes.
_WORDS = "SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM documents WHERE lang = 'en' AND kind = '{kind}') WHERE w <> ''"


def words(t: Tables, kind: str) -> DataFrame:
    rows = t.documents.where((F.col("lang") == "en") & (F.col("kind") == kind))
    return rows.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where("w <> ''").select(F.lower("w").alias("word")).distinct()


def entries(t: Tables, kind: str, tag: str) -> DataFrame:
    return words(t, kind).withColumn("phones", F.concat(F.lit(tag), F.upper("word")))


def _entries(kind: str, tag: str) -> str:
    return f"SELECT word, '{tag}' || upper(word) AS phones FROM ({_WORDS.format(kind=kind)})"


@query()
def p3_found(t: Tables) -> DataFrame:
    return unpack.unpack(t.songs.where("source = 'sheetpad'"), "row_id", "lyrics")


@query(lyrics.CLEAN_SQL)
def clean_lyrics(t: Tables) -> DataFrame:
    return spread(t.songs.select("row_id", "lyrics")).select("row_id", lyrics.clean_lyrics(F.col("lyrics")).alias("lyrics"))


_TOKENS = r"""
    SELECT row_id, pos, id AS token_id, CAST(CASE WHEN tag IS NOT NULL THEN tag + 3 WHEN token = '.' THEN 2 WHEN token = ',' THEN 1 ELSE coalesce(now + 3, 0) END AS INTEGER) AS special_id,
           CAST(CASE WHEN tag IS NULL AND token NOT IN ('.', ',') THEN least(1 + dots, 199) ELSE 0 END AS INTEGER) AS sentence
    FROM (SELECT *, CAST(sum(CASE WHEN token = '.' THEN 1 ELSE 0 END) OVER (PARTITION BY row_id, island ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS dots
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY k) - 1 AS INTEGER) AS pos,
                 last_value(tag IGNORE NULLS) OVER (PARTITION BY row_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS now,
                 count(tag) OVER (PARTITION BY row_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS island
    FROM (SELECT row_id, k, x.token, v.id, CASE x.token WHEN '[verse]' THEN 0 WHEN '[chorus]' THEN 1 WHEN '[bridge]' THEN 2 WHEN '[inst]' THEN 3 WHEN '[intro]' THEN 4 WHEN '[outro]' THEN 5 WHEN '[silence]' THEN 6 END AS tag
          FROM (SELECT row_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS k FROM (SELECT row_id, string_split_regex(trim(lyrics), ' +') AS ts FROM songs WHERE lyrics IS NOT NULL)) x
          JOIN (SELECT token, min(id) AS id FROM vocab WHERE token <> '' GROUP BY token) v ON x.token = v.token)))"""


@query(_TOKENS)
def tokenize_structure(t: Tables) -> DataFrame:
    return sequences.annotate_tokens(spread(t.songs.select("row_id", "lyrics")), t.vocab, "row_id", "lyrics")


@query(f"WITH songs AS (SELECT row_id, regexp_replace(lyrics, '([.,])', ' \\1 ', 'g') AS lyrics FROM ({lyrics.CLEAN_SQL})) {_TOKENS}")
def lyrics_end_to_end(t: Tables) -> DataFrame:
    """The flagship: sheets cleaned, phoneme marks set apart, tokens numbered and annotated."""
    clean = spread(t.songs.select("row_id", "lyrics")).select("row_id", F.regexp_replace(lyrics.clean_lyrics(F.col("lyrics")), r"([.,])", " $1 ").alias("lyrics"))
    return sequences.annotate_tokens(clean, t.vocab, "row_id", "lyrics")


@query(r"""SELECT row_id, CAST(count(*) FILTER (WHERE v.token IS NOT NULL) AS BIGINT) AS known, CAST(count(*) FILTER (WHERE v.token IS NULL) AS BIGINT) AS unknown
           FROM (SELECT row_id, unnest(string_split_regex(trim(lyrics), ' +')) AS token FROM songs WHERE lyrics IS NOT NULL) x
           LEFT JOIN (SELECT DISTINCT token FROM vocab WHERE token <> '') v ON x.token = v.token GROUP BY row_id""")
def vocab_coverage(t: Tables) -> DataFrame:
    """Tokens in the vocabulary (semi join) and out of it (anti join), by song."""
    tokens = t.songs.where("lyrics is not null").select("row_id", F.explode(F.split(F.trim("lyrics"), " +")).alias("token"))
    known = t.vocab.where("token <> ''").select("token").distinct().withColumn("k", F.lit(1))
    joined = tokens.join(known, "token", "left")
    return joined.groupBy("row_id").agg(F.count("k").alias("known"), F.count_if(F.col("k").isNull()).alias("unknown"))


@query(r"SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(trim(lyrics), ' +')) AS token FROM songs WHERE lyrics IS NOT NULL) x WHERE token <> '' AND NOT EXISTS (SELECT 1 FROM vocab v WHERE v.token = x.token)")
def oov_anti_tokens(t: Tables) -> DataFrame:
    tokens = t.songs.where("lyrics is not null").select(F.explode(F.split(F.trim("lyrics"), " +")).alias("token")).where("token <> ''").distinct()
    return tokens.join(t.vocab.select("token"), "token", "left_anti")


@query("SELECT DISTINCT token FROM (SELECT token FROM vocab UNION ALL SELECT term FROM flag_terms UNION ALL SELECT unnest(['[pad]', '.', ',']))")
def vocab_union_distinct(t: Tables) -> DataFrame:
    marks = t.spark.createDataFrame([("[pad]",), (".",), (",",)], "token string")
    return t.vocab.select("token").union(t.flag_terms.select("term")).union(marks).distinct()


@query(f"{_entries('note', 'N_')} UNION ALL SELECT * FROM ({_entries('guide', 'G_')}) g WHERE word NOT IN ({_WORDS.format(kind='note')})")
def lexicon_add_if_absent(t: Tables) -> DataFrame:
    return lexicons.add_absent(entries(t, "note", "N_"), entries(t, "guide", "G_"))


@query(f"SELECT * FROM ({_entries('note', 'N_')}) n WHERE word NOT IN ({_WORDS.format(kind='guide')}) UNION ALL {_entries('guide', 'G_')}")
def lexicon_override(t: Tables) -> DataFrame:
    return lexicons.override(entries(t, "note", "N_"), entries(t, "guide", "G_"))


@query(f"SELECT * FROM ({_entries('note', 'N_')}) n WHERE word NOT IN ({_WORDS.format(kind='review')})")
def lexicon_remove(t: Tables) -> DataFrame:
    return lexicons.remove(entries(t, "note", "N_"), words(t, "review"))


@query(f"SELECT word FROM ({_WORDS.format(kind='review')}) EXCEPT SELECT word FROM ({_WORDS.format(kind='note')})")
def lexicon_missing(t: Tables) -> DataFrame:
    return lexicons.missing(words(t, "note"), words(t, "review"))


@query(f"SELECT word, CAST(len(regexp_extract_all(lower(word), '[aeiou]')) AS BIGINT) AS vowels FROM ({_WORDS.format(kind='note')}) WHERE word LIKE '%ing' OR length(word) = 1")
def lexicon_filter(t: Tables) -> DataFrame:
    return words(t, "note").where("word like '%ing' or length(word) = 1").withColumn("vowels", F.size(F.regexp_extract_all("word", F.lit("[aeiou]"), 0)).cast("bigint"))


@query("""SELECT structure, CASE WHEN x IN ('verse','chorus','bridge','inst','intro','outro','silence') THEN x END AS canonical, CAST(count(*) AS BIGINT) AS n
          FROM (SELECT structure, CASE lower(trim(structure)) WHEN 'start' THEN 'intro' WHEN 'end' THEN 'outro' WHEN 'solo' THEN 'inst' WHEN 'break' THEN 'inst' ELSE lower(trim(structure)) END AS x FROM segments) GROUP BY 1, 2""")
def structure_canonical(t: Tables) -> DataFrame:
    return t.segments.groupBy("structure").agg(F.count(F.lit(1)).alias("n")).select("structure", sequences.canonical_structure(F.col("structure")).alias("canonical"), "n")


@query("""SELECT structure, coalesce((structure IN ('verse','chorus','bridge')) = (trim(coalesce(lyric, '')) <> ''), false) AS legal, CAST(count(*) AS BIGINT) AS n FROM segments GROUP BY 1, 2""")
def structure_legal(t: Tables) -> DataFrame:
    return t.segments.groupBy("structure", sequences.legal_structure(F.col("structure"), F.col("lyric")).alias("legal")).agg(F.count(F.lit(1)).alias("n"))


_T = r"(?i)(\[(?:intro|verse|chorus|bridge|inst|outro|silence)\])"


@query(rf"""SELECT row_id, CAST(k - 1 AS INTEGER) AS section, nullif(lower(regexp_extract(p, '{_T}', 1)), '') AS tag, regexp_replace(regexp_replace(p, '^{_T[:4]}{_T[4:]}', ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS text
    FROM (SELECT row_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT row_id, string_split(regexp_replace(lyrics, '{_T}', chr(1) || '\1', 'g'), chr(1)) AS ps FROM songs WHERE lyrics IS NOT NULL))
    WHERE k > 1 OR regexp_matches(p, '[^\s\p{{Z}}]')""".replace("'^(?i)", "'(?i)^"))
def lyric_sections(t: Tables) -> DataFrame:
    return lyrics.sections(t.songs, "row_id", "lyrics")


@query(r"""SELECT doc_id, CAST(k - 1 AS INTEGER) AS seq, CASE WHEN regexp_matches(run, '^[一-龥]') THEN 'zh' WHEN regexp_matches(run, '^[,.!?…\-]$') THEN 'sp' ELSE 'en' END AS script, run
    FROM (SELECT doc_id, unnest(rs) AS run, generate_subscripts(rs, 1) AS k FROM (SELECT doc_id, regexp_extract_all(replace(text, chr(10), '.'), '[一-龥]+|[,.!?…\-]|[^一-龥,.!?…\-]+') AS rs FROM documents WHERE text IS NOT NULL))""")
def script_segments(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode_outer(sequences.script_runs(F.col("text"))).alias("seq", "r"))
    return rows.where("r is not null").select("doc_id", "seq", "r.script", "r.run")


@query(rf"SELECT o_orderkey, {readings.cardinal_sql('CAST(o_orderkey AS VARCHAR)')} AS words FROM orders")
def verbalize_cardinal(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", chinese.cardinal_words(F.col("o_orderkey").cast("string")).alias("words"))


@query(f"SELECT p_partkey, {readings.digits_sql('CAST(p_partkey AS VARCHAR)')} AS digits, {readings.digits_sql('CAST(p_partkey AS VARCHAR)', True)} AS telephone FROM part")
def verbalize_digits(t: Tables) -> DataFrame:
    x = F.col("p_partkey").cast("string")
    return t.part.select("p_partkey", chinese.digits_words(x).alias("digits"), chinese.digits_words(x, True).alias("telephone"))


_CENTS = "CAST(CAST(round(p_retailprice * 100) AS BIGINT) {op} 100 AS {text})"


@query(f"SELECT p_partkey, {readings.number_sql('w', 'd')} AS words FROM (SELECT p_partkey, CAST(CAST(round(p_retailprice * 100) AS BIGINT) // 100 AS VARCHAR) AS w, lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS d FROM part)")
def num_to_words(t: Tables) -> DataFrame:
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    rows = t.part.select("p_partkey", F.floor(cents / 100).cast("bigint").cast("string").alias("w"), F.lpad((cents % 100).cast("string"), 2, "0").alias("d"))
    return rows.select("p_partkey", chinese.number_words(F.col("w"), F.col("d")).alias("words"))


@query(f"""SELECT o_orderkey, {readings.digits_sql("strftime(o_orderdate, '%Y')")} || '年' || {readings.cardinal_sql("CAST(month(o_orderdate) AS VARCHAR)")} || '月' || {readings.cardinal_sql("CAST(day(o_orderdate) AS VARCHAR)")} || '日' AS words FROM orders""")
def date_words(t: Tables) -> DataFrame:
    """Dates as read out, by the chain; the SQL composes them from their parts."""
    days = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()
    said = days.select("day", F.get(chinese.normalise("day"), 0).alias("words"))
    return t.orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).join(said, "day").select("o_orderkey", "words")


@query(f"""SELECT event_id, {readings.cardinal_sql("CAST(hour(ts) AS VARCHAR)")} || '点' || CASE WHEN minute(ts) = 0 THEN '' WHEN minute(ts) = 30 THEN '半' ELSE CASE WHEN minute(ts) < 10 THEN '零' ELSE '' END || {readings.cardinal_sql("CAST(minute(ts) AS VARCHAR)")} || '分' END AS words FROM events""")
def time_words(t: Tables) -> DataFrame:
    times = t.events.select(F.date_format("ts", "H:mm").alias("at")).distinct()
    said = times.select("at", F.get(chinese.normalise("at"), 0).alias("words"))
    return t.events.withColumn("at", F.date_format("ts", "H:mm")).join(said, "at").select("event_id", "words")


@query(f"SELECT DISTINCT k, '百分之' || {readings.cardinal_sql('CAST(k AS VARCHAR)')} AS percent, {readings.cardinal_sql('CAST(k + 1 AS VARCHAR)')} || '分之' || {readings.cardinal_sql('CAST(k AS VARCHAR)')} AS fraction, '零下' || {readings.cardinal_sql('CAST(k AS VARCHAR)')} || '度' AS cold, {readings.cardinal_sql('CAST(k AS VARCHAR)')} || '个' AS many FROM (SELECT CAST(l_quantity AS BIGINT) AS k FROM lineitem)")
def quantity_words(t: Tables) -> DataFrame:
    k = t.lineitem.select(F.col("l_quantity").cast("bigint").alias("k")).distinct()
    said = lambda x: F.get(chinese.normalise(x), 0)
    text = F.col("k").cast("string")
    return k.select(
        "k", said(F.concat(text, F.lit("%"))).alias("percent"), said(F.concat(text, F.lit("/"), (F.col("k") + 1).cast("string"))).alias("fraction"),
        said(F.concat(F.lit("-"), text, F.lit("°C"))).alias("cold"), said(F.concat(text, F.lit("个"))).alias("many"),
    )


@query()
def normalise_documents(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text")).select("doc_id", chinese.normalise("text").alias("sentences"))


def _chain(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(f"SELECT p_partkey, {_chain('lower(p_name) || p_size || chr(109) || chr(109)', chinese.UNITS.items())} AS said FROM part")
def unit_replace(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", chinese.unit_names(F.concat(F.lower("p_name"), F.col("p_size").cast("string"), F.lit("mm"))).alias("said"))


_FULL = "".join(chr(0xFEE0 + c) for c in range(0x30, 0x7B) if chr(c).isalnum())


@query(f"SELECT row_id, translate(lyrics, '{_FULL}', '{''.join(chr(ord(c) - 0xFEE0) for c in _FULL)}') AS lyrics FROM songs")
def fullwidth_fold(t: Tables) -> DataFrame:
    return t.songs.select("row_id", chinese.half_width(F.col("lyrics")).alias("lyrics"))


@query(rf"""SELECT row_id, regexp_replace({_chain("replace(replace(lyrics, '嗯', '恩'), '呣', '母')", [(a, b) for a, b in chinese.PUNCTUATION.items() if a != chr(10)]).replace("'...'", "'...'")}, '[^一-龥!?…,.\-]+', '', 'g') AS marks FROM (SELECT row_id, replace(lyrics, chr(10), '.') AS lyrics FROM songs)""")
def punctuation_map(t: Tables) -> DataFrame:
    return t.songs.select("row_id", chinese.phoneme_punctuation(F.replace("lyrics", F.lit("\n"), F.lit("."))).alias("marks"))


@query(rf"SELECT doc_id, regexp_replace(translate({_chain('text', [('/', '每'), *((g, s) for gs, s in chinese.GREEK.items() for g in gs), ('⑩', '十')])}, '{chinese.CIRCLED[:9]}', '{chinese.DIGITS[1:]}'), '[-—《》【】<=>{{}}()（）#&@“”^_|\\]', '', 'g') AS said FROM documents")
def post_replace(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", chinese.said_signs(F.col("text")).alias("said"))


@query(f"SELECT word, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(word), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT))), lambda a, b: (a * 16 + b) % 1000) AS BIGINT) AS bucket FROM ({_WORDS.format(kind='note')})")
def hash_bucket(t: Tables) -> DataFrame:
    return words(t, "note").select("word", lexicons.hash_bucket(F.col("word"), 1000).alias("bucket"))


@query("SELECT row_id, CAST(i AS INTEGER) AS sample, idx || '_s' || i || '.flac' AS name FROM songs, range(2) r(i)")
def sample_fanout(t: Tables) -> DataFrame:
    rows = t.songs.select("row_id", "idx", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("sample"))
    return rows.select("row_id", "sample", F.concat("idx", F.lit("_s"), F.col("sample").cast("string"), F.lit(".flac")).alias("name"))


@query("""SELECT path, CASE WHEN len(string_split(path, ':')) = 2 THEN string_split(path, ':')[1] END AS zip_path, CASE WHEN len(string_split(path, ':')) = 2 THEN string_split(path, ':')[2] END AS file_path,
          regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS base FROM audio_meta""")
def zip_members(t: Tables) -> DataFrame:
    m = attributes.zip_member(F.col("path"))
    return t.audio_meta.select("path", m["zip_path"].alias("zip_path"), m["file_path"].alias("file_path"), attributes.base_name(F.col("path")).alias("base"))


@query("""SELECT s.row_id, m.duration, m.sample_rate, m.path IS NULL AS missing FROM songs s LEFT JOIN (SELECT path, max(duration) AS duration, max(sample_rate) AS sample_rate FROM audio_meta GROUP BY path) m ON s.prompt_wav = m.path""")
def prompt_lookup(t: Tables) -> DataFrame:
    """Songs with their prompt's metadata: a left lookup in a small table; repeated paths count once."""
    meta = t.audio_meta.groupBy("path").agg(F.max("duration").alias("duration"), F.max("sample_rate").alias("sample_rate"))
    songs = t.songs
    return songs.join(meta, songs.prompt_wav == meta.path, "left").select("row_id", "duration", "sample_rate", F.col("path").isNull().alias("missing"))


@query("""SELECT row_id, idx, lyrics IS NOT NULL AND prompt_wav IS NOT NULL AND idx IS NOT NULL AS complete FROM songs""")
def required_fields(t: Tables) -> DataFrame:
    return t.songs.select("row_id", "idx", (F.col("lyrics").isNotNull() & F.col("prompt_wav").isNotNull() & F.col("idx").isNotNull()).alias("complete"))


@query("SELECT doc_id, strip_accents(text) AS text FROM documents")
def strip_accents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", english.strip_accents("text").alias("text"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(translate(strip_accents(regexp_replace(text, '[0-9]', '', 'g')), ';:，；：。！？’"', ',,,,,.!?'''''), '[^ A-Za-z''.,?!\-]', '', 'g'), '(?i)i\.e\.', 'that is', 'g'), '(?i)e\.g\.', 'for example', 'g') AS text FROM documents""")
def normalise_english(t: Tables) -> DataFrame:
    """Without digits here, as SQL can't say numbers; english_numbers has them."""
    bare = t.documents.select("doc_id", F.regexp_replace("text", "[0-9]", "").alias("text"))
    return bare.select("doc_id", english.normalise_english(english.strip_accents("text")).alias("text"))


@query("""SELECT w.word, coalesce(CASE WHEN upper(w.word) = 'A' THEN 'EY1' END, n.phones, g.phones) AS phones FROM (""" + _WORDS.format(kind="lyric") + ") w LEFT JOIN (" + _entries("note", "N_") + ") n ON w.word = n.word LEFT JOIN (" + _entries("guide", "G_") + ") g ON w.word = g.word AND n.word IS NULL")
def tiered_lookup(t: Tables) -> DataFrame:
    """Pronunciations by tiers: spelled, the first lexicon, the second."""
    rows = words(t, "lyric").join(entries(t, "note", "N_").withColumnRenamed("phones", "n"), "word", "left").join(entries(t, "guide", "G_").withColumnRenamed("phones", "g"), "word", "left")
    return rows.select("word", F.coalesce(F.get(english.spelled(F.col("word")), 0), "n", "g").alias("phones"))


@query("SELECT row_id, json_extract_string(line, '$.idx') AS idx, json_extract_string(line, '$.lyrics') AS lyrics FROM raw_lines WHERE line IS NOT NULL AND json_valid(line) AND json_type(line) = 'OBJECT'")
def raw_records(t: Tables) -> DataFrame:
    """Records of raw lines by a declared schema; broken lines are left out."""
    schema = T.StructType([*RECORD.fields, T.StructField("_broken", T.StringType())])
    r = F.from_json("line", schema, {"columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false"})
    rows = t.raw_lines.where(F.col("line").rlike(r"^\s*\{")).select("row_id", r.alias("r")).where("r is not null and r._broken is null")
    return rows.select("row_id", "r.idx", "r.lyrics")


@query("SELECT row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lyrics, '[^一-龥]+', ',', 'g'), '^,', ''), '^(.),', '\\1'), ',$', '') AS han FROM songs")
def han_text(t: Tables) -> DataFrame:
    return t.songs.select("row_id", pinyin.han_only(F.col("lyrics")).alias("han"))


@query(f"SELECT word, CAST(tone AS INTEGER) AS tone, '<' || word || tone || '>' AS symbol FROM ({_WORDS.format(kind='review')}), range(1, 6) t(tone)")
def toned_vocabulary(t: Tables) -> DataFrame:
    return pinyin.toned(words(t, "review"), "word")


@query(f"SELECT word, [left(word, 1), substr(word, 2) || (1 + length(word) % 5)] AS phones FROM ({_WORDS.format(kind='review')}) WHERE length(word) > 2")
def syllable_phones(t: Tables) -> DataFrame:
    """Toned syllables with their two phones; the words of reviews play syllables, those of over two letters are in the table."""
    w = words(t, "review")
    parts = w.where(F.length("word") > 2).select(F.col("word").alias("pinyin"), F.left("word", F.lit(1)).alias("initial"), F.expr("substr(word, 2)").alias("final"))
    rows = w.select("word", F.concat("word", (1 + F.length("word") % 5).cast("string")).alias("toned"))
    return pinyin.phones(rows, parts, "toned").select("word", "phones")


@query("""SELECT event_id, CASE WHEN i <> '' THEN i || CASE f WHEN 'uei' THEN 'ui' WHEN 'iou' THEN 'iu' WHEN 'uen' THEN 'un' ELSE f END
    ELSE CASE f WHEN 'ing' THEN 'ying' WHEN 'i' THEN 'yi' WHEN 'in' THEN 'yin' WHEN 'u' THEN 'wu' ELSE CASE left(f, 1) WHEN 'v' THEN 'yu' || substr(f, 2) WHEN 'i' THEN 'y' || substr(f, 2) WHEN 'u' THEN 'w' || substr(f, 2) ELSE f END END END AS syllable
    FROM (SELECT event_id, ['', 'd', 'g', 'l'][1 + event_id % 4] AS i, ['uei', 'iou', 'uen', 'ing', 'i', 'in', 'u', 'van', 'ia', 'uo', 'e', 'ang'][1 + event_id % 12] AS f FROM events)""")
def syllable_spelling(t: Tables) -> DataFrame:
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("event_id") % len(xs)).cast("int"))
    i, f = pick(["", "d", "g", "l"]), pick(["uei", "iou", "uen", "ing", "i", "in", "u", "van", "ia", "uo", "e", "ang"])
    return t.events.select("event_id", pinyin.spelled(i, f).alias("syllable"))


@query(r"""SELECT doc_id, string_agg(CASE WHEN regexp_matches(run, '^[一-龥]') THEN '<zh>' || length(run) WHEN regexp_matches(run, '^[,.!?…\-]$') THEN run ELSE 'en:' || trim(run) END, '|' ORDER BY k) AS said
    FROM (SELECT doc_id, unnest(rs) AS run, generate_subscripts(rs, 1) AS k FROM (SELECT doc_id, regexp_extract_all(replace(text, chr(10), '.'), '[一-龥]+|[,.!?…\-]|[^一-龥,.!?…\-]+') AS rs FROM documents WHERE text IS NOT NULL)) GROUP BY doc_id""".replace("'en:' || trim(run)", "'en:' || length(run)"))
def mixed_dispatch(t: Tables) -> DataFrame:
    """Runs of mixed text, each said by the function of its script, in order."""
    rows = t.documents.where("text is not null").select("doc_id", F.posexplode(sequences.script_runs(F.col("text"))).alias("seq", "r")).select("doc_id", "seq", "r.script", "r.run")
    said = {"zh": F.array(F.concat(F.lit("<zh>"), F.length("run").cast("string"))), "en": F.array(F.concat(F.lit("en:"), F.length("run").cast("string")))}
    return pinyin.by_language(rows, "doc_id", "seq", "script", "run", said).select("doc_id", F.array_join("phones", "|").alias("said"))


_TAGGED = r"(SELECT row_id, string_split_regex(trim(lyrics), ' +') AS ts FROM songs WHERE lyrics IS NOT NULL)"


@query(rf"""SELECT row_id, CAST(k - 1 AS INTEGER) AS s, CAST(coalesce(lead(k) OVER (PARTITION BY row_id ORDER BY k) - 1, n) AS INTEGER) AS e FROM (
    SELECT row_id, n, unnest(list_filter(range(1, n + 1), lambda i: regexp_matches(ts[i], '^\[\w+\]$'))) AS k FROM (SELECT row_id, ts, len(ts) AS n FROM {_TAGGED}))""")
def section_bounds(t: Tables) -> DataFrame:
    tags = F.transform(F.split(F.trim("lyrics"), " +"), lambda x: x.rlike(r"^\[\w+\]$"))
    rows = t.songs.where("lyrics is not null").select("row_id", F.explode(sequences.boundaries(tags)).alias("b"))
    return rows.select("row_id", F.col("b.start").alias("s"), F.col("b.end").alias("e"))
