"""Queries of the sequence, selection and array operators, mostly over events and embeddings."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.operators import arrays, attributes, lyrics, selection, sequences
from strophe.plans.registry import Tables, query

#: Events as sequences: a structure per event type, a token and a tone per event.
_SEQ = "(SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, CAST(event_id % 17 AS INTEGER) AS token FROM events)"


def sequence(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).withColumn("token", (F.col("event_id") % 17).cast("int"))


def by_user(t: Tables, value) -> DataFrame:
    """Events of each user as an array in order; a user has a bounded number of events."""
    return t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", value.alias("v")))).alias("s")).select("user_id", F.col("s.v").alias("x"))


_ARR = "(SELECT user_id, list({v} ORDER BY ts, event_id) AS x FROM events GROUP BY user_id)"
_TONES = _ARR.format(v="CAST(1 + event_id % 5 AS INTEGER)")
_TOK = _ARR.format(v="CAST(event_id % 17 AS INTEGER)")


@query(f"SELECT user_id, list_transform(x, lambda t, i: CAST(CASE WHEN t = 3 AND x[i + 1] = 3 THEN 2 ELSE t END AS INTEGER)) AS tones FROM {_TONES}")
def tone3_lead(t: Tables) -> DataFrame:
    return by_user(t, (1 + F.col("event_id") % 5).cast("int")).select("user_id", sequences.third_tones(F.col("x")).alias("tones"))


_MAP = "CASE event_type WHEN {a} THEN 'verse' WHEN {b} THEN 'chorus' ELSE 'inst' END"


@query("""WITH s AS (SELECT user_id, event_id, value AS start_time, value + 1 AS end_time, CASE event_id % 5 WHEN 0 THEN 'verse' WHEN 1 THEN 'verse' WHEN 2 THEN 'chorus' ELSE 'inst' END AS structure, event_type AS lyric, ts FROM events),
    a AS (SELECT *, row_number() OVER w AS n, CASE WHEN lag(structure) OVER w = structure THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM a),
    c AS (SELECT *, lead(end_time) OVER (PARTITION BY user_id, run ORDER BY n) AS nxt FROM b)
    SELECT user_id, run, start_time, coalesce(nxt, end_time) AS end_time, structure, lyric FROM c WHERE structure <> 'inst'
    UNION ALL SELECT user_id, run, arg_min(start_time, n), arg_max(end_time, n), structure, arg_min(lyric, n) FROM b WHERE structure = 'inst' GROUP BY user_id, run, structure""")
def structure_merge(t: Tables) -> DataFrame:
    s = F.when(F.col("event_id") % 5 < 2, "verse").when(F.col("event_id") % 5 == 2, "chorus").otherwise("inst")
    rows = t.events.select("user_id", "ts", "event_id", F.col("value").alias("start_time"), (F.col("value") + 1).alias("end_time"), s.alias("structure"), F.col("event_type").alias("lyric"))
    return sequences.merge_runs(rows, "user_id", ["ts", "event_id"], "start_time", "end_time", "structure", "lyric")


@query(f"SELECT user_id, pos // 8 AS block, list(token ORDER BY pos) AS tokens FROM {_SEQ} GROUP BY 1, 2")
def block_tumbling(t: Tables) -> DataFrame:
    rows = by_user(t, (F.col("event_id") % 17).cast("int"))
    return rows.select("user_id", F.posexplode(sequences.blocks(F.col("x"), 8)).alias("block", "tokens"))


@query(f"SELECT user_id, block, coalesce(lag(tokens) OVER (PARTITION BY user_id ORDER BY block), [0, 0, 0, 0, 0, 0, 0, 0]) AS previous FROM (SELECT user_id, pos // 8 AS block, list(token ORDER BY pos) AS tokens FROM {_SEQ} GROUP BY 1, 2)")
def block_previous(t: Tables) -> DataFrame:
    zero = F.array_repeat(F.lit(0), 8)
    rows = by_user(t, (F.col("event_id") % 17).cast("int")).select("user_id", sequences.previous_blocks(sequences.blocks(F.col("x"), 8), zero).alias("b"))
    return rows.select("user_id", F.posexplode("b").alias("block", "previous"))


@query(f"SELECT user_id, list_transform(range(0, 40), lambda i: CASE WHEN i < len(x) THEN x[i + 1] WHEN i = len(x) THEN 17 ELSE 18 END) AS target FROM {_TOK}")
def block_targets(t: Tables) -> DataFrame:
    rows = by_user(t, (F.col("event_id") % 17).cast("int"))
    return rows.select("user_id", sequences.targets(F.col("x"), 40, F.lit(17), F.lit(18)).alias("target"))


@query(f"SELECT user_id, list(v ORDER BY pos, k) AS mixed FROM (SELECT user_id, pos, 0 AS k, token AS v FROM {_SEQ} UNION ALL SELECT user_id, max(pos), 1, -1 - CAST(pos // 4 AS INTEGER) FROM {_SEQ} GROUP BY user_id, pos // 4) GROUP BY user_id")
def block_interleave(t: Tables) -> DataFrame:
    rows = by_user(t, (F.col("event_id") % 17).cast("int"))
    latents = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / F.lit(4)).cast("int")), lambda i: -1 - i)
    return rows.select("user_id", sequences.interleave(F.col("x"), latents, 4).alias("mixed"))


@query("""SELECT n, p, CAST(max(k) AS INTEGER) AS owner FROM (SELECT n, k, unnest(range(a, z)) AS p FROM (
        SELECT n, k, s + CASE WHEN k > 0 THEN 8 ELSE 0 END AS a, s + 64 - CASE WHEN k < m THEN 8 ELSE 0 END AS z FROM (
        SELECT n, k, CASE WHEN k * 48 + 64 <= n THEN k * 48 ELSE n - 64 END AS s, max(k) OVER (PARTITION BY n) AS m FROM (
        SELECT n, unnest(range(0, (n - 64) // 48 + 1 + CASE WHEN (n - 64) // 48 * 48 + 64 < n THEN 1 ELSE 0 END)) AS k FROM (
        SELECT DISTINCT 64 + p_partkey % 300 AS n FROM part))))) GROUP BY n, p""")
def chunk_owner(t: Tables) -> DataFrame:
    n = t.part.select((64 + F.col("p_partkey") % 300).cast("int").alias("n")).distinct()
    rows = n.select("n", F.posexplode(sequences.chunk_owner(F.col("n"), 64, 16)).alias("p", "owner"))
    return rows.select(F.col("n").cast("bigint").alias("n"), F.col("p").cast("bigint").alias("p"), "owner")


@query(f"SELECT event_id, CAST(len(list_distinct(pool)) AS INTEGER) AS distinct_before, coalesce(list_contains(pool, token), false) AS repeated, round(CASE WHEN list_contains(pool, token) AND token <> 16 THEN value / 1.1 ELSE value END, 6) AS penalised FROM (SELECT *, coalesce(list(token) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), []) AS pool FROM {_SEQ})")
def repetition_window(t: Tables) -> DataFrame:
    rows = selection.repetition_window(sequence(t), "user_id", "pos", "token", 50)
    return rows.select(
        "event_id", F.size("pool").alias("distinct_before"), F.array_contains("pool", F.col("token")).alias("repeated"),
        F.round(selection.penalised(F.col("value"), F.col("token"), F.col("pool"), 16), 6).alias("penalised"),
    )


_P = "(SELECT user_id, event_id, value, exp(value / 10 - max(value / 10) OVER (PARTITION BY user_id)) / sum(exp(value / 10)) OVER (PARTITION BY user_id) * exp(max(value / 10) OVER (PARTITION BY user_id)) AS p FROM events)"


def probabilities(t: Tables) -> DataFrame:
    return selection.softmax(t.events.select("user_id", "event_id", (F.col("value") / 10).alias("logit")), ["user_id"], "logit")


@query("SELECT user_id, event_id, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS p FROM (SELECT user_id, event_id, exp(value / 10 - max(value / 10) OVER (PARTITION BY user_id)) AS e FROM events WHERE value IS NOT NULL)")
def softmax_norm(t: Tables) -> DataFrame:
    return probabilities(t).select("user_id", "event_id", F.round("p", 6).alias("p"))


@query("SELECT user_id, event_id, round(v / sum(v) OVER (PARTITION BY user_id), 6) AS p FROM (SELECT user_id, event_id, round(value) AS v, rank() OVER (PARTITION BY user_id ORDER BY round(value) DESC) AS r FROM events WHERE value > 0) WHERE r <= 3")
def topk_ties(t: Tables) -> DataFrame:
    rows = t.events.where("value > 0").select("user_id", "event_id", F.round("value").alias("p"))
    return selection.top_k(rows, ["user_id"], "p", 3).select("user_id", "event_id", F.round("p", 6).alias("p"))


@query("""SELECT user_id, event_id, round(p / sum(p) OVER (PARTITION BY user_id), 6) AS p FROM (SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_id ROWS UNBOUNDED PRECEDING) - p AS c FROM (
    SELECT user_id, event_id, value / sum(value) OVER (PARTITION BY user_id) AS p FROM events WHERE value > 0)) WHERE c <= 0.5""")
def topp_nucleus(t: Tables) -> DataFrame:
    p = F.col("value") / F.sum("value").over(Window.partitionBy("user_id"))
    rows = t.events.where("value > 0").select("user_id", "event_id", p.alias("p"))
    return selection.top_p(rows, ["user_id"], "p", 0.5, "event_id").select("user_id", "event_id", F.round("p", 6).alias("p"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE value IS NOT NULL) WHERE r = 1")
def greedy_argmax(t: Tables) -> DataFrame:
    return selection.greedy(t.events, ["user_id"], "value", "event_id")


@query("""SELECT user_id, min(event_id) AS event_id FROM (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY user_id) AS c FROM events WHERE value > 0)
    WHERE c > (user_id % 100) / 100.0 GROUP BY user_id""")
def weighted_draw(t: Tables) -> DataFrame:
    """A draw with a supplied uniform number a user."""
    rows = t.events.where("value > 0").withColumn("u", (F.col("user_id") % 100) / 100)
    return selection.draw(rows, ["user_id"], "value", "event_id", "u")


_E = "(SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x, label FROM embeddings)"
_R = "list_transform({x}, lambda e: round(e, 5) + 0.0)"


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def rounded(x) -> "F.Column":
    return F.transform(x, lambda e: F.round(e, 5) + 0.0)


for _name, _exact, _at in (("stretch_nearest_exact", True, "floor((i + 0.5) * 64 / 100)"), ("stretch_nearest", False, "floor(i * 64 / 100)")):

    @query(f"SELECT vec_id, list_transform(range(0, 100), lambda i: x[CAST({_at} AS INTEGER) + 1]) AS x FROM {_E}", name=_name)
    def _stretch(t: Tables, exact: bool = _exact) -> DataFrame:
        return vectors(t).select("vec_id", sequences.stretch(F.col("x"), F.lit(100), exact).alias("x"))


@query(f"SELECT vec_id, list_transform(range(0, 12), lambda i: CAST(i < vec_id % 12 AS INTEGER)) AS mask, list_transform(range(0, 70), lambda i: coalesce(x[i + 1], -1.0)) AS padded FROM {_E}")
def mask_and_pad(t: Tables) -> DataFrame:
    return vectors(t).select("vec_id", sequences.mask(F.col("vec_id") % 12, 12).alias("mask"), sequences.pad(F.col("x"), 70, F.lit(-1.0)).alias("padded"))


@query(f"SELECT vec_id, CAST(len(y) AS INTEGER) AS length, list_transform(range(0, max(len(y)) OVER (PARTITION BY label)), lambda i: coalesce(y[i + 1], 0.0)) AS y FROM (SELECT vec_id, label, x[1:1 + vec_id % 20] AS y FROM {_E})")
def pad_batch(t: Tables) -> DataFrame:
    rows = vectors(t).select("vec_id", "label", F.slice("x", F.lit(1), (1 + F.col("vec_id") % 20).cast("int")).alias("y"))
    return attributes.padded_batch(rows, "label", "y").select("vec_id", "length", "y")


@query("SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS texts, CAST(max(length(o_orderpriority)) AS INTEGER) AS longest FROM orders GROUP BY o_custkey")
def collate_text(t: Tables) -> DataFrame:
    return attributes.collated(t.orders, "o_custkey", "o_orderkey", "o_orderpriority").select("o_custkey", F.col("values").alias("texts"), "longest")


@query(f"SELECT vec_id, {_R.format(x='list_transform(range(1, 33), lambda i: (x[i] + x[i + 32]) / 2)')} AS mixed FROM {_E}")
def downmix_mean(t: Tables) -> DataFrame:
    x = F.col("x")
    return vectors(t).select("vec_id", rounded(F.zip_with(F.slice(x, 1, 32), F.slice(x, 33, 32), lambda a, b: (a + b) / 2)).alias("mixed"))


_M = "list_sum(x) / len(x)"


@query(f"SELECT vec_id, {_R.format(x='list_transform(x, lambda e: (e - m) / sqrt(v + 1e-5))')} AS normed FROM (SELECT vec_id, x, m, list_sum(list_transform(x, lambda e: (e - m) * (e - m))) / len(x) AS v FROM (SELECT vec_id, x, {_M} AS m FROM {_E}))")
def layer_norm(t: Tables) -> DataFrame:
    return vectors(t).select("vec_id", rounded(arrays.layer_norm(F.col("x"))).alias("normed"))


@query(f"SELECT vec_id, {_R.format(x='list_transform(x, lambda e: e / greatest(n, 1e-12))')} AS normed FROM (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS n FROM {_E})")
def l2_norm(t: Tables) -> DataFrame:
    return vectors(t).select("vec_id", rounded(arrays.unit_norm(F.col("x"))).alias("normed"))


@query(f"SELECT vec_id, {_R.format(x='list_transform(range(1, 33), lambda i: x[i] + (x[i + 32] - x[i]) * 1.5)')} AS blend FROM {_E}")
def cfg_blend(t: Tables) -> DataFrame:
    return vectors(t).select("vec_id", rounded(selection.guided(F.slice("x", 1, 32), F.slice("x", 33, 32), 1.5)).alias("blend"))


@query(f"""SELECT vec_id, {_R.format(x='list_transform(range(1, 33), lambda i: cos(t * pi() / 2) * x[i] + sin(t * pi() / 2) * x[i + 32])')} AS noised, {_R.format(x='list_transform(range(1, 33), lambda i: cos(t * pi() / 2) * x[i + 32] - sin(t * pi() / 2) * x[i])')} AS velocity,
    {_R.format(x='list_transform(range(1, 33), lambda i: x[i + 32] - x[i])')} AS flow FROM (SELECT *, (vec_id % 100) / 100.0 AS t FROM {_E})""")
def noising(t: Tables) -> DataFrame:
    a, v, f = arrays.noised(F.slice("x", 1, 32), F.slice("x", 33, 32), (F.col("vec_id") % 100) / 100)
    return vectors(t).select("vec_id", rounded(a).alias("noised"), rounded(v).alias("velocity"), rounded(f).alias("flow"))


@query(f"SELECT vec_id, {_R.format(x='list_transform(x, lambda e: e + pow(sin(e * 1.5), 2) / (0.5 + 1e-9))')} AS y FROM {_E}")
def snake_beta(t: Tables) -> DataFrame:
    return vectors(t).select("vec_id", rounded(arrays.snake(F.col("x"), 1.5, 0.5)).alias("y"))


@query(f"SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN i <= 32 THEN -x[i + 32] ELSE x[i - 32] END) AS y FROM {_E}")
def rotate_half(t: Tables) -> DataFrame:
    return vectors(t).select("vec_id", arrays.rotate_half(F.col("x")).alias("y"))


@query(f"""SELECT vec_id, {_R.format(x='list_transform(range(1, 65), lambda i: CASE WHEN i > 32 THEN x[i] WHEN i <= 16 THEN x[i] * cos(p * pow(10000.0, -((i - 1) * 2.0 / 32))) - x[i + 16] * sin(p * pow(10000.0, -((i - 1) * 2.0 / 32))) ELSE x[i] * cos(p * pow(10000.0, -((i - 17) * 2.0 / 32))) + x[i - 16] * sin(p * pow(10000.0, -((i - 17) * 2.0 / 32))) END)')} AS y FROM (SELECT *, vec_id % 50 AS p FROM {_E})""")
def rotary(t: Tables) -> DataFrame:
    return vectors(t).select("vec_id", rounded(arrays.rotary(F.col("x"), F.col("vec_id") % 50, 32)).alias("y"))


@query(f"SELECT DISTINCT p, {_R.format(x='list_transform(range(0, 16), lambda i: CASE WHEN i < 8 THEN cos(p / pow(10000.0, i / 7.0)) ELSE sin(p / pow(10000.0, (i - 8) / 7.0)) END)')} AS y, {_R.format(x='list_transform(range(0, 16), lambda i: CASE WHEN i < 8 THEN 0.5 * sin(p * pow(10000.0, -i / 8.0)) ELSE 0.5 * cos(p * pow(10000.0, -(i - 8) / 8.0)) END)')} AS scaled FROM (SELECT vec_id % 200 AS p FROM embeddings)")
def sinusoid(t: Tables) -> DataFrame:
    p = t.embeddings.select((F.col("vec_id") % 200).alias("p")).distinct()
    return p.select("p", rounded(arrays.sinusoid(F.col("p"), 16)).alias("y"), rounded(arrays.scaled_sinusoid(F.col("p"), 16, 0.5)).alias("scaled"))


@query(f"SELECT vec_id, {_R.format(x='[cos(2 * pi() * a * 0.5), cos(2 * pi() * a * 2.0), sin(2 * pi() * a * 0.5), sin(2 * pi() * a * 2.0)]')} AS y, list_transform(x, lambda e: CAST(e <= 0.5 AS INTEGER)) AS mask FROM (SELECT vec_id, x, x[1] AS a FROM {_E})")
def fourier_and_mask(t: Tables) -> DataFrame:
    return vectors(t).select("vec_id", rounded(arrays.fourier(F.get("x", 0), [0.5, 2.0])).alias("y"), arrays.shrinking_mask(F.col("x"), 1, 4).alias("mask"))


@query(f"SELECT vec_id, {_R.format(x='list_transform(x, lambda e: e * pow(1 + 0.25, 4))')} AS y FROM {_E}".replace("pow(1 + 0.25, 4)", "pow(1 - 0.25, 4)"))
def euler_steps(t: Tables) -> DataFrame:
    """Four steps of dx/dt = x from time 1 to 0."""
    return vectors(t).select("vec_id", rounded(arrays.euler(F.col("x"), 4, 1.0, lambda e, _: e)).alias("y"))


@query(f"SELECT vec_id, {_R.format(x='list_transform(range(33, 65), lambda i: ln(1 + exp(x[i])) + 1e-4)')} AS deviation, round(list_sum(list_transform(range(1, 33), lambda i: x[i] * x[i] + pow(ln(1 + exp(x[i + 32])) + 1e-4, 2) - ln(pow(ln(1 + exp(x[i + 32])) + 1e-4, 2)) - 1)), 4) AS kl FROM {_E}")
def gaussian_bottleneck(t: Tables) -> DataFrame:
    m, s = arrays.gaussian(F.col("x"))
    return vectors(t).select("vec_id", m.alias("m"), s.alias("s")).select("vec_id", rounded(F.col("s")).alias("deviation"), F.round(arrays.kl(F.col("m"), F.col("s")), 4).alias("kl"))


@query("SELECT a.p AS query, b.p AS key FROM (SELECT DISTINCT vec_id % 40 AS p FROM embeddings) a JOIN (SELECT DISTINCT vec_id % 40 AS p FROM embeddings) b ON b.p <= a.p")
def causal_pairs(t: Tables) -> DataFrame:
    """A causal mask over positions, a fixed small set: key at or before query."""
    a = t.embeddings.select((F.col("vec_id") % 40).alias("query")).distinct()
    return a.select("query", F.explode(F.sequence(F.lit(0), F.col("query"))).alias("key"))


_BOOK = "(SELECT label, list_transform(range(1, 9), lambda i: 0.0 + label * 0.1 + i * 0.01) AS v FROM (SELECT DISTINCT label FROM embeddings))"


@query(f"SELECT vec_id, CAST(arg_min(label, round(d, 9) * 1000 + label * 1e-7) AS INTEGER) AS code FROM (SELECT vec_id, label, list_sum(list_transform(range(1, 9), lambda i: (x[i] - v[i]) * (x[i] - v[i]))) AS d FROM (SELECT e.vec_id, e.x, b.label, b.v FROM {_E} e, {_BOOK} b)) GROUP BY vec_id")
def rvq_nearest(t: Tables) -> DataFrame:
    book = t.embeddings.select(F.col("label").alias("code")).distinct().select("code", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.col("code") * 0.1 + i * 0.01).alias("vector"))
    rows = vectors(t).select("vec_id", F.slice("x", 1, 8).alias("y"))
    return attributes.nearest_code(rows, book, "y").select("vec_id", "code")


@query("""SELECT event_id, k, v FROM (SELECT event_id, 'text.kind' AS k, event_type AS v FROM events UNION ALL SELECT event_id, 'wav.props', props FROM events)""")
def attributes_flatten(t: Tables) -> DataFrame:
    flat = attributes.flatten({"text": F.create_map(F.lit("kind"), F.col("event_type")), "wav": F.create_map(F.lit("props"), F.col("props"))})
    return t.events.select("event_id", F.explode(flat).alias("k", "v"))


@query("SELECT path, CAST(round_even(coalesce(duration, 0) * sample_rate * 25 / 48000, 0) AS BIGINT) AS frames FROM audio_meta")
def rescaled_lengths(t: Tables) -> DataFrame:
    n = F.coalesce(F.col("duration"), F.lit(0.0)) * F.col("sample_rate")
    return t.audio_meta.select("path", arrays.resampled_length(n, F.lit(48000), F.lit(25)).alias("frames"))


@query("""SELECT user_id, pos, CAST(trunc((value + 1) / 0.2) - trunc(value / 0.2) AS INTEGER) - CASE WHEN lead(pos) OVER (PARTITION BY user_id ORDER BY pos) IS NULL THEN 0 ELSE 1 END AS frames FROM """ + _SEQ)
def section_frames(t: Tables) -> DataFrame:
    rows = sequence(t).select("user_id", "pos", F.col("value").alias("st"), (F.col("value") + 1).alias("et"))
    return lyrics.durations(rows, "user_id", "pos", "st", "et", 0.2).select("user_id", "pos", "frames")


@query("SELECT user_id, event_id, CAST(sum(len) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM (SELECT *, length(event_type) AS len FROM events)")
def cumulative_lengths(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("user_id", "event_id", F.sum(F.length("event_type").cast("bigint")).over(w).alias("upto"))


@query(f"SELECT vec_id, list_concat(x[33:36], list_transform(range(1, 33), lambda i: x[i] + x[i + 32] + x[33 + CAST(floor((i - 1) * 8 / 32) AS INTEGER)])) AS y FROM {_E}".replace("x[33 + CAST", "x[33 + CAST"))
def fuse_conditions(t: Tables) -> DataFrame:
    """Conditions fused into a sequence: one added, one stretched and added, one put before."""
    second = F.slice("x", 33, 32)
    y = attributes.fuse(F.slice("x", 1, 32), [("sum", second), ("input_interpolate", F.slice("x", 33, 8)), ("prepend", F.slice("x", 33, 4))])
    return vectors(t).select("vec_id", y.alias("y"))


_CENTRES = f"(SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {_E}) GROUP BY label, i) GROUP BY label)"


@query(f"SELECT a.label AS a, b.label AS b, round(exp(-list_sum(list_transform(range(1, 65), lambda i: (a.c[i] - b.c[i]) * (a.c[i] - b.c[i]))) / 64 / 64), 6) AS kernel FROM {_CENTRES} a, {_CENTRES} b WHERE a.label <= b.label")
def mean_kernel(t: Tables) -> DataFrame:
    """The kernel of the discrepancy between the mean vectors of labels, a fixed small set."""
    cells = vectors(t).select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    c = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select("label", F.col("s.m").alias("c"))
    a, b = c.select(F.col("label").alias("a"), F.col("c").alias("x")), c.select(F.col("label").alias("b"), F.col("c").alias("y"))
    return a.join(F.broadcast(b), F.col("a") <= F.col("b")).select("a", "b", F.round(F.exp(-arrays.distance2(F.col("x"), F.col("y")) / 64 / 64), 6).alias("kernel"))


@query(f"SELECT event_id, CAST(coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM (SELECT *, length(event_type) AS n FROM {_SEQ})")
def running_offset(t: Tables) -> DataFrame:
    """Where each event's tokens begin among all of its user."""
    w = Window.partitionBy("user_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return sequence(t).select("event_id", F.coalesce(F.sum(F.length("event_type").cast("bigint")).over(w), F.lit(0)).alias("first"))


@query(f"""SELECT vec_id, {_R.format(x='list_transform(x, lambda e: pow(0.75, 4) * e)')} AS tempered, {_R.format(x='list_transform(range(1, 33), lambda i: x[i] * 0.75 + x[i + 32] * 0.25)')} AS varied,
    {_R.format(x='list_transform(range(1, 33), lambda i: x[i] * x[i + 32] / (1 + exp(-x[i + 32])))')} AS gated, {_R.format(x='list_transform(x, lambda e: tanh(e))')} AS clipped FROM {_E}""")
def sampler_steps(t: Tables) -> DataFrame:
    """Tempered Euler steps along x from zeros, jumping at 0.75; a variation, a gate, soft clipping."""
    x, a, b = F.col("x"), F.slice("x", 1, 32), F.slice("x", 33, 32)
    tempered = arrays.euler_tempered(x, 4, 0.75, lambda e, _: e)
    return vectors(t).select("vec_id", rounded(tempered).alias("tempered"), rounded(arrays.variation(a, b, 0.25)).alias("varied"), rounded(arrays.gated(x)).alias("gated"), rounded(arrays.clipped(x)).alias("clipped"))


@query("""SELECT DISTINCT p, [round((p // 10) * pow(10000.0, -0.0), 5) + 0.0, round((p // 10) * pow(10000.0, -0.5), 5) + 0.0, round((p // 10) * pow(10000.0, -0.0), 5) + 0.0, round((p // 10) * pow(10000.0, -0.5), 5) + 0.0,
    round((p % 10) * pow(10000.0, -0.0), 5) + 0.0, round((p % 10) * pow(10000.0, -0.5), 5) + 0.0, round((p % 10) * pow(10000.0, -0.0), 5) + 0.0, round((p % 10) * pow(10000.0, -0.5), 5) + 0.0] AS y FROM (SELECT vec_id % 200 AS p FROM embeddings)""")
def rotary_grid(t: Tables) -> DataFrame:
    return t.embeddings.select((F.col("vec_id") % 200).alias("p")).distinct().select("p", rounded(arrays.rotary_2d(F.col("p"), 10, 8)).alias("y"))


@query(f"SELECT vec_id, {_R.format(x='list_transform(x, lambda e: 2 * e)')} AS y FROM {_E}")
def velocity_steps(t: Tables) -> DataFrame:
    return vectors(t).select("vec_id", rounded(arrays.velocity_sampler(F.col("x"), 2, lambda e, _: -e)).alias("y"))


@query(f"SELECT user_id, pos, round(sum(e * value) / sum(e), 6) AS out FROM (SELECT q.user_id, q.pos, k.value, exp((q.token * k.token + 1.0) / 100 / sqrt(2)) AS e FROM {_SEQ} q JOIN {_SEQ} k ON q.user_id = k.user_id AND k.pos <= q.pos AND k.pos >= q.pos - 5) GROUP BY 1, 2")
def band_attention(t: Tables) -> DataFrame:
    """Attention over the five events before each, a band join within a user."""
    x = F.array(F.col("token") / 10, F.lit(0.1))
    rows = sequence(t).select("user_id", "pos", x.alias("x"), "value")
    return attributes.attended(rows, "user_id", "pos", "x", "x", "value", 5).select("user_id", "pos", F.round("out", 6).alias("out"))


@query(f"SELECT label, list(list_transform(range(0, m), lambda i: coalesce(y[i + 1], 0.0)) ORDER BY vec_id) AS waves, list(CAST(len(y) AS INTEGER) ORDER BY vec_id) AS lengths FROM (SELECT *, max(len(y)) OVER (PARTITION BY label) AS m FROM (SELECT vec_id, label, x[1:1 + vec_id % 6] AS y FROM {_E})) GROUP BY label")
def collate_waves(t: Tables) -> DataFrame:
    rows = vectors(t).select("vec_id", "label", F.slice("x", F.lit(1), (1 + F.col("vec_id") % 6).cast("int")).alias("y"), F.lit(1).alias("channels"))
    return attributes.collated_waves(rows, "label", "vec_id", "y", "channels")


@query("SELECT vec_id, CAST(vec_id % 12 AS BIGINT) AS n, list_transform(range(0, 12), lambda i: CAST(greatest(i - vec_id % 5, 0) AS INTEGER)) AS positions FROM embeddings")
def masks_and_positions(t: Tables) -> DataFrame:
    n = (F.col("vec_id") % 12).cast("int")
    return t.embeddings.select("vec_id", attributes.masked_length(sequences.mask(n, 12)).alias("n"), sequences.positions(F.lit(12), (F.col("vec_id") % 5).cast("int")).alias("positions"))


@query("SELECT event_id, q AS head, q // 4 AS kv FROM events, range(8) r(q)")
def repeated_heads(t: Tables) -> DataFrame:
    """Query heads with the key/value head they share, four each."""
    return t.events.select("event_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))).alias("head")).withColumn("kv", F.floor(F.col("head") / 4))
