"""Attributes and conditions of records: nested maps, null conditions, fusion, metadata."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flatten(maps: dict[str, Column]) -> Column:
    """Maps by kind as one with keys kind.name; null maps count as empty."""
    empty = F.create_map().cast("map<string,string>")

    def named(kind: str, m: Column) -> Column:
        return F.transform_keys(F.coalesce(m, empty), lambda k, _: F.concat(F.lit(kind + "."), k))

    return F.map_concat(*(named(kind, m) for kind, m in maps.items()))


def unflatten(flat: Column, kind: str) -> Column:
    """The entries of one kind, without its name."""
    return F.transform_keys(F.map_filter(flat, lambda k, _: k.startswith(kind + ".")), lambda k, _: F.substring(k, F.lit(len(kind) + 2), F.length(k)))


def without(attributes: Column, name: str) -> Column:
    """A map with one of its values nulled; a name it lacks is an error."""
    return F.when(
        F.map_contains_key(attributes, name), F.transform_values(attributes, lambda k, v: F.when(k != name, v))
    ).otherwise(F.raise_error(F.concat(F.lit(f"no attribute {name} among "), F.array_join(F.map_keys(attributes), ","))).cast("map<string,string>"))


def null_wave(sample_rate: int = 48000) -> Column:
    """The condition of a missing waveform: one step of zero with length 0."""
    return F.struct(F.array(F.lit(0.0)).alias("wav"), F.lit(0).cast("bigint").alias("length"), F.lit(sample_rate).alias("sample_rate"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("double").alias("seek_time"))


def dropped(key: Column, p: float, salt: str = "") -> Column:
    """Whether an attribute of the record is dropped, with probability p, always alike for a key."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1_000_000)) < int(p * 1_000_000)


def collated(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, values, longest): the values of a group in order, and the length of the longest. A group is a batch, of bounded size."""
    kept = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_s"), F.max(F.length(value)).alias("longest"))
    return kept.select(group, F.col("_s")[value].alias("values"), "longest")


def padded_batch(df: DataFrame, group: str, x: str) -> DataFrame:
    """df with x filled with zeros to the longest of its group, and its own length. Only the greatest lengths are aggregated (map-side), a row a group."""
    widest = df.groupBy(F.col(group).alias("_g")).agg(F.max(F.size(x)).alias("_w"))
    rows = df.join(widest, F.col(group).eqNullSafe(F.col("_g")))
    return rows.withColumn("length", F.size(x)).withColumn(x, F.concat(x, F.array_repeat(F.lit(0.0), F.col("_w") - F.size(x)))).drop("_g", "_w")


def fuse(x: Column, conditions: list[tuple[str, Column]]) -> Column:
    """x with conditions fused in: sum adds, input_interpolate stretches and adds, prepend goes before (the last first), cross goes behind."""
    from strophe.operators.sequences import stretch

    for how, c in conditions:
        if how == "sum":
            x = F.zip_with(x, c, lambda a, b: a + b)
        elif how == "input_interpolate":
            x = F.zip_with(x, stretch(c, F.size(x), exact=False), lambda a, b: a + b)
        elif how == "prepend":
            x = F.concat(c, x)
        elif how == "cross":
            x = F.concat(x, c)
        else:
            raise ValueError(f"unknown way to fuse: {how}")
    return x


def zip_member(path: Column) -> Column:
    """(zip_path, file_path) of an address zip:inner with exactly one colon, else null."""
    p = F.split(path, ":")
    return F.when(F.size(p) == 2, F.struct(F.get(p, 0).alias("zip_path"), F.get(p, 1).alias("file_path")))


def base_name(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


#: Most codes of a codebook; it is sent to every task.
MOST_CODES = 100_000


def nearest_code(df: DataFrame, codebook: DataFrame, x: str, code: str = "code", vector: str = "vector") -> DataFrame:
    """df with code, the nearest vector of a codebook (of equal ones the smallest code), and residual. The codebook is broadcast as one array; over MOST_CODES codes are an error."""
    from strophe.operators.arrays import distance2

    if codebook.count() > MOST_CODES:
        raise ValueError(f"a codebook of over {MOST_CODES} codes")
    book = codebook.agg(F.array_sort(F.collect_list(F.struct(F.col(code).alias("code"), F.col(vector).alias("vector")))).alias("_book"))
    near = F.array_min(F.transform("_book", lambda c: F.struct(distance2(F.col(x), c["vector"]).alias("d"), c["code"].alias("code"), c["vector"].alias("vector"))))
    return df.join(F.broadcast(book)).withColumn("_n", near).withColumn("code", F.col("_n.code")).withColumn("residual", F.zip_with(x, "_n.vector", lambda a, b: a - b)).drop("_n", "_book")


def residual_codes(df: DataFrame, codebooks: list[DataFrame], x: str) -> DataFrame:
    """df with codes, the nearest code of each codebook for what the ones before left over, and quantised, the sum of the chosen vectors."""
    out, left = df.withColumn("codes", F.array().cast("array<int>")).withColumn("_x", F.col(x)), "_x"
    for book in codebooks:
        out = nearest_code(out, book, left).withColumn("codes", F.concat("codes", F.array(F.col("code").cast("int")))).withColumn(left, F.col("residual")).drop("code", "residual")
    return out.withColumn("quantised", F.zip_with(x, "_x", lambda a, b: a - b)).drop("_x")


def collated_waves(df: DataFrame, group: str, order: str, wave: str, channels: str) -> DataFrame:
    """(group, waves, lengths): the waves of a batch in order, filled with zeros to the longest, and their lengths; batches of mixed channel counts are an error."""
    s = F.array_sort(F.collect_list(F.struct(order, F.col(wave).alias("w"))))
    kept = df.groupBy(group).agg(s.alias("_s"), F.max(F.size(wave)).alias("_m"), F.count_distinct(channels).alias("_c"))
    fill = lambda w: F.concat(w, F.array_repeat(F.lit(0.0), F.col("_m") - F.size(w)))
    waves = F.when(F.col("_c") <= 1, F.transform("_s", lambda x: fill(x["w"]))).otherwise(F.raise_error(F.lit("mixed channel counts in a batch")).cast("array<array<double>>"))
    return kept.select(group, waves.alias("waves"), F.transform("_s", lambda x: F.size(x["w"])).alias("lengths"))


def masked_length(mask: Column) -> Column:
    """How many ones a mask begins with; ones behind a zero are an error."""
    first = F.coalesce(F.nullif(F.array_position(mask, 0), F.lit(0)) - 1, F.size(mask).cast("bigint"))
    ones = F.aggregate(mask, F.lit(0).cast("bigint"), lambda a, m: a + m)
    return F.when(first == ones, ones).otherwise(F.raise_error(F.lit("a mask with holes")).cast("bigint"))


def by_kind(names: dict[str, str], conditions: Column, how: str) -> Column:
    """The conditions (a map by name) that are fused in one way; names says how each is, and an unknown name is an error."""
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    checked = F.map_filter(conditions, lambda k, _: F.coalesce(known[k], F.raise_error(F.concat(F.lit("unknown condition "), k)).cast("string")) == how)
    return checked


def _attention(q: DataFrame, k: DataFrame, on: list[str], near: Column, group: str, pos: str) -> DataFrame:
    from strophe.operators.arrays import total

    dot = total(F.zip_with("_x", "_y", lambda a, b: a * b)) / F.sqrt(F.size("_x"))
    pairs = q.join(k, on).where(near).withColumn("_e", F.exp(dot))
    return pairs.groupBy(group, F.col("_q").alias(pos)).agg((F.sum(F.col("_e") * F.col("_v")) / F.sum("_e")).alias("out"))


def attended(df: DataFrame, group: str, pos: str, query: str, key: str, value: str, reach: int | None = None) -> DataFrame:
    """(group, pos, out): scaled-dot attention of each row over the rows of its group at or before it, at most reach back.

    With a reach, rows meet by stretches of so many positions (their own and the
    one before), so a long group costs its length times the reach; without one,
    all pairs of a group are the result's own definition.
    """
    q = df.select(group, F.col(pos).alias("_q"), F.col(query).alias("_x"))
    k = df.select(group, F.col(pos).alias("_k"), F.col(key).alias("_y"), F.col(value).alias("_v"))
    near = F.col("_k") <= F.col("_q")
    if reach is None:
        return _attention(q, k, [group], near, group, pos)
    width = max(reach, 1)
    q = q.withColumn("_s", F.floor(F.col("_q") / width))
    k = k.withColumn("_s", F.explode(F.sequence(F.floor(F.col("_k") / width), F.floor((F.col("_k") + reach) / width))))
    return _attention(q, k, [group, "_s"], near & (F.col("_k") >= F.col("_q") - reach), group, pos)


def neighbourhood(df: DataFrame, group: str, pos: str, query: str, key: str, value: str, size: int) -> DataFrame:
    """(group, pos, out): scaled-dot attention of each row over the size rows around it, positions 0 to n - 1; at the edges the window stays within the group. Groups of less than size rows attend to all of theirs."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    start = F.greatest(F.lit(0), F.least(F.col(pos) - size // 2, F.col("_n") - size))
    q = df.join(n, group).select(group, F.col(pos).alias("_q"), F.col(query).alias("_x"), F.explode(F.sequence(start.cast("long"), F.least(start + size, F.col("_n")).cast("long") - 1)).alias("_k"))
    k = df.select(group, F.col(pos).cast("long").alias("_k"), F.col(key).alias("_y"), F.col(value).alias("_v"))
    return _attention(q, k, [group, "_k"], F.lit(True), group, pos)


def names(flat: Column, kind: str) -> Column:
    """The sorted names of the attributes of one kind in a flat map."""
    return F.array_sort(F.map_keys(unflatten(flat, kind)))


def assembled(texts: dict[str, Column], waves: dict[str, Column], known: tuple[str, ...], sample_rate: int = 48000) -> Column:
    """The conditions of a record as [text, wav] maps by name: a null text stays null, a null wave becomes null_wave; a name outside known is an error."""
    if unknown := sorted({*texts, *waves} - {*known}):
        raise ValueError(f"unknown conditions: {', '.join(unknown)}")
    named = lambda of: F.create_map(*(x for n, c in of.items() for x in (F.lit(n), c)))
    return F.struct(named(texts).alias("text"), named({n: F.coalesce(c, null_wave(sample_rate)) for n, c in waves.items()}).alias("wav"))
