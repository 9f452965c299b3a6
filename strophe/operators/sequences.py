"""Operators over ordered sequences: rows with a group key and a position, or arrays.

Positions need not be dense unless said. Window operators shuffle once, on the
group key; a sequence is at most one song, so no window holds more than a song.
Operators on arrays never shuffle.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.operators.arrays import let

# Structures and their numbers; those that are sung; other names of some.
STRUCTURES = {"verse": 0, "chorus": 1, "bridge": 2, "inst": 3, "intro": 4, "outro": 5, "silence": 6}
VOCAL = ("verse", "chorus", "bridge")
ALIASES = {"start": "intro", "end": "outro", "solo": "inst", "break": "inst"}


def canonical_structure(name: Column) -> Column:
    """The structure that a name means, in any case and with a number or blanks around; null for unknown and null names."""
    x = F.lower(F.trim(name))
    for a, b in ALIASES.items():
        x = F.when(x == a, F.lit(b)).otherwise(x)
    return F.when(x.isin(*STRUCTURES), x)


def legal_structure(structure: Column, text: Column) -> Column:
    """Whether a vocal structure has text, and any other has none; a null text is empty, a null structure never legal."""
    return F.coalesce(structure.isin(*VOCAL) == (F.trim(F.coalesce(text, F.lit(""))) != ""), F.lit(False))


def merge_runs(df: DataFrame, group: str, order: list[str], start: str, end: str, structure: str, lyric: str) -> DataFrame:
    """Runs of one structure in a group: a run that isn't sung becomes one row; of a sung one every row stays, ending where the next row of the run ends.

    (group, run, start, end, structure, lyric); run counts the runs of a group from
    1. A merged row has the first start and lyric and the last end. Null structures
    are a structure of their own; ties in order are broken by all other columns.
    One shuffle on the group.
    """
    w = Window.partitionBy(group).orderBy(*order, start, end, structure, lyric)
    changed = F.when(F.col(structure).eqNullSafe(F.lag(structure).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = df.select(group, *order, start, end, structure, lyric).withColumn("_new", changed).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(group, "run").orderBy("_n")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sung = F.coalesce(F.col(structure).isin(*VOCAL), F.lit(False))
    follows = F.lead(F.lit(1)).over(inside).isNotNull()
    ends = F.when(~sung, F.last(end).over(whole)).when(follows, F.lead(end).over(inside)).otherwise(F.col(end))
    rows = rows.withColumn("_end", ends).where(sung | (F.col("_new") == 1))
    return rows.select(group, "run", start, F.col("_end").alias(end), structure, lyric)


def annotate_tokens(df: DataFrame, vocab: DataFrame, key: str, text: str, max_sentences: int = 200) -> DataFrame:
    """(key, pos, token_id, special_id, sentence): the tokens of a text that are in a vocabulary (id, token).

    Tokens outside the vocabulary are dropped and positions closed up. special_id:
    1 a comma, 2 a period, 3 + the structure's number a tag, and content has that of
    the current structure (0 before any). sentence: on content, 1 + the periods
    since the last tag, at most max_sentences - 1; 0 elsewhere. A token that occurs
    twice in the vocabulary has its smallest id. Null and empty texts give no rows;
    keys should be unique. The vocabulary is joined (broadcast if small); one
    shuffle on the key.
    """
    tag = F.regexp_extract("token", r"^\[(\w+)\]$", 1)
    number = F.lit(None).cast("int")
    for s, n in STRUCTURES.items():
        number = F.when(tag == s, F.lit(n)).otherwise(number)
    # what a token is comes with the vocabulary, so it isn't worked out for every token
    ids = vocab.where("token is not null and token <> ''").groupBy("token").agg(F.min("id").alias("token_id")).withColumn("_tag", number)
    # outer, as Spark would compute the text a second time to filter empty arrays; the join drops nulls
    tokens = df.select(F.col(key), F.posexplode_outer(F.split(F.trim(F.col(text)), " +")).alias("_at", "token"))
    known = tokens.join(ids, "token")
    w = Window.partitionBy(key).orderBy("_at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("pos", F.row_number().over(w) - 1).withColumn("_now", F.last("_tag", True).over(so_far)).withColumn("_island", F.count("_tag").over(so_far))
    dots = F.sum(F.when(F.col("token") == ".", 1).otherwise(0)).over(Window.partitionBy(key, "_island").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    content = F.col("_tag").isNull() & ~F.col("token").isin(".", ",")
    special = F.when(F.col("_tag").isNotNull(), F.col("_tag") + 3).when(F.col("token") == ".", 2).when(F.col("token") == ",", 1).otherwise(F.coalesce(F.col("_now") + 3, F.lit(0)))
    return known.withColumn("_dots", dots).select(
        key, "pos", "token_id", special.cast("int").alias("special_id"),
        F.when(content, F.least(F.col("_dots") + 1, F.lit(max_sentences - 1))).otherwise(0).cast("int").alias("sentence"),
    )


def third_tones(tones: Column) -> Column:
    """A third tone before a third tone becomes the second, judged by the tones as given."""
    return F.transform(tones, lambda t, i: F.when((t == 3) & (F.get(tones, i + 1) == 3), F.lit(2)).otherwise(t))


def merge_repeated(words: Column) -> Column:
    """Equal neighbours become one word, compared with what has grown so far: A A A is AA, A."""
    one = F.array(F.lit("")).cast("array<string>")
    grown = F.aggregate(
        words, F.slice(one, 1, 0),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) == x), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(x, x)))).otherwise(F.concat(acc, F.array(x))),
    )
    return grown


def blocks(x: Column, size: int) -> Column:
    """An array in blocks of size; the last may be shorter."""
    n = F.ceil(F.size(x) / F.lit(size)).cast("int")
    none = F.slice(F.array(x), 1, 0)  # of the elements' own type
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(x, i * size + 1, size))).otherwise(none)


def previous_blocks(b: Column, zero: Column) -> Column:
    """Every block replaced by the one before; the first by zero."""
    return F.slice(F.concat(F.array(zero), b), 1, F.size(b))


def targets(x: Column, width: int, eos: Column, special: Column) -> Column:
    """x, then eos, then special, up to width."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i < F.size(x), F.get(x, i)).when(i == F.size(x), eos).otherwise(special))


def interleave(tokens: Column, latents: Column, size: int) -> Column:
    """Blocks of size tokens, each followed by its latent."""
    return let(latents, lambda l: F.flatten(F.transform(blocks(tokens, size), lambda b, i: F.concat(b, F.array(F.get(l, i))))))


def overlapped_chunks(n: int, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, first, end) of chunks over n steps: chunks begin every size - overlap steps, the last one is right-aligned; inner edges lose half the overlap. Less than a chunk is an error."""
    if n < size:
        raise ValueError(f"{n} steps are less than a chunk of {size}")
    starts = list(range(0, n - size + 1, size - overlap))
    if starts[-1] + size < n:
        starts.append(n - size)
    half = overlap // 2
    return [(s, s + (half if i else 0), s + size - (half if i < len(starts) - 1 else 0)) for i, s in enumerate(starts)]


def chunk_owner(n: Column, size: int, overlap: int) -> Column:
    """For each of n positions the number of the last chunk that covers it after trimming; null if n is less than a chunk."""
    hop, half = size - overlap, overlap // 2
    regular = F.floor((n - size) / F.lit(hop)).cast("int")
    tail = (regular * hop + size) < n
    last = regular + tail.cast("int")

    def begins(k: Column) -> Column:
        return F.when(k == 0, F.lit(0)).when(tail & (k == last), n - size + half).otherwise(k * hop + half)

    position = F.sequence(F.lit(0), n - 1)
    # chunks begin in order of their numbers, so the owner is the last that has begun
    return F.when(n >= size, F.transform(position, lambda p: F.when(p >= begins(last), last).otherwise(F.greatest(F.floor((p - half) / F.lit(hop)).cast("int"), F.lit(0)))))


def stretch(x: Column, size: Column, exact: bool = True) -> Column:
    """x brought to size by nearest index: floor((i + 0.5) * in / out) if exact, else floor(i * in / out). Null and empty arrays stay."""

    def stretched(y: Column) -> Column:
        n = F.size(y)
        at = (lambda i: F.floor((i + 0.5) * n / size)) if exact else (lambda i: F.floor(i * n / size))
        return F.when((n > 0) & (size > 0), F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(y, F.least(at(i).cast("int"), n - 1)))).otherwise(y)

    return let(x, stretched)


def pad(x: Column, width: int, value: Column) -> Column:
    """x cut or filled with value to width."""
    return F.slice(F.concat(x, F.array_repeat(value, width)), 1, width)


def mask(n: Column, width: int) -> Column:
    """1 for positions below n, else 0; width is at least 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(max(width, 1) - 1)), lambda i: (i < n).cast("int"))


def script_runs(text: Column) -> Column:
    """A text as runs of [script, run]: each of , . ! ? … - alone is sp, Han characters are zh, all else is en; newlines count as periods."""
    found = F.regexp_extract_all(F.regexp_replace(text, "\n", "."), F.lit(r"[一-龥]+|[,.!?…\-]|[^一-龥,.!?…\-]+"), 0)
    kind = lambda r: F.when(r.rlike("^[一-龥]"), "zh").when(r.rlike(r"^[,.!?…\-]$"), "sp").otherwise("en")
    return F.transform(found, lambda r: F.struct(kind(r).alias("script"), r.alias("run")))


def boundaries(tags: Column) -> Column:
    """[start, end) of each section of a token array, from positions that are tags (true) to the next or the end."""
    at = F.filter(F.transform(tags, lambda t, i: F.when(t, i)), lambda i: i.isNotNull())
    following = lambda a: F.concat(F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), F.array(F.size(tags)))
    return let(at, lambda a: F.when(F.size(a) > 0, F.zip_with(a, following(a), lambda s, e: F.struct(s.alias("start"), e.alias("end")))).otherwise(F.array().cast("array<struct<start int, end int>>")))


def positions(n: Column, start: Column) -> Column:
    """0 to n - 1 counted from start, never below 0."""
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.greatest(i - start, F.lit(0)))


def summaries(n: int, size: int) -> list[int]:
    """Of n outputs, those that sum up a block: every one behind size others."""
    return [i for i in range(n) if (i + 1) % (size + 1) == 0]


def split_word(word: Column, parts: Column) -> Column:
    """A word cut at its shortest part (of equal ones the first): [before or part, rest]."""
    short = F.get(F.array_sort(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), p.alias("p")))), 0)["p"]
    at = F.instr(word, short)
    return F.when(at == 1, F.array(short, F.substring(word, F.length(short) + 1, F.length(word)))).otherwise(F.array(F.substring(word, F.lit(1), F.length(word) - F.length(short)), short))


def zipped(*arrays: Column) -> Column:
    """Arrays element by element, as long as the shortest."""
    return F.slice(F.arrays_zip(*arrays), F.lit(1), F.least(*(F.size(a) for a in arrays)) if len(arrays) > 1 else F.size(arrays[0]))


def _starts(n: Column, size: int, overlap: int) -> Column:
    hop = size - overlap
    regular = F.sequence(F.lit(0), n - size, F.lit(hop))
    return F.when((n - size) % hop == 0, regular).otherwise(F.concat(regular, F.array(n - size)))


def split_chunks(x: Column, size: int, overlap: int) -> Column:
    """x as overlapping chunks of size, the last one right-aligned, each with its start; less than a chunk is an error."""
    cut = let(x, lambda y: F.transform(_starts(F.size(y), size, overlap), lambda s: F.struct(s.alias("start"), F.slice(y, s + 1, F.lit(size)).alias("values"))))
    return F.when(F.size(x) >= size, cut).otherwise(F.raise_error(F.concat(F.size(x).cast("string"), F.lit(f" steps are less than a chunk of {size}"))))


def stitched(chunks: Column, overlap: int) -> Column:
    """One array of chunks (as split_chunks gives them, their values changed at will but not in number): half of each overlap is cut from inner edges, and what still meets is the later chunk's."""
    half = overlap // 2

    def part(c: Column, i: Column) -> Column:
        first = F.when(i == 0, 0).otherwise(half)
        until = F.when(i + 1 < F.size(chunks), F.get(chunks, i + 1)["start"] + half - c["start"]).otherwise(F.size(c["values"]))
        return F.slice(c["values"], first + 1, until - first)

    return F.flatten(F.transform(chunks, part))


def pad_rows(x: Column, width: int, blank: Column) -> Column:
    """[rows, mask]: an array of vectors cut or filled with the blank vector to width, and 1 for the rows it had, else 0."""
    return F.struct(pad(x, width, blank).alias("rows"), mask(F.size(x), width).alias("mask"))
