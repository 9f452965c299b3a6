"""Lyric sheets: cleaning, sections, phoneme-stage tokens."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.characters import TAGS
from strophe.operators.arrays import let

# Marks that become periods, signs that go, and the tags before text that need no comma.
MARKS = "[!?;,:…！？，]"
GONE = "[\"“”‘’«»〈〉《》【】(){}]"
SUNG = ("[verse]", "[chorus]", "[bridge]")
_TAG = r"\[(?:" + "|".join(TAGS) + r")\]"
_UNSUNG = "|".join(t for t in TAGS if f"[{t}]" not in SUNG)
_CUT = "\x01"
_WS = r"[\s\p{Z}]"
#: Signs within a sheet that is being cleaned: around a tag, at the ends of other bracketed text, and for a part whose characters are all dropped.
OPEN, CLOSE, EDGE, EMPTY = "\x01", "\x02", "\x03", "\x04"


def _lower_tags(x: Column) -> Column:
    for t in TAGS:
        x = F.regexp_replace(x, rf"(?i){OPEN}\[{t}\]", f"{OPEN}[{t}]")
    return x


def clean_lyrics(text: Column) -> Column:
    """A sheet in one form: marks as periods, lower-case tags, no quotes or brackets, single blanks, ` , ` between sections.

    A comma goes between two different tags, and between a tag and text unless the
    tag is exactly a sung one; equal neighbours get none. Blanks between two Han
    characters become periods, without overlap. Null gives null, empty gives empty.

    Every rule is one replacement over the whole sheet: tags are set between signs
    first, so that the rules can look at what stands next to them.
    """
    some = lambda x, has, pattern, to: let(x, lambda y: F.when(y.rlike(has) if has else y.contains(".."), F.regexp_replace(y, pattern, to)).otherwise(y))
    x = F.regexp_replace(text, f"[{OPEN}{CLOSE}{EDGE}{EMPTY}]", "")
    x = F.regexp_replace(x, MARKS, ".")
    x = F.regexp_replace(x, rf"(?i)({_TAG}){_WS}*[,.]", "$1 ")
    x = F.regexp_replace(x, f"{_WS}+", " ")
    # tags between their signs; other brackets and what they hold are a part of text
    x = F.regexp_replace(x, rf" *(?:((?i:{_TAG}))|(\[[^\]]+\])) *", f"{OPEN}$1{CLOSE}$2{EDGE}")
    x = F.replace(x, F.lit(f"{CLOSE}{EDGE}"), F.lit(CLOSE))
    x = F.replace(x, F.lit(f"{OPEN}{CLOSE}"), F.lit(EDGE))
    x = let(x, lambda y: F.when(y.rlike(rf"{OPEN}\[[^\]]*[A-Z]"), _lower_tags(y)).otherwise(y))
    bare = f"(?<![^{CLOSE}{EDGE}]) *+(?:{GONE} *)++(?![^{OPEN}{EDGE}])"
    gone = lambda y: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(y, bare, EMPTY), GONE, ""), " +", " "), f" ?([{OPEN}{CLOSE}{EDGE}]) ?", "$1")
    x = let(x, lambda y: F.when(y.rlike(GONE), gone(y)).otherwise(y))
    # commas: before a tag behind text, between different tags, and behind a tag that isn't sung before text
    x = F.regexp_replace(x, f"(?<=[^{CLOSE}])(?={OPEN})", " , ")
    x = F.regexp_replace(x, rf"{OPEN}\[(?:(\w+)\]{CLOSE}(?={OPEN}\[(?!\1\]))|({_UNSUNG})\]{CLOSE}(?=[^{OPEN}]))", "[$1$2]  , ")
    x = F.replace(x, F.lit(CLOSE), F.lit(" "))
    x = F.regexp_replace(x, f"[{OPEN}{EDGE}{EMPTY}]", "")
    x = F.regexp_replace(F.regexp_replace(x, " +,", " ,"), ", +", ", ")
    x = some(x, None, r"\.{2,}", ".")
    x = some(x, r"\. *,", r"\. *,", ",")
    x = some(x, "[一-鿿] ", "([一-鿿]) +([一-鿿])", "$1.$2")
    return F.trim(x)


CLEAN_SQL = rf"""
    WITH parts AS (SELECT row_id, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(lyrics, '{MARKS}', '.', 'g'), '(?i)({_TAG}){_WS}*[,.]', '\1 ', 'g'),
        '(\[[^\]]+\])', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda p: trim(regexp_replace(p, '{_WS}', ' ', 'g')) <> '') AS ps FROM songs),
    clean AS (SELECT row_id, list_transform(ps, lambda p: CASE WHEN regexp_matches(lower(trim(regexp_replace(p, '{_WS}+', ' ', 'g'))), '^{_TAG}$')
        THEN lower(trim(regexp_replace(p, '{_WS}+', ' ', 'g'))) ELSE trim(regexp_replace(regexp_replace(p, '{GONE}', '', 'g'), '{_WS}+', ' ', 'g')) END) AS c FROM parts),
    joined AS (SELECT row_id, array_to_string(list_transform(c, lambda p, i: p || CASE WHEN regexp_matches(p, '^{_TAG}$') THEN ' ' ELSE '' END ||
        CASE WHEN i = len(c) THEN '' WHEN regexp_matches(p, '^{_TAG}$') AND regexp_matches(c[i + 1], '^{_TAG}$') THEN CASE WHEN p <> c[i + 1] THEN ' , ' ELSE '' END
             WHEN (regexp_matches(p, '^{_TAG}$') OR regexp_matches(c[i + 1], '^{_TAG}$')) AND p NOT IN {SUNG} THEN ' , ' ELSE '' END), '') AS x FROM clean)
    SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '{_WS}+,', ' ,', 'g'), ',{_WS}+', ', ', 'g'), '\.{{2,}}', '.', 'g'), '\.{_WS}*,', ',', 'g'),
        '([一-鿿]){_WS}+([一-鿿])', '\1.\2', 'g')) AS lyrics FROM joined"""


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, tag, text): the parts of a sheet after each tag, numbered from 1; text before any tag has section 0 and a null tag.

    Null texts give no row, empty ones one with section 0 if they have text. In-row: no shuffle.
    """
    cut = F.split(F.regexp_replace(F.col(text), rf"(?i)({_TAG})", f"{_CUT}$1"), _CUT)
    rows = df.select(F.col(key), F.posexplode_outer(cut).alias("section", "_p"))
    tag = F.lower(F.regexp_extract("_p", rf"(?i)^({_TAG})", 1))
    body = F.regexp_replace(F.regexp_replace("_p", rf"(?i)^{_TAG}", ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return rows.select(key, "section", F.when(tag != "", tag).alias("tag"), body.alias("text")).where("section > 0 or text <> ''")


def durations(df: DataFrame, key: str, order: str, start: str, end: str, resolution: float) -> DataFrame:
    """df with frames: each section's start and end in steps of resolution, truncated, less one for the separator unless the section is its group's last."""
    w = Window.partitionBy(key).orderBy(order)
    n = (F.col(end) / resolution).cast("int") - (F.col(start) / resolution).cast("int")
    return df.withColumn("frames", n - F.when(F.lead(F.lit(1)).over(w).isNull(), 0).otherwise(1))


def stretched_section(tokens: Column, start: Column, end: Column, resolution: float, last: Column, separator: Column) -> Column:
    """A section's tokens stretched to the steps of its duration (nearest, exact), less the separator that follows unless it is the last; a section without tokens or steps is an error."""
    from strophe.operators.sequences import stretch

    n = F.floor(end / resolution).cast("int") - F.floor(start / resolution).cast("int") - F.when(last, 0).otherwise(1)
    some = F.when((F.size(tokens) > 0) & (n > 0), stretch(tokens, n)).otherwise(F.raise_error(F.lit("a section without tokens or steps")))
    return F.when(last, some).otherwise(F.concat(some, F.array(separator)))


def stretched(df: DataFrame, key: str, order: str, tokens: str, start: str, end: str, resolution: float, separator: Column) -> DataFrame:
    """(key, tokens): the sections of a sheet, each stretched to its duration, a separator between. A sheet is a row; one shuffle, on the key."""
    w = Window.partitionBy(key).orderBy(order)
    last = F.lead(F.lit(1)).over(w).isNull()
    rows = df.withColumn("_last", last).select(key, order, stretched_section(F.col(tokens), F.col(start), F.col(end), resolution, F.col("_last"), separator).alias("t"))
    kept = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "t"))).alias("s"))
    return kept.select(key, F.flatten("s.t").alias(tokens))
