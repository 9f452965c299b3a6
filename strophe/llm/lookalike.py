"""Texts that look alike but differ in their characters, brought to one form.

`fold` undoes what is invisible or a mere width or presentation form: it drops
characters that take no room, turns every one-character blank into the plain
space, full-width, ligature, radical and compatibility characters into the plain
ones, and composes accents. Look-alike letters of other scripts need their
surroundings: `tokens` finds, per token, the script that its unmistakable letters
(or else those of the whole text) belong to and proposes the token in that script.
`repair` applies a proposal only where the corpus vocabulary holds its result.
"""


import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from strophe.functions.characters import FOLDED_TAG, GREEK, GREEK_AS, DIRTY_PY, LATIN, TO_CYRILLIC, TO_GREEK, dirty, fold, has_words
from strophe.session import ship, stage

#: Letters of one script with no twin in another decide a token's script.
FOREIGN = re.compile("[\u0251\u0261\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff]")
_SURE = {
    "latin": re.compile("[" + "".join(c for c in map(chr, range(0x41, 0x180)) if c.isalpha() and ord(c) not in TO_CYRILLIC and ord(c) not in TO_GREEK) + "]"),
    "cyrillic": re.compile("[" + "".join(c for c in map(chr, range(0x400, 0x530)) if c.isalpha() and ord(c) not in LATIN) + "]"),
    "greek": re.compile("[" + "".join(c for c in map(chr, range(0x370, 0x400)) if c.isalpha() and ord(c) not in LATIN) + "]"),
}
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
#: Up to so many proposals (some 50 bytes each) are broadcast to pick the corpus words that matter; beyond, all distinct words are joined.
BROADCAST_WORDS = 500_000
OPEN, MID, CLOSE = "\ue000", "\ue001", "\ue002"


def _script(letter: str) -> str:
    c = ord(letter)
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return "latin"
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return "greek"
    return "cyrillic" if 0x400 <= c < 0x530 else "other"


def _sure(token: str) -> dict[str, int]:
    """Letters that look like no other script's, by script."""
    n: dict[str, int] = {}
    for x in unicodedata.normalize("NFD", token):
        c = ord(x)
        if x.isalpha() and c not in LATIN and c not in TO_CYRILLIC and c not in TO_GREEK:
            n[_script(x)] = n.get(_script(x), 0) + 1
    return n


def _into(token: str, script: str) -> str:
    how = {"latin": LATIN, "cyrillic": TO_CYRILLIC | {c: t for c, t in zip(map(ord, GREEK), (TO_CYRILLIC.get(ord(x), x) for x in GREEK_AS))}, "greek": TO_GREEK}[script]
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", token).translate(how))


@lru_cache(100_000)
def propose(token: str, main: str) -> str:
    """The token in its dominant script; main decides where no letter of the token is unmistakable."""
    n = _sure(token)
    best = max(n, key=lambda s: (n[s], s == "latin"), default=main)
    return _into(token, best if best in ("latin", "cyrillic", "greek") else "latin")


def _main(text: str) -> str:
    """The script of most unmistakable letters of a text."""
    n = {s: len(r.findall(text)) for s, r in _SURE.items()}
    return max(n, key=lambda s: (n[s], s == "latin"))


def mark(text: str) -> str:
    """fold(text), each token that holds a look-alike letter given as OPEN spelling MID proposal CLOSE."""
    t = fold(text)
    if not FOREIGN.search(t):
        return t
    main = _main(FOLDED_TAG.sub(" ", t))

    def one(m: re.Match) -> str:
        w = m[0]
        if not FOREIGN.search(w):
            return w
        p = propose(w, main)
        return w if p == w else f"{OPEN}{w}{MID}{p}{CLOSE}"

    return _TOKEN.sub(one, t)


_MARKED = re.compile(f"{OPEN}[^{MID}]*{MID}([^{CLOSE}]*){CLOSE}")


def skeleton(text: str) -> str:
    """The form under which all look-alikes are equal, whether or not the vocabulary knows the words."""
    return text if not DIRTY_PY.search(text) else _MARKED.sub(r"\1", mark(text))


@pandas_udf(StringType())
def _mark_udf(s: pd.Series) -> pd.Series:
    return s.map(mark, na_action="ignore")


@pandas_udf(StringType())
def _skeleton_udf(s: pd.Series) -> pd.Series:
    return s.map(skeleton, na_action="ignore")


def skeletons(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the skeleton of a text column as out; clean texts never leave the JVM. Null stays null."""
    ship(df.sparkSession)
    return df.withColumn(out, F.coalesce(_skeleton_udf(F.when(dirty(F.col(text)), F.col(text))), F.col(text)))


def repair(df: DataFrame, key: str = "row_id", text: str = "lyrics") -> DataFrame:
    """(key, text, form): every non-null text with its one consistent form.

    A token with look-alike letters is replaced only if its proposal is in the
    corpus vocabulary: a token of some text once folded, or the proposal of two
    or more different spellings. Proposals follow the script of the token's
    unmistakable letters, so real Cyrillic or Greek words stay. Null keys are
    kept; null texts give no row, empty ones an empty form; other columns of df,
    whatever their names, are left out. Equal rows give equal rows.

    The vocabulary is an aggregate with a map-side combine; the only text that is
    shuffled is that of rows with a rejected proposal.
    """
    ship(df.sparkSession)
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    bad = stage(src.where(dirty(F.col("t"))).select("k", "t", _mark_udf("t").alias("m")), "marked")
    proposal = f"{OPEN}([^{MID}]*){MID}([^{CLOSE}]*){CLOSE}"
    pairs = bad.select(F.explode(F.regexp_extract_all("m", F.lit(f"({proposal})"), 1)).alias("p")).select(
        F.regexp_extract("p", proposal, 1).alias("spelling"), F.lower(F.regexp_extract("p", proposal, 2)).alias("result")
    ).distinct()
    pairs = stage(pairs, "proposals")
    wanted = pairs.select("result").distinct()
    folded = src.where(~dirty(F.col("t"))).select("t").union(bad.select(F.regexp_replace("m", proposal, "$1")))
    words = folded.select(F.explode_outer(F.split(F.lower("t"), r"[\x00-@\[-`{-\u00BF\u2000-\u206F\u3000-\u303F\uFF00-\uFF20]+")).alias("result"))
    if wanted.count() <= BROADCAST_WORDS:
        words = words.join(F.broadcast(wanted), "result", "left_semi").distinct()
    else:
        words = words.distinct().join(wanted, "result", "left_semi")
    several = pairs.groupBy("result").agg((F.min("spelling") < F.max("spelling")).alias("two")).where("two").select("result")
    known = words.union(several).distinct()
    refused = pairs.join(known, "result", "left_anti").select("spelling").distinct()
    lost = (
        bad.select("k", "t", "m", F.explode(F.regexp_extract_all("m", F.lit(proposal), 1)).alias("spelling"))
        .distinct().join(refused, "spelling").groupBy("k", "t", "m").agg(F.collect_set("spelling").alias("keep"))
    )
    plain = F.regexp_replace("m", proposal, "$2")
    kept = F.regexp_replace(
        F.aggregate("keep", F.col("m"), lambda m, s: F.regexp_replace(m, F.concat(F.lit(OPEN), s, F.lit(f"{MID}[^{CLOSE}]*{CLOSE}")), s)),
        proposal, "$2",
    )
    fixed = bad.join(lost.select(F.col("k").alias("k2"), F.col("t").alias("t2"), "keep"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")), "left")
    fixed = fixed.select("k", "t", F.when(F.col("keep").isNull(), plain).otherwise(kept).alias("form"))
    clean = src.where(~dirty(F.col("t"))).select("k", "t", F.col("t").alias("form"))
    return clean.unionByName(fixed).select(F.col("k").alias(key), F.col("t").alias(text), "form")


def same_looking(df: DataFrame, key: str = "row_id", text: str = "lyrics") -> DataFrame:
    """(key_a, key_b), key_a < key_b: the pairs whose texts with words look the same but aren't the same string.

    Null keys and texts without words take no part; rows of one key pair up only
    with other keys. Only 128-bit keys of forms are joined, after groups with a
    single string are gone: each form's different strings with each other, then
    either side with its rows, so n copies of one string and one of another take
    2n rows, not n².
    """
    forms = repair(df.where(has_words(F.col(text))), key, text).where(F.col(key).isNotNull())
    keyed = stage(
        forms.select(key, F.xxhash64("form").alias("k1"), F.xxhash64(F.lit(7), F.col("form")).alias("k2"), F.xxhash64(text, F.lit(1)).alias("h"), dirty(F.col(text)).alias("d")),
        "forms",
    )
    several = keyed.groupBy("k1", "k2").agg(F.min("h").alias("x"), F.max("h").alias("y"), F.max("d").alias("d")).where("d and x <> y").select("k1", "k2")
    some = stage(keyed.join(several, ["k1", "k2"], "left_semi").select("k1", "k2", "h", F.col(key).alias("k")), "alike")
    strings = some.groupBy("k1", "k2", "h").agg(F.count(F.lit(1)).alias("n"))
    pairs = strings.select("k1", "k2", F.col("h").alias("ha")).join(strings.select("k1", "k2", F.col("h").alias("hb")), ["k1", "k2"]).where("ha < hb")
    a = some.select("k1", "k2", F.col("h").alias("ha"), F.col("k").alias("ka"))
    b = some.select("k1", "k2", F.col("h").alias("hb"), F.col("k").alias("kb"))
    rows = pairs.join(a, ["k1", "k2", "ha"]).join(b, ["k1", "k2", "hb"]).where("ka <> kb")
    return rows.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()
