"""English text before its pronunciation is looked up."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType


# Punctuation and what it becomes.
PUNCTUATION, PUNCTUATION_AS = ";:，；：。！？’\"", ",,,,,.!?''"
# Number words.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ("", "thousand", "million", "billion", "trillion")
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def cardinal(n: int) -> str:
    """A number below 10 ** 15 in words, hundreds without `and`; larger ones digit by digit."""
    if n < 20:
        return SMALL[n]
    if n < 100:
        return TENS[n // 10] + ("-" + SMALL[n % 10] if n % 10 else "")
    if n < 1000:
        return SMALL[n // 100] + " hundred" + (" " + cardinal(n % 100) if n % 100 else "")
    if n >= 10**15:
        return " ".join(SMALL[int(c)] for c in str(n))
    groups = [(n // 1000**k % 1000, SCALES[k]) for k in range(4, -1, -1)]
    return " ".join(f"{cardinal(g)} {scale}".strip() for g, scale in groups if g)


def ordinal(n: int) -> str:
    """The last word of the cardinal in its ordinal form."""
    head, sep, last = (said := cardinal(n)).rpartition("-" if "-" in said.rsplit(" ", 1)[-1] else " ")
    last = ORDINALS.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return head + sep + last


def year(n: int) -> str:
    """1001 to 2999 in pairs of digits, as years are read; 2000 to 2009 as numbers, round hundreds as hundreds."""
    if 2000 <= n < 2010 or n % 1000 == 0:
        return cardinal(n)
    low = "hundred" if n % 100 == 0 else f"oh {SMALL[n % 100]}" if n % 100 < 10 else cardinal(n % 100)
    return f"{cardinal(n // 100)} {low}"


def say_numbers(text: str) -> str:
    """Numbers of a text in words: thousands' commas dropped, pounds and dollars named, decimals digit by digit, ordinals, and whole numbers (of 1001 to 2999 as years)."""

    def money(m: re.Match) -> str:
        whole, cents = int(m[1] or 0), int((m[2] or "0").ljust(2, "0"))
        parts = [f"{whole} dollar{'s' * (whole != 1)}"] * (whole > 0) + [f"{cents} cent{'s' * (cents != 1)}"] * (cents > 0)
        return ", ".join(parts) or "zero dollars"

    t = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text)
    t = re.sub(r"£(\d+)", r"\1 pounds", t)
    t = re.sub(r"\$(\d+)(?:\.(\d{1,2}))?(?!\d)", money, t)
    t = re.sub(r"(\d+)\.(\d+)", lambda m: f"{cardinal(int(m[1]))} point {' '.join(SMALL[int(c)] for c in m[2])}", t)
    t = re.sub(r"(\d+)(?:st|nd|rd|th)(?![A-Za-z])", lambda m: ordinal(int(m[1])), t)
    return re.sub(r"\d+", lambda m: year(int(m[0])) if 1000 < int(m[0]) < 3000 else cardinal(int(m[0])), t)


@pandas_udf(StringType())
def _said(text: pd.Series) -> pd.Series:
    return text.map(lambda t: say_numbers(t) if t else t, na_action="ignore")


def numbers_said(c: Column) -> Column:
    """say_numbers; texts without digits stay in the JVM."""
    return F.coalesce(_said(F.when(c.rlike("[0-9]"), c)), c)


@pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Letters without their accents; null for null. No built-in decomposes characters."""
    return text.map(lambda t: t if t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"), na_action="ignore")


def normalise_english(plain: Column) -> Column:
    """Text without accents in the characters that have a pronunciation: punctuation mapped, numbers and i.e. and e.g. written out, the rest dropped."""
    x = numbers_said(F.translate(plain, PUNCTUATION, PUNCTUATION_AS))
    # fixed values: the characters that have a pronunciation, and the two abbreviations
    x = F.regexp_replace(x, "[^ A-Za-z'.,?!\\-]", "")
    return F.regexp_replace(F.regexp_replace(x, r"(?i)i\.e\.", "that is"), r"(?i)e\.g\.", "for example")


def spelled(token: Column) -> Column:
    """Phones of a token that needs no lexicon: a token without letters is itself, a lone A is EY1; else null."""
    return F.when(~token.rlike("[A-Za-z]"), F.array(token)).when(F.upper(token) == "A", F.array(F.lit("EY1")))


