"""Characters that look like others or take no room, and the structure tags of lyrics."""

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Structure tags.
TAGS = ("intro", "verse", "chorus", "bridge", "inst", "outro", "silence")
# Cyrillic letters and the Latin letters they look like.
CYRILLIC = "АВЕКМНОРСТУХЅІЈҮԌԜԚаеорсухѕіјԁһԛԝӏүѵѴ"
CYRILLIC_AS = "ABEKMHOPCTYXSIJYGWQaeopcyxsijdhqwlyvV"
# Greek letters and the Latin letters they look like.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳͿϹν"
GREEK_AS = "ABEZHIKMNOPTYXocjJCv"
# Other letters that are drawn as basic Latin ones.
OTHER = "ɑɡ"
OTHER_AS = "ag"
# Radicals without a compatibility mapping and the Han characters they look like.
RADICALS = "⺠⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰"
RADICALS_AS = "民西见角贝车长门青韦页风飞食马骨鬼鱼鸟麦黄齐齿龙"
# Code point ranges that take no room.
NO_ROOM = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB), (0xE0000, 0xE01EF)]
# One-character blanks.
BLANKS = [(0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x2800, 0x2800), (0x3000, 0x3000), (0x3164, 0x3164), (0xFFA0, 0xFFA0)]
#: Ranges whose compatibility form is drawn alike: letterlike and Roman numerals, radicals, ideographs, ligatures, widths, mathematical alphabets.
ALIKE = [(0x2100, 0x214F), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0xFF01, 0xFFEF), (0x1D400, 0x1D7FF), (0x2F800, 0x2FA1F)]


def _fold_table() -> dict[int, str | None]:
    t: dict[int, str | None] = {}
    for a, b in ALIKE:
        for c in range(a, b + 1):
            d = unicodedata.normalize("NFKC", chr(c))
            kind = unicodedata.decomposition(chr(c))
            if d != chr(c) and not d.startswith(" ") and (a != 0x2100 or kind.startswith("<font>") or not kind.startswith("<")):
                t[c] = d
    t |= dict(zip(map(ord, RADICALS), RADICALS_AS))
    for ranges, to in ((NO_ROOM, None), (BLANKS, " ")):
        t |= {c: to for a, b in ranges for c in range(a, b + 1)}
    return t


FOLD = _fold_table()
LATIN = dict(zip(map(ord, CYRILLIC + GREEK + OTHER), CYRILLIC_AS + GREEK_AS + OTHER_AS))
TO_CYRILLIC = {ord(b): a for a, b in reversed(list(zip(CYRILLIC, CYRILLIC_AS)))}
TO_GREEK = {ord(b): a for a, b in reversed(list(zip(GREEK, GREEK_AS)))}
#: Texts made of these characters alone are their own form (Latin with composed accents, Han, usual signs).
CLEAN = r"\t\n\r -~\u00A1-\u00AC\u00AE-\u017F\u2010-\u2027\u2030-\u205E\u20A0-\u20BF\u3001-\u3020\u3040-\u3130\u3400-\u9FFF\uAC00-\uD7A3\x{1F000}-\x{1FAFF}\u2190-\u23FF\u2500-\u27FF"
#: A character outside CLEAN, or any beyond the basic plane: this class compiles to a bitmap.
DIRTY_PY = re.compile("[^" + re.sub(r"\\x\{\w+\}-\\x\{\w+\}", "", CLEAN) + "]")


_FOLDED = re.compile("[" + "".join(chr(c) for c in FOLD if c < 0x10000) + "]|[\U00010000-\U0010ffff]")


def fold(text: str) -> str:
    """Invisible and presentation differences undone, accents composed; letters of other scripts stay."""
    return unicodedata.normalize("NFC", _FOLDED.sub(lambda m: FOLD.get(ord(m[0]), m[0]) or "", text))


FOLDED_TAG = re.compile(r"\[(?:" + "|".join(TAGS) + r")\]", re.I)


def dirty(c: Column) -> Column:
    """Whether a text has a character outside CLEAN; most texts are told by their lengths, or by a class of four ranges."""
    return (F.octet_length(c) != F.length(c)) & c.rlike(r"[^\t-~\u00A1-\u00AC\u00AE-\u017F\u3400-\u9FFF]") & c.rlike("[^" + CLEAN + "]")


def tag_pattern(*tags: str) -> str:
    """Java pattern of the tags in any case, width or look-alike letters, with characters that take no room between."""
    twins: dict[str, set[str]] = {}
    for c, to in (FOLD | LATIN).items():
        if to and len(to) == 1:
            twins.setdefault(to.lower(), set()).add(f"\\x{{{c:X}}}")
    room = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in NO_ROOM) + "]*"
    one = lambda x: f"[{chr(92)}{x}{''.join(sorted(twins.get(x, ())))}]" if x in "[]" else f"[{x}{''.join(sorted(twins.get(x, ())))}]"
    return "(?i)" + one("[") + room + "(?:" + "|".join(room.join(map(one, t)) for t in tags or TAGS) + ")" + room + one("]")


def tagless(c: Column) -> Column:
    """The text without its structure tags, however their characters are written."""
    return F.when(dirty(c), F.regexp_replace(c, tag_pattern(), "")).otherwise(F.regexp_replace(c, r"(?i)\[(?:" + "|".join(TAGS) + r")\]", ""))


def has_words(c: Column) -> Column:
    """Whether a text holds a letter or digit besides its tags; mostly seen at the first one outside brackets."""
    outside = r"(?:^|[\]\uFF3D])[^\[\uFF3B\p{L}\p{N}]*+[\p{L}\p{N}]"
    return F.coalesce(c.rlike(outside) | tagless(c).rlike(r"[\p{L}\p{N}]"), F.lit(False))


def plain_tags(c: Column) -> Column:
    """The text with every tag in plain lower-case characters where its characters are unusual ones."""
    x = c
    for t in TAGS:
        x = F.regexp_replace(x, tag_pattern(t), f"[{t}]")
    return F.when(dirty(c), x).otherwise(c)
