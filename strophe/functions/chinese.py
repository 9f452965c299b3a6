"""Chinese text normalisation: numbers, dates, times, units and phones as words.

Single readings are expressions over a column of digits. The whole chain, whose steps depend on each other's results and look around
their matches, is one Arrow function.
"""

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Digits, places within four digits, and the words for groups of four.
DIGITS = "零一二三四五六七八九"
PLACES = ("千", "百", "十", "")
# Units by notation, replaced in this order wherever they stand.
UNITS = {
    "cm2": "平方厘米", "cm²": "平方厘米", "cm3": "立方厘米", "cm³": "立方厘米", "cm": "厘米", "db": "分贝", "ds": "毫秒", "kg": "千克", "km": "千米",
    "m2": "平方米", "m²": "平方米", "m³": "立方米", "m3": "立方米", "ml": "毫升", "m": "米", "mm": "毫米", "s": "秒",
}
# Signs of arithmetic.
SIGNS = {"+": "加", "-": "减", "×": "乘", "÷": "除", "=": "等于"}
# Measure words behind a number; a parameter of the chain.
MEASURES = (
    "封 艘 把 目 套 段 人 所 朵 匹 张 座 回 场 尾 条 个 首 阙 阵 网 炮 顶 丘 棵 只 支 袭 辆 挑 担 颗 壳 窠 曲 墙 群 腔 砣 客 贯 扎 捆 刀 令 打 手 罗 坡 山 岭 江 溪 钟 队 单 双 对 出 口 头 脚 板 跳 枝 件 贴 针 线 管 名 位 身 堂 课 本 页 家 户 层 "
    "丝 毫 厘 分 钱 两 斤 铢 石 钧 锱 忽 千克 毫克 微克 公分 寸 尺 丈 里 寻 常 铺 程 千米 分米 厘米 毫米 微米 米 撮 勺 合 升 斗 盘 碗 碟 叠 桶 笼 盆 盒 杯 斛 锅 簋 篮 罐 瓶 壶 卮 盏 箩 箱 煲 啖 袋 钵 "
    "年 月 日 季 刻 时 周 天 秒 小时 旬 纪 岁 世 更 夜 春 夏 秋 冬 代 伏 辈 丸 泡 粒 幢 堆 根 道 面 片 块 元 亿 千万 百万 万 千 百 美元 亿吨 千万吨 百万吨 万吨 千吨 百吨 十吨 角 毛"
).split()
# Greek letters as they are said.
GREEK = {
    "α": "阿尔法", "β": "贝塔", "γΓ": "伽玛", "δΔ": "德尔塔", "ε": "艾普西龙", "ζ": "捷塔", "η": "依塔", "θΘ": "西塔", "ι": "艾欧塔", "κ": "喀帕", "λΛ": "拉姆达",
    "μ": "缪", "ν": "拗", "ξΞ": "克西", "ο": "欧米克伦", "πΠ": "派", "ρ": "肉", "ςΣσ": "西格玛", "τ": "套", "υ": "宇普西龙", "φΦ": "服艾", "χ": "器", "ψΨ": "普赛", "ωΩ": "欧米伽",
}
# Forms of mobile, landline and service numbers.
MOBILE = r"(?<!\d)(?:\+?86 ?)?1(?:[38]\d|5[0-35-9]|7[678]|9[89])\d{8}(?!\d)"
LANDLINE = r"(?<!\d)(?:0(?:10|2[1-3]|[3-9]\d{2})-?)?[1-9]\d{6,7}(?!\d)"
SERVICE = r"400-?\d{3}-?\d{4}"
# Punctuation of the phoneme stage.
PUNCTUATION = {"...": "…", "：": ",", "；": ",", "，": ",", "·": ",", "、": ",", "/": ",", "。": ".", "\n": ".", "$": ".", "！": "!", "？": "?", "—": "-", "~": "…", "～": "…"}
# Marks that the phoneme stage keeps, circled numbers, and signs that are dropped from sentences.
KEPT = "!?…,.-"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"
DROPPED = r"[——《》【】<>{}()（）#&@“”^_|\\]"


# ---- readings as expressions ----

def digits_words(x: Column, telephone: bool = False) -> Column:
    """Digits read one by one; by telephone a one is 幺."""
    return F.translate(x, "0123456789", DIGITS.replace("一", "幺") if telephone else DIGITS)


def cardinal_words(x: Column) -> Column:
    """A string of digits, of any length, as a cardinal; empty for empty, null for null.

    Every digit gets its place, eight by eight, then what zeros make silent goes:
    one 零 is left of a run inside, none at the end of four or eight digits.
    """
    y = F.lpad(x, (F.ceil(F.length(x) / F.lit(8)) * 8).cast("int"), "0")
    y = F.regexp_replace(y, r"(\d)(\d)(\d)(\d)(\d)(\d)(\d)(\d)", "$1千$2百$3十$4万$5千$6百$7十$8亿")
    y = F.regexp_replace(F.regexp_replace(y, "亿$", ""), "0[千百十]", "0")
    y = F.regexp_replace(F.regexp_replace(y, "(?<![0-9千百十])0+万", "0"), "0+万", "万")
    y = F.regexp_replace(F.regexp_replace(F.regexp_replace(y, "0+亿", "亿"), "^[0亿]+", ""), "0+$", "")
    y = F.translate(F.regexp_replace(y, "0+", "0"), "0123456789", DIGITS)
    return F.when(x == "", "").when(x.rlike("^0+$"), DIGITS[0]).otherwise(F.regexp_replace(y, "^一十", "十"))


def number_words(whole: Column, decimals: Column) -> Column:
    """A cardinal with 点 and its decimals, without their trailing zeros."""
    d = F.regexp_replace(decimals, "0+$", "")
    lead = F.when((whole == "") & (d != ""), DIGITS[0]).otherwise(cardinal_words(whole))
    return F.concat(lead, F.when(d == "", "").otherwise(F.concat(F.lit("点"), digits_words(d))))


# ---- the chain ----

def digits(x: str, telephone: bool = False) -> str:
    return "".join("幺" if telephone and c == "1" else DIGITS[int(c)] for c in x)


def cardinal(x: str) -> str:
    """Digits of any length as a cardinal: 亿 splits off eight digits, 万 four."""
    x = x.lstrip("0")
    if not x:
        return DIGITS[0]

    def read(part: str, gap: bool) -> str:
        """gap: a zero that was passed over stands before."""
        size, word = next(((n, w) for n, w in ((8, "亿"), (4, "万")) if len(part.lstrip("0")) > n), (0, ""))
        if size:
            return read(part[:-size], gap) + word + read(part[-size:], False)
        out, zero, seen = "", gap, False
        for i, c in enumerate(part):
            place = len(part) - i - 1
            if c == "0":
                zero = True
                continue
            lead = zero and (part[i - 1] == "0" if i else gap) and (seen or i or gap)
            out += ("零" if lead else "") + DIGITS[int(c)] + ("", "十", "百", "千")[place]
            seen, zero = True, False
        return out

    out = read(x, False)
    return out[1:] if out.startswith("一十") else out


def number(x: str) -> str:
    """A number with or without decimals; two points are an error."""
    if x.count(".") > 1:
        raise ValueError(f"more than one point in {x}")
    whole, _, decimals = x.partition(".")
    decimals = decimals.rstrip("0")
    said = cardinal(whole) if whole else ""
    return (said or DIGITS[0]) + "点" + digits(decimals) if decimals else said


def _signed(x: str, minus: str = "负") -> str:
    return minus + number(x[1:]) if x.startswith("-") else number(x)


def _part(x: str) -> str:
    """Minutes or seconds: a leading zero is said."""
    return (DIGITS[0] if x[0] == "0" else "") + number(x.lstrip("0"))


def _clock(hour: str, minute: str, second: str | None, half: str) -> str:
    """half: the minute that decides whether it is half past."""
    said = number(hour) + "点"
    if minute.strip("0"):
        said += "半" if int(half) == 30 else _part(minute) + "分"
    return said + (_part(second) + "秒" if second and second.strip("0") else "")


_AFTER = str.maketrans({"/": "每", **{c: cardinal(str(i)) for i, c in enumerate(CIRCLED, 1)}, **{c: said for cs, said in GREEK.items() for c in cs}, **dict.fromkeys("-—《》【】<=>{}()（）#&@“”^_|\\")})


def post_replace(x: str) -> str:
    """Slashes, circled digits and Greek letters as words, without special characters."""
    return x.translate(_AFTER)


# Forms of a number, a time and a unit.
_N = r"-?\d+(?:\.\d+)?"
_T = r"([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?"
_U = "%|°C|℃|度|摄氏度|" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))


def _arithmetic(x: str) -> str:
    number_ = r"(?:-?\d+(?:\.\d+)?|\.\d+)"
    rule = re.compile(rf"({number_})([+\-×÷=])({number_})")
    while rule.search(x):
        x = rule.sub(lambda m: m[1] + SIGNS[m[2]] + m[3], x)
    return x


def _units(x: str) -> str:
    for u, said in UNITS.items():
        x = x.replace(u, said)
    return x


def _ymd(m: re.Match) -> str:
    return digits(m["y"]) + "年" + (cardinal(m["m"]) + "月" if m["m"] else "") + (cardinal(m["d"]) + (m.groupdict().get("w") or "日") if m["d"] else "")


def rules(measures: list[str] = MEASURES) -> list[tuple[re.Pattern | None, Callable]]:
    """The steps in their order: a pattern with what each match becomes, or None with a function of the whole. Patterns and order are fixed values."""
    many = "|".join(sorted(measures, key=lambda u: (-len(u), u)))
    p = re.compile
    return [
        (p(r"(?P<y>\d{4}|\d{2})年(?:(?P<m>0?[1-9]|1[0-2])月)?(?:(?P<d>0?[1-9]|[12]\d|30|31)(?P<w>[日号]))?"), _ymd),
        (p(r"(?P<y>\d{4})([- /.])(?P<m>0[1-9]|1[012])\2(?P<d>0[1-9]|[12]\d|3[01])"), _ymd),
        # whether a range's second time is half past is judged by the first minute; results must keep that
        (p(rf"{_T}[~-]{_T}"), lambda m: _clock(m[1], m[2], m[3], m[2]) + "至" + _clock(m[4], m[5], m[6], m[2])),
        (p(_T), lambda m: _clock(m[1], m[2], m[3], m[2])),
        (p(rf"(?:{_N}|\.\d+)(?:{_U})~(?:{_N}|\.\d+)(?:{_U})"), lambda m: m[0].replace("~", "至")),
        (p(r"(-?\d+(?:\.\d+)?)(°C|℃|度|摄氏度)"), lambda m: _signed(m[1], "零下") + ("摄氏度" if m[2] == "摄氏度" else "度")),
        (None, _units),
        (p(r"(-?)(\d+)/(\d+)"), lambda m: ("负" if m[1] else "") + number(m[3]) + "分之" + number(m[2])),
        (p(r"(-?)(\d+(?:\.\d+)?)%"), lambda m: ("负" if m[1] else "") + "百分之" + number(m[2])),
        (p(MOBILE), lambda m: "，".join(digits(g, True) for g in m[0].strip("+").split())),
        (p(LANDLINE), lambda m: "，".join(digits(g, True) for g in m[0].split("-"))),
        (p(SERVICE), lambda m: "，".join(digits(g, True) for g in m[0].split("-"))),
        (p(rf"(?<![\d+\-×÷=])({_N})[-~]({_N})(?![\d+\-×÷=])"), lambda m: _signed(m[1]) + "到" + _signed(m[2])),
        (None, _arithmetic),
        (p(r"-(\d+)"), lambda m: "负" + number(m[1])),
        (p(r"(-?\d+\.\d+)|(\.\d+)"), lambda m: _signed(m[0])),
        (p(rf"(\d+)([多余几+]?)({many})"), lambda m: number(m[1]) + m[2].replace("+", "多") + m[3]),
        (p(r"\d{3,}"), lambda m: digits(m[0], True)),
        (p(rf"{_N}|\.\d+"), lambda m: _signed(m[0])),
        (None, post_replace),
    ]


_HALF = str.maketrans({0xFF00 + c - 0x20: chr(c) for c in range(0x30, 0x7B) if chr(c).isalnum()} | {0x3000: " "})
_RULES = rules()


def normalise_sentence(x: str, steps: list | None = None, simple: dict[int, str] | None = None) -> str:
    """Traditional characters to simplified ones by a table, letters, digits and blanks to half width (no other signs), then every step in order."""
    x = x.translate(simple or {}).translate(_HALF)
    for rule, said in steps or _RULES:
        x = rule.sub(said, x) if rule else said(x)
    return x


def sentences(x: str) -> list[str]:
    """Sentences without blanks and special characters; a mark, with a closing quote if one follows, ends one."""
    x = re.sub(DROPPED, "", x.replace(" ", ""))
    return [s.strip() for s in re.split(r"\n+", re.sub(r"([：、，；。？！,;?!][”’]?)", r"\1\n", x).strip())]


def normaliser(pairs: list[tuple[str, str]] | tuple[()] = (), measures: list[str] = MEASURES) -> Callable[..., Column]:
    """A function of a text column that gives its normalised sentences, null for null. pairs: traditional and simplified characters, of repeated ones the last counts; measures: words that may stand behind a number."""
    simple = {ord(a): b for a, b in pairs}

    @pandas_udf(ArrayType(StringType()))
    def normalised(text: pd.Series) -> pd.Series:
        steps = _RULES if measures is MEASURES else rules(measures)
        return pd.Series([None if t is None else [normalise_sentence(s, steps, simple) for s in sentences(t)] for t in text], dtype=object)

    return normalised


normalise = normaliser()


def spoken_text(text: Column, normalised: Callable[..., Column] = normalise) -> Column:
    """A text as the phoneme stage takes it: its normalised sentences, with the punctuation of that stage, in one."""
    return F.array_join(F.transform(normalised(text), phoneme_punctuation), "")


# ---- native steps ----

def half_width(c: Column) -> Column:
    """Full-width letters and digits to half width; blanks and signs stay."""
    ascii_ = "".join(chr(x) for x in range(0x30, 0x7B) if chr(x).isalnum())
    return F.translate(c, "".join(chr(ord(x) + 0xFEE0) for x in ascii_), ascii_)


def unit_names(c: Column) -> Column:
    """Every unit notation as a word, wherever it stands, one after the other."""
    for u, said in UNITS.items():
        c = F.replace(c, F.lit(u), F.lit(said))
    return c


def said_signs(c: Column) -> Column:
    """post_replace, natively."""
    for u, said in [("/", "每"), *((g, s) for gs, s in GREEK.items() for g in gs), ("⑩", "十")]:
        c = F.replace(c, F.lit(u), F.lit(said))
    return F.regexp_replace(F.translate(c, CIRCLED[:9], DIGITS[1:]), r"[-—《》【】<=>{}()（）#&@“”^_|\\]", "")


def phoneme_punctuation(c: Column) -> Column:
    """The punctuation of the phoneme stage; nothing but Han characters and it is left."""
    c = F.replace(F.replace(c, F.lit("嗯"), F.lit("恩")), F.lit("呣"), F.lit("母"))
    for a, b in PUNCTUATION.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, rf"[^一-龥{re.escape(KEPT)}]+", "")


def phone_sentences(c: Column) -> Column:
    """Sentences that keep their mark; blank ones are dropped."""
    return F.filter(F.split(c, rf"(?<=[{re.escape(KEPT)}])\s*"), lambda s: F.trim(s) != "")


def simplified(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Characters replaced by a table of pairs; of repeated ones the last counts."""
    last = dict(pairs)
    return F.translate(c, "".join(last), "".join(last.values()))
