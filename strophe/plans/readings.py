"""SQL (DuckDB) for the readings of numbers, written apart from the expressions it checks."""

from strophe.functions import chinese


def digits_sql(x: str, telephone: bool = False) -> str:
    """Digits read one by one; by telephone a one is 幺."""
    return f"translate({x}, '0123456789', '{chinese.DIGITS.replace('一', '幺') if telephone else chinese.DIGITS}')"


def _group_sql(g: str, zero: str, before: str) -> str:
    """Four digits g; zero: whether 零 goes before a leading thousand; before: whether any digit stands before the group."""
    parts = []
    for k, place in enumerate(chinese.PLACES):
        d = f"substr({g}, {k + 1}, 1)"
        gap = zero if k == 0 else f"(substr({g}, {k}, 1) = '0' AND ({before} OR substr({g}, 1, {k}) <> '{'0' * k}'))"
        parts.append(f"CASE WHEN {d} = '0' THEN '' ELSE concat(CASE WHEN {gap} THEN '零' ELSE '' END, translate({d}, '0123456789', '{chinese.DIGITS}'), '{place}') END")
    return f"concat({', '.join(parts)})"


def cardinal_sql(x: str) -> str:
    """A string of up to 12 digits as a cardinal: one 零 for a run of inner zeros, none at a group's end, 十 for a leading 一十."""
    p = f"lpad({x}, 12, '0')"
    a, b, c = (f"substr({p}, {i}, 4)" for i in (1, 5, 9))
    high = f"CASE WHEN {a} = '0000' THEN '' ELSE concat({_group_sql(a, 'false', 'false')}, '亿') END"
    mid = f"CASE WHEN {b} = '0000' THEN '' ELSE concat({_group_sql(b, 'false', f'{a} <> ' + chr(39) + '0000' + chr(39))}, '万') END"
    low = f"CASE WHEN {c} = '0000' THEN '' ELSE {_group_sql(c, f'({a} <> ' + chr(39) + '0000' + chr(39) + f' AND {b} = ' + chr(39) + '0000' + chr(39) + ')', f'substr({p}, 1, 8) <> ' + chr(39) + '00000000' + chr(39))} END"
    whole = f"concat({high}, {mid}, {low})"
    return f"CASE WHEN {x} = '' THEN '' WHEN {p} = '000000000000' THEN '零' ELSE regexp_replace({whole}, '^一十', '十') END"


def number_sql(whole: str, decimals: str) -> str:
    """A cardinal with 点 and its decimals, without their trailing zeros."""
    d = f"regexp_replace({decimals}, '0+$', '')"
    return f"concat(CASE WHEN {whole} = '' AND {d} <> '' THEN '零' ELSE {cardinal_sql(whole)} END, CASE WHEN {d} = '' THEN '' ELSE concat('点', {digits_sql(d)}) END)"
