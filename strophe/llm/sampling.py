"""A sample that stays as data grows, by a Feistel permutation of identifiers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.operators.arrays import let

#: Bits of half an identifier; the domain has 2 ** (2 * HALF) identifiers.
HALF = 30
# Multipliers (odd, under 2**31) and addends of the rounds.
ROUNDS = ((1540483477, 40503), (2027808485, 65599), (1812433253, 69069), (1103515245, 12345))
# Fixed value: idx that stand for none.
PLACEHOLDERS = ("untitled",)
_MASK = (1 << HALF) - 1


def identifier(idx: Column, row: Column) -> Column:
    """The number of a record in the domain: 60 bits of the MD5 of its idx, or, where that is null, blank or a placeholder, of its row id."""
    x = F.trim(idx)
    real = x.isNotNull() & (x != "") & ~F.lower(x).isin(*PLACEHOLDERS)
    own = F.when(real, F.concat(F.lit("i:"), x)).otherwise(F.concat(F.lit("r:"), row.cast("string")))
    return F.conv(F.substring(F.md5(own), 1, 15), 16, 10).cast("bigint")


def _bound(turn, k: int, c: int):
    return lambda state: turn(state, k, c)


def permuted(n: Column) -> Column:
    """The identifier's image under a fixed permutation of the domain: one-to-one, without state."""

    def halves(left: Column, right: Column) -> Column:
        return F.struct(left.alias("left"), right.alias("right"))

    def turn(state: Column, k: int, c: int) -> Column:
        y = state["right"] * F.lit(k).cast("bigint") + F.lit(c).cast("bigint")
        return halves(state["right"], state["left"].bitwiseXOR(y.bitwiseXOR(F.shiftright(y, 17)).bitwiseAND(F.lit(_MASK))))

    # each round names the one before three times; bound, it is computed once
    state = let(n, lambda x: halves(F.shiftright(x, HALF), x.bitwiseAND(F.lit(_MASK))))
    for k, c in ROUNDS:
        state = let(state, _bound(turn, k, c))
    return let(state, lambda s: F.shiftleft(s["left"], HALF).bitwiseOR(s["right"]))


def sample(df: DataFrame, rate: float, idx: str = "idx", row: str = "row_id") -> DataFrame:
    """The rows of df whose permuted identifier lies under rate times the size of the domain.

    Whether a row is chosen depends on its idx alone (on its row id where it has no
    real idx; null then is one identifier), so all records of an idx are chosen
    together, a rerun or another partitioning chooses the same rows, new rows don't
    displace old ones, and a larger rate chooses more of the same. Rate 0 chooses
    none, 1 all. Columns stay as they are. A filter: no shuffle, no Python.
    """
    if not 0 <= rate <= 1:
        raise ValueError(f"rate {rate} isn't between 0 and 1")
    chosen = permuted(identifier(F.col(idx), F.coalesce(F.col(row).cast("string"), F.lit("null"))))
    return df.where(chosen < F.lit(int(rate * (1 << 2 * HALF))).cast("bigint"))


def sql(rate: float, table: str = "songs") -> str:
    """SQL (DuckDB) for row_id and idx of the sample of songs."""
    x = "trim(idx)"
    own = f"CASE WHEN {x} IS NOT NULL AND {x} <> '' AND lower({x}) NOT IN ({', '.join(repr(p) for p in PLACEHOLDERS)}) THEN 'i:' || {x} ELSE 'r:' || row_id END"
    q = f"SELECT row_id, idx, CAST('0x' || substr(md5({own}), 1, 15) AS BIGINT) AS n FROM {table}"
    q = f"SELECT row_id, idx, n >> {HALF} AS l, n & {_MASK} AS r FROM ({q})"
    for k, c in ROUNDS:
        y = f"(r * {k} + {c})"
        q = f"SELECT row_id, idx, r AS l, xor(l, xor({y}, {y} >> 17) & {_MASK}) AS r FROM ({q})"
    return f"SELECT row_id, idx FROM ({q}) WHERE (l << {HALF} | r) < {int(rate * (1 << 2 * HALF))}"
