"""Choice of tokens by probability: top-k, nucleus, greedy, weighted draw, penalties."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(df: DataFrame, group: list[str], logit: str, temperature: float = 1.0) -> DataFrame:
    """df with p, the softmax of the logits of each group; null logits take no part."""
    w = Window.partitionBy(*group)
    x = F.exp((F.col(logit) - F.max(logit).over(w)) / temperature)
    return df.where(F.col(logit).isNotNull()).withColumn("_x", x).withColumn("p", F.col("_x") / F.sum("_x").over(w)).drop("_x")


def top_k(df: DataFrame, group: list[str], p: str, k: int) -> DataFrame:
    """Rows whose probability is at least the k-th largest of the group (ties stay, so more than k may), with p made to sum to 1."""
    kept = df.withColumn("_r", F.rank().over(Window.partitionBy(*group).orderBy(F.desc(p)))).where(F.col("_r") <= k).drop("_r")
    return kept.withColumn(p, F.col(p) / F.sum(p).over(Window.partitionBy(*group)))


def top_p(df: DataFrame, group: list[str], p: str, least: float, tie: str) -> DataFrame:
    """Rows in falling probability while those before sum to at most least, with p made to sum to 1; ties by tie."""
    w = Window.partitionBy(*group).orderBy(F.desc(p), tie).rowsBetween(Window.unboundedPreceding, 0)
    kept = df.withColumn("_c", F.sum(p).over(w) - F.col(p)).where(F.col("_c") <= least).drop("_c")
    return kept.withColumn(p, F.col(p) / F.sum(p).over(Window.partitionBy(*group)))


def greedy(df: DataFrame, group: list[str], p: str, token: str) -> DataFrame:
    """The token of the highest probability of each group, of equal ones the smallest."""
    return df.where(F.col(p).isNotNull()).groupBy(*group).agg(F.max_by(token, F.struct(F.col(p), -F.col(token))).alias(token))


def draw(df: DataFrame, group: list[str], p: str, token: str, uniform: str) -> DataFrame:
    """The token at which the cumulative probability passes the group's uniform number."""
    w = Window.partitionBy(*group).orderBy(token).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(p).over(Window.partitionBy(*group))
    at = df.withColumn("_c", F.sum(p).over(w) / total).where(F.col("_c") > F.col(uniform))
    return at.groupBy(*group).agg(F.min(token).alias(token))


def choose(df: DataFrame, group: list[str], logit: str, token: str, temperature: float = 1.0, k: int = 0, nucleus: float = 0.0, sample: bool = True) -> DataFrame:
    """The tokens left to draw from: greedy if not sampling or without temperature, else nucleus if set, else top-k if set, else all."""
    if not sample or temperature <= 0:
        return greedy(softmax(df, group, logit), group, "p", token)
    p = softmax(df, group, logit, temperature)
    if nucleus > 0:
        return top_p(p, group, "p", nucleus, token)
    return top_k(p, group, "p", k) if k > 0 else p


def repetition_window(df: DataFrame, group: str, pos: str, token: str, size: int = 50, eos: int | None = None) -> DataFrame:
    """df with pool, the distinct tokens among the size rows before each row of its group, in order; with eos, rows that aren't there yet count as eos."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(-size, -1)
    pool = F.collect_set(token).over(w)
    if eos is not None:
        pool = F.when(F.count(F.lit(1)).over(w) < size, F.array_union(pool, F.array(F.lit(eos)))).otherwise(pool)
    return df.withColumn("pool", F.array_sort(pool))


def penalised(logit: Column, token: Column, pool: Column, eos: int, penalty: float = 1.1) -> Column:
    """A logit divided by the penalty if its token is in the pool and isn't eos; so a negative one becomes likelier."""
    return F.when(F.array_contains(pool, token) & (token != eos), logit / penalty).otherwise(logit)


def guided(free: Column, conditional: Column, weight: float) -> Column:
    """free + (conditional - free) * weight, by element."""
    return F.zip_with(free, conditional, lambda u, c: u + (c - u) * weight)
