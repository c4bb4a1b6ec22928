"""Prior strengths of a hierarchy of groups, estimated from the groups themselves.

A child's rate is drawn to its parent's with the weight of ``k`` outcomes, where k = 1 / rho - 1 and rho is the correlation
of outcomes within a child: the one-way analysis of variance of children within their parents, pooled over all parents,
which for outcomes of 0 and 1 is the moment estimate of a beta-binomial. Where children differ no more than chance
makes them, rho falls to its lower bound and children stay near their parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of rho: k is between 1 and 9,999 outcomes.
RHO = (0.0001, 0.5)


def strengths(levels: DataFrame) -> dict[int, float]:
    """``levels``: a row for each child with level (int), parent, n (outcomes), s (their sum) and q (the sum of their
    squares). Returns k of each level that has outcomes; a row for each level comes to the driver."""
    n, s = F.col("n").cast("double"), F.col("s").cast("double")
    parents = (
        levels.where("n > 0")
        .groupBy("level", "parent")
        .agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(n * n).alias("nn"), F.count(F.lit(1)).alias("h"), F.sum(s * s / n).alias("ss"), F.sum(F.col("q") - s * s / n).alias("within"))
    )
    whole = parents.groupBy("level").agg(
        F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("between"),
        F.sum("within").alias("within"),
        (F.sum("h") - F.count(F.lit(1))).alias("df_between"),
        (F.sum("n") - F.sum("h")).alias("df_within"),
        (F.sum("n") - F.sum(F.col("nn") / F.col("n"))).alias("weight"),
    )
    return {r.level: strength(r.between, r.within, r.df_between, r.df_within, r.weight) for r in whole.collect()}


def strength(between: float, within: float, df_between: float, df_within: float, weight: float) -> float:
    rho = RHO[0]
    if df_between > 0 and df_within > 0:
        b, w = between / df_between, within / df_within
        if (total := b + (weight / df_between - 1) * w) > 0:
            rho = min(max((b - w) / total, RHO[0]), RHO[1])
    return 1 / rho - 1


def shrunk(s: Column, n: Column, k: Column, parent: Column) -> Column:
    """The posterior mean of a group."""
    return (s + k * parent) / (n + k)
