"""Measuring rules: as few passes over the data as the rule set allows.

All row predicates and all scalar aggregates of a rule set share one aggregation. Every field with cardinality, entropy
or information gain rules costs one grouped pass that serves all three, and every distinct set of uniqueness keys costs
one; grouped counts are combined before the shuffle, so hot keys stay cheap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import named

SCALARS = {"has_min": F.min, "has_max": F.max, "has_sum": F.sum, "has_mean": F.avg, "has_std": F.stddev_samp}
GROUPED = ("has_cardinality", "has_entropy", "has_infogain")


def fused(df: DataFrame, violations: list[Column], scalars: list[tuple[str, str]]) -> tuple[int, list[int], list]:
    """(rows, violating rows of each predicate, value of each (check, field)) from a single aggregation."""
    cols = [F.count(F.lit(1)).alias("total")]
    cols += [F.count_if(v).alias(f"v{i}") for i, v in enumerate(violations)]
    cols += [SCALARS[check](named(field)).alias(f"s{i}") for i, (check, field) in enumerate(scalars)]
    row = df.agg(*cols).first()
    return row[0], list(row[1 : 1 + len(violations)]), list(row[1 + len(violations) :])


def spread(df: DataFrame, field: str) -> dict[str, float]:
    """Cardinality, entropy (bits) and entropy over its maximum of one column, from grouped counts in one pass.

    With group sizes n, their sum N and k groups: H = log2 N - sum(n log2 n) / N. NULL is no value; NaN counts for
    the cardinality alone.
    """
    kind = df.schema[next(c for c in df.columns if c.lower() == field.lower())].dataType.typeName()
    nan = F.isnan("v") if kind in ("float", "double") else F.lit(False)
    counts = df.select(named(field).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    n = F.when(~nan, F.col("n"))
    distinct, k, total, weighted = counts.agg(F.count(F.lit(1)), F.count(n), F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(n * F.log2(n)), F.lit(0.0))).first()
    entropy = max(0.0, math.log2(total) - weighted / total) if total else 0.0
    return {"has_cardinality": float(distinct), "has_entropy": entropy, "has_infogain": entropy / math.log2(k) if k > 1 else 0.0}


def duplicate_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Key tuples (k0, k1, ...) of more than one row, with their number n. NULL equals NULL."""
    counts = df.select(*[named(k).alias(f"k{i}") for i, k in enumerate(keys)]).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1")


def marked_duplicates(df: DataFrame, keys: tuple[str, ...], dup: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean column: whether another row has the same keys; ``dup`` are the repeated ones.

    A join with the repeated keys, not a window: the keys are counted before they are shuffled, few of them repeat as
    a rule, so Spark may broadcast them by their measured size, and a hot key's rows can be split over tasks.
    """
    dup = dup.select(*[F.col(f"k{i}").alias(f"{flag}_k{i}") for i in range(len(keys))], F.lit(True).alias(flag))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & named(k).eqNullSafe(F.col(f"{flag}_k{i}"))
    return df.join(dup, cond, "left").drop(*[f"{flag}_k{i}" for i in range(len(keys))]).withColumn(flag, F.coalesce(flag, F.lit(False)))
