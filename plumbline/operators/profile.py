"""Column profiles of a dataset in two passes, whatever the number of columns.

One aggregation has the counts and statistics. Distinct values of all columns are counted together: each row gives a pair
(column, 128-bit hash of the value) for each of its values, pairs are made distinct on each task before they are
shuffled, and the shuffle carries 20 bytes a value however long values are. Of a million million different values two
share a hash with odds of one to about 10^14.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import named

SEED = 42
#: What the second half of the hash begins with.
_SECOND = 1_000_003
_STATS = (("min", F.min), ("max", F.max), ("mean", F.avg), ("std_dev", F.stddev_samp), ("sum", F.sum))
#: Spark's own names of the types whose short name in SQL is another.
_NAMES = {"bigint": "long", "int": "integer", "smallint": "short", "tinyint": "byte"}


@dataclass(frozen=True)
class ColumnProfile:
    type: str
    nullable: bool
    row_count: int
    completeness: float
    distinct_count: int
    null_count: int
    uniqueness: float
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    std_dev: float | None = None
    sum: float | None = None


@dataclass(frozen=True)
class ProfileReport:
    table_stats: dict[str, Any]
    column_profiles: dict[str, ColumnProfile]

    def to_map(self) -> dict[str, Any]:
        return {"table_stats": self.table_stats, "column_profiles": {k: asdict(v) for k, v in self.column_profiles.items()}}

    def to_json(self) -> str:
        return json.dumps(self.to_map())

    def to_frame(self, spark: SparkSession) -> DataFrame:
        kinds = {"str": "string", "bool": "boolean", "int": "long"}
        fields = ", ".join(f"`{n}` {kinds.get(a, 'double')}" for n, a in ColumnProfile.__annotations__.items())
        return spark.createDataFrame([(k, *asdict(v).values()) for k, v in self.column_profiles.items()], f"column string, {fields}")


def profile(df: DataFrame, sample_fraction: float | None = None) -> ProfileReport:
    """Counts of nulls and distinct values of every column; minimum, maximum, mean, deviation and sum of numeric ones.

    A fraction between 0 and 1 profiles a sample (fixed seed); otherwise all rows are read.
    """
    began = time.time()
    if sample_fraction is not None and 0 < sample_fraction < 1:
        df = df.sample(sample_fraction, SEED)
    cols, fields = [F.count(F.lit(1)).alias("n")], df.schema.fields
    numeric = [isinstance(f.dataType, T.NumericType) for f in fields]
    for i, f in enumerate(fields):
        c = named(f.name)
        cols.append(F.count(c).alias(f"c{i}"))
        cols += [fn(c).cast("double").alias(f"{name}{i}") for name, fn in _STATS if numeric[i]]
    row, different = df.agg(*cols).first().asDict(), distinct_counts(df)
    n, out = row["n"], {}
    for i, f in enumerate(fields):
        stats = {name: row[f"{name}{i}"] for name, _ in _STATS if numeric[i]}
        nulls, kind = n - row[f"c{i}"], f.dataType.simpleString()
        out[f.name] = ColumnProfile(_NAMES.get(kind, kind.split("<")[0]), f.nullable, n, (n - nulls) / n if n else 1.0, different[i], nulls, different[i] / n if n else 0.0, **stats)
    return ProfileReport({"total_rows": n, "columns_count": len(fields), "execution_time_ms": (time.time() - began) * 1000}, out)


def distinct_counts(df: DataFrame) -> list[int]:
    """The number of different values, without NULL, of each column; equal are what grouping has as equal (0.0 and -0.0,
    all NaN)."""

    def pair(i: int, f: T.StructField):
        c = named(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(F.isnan(c), F.lit(float("nan"))).otherwise(c + F.lit(0.0)).cast(f.dataType)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):  # hashes pass over NULL in these, or have no maps
            c = F.to_json(F.struct(c), {"ignoreNullFields": "false"})
        return F.when(named(f.name).isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(c).alias("a"), F.xxhash64(F.lit(_SECOND), c).alias("b")))

    pairs = [pair(i, f) for i, f in enumerate(df.schema.fields)]
    if not pairs:
        return []
    values = df.select(F.explode(F.array(*pairs)).alias("p")).where("p IS NOT NULL").select("p.i", "p.a", "p.b").distinct()
    found = {r.i: r.n for r in values.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(i, 0) for i in range(len(pairs))]
