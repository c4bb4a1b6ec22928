"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source; row i of n gets the fractional rank (i - 1/2) / n. In the order
of fractional ranks every stretch holds the sources in their proportions, and cuts at equal counts give shards that
match the mixture, with counts at most one apart (law ``rows``).

No source is sorted by one task: ranks within a source add a running count over hash ranges to a row number within a
range, and places in the whole order add a running count over equal ranges of fractional ranks to a row number within
a range. Both are even by construction, whatever a source holds. Texts are read once, into a narrow table of keys on
which everything else runs. The shuffle's hash is of id and text, so rows without an id are spread as others are.

Defined cases: null source is a source of its own; null text counts no bytes; an empty table gives an empty result;
rows repeated with one id get places of their own; null and repeated ids are told apart by their texts; columns other
than those named are not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stored

#: Rows in a hash range that one task sorts, about.
ROWS_PER_RANGE = 400_000
#: Ranges at least, which is what small inputs are cut into.
RANGES = 64


def interleave(docs: DataFrame, shards: int = 40, source: str = "source", doc_id: str = "doc_id", text: str = "text", seed: str = "shard-1") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(source)).alias("source"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    shuffled = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text_crc32").cast("string")))
    rows = stored(rows.withColumn("h", shuffled), "shard-keys")
    total = rows.count()
    ranges = max(RANGES, -(-total // ROWS_PER_RANGE))
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * ranges / F.lit(4294967296.0)).cast("long"))
    cells = rows.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))
    by_range = Window.partitionBy("source").orderBy("range")
    before = F.coalesce(F.sum("n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("from", before).withColumn("all", F.sum("n").over(Window.partitionBy("source"))).drop("n")
    inner = Window.partitionBy("source", "range").orderBy("h", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("rank", F.row_number().over(inner))
    rows = rows.alias("l").join(cells.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.range") == F.col("r.range"))).select("l.*", "r.from", "r.all")
    rows = rows.withColumn("frac", (F.col("from") + F.col("rank") - F.lit(0.5)) / F.col("all"))
    rows = rows.withColumn("part", F.floor(F.col("frac") * ranges).cast("long"))
    # how many rows each range of fractional ranks holds; as many rows as there are ranges
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", start.alias("start"))
    order = Window.partitionBy("part").orderBy("frac", F.col("source").asc_nulls_last(), "h", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("at", F.row_number().over(order) - 1).join(parts, "part").withColumn("place", (F.col("start") + F.col("at")).cast("long"))
    # shard k has the places from ceil(k * total / shards) on
    shard = F.floor(F.col("place") * shards / F.lit(max(total, 1))).cast("int")
    rows = rows.withColumn("shard", F.least(shard, F.lit(shards - 1)))
    first = F.ceil(F.col("shard").cast("long") * F.lit(max(total, 1)) / F.lit(float(shards))).cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: The same places by one sort of all rows. CRC-32 comes from its table, made by the polynomial.
ORACLE = r"""
WITH t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
b AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM b, t),
h AS (SELECT *, md5('shard-1|' || coalesce(doc_id::VARCHAR, '-') || '|' || crc::VARCHAR) AS h FROM c),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, crc, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS frac, count(*) OVER () AS n FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY frac, source NULLS LAST, h, doc_id, crc, size) - 1 AS place FROM r),
s AS (SELECT *, least(floor(place * 40 / n::DOUBLE), 39)::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard, (place - ceil(shard * n / 40::DOUBLE))::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""
