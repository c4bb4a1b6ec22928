"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words from a weighted share of a budget, never above ``max_repeat`` times its
own size. Documents of a source have the same expected number of copies r = target / size. They stand in an order
that runs from small to large documents; one random offset u is added to the running sum of expected copies, and a
document is emitted once for each integer boundary that its interval crosses: floor(u + r*i) - floor(u + r*(i-1)).
The order by size keeps the taken words near the target, since each size class is sampled evenly.

Ranks come from three windows over bounded partitions: size classes within a source (at most some hundred rows), salts
within a class (``salts`` rows) and rows within a salt, so that no source, however large, is sorted by one task. A salt
follows from id and text, so rows without an id are spread as others are. Texts are split into words once, into a narrow
table of keys; targets and ranks come from it.

Defined cases: null text has size 0; null source is a source of its own, last in order; an empty table gives an empty
result; rows equal in id, source and text have places one after another, are counted before the shuffle, and come out
of ``mixed_documents`` as copies of one of them; other columns pass through it, whatever their names; a source of size 0
has target 0 and its documents are not taken.
Reruns agree: order and offset depend on ids, texts and the seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, stored

#: Rows of one salt that a task sorts at most, if all rows are alike.
ROWS_PER_SALT = 400_000
#: Salts at least.
SALTS = 128


def n_words(col: str = "text") -> Column:
    """Number of words between the six ASCII white-space characters, null: 0."""
    return F.coalesce(F.regexp_count(F.col(quoted(col)), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), budget: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """``sizes`` (source, total) with the target of each source; one row for each source.

    Filling up: with sources in order of cap / weight, the first k are at their cap, where k is the largest number for
    which the level of the rest still reaches the k-th one's cap. That is the end state of sharing the excess again
    and again by weight. All sums are of whole numbers, so that reruns agree to the last bit.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("weight", pick.cast("long")).withColumn("cap", max_repeat * F.col("total"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    want = F.lit(budget) * F.sum("total").over(Window.partitionBy())
    full = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumns({"want": want, "full": full, "rest": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("level", (F.col("want") - F.col("full")) / F.col("rest"))
    # the level after all sources at their cap: that of the first one below its cap; later ones count it as full, so theirs
    # are lower
    below = F.col("level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("end", F.max(F.when(below, F.col("level"))).over(Window.partitionBy()))
    return s.select("source", "total", F.when(below, F.col("end") * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"))


def mix_keys(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", weights=(3, 1, 2), budget: float = 1.5, max_repeat: int = 2, seed: str = "mix-1") -> DataFrame:
    """A row for each document, that is, id, source and text: doc_id, source, tie (a hash of the text), size, total (of the
    source), target, rows (how many have it) and copies (an array: what each of these takes)."""
    hexadecimal = lambda c: F.conv(F.substring(c, 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(source)).alias("source"), n_words(text).alias("size"), F.md5(F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary")).alias("tie"))
    rows = stored(rows.groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("rows")), "mix-keys")
    salts = max(SALTS, -(-(rows.agg(F.sum("rows")).first()[0] or 0) // ROWS_PER_SALT))
    h = hexadecimal(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "tie")))
    rows = rows.withColumns({"class": F.floor(4 * F.log2(F.col("size") + F.lit(1.0))).cast("int"), "salt": h % F.lit(salts)})

    cells = rows.groupBy("source", "class", "salt").agg(F.sum("rows").alias("n"), F.sum(F.col("size") * F.col("rows")).alias("words"))
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("total")), weights, budget, max_repeat)
    up_to = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def joined(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
        on = F.lit(True)
        for n in names:
            on = on & F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
        return left.alias("l").join(right.alias("r"), on).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in names])

    classes = classes.withColumn("class_from", up_to("n", Window.partitionBy("source").orderBy("class"))).select("source", "class", "class_from")
    cells = cells.withColumn("salt_from", up_to("n", Window.partitionBy("source", "class").orderBy("salt"))).select("source", "class", "salt", "salt_from")
    cells = joined(cells, joined(classes, targets, ["source"]), ["source", "class"])
    rank = up_to("rows", Window.partitionBy("source", "class", "salt").orderBy("size", "doc_id", "tie"))
    rows = joined(rows.withColumn("rank", rank), cells, ["source", "class", "salt"])
    offset = hexadecimal(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("source"), F.lit(""))))).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"offset": offset, "rate": rate, "before": F.col("class_from") + F.col("salt_from") + F.col("rank")})

    def crossed(k):
        at = (F.col("before") + k).cast("double")
        return (F.floor(F.col("offset") + F.col("rate") * at) - F.floor(F.col("offset") + F.col("rate") * (at - F.lit(1.0)))).cast("long")

    return rows.select("doc_id", "source", "tie", "size", "total", "target", "rows", F.transform(F.sequence(F.lit(1).cast("long"), "rows"), crossed).alias("copies"))


def mixed_documents(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    own_id, own_source, own_tie, times, time, one = fresh(docs.columns, "own_id", "own_source", "own_tie", "times", "time", "one")
    copies = F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x).cast("int")
    taken = mix_keys(docs, source, doc_id, text, **options).select(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("tie").alias(own_tie), F.col("rows").alias(one), copies.alias(times)).where(F.col(times) > 0)
    tie = F.md5(F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary"))
    on = F.col(quoted(doc_id)).eqNullSafe(F.col(own_id)) & F.col(quoted(source)).eqNullSafe(F.col(own_source)) & (tie == F.col(own_tie))
    columns = [F.col(quoted(c)) for c in docs.columns]
    alone = docs.join(taken.where(F.col(one) == 1), on).select(*columns, times)
    # of equal rows one is enough: chosen before the shuffle, so none of them meet
    equal = docs.join(taken.where(F.col(one) > 1), on).groupBy(own_id, own_source, own_tie).agg(F.first(F.struct(*columns, times)).alias(one)).select(f"{one}.*")
    return alone.unionByName(equal).withColumn(time, F.explode(F.sequence(F.lit(1), times))).select(*columns)
