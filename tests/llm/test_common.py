"""The shared pieces of the operators."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from plumbline.llm import common


def test_fresh_names():
    assert common.fresh(["a", "_B", "b"], "a", "b", "c", "c") == ["_a", "__b", "c", "_c"]


def test_quoted_names(spark):
    df = spark.createDataFrame([(1,)], "`a.b``c` int")
    assert df.select(F.col(common.quoted("a.b`c"))).columns == ["a.b`c"]


def test_tables_are_stored_and_dropped(spark):
    df = common.stored(spark.range(100).withColumn("k", F.col("id") % 3).groupBy("k").count(), "probe")
    path = df._plumbline_path.removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 3 and spark.conf.get(common.SHUFFLES_END, "false") != "true"
    common.dropped(df)
    assert not os.path.exists(path)


def test_a_shared_folder_is_needed_on_a_cluster():
    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_hot_keys_are_broadcast(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2).where("k <> 2500")
    out = common.joined_by_key(rows, table, "k", "n", 3000)
    assert out.columns == ["k", "id", "v"] and out.count() == 2999 and out.where("v <> 2 * k").count() == 0
    assert out.where("k = 0").count() == 2000


def test_columns_are_added_to_any_names(spark):
    import pyarrow as pa

    df = spark.createDataFrame([(k, str(k)) for k in range(10)], "`x.y` int, `select` string")
    out = common.with_columns(df, lambda: lambda columns: [pa.array([len(s) for s in columns[1].to_pylist()], pa.int32())], 3, without="select", **{"n.n": "int"})
    assert out.columns == ["x.y", "n.n"] and out.count() == 10 and {r["n.n"] for r in out.collect()} == {1}
