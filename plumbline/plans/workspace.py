"""A folder that driver and executors share, for streams' checkpoints and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir. Where that isn't set, a temporary folder if driver and executors are one
    process; else an error, since executors don't share such a folder."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="plumbline-")
    return f"{place}/{name}-{uuid.uuid4().hex}"
