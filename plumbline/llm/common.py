"""Shared pieces of the training-data operators: shared storage, word hashing, window hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that separate words.
WHITE = b" \t\n\x0b\x0c\r"
U64 = np.uint64
#: Spark removes the shuffle files of a query when it ends.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_M1, _M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). One is made only where none is set and driver
    and executors are one process; elsewhere its absence is an error."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = getattr(sc, "_plumbline_shared", None) or tempfile.mkdtemp(prefix="plumbline-")
        sc._plumbline_shared = place
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(place)
    return place


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage ends there.

    A lost executor costs nothing of it. The shuffle files of the write go with its end; ``dropped`` removes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._plumbline_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def joined_by_key(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` inner joined with ``table``, which has one row for each key and in ``n`` the number of rows that have it.

    Keys of more than one in ``share`` of ``total`` rows, of which there are fewer than ``share``, are broadcast, so that
    no task gets a hot one; the others are shuffled.
    """
    hot = F.broadcast(table.where(F.col(n) * share > total).drop(n))
    cold = table.where(F.col(n) * share <= total).drop(n)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Each of ``names`` with underscores before it until no column of ``taken`` (of any letter case) is called so."""
    taken = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def with_columns(df: DataFrame, made, rows: int, without: str | None = None, **kinds: str) -> DataFrame:
    """``df`` with further columns of these ``kinds`` from ``made()``, which is called for each partition and gives a
    function of a batch (its columns in order) to a list of arrays. Batches have at most so many ``rows``. Columns keep
    their names, whatever these are: they are numbered on the way. The column ``without`` isn't sent back."""
    names = [f"c{k}" for k in range(len(df.columns) + len(kinds))]
    kept = [k for k, c in enumerate(df.columns) if c != without]
    types = [*(f.dataType.simpleString() for f in df.schema.fields), *kinds.values()]
    back = [*kept, *range(len(df.columns), len(names))]

    def run(batches):
        step = made()
        try:
            for batch in batches:
                for part in slices(batch, rows):
                    columns = [*part.columns, *step(part.columns)]
                    yield pa.RecordBatch.from_arrays([columns[k] for k in back], [names[k] for k in back])
        finally:
            step = None
            gc.enable()  # where ``made`` has turned it off
            give_back()

    out = df.toDF(*names[: len(df.columns)]).mapInArrow(run, ", ".join(f"{names[k]} {types[k]}" for k in back))
    return out.toDF(*[df.columns[k] for k in kept], *kinds)


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_ids(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def windows(ids: np.ndarray, k: int, mult: int = _M1) -> np.ndarray:
    """Hashes of all ``k`` consecutive ids (polynomial mod 2^64 of 64-bit word hashes, then mixed)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    cur, have = ids, 1
    power = lambda e: U64(pow(mult, e, 1 << 64))
    with np.errstate(over="ignore"):
        for bit in bin(k)[3:]:
            cur, have = cur[:-have] * power(have) + cur[have:], have * 2
            if bit == "1":
                cur, have = cur[:-1] * power(1) + ids[have:], have + 1
        return mixed(cur[:n])


def second_windows(ids: np.ndarray, k: int) -> np.ndarray:
    """A second, independent family of window hashes."""
    with np.errstate(over="ignore"):
        return windows(mixed(ids ^ U64(0xA5A5A5A55A5A5A5A)), k, _M2)


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask of ``n`` words covered by windows of ``k`` words at ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + k, -1)
    return np.cumsum(step[:n]) > 0


def slices(batch: pa.RecordBatch, rows: int = 256):
    """A batch in slices of ``rows``: what is held as Python objects at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def give_back() -> None:
    """Return freed memory to the system: Python workers wait for other tasks and are not ended meanwhile."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is free within its heap
        trim(0)


def chunks(batches, limit: int, size=lambda row: len(row[1])):
    """Rows of Arrow batches as tuples, in lists of at most ``limit`` in size (a larger row alone)."""
    held, total = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            s = size(row)
            if held and total + s > limit:
                yield held
                held, total = [], 0
            held.append(row)
            total += s
    if held:
        yield held
