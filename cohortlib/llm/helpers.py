"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlib.session import shared_dir, tune

#: A word is a run of anything but ASCII white space; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch: texts may be long, and both sides of the pipe hold whole batches.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Spark deletes the files of a query's exchanges when it ends, and not only when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once below ``spark.checkpoint.dir`` and read it back: it cuts the lineage, survives lost
    executors, and tells the planner its true size. The files of the exchanges it came from are deleted with the write."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}/{name}"
    former = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if former is None else spark.conf.set(CLEANUP, former)
    _written.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


class _Written(threading.local):
    """Of each thread, so that none deletes what another one wrote."""

    def __init__(self):
        self.paths: list[str] = []


_written = _Written()


def written_since(mark: int) -> list[str]:
    """Folders that ``stage`` has written since it had written ``mark`` of them."""
    return _written.paths[mark:]


def n_written() -> int:
    return len(_written.paths)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stages(spark: SparkSession) -> None:
    """Delete what ``stage`` wrote for this application; call it when no result of it is needed any more."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/llm")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, f"{spark.sparkContext.applicationId}-*"))
    for status in found or []:
        fs.delete(status.getPath(), True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def raw_text(column: str | Column = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def fold(column: str = "doc_id", mod: int = 7) -> Column:
    """crc32 of the id as text, modulo ``mod`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def chunks(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Regroup batches into pieces of about ``most_bytes`` of one binary column (one long row may exceed it)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start, length = 0, batch.num_rows
        if not length:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        while start < length:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - base)
            start = stop
            if size >= most_bytes:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows that agree in the first ``keys`` columns; rows must come sorted by them."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(pair) for pair in zip(held, cols, strict=True)]
        change = np.zeros(len(cols[0]) - 1, bool)
        for c in cols[:keys]:
            change |= c[1:] != c[:-1]
        cuts = (np.flatnonzero(change) + 1).tolist()
        for a, b in zip([0, *cuts], cuts, strict=False):
            yield [c[a:b] for c in cols]
        held = [c[cuts[-1] if cuts else 0:] for c in cols]
    if held is not None:
        yield held


def running_totals(rows: DataFrame, by: list[Column], totals: dict[str, str]) -> DataFrame:
    """``rows`` with exclusive running sums in the order ``by``; ``totals`` names the new columns and what they add up.

    Rows are range-partitioned, sorted and written; each partition adds up its own rows, and one row for each partition
    gives the offsets. No key gathers in one task, however frequent: ``by`` has to tell rows apart, except rows that
    may be exchanged for each other."""
    part, *inner = fresh(rows, "part", *(f"inner_{t}" for t in totals))
    n = partitions(rows.sparkSession)
    placed = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(part, F.spark_partition_id())
    placed = stage(placed, "placed")
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)          # over at most n rows
    sums = placed.groupBy(part).agg(*(F.sum(size).alias(i) for i, size in zip(inner, totals.values(), strict=True)))
    offsets = sums.select(part, *(F.coalesce(F.sum(i).over(earlier), F.lit(0)).alias(t) for i, t in zip(inner, totals, strict=True)))
    within = Window.partitionBy(part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select("*", *(F.coalesce(F.sum(size).over(within), F.lit(0)).alias(i)
                                  for i, size in zip(inner, totals.values(), strict=True)))
    return summed.join(F.broadcast(offsets), part).select(
        *rows.columns, *((F.col(i) + F.col(t)).alias(t) for i, t in zip(inner, totals, strict=True)))
