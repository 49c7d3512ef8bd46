"""Most frequent values of a column with far more distinct values than memory holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boughline.operators.common import broadcast_up_to, settle

#: Counters per row of the sketch and rows; 8 * WIDTH * DEPTH bytes a task.
WIDTH = 1 << 18
DEPTH = 4
#: Heavy candidates that a task keeps.
HEAP = 1024
#: Rows that a task combines before it sends their counts on.
COMBINE_ROWS = 400_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of values within bounded runs of rows, so that a hot value doesn't travel row by row."""
    held, rows = [], 0

    def counts() -> pa.RecordBatch:
        got = pa.chunked_array(held).combine_chunks().value_counts()
        return pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], names=["value", "n"])

    for batch in batches:
        values = batch.column(0).drop_null()
        if len(values):
            held.append(values)
            rows += len(values)
        if rows >= COMBINE_ROWS:
            yield counts()
            held, rows = [], 0
    if rows:
        yield counts()


class Sketch:
    """Count-min sketch with conservative update, and the heaviest values seen with it.

    An estimate never falls below the true count. ``floor`` bounds the count of
    every value that isn't among the candidates.
    """

    def __init__(self, width: int = WIDTH, depth: int = DEPTH, heap: int = HEAP) -> None:
        self.cells = np.zeros((depth, width), np.int64)
        self.shift = np.uint64(64 - (width.bit_length() - 1))
        self.heap = heap
        self.hashes = np.empty(0, np.uint64)
        self.estimates = np.empty(0, np.int64)
        self.values: pa.Array | None = None
        self.floor = 0

    def update(self, values: pa.Array, hashes: np.ndarray, n: np.ndarray) -> None:
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.bincount(inverse, weights=n, minlength=len(keys)).astype(np.int64)
        at = [((keys ^ (keys >> np.uint64(32))) * _ODD[r]) >> self.shift for r in range(len(self.cells))]
        raised = np.min([row[i] for row, i in zip(self.cells, at, strict=True)], axis=0) + n
        for row, i in zip(self.cells, at, strict=True):  # cells rise to the estimate at most
            np.maximum.at(row, i, raised)
        keep = np.flatnonzero(raised > self.floor) if len(self.hashes) >= self.heap else np.arange(len(keys))
        old = ~np.isin(self.hashes, keys[keep], assume_unique=True)
        hashes, estimates = np.concatenate([self.hashes[old], keys[keep]]), np.concatenate([self.estimates[old], raised[keep]])
        fresh = values.take(pa.array(first[keep]))
        pool = fresh if self.values is None else pa.concat_arrays([self.values.filter(pa.array(old)), fresh])
        if len(hashes) > self.heap:
            order = np.argpartition(-estimates, self.heap)
            self.floor = max(self.floor, int(estimates[order[self.heap :]].max()))
            order = order[: self.heap]
            hashes, estimates, pool = hashes[order], estimates[order], pool.take(pa.array(order))
        self.hashes, self.estimates, self.values = hashes, estimates, pool


def _sketched(width: int, depth: int, heap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(width, depth, heap)
        for batch in batches:
            if batch.num_rows:
                sketch.update(batch.column("value"), batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("n").to_numpy(zero_copy_only=False))
        if sketch.values is not None:
            floor = pa.array(np.full(len(sketch.estimates), sketch.floor))
            yield pa.RecordBatch.from_arrays([sketch.values, pa.array(sketch.estimates), floor], names=["value", "approx_count", "floor"])

    return run


def heavy_candidates(df: DataFrame, column: str, width: int = WIDTH, depth: int = DEPTH, heap: int = HEAP) -> DataFrame:
    """Candidates ``value, approx_count, floor`` of the most frequent values.

    Values are hash-partitioned, so each lives in one task's sketch and the
    tasks' heaps are disjoint: their union needs no merging of counts. Memory
    is ``8 * width * depth`` bytes and ``heap`` values a task, whatever the
    number of rows and distinct values. ``approx_count`` is never below the true
    count; a value that isn't returned occurs at most ``floor`` times (the
    largest over all rows). NULL is no value; every row counts, repeated ones
    too; an empty table has no candidates. ``width`` is a power of two.
    """
    kind = df.schema[column].dataType.simpleString()
    combined = df.select(F.col(column).alias("value")).mapInArrow(_combined, f"value {kind}, n bigint")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = combined.withColumn("h", F.xxhash64("value")).repartition(tasks, "h")
    return spread.mapInArrow(_sketched(width, depth, heap), f"value {kind}, approx_count bigint, floor bigint")


def top_values(df: DataFrame, column: str, k: int, **sketch: int) -> DataFrame:
    """The ``k`` values with the most rows: ``value, n_rows, approx_count``, exact.

    Candidates come from the sketch. The rows of the ``16 * k`` heaviest are
    counted first (one scan); the ``k``-th count then tells which values can be
    among the first at all: if it lies above ``floor``, only candidates whose
    estimates reach it, and those are counted too; else (flat columns, ties with
    evicted values) any value may, and all are counted in one aggregate,
    combined before the shuffle. Only ``16 * k`` values reach the driver;
    candidates are broadcast behind a count of them, else joined by a shuffle.
    At equal counts the smaller value comes first.
    """
    spark = df.sparkSession
    found = settle(heavy_candidates(df, column, **sketch))
    floor = found.agg(F.max("floor")).head()[0] or 0
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL")
    first = lambda counted: counted.orderBy(F.desc("n_rows"), "value").limit(k)

    def counted(chosen: DataFrame) -> DataFrame:
        return values.join(chosen, "value").groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"), F.first("approx_count").alias("approx_count"))

    heaviest = found.orderBy(F.desc("approx_count"), "value").limit(16 * k + 1).select("value", "approx_count").collect()
    schema = found.select("value", "approx_count").schema
    top = first(counted(F.broadcast(spark.createDataFrame(heaviest[: 16 * k], schema)))).collect()
    least = top[-1]["n_rows"] if len(top) == k else 1
    result = spark.createDataFrame(top, T.StructType([schema["value"], T.StructField("n_rows", T.LongType()), schema["approx_count"]]))
    if floor >= least:
        every = values.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least)
        seen = first(every).join(found.select("value", "approx_count"), "value", "left")
        result = first(seen.select("value", "n_rows", F.coalesce("approx_count", F.lit(floor)).alias("approx_count")))
    elif len(heaviest) > 16 * k and heaviest[-1]["approx_count"] >= least:
        result = first(counted(broadcast_up_to(found.where(F.col("approx_count") >= least).select("value", "approx_count"))))
    return result.orderBy(F.desc("n_rows"), "value")
