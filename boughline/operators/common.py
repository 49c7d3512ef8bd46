"""Pieces that several operators share: cutting lineage, checked broadcasts, distributed running sums."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a side may be broadcast by ``broadcast_up_to``; callers pass narrow rows only.
BROADCAST_ROWS = 200_000
#: Rows of one range of a running sum.
RANGE_ROWS = 100_000
#: Folders written by ``settle`` and still there.
_settled: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's checkpoint folder, which all executors share.

    Where a session names none (``spark.checkpoint.dir``), a local one gets a
    temporary folder that goes with the process, and one on a cluster a folder
    below the user's home on the default file system; if that is a machine's
    own, the setting is needed, and its lack is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="boughline-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        elif folder is None:
            files = context._jvm.org.apache.hadoop.fs.FileSystem.get(context._jsc.hadoopConfiguration())
            if files.getScheme() == "file":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = f"{files.getHomeDirectory().toString()}/.boughline/{context.applicationId}"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def _delete(spark: SparkSession, folder: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _settled.discard(folder)


def settle(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` computed once, written as a table to the shared folder and read from there.

    This cuts the lineage like a checkpoint, but columns are pruned when it is
    read and its size is known to the optimiser. ``by`` partitions the table by
    a column of few values, so that reading one of them reads nothing else.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    _settled.add(folder)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    if by is not None:
        out = out.select(*df.columns)  # it was moved to the end
    out._settled = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more (others are left alone)."""
    for df in tables:
        folder = df.__dict__.get("_settled")
        if folder is not None:
            _delete(df.sparkSession, folder)


def forget(spark: SparkSession) -> None:
    """Deletes all settled tables; results that weren't read yet can't be read afterwards."""
    for folder in list(_settled):
        _delete(spark, folder)


@atexit.register
def _forget_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may be gone already
            forget(spark)


def broadcast_up_to(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged (a shuffle join follows)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ancestors(path: Column) -> Column:
    """Proper ancestor directories of a path, outermost first, each with its final slash."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    depth = F.size(parts)
    return F.when(depth > 1, F.transform(F.sequence(F.lit(1), depth - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(
        F.array().cast("array<string>")
    )


def running_sum(df: DataFrame, keys: list[str], order: Column, amount: Column, out: str, bits: int | None = None) -> DataFrame:
    """Adds ``out``: the exclusive running sum of ``amount`` per ``keys`` in the order of the 64-bit integer ``order``.

    No key meets one task: rows are cut into ``2 ** bits`` ranges of ``order``
    within each key (by default as many as keep about ``RANGE_ROWS`` rows each
    if one key has all rows), each range is summed in a window of its own, and
    the sums of the ranges before it (a table of keys times ranges) are joined in.
    ``order`` should spread evenly over 64 bits (a hash); make it unique where
    the order matters. NULL keys are keys of their own.
    """
    if bits is None:
        bits = max(1, (df.count() // RANGE_ROWS).bit_length())
    placed = df.withColumn("_order", order).withColumn("_amount", amount.cast("bigint"))
    placed = placed.withColumn("_bucket", F.shiftright("_order", 64 - bits))
    sums = placed.groupBy(*keys, "_bucket").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_bucket").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    match = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(starts, match).withColumn(out, F.col("_local") + F.col("_start"))
    return joined.drop("_order", "_amount", "_bucket", "_local", "_start", "_b", *[f"_k{i}" for i in range(len(keys))])


def last_seen(df: DataFrame, group: str, order: str, lasts: dict[str, Column], upto: bool = False, counted: dict[str, Column] | None = None) -> DataFrame:
    """Adds per row what came before it in its group: for each of ``lasts`` the last value that isn't NULL, for each of ``counted`` how many weren't.

    ``order`` is a whole number, unique in its group; ``upto`` takes the row
    itself in. Groups are cut into stretches of ``RANGE_ROWS`` numbers, each a
    window of its own, and what the stretches before it hold (a table of groups
    times stretches, of the groups that have several) is joined in, so that no
    group meets one task. NULL groups are a group of their own. ``df`` is read
    for both, so settle it where it isn't a table.
    """
    counted = counted or {}
    placed = df.withColumn("_stretch", F.floor(F.col(order) / RANGE_ROWS)).withColumns({f"_in_{c}": v for c, v in {**lasts, **counted}.items()})
    within = Window.partitionBy(group, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow if upto else -1)
    local = placed.withColumns({**{f"_l_{c}": F.last(f"_in_{c}", ignorenulls=True).over(within) for c in lasts}, **{f"_l_{c}": F.count(f"_in_{c}").over(within) for c in counted}})
    kept = [F.col(c) for c in df.columns if c not in lasts and c not in counted]
    first, last = F.floor(F.min(order) / RANGE_ROWS), F.floor(F.max(order) / RANGE_ROWS)
    spans = df.groupBy(F.col(group).alias("_h")).agg(first.alias("_a"), last.alias("_z"), F.count(order).alias("_k"), F.count(F.lit(1)).alias("_n")).where("_a < _z OR _k BETWEEN 1 AND _n - 1").select("_h")
    if spans.isEmpty():  # nothing is carried from one stretch to another
        return local.select(*kept, *[F.col(f"_l_{c}").alias(c) for c in [*lasts, *counted]])
    newest = {f"_x_{c}": F.max_by(f"_in_{c}", F.when(F.col(f"_in_{c}").isNotNull(), F.col(order))) for c in lasts}
    carrying = placed.join(broadcast_up_to(spans), F.col(group).eqNullSafe(F.col("_h")), "left_semi")
    sums = carrying.groupBy(F.col(group).alias("_g"), F.col("_stretch").alias("_s")).agg(*[v.alias(c) for c, v in newest.items()], *[F.count(f"_in_{c}").alias(f"_x_{c}") for c in counted])
    earlier = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(f"_x_{c}", ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in lasts] + [F.coalesce(F.sum(f"_x_{c}").over(earlier), F.lit(0)).alias(f"_c_{c}") for c in counted]
    starts = broadcast_up_to(settle(sums.select("_g", "_s", *carried)))
    joined = local.join(starts, F.col(group).eqNullSafe(F.col("_g")) & F.col("_stretch").eqNullSafe(F.col("_s")), "left")
    added = {**{c: F.coalesce(f"_l_{c}", f"_c_{c}") for c in lasts}, **{c: F.col(f"_l_{c}") + F.coalesce(f"_c_{c}", F.lit(0)) for c in counted}}
    return joined.select(*kept, *[v.alias(c) for c, v in added.items()])
