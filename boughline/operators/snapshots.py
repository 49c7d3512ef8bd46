"""What changed between full snapshots of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boughline.operators.common import broadcast_up_to, settle


def _signed_counts(signed: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``n``: rows whose signs (1 of one side, -1 of the other) don't cancel."""
    return signed.groupBy(*columns).agg(F.sum("_sign").alias("n")).where("n <> 0")


def except_all_both_ways(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``n``: what EXCEPT ALL leaves of ``a`` (``n`` copies) and of ``b`` (``-n`` copies).

    EXCEPT ALL counts the copies of a row on both sides; one signed count gives
    both directions, so every row is shuffled once, combined before. NULLs are equal.
    """
    return _signed_counts(a.select(*columns, F.lit(1).alias("_sign")).unionByName(b.select(*columns, F.lit(-1).alias("_sign"))), columns)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Changes from ``old`` to ``new``: ``keys`` and ``change_type`` (added, removed, changed).

    EXCEPT ALL both ways removes the identical rows, and a full join of the two
    residues by key labels what is left, so the join sees the changes only.
    NULL equals NULL, in keys and compared columns alike. Columns outside
    ``keys`` and ``compared`` don't matter. Repeated rows count once; where a
    side holds several different rows of one key, the key is reported once.
    Either side may be empty.
    """
    columns = [*keys, *compared]
    residue = except_all_both_ways(old.select(*columns).distinct(), new.select(*columns).distinct(), columns)
    gone = residue.where("n > 0").select(*keys).distinct().withColumn("_old", F.lit(True)).alias("o")
    come = residue.where("n < 0").select(*keys).distinct().withColumn("_new", F.lit(True)).alias("n")
    same_key = reduce(Column.__and__, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    kind = F.when(F.col("o._old").isNull(), "added").when(F.col("n._new").isNull(), "removed").otherwise("changed")
    return gone.join(come, same_key, "full_outer").select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], kind.alias("change_type"))


def series_order(snapshots: DataFrame, series: str, snapshot: str, taken_at: str) -> DataFrame:
    """One row per snapshot with its place in its series: ``snapshot, series, ordinal``.

    Snapshots announced more than once count once (earliest moment). A NULL
    series or moment has no place. Equal moments are ordered by snapshot id.
    """
    known = snapshots.where(F.col(series).isNotNull() & F.col(taken_at).isNotNull() & F.col(snapshot).isNotNull())
    once = known.groupBy(snapshot).agg(F.min(F.struct(taken_at, series)).alias("_s")).select(F.col(snapshot).alias("snapshot"), F.col(f"_s.{series}").alias("series"), F.col(f"_s.{taken_at}").alias("_at"))
    return once.select("snapshot", "series", (F.row_number().over(Window.partitionBy("series").orderBy("_at", "snapshot")) - 1).alias("ordinal"))


def series_changes(rows: DataFrame, snapshots: DataFrame, series: str, snapshot: str, taken_at: str, key: str, compared: list[str]) -> DataFrame:
    """Changes between all consecutive snapshots of each series: ``snapshot, key, change_type``.

    EXCEPT ALL both ways for all pairs at once: a row of a snapshot counts 1 in
    the pair in which that is the newer one and -1 in the pair in which it is
    the older one; per pair and row the signs are added up, over the real
    columns, and rows that don't cancel are the residues, which a full join by
    key labels. Before that each distinct row is shuffled once, with the set of
    snapshots that hold it (combined before); the signs are counted where it
    then lies, so neither pairs nor directions multiply what travels.

    Repeated rows (and rows that differ only in other columns) count once.
    NULL equals NULL only. A row with a NULL key is no record. Snapshots
    without rows in ``rows`` are empty snapshots, rows of unknown snapshots
    don't matter. Clashing names of other columns don't matter.
    """
    order = settle(series_order(snapshots, series, snapshot, taken_at))
    placed = broadcast_up_to(order)
    values = [f"_v{i}" for i in range(len(compared))]
    slim = rows.where(F.col(key).isNotNull()).select(F.col(snapshot).alias("_snapshot"), F.col(key).alias("_key"), *[F.col(c).alias(v) for c, v in zip(compared, values, strict=True)])
    held = slim.join(placed, F.col("_snapshot") == F.col("snapshot")).groupBy("series", "_key", *values).agg(F.collect_set("ordinal").alias("_held"))
    sides = F.flatten(F.transform("_held", lambda o: F.array(F.struct(o.alias("pair"), F.lit(1).alias("sign")), F.struct((o + 1).alias("pair"), F.lit(-1).alias("sign")))))
    signed = held.select("series", "_key", *values, F.explode(sides).alias("_s")).select("series", "_key", *values, F.col("_s.pair").alias("ordinal"), F.col("_s.sign").alias("_sign"))
    residues = _signed_counts(signed, ["series", "_key", *values, "ordinal"])
    # The first snapshot of a series has nothing before it, the last nothing behind it.
    newer = order.where("ordinal > 0")
    each = residues.join(broadcast_up_to(newer), ["series", "ordinal"]).select("snapshot", "_key", (F.col("n") > 0).alias("_new")).distinct()
    each = settle(each)  # the changes alone, read by both sides of the join
    by = ["snapshot", "_key"]
    older = each.where("NOT _new").select(*by, F.lit(True).alias("_o"))
    joined = older.join(each.where("_new").select(*by, F.lit(True).alias("_n")), by, "full_outer")
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("changed")
    return joined.select("snapshot", F.col("_key").alias("key"), kind.alias("change_type"))
