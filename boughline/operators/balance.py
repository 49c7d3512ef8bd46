"""Per-key results when a few keys hold most rows.

Keys are placed by their load: light keys are bin-packed to tasks, a heavy key
is split into shards in proportion to its rows, and the matching side of a join
is replicated to those shards only (fragment-replicate by estimated load).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boughline.operators.common import settle

#: A key is split when it holds more than this part of a task's even share.
SPLIT_AT = 0.5
#: Groups of light keys that are packed per task.
BUNDLES_PER_TASK = 32


@dataclass(frozen=True)
class Placement:
    """Where keys go: ``heavy`` has ``keys, _tasks array<int>``, ``bundles`` has ``_b, _light`` (bundle and task)."""

    keys: tuple[str, ...]
    tasks: int
    heavy: DataFrame
    bundles: DataFrame
    loads: tuple[int, ...]


def _bundle(keys: list[str] | tuple[str, ...], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def place(loads: DataFrame, keys: list[str], weight: str, tasks: int) -> Placement:
    """Packs keys to ``tasks`` tasks by their ``weight``.

    The driver sees two bounded tables: the keys above ``SPLIT_AT`` of an even
    share (there can be at most ``tasks / SPLIT_AT`` of them) and the summed
    loads of ``tasks * BUNDLES_PER_TASK`` hash bundles of all other keys.
    Bundles and shards go, largest first, to the least loaded task.
    """
    n = tasks * BUNDLES_PER_TASK
    total = loads.agg(F.sum(weight)).head()[0] or 0
    share = max(1.0, total / tasks)
    is_heavy = F.col(weight) > F.lit(share * SPLIT_AT)
    bundle = F.when(~is_heavy, _bundle(keys, n)).alias("_b")
    alone = [F.when(is_heavy, F.col(k)).alias(k) for k in keys]
    summed = loads.groupBy(bundle, *alone).agg(F.sum(weight).cast("bigint").alias("_w")).collect()
    heavy, light = [r for r in summed if r["_b"] is None], [r for r in summed if r["_b"] is not None]
    items: list[tuple[float, tuple[str, int]]] = [(r["_w"], ("bundle", r["_b"])) for r in light]
    for i, r in enumerate(heavy):
        shards = min(tasks, max(1, -(-r["_w"] // int(share * SPLIT_AT + 1))))
        items += [(r["_w"] / shards, ("heavy", i))] * shards
    bundle_task, shard_tasks = [0] * n, [[] for _ in heavy]
    queue = [(0.0, t) for t in range(tasks)]
    for load, (kind, i) in sorted(items, key=lambda x: (-x[0], x[1])):
        at, task = heapq.heappop(queue)
        heapq.heappush(queue, (at + load, task))
        if kind == "bundle":
            bundle_task[i] = task
        else:
            shard_tasks[i].append(task)
    schema = T.StructType([*loads.select(*keys).schema, T.StructField("_tasks", T.ArrayType(T.IntegerType()))])
    rows = [(*[r[k] for k in keys], sorted(set(t))) for r, t in zip(heavy, shard_tasks, strict=True)]
    spark = loads.sparkSession
    bundles = spark.createDataFrame(list(enumerate(bundle_task)), "_b int, _light int")
    by_task = [0] * tasks
    for at, task in queue:
        by_task[task] = int(at)
    return Placement(tuple(keys), tasks, spark.createDataFrame(rows, schema), bundles, tuple(by_task))


def _with_tasks(df: DataFrame, p: Placement) -> DataFrame:
    """Adds ``_tasks``: the tasks that hold a row's key."""
    heavy = p.heavy.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(p.keys)], "_tasks")
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(p.keys)])
    bundle = F.when(F.col("_tasks").isNull(), _bundle(p.keys, p.tasks * BUNDLES_PER_TASK))
    # At most tasks / SPLIT_AT and tasks * BUNDLES_PER_TASK rows: proven bounds.
    joined = df.join(F.broadcast(heavy), match, "left").withColumn("_b", bundle).join(F.broadcast(p.bundles), "_b", "left")
    return joined.withColumn("_tasks", F.coalesce("_tasks", F.array("_light"))).drop("_b", "_light", *[f"_h{i}" for i in range(len(p.keys))])


def scatter(df: DataFrame, p: Placement, spread: Column) -> DataFrame:
    """``df`` moved to its tasks; rows of a split key go to one of its shards by ``spread`` (any integer)."""
    task = F.element_at("_tasks", (F.pmod(spread, F.size("_tasks")) + 1).cast("int"))
    return _with_tasks(df, p).withColumn("_task", task).drop("_tasks").repartitionById(p.tasks, F.col("_task"))


def replicate(other: DataFrame, p: Placement) -> DataFrame:
    """The matching side, each row copied to the shards of its key and nowhere else."""
    return _with_tasks(other, p).withColumn("_task", F.explode("_tasks")).drop("_tasks").repartitionById(p.tasks, F.col("_task"))


def balanced_aggregate(df: DataFrame, keys: list[str], partials: dict[str, tuple[Column, str]], tasks: int, slots: int = 16) -> DataFrame:
    """Per-key aggregates without a task that does most of the work.

    ``partials`` maps an output column to an aggregate and to the function that
    merges it (``sum``, ``min`` or ``max``). Rows are combined before the first
    shuffle into at most ``slots`` parts per key; the parts, which are what
    moves, are placed by their number (``place``), combined by task and the
    shards of split keys merged. There is no matching side to replicate
    (``balanced_join`` has one). A NULL key is a key of its own; repeated rows
    are rows; an empty table has no keys.
    """
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    sliced = df.withColumn("_slot", F.pmod(F.spark_partition_id(), F.lit(slots)))
    parts = sliced.groupBy(*keys, "_slot").agg(*[a.alias(c) for c, (a, _) in partials.items()])
    parts = settle(parts)
    placed = place(parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_load")), keys, "_load", tasks)
    merged = [merge[how](c).alias(c) for c, (_, how) in partials.items()]
    by_task = scatter(parts, placed, F.col("_slot")).groupBy("_task", *keys).agg(*merged)
    return by_task.groupBy(*keys).agg(*merged)


def balanced_join(big: DataFrame, matching: DataFrame, keys: list[str], tasks: int, spread: Column, how: str = "inner") -> DataFrame:
    """Joins ``big`` with ``matching`` on ``keys`` (of the same names in both), load-balanced.

    Rows of ``big`` keep their multiplicity. ``how`` is ``inner`` or ``left``.
    NULL keys match nothing; with ``left`` their rows stay. Other columns of
    ``matching`` that ``big`` has too get the suffix ``_matching``. Either side
    may be empty; rows of ``matching`` keep their multiplicity too.
    """
    twice = {c for c in matching.columns if c in big.columns and c not in keys}
    matching = matching.select(*[F.col(c).alias(f"{c}_matching" if c in twice else c) for c in matching.columns])
    loads = settle(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_load")))
    placed = place(loads, keys, "_load", tasks)
    left, right = scatter(big, placed, spread), replicate(matching, placed)
    return left.join(right, ["_task", *keys], how).drop("_task")
