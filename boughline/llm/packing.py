"""Filling containers of fixed capacity with items of varying length."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boughline.llm.tokens import VOCABULARY, token_counts
from boughline.operators.common import running_sum, settle


def plan_containers(capacity: int, counts: dict[int, int], first: int = 0) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit over counts of lengths: rows ``(length, rank_from, rank_to, per_bin, first_bin, offset)`` and the next free bin.

    Lengths are placed from long to short, all items of one length at once:
    each goes to the fullest container that still holds it, so a run of equally
    filled containers takes as many as fit of the length each. Runs are kept as
    ranges of container numbers, so the plan grows with the distinct lengths
    (at most the capacity), never with the items. Item ``rank`` of a length is
    in container ``first_bin + (rank - rank_from) // per_bin`` at ``offset +
    (rank - rank_from) % per_bin * length``.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of containers (first, how many)
    rooms: list[int] = []
    free = first

    def put(room: int, start: int, n: int) -> None:
        if n and room:
            if room not in runs:
                runs[room] = []
                bisect.insort(rooms, room)
            runs[room].append((start, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                start, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, start = capacity, free
                n = -(-left // (capacity // length))
                free += n
            each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, rank + full * each, each, start, capacity - room))
                put(room - each * length, start, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left and left < each:  # the last items share one more container
                    plan.append((length, rank, rank + left, left, start + full, capacity - room))
                    put(room - left * length, start + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put(room, start + full, n - full)
    return plan, free


_PLAN = "kind string, length bigint, rank_from bigint, rank_to bigint, per_bin bigint, first_bin bigint, offset bigint"


def pack(items: DataFrame, kinds: dict[str, int]) -> DataFrame:
    """Assigns items to containers of every kind: ``bin_kind, container, item, piece, start, size``.

    ``items`` has ``item`` (unique) and ``size``; ``kinds`` maps a kind to its
    capacity. An item is split only if it exceeds the capacity: into pieces
    that each fill a container, and a rest that is placed like an item.
    Lengths are counted first, the counts (at most ``capacity`` of a kind, so
    a proven bound) are planned on the driver with ``plan_containers``, and
    items take the planned slots by joining on their rank within their length.
    Ranks are counted in ranges of a hash, however many items have a length. The
    plan has about three rows a length once there are many items (77,000 rows
    for a capacity of 32,768), so it stays small.

    Items of NULL or no size need no container and get none; equal sizes are
    ranked by a hash of the item; without items there are no containers. Kinds
    without a positive capacity are refused.
    """
    if any(c is None or c < 1 for c in kinds.values()):
        raise ValueError("capacities are positive")
    spark = items.sparkSession
    sized = items.where("size > 0").select("item", F.col("size").cast("bigint").alias("size"))
    bins = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in sorted(kinds.items())])
    per_kind = sized.select("item", "size", F.explode(bins).alias("k")).select("item", "size", "k.kind", "k.capacity")
    per_kind = per_kind.withColumn("fulls", F.floor(F.col("size") / F.col("capacity"))).withColumn("length", F.col("size") % F.col("capacity"))
    # Nothing is rounded: sizes lie far below 2 ** 53.
    counted = per_kind.groupBy("kind", "length").agg(F.count(F.lit(1)).alias("n"), F.sum("fulls").alias("fulls")).collect()
    rows, fulls = [], {}
    for kind, capacity in sorted(kinds.items()):
        own = [r for r in counted if r["kind"] == kind]
        plan, used = plan_containers(capacity, {r["length"]: r["n"] for r in own if r["length"]})
        fulls[kind] = used
        rows += [(kind, *p) for p in plan]
    rests = per_kind.where("length > 0").select("kind", "item", "length", "fulls")
    ranked = running_sum(rests, ["kind", "length"], F.xxhash64("item"), F.lit(1), "rank")
    slots = F.broadcast(spark.createDataFrame(rows, _PLAN)).alias("p")
    r = ranked.alias("r")
    match = (F.col("r.kind") == F.col("p.kind")) & (F.col("r.length") == F.col("p.length")) & (F.col("r.rank") >= F.col("p.rank_from")) & (F.col("r.rank") < F.col("p.rank_to"))
    at = F.col("r.rank") - F.col("p.rank_from")
    placed = r.join(slots, match).select(
        F.col("r.kind").alias("bin_kind"),
        (F.col("p.first_bin") + F.floor(at / F.col("p.per_bin"))).alias("container"),
        "item",
        (F.col("fulls") + 1).cast("int").alias("piece"),
        (F.col("p.offset") + (at % F.col("p.per_bin")) * F.col("p.length")).alias("start"),
        F.col("r.length").alias("size"),
    )
    # Containers filled by one piece are numbered behind the planned ones by item, which needs no global order.
    large = per_kind.where("fulls > 0").select("kind", "capacity", "item", F.col("fulls").cast("bigint").alias("fulls"))
    base = F.element_at(F.create_map(*[x for k, n in sorted(fulls.items()) for x in (F.lit(k), F.lit(n).cast("bigint"))]), F.col("kind"))
    before = running_sum(large, ["kind"], F.xxhash64("item"), F.col("fulls"), "before").withColumn("first", base + F.col("before"))
    whole = before.withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("fulls").cast("int")))).select(
        F.col("kind").alias("bin_kind"), (F.col("first") + F.col("piece") - 1).alias("container"), "item", "piece", F.lit(0).cast("bigint").alias("start"), F.col("capacity").alias("size")
    )
    return placed.unionByName(whole)


def pack_documents(documents: DataFrame, kinds: dict[str, int], vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """``pack`` for the texts of documents, measured in tokens.

    Each text is tokenized once; sizes are written once and read by the count
    and the assignment. Repeated rows of a ``doc_id`` count once (with the
    largest text); NULL and empty texts need no container.
    """
    sizes = token_counts(documents.where("doc_id IS NOT NULL"), ["doc_id"], vocabulary, pattern)
    items = settle(sizes.groupBy(F.col("doc_id").alias("item")).agg(F.max("n_tokens").alias("size")))
    return pack(items, kinds).withColumnRenamed("item", "doc_id")
