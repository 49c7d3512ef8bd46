"""Applying a stream of inserts, updates and deletes that arrives repeated and out of order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boughline.operators.common import ancestors, broadcast_up_to, discard, settle

#: Fields in which an entry equals the current one at its path, which removes it.
IDENTITY = ["name", "file_type", "perm", "ts", "size", "link_target", "content_id", "hard_link", "flow_op", "flow_target"]


def section_order(sections: DataFrame) -> DataFrame:
    """Log sequence numbers of the sections that a chain of states from the empty one leads to.

    Returns ``chain_id, section_id, lsn`` with ``lsn`` from 1. Deliveries of one
    change (same chain, base and new state) are one section, named by the
    smallest ``section_id``. Chains are linear: of several sections that start
    from one state, the one that arrived first applies first, the others where
    the chain comes back to that state. Sections without a new state, and those
    that no chain leads to, are left out, whatever state they name.

    Positions come from pointer doubling: each round joins every section with
    the one its pointer names and doubles the reach, so a chain of n sections
    takes log2(n) rounds, whatever share of the rows it holds. Chains in which
    a state starts or ends several sections are walked forward in the same way.
    """
    once = (
        sections.where("chain_id IS NOT NULL AND new_id IS NOT NULL")
        .groupBy("chain_id", "base_id", "new_id")
        .agg(F.min("section_id").alias("section_id"), F.min("arrived_at").alias("_at"))
    )
    once = settle(once)
    unclear = reduce(DataFrame.unionByName, [once.groupBy("chain_id", c).count().where("count > 1").select("chain_id") for c in ("base_id", "new_id")]).distinct()
    unclear = settle(unclear)
    if unclear.isEmpty():
        return _doubled(once)
    return _doubled(once.join(unclear, "chain_id", "left_anti")).unionByName(_walked(once.join(unclear, "chain_id", "left_semi")))


def _doubled(once: DataFrame) -> DataFrame:
    """Positions in chains of which each state starts and ends one section at most."""
    links = settle(once.select("chain_id", "section_id", F.col("new_id").alias("_state"), F.col("base_id").alias("_ptr"), F.lit(1).cast("bigint").alias("lsn"), F.lit(True).alias("_moved")))
    rounds = max(1, links.count().bit_length())
    for _ in range(rounds):  # more are never needed; a cycle is left unresolved
        at = links.select(F.col("chain_id").alias("_c"), F.col("_state").alias("_s"), F.col("_ptr").alias("_next"), F.col("lsn").alias("_hops"))
        joined = links.join(at, (F.col("chain_id") == F.col("_c")) & (F.col("_ptr") == F.col("_s")), "left")
        moved = F.col("_s").isNotNull()
        ahead = joined.select(
            "chain_id",
            "section_id",
            "_state",
            F.when(moved, F.col("_next")).otherwise(F.col("_ptr")).alias("_ptr"),
            (F.col("lsn") + F.when(moved, F.col("_hops")).otherwise(0)).alias("lsn"),
            moved.alias("_moved"),
        )
        former, links = links, settle(ahead)
        discard(former)
        if links.where("_moved AND _ptr IS NOT NULL").isEmpty():
            break
    return links.where("_ptr IS NULL").select("chain_id", "section_id", "lsn")


def _walked(left: DataFrame) -> DataFrame:
    """Positions in any chains: from the empty state on, at each state the first arrived section not yet applied.

    Each round follows the first section of every state until a state has none
    or was met before, doubling the reach of jumps; chains that came back to a
    state with sections left go on with those in the next round.
    """
    ends = left.select("chain_id").distinct().select(F.col("chain_id").alias("_c"), F.lit(None).cast("binary").alias("_state"), F.lit(0).cast("bigint").alias("_lsn"))
    walked = []
    while True:
        arrived = Window.partitionBy("chain_id", "base_id").orderBy(F.col("_at").asc_nulls_last(), F.col("section_id"))
        first = settle(left.withColumn("_r", F.row_number().over(arrived)).where("_r = 1").drop("_r"))
        at_end = (F.col("chain_id") == F.col("_c")) & F.col("base_id").eqNullSafe(F.col("_state"))
        reached = settle(first.join(ends, at_end).select("chain_id", "section_id", (F.col("_lsn") + 1).alias("lsn")))
        if reached.isEmpty():
            break
        after = first.select(F.col("chain_id").alias("_c"), F.col("base_id").alias("_b"), F.col("section_id").alias("_next"))
        jumps = settle(first.join(after, (F.col("chain_id") == F.col("_c")) & (F.col("new_id") == F.col("_b"))).select("chain_id", "section_id", "_next"))
        hop, known = 1, reached.count()
        while True:
            ahead = reached.join(jumps, ["chain_id", "section_id"]).select("chain_id", F.col("_next").alias("section_id"), (F.col("lsn") + hop).alias("lsn"))
            reached = settle(reached.unionByName(ahead).groupBy("chain_id", "section_id").agg(F.min("lsn").alias("lsn")))
            n = reached.count()
            if n == known:
                break
            second = jumps.select("chain_id", F.col("section_id").alias("_next"), F.col("_next").alias("_then"))
            jumps = settle(jumps.join(second, ["chain_id", "_next"]).select("chain_id", "section_id", F.col("_then").alias("_next")))
            hop, known = 2 * hop, n
        walked.append(reached)
        ends = settle(first.join(reached, ["chain_id", "section_id"]).groupBy(F.col("chain_id").alias("_c")).agg(F.max_by("new_id", "lsn").alias("_state"), F.max("lsn").alias("_lsn")))
        left = settle(left.join(reached, ["chain_id", "section_id"], "left_anti"))
    return reduce(DataFrame.unionByName, walked, reached)


def _classified(events: DataFrame, resets: DataFrame) -> DataFrame:
    """Events of known paths with ``_odd`` (puts a row; else removes it) and ``_live`` (last of its path and not reset since).

    Within a run of equal consecutive values the first puts the row, the second
    removes it, the third puts it again; a reset (an ancestor's removal) starts
    over, and wins over changes below it in the same section. One sort of each
    path's events serves all windows. ``_fresh`` marks the first event since the
    last reset, ``_next_reset`` the reset that follows.
    """
    marked = events.withColumn("_reset", F.lit(None).cast("bigint")).unionByName(
        resets.select("chain_id", "path", F.col("lsn"), F.col("lsn").alias("_reset"), F.lit(-1).cast("bigint").alias("seq")), allowMissingColumns=True
    )
    by = Window.partitionBy("chain_id", "path").orderBy("lsn", "seq")
    upto, before, all_ = (by.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1, Window.unboundedFollowing))
    none = F.lit(-1).cast("bigint")
    value = F.struct(*IDENTITY)
    marked = marked.select(
        "*",
        F.coalesce(F.last("_reset", ignorenulls=True).over(upto), none).alias("_epoch"),
        F.coalesce(F.max("_reset").over(all_), none).alias("_last_reset"),
        F.first("_reset", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("_next_reset"),
        # Within an epoch the event before is the row before.
        F.lag(value).over(by).eqNullSafe(value).alias("_same"),
        F.lead("lsn").over(by).isNull().alias("_final"),
    )
    own = F.col("_reset").isNull() & (F.col("lsn") > F.col("_epoch"))
    marked = marked.withColumn("_own", own).withColumn("_n", F.count_if("_own").over(upto))
    fresh = ~F.last(F.when(F.col("_own"), F.col("_epoch")), ignorenulls=True).over(before).eqNullSafe(F.col("_epoch"))
    marked = marked.withColumn("_fresh", fresh)
    start = F.last(F.when(F.col("_own") & (F.col("_fresh") | ~F.col("_same")), F.col("_n")), ignorenulls=True).over(upto)
    marked = marked.withColumn("_odd", (F.col("_n") - start) % 2 == 0)
    return marked.where("_own").withColumn("_live", F.col("_final") & (F.col("_epoch") == F.col("_last_reset")))


def _below(events: DataFrame, removals: DataFrame) -> DataFrame:
    """Resets ``chain_id, path, lsn`` that removals of directories mean for the paths below them.

    Removals are few as a rule: they go to the events, so that only paths below
    a removed directory move; beyond ``BROADCAST_ROWS`` of them both sides are shuffled.
    """
    gone = broadcast_up_to(removals.select(F.col("chain_id").alias("_c"), F.col("path").alias("_d"), "lsn"))
    up = events.select("chain_id", "path", F.explode(ancestors(F.col("path"))).alias("_dir"))
    return up.join(gone, (F.col("chain_id") == F.col("_c")) & (F.col("_dir") == F.col("_d"))).select("chain_id", "path", "lsn").distinct()


def _replayed(sections: DataFrame, changes: DataFrame, base: DataFrame | None, stop_at: int | None) -> DataFrame:
    """All events in log order, classified, with the resets that removals of directories mean."""
    order = settle(section_order(sections))
    if stop_at is not None:
        order = order.where(F.col("lsn") <= stop_at)
    fields = ["seq", "path", "is_dir", *IDENTITY]
    slim = changes.where("path IS NOT NULL").select("section_id", *[F.col(c) for c in fields])
    events = slim.join(broadcast_up_to(order), "section_id").select("chain_id", "lsn", *fields)
    if base is not None:
        events = events.unionByName(base.where("path IS NOT NULL").select("chain_id", F.lit(0).cast("bigint").alias("lsn"), *fields))
    rest = [c for c in events.columns if c not in ("chain_id", "path", "lsn", "seq")]
    events = settle(events.groupBy("chain_id", "path", "lsn", *rest).agg(F.coalesce(F.min("seq"), F.lit(0)).cast("bigint").alias("seq")))
    # A directory can only be removed where two of its changes are equal. Hashes find those that may be (few); they are settled exactly, level by level.
    dirs = events.where("coalesce(is_dir, false) OR path LIKE '%/'")
    twice = dirs.groupBy("chain_id", "path", F.xxhash64(*IDENTITY).alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("chain_id", "path").distinct()
    again = dirs.join(broadcast_up_to(settle(twice)), ["chain_id", "path"], "left_semi")
    again = settle(again.select(*events.columns, F.size(ancestors(F.col("path"))).alias("_level")))
    removals = events.select("chain_id", "path", "lsn").limit(0)
    levels = sorted(r[0] for r in again.select("_level").distinct().collect())  # as many as the tree is deep
    for level in levels:
        here = again.where(F.col("_level") == level).drop("_level")
        found = _classified(here, _below(here, removals)).where(~F.col("_odd")).select("chain_id", "path", "lsn")
        former, removals = removals, settle(removals.unionByName(found))
        discard(former)
    return _classified(events, _below(events, removals) if levels else removals)


def apply_changes(sections: DataFrame, changes: DataFrame, base: DataFrame | None = None, stop_at: int | None = None) -> DataFrame:
    """Current rows of each chain: ``chain_id``, ``path``, ``lsn`` and the fields of ``changes``.

    Deliveries are deduplicated by identifier and put in log order
    (``section_order``); a window over each path ranks its changes by log
    sequence number and keeps the latest, which is merged into ``base`` (rows
    with ``chain_id``, the state before the first section; empty by default),
    dropping deletes. An entry equal to the current one at its path removes it
    and, if it is a directory, all below it, also what the same section
    changes below; any other entry replaces the current one or is added.
    Removals of directories are settled level by level of the tree, over
    directories alone, before all paths are ranked once. ``stop_at`` gives the
    state after so many sections.

    Repeated rows count once; NULL equals NULL; a change with a NULL path or of
    an unknown section is none. Several different changes of a path in one
    section apply in the order of ``seq``. Empty inputs give an empty state.
    """
    final = _replayed(sections, changes, base, stop_at).where("_live AND _odd")
    return final.select("chain_id", "path", "lsn", "is_dir", *IDENTITY)


def chain_log(sections: DataFrame, changes: DataFrame) -> DataFrame:
    """What each section did: ``chain_id, lsn, n_added, n_removed, n_modified`` (paths, directories included).

    A path counts as modified if its id changes. Sections that did nothing of
    the kind have no row.
    """
    events = _replayed(sections, changes, None, None)
    by = Window.partitionBy("chain_id", "path").orderBy("lsn", "seq")
    here = lambda c: F.when(~F.col("_fresh"), F.lag(c).over(by))  # noqa: E731  # of the event before in this epoch
    more = F.coalesce(~F.lead("_fresh").over(by), F.lit(False))
    before = events.select("chain_id", "lsn", "content_id", "_odd", "_next_reset", F.coalesce(here("_odd"), F.lit(False)).alias("_had"), here("content_id").alias("_old_id"), more.alias("_more"))
    kind = F.when(~F.col("_odd"), "removed").when(~F.col("_had"), "added").when(~F.col("_old_id").eqNullSafe(F.col("content_id")), "modified")
    own = F.struct("lsn", kind.alias("kind"))
    swept = F.when(F.col("_odd") & ~F.col("_more") & F.col("_next_reset").isNotNull(), F.struct(F.col("_next_reset").alias("lsn"), F.lit("removed").alias("kind")))
    each = before.select("chain_id", F.explode(F.array_compact(F.array(own, swept))).alias("_k")).select("chain_id", "_k.lsn", "_k.kind").where("kind IS NOT NULL")
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return each.groupBy("chain_id", "lsn").agg(count("added"), count("removed"), count("modified"))


def unapplied_sections(sections: DataFrame) -> DataFrame:
    """``chain_id, section_id, reason`` of the sections that change nothing, so that they can be asked for again.

    ``no state``: without a chain or a new state; ``unreachable``: no chain of
    states from the empty one leads to them, or another section that arrived
    before started from their state and no chain comes back to it. Repeated
    deliveries of a change that is applied aren't listed, those of one that
    isn't are, each.
    """
    applied = section_order(sections).select("section_id")
    known = sections.select("chain_id", "section_id", "base_id", "new_id").distinct()
    stateless = F.col("chain_id").isNull() | F.col("new_id").isNull()
    changes = known.where(~stateless)
    done = changes.join(applied, "section_id", "left_semi").select(F.col("chain_id").alias("_c"), F.col("base_id").alias("_b"), F.col("new_id").alias("_n")).distinct()
    same = (F.col("chain_id") == F.col("_c")) & F.col("base_id").eqNullSafe(F.col("_b")) & (F.col("new_id") == F.col("_n"))
    lost = changes.join(done, same, "left_anti").select("chain_id", "section_id", F.lit("unreachable").alias("reason"))
    return lost.unionByName(known.where(stateless).select("chain_id", "section_id", F.lit("no state").alias("reason"))).distinct()
