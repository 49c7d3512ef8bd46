"""Differences, patches, merges and intersections of trees.

Both sides have the entry schema; ``manifest_id`` names the pair of trees that
are compared, so one call compares any number of pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boughline.operators.common import ancestors, broadcast_up_to, settle
from boughline.operators.navigate import last_by_name, parent_closure
from boughline.operators.snapshots import except_all_both_ways
from boughline.schema import ENTRY, IDENTITY, TREE, located


def _sides(a: DataFrame, b: DataFrame, key: str, columns: list[str], how: str = "full_outer") -> DataFrame:
    """``tree, key, a, b``: structs of both sides' columns, NULL where a side is missing."""
    left = a.select(F.col(TREE).alias("_at"), F.col(key).alias("_ak"), F.struct(*columns).alias("a"))
    right = b.select(F.col(TREE).alias("_bt"), F.col(key).alias("_bk"), F.struct(*columns).alias("b"))
    joined = left.join(right, (F.col("_at") == F.col("_bt")) & (F.col("_ak") == F.col("_bk")), how)
    return joined.select(F.coalesce("_at", "_bt").alias(TREE), F.coalesce("_ak", "_bk").alias("_key"), "a", "b")


def same_in(columns: list[str], a: str = "a", b: str = "b") -> Column:
    """NULL-safe equality of two structs in all of ``columns``."""
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def flat_diff(a: DataFrame, b: DataFrame, key: str = "name") -> DataFrame:
    """``manifest_id, key, change_type, path, size``: added, removed, modified or same by bare name or by path.

    By name the last entry of a name counts. With both ids known, id and mode
    decide, else mode, size, moment and target. Modified and added rows show
    ``b``, the others ``a``.
    """
    columns = ["path", "file_type", "perm", "size", "ts", "link_target", "content_id"]
    slim = lambda df: df.select(TREE, "name", "seq", *columns)
    both = _sides(last_by_name(slim(a)), last_by_name(slim(b)), "name", columns) if key == "name" else _sides(a, b, "path", columns)
    known = F.col("a.content_id").isNotNull() & F.col("b.content_id").isNotNull()
    mode = same_in(["file_type", "perm"])
    equal = F.when(known, mode & (F.col("a.content_id") == F.col("b.content_id"))).otherwise(mode & same_in(["size", "ts", "link_target"]))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(equal, "same").otherwise("modified")
    shown = F.when(kind.isin("added", "modified"), F.col("b")).otherwise(F.col("a"))
    return both.select(TREE, F.col("_key").alias("key"), kind.alias("change_type"), shown["path"].alias("path"), shown["size"].alias("size"))


def _below(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``manifest_id, path`` of the rows that lie below one of the root directories."""
    up = rows.select(TREE, "path", F.explode(ancestors(F.col("path"))).alias("_up"))
    tops = roots.select(F.col(TREE).alias("_t"), F.col("path").alias("_r"))
    return up.join(tops, (F.col(TREE) == F.col("_t")) & (F.col("_up") == F.col("_r")), "left_semi").select(TREE, "path").distinct()


def tree_diff(old: DataFrame, new: DataFrame, touch_parents: bool = True) -> DataFrame:
    """The delta that turns ``old`` into ``new``: entries with ``op`` (add, replace, remove, touch).

    Added directories come with all below them; of a removed directory the top
    row alone is a removal. ``touch`` marks unchanged directories on the way to
    a change, which a nested text needs to show; they change nothing when
    applied (the explicit ``op`` keeps the round trip exact).
    """
    rest = [c for c in ENTRY.names if c not in (TREE, "path")]
    both = _sides(old, new, "path", rest).withColumnRenamed("_key", "path")
    op = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "remove").otherwise("replace")
    differs = F.col("a").isNull() | F.col("b").isNull() | ~same_in(IDENTITY)
    # The changes alone are kept; what follows reads them several times.
    delta = settle(both.where(differs).select(TREE, "path", op.alias("op"), F.coalesce("b", "a").alias("_e")))
    removed = delta.where("op = 'remove'").select(TREE, "path")
    covered = _below(removed, removed.where(F.col("path").endswith("/"))).withColumn("op", F.lit("remove"))
    changed = delta.join(covered, [TREE, "path", "op"], "left_anti").select(TREE, "path", "op", "_e.*")
    if touch_parents:
        need = delta.select(TREE, F.explode(ancestors(F.col("path"))).alias("path")).distinct().join(delta.select(TREE, "path"), [TREE, "path"], "left_anti")
        touched = new.join(need, [TREE, "path"], "left_semi").withColumn("op", F.lit("touch"))
        changed = changed.unionByName(touched.select(TREE, "path", "op", *rest))
    return changed


def apply_delta(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Applies a ``tree_diff`` delta: removals take all below them along, adds and replaces put their entry."""
    removed = delta.where("op = 'remove'").select(TREE, "path")
    dirs = removed.where(F.col("path").endswith("/"))
    gone = removed.unionByName(_below(base, dirs)).distinct()
    put = delta.where("op IN ('add', 'replace')").select(*ENTRY.names)
    kept = base.select(*ENTRY.names).join(gone.unionByName(put.select(TREE, "path")).distinct(), [TREE, "path"], "left_anti")
    return kept.select(*ENTRY.names).unionByName(put)


def toggle_patch(base: DataFrame, patch: DataFrame) -> DataFrame:
    """Applies a patch without ops: an entry identical to the base's removes it and all below, any other replaces or adds.

    A removal wins over changes the same patch makes below it.
    """
    hits = _sides(base, patch, "path", IDENTITY, "inner").where(same_in(IDENTITY)).select(TREE, F.col("_key").alias("path"))
    dirs = hits.where(F.col("path").endswith("/"))
    gone = hits.unionByName(_below(base.select(TREE, "path").unionByName(patch.select(TREE, "path")), dirs)).distinct()
    put = patch.select(*ENTRY.names).join(gone, [TREE, "path"], "left_anti").select(*ENTRY.names)
    kept = base.select(*ENTRY.names).join(gone.unionByName(put.select(TREE, "path")).distinct(), [TREE, "path"], "left_anti")
    return kept.select(*ENTRY.names).unionByName(put)


#: What a merge carries of an entry; the other columns follow from its path.
_CARRIED = [c for c in ENTRY.names if c not in (TREE, "path", "name", "parent_path", "depth", "is_dir")]


def _merge_equal(x: str, y: str) -> Column:
    """Same content at one path: directories by their flow, symlinks by target, files by id."""
    cx, cy = (lambda f: F.col(f"{x}.{f}")), (lambda f: F.col(f"{y}.{f}"))
    link = lambda c: F.coalesce(c("file_type") == "l", F.lit(False))
    return (
        F.when(F.col("path").endswith("/"), cx("flow_op").eqNullSafe(cy("flow_op")) & cx("flow_target").eqNullSafe(cy("flow_target")))
        .when(link(cx) | link(cy), (link(cx) == link(cy)) & cx("link_target").eqNullSafe(cy("link_target")))
        .otherwise(cx("content_id").eqNullSafe(cy("content_id")))
    )


def _three(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Every path of the three trees with its structs ``b``, ``l`` and ``r``."""
    side = lambda df, n: df.select(TREE, "path", F.struct(*_CARRIED).alias(n))
    return side(local, "l").join(side(remote, "r"), [TREE, "path"], "full_outer").join(side(base, "b"), [TREE, "path"], "full_outer")


def _decision(three: DataFrame) -> DataFrame:
    """Adds the decision of the merge to rows ``path, b, l, r`` of structs."""
    b, left, right = (F.col(c).isNotNull() for c in "blr")
    l_same, r_same, agree = _merge_equal("b", "l"), _merge_equal("b", "r"), _merge_equal("l", "r")
    decision = (
        F.when(~b & left & ~right, "local")
        .when(~b & ~left & right, "remote")
        .when(~b, F.when(agree, "local").otherwise("conflict"))
        .when(left & right & l_same & r_same, "base")
        .when(left & right & r_same, "local")
        .when(left & right & l_same, "remote")
        .when(left & right, F.when(agree, "local").otherwise("conflict"))
        .when(left, F.when(l_same, "delete").otherwise("conflict"))
        .when(right, F.when(r_same, "delete").otherwise("conflict"))
        .otherwise("delete")
    )
    return three.withColumn("decision", decision)


def merge_trees(base: DataFrame, local: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Three-way merge: merged entries (with missing parents added) and conflicts ``manifest_id, path, winner, loser_path``.

    Of two conflicting versions a strictly newer remote wins, otherwise the
    local one; the other is kept beside it as ``<name>.conflict`` (unless a
    path of that name is merged too). A change wins over a deletion. An empty
    base gives the union of two trees. Names, parents and depths aren't moved:
    they follow from the paths.
    """
    return _merged(_three(base, local, remote))


def merge_runs(entries: DataFrame, order: DataFrame, length: int = 3) -> tuple[DataFrame, DataFrame]:
    """``merge_trees`` of every run of consecutive snapshots of each series, under the newest one's manifest id.

    ``order`` is a ``series_order``. Of ``length`` 3 the oldest of a run is the
    base, the next local, the newest remote; 2 unites pairs without a base. A
    row that several snapshots share is moved once, with the set of them, and
    all runs of a path are decided where its rows then lie. Repeated rows count
    once. ``seq`` is NULL in the result: a merged tree has no input order.
    """
    placed = broadcast_up_to(order)
    shared = [c for c in _CARRIED if c != "seq"]
    whole = F.struct(*[F.col(c) if c in shared else F.lit(None).cast("bigint").alias(c) for c in _CARRIED])
    held = entries.select(F.col(TREE).alias("_tree"), "path", *shared).join(placed, F.col("_tree") == F.col("snapshot")).groupBy("series", "path", *shared).agg(F.collect_set("ordinal").alias("_held"))
    # A path has few distinct rows a series now, so they can meet.
    near = held.repartition("series", "path").select("series", "path", whole.alias("e"), F.explode("_held").alias("_o"))
    part = near.select("series", "path", "e", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.col("_o") + k)).alias("_back", "ordinal"))
    newest = broadcast_up_to(order.where(F.col("ordinal") >= length - 1).select("series", "ordinal", F.col("snapshot").alias(TREE)))
    sided = part.join(newest, ["series", "ordinal"])
    pick = lambda k, n: F.first(F.when(F.col("_back") == k, F.col("e")), ignorenulls=True).alias(n)
    return _merged(sided.groupBy("series", TREE, "path").agg(pick(0, "r"), pick(1, "l"), pick(2, "b")).drop("series"))


def _merged(three: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged entries and conflicts of paths with their structs."""
    decided = _decision(three)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    newer = F.coalesce(F.col("r.ts"), epoch) > F.coalesce(F.col("l.ts"), epoch)
    winner = F.when(F.col("decision") == "conflict", F.when(F.col("l").isNull(), "remote").when(F.col("r").isNull(), "local").when(newer, "remote").otherwise("local")).otherwise(F.col("decision"))
    decided = decided.withColumn("winner", winner)
    entry = F.when(F.col("winner") == "base", F.col("b")).when(F.col("winner") == "local", F.col("l")).when(F.col("winner") == "remote", F.col("r"))
    beside = F.when(F.col("path").endswith("/"), F.concat(F.regexp_replace("path", "/$", ""), F.lit(".conflict/"))).otherwise(F.concat("path", F.lit(".conflict")))
    two = (F.col("decision") == "conflict") & F.col("l").isNotNull() & F.col("r").isNotNull()
    loser = F.when(F.col("winner") == "local", F.col("r")).otherwise(F.col("l"))
    nothing = F.lit(None).cast("string")
    row = lambda path, kind, e, won=nothing, lost=nothing: F.struct(path.alias("path"), F.lit(kind).alias("kind"), e.alias("e"), won.alias("winner"), lost.alias("loser_path"))
    kept = F.array_compact(
        F.array(
            F.when(entry.isNotNull(), row(F.col("path"), "main", entry)),
            F.when(two, row(beside, "lost", loser)),
            F.when(F.col("decision") == "conflict", row(F.col("path"), "conflict", F.when(F.lit(False), entry), F.col("winner"), F.when(two, beside))),
        )
    )
    # Winners, losers and conflicts come out of one pass over the three trees; the result is written once and completed from there.
    put = settle(decided.select(TREE, F.explode(kept).alias("_k")).select(TREE, "_k.path", "_k.kind", "_k.winner", "_k.loser_path", "_k.e.*"), by="kind")
    at = located(F.col("path"))
    whole = lambda kind: put.where(F.col("kind") == kind).select(TREE, "path", *_CARRIED, *[v.alias(c) for c, v in at.items()]).select(*ENTRY.names)
    main = whole("main")
    losers = whole("lost").join(main.select(TREE, "path"), [TREE, "path"], "left_anti").select(*ENTRY.names)
    merged = parent_closure(main.unionByName(losers), perm=0o755)
    return merged, put.where("kind = 'conflict'").select(TREE, "path", "winner", "loser_path")


def intersect_by_id(a: DataFrame, b: DataFrame) -> DataFrame:
    """Non-directories of ``b`` whose known id is one of ``a``'s non-directories, with their parents."""
    ids = a.where("NOT is_dir AND content_id IS NOT NULL").select(TREE, "content_id").distinct()
    return parent_closure(b.where("NOT is_dir").join(ids, [TREE, "content_id"], "left_semi").select(*ENTRY.names))


def intersect_by_path(a: DataFrame, b: DataFrame) -> DataFrame:
    """Non-directories of ``b`` at a non-directory path of ``a``, with their parents."""
    paths = a.where("NOT is_dir").select(TREE, "path").distinct()
    return parent_closure(b.where("NOT is_dir").join(paths, [TREE, "path"], "left_semi").select(*ENTRY.names))


def minus_by_id(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of ``a`` less those of ``b``, with multiplicity: ``manifest_id, content_id``."""
    ids = lambda df: df.where("content_id IS NOT NULL").select(TREE, "content_id")
    left = except_all_both_ways(ids(a), ids(b), [TREE, "content_id"]).where("n > 0")
    return left.select(TREE, "content_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("_i")).drop("_i")


def same_name_other_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files of one bare name with different ids: ``manifest_id, name`` once each, however many share it."""
    per = lambda df, n: df.where("NOT is_dir AND content_id IS NOT NULL").groupBy(TREE, "name").agg(F.min("content_id").alias(f"{n}_min"), F.max("content_id").alias(f"{n}_max"))
    joined = per(a, "a").join(per(b, "b"), [TREE, "name"])
    return joined.where("NOT (a_min = a_max AND b_min = b_max AND a_min = b_min)").select(TREE, "name")


def explain_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per pair and kind the number of files and bytes: ``manifest_id, change_type, n_files, n_bytes``; an id decides."""
    files = lambda df: df.where("NOT is_dir")
    both = _sides(files(a), files(b), "path", ["content_id", "size"])
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(same_in(["content_id"]), "unchanged").otherwise("modified")
    size = F.coalesce("b.size", "a.size", F.lit(0))
    return both.groupBy(TREE, kind.alias("change_type")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("n_bytes"))


def id_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """The counts a chain's log shows per step: ``manifest_id, n_added, n_removed, n_modified`` by path, directories included."""
    both = _sides(a, b, "path", ["content_id"])
    one = lambda c: F.count_if(c)
    return both.groupBy(TREE).agg(
        one(F.col("a").isNull()).alias("n_added"), one(F.col("b").isNull()).alias("n_removed"), one(F.col("a").isNotNull() & F.col("b").isNotNull() & ~same_in(["content_id"])).alias("n_modified")
    )


def merge_all(trees: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of several trees from left to right, and the conflicts of all steps; a caller that wants none checks that they are empty."""
    merged, conflicts = trees[0], None
    for tree in trees[1:]:
        merged, found = merge_trees(merged.limit(0), merged, tree)
        merged = merged.select(*ENTRY.names)
        conflicts = found if conflicts is None else conflicts.unionByName(found)
    if conflicts is None:
        conflicts = trees[0].limit(0).select(TREE, "path", F.lit("").alias("winner"), F.lit("").alias("loser_path"))
    return merged, conflicts


class Conflicts(ValueError):
    """Trees that can't be united; ``paths`` are the first of their conflicts."""

    def __init__(self, paths: list[tuple[str, str]]) -> None:
        super().__init__(f"conflicts at {', '.join(p for _, p in paths)}")
        self.paths = paths


def merge_strictly(trees: list[DataFrame], shown: int = 20) -> DataFrame:
    """Union of several trees that must agree; raises ``Conflicts`` with the first ``shown`` paths where two don't."""
    merged, conflicts = merge_all(trees)
    found = conflicts.select(TREE, "path").orderBy(TREE, "path").limit(shown).collect()
    if found:
        raise Conflicts([(r[TREE], r["path"]) for r in found])
    return merged


def explain_patch(target: DataFrame, current: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``manifest_id, action, n_files, n_bytes, n_missing``: files to create, update, remove and skip.

    ``stored`` (``content_id``) tells which contents can be had; files to write
    without one are counted as missing.
    """
    files = lambda df: df.where("NOT is_dir")
    both = _sides(files(current), files(target), "path", ["content_id", "size"])
    action = F.when(F.col("a").isNull(), "create").when(F.col("b").isNull(), "remove").when(same_in(["content_id"]), "skip").otherwise("update")
    rows = both.select(TREE, action.alias("action"), F.coalesce("b.size", "a.size", F.lit(0)).alias("size"), F.col("b.content_id").alias("content_id"))
    if stored is not None:
        have = stored.where("content_id IS NOT NULL").select(F.col("content_id").alias("_have")).distinct()
        rows = rows.join(have, F.col("content_id") == F.col("_have"), "left")
        missing = F.col("action").isin("create", "update") & F.col("content_id").isNotNull() & F.col("_have").isNull()
    else:
        missing = F.lit(False)
    return rows.groupBy(TREE, "action").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"), F.count_if(missing).alias("n_missing"))


def reverse_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """The delta that leads from ``new`` back to ``old``."""
    return tree_diff(new, old)
