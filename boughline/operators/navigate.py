"""Filters, navigation and reshaping of trees; every operator works on many manifests at once.

Inputs have the entry schema (``boughline.schema``). Lookups are joins on
``(manifest_id, path)``; a NULL path or manifest never matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boughline.functions.globs import glob
from boughline.operators.common import ancestors, last_seen, settle
from boughline.schema import ENTRY, TREE, located


def by_glob(entries: DataFrame, pattern: str) -> DataFrame:
    """Entries whose bare name matches a shell pattern."""
    return entries.where(glob(F.col("name"), pattern))


def by_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    return entries.where(F.col("name").startswith(prefix))


def at_depth(entries: DataFrame, depth: int) -> DataFrame:
    return entries.where(F.col("depth") == depth)


def last_by_name(entries: DataFrame) -> DataFrame:
    """Per manifest and bare name the entry that comes last."""
    rest = [c for c in entries.columns if c not in (TREE, "name")]
    return entries.groupBy(TREE, "name").agg(F.max_by(F.struct(*rest), "seq").alias("_e")).select(TREE, "name", "_e.*")


def build_paths(lines: DataFrame, order: str = "line_no", max_depth: int | None = None) -> DataFrame:
    """Adds ``path``, ``parent_path`` and ``is_orphan`` to rows of bare names and depths.

    An entry's parent at each level is the last directory before it at that
    level; it is the parent only if no shallower entry lies between. Rows
    without an open directory one level up are orphans with their bare name as
    path. Manifests are read in stretches (``last_seen``), so a long one is no
    single task's; ``max_depth`` (else computed) bounds the levels.
    """
    return paths_in_order(settle(lines), order, max_depth)


def paths_in_order(lines: DataFrame, order: str = "line_no", max_depth: int | None = None, boundary: str | None = None) -> DataFrame:
    """``build_paths`` of a table, which is read for the depth, for what stretches hold, and for the paths.

    ``boundary`` is a column that is NULL but in rows that part sections, whose
    depth is NULL: no directory stays open across them. ``base_id`` (the last
    boundary) and ``section_no`` (how many came before)
    are added then.
    """
    deepest = max_depth if max_depth is not None else (lines.agg(F.max("depth")).head()[0] or 0)
    is_dir, depth = F.col("name").endswith("/"), F.col("depth")
    parts = F.lit(False) if boundary is None else F.col(boundary).isNotNull()
    # Of the entries up to a level the last one decides: a directory of that level is open, anything else closes it.
    lasts = {f"_d{level}": F.when(parts | (depth <= level), F.struct(F.when((depth == level) & is_dir, F.col("name")).alias("name"))) for level in range(deepest)}
    if boundary is None:
        out = last_seen(lines, TREE, order, lasts) if lasts else lines
    else:
        # A boundary is never an entry, so what comes before an entry and what comes up to it have the same sections.
        out = last_seen(lines, TREE, order, {**lasts, "base_id": F.col(boundary)}, counted={"section_no": F.col(boundary)})
    opened = [F.col(f"_d{level}.name") for level in range(deepest)]
    names = F.slice(F.array(*opened).cast("array<string>"), F.lit(1), F.greatest(depth, F.lit(0)))
    out = out.withColumn("_names", names).withColumn("is_orphan", F.size(F.array_compact("_names")) != depth)
    out = out.withColumn("parent_path", F.when(F.col("is_orphan"), "").otherwise(F.array_join("_names", "")))
    return out.withColumn("path", F.concat("parent_path", "name")).drop("_names", *lasts)


def children(entries: DataFrame) -> DataFrame:
    """``manifest_id, path, child``: each directory with its direct entries."""
    dirs = entries.where("is_dir").select(F.col(TREE), "path")
    own = entries.select(F.col(TREE).alias("_t"), F.col("parent_path").alias("_p"), F.col("path").alias("child"))
    return dirs.join(own, (F.col(TREE) == F.col("_t")) & (F.col("path") == F.col("_p"))).select(TREE, "path", "child")


def sibling_counts(entries: DataFrame) -> DataFrame:
    """``manifest_id, path, n_siblings``: entries beside each one, itself excluded."""
    per = entries.groupBy(TREE, "parent_path").agg(F.count(F.lit(1)).alias("_n"))
    return entries.select(TREE, "parent_path", "path").join(per, [TREE, "parent_path"]).select(TREE, "path", (F.col("_n") - 1).alias("n_siblings"))


def ancestor_rows(entries: DataFrame) -> DataFrame:
    """``manifest_id, path, distance, ancestor``, nearest first, of the ancestors that are entries."""
    up = entries.select(TREE, "path", F.posexplode(F.reverse(ancestors(F.col("path")))).alias("_i", "ancestor"))
    dirs = entries.select(F.col(TREE).alias("_t"), F.col("path").alias("_a"))
    return up.join(dirs, (F.col(TREE) == F.col("_t")) & (F.col("ancestor") == F.col("_a")), "left_semi").select(TREE, "path", (F.col("_i") + 1).alias("distance"), "ancestor")


def descendant_counts(entries: DataFrame) -> DataFrame:
    """``manifest_id, path, n_descendants`` of every directory, by counting ancestors of entries."""
    below = entries.select(TREE, F.explode(ancestors(F.col("path"))).alias("path")).groupBy(TREE, "path").agg(F.count(F.lit(1)).alias("_n"))
    return entries.where("is_dir").select(TREE, "path").join(below, [TREE, "path"], "left").select(TREE, "path", F.coalesce("_n", F.lit(0)).alias("n_descendants"))


def _rebased(entries: DataFrame, path: Column) -> DataFrame:
    """Entries moved to another path, with the columns that follow from it."""
    moved = entries.withColumn("path", path)
    for name, value in located(F.col("path")).items():
        moved = moved.withColumn(name, value)
    return moved


def extract_subtree(entries: DataFrame, directory: str) -> DataFrame:
    """What lies below a directory, in every manifest that has it, as trees of their own."""
    inside = F.col("path").startswith(directory) & (F.col("path") != directory)
    return _rebased(entries.where(inside), F.substring(F.col("path"), F.lit(len(directory) + 1), F.length("path")))


def remove_subtree(entries: DataFrame, directory: str) -> DataFrame:
    """Entries without a directory and all below it."""
    return entries.where(~F.col("path").startswith(directory))


def inject_subtree(entries: DataFrame, directory: str, sub: DataFrame) -> DataFrame:
    """Replaces the content of a directory by ``sub`` in the manifests that have it; its own row stays."""
    kept = entries.where(~F.col("path").startswith(directory) | (F.col("path") == directory))
    holders = entries.where(F.col("path") == directory).select(TREE).distinct()
    put = _rebased(sub.join(holders, TREE, "left_semi"), F.concat(F.lit(directory), "path"))
    return kept.select(*ENTRY.names).unionByName(put.select(*ENTRY.names))


def move(entries: DataFrame, source: str, target: str) -> DataFrame:
    """Renames an entry; a directory takes all below it along."""
    hit = (F.col("path") == source) | (F.lit(source.endswith("/")) & F.col("path").startswith(source))
    path = F.when(hit, F.concat(F.lit(target), F.substring(F.col("path"), F.lit(len(source) + 1), F.length("path")))).otherwise(F.col("path"))
    return _rebased(entries, path)


def parent_closure(entries: DataFrame, perm: int | None = None) -> DataFrame:
    """Entries plus a row for every ancestor directory that is missing.

    Added rows are directories with ``perm`` (NULL: no known metadata).
    """
    need = entries.select(TREE, F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    missing = need.join(entries.select(TREE, "path"), [TREE, "path"], "left_anti")
    at = located(F.col("path"))
    added = missing.select(TREE, "path", *[v.alias(k) for k, v in at.items() if k != "is_dir"], F.lit(True).alias("is_dir"), F.lit(perm).cast("int").alias("perm"))
    if perm is not None:
        added = added.withColumn("file_type", F.lit("d"))
    return entries.unionByName(added, allowMissingColumns=True)


def paths_to_entries(paths: DataFrame, column: str = "path", tree: str | None = None) -> DataFrame:
    """A manifest from a list of paths: distinct trimmed paths and the directories they imply, all metadata unknown."""
    text = F.trim(F.col(column))
    found = paths.select((F.col(tree) if tree else F.lit("m")).alias(TREE), text.alias("path")).where("path IS NOT NULL AND path <> ''").distinct()
    at = located(F.col("path"))
    return parent_closure(found.select(TREE, "path", *[v.alias(k) for k, v in at.items()]))


def resolve(entries: DataFrame, path: str) -> DataFrame:
    """The entry at a path of each manifest, with or without a directory's final slash."""
    return entries.where(F.col("path").isin(path.rstrip("/"), path.rstrip("/") + "/"))


def expand_listings(entries: DataFrame, listings: DataFrame) -> DataFrame:
    """Inlines stored one-level listings below directories, level by level.

    ``listings`` has ``listing_id`` (an id of directories) and the entry
    columns ``name``, ``file_type``, ``perm``, ``ts``, ``size``,
    ``content_id``. Directories without a stored listing stay closed. Listings
    are inlined however deep they are nested; raises if one contains itself,
    which ids of contents can't.
    """
    stored = listings.select(F.col("listing_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("name", "file_type", "perm", "ts", "size", "content_id")])
    result = entries
    front = entries.where("is_dir AND content_id IS NOT NULL")
    level, most = 0, None
    while True:
        found = front.select(TREE, F.col("path").alias("_up"), F.col("content_id").alias("_c")).join(stored, F.col("_c") == F.col("_id"))
        rows = found.select(TREE, F.concat("_up", "_name").alias("path"), *[F.col(f"_{c}").alias(c) for c in ("file_type", "perm", "ts", "size", "content_id")])
        at = located(F.col("path"))
        front = rows.select("*", *[v.alias(k) for k, v in at.items()])
        front = settle(front)
        if front.isEmpty():
            break
        level += 1
        if level == 64:  # nested deeper than there are listings, one would contain itself
            most = listings.select("listing_id").distinct().count()
        if most is not None and level > most:
            raise ValueError("a stored listing contains itself")
        result = result.unionByName(front, allowMissingColumns=True)
        front = front.where("is_dir AND content_id IS NOT NULL")
    return result


def resolve_listing(listings: DataFrame, root_id: bytes, path: str) -> DataFrame:
    """The entry that a path leads to through stored listings: one step of ``name`` to ``content_id`` per component.

    ``listings`` is as for ``expand_listings``. Intermediate steps are ids of
    single directories; the result is empty where a step isn't found.
    """
    parts = [p for p in path.split("/") if p]
    at, found = root_id, listings.limit(0)
    for i, part in enumerate(parts):
        found = listings.where((F.col("listing_id") == F.lit(at)) & F.col("name").isin(part, part + "/"))
        if i + 1 < len(parts):
            step = found.where(F.col("name").endswith("/")).select("content_id").head()
            if step is None:
                return listings.limit(0)
            at = bytes(step[0])
    return found
