"""Statistics, the documented recipes, and validation of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from boughline.functions.fields import mode_text, valid_name
from boughline.functions.order import path_key, ranked
from boughline.operators.common import last_seen
from boughline.schema import TREE


def manifest_stats(entries: DataFrame) -> DataFrame:
    """``manifest_id, n_files, n_dirs, total_size``; unknown and negative sizes count as 0."""
    return entries.groupBy(TREE).agg(F.count_if(~F.col("is_dir")).alias("n_files"), F.count_if("is_dir").alias("n_dirs"), F.sum(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))).alias("total_size"))


def field_stats(entries: DataFrame) -> DataFrame:
    """What a validator reports per manifest: counts by type, unknown fields, extremes."""
    c = F.col
    return entries.groupBy(TREE).agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_if(F.coalesce(c("file_type") == "l", F.lit(False))).alias("n_links"),
        F.count_if(c("perm").isNull()).alias("n_no_mode"),
        F.count_if(c("ts").isNull()).alias("n_no_ts"),
        F.count_if(c("size").isNull()).alias("n_no_size"),
        F.count("content_id").alias("n_ids"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max("depth").alias("max_depth"),
        F.max("size").alias("max_size"),
        F.max(F.length("name")).alias("name_width"),
    )


def extension(name: Column) -> Column:
    """What follows the last dot of a name; ``none`` without one."""
    found = F.regexp_extract(name, r"\.([^./]*)$", 1)
    return F.when(name.contains("."), found).otherwise("none")


def count_by_extension(entries: DataFrame) -> DataFrame:
    return entries.where("NOT is_dir").groupBy(TREE, extension(F.col("name")).alias("extension")).agg(F.count(F.lit(1)).alias("n_files"))


def bytes_by_top_directory(entries: DataFrame) -> DataFrame:
    """Bytes of files per first directory; files of the root as ``(root)``."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("(root)")
    return entries.where("NOT is_dir").groupBy(TREE, top.alias("top")).agg(F.sum(F.coalesce("size", F.lit(0))).alias("n_bytes"))


def larger_than(entries: DataFrame, size: int, include_dirs: bool = True) -> DataFrame:
    return entries.where((F.col("size") > size) & (F.lit(include_dirs) | ~F.col("is_dir")))


def modified_after(entries: DataFrame, moment: str, include_dirs: bool = True) -> DataFrame:
    return entries.where((F.col("ts") > F.lit(moment).cast("timestamp_ntz")) & (F.lit(include_dirs) | ~F.col("is_dir")))


def duplicate_ids(entries: DataFrame) -> DataFrame:
    """``manifest_id, content_id, n``: ids that more than one entry has."""
    return entries.where("content_id IS NOT NULL").groupBy(TREE, "content_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sharing_rows(entries: DataFrame) -> DataFrame:
    """Entries whose id another entry of the manifest has: ``manifest_id, path, content_id``."""
    return entries.select(TREE, "path", "content_id").join(duplicate_ids(entries), [TREE, "content_id"], "left_semi").select(TREE, "path", "content_id")


def wasted_bytes(entries: DataFrame) -> DataFrame:
    """``manifest_id, wasted``: bytes of further copies, all entries of an id counted; of an id's known sizes the last one counts."""
    known = F.when(F.col("size").isNotNull(), F.col("seq"))
    per = entries.where("content_id IS NOT NULL").groupBy(TREE, "content_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("size", known).alias("s"))
    return per.groupBy(TREE).agg(F.sum(F.coalesce("s", F.lit(0)) * (F.col("n") - 1)).alias("wasted"))


def largest(entries: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest entries over all manifests, ties by manifest and path."""
    return entries.where("size IS NOT NULL").orderBy(F.desc("size"), TREE, "path").limit(k)


def newest(entries: DataFrame, k: int) -> DataFrame:
    return entries.where("ts IS NOT NULL").orderBy(F.desc("ts"), TREE, "path").limit(k)


def id_width(entries: DataFrame) -> DataFrame:
    """The column at which an aligned text shows ids, per manifest: 80, or more by tens for long lines."""
    size = F.length(F.format_number(F.coalesce("size", F.lit(0)), 0))
    per = entries.groupBy(TREE).agg(F.max(size).alias("_s"), F.max(F.col("depth") * 2 + F.length("name") + F.coalesce(F.length("link_target") + 4, F.lit(0))).alias("_n"))
    need = F.lit(10 + 1 + 24 + 1 + 1) + F.col("_s") + F.col("_n") + 10
    return per.select(TREE, F.greatest(F.lit(80), F.ceil(need / 10) * 10).cast("bigint").alias("id_column"))


def structural_issues(entries: DataFrame) -> DataFrame:
    """``manifest_id, path, issue``: illegal names and paths that occur more than once."""
    bad = entries.where(~valid_name(F.col("name"))).select(TREE, "path", F.lit("name").alias("issue"))
    twice = entries.groupBy(TREE, "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(TREE, "path", F.lit("duplicate").alias("issue"))
    return bad.unionByName(twice).distinct()


def order_issues(entries: DataFrame) -> DataFrame:
    """``manifest_id, seq, issue``: depth jumps of more than one level, and files after directories of one parent, in input order.

    Depths are compared in stretches of a manifest, files with the first
    directory of their parent; neither takes a whole manifest into one task.
    """
    c = F.col
    placed = last_seen(entries.select(TREE, "seq", "depth", "is_dir", "parent_path"), TREE, "seq", {"_before": c("depth")})
    first = placed.where("is_dir").groupBy(c(TREE).alias("_t"), c("parent_path").alias("_p")).agg(F.min("seq").alias("_first"))
    marked = placed.join(first, c(TREE).eqNullSafe(c("_t")) & c("parent_path").eqNullSafe(c("_p")), "left")
    jump, late = c("depth") - F.coalesce("_before", F.lit(-1)) > 1, ~c("is_dir") & (c("seq") > c("_first"))
    issues = F.array_compact(F.array(F.when(jump, F.lit("depth jump")), F.when(late, F.lit("file after directory"))))
    return marked.select(TREE, "seq", F.explode(issues).alias("issue"))


def mode_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy(TREE, F.coalesce(mode_text(F.col("file_type"), F.col("perm")), F.lit("-")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def out_of_order(entries: DataFrame) -> DataFrame:
    """``manifest_id, n_moved``: entries whose place by ``seq`` isn't their canonical one; 0 for a manifest in order."""
    by_seq = ranked(entries.select(TREE, "path", "seq"), TREE, [F.col("seq"), F.col("path")], "_a").select(TREE, "path", "_a")
    by_key = ranked(entries.select(TREE, "path"), TREE, [path_key(F.col("path")), F.col("path")], "_b").select(TREE, "path", "_b")
    return by_seq.join(by_key, [TREE, "path"]).groupBy(TREE).agg(F.count_if(F.col("_a") != F.col("_b")).alias("n_moved"))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a progress observation: rows, directories and bytes that passed, filled when an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_entries"), F.count_if("is_dir").alias("n_dirs"), F.sum(F.coalesce("size", F.lit(0))).alias("n_bytes")), seen
