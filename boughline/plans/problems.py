"""Queries of the general data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boughline.operators.balance import balanced_aggregate, balanced_join
from boughline.operators.changefeed import apply_changes
from boughline.operators.common import settle
from boughline.operators.snapshots import series_changes
from boughline.plans import feedsql
from boughline.sources.manifest_lines import load_manifest_lines, rejected_lines
from boughline.sources.tables import table

#: Part of all rows from which a value counts as holding most of them.
HEAVY_SHARE = 0.025


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_lines(table(spark, sf_dir, "manifest_lines")).select("manifest_id", "line_no", "field")


def p1_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_manifest_lines(table(spark, sf_dir, "manifest_lines"))[0].select(
        "manifest_id", "line_no", "depth", "name", "file_type", "perm", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"), "size", "link_target", "flow_target", "id_text"
    )


def p1_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = load_manifest_lines(table(spark, sf_dir, "manifest_lines"))[1]
    return bad.groupBy("manifest_id", "field", "message").agg(F.count(F.lit(1)).alias("n_lines"))


def _keyed(entries: DataFrame) -> DataFrame:
    key = F.explode(
        F.array(
            F.struct(F.lit("content_id").alias("field_name"), F.col("content_id").alias("key")),
            F.struct(F.lit("depth").alias("field_name"), F.col("depth").cast("string").cast("binary").alias("key")),
        )
    )
    return entries.select(key.alias("k"), "size").select("k.field_name", "k.key", "size")


def _key_value() -> F.Column:
    text = F.when(F.col("field_name") == "depth", F.col("key").cast("string")).otherwise(F.lower(F.hex("key")))
    return text.alias("key_value")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "entries")
    per_key = settle(balanced_aggregate(_keyed(entries).drop("size"), ["field_name", "key"], {"n_rows": (F.count(F.lit(1)), "sum")}, _tasks(spark)))
    total = per_key.where("field_name = 'depth'").agg(F.sum("n_rows")).head()[0] or 0  # every row has one depth, NULL too
    return per_key.where(F.col("key").isNotNull() & (F.col("n_rows") >= F.lit(total * HEAVY_SHARE))).select("field_name", _key_value())


def p2_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    partials = {
        "n_rows": (F.count(F.lit(1)), "sum"),
        "n_sized": (F.count("size"), "sum"),
        "total_size": (F.sum("size"), "sum"),
        "largest": (F.max("size"), "max"),
        "smallest": (F.min("size"), "min"),
    }
    per_key = balanced_aggregate(_keyed(table(spark, sf_dir, "entries")), ["field_name", "key"], partials, _tasks(spark))
    return per_key.select("field_name", _key_value(), *partials)


def p2_depth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry against the mean size of its depth: rows move by the placement, the means go to the shards only."""
    entries = table(spark, sf_dir, "entries").where("size IS NOT NULL").select("manifest_id", "seq", "depth", "size")
    means = balanced_aggregate(entries, ["depth"], {"_s": (F.sum("size"), "sum"), "_n": (F.count("size"), "sum")}, _tasks(spark))
    means = means.select("depth", F.floor(F.col("_s") / F.col("_n")).alias("mean_size"))
    joined = balanced_join(entries, means, ["depth"], _tasks(spark), F.xxhash64("manifest_id", "seq"))
    return joined.groupBy("manifest_id", "depth").agg(F.count_if(F.col("size") > F.col("mean_size")).alias("n_above"), F.count(F.lit(1)).alias("n_rows"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = series_changes(table(spark, sf_dir, "entries"), table(spark, sf_dir, "manifests"), "volume_id", "manifest_id", "taken_at", "path", ["content_id", "ts", "size"])
    return changes.select(F.col("snapshot").alias("manifest_id"), F.col("key").alias("path"), "change_type")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = apply_changes(table(spark, sf_dir, "patch_sections"), table(spark, sf_dir, "patch_entries"))
    return state.select("chain_id", "path", F.coalesce(F.lower(F.hex("content_id")), F.lit("")).alias("content_id_hex"))


QUERIES = {f.__name__: f for f in (p1_found, p1_entries, p1_messages, p2_found, p2_key_stats, p2_depth_rows, p5_found, p6_found)}

_VALUE = "CASE WHEN field_name = 'depth' THEN decode(key) ELSE lower(hex(key)) END AS key_value"
_KEYED = (
    "(SELECT 'content_id' AS field_name, content_id AS key, size FROM entries UNION ALL "
    "SELECT 'depth', encode(CAST(depth AS VARCHAR)), size FROM entries)"
)

SQL = {
    "p1_found": feedsql.P1_FOUND,
    "p1_entries": feedsql.P1_ENTRIES,
    "p1_messages": feedsql.P1_MESSAGES,
    "p6_found": feedsql.STATE,
    "p2_found": f"""
        SELECT field_name, {_VALUE} FROM {_KEYED} WHERE key IS NOT NULL
        GROUP BY field_name, key HAVING count(*) >= 0.025 * (SELECT count(*) FROM entries)""",
    "p2_key_stats": f"""
        SELECT field_name, {_VALUE}, count(*) AS n_rows, count(size) AS n_sized, CAST(sum(size) AS BIGINT) AS total_size,
               max(size) AS largest, min(size) AS smallest
        FROM {_KEYED} GROUP BY field_name, key""",
    "p2_depth_rows": """
        WITH e AS (SELECT manifest_id, depth, size FROM entries WHERE size IS NOT NULL),
             m AS (SELECT depth, CAST(floor(CAST(sum(size) AS DOUBLE) / count(size)) AS BIGINT) AS mean_size FROM e GROUP BY depth)
        SELECT manifest_id, depth, CAST(count(*) FILTER (WHERE size > mean_size) AS BIGINT) AS n_above, count(*) AS n_rows
        FROM e JOIN m USING (depth) GROUP BY manifest_id, depth""",
    "p5_found": """
        WITH m AS (SELECT manifest_id, min(volume_id) AS volume_id, min(taken_at) AS taken_at FROM manifests
                   WHERE volume_id IS NOT NULL AND taken_at IS NOT NULL GROUP BY manifest_id),
             p AS (SELECT manifest_id, lag(manifest_id) OVER (PARTITION BY volume_id ORDER BY taken_at, manifest_id) AS older FROM m),
             e AS (SELECT DISTINCT manifest_id, path, content_id, ts, size FROM entries),
             n AS (SELECT p.manifest_id, e.path, e.content_id, e.ts, e.size FROM p JOIN e USING (manifest_id) WHERE p.older IS NOT NULL),
             o AS (SELECT p.manifest_id, e.path, e.content_id, e.ts, e.size FROM p JOIN e ON e.manifest_id = p.older)
        SELECT coalesce(n.manifest_id, o.manifest_id) AS manifest_id, coalesce(n.path, o.path) AS path,
               CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change_type
        FROM n FULL JOIN o ON n.manifest_id = o.manifest_id AND n.path = o.path
        WHERE n.path IS NULL OR o.path IS NULL OR n.content_id IS DISTINCT FROM o.content_id
           OR n.ts IS DISTINCT FROM o.ts OR n.size IS DISTINCT FROM o.size""",
}
