"""The entry schema and helpers to build small manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row per entry of a manifest; unknown values are NULL.
ENTRY = T.StructType(
    [
        T.StructField("manifest_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("perm", T.IntegerType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("size", T.LongType()),
        T.StructField("link_target", T.StringType()),
        T.StructField("content_id", T.BinaryType()),
        T.StructField("hard_link", T.IntegerType()),
        T.StructField("flow_op", T.StringType()),
        T.StructField("flow_target", T.StringType()),
        T.StructField("is_sequence", T.BooleanType()),
        T.StructField("pattern", T.StringType()),
    ]
)

#: Fields in which two entries are identical.
IDENTITY = ["name", "file_type", "perm", "ts", "size", "content_id", "link_target", "hard_link", "flow_op", "flow_target"]
TREE = "manifest_id"


def located(path: F.Column) -> dict[str, F.Column]:
    """The columns that follow from a path."""
    parent = F.regexp_replace(path, "[^/]+/?$", "")
    return {
        "name": F.regexp_extract(path, "([^/]+/?)$", 1),
        "parent_path": parent,
        "depth": F.size(F.split(parent, "/")) - 1,
        "is_dir": path.endswith("/"),
    }


def build(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Entries from dictionaries with at least ``path``; the rest is derived or NULL."""
    full = []
    for i, row in enumerate(rows):
        path = row["path"]
        parts = [p for p in path.split("/") if p]
        name = parts[-1] + ("/" if path.endswith("/") else "")
        base = {"manifest_id": "m", "seq": i, "depth": len(parts) - 1, "name": name, "parent_path": path[: len(path) - len(name)], "is_dir": path.endswith("/"), "file_type": "d" if path.endswith("/") else "-", "is_sequence": False}
        full.append(tuple((base | row).get(f.name) for f in ENTRY))
    return spark.createDataFrame(full, ENTRY)


def unique_entries(entries: DataFrame) -> DataFrame:
    """Repeated rows once, in the entry schema (``(manifest_id, path)`` names one entry); filters reach below this."""
    return entries.select(*ENTRY.names).distinct()
