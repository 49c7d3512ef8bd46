"""Natural order of names and depth-first order of paths as plain sort keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boughline.operators.common import broadcast_up_to, discard, settle

# Marks within keys, below every character of a text (those that aren't are written as two).
_END, _TEXT, _NUMBER, _ESCAPE = "\x01", "\x02", "\x03", "\x05"


def _plain(text: Column) -> Column:
    """``text`` with the characters up to the last mark written as two, in the same order."""
    marks = [chr(i) for i in range(ord(_ESCAPE) + 1)]
    written = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(_ESCAPE + chr(ord(c) + ord("A")))), [_ESCAPE, *marks[:-1]], text)
    return F.when(text.rlike(r"[\x00-\x05]"), written).otherwise(text)


def _counted(text: Column) -> Column:
    """The length of ``text`` behind the number of its own digits."""
    n = F.length(text)
    return F.when(n < 10, F.concat(F.lit("1"), n.cast("string"))).otherwise(F.concat(F.length(n.cast("string")).cast("string"), n.cast("string")))


def _numbered(text: Column) -> Column:
    """``text`` with its runs of digits written so that they sort by value, then by length."""

    # Within a lambda every mention is evaluated, so no regular expression stands there.
    def run(part: Column) -> Column:
        digits = F.when(part.startswith("0"), F.when(F.ltrim(part, F.lit("0")) == "", "0").otherwise(F.ltrim(part, F.lit("0")))).otherwise(part)
        return F.when(F.ascii(part).between(ord("0"), ord("9")), F.concat(F.lit(_NUMBER), _counted(digits), digits, _counted(part))).otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("([0-9]++|[^0-9]++)"), 1), run), "")


def natural_key(name: Column) -> Column:
    """Sort key (text, compared by bytes): runs of digits by value, then by length; text by bytes and before digits; fewer runs first.

    A value is compared as the length of its digits without leading zeros and
    those digits, so runs of any length are exact. A length is written behind
    the number of its own digits. NULL for NULL.
    """

    text = _plain(name)
    first = F.when(name.rlike("^[^0-9]"), F.lit(_TEXT)).otherwise("")
    return F.concat(first, F.when(name.rlike("[0-9]"), _numbered(text)).otherwise(text), F.lit(_END))


def path_parts(path: Column) -> Column:
    """Components of a path; directories keep their final slash."""
    return F.regexp_extract_all(path, F.lit("([^/]+/?)"), 1)


def path_key(path: Column) -> Column:
    """Sort key (text) of the canonical order: depth-first, files before directories, names in natural order."""
    part = lambda p: F.concat(F.when(p.endswith("/"), _TEXT).otherwise(_END), natural_key(p))
    each = F.array_join(F.transform(path_parts(path), part), "")
    # Where no component is empty, the marks between components are put into the path as a whole, and the last one's mark is that of a file or directory.
    text = F.regexp_replace(F.regexp_replace(_plain(path), "/(?=[^0-9])", f"/{_END}{_TEXT}{_TEXT}"), "/(?=[0-9])", f"/{_END}{_TEXT}")
    text = F.when(path.endswith("/"), text).otherwise(F.regexp_replace(text, f"/{_END}{_TEXT}([^/]*+)$", f"/{_END}{_END}$1"))
    text = F.when(path.rlike("[0-9]"), _numbered(text)).otherwise(text)
    first = F.concat(F.when(path.contains("/"), _TEXT).otherwise(_END), F.when(path.rlike("^[^0-9]"), F.lit(_TEXT)).otherwise(""))
    return F.when((path == "") | path.rlike("^/|//"), each).otherwise(F.concat(first, text, F.lit(_END)))


def canonical_sort(entries: DataFrame, tree: str = "manifest_id") -> DataFrame:
    """Entries in canonical order; of rows of one path the last (largest ``seq``) stays.

    The sort is range-partitioned over all trees, whatever their sizes.
    """
    last = entries.groupBy(tree, "path").agg(F.max_by(F.struct(*[c for c in entries.columns if c not in (tree, "path")]), "seq").alias("_e"))
    return last.select(tree, "path", "_e.*").orderBy(tree, path_key(F.col("path")), "path")


def ranked(df: DataFrame, group: str, key: list[Column], out: str, costly: bool = False) -> DataFrame:
    """Adds ``out``, the 1-based place of each row within ``group`` by ``key``.

    Rows are range-partitioned by group and key and sorted within the ranges
    (one shuffle); a row's place follows from its place in its range and from
    the rows that the ranges before hold of the group, so a group of any size
    is ranked by many tasks. Pass narrow rows: they are written once.
    ``costly`` keys (and rows) are written before, since ranges are found by a
    pass of its own over them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_key{i}" for i in range(len(key))]
    keyed = df.select("*", *[k.alias(c) for c, k in zip(names, key, strict=True)])
    if costly:
        keyed = settle(keyed)
    cut = keyed.repartitionByRange(n, group, *names).sortWithinPartitions(group, *names).drop(*names)
    cut = settle(cut.withColumn("_at", F.monotonically_increasing_id()))  # the range in the upper bits, the place in it below
    discard(keyed)
    of_range = F.shiftright("_at", 33)
    held = cut.groupBy(F.col(group).alias("_rg"), of_range.alias("_r")).agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_rg").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = broadcast_up_to(held.select("_rg", "_r", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least") + 1).alias("_start")))
    joined = cut.join(starts, F.col(group).eqNullSafe(F.col("_rg")) & (of_range == F.col("_r")))
    return joined.withColumn(out, F.col("_at") + F.col("_start")).drop("_at", "_rg", "_r", "_start")
