"""Numbered files folded into ranges, and ranges expanded."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boughline.functions.ids import id_text, parse_id
from boughline.operators.common import settle
from boughline.schema import ENTRY, TREE, located

_PATTERN = r"^(.*?)\[([0-9][0-9,:-]*)\](.*)$"
#: Characters of an id's text.
_ID_CHARS = 90
_RANGES = "array<struct<first: bigint, last: bigint, step: bigint>>"


def is_sequence(name: Column) -> Column:
    """Whether a name has a bracketed list of numbers or ranges."""
    return name.rlike(r"^.*?\[[0-9]+(-[0-9]+(:[0-9]+)?)?(,[0-9]+(-[0-9]+(:[0-9]+)?)?)*\]")


def is_sequence_text(escaped: Column) -> Column:
    """``is_sequence`` of a name in manifest text, where escaped brackets are plain ones."""
    return escaped.contains("[") & escaped.rlike(r"^(?:[^\\\[]|\\.)*\[[0-9]+(-[0-9]+(:[0-9]+)?)?(,[0-9]+(-[0-9]+(:[0-9]+)?)?)*\]")


def parse_sequence(name: Column) -> Column:
    """``prefix, suffix, padding, ranges`` of a sequence's name; NULL for other names."""
    inner = F.regexp_extract(name, _PATTERN, 2)

    def one(part: Column) -> Column:
        first = F.regexp_extract(part, "^([0-9]+)", 1)
        last = F.regexp_extract(part, "-([0-9]+)", 1)
        step = F.regexp_extract(part, ":([0-9]+)", 1)
        number = lambda c: c.try_cast("bigint")
        return F.struct(number(first).alias("first"), F.coalesce(number(last), number(first)).alias("last"), F.coalesce(number(step), F.lit(1).cast("bigint")).alias("step"))

    width = F.length(F.regexp_extract(inner, "^([0-9]+)", 1))
    parsed = F.struct(F.regexp_extract(name, _PATTERN, 1).alias("prefix"), F.regexp_extract(name, _PATTERN, 3).alias("suffix"), width.alias("padding"), F.transform(F.split(inner, ","), one).alias("ranges"))
    return F.when(is_sequence(name), parsed)


def frame_count(ranges: Column) -> Column:
    """Members of ranges, each counted for itself."""
    return F.aggregate(ranges, F.lit(0).cast("bigint"), lambda n, r: n + F.floor((r["last"] - r["first"]) / r["step"]) + 1)


def has_frame(ranges: Column, frame: Column) -> Column:
    return F.exists(ranges, lambda r: (frame >= r["first"]) & (frame <= r["last"]) & ((frame - r["first"]) % r["step"] == 0))


def _padded(number: Column, width: Column) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, F.lit("0"))).otherwise(text)


def expand_sequences(entries: DataFrame) -> DataFrame:
    """``manifest_id, path, frame_no, frame, member``: the members of each sequence entry in range order."""
    parsed = entries.withColumn("_s", parse_sequence(F.col("name"))).where("_s IS NOT NULL")
    frames = F.flatten(F.transform(F.col("_s.ranges"), lambda r: F.sequence(r["first"], r["last"], r["step"])))
    each = parsed.select(TREE, "path", "parent_path", "_s", F.posexplode(frames).alias("_i", "frame"))
    member = F.concat(F.coalesce("parent_path", F.lit("")), F.col("_s.prefix"), _padded(F.col("frame"), F.col("_s.padding")), F.col("_s.suffix"))
    return each.select(TREE, "path", (F.col("_i") + 1).alias("frame_no"), "frame", member.alias("member"))


_RUN = ["parent_path", "prefix", "suffix", "width", "link"]


def _numbered(entries: DataFrame) -> DataFrame:
    """Files with a number in their names: ``manifest_id``, the columns of ``_RUN``, ``frame`` and the entry's own."""
    part = lambda i: F.regexp_extract("name", "^([^0-9]*)([0-9]+)(.*)$", i)
    files = entries.where(~F.col("is_dir") & F.col("name").rlike("[0-9]"))
    keyed = files.withColumns({"prefix": part(1), "suffix": part(3), "width": F.length(part(2)), "link": F.coalesce(F.col("file_type") == "l", F.lit(False)), "frame": part(2).try_cast("bigint")})
    return keyed.where("frame IS NOT NULL")


def _runs(numbered: DataFrame, least: int, member: Column) -> DataFrame:
    """Runs that are folded, with ``members``: ``member`` of each file in frame order."""
    group = [TREE, *_RUN]
    island = numbered.select(*group, "frame", "size", "ts", "perm", "content_id", member.alias("_m")).withColumn("_i", F.col("frame") - F.row_number().over(Window.partitionBy(*group).orderBy("frame")))
    runs = island.groupBy(*group, "_i").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.when(F.count("size") == F.count(F.lit(1)), F.sum("size")).alias("size"),
        F.max("ts").alias("ts"),
        F.min("perm").alias("perm"),
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.count("content_id").alias("_known"),
        F.transform(F.array_sort(F.collect_list(F.struct("frame", "_m"))), lambda x: x["_m"]).alias("members"),
    )
    kept = runs.where((F.col("n_frames") >= least) & (F.col("link") | (F.col("_known") == F.col("n_frames"))))
    name = F.concat("prefix", F.lit("["), _padded(F.col("first_frame"), F.col("width")), F.lit("-"), _padded(F.col("last_frame"), F.col("width")), F.lit("]"), "suffix")
    return kept.withColumn("name", name)


def fold_sequences(entries: DataFrame, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` numbered files as one entry each.

    ``manifest_id, parent_path, name, n_frames, size, ts, perm, first_frame,
    last_frame, member_ids``: files of one directory whose names differ in the
    first run of digits only (of one width; symlinks apart) and whose numbers
    follow each other. Size and moment are the sum and the latest (the size unknown if one
    is), permissions the smallest. Runs with an unknown id aren't folded, but
    for symlinks. Runs are found by number minus rank; ``member_ids`` is in
    frame order, as long as the run.
    """
    runs = _runs(_numbered(entries), least, F.col("content_id")).withColumnRenamed("members", "member_ids")
    return runs.select(TREE, "parent_path", "name", "n_frames", "size", "ts", "perm", "first_frame", "last_frame", "member_ids")


def fold_tree(entries: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """A tree with its runs folded, and the range data ``manifest_id, content_id, members`` that bring their members back.

    A run of files becomes one entry whose id is that of its members' id texts,
    written one after the other; that text is its range data, kept once. A run
    of symlinks without ids has none.
    """
    numbered = _numbered(entries.select(*ENTRY.names))
    runs = settle(_runs(numbered, least, id_text(F.col("content_id"))))
    whole = F.col("_known") == F.col("n_frames")
    path = F.concat("parent_path", "name")
    folded = runs.select(
        TREE, path.alias("path"), "name", "parent_path", located(path)["depth"].alias("depth"), F.lit(False).alias("is_dir"), F.when(F.col("link"), "l").otherwise("-").alias("file_type"), "perm", "ts", "size",
        F.when(whole, sequence_id(F.col("members"))).alias("content_id"), F.lit(True).alias("is_sequence"), F.col("name").alias("pattern"), F.col("first_frame").alias("seq"),
    )
    inside = numbered.alias("n").join(runs.alias("r"), [F.col(f"n.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [TREE, *_RUN]] + [F.col("n.frame").between(F.col("r.first_frame"), F.col("r.last_frame"))], "left_semi")
    rest = entries.select(*ENTRY.names).join(inside.select(TREE, "path"), [TREE, "path"], "left_anti").select(*ENTRY.names)
    return rest.unionByName(folded, allowMissingColumns=True), runs.where(whole).select(TREE, sequence_id(F.col("members")).alias("content_id"), F.array_join("members", "").alias("members")).distinct()


def expand_tree(entries: DataFrame, range_data: DataFrame) -> DataFrame:
    """A tree with its sequences expanded: each member an entry of its own, with its id where range data tell it.

    Members have the permissions and moment of their sequence; their sizes are unknown.
    """
    marked = settle(entries.where("is_sequence").select(TREE, "path", "parent_path", "name", "file_type", "perm", "ts", "content_id", "seq"))
    each = expand_sequences(marked).alias("x").join(marked.alias("s"), [TREE, "path"])
    known = range_data.select(F.col(TREE).alias("_t"), F.col("content_id").alias("_c"), "members").distinct()
    found = each.join(known, (F.col(TREE) == F.col("_t")) & (F.col("content_id") == F.col("_c")), "left")
    own = F.substring("members", (F.col("frame_no") - 1) * _ID_CHARS + 1, F.lit(_ID_CHARS))
    at = located(F.col("member"))
    rows = found.select(TREE, F.col("member").alias("path"), *[v.alias(k) for k, v in at.items()], "file_type", "perm", "ts", "seq", parse_id(own).alias("content_id"), F.lit(False).alias("is_sequence"))
    plain = entries.where("NOT coalesce(is_sequence, false)").select(*ENTRY.names)
    return plain.unionByName(rows, allowMissingColumns=True)


def normal_ranges(frames: list[int] | np.ndarray, least: int = 3) -> list[tuple[int, int, int]]:
    """Numbers as ranges: maximal runs of step 1, then progressions of at least ``least`` terms, then singles, by first number.

    Runs are numbers of one difference to their rank. Progressions are stretches
    of equal differences among the numbers that are left; where two stretches
    share a number, the first one long enough takes it.
    """
    numbers = np.unique(np.asarray(frames, np.int64))
    _, first, size = np.unique(numbers - np.arange(len(numbers)), return_index=True, return_counts=True)
    together = size > 1
    out = [(int(a), int(a + n - 1), 1) for a, n in zip(numbers[first[together]], size[together], strict=True)]
    alone = numbers[first[~together]]
    gaps = np.diff(alone)
    turns = np.flatnonzero(np.diff(gaps)) + 1
    taken, free = np.zeros(len(alone), bool), 0
    for low, high in zip([0, *turns], [*turns, len(gaps)], strict=True):  # positions low..high of ``alone`` have one gap
        low = max(low, free)
        if len(gaps) and high - low + 1 >= least:
            out.append((int(alone[low]), int(alone[high]), int(gaps[low])))
            taken[low : high + 1] = True
            free = high + 1
    return sorted([*out, *((int(a), int(a), 1) for a in alone[~taken])])


def frame_ranges(frames: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """``keys, first, last, step``: the ``normal_ranges`` of the numbers of each key, a row per range, in windows.

    Runs are found by number minus rank. Of the numbers left alone a stretch of
    equal differences is taken if it has more than three terms, or three of
    which the stretch before doesn't take the first; the latter alternates
    along neighbouring stretches of three. Repeated and NULL numbers don't count.
    """
    known = frames.where(F.col(frame).isNotNull()).select(*keys, F.col(frame).cast("bigint").alias("_f")).distinct()
    by = Window.partitionBy(*keys).orderBy("_f")
    runs = known.withColumn("_i", F.col("_f") - F.row_number().over(by)).groupBy(*keys, "_i").agg(F.min("_f").alias("first"), F.max("_f").alias("last"))
    runs = settle(runs.drop("_i"))
    by = Window.partitionBy(*keys).orderBy("first")
    alone = runs.where("first = last").select(*keys, "first", (F.lead("first").over(by) - F.col("first")).alias("gap")).where("gap IS NOT NULL")
    turned = F.coalesce(F.lag("gap").over(by) != F.col("gap"), F.lit(True)).cast("int")
    numbered = alone.withColumn("_s", F.sum(turned).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stretches = numbered.groupBy(*keys, "_s", F.col("gap").alias("step")).agg(F.min("first").alias("first"), (F.max("first") + F.col("gap")).alias("last"), (F.count(F.lit(1)) + 1).alias("n"))
    by = Window.partitionBy(*keys).orderBy("_s")
    # Stretches of exactly three in a row: the place among them and whether the one before them is longer.
    block = F.sum((F.col("n") != 3).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stretches = stretches.withColumn("_longer", F.coalesce(F.last(F.when(F.col("n") != 3, F.col("n") > 3), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False)))
    stretches = stretches.withColumn("_block", block)
    place = F.count_if(F.col("n") == 3).over(Window.partitionBy(*keys, "_block").orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    took = F.when(F.col("n") > 3, True).when(F.col("n") == 3, (place + F.col("_longer").cast("int")) % 2 == 1).otherwise(False)
    stretches = stretches.withColumn("_took", took).withColumn("_start", F.when(F.coalesce(F.lag("_took").over(by), F.lit(False)), F.col("first") + F.col("step")).otherwise(F.col("first")))
    chosen = stretches.where("_took").select(*keys, F.col("_start").alias("first"), "last", "step")
    inside = chosen.select(*keys, F.explode(F.sequence("first", "last", "step")).alias("first"))
    match = [F.col(f"r.{k}").eqNullSafe(F.col(f"i.{k}")) for k in [*keys, "first"]]
    rest = runs.alias("r").join(inside.alias("i"), match, "left_anti").select("r.*", F.lit(1).cast("bigint").alias("step"))
    return rest.unionByName(chosen)


@functools.cache
def _normal_udf():
    @F.arrow_udf(_RANGES)
    def normal(lists: pa.Array) -> pa.Array:
        found = [None if x is None else normal_ranges(x) for x in lists.to_pylist()]
        flat = np.array([r for x in found if x for r in x], np.int64).reshape(-1, 3)
        offsets = np.concatenate([[0], np.cumsum([len(x or ()) for x in found])]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["first", "last", "step"])
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([x is None for x in found]))

    return normal


def normalize_ranges(ranges: Column) -> Column:
    """``normal_ranges`` of a column of ranges."""
    return _normal_udf()(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["first"], r["last"], r["step"])))))


def sequence_id(member_texts: Column, bits: int = 512) -> Column:
    """The id of a sequence: the hash of its members' id texts, one after the other."""
    return F.unhex(F.sha2(F.array_join(member_texts, ""), bits))
