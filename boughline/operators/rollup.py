"""Sizes, moments and identities rolled up the levels of trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boughline.functions.fields import canonical_line, moment_text
from boughline.functions.ids import encode_digests
from boughline.functions.order import natural_key
from boughline.operators.common import settle
from boughline.schema import ENTRY, TREE


#: Levels of a tree that one job goes up; lineage is cut between jobs.
LEVELS_AT_ONCE = 6
#: Stands for the text of an id where only its length matters.
_ID_WIDTH = "c4" + "1" * 88


def _levels(table: DataFrame) -> list[list[int]]:
    """The depths that occur, deepest first, in groups that one job takes."""
    depths = sorted((r[0] for r in table.select("depth").distinct().collect()), reverse=True)  # as many as the trees are deep
    return [depths[i : i + LEVELS_AT_ONCE] for i in range(0, len(depths), LEVELS_AT_ONCE)]


def roll_up(entries: DataFrame, line: Column | None = None, include_listing: bool = True) -> DataFrame:
    """Resolves unknown sizes and moments of directories: ``manifest_id, path, size, ts`` of all directories.

    A directory's size is the sum of its children's plus (``include_listing``)
    the bytes of its own one-level listing, its moment the latest of theirs;
    any unknown child makes it unknown, an empty directory has size 0 and no
    moment. Known values stay and still count for the parent.

    Files are summed per directory in one aggregate over all levels; directories
    go up level by level as narrow rows (their lines are measured, not made).
    ``line`` is the canonical line of an entry (over its columns, with ``-``
    for an unknown size or moment).
    """
    text = canonical_line(identity=F.when(F.col("content_id").isNotNull(), F.lit(_ID_WIDTH))) if line is None else line
    length = F.octet_length(text) + 1 if include_listing else F.lit(0)
    sums = lambda df: df.groupBy(TREE, "parent_path").agg(
        F.sum("size").alias("s"), F.sum("bytes").alias("b"), F.max("ts").alias("t"), F.bool_or(F.col("size").isNull()).alias("no_s"), F.bool_or(F.col("ts").isNull()).alias("no_t")
    )
    files = sums(entries.where("NOT is_dir").select(TREE, "parent_path", "size", "ts", length.alias("bytes")))
    # A directory's line is measured without its size and moment, whose own widths are added when they are known.
    blank = entries.where("is_dir").withColumns({"_size": F.col("size"), "_ts": F.col("ts"), "size": F.lit(None).cast("bigint"), "ts": F.lit(None).cast("timestamp_ntz")})
    dirs = blank.select(TREE, "path", "parent_path", "depth", F.col("_size").alias("size"), F.col("_ts").alias("ts"), length.alias("bytes")).alias("d")
    own = files.select(F.col(TREE).alias("_t"), F.col("parent_path").alias("_p"), F.struct("s", "b", "t", "no_s", "no_t", F.lit(True).alias("any")).alias("own"))
    dirs = settle(dirs.join(own, (F.col(TREE) == F.col("_t")) & (F.col("path") == F.col("_p")), "left").drop("_t", "_p"), by="depth")
    width = lambda c: F.coalesce(F.octet_length(c), F.lit(1)) - 1
    grown = F.col("bytes") + (width(F.when(F.col("size") >= 0, F.col("size").cast("string"))) + width(moment_text(F.col("ts"))) if include_listing else F.lit(0))
    some = F.coalesce("own.any", F.lit(False)) | F.coalesce("sub.any", F.lit(False))
    unknown = lambda c: F.coalesce(F.col(f"own.{c}"), F.lit(False)) | F.coalesce(F.col(f"sub.{c}"), F.lit(False))
    zero = lambda c: F.coalesce(F.col(f"own.{c}"), F.lit(0)) + F.coalesce(F.col(f"sub.{c}"), F.lit(0))
    size = F.when(~some, 0).when(unknown("no_s"), None).otherwise(zero("s") + zero("b"))
    ts = F.when(some & ~unknown("no_t"), F.greatest("own.t", "sub.t"))
    done, below = [], files.limit(0)
    for group in _levels(dirs):
        climbed = []
        for depth in group:
            sub = below.select(F.col(TREE).alias("_t"), F.col("parent_path").alias("_p"), F.struct("s", "b", "t", "no_s", "no_t", F.lit(True).alias("any")).alias("sub"))
            here = dirs.where(F.col("depth") == depth).join(sub, (F.col(TREE) == F.col("_t")) & (F.col("path") == F.col("_p")), "left")
            here = here.withColumns({"size": F.coalesce("size", size).cast("bigint"), "ts": F.coalesce("ts", ts)})
            here = here.select(TREE, "path", "parent_path", "depth", "size", "ts", grown.alias("bytes"))
            climbed.append(here)
            below = sums(here)
        out = settle(reduce(DataFrame.unionByName, climbed))
        below = sums(out.where(F.col("depth") == group[-1]))
        done.append(out)
    return reduce(DataFrame.unionByName, [d.select(TREE, "path", "size", "ts") for d in done or [dirs]])


_LISTED = "manifest_id string, path string, digest binary, up string, _n string, line string"


def _hash_groups(algorithm: str, spell: str):
    """Hashes the lines (each with its newline) of neighbouring rows of one ``manifest_id, parent_path``, in their order.

    A row with a ``head`` begins its group and adds nothing to the hash: from it
    and the digest the line of the directory itself is made. ``spell`` tells how
    that writes digests: ``id`` (base 58) or ``hex``.
    """

    def emitted(done: list[tuple]) -> pa.RecordBatch:
        digests = pa.array([d[2] for d in done], pa.binary())
        texts = encode_digests(digests).to_pylist() if spell == "id" and done else [d[2].hex() for d in done]
        lines = [None if d[3] is None else d[3] + t + "\n" for d, t in zip(done, texts, strict=True)]
        columns = [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()), digests, pa.array([d[4] for d in done], pa.string()), pa.array([d[5] for d in done], pa.string()), pa.array(lines, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["manifest_id", "path", "digest", "up", "_n", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hasher, own = None, None, (None, None, None)
        for batch in batches:
            n, done = batch.num_rows, []
            if not n:
                continue
            trees, parents = batch.column("manifest_id"), batch.column("parent_path")
            lines = batch.column("line").cast(pa.large_string())
            offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + n + 1]
            data = memoryview(lines.buffers()[2] or b"")
            begins = np.ones(n, bool)
            if n > 1:
                begins[1:] = np.asarray(pc.or_(pc.not_equal(trees[1:], trees[:-1]), pc.not_equal(parents[1:], parents[:-1])).fill_null(True))
            starts = np.flatnonzero(begins)
            at = pa.array(starts)
            heads = zip(*(batch.column(c).take(at).to_pylist() for c in ("manifest_id", "parent_path", "head", "up", "_n")), strict=True)
            for start, end, (tree, parent, *header) in zip(starts, [*starts[1:], n], heads, strict=True):
                if (tree, parent) != key or hasher is None:
                    if hasher is not None:
                        done.append((*key, hasher.digest(), *own))
                    key, hasher = (tree, parent), hashlib.new(algorithm)
                    own = tuple(header) if header[0] is not None else (None, None, None)
                hasher.update(data[offsets[start] : offsets[end]])
            yield emitted(done)
        if hasher is not None:
            yield emitted([(*key, hasher.digest(), *own)])

    return run


def _place() -> Column:
    """Where an entry's line stands in its listing: files first, then in natural order."""
    return F.concat(F.when(F.col("is_dir"), "1").otherwise("0"), natural_key(F.col("name"))).alias("_n")


def _listing_lines(entries: DataFrame, line: Column) -> DataFrame:
    """Lines of one-level listings with the key by which they are sorted."""
    return entries.select(TREE, F.coalesce("parent_path", F.lit("")).alias("parent_path"), "depth", _place(), F.concat(line, F.lit("\n")).alias("line"))


def _hashed(rows: DataFrame, algorithm: str, spell: str = "id") -> DataFrame:
    """Rows ``manifest_id, parent_path, head, up, _n, line`` hashed by directory."""
    ordered = rows.withColumn("_o", F.col("head").isNull()).repartition(TREE, "parent_path").sortWithinPartitions(TREE, "parent_path", "_o", "_n", "line")
    return ordered.select(TREE, "parent_path", "head", "up", "_n", "line").mapInArrow(_hash_groups(algorithm, spell), _LISTED)


def _plain(lines: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return lines.select(TREE, "parent_path", nothing.alias("head"), nothing.alias("up"), "_n", "line")


def listing_digests(entries: DataFrame, line: Column, algorithm: str = "sha512") -> DataFrame:
    """``manifest_id, path, digest``: the hash of each directory's one-level listing ('' is the root).

    Lines are sorted files first, then in natural order, and streamed through a
    hasher, so a directory of any size takes constant memory.
    """
    return _hashed(_plain(_listing_lines(entries, line)), algorithm).select(TREE, "path", "digest")


def tree_digests(entries: DataFrame, line: Column | None = None, algorithm: str = "sha512", spell: str = "id") -> DataFrame:
    """Merkle identities ``manifest_id, path, digest`` of all directories and of each root (path '').

    From the deepest level up each directory's listing is hashed, and the hasher
    itself makes the directory's line for the listing above from its digest, so
    a level is one shuffle. Lines of files are made once, for all levels at a
    time; several levels are one job. A directory without entries has the digest
    of nothing. ``line`` is the canonical line of an entry (over its columns),
    which ends in its id, ``-`` for an unknown one; ``spell`` tells how it writes
    ids (``id`` or ``hex``).
    """
    text = canonical_line() if line is None else line
    files = settle(_listing_lines(entries.where("NOT is_dir"), text), by="depth")
    dirs = entries.where("is_dir").withColumn("content_id", F.lit(None).cast("binary"))
    heads = settle(dirs.select(TREE, "path", F.coalesce("parent_path", F.lit("")).alias("up"), "depth", _place(), F.regexp_replace(text, "-$", "").alias("head")), by="depth")
    found = files.select("depth").distinct().unionByName(heads.select(F.explode(F.array("depth", F.col("depth") + 1)).alias("depth")).distinct()).distinct()
    done, below = [], None
    for group in _levels(found):  # of the depth of what is listed; the listing of the root is that of depth 0
        climbed = []
        for depth in group:
            own = heads.where(F.col("depth") == depth - 1).select(TREE, F.col("path").alias("parent_path"), "head", "up", "_n", F.lit("").alias("line"))
            rows = _plain(files.where(F.col("depth") == depth)).unionByName(own)
            if below is not None:
                rows = rows.unionByName(_plain(below.where("line IS NOT NULL").select(TREE, F.col("up").alias("parent_path"), "_n", "line")))
            below = _hashed(rows, algorithm, spell)
            climbed.append(below.withColumn("_level", F.lit(depth)))
        out = settle(reduce(DataFrame.unionByName, climbed))
        below = out.where(F.col("_level") == group[-1]).drop("_level")
        done.append(out.select(TREE, "path", "digest"))
    return reduce(DataFrame.unionByName, done) if done else heads.select(TREE, "path", F.lit(None).cast("binary").alias("digest"))


def text_digests(lines: DataFrame, algorithm: str = "sha512") -> DataFrame:
    """``manifest_id, digest``: the hash of each manifest's whole text, from ``manifest_id, line_no, line``.

    This is the identity of the nested text, another one than a root's listing
    has. Lines are streamed through a hasher in order, in constant memory.
    """
    ordered = lines.repartition(TREE).sortWithinPartitions(TREE, "line_no")
    shaped = _plain(ordered.select(TREE, F.lit("").alias("parent_path"), F.lit("").alias("_n"), F.concat("line", F.lit("\n")).alias("line")))
    return shaped.mapInArrow(_hash_groups(algorithm, "id" if algorithm == "sha512" else "hex"), _LISTED).select(TREE, "digest")


def listing_texts(entries: DataFrame, line: Column | None = None) -> DataFrame:
    """``manifest_id, path, content``: the one-level listing of each directory as text ('' is the root), to be stored by its digest.

    A listing is one value by its nature, so it takes as much memory as it is
    long; where only its digest is needed, ``listing_digests`` streams it.
    """
    text = canonical_line() if line is None else line
    lines = _listing_lines(entries, text)
    listed = lines.groupBy(TREE, "parent_path").agg(F.array_sort(F.collect_list(F.struct("_n", "line"))).alias("_l"))
    return listed.select(TREE, F.col("parent_path").alias("path"), F.array_join(F.transform("_l", lambda x: x["line"]), "").alias("content"))
