"""Directory trees as entries."""

from __future__ import annotations

import datetime
import fnmatch
import hashlib
import os
import stat
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from boughline.functions.order import canonical_sort, path_key, ranked
from boughline.operators.common import discard, settle
from boughline.operators.compare import flat_diff
from boughline.operators.rollup import roll_up, tree_digests
from boughline.operators.sequences import fold_tree
from boughline.schema import ENTRY, TREE

#: Modes of a scan and their names.
MODES = {"s": "structure", "1": "structure", "structure": "structure", "m": "metadata", "2": "metadata", "metadata": "metadata", "f": "full", "3": "full", "full": "full", "": "full"}
_KINDS = [(stat.S_ISDIR, "d"), (stat.S_ISLNK, "l"), (stat.S_ISFIFO, "p"), (stat.S_ISSOCK, "s"), (stat.S_ISBLK, "b"), (stat.S_ISCHR, "c")]
#: Bytes of a file that are hashed at a time.
CHUNK = 1 << 20
#: Entries of listed directories that are sent on at a time.
LISTED_AT_ONCE = 10_000


def scan_mode(text: str) -> str:
    if text not in MODES:
        raise ValueError(f"no scan mode: {text}")
    return MODES[text]


class ScanCancelled(Exception):
    """A scan was told to stop."""


def _matches(pattern: str, text: str) -> bool:
    """Whether a shell pattern matches a base name or relative path; nothing but a slash matches a slash."""
    own, parts = pattern.rstrip("/").replace("[^", "[!").split("/"), text.split("/")
    return len(own) == len(parts) and all(map(fnmatch.fnmatchcase, parts, own))


def pattern_lines(text: str) -> list[str]:
    """Patterns of an exclude file: one per line, blank lines and those that begin with ``#`` left out."""
    lines = [x.strip() for x in text.splitlines()]
    return [x for x in lines if x and not x.startswith("#")]


def _read_patterns(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8", errors="surrogateescape") as f:
            return pattern_lines(f.read())
    except OSError:
        return []  # no file, no patterns


_LISTED = T.StructType([*ENTRY, T.StructField("_patterns", T.ArrayType(T.StringType())), T.StructField("_trail", T.ArrayType(T.StringType()))])
_FRONT = "path string, depth int, patterns array<string>, trail array<string>"


def _lister(root: str, with_metadata: bool, exclude: list[str], exclude_name: str | None, hidden: bool, follow: bool):
    """Lists directories: their entries, and for directories among them the patterns that hold below and the places on the way."""
    schema = to_arrow_schema(_LISTED)

    def rows(parent: str, depth: int, patterns: list[str], trail: list[str]) -> Iterator[tuple]:
        at = os.path.join(root, parent)
        patterns = patterns + (_read_patterns(os.path.join(at, exclude_name)) if exclude_name else [])
        for item in sorted(os.scandir(at), key=lambda x: x.name):
            path = parent + item.name
            if (not hidden and item.name.startswith(".")) or any(_matches(p, item.name) or _matches(p, path) for p in (*exclude, *patterns)):
                continue
            followed = follow and item.is_symlink() and os.path.exists(item.path)
            info = item.stat(follow_symlinks=followed)
            kind = next((k for test, k in _KINDS if test(info.st_mode)), "-")
            place = f"{info.st_dev}:{info.st_ino}"
            if kind == "d" and place in trail:
                continue  # a symlink that leads back up
            is_dir, name = kind == "d", item.name + ("/" if kind == "d" else "")
            size = info.st_size if with_metadata and not is_dir else None
            ts = datetime.datetime.fromtimestamp(int(info.st_mtime), datetime.UTC).replace(tzinfo=None) if with_metadata else None
            yield (root, None, depth, name, parent + name, parent, is_dir, kind, stat.S_IMODE(info.st_mode) if with_metadata else None, ts, size,
                   os.readlink(item.path) if kind == "l" else None, None, None, None, None, False, None, patterns if is_dir else None, [*trail, place] if is_dir else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for front in zip(*(batch.column(c).to_pylist() for c in ("path", "depth", "patterns", "trail")), strict=True):
                for row in rows(*front):
                    found.append(row)
                    if len(found) == LISTED_AT_ONCE:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in found], schema)
                        found = []
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in found], schema)

    return run


def listing(
    spark: SparkSession, root: str, with_metadata: bool = True, exclude: list[str] | None = None, exclude_name: str | None = None, hidden: bool = True, follow: bool = False, cancelled=None
) -> DataFrame:
    """Names, kinds and (``with_metadata``) modes, moments and sizes of a tree, walked by the executors, a level of directories at a time.

    Options are those of ``scan``. ``seq`` is the place in canonical order, from 0.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    info = os.stat(root)
    front = spark.createDataFrame([("", 0, [], [f"{info.st_dev}:{info.st_ino}"])], _FRONT)
    levels = []
    while True:
        if cancelled is not None and cancelled():
            discard(*levels)
            raise ScanCancelled(root)
        found = settle(front.repartition(tasks).mapInArrow(_lister(root, with_metadata, exclude or [], exclude_name, hidden, follow), _LISTED))
        levels.append(found)
        front = found.where("is_dir").select("path", (F.col("depth") + 1).alias("depth"), F.col("_patterns").alias("patterns"), F.col("_trail").alias("trail"))
        if front.isEmpty():
            break
    listed = reduce(DataFrame.unionByName, levels).select(*ENTRY.names)
    placed = ranked(listed.drop("seq"), TREE, [path_key(F.col("path")), F.col("path")], "_n").withColumn("seq", F.col("_n") - 1).select(*ENTRY.names)
    return placed


def _hashed(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column("path").to_pylist():
                hasher = hashlib.sha512()
                with open(os.path.join(root, path), "rb") as f:
                    while chunk := f.read(CHUNK):
                        hasher.update(chunk)
                digests.append(hasher.digest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(digests, pa.binary())], names=["path", "digest"])

    return run


def _one_file(spark: SparkSession, path: str, with_metadata: bool) -> DataFrame:
    info = os.lstat(path)
    kind = next((k for test, k in _KINDS if test(info.st_mode)), "-")
    ts = datetime.datetime.fromtimestamp(int(info.st_mtime), datetime.UTC).replace(tzinfo=None) if with_metadata else None
    name = os.path.basename(path)
    row = (os.path.dirname(path), 0, 0, name, name, "", False, kind, stat.S_IMODE(info.st_mode) if with_metadata else None, ts, info.st_size if with_metadata else None, os.readlink(path) if kind == "l" else None, None, None, None, None, False, None)
    return spark.createDataFrame([row], ENTRY)


def scan(
    spark: SparkSession,
    root: str,
    mode: str = "full",
    exclude: list[str] | None = None,
    guide: DataFrame | None = None,
    reference: DataFrame | None = None,
    exclude_file: str | None = None,
    exclude_name: str | None = None,
    hidden: bool = True,
    follow: bool = False,
    roll: bool = False,
    sequences: bool = False,
    cancelled=None,
) -> DataFrame:
    """Entries of a directory tree on a file system that all executors share; of a single file one row.

    The executors walk the tree level by level and hash contents, each file
    once and in chunks. ``exclude`` are shell patterns of base names or relative
    paths, ``exclude_file`` names a file of them, ``exclude_name`` files that
    hold more of them for the directory they lie in and all below; an excluded
    directory isn't entered. ``hidden`` takes names that begin with a dot,
    ``follow`` follows symlinks (one that leads back up is left out). ``guide``
    keeps its paths only. With ``reference`` entries, a file of unchanged size
    and moment takes its id from there and isn't read. A symlink has its
    target's id if the target is a regular file of the tree. ``roll`` adds sizes,
    moments and ids of directories, ``sequences`` folds numbered files.
    ``cancelled()`` is asked before each level and before contents are read;
    when it is true, the scan ends with ``ScanCancelled``. What a running job
    does is stopped by cancelling its Spark job group.
    """
    mode = scan_mode(mode)
    patterns = [*(exclude or []), *(_read_patterns(exclude_file) if exclude_file else [])]
    if os.path.isdir(root):
        listed = listing(spark, root, mode != "structure", patterns, exclude_name, hidden, follow, cancelled)
    else:
        listed, root = _one_file(spark, root, mode != "structure"), os.path.dirname(root)
    if guide is not None:
        listed = listed.join(guide.select("path").distinct(), "path", "left_semi").select(*ENTRY.names)
    if cancelled is not None and cancelled():
        raise ScanCancelled(root)
    out = with_ids(listed, root, reference) if mode == "full" else listed
    if roll:
        out = rolled(out, mode == "full")
    return fold_tree(out)[0] if sequences else out


def with_ids(listed: DataFrame, root: str, reference: DataFrame | None = None) -> DataFrame:
    """A listing with the ids of its files' contents (those of ``reference`` where size and moment are the same)."""
    files = listed.where("file_type = '-'")
    known = None
    if reference is not None:
        old = reference.where("NOT is_dir").select("path", F.col("size").alias("_s"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("_t"), F.col("content_id").alias("digest"))
        known = files.join(old, "path").where("size <=> _s AND ts <=> _t AND digest IS NOT NULL").select("path", "digest")
        files = files.join(known, "path", "left_anti")
    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digests = files.select("path").repartition(tasks).mapInArrow(_hashed(root), "path string, digest binary")
    if known is not None:
        digests = digests.unionByName(known)
    digests = settle(digests)
    own = listed.join(digests, "path", "left").withColumn("content_id", F.col("digest")).drop("digest")
    targets = digests.select(F.col("path").alias("_p"), F.col("digest").alias("_d"))
    linked = own.join(targets, (F.col("file_type") == "l") & (F.concat("parent_path", "link_target") == F.col("_p")), "left")
    return linked.withColumn("content_id", F.coalesce("content_id", "_d")).select(*ENTRY.names)


def rolled(entries: DataFrame, ids: bool = True) -> DataFrame:
    """Entries whose directories have their sizes and moments and (``ids``) the ids of their listings."""
    entries = settle(entries)
    at = lambda df, *columns: df.select(F.col(TREE).alias("_t"), F.col("path").alias("_p"), *columns)
    here = F.col("is_dir") & (F.col(TREE) == F.col("_t")) & (F.col("path") == F.col("_p"))
    sized = entries.join(at(roll_up(entries), F.col("size").alias("_s"), F.col("ts").alias("_m")), here, "left")
    sized = sized.withColumns({"size": F.coalesce("size", "_s"), "ts": F.coalesce("ts", "_m")}).select(*ENTRY.names)
    if not ids:
        return sized
    sized = settle(sized)
    found = sized.join(at(tree_digests(sized), F.col("digest").alias("_d")), here, "left")
    return found.withColumn("content_id", F.coalesce("_d", "content_id")).select(*ENTRY.names)


def verify(spark: SparkSession, root: str, entries: DataFrame, mode: str = "full") -> DataFrame:
    """``path, problem``: where a tree differs from its manifest (``missing``, ``changed``, ``extra``); every content is read again."""
    kinds = flat_diff(entries.withColumn(TREE, F.lit("m")), scan(spark, root, mode).withColumn(TREE, F.lit("m")), "path").where("change_type <> 'same'")
    said = F.when(F.col("change_type") == "removed", "missing").when(F.col("change_type") == "added", "extra").otherwise("changed")
    return kinds.select(F.col("key").alias("path"), said.alias("problem"))


def entry_stream(entries: DataFrame, handle) -> int:
    """Calls ``handle`` for each entry in canonical order without holding them all; returns how many.

    The caller's function runs on the driver, so rows pass there one partition at a time.
    """
    n = 0
    for row in canonical_sort(entries, TREE).toLocalIterator():
        handle(row)
        n += 1
    return n


def progressive_scan(spark: SparkSession, root: str, state: dict | None = None) -> Iterator[tuple[str, DataFrame]]:
    """``(stage, entries)`` in three stages, each as soon as it is there: names, then metadata, then ids.

    Names are listed once without metadata; then the tree is read with it, and
    its files' contents are hashed on top of that. ``state`` has the newest
    stage and entries under ``stage`` and ``entries`` at any time.
    """
    state = {} if state is None else state
    names = listing(spark, root, with_metadata=False)
    state.update(stage="structure", entries=names)
    yield "structure", names
    known = listing(spark, root)
    state.update(stage="metadata", entries=known)
    yield "metadata", known
    whole = with_ids(known, root)
    state.update(stage="full", entries=whole)
    yield "full", whole
