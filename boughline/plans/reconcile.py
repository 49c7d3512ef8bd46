"""Plans that turn one tree into another."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boughline.functions.order import ranked
from boughline.operators.common import settle
from boughline.schema import TREE

#: Order in which operations run.
PHASES = {"mkdir": 1, "move": 2, "create": 3, "symlink": 4, "chmod": 5, "chtimes": 6, "remove": 7, "rmdir": 8}


def availability(entries: DataFrame) -> DataFrame:
    """Where content lies: ``manifest_id, content_id, path, n_paths`` (the smallest path stands for all)."""
    files = entries.where("NOT is_dir AND content_id IS NOT NULL")
    return files.groupBy(TREE, "content_id").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n_paths"))


def plan_operations(target: DataFrame, current: DataFrame) -> DataFrame:
    """Operations ``manifest_id, phase, op, path, src_path`` that make ``target`` of ``current``.

    Files to create and files to remove of one content become moves, paired
    one to one in path order (places within a content are counted by many tasks,
    however many files hold it); what is left is created or removed. Run them by
    phase, mkdir and the like shallow first, removals deep first.
    """
    cols = ["is_dir", "file_type", "perm", "ts", "size", "link_target", "content_id"]
    side = lambda df, n: df.select(TREE, "path", F.struct(*cols).alias(n))
    both = side(target, "t").join(side(current, "c"), [TREE, "path"], "full_outer")
    have, had = F.col("t").isNotNull(), F.col("c").isNotNull()
    directory = F.coalesce("t.is_dir", "c.is_dir")
    link = lambda s: F.coalesce(F.col(f"{s}.file_type") == "l", F.lit(False))
    other_content = ~F.col("t.content_id").eqNullSafe(F.col("c.content_id")) | (link("t") != link("c"))
    ops = F.array_compact(
        F.array(
            F.when(have & ~had & directory, F.lit("mkdir")),
            F.when(have & ~link("t") & ~directory & (~had | other_content), F.lit("create")),
            F.when(have & link("t") & (~had | ~link("c") | ~F.col("t.link_target").eqNullSafe(F.col("c.link_target"))), F.lit("symlink")),
            F.when(have & had & F.col("t.perm").isNotNull() & ~F.col("t.perm").eqNullSafe(F.col("c.perm")), F.lit("chmod")),
            F.when(have & had & F.col("t.ts").isNotNull() & ~F.col("t.ts").eqNullSafe(F.col("c.ts")), F.lit("chtimes")),
            F.when(~have & ~directory, F.lit("remove")),
            F.when(~have & directory, F.lit("rmdir")),
        )
    )
    each = settle(both.select(TREE, "path", F.explode(ops).alias("op"), F.col("t.content_id").alias("_tid"), F.col("c.content_id").alias("_cid"), had.alias("_had")))  # the changes alone
    place = lambda df, c: ranked(df.withColumn("_g", F.concat_ws(" ", TREE, F.hex(c))), "_g", [F.col("path")], "_n")
    made = place(each.where("op = 'create' AND NOT _had AND _tid IS NOT NULL"), "_tid").select(TREE, "path", F.col("_tid").alias("_id"), "_n")
    lost = place(each.where("op = 'remove' AND _cid IS NOT NULL"), "_cid").select(TREE, F.col("path").alias("src_path"), F.col("_cid").alias("_id"), "_n")
    moves = made.join(lost, [TREE, "_id", "_n"]).select(TREE, "path", "src_path")
    rest = each.join(moves.select(TREE, "path", F.lit("create").alias("op")).unionByName(moves.select(TREE, F.col("src_path").alias("path"), F.lit("remove").alias("op"))), [TREE, "path", "op"], "left_anti")
    all_ = rest.select(TREE, "op", "path", F.lit(None).cast("string").alias("src_path")).unionByName(moves.select(TREE, F.lit("move").alias("op"), "path", "src_path"))
    phase = F.element_at(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv]), F.col("op"))
    return all_.select(TREE, phase.alias("phase"), "op", "path", "src_path")


def missing_content(target: DataFrame, *sources: DataFrame) -> DataFrame:
    """Ids of files the target needs that none of the sources has: ``manifest_id, content_id``. A plan with any can't run."""
    need = target.where("NOT is_dir AND content_id IS NOT NULL").select(TREE, "content_id").distinct()
    for source in sources:
        need = need.join(source.where("NOT is_dir").select(TREE, "content_id"), [TREE, "content_id"], "left_anti")
    return need


def execute(plan: DataFrame, target: DataFrame, folder: str, fetch) -> dict[str, int]:
    """Runs the plan of one tree on a local folder, in order; returns how many operations of each kind were done or skipped.

    ``fetch(digest)`` gives the bytes of a file to create. Operations that find
    their result already there are skipped, so a run that broke off can be
    repeated. Rows stream to the driver one partition at a time. Paths that
    would leave the folder are refused. Moments of directories are set last, deepest first.
    """
    done: dict[str, int] = {}
    root = os.path.realpath(folder)
    meta = target.select("path", F.col("perm").alias("_p"), F.col("ts").alias("_t"), F.col("content_id").alias("_c"), F.col("link_target").alias("_l"))
    late: list[tuple[str, float]] = []

    def place(path: str) -> str:
        at = os.path.join(root, path.rstrip("/"))
        if os.path.commonpath([root, os.path.realpath(os.path.dirname(at))]) != root or ".." in path.split("/"):
            raise ValueError(f"{path} lies outside of the folder")
        return at

    for r in in_run_order(plan.join(meta, "path", "left")).toLocalIterator():
        at, op = place(r["path"]), r["op"]
        here = os.path.lexists(at)
        skip = (op == "mkdir" and here) or (op in ("remove", "rmdir") and not here)
        if not skip:
            if op == "mkdir":
                os.makedirs(at)
            elif op == "move":
                source = place(r["src_path"])
                if os.path.lexists(source):
                    os.replace(source, at)
                else:
                    skip = True
            elif op == "create":
                with open(at + ".part", "wb") as f:
                    f.write(fetch(bytes(r["_c"])) if r["_c"] is not None else b"")
                os.replace(at + ".part", at)
            elif op == "symlink":
                if here:
                    os.remove(at)
                os.symlink(r["_l"], at)
            elif op == "remove":
                os.remove(at)
            elif op == "rmdir":
                if os.listdir(at):
                    skip = True
                else:
                    os.rmdir(at)
        if op in ("mkdir", "create", "move", "chmod") and r["_p"] is not None and not os.path.islink(at) and os.path.lexists(at):
            os.chmod(at, r["_p"])
        if op in ("mkdir", "create", "move", "chtimes") and r["_t"] is not None and os.path.lexists(at) and not os.path.islink(at):
            late.append((at, r["_t"].replace(tzinfo=datetime.UTC).timestamp()))
        key = "skipped" if skip else op
        done[key] = done.get(key, 0) + 1
    for at, moment in sorted(late, reverse=True):
        os.utime(at, (moment, moment))
    return done


def plan_counts(plan: DataFrame) -> DataFrame:
    """Operations per pair: ``manifest_id, op, n``."""
    return plan.groupBy(TREE, "op").agg(F.count(F.lit(1)).alias("n"))


def in_run_order(plan: DataFrame) -> DataFrame:
    """The plan sorted for execution."""
    depth = F.size(F.split(F.regexp_replace("path", "/$", ""), "/"))
    return plan.orderBy(TREE, "phase", F.when(F.col("phase") >= PHASES["remove"], -depth).otherwise(depth), "path")
