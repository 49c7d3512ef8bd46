"""Scan options, operands, stores over several places, and chain states kept up to date."""

import datetime
import hashlib
import os

import pytest
from pyspark.sql import functions as F
from test_problem_operators import ENTRY as CHANGE
from test_problem_operators import SECTION, entry

from boughline.functions import ids
from boughline.operators import compare
from boughline.operators.changefeed import unapplied_sections
from boughline.schema import build
from boughline.sources import operands as given
from boughline.sources import text
from boughline.sources.directory import ScanCancelled, entry_stream, progressive_scan, scan, verify
from boughline.sources.store import Store, distribute, has_any, remove_everywhere
from boughline.streaming.chains import ChainState


def sha(s):
    return hashlib.sha512(s.encode()).digest()


def tree(folder, files):
    for path, content in files.items():
        at = folder / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)
    return str(folder)


def paths(df):
    return sorted(r["path"] for r in df.collect())


def test_scan_options(spark, tmp_path):
    root = tree(tmp_path / "t", {"a/x.txt": "x", "a/y.tmp": "y", "a/.skip": "# comment\n\n*.tmp\n", "b/y.tmp": "y", "b/c/z.o": "z", ".hid": "h", "f.1": "1", "f.2": "2", "f.3": "3"})
    os.symlink("../a", os.path.join(root, "b", "to_a"))
    os.symlink("..", os.path.join(root, "b", "up"))
    (tmp_path / "list").write_text("# objects\n*.o\n\nb/y*\n")
    everything = paths(scan(spark, root, "s"))
    assert everything == [".hid", "a/", "a/.skip", "a/x.txt", "a/y.tmp", "b/", "b/c/", "b/c/z.o", "b/to_a", "b/up", "b/y.tmp", "f.1", "f.2", "f.3"]
    assert paths(scan(spark, root, "s", exclude_file=str(tmp_path / "list"), hidden=False)) == ["a/", "a/x.txt", "a/y.tmp", "b/", "b/c/", "b/to_a", "b/up", "f.1", "f.2", "f.3"]
    assert "a/y.tmp" not in paths(scan(spark, root, "s", exclude_name=".skip")) and "b/y.tmp" in paths(scan(spark, root, "s", exclude_name=".skip"))
    followed = paths(scan(spark, root, "s", follow=True))
    assert "b/to_a/" in followed and "b/to_a/x.txt" in followed and not [p for p in followed if p.startswith("b/up")]
    assert "f.[1-3]" in paths(scan(spark, root, sequences=True))
    one = scan(spark, os.path.join(root, "a", "x.txt")).collect()
    assert [(r["path"], bytes(r["content_id"])) for r in one] == [("x.txt", sha("x"))]
    got = {r["path"]: r for r in scan(spark, root, exclude=["b", ".*", "f.*"], roll=True).collect()}
    lines = "".join(f"-rw-r--r-- {got[p]['ts']:%Y-%m-%dT%H:%M:%SZ} 1 {p[2:]} {ids.encode_id(bytes(got[p]['content_id']))}\n" for p in ("a/x.txt", "a/y.tmp"))
    assert got["a/"]["size"] == 2 + len(lines) and bytes(got["a/"]["content_id"]) == sha(lines)


def test_scan_is_cancelled_and_streams_in_order(spark, tmp_path):
    root = tree(tmp_path / "t", {"a10": "", "a2": "", "d/b": ""})
    asked = []
    with pytest.raises(ScanCancelled):
        scan(spark, root, cancelled=lambda: asked.append(1) or len(asked) > 1)
    seen, state = [], {}
    assert entry_stream(scan(spark, root, "s"), lambda r: seen.append((r["seq"], r["path"]))) == 4
    assert seen == [(0, "a2"), (1, "a10"), (2, "d/"), (3, "d/b")]
    stages = [(stage, state["stage"], df.where("content_id IS NOT NULL").count()) for stage, df in progressive_scan(spark, root, state)]
    assert stages == [("structure", "structure", 0), ("metadata", "metadata", 0), ("full", "full", 3)]


def test_operands_reuse_known_ids(spark, tmp_path):
    root = tree(tmp_path / "t", {"same": "1", "other": "22"})
    moment = datetime.datetime(2024, 1, 2, 3, 4, 5)
    for name in ("same", "other"):
        os.utime(os.path.join(root, name), (moment.replace(tzinfo=datetime.UTC).timestamp(),) * 2)
    rows = [{"path": "same", "size": 1, "ts": moment, "content_id": sha("kept")}, {"path": "other", "size": 9, "ts": moment, "content_id": sha("kept")}]
    (tmp_path / "m.txt").write_text("".join(r["line"] + "\n" for r in text.manifest_text(build(spark, rows)).orderBy("line_no").collect()))
    for swap in (False, True):
        sides = given.operands(spark, *([str(tmp_path / "m.txt"), root][:: -1 if swap else 1]))
        known, scanned = sides[::-1] if swap else sides
        assert {r["path"]: bytes(r["content_id"]) for r in scanned.collect()} == {"same": sha("kept"), "other": sha("22")}
        assert compare.flat_diff(known, scanned, "path").where("key = 'other'").head()["change_type"] == "modified"
    assert [paths(side) for side in given.operands(spark, root, root, "s")] == [["other", "same"]] * 2


def test_several_stores(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "one")), Store(spark, str(tmp_path / "two"))
    said = spark.createDataFrame([("a", sha("a")), ("b", sha("x")), ("c", None)], "content string, content_id binary")
    assert [bytes(r["content_id"]) for r in one.put_as(said).collect()] == [sha("x")] and one.rows().count() == 1
    two.put(spark.createDataFrame([("b",), ("c",)], "content string"))
    wanted = spark.createDataFrame([(sha(x),) for x in "abz"], "content_id binary")
    assert has_any([one, two], wanted).count() == 2
    two.rows().where(F.col("content") == b"b").select("digest", "shard").selectExpr("digest", "CAST('bad' AS binary) AS content", "3L AS n_bytes", "shard").write.mode("append").partitionBy("shard").parquet(two.path)
    got = sorted((r["is_valid"], r["content"]) for r in two.open_valid(wanted).collect())
    assert got == [(False, None), (True, b"b")]
    remove_everywhere([one, two], wanted)
    assert one.rows().count() == 0 and [bytes(r["content"]) for r in two.rows().collect()] == [b"c"]
    (tmp_path / "file").write_text("")
    done = distribute(said, [Store(spark, str(tmp_path / "file" / "no")), two])
    assert isinstance(done[str(tmp_path / "file" / "no")], Exception) and done[two.path] == 3


def test_merge_that_refuses_conflicts(spark):
    a, b = build(spark, [{"path": "x", "content_id": sha("1")}]), build(spark, [{"path": "y", "content_id": sha("1")}])
    assert paths(compare.merge_strictly([a, b, a])) == ["x", "y"]
    with pytest.raises(compare.Conflicts, match="x") as found:
        compare.merge_strictly([a, b, build(spark, [{"path": "x", "content_id": sha("2")}])])
    assert found.value.paths == [("m", "x")]


def test_unapplied_sections(spark):
    rows = [(1, "c", None, b"1"), (2, "c", b"1", b"2"), (3, "c", b"1", b"2"), (4, "c", b"lost", b"3"), (5, "c", b"lost", b"3"), (6, None, None, b"1"), (7, "c", b"2", None)]
    got = {(r["section_id"], r["reason"]) for r in unapplied_sections(spark.createDataFrame([(*r, None) for r in rows], "section_id bigint, chain_id string, base_id binary, new_id binary, arrived_at timestamp_ntz")).collect()}
    assert got == {(4, "unreachable"), (5, "unreachable"), (6, "no state"), (7, "no state")}


def test_chain_state_replays_only_what_changed(spark, tmp_path):
    sections = [(1, "c", None, b"1", None, ""), (2, "d", None, b"1", None, "")]
    changes = [entry(1, 0, "x", 1), entry(2, 0, "y", 1)]
    late = [(3, "c", b"1", b"2", None, "")], [entry(3, 0, "x", 1), entry(3, 1, "z", 2)]
    chains = ChainState(spark, str(tmp_path / "log"))

    def take(rows, schema, kind, n):
        folder = str(tmp_path / f"in-{kind}")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        chains.take(spark.readStream.schema(schema).parquet(folder), kind)

    take(sections, SECTION, "sections", 0)
    take(changes, CHANGE, "changes", 0)
    state = lambda: sorted((r["chain_id"], r["path"]) for r in chains.state().collect())
    assert state() == [("c", "x"), ("d", "y")] == state()
    take(late[0], SECTION, "sections", 1)
    take(late[1], CHANGE, "changes", 1)
    assert state() == [("c", "z"), ("d", "y")]


def test_verify_against_a_manifest(spark, tmp_path):
    root = tree(tmp_path / "t", {"a": "1", "b": "2", "d/c": "3"})
    before = scan(spark, root).collect()
    kept = spark.createDataFrame(before, scan(spark, root).schema)
    assert verify(spark, root, kept).count() == 0
    (tmp_path / "t" / "b").write_text("changed")
    os.remove(tmp_path / "t" / "d" / "c")
    (tmp_path / "t" / "new").write_text("")
    assert {(r["path"], r["problem"]) for r in verify(spark, root, kept).collect()} >= {("b", "changed"), ("d/c", "missing"), ("new", "extra")}
