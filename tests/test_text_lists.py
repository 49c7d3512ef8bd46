"""Id lists in manifest text, folded and expanded trees, and what a strict reader refuses."""

import datetime
import hashlib

from pyspark.sql import functions as F

from boughline.functions import ids
from boughline.operators import compare, sequences
from boughline.operators.common import last_seen
from boughline.schema import build
from boughline.sources import text


def sha(s):
    return hashlib.sha512(s.encode()).digest()


def frames(name, first, last, suffix=".exr"):
    return [{"path": f"d/{name}.{i:03d}{suffix}", "size": 5, "perm": 0o644, "ts": datetime.datetime(2024, 1, 2), "content_id": sha(f"{name}{i}")} for i in range(first, last + 1)]


def test_folded_tree_written_and_read_back(spark):
    rows = [{"path": "d/"}, *frames("a", 1, 5), *frames("b", 8, 11), {"path": "d/single.7.x", "content_id": sha("s")}, *[{"path": f"l{i}", "file_type": "l", "link_target": "d/x"} for i in range(3)]]
    tree = build(spark, rows)
    folded, members = sequences.fold_tree(tree)
    assert {r["path"] for r in folded.collect()} == {"d/", "d/a.[001-005].exr", "d/b.[008-011].exr", "d/single.7.x", "l[0-2]"}
    texts = "".join(ids.encode_id(sha(f"a{i}")) for i in range(1, 6))
    kept = {bytes(r["content_id"]): r["members"] for r in members.collect()}
    assert kept[sha(texts)] == texts and len(kept) == 2
    lines = text.manifest_text(folded, members=members)
    last = [r["line"] for r in lines.orderBy("line_no").collect()][-2:]
    assert sorted(last, key=lambda x: ids.encode_id(sha(x))) == last and set(last) == set(kept.values())
    assert {(bytes(r["content_id"]), r["members"]) for r in text.range_data(lines).collect()} == set(kept.items())
    back = {r["path"]: r["content_id"] and bytes(r["content_id"]) for r in sequences.expand_tree(text.read_entries(lines), text.range_data(lines)).collect()}
    assert back == {r["path"]: r.get("content_id") for r in rows}
    assert text.rejected(lines).count() == 0
    # Without the lists the members are there, their ids aren't.
    bare = sequences.expand_tree(folded, members.limit(0)).where("path LIKE 'd/a%'").collect()
    assert len(bare) == 5 and all(r["content_id"] is None for r in bare)


def test_range_data_of_a_patched_tree(spark):
    old, new = build(spark, frames("a", 1, 3)), build(spark, frames("a", 1, 3) + frames("b", 1, 4))
    (a, ma), (b, mb) = sequences.fold_tree(old), sequences.fold_tree(new)
    patched = compare.apply_delta(a, compare.tree_diff(a, b))
    both = sequences.expand_tree(patched, ma.unionByName(mb))
    assert {r["path"]: bytes(r["content_id"]) for r in both.collect()} == {r["path"]: bytes(r["content_id"]) for r in new.collect()}


def test_refused_lines(spark):
    word = ids.encode_id(sha("x"))
    lines = ["@version 1.0", "- - 1 a -\r", "- - 1", "zz - 1 a -", "- yesterday 1 a -", "- - 1x a -", "- - 1 .. -", "- - 1 a c4zz", "- - 1 good -", "", word, word, "- - 2 b -", word * 2, word]
    df = spark.createDataFrame([("m", i + 1, x) for i, x in enumerate(lines)], "manifest_id string, line_no bigint, line string")
    got = {r["line_no"]: r["field"] for r in text.rejected(df).collect()}
    assert got == {1: "directive", 2: "character", 3: "fields", 4: "mode", 5: "timestamp", 6: "size", 7: "name", 8: "c4id", 11: "patch", 15: "patch"}
    assert [(r["name"], r["section_no"]) for r in text.read_entries(df).orderBy("seq").collect()] == [("good", 0), ("b", 2)]
    assert text.rejected(df.limit(0)).count() == 0 and text.read_entries(df.limit(0)).count() == 0


def test_lines_of_files_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "a").write_text("".join(f"line {i}\n" for i in range(5000)))
    (tmp_path / "b").write_text("x\r\n\ny")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = text.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = sorted((r["line_no"], r["line"]) for r in got if r["manifest_id"].endswith("a"))
    assert a == [(i + 1, f"line {i}") for i in range(5000)]
    assert sorted((r["line_no"], r["line"]) for r in got if r["manifest_id"].endswith("b")) == [(1, "x\r"), (2, ""), (3, "y")]


def test_last_seen_across_stretches(spark, monkeypatch):
    monkeypatch.setattr("boughline.operators.common.RANGE_ROWS", 4)
    rows = [(g, i, i if i % 7 == 3 else None) for g in ("a", None) for i in range(0, 60, 2 if g else 1)]
    df = spark.createDataFrame(rows, "g string, at bigint, v bigint")
    for upto in (False, True):
        for r in last_seen(df, "g", "at", {"last": F.col("v")}, upto, {"n": F.col("v")}).collect():
            before = [v for g, i, v in rows if g == r["g"] and v is not None and (i < r["at"] or (upto and i == r["at"]))]
            assert (r["last"], r["n"]) == (before[-1] if before else None, len(before))


def test_reading_text_parses_each_line_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    base = ids.encode_id(sha("x"))
    rows = ["-rw-r--r-- 2024-01-01T00:00:00Z 1 a -", "drwxr-xr-x - - d/ -", f"  -rw-r--r-- - 1 b\\ c {base}", base, "-rw-r--r-- - 2 a -", "drwxr-xr-x - - e/ -", "  lrwxrwxrwx - - l -> d/b\\ c -"]
    lines = spark.createDataFrame([("m", i, line) for i, line in enumerate(rows)], "manifest_id string, line_no bigint, line string")
    back = text.read_entries(lines.mapInArrow(counted, lines.schema)).orderBy("seq").collect()
    assert [(r["section_no"], r["base_id"], r["path"]) for r in back] == [(0, None, "a"), (0, None, "d/"), (0, None, "d/b c"), (1, base, "a"), (1, base, "e/"), (1, base, "e/l")]
    assert bytes(back[2]["content_id"]) == sha("x") and back[4]["content_id"] is None
    assert back[5]["link_target"] == "d/b c" and back[0]["ts"].year == 2024
    assert seen.value == len(rows)


def _counted(df):
    """``df`` and an accumulator of the rows of it that are read."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_writing_text_reads_entries_once(spark):
    tree, seen = _counted(build(spark, [{"path": p} for p in ("b10", "b9", "a/", "a/x 1")]))
    assert [r["line"].strip() for r in text.manifest_text(tree).orderBy("line_no").collect()] == ["- - - b9 -", "- - - b10 -", "d--------- - - a/ -", "- - - a/x\\ 1 -".replace("a/", "")]
    assert seen.value == 4


def test_expanding_reads_sequences_twice_at_most(spark):
    rows = [{"path": "s[1-3]", "is_sequence": True}, {"path": "t"}]
    tree, seen = _counted(build(spark, rows))
    none = spark.createDataFrame([], "manifest_id string, content_id binary, members string")
    assert {r["path"] for r in sequences.expand_tree(tree, none).collect()} == {"s1", "s2", "s3", "t"}
    assert seen.value <= 2 * len(rows)


def test_identity_reads_lines_three_times_at_most(spark):
    rows = [("m", 0, "- - - b -"), ("m", 1, "- - - a -"), ("t", 0, "some words"), ("t", 1, "more"), ("blank", 0, "")]
    lines, seen = _counted(spark.createDataFrame(rows, "manifest_id string, line_no bigint, line string"))
    got = {r["manifest_id"]: bytes(r["digest"]) for r in text.identify(lines).collect()}
    assert got == {"m": sha("- - - a -\n- - - b -\n"), "t": sha("some words\nmore\n"), "blank": sha("\n")}
    assert seen.value <= 3 * len(rows)
