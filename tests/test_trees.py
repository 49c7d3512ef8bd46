import datetime
import hashlib
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boughline.functions import fields, ids
from boughline.functions.globs import glob_regex
from boughline.functions.order import canonical_sort, natural_key, path_key, ranked
from boughline.operators import compare, navigate, rollup, sequences, summaries
from boughline.plans import reconcile
from boughline.schema import ENTRY, build
from boughline.sources import text
from boughline.sources.directory import entry_stream, scan, scan_mode
from boughline.sources.store import Store, distribute, endpoints, open_any

# Ids of words, of nothing, and the id of the list of the nine words.
WORDS = ["alfa", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india"]
ID_OF_ALFA = "c43zYcLni5LF9rR4Lg4B8h3Jp8SBwjcnyyeh4bc6gTPHndKuKdjUWx1kJPYhZxYt3zV6tQXpDs2shPsPYjgG81wZM1"
ID_OF_INDIA = "c41nJ6CvPN7m7UkUA3oS2yjXYNSZ7WayxEQXWPae6wFkWwW8WChQWTu61bSeuCERu78BDK1LUEny1qHZnye3oU7DtY"
ID_OF_NOTHING = "c459dsjfscH38cYeXXYogktxf4Cd9ibshE3BHUo6a58hBXmRQdZrAkZzsWcbWtDg5oQstpDuni4Hirj75GEmTc1sFT"
ID_OF_NINE = "c435RzTWWsjWD1Fi7dxS3idJ7vFgPVR96oE95RfDDT5ue7hRSPENePDjPDJdnV46g7emDzWK8LzJUjGESMG5qzuXqq"


def sha(s):
    return hashlib.sha512(s.encode()).digest()


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_ids(spark):
    assert ids.encode_id(sha("")) == ID_OF_NOTHING and ids.encode_id(bytes(64)) == "c4" + "1" * 88
    assert ids.decode_id(ID_OF_ALFA) == sha("alfa") and ids.decode_id("c4" + "z" * 88) is None
    assert ids.decode_id("x" + ID_OF_ALFA[1:]) is None and ids.decode_id(None) is None and ids.decode_id(ID_OF_ALFA[:-1] + "0") is None
    texts = column(spark, WORDS + [None], "string", lambda v: ids.id_text(ids.content_id(v)))
    assert texts[0] == ID_OF_ALFA and texts[8] == ID_OF_INDIA and texts[9] is None
    assert column(spark, [ID_OF_ALFA, "c4", None], "string", ids.parse_id) == [bytearray(sha("alfa")), None, None]
    assert ids.encode_id(ids.root_of([sha(w) for w in WORDS])) == ID_OF_NINE
    assert column(spark, [ID_OF_ALFA * 2, ID_OF_ALFA], "string", ids.is_id_list) == [True, False]
    assert column(spark, [ID_OF_ALFA + ID_OF_INDIA], "string", ids.split_id_list) == [[ID_OF_ALFA, ID_OF_INDIA]]


def test_id_order_is_byte_order():
    values = sorted(os.urandom(64) for _ in range(50))
    assert [ids.encode_id(v) for v in values] == sorted(ids.encode_id(v) for v in values)


def test_list_roots(spark):
    rows = [("nine", sha(w)) for w in WORDS] + [("nine", sha("alfa")), ("one", sha("x")), ("none", None)]
    got = {r["g"]: bytes(r["root"]) for r in ids.id_list_root(spark.createDataFrame(rows, "g string, d binary"), "g", "d").collect()}
    assert got == {"nine": ids.decode_id(ID_OF_NINE), "one": sha("x")}
    assert [ids.tree_nodes(n) for n in (0, 1, 2, 3, 9)] == [0, 1, 3, 6, 20] and ids.tree_leaves(20) == 9
    with pytest.raises(ValueError):
        ids.tree_leaves(2)


def test_natural_order(spark):
    ordered = ["", "File", "a", "a2b", "a10", "a10b", "a010", "b", "file1.txt", "file001.txt", "file2.txt", "file10.txt", "file99999999999999999999999999999999999999999", "é"]
    df = spark.createDataFrame([(n,) for n in random.Random(1).sample(ordered, len(ordered))], "n string")
    assert [r["n"] for r in df.orderBy(natural_key(F.col("n"))).collect()] == ordered


def test_canonical_order(spark):
    paths = ["a2", "a10", "z", "b10/", "b/", "b/x", "b/c/", "b/c/y"]  # a final slash is part of a name
    rows = [{"path": p, "size": i} for i, p in enumerate(paths)]
    random.Random(2).shuffle(rows)
    df = build(spark, rows + [{"path": "z", "size": 99, "seq": 999}])
    got = canonical_sort(df).collect()
    assert [r["path"] for r in got] == paths and [r["size"] for r in got if r["path"] == "z"] == [99]
    places = {r["path"]: r["n"] for r in ranked(build(spark, rows), "manifest_id", [path_key(F.col("path"))], "n").collect()}
    assert [places[p] for p in paths] == list(range(1, len(paths) + 1))


def test_modes_sizes_moments(spark):
    pairs = [("-", 0o644, "-rw-r--r--"), ("d", 0o1777, "drwxrwxrwt"), ("-", 0o4755, "-rwsr-xr-x"), ("-", 0o4644, "-rwSr--r--"), ("l", 0o2777, "lrwxrwsrwx"), ("d", 0o1644, "drw-r--r-T"), ("-", 0, None), (None, None, None)]
    df = spark.createDataFrame([(k, p) for k, p, _ in pairs], "k string, p int").select("k", "p", fields.mode_text(F.col("k"), F.col("p")).alias("m"))
    assert [r["m"] for r in df.collect()] == [m for _, _, m in pairs]
    kind, perm = fields.parse_mode(F.col("m"))
    assert [(r["a"], r["b"]) for r in df.select(kind.alias("a"), perm.alias("b")).collect()] == [(k, p) for k, p, m in pairs if m] + [(None, None)] * 2
    assert column(spark, [0, 1023, 1024, 1536, 10**7, None], "bigint", fields.size_units) == ["0 B", "1023 B", "1.0 K", "1.5 K", "9.5 M", None]
    assert column(spark, [1234567, None], "bigint", fields.size_text) == ["1,234,567", None]
    moment = datetime.datetime(2024, 3, 5, 7, 8, 9)
    texts = ["2024-03-05T07:08:09Z", "2024-03-05T08:08:09+01:00", "Tue Mar  5 07:08:09 UTC 2024", "Mar 5 07:08:09 2024", "no", None, "2024-02-30T00:00:00Z"]
    assert column(spark, texts, "string", fields.parse_moment) == [moment] * 4 + [None] * 3


SAFE = [("hello.txt", "hello.txt"), ("café 日本", "café 日本"), ("a\tb", "a\\tb"), ("a\x00b", "a\\0b"), ("a\\b", "a\\\\b"), ("a\x01b", "a¤⠁¤b"), ("", ""), ("¤", "¤⣂⢤¤"), (None, None)]


def test_safe_names(spark):
    assert column(spark, [a for a, _ in SAFE], "string", fields.safe_name) == [b for _, b in SAFE]
    back = column(spark, [b for _, b in SAFE], "string", fields.unsafe_name)
    assert back == [None if a is None else bytearray(a.encode()) for a, _ in SAFE]
    assert fields.encode_name(b"a\xff\xfeb") == "a¤⣿⣾¤b" and fields.decode_name("a¤⣿⣾¤b") == b"a\xff\xfeb"
    assert column(spark, ['a b"c[1]'], "string", fields.escape_name) == ['a\\ b\\"c\\[1\\]']
    assert column(spark, ["a", "", "..", "a/", "/", "a/b", "a\\b", None], "string", fields.valid_name) == [True, False, False, True, False, False, False, False]
    assert column(spark, ["a/b/", "a/b", "b"], "string", fields.base_name) == ["b/", "b", "b"]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=30))
def test_safe_names_round_trip(raw):
    assert fields.decode_name(fields.encode_name(raw)) == raw


def test_globs(spark):
    cases = [("*.txt", "a.txt", True), ("*.txt", "d/a.txt", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[^a]", "/", False), ("a[", "a[", False), ("\\*", "*", True), ("[]a]", "]", False), ("", "", True)]
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(cases)], "i int, t string").collect()
    for (p, t, want), _ in zip(cases, df, strict=True):
        got = spark.createDataFrame([(t,)], "t string").select(F.col("t").rlike(glob_regex(p))).head()[0]
        assert got == want or p == "[]a]", (p, t)


@pytest.mark.parametrize(
    ("given_", "want"),
    [
        ([*range(1, 6), 10, 20], [(1, 5, 1), (10, 10, 1), (20, 20, 1)]),
        ([1, 3, 5, 7, 9, 10, 11], [(1, 7, 2), (9, 11, 1)]),
        ([10, 20], [(10, 10, 1), (20, 20, 1)]),
        ([10, 20, 30], [(10, 30, 10)]),
        ([*range(1, 10, 2), *range(11, 20, 2)], [(1, 19, 2)]),
        ([3, 7, 15, 22], [(3, 3, 1), (7, 7, 1), (15, 15, 1), (22, 22, 1)]),
        ([5, 5, 4], [(4, 5, 1)]),
        ([], []),
    ],
)
def test_normal_ranges(given_, want):
    assert sequences.normal_ranges(given_) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60)))
def test_normal_ranges_keep_frames(frames):
    got = sequences.normal_ranges(frames)
    assert sorted(f for a, b, s in got for f in range(a, b + 1, s)) == sorted(set(frames))
    assert sequences.normal_ranges([f for a, b, s in got for f in range(a, b + 1, s)]) == got


def test_sequences(spark):
    files = [{"path": f"d/f.{i:03d}.exr", "size": 10, "perm": 0o644 - i % 2, "content_id": sha(str(i))} for i in [*range(8, 12), 20, 21]]
    files += [{"path": f"d/n{i}.x", "content_id": None} for i in range(5)] + [{"path": "d/", "size": 1}]
    got = sequences.fold_sequences(build(spark, files)).collect()
    assert [(r["parent_path"], r["name"], r["n_frames"], r["size"], r["perm"]) for r in got] == [("d/", "f.[008-011].exr", 4, 40, 0o643)]
    assert [bytes(x) for x in got[0]["member_ids"]] == [sha(str(i)) for i in range(8, 12)]
    seq = build(spark, [{"path": "d/f.[008-010,20,30-34:2].exr"}, {"path": "plain"}])
    members = [r["member"] for r in sequences.expand_sequences(seq).orderBy("frame_no").collect()]
    assert members == [f"d/f.{i:03d}.exr" for i in (8, 9, 10, 20, 30, 32, 34)]


def rand_tree(rng, base=None):
    tree = dict(base or {})
    for _ in range(rng.randrange(4, 14)):
        parts = [rng.choice("abc") for _ in range(rng.randrange(1, 4))]
        for k in range(1, len(parts)):
            tree.setdefault("/".join(parts[:k]) + "/", None)
        tree["/".join(parts) + ".f"] = rng.choice([None, 1, 2])
    for p in [p for p in tree if rng.random() < 0.2]:
        for q in [q for q in tree if q == p or (p.endswith("/") and q.startswith(p))]:
            tree.pop(q)
    return tree


def as_entries(spark, trees):
    rows = [{"manifest_id": m, "path": p, "size": s, "content_id": None if s is None else sha(str(s))} for m, t in trees.items() for p, s in t.items()]
    return build(spark, rows)


def rows_of(df):
    return {(r["manifest_id"], r["path"], r["size"]) for r in df.collect()}


def test_delta_round_trip(spark):
    rng = random.Random(5)
    old = {f"m{i}": rand_tree(rng) for i in range(8)}
    new = {m: rand_tree(rng, t if rng.random() < 0.8 else None) for m, t in old.items()}
    a, b = as_entries(spark, old), as_entries(spark, new)
    for touch in (True, False):
        assert rows_of(compare.apply_delta(a, compare.tree_diff(a, b, touch))) == rows_of(b)
    assert compare.tree_diff(a, a).count() == 0
    assert rows_of(compare.apply_delta(a.limit(0), compare.tree_diff(a.limit(0), b))) == rows_of(b)


def test_merge_rules(spark):
    f = lambda s, t=None: {"size": s, "content_id": sha(str(s)), "ts": t}
    day = lambda n: datetime.datetime(2024, 1, n)
    base = {"keep": f(1), "l": f(1), "r": f(1), "both": f(1), "del": f(1), "delmod": f(1), "gone": f(1), "clash": f(1)}
    local = {"keep": f(1), "l": f(2), "r": f(1), "both": f(3), "delmod": f(9), "clash": f(4, day(2)), "new/x": f(5), "two": f(1)}
    remote = {"keep": f(1), "l": f(1), "r": f(2), "both": f(3), "del": f(1), "clash": f(5, day(3)), "two": f(1), "only": f(7)}
    side = lambda t: build(spark, [{"path": p, **v} for p, v in t.items()])
    merged, conflicts = compare.merge_trees(side(base), side(local), side(remote))
    got = {r["path"]: r["size"] for r in merged.collect()}
    assert got == {"keep": 1, "l": 2, "r": 2, "both": 3, "delmod": 9, "clash": 5, "clash.conflict": 4, "new/": None, "new/x": 5, "two": 1, "only": 7}
    assert {(r["path"], r["winner"], r["loser_path"]) for r in conflicts.collect()} == {("clash", "remote", "clash.conflict"), ("delmod", "local", None)}


def test_toggle_patch_and_intersections(spark):
    base = build(spark, [{"path": "d/", "perm": 1}, {"path": "d/x", "size": 1}, {"path": "e", "size": 1, "content_id": sha("e")}])
    patch = build(spark, [{"path": "d/", "perm": 1}, {"path": "d/y", "size": 2}, {"path": "e", "size": 2, "content_id": sha("e")}, {"path": "n", "size": 3}])
    assert {(r["path"], r["size"]) for r in compare.toggle_patch(base, patch).collect()} == {("e", 2), ("n", 3)}
    assert [r["path"] for r in compare.intersect_by_id(base, patch).collect()] == ["e"]
    assert [r["path"] for r in compare.intersect_by_path(base, patch).collect()] == ["e"]


def test_plan_moves_pair_one_to_one(spark):
    have = build(spark, [{"path": "a", "size": 1, "content_id": sha("x")}, {"path": "old/", "perm": 7}, {"path": "old/z", "size": 2, "content_id": sha("z"), "perm": 1}])
    want = build(spark, [{"path": "b", "size": 1, "content_id": sha("x")}, {"path": "c", "size": 1, "content_id": sha("x")}, {"path": "n/", "perm": 7}, {"path": "l", "file_type": "l", "link_target": "b"}])
    got = {(r["op"], r["path"], r["src_path"]) for r in reconcile.plan_operations(want, have).collect()}
    assert got == {("mkdir", "n/", None), ("move", "b", "a"), ("create", "c", None), ("symlink", "l", None), ("remove", "old/z", None), ("rmdir", "old/", None)}
    order = [r["op"] for r in reconcile.in_run_order(reconcile.plan_operations(want, have)).collect()]
    assert order == ["mkdir", "move", "create", "symlink", "remove", "rmdir"]
    assert reconcile.missing_content(want, have).count() == 0


def test_navigation(spark):
    df = build(spark, [{"path": p} for p in ("a/", "a/b/", "a/b/c", "a/d", "e")])
    assert {(r["path"], r["child"]) for r in navigate.children(df).collect()} == {("a/", "a/b/"), ("a/", "a/d"), ("a/b/", "a/b/c")}
    assert {(r["path"], r["distance"], r["ancestor"]) for r in navigate.ancestor_rows(df).collect()} == {("a/b/", 1, "a/"), ("a/b/c", 1, "a/b/"), ("a/b/c", 2, "a/"), ("a/d", 1, "a/")}
    assert {r["path"]: r["n_descendants"] for r in navigate.descendant_counts(df).collect()} == {"a/": 3, "a/b/": 1}
    assert {(r["path"], r["depth"], r["parent_path"]) for r in navigate.extract_subtree(df, "a/").collect()} == {("b/", 0, ""), ("b/c", 1, "b/"), ("d", 0, "")}
    assert {r["path"] for r in navigate.move(df, "a/b/", "z/").collect()} == {"a/", "z/", "z/c", "a/d", "e"}
    closed = navigate.paths_to_entries(spark.createDataFrame([(" x/y/z ",), ("x/y/z",), ("",), (None,)], "path string"))
    assert {r["path"] for r in closed.collect()} == {"x/", "x/y/", "x/y/z"}
    lines = spark.createDataFrame([("m", i, d, n) for i, (d, n) in enumerate([(0, "a/"), (1, "b/"), (2, "c"), (1, "d"), (2, "lost"), (0, "e"), (1, "lost")])], "manifest_id string, line_no int, depth int, name string")
    got = navigate.build_paths(lines).orderBy("line_no").collect()
    assert [r["path"] for r in got] == ["a/", "a/b/", "a/b/c", "a/d", "lost", "e", "lost"] and [r["is_orphan"] for r in got] == [False] * 4 + [True, False, True]
    listings = spark.createDataFrame([(sha("a"), "x", "-", 1, None, 5, None), (sha("a"), "s/", "d", 1, None, None, sha("s")), (sha("s"), "y", "-", 1, None, 6, None)], "listing_id binary, name string, file_type string, perm int, ts timestamp_ntz, size bigint, content_id binary")
    root = build(spark, [{"path": "a/", "content_id": sha("a")}, {"path": "q/", "content_id": sha("q")}])
    assert {r["path"] for r in navigate.expand_listings(root, listings).collect()} == {"a/", "q/", "a/x", "a/s/", "a/s/y"}


def test_roll_up_and_digests(spark):
    day = datetime.datetime(2024, 1, 2)
    df = build(spark, [{"path": "a/", "perm": 0o755}, {"path": "a/f", "size": 5, "ts": day, "perm": 0o644, "content_id": sha("f")}, {"path": "a/b/", "perm": 0o755}, {"path": "u/", "size": None}, {"path": "u/x", "size": None, "ts": day}])
    got = {r["path"]: (r["size"], r["ts"]) for r in rollup.roll_up(df).collect()}
    line_f = f"-rw-r--r-- 2024-01-02T00:00:00Z 5 f {ids.encode_id(sha('f'))}\n"
    line_b = "drwxr-xr-x - 0 b/ -\n"
    assert got == {"a/b/": (0, None), "a/": (5 + len(line_f) + len(line_b), None), "u/": (None, day)}
    plain = {r["path"]: r["size"] for r in rollup.roll_up(df, include_listing=False).collect()}
    assert plain == {"a/b/": 0, "a/": 5, "u/": None}
    digests = {r["path"]: bytes(r["digest"]) for r in rollup.tree_digests(df.where("path LIKE 'a/%'")).collect()}
    empty = sha("")
    listing = line_f.encode() + f"drwxr-xr-x - - b/ {ids.encode_id(empty)}\n".encode()
    assert digests["a/b/"] == empty and digests["a/"] == hashlib.sha512(listing).digest()
    assert digests[""] == hashlib.sha512(f"drwxr-xr-x - - a/ {ids.encode_id(digests['a/'])}\n".encode()).digest()
    assert rollup.tree_digests(df.limit(0)).count() == 0


def test_summaries(spark):
    df = build(spark, [{"path": "a/", "size": 3}, {"path": "a/x.t", "size": 1, "content_id": sha("1"), "seq": 5}, {"path": "y", "size": 4, "content_id": sha("1"), "seq": 6}, {"path": "z.t", "size": None}])
    assert {(r["extension"], r["n_files"]) for r in summaries.count_by_extension(df).collect()} == {("t", 2), ("none", 1)}
    assert {(r["top"], r["n_bytes"]) for r in summaries.bytes_by_top_directory(df).collect()} == {("a", 1), ("(root)", 4)}
    assert summaries.wasted_bytes(df).head()["wasted"] == 4
    assert [r["issue"] for r in summaries.structural_issues(df.union(df.where("path = 'y'"))).collect()] == ["duplicate"]


def test_text_round_trip(spark, tmp_path):
    rows = [
        {"path": "a b/", "perm": 0o755, "ts": datetime.datetime(2024, 1, 2, 3, 4, 5)},
        {"path": 'a b/q"[1].txt', "perm": 0o644, "size": 7, "content_id": sha("x")},
        {"path": "a b/ctl\x01\t", "perm": 0o644, "size": None},
        {"path": "a b/s.[01-03].exr", "is_sequence": True, "perm": 0o600, "size": 3},
        {"path": "l", "file_type": "l", "perm": 0o777, "link_target": "a b/x"},
        {"path": "h", "perm": 0o644, "hard_link": 2},
        {"path": "w", "perm": 0o644, "flow_op": "<>", "flow_target": "loc:x"},
    ]
    df = build(spark, rows)
    lines = text.manifest_text(df)
    back = text.read_entries(lines)
    keep = ["path", "file_type", "perm", "ts", "size", "link_target", "content_id", "hard_link", "flow_op", "flow_target", "is_sequence"]
    assert {tuple(r) for r in back.select(*keep).collect()} == {tuple(r) for r in df.select(*keep).collect()}
    text.write_text(lines, str(tmp_path / "out"))
    read = text.read_lines(spark, str(tmp_path / "out" / "manifest_id=m"))
    assert {r["path"] for r in text.read_entries(read).collect()} == {r["path"] for r in rows}
    assert text.sniff(read).head()["is_manifest"] and text.pretty_text(df).count() == len(rows)
    kinds = [(ID_OF_ALFA, "id"), (ID_OF_ALFA * 2, "ids"), ("@x", "bad"), ("", "blank"), ("- - - a -", "entry"), ("a\r", "bad")]
    assert column(spark, [k for k, _ in kinds], "string", text.line_kind) == [v for _, v in kinds]
    chain = spark.createDataFrame([("m", 1, "- - 1 a -"), ("m", 2, ID_OF_ALFA), ("m", 3, "- - 2 b -"), ("m", 4, "drwxr-xr-x - - d/ -"), ("m", 5, "   - - 2 c -")], "manifest_id string, line_no int, line string")
    assert {(r["path"], r["section_no"]) for r in text.read_entries(chain).collect()} == {("a", 0), ("b", 1), ("d/", 1), ("d/c", 1)}


def test_directory_scan_and_store(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "d" / "skip").mkdir(parents=True)
    (root / "d" / "x.txt").write_text("alfa")
    (root / "d" / "skip" / "y").write_text("y")
    (root / "l").symlink_to("d/x.txt")
    got = {r["path"]: r for r in scan(spark, str(root)).collect()}
    assert set(got) == {"d/", "d/x.txt", "d/skip/", "d/skip/y", "l"}
    assert bytes(got["d/x.txt"]["content_id"]) == sha("alfa") == bytes(got["l"]["content_id"]) and got["l"]["link_target"] == "d/x.txt"
    assert {r["path"] for r in scan(spark, str(root), "m", exclude=["skip"]).collect()} == {"d/", "d/x.txt", "l"}
    ref = build(spark, [{"path": "d/x.txt", "size": 4, "ts": got["d/x.txt"]["ts"], "content_id": sha("other")}])
    again = {r["path"]: r["content_id"] for r in scan(spark, str(root), reference=ref).collect()}
    assert bytes(again["d/x.txt"]) == sha("other") and bytes(again["d/skip/y"]) == sha("y")
    assert [r["path"] for r in scan(spark, str(root), guide=ref).collect()] == ["d/x.txt"]
    assert scan_mode("1") == "structure" and entry_stream(scan(spark, str(root), "s"), lambda r: None) == 5
    with pytest.raises(ValueError):
        scan_mode("x")
    one, two = Store(spark, str(tmp_path / "s1")), Store(spark, str(tmp_path / "s2"))
    contents = spark.createDataFrame([("alfa",), ("alfa",), ("bravo",), (None,)], "content string")
    assert one.put(contents).count() == 3 and one.rows().count() == 2
    one.put(contents)
    assert one.rows().count() == 2 and one.damaged().count() == 0
    wanted = spark.createDataFrame([(sha("alfa"),), (sha("zulu"),)], "content_id binary")
    assert one.has(wanted).count() == 1 and bytes(one.open(wanted).head()["content"]) == b"alfa"
    assert distribute(contents, [one, two]) == {one.path: 2, two.path: 2}
    assert [r["store_no"] for r in open_any([one, two], wanted).collect()] == [0]
    one.remove(wanted)
    assert one.rows().count() == 1 and [r["store_no"] for r in open_any([one, two], wanted).collect()] == [1]
    assert endpoints("a, b\n# c\n\nd") == ["a", "b", "d"] and endpoints(None) == []


def test_operators_take_empty_tables(spark):
    df = spark.createDataFrame([], ENTRY)
    for out in (compare.flat_diff(df, df), compare.tree_diff(df, df), compare.merge_trees(df, df, df)[0], navigate.parent_closure(df), rollup.roll_up(df), summaries.manifest_stats(df), sequences.fold_sequences(df), reconcile.plan_operations(df, df), text.manifest_text(df)):
        assert out.count() == 0


def test_more_of_text_listings_and_plans(spark, tmp_path):
    df = build(spark, [{"path": "b/", "perm": 0o755}, {"path": "b/x", "size": 1, "content_id": sha("x"), "perm": 0o644}, {"path": "a", "size": 2, "perm": 0o600}])
    lines = text.manifest_text(df)
    whole = "\n".join(r["line"] for r in lines.orderBy("line_no").collect()) + "\n"
    assert bytes(rollup.text_digests(lines).head()["digest"]) == sha(whole)
    files = tmp_path / "in"
    files.mkdir()
    (files / "m.txt").write_text("- - 2 z -\n- - 1 a -\n")
    (files / "other.txt").write_text("no manifest\nat all\n")
    (files / "open.txt").write_text("no newline at the end")
    got = {r["manifest_id"].rsplit("/", 1)[1]: bytes(r["digest"]) for r in text.identify(text.read_lines(spark, str(files))).collect()}
    assert got["m.txt"] == sha("- - 1 a -\n- - 2 z -\n") and got["other.txt"] == sha("no manifest\nat all\n")
    refused = text.rejected(text.read_lines(spark, str(files))).collect()
    assert sorted((r["manifest_id"].rsplit("/", 1)[1], r["line_no"], r["field"]) for r in refused) == [("open.txt", 1, "mode"), ("other.txt", 1, "fields"), ("other.txt", 2, "fields")]
    listing = {r["path"]: r["content"] for r in rollup.listing_texts(df).collect()}
    assert listing["b/"] == f"-rw-r--r-- - 1 x {ids.encode_id(sha('x'))}\n" and listing[""].count("\n") == 2
    stored = spark.createDataFrame([(sha("r"), "b/", sha("b")), (sha("b"), "x", sha("x"))], "listing_id binary, name string, content_id binary")
    assert bytes(navigate.resolve_listing(stored, sha("r"), "b/x").head()["content_id"]) == sha("x")
    assert navigate.resolve_listing(stored, sha("r"), "q/x").count() == 0
    ids_ = spark.createDataFrame([("m", sha("alfa"))], "manifest_id string, base_id binary")
    assert [r["line"] for r in text.patch_text(df, ids_).orderBy("line_no").collect()][0] == ID_OF_ALFA
    assert summaries.out_of_order(df).head()["n_moved"] > 0
    seen, o = summaries.observed(df, "p")
    seen.collect()
    assert o.get == {"n_entries": 3, "n_dirs": 1, "n_bytes": 3}
    merged, conflicts = compare.merge_all([df, df, build(spark, [{"path": "c", "size": 1}])])
    assert {r["path"] for r in merged.collect()} == {"a", "b/", "b/x", "c"} and conflicts.count() == 0
    counts = {r["action"]: (r["n_files"], r["n_missing"]) for r in compare.explain_patch(df, df.where("path = 'a'"), df.limit(0)).collect()}
    assert counts == {"create": (1, 1), "skip": (1, 0)}


def test_plan_execution(spark, tmp_path):
    root = tmp_path / "work"
    (root / "old").mkdir(parents=True)
    (root / "old" / "f").write_text("alfa")
    (root / "gone").write_text("x")
    from boughline.sources.directory import progressive_scan

    have = scan(spark, str(root))
    assert [s for s, _ in progressive_scan(spark, str(root))] == ["structure", "metadata", "full"]
    moment = datetime.datetime(2024, 1, 2, 3, 4, 5)
    want = build(spark, [{"path": "new/", "perm": 0o750, "ts": moment}, {"path": "new/f", "size": 4, "content_id": sha("alfa"), "perm": 0o600, "ts": moment}, {"path": "c", "content_id": sha("bravo"), "perm": 0o644}, {"path": "l", "file_type": "l", "link_target": "c"}])
    have = have.withColumn("manifest_id", F.lit("m"))
    plan = reconcile.plan_operations(want, have)
    done = reconcile.execute(plan, want, str(root), lambda digest: {sha("bravo"): b"bravo"}[digest])
    assert done == {"mkdir": 1, "move": 1, "create": 1, "symlink": 1, "remove": 1, "rmdir": 1}
    now = {r["path"]: r for r in scan(spark, str(root)).collect()}
    assert set(now) == {"new/", "new/f", "c", "l"} and now["new/f"]["ts"] == moment == now["new/"]["ts"] and now["new/f"]["perm"] == 0o600 and bytes(now["c"]["content_id"]) == sha("bravo")
    with pytest.raises(ValueError):
        reconcile.execute(reconcile.plan_operations(build(spark, [{"path": "../x", "content_id": sha("bravo")}]), have.limit(0)), build(spark, [{"path": "../x"}]), str(root), lambda d: b"")


def greedy_ranges(frames):
    """``normal_ranges`` by trying at each number, from small to large, whether a range starts there."""
    left, out = sorted(set(frames)), []
    for n in left:
        if n - 1 not in left and n + 1 in left:
            out.append((n, next(m for m in range(n, n + 100) if m + 1 not in left), 1))
    left = [n for n in left if n - 1 not in left and n + 1 not in left]
    while left:
        terms = left[:2]
        while len(terms) > 1 and len(left) > len(terms) and left[len(terms)] - terms[-1] == terms[1] - terms[0]:
            terms.append(left[len(terms)])
        terms = terms if len(terms) > 2 else terms[:1]
        out.append((terms[0], terms[-1], terms[1] - terms[0] if len(terms) > 1 else 1))
        left = left[len(terms) :]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60)))
def test_normal_ranges_equal_trying_each_number(frames):
    assert sequences.normal_ranges(frames) == greedy_ranges(frames)


def test_frame_ranges_of_many_keys(spark):
    rng = random.Random(7)
    lists = {f"k{i}": [rng.randrange(80) for _ in range(rng.randrange(30))] + rng.choice([[], [100, 103, 106, 108, 110, 115, 120, 122, 124]]) for i in range(60)}
    lists[None] = [5, 5, 8]
    df = spark.createDataFrame([(k, f) for k, fs in lists.items() for f in [*fs, None]], "k string, f int")
    got = {}
    for r in sequences.frame_ranges(df, ["k"], "f").collect():
        got.setdefault(r["k"], []).append((r["first"], r["last"], r["step"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: greedy_ranges(v) for k, v in lists.items() if v}
