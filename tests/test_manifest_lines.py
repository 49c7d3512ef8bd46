import datetime
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from boughline.sources.manifest_lines import FIELDS, ID_ALPHABET, _bounded, _read_range, load_manifest_lines, parse_lines, read_records, rejected_lines

ID = "c4" + "1" * 88
GOOD = f"-rw-r--r-- 2024-02-29T10:00:00Z 1,024 a.txt {ID}"


def plain(line):
    """The definition of a valid line, read one line at a time."""
    if line is None or line.strip(" \t") == "":
        return -1
    if any(ord(c) < 32 and c != "\t" for c in line):
        return 1
    body = line.lstrip(" ")
    if (len(line) - len(body)) % 2:
        return 2
    if body.count('"') not in (0, 2):
        return 3
    at = 3
    if '"' in body:
        m = re.fullmatch(r'(.* )?"([^"]*)"( .*)?', body, re.S)
        if not m:
            return 3
        before = (m[1] or "").split(" ")[:-1] if m[1] else []
        parts = before + ['"' + m[2] + '"'] + (m[3][1:].split(" ") if m[3] else [])
        at = len(before)
    else:
        parts = body.split(" ")
    if len(parts) not in (5, 7) or (len(parts) == 7 and parts[4] != "->"):
        return 4
    if at != 3:
        return 3
    mode, ts, size, name, ident = parts[0], parts[1], parts[2], parts[3].strip('"'), parts[-1]
    if mode != "-" and not re.fullmatch("[-dlbcps][-rwxstST]{9}", mode):
        return 5
    if ts not in ("-", "0"):
        if not re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z", ts) or ts[17:19] >= "60":
            return 6
        try:
            datetime.datetime.strptime(ts, "%Y-%m-%dT%H:%M:%SZ")
        except ValueError:
            return 6
    digits = size.replace(",", "")
    if size != "-" and (not re.fullmatch("[0-9]+", digits) or int(digits) >= 2**63):
        return 7
    core = name[:-1] if mode[0] == "d" and name.endswith("/") else name
    if core in ("", ".", "..") or "/" in core or "\\" in core:
        return 8
    return 0 if ident == "-" or re.fullmatch(f"c4[{ID_ALPHABET}]{{88}}", ident) else 9


CASES = [
    GOOD, "  " + GOOD, None, "", "   ", " " + GOOD, GOOD + "\r", GOOD.replace("a.txt", '"a b.txt"'), GOOD.replace("a.txt", '"a b.txt'), GOOD.replace("a.txt", '"a"b c"'),
    GOOD.replace("a.txt", "a b.txt"), GOOD.replace("-rw-r--r--", "0644"), GOOD.replace("-rw-r--r--", "-"), GOOD.replace("02-29", "02-30"), GOOD.replace("2024-02-29", "2023-02-29"),
    GOOD.replace("1,024", "-1"), GOOD.replace("1,024", "9223372036854775807"), GOOD.replace("1,024", "9223372036854775808"), GOOD.replace("1,024", ","), GOOD.replace("1,024", "00000000000000000000007"),
    GOOD.replace("a.txt", ".."), GOOD.replace("a.txt", "a/"), "drwxr-xr-x - - a/ -", "drwxr-xr-x - - / -", "drwxr-xr-x - - ../ -", "drwxr-xr-x - - a/b/ -", GOOD.replace("a.txt", "a\\b"),
    GOOD[:-1], GOOD[:-1] + "0", "lrwxrwxrwx - - a -> b -", "lrwxrwxrwx - - a => b -", 'lrwxrwxrwx - - a -> "b -', '"-" - - a -', "- - - a\tb -", "-", "- - - é漢 -", "- - -  -", "x" * 5000,
]


def test_agrees_with_the_definition_line_by_line():
    assert parse_lines(pa.array(CASES, pa.string()))["code"].tolist() == [plain(c) for c in CASES]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=' "-dlrwxsT/\\.0129:,Zac4é\t\r->', max_size=40) | st.sampled_from([c for c in CASES if c]), max_size=12))
def test_any_batch_agrees(lines):
    assert parse_lines(pa.array(lines, pa.string()))["code"].tolist() == [plain(c) for c in lines]


def test_sliced_arrays_and_values():
    got = parse_lines(pa.array(["x", *CASES], pa.string()).slice(1))
    assert got["code"].tolist() == [plain(c) for c in CASES]
    assert got["size"][0].as_py() == 1024 and got["name"][7].as_py() == "a b.txt"


def test_load_separates_and_deduplicates(spark):
    rows = [("m", i, line, "x") for i, line in enumerate(CASES)]
    lines = spark.createDataFrame(rows + rows[:8], "manifest_id string, line_no int, line string, field string")
    good, bad = load_manifest_lines(lines)
    assert {r["line_no"] for r in good.collect()} == {i for i, c in enumerate(CASES) if plain(c) == 0}
    reasons = {r["line_no"]: r["field"] for r in bad.collect()}
    assert reasons == {i: FIELDS[plain(c)] for i, c in enumerate(CASES) if plain(c) > 0}
    assert good.count() == len({i for i, c in enumerate(CASES) if plain(c) == 0})
    link = [r for r in good.collect() if r["name"] == "a" and r["file_type"] == "l"][0]
    assert link["link_target"] == "b" and link["perm"] == 0o777


def test_empty_table(spark):
    lines = spark.createDataFrame([], "manifest_id string, line_no bigint, line string")
    assert rejected_lines(lines).count() == 0


def test_a_number_with_a_good_and_a_bad_text_comes_out_once(spark):
    good = "- - 1 a -"
    df = spark.createDataFrame([("m", 1, good), ("m", 1, "zz"), ("m", 2, good), ("m", 2, " "), ("m", 2, None), ("m", 3, "!"), ("m", 3, good), ("m", 3, "!")], "manifest_id string, line_no int, line string")
    entries, bad = load_manifest_lines(df)
    assert sorted(r["line_no"] for r in entries.collect()) == [1, 2] and [(r["line_no"], r["raw"]) for r in bad.collect()] == [(3, "!")]


def test_batches_are_bounded_by_bytes():
    lines = ["a" * n for n in (3, 4, 50, 1, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(lines)], names=["line"])
    assert [b.column("line").to_pylist() for b in _bounded(iter([batch]), 8)] == [lines[:2], lines[2:3], lines[3:]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab\" \n", max_size=9), max_size=12), st.integers(1, 30), st.integers(1, 9))
def test_ranges_hold_each_record_once(tmp_path_factory, parts, size, step):
    path = tmp_path_factory.mktemp("f") / "m"
    path.write_text("\n".join(parts))
    data = path.read_bytes()
    found = [x for start in range(0, len(data), size) for got in _read_range(str(path), start, start + size, step) for x in got.to_pylist()]
    want = data.split(b"\n")
    assert found == (want[:-1] if data.endswith(b"\n") or not data else want)


def test_files_are_read_parsed_and_rejected(spark, tmp_path):
    lines = [GOOD if i % 5 else f'broken "quote {i}' for i in range(2000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text(GOOD)
    (tmp_path / "empty.txt").write_text("")
    read = read_records(spark, str(tmp_path), range_bytes=5000, step=700)
    entries, bad = load_manifest_lines(read)
    assert sorted(r["line_no"] for r in bad.where("manifest_id LIKE '%a.txt'").collect()) == [i + 1 for i in range(0, 2000, 5)]
    assert entries.count() == 1600 + 1 and [r["field"] for r in bad.select("field").distinct().collect()] == ["quoting"]
    assert read.count() == 2001
