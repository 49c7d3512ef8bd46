"""Identities of texts: canonical manifests recognised while they are hashed, others read and written anew."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from boughline.functions import ids
from boughline.functions.fields import encode_name
from boughline.functions.order import path_key
from boughline.plans import queries
from boughline.schema import build
from boughline.sources import canonical, text

ID = ids.encode_id(hashlib.sha512(b"x").digest())
NAMES = ["a", "a1", "a01", "a10", "a9", "9", "09", "A", "d/", "1/", "x 1", 'q"u', "b[x]", "b[1]", ".h", "...", "é", "т9", "𝒳", "¤", "t\tb", "n\n2", " ", "z​", "-", "c4", "->", "@"]
#: Files of which some are their own canonical text; of the others each differs in one place.
FILES = [
    ["- - - a -", "drwxr-xr-x 2024-02-29T23:59:59Z 0 d/ -", f"  lrwxrwxrwx - 12 l -> a\\ b {ID}", "  - - - m <- s:x/ -", "  - - - n ->3 -", "  - - - o -> -", "  - - - p[1-3].x -", "  d--------- - - q/ -", "    - - - r\\ 1 -", "d--------- - - e/ -"],
    ["- - - b -", "- - - a -"], ["d--------- - - d/ -", "- - - a -"], ["- - - a9 -", "- - - a10 -"], ["- - - a10 -", "- - - a9 -"], ["- - - a1 -", "- - - a01 -"], ["- - - a01 -", "- - - a1 -"],
    ["d--------- - - d/ -", "    - - - a -"], ["d--------- - - d/ -", " - - - a -"], ["- - - a -", "  - - - b -"], ["d--------- - - d/ -", "  d--------- - - e/ -", "     - - - f -"], ["d--------- - - d/ -", "  - - - e -", "    - - - f -"],
    ["", "- - - a -"], ["- - - a -", ""], ["- - - a - "], ["-  - - a -"], ["---------- - - a -"], ["-rwtr--r-- - - a -"], ["-rw-r--r-T - - a -"], ["-rwSr-sr-t - - a -"], ["drwxr-xr-x - - a -"],
    ["- 0 - a -"], ["- 1970-01-01T00:00:00Z - a -"], ["- 2023-02-29T00:00:00Z - a -", "- - - b -"], ["- 2024-01-01T24:00:00Z - a -", "- - - b -"], ["- 2024-01-01T01:00:00+01:00 - a -"], ["- 1582-10-10T00:00:00Z - a -"],
    ["- - 1,000 a -"], ["- - 007 a -"], ["- - 999999999999999999 a -"], ["- - 9999999999999999999 a -", "- - - b -"], ["- - - a\\[1\\] -"], ["- - - a[1] -"], ["- - - a[x] -"], ['- - - a" -'], ['- - - a\\" -'], ["- - - a\\t -"], ["- - - a\\x -"], ["- - - ¤⠀¤ -"], ["- - - ¤⠁¤ -"], ["- - - ¤⣿¤ -"], ["- - - ¤a -"],
    ["- - - .. -", "- - - a -"], ["- - - a/b -", "- - - c -"], ["- - - a c4" + "z" * 88], [f"- - - a {ids.encode_id(bytes([255]) * 64)}"], ["- - - a c4x", "- - - b -"], [f"- - - a -{ID}", "- - - b -"],
    ["l--------- - - a -> b\\\"c -"], ["- - - a -> s:b\\ c -"], ["l--------- - - a -> s:b\\ c -"], ["- - - a -> s:b -"], ["- - - a -> b[1] -"], ["- - - a => b -"], ["- - - a <- -"], ["- - - a ->0 -"], ["- - - a ->3 b -"], ["- - - a ->03 -"],
    [ID, "- - - a -"], ["- - - a -", ID], ["- - - a -", ID, "- - - b -"], ["- - - a -", "- - - a -"], ["- - - a\r -", "- - - b -"], ["@x", "- - - a -"], ["words", "- - - a -"], [" ", "words"], ["c4 words", "more"], ["- -x"], [""], ["- list", "- 0"],
]


def _lines(spark, files):
    rows = [(str(i), n, line) for i, lines in enumerate(files) for n, line in enumerate(lines)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "manifest_id string, line_no bigint, line string").localCheckpoint()


def _digests(df):
    return {r["manifest_id"]: bytes(r["digest"]) for r in df.collect()}


def test_texts_have_the_identities_of_what_is_read_from_them(spark):
    lines = _lines(spark, FILES)
    got = _digests(text.identify(lines))
    assert got == _digests(text._identify_anew(lines, "sha512"))
    assert got["0"] == hashlib.sha512("".join(x + "\n" for x in FILES[0]).encode()).digest()


def _own(lines):
    file = canonical._File("sha256")
    file.take([x + "\n" for x in lines], memoryview(b""))
    return file.same


@pytest.mark.parametrize("lines", [FILES[0], ["- - - a9 -", "- - - a10 -"], ["- - - a\\[1\\] -"], ["- - - ¤⠁¤ -"], ["- - - a -> s:b -"], ["words"]])
def test_canonical_texts_are_recognised(lines):
    assert _own(lines)


def test_sibling_keys_are_those_of_paths(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", path_key(F.col("n")).alias("k"))
    written = lambda n: "".join("\\" + c if c in ' "[]' else c for c in encode_name(n))
    for r in df.collect():
        assert canonical.sibling_key(written(r["n"])) == r["k"], r["n"]


def test_identity_of_canonical_texts_reads_lines_once(spark):
    lines, seen = _lines(spark, [FILES[0], ["words", ""], ["- - - a -", "- - - b -"]]), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    assert len(text.identify(lines.mapInArrow(counted, lines.schema)).collect()) == 3
    assert seen.value == lines.count()


def test_files_go_on_across_batches(spark):
    files = [[f"- - - a{i} -" for i in range(20)], ["", "", "words", *map(str, range(9))], ["- - - b -", *[f"- - - a{i} -" for i in range(9)]]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = _digests(text.identify(_lines(spark, files)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [files[0], files[1], [*files[2][1:], files[2][0]]]
    assert got == {str(i): hashlib.sha512("".join(x + "\n" for x in lines).encode()).digest() for i, lines in enumerate(want)}


def test_keyed_text_is_numbered_where_it_is_read_anew(spark):
    tree = build(spark, [{"path": p, "link_target": t} for p, t in (("b10", None), ("b9", None), ("a/", None), ("a/x 1", "t"))])
    keyed = text.keyed_text(tree)
    want = _digests(text.identify(text.manifest_text(tree)))
    assert _digests(text.identify(keyed, order=text.TEXT_ORDER)) == want
    assert _digests(text.identify(keyed.repartition("manifest_id"), order=text.TEXT_ORDER, together=True)) == want
    wide = _digests(text.identify(text.keyed_text(tree, indent=4), order=text.TEXT_ORDER))
    assert wide == want


def test_query_tells_documents_apart(spark, tmp_path):
    rows = [{"manifest_id": m, "seq": i, "path": p} for i, (m, p) in enumerate([("1", "b"), ("1", "a"), ("7", "c/"), ("7", "c/d")])]
    entries = build(spark, rows + rows[:2])
    entries.withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(str(tmp_path / "entries.parquet"))
    docs = [(1, "one\ntwo"), (1, "one\ntwo"), (1, "other"), (2, None), (3, ""), (None, "x"), (4, "- 0 is first\n- 1 is second")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [("1", sha("- - - a -\n- - - b -\n")), ("7", sha("d--------- - - c/ -\n  - - - d -\n")), *[(d and str(d), sha(t + "\n")) for d, t in set(docs) if t is not None]]
    got = [tuple(r) for r in queries.QUERIES["text_identities"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
