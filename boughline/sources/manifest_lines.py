"""Manifest text as rows: valid lines become entries, bad lines become reasoned rejects.

The parser never looks at one line at a time. A batch of lines is one byte
buffer; quote masks and their prefix parity tell which blanks delimit fields,
and every count and type check is a numpy operation over the whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from boughline.operators.common import broadcast_up_to, settle

# Fixed values of the line format.
ID_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
MODE_TYPES = "-dlbcps"
MODE_BITS = "-rwxstST"
ID_LENGTH = 90
#: Bytes of lines that are parsed at a time (the masks take some ten times as much); a longer line is parsed alone.
BATCH_BYTES = 4 << 20

#: Reasons in the order in which they are looked for; 0 is a valid line, -1 a blank one.
FIELDS = ["", "character", "indentation", "quoting", "fields", "mode", "timestamp", "size", "name", "c4id"]
MESSAGES = [
    "",
    "control character in the line",
    "odd number of leading spaces",
    "double quotes belong only at both ends of the name",
    "five fields expected, or seven with -> and a target",
    "mode is neither - nor a type and nine permission characters",
    "timestamp is not -, 0 or an existing moment YYYY-MM-DDTHH:MM:SSZ",
    "size is not - or a decimal number within 64 bits",
    "name is empty, . or .., or holds a slash or backslash",
    "id is neither - nor c4 and 88 base-58 characters",
]

PARSED_SCHEMA = T.StructType(
    [
        T.StructField("manifest_id", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("field", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("ts_text", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("id_text", T.StringType()),
    ]
)


def _table(chars: str) -> np.ndarray:
    known = np.zeros(256, bool)
    known[np.frombuffer(chars.encode(), np.uint8)] = True
    return known


_TYPES, _BITS, _DIGITS, _IDS = _table(MODE_TYPES), _table(MODE_BITS), _table("0123456789"), _table(ID_ALPHABET)
_MONTH_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _within(mask: np.ndarray) -> np.ndarray:
    """Prefix counts of a byte mask: the count in [a, b) is out[b] - out[a]."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _gather(buf: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """A matrix of ``width`` bytes from each start (callers pick rows that are long enough)."""
    return buf[start[:, None] + np.arange(width)]


def _slices(buf: np.ndarray, start: np.ndarray, length: np.ndarray, null: np.ndarray) -> pa.Array:
    """Slices of the buffer as a string column without a Python loop."""
    length = np.where(null, 0, length)
    ends = np.cumsum(length)
    index = np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.zeros(len(length) + 1, np.int64)
    offsets[1:] = ends
    data = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[index])))
    return pa.compute.if_else(pa.array(null), pa.scalar(None, pa.large_string()), data).cast(pa.string())


def _moment_ok(m: np.ndarray) -> np.ndarray:
    """Rows of 20 bytes that are an existing YYYY-MM-DDTHH:MM:SSZ."""
    digit_at = [0, 1, 2, 3, 5, 6, 8, 9, 11, 12, 14, 15, 17, 18]
    ok = _DIGITS[m[:, digit_at]].all(axis=1)
    for at, char in ((4, "-"), (7, "-"), (10, "T"), (13, ":"), (16, ":"), (19, "Z")):
        ok &= m[:, at] == ord(char)
    v = m.astype(np.int64) - 48
    two = lambda i: v[:, i] * 10 + v[:, i + 1]
    year, month, day = two(0) * 100 + two(2), two(5), two(8)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    month_ok = (month >= 1) & (month <= 12)
    days = _MONTH_DAYS[np.where(month_ok, month, 0)] + (leap & (month == 2))
    return ok & (year >= 1) & month_ok & (day >= 1) & (day <= days) & (two(11) < 24) & (two(14) < 60) & (two(17) < 60)


def parse_lines(lines: pa.Array) -> dict[str, object]:
    """Codes and fields of a batch of lines; ``code`` indexes FIELDS, -1 is a blank or NULL line."""
    lines = lines.cast(pa.large_string())
    n = len(lines)
    absent = np.asarray(lines.is_null())
    lines = lines.fill_null("")
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + n + 1]
    whole = np.frombuffer(lines.buffers()[2] or b"", np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
    # Room behind the end keeps matrix gathers of short rows inside the buffer.
    buf = np.concatenate([whole[lo:hi], np.zeros(ID_LENGTH + 10, np.uint8)])
    start, end = offsets[:-1] - lo, offsets[1:] - lo
    body = buf[: hi - lo]

    white = (body == 32) | (body == 9)
    seen_text = _within(~white)
    blank = absent | (seen_text[end] == seen_text[start])
    control = _within((body < 32) & (body != 9))
    has_control = control[end] > control[start]

    text_at = np.append(np.flatnonzero(body != 32), hi - lo)
    indent_end = np.minimum(text_at[np.searchsorted(text_at, start)], end)
    indent = indent_end - start

    quotes = body == 34
    n_quotes_to = _within(quotes)
    n_quotes = n_quotes_to[end] - n_quotes_to[start]
    row = np.repeat(np.arange(n), end - start)
    inside = ((n_quotes_to[:-1] - n_quotes_to[start][row]) & 1).astype(bool)
    quote_at = np.append(np.flatnonzero(quotes), [0, 0])
    first_quote = quote_at[np.minimum(n_quotes_to[start], len(quote_at) - 2)]
    second_quote = quote_at[np.minimum(n_quotes_to[start] + 1, len(quote_at) - 1)]
    two = n_quotes == 2
    first_quote, second_quote = np.where(two, first_quote, 0), np.where(two, second_quote, 0)
    framed = two & ((first_quote == indent_end) | (buf[first_quote - 1] == 32)) & ((second_quote + 1 == end) | (buf[second_quote + 1] == 32))
    quoting_ok = (n_quotes == 0) | framed

    delimiter = (body == 32) & ~inside & (np.arange(hi - lo) >= indent_end[row])
    delimiters_to = _within(delimiter)
    n_fields = delimiters_to[end] - delimiters_to[start] + 1
    delimiter_at = np.append(np.flatnonzero(delimiter), np.zeros(8, np.int64))
    base = np.minimum(delimiters_to[start], max(len(delimiter_at) - 8, 0))
    cut = delimiter_at[base[:, None] + np.arange(6)]
    five, seven = n_fields == 5, n_fields == 7
    counted = five | seven
    cut = np.where(np.arange(6) < (n_fields - 1)[:, None], cut, end[:, None])
    f_start = np.concatenate([indent_end[:, None], cut + 1], axis=1)
    f_end = np.concatenate([cut, end[:, None]], axis=1)
    f_len = f_end - f_start
    safe = np.where(counted[:, None], f_start, 0)
    last = np.where(seven, 6, 4)
    pick = lambda a, k: np.take_along_axis(a, k[:, None], axis=1)[:, 0]

    arrow = (f_len[:, 4] == 2) & (buf[safe[:, 4]] == ord("-")) & (buf[safe[:, 4] + 1] == ord(">"))
    fields_ok = five | (seven & arrow)
    # Quotes around another field than the name are misplaced.
    quoting_ok &= ~(two & fields_ok) | ((first_quote == f_start[:, 3]) & (second_quote + 1 == f_end[:, 3]))

    dash = lambda k: (f_len[:, k] == 1) & (buf[safe[:, k]] == ord("-"))
    mode = _gather(buf, safe[:, 0], 10)
    mode_dash = dash(0)
    mode_ok = mode_dash | ((f_len[:, 0] == 10) & _TYPES[mode[:, 0]] & _BITS[mode[:, 1:]].all(axis=1))

    ts_none = (f_len[:, 1] == 1) & ((buf[safe[:, 1]] == ord("-")) | (buf[safe[:, 1]] == ord("0")))
    ts_ok = ts_none | ((f_len[:, 1] == 20) & _moment_ok(_gather(buf, safe[:, 1], 20)))

    digits_to, commas_to = _within(_DIGITS[body]), _within(body == 44)
    size_from, size_to = np.where(counted, f_start[:, 2], 0), np.where(counted, f_end[:, 2], 0)
    n_digits = digits_to[size_to] - digits_to[size_from]
    size_dash = dash(2)
    numeric = (n_digits > 0) & (n_digits + commas_to[size_to] - commas_to[size_from] == f_len[:, 2])
    size = np.zeros(n, np.int64)
    plain = np.flatnonzero(numeric & counted & (n_digits <= 18))
    if len(plain):
        width = int((size_to - size_from)[plain].max())
        value = np.zeros(len(plain), np.int64)
        for k in range(width):
            at = size_from[plain] + k
            byte = buf[np.minimum(at, len(buf) - 1)]
            is_digit = (at < size_to[plain]) & _DIGITS[byte]
            value = np.where(is_digit, value * 10 + (byte.astype(np.int64) - 48), value)
        size[plain] = value
    size_ok = size_dash | numeric
    for i in np.flatnonzero(numeric & counted & (n_digits > 18)):  # near or beyond the 64-bit bound
        value = int(bytes(buf[size_from[i] : size_to[i]]).replace(b",", b""))
        size_ok[i] = value < 2**63
        size[i] = value if size_ok[i] else 0

    name_from = np.where(counted, f_start[:, 3] + two, 0)
    name_to = np.where(counted, f_end[:, 3] - two, 0)
    is_dir = ~mode_dash & (buf[safe[:, 0]] == ord("d"))
    core_to = name_to - (is_dir & (name_to > name_from) & (buf[np.maximum(name_to - 1, 0)] == ord("/")))
    core = core_to - name_from
    slashes_to = _within((body == ord("/")) | (body == ord("\\")))
    dot = buf[name_from] == ord(".")
    name_ok = (core > 0) & (slashes_to[np.maximum(core_to, name_from)] == slashes_to[name_from])
    name_ok &= ~(dot & ((core == 1) | ((core == 2) & (buf[name_from + 1] == ord(".")))))

    id_from, id_len = pick(safe, last), pick(f_len, last)
    ids = _gather(buf, id_from, ID_LENGTH)
    id_dash = (id_len == 1) & (ids[:, 0] == ord("-"))
    id_ok = id_dash | ((id_len == ID_LENGTH) & (ids[:, 0] == ord("c")) & (ids[:, 1] == ord("4")) & _IDS[ids[:, 2:]].all(axis=1))

    code = np.select(
        [blank, has_control, indent % 2 == 1, ~quoting_ok, ~fields_ok, ~mode_ok, ~ts_ok, ~size_ok, ~name_ok, ~id_ok],
        [-1, 1, 2, 3, 4, 5, 6, 7, 8, 9],
        0,
    )
    good = code == 0
    return {
        "code": code,
        "depth": np.where(good, indent // 2, 0),
        "mode": _slices(buf, safe[:, 0], f_len[:, 0], ~good | mode_dash),
        "file_type": _slices(buf, safe[:, 0], np.ones(n, np.int64), ~good | mode_dash),
        "ts_text": _slices(buf, safe[:, 1], f_len[:, 1], ~good | ts_none),
        "size": pa.array(size, pa.int64(), mask=~good | size_dash),
        "name": _slices(buf, name_from, name_to - name_from, ~good),
        "target": _slices(buf, safe[:, 5], f_len[:, 5], ~good | ~seven),
        "id_text": _slices(buf, id_from, id_len, ~good | id_dash),
        "good": good,
    }


def _bounded(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their lines have about ``limit`` bytes at most, or are one line."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column("line")).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reasons, messages = pa.array(FIELDS), pa.array(MESSAGES)
    for batch in _bounded(batches, BATCH_BYTES):
        lines = batch.column("line")
        got = parse_lines(lines)
        code, good = got["code"], got["good"]
        why = pa.array(np.maximum(code, 0), mask=code <= 0)
        out = pa.RecordBatch.from_arrays(
            [
                batch.column("manifest_id"),
                batch.column("line_no"),
                reasons.take(why),
                messages.take(why),
                pa.compute.if_else(pa.array(good), pa.scalar(None, pa.string()), lines.cast(pa.string())),
                pa.array(got["depth"].astype(np.int32), mask=~good),
                got["file_type"],
                got["mode"],
                got["ts_text"],
                got["size"],
                got["name"],
                got["target"],
                got["id_text"],
            ],
            names=PARSED_SCHEMA.names,
        )
        yield out.filter(pa.array(code >= 0))


def parse_manifest_lines(lines: DataFrame) -> DataFrame:
    """Each non-blank line parsed; ``field`` and ``message`` are NULL for a valid line.

    ``lines`` has ``manifest_id``, ``line_no`` and ``line``; other columns are
    ignored, whatever their names. NULL and blank lines give no row, an empty
    table gives an empty result, and a repeated row gives a repeated result
    (``load_manifest_lines`` removes those). A bad line keeps its text in
    ``raw``. It is one map over the input: no shuffle, and lines of a
    manifest may lie in any partition.
    """
    return lines.select("manifest_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("line").cast("string").alias("line")).mapInArrow(
        _parse_batches, PARSED_SCHEMA
    )


def permission_bits(mode: F.Column) -> F.Column:
    """The twelve permission bits of a ten-character mode; NULL for NULL."""
    bits = F.lit(0)
    for group, shift in ((1, 6), (4, 3), (7, 0)):
        special = {1: 0o4000, 4: 0o2000, 7: 0o1000}[group]
        r, w, x = (F.substring(mode, group + 1 + k, 1) for k in range(3))
        bits = bits + F.when(r == "r", 4 << shift).otherwise(0) + F.when(w == "w", 2 << shift).otherwise(0)
        bits = bits + F.when(x.isin("x", "s", "t"), 1 << shift).otherwise(0) + F.when(x.isin("s", "S", "t", "T"), special).otherwise(0)
    return F.when(mode.isNotNull(), bits).cast("int")


def load_manifest_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid lines as entries, and rejects ``(manifest_id, line_no, field, message, raw)``.

    Each ``(manifest_id, line_no)`` gives one entry or one reject, however often
    it is repeated: of different texts under one number the smallest that isn't
    blank counts, which is settled before valid and bad lines part. Epoch
    moments, ``0`` and ``-`` are NULL. A target is a ``link_target`` of a
    symlink, a flow target where it starts with a label and a colon, else a link
    target.
    """
    key = ["manifest_id", "line_no"]
    text = lines.select("manifest_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("line").cast("string").alias("line"))
    once = text.where(F.col("line").rlike("[^ \t]")).groupBy(*key).agg(F.min("line").alias("line"))
    parsed = parse_manifest_lines(once)
    bad = parsed.where("field IS NOT NULL").select(*key, "field", "message", "raw")
    flow = (F.coalesce(F.col("file_type"), F.lit("")) != "l") & F.col("target").rlike("^[a-zA-Z][a-zA-Z0-9_-]*:")
    ts = F.to_timestamp_ntz("ts_text", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    fields = parsed.where("field IS NULL").select(
        *key,
        "depth",
        "name",
        (F.col("name").endswith("/") | F.coalesce(F.col("file_type") == "d", F.lit(False))).alias("is_dir"),
        F.when(F.col("file_type").isNotNull(), F.col("file_type")).alias("file_type"),
        permission_bits(F.col("mode")).alias("perm"),
        F.when(ts != F.lit("1970-01-01").cast("timestamp_ntz"), ts).alias("ts"),
        "size",
        F.when(~flow, F.col("target")).alias("link_target"),
        F.when(flow, F.lit("->")).alias("flow_op"),
        F.when(flow, F.col("target")).alias("flow_target"),
        "id_text",
    )
    return fields, bad


#: Bytes of a file that one task reads as a range; a record belongs to the range in which it begins.
RANGE_BYTES = 64 << 20


def records(buf: bytes, last: bool) -> tuple[pa.Array, int]:
    """The whole records at the beginning of ``buf`` as a binary column, and how many bytes they take with their ends.

    Ends are the bytes of a newline mask. A quote doesn't protect one (a line
    never goes on in the next, so broken quoting spoils one record only), and
    the parity of quotes starts afresh behind it. ``last`` takes what follows
    the final newline as a record too.
    """
    data = np.frombuffer(buf, np.uint8)
    ends = np.flatnonzero(data == 10)
    if last and (not len(ends) or ends[-1] + 1 < len(data)) and len(data):
        ends = np.append(ends, len(data))
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else np.empty(0, np.int64)
    # Without the newlines the records are one buffer again, cut where they were.
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    taken = int(min(ends[-1] + 1, len(data))) if len(ends) else 0
    joined = pa.py_buffer(np.ascontiguousarray(data[:taken][data[:taken] != 10]))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), joined]).cast(pa.binary()), taken


def _read_range(path: str, start: int, end: int, step: int) -> Iterator[pa.Array]:
    """The records of a file that begin in ``[start, end)``, read ``step`` bytes at a time."""
    files, at = pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    with files.open_input_file(at) as f:
        size, pos, held = f.size(), max(start - 1, 0), b""
        begin = pos  # of what is held
        skipping = start > 0  # up to the end of the record that began before
        while begin < end and begin < size:
            chunk = f.read_at(min(step, size - pos), pos)
            pos += len(chunk)
            held += chunk
            if skipping:
                cut = held.find(b"\n") + 1
                if not cut and pos < size:
                    begin, held = pos, b""
                    continue
                begin, held, skipping = begin + (cut or len(held)), held[cut:] if cut else b"", False
            found, taken = records(held, pos >= size)
            if taken:
                lengths = np.concatenate([[0], np.cumsum(pc.binary_length(found).to_numpy(zero_copy_only=False) + 1)])[:-1]
                yield found.slice(0, int(np.searchsorted(lengths, end - begin, side="left")))
                begin, held = begin + taken, held[taken:]
            if pos >= size:
                break


def _read_ranges(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                n = 0
                for found in _read_range(path, start, end, step):
                    at = pa.array(np.arange(n, n + len(found)))
                    n += len(found)
                    yield pa.RecordBatch.from_arrays([pa.repeat(path, len(found)), pa.repeat(pa.scalar(start, pa.int64()), len(found)), at, found], names=["manifest_id", "start", "at", "line"])

    return run


def read_records(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES, step: int = BATCH_BYTES) -> DataFrame:
    """``manifest_id`` (the file), ``line_no`` from 1 and ``line`` of manifest files, for ``load_manifest_lines``.

    Files are cut into ranges that tasks read on their own, each locating record
    ends in its bytes; a line's number follows from the counts of the ranges
    before. A file of any size takes ``step`` bytes and its longest line of memory a task.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length").where("length > 0")
    begins = files.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = begins.select("path", "start", (F.col("start") + range_bytes).alias("end")).repartition(tasks, "path", "start")
    read = settle(ranges.mapInArrow(_read_ranges(step), "manifest_id string, start bigint, at bigint, line binary"))
    counts = read.groupBy(F.col("manifest_id").alias("_f"), F.col("start").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    firsts = broadcast_up_to(counts.select("_f", "_s", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).alias("_first")))
    numbered = read.join(firsts, (F.col("manifest_id") == F.col("_f")) & (F.col("start") == F.col("_s")))
    return numbered.select("manifest_id", (F.col("at") + F.col("_first")).alias("line_no"), F.col("line").cast("string").alias("line"))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The rejects alone."""
    return load_manifest_lines(lines)[1]
