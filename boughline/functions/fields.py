"""Fields of an entry and their text: modes, sizes, moments, names, links, whole lines."""

from __future__ import annotations

import functools

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from boughline.functions.ids import id_text
from boughline.sources.manifest_lines import permission_bits

EPOCH = "1970-01-01"
# Escapes of characters in names, and the sign that frames bytes written as braille.
NAME_ESCAPES = {"\0": "0", "\t": "t", "\n": "n", "\r": "r", "\\": "\\"}
BYTE_FRAME = "¤"
BRAILLE = 0x2800


def mode_text(file_type: Column, perm: Column) -> Column:
    """Ten characters of type and permissions; NULL where both are NULL or no bits are set."""
    bits = F.coalesce(perm, F.lit(0))

    def rwx(shift: int, special: int, low: str, high: str) -> Column:
        x, s = bits.bitwiseAND(1 << shift) != 0, bits.bitwiseAND(special) != 0
        return F.concat(
            F.when(bits.bitwiseAND(4 << shift) != 0, "r").otherwise("-"),
            F.when(bits.bitwiseAND(2 << shift) != 0, "w").otherwise("-"),
            F.when(s & x, low).when(s, high).when(x, "x").otherwise("-"),
        )

    text = F.concat(F.coalesce(file_type, F.lit("-")), rwx(6, 0o4000, "s", "S"), rwx(3, 0o2000, "s", "S"), rwx(0, 0o1000, "t", "T"))
    unknown = (bits == 0) & F.coalesce(file_type == "-", F.lit(True))
    return F.when(~unknown, text)


def parse_mode(text: Column) -> tuple[Column, Column]:
    """``(file_type, perm)`` of a mode's text; NULLs for ``-``, ten dashes and what is no mode."""
    valid = text.rlike("^[-dlbcps][-rwxstST]{9}$") & (text != "-" * 10)
    return F.when(valid, F.substring(text, 1, 1)), F.when(valid, permission_bits(text))


def moment_text(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ``; NULL for NULL and the epoch."""
    return F.when(ts != F.lit(EPOCH).cast("timestamp_ntz"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def parse_moment(text: Column) -> Column:
    """A moment in UTC from the canonical form, RFC 3339 with an offset, Unix ``date`` or ``Mon D hh:mm:ss yyyy``; else NULL."""
    canonical = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$")
    offset = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+[+-][0-9]{2}:[0-9]{2}$")
    named = text.rlike("^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) +)?[A-Z][a-z]{2} +[0-9]")
    # Of the named forms only the month, the day, the time and the year stay, one blank apart.
    plain = F.regexp_replace(text, "^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) +| (?:UTC|GMT)(?= |$)| +(?= )", "")
    form = F.when(offset, "yyyy-MM-dd'T'HH:mm:ssXXX").when(text.rlike(" [0-9]{4} [0-9:]+$"), "MMM d yyyy HH:mm:ss").otherwise("MMM d HH:mm:ss yyyy")
    usual = F.substring(text, 1, 19).try_cast("timestamp_ntz")  # without a formatter
    return F.when(canonical, usual).when(offset | named, F.try_to_timestamp(plain, form).cast("timestamp_ntz"))


def size_text(size: Column) -> Column:
    """Digits with thousands commas; NULL for NULL."""
    return F.format_number(size, 0)


def size_units(size: Column) -> Column:
    """``n B`` or one decimal of K, M, G, T by powers of 1024."""
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((1, "K"), (2, "M"), (3, "G"), (4, "T")):
        # Tenths rounded half up in whole numbers, so that all engines agree.
        tenths = F.floor((size * 10 + F.lit(1024**power // 2)) / F.lit(1024**power)).cast("bigint")
        text = F.when(size >= 1024**power, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(text)
    return text


#: What can't stand in a text as it is: one character with an escape, or a run of others that aren't shown.
_HIDDEN = regex.compile(r"(?P<escaped>[\0\t\n\r\\])|(?P<framed>(?:[^\0\t\n\r\\\p{L}\p{M}\p{N}\p{P}\p{S} ]|¤)+)")


def _written(found) -> str:
    if found["escaped"]:
        return "\\" + NAME_ESCAPES[found["escaped"]]
    return BYTE_FRAME + "".join(chr(BRAILLE + b) for b in found["framed"].encode("utf-8", "surrogateescape")) + BYTE_FRAME


def encode_name(raw: bytes | str | None) -> str | None:
    """A name in printable characters: escapes for the common control characters, framed braille for other bytes."""
    if raw is None:
        return None
    return _HIDDEN.sub(_written, raw.decode("utf-8", "surrogateescape") if isinstance(raw, bytes) else raw)


def decode_name(text: str | None) -> bytes | None:
    """The bytes of an encoded name; unknown escapes and unclosed frames stay as they are."""
    if text is None:
        return None
    back = {v: k for k, v in NAME_ESCAPES.items()}
    out, i = bytearray(), 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in back:
            out += back[text[i + 1]].encode()
            i += 2
            continue
        if c == BYTE_FRAME:
            end = i + 1
            while end < len(text) and BRAILLE <= ord(text[end]) < BRAILLE + 256:
                end += 1
            if end > i + 1 and end < len(text) and text[end] == BYTE_FRAME:
                out += bytes(ord(x) - BRAILLE for x in text[i + 1 : end])
                i = end + 1
                continue
            # A frame without its end stays as it is.
        out += c.encode()
        i += 1
    return bytes(out)


def _each(function, values: pa.Array, kind: pa.DataType) -> pa.Array:
    coded = values.dictionary_encode()  # each distinct value once
    return pa.array([function(v) for v in coded.dictionary.to_pylist()], kind).take(coded.indices)


@functools.cache
def _name_udfs():
    @F.arrow_udf("string")
    def encode(names: pa.Array) -> pa.Array:
        return _each(encode_name, names, pa.string())

    @F.arrow_udf("binary")
    def decode(names: pa.Array) -> pa.Array:
        return _each(decode_name, names, pa.binary())

    return encode, decode


def safe_name(name: Column) -> Column:
    """``encode_name`` of a column; clean names never leave the JVM."""
    clean = name.rlike(r"^[\p{L}\p{M}\p{N}\p{P}\p{S} &&[^¤\\]]*$")
    return F.when(clean, name).otherwise(_name_udfs()[0](F.when(~clean, name)))


def unsafe_name(name: Column) -> Column:
    """``decode_name`` of a column, as binary."""
    clean = ~name.rlike(r"[¤\\]")
    return F.when(clean, name.cast("binary")).otherwise(_name_udfs()[1](F.when(~clean, name)))


def escape_name(name: Column, is_sequence: Column | None = None) -> Column:
    """Backslashes before blanks, quotes and, but for sequences, brackets."""
    plain = F.regexp_replace(name, r'([ "\[\]])', r"\\$1")
    if is_sequence is None:
        return plain
    return F.when(F.coalesce(is_sequence, F.lit(False)), F.regexp_replace(name, r'([ "])', r"\\$1")).otherwise(plain)


def escape_target(target: Column) -> Column:
    return F.regexp_replace(target, r'([ "])', r"\\$1")


def base_name(path: Column) -> Column:
    """The last component of a path; a directory keeps its slash."""
    return F.regexp_extract(path, "([^/]*/?)$", 1)


def valid_name(name: Column) -> Column:
    """False for NULL, empty, ``/``, ``.``, ``..`` and names with an inner slash, backslash or NUL."""
    # Most names have a slash at their end at most, no backslash and no dot in front; the others are looked at closely.
    slash = F.instr(name, "/")
    usual = (name != "") & (name != "/") & ~name.startswith(".") & ((slash == 0) | (slash == F.length(name))) & ~name.contains("\\") & ~name.contains("\x00")
    core = F.regexp_replace(F.coalesce(name, F.lit("")), "/$", "")
    return F.coalesce(usual, F.lit(False)) | (core != "") & ~core.isin(".", "..") & ~core.rlike(r"[/\\\x00]")


def is_flow_target(target: Column) -> Column:
    return target.rlike("^[a-zA-Z][a-zA-Z0-9_-]*:")


def is_directory(file_type: Column, name: Column) -> Column:
    return F.coalesce(file_type == "d", F.lit(False)) | name.endswith("/")


def null_fields(file_type: Column, perm: Column, ts: Column, size: Column) -> Column:
    """Names of the unknown fields among mode, timestamp and size, joined by commas."""
    return F.concat_ws(",", F.when(mode_text(file_type, perm).isNull(), "Mode"), F.when(moment_text(ts).isNull(), "Timestamp"), F.when(size.isNull() | (size < 0), "Size"))


def link_text(link_target: Column, hard_link: Column, flow_op: Column, flow_target: Column) -> Column:
    """The link part of a line with a leading blank, '' without a link: target, else hard link, else flow."""
    linked = F.when(F.coalesce(link_target, F.lit("")) != "", F.concat(F.lit(" -> "), escape_target(link_target)))
    linked = linked.when(F.coalesce(hard_link, F.lit(0)) < 0, " ->").when(F.coalesce(hard_link, F.lit(0)) > 0, F.concat(F.lit(" ->"), hard_link.cast("string")))
    return linked.when(flow_op.isNotNull(), F.concat(F.lit(" "), flow_op, F.lit(" "), F.coalesce(flow_target, F.lit("")))).otherwise("")


def canonical_line(identity: Column | None = None, name: Column | None = None) -> Column:
    """The line of an entry by which it is hashed, over the columns of the entry schema.

    ``identity`` is the text of the id (base-58 of ``content_id`` by default),
    ``name`` the encoded name (``safe_name`` by default); NULLs are ``-``.
    """
    dash = lambda c: F.coalesce(c, F.lit("-"))
    c = F.col
    identity = id_text(c("content_id")) if identity is None else identity
    shown = escape_name(safe_name(c("name")) if name is None else name, c("is_sequence"))
    size = F.when(c("size") >= 0, c("size").cast("string"))
    head = F.concat_ws(" ", dash(mode_text(c("file_type"), c("perm"))), dash(moment_text(c("ts"))), dash(size), shown)
    return F.concat(head, link_text(c("link_target"), c("hard_link"), c("flow_op"), c("flow_target")), F.lit(" "), dash(identity))
