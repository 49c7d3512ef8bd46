"""Canonical manifest text, recognised while it is hashed."""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from boughline.functions.fields import decode_name, encode_name
from boughline.functions.ids import encode_id
from boughline.sources.manifest_lines import ID_ALPHABET

HASHED = "manifest_id string, digest binary"

#: A canonical line with its newline: indent, type, day, time, name, operator and target of a link, id. Whatever else a reader takes is another text.
_LINE = re.compile(
    r"( *)(?:-|(?!-{10} )([-dlbcps])[r-][w-][xsS-][r-][w-][xsS-][r-][w-][xtT-])"
    r" (?:-|([1-9][0-9]{3}-[0-9]{2}-[0-9]{2})T((?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])Z) (?:-|0|[1-9][0-9]{0,17})"
    r' ((?:[^ \\]|\\.)+)(?: ->(?:[1-9][0-9]{0,8})?| (->|<-|<>) ((?:[^ \\"¤\r]|\\[ "])+))?'
    rf" (?:-|(c4[{ID_ALPHABET}]{{88}}))\n"
)
#: What the first line with text of a manifest begins with (an id does too).
_ENTRY = re.compile(r"(?:-|[-dlbcps][-rwxstST]{9}) +(?:-|0|[0-9]{4}-[0-9]{2}-[0-9]{2}T)")
_LARGEST_ID = encode_id(b"\xff" * 64)
_SEQUENCE = re.compile(r"[^\\\[]*\[[0-9]+(-[0-9]+(:[0-9]+)?)?(,[0-9]+(-[0-9]+(:[0-9]+)?)?)*\]")
_SHOWN = regex.compile(r"[\p{L}\p{M}\p{N}\p{P}\p{S} ]*")
_UNASSIGNED = regex.compile(r"\p{Cn}")
#: Characters that stand for marks in a key are written as two.
_MARKS = {i: "\x05" + chr(i + ord("A")) for i in range(6)}
_FLOW = re.compile("[a-zA-Z][a-zA-Z0-9_-]*:")
_DIGITS = re.compile("[0-9]+")


def _counted(text: str) -> str:
    n = str(len(text))
    return f"{len(n)}{n}"


def _number(found: re.Match) -> str:
    digits = found[0].lstrip("0") or "0"
    return f"\x03{_counted(digits)}{digits}{_counted(found[0])}"


def _stored(written: str) -> str | None:
    """The name of an entry by its name in text; None where an entry of that name is written in another way, or none has it."""
    if _SEQUENCE.match(written):
        name = written
        if not name.isascii() and not _SHOWN.fullmatch(name):
            return None
        if re.search(r'[\\"¤]', name) or (name.isascii() and not name.isprintable()):
            return None
    elif written.isascii() and written.isprintable() and not re.search(r'[\\"\[\]]', written):
        name = written
    else:
        try:
            name = decode_name(re.sub(r'\\([ "\[\]])', r"\1", written)).decode()
        except UnicodeDecodeError:
            return None
        # What a character is depends on the version of Unicode where it isn't assigned.
        if re.sub(r'([ "\[\]])', r"\\\1", encode_name(name)) != written or _UNASSIGNED.search(name):
            return None
    core = name.removesuffix("/")
    return None if core in ("", ".", "..") or re.search(r"[/\\\0]", core) else name


@functools.lru_cache(1 << 17)
def sibling_key(written: str) -> str | None:
    """Where an entry stands among its siblings (as ``order.path_key`` has it), by its name in text; None for a name that isn't written like this."""
    name = _stored(written)
    if name is None:
        return None
    kind, first = "\x02" if name.endswith("/") else "\x01", "" if name[0] in "0123456789" else "\x02"
    return f"{kind}{first}{_DIGITS.sub(_number, name.translate(_MARKS))}\x01"


@functools.lru_cache(1 << 14)
def _is_day(text: str) -> bool:
    try:
        datetime.date.fromisoformat(text)
    except ValueError:
        return False
    return True


class _File:
    """A file of which lines are read in order: hashed as it stands, and judged whether its canonical text is another one."""

    def __init__(self, algorithm: str):
        self.hasher = hashlib.new(algorithm)
        self.kind, self.same, self.blank = None, True, False
        self.siblings: list[str] = []  # the last entry of each open level
        self.deepest = 0

    def take(self, lines: list[str | None], data: memoryview) -> None:
        if self.kind is None:
            for line in lines:
                text = (line or "").removesuffix("\n").strip(" ")
                if text:
                    # An id may open a manifest; whether this is one is left to the reader of text.
                    self.kind = "manifest" if _ENTRY.match(text) or text.startswith("c4") else "other"
                    break
                self.blank = True
        if self.kind == "manifest" and self.same:
            self.same = not self.blank and self.canonical(lines)
        if self.same:
            self.hasher.update(data)

    def canonical(self, lines: list[str | None]) -> bool:
        """Whether lines are written as their entries would be, in the order in which they would be."""
        siblings, deepest, match = self.siblings, self.deepest, _LINE.fullmatch
        for line in lines:
            found = match(line or "")
            if found is None:
                return False
            indent, kind, day, time, name, op, target, identity = found.groups()
            depth, odd = divmod(len(indent), 2)
            key = sibling_key(name)
            if odd or depth > deepest or key is None or (identity is not None and identity > _LARGEST_ID):
                return False
            if day is not None and (not _is_day(day) or (day == "1970-01-01" and time == "00:00:00")):
                return False
            if target is not None and "\\" in target and (op != "->" or (kind != "l" and _FLOW.match(re.sub(r"\\(.)", r"\1", target)))):
                return False
            if depth < len(siblings):
                if siblings[depth] >= key:
                    return False
                del siblings[depth + 1 :]
                siblings[depth] = key
            else:
                siblings.append(key)
            deepest = depth + 1 if name.endswith("/") else depth
        self.deepest = deepest
        return True

    def digest(self) -> bytes | None:
        return self.hasher.digest() if self.same else None


def hash_files(algorithm: str):
    """Hashes the lines (``manifest_id, line``, each with its newline) of neighbouring rows of one file, in their order.

    A file that is no manifest, and a manifest that is its own canonical text,
    gets the digest of its lines; another manifest gets NULL. Of a file only
    the last entry of each open level is kept.
    """

    def emitted(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.binary())], names=["manifest_id", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, file = None, None
        for batch in batches:
            n, done = batch.num_rows, []
            if not n:
                continue
            trees = batch.column("manifest_id")
            lines = batch.column("line").cast(pa.large_string())
            offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + n + 1]
            data = memoryview(lines.buffers()[2] or b"")
            begins = np.ones(n, bool)
            if n > 1:
                begins[1:] = np.asarray(pc.not_equal(trees[1:], trees[:-1]).fill_null(True))
            starts = np.flatnonzero(begins).tolist()
            texts = lines.to_pylist()
            for start, end, tree in zip(starts, [*starts[1:], n], trees.take(pa.array(starts)).to_pylist(), strict=True):
                if file is None or tree != key:
                    if file is not None:
                        done.append((key, file.digest()))
                    key, file = tree, _File(algorithm)
                file.take(texts[start:end], data[offsets[start] : offsets[end]])
            yield emitted(done)
        if file is not None:
            yield emitted([(key, file.digest())])

    return run
