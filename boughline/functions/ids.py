"""Content ids: digests in the plan, base-58 text at the edges only."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boughline.functions.order import ranked
from boughline.operators.common import discard, settle
from boughline.sources.manifest_lines import ID_ALPHABET

#: An id in text: the prefix and 88 digits.
ID_PATTERN = f"^c4[{ID_ALPHABET}]{{88}}$"
_DIGITS = 88
_VALUES = {c: i for i, c in enumerate(ID_ALPHABET)}


def content_id(content: Column, bits: int = 512) -> Column:
    """The digest of bytes or text as binary; NULL for NULL. 512 bits make an id, 256 a checkable stand-in."""
    return F.unhex(F.sha2(content, bits))


def encode_id(digest: bytes | None) -> str | None:
    """The text of a digest of 64 bytes."""
    if digest is None:
        return None
    value, out = int.from_bytes(digest, "big"), []
    while value:
        value, digit = divmod(value, len(ID_ALPHABET))
        out.append(ID_ALPHABET[digit])
    return "c4" + "".join(reversed(out)).rjust(_DIGITS, ID_ALPHABET[0])


def decode_id(text: str | None) -> bytes | None:
    """The digest of an id's text; NULL for what is no id."""
    if text is None or len(text) != _DIGITS + 2 or not text.startswith("c4"):
        return None
    value = 0
    for c in text[2:]:
        if c not in _VALUES:
            return None
        value = value * len(ID_ALPHABET) + _VALUES[c]
    return value.to_bytes(64, "big") if value < 1 << 512 else None


#: Ids that are converted at a time, five digits of base 58 a step.
_BLOCK = 1 << 13
_STEP, _STEPS, _LIMBS = 58**5, 18, 16
_LETTERS = np.frombuffer(ID_ALPHABET.encode(), np.uint8)
_PLACES = np.full(256, 255, np.uint8)
_PLACES[_LETTERS] = np.arange(58)


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    """The bytes of values of one width, a row each."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def _packed(rows: list[np.ndarray], width: int, kind: pa.DataType) -> pa.Array:
    data = np.concatenate(rows) if rows else np.empty((0, width), np.uint8)
    offsets = pa.py_buffer(np.arange(0, (len(data) + 1) * width, width, dtype=np.int32))
    return pa.Array.from_buffers(kind, len(data), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))])


def encode_digests(digests: pa.Array) -> pa.Array:
    """Texts of digests of 64 bytes: long division by powers of 58 over a whole block of ids at a time."""
    every, rows = _matrix(digests, 64), []
    for k in range(0, len(every), _BLOCK):
        limbs = every[k : k + _BLOCK].view(">u4").T.astype(np.uint64)
        out = np.empty((limbs.shape[1], _STEPS * 5), np.uint8)
        for step in range(_STEPS):
            rest = np.zeros(limbs.shape[1], np.uint64)
            for limb in limbs:
                rest = (rest << np.uint64(32)) | limb
                limb[:], rest = np.divmod(rest, np.uint64(_STEP))
            for digit in range(5):
                rest, place = np.divmod(rest, np.uint64(58))
                out[:, _STEPS * 5 - 1 - step * 5 - digit] = place
        text = _LETTERS[out[:, _STEPS * 5 - _DIGITS :]]
        rows.append(np.hstack([np.broadcast_to(np.frombuffer(b"c4", np.uint8), (len(text), 2)), text]))
    return _packed(rows, _DIGITS + 2, pa.string())


def decode_texts(texts: pa.Array) -> pa.Array:
    """Digests of texts of the length of an id, a block at a time; NULL for what is no id."""
    every, rows, valid = _matrix(texts, _DIGITS + 2), [], []
    for k in range(0, len(every), _BLOCK):
        block = every[k : k + _BLOCK]
        places = _PLACES[block[:, 2:]]
        good = (block[:, 0] == ord("c")) & (block[:, 1] == ord("4")) & (places < 58).all(axis=1)
        digits = np.zeros((len(block), _STEPS * 5), np.uint64)
        digits[:, _STEPS * 5 - _DIGITS :] = np.where(good[:, None], places, 0)
        limbs = np.zeros((_LIMBS, len(block)), np.uint64)
        for step in range(_STEPS):
            carry = digits[:, step * 5 : step * 5 + 5] @ np.array([58**4, 58**3, 58**2, 58, 1], np.uint64)
            for limb in limbs[::-1]:
                carry = limb * np.uint64(_STEP) + carry
                limb[:] = carry & np.uint64(0xFFFFFFFF)
                carry >>= np.uint64(32)
            good &= carry == 0
        rows.append(np.ascontiguousarray(limbs.T.astype(">u4")).view(np.uint8))
        valid.append(good)
    return pa.compute.if_else(pa.array(np.concatenate(valid) if valid else np.empty(0, bool)), _packed(rows, 64, pa.binary()), pa.scalar(None, pa.binary()))


def _each(whole, width: int, single, values: pa.Array, kind: pa.DataType) -> pa.Array:
    """Each distinct value converted once: those of the usual width together, others alone."""
    coded = values.dictionary_encode()
    known = coded.dictionary
    usual = np.asarray(pa.compute.equal(pa.compute.binary_length(known), width))
    if usual.all():
        done = whole(known)
    else:
        done = pa.array([single(v) for v in known.to_pylist()], kind)
    return done.take(coded.indices)


@functools.cache
def _codecs():
    @F.arrow_udf("string")
    def encode(digests: pa.Array) -> pa.Array:
        return _each(encode_digests, 64, encode_id, digests, pa.string())

    @F.arrow_udf("binary")
    def decode(texts: pa.Array) -> pa.Array:
        return _each(decode_texts, _DIGITS + 2, decode_id, texts, pa.binary())

    return encode, decode


def id_text(digest: Column) -> Column:
    """Base-58 text of binary ids, for the last projection of a plan."""
    return _codecs()[0](digest)


def parse_id(text: Column) -> Column:
    """Binary id of base-58 text; NULL where the text is no id."""
    return _codecs()[1](text)


def is_id(text: Column) -> Column:
    return text.rlike(ID_PATTERN)


def is_id_list(text: Column) -> Column:
    """Two ids or more written without anything between."""
    return text.rlike(f"^(c4[{ID_ALPHABET}]{{88}}){{2,}}$")


def split_id_list(text: Column) -> Column:
    """The ids of an id list (bare or one per line) as an array of text."""
    return F.regexp_extract_all(text, F.lit(f"(c4[{ID_ALPHABET}]{{88}})"), 1)


def pair_sum(a: Column, b: Column, bits: int = 512) -> Column:
    """The id of two ids whatever their order; of equal ones the id itself; NULL if one is NULL."""
    return F.when(a == b, a).when(a.isNotNull() & b.isNotNull(), content_id(F.concat(F.least(a, b), F.greatest(a, b)), bits))


def id_json(digest: Column) -> Column:
    """The id as a JSON string, '' for NULL."""
    return F.concat(F.lit('"'), F.coalesce(id_text(digest), F.lit("")), F.lit('"'))


def id_list_root(df: DataFrame, group: str, digest: str, bits: int = 512) -> DataFrame:
    """``group, root``: the id of each group's set of ids.

    Ids are sorted and made distinct, then summed in pairs, round after round,
    an odd last one moving up unchanged. Places are counted in ranges and rounds
    are joins by place, so that a group's ids never meet in one row or task; a
    group of n ids takes log2(n) rounds, of which several make one job. NULL ids
    are left out; a group without ids has no root.
    """
    ids = df.where(F.col(digest).isNotNull()).select(F.col(group).alias("g"), F.col(digest).alias("d")).distinct()
    level = settle(ranked(ids, "g", [F.col("d")], "n").select("g", "d", (F.col("n") - 1).alias("p")))
    while (level.agg(F.max("p")).head()[0] or 0) > 0:
        former, level = level, settle(_halved(_halved(_halved(level, bits), bits), bits))
        discard(former)
    return level.select(F.col("g").alias(group), F.col("d").alias("root"))


def _halved(level: DataFrame, bits: int) -> DataFrame:
    """Ids ``g, d, p`` summed in pairs of places."""
    at = lambda rest: F.max(F.when(F.col("p") % 2 == rest, F.col("d")))
    pairs = level.groupBy("g", F.shiftright("p", 1).alias("q")).agg(at(0).alias("a"), at(1).alias("b"))
    return pairs.select("g", F.coalesce(pair_sum(F.col("a"), F.col("b"), bits), "a").alias("d"), F.col("q").alias("p"))


def tree_nodes(leaves: int) -> int:
    """Nodes of the id tree over that many leaves."""
    total = leaves
    while leaves > 1:
        leaves = -(-leaves // 2)
        total += leaves
    return total


def tree_leaves(nodes: int) -> int:
    """Leaves of the id tree with that many nodes; raises if there is none."""
    low, high = 0, nodes
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if tree_nodes(middle) < nodes else (low, middle)
    if tree_nodes(low) != nodes:
        raise ValueError(f"no id tree has {nodes} nodes")
    return low


def root_of(ids: list[bytes]) -> bytes | None:
    """The id of a small list of ids, as ``id_list_root`` on the driver."""
    level = sorted(set(ids))
    while len(level) > 1:
        level = [hashlib.sha512(min(p) + max(p)).digest() if len(p) == 2 and p[0] != p[1] else p[0] for p in (level[i : i + 2] for i in range(0, len(level), 2))]
    return level[0] if level else None
