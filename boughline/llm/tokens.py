"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file (ranks of byte pairs) where none is named.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Encoders that this process has made.
_ENCODERS: dict[int, object] = {}


def usual_pattern() -> str:
    """The pattern that cuts texts into words for the vocabularies of the module ``public_tokenizers``."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def _encoder(vocabulary: bytes, pattern: str):
    key = hash((vocabulary, pattern))
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(*shared.value)
            counts = np.fromiter((len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def token_counts(documents: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of each document's whole ``text``; 0 for NULL and ''.

    The vocabulary (under a megabyte) is read by the driver and broadcast, so
    executors need no file; so is ``pattern`` (``usual_pattern`` where none is
    given). Special tokens in a text are ordinary text.
    """
    shared = documents.sparkSession.sparkContext.broadcast((Path(vocabulary).read_bytes(), usual_pattern() if pattern is None else pattern))
    slim = documents.select(*keep, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(_counter(shared), f"{fields}, n_tokens bigint")
