"""What a comparison or merge is given: manifest files, directories, or one of each."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boughline.schema import ENTRY, TREE
from boughline.sources.directory import scan
from boughline.sources.text import read_entries, read_lines


def operand(spark: SparkSession, path: str, mode: str = "full", reference: DataFrame | None = None) -> DataFrame:
    """Entries of a directory or of a manifest file, under one manifest id (``m``); ``reference`` as for ``scan``."""
    if os.path.isdir(path):
        entries = scan(spark, path, mode, reference=reference)
    else:
        # Later sections are patches of the first; what a plain operand shows is the first.
        entries = read_entries(read_lines(spark, path)).where("section_no = 0 OR base_id IS NULL")
    return entries.withColumn(TREE, F.lit("m")).select(*ENTRY.names)


def operands(spark: SparkSession, old: str, new: str, mode: str = "full") -> tuple[DataFrame, DataFrame]:
    """Both sides of a comparison: where one is a directory and the other a manifest, files that the manifest knows with their size and moment aren't read again."""
    if os.path.isdir(old) == os.path.isdir(new):
        return operand(spark, old, mode), operand(spark, new, mode)
    if os.path.isdir(old):
        known = operand(spark, new, mode)
        return operand(spark, old, mode, known), known
    known = operand(spark, old, mode)
    return known, operand(spark, new, mode, known)
