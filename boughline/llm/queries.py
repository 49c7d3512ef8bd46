"""Queries of the problems of large text collections over the test tables, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boughline.llm.frequent import WIDTH, heavy_candidates, top_values
from boughline.llm.language import Model, document_languages, fit_languages, mislabelled
from boughline.llm.mixing import Target, curriculum, mix, shares, sized_documents
from boughline.llm.packing import pack_documents
from boughline.llm.visual import consistent_names, look_alikes
from boughline.sources.tables import table

TOP = 20


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_values(table(spark, sf_dir, "entries"), "content_id", TOP).select(F.lower(F.hex("value")).alias("content_id_hex"))


def p3_approx_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = heavy_candidates(table(spark, sf_dir, "entries"), "content_id").orderBy(F.desc("approx_count"), "value").limit(TOP)
    return found.select(F.lower(F.hex("value")).alias("content_id_hex"), "approx_count")


def p3_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the estimates of the most frequent ids lie where the sketch promises: from the count up to a part of all rows above it."""
    entries = table(spark, sf_dir, "entries")
    slack = math.e * entries.where("content_id IS NOT NULL").count() / WIDTH
    top = top_values(entries, "content_id", TOP)
    return top.select(F.lower(F.hex("value")).alias("content_id_hex"), "n_rows", (F.col("approx_count") >= F.col("n_rows")).alias("not_below"), (F.col("approx_count") <= F.col("n_rows") + F.lit(slack)).alias("not_far_above"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alikes(table(spark, sf_dir, "entries"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = consistent_names(table(spark, sf_dir, "entries"))
    return formed.select("manifest_id", "seq", "name_form", "link_target_form").distinct()


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "pack_bins").groupBy("bin_kind").agg(F.max("capacity_tokens").alias("c")).collect()  # a fixed table
    return pack_documents(table(spark, sf_dir, "documents"), {r["bin_kind"]: r["c"] for r in kinds})


def p7_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assignments(spark, sf_dir).select("bin_kind", "container", "doc_id", "piece", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"))


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _assignments(spark, sf_dir).groupBy("bin_kind", "container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("bin_kind").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))


def _targets(spark: SparkSession, sf_dir: str) -> list[Target]:
    rows = table(spark, sf_dir, "mix_targets").where("source IS NOT NULL").groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("r")).collect()  # a fixed table
    return curriculum({r["source"]: (r["w"], r["r"]) for r in rows})


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sized_documents(table(spark, sf_dir, "documents"))
    return mix(sized, _targets(spark, sf_dir)).withColumnRenamed("size", "n_tokens")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, targets = sized_documents(table(spark, sf_dir, "documents")), _targets(spark, sf_dir)
    return shares(mix(sized, targets), sized, targets)


#: Models that queries of this process fitted, by session and data set, so that each is fitted once.
_MODELS: dict[tuple[str, str], Model] = {}


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    codes = sorted(r[0] for r in table(spark, sf_dir, "lang_codes").select("lang").distinct().collect())  # the languages of the world at most
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = fit_languages(documents, codes)
    return document_languages(documents, codes, model=_MODELS[key])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mislabelled(_languages(spark, sf_dir))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).select("doc_id", "given", "lang", F.round("confidence", 4).alias("confidence"), F.size("langs").alias("n_langs")).distinct()


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _languages(spark, sf_dir).where(F.size("langs") > 1)
    return mixed.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.segment_no", "s.lang", F.round("s.confidence", 4).alias("confidence"), "s.n_sentences", "s.n_words", "s.text").distinct()


QUERIES = {f.__name__: f for f in (p3_found, p3_approx_counts, p3_bounds, p4_found, p4_forms, p7_assignments, p7_usage, p8_mixture, p8_shares, p9_found, p9_documents, p9_segments)}

SQL = {
    "p3_found": f"""
        SELECT lower(hex(content_id)) AS content_id_hex FROM entries WHERE content_id IS NOT NULL
        GROUP BY content_id ORDER BY count(*) DESC, content_id LIMIT {TOP}""",
    "p3_bounds": f"""
        SELECT lower(hex(content_id)) AS content_id_hex, count(*) AS n_rows, true AS not_below, true AS not_far_above FROM entries WHERE content_id IS NOT NULL
        GROUP BY content_id ORDER BY count(*) DESC, content_id LIMIT {TOP}""",
}
