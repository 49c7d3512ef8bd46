"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boughline.llm.tokens import VOCABULARY, token_counts
from boughline.operators.common import running_sum, settle

#: How far a source's weight may lean to the start or the end of training, as a part of it.
TILT = 0.4


@dataclass(frozen=True)
class Target:
    """A source's target share, most uses of a document, and weight over time as ``(time, weight)`` knots from 0 to 1."""

    source: str
    weight: float
    max_repeats: int
    schedule: tuple[tuple[float, float], ...]


def curriculum(weights: dict[str, tuple[float, int]], tilt: float = TILT) -> list[Target]:
    """Targets whose weights move linearly over time: often-repeated sources lean to the end, others to the start.

    At any time all weights add up to their sum, and each integrates to its target.
    """
    total = sum(w for w, _ in weights.values()) or 1.0
    most = max((r for _, r in weights.values()), default=1)
    lean = {s: tilt * (2 * (r - 1) / max(most - 1, 1) - 1) for s, (_, r) in weights.items()}
    middle = sum(weights[s][0] * lean[s] for s in weights) / total
    lean = {s: x - middle for s, x in lean.items()}
    widest = max([1.0, *(abs(x) for x in lean.values())])
    return [Target(s, w, r, ((0.0, w * (1 - lean[s] / widest)), (1.0, w * (1 + lean[s] / widest)))) for s, (w, r) in sorted(weights.items())]


def _integral(schedule: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float]]:
    """Pieces ``(time, weight, slope, integral before)`` of a piecewise linear schedule."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), area))
        area += (w0 + w1) / 2 * (t1 - t0)
    return [*pieces, (schedule[-1][0], schedule[-1][1], 0.0, area)]


def mix(sized: DataFrame, targets: list[Target], total: float | None = None) -> DataFrame:
    """Uses of documents in training order: ``doc_id, source, repeat_no, size, position``.

    ``sized`` has ``doc_id`` (unique), ``source`` and ``size``. Each source's
    weight schedule is integrated to its cumulative token demand; the documents
    of a source, in the order of a hash and pass after pass, meet that demand,
    and inverting it at a document's place gives its ``position`` in [0, 1],
    by which the uses are range-sorted. A document is used at most
    ``max_repeats`` times, one pass after another.

    ``total`` is the size to reach; by default the largest at which every
    source that has documents meets its share. Sources without documents can't
    contribute: the weights of the others are scaled up to make the whole.
    Documents of sources without a target (NULL is none) and of no size aren't
    used. A source's last pass takes documents while they fit its demand whole,
    and then the one of those left whose size comes nearest to what is missing,
    if that is nearer than leaving it out. Running sizes are cut into ranges, so
    that no source meets one task.
    """
    spark = sized.sparkSession
    wanted = {t.source: t for t in targets if t.weight > 0 and t.max_repeats > 0}
    usable = sized.where(F.col("source").isin(list(wanted)) & (F.col("size") > 0)).select("doc_id", "source", "size")
    have = {r["source"]: r["s"] for r in usable.groupBy("source").agg(F.sum("size").alias("s")).collect()}  # one row per target
    scale = sum(wanted[s].weight for s in have) or 1.0
    reach = min((have[s] * wanted[s].max_repeats * scale / wanted[s].weight for s in have), default=0.0)
    total = reach if total is None else min(total, reach)
    demands, pieces = [], []
    for s in sorted(have):
        demand = total * wanted[s].weight / scale
        knots = _integral(wanted[s].schedule)
        area = knots[-1][3]
        full = min(math.floor(demand / have[s] + 1e-9), wanted[s].max_repeats)
        demands.append((s, float(demand), int(have[s]), full, float(max(demand - full * have[s], 0.0)) if full < wanted[s].max_repeats else 0.0))
        for (t0, w0, slope, before), after in zip(knots, [k[3] for k in knots[1:]] + [math.inf], strict=True):
            if after > before:
                f = demand / area
                pieces.append((s, before * f, after * f, t0, w0 * f, slope * f))
    bounds = F.broadcast(spark.createDataFrame(demands, "source string, demand double, have bigint, full int, rest double"))  # one row per target
    placed = settle(running_sum(usable, ["source"], F.xxhash64("doc_id"), F.col("size"), "before")).join(bounds, "source")
    end = F.col("before") + F.col("size")
    cuts = placed.groupBy("source").agg(F.coalesce(F.max(F.when(end <= F.col("rest"), end)), F.lit(0)).alias("cut"), F.first("rest").alias("_rest"))
    cuts = F.broadcast(settle(cuts.select("source", "cut", (F.col("_rest") - F.col("cut")).alias("gap"))))
    left = placed.join(cuts, "source").where((end > F.col("rest")) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    tails = left.groupBy("source").agg(F.min_by("doc_id", F.struct(F.abs(F.col("size") - F.col("gap")), F.xxhash64("doc_id"), "doc_id")).alias("_tail"))
    each = placed.join(cuts, "source").join(F.broadcast(settle(tails)), "source", "left")
    is_tail = F.coalesce(F.col("doc_id") == F.col("_tail"), F.lit(False))
    last = (end <= F.col("rest")) | is_tail
    uses = each.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("full") + 1))).where((F.col("repeat_no") <= F.col("full")) | last)
    start = F.when(is_tail & (F.col("repeat_no") > F.col("full")), F.col("cut")).otherwise(F.col("before"))
    middle = (F.col("repeat_no") - 1) * F.col("have") + start + F.col("size") / 2
    uses = uses.select("doc_id", "source", "size", "repeat_no", F.least(middle, F.col("demand")).alias("at"))
    curve = F.broadcast(spark.createDataFrame(pieces, "source string, low double, high double, t0 double, w0 double, slope double")).alias("c")
    u = uses.alias("u")
    found = u.join(curve, (F.col("u.source") == F.col("c.source")) & (F.col("u.at") >= F.col("c.low")) & (F.col("u.at") < F.col("c.high")))
    rest = F.col("at") - F.col("low")
    # The area w0 * t + slope * t * t / 2 solved for t, in the form that holds for a slope of 0 too.
    root = F.sqrt(F.greatest(F.col("w0") * F.col("w0") + 2 * F.col("slope") * rest, F.lit(0.0)))
    position = F.least(F.col("t0") + F.when(rest > 0, 2 * rest / (F.col("w0") + root)).otherwise(0.0), F.lit(1.0))
    return found.select("doc_id", F.col("u.source").alias("source"), "repeat_no", "size", position.alias("position")).orderBy("position", "doc_id", "repeat_no")


def shares(uses: DataFrame, sized: DataFrame, targets: list[Target]) -> DataFrame:
    """Actual shares of every target: ``source, target_weight, actual_share, tokens, n_docs, n_uses, most_uses, available_tokens, sets_total``.

    ``sets_total`` marks the source that is the scarcest for its weight: by
    default the whole is as large as its documents, used as often as they may,
    make it, and the other sources' remaining tokens stay unused.
    """
    spark = uses.sparkSession
    per_doc = uses.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t"))
    used = per_doc.groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_uses"), F.max("n").alias("most_uses"))
    got = {r["source"]: r for r in used.collect()}  # one row per target at most
    wanted = sized.where(F.col("source").isin([t.source for t in targets])).groupBy("source").agg(F.sum("size").alias("s"))
    have = {r["source"]: r["s"] for r in wanted.collect()}
    everything = sum(r["tokens"] for r in got.values()) or 1
    reach = {t.source: have[t.source] * t.max_repeats / t.weight for t in targets if have.get(t.source) and t.weight > 0 and t.max_repeats > 0}
    scarcest = min(reach, key=lambda s: (reach[s], s), default=None)
    rows = []
    for t in targets:
        r = got.get(t.source)
        counts = [int(r[c]) if r else 0 for c in ("tokens", "n_docs", "n_uses", "most_uses")]
        rows.append((t.source, float(t.weight), counts[0] / everything, *counts, int(have.get(t.source) or 0), t.source == scarcest))
    return spark.createDataFrame(rows, "source string, target_weight double, actual_share double, tokens bigint, n_docs bigint, n_uses bigint, most_uses bigint, available_tokens bigint, sets_total boolean")


def sized_documents(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """``doc_id, source, size`` in tokens, written once. Repeated rows of a ``doc_id`` count once (largest text, smallest source)."""
    sizes = token_counts(documents.where("doc_id IS NOT NULL"), ["doc_id", "source"], vocabulary, pattern)
    return settle(sizes.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("size")))
