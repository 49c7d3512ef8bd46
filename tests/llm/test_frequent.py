"""Frequent values where the sketch's candidates don't settle the result."""

from boughline.llm.frequent import top_values


def rows(df):
    return [(r["value"], r["n_rows"]) for r in df.collect()]


def test_top_values_of_an_all_distinct_column(spark):
    df = spark.range(20_000).selectExpr("format_string('u%06d', id) AS v")
    got = top_values(df, "v", 3, width=1 << 12, heap=50).collect()
    assert [(r["value"], r["n_rows"]) for r in got] == [("u000000", 1), ("u000001", 1), ("u000002", 1)]
    assert all(r["approx_count"] >= 1 for r in got)


def test_top_values_where_the_last_ties_with_evicted_ones(spark):
    hot = [("hot",)] * 100 + [("warm",)] * 50
    tied = [(f"t{i:04d}",) for i in range(2000) for _ in range(3)]
    df = spark.createDataFrame([*hot, *tied, (None,)], "v string").repartition(4)
    assert rows(top_values(df, "v", 4, width=1 << 12, heap=20)) == [("hot", 100), ("warm", 50), ("t0000", 3), ("t0001", 3)]


def test_top_values_counts_candidates_that_may_still_enter(spark):
    df = spark.createDataFrame([(f"v{i:04d}",) for i in range(900) for _ in range(1 + (i < 60))], "v string").repartition(4)
    assert rows(top_values(df, "v", 2, width=1 << 12, heap=1000)) == [("v0000", 2), ("v0001", 2)]
