import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from boughline.operators.balance import balanced_aggregate, balanced_join, place
from boughline.operators.changefeed import IDENTITY, apply_changes, chain_log, section_order
from boughline.operators.common import running_sum
from boughline.operators.snapshots import series_changes, snapshot_diff

# Keys with most rows


def skewed(spark, n=3000):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.02 else ("hot" if rng.random() < 0.4 else f"k{rng.randrange(200)}"), i, rng.choice([None, 1, 5])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, id int, size bigint").repartition(6)


def test_balanced_aggregate_equals_a_plain_one(spark):
    rows, df = skewed(spark)
    got = balanced_aggregate(df, ["key"], {"n": (F.count(F.lit(1)), "sum"), "s": (F.sum("size"), "sum"), "m": (F.max("size"), "max")}, 8)
    want = defaultdict(list)
    for k, _, s in rows:
        want[k].append(s)
    got = {r["key"]: (r["n"], r["s"], r["m"]) for r in got.collect()}
    assert got == {k: (len(v), sum(filter(None, v)) or None, max(filter(None, v), default=None)) for k, v in want.items()}


def test_balanced_aggregate_of_nothing(spark):
    df = spark.createDataFrame([], "key string")
    assert balanced_aggregate(df, ["key"], {"n": (F.count(F.lit(1)), "sum")}, 4).count() == 0


def test_heavy_keys_are_split_and_tasks_balanced(spark):
    _, df = skewed(spark)
    placed = place(df.groupBy("key").agg(F.count(F.lit(1)).alias("w")), ["key"], "w", 8)
    heavy = {r["key"]: r["_tasks"] for r in placed.heavy.collect()}
    assert len(heavy["hot"]) >= 4 and max(placed.loads) <= 2 * sum(placed.loads) / 8


@pytest.mark.parametrize("how", ["inner", "left"])
def test_balanced_join_keeps_rows(spark, how):
    rows, df = skewed(spark)
    other = spark.createDataFrame([("hot", 1), ("k3", 2), ("k4", 3), ("none", 4), (None, 5)], "key string, v int")
    got = Counter((r["key"], r["id"], r["v"]) for r in balanced_join(df, other, ["key"], 8, F.col("id"), how).collect())
    values = {"hot": 1, "k3": 2, "k4": 3}
    want = Counter((k, i, values.get(k)) for k, i, _ in rows if how == "left" or k in values)
    assert got == want


def test_balanced_join_of_nothing_and_clashing_names(spark):
    _, df = skewed(spark, 50)
    other = spark.createDataFrame([("hot", 7, 1), ("hot", 8, 1)], "key string, id int, v int")
    joined = balanced_join(df, other, ["key"], 4, F.col("id"))
    assert set(joined.columns) == {"key", "id", "size", "id_matching", "v"} and {r["id_matching"] for r in joined.collect()} == {7, 8}
    assert joined.count() == 2 * df.where("key = 'hot'").count()
    assert balanced_join(df.limit(0), other, ["key"], 4, F.col("id")).count() == 0
    assert balanced_join(df, other.limit(0), ["key"], 4, F.col("id"), "left").count() == 50


def test_running_sum(spark):
    rows = [("a" if i % 3 else None, i, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id bigint, n int")
    got = running_sum(df, ["k"], F.xxhash64("id"), F.col("n"), "before", bits=4).withColumn("h", F.xxhash64("id")).collect()
    for k in ("a", None):
        total = 0
        own = sorted((r for r in got if r["k"] == k), key=lambda r: r["h"])
        for r in own:
            assert r["before"] == total
            total += r["n"]
    assert len(got) == len(rows)


# Changes between snapshots


def states(rng, n):
    out = [{}]
    for _ in range(n):
        s = dict(out[-1])
        for _ in range(rng.randrange(8)):
            p = f"p{rng.randrange(12)}"
            if rng.random() < 0.3:
                s.pop(p, None)
            else:
                s[p] = (rng.choice([None, 1, 2]), rng.choice([None, 1, 2]))
        out.append(s)
    return out[1:]


@pytest.mark.parametrize("n", [1, 3, 150])
def test_series_changes_equals_comparing_neighbours(spark, n):
    rng = random.Random(n)
    rows, snaps, want = [], [], set()
    for v in ("v1", "v2"):
        held = states(rng, n)
        for i, s in enumerate(held):
            m = f"{v}-{i:03d}"
            snaps.append((m, v, i, "x"))
            rows += [(m, p, a, b, rng.random()) for p, (a, b) in s.items() for _ in range(rng.choice([1, 1, 2]))]
            if i:
                old = held[i - 1]
                want |= {(m, p, "added") for p in s.keys() - old.keys()} | {(m, p, "removed") for p in old.keys() - s.keys()}
                want |= {(m, p, "changed") for p in s.keys() & old.keys() if s[p] != old[p]}
    snaps += snaps[:3] + [("lost", None, 1, "x"), ("never", "v1", None, "x")]
    rows += [("unknown", "p", 1, 1, 0.0), ("v1-000", None, 1, 1, 0.0)]
    df = spark.createDataFrame(rows, "m string, path string, a int, b int, series double")
    sn = spark.createDataFrame(snaps, "m string, v string, at int, path string")
    got = series_changes(df, sn, "v", "m", "at", "path", ["a", "b"]).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_series_changes_of_nothing(spark):
    df = spark.createDataFrame([], "m string, path string, a int")
    sn = spark.createDataFrame([], "m string, v string, at int")
    assert series_changes(df, sn, "v", "m", "at", "path", ["a"]).count() == 0


def test_snapshot_diff_with_nulls_and_copies(spark):
    old = spark.createDataFrame([("a", 1), ("b", None), ("b", None), (None, 3), ("d", 4)], "k string, x int")
    new = spark.createDataFrame([("a", 2), ("b", None), (None, 3), ("e", 5), ("e", 5)], "k string, x int")
    got = {tuple(r) for r in snapshot_diff(old, new, ["k"], ["x"]).collect()}
    assert got == {("a", "changed"), ("d", "removed"), ("e", "added")}
    assert snapshot_diff(old.limit(0), old.limit(0), ["k"], ["x"]).count() == 0


# Change feeds

ENTRY = "section_id bigint, seq bigint, path string, is_dir boolean, name string, file_type string, perm int, ts timestamp_ntz, size bigint, link_target string, content_id binary, hard_link int, flow_op string, flow_target string, chain_id int"
SECTION = "section_id bigint, chain_id string, base_id binary, new_id binary, arrived_at timestamp_ntz, path string"


def entry(section, seq, path, size):
    return (section, seq, path, path.endswith("/"), path.split("/")[-1], "-", None, None, size, None, None if size is None else bytes([size]), None, None, None, 9)


def feed(rng, chains=4, length=9):
    sections, entries, log, number = [], [], {}, 1
    for c in range(chains):
        state, per = {}, []
        for i in range(length):
            base = None if i == 0 else f"{c}-{i - 1}".encode()
            changes = {}
            for _ in range(rng.randrange(1, 7)):
                d = rng.choice(["", "d/", "d/e/", "f/"])
                p = d + rng.choice(["", "x", "y"]) if d else rng.choice(["x", "y"])
                now = state.get(p)
                changes[p] = now[0] if now and rng.random() < 0.5 else rng.choice([None, 1, 2])
            rows = sorted(changes.items())
            for _ in range(rng.choice([1, 1, 2])):
                sections.append((number, f"c{c}", base, f"{c}-{i}".encode(), None, "clash"))
                own = [entry(number, k, p, s) for k, (p, s) in enumerate(rows)]
                rng.shuffle(own)
                entries += own + own[:1]
                number += 1
            gone, before = [], dict(state)
            for p, s in rows:
                if any(p.startswith(g) and p != g for g in gone):
                    continue
                if p in state and state[p] == (s,):
                    for q in [q for q in state if q == p or (p.endswith("/") and q.startswith(p))]:
                        del state[q]
                    if p.endswith("/"):
                        gone.append(p)
                else:
                    state[p] = (s,)
            added, removed = len(state.keys() - before.keys()), len(before.keys() - state.keys())
            changed = sum(before[p] != state[p] for p in state.keys() & before.keys())
            per.append((added, removed, changed))
        log[f"c{c}"] = (state, per)
    sections += [(number, "c0", b"nowhere", b"lost", None, "x"), (number + 1, "c0", b"loop1", b"loop2", None, "x"), (number + 2, "c0", b"loop2", b"loop1", None, "x"), (number + 3, None, None, b"q", None, "x")]
    entries += [entry(number, 0, "lost", 1), entry(number + 1, 0, "loop", 1), entry(999, 0, "none", 1)]
    rng.shuffle(sections)
    rng.shuffle(entries)
    return sections, entries, log


@pytest.mark.parametrize("seed", [1, 2])
def test_feed_equals_replaying_it(spark, seed):
    sections, entries, log = feed(random.Random(seed))
    s, e = spark.createDataFrame(sections, SECTION), spark.createDataFrame(entries, ENTRY)
    got = {(r["chain_id"], r["path"], r["size"]) for r in apply_changes(s, e).collect()}
    assert got == {(c, p, v[0]) for c, (state, _) in log.items() for p, v in state.items()}
    counts = {(r["chain_id"], r["lsn"]): (r["n_added"], r["n_removed"], r["n_modified"]) for r in chain_log(s, e).collect()}
    for c, (_, per) in log.items():
        for i, (a, r, m) in enumerate(per):
            assert counts.get((c, i + 1), (0, 0, 0)) == (a, r, m)


def test_feed_with_base_stop_and_nothing(spark):
    s = spark.createDataFrame([(1, "c", None, b"1", None, ""), (2, "c", b"1", b"2", None, "")], SECTION)
    e = spark.createDataFrame([entry(1, 0, "x", 1), entry(2, 0, "x", 1), entry(2, 1, "y", 2)], ENTRY)
    base = spark.createDataFrame([("c", 0, "z", False, "z", *[None] * 9)], "chain_id string, seq bigint, path string, is_dir boolean, " + ", ".join(f"{c} {k}" for c, k in zip(IDENTITY, ["string", "string", "int", "timestamp_ntz", "bigint", "string", "binary", "int", "string", "string"], strict=True)))
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(apply_changes(s, e, base)) == ["y", "z"]
    assert paths(apply_changes(s, e, stop_at=1)) == ["x"]
    assert paths(apply_changes(s.limit(0), e)) == [] and paths(apply_changes(s, e.limit(0))) == []


def test_long_chain_positions(spark):
    n = 300
    rows = [(i, "c", None if i == 0 else str(i - 1).encode(), str(i).encode(), None, "") for i in range(n)]
    random.Random(3).shuffle(rows)
    got = {r["section_id"]: r["lsn"] for r in section_order(spark.createDataFrame(rows, SECTION)).collect()}
    assert got == {i: i + 1 for i in range(n)}
