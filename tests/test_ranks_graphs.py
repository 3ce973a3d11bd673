"""Exact order statistics, running ranks and bucketed PageRank."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import graph, order_stats, popularity, stats

SHARES = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}


def groups(rng):
    rows = [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [("crowded", 10.0 ** rng.uniform(-12, 12)) for _ in range(800)] + [("ties", float(rng.randrange(3))) for _ in range(500)]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0), (None, 7.0), (None, -1.0), ("none", None), ("none", float("nan")), ("same", 0.1), ("same", 0.1)]
    return rows


@pytest.mark.parametrize(("bins", "few"), [(1024, 100_000), (4, 3)])
def test_quantiles_of_groups(spark, bins, few):
    rows = groups(random.Random(bins))
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r.g: r for r in order_stats.exact_quantiles(df, ["g"], "x", SHARES, bins, few).collect()}
    want = {}
    for g, x in rows:
        if x is not None and x == x:
            want.setdefault(g, []).append(x)
    assert set(got) == set(want)
    for g, values in want.items():
        assert [got[g][n] for n in SHARES] == pytest.approx([np.quantile(values, p) for p in SHARES.values()], rel=1e-12)


def test_quantiles_without_groups_or_rows(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 9, 3, None)], "x int")
    assert tuple(order_stats.exact_quantiles(df, [], "x", {"m": 0.5, "q": 0.25}).first()) == (4.0, 2.5)
    assert order_stats.exact_quantiles(df.limit(0), [], "x", {"m": 0.5}).collect() == []
    assert order_stats.exact_quantiles(df.where("x is null"), [], "x", {"m": 0.5}).collect() == []
    row = stats.describe(df.limit(0), "x").first()
    assert row.n == 0 and row.q50 is None and row["max"] is None


def test_quantiles_of_several_keys_and_ranges_that_are_joined(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "RANGES_BYTES", 0)
    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), rng.randrange(3), rng.randrange(1000)) for _ in range(2000)]
    got = {(r.a, r.b): r.m for r in order_stats.exact_quantiles(spark.createDataFrame(rows, "a string, b int, x int"), ["a", "b"], "x", {"m": 0.5}, 16, 5).collect()}
    want = {k: statistics.median(x for a, b, x in rows if (a, b) == k) for k in {(a, b) for a, b, _ in rows}}
    assert got == want


def test_what_is_shuffled_for_a_hot_group_is_bounded_by_the_parts(spark):
    """The rows that counting sends on are at most parts and tasks, however large the group."""
    df = spark.range(0, 200_000, 1, 4).select(F.lit("g").alias("g"), F.rand(3).alias("v"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    place = F.least(F.floor(F.col("v") * 64), F.lit(63))
    counted = df.groupBy("g", "lo", "hi", place.alias("part")).agg(F.count("*").alias("rows"), F.min("v"), F.max("v"))
    assert "partial_count" in counted._jdf.queryExecution().executedPlan().toString()
    assert counted.count() == 64


def test_group_stats_equal_those_of_python(spark):
    rows = [(i % 3, float(i * i % 17)) for i in range(100)] + [(None, 1.0), (5, None)]
    got = {r.k: r for r in stats.group_stats(spark.createDataFrame(rows, "k int, x double"), "k", "x").collect()}
    for k in range(3):
        own = [x for j, x in rows if j == k]
        assert (got[k]["median"], got[k]["max"], got[k].n) == (statistics.median(own), max(own), len(own))
    assert set(got) == {0, 1, 2, 5} and got[5]["median"] is None


def test_running_ranks_in_many_ranges(spark):
    rng = random.Random(3)
    values = [rng.randrange(200) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int")
    got = {r.id: r.p for r in popularity.percent_rank_scalable(df, "v", "p", 7).collect()}
    assert all(got[i] == pytest.approx(sum(w > v for w in values) / 999) for i, v in enumerate(values))
    placed = popularity.placed(df, "n", "v", "id", range_values=10)
    assert [r.n for r in placed.orderBy("v", "id").collect()] == list(range(1000))
    assert placed.rdd.getNumPartitions() >= 1
    number = {r.id: r.batch for r in popularity.batches(df, "id", 64, 9).collect()}
    assert number == {i: i // 64 for i in range(1000)}


# PageRank


def ranks_by_force(edges, alpha=0.85, rounds=200):
    edges = set(edges)
    every = {x for e in edges for x in e}
    out = {n: [b for a, b in edges if a == n] for n in every}
    rank = dict.fromkeys(every, 1 / len(every))
    for _ in range(rounds):
        held = sum(rank[n] for n in every if not out[n])
        new = {n: (1 - alpha + alpha * held) / len(every) for n in every}
        for n in every:
            for b in out[n]:
                new[b] += alpha * rank[n] / len(out[n])
        rank = new
    return rank


def test_pagerank_equals_brute_force_and_leaves_no_tables(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(40)}", f"n{int(rng.expovariate(0.1)) % 40}") for _ in range(150)] + [("n1", "sink"), ("hub", "n2")]
    edges += edges[:10] + [(f"n{i}", "hub") for i in range(40)]
    df = spark.createDataFrame([*edges, (None, "x"), ("y", None)], "src string, dst string")
    got = {r.node: r["rank"] for r in graph.pagerank(df, tol=1e-12).collect()}
    assert got == pytest.approx(ranks_by_force(edges), abs=1e-9)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("graph_")] == []
    assert graph.pagerank(df.limit(0)).collect() == []


def test_a_round_shuffles_neither_links_nor_ranks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    buckets = graph._Buckets(spark)
    links = buckets.write(spark.range(1000).selectExpr("id % 50 as src", "id % 37 as dst"), "src")
    ranks = buckets.write(spark.range(50).selectExpr("id as node", "20L as out", "0.02D as rank"), "node")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = graph._pagerank_round(spark.table(links[0]), spark.table(ranks[0]), 0.85, 0.1)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        buckets.drop(*links)
        buckets.drop(*ranks)
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan and "hashpartitioning(dst" in plan
