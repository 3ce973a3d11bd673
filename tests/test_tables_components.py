"""Database tables read in partitions, and components of stars and long paths."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import graph
from corpusmill.sources import web


@pytest.fixture()
def derby(spark):
    return f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"


def _stored(spark, url, keys):
    rows = [(k, f"text {i}", i) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "id long, name string, n int").repartition(2).write.jdbc(url, "pages")
    return rows


def test_each_row_is_read_once_in_even_partitions(spark, derby):
    # a third of the keys are crowded into a hundredth of the range, some are null and some repeat
    keys = [*range(0, 100_000, 100), *range(50_000, 50_500), *[None] * 5, *[7] * 20, -3]
    rows = _stored(spark, derby, keys)
    got = web.read_table(spark, derby, "pages", key='"id"', parts=6)
    assert got.rdd.getNumPartitions() == 6
    assert sorted(got.collect(), key=lambda r: r.n) == rows
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * len(rows) / 6


def test_crowded_keys_far_from_the_others_are_cut(spark, derby):
    _stored(spark, derby, [*range(400), 10**15])
    sizes = [r["count"] for r in web.read_table(spark, derby, "pages", key='"id"', parts=4).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 150


def test_conditions_and_columns_reach_the_database(spark, derby):
    rows = _stored(spark, derby, list(range(1000)))
    got = web.read_table(spark, derby, "pages", key='"id"', parts=4).where("n >= 990").select("name")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,990)" in plan and "ReadSchema: struct<name:string>" in plan
    assert sorted(r.name for r in got.collect()) == sorted(name for _, name, n in rows if n >= 990)


@pytest.mark.parametrize("keys", [[], [None, None], [5, 5, 5], [1, 2], [-(2**62), 2**62]])
def test_odd_keys(spark, derby, keys):
    rows = _stored(spark, derby, keys)
    got = web.read_table(spark, derby, "pages", key='"id"', parts=4)
    assert sorted(got.collect(), key=lambda r: r.n) == rows
    assert web.read_table(spark, derby, "pages", limit=1, key='"id"', parts=4).count() == min(1, len(keys))


def _brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def _counted(monkeypatch):
    steps = []
    step = graph._star_step
    monkeypatch.setattr(graph, "_star_step", lambda *a: steps.append(1) or step(*a))
    return steps


def test_components_of_random_links(spark):
    r = random.Random(5)
    for n in (0, 1, 40, 150):
        edges = [(f"n{r.randrange(120):03}", f"n{r.randrange(120):03}") for _ in range(n)]
        got = graph.weak_components(spark.createDataFrame(edges, "src string, dst string")).collect()
        assert {x.node: x.component for x in got} == _brute(edges) and len(got) == len(_brute(edges))


def test_components_with_null_ends_self_links_and_repeats(spark):
    edges = [("a", "a"), ("b", None), (None, "c"), ("e", "d"), ("d", "e"), ("e", "d")]
    got = graph.weak_components(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert sorted((x.node or "", x.component or "") for x in got) == [("", ""), ("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("e", "d")]


def test_a_star_ends_in_few_rounds_and_its_hub_is_not_shuffled(spark, monkeypatch):
    steps = _counted(monkeypatch)
    n = 200_000
    edges = spark.range(n).select((F.col("id") + 1).alias("src"), F.lit(n * 2).cast("long").alias("dst"))
    got = graph.weak_components(edges)
    assert got.agg(F.count("*"), F.min("component"), F.max("component")).first() == (n + 1, 1, 1)
    assert len(steps) <= 8


def test_a_long_path_ends_in_tens_of_steps(spark, monkeypatch):
    steps = _counted(monkeypatch)
    n = 20_000
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "src long, dst long")
    assert graph.weak_components(edges).where("component <> 0").count() == 0
    assert len(steps) <= 40
