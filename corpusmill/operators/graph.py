"""Link graphs as tables of edges (src, dst)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.store import remove, scratch

#: Nodes that are broadcast because they have many links are at most so many, by the choice of what counts as many.
HUBS = 100_000


def _written(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder."""
    path = scratch(df.sparkSession, "graph")
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


class _Buckets:
    """Tables bucketed by one column into as many buckets as shuffles have partitions, so joins on it move neither side."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, df: DataFrame, by: str) -> tuple[str, str]:
        """The table's name and path."""
        name, path = f"graph_{uuid.uuid4().hex}", scratch(self.spark, "graph")
        df.write.option("path", path).bucketBy(self.n, by).sortBy(by).saveAsTable(name)
        return name, path

    def drop(self, name: str, path: str | None = None) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        if path:
            remove(self.spark, path)


def link_edges(pages: DataFrame, title: str, targets: str) -> DataFrame:
    """Distinct edges from each page to the targets of its links; self-links stay."""
    return pages.select(F.col(title).alias("src"), F.explode(targets).alias("dst")).distinct()


def nodes(edges: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    found = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    if titles is not None:
        found = found.union(titles)
    return found.distinct()


def degree_centrality(edges: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """In- and out-degree of every node and their shares of the other nodes."""
    every = nodes(edges, titles)
    n = every.count()
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    if titles is not None:
        ends = ends.unionByName(titles.toDF("node").withColumns({"o": F.lit(0), "i": F.lit(0)}))
    degrees = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    share = lambda c: F.col(c) / F.lit(max(n - 1, 1))
    return degrees.select("node", "in_degree", "out_degree", share("in_degree").alias("in_centrality"), share("out_degree").alias("out_centrality"))


def graph_counts(edges: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    return nodes(edges, titles).agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node).select("dst")


def in_degrees(edges: DataFrame, chosen: DataFrame, node: str = "dst") -> DataFrame:
    """The chosen nodes with the number of links to each."""
    links = edges.join(chosen.select(F.col(node).alias("dst")).distinct(), "dst", "left_semi")
    found = links.groupBy(F.col("dst").alias(node)).agg(F.count("*").alias("in_degree"))
    return chosen.join(found, node, "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0).cast("long")))


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among the chosen nodes."""
    return edges.join(chosen.select(F.col("node").alias("src")), "src", "left_semi").join(chosen.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def _pagerank_round(links: DataFrame, ranks: DataFrame, alpha: float, base: float) -> DataFrame:
    """New ranks (node, out, old, rank). links are in buckets of src and ranks of node, so only sums for each target are shuffled."""
    shares = ranks.where("out > 0").select("node", (F.col("rank") / F.col("out")).alias("share"))
    given = links.join(shares, links.src == shares.node).groupBy("dst").agg(F.sum("share").alias("got"))
    return ranks.join(given, ranks.node == given.dst, "left").select("node", "out", F.col("rank").alias("old"), (F.lit(base) + F.lit(alpha) * F.coalesce("got", F.lit(0.0))).alias("rank"))


def pagerank(edges: DataFrame, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100, fixed: int | None = None) -> DataFrame:
    """(node, rank); what nodes without links hold is shared by all. Stops below tol * n of change, or after `fixed` rounds.

    Links are written once, in buckets of src; ranks are kept in the same buckets. A round is one job that writes the new ranks and tells, by observed
    sums, how much they changed and what sinks now hold; the round before is deleted.
    """
    spark = edges.sparkSession
    buckets = _Buckets(spark)
    known = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    links_at = buckets.write(known, "src")
    links = spark.table(links_at[0])
    outs = links.groupBy("src").agg(F.count("*").alias("out"))
    every = nodes(links).join(outs, F.col("node") == F.col("src"), "left").select("node", F.coalesce("out", F.lit(0).cast("long")).alias("out"))
    every = _written(every)
    n, held = every.agg(F.count("*"), F.count_if(F.col("out") == 0)).first()
    if not n:
        buckets.drop(*links_at)
        return every.select("node", F.lit(0.0).alias("rank"))
    at, held = buckets.write(every.select("node", "out", F.lit(1.0 / n).alias("rank")), "node"), held / n
    for _ in range(fixed or max_iter):
        seen = Observation(f"pagerank-{uuid.uuid4().hex}")
        new = _pagerank_round(links, spark.table(at[0]), alpha, (1 - alpha) / n + alpha * held / n)
        new = new.observe(seen, F.sum(F.when(F.col("out") == 0, F.col("rank"))).alias("held"), F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change"))
        before, at = at, buckets.write(new.drop("old"), "node")
        buckets.drop(*before)
        held = seen.get["held"] or 0.0
        if fixed is None and seen.get["change"] < n * tol:
            break
    buckets.drop(*links_at)
    schema = spark.table(at[0]).schema
    buckets.drop(at[0])
    return spark.read.schema(schema).parquet(at[1]).select("node", "rank")


def _reach(edges: DataFrame, start: DataFrame, alive: DataFrame) -> DataFrame:
    """(node, color) reached from (node, color) along edges; each node takes the largest color that reaches it."""
    colors = start
    while True:
        sent = edges.join(colors, edges.src == colors.node).groupBy("dst").agg(F.max("color").alias("sent"))
        new = _written(colors.join(sent, colors.node == sent.dst, "left").select("node", F.greatest("color", F.coalesce("sent", "color")).alias("color"), (F.coalesce("sent", "color") > F.col("color")).alias("moved")))
        if not new.where("moved").limit(1).count():
            return new.select("node", "color")
        colors = new.select("node", "color")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) by colouring: forward colours, then backward from each colour's root; nodes without in- or out-links are trimmed first."""
    left = _written(edges.where("src <> dst").distinct())
    every = nodes(edges)
    done: DataFrame | None = None
    remaining = _written(every)
    while True:
        while True:
            alive = left.select(F.col("src").alias("node")).distinct().join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
            alive = _written(alive)
            kept = _written(left.join(alive.withColumnRenamed("node", "src"), "src", "left_semi").join(alive.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        single = remaining.join(alive, "node", "left_anti").select("node", F.col("node").alias("component"))
        done = single if done is None else done.unionByName(single)
        if not alive.limit(1).count():
            return _written(done)
        forward = _reach(left, alive.withColumn("color", F.col("node")), alive)
        f = forward.withColumnRenamed("color", "f")
        inside = left.join(f.select(F.col("node").alias("src"), F.col("f").alias("fs")), "src").join(f.select(F.col("node").alias("dst"), F.col("f").alias("fd")), "dst").where("fs = fd")
        back = _written(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = forward.select("node", F.when(F.col("node") == F.col("color"), F.lit(1)).otherwise(F.lit(0)).alias("color"))
        reached = _reach(back, roots, alive).where("color = 1").select("node")
        found = _written(forward.join(reached, "node", "left_semi").select("node", F.col("color").alias("component")))
        done = _written(done.unionByName(found))
        remaining = _written(alive.join(found.select("node"), "node", "left_anti"))
        if not remaining.limit(1).count():
            return done
        left = _written(left.join(remaining.withColumnRenamed("node", "src"), "src", "left_semi").join(remaining.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))


def largest_strong_component(edges: DataFrame) -> DataFrame:
    return strong_components(edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n").alias("size"))


def _with_least(edges: DataFrame, n_edges: int) -> DataFrame:
    """Rows (a, b) with `least`, the least of a and all its b.

    The table of least neighbours comes from partial sums. Nodes of more than max(1000, n_edges / HUBS) rows, of which there can be no more than HUBS,
    are broadcast and their links stay where they are; all others meet in a shuffle in which no node is frequent.
    """
    most = max(1000, n_edges // HUBS)
    table = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k")).select("a", F.least("a", "m").alias("least"), "k")
    hubs = F.broadcast(table.where(F.col("k") > most).drop("k"))
    others = edges.join(hubs.select("a"), "a", "left_anti").join(table.where(F.col("k") <= most).drop("k").hint("merge"), "a")
    return edges.join(hubs, "a").unionByName(others)


def _star_step(edges: DataFrame, large: bool) -> tuple[DataFrame, int]:
    """One step of star contraction on links (a, b) with a > b: (written links, how many of them moved).

    The large step hangs the larger neighbours of each node on the least of it and its neighbours, the small step its smaller neighbours and the node itself.
    """
    n = edges.count()
    seen = Observation(f"stars-{uuid.uuid4().hex}")
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rows = _with_least(both, 2 * n).where("b > a").observe(seen, F.count_if(F.col("least") != F.col("a")).alias("moved"))
        new = rows.select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        rows = _with_least(edges, n).observe(seen, F.count_if(F.col("least") != F.col("b")).alias("moved"))
        ends = F.array(F.struct(F.col("a").alias("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))
        new = rows.select(F.inline(ends)).where("a <> b")
    made = _written(new.distinct())
    return made, seen.get["moved"]


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node joined by links of any direction.

    Large and small star steps by turns, until neither moves a link; the number of rounds grows with the logarithm of the longest path, and no
    node's links meet in one task. A null end is a node of its own that links with nothing; an empty table gives no rows.
    """
    spark = edges.sparkSession
    known = edges.where("src is not null and dst is not null and src <> dst")
    stars = _written(known.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    moved = 0 if stars.isEmpty() else 1
    while moved:
        moved = 0
        for large in (True, False):
            before, (stars, some) = stars, _star_step(stars, large)
            remove(spark, before.written_to)
            moved += some
    return nodes(edges).join(stars, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))
