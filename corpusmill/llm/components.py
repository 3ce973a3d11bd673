"""Connected components of a graph of links by alternating large and small stars; the label of a node is the least of its component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, skew_safe_join, tidy


def forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Of some links, one for each node to the least node that it is joined to by them: rows (a, b), a > b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    u, v = at[: len(a)], at[len(a) :]
    while True:
        least = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        np.minimum.at(label, before[u], least)
        np.minimum.at(label, before[v], least)
        label = label[label]
        if (label == before).all():
            break
    keep = label != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[keep], pa.int64()), pa.array(nodes[label[keep]], pa.int64())], ["a", "b"])


@tidy
def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())


def connected_components(links: DataFrame, contracted: bool = False) -> DataFrame:
    """(node, label) of every node that has a link. links: columns a and b; contracted: each task's are a forest with a > b already.

    Links are contracted to a forest in each task first. In the rounds, a node with many links gets the least of its neighbours by a
    broadcast of such nodes, whose number is bounded, so its links stay spread over the tasks.
    """
    if not contracted:
        links = links.where("a <> b").select("a", "b").mapInArrow(_forests, "a long, b long")
    edges = materialize(links.distinct(), "edges")
    n, before = edges.count(), None
    while n:
        # large star: neighbours above a node are hung on the least of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k")).select("a", F.least("a", "m").alias("m"), "k")
        large = skew_safe_join(both.where("b > a"), least, ["a"], "k", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        # small star: a node and its neighbours below are hung on the least of them
        lower = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        small = skew_safe_join(large, lower, ["a"], "k", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        new = materialize(small.where("a <> b").distinct(), "edges")
        discard(edges)
        discard(large)
        edges = new
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        n, before = state[0], state
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    discard(edges)
    return labels
