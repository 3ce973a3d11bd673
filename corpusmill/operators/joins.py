"""Joins of articles, views, ids and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_views(articles: DataFrame, views: DataFrame, key: str = "title_match", how: str = "left") -> DataFrame:
    """Articles with their views; views that are not grouped by key multiply the articles."""
    return articles.join(views, key, how)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_semi")


def any_id_in(rows: DataFrame, ids: DataFrame, row_key: str, list_col: str = "page_ids", id_col: str = "page_id") -> DataFrame:
    """Rows of which at least one listed id is in ids; by exploded ids, so neither side need be small."""
    hits = rows.select(row_key, F.explode(list_col).alias(id_col)).join(ids.select(id_col).distinct(), id_col, "left_semi").select(row_key).distinct()
    return rows.join(hits, row_key, "left_semi")


def pending_chunks(chunks: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Chunks that the checkpoint does not list."""
    return chunks.join(checkpoint.select("title_match", "chunk_idx").distinct(), ["title_match", "chunk_idx"], "left_anti")


def pending_articles(articles: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Articles with at least one chunk that the checkpoint does not list; articles without chunks are not pending."""
    wanted = articles.select("title_match", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_idx")) if "n_chunks" in articles.columns else articles.select("title_match", F.posexplode("split_text").alias("chunk_idx", "_c")).drop("_c")
    wanted = wanted.where("chunk_idx >= 0")
    return articles.join(pending_chunks(wanted, checkpoint).select("title_match").distinct(), "title_match", "left_semi")


def lookup_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of search hits, with their score and rank, in that order."""
    return hits.join(chunks, "id").orderBy("rank")


def cited_chunks(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that an answer cites."""
    return answers.select(F.explode("source_ids").alias("id")).distinct().join(chunks, "id")


def with_source_names(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations with the name of the first source of their id, or Unknown. First is the least `ord`, where sources have it (null: last), then the least name."""
    order = [x for c in ("ord", "source") if c in sources.columns for x in (F.col(c).isNull(), F.col(c))]
    first = sources.groupBy("id").agg(F.min_by("source", F.struct(*[x.alias(f"o{i}") for i, x in enumerate(order)])).alias("source"))
    return citations.join(first, "id", "left").withColumn("source", F.coalesce("source", F.lit("Unknown")))


def size_grid(dims: DataFrame, counts: DataFrame) -> DataFrame:
    """GB of float32 vectors for each dimension and count; both tables are lists of parameters."""
    grid = F.broadcast(dims).crossJoin(F.broadcast(counts))
    return grid.withColumn("gb", F.col("n_vectors") * F.col("dim") * 4 / F.lit(float(1 << 30)))
