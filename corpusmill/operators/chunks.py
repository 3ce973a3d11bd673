"""From articles to chunks, and to rows for embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.splitter import split_text, split_text_counted


def chunk_articles(articles: DataFrame, text_col: str, chunk_size: Column | int, overlap: int = 300, discard: int = 12, min_words: int = 45) -> DataFrame:
    """articles with chunk_size, split_text, n_chunks and n_words_per_chunk."""
    size = chunk_size if isinstance(chunk_size, Column) else F.lit(chunk_size)
    out = articles.withColumn("chunk_size", size.cast("int"))
    out = out.withColumn("_split", split_text_counted(T.strip(F.col(text_col)), F.col("chunk_size"), overlap, discard, True, False, min_words))
    return out.withColumns({"split_text": F.col("_split.chunk"), "n_chunks": F.size("_split"), "n_words_per_chunk": F.col("_split.words")}).drop("_split")


def create_chunks(articles: DataFrame, language: str, index_name: str, namespace: str, title: str = "title", url: str = "url", text_col: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunk records of articles: markup stripped, neither discarded nor joined; no vectors yet."""
    pieces = split_text(F.col(text_col), size, overlap, clean_whitespace=True, clean_html=True)
    rows = articles.select(F.col(title).alias("source_title"), F.col(url).alias("source_url"), F.posexplode(pieces).alias("chunk_index", "chunk_text"))
    return rows.select(T.chunk_id(F.col("source_title"), F.col("source_url"), F.col("chunk_index")).alias("id"), F.lit(language).alias("language"), F.lit(index_name).alias("index_name"), F.lit(namespace).alias("namespace"), "chunk_text", "chunk_index", "source_title", "source_url", F.lit(None).cast("array<float>").alias("vector"))


def load_chunks(articles: DataFrame, text_col: str = "main_text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Plain chunks of scraped articles with their title and place, without cleaning."""
    pieces = split_text(F.col(text_col), size, overlap, clean_whitespace=False)
    return articles.select(F.col("name").alias("source_title"), F.posexplode(pieces).alias("chunk_index", "chunk_text"))


def prepare_chunks(articles: DataFrame, checkpoint: DataFrame | None = None, quote: bool = True) -> DataFrame:
    """A row for each chunk to embed; those of the checkpoint are left out."""
    zipped = F.arrays_zip(F.col("split_text").alias("chunk"), F.col("n_words_per_chunk").alias("words"))
    rows = articles.select("title_match", T.strip(F.col("title")).alias("title"), "url", F.col("word_count").alias("word_count_total"), "chunk_size", F.posexplode(zipped).alias("chunk_idx", "z"))
    rows = rows.select("chunk_idx", T.with_chunk_prefix(F.col("title"), F.col("z.chunk"), quote).alias("chunk_text"), "title_match", "title", "url", T.title_normalized(F.col("title_match")).alias("title_normalized"), "word_count_total", F.col("z.words").alias("word_count_chunk"), "chunk_size")
    if checkpoint is None:
        return rows
    return rows.join(checkpoint.select("title_match", "chunk_idx").distinct(), ["title_match", "chunk_idx"], "left_anti")
