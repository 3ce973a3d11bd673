"""Embedding by a provider, and the resumable embed-and-upsert job."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks import VectorTable, append_checkpoint, read_or_empty, written
from .chunks import prepare_chunks
from .vectors import vector_id, vector_records

#: A function from texts to vectors, one for each, in order.
Provider = Callable[[list[str]], list[list[float]]]


class HashProvider:
    """An offline stand-in for an embedding service: hashed words, scaled to length 1."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()


def embed(text: Column, provider: Provider, batch_size: int = 64) -> Column:
    """Vectors of texts in batches; the provider must give one for each."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, out = batch.to_pylist(), []
            for at in range(0, len(texts), batch_size):
                part = [t or "" for t in texts[at : at + batch_size]]
                found = provider(part)
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} vectors for {len(part)} texts")
                out.extend(found)
            yield pa.array(out, pa.list_(pa.float32()))

    return run(text)


def embed_articles(articles: DataFrame, table: VectorTable, namespace: str, checkpoint_path: str, provider: Provider, batch_size: int = 50, safe_ids: bool = True, articles_per_batch: int = 100_000) -> int:
    """Embed what the checkpoint does not list. Returns the number of chunks.

    What is pending is written once, in batches of whole buckets of the vector table and about `articles_per_batch` articles, so each bucket is rewritten by one
    batch. A batch writes its vectors, then its checkpoint: a run that breaks off loses one batch at most and is repeated safely.
    """
    spark, vectors = articles.sparkSession, table.of(namespace)
    n_batches = max(1, min(table.buckets, -(-articles.count() // articles_per_batch)))
    chunks = prepare_chunks(articles, read_or_empty(spark, checkpoint_path, "title_match string, chunk_idx int"))
    batch = F.floor(vectors.bucket(vector_id(safe_ids)) * n_batches / table.buckets).cast("int")
    total = 0
    with written(chunks.withColumn("batch", batch), "pending", "batch") as pending:
        for i in sorted(r.batch for r in pending.select("batch").distinct().collect()):
            own = pending.where(F.col("batch") == i).drop("batch")
            total += table.upsert(namespace, vector_records(own.withColumn("vector", embed(F.col("chunk_text"), provider, batch_size)), safe_ids))
            append_checkpoint(own.select("title_match", "chunk_idx"), checkpoint_path)
    return total
