"""An extension: chunks arriving as files are embedded and upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.embedding import Provider, embed
from ..operators.vectors import vector_records
from ..sinks import VectorTable


def stream_upserts(spark: SparkSession, path: str, schema: str, table: VectorTable, namespace: str, provider: Provider, checkpoint: str) -> StreamingQuery:
    """Files of prepared chunks under path to vectors. Ids are deterministic, so a batch that is repeated changes nothing."""
    chunks = spark.readStream.schema(schema).parquet(path)

    def write(batch: DataFrame, _: int) -> None:
        table.upsert(namespace, vector_records(batch.withColumn("vector", embed(F.col("chunk_text"), provider)), safe_ids=True))

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
