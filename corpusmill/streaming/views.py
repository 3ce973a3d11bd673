"""An extension: pageview files to monthly views as the files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.popularity import monthly_views
from ..sources import pageviews

#: What is stored of each file.
STORED = "article_title STRING, views BIGINT, page_ids ARRAY<STRING>, wiki_code STRING, month STRING, file STRING"


def stream_views(spark: SparkSession, path: str, table: str, checkpoint: str, wiki_codes: list[str] | None = None, pattern: str = "*-user.bz2") -> StreamingQuery:
    """Sums of each file's lines to a table in folders by month, language and file.

    A batch replaces the folders of its own files, so a batch that is repeated, or a file that is delivered again under its name (in any folder), changes nothing;
    a late file adds to its month whenever it comes. No state is held between batches, and nothing is too late.
    """
    lines = spark.readStream.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    named = lines.select("value", F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_name").alias("file"))

    def write(batch: DataFrame, _: int) -> None:
        # of deliveries of one name in one batch, one counts
        one = batch.groupBy("file").agg(F.max("at").alias("at"))
        rows = batch.join(one, ["file", "at"]).withColumn("month", F.regexp_extract("file", r"(\d{6})", 1))
        sums = monthly_views(pageviews.parse(rows, wiki_codes, "month", "file"), "month", "file")
        sums.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("month", "wiki_code", "file").parquet(table)

    return named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_streamed_views(spark: SparkSession, table: str) -> DataFrame:
    """month, wiki_code, article_title, views, page_ids: the same as from all files at once."""
    rows = spark.read.schema(STORED).parquet(table)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_ids"))))
    return rows.groupBy("month", "wiki_code", "article_title").agg(F.sum("views").alias("views"), ids.alias("page_ids"))
