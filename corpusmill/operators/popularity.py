"""Pageview aggregation, ranking and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import remove, scratch


def monthly_views(lines: DataFrame, *extra: str) -> DataFrame:
    """Views and page ids of each (wiki_code, title); `extra` columns such as the month join the key."""
    return lines.groupBy(*extra, "wiki_code", "article_title").agg(F.sum("views").alias("views"), F.array_sort(F.collect_set("page_id")).alias("page_ids"))


def views_without_sentinel(lines: DataFrame) -> DataFrame:
    """As monthly_views, but the word null is not a page id."""
    return monthly_views(lines.withColumn("page_id", F.nullif("page_id", F.lit("null"))))


def views_by_title(views: DataFrame, key: str = "title_match") -> DataFrame:
    """Summed views and the union of the id lists."""
    return views.groupBy(key).agg(F.sum("views").alias("total_views"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_ids")))).alias("aggregated_page_ids"))


def views_by_title_listed(views: DataFrame, key: str = "title_match") -> DataFrame:
    """Summed views and the distinct id lists as one string, in order."""
    listed = F.concat(F.lit("["), F.array_join("page_ids", ", "), F.lit("]"))
    return views.groupBy(key).agg(F.sum("views").alias("total_views"), F.array_join(F.array_sort(F.collect_set(listed)), ",").alias("aggregated_page_ids"))


def top_titles(views: DataFrame, n: int, key: str = "title_match") -> DataFrame:
    """The n most viewed titles; ties by title."""
    return views.orderBy(F.desc("total_views"), key).limit(n)


def first_per_key(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order, with rn = 1. Spark keeps one row a key before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rn = 1")


def later_duplicates(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """All but the first row of each key."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rn > 1").drop("rn")


#: Distinct values of one range of a histogram, about.
RANGE_VALUES = 100_000


def _running(histogram: DataFrame, value: str, descending: bool, range_values: int = RANGE_VALUES) -> tuple[DataFrame, int]:
    """For each distinct value: rows before it (`before`) and its own (`k`), without one task that holds all values; and the rows in all.

    The histogram is evaluated once. Values are dealt to ranges by their number; the ranges' sums, a row each, are accumulated, then values within their range.
    """
    spark, paths = histogram.sparkSession, [scratch(histogram.sparkSession, n) for n in ("histogram", "ranges")]
    histogram.write.parquet(paths[0])
    stored = spark.read.schema(histogram.schema).parquet(paths[0])
    n, total = stored.agg(F.count("*"), F.coalesce(F.sum("k"), F.lit(0))).first()
    order = F.desc(value) if descending else F.asc(value)
    stored.repartitionByRange(max(1, -(-n // range_values)), order).withColumn("_range", F.spark_partition_id()).write.parquet(paths[1])
    remove(spark, paths[0])
    ranged = spark.read.parquet(paths[1])
    sums = ranged.groupBy("_range").agg(F.sum("k").alias("_sum"))
    offset = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    within = F.coalesce(F.sum("k").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_within", within).join(F.broadcast(offset), "_range").select(value, "k", (F.col("_offset") + F.col("_within")).alias("before")), total


def percent_rank_scalable(df: DataFrame, value: str, out: str, range_values: int = RANGE_VALUES) -> DataFrame:
    """percent_rank() over all rows, most first, from a histogram of the values; the rows themselves are not gathered."""
    ranks, total = _running(df.groupBy(value).agg(F.count("*").alias("k")), value, True, range_values)
    ranks = ranks.select(F.col(value).alias("_v"), (F.col("before") / F.lit(max(total - 1, 1))).cast("double").alias(out))
    return df.join(ranks, df[value].eqNullSafe(ranks["_v"])).drop("_v")


def average_percent_rank(df: DataFrame, value: str, out: str, range_values: int = RANGE_VALUES) -> DataFrame:
    """Share of the rows at or below a value, ties at their mean, 1.0 for the most; null values stay null and do not count."""
    ranks, total = _running(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("k")), value, False, range_values)
    ranks = ranks.select(F.col(value).alias("_v"), ((F.col("before") + (F.col("k") + 1) / 2.0) / F.lit(max(total, 1))).cast("double").alias(out))
    return df.join(ranks, df[value] == ranks["_v"], "left").drop("_v")


def random_chunk_size(key: Column, low: int = 1000, high: int = 2000, seed: int = 42) -> Column:
    """A size between low and high that depends on the row's key only."""
    return (F.lit(low) + F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(high - low + 1))).cast("int")


def batches(df: DataFrame, key: str, size: int, range_values: int = RANGE_VALUES) -> DataFrame:
    """Number of the batch of `size` rows that each row falls in, in the order of a unique key."""
    counted, _ = _running(df.groupBy(key).agg(F.count("*").alias("k")), key, False, range_values)
    return df.join(counted.select(key, F.floor(F.col("before") / size).alias("batch")), key)


def placed(df: DataFrame, out: str, *order: str, range_values: int = RANGE_VALUES) -> DataFrame:
    """Number each row, from 0, in the order of columns that are unique together; no task sees all rows."""
    key = F.struct(*order)
    counted, _ = _running(df.groupBy(key.alias("_key")).agg(F.count("*").alias("k")), "_key", False, range_values)
    return df.join(counted.select("_key", F.col("before").alias(out)), key == F.col("_key")).drop("_key")


def row_at(df: DataFrame, order: list[Column], index: int) -> DataFrame:
    """The row at a place (from 0) of a total order."""
    return df.orderBy(*order).offset(index).limit(1)
