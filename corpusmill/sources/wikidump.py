"""Wiki dumps: XML pages in splittable bz2 files, and their index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.wikitext import wikitext_column
from ..operators.filters import is_disambiguation, main_articles
from . import multistream
from .store import scratch

#: Fixed value: the elements of a page that are read.
PAGE = "title STRING, ns STRING, id BIGINT, redirect STRUCT<_title: STRING>, revision STRUCT<id: BIGINT, timestamp: STRING, contributor: STRUCT<username: STRING, id: BIGINT>, text: STRING>"


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Distinct offsets of an index file of offset:id:title lines, in order."""
    first = F.split("value", ":")[0].try_cast("bigint")
    return spark.read.text(path).select(first.alias("offset")).where("offset is not null").distinct().orderBy("offset")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of dump files. Records end at </page>, so one file is read by many tasks, and files without a root element are read too."""
    records = spark.read.option("lineSep", "</page>").text(path)
    begins = F.instr("value", "<page>")
    record = F.concat(F.expr("substring(value, instr(value, '<page>'))"), F.lit("</page>"))
    return pages_of(records.where(begins > 0).select(record.alias("record")))


def pages_of(records: DataFrame) -> DataFrame:
    """Pages of their elements in column `record`; explode keeps Spark from parsing an element again for each filter and column."""
    rows = records.select(F.explode(F.array(F.from_xml("record", PAGE, {"rowTag": "page", "mode": "PERMISSIVE"}))).alias("p"))
    return rows.select("p.title", "p.ns", F.col("p.id").alias("page_id"), F.col("p.redirect._title").alias("redirect"), F.col("p.redirect").isNotNull().alias("is_redirect"), F.col("p.revision.id").alias("revision_id"), F.col("p.revision.timestamp").alias("timestamp"), F.col("p.revision.text").alias("text"))


def read_pages_by_offset(spark: SparkSession, path: str, index_path: str, range_bytes: int = 32 << 20) -> DataFrame:
    """Pages of multistream files, each stream read at the offset that the index gives; damaged streams are passed over (see multistream.read_records)."""
    offsets = scratch(spark, "offsets")
    multistream.write_offsets(spark, index_path, offsets)
    return pages_of(multistream.read_records(spark, path, offsets, range_bytes).where("record is not null"))


def articles(pages: DataFrame, lang: str = "en", category_prefix: str = "Category:", keep_text: bool = False, quote_url: bool = False) -> DataFrame:
    """Article rows of the main namespace: no redirects, no disambiguation pages. The page's own id is the id. A page is parsed once (explode, see pages_of)."""
    main = main_articles(pages.withColumn("redirect", F.when(F.col("is_redirect"), F.coalesce("redirect", F.lit("")))))
    main = main.withColumn("w", F.explode(F.array(wikitext_column(F.col("text"), category_prefix)))).where(~is_disambiguation(F.col("w.templates")))
    categories = T.categories_of_links(F.col("w.links"), category_prefix)
    url = T.article_url_quoted(F.col("title"), lang) if quote_url else T.article_url(F.col("title"), lang)
    out = main.select(
        "page_id", "title", url.alias("url"), T.word_count(F.col("w.plain_text")).alias("word_count"), F.size("w.links").alias("outlink_count"), F.size(categories).alias("category_count"), F.array_join(categories, "|").alias("categories"),
        F.size("w.templates").alias("template_count"), F.size("w.external_links").alias("external_link_count"), F.try_to_timestamp("timestamp").alias("last_modified"), F.col("w.plain_text").alias("processed_text"), *([F.col("text").alias("raw_text")] if keep_text else []),
    )
    return out


def first_pages(pages: DataFrame, n: int) -> DataFrame:
    """n pages of the main namespace by page id."""
    return pages.where("ns = '0'").orderBy("page_id").limit(n)


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One row a page id: the least revision."""
    from ..operators.popularity import first_per_key

    return first_per_key(pages, ["page_id"], F.col("revision_id").asc_nulls_last(), F.col("title")).drop("rn")
