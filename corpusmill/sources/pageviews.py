"""Pageview files: text lines of wiki_code, title, page id, access method, total and a code of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The languages that are kept.
WIKI_CODES = ["is.wikipedia", "no.wikipedia", "nn.wikipedia", "de.wikipedia", "en.wikipedia", "fo.wikipedia", "nl.wikipedia", "se.wikipedia", "dk.wikipedia", "lu.wikipedia"]


def read_lines(spark: SparkSession, path: str, pattern: str = "*-user.bz2", month_of_folder: bool = False) -> DataFrame:
    """Lines of the files that fit the pattern, with the month in the file's name if there is one, or of their folders `month=...`."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    if month_of_folder:
        return lines.withColumn("month", F.col("month").cast("string"))
    return lines.withColumn("month", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{6})", 1))


def _tokens(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def parse(lines: DataFrame, wiki_codes: list[str] | None = None, *keep: str) -> DataFrame:
    """Views by line. Lines with fewer than six parts or no number are skipped; the languages are tested before anything else is cut out."""
    rows = lines.withColumn("_t", _tokens(F.col("value"))).where(F.size("_t") >= 6)
    if wiki_codes is not None:
        rows = rows.where(F.col("_t")[0].isin(wiki_codes))
    views = F.element_at("_t", -2).try_cast("bigint")
    return rows.select(*keep, F.col("_t")[0].alias("wiki_code"), F.col("_t")[1].alias("article_title"), F.col("_t")[2].alias("page_id"), views.alias("views")).where("views is not null")


def parse_strict(lines: DataFrame, prefix: str | None = None) -> DataFrame:
    """All six columns; lines of five parts are skipped, any other number fails."""
    rows = lines if prefix is None else lines.where(F.startswith("value", F.lit(prefix)))
    rows = rows.withColumn("_t", _tokens(F.col("value")))
    n = F.size("_t")
    ok = F.when(n == 6, True).when(n == 5, False).otherwise(F.raise_error(F.concat(F.lit("unexpected columns: "), F.col("value"))).cast("boolean"))
    names = ("wiki_code", "article_title", "page_id", "access_method", "daily_total", "hourly_counts")
    out = rows.where(ok).select(*[F.col("_t")[i].alias(c) for i, c in enumerate(names)])
    return out.withColumn("daily_total", F.col("daily_total").cast("bigint"))


def _urls(months: DataFrame, base: str) -> DataFrame:
    return months.select(F.concat(F.lit(base.rstrip("/") + "/"), F.date_format("d", "yyyy"), F.lit("/"), F.date_format("d", "yyyy-MM"), F.lit("/pageviews-"), F.date_format("d", "yyyyMM"), F.lit("-user.bz2")).alias("url"))


def month_urls(spark: SparkSession, base: str, from_year: int, from_month: int, to_year: int, to_month: int) -> DataFrame:
    """Addresses of the monthly files of an inclusive range."""
    days = F.explode(F.sequence(F.make_date(F.lit(from_year), F.lit(from_month), F.lit(1)), F.make_date(F.lit(to_year), F.lit(to_month), F.lit(1)), F.expr("interval 1 month")))
    return _urls(spark.range(1).select(days.alias("d")), base)


def urls_of_months(df: DataFrame, time_col: str, base: str) -> DataFrame:
    """Addresses of the monthly files from the first to the last month of a table's times."""
    ends = df.agg(F.min(time_col).alias("first"), F.max(time_col).alias("last")).where("first is not null")
    months = F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))
    return _urls(ends.select(F.explode(months).alias("d")), base)


def first_lines(lines: DataFrame, n: int = 10) -> DataFrame:
    """A look at n lines; of large files no more is read than that takes."""
    return lines.limit(n)


def previous_month(year: int, month: int) -> tuple[int, int]:
    return (year - 1, 12) if month == 1 else (year, month - 1)
