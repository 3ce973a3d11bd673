"""The flagship flow: popular articles, one for each title, ranked by views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.popularity import first_per_key, percent_rank_scalable, top_titles


def popular_articles(articles: DataFrame, views: DataFrame, n: int, lang: str = "en", key: str = "title_match") -> DataFrame:
    """Articles of the n most viewed titles, the longest for each title, with total_views, url_pageviews and views_percentile.

    The titles are cut before the join. The percentile is over all joined rows, also those that are not kept. Ranks come from a histogram of
    the views, so no task sees all rows.
    """
    joined = articles.join(top_titles(views, n, key), key)
    ranked = percent_rank_scalable(joined, "total_views", "views_percentile")
    kept = first_per_key(ranked, [key], F.desc("word_count"), F.col("page_id"))
    return kept.withColumn("url_pageviews", T.curid_url(T.first_real_page_id(F.col("aggregated_page_ids")), lang))


def curated_corpus(articles: DataFrame, views: DataFrame, n_titles: int, n_articles: int, min_words: int = 50, lang: str = "en") -> DataFrame:
    """The n_articles most viewed of the popular articles with more than min_words words."""
    found = popular_articles(articles, views, n_titles, lang).where(F.col("word_count") > min_words)
    return found.orderBy(F.desc("total_views"), "title_match").limit(n_articles)
