"""The registered queries of the library and their DuckDB SQL.

Encyclopedia entities are mapped onto the driver's tables: events are pageview lines, documents are articles, pages are scraped
pages, embeddings are vectors, orders and lineitem give links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html_text, splitter
from .functions import text as T
from .operators import chunks, filters, graph, joins, popularity, rag, stats, vectors
from .plans.popular import curated_corpus as curated
from .plans.popular import popular_articles
from .sources import multistream, pageviews, sqldump, wikidump
from .sources.store import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# pageview lines and articles on the driver's tables


def _lines(spark, d):
    k = F.get_json_object("props", "$.k")
    return _read(spark, d, "events").select(F.col("event_type").alias("wiki_code"), F.concat(F.lit("Page_"), (F.col("user_id") % 200).cast("string")).alias("article_title"), F.when(k.cast("int") % 7 == 0, "null").otherwise(k).alias("page_id"), F.floor("value").cast("bigint").alias("views"), F.date_format("ts", "yyyyMM").alias("month"))


def _monthly(spark, d):
    return popularity.monthly_views(_lines(spark, d), "month")


def _articles(spark, d):
    i = F.col("doc_id")
    return _read(spark, d, "documents").select(i.alias("page_id"), F.concat(F.lit("Page "), (i % 300).cast("string")).alias("title"), T.word_count(F.col("text")).alias("word_count"), (i % 150).cast("int").alias("outlink_count"), (i % 5).cast("int").alias("category_count"), (i % 300).cast("int").alias("template_count"), "text")


def _views(spark, d):
    return popularity.views_by_title(_monthly(spark, d).withColumn("title_match", T.title_match(F.col("article_title"))))


def _keyed(spark, d):
    return _articles(spark, d).drop("text").withColumn("title_match", T.title_match(F.col("title")))


_CTE = r"""
WITH k AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events),
lines AS (SELECT event_type AS wiki_code, 'Page_' || CAST(user_id % 200 AS VARCHAR) AS article_title, CASE WHEN CAST(k AS INT) % 7 = 0 THEN 'null' ELSE k END AS page_id, CAST(floor(value) AS BIGINT) AS views, strftime(ts, '%Y%m') AS month FROM k),
monthly AS (SELECT month, wiki_code, article_title, CAST(sum(views) AS BIGINT) AS views, list_sort(list_distinct(list(page_id) FILTER (page_id IS NOT NULL))) AS page_ids FROM lines GROUP BY ALL),
views AS (SELECT lower(replace(article_title, '_', ' ')) AS title_match, CAST(sum(views) AS BIGINT) AS total_views, list_sort(list_distinct(flatten(list(page_ids)))) AS aggregated_page_ids FROM monthly GROUP BY 1),
articles AS (SELECT doc_id AS page_id, 'Page ' || CAST(doc_id % 300 AS VARCHAR) AS title, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INT) AS word_count, CAST(doc_id % 150 AS INT) AS outlink_count, CAST(doc_id % 5 AS INT) AS category_count, CAST(doc_id % 300 AS INT) AS template_count, text FROM documents),
keyed AS (SELECT * EXCLUDE (text), lower(replace(title, '_', ' ')) AS title_match FROM articles)
"""


@_query(
    _CTE
    + """, top AS (SELECT title_match, total_views, aggregated_page_ids FROM views ORDER BY total_views DESC, title_match LIMIT 150),
    ranked AS (SELECT k.*, t.total_views, t.aggregated_page_ids, percent_rank() OVER (ORDER BY t.total_views DESC) AS views_percentile, row_number() OVER (PARTITION BY k.title_match ORDER BY k.word_count DESC, k.page_id) AS rn
               FROM keyed k JOIN top t USING (title_match))
    SELECT page_id, title, word_count, title_match, total_views, array_to_string(aggregated_page_ids, ',') AS aggregated_page_ids,
           'https://en.wikipedia.org/w/index.php?curid=' || list_filter(aggregated_page_ids, lambda x: x <> 'null')[1] AS url_pageviews, round(views_percentile, 9) AS views_percentile, CAST(rn AS INT) AS rn FROM ranked WHERE rn = 1"""
)
def popular_articles_flagship(spark, d):
    out = popular_articles(_keyed(spark, d), _views(spark, d), 150)
    return out.select("page_id", "title", "word_count", "title_match", "total_views", F.array_join("aggregated_page_ids", ",").alias("aggregated_page_ids"), "url_pageviews", F.round("views_percentile", 9).alias("views_percentile"), "rn")


@_query(_CTE + "SELECT month, wiki_code, article_title, views, array_to_string(page_ids, ',') AS page_ids FROM monthly")
def pageviews_monthly_agg(spark, d):
    return _monthly(spark, d).withColumn("page_ids", F.array_join("page_ids", ","))


@_query(_CTE + "SELECT title_match, total_views, array_to_string(aggregated_page_ids, ',') AS aggregated_page_ids FROM views")
def pageviews_by_title_union_ids(spark, d):
    return _views(spark, d).withColumn("aggregated_page_ids", F.array_join("aggregated_page_ids", ","))


@_query(
    _CTE
    + """SELECT lower(trim(replace(article_title, '-', ''))) AS title_match, CAST(sum(views) AS BIGINT) AS total_views,
    array_to_string(list_sort(list_distinct(list('[' || array_to_string(page_ids, ', ') || ']'))), ',') AS aggregated_page_ids FROM monthly GROUP BY 1"""
)
def pageviews_listagg_distinct(spark, d):
    return popularity.views_by_title_listed(_monthly(spark, d).withColumn("title_match", T.title_match_hyphen(F.col("article_title"))))


@_query(_CTE + "SELECT wiki_code, article_title, CAST(sum(views) AS BIGINT) AS views, coalesce(array_to_string(list_sort(list_distinct(list(page_id) FILTER (page_id <> 'null'))), ','), '') AS page_ids FROM lines GROUP BY ALL")
def ids_non_null(spark, d):
    return popularity.views_without_sentinel(_lines(spark, d)).withColumn("page_ids", F.array_join("page_ids", ","))


@_query(
    _CTE
    + """SELECT k.page_id, v.total_views, round((rank() OVER (ORDER BY v.total_views) + (count(*) OVER (PARTITION BY v.total_views) - 1) / 2.0) / (SELECT count(*) FROM keyed k2 JOIN views v2 USING (title_match)), 9) AS percentile
    FROM keyed k JOIN views v USING (title_match) UNION ALL SELECT k.page_id, NULL, NULL FROM keyed k ANTI JOIN views v USING (title_match)"""
)
def views_percentile_avg_rank(spark, d):
    merged = joins.merge_views(_keyed(spark, d), _views(spark, d)).select("page_id", "total_views")
    return popularity.average_percent_rank(merged, "total_views", "percentile").withColumn("percentile", F.round("percentile", 9))


@_query(_CTE + "SELECT k.page_id, v.total_views, round(percent_rank() OVER (ORDER BY v.total_views DESC), 9) AS views_percentile FROM keyed k JOIN views v USING (title_match)")
def views_percent_rank_scalable(spark, d):
    merged = joins.merge_views(_keyed(spark, d), _views(spark, d), how="inner").select("page_id", "total_views")
    return popularity.percent_rank_scalable(merged, "total_views", "views_percentile").withColumn("views_percentile", F.round("views_percentile", 9))


@_query("SELECT * FROM (SELECT lang, source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS INT) AS rn FROM documents) WHERE rn = 1")
def longest_per_key(spark, d):
    return popularity.first_per_key(_read(spark, d, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], F.desc("n_chars"), F.col("doc_id"))


@_query(_CTE + "SELECT page_id, title, word_count FROM keyed WHERE word_count > 50 ORDER BY word_count DESC, page_id LIMIT 200")
def top_n_then_filter(spark, d):
    return _keyed(spark, d).select("page_id", "title", "word_count").where("word_count > 50").orderBy(F.desc("word_count"), "page_id").limit(200)


@_query(_CTE + "SELECT title_match, total_views FROM views ORDER BY total_views DESC, title_match LIMIT 100")
def top_titles(spark, d):
    return popularity.top_titles(_views(spark, d).select("title_match", "total_views"), 100)


@_query(_CTE + "SELECT k.page_id, k.title_match, v.total_views FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title_match ORDER BY word_count DESC, page_id) AS rn FROM keyed) WHERE rn = 1) k LEFT JOIN views v USING (title_match)")
def left_merge_views(spark, d):
    one = popularity.first_per_key(_keyed(spark, d), ["title_match"], F.desc("word_count"), F.col("page_id"))
    return joins.merge_views(one, _views(spark, d)).select("page_id", "title_match", "total_views")


@_query(_CTE + "SELECT k.page_id, k.title_match, m.month, m.wiki_code, m.views FROM keyed k LEFT JOIN (SELECT *, lower(replace(article_title, '_', ' ')) AS title_match FROM monthly) m USING (title_match)")
def fanout_merge(spark, d):
    m = _monthly(spark, d).withColumn("title_match", T.title_match(F.col("article_title"))).select("title_match", "month", "wiki_code", "views")
    return joins.merge_views(_keyed(spark, d).select("page_id", "title_match"), m).select("page_id", "title_match", "month", "wiki_code", "views")


@_query(_CTE + "SELECT page_id, title_match FROM keyed WHERE title_match NOT IN (SELECT title_match FROM views)")
def unmatched_titles(spark, d):
    return joins.unmatched(_keyed(spark, d).select("page_id", "title_match"), _views(spark, d), "title_match")


@_query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def matched_ids_semi(spark, d):
    return joins.matched(_read(spark, d, "documents").select("doc_id", "lang"), _read(spark, d, "labels"), "doc_id")


@_query(_CTE + "SELECT title_match, total_views FROM views WHERE list_has_any(aggregated_page_ids, (SELECT list(CAST(p_size AS VARCHAR)) FROM part WHERE p_size <= 3))")
def array_overlap_semi(spark, d):
    ids = _read(spark, d, "part").where("p_size <= 3").select(F.col("p_size").cast("string").alias("page_id"))
    return joins.any_id_in(_views(spark, d), ids, "title_match", "aggregated_page_ids").select("title_match", "total_views")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R')")
def pending_chunks(spark, d):
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("title_match"), F.col("l_linenumber").alias("chunk_idx"), "l_returnflag")
    return joins.pending_chunks(rows, rows.where("l_returnflag = 'R'")).select(F.col("title_match").alias("l_orderkey"), F.col("chunk_idx").alias("l_linenumber"))


_OPTIONS = filters.FilterOptions(60, 120, 250, 100, 3, ["Page 1"])
_KEEP = "NOT starts_with(title, 'Page 1') AND (coalesce(total_views >= 60, false) OR category_count >= 3 OR (word_count >= 120 AND template_count <= 250 AND outlink_count <= 100))"


def _filtered(spark, d):
    return filters.filter_articles(joins.merge_views(_keyed(spark, d), _views(spark, d)).withColumnRenamed("total_views", "views"), _OPTIONS)


@_query(_CTE + f"SELECT page_id, title, total_views AS views FROM keyed LEFT JOIN views USING (title_match) WHERE {_KEEP}")
def article_filter_kept(spark, d):
    return _filtered(spark, d)[0].select("page_id", "title", "views")


@_query(_CTE + f"SELECT title_match FROM keyed EXCEPT SELECT title_match FROM keyed LEFT JOIN views USING (title_match) WHERE {_KEEP}")
def article_filter_discarded(spark, d):
    return _filtered(spark, d)[1]


@_query("SELECT p_partkey, p_type FROM part WHERE NOT (starts_with(p_type, 'PROMO') OR starts_with(p_type, 'STANDARD'))")
def prefix_filter(spark, d):
    return filters.without_prefixes(_read(spark, d, "part").select("p_partkey", "p_type"), ["PROMO", "STANDARD"], "p_type")


@_query(_CTE + "SELECT page_id, word_count FROM keyed WHERE word_count BETWEEN 100 AND 200")
def word_count_between(spark, d):
    return _keyed(spark, d).select("page_id", "word_count").where(F.col("word_count").between(100, 200))


@_query(_CTE + "SELECT count_if(total_views IS NULL) AS missing, count_if(total_views IS NOT NULL) AS known FROM keyed LEFT JOIN views USING (title_match)")
def null_counts(spark, d):
    return joins.merge_views(_keyed(spark, d), _views(spark, d)).agg(F.count_if(F.col("total_views").isNull()).alias("missing"), F.count_if(F.col("total_views").isNotNull()).alias("known"))


@_query(_CTE + "SELECT month, wiki_code, article_title FROM monthly WHERE page_ids <> ['null']")
def sentinel_rows_dropped(spark, d):
    return _monthly(spark, d).where(~filters.only_sentinel_ids(F.col("page_ids"))).select("month", "wiki_code", "article_title")


@_query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\bthe\\b')")
def contains_any_case(spark, d):
    return _read(spark, d, "documents").where(filters.contains(F.col("text"), r"\bthe\b")).select("doc_id")


@_query("SELECT split_part(concat(event_type, ':', user_id), ':', 1) AS prefix, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, prefix LIMIT 25")
def prefix_histogram(spark, d):
    return stats.prefix_histogram(_read(spark, d, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("title")))


@_query(_CTE + "SELECT page_id, count(*) AS n_titles, CAST(sum(views) AS BIGINT) AS views, array_to_string(list_sort(list(month || '/' || wiki_code || '/' || article_title || '/' || CAST(views AS VARCHAR))), ',') AS titles FROM (SELECT month, wiki_code, article_title, views, unnest(page_ids) AS page_id FROM monthly) WHERE page_id <> 'null' GROUP BY 1")
def page_id_inversion(spark, d):
    m = _monthly(spark, d).withColumn("wiki_code", F.concat_ws("/", "month", "wiki_code"))
    named = F.transform("titles", lambda t: F.concat_ws("/", t["wiki_code"], t["article_title"], t["views"].cast("string")))
    total = F.aggregate("titles", F.lit(0).cast("long"), lambda s, t: s + t["views"])
    return stats.invert_page_ids(m).select("page_id", F.size("titles").cast("long").alias("n_titles"), total.alias("views"), F.array_join(F.array_sort(named), ",").alias("titles"))


@_query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def value_counts(spark, d):
    return stats.value_counts(_read(spark, d, "documents"), "source")


@_query("SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, CAST(min(n_chars) AS DOUBLE) AS min, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.75) AS q75, CAST(max(n_chars) AS DOUBLE) AS max FROM documents")
def describe_exact(spark, d):
    return stats.describe(_read(spark, d, "documents"), "n_chars").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@_query("SELECT p_size, round(avg(p_retailprice), 6) AS mean, round(median(p_retailprice), 6) AS median, max(p_retailprice) AS max, min(p_retailprice) AS min, count(*) AS n FROM part GROUP BY 1")
def views_group_stats(spark, d):
    return stats.group_stats(_read(spark, d, "part"), "p_size", "p_retailprice").withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


@_query("SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS mean, list_max(embedding) AS most, list_min(embedding) AS least, round(list_median(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS median, round(list_stddev_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS std FROM embeddings")
def chunk_array_stats(spark, d):
    v = _read(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return stats.array_stats(v, "vec_id", "v").select("vec_id", F.round("mean", 6).alias("mean"), F.col("most").cast("float").alias("most"), F.col("least").cast("float").alias("least"), F.round("median", 6).alias("median"), F.round("std", 6).alias("std"))


_LINES = r"(SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS parts FROM documents)"


def _line_chunks(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: x != "").alias("split_text"))
    return docs.withColumn("n_words_per_chunk", F.transform("split_text", T.word_count))


_WC = r"len(list_filter(regexp_split_to_array(c, '\s+'), lambda w: w <> ''))"


@_query(f"SELECT doc_id, CAST(pos - 1 AS INT) AS place, CAST(words AS INT) AS words, md5(c) AS chunk_md5 FROM (SELECT doc_id, c, pos, {_WC} AS words FROM (SELECT doc_id, unnest(parts) AS c, generate_subscripts(parts, 1) AS pos FROM {_LINES})) ORDER BY words DESC, doc_id, pos LIMIT 1")
def longest_chunk(spark, d):
    return stats.longest_chunk(_line_chunks(spark, d), "doc_id", "split_text", "n_words_per_chunk").select("doc_id", "place", "words", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@_query(f"SELECT doc_id, CAST(pos - 1 AS INT) AS place, CAST(words AS INT) AS words FROM (SELECT doc_id, pos, {_WC} AS words FROM (SELECT doc_id, unnest(parts) AS c, generate_subscripts(parts, 1) AS pos FROM {_LINES})) WHERE words < 20 ORDER BY doc_id, pos LIMIT 1")
def first_short_chunk(spark, d):
    return stats.first_short_chunk(_line_chunks(spark, d), "doc_id", "n_words_per_chunk", 20)


@_query(f"SELECT doc_id, CAST(min(pos) - 1 AS INT) AS place FROM (SELECT doc_id, pos, {_WC} AS words FROM (SELECT doc_id, unnest(parts) AS c, generate_subscripts(parts, 1) AS pos FROM {_LINES})) WHERE words = 12 GROUP BY doc_id")
def first_chunk_of_words(spark, d):
    return stats.first_chunk_of(_line_chunks(spark, d), "doc_id", "n_words_per_chunk", 12)


@_query(f"SELECT doc_id, CAST(min({_WC}) AS INT) AS least, CAST(max({_WC}) AS INT) AS most FROM (SELECT doc_id, unnest(parts) AS c FROM {_LINES}) GROUP BY 1")
def chunk_extremes(spark, d):
    return stats.extremes(_line_chunks(spark, d), "doc_id", "n_words_per_chunk")


@_query(f"SELECT CAST(sum({_WC}) AS BIGINT) AS total FROM (SELECT unnest(parts) AS c FROM {_LINES})")
def total_chunk_words(spark, d):
    return stats.total_of_arrays(_line_chunks(spark, d), "n_words_per_chunk")


@_query("SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 100.0)), 99) AS INT) AS bin, count(*) AS n FROM documents, (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) GROUP BY 1")
def histogram_bins(spark, d):
    return stats.histogram(_read(spark, d, "documents"), "n_chars", 100)


@_query(_CTE + "SELECT (SELECT count(DISTINCT title_match) FROM keyed) AS n_a, (SELECT count(*) FROM views) AS n_b, (SELECT count(*) FROM (SELECT title_match FROM keyed INTERSECT SELECT title_match FROM views)) AS n_both, (SELECT count(*) FROM (SELECT title_match FROM keyed EXCEPT SELECT title_match FROM views)) AS n_only_a")
def title_overlap_counts(spark, d):
    return stats.overlap_counts(_keyed(spark, d), _views(spark, d), "title_match")


@_query("SELECT dim, round(a * dim * 4 / 1073741824, 9) AS gb_documents, round(b * dim * 4 / 1073741824, 9) AS gb_events FROM (VALUES (384), (768), (1024), (1536)) t(dim), (SELECT (SELECT count(*) FROM documents) AS a, (SELECT count(*) FROM events) AS b)")
def size_grid_pivot(spark, d):
    """GB of the vectors that all rows of two tables would make, by dimension."""
    dims = spark.createDataFrame([(x,) for x in (384, 768, 1024, 1536)], "dim long")
    count = lambda t: _read(spark, d, t).agg(F.count("*").alias("n_vectors")).select(F.lit(f"gb_{t}").alias("name"), "n_vectors")
    return joins.size_grid(dims, count("documents").unionByName(count("events"))).groupBy("dim").pivot("name", ["gb_documents", "gb_events"]).agg(F.round(F.first("gb"), 9))


@_query(_CTE + "SELECT CAST(sum(word_count) AS BIGINT) AS words, round(sum(word_count) * 1.35 / 1e6 * 0.008, 9) AS cost FROM keyed")
def embedding_cost(spark, d):
    return _keyed(spark, d).agg(F.sum("word_count").alias("words")).select("words", F.round(stats.embedding_cost(F.col("words"), 0.008), 9).alias("cost"))


@_query("SELECT 'https://dumps.example.org/' || strftime(m, '%Y') || '/' || strftime(m, '%Y-%m') || '/pageviews-' || strftime(m, '%Y%m') || '-user.bz2' AS url FROM (SELECT unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), INTERVAL 1 MONTH)) AS m FROM events)")
def month_urls(spark, d):
    """The files that cover the months of all events."""
    return pageviews.urls_of_months(_read(spark, d, "events"), "ts", "https://dumps.example.org")


@_query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1")
def duplicate_rows(spark, d):
    return popularity.later_duplicates(_read(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], F.col("doc_id"))


@_query(r"SELECT p_partkey, regexp_replace(replace(lower(trim(p_name)), ' ', '_'), '[^a-z0-9_-]', '', 'g') AS title_normalized, concat_ws('_', regexp_replace(replace(lower(trim(p_name)), ' ', '_'), '[^a-z0-9_-]', '', 'g'), CAST(p_size AS VARCHAR)) AS vector_id FROM part")
def title_normalized_ids(spark, d):
    return _read(spark, d, "part").select("p_partkey", T.title_normalized(F.col("p_name")).alias("title_normalized"), T.vector_id(F.col("p_name"), F.col("p_size")).alias("vector_id"))


@_query("SELECT page_id, md5(CAST(page_id AS VARCHAR) || url) AS source_id, md5(CAST(page_id AS VARCHAR) || url) || '#0' AS chunk_id FROM pages")
def source_ids_md5(spark, d):
    title = F.col("page_id").cast("string")
    return _read(spark, d, "pages").select("page_id", T.source_id(title, F.col("url")).alias("source_id"), T.chunk_id(title, F.col("url"), F.lit(0)).alias("chunk_id"))


@_query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INT) AS words, CAST(len(string_split(text, ' ')) AS INT) AS parts FROM documents")
def word_counts(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), T.single_space_count(F.col("text")).alias("parts"))


_WS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{3,}}', ' ', 'g'), '\t{{3,}}', chr(9), 'g'), '[ \t]*\n[ \t]*', chr(10), 'g')"


@_query("SELECT page_id, md5(" + _WS.format("html") + ") AS cleaned FROM pages")
def whitespace_normalize(spark, d):
    return _read(spark, d, "pages").select("page_id", F.md5(T.normalize_whitespace(F.col("html")).cast("binary")).alias("cleaned"))


@_query(r"SELECT page_id, md5(replace(regexp_replace(regexp_replace(html, '\n{3,}', chr(10) || chr(10), 'g'), '\t{2,}', chr(9), 'g'), chr(13), '')) AS cleaned FROM pages")
def scraped_cleanup(spark, d):
    return _read(spark, d, "pages").select("page_id", F.md5(T.clean_scraped(F.col("html")).cast("binary")).alias("cleaned"))


@_query("SELECT page_id, 'https://is.wikipedia.org/wiki/' || replace(url_encode(replace(title, ' ', '_')), '%2F', '/') AS url FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)")
def url_encode(spark, d):
    return _read(spark, d, "pages").select("page_id", T.article_url_quoted(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "is").alias("url"))


@_query()
def html_text_of_pages(spark, d):
    html_text.bound_batches(spark)
    return _read(spark, d, "pages").select("page_id", html_text.html_text_column(F.col("html")).alias("text"))


@_query()
def html_main_article(spark, d):
    html_text.bound_batches(spark)
    marked = F.regexp_replace("html", "<article>", '<article id="main">')
    return _read(spark, d, "pages").select("page_id", html_text.main_article_column(marked, "main").alias("text"))


@_query("""SELECT page_id, a AS url FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS a FROM pages)""")
def html_links(spark, d):
    html_text.bound_batches(spark)
    return _read(spark, d, "pages").select("page_id", F.explode(html_text.links_column(F.col("html"))).alias("a")).select("page_id", F.col("a.url").alias("url"))


@_query(r"SELECT doc_id, CAST(len(links) AS INT) AS outlinks, array_to_string(links, ',') AS targets FROM (SELECT doc_id, regexp_extract_all(w, '\[\[([^|\]]+)', 1) AS links FROM (SELECT doc_id, '[[' || lang || '|the language]] and [[' || source || ']] ' || text AS w FROM documents))")
def outlinks_regex(spark, d):
    w = F.concat(F.lit("[["), "lang", F.lit("|the language]] and [["), "source", F.lit("]] "), "text")
    return _read(spark, d, "documents").select("doc_id", T.link_targets(w).alias("l")).select("doc_id", F.size("l").alias("outlinks"), F.array_join("l", ",").alias("targets"))


_LINKED = "(SELECT doc_id, '[[' || lang || '|the language]] [[Category: ' || source || '|' || doc_id || ']] [[Category:' || lang || ' ]] ' || text AS w FROM documents)"


@_query(
    r"""SELECT doc_id, array_to_string(regexp_extract_all(w, '\[\[Category:(.*?)\]\]', 1), '#') AS with_keys, array_to_string(c, '|') AS categories, CAST(len(c) AS INT) AS n_categories
    FROM (SELECT *, list_transform(list_filter(regexp_extract_all(w, '\[\[([^|\]]+)', 1), lambda x: starts_with(x, 'Category:')), lambda x: trim(substr(x, 10))) AS c FROM """
    + _LINKED
    + ")"
)
def category_links(spark, d):
    """Category links by pattern, with their sort keys, and the categories among the links' titles."""
    w = F.concat(F.lit("[["), "lang", F.lit("|the language]] [[Category: "), "source", F.lit("|"), F.col("doc_id").cast("string"), F.lit("]] [[Category:"), "lang", F.lit(" ]] "), "text")
    found = _read(spark, d, "documents").select("doc_id", T.category_bodies(w).alias("b"), T.categories_of_links(T.link_targets(w)).alias("c"))
    return found.select("doc_id", F.array_join("b", "#").alias("with_keys"), T.joined(F.col("c")).alias("categories"), F.size("c").alias("n_categories"))


@_query("SELECT string_split(url, '/')[-2] AS folder, count(*) AS n, count(DISTINCT url) AS urls FROM pages GROUP BY 1")
def folders_of_paths(spark, d):
    """The last folder of each page's address, as languages stand in the paths of dumps."""
    return _read(spark, d, "pages").groupBy(T.path_language(F.col("url")).alias("folder")).agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


@_query(r"SELECT doc_id, length(t) AS n, sha256(t) AS text_sha256 FROM (SELECT doc_id, regexp_replace(chr(9) || ' ' || text || chr(13) || chr(10), '^\s+|\s+$', '', 'g') AS t FROM documents)")
def stripped_articles(spark, d):
    """Articles without white space at their ends, as they are before they are cut into chunks."""
    t = T.strip(F.concat(F.lit("\t "), "text", F.lit("\r\n")))
    return _read(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))


@_query()
def split_text_chunks(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", splitter.split_text(F.col("text"), popularity.random_chunk_size(F.col("doc_id")), 300, 12, True, False, 45).alias("c"))
    return docs.select("doc_id", F.posexplode("c").alias("chunk_idx", "chunk_text"))


@_query(
    rf"""WITH c AS (SELECT doc_id, unnest(parts) AS c, generate_subscripts(parts, 1) AS pos FROM {_LINES}),
    placed AS (SELECT doc_id, c, pos, sum(CASE WHEN {_WC} >= 45 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS long FROM c),
    runs AS (SELECT doc_id, long, string_agg(c, ' ' ORDER BY pos) AS run FROM placed GROUP BY doc_id, long)
    SELECT doc_id, CAST(greatest(long, 1) - 1 AS INT) AS chunk_idx, string_agg(CASE WHEN long = 0 THEN regexp_replace(run, '^\s+|\s+$', '', 'g') ELSE run END, ' ' ORDER BY long) AS chunk_text FROM runs GROUP BY doc_id, greatest(long, 1)"""
)
def combine_short_chunks(spark, d):
    return _line_chunks(spark, d).select("doc_id", F.posexplode(splitter.combine_short(F.col("split_text"), 45)).alias("chunk_idx", "chunk_text"))


@_query()
def create_chunks(spark, d):
    pages = _read(spark, d, "pages").select(F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), "url", F.col("html").alias("text"))
    return chunks.create_chunks(pages, "icelandic", "is-index", "pages").drop("vector")


@_query()
def prefix_chunks(spark, d):
    articles = _articles(spark, d).withColumns({"title_match": T.title_match(F.col("title")), "url": T.article_url(F.col("title"))})
    return chunks.prepare_chunks(chunks.chunk_articles(articles, "text", popularity.random_chunk_size(F.col("title_match"))))


@_query(_CTE + "SELECT page_id, 'This is text from the wikipedia article with title: ''' || title || '''' || chr(10) || text AS chunk_text FROM articles")
def chunk_prefix(spark, d):
    return _articles(spark, d).select("page_id", T.with_chunk_prefix(F.col("title"), F.col("text")).alias("chunk_text"))


def _vectors(spark, d):
    return _read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), F.col("label").cast("string").alias("namespace"))


_V = "e AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@_query(f"WITH {_V}, q AS (SELECT v AS qv FROM e WHERE id = '0') SELECT id, round(list_cosine_similarity(v, qv), 5) AS score FROM e, q ORDER BY list_cosine_similarity(v, qv) DESC, id LIMIT 5")
def vector_topk_single(spark, d):
    first = _read(spark, d, "embeddings").where("vec_id = 0").first()
    return vectors.search_one(list(first.embedding), _vectors(spark, d), 5).withColumn("score", F.round("score", 5))


@_query(f"WITH {_V}, q AS (SELECT vec_id AS qid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS qv FROM embeddings WHERE vec_id % 100 = 0) SELECT qid, id, round(s, 5) AS score, CAST(rank AS INT) AS rank FROM (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM (SELECT qid, id, list_cosine_similarity(v, qv) AS s FROM e, q)) WHERE rank <= 5")
def vector_topk_batch(spark, d):
    q = _read(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return vectors.search(q, _vectors(spark, d), 5).select("qid", "id", F.round("score", 5).alias("score"), "rank")


@_query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 UNION ALL SELECT c_custkey, 0, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def vector_upsert_last_wins(spark, d):
    existing = _read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(0).cast("long").alias("o_orderkey"), F.col("c_acctbal").alias("o_totalprice"))
    new = _read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return vectors.upsert(existing, new, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@_query(
    r"""WITH s AS (SELECT conv_id, turn, chr(10) || '        ```' || chr(10) || '        source_id: ' || CAST(turn AS VARCHAR) || chr(10) || '        source_text: ' || text || chr(10) || '        ```' || chr(10) || '        ' AS block FROM conversations WHERE role <> 'user'),
    q AS (SELECT conv_id, min_by(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1)
    SELECT q.conv_id AS qid, md5(chr(10) || 'You will be given a message from a user and a list of sources, ' || chr(10) || 'that may be relevant to answering the question.' || chr(10) || 'Your job is to answer the question.' || chr(10) || chr(10) || 'Here is the question:' || chr(10) || question || chr(10) || chr(10) || 'Sources:' || chr(10) || coalesce(b.blocks, '') || chr(10)) AS prompt
    FROM q LEFT JOIN (SELECT conv_id, string_agg(block, chr(10) || chr(10) ORDER BY turn, block) AS blocks FROM s GROUP BY 1) b USING (conv_id)"""
)
def rag_prompt(spark, d):
    c = _read(spark, d, "conversations")
    hits = c.where("role <> 'user'").select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), F.col("turn").cast("string").alias("id"), F.col("text").alias("chunk_text"))
    questions = c.where("role = 'user'").groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias("question"))
    return rag.prompts(hits, questions).withColumn("prompt", F.md5(F.col("prompt").cast("binary")))


@_query("SELECT conv_id, turn, conv_id % 7 > 4 AS whole, CASE WHEN conv_id % 7 > 4 THEN text END AS response, CASE WHEN conv_id % 7 > 4 THEN CAST(turn AS VARCHAR) END AS source_ids, CASE WHEN conv_id % 7 > 4 THEN 1 END AS n_spans FROM conversations")
def parse_llm_json(spark, d):
    """Answers of which most are broken: cut off, prose, without a field, in a code fence, or with a field of another type; those have no fields."""
    source, spans = F.array(F.col("turn").cast("string")), F.array(F.create_map(F.col("turn").cast("string"), F.lit("x")))
    whole = F.to_json(F.struct(F.col("text").alias("response"), source.alias("source_ids"), spans.alias("highlighted_response")))
    lacks = F.to_json(F.struct(F.col("text").alias("response"), spans.alias("highlighted_response")))
    other = F.to_json(F.struct(F.col("text").alias("response"), F.lit("x").alias("source_ids"), spans.alias("highlighted_response")))
    kinds = [F.expr("left(made, length(made) - 1)"), F.concat(F.lit("Sorry: "), "text"), F.col("lacks"), F.concat(F.lit("```json\n"), "made", F.lit("\n```")), F.col("other")]
    answer = F.col("made")
    for i, kind in enumerate(kinds):
        answer = F.when(F.col("conv_id") % 7 == i, kind).otherwise(answer)
    rows = _read(spark, d, "conversations").withColumns({"made": whole, "lacks": lacks, "other": other}).select("conv_id", "turn", rag.parse_response(answer, strict=False).alias("a"))
    return rows.select("conv_id", "turn", F.col("a").isNotNull().alias("whole"), "a.response", F.array_join("a.source_ids", ",").alias("source_ids"), F.size("a.highlighted_response").alias("n_spans"))


@_query("SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def cited_chunks(spark, d):
    answers = _read(spark, d, "labels").where("toxic = 1").select(F.array(F.col("doc_id").cast("string")).alias("source_ids"))
    return joins.cited_chunks(answers, _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang"))


@_query("SELECT conv_id, turn, md5(replace(text, 'the', '<mark title=\"' || CASE WHEN role = 'user' THEN 'A' ELSE 'Unknown' END || '\">the [' || role || ']</mark>')) AS marked FROM conversations")
def highlight_response(spark, d):
    names = F.create_map(F.lit("user"), F.lit("A"))
    return _read(spark, d, "conversations").select("conv_id", "turn", F.md5(rag.highlight(F.col("text"), F.array(F.create_map("role", F.lit("the"))), names).cast("binary")).alias("marked"))


@_query("SELECT e.doc_id AS id, coalesce(CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END, 'Unknown') AS source FROM documents e LEFT JOIN labels l USING (doc_id)")
def citation_names(spark, d):
    sources = _read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("source"))
    return joins.with_source_names(_read(spark, d, "documents").select(F.col("doc_id").alias("id")), sources)


@_query(
    """SELECT d.doc_id AS id, coalesce(s.role, 'Unknown') AS source FROM documents d
    LEFT JOIN (SELECT conv_id, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST) = 1) s ON d.doc_id = s.conv_id"""
)
def citation_names_in_order(spark, d):
    sources = _read(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("ord"), F.col("role").alias("source"))
    return joins.with_source_names(_read(spark, d, "documents").select(F.col("doc_id").alias("id")), sources)


_EDGES = "edges AS (SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS src, 's' || CAST(l_partkey % 97 AS VARCHAR) AS dst FROM lineitem)"


def _edges(spark, d):
    node = lambda c: F.concat(F.lit("s"), c.cast("string"))
    return graph.link_edges(_read(spark, d, "lineitem").select(node(F.col("l_suppkey")).alias("t"), F.array(node(F.col("l_partkey") % 97)).alias("l")), "t", "l")


@_query(f"WITH {_EDGES}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), c AS (SELECT count(*) AS n FROM n) SELECT node, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, round(coalesce(i, 0) / (c.n - 1), 9) AS in_centrality, round(coalesce(o, 0) / (c.n - 1), 9) AS out_centrality FROM n LEFT JOIN (SELECT dst AS node, count(*) AS i FROM edges GROUP BY 1) USING (node) LEFT JOIN (SELECT src AS node, count(*) AS o FROM edges GROUP BY 1) USING (node), c")
def degree_centrality(spark, d):
    out = graph.degree_centrality(_edges(spark, d))
    return out.withColumns({c: F.round(c, 9) for c in ("in_centrality", "out_centrality")})


@_query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")
def graph_counts(spark, d):
    return graph.graph_counts(_edges(spark, d))


_RANK0 = f"WITH {_EDGES}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes), links AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS out FROM edges), r0 AS (SELECT node, 1 / n AS rank FROM nodes, c)"
_STEP = ", r{0} AS (SELECT x.node, (0.15 + 0.85 * coalesce((SELECT sum(rank) FROM r{1} WHERE node NOT IN (SELECT src FROM edges)), 0)) / c.n + 0.85 * coalesce(g.got, 0) AS rank FROM c, r{1} x LEFT JOIN (SELECT dst, sum(rank / out) AS got FROM links JOIN r{1} ON src = node GROUP BY dst) g ON g.dst = x.node)"


@_query(_RANK0 + "".join(_STEP.format(i + 1, i) for i in range(3)) + " SELECT node, round(rank, 9) AS rank FROM r3")
def pagerank_fixed_iters(spark, d):
    return graph.pagerank(_edges(spark, d), fixed=3).withColumn("rank", F.round("rank", 9))


# rounds until nothing changes in the digits that are shown
_RANKS = f"""WITH RECURSIVE {_EDGES}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes), links AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS out FROM edges),
    r(i, node, rank) AS (SELECT 0, node, 1 / n FROM nodes, c UNION ALL
        SELECT i + 1, x.node, (0.15 + 0.85 * held) / c.n + 0.85 * coalesce(g.got, 0) FROM c, r x LEFT JOIN (SELECT dst, sum(rank / out) AS got FROM links JOIN r ON src = node GROUP BY dst) g ON g.dst = x.node,
             (SELECT coalesce(sum(rank), 0) AS held FROM r WHERE node NOT IN (SELECT src FROM edges)) WHERE i < 100),
    last AS (SELECT node, round(rank, 8) AS rank FROM r WHERE i = 100)"""


@_query()
def pagerank_converged(spark, d):
    return graph.pagerank(_edges(spark, d)).withColumn("rank", F.round("rank", 9))


_REACH = f"WITH RECURSIVE {_EDGES}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"


@_query(
    _REACH
    + """, far AS (SELECT src, dst FROM edges UNION SELECT far.src, edges.dst FROM far JOIN edges ON edges.src = far.dst),
    mutual AS (SELECT a.src AS node, a.dst AS other FROM far a JOIN far b ON a.src = b.dst AND a.dst = b.src UNION SELECT node, node FROM nodes)
    SELECT max(n) AS size FROM (SELECT count(*) AS n FROM mutual GROUP BY node)"""
)
def largest_scc(spark, d):
    return graph.largest_strong_component(_edges(spark, d))


@_query(
    _REACH
    + """, ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    far AS (SELECT node AS a, node AS b FROM nodes UNION SELECT far.a, ways.b FROM far JOIN ways ON ways.a = far.b)
    SELECT a AS node, min(b) AS component FROM far GROUP BY a"""
)
def link_components(spark, d):
    return graph.weak_components(_edges(spark, d))


@_query(f"WITH {_EDGES}, top AS (SELECT dst AS node FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20) SELECT src, dst FROM edges WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)")
def induced_subgraph(spark, d):
    edges = _edges(spark, d)
    top = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(20).select("node")
    return graph.induced(edges, top)


@_query("SELECT event_id, CAST(user_id % 24 + 1 AS INT) AS slot, CAST(floor(abs(value)) AS INT) AS views FROM events")
def hourly_decode(spark, d):
    code = F.concat(F.char((F.col("user_id") % 24 + 65).cast("long")), F.floor(F.abs("value")).cast("string"))
    rows = _read(spark, d, "events").select("event_id", F.explode(T.symbol_counts(code)).alias("s"))
    return rows.select("event_id", "s.slot", "s.views")


@_query(_CTE + "SELECT title_match FROM keyed INTERSECT SELECT title_match FROM views")
def title_intersection(spark, d):
    return _keyed(spark, d).select("title_match").intersect(_views(spark, d).select("title_match"))


@_query("SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, 'label' FROM labels")
def union_by_name(spark, d):
    return _read(spark, d, "documents").select("doc_id", "lang").unionByName(_read(spark, d, "labels").select(F.lit("label").alias("lang"), "doc_id"))


@_query("SELECT event_type AS wiki_code, split_part(event_type || '.wikipedia', '.', 1) AS lang, count(*) AS n FROM events GROUP BY 1")
def wiki_languages(spark, d):
    return _read(spark, d, "events").groupBy(F.col("event_type").alias("wiki_code")).agg(F.count("*").alias("n")).withColumn("lang", T.wiki_language(F.concat("wiki_code", F.lit(".wikipedia"))))


@_query("SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT doc_id) AS docs FROM documents")
def distinct_counts(spark, d):
    return _read(spark, d, "documents").agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.countDistinct("doc_id").alias("docs"))


@_query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 1000) AS BIGINT) AS batch FROM documents")
def article_batches(spark, d):
    return popularity.batches(_read(spark, d, "documents").select("doc_id"), "doc_id", 1000)


@_query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1 OFFSET 10")
def row_at_place(spark, d):
    return popularity.row_at(_read(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 10)


@_query(
    f"""WITH c AS (SELECT doc_id, c, pos, len(string_split(c, ' ')) < 10 AS short FROM (SELECT doc_id, unnest(parts) AS c, generate_subscripts(parts, 1) AS pos FROM {_LINES})),
    placed AS (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS place, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id) AS long FROM c)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INT) AS run, joined
    FROM (SELECT doc_id, place, string_agg(c, ' | ' ORDER BY pos) AS joined FROM placed WHERE short AND place < long GROUP BY doc_id, place)"""
)
def short_chunk_runs(spark, d):
    return stats.short_runs(_line_chunks(spark, d), "doc_id", "split_text", 10)


@_query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS idx FROM conversations")
def enumerate_chunks(spark, d):
    return rag.numbered(_read(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@_query("SELECT (SELECT count(*) FROM labels) AS chunks_done, (SELECT count(DISTINCT doc_id) FROM labels) AS articles_done, round((SELECT count(*) FROM labels) / (SELECT count(*) FROM documents), 9) AS chunk_share, round((SELECT count(DISTINCT doc_id) FROM labels) / (SELECT count(*) FROM documents), 9) AS article_share")
def embedding_progress(spark, d):
    out = stats.progress(_read(spark, d, "labels").withColumnRenamed("doc_id", "title_match"), _read(spark, d, "documents").withColumnRenamed("doc_id", "title_match"))
    return out.withColumns({c: F.round(c, 9) for c in ("chunk_share", "article_share")})


@_query(
    _CTE
    + """, top AS (SELECT title_match, total_views FROM views ORDER BY total_views DESC, title_match LIMIT 150),
    ranked AS (SELECT k.page_id, k.word_count, title_match, t.total_views, row_number() OVER (PARTITION BY title_match ORDER BY k.word_count DESC, k.page_id) AS rn FROM keyed k JOIN top t USING (title_match))
    SELECT page_id, word_count, title_match, total_views FROM ranked WHERE rn = 1 AND word_count > 50 ORDER BY total_views DESC, title_match LIMIT 60"""
)
def curated_corpus(spark, d):
    return curated(_keyed(spark, d), _views(spark, d), 150, 60).select("page_id", "word_count", "title_match", "total_views")


@_query(_CTE + "SELECT page_id, title, template_count FROM keyed ORDER BY template_count DESC, page_id LIMIT 50")
def top_template_counts(spark, d):
    return stats.leading(_keyed(spark, d), 50, F.desc("template_count"), F.col("page_id")).select("page_id", "title", "template_count")


@_query(_CTE + "SELECT page_id, title, outlink_count FROM keyed ORDER BY outlink_count DESC, page_id LIMIT 75")
def top_outlink_counts(spark, d):
    return stats.leading(_keyed(spark, d), 75, F.desc("outlink_count"), F.col("page_id")).select("page_id", "title", "outlink_count")


_CHUNK_SIZES = f"sizes AS (SELECT doc_id, count(*) AS n_chunks, min({_WC}) AS least, max({_WC}) AS most, sum({_WC}) AS words FROM (SELECT doc_id, unnest(parts) AS c FROM {_LINES}) GROUP BY 1)"


def _chunk_sizes(spark, d):
    return stats.chunk_sizes(_line_chunks(spark, d), "doc_id", "n_words_per_chunk")


@_query(f"WITH {_CHUNK_SIZES} SELECT doc_id, CAST(least AS INT) AS least, CAST(words AS BIGINT) AS words, row_number() OVER (ORDER BY least, words, doc_id) - 1 AS place FROM sizes")
def order_by_least_chunk_then_words(spark, d):
    return popularity.placed(_chunk_sizes(spark, d).select("doc_id", "least", "words"), "place", "least", "words", "doc_id")


@_query(f"WITH {_CHUNK_SIZES} SELECT doc_id, CAST(n_chunks AS INT) AS n_chunks FROM sizes ORDER BY n_chunks DESC, doc_id LIMIT 100")
def most_chunks_first(spark, d):
    return stats.leading(_chunk_sizes(spark, d), 100, F.desc("n_chunks"), F.col("doc_id")).select("doc_id", "n_chunks")


@_query(f"WITH {_CHUNK_SIZES} SELECT doc_id, CAST(most AS INT) AS most FROM sizes ORDER BY most DESC, doc_id LIMIT 100")
def largest_chunk_first(spark, d):
    return stats.leading(_chunk_sizes(spark, d), 100, F.desc("most"), F.col("doc_id")).select("doc_id", "most")


@_query(f"SELECT doc_id, CAST(pos - 1 AS INT) AS chunk_idx, md5(c) AS chunk_md5 FROM (SELECT doc_id, unnest(parts) AS c, generate_subscripts(parts, 1) AS pos FROM {_LINES}) WHERE pos <= 100")
def chunk_slice(spark, d):
    rows = _line_chunks(spark, d).select("doc_id", F.posexplode(F.slice("split_text", 1, 100)).alias("chunk_idx", "c"))
    return rows.select("doc_id", "chunk_idx", F.md5(F.col("c").cast("binary")).alias("chunk_md5"))


@_query("SELECT n_nationkey, 'n_name' AS field, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation")
def transposed_rows(spark, d):
    return stats.transposed(_read(spark, d, "nation"), "n_nationkey")


@_query("SELECT * FROM (VALUES (0, 'doc_id', 'bigint'), (1, 'text', 'string'), (2, 'lang', 'string'), (3, 'source', 'string'), (4, 'n_chars', 'bigint')) t(place, field, type) JOIN (UNPIVOT (SELECT count(doc_id) AS doc_id, count(text) AS text, count(lang) AS lang, count(source) AS source, count(n_chars) AS n_chars FROM documents) ON COLUMNS(*) INTO NAME field VALUE known) USING (field)")
def table_schema(spark, d):
    """Columns, their types and how many rows have a value."""
    docs = _read(spark, d, "documents")
    return stats.schema_rows(docs).join(stats.known_counts(docs), "field")


@_query("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def preview(spark, d):
    return stats.leading(_read(spark, d, "documents"), 100, F.col("doc_id")).select("doc_id", "lang", "source", "n_chars")


_DEGREES = f"WITH {_EDGES}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), degrees AS (SELECT node, (SELECT count(*) FROM edges WHERE dst = node) AS i, (SELECT count(*) FROM edges WHERE src = node) AS o, (SELECT count(*) - 1 FROM n) AS others FROM n)"


@_query(
    _DEGREES
    + """ SELECT 'in' AS kind, node, i AS links, round(i / others, 9) AS centrality FROM (FROM degrees ORDER BY i DESC, node LIMIT 20)
    UNION ALL SELECT 'out', node, o, round(o / others, 9) FROM (FROM degrees ORDER BY o DESC, node LIMIT 10)"""
)
def top_centrality(spark, d):
    degrees = graph.degree_centrality(_edges(spark, d))
    side = lambda kind, n: stats.leading(degrees, n, F.desc(f"{kind}_degree"), F.col("node")).select(F.lit(kind).alias("kind"), "node", F.col(f"{kind}_degree").alias("links"), F.round(f"{kind}_centrality", 9).alias("centrality"))
    return side("in", 20).unionByName(side("out", 10))


@_query(
    _RANKS
    + """ SELECT 'top' AS side, node, rank FROM (FROM last ORDER BY rank DESC, node LIMIT 10)
    UNION ALL SELECT 'bottom', node, rank FROM (FROM last ORDER BY rank, node LIMIT 3)"""
)
def pagerank_ends(spark, d):
    """The first and last nodes by converged ranks."""
    ranks = graph.pagerank(_edges(spark, d), tol=1e-13).withColumn("rank", F.round("rank", 8))
    side = lambda name, n, order: stats.leading(ranks, n, order, F.col("node")).select(F.lit(name).alias("side"), "node", "rank")
    return side("top", 10, F.desc("rank")).unionByName(side("bottom", 3, F.asc("rank")))


@_query(f"WITH {_EDGES} SELECT dst, (SELECT count(*) FROM edges e WHERE e.dst = edges.dst) AS in_degree FROM edges WHERE src = 's1'")
def neighbours_with_in_degree(spark, d):
    edges = _edges(spark, d)
    return graph.in_degrees(edges, graph.neighbours(edges, "s1"))


@_query(
    f"WITH {_V}, q AS (SELECT vec_id AS qid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS qv FROM embeddings WHERE vec_id % 100 = 0), hits AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY list_cosine_similarity(v, qv) DESC, id) AS rank FROM e, q) SELECT qid, id, CAST(rank AS INT) AS rank, CAST(label AS VARCHAR) AS namespace FROM hits JOIN embeddings ON CAST(vec_id AS VARCHAR) = id WHERE rank <= 5"
)
def lookup_hits(spark, d):
    q = _read(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    hits = vectors.search(q, _vectors(spark, d), 5).select("qid", "id", "rank")
    return joins.lookup_chunks(hits, _vectors(spark, d).select("id", "namespace")).select("qid", "id", "rank", "namespace")


@_query("SELECT label, count(*) AS n, round(count(*) * 64 * 4 / 1073741824.0, 12) AS gb, CAST(floor(label * 1073741824.0 / (64 * 4)) AS BIGINT) AS vectors FROM embeddings GROUP BY 1")
def vector_storage(spark, d):
    rows = _read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return rows.select("label", "n", F.round(stats.storage_gb(F.col("n"), F.lit(64)), 12).alias("gb"), stats.vectors_in(F.col("label"), F.lit(64)).alias("vectors"))


@_query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (50 - l_quantity) / l_quantity, 6) AS eta, round(l_extendedprice / l_quantity, 6) AS ratio FROM lineitem")
def progress_arithmetic(spark, d):
    eta = T.eta_seconds(F.col("l_quantity"), F.lit(50), F.col("l_extendedprice"))
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(eta, 6).alias("eta"), F.round(T.compression_ratio(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("ratio"))


# from raw files: dumps, SQL dumps and pageview lines that Spark writes from the tables first


def _dump(spark, d, text):
    """documents as a multistream dump in the shared folder: (folder, index files)."""
    i, path = F.col("doc_id"), scratch(spark, "dump")
    title, redirect = F.concat(F.lit("Page <"), i.cast("string"), F.lit(">")), F.when(i % 17 == 0, F.lit('Page "A" & B'))
    element = multistream.page_element(title, F.when(i % 19 == 0, 1).otherwise(0), i, text, redirect, F.lit("2024-09-01T12:34:56Z"))
    multistream.write_dump(_read(spark, d, "documents").where("doc_id is not null").select(i.alias("page_id"), title.alias("title"), element.alias("record")), path)
    return path, f"{path}/*-index.txt.bz2"


_PLAIN = r"trim(regexp_replace(coalesce(text, ''), '[\x00-\x1F\x7F]+', ' ', 'g'))"


@_query(
    f"""SELECT doc_id AS page_id, 'Page <' || doc_id || '>' AS title, CASE WHEN doc_id % 19 = 0 THEN '1' ELSE '0' END AS ns, doc_id % 17 = 0 AS is_redirect,
    CASE WHEN doc_id % 17 = 0 THEN 'Page "A" & B' END AS redirect, sha256({_PLAIN}) AS text_sha256 FROM documents WHERE doc_id IS NOT NULL"""
)
def multistream_pages(spark, d):
    """Documents as a dump, written, and read again stream by stream at the index's offsets."""
    path, index = _dump(spark, d, F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x1F\x7F]+", " ")))
    pages = wikidump.read_pages_by_offset(spark, path, index, 4 << 20)
    return pages.select("page_id", "title", "ns", "is_redirect", "redirect", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@_query(
    r"""WITH a AS (SELECT doc_id AS i, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) AS words FROM documents WHERE doc_id IS NOT NULL AND doc_id % 17 <> 0 AND doc_id % 19 <> 0 AND doc_id % 13 <> 0)
    SELECT i AS page_id, 'https://en.wikipedia.org/wiki/Page_<' || i || '>' AS url, CAST(words + 2 * (i % 4) + CASE WHEN i % 11 = 0 THEN 2 ELSE 0 END AS INT) AS word_count,
           CAST(i % 4 + i % 3 + CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN i % 7 = 0 THEN 2 ELSE 0 END AS INT) AS outlink_count, CAST(i % 3 AS INT) AS category_count, array_to_string(list_transform(range(i % 3), lambda k: 'Cat ' || k), '|') AS categories,
           CAST(CASE WHEN i % 3 = 0 THEN 2 ELSE 0 END + i % 2 + CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END AS INT) AS template_count, CAST(i % 2 AS INT) AS external_link_count FROM a"""
)
def dump_articles(spark, d):
    """Articles of a dump whose pages hold links, templates, tables, files, refs and unmarked text; talk pages, redirects and disambiguations go."""
    i = F.col("doc_id")
    some = lambda n, text: F.repeat(F.lit(text), n.cast("int"))
    when = lambda test, text: F.when(test, F.lit(text)).otherwise("")
    category = lambda k: F.when(k < i % 3, F.concat(F.lit("\n[[Category:Cat "), k.cast("string"), F.lit("|key]]"))).otherwise("")
    text = F.concat(
        when(i % 3 == 0, "{{Infobox\n|name={{nowrap|x [[}}|y}}\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "), some(i % 4, " [[Page 1#Part|'''shown''' words]]"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), category), ""), some(i % 2, " <ref name=a>see [http://example.org/a b] {{cite|t=[x]}}</ref><ref name=a />"),
        when(i % 5 == 0, '\n{| class="x"\n|-\n| [[Page 9]] || {{flag}}\n|}\n'), when(i % 7 == 0, "\n[[File:x.jpg|thumb|a [[Page 2|b]] c]]"),
        when(i % 11 == 0, " <nowiki>[[no]] {{no}}</nowiki> <!-- [[no]] -->"), when(i % 13 == 0, "\n{{Disambiguation}}"),
    )
    path, index = _dump(spark, d, text)
    pages = wikidump.read_pages_by_offset(spark, path, index, 4 << 20)
    return wikidump.articles(pages).select("page_id", "url", "word_count", "outlink_count", "category_count", "categories", "template_count", "external_link_count")


@_query("SELECT lang || 'wiki' AS schema, lang, CAST(doc_id AS VARCHAR) AS page_id, source, CAST(length(text) AS INT) AS n, sha256(text) AS text_sha256 FROM documents WHERE lang IN ('de', 'fr')")
def sql_dump_rows(spark, d):
    """Documents as SQL dumps by language, with line ends, semicolons and quotes in values; one of two tables is read again, of two languages."""
    path = scratch(spark, "sqldump")
    docs = _read(spark, d, "documents").where("lang is not null")
    sqldump.write_sql_dumps(docs, path, "page", "lang", ["doc_id", "source", "text"])
    sqldump.write_sql_dumps(docs, path, "pagelinks", "lang", ["doc_id", "lang", "n_chars"])
    rows = sqldump.read_sql_dumps(spark, path, "page", ["page_id", "source", "text"], ["de", "fr"], 1 << 20, "*.txt")
    return rows.select("schema", "lang", "page_id", "source", F.length("text").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@_query(
    _CTE
    + """SELECT month, wiki_code, article_title, CAST(sum(views) AS BIGINT) AS views, array_to_string(list_sort(list_distinct(list(page_id))), ',') AS page_ids
    FROM lines WHERE page_id IS NOT NULL AND wiki_code IN ('view', 'click') AND views % 10 <> 0 AND views % 11 <> 0 GROUP BY ALL"""
)
def pageviews_from_lines(spark, d):
    """Monthly views from pageview lines in bz2 files by month; lines of five parts and lines without a number are skipped, other languages left out."""
    path, v = scratch(spark, "pageviews"), F.col("views")
    total = F.when(v % 11 == 0, F.lit("x")).otherwise(v.cast("string"))
    parts = F.concat_ws(" ", "wiki_code", "article_title", F.when(v % 10 != 0, F.col("page_id")), F.lit("mobile-web"), total, F.lit("A1B2"))
    _lines(spark, d).select("month", parts.alias("value")).write.partitionBy("month").option("compression", "bzip2").text(path)
    lines = pageviews.read_lines(spark, path, "part-*.bz2", month_of_folder=True)
    return popularity.monthly_views(pageviews.parse(lines, ["view", "click"], "month"), "month").withColumn("page_ids", F.array_join("page_ids", ","))


@_query(
    _CTE
    + """SELECT wiki_code, article_title, page_id, 'mobile-web' AS access_method, views AS daily_total, 'A' || views || 'B2' AS hourly_counts
    FROM lines WHERE page_id IS NOT NULL AND starts_with(wiki_code, 'p') AND views % 10 <> 0"""
)
def strict_prefix_lines(spark, d):
    """All six columns of the pageview lines that begin with a prefix; lines of five parts are skipped."""
    path, v = scratch(spark, "strict"), F.col("views")
    parts = F.concat_ws(" ", "wiki_code", "article_title", F.when(v % 10 != 0, F.col("page_id")), F.lit("mobile-web"), v.cast("string"), F.concat(F.lit("A"), v.cast("string"), F.lit("B2")))
    _lines(spark, d).select(parts.alias("value")).write.option("compression", "bzip2").text(path)
    return pageviews.parse_strict(pageviews.read_lines(spark, path, "part-*.bz2").drop("month"), "p")
