"""Exploratory aggregates, and cost and size models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order_stats import exact_quantiles


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """How often each value comes, without nulls, most often first."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, exact median, most, least and number of rows of each key; a key's rows are nowhere together."""
    known = df.where(F.col(key).isNotNull())
    sums = known.groupBy(key).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.count("*").alias("n"))
    return sums.join(exact_quantiles(known, [key], value, {"median": 0.5}), key, "left").select(key, "mean", "median", "max", "min", "n").orderBy(key)


def leading(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order; Spark keeps n rows a task, so none sees all."""
    return df.orderBy(*order).limit(n)


def transposed(df: DataFrame, key: str) -> DataFrame:
    """A row for each row's field: (key, field, value), values as text."""
    others = [c for c in df.columns if c != key]
    return df.select(key, *[F.col(c).cast("string").alias(c) for c in others]).unpivot(key, others, "field", "value")


def schema_rows(df: DataFrame) -> DataFrame:
    """The columns of df and their types, in order."""
    return df.sparkSession.createDataFrame([(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)], "place int, field string, type string")


def known_counts(df: DataFrame) -> DataFrame:
    """(field, known): rows that have a value in each column, by one pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return counts.select(F.lit(0).alias("_one"), "*").unpivot("_one", df.columns, "field", "known").drop("_one")


def chunk_sizes(df: DataFrame, key: str, counts: str) -> DataFrame:
    """How many chunks each row has, words of the least and of the largest, and of all; rows without chunks are left out."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return df.where(F.size(counts) > 0).select(key, F.size(counts).alias("n_chunks"), F.array_min(counts).alias("least"), F.array_max(counts).alias("most"), total.alias("words"))


def prefix_histogram(df: DataFrame, title: str = "title", top: int = 25) -> DataFrame:
    """The most frequent prefixes before a colon."""
    found = df.where(F.instr(title, ":") > 0).groupBy(F.substring_index(title, ":", 1).alias("prefix")).agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "prefix").limit(top)


def invert_page_ids(views: DataFrame) -> DataFrame:
    """For each page id its (wiki_code, article_title, views). The word null, which stands for all unknown ids, is none."""
    rows = views.select(F.explode("page_ids").alias("page_id"), "wiki_code", "article_title", "views").where("page_id <> 'null'")
    return rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("wiki_code", "article_title", "views"))).alias("titles"))


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample deviation, least, exact interpolated quartiles, most; no task sees all values."""
    sums = df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"))
    quartiles = exact_quantiles(df, [], col, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return sums.join(quartiles, F.lit(True), "left").select("n", "mean", "std", "min", "q25", "q50", "q75", "max")  # one row each


def array_stats(df: DataFrame, key: str, values: str) -> DataFrame:
    """Mean, most, least, median and population deviation of each row's numbers; null for none."""
    v = F.col(values)
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    ordered = F.array_sort(v)
    median = (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor((n + 2) / 2).cast("int"))) / 2.0
    some = lambda c: F.when(n > 0, c)
    return df.select(key, some(mean).alias("mean"), F.array_max(v).alias("most"), F.array_min(v).alias("least"), some(median).alias("median"), some(spread).alias("std"))


def total_of_arrays(df: DataFrame, values: str) -> DataFrame:
    return df.agg(F.sum(F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)).alias("total"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Rows in each of `bins` equally wide bins between the least and the most; the most is in the last."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, n long")
    width = (high - low) / bins or 1
    place = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(float(width))), F.lit(bins - 1)).cast("int")
    return df.where(F.col(col).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def longest_chunk(df: DataFrame, key: str, chunks: str, counts: str) -> DataFrame:
    """The chunk with the most words; of several the one with the least (key, place)."""
    rows = df.select(key, F.posexplode(F.arrays_zip(F.col(chunks).alias("chunk"), F.col(counts).alias("words"))).alias("place", "z"))
    return rows.select(key, "place", F.col("z.chunk").alias("chunk"), F.col("z.words").alias("words")).orderBy(F.desc("words"), key, "place").limit(1)


def first_short_chunk(df: DataFrame, key: str, counts: str, below: int) -> DataFrame:
    """The first chunk with fewer words than `below`, by (key, place)."""
    rows = df.select(key, F.posexplode(counts).alias("place", "words")).where(F.col("words") < below)
    return rows.orderBy(key, "place").limit(1)


def first_chunk_of(df: DataFrame, key: str, counts: str, words: int) -> DataFrame:
    """Of each row that has one, the place of the first chunk with exactly that many words; a row's own list tells it, so nothing is shuffled."""
    return df.select(key, (F.array_position(counts, words) - 1).cast("int").alias("place")).where("place >= 0")


def extremes(df: DataFrame, key: str, counts: str) -> DataFrame:
    return df.select(key, F.array_min(counts).alias("least"), F.array_max(counts).alias("most"))


def overlap_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of a, of b, of both, and of a only; by one grouped pass over both."""
    sides = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    marked = sides.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return marked.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_both"), F.sum(F.col("a") * (1 - F.col("b"))).alias("n_only_a"))


def counters(pages: DataFrame) -> DataFrame:
    """Pages of the main namespace, redirects and others."""
    main = pages.where("ns = '0'")
    return main.agg(F.count("*").alias("total"), F.count_if(F.col("redirect").isNull()).alias("content"), F.count_if(F.col("redirect").isNotNull()).alias("redirects"))


def progress(done: DataFrame, chunks: DataFrame) -> DataFrame:
    """Shares of the chunks and of the articles that are done."""
    d = done.agg(F.count("*").alias("chunks_done"), F.countDistinct("title_match").alias("articles_done"))
    t = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("title_match").alias("articles"))
    return d.crossJoin(t).select("chunks_done", "articles_done", (F.col("chunks_done") / F.col("chunks")).alias("chunk_share"), (F.col("articles_done") / F.col("articles")).alias("article_share"))


#: Fixed value: tokens for each word in the cost model.
TOKENS_A_WORD = 1.35


def embedding_cost(words: Column, price_a_million: float) -> Column:
    return words * F.lit(TOKENS_A_WORD) / F.lit(1e6) * F.lit(price_a_million)


def storage_gb(rows: Column, dim: Column) -> Column:
    """GB of float32 vectors."""
    return rows * dim * 4 / F.lit(float(1 << 30))


def vectors_in(gb: Column, dim: Column) -> Column:
    return F.floor(gb * F.lit(float(1 << 30)) / (dim * 4))


def short_runs(df: DataFrame, key: str, chunks: str, least_words: int) -> DataFrame:
    """Runs of neighbouring short chunks (words between single spaces), joined by a bar; a run at the end is not closed and left out."""
    state = "struct<done:array<string>,open:array<string>>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open")).cast(state)

    def step(s: Column, c: Column) -> Column:
        short = F.size(F.split(c, " ", -1)) < least_words
        closed = F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], " | ")))).otherwise(s["done"])
        none = F.array().cast("array<string>")
        return F.struct(F.when(short, s["done"]).otherwise(closed).alias("done"), F.when(short, F.concat(s["open"], F.array(c))).otherwise(none).alias("open")).cast(state)

    return df.select(key, F.posexplode(F.aggregate(chunks, start, step, lambda s: s["done"])).alias("run", "joined"))
