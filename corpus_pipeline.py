"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the shared folder and reads it
again as the next one's docs. All stages but the last return the columns of documents.

Rows are told apart by doc_id, which documents holds once each; of rows that repeat an id with another text, each is
judged by its own text in the first two stages and the Jaccard join keeps those of one kept id.

Null and empty texts: the source decides on their language, one of them stays in exact dedup, and it is packed as the end id alone. A null id
is no reason to go; its row links with nothing. Very long texts are handled whole in each stage. Ties go to the smallest doc_id. Extra
columns of documents are not carried: each stage but the last returns the columns of documents. An empty table gives no piece.

A stage's result is evaluated by whoever writes it, so the stages leave the bounds of Arrow batches (4 MB, 2000 rows) in the session's settings.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm import exact_dedup as exact
from corpusmill.llm import jaccard_join, language, packing, substring_dedup
from corpusmill.llm.common import bound_batches, discard, materialize
from corpusmill.llm.queries import LANGUAGES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """docs whose keys are not in gone, by one join at any size; Spark alone may send a side that its own limit takes for small to all tasks."""
    return docs.join(materialize(gone.distinct(), "gone"), keys, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in no language go."""
    bound_batches(spark)
    model = language.fit_trigrams(docs, LANGUAGES)
    # a row by 128 bits of its id and text
    keyed = docs.withColumns({"_key1": F.xxhash64("doc_id", "text"), "_key2": F.xxhash64("text", "doc_id", F.lit(1))})
    judged = language.identify(keyed.select("_key1", "_key2", "text", "source"), model, LANGUAGES, "text", host=F.col("source"))
    return _without(keyed, judged.where("language = 'und'").select("_key1", "_key2"), ["_key1", "_key2"]).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays. Rows that repeat both id and text are one row first, the longest; rows without an id stay."""
    bound_batches(spark)
    judged = exact.exact_dedup(docs)
    found = materialize(judged, "dedup-found")
    discard(judged.contents)
    keys = ["doc_id", "text_sha256"]
    docs = docs.withColumn("text_sha256", F.sha2(F.translate(F.coalesce("text", F.lit("")), " \t\n\r\x0b\x0c", "").cast("binary"), 256))
    if not found.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        order = Window.partitionBy(*keys).orderBy(F.desc(F.length("text")), "text")
        docs = docs.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    gone = found.where(~F.col("kept")).select(*keys).subtract(found.where("kept").select(*keys))
    return _without(docs, gone, keys).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity of 0.8 or more) the document with the smallest id stays."""
    bound_batches(spark)
    found = jaccard_join.jaccard_components(docs, words=5, percent=80, rounds=2)
    return _without(docs, found.where("doc_id <> component_id").select("doc_id"), ["doc_id"]).select(*COLUMNS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of sentences go from all documents but the first; documents of which nothing is left go."""
    bound_batches(spark)
    done = substring_dedup.substring_dedup(docs).where("n_removed = 0 or trim(text) <> ''")
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    bound_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", ngram_jaccard_join), ("substring_dedup", substring), ("packing", pack)]

#: SQL expresses neither the trained language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
