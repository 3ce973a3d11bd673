"""Tables on shared storage: articles, views by language and month, chunks, vectors and checkpoints."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.store import remove, scratch


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_articles(articles: DataFrame, path: str, lang: str) -> None:
    """Replace one language's articles."""
    articles.withColumn("lang", F.lit(lang)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("lang").parquet(path)


def write_views(views: DataFrame, path: str) -> None:
    """Replace the months and languages that views holds; others stay, and a repeated run changes nothing."""
    views.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("wiki_code", "month").parquet(path)


def read_views(spark: SparkSession, path: str) -> DataFrame:
    """Views without the index column that other writers may have left."""
    return spark.read.parquet(path).drop("__index_level_0__")


def create_if_absent(df: DataFrame, table: str) -> bool:
    """Save df as a table unless there is one; whether it did."""
    if df.sparkSession.catalog.tableExists(table):
        return False
    df.write.saveAsTable(table)
    return True


def create_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def drop(spark: SparkSession, name: str) -> None:
    """Drop a view or table if there is one."""
    spark.catalog.dropTempView(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def set_columns(df: DataFrame, **columns) -> DataFrame:
    """UPDATE of whole columns."""
    return df.withColumns(columns)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8."""
    df.write.mode("overwrite").json(path)


@dataclass
class BucketTable:
    """A Parquet table in folders by a hash of the key, so that a change rewrites the buckets it touches and no others.

    Changes go through Spark's dynamic partition overwrite: new files are staged and put in the place of the buckets' folders when the job commits, so a repeated
    change gives the same table. A bucket that loses its last row keeps a row of nulls as its mark; rows without a key are not kept. Writers of
    different buckets do not meet; of two that change one bucket at once, the later commit stays.
    """

    spark: SparkSession
    path: str
    schema: str
    key: tuple[str, ...] = ("id",)
    buckets: int = 64

    def bucket(self, *key: Column) -> Column:
        """The bucket of a key."""
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.dropna(subset=list(self.key)).withColumn("bucket", self.bucket(*map(F.col, self.key)))

    def _stored(self, touched: list[int] | None = None) -> DataFrame:
        found = read_or_empty(self.spark, self.path, f"{self.schema}, bucket INT").dropna(subset=list(self.key))
        return found if touched is None else found.where(F.col("bucket").isin(touched))

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _replace(self, rows: DataFrame, touched: list[int] = ()) -> None:
        """Put rows in the place of their buckets, and of the touched ones that have none."""
        if touched:
            rows = rows.unionByName(self.spark.createDataFrame([(b,) for b in touched], "bucket int"), allowMissingColumns=True)
        rows.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(self.path)

    def upsert(self, rows: DataFrame, *latest: Column) -> int:
        """Rows in place of those with their keys; of several with one key the latest. Returns their number before that; rows are evaluated once."""
        from .operators.vectors import last_write

        with written(self._bucketed(rows), "upsert") as fresh:
            n, touched = fresh.agg(F.count("*"), F.collect_set("bucket")).first()  # at most `buckets` numbers
            if n:
                old = self._stored(touched)
                new = last_write(fresh, list(self.key), *latest) if latest else fresh.dropDuplicates(list(self.key))
                self._replace(old.join(fresh.select("bucket", *self.key), ["bucket", *self.key], "left_anti").select(*old.columns).unionByName(new.select(*old.columns)))
        return n

    def delete(self, keys: DataFrame) -> None:
        with written(self._bucketed(keys.select(*self.key)), "delete") as gone:
            touched = gone.agg(F.collect_set("bucket")).first()[0]
            if touched:
                self._replace(self._stored(touched).join(gone, ["bucket", *self.key], "left_anti"), touched)

    def clear(self) -> None:
        """Delete all rows."""
        touched = self._stored().agg(F.collect_set("bucket")).first()[0]
        if touched:
            self._replace(self._stored(touched).limit(0), touched)


@contextlib.contextmanager
def written(df: DataFrame, name: str, *by: str) -> Iterator[DataFrame]:
    """df as a table in the shared folder, in folders by some columns, while it is used more than once."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


#: Fixed value: the columns of the chunk store.
CHUNK_STORE = "id STRING, language STRING, index_name STRING, namespace STRING, chunk_text STRING, chunk_index INT, source_title STRING, source_url STRING, created_at TIMESTAMP"


def chunk_store(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    return BucketTable(spark, path, CHUNK_STORE, buckets=buckets)


def insert_chunks(store: BucketTable, chunks: DataFrame) -> None:
    store.upsert(chunks.drop("vector").withColumn("created_at", F.current_timestamp()))


#: Fixed value: the columns of a vector record.
VECTORS = "id STRING, values ARRAY<FLOAT>, metadata STRUCT<title: STRING, url: STRING, chunk_idx: INT, chunk_text: STRING>"


class _VectorBuckets(BucketTable):
    """Vectors of one article (ids that differ in the number at their end) share a bucket."""

    def bucket(self, *key: Column) -> Column:
        return super().bucket(F.regexp_replace(key[0], r"_\d+$", ""))


@dataclass
class VectorTable:
    """One index: a bucket table for each namespace, vectors of one dimension."""

    spark: SparkSession
    path: str
    dimension: int
    buckets: int = 64

    def of(self, namespace: str) -> BucketTable:
        return _VectorBuckets(self.spark, f"{self.path}/namespace={namespace}", VECTORS, buckets=self.buckets)

    def read(self, namespace: str) -> DataFrame:
        return self.of(namespace).read()

    def upsert(self, namespace: str, records: DataFrame) -> int:
        """The last write of an id wins; only the buckets of the records' articles are rewritten. Returns the number of records."""
        from .operators.vectors import check_dimension

        return self.of(namespace).upsert(check_dimension(records, self.dimension), F.desc("metadata.title"), F.desc("metadata.chunk_idx"))

    def delete_all(self, namespace: str) -> None:
        self.of(namespace).clear()


def create_index(spark: SparkSession, registry: str, base: str, name: str, dimension: int, metric: str = "cosine") -> VectorTable:
    """The index of this name; its settings are registered once, and another dimension is refused."""
    known = read_or_empty(spark, registry, "name string, dimension int, metric string").where(F.col("name") == name).limit(1).collect()
    if known and known[0].dimension != dimension:
        raise ValueError(f"{name} has vectors of {known[0].dimension} numbers")
    if not known:
        spark.createDataFrame([(name, dimension, metric)], "name string, dimension int, metric string").write.mode("append").parquet(registry)
    return VectorTable(spark, f"{base}/{name}", dimension)


def append_checkpoint(chunks: DataFrame, path: str) -> None:
    chunks.select("title_match", F.col("chunk_idx").cast("int").alias("chunk_idx")).write.mode("append").parquet(path)
