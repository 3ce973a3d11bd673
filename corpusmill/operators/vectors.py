"""Vector tables: upsert, delete, index settings and exact search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import text as T
from ..sources.store import opened, remove, scratch

#: Bytes of the queries' vectors that every task holds at once; more queries are searched in blocks of that size.
QUERY_BYTES = 64 << 20
#: Vectors and queries that a task compares at once, and pairs that it scores at once.
_VECTORS, _QUERIES, _PAIRS = 4096, 256, 1 << 15


def vector_id(safe_ids: bool) -> Column:
    """A chunk's id: its article's name and its number."""
    return T.safe_vector_id(F.col("title_match"), F.col("chunk_idx")) if safe_ids else F.concat_ws("_", "title_normalized", F.col("chunk_idx").cast("string"))


def vector_records(chunks: DataFrame, safe_ids: bool = False) -> DataFrame:
    """(id, values, metadata) of embedded chunks."""
    return chunks.select(vector_id(safe_ids).alias("id"), F.col("vector").cast("array<float>").alias("values"), F.struct("title", "url", "chunk_idx", "chunk_text").alias("metadata"))


def last_write(rows: DataFrame, key: list[str], *latest: Column) -> DataFrame:
    """The latest row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*latest))).where("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, new: DataFrame, key: list[str], *latest: Column) -> DataFrame:
    """existing with new rows in place of those of the same key; of several new ones the latest."""
    fresh = last_write(new, key, *latest) if latest else new.dropDuplicates(key)
    return existing.join(fresh.select(*key), key, "left_anti").unionByName(fresh.select(*existing.columns))


def check_dimension(vectors: DataFrame, dimension: int, col: str = "values") -> DataFrame:
    """vectors; a row of another length fails the job."""
    return vectors.where(F.assert_true(F.size(col) == dimension, F.lit(f"a vector does not have {dimension} numbers")).isNull())


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, namespace: str | None = None) -> DataFrame:
    """Exact cosine top k of each query: (qid, id, score, rank).

    queries: (qid, vector), a stated set. They are written to the shared folder, and vectors are dealt to tasks by a hash of their ids, because a file may hold all of
    them in one row group: each task reads up to QUERY_BYTES of queries there and keeps its k best of each, so what moves is the vectors once and k rows for each query
    and task. More queries are dealt by a hash of their ids to blocks of that size, which are searched one after the other; each writes its k rows a query.

    A task finds candidates by products of matrices of floats, with a margin for their rounding, and scores these one number after the other in doubles, so that equal
    vectors have equal scores wherever they are, and ids decide. Vectors of zeros score 0; a missing vector, or one of another dimension than the query's, scores null, and is last.
    """
    if namespace is not None:
        vectors = vectors.where(F.col("namespace") == namespace)
    n, dim = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n * (dim or 0) * 4 // QUERY_BYTES))
    if blocks > 1:
        blocks += blocks // 8 + 1  # a hash fills them unevenly
    spark, path = queries.sparkSession, scratch(queries.sparkSession, "queries")
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
    numbered = queries.select("qid", "vector", F.monotonically_increasing_id().alias("_q"), block.alias("block"))
    numbered.write.partitionBy("block").parquet(path)
    dealt = spark.read.schema(numbered.schema).parquet(path)
    if blocks == 1:
        return _search_block(dealt, path, 0, vectors, k)
    hits = scratch(spark, "hits")
    for i in range(blocks):
        _search_block(dealt.where(F.col("block") == i), path, i, vectors, k).write.mode("append").parquet(hits)
    remove(spark, path)
    return spark.read.parquet(hits)


def _search_block(queries: DataFrame, path: str, block: int, vectors: DataFrame, k: int) -> DataFrame:
    """The search of the queries in the folder of a block."""
    kind = vectors.schema["id"].dataType
    found = vectors.select("id", "values").repartition("id").mapInArrow(partial(_best_of_task, path=f"{path}/block={block}", k=k), StructType([StructField("_q", LongType()), StructField("id", kind), StructField("score", DoubleType())]))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    hits = found.join(queries.select("_q", "qid"), "_q").select("qid", "id", "score")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _best_of_task(batches: Iterator[pa.RecordBatch], path: str, k: int) -> Iterator[pa.RecordBatch]:
    """The k best vectors of a task for each query in a folder: (_q, id, score)."""
    store, at = opened(path)
    if store.get_file_info(at).type == fs.FileType.NotFound:  # a block without queries
        return
    asked = ds.dataset(at, format="parquet", filesystem=store, partitioning=None).to_table(columns=["_q", "vector"]).combine_chunks()
    tops = []
    for dim, rows, values in _matrices(asked["vector"]):
        numbers = asked["_q"].to_numpy()[rows]
        tops += [_Top(dim, numbers[i : i + _QUERIES], values[i : i + _QUERIES], k) for i in range(0, len(rows), _QUERIES)]
    least: dict[int | None, pa.Array] = {}  # the k least ids of each dimension
    for batch in batches:
        for dim, rows, values in _matrices(batch.column("values")):
            ids = batch.column("id").take(pa.array(rows))
            least[dim] = _least(pa.concat_arrays([least[dim], ids]) if dim in least else ids, k)
            for i in range(0, len(rows) if dim is not None else 0, _VECTORS):
                kept = _few_of_equal(values[i : i + _VECTORS], ids.slice(i, _VECTORS), k)
                some, names = values[i + kept], ids.take(pa.array(i + kept))
                square = _dot(some, some)
                unit = _unit(some, square)
                for top in tops:
                    if top.dim == dim:
                        top.add(some, square, unit, names)
    for top in tops:
        yield from top.rows(least)


def _matrices(lists: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
    """The lists of each length with their places, as a matrix; missing ones have the length None. A list with a missing number counts as zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        if dim < 0:
            yield None, rows, np.empty((len(rows), 0))
            continue
        flat = lists.take(pa.array(rows)).flatten()
        values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
        if flat.null_count:
            values[flat.is_null().to_numpy(zero_copy_only=False).reshape(len(rows), dim).any(axis=1)] = 0
        yield int(dim), rows, values


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of two matrices, summed from first to last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _unit(rows: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Rows of length 1, as floats; zeros stay zeros."""
    with np.errstate(invalid="ignore"):
        return (rows / np.sqrt(np.where(square == 0, 1, square))[:, None]).astype(np.float32)


def _ids_order(ids: pa.Array) -> np.ndarray:
    """The place of each id in Spark's ascending order, the same for equal ones."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _least(ids: pa.Array, k: int) -> pa.Array:
    return ids.take(pa.array(np.argsort(_ids_order(ids), kind="stable")[:k]))


def _first_of_groups(group: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their group, in rows sorted by group."""
    return np.arange(len(group)) - np.searchsorted(group, group) < k


def _few_of_equal(values: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Rows without those that have k equal vectors of lesser ids before them."""
    n, dim = values.shape
    group = np.unique(np.ascontiguousarray(values).view(np.dtype((np.void, dim * 8))).ravel(), return_inverse=True)[1] if dim else np.zeros(n, np.int64)
    if group.max(initial=0) == n - 1:
        return np.arange(n)
    order = np.lexsort((_ids_order(ids), group))
    return order[_first_of_groups(group[order], k)]


class _Top:
    """The k best vectors so far of some queries of one dimension, sorted by query."""

    def __init__(self, dim: int | None, numbers: np.ndarray, values: np.ndarray, k: int):
        self.dim, self.numbers, self.values, self.k = dim, numbers, values, k
        self.square = _dot(values, values)
        self.unit = _unit(values, self.square)
        self.q, self.score, self.ids = np.empty(0, np.int64), np.empty(0), None
        self.floor = np.full(len(numbers), -np.inf)  # the score of the k-th
        self.margin = ((dim or 0) + 16) * 2.0**-23  # at least twice what products of floats may be off, in any order of their sums

    def add(self, values: np.ndarray, square: np.ndarray, unit: np.ndarray, ids: pa.Array) -> None:
        with np.errstate(invalid="ignore"):
            near = self.unit @ unit.T
        floor = self.floor
        if near.shape[1] > self.k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(near, -self.k, axis=1)[:, -self.k])
        least = (floor - self.margin).astype(np.float32)[:, None]
        q, v = np.divmod(np.flatnonzero(~(near < least)), near.shape[1])  # what is no number is greatest, and stays
        dot = np.empty(len(q))
        for i in range(0, len(q), _PAIRS):
            dot[i : i + _PAIRS] = _dot(self.values[q[i : i + _PAIRS]], values[v[i : i + _PAIRS]])
        with np.errstate(invalid="ignore", divide="ignore"):
            length = np.sqrt(self.square[q] * square[v])
            score = np.where(length == 0, 0.0, np.clip(dot / length, -1, 1))
        stay = ~(score < self.floor[q])
        if not stay.any():
            return
        q, v, score = q[stay], v[stay], score[stay]
        names = ids.take(pa.array(v))
        q, score, names = np.concatenate([self.q, q]), np.concatenate([self.score, score]), names if self.ids is None else pa.concat_arrays([self.ids, names])
        order = np.lexsort((_ids_order(names), np.where(np.isnan(score), -np.inf, -score), q))
        order = order[_first_of_groups(q[order], self.k)]
        self.q, self.score, self.ids = q[order], score[order], names.take(pa.array(order))
        last = ~_first_of_groups(self.q, self.k - 1)
        self.floor[self.q[last]] = self.score[last]

    def rows(self, least: dict[int | None, pa.Array]) -> Iterator[pa.RecordBatch]:
        """The best, and where they are fewer than k, those without a score."""
        names = ["_q", "id", "score"]
        if self.ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(self.numbers[self.q]), self.ids, pa.array(self.score)], names)
        others = [ids for dim, ids in least.items() if dim != self.dim or dim is None]
        short = np.flatnonzero(np.bincount(self.q, minlength=len(self.numbers)) < self.k)
        if others and len(short):
            ids = _least(pa.concat_arrays(others), self.k)
            places = np.tile(np.arange(len(ids)), len(short))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.numbers[short], len(ids))), ids.take(pa.array(places)), pa.nulls(len(places), pa.float64())], names)


def search_one(vector: list[float], vectors: DataFrame, k: int = 5) -> DataFrame:
    """Exact cosine top k of one vector."""
    wanted = F.array(*[F.lit(float(x)) for x in vector])
    return vectors.select("id", T.cosine(F.col("values"), wanted).alias("score")).orderBy(F.desc("score"), "id").limit(k)
