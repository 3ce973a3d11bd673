"""Token ids in binary files, with Elias-Fano coded document boundaries.

A file is one concatenated array of ids, in 2 or 4 bytes each, followed by two monotone sequences in Elias-Fano form: where each
document begins in the array (and where the last one ends), and the document ids. A value is cut into low bits, which are packed, and a high
part, which is a distance in a bit vector with a one for each value; value i is found by selecting the i-th one, from a sample of
each 256th one's place in 32 bits. That takes about 2 + log2(ids a document) bits a document instead of 64, and still gives any
document's offset without reading the others. Layout, little-endian:

    magic | ids | boundaries: low bits, high bits, samples | document ids: the same | footer (sizes) | magic

Documents are sorted by id by a range shuffle and written by the tasks that hold the ranges; a task begins a new file after
`file_ids` ids or FILE_DOCS documents. Names hold the task attempt, and the manifest, a Parquet table that Spark commits after all tasks,
names the files of the attempts that counted; what a lost attempt has left is never read. Files go through pyarrow's file systems,
so `path` is a URI of a store that driver and executors share.

Null and empty texts hold the end id only. Null ids come first. Rows that share an id are in the order of their texts; rows that
repeat both are interchangeable, and a hot id is spread by the texts' hash. A very long text is one document whole (below 2^32 ids a file). An
empty table gives an empty manifest and no file. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, shared_dir, tidy, windows
from .packing import id_kind, word_encoder

MAGIC = b"EFTOKEN1"
#: Ones between two sampled ones.
SAMPLE = 256
#: Documents of one file at most.
FILE_DOCS = 1 << 20
_FOOTER = struct.Struct("<QQQQqQI")  # documents, ids, null document ids, bytes of the ids, least document id, universe of document ids, bytes an id
_MANIFEST = "part int, k int, file string, n_docs long, n_ids long, n_bytes long"


class EliasFano:
    """n ascending numbers below or equal to `universe`, from their bytes."""

    def __init__(self, n: int, universe: int, data: bytes):
        self.n, self.universe, self.width = n, universe, self.low_bits(n, universe)
        low, high, _ = self.sizes(n, universe)
        self.low = np.frombuffer(data, np.uint8, low)
        self.high = np.frombuffer(data, np.uint8, high, low)
        self.samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), low + high)

    @staticmethod
    def low_bits(n: int, universe: int) -> int:
        return max(0, (universe // n).bit_length() - 1) if n else 0

    @classmethod
    def sizes(cls, n: int, universe: int) -> tuple[int, int, int]:
        """Bytes of the low bits, of the high bits and of the samples."""
        width = cls.low_bits(n, universe)
        if not n:
            return 0, 0, 0
        return -(-n * width // 8), -(-(n + (universe >> width) + 1) // 8), 4 * -(-n // SAMPLE)

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> bytes:
        """values: ascending uint64."""
        n, width = len(values), cls.low_bits(len(values), universe)
        if not n:
            return b""
        values = values.astype(np.uint64)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        ones = np.zeros(cls.sizes(n, universe)[1] * 8, np.uint8)
        ones[places] = 1
        return low.tobytes() + np.packbits(ones, bitorder="little").tobytes() + places[::SAMPLE].astype("<u4").tobytes()

    def _low(self, i: int) -> int:
        at, end = i * self.width, (i + 1) * self.width
        return int.from_bytes(self.low[at // 8 : -(-end // 8)].tobytes(), "little") >> at % 8 & (1 << self.width) - 1

    def select(self, i: int) -> int:
        """Value i, from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = place // 8
        first = int(self.high[at]) >> place % 8 << place % 8
        while left >= (k := first.bit_count()):
            left, at = left - k, at + 1
            first = int(self.high[at])
        for _ in range(left):
            first &= first - 1
        return (at * 8 + (first & -first).bit_length() - 1 - i << self.width) | self._low(i)

    def all(self) -> np.ndarray:
        """All values at once, uint64."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)
        values = high.astype(np.uint64) << np.uint64(self.width)
        bits = np.unpackbits(self.low, count=self.n * self.width, bitorder="little").reshape(self.n, self.width)
        for b in range(self.width):
            values |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return values


def _store(uri: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(uri)


class _Writer:
    """One file, written as its documents come."""

    def __init__(self, folder: str, name: str, kind: np.dtype):
        self.store, self.folder = _store(folder)
        self.name, self.kind = name, kind
        self.store.create_dir(self.folder, recursive=True)
        self.out = self.store.open_output_stream(f"{self.folder}/{name}")
        self.out.write(MAGIC)
        self.lengths: list[np.ndarray] = []
        self.doc_ids: list[pa.Array] = []
        self.n_docs = self.n_ids = 0

    def add(self, doc_ids: pa.Array, lengths: np.ndarray, ids: memoryview) -> None:
        self.out.write(ids)
        self.lengths.append(lengths)
        self.doc_ids.append(doc_ids)
        self.n_docs, self.n_ids = self.n_docs + len(lengths), self.n_ids + int(lengths.sum())

    def close(self) -> int:
        """Bytes of the file."""
        ends = np.concatenate([[0], np.cumsum(np.concatenate(self.lengths))]).astype(np.uint64)
        doc_ids = pa.concat_arrays(self.doc_ids)
        known = doc_ids.drop_null().to_numpy().astype(np.int64)
        least = int(known[0]) if len(known) else 0
        universe = int(known[-1]) - least if len(known) else 0
        for part in (EliasFano.encode(ends, self.n_ids), EliasFano.encode(known.view(np.uint64) - np.int64(least).view(np.uint64), universe)):
            self.out.write(part)
        self.out.write(_FOOTER.pack(self.n_docs, self.n_ids, doc_ids.null_count, self.n_ids * self.kind.itemsize, least, universe, self.kind.itemsize) + MAGIC)
        size = self.out.tell()
        self.out.close()
        return size

    def abandon(self) -> None:
        self.out.close()
        self.store.delete_file(f"{self.folder}/{self.name}")


class TokenFile:
    """One file, open for reading; its ids are read only where they are asked for."""

    def __init__(self, folder: str, name: str):
        store, folder = _store(folder)
        self.file = store.open_input_file(f"{folder}/{name}")
        tail = self.file.size() - _FOOTER.size - len(MAGIC)
        footer = self.file.read_at(_FOOTER.size + len(MAGIC), tail)
        if footer[_FOOTER.size :] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name} is no token file or was cut off")
        self.n_docs, self.n_ids, self.n_null, size, self.least, universe, width = _FOOTER.unpack(footer[: _FOOTER.size])
        self.kind = np.dtype(f"<u{width}")
        at = len(MAGIC) + size
        first = sum(EliasFano.sizes(self.n_docs + 1, self.n_ids))
        coded = self.file.read_at(tail - at, at)
        self.ends = EliasFano(self.n_docs + 1, self.n_ids, coded[:first])
        self.known = EliasFano(self.n_docs - self.n_null, universe, coded[first:])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at start to stop of the concatenated array, as little-endian unsigned 32-bit numbers."""
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * width, len(MAGIC) + start * width), self.kind).astype("<u4")

    def doc_id(self, i: int) -> int | None:
        if i < self.n_null:
            return None
        found = self.known.select(i - self.n_null) + self.least
        return found

    def document(self, i: int) -> np.ndarray:
        """The ids of document i: two selections and one read of a range."""
        return self.ids(self.ends.select(i), self.ends.select(i + 1))

    def batches(self, ids: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All documents in runs of about `ids` ids: (numbers of the documents and one more, their bounds)."""
        ends = self.ends.all().astype(np.int64)
        at = 0
        while at < self.n_docs:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + ids, "right")) - 1)
            yield at, ends[at : stop + 1]
            at = stop

    def doc_ids(self) -> pa.Array:
        known = (self.known.all() + np.int64(self.least).view(np.uint64)).view(np.int64)
        return pa.concat_arrays([pa.nulls(self.n_null, pa.int64()), pa.array(known)])


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = 1 << 23) -> str:
    """Write the ids of all texts, each followed by end_id, in ascending order of ids. Returns `path`; by default a new folder in the shared one."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = (path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}").rstrip("/")
    path = path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"
    kind = id_kind(max(end_id + 1, Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)))

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, task = word_encoder(tokenizer_path), TaskContext.get()
        k, out = 0, None

        def done() -> pa.RecordBatch:
            size = out.close()
            return pa.RecordBatch.from_pylist([{"part": task.partitionId(), "k": k, "file": out.name, "n_docs": out.n_docs, "n_ids": out.n_ids, "n_bytes": size}], schema)

        schema = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
        try:
            for batch in windows(batches, size=min(6 << 20, 4 * file_ids)):
                if out and (out.n_ids >= file_ids or out.n_docs >= FILE_DOCS):
                    made = done()
                    k, out = k + 1, None
                    yield made
                if not out:
                    out = _Writer(f"{path}/ids", f"part-{task.partitionId():05d}-{k:04d}-{task.taskAttemptId()}", kind)
                coded = of(batch.column("text"), end_id)
                bounds = np.frombuffer(coded.buffers()[1], np.int32, len(coded) + 1, coded.offset * 4)
                ids = memoryview(coded.buffers()[2])[bounds[0] : bounds[-1]]
                if of.kind != kind:
                    ids = memoryview(np.frombuffer(ids, of.kind).astype(kind)).cast("B")
                out.add(batch.column("doc_id"), np.diff(bounds) // of.kind.itemsize, ids)
                release()
            if out:
                made, out = done(), None
                yield made
        except BaseException:
            if out:
                out.abandon()
            raise
        finally:
            of.forget()

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text).withColumn("mixed", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "mixed").sortWithinPartitions("doc_id", "mixed", "text").drop("mixed")
    rows.mapInArrow(write, _MANIFEST).write.parquet(f"{path}/manifest")
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file, with the ids and documents of all files before it (first_id, first_doc). Sums run over tasks, then within a task's files."""
    files = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids"), F.sum("n_docs").alias("docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task that wrote
    parts = parts.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("ids", "docs")))
    within = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    first = lambda n, c: (F.col(f"{c}_before") + F.coalesce(F.sum(n).over(within), F.lit(0))).alias(f"first_{c[:-1]}")
    return files.join(parts, "part").select(*files.columns, first("n_ids", "ids"), first("n_docs", "docs"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document: doc_id, start (ids before it in all files), n_tokens, ids (binary: little-endian unsigned 32-bit)."""

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first_id").to_pylist(), strict=True):
                file = TokenFile(f"{path}/ids", name)
                doc_ids = file.doc_ids()
                for at, bounds in file.batches(1 << 20):
                    data = file.ids(bounds[0], bounds[-1])
                    n = np.diff(bounds)
                    ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * (bounds - bounds[0])).astype(np.int32)), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(n)), pa.array(bounds[:-1] + first), pa.array(n), ids], ["doc_id", "start", "n_tokens", "ids"])
                    release()

    files = manifest(spark, path).select("file", "first_id")
    n = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").count()
    return files.repartition(max(1, n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def fetch_documents(wanted: DataFrame, path: str, position_col: str = "position") -> DataFrame:
    """The documents at the given places (0: first) in the order of all files: position, doc_id, ids. A place is sent to its file by blocks of
    FILE_DOCS places, of which a file touches few; only the asked documents' ids are read. Null places and those outside give no row."""
    spark = wanted.sparkSession
    files = manifest(spark, path).select("file", "first_doc", "n_docs")
    block = lambda c: F.shiftright(c, FILE_DOCS.bit_length() - 1)
    files = files.withColumn("block", F.explode(F.sequence(block(F.col("first_doc")), block(F.col("first_doc") + F.col("n_docs") - 1))))
    asked = wanted.select(F.col(position_col).cast("long").alias("position")).withColumn("block", block(F.col("position")))
    i = F.col("position") - F.col("first_doc")
    asked = asked.join(files, "block").where((i >= 0) & (i < F.col("n_docs"))).select("position", "file", i.alias("i"))

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows, held = [], 0
            for position, own, i in zip(*(batch.column(c).to_pylist() for c in ("position", "file", "i")), strict=True):
                if own != name:
                    name, file = own, TokenFile(f"{path}/ids", own)
                ids = file.document(i).tobytes()
                rows.append({"position": position, "doc_id": file.doc_id(i), "ids": ids})
                held += len(ids)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("position", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
    dealt = asked.repartition("file", F.shiftright("position", 12)).sortWithinPartitions("file", "position")
    return dealt.mapInArrow(read, "position long, doc_id long, ids binary")
