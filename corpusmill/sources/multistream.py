"""Multistream dumps: bz2 files of many streams, read stream by stream at the offsets of their index.

The index, text lines of offset:id:title, becomes a small table of (file, offset). The data source `wiki_multistream` plans byte ranges of
`rangeBytes` of each dump file; the task of a range asks the table for the offsets inside it, seeks to each and decodes that one stream.
So a file is read by as many tasks as it has ranges, each stream by one of them, and the driver holds a range's two numbers and no offsets.

A stream that cannot be decoded or that ends early gives one row with its offset and the error, behind the pages that were whole; the
others are read. A stream that the index does not name (the head with the site's data, the closing element) is not read.
"""

from __future__ import annotations

import bz2
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .store import opened, uri

#: Bytes read at once from a stream, and decoded at once from that.
_READ = 1 << 20
_DECODED = 4 << 20
_PAGE = re.compile(rb"<page>.*?</page>", re.S)
RECORDS = "file string, offset long, record string, error string"
_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record", pa.string()), ("error", pa.string())])


def write_offsets(spark: SparkSession, index_path: str, path: str) -> None:
    """The table of distinct (file, offset) of index files, sorted, so that a task reads the part it asks for. Lines that begin with no number are skipped."""
    lines = spark.read.text(index_path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"-index\.txt(\.bz2)?$", ".xml.bz2")
    offsets = lines.select(name.alias("file"), F.split("value", ":")[0].try_cast("bigint").alias("offset")).where("offset is not null").distinct()
    offsets.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").write.parquet(path)


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    end: int


class MultistreamSource(DataSource):
    """Options: path (a dump file or a folder of *.xml.bz2 files), offsets (table of write_offsets), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "wiki_multistream"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.offsets, self.size = uri(options["path"]), uri(options["offsets"]), int(options.get("rangeBytes", 32 << 20))

    def partitions(self) -> list[_Range]:
        store, path = opened(self.path)
        found = store.get_file_info(path)
        if found.type == stores.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if found.type == stores.FileType.Directory:
            files = [f for f in store.get_file_info(stores.FileSelector(path)) if f.base_name.endswith(".xml.bz2")]
        else:
            files = [found]
        return [_Range(f.base_name, at, min(f.size, at + self.size)) for f in files for at in range(0, f.size, self.size)]

    def read(self, part: _Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no files
            return
        store, at = opened(self.offsets)
        ours = (pc.field("file") == part.file) & (pc.field("offset") >= part.start) & (pc.field("offset") < part.end)
        offsets = sorted(ds.dataset(at, format="parquet", filesystem=store).to_table(columns=["offset"], filter=ours)["offset"].to_pylist())
        if not offsets:
            return
        store, path = opened(self.path)
        if store.get_file_info(path).type == stores.FileType.Directory:
            path = f"{path}/{part.file}"
        with store.open_input_file(path) as f:
            for offset in offsets:
                for records, error in stream_pages(f, offset):
                    if records or error:
                        rows = [*records, *([None] if error else [])]
                        yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(rows)), pa.array([offset] * len(rows), pa.int64()), pa.array(rows, pa.string()), pa.array([None] * len(records) + [error] * bool(error), pa.string())], schema=_ARROW)


def stream_pages(file, offset: int) -> Iterator[tuple[list[str], str | None]]:
    """The page elements of the one stream at an offset, as they are decoded, and at last what was wrong with it."""
    file.seek(offset)
    one, rest, data = bz2.BZ2Decompressor(), b"", b""
    try:
        while not one.eof:
            if one.needs_input:
                data = file.read(_READ)
                if not data:
                    raise EOFError("the file ends within the stream")
            rest += one.decompress(data, _DECODED)
            data, end, records = b"", 0, []
            for m in _PAGE.finditer(rest):
                end = m.end()
                records.append(m.group().decode("utf-8", "replace"))
            rest = rest[end:]
            yield records, None
    except (OSError, EOFError, ValueError) as e:
        yield [], f"{type(e).__name__}: {e}"
    else:
        if b"<page>" in rest:
            yield [], "ValueError: the stream ends within a page"


def read_records(spark: SparkSession, path: str, offsets: str, range_bytes: int = 32 << 20) -> DataFrame:
    """Rows of file, offset, record (a page element) and error (of a damaged stream, record null)."""
    spark.dataSource.register(MultistreamSource)
    return spark.read.format("wiki_multistream").option("offsets", offsets).option("rangeBytes", str(range_bytes)).load(path)


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def page_element(title: Column, ns: Column, page_id: Column, text: Column, redirect: Column, timestamp: Column) -> Column:
    """A page as dumps have it."""
    to = F.when(redirect.isNotNull(), F.concat(F.lit('<redirect title="'), F.replace(_escaped(redirect), F.lit('"'), F.lit("&quot;")), F.lit('" />'))).otherwise("")
    head = F.concat(F.lit("<page><title>"), _escaped(title), F.lit("</title><ns>"), ns.cast("string"), F.lit("</ns><id>"), page_id.cast("string"), F.lit("</id>"), to)
    return F.concat(head, F.lit("<revision><id>1</id><timestamp>"), timestamp, F.lit('</timestamp><text xml:space="preserve">'), _escaped(text), F.lit("</text></revision></page>\n"))


def write_dump(pages: DataFrame, path: str, pages_a_stream: int = 100) -> None:
    """pages (page_id, title, record) as multistream files with their indexes, one pair for each task. A repeated attempt puts the same names in place."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = opened(path)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name, own = f"pages-{task.partitionId():05d}-multistream", f".{task.taskAttemptId()}-{task.partitionId()}"
        n = 0
        with store.open_output_stream(f"{folder}/{own}.dump") as dump, store.open_output_stream(f"{folder}/{own}.index", compression="bz2") as index:
            dump.write(bz2.compress(b"<mediawiki><siteinfo></siteinfo>\n"))
            for batch in batches:
                for at in range(0, batch.num_rows, pages_a_stream):
                    some = batch.slice(at, pages_a_stream).to_pydict()
                    begin = dump.tell()
                    dump.write(bz2.compress("".join(some["record"]).encode()))
                    index.write("".join(f"{begin}:{i}:{t}\n" for i, t in zip(some["page_id"], some["title"], strict=True)).encode())
                    n += len(some["record"])
            dump.write(bz2.compress(b"</mediawiki>\n"))
        if n:
            store.move(f"{folder}/{own}.dump", f"{folder}/{name}.xml.bz2")
            store.move(f"{folder}/{own}.index", f"{folder}/{name}-index.txt.bz2")
        else:
            store.delete_file(f"{folder}/{own}.dump")
            store.delete_file(f"{folder}/{own}.index")
        yield pa.RecordBatch.from_pydict({"pages": pa.array([n], pa.int64())})

    pages.select("page_id", "title", "record").mapInArrow(write, "pages long").agg(F.sum("pages")).collect()
