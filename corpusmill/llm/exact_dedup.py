"""Exact dedup by skew-safe combining.

Texts are equal when they are identical without the characters `[\\x20\\x09-\\x0D]`. Three stages, each comparing
full content (compressed, which is one-to-one) and not digests alone:

1. every task combines the copies among the rows it has read (windows of bounded size);
2. those winners meet by (digest, salt), so a digest with a third of all rows is spread over `salts` tasks, by default as many as
   the session shuffles to (16 at least), so the spread of a hot text grows with the partitions that the data needs;
3. the winners of the salts meet by digest: at most `salts` rows for each content.

Only winners carry content; members travel as one list of ids for each local group, which is joined to the result of stage 3
by the small id of its salt group.

Of equal texts the row with the most code points in the original stays, then the smallest id (a null id comes
last), then one of the repeated rows. Null and empty texts are equal to each other. Every input row gives one
output row; an empty table gives none. Very long texts are compared whole. Only the id and text columns are read, so other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialize, text_bytes, tidy, unique_ids, windows

_LOCAL = pa.schema([("gid", pa.int64()), ("best_id", pa.int64()), ("n_chars", pa.int64()), ("size", pa.int64()), ("members", pa.list_(pa.int64())), ("best_pos", pa.int32()), ("sha", pa.string()), ("content", pa.binary())])
_SALTED = pa.schema([("gid", pa.int64()), ("members", pa.list_(pa.int64())), ("best_pos", pa.int32()), ("class2", pa.int64()), ("win_gid", pa.int64()), ("best_id", pa.int64()), ("n_chars", pa.int64()), ("size", pa.int64()), ("sha", pa.string()), ("content", pa.binary())])
_FINAL = pa.schema([("class2", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keep_gid", pa.int64()), ("text_sha256", pa.string())])
_DDL = {
    "local": "gid long, best_id long, n_chars long, size long, members array<long>, best_pos int, sha string, content binary",
    "salted": "gid long, members array<long>, best_pos int, class2 long, win_gid long, best_id long, n_chars long, size long, sha string, content binary",
    "final": "class2 long, keep_id long, group_size long, keep_gid long, text_sha256 string",
}


def _chars(text: bytes) -> int:
    """Code points of UTF-8: the bytes that do not continue one."""
    return len(text) if text.isascii() else int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def _better(a: tuple, b: tuple) -> bool:
    """Whether (n_chars, id) a goes before b."""
    return (-a[0], a[1] is None, a[1] or 0) < (-b[0], b[1] is None, b[1] or 0)


@tidy
def _combine_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, press = unique_ids(), zstandard.ZstdCompressor(level=1)
    for batch in windows(batches):
        groups: dict[bytes, list] = {}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            group = groups.setdefault(text.translate(None, ASCII_SPACE), [None, [], 0])
            own = (_chars(text), doc_id)
            if group[0] is None or _better(own, group[0]):
                group[0], group[2] = own, len(group[1])
            group[1].append(doc_id)
        rows = [(next(ids), best[1], best[0], len(members), members, pos, hashlib.sha256(content).hexdigest(), press.compress(content)) for content, (best, members, pos) in groups.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LOCAL, strict=True)], schema=_LOCAL)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows sorted by sha, with whether the sha is a new one."""
    last = None
    for batch in windows(batches, "content"):
        for row in batch.to_pylist():
            yield row["sha"] != last, row
            last = row["sha"]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x) for x in row if isinstance(x, bytes)) + sum(8 * len(x) for x in row if isinstance(x, list))
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


@tidy
def _combine_salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each local group at once with the id of its class (its first local group); each class's winner at the end of its digest."""

    def rows() -> Iterator[tuple]:
        classes: dict[bytes, list] = {}  # by content: of one digest, so one entry unless digests collide
        for new, row in _runs(batches):
            if new:
                yield from ended(classes)
                classes = {}
            found = classes.setdefault(row["content"], [row["gid"], None, None, 0, row["sha"]])
            own = (row["n_chars"], row["best_id"])
            if found[1] is None or _better(own, found[1]):
                found[1], found[2] = own, row["gid"]
            found[3] += row["size"]
            yield row["gid"], row["members"], row["best_pos"], found[0], None, None, None, None, None, None
        yield from ended(classes)

    def ended(classes: dict) -> Iterator[tuple]:
        for content, (first, best, gid, size, sha) in classes.items():
            yield None, None, None, first, gid, best[1], best[0], size, sha, content

    return _batches(rows(), _SALTED)


@tidy
def _combine_global(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        classes: dict[bytes, list] = {}
        for new, row in _runs(batches):
            if new:
                yield from ended(classes)
                classes = {}
            found = classes.setdefault(row["content"], [[], None, None, 0, row["sha"]])
            found[0].append(row["class2"])  # at most one for each salt
            own = (row["n_chars"], row["best_id"])
            if found[1] is None or _better(own, found[1]):
                found[1], found[2] = own, row["win_gid"]
            found[3] += row["size"]
        yield from ended(classes)

    def ended(classes: dict) -> Iterator[tuple]:
        for members, best, gid, size, sha in classes.values():
            for class2 in members:
                yield class2, best[1], size, gid, sha

    return _batches(rows(), _FINAL)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    salts = salts or max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    local = text_bytes(docs, text_col, F.col(id_col).cast("long").alias("doc_id")).mapInArrow(_combine_local, _DDL["local"])
    salted = local.withColumn("salt", F.pmod(F.xxhash64("gid"), F.lit(salts))).repartition("sha", "salt").sortWithinPartitions("sha").drop("salt")
    salted = materialize(salted.mapInArrow(_combine_salted, _DDL["salted"]), "dedup")
    winners = salted.where("gid is null").select("class2", "win_gid", "best_id", "n_chars", "size", "sha", "content")
    final = winners.repartition("sha").sortWithinPartitions("sha").mapInArrow(_combine_global, _DDL["final"])
    # a row for each local group is joined, and its members are told apart afterwards, where the group is
    groups = salted.where("gid is not null").select("gid", "class2", "best_pos", "members").join(final, "class2")
    members = groups.select("gid", "best_pos", "keep_gid", "keep_id", "group_size", "text_sha256", F.posexplode("members").alias("pos", "doc_id"))
    kept = (F.col("gid") == F.col("keep_gid")) & (F.col("pos") == F.col("best_pos"))
    out = members.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    out.contents = salted  # to be discarded by who has written the rows
    return out
