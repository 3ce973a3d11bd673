"""Substring dedup with sliding spans of units.

Units end after `.`, `!` or `?` before white space, and at line ends; of each `long_words` successive words without such an end, the
one of least rank ends a unit too: after `,`, `;` or `:` first, then by a hash of the word. So a unit has at most `long_words`
words, and whether a word ends one depends on the `long_words` - 1 words on either side alone, not on where the text around begins.
A span begins at each unit and holds the fewest units that make at least `span` units and `span_words` words. A passage of n
words has the same units wherever it stands but for 2 * `long_words` - 1 words at its begin and 2 * `long_words` - 2 at its end at most,
so that with the defaults every repeated passage of 51 words or more holds a whole span (51 - 25 = 26 = `span_words` - 1 + `long_words`).

Spans are hashed (128 bits, white space as single spaces) and joined over all documents. The first occurrence
is the one with the least (id, text hash, place); all units that a later occurrence covers are removed, with the white
space behind them. Of a repeated passage some words at its begin and end may stay: where units differ, or fewer than a unit
behind its last span.

Each task compares the spans of what it has read first, a window at a time, and remembers those that repeat (`REMEMBERED` at most), so that a
passage in a third of all documents is sent to its place about once per task, and not once per document or window.

Null texts are empty and nothing is removed from them. Rows without an id come after all others. Repeated rows (same id and text) count as
one document. Very long texts are handled whole. An empty table gives an empty result. Input columns stay, whatever their names; those named
like an output column (n_removed, removed_chars) are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, tidy, windows

_LAST = (1 << 63) - 1
_SPACE = np.array([chr(i).isspace() for i in range(0x3002)])
_POWERS = np.power(np.uint64(0x9E3779B97F4A7C15), np.arange(64, dtype=np.uint64))
#: Repeated spans that a task remembers.
REMEMBERED = 100_000
#: Words of so many letters are the last to end a unit: they are frequent.
_SHORT = 4


def _sliding(op: Callable, a: np.ndarray, size: int) -> np.ndarray:
    """op over each `size` successive values."""
    done = 1
    while done < size:
        step = min(done, size - done)
        a = op(a[:-step], a[step:])
        done += step
    return a


def _cut(text: str, long_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, begins and ends of the words, first words of the units and one after their last."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = _SPACE[np.minimum(points, len(_SPACE) - 1)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    begin, stop = edge[::2], edge[1::2]
    if not len(begin):
        return points, begin, stop, begin, begin
    last = points[stop - 1]
    lines = np.concatenate([[0], np.cumsum(points == 10)])
    strong = (last == 46) | (last == 33) | (last == 63)
    strong[:-1] |= lines[begin[1:]] > lines[stop[:-1]]
    lengths = stop - begin
    place = np.arange(begin[0], len(points)) - np.repeat(begin, np.diff(begin, append=len(points)))
    letters = np.where(space, 0, points)[begin[0] :].astype(np.uint64)
    rank = np.add.reduceat((letters + np.uint64(1)) * _POWERS[place & 63] * (letters > 0), begin - begin[0])
    rank ^= rank >> np.uint64(29)
    rank *= np.uint64(0xBF58476D1CE4E5B9)
    rank = (rank >> np.uint64(3)) + np.uint64(1)
    clause = (last == 44) | (last == 59) | (last == 58)
    rank += np.where(clause, 0, np.where(lengths > _SHORT, 1, 2)).astype(np.uint64) << np.uint64(61)
    rank[strong] = 0
    cut = strong
    if len(rank) >= long_words:
        least = _sliding(np.minimum, rank, long_words)
        cut = cut | (_sliding(np.maximum, np.pad(least, long_words - 1), long_words) == rank)
    cut[-1] = True
    after = np.flatnonzero(cut) + 1
    return points, begin, stop, np.concatenate([[0], after[:-1]]), after


def _ends(first: np.ndarray, after: np.ndarray, span: int, span_words: int) -> np.ndarray:
    """One after the last unit of each span; the last units begin none."""
    end = np.maximum(np.arange(len(first)) + span, np.searchsorted(after, first + span_words) + 1)
    return end[end <= len(first)]


def sentences(text: str, long_words: int) -> list[tuple[int, int, int, str]]:
    """Of each unit: (begin, end with the white space behind, words, text with single spaces)."""
    points, begin, _, first, _ = _cut(text, long_words)
    places = [*begin[first].tolist(), len(points)]
    words = [text[b:e].split() for b, e in zip(places, places[1:], strict=False)]
    return [(b, e, len(w), " ".join(w)) for b, e, w in zip(places, places[1:], words, strict=False)]


def spans(text: str, span: int, span_words: int, long_words: int) -> np.ndarray:
    """Digests of the spans that begin at the first unit, the second and so on, two numbers each."""
    points, begin, stop, first, after = _cut(text, long_words)
    end = _ends(first, after, span, span_words)
    if not len(end):
        return np.empty((0, 2), np.int64)
    # one space between words and one line end between units
    kept = ~_SPACE[np.minimum(points, len(_SPACE) - 1)]
    kept[stop[:-1]] = True
    shown = points.copy()
    shown[stop[:-1]] = 32
    shown[stop[after[:-1] - 1]] = 10
    at = np.concatenate([[0], np.cumsum(kept)]) * 4
    held = memoryview(shown[kept].tobytes())
    low, high = at[begin[first[: len(end)]]].tolist(), at[stop[after[end - 1] - 1]].tolist()
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(held[a:z]) for a, z in zip(low, high, strict=True)]), np.int64).reshape(-1, 2)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (high, low, key1, key2, first): all but the first of each hash, and those known as later."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        high, low, later = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("high", "low", "later"))
        same = np.concatenate([[last == (high[0], low[0])], (high[1:] == high[:-1]) & (low[1:] == low[:-1])])
        last = (high[-1], low[-1])
        yield batch.filter(pa.array(same | later)).select(["key1", "key2", "first"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3, span_words: int = 20, long_words: int = 7) -> DataFrame:
    """docs with the repeated spans removed from the text, n_removed (units) and removed_chars."""
    kept = [c for c in docs.columns if c.lower() not in ("n_removed", "removed_chars")]
    # the input's columns travel in one, so that their names do not matter
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("key1"), F.xxhash64(text).alias("key2"))

    @tidy
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}  # the least place so far of spans that repeat
        heads = np.empty(0, np.int64)
        for batch in windows(batches, size=6 << 20):
            made = []
            for key1, key2, text in zip(*(batch.column(c).to_pylist() for c in ("key1", "key2", "text")), strict=True):
                found = spans(text, span, span_words, long_words)
                made.append((found[:, 0], found[:, 1], np.full(len(found), key1), np.full(len(found), key2), np.arange(len(found))))
            cols = [np.concatenate(c) for c in zip(*made, strict=True)]
            order = np.lexsort(cols[::-1])
            same = [np.diff(c[order], prepend=~c[order[:1]]) == 0 for c in cols]
            later, again = np.empty(len(order), bool), np.empty(len(order), bool)
            later[order] = same[0] & same[1]
            again[order] = np.logical_and.reduce(same)
            least = order[~later[order] & np.append(later[order][1:], False)]  # of those that repeat in this window
            if len(heads):
                at = np.minimum(np.searchsorted(heads, cols[0]), len(heads) - 1)
                for i in np.flatnonzero((heads[at] == cols[0]) & ~later).tolist():
                    high, low, *own = (int(c[i]) for c in cols)
                    if (high, low) in known:
                        later[i] = tuple(own) > known[high, low]
                        known[high, low] = min(known[high, low], tuple(own))
            if len(known) > REMEMBERED:
                known.clear()
            for high, low, *own in zip(*(c[least].tolist() for c in cols), strict=True):
                known.setdefault((high, low), tuple(own))
            heads = np.sort(np.fromiter((high for high, _ in known), np.int64, len(known)))
            cols = [c[~again] for c in (*cols, later)]
            for at in range(0, len(cols[0]), 100_000):
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000], k) for c, k in zip(cols, kinds, strict=True)], ["high", "low", "key1", "key2", "first", "later"])

    source = keyed.select("key1", "key2", F.coalesce(F.col("row")[text_col], F.lit("")).alias("text"))
    found = source.mapInArrow(spread, "high long, low long, key1 long, key2 long, first int, later boolean")
    dealt = found.repartition(F.when(F.col("later"), F.xxhash64("key1", "key2", "first")).otherwise(F.xxhash64("high", "low")))
    # rows known as later are told apart from others of their hash, which they would make look repeated
    dealt = dealt.withColumns({"high": F.when(F.col("later"), F.lit(0)).otherwise(F.col("high")), "low": F.when(F.col("later"), F.lit(0)).otherwise(F.col("low"))})
    later = dealt.sortWithinPartitions("high", "low", "key1", "key2", "first").mapInArrow(_later, "key1 long, key2 long, first int")
    cover = later.groupBy("key1", "key2").agg(F.collect_list("first").alias("cover"))
    joined = keyed.join(cover, ["key1", "key2"], "left")

    @F.arrow_udf("struct<text:string,n_removed:int,removed_chars:long>")
    def strip(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, covers in batches:
            out = []
            for text, cover in zip(texts.to_pylist(), covers.to_pylist(), strict=True):
                if not cover:
                    out.append({"text": text, "n_removed": 0, "removed_chars": 0})
                    continue
                points, begin, _, first, after = _cut(text, long_words)
                places, ends = np.append(begin[first], len(points)), _ends(first, after, span, span_words)
                turns = np.zeros(len(places), int)
                np.add.at(turns, cover, 1)
                np.add.at(turns, ends[cover], -1)
                gone = np.flatnonzero(np.cumsum(turns))
                kept, at, lost = [], 0, 0
                for low, high in zip(places[gone].tolist(), places[gone + 1].tolist(), strict=True):
                    kept.append(text[at:low])
                    at, lost = high, lost + high - low
                kept.append(text[at:])
                out.append({"text": "".join(kept), "n_removed": len(gone), "removed_chars": lost})
            yield pa.array(out, pa.struct([("text", pa.string()), ("n_removed", pa.int32()), ("removed_chars", pa.int64())]))
            del out
            release()

    done = joined.select("row", strip(F.col("row")[text_col], F.col("cover")).alias("done"))
    return done.select(*[F.col("done.text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept], "done.n_removed", "done.removed_chars")
