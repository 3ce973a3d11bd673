"""Recursive character splitting and the chunk operations built on it."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .html_text import html_text_column
from .text import SPACE, normalize_whitespace, strip

#: Where a text is split, best first; the empty one stands for every character.
SEPARATORS = ("\n\n", "\n", " ", "")


class _Text:
    """A text whose parts are told by their places; nothing is cut out of it but the chunks."""

    def __init__(self, text: str):
        self.text, self.codes = text, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def bounds(self, start: int, end: int, separator: str) -> np.ndarray | range:
        """Where the parts of text[start:end] begin, and its end; a part begins with the separator, but for the first."""
        if not separator:
            return range(start, end + 1)
        if len(separator) == 1:
            found = np.flatnonzero(self.codes[start:end] == ord(separator)) + start
        else:
            found = np.fromiter((m.start() for m in re.compile(re.escape(separator)).finditer(self.text, start, end)), np.int64)
        return np.concatenate([[start], found[found > start], [end]])

    def chunks(self, start: int, end: int, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[str]:
        """Chunks of text[start:end]; parts that are too long and can't be split stay as they are, all others are stripped."""
        chosen = next((i for i, s in enumerate(separators) if not s or self.text.find(s, start, end) >= 0), len(separators) - 1)
        bounds, finer = self.bounds(start, end, separators[chosen]), separators[chosen + 1 :]
        if isinstance(bounds, range):
            large = range(len(bounds) - 1) if size <= 1 else ()
        else:
            large = np.flatnonzero(np.diff(bounds) >= size).tolist()
        first = 0
        for i in (*large, len(bounds) - 1):
            yield from self._packed(bounds, first, i, size, overlap)
            if i < len(bounds) - 1:
                if finer:
                    yield from self.chunks(int(bounds[i]), int(bounds[i + 1]), size, overlap, finer)
                else:
                    yield self.text[bounds[i] : bounds[i + 1]]
            first = i + 1

    def _packed(self, bounds: np.ndarray | range, first: int, last: int, size: int, overlap: int) -> Iterator[str]:
        """Neighbouring parts from first to last, each shorter than size, in chunks up to it; each repeats at most `overlap` of the one before. Ends are found by search."""
        while first < last:
            end = bisect_right(bounds, bounds[first] + size, first + 1, last + 1) - 1
            if chunk := self.text[bounds[first] : bounds[end]].strip():
                yield chunk
            if end == last:
                return
            first = bisect_left(bounds, max(bounds[end] - overlap, bounds[end + 1] - size), first, end)


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters where the text can be split, stripped, without empty ones."""
    if overlap > size:
        raise ValueError("the overlap is larger than the chunks")
    return list(_Text(text).chunks(0, len(text), size, overlap, separators)) if text else []


def finished(chunks: list[str], least_words: int, min_words: int) -> list[tuple[str, int]]:
    """Chunks of `least_words` or more with their numbers of words, short ones joined as in `combine_short` where min_words is not 0; one pass."""
    counted = [(c, n) for c in chunks if (n := len(c.split())) >= least_words]
    if not min_words:
        return counted
    done: list[tuple[str, int]] = []
    parts: list[str] = []
    words, long = 0, False
    for chunk, n in counted:
        if n >= min_words and long:
            done.append((" ".join(parts), words))
            parts, words = [], 0
        elif n >= min_words and parts:
            parts = [" ".join(parts).strip()]
        parts.append(chunk)
        words, long = words + n, long or n >= min_words
    if parts:
        joined = " ".join(parts)
        done.append((joined if long else joined.strip(), words))
    return done


def split_counted(text: Column, size: Column | int, overlap: int, least_words: int = 0, min_words: int = 0) -> Column:
    """Of each text an array of (chunk, words): split, short chunks discarded, short ones joined, in one Python step. The size may differ by row; a null text has null."""

    @F.arrow_udf("array<struct<chunk:string,words:int>>")
    def split(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("chunk", pa.string()), ("words", pa.int32())])
        for texts, sizes in batches:
            offsets, chunks, words = [0], [], []
            for t, n in zip(texts, sizes, strict=True):
                for chunk, k in finished(split_recursive(t.as_py(), n.as_py(), overlap), least_words, min_words) if t.is_valid else ():
                    chunks.append(chunk)
                    words.append(k)
                offsets.append(len(chunks))
            rows = pa.StructArray.from_arrays([pa.array(chunks, pa.string()), pa.array(words, pa.int32())], fields=list(kind))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows, mask=texts.is_null())

    return split(text, size if isinstance(size, Column) else F.lit(size))


def _word_count(chunk: Column) -> Column:
    return F.size(F.filter(F.split(chunk, rf"(?U){SPACE}+"), lambda w: w != ""))


def discard_short(chunks: Column, least_words: int) -> Column:
    return F.filter(chunks, lambda c: _word_count(c) >= least_words)


def combine_short(chunks: Column, min_words: int) -> Column:
    """Short chunks join the chunk before them, leading ones (stripped as a whole) the first long chunk; all short ones become one."""
    state = "struct<done:array<string>,open:string,long:boolean>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(False).alias("long")).cast(state)

    def step(s: Column, c: Column) -> Column:
        is_long = _word_count(c) >= min_words
        closes = is_long & s["long"]
        return F.struct(F.when(closes, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"), F.when(closes | s["open"].isNull(), c).otherwise(F.concat_ws(" ", F.when(is_long, strip(s["open"])).otherwise(s["open"]), c)).alias("open"), (s["long"] | is_long).alias("long")).cast(state)

    return F.aggregate(chunks, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.when(s["long"], s["open"]).otherwise(strip(s["open"]))))))


def split_text_counted(text: Column, chunk_size: Column | int, chunk_overlap: int, discard_chunk_n_words_cutoff: int = 0, clean_whitespace: bool = True, clean_html: bool = False, min_words_per_chunk: int = 0) -> Column:
    """Strip markup, normalise white space, split, discard short chunks, join short ones: an array of (chunk, words)."""
    if clean_html:
        text = html_text_column(text)
    if clean_whitespace:
        text = normalize_whitespace(text)
    return split_counted(text, chunk_size, chunk_overlap, discard_chunk_n_words_cutoff, min_words_per_chunk)


def split_text(*args, **options) -> Column:
    """The chunks of `split_text_counted`."""
    return split_text_counted(*args, **options)["chunk"]
