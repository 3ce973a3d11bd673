"""Phrase collocations from suffix arrays of word ids.

Texts, lower-cased in A-Z, are cut at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`. A shard is what a task has read of one
language up to SHARD_BYTES of text: the distinct words, and the array of their ids with 0 between pieces. For phrases of k words each
shard sorts its suffixes to a depth of k words by prefix doubling; the LCP array's intervals of k and more are the shard's phrases, and
their widths the counts. These are summed over all shards by language and phrase.

Lengths are counted one after the other, because a phrase found `least` times has parts found as often: the second length takes
only positions whose words, the third only those whose pairs may be that frequent. Which may is told by a bit map of FILTER_BITS bits, the
same size for any input; it passes all that are, and some that are not, which their sums show. So no count is lost.

A candidate is a phrase of 2 to `most_words` words found `least` times. Each cut in two parts of l and r occurrences gives
floor(1000000 * a * a / (l * r)) in decimals; the lowest counts, the first of equals. A candidate goes if a longer one that holds its words has
`share` percent of its occurrences. The rest is sorted over all tasks by language and score, and ranks are places in that order.

Null languages are `und`. Null and empty texts, or those without words, count nothing; repeated rows count each. Ties go to the higher
count, then the phrase in byte order. Very long texts are read whole; one makes a shard of its own size. An empty table gives no phrase. Only the
text and language columns are read, so others may have any name. Words of a third of all rows are met by joins that broadcast frequent keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_bounded, materialize, release, skew_safe_join, splits_bounded, tidy, windows

#: Bytes of text of one language in a shard.
SHARD_BYTES = 6 << 20
#: Shards of a row group; a task that writes or reads shards holds one group in memory.
GROUP_SHARDS = 4
#: Bytes of shards, compressed, that one task counts; it holds their phrases in memory.
SPLIT_BYTES = 4 << 20
#: Bits of the map that tells which shorter phrases may be frequent.
FILTER_BITS = 1 << 26
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_UPPER + b"\t" + _BREAKS, _UPPER.lower() + b" " + b"\n" * len(_BREAKS))
_MASK = (1 << 64) - 1


def encode_shard(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, and the array of their ids from 1 with 0 between pieces."""
    marked = b" \n ".join(t.translate(_PLAIN).replace(b"\n", b" \n ") for t in texts)
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(marked)], np.int64)), pa.py_buffer(marked)])
    coded = pc.split_pattern(whole, " ").flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    new = np.full(len(words), -1, np.int32)
    kept = [i for i, w in enumerate(words) if w not in (b"", b"\n")]
    new[kept] = np.arange(1, len(kept) + 1)
    if b"\n" in words:
        new[words.index(b"\n")] = 0
    ids = new[coded.indices.to_numpy()]
    ids = ids[ids >= 0]
    ids = ids[(ids > 0) | (np.concatenate([[1], ids[:-1]]) > 0)] if len(ids) else ids  # one 0 is enough
    return [words[i] for i in kept], ids


def suffix_array(ids: np.ndarray, depth: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions `at` in the order of their first `depth` words, and for each but the first the words it shares with the one before, up to `depth`.

    Prefix doubling: ranks by h words come in pairs (here, h words on) to ranks by up to 2h.
    """
    end = len(ids)
    rank, known = ids.astype(np.int64), 1
    places = np.arange(end)
    while known < depth:
        step = min(known, depth - known)
        ahead = np.zeros(end, np.int64)
        ahead[: end - step] = rank[step:]
        if known + step >= depth:  # the last ranks are needed at these positions only
            places = at
        key = rank[places] * (int(rank.max(initial=0)) + 1) + ahead[places]
        order = np.argsort(key, kind="stable")
        ranked = np.empty(len(places), np.int64)
        ranked[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) + 1 if len(order) else 0
        known += step
        if known < depth:
            rank = ranked
        else:
            rank = np.zeros(end, np.int64)
            rank[places] = ranked
    sa = at[np.argsort(rank[at], kind="stable")]
    lcp = np.zeros(max(0, len(sa) - 1), np.int8)
    same = np.ones(len(lcp), bool)
    for k in range(depth):
        there = np.minimum(sa + k, end - 1)
        word = np.where(sa + k < end, ids[there], 0)
        same &= (word[1:] == word[:-1]) & (word[1:] > 0)
        lcp += same
    return sa, lcp


def intervals(lcp: np.ndarray, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the intervals of n suffixes that share `words` words begin in the suffix array, and how wide they are."""
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], lcp < words]))
    return first, np.diff(np.append(first, n))


def _roll(hashes: np.ndarray) -> np.ndarray:
    return (hashes << np.uint64(21)) | (hashes >> np.uint64(43))


def _phrase_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(bits - 1)).astype(np.int64)


def _hash(phrase: Column, words: int) -> Column:
    """The same hash as `_phrase_bits` takes, of a phrase of so many words."""
    split, found = F.split(phrase, " "), None
    for i in range(words):
        own = F.xxhash64("lang", split[i])
        found = own if found is None else F.shiftleft(found, 21).bitwiseOR(F.shiftrightunsigned(found, 43)).bitwiseXOR(own)
    return found


def _filter(frequent: DataFrame, words: int, bits: int) -> np.ndarray:
    """The bit map of the frequent phrases of so many words: bits / 64 numbers whatever the input."""
    h = _hash(F.col("phrase"), words)
    place = h.bitwiseXOR(F.shiftrightunsigned(h, 32)).bitwiseAND(F.lit(bits - 1).cast("long"))
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    found = frequent.select(place.alias("place")).groupBy(F.shiftright("place", 6).cast("int").alias("i")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["i"].to_numpy()] = found["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool) if len(found) else np.zeros(bits, bool)


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each shard's language, words and ids (little-endian 32-bit)."""

    @tidy
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def made() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                words, ids = encode_shard(texts)
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([words], pa.list_(pa.binary())), pa.array([ids.astype("<i4").tobytes()])], ["lang", "words", "ids"])
                release()

        for batch in windows(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
            if size >= SHARD_BYTES:
                yield from made()
                held, size = {}, 0
        yield from made()

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(step, "lang string, words array<binary>, ids binary")


def _words_of(row_words: list[bytes], lang: str) -> np.ndarray:
    """The 64-bit hashes of the words, as Spark's xxhash64 of (lang, word); place 0 is no word."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in row_words)], np.uint64)


def _counted(shard: DataFrame, words: int, shared) -> DataFrame:
    """Each shard's phrases of so many words with their counts there; but for single words, those whose shorter parts may be frequent by the shared map."""

    @tidy
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own, data in zip(batch.column("lang").to_pylist(), batch.column("words").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(data, "<i4")
                ok = ids > 0
                if words > 1:
                    packed = shared.value
                    hashes = _words_of(own, lang)[ids]
                    rolled = hashes.copy()
                    for k in range(1, words - 1):
                        rolled = _roll(rolled[:-1]) ^ hashes[k:]
                        ok = ok[:-1] & (ids[k:] > 0)
                    place = _phrase_bits(rolled, len(packed) * 8)
                    ok = ok & (packed[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
                    ok = ok[:-1] & ok[1:] & (ids[words - 1 :] > 0)
                sa, lcp = suffix_array(ids, words, np.flatnonzero(ok))
                first, counts = intervals(lcp, len(sa), words)
                names = pa.array([b"", *own], pa.binary()).cast(pa.string())
                for at in range(0, len(first), 200_000):
                    begin = sa[first[at : at + 200_000]]
                    parts = [names.take(pa.array(ids[begin + k])) for k in range(words)]
                    phrase = pc.binary_join_element_wise(*parts, " ") if words > 1 else parts[0]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(begin)), phrase, pa.array(counts[at : at + 200_000])], ["lang", "phrase", "f"])
            release()

    return shard.mapInArrow(step, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _with_count(rows: DataFrame, grams: DataFrame, part: str, out: str, n: int) -> DataFrame:
    """rows with the occurrences of the phrase in column `part`."""
    asked = rows.groupBy("lang", part).agg(F.count("*").alias("asked"))
    table = asked.join(grams.select("lang", F.col("phrase").alias(part), F.col("f").alias(out)), ["lang", part])
    return skew_safe_join(rows, materialize(table, "parts"), ["lang", part], "asked", n)


def mine_collocations(docs: DataFrame, most_words: int = 3, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang", filter_bits: int = FILTER_BITS) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n (all words of the language), score."""
    spark = docs.sparkSession
    with batches_bounded(spark):
        shard = materialize(shards(docs, text_col, lang_col), "shards", GROUP_SHARDS)
    with batches_bounded(spark), splits_bounded(spark, SPLIT_BYTES):
        words = materialize(_counted(shard, 1, None), "words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    grams = [words.where(F.col("f") >= least)]
    for k in range(2, most_words + 1):
        packed = np.packbits(_filter(grams[-1], k - 1, filter_bits), bitorder="little")
        shared = spark.sparkContext.broadcast(packed)
        with batches_bounded(spark), splits_bounded(spark, SPLIT_BYTES):
            grams.append(materialize(_counted(shard, k, shared).where(F.col("f") >= least), f"phrases-{k}"))
        shared.destroy()
    everything = grams[0]
    for g in grams[1:]:
        everything = everything.unionByName(g)

    split = F.split("phrase", " ")
    found = everything.select("lang", "phrase", F.col("f").alias("a"), F.size(split).alias("words")).where("words > 1")
    # inside a longer candidate with enough of the occurrences
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    inside = found.where("words > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    found = found.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))

    cut = found.select("lang", "phrase", "a", F.posexplode(F.expr("transform(sequence(1, words - 1), k -> struct(array_join(slice(split(phrase, ' '), 1, k), ' ') AS head, array_join(slice(split(phrase, ' '), k + 1, words - k), ' ') AS tail))")).alias("k", "part"))
    cut = materialize(cut.select("lang", "phrase", "a", "k", "part.head", "part.tail"), "cuts")
    n_cuts = cut.count()
    cut = materialize(_with_count(cut, everything, "head", "l", n_cuts), "heads")
    cut = _with_count(cut, everything, "tail", "r", n_cuts)
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumns({"over": F.lit(1_000_000).cast("decimal(7,0)") * (whole("a") * whole("a")).cast("decimal(31,0)"), "under": whole("l") * whole("r")})
    cut = cut.withColumn("score", F.expr("over div under"))
    best = cut.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("best")).select("lang", "phrase", "best.*")

    # places in the order of all tasks, so no task holds a language
    order = [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")]
    placed = best.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed, "placed").withColumn("part", F.shiftright("place", 33))
    parts = placed.groupBy("lang", "part").agg(F.min("place").alias("first"), F.count("*").alias("k"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task with the language
    parts = parts.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).where(F.col("before") < top)
    rank = (F.col("place") - F.col("first") + F.col("before") + 1).alias("rank")
    out = placed.join(parts, ["lang", "part"]).select("lang", rank, "phrase", "a", "l", "r", "score").where(F.col("rank") <= top)
    return out.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
