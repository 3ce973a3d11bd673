"""Packing by cutting-stock column generation.

A document is its token ids and an end id. Whole multiples of `size` ids are sequences of their own. The rests are classed by
length in units of `unit` ids (size / unit classes at most); the histogram of the classes, which is all that the driver
sees, defines a linear program over patterns (how many rests of each class share a sequence). Columns are priced by a
knapsack dynamic program; the solution is rounded down, and what is left is filled greedily, largest class
first. Documents are ranked within their class, by distributed prefix sums, and the ranks are dealt to the patterns' places.

Rounding lengths up to units leaves some ids of room in each sequence. So a small share of documents, chosen by hash, is
held back and poured into the room, cut where a sequence is full; what they have beyond that fills
sequences of their own. Only the last of those can be short; it is split at powers of two, which need no padding.

Every id lies in one piece. Null and empty texts have the end id only. Repeated rows are packed each; null ids stay null. An
empty table gives no piece. Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prefix_sum, release, text_bytes, tidy, unique_ids, windows, word_codes

#: Ids of one document in one sequence of full length begin here in the numbering of sequences.
FULL = 1 << 40


def id_kind(size: int) -> np.dtype:
    """The shortest unsigned type that holds ids below size."""
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


class WordEncoder:
    """Texts to their ids, as numbers of `kind`, for tokenizers that drop white space.

    The ids of a text are those of its white-space separated chunks, and a window's distinct chunks are looked at once each. A chunk of Latin
    letters and ASCII marks behind them is letters and marks to the tokenizer too, in lower case and each on its own; both are looked up, and new ones
    are encoded by the tokenizer's model, many in one call, where it marks the ends of words. All other new chunks go through the whole tokenizer.
    """

    #: Lines of Latin letters and ASCII marks, but for the apostrophe, which can begin a suffix; other lines give two empty groups.
    _SIMPLE = re.compile(rb"(?m)^(?:((?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++)([!-&(-/:-@\[-`{-~]*+)|[^\n]*+)$")

    def __init__(self, path: str, keep: int = 150_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.keep, self.whole = keep, Tokenizer.from_file(path)
        self.forget()
        self.whole.no_truncation()
        self.whole.no_padding()
        self.end, self.kind = None, id_kind(self.whole.get_vocab_size(with_added_tokens=True))
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        if suffix:
            self.model = Tokenizer(self.whole.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.end = np.zeros(self.whole.get_vocab_size(with_added_tokens=True), bool)
            self.end[[i for t, i in self.whole.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
            same = [*range(33, 127), *range(161, 173), *range(174, 256)]
            self.shown = {b: b for b in same} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in same)}

    def forget(self) -> None:
        self.known = {b"": b""}

    def _model_ids(self, words: list[bytes]) -> list[bytes] | None:
        """The ids of words of letters and of marks; None where the vocabulary does not mark each end."""
        out: list[bytes] = []
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            shown = [x.decode() if x.isascii() else x.decode("latin-1").translate(self.shown) for x in some]
            ids = np.concatenate([np.array(e.ids, self.kind) for e in self.model.encode_batch_fast([" ".join(shown[i : i + 1000]) for i in range(0, len(shown), 1000)], add_special_tokens=False)])
            ends = (np.flatnonzero(self.end[ids]) + 1) * self.kind.itemsize
            if len(ends) != len(some):
                return None
            raw, stops = ids.tobytes(), ends.tolist()
            out += [raw[a:z] for a, z in zip([0, *stops], stops, strict=False)]
        return out

    def _whole_ids(self, chunks: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(chunks), 20_000):
            out += [np.array(x.ids, self.kind).tobytes() for x in self.whole.encode_batch_fast([w.decode() for w in chunks[at : at + 20_000]], add_special_tokens=False)]
        return out

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks."""
        known, lowered, marks, found = self.known, [], [], None
        if self.end is not None and chunks:
            letters, marks = zip(*self._SIMPLE.findall(b"\n".join(chunks)), strict=True)
            lowered = b"\n".join(letters).decode().lower().encode().split(b"\n")
            new = list(set(lowered).union(marks).difference(known))
            found = self._model_ids(new)
        if found is None:
            out, others = [b""] * len(chunks), range(len(chunks))
        else:
            known.update(zip(new, found, strict=True))
            out = list(map(bytes.__add__, map(known.__getitem__, lowered), map(known.__getitem__, marks)))
            others = [i for i, x in enumerate(letters) if not x]
        # chunks that are no simple word are kept too, told apart by what no chunk holds
        own = [b" " + chunks[i] for i in others]
        new = [w for w in own if w not in known]
        known.update(zip(new, self._whole_ids([w[1:] for w in new]), strict=True))
        for i, w in zip(others, own, strict=True):
            out[i] = known[w]
        if len(known) > self.keep:  # what this window has stays
            self.known = {w: known[w] for w in {b"", *lowered, *marks, *own} if w in known}
        return out

    def __call__(self, texts: pa.Array, end_id: int) -> pa.Array:
        """The ids of each text and end_id, as little-endian bytes."""
        bounds, codes, distinct = word_codes(texts)
        ids = pa.array([*self._ids(distinct), np.array([end_id], self.kind).tobytes()], pa.binary())
        found = ids.take(pa.array(np.insert(codes, bounds[1:], len(distinct))))
        offsets = np.frombuffer(found.buffers()[1], np.int32)[np.concatenate([[0], bounds[1:] + np.arange(len(texts)) + 1])]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), found.buffers()[2]])


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a worker: its tokenizer is kept between tasks, its words (at most `keep` and a window's) are not."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def solve_patterns(counts: np.ndarray, tolerance: float = 1e-4, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """counts[c]: rests of c + 1 units; capacity len(counts) units. Patterns with how often each is used; they hold all rests.

    Should `rounds` columns not bring the program within `tolerance` of its best, the columns so far are rounded: all rests
    are still held, in somewhat more sequences.
    """
    capacity = len(counts)
    classes = np.flatnonzero(counts)
    if not len(classes):
        return []
    width, demand = classes + 1, counts[classes].astype(float)
    m = len(classes)
    columns = [np.where(np.arange(m) == i, capacity // width[i], 0) for i in range(m)]
    inverse = np.diag([1 / columns[i][i] for i in range(m)])
    x = inverse @ demand
    for _ in range(rounds):
        price = inverse.sum(0)
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):
            k = np.searchsorted(width, room, "right")
            best[room], choice[room] = best[room - 1], -1
            if k:
                value = best[room - width[:k]] + price[:k]
                j = int(value.argmax())
                if value[j] > best[room] + 1e-12:
                    best[room], choice[room] = value[j], j
        if best[capacity] <= 1 + tolerance:
            break
        column, room = np.zeros(m), capacity
        while room > 0:
            j = choice[room]
            if j < 0:
                room -= 1
            else:
                column[j] += 1
                room -= width[j]
        step = inverse @ column
        up = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / step[up]
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        columns[out] = column.astype(int)
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    left = counts[classes].astype(np.int64)
    used: list[tuple[np.ndarray, int]] = []

    def use(column: np.ndarray, times: int) -> None:
        pattern = np.zeros(capacity, np.int64)
        pattern[classes] = column
        used.append((pattern, times))

    for column, amount in sorted(zip(columns, x, strict=True), key=lambda p: -p[1]):
        hold = column > 0
        times = min(int(amount + 1e-6), int((left[hold] // column[hold]).min()))
        if times > 0:
            left = left - times * column
            use(column, times)
    while left.any():
        column, room = np.zeros(m, np.int64), capacity
        for j in range(m - 1, -1, -1):
            column[j] = min(left[j], room // width[j])
            room -= column[j] * width[j]
        hold = column > 0
        times = int((left[hold] // column[hold]).min())
        left = left - times * column
        use(column, times)
    return used


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, unit: int = 16) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    kind = id_kind(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True))

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, uid = word_encoder(tokenizer_path), unique_ids()
        for batch in windows(batches, size=6 << 20):
            found = of(batch.column("text"), end_id)
            n = np.diff(np.frombuffer(found.buffers()[1], np.int32)) // kind.itemsize
            yield pa.RecordBatch.from_arrays([pa.array([next(uid) for _ in range(len(found))], pa.int64()), batch.column("doc_id"), pa.array(n.astype(np.int64)), found], ["uid", "doc_id", "n", "ids"])
            release()
        of.forget()

    texts = text_bytes(docs, text_col, F.col(id_col).cast("long").alias("doc_id"))
    tokens = materialize(texts.mapInArrow(encode, "uid long, doc_id long, n long, ids binary"), "tokens")
    n_rows = tokens.count()
    plan = tokens.select("uid", "n", (F.col("n") % size).alias("rest"), F.floor(F.col("n") / size).alias("full"))
    plan = plan.withColumns({"class": F.ceil(F.col("rest") / unit).cast("int"), "draw": F.pmod(F.xxhash64("uid", F.lit(10)), F.lit(10_000))})

    def histogram(rows: DataFrame) -> tuple[np.ndarray, int]:
        counts, ids = np.zeros(size // unit, np.int64), 0
        for row in rows.where("rest > 0").groupBy("class").agg(F.count("*").alias("k"), F.sum("rest").alias("ids")).collect():
            counts[row["class"] - 1], ids = row.k, ids + row.ids
        return counts, ids

    counts, ids = histogram(plan)
    room = sum(times for _, times in solve_patterns(counts)) * size - ids
    share = min(10_000, int(np.ceil(10_000 * 1.25 * room / max(1, ids)))) if ids else 0
    rests = plan.where("rest > 0")
    counts, _ = histogram(plan.where(F.col("draw") >= share))
    patterns = solve_patterns(counts)
    sequences = sum(times for _, times in patterns)

    # for each class: where the ranks of each pattern begin, the pattern's first sequence and how many it takes of the class
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    first = np.concatenate([[0], np.cumsum([t for _, t in patterns])]).astype(np.int64)
    for c in np.flatnonzero(counts):
        at = [i for i, (p, _) in enumerate(patterns) if p[c]]
        each = np.array([patterns[i][0][c] for i in at], np.int64)
        held = each * np.array([patterns[i][1] for i in at], np.int64)
        tables[int(c) + 1] = (np.concatenate([[0], np.cumsum(held)[:-1]]), first[at], each)
    shared = spark.sparkContext.broadcast(tables)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            out = np.zeros(len(kind), np.int64)
            for c in np.unique(kind):
                starts, base, each = shared.value[int(c)]
                rows = kind == c
                i = np.searchsorted(starts, rank[rows], "right") - 1
                out[rows] = base[i] + (rank[rows] - starts[i]) // each[i]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("start"), batch.column("rest"), pa.array(out, pa.int64())], ["uid", "start", "length", "sequence_id"])

    packed = prefix_sum(rests.where(F.col("draw") >= share).withColumn("one", F.lit(1)), "one", "rank", ["class"], "uid", n_rows)
    packed = packed.select("uid", (F.col("full") * size).alias("start"), F.col("rest").cast("long"), "class", F.col("rank").cast("long")).mapInArrow(place, "uid long, start long, length long, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy("uid")
    packed = packed.withColumn("offset", F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    packed = materialize(packed, "packed")

    # the held-back documents as one stream of ids, and the room of all sequences as one stream of places
    stream = prefix_sum(rests.where(F.col("draw") < share).select("uid", (F.col("full") * size).alias("start"), F.col("rest").cast("long").alias("length")), "length", "from", [], "uid", n_rows)
    rooms = packed.groupBy("sequence_id").agg(F.sum("length").alias("offset")).where(F.col("offset") < size).withColumn("room", size - F.col("offset"))
    rooms = materialize(prefix_sum(rooms, "room", "from", [], "sequence_id", n_rows), "rooms")
    poured = rests.where(F.col("draw") < share).agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]
    total = rooms.agg(F.coalesce(F.sum("room"), F.lit(0))).first()[0]
    over = max(0, poured - total)
    more = spark.range(over // size).select((F.col("id") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(size).cast("long").alias("room"), (F.col("id") * size + total).alias("from"))
    tail, at = [], total + over // size * size
    for i, n in enumerate(_powers(over % size)):
        tail.append((sequences + over // size + i, 0, n, at))
        at += n
    rooms = rooms.select("sequence_id", "offset", F.col("room").cast("long"), F.col("from").cast("long")).unionByName(more)
    rooms = rooms.unionByName(spark.createDataFrame(tail, "sequence_id long, offset long, room long, from long"))
    stretch = lambda n: F.explode(F.sequence(F.floor(F.col("from") / size), F.floor((F.col("from") + F.col(n) - 1) / size))).alias("stretch")
    a = rooms.select("sequence_id", "offset", "room", F.col("from").alias("room_from"), stretch("room"))
    b = stream.select("uid", "start", "length", F.col("from").alias("doc_from"), stretch("length"))
    low, high = F.greatest("room_from", "doc_from"), F.least(F.col("room_from") + F.col("room"), F.col("doc_from") + F.col("length"))
    cut = a.join(b, "stretch").where((low < high) & (F.floor(low / size) == F.col("stretch")))
    cut = cut.select("uid", (F.col("start") + low - F.col("doc_from")).alias("start"), (high - low).alias("length"), "sequence_id", (F.col("offset") + low - F.col("room_from")).alias("offset"))

    whole = prefix_sum(plan.where("full > 0").select("uid", "full"), "full", "before", [], "uid", n_rows)
    whole = whole.select("uid", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("k", "i"), "before")
    whole = whole.select("uid", (F.col("i") * size).alias("start"), F.lit(size).cast("long").alias("length"), (F.col("before") + F.col("i") + FULL).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pieces = packed.select("uid", "start", "length", "sequence_id", F.col("offset").cast("long")).unionByName(cut).unionByName(whole)
    pieces = pieces.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    @tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in windows(batches, "ids", 8 << 20):
            rows = []
            for doc_id, n, ids, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "pieces")), strict=True):
                view = memoryview(np.frombuffer(ids, kind).astype("<u4")).cast("B")
                for p in found:
                    s, k = p["start"], p["length"]
                    rows.append((doc_id, s, k, zlib.crc32(view[4 * s : 4 * (s + k)]), n, p["sequence_id"], p["offset"]))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return tokens.join(pieces, "uid").select("doc_id", "n", "ids", "pieces").mapInArrow(digest, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
