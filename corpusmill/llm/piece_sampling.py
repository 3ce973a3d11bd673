"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an edge for every piece of the model that matches, and for characters without a piece one edge that
stands for their bytes. A piece of rank r in the model weighs (r + 2) ** -alpha; a segmentation is drawn with a probability
proportional to the product of its pieces' weights: sums over all paths are filtered forward, and pieces are drawn backward. Draws
are hashes of (seed, row key, unit, step), so a row's segmentation does not depend on what else is read or where.

No piece crosses from a non-space to a space, so the lattice falls apart into units (spaces and what follows them). Units are filtered once
for each distinct one in a window of `WINDOW` characters; each occurrence is drawn on its own. A text longer than that is encoded in
several windows, cut between units, with the draws that it would have in one; only a single unit has to fit.

Decoding joins the pieces' bytes and drops the space that encoding puts first; it gives the text back exactly, also with
leading, trailing or repeated spaces and with the model's own space mark in the text (which is encoded by its bytes).

Null texts stay null, empty texts have no pieces. Rows without a key are keyed by their text. Repeated rows are encoded alike. An empty table
gives an empty result. Only the key and the text are read; `encode_sampled` and `decode_pieces` are columns, so all others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, tidy, windows

_UNITS = re.compile(r" *[^ ]+| +")
_SPACE = 0x2581
#: A code point that no piece has: the model's space mark as a character of the text.
_MARK = 0x110000
#: Characters of text that are filtered and drawn together.
WINDOW = 1 << 20
_MODELS: dict[tuple[str, float], PieceModel] = {}


class PieceModel:
    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {i: model.id_to_piece(i) for i in normal}
        order = sorted(normal, key=lambda i: -model.get_score(i))
        self.size, self.depth = size, max(map(len, pieces.values()))
        #: by id, and at `size` the weight of a character in bytes
        self.weight = np.full(size + 1, -np.inf)
        self.weight[order] = -alpha * np.log(np.arange(len(order)) + 2.0)
        self.weight[size] = -alpha * np.log(size + 2.0) - 1
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        raw = {i: p.replace(chr(_SPACE), " ").encode() for i, p in pieces.items()} | {int(i): bytes([b]) for b, i in enumerate(self.byte_id)}
        self.raw_length = np.array([len(raw.get(i, b"")) for i in range(size)], np.int64)
        self.raw_start = np.concatenate([[0], np.cumsum(self.raw_length)])[:-1]
        self.raw = np.frombuffer(b"".join(raw.get(i, b"") for i in range(size)), np.uint8)
        # trie: node * letters + letter, sorted, to the next node
        letters = sorted({ord(c) for p in pieces.values() for c in p})
        self.letter = np.full(_MARK + 1, -1, np.int32)
        self.letter[letters] = np.arange(len(letters))
        self.letters = len(letters)
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i, p in pieces.items():
            at = 0
            for c in p:
                step = (at, int(self.letter[ord(c)]))
                if step not in nodes:
                    nodes[step] = len(ends)
                    ends.append(-1)
                at = nodes[step]
            ends[at] = i
        keys = sorted((a * self.letters + c, to) for (a, c), to in nodes.items())
        self.keys, self.to, self.ends = np.array([k for k, _ in keys], np.int64), np.array([t for _, t in keys], np.int64), np.array(ends, np.int32)

    def filtered(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the units' positions: piece ids by length, cumulated probabilities by length, each unit's last position, code points."""
        joined = "".join(units)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        spaces = codes == 32
        codes = np.where(codes == _SPACE, _MARK, codes)
        codes[spaces] = _SPACE
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        # one position before each unit: code j of unit k is between positions j + k and j + k + 1
        place = np.arange(len(codes)) + np.repeat(np.arange(len(units)), lengths)
        last = np.cumsum(lengths) + np.arange(len(units))
        first = last - lengths
        end_of = np.repeat(last, lengths)
        letter = self.letter[codes]
        ids = np.full((len(codes) + len(units), self.depth), -1, np.int32)
        at, node, start = np.arange(len(codes)), np.zeros(len(codes), np.int64), place
        for d in range(1, self.depth + 1):
            key = node * self.letters + letter[at + d - 1]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = (self.keys[i] == key) & (letter[at + d - 1] >= 0)
            at, node, start = at[on], self.to[i[on]], start[on]
            piece = self.ends[node]
            hit = piece >= 0
            ids[start[hit] + d, d - 1] = piece[hit]
            more = start + d < end_of[at]
            at, node, start = at[more], node[more], start[more]
            if not len(at):
                break
        bare = ids[place + 1, 0] < 0
        ids[place[bare] + 1, 0] = self.size
        weight = np.append(self.weight, -np.inf)  # -1: the last one
        sums = np.zeros(len(ids))
        cumulated = np.ones(ids.shape, np.float32)
        steps = np.arange(1, self.depth + 1)
        by_length = np.argsort(-lengths, kind="stable")
        count = len(units) - np.searchsorted(np.sort(lengths), np.arange(1, lengths.max() + 1))
        for level in range(1, int(lengths.max()) + 1):
            node = first[by_length[: count[level - 1]]] + level
            width = min(level, self.depth)
            way = sums[node[:, None] - steps[None, :width]] + weight[ids[node, :width]]
            most = way.max(1)
            part = np.exp(way - most[:, None])
            total = part.cumsum(1)
            sums[node] = most + np.log(total[:, -1])
            cumulated[node, :width] = total / total[:, -1:]
        code_before = np.zeros(len(ids), np.int64)
        code_before[place + 1] = codes
        return ids, cumulated, last, code_before

    def encode(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        ids, counts = [], np.zeros(len(texts), np.int64)
        held: list[tuple[int, int, list[str]]] = []  # row, number of its first unit here, units
        size = 0

        def close() -> None:
            nonlocal size
            found, n = self._encode([u for *_, u in held], [keys[r] for r, *_ in held], [first for _, first, _ in held])
            ids.append(found)
            np.add.at(counts, [r for r, *_ in held], n)
            held.clear()
            size = 0

        for row, text in enumerate(texts):
            units, at = _units(text), 0
            while at < len(units):
                # units up to the window's end, one at least
                stop, room = at, WINDOW - size
                if len(text) <= room:
                    stop, size = len(units), size + len(text)
                else:
                    while stop < len(units) and (room > 0 or (stop == at and not held)):
                        room -= len(units[stop]) + 1
                        stop += 1
                    size = WINDOW - room
                if stop > at:
                    held.append((row, at, units[at:stop]))
                at = stop
                if size >= WINDOW:
                    close()
        if held:
            close()
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts

    def _encode(self, lists: list[list[str]], keys: list[int], firsts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Lists of units, the numbers of their first ones in their rows: (ids of all, how many each list has)."""
        distinct: dict[str, int] = {}
        per_text = np.fromiter(map(len, lists), np.int64, len(lists))
        named = [distinct.setdefault(u, len(distinct)) for units in lists for u in units]
        ids, cumulated, last, code = self.filtered([" " + u for u in distinct])
        first = np.concatenate([[0], last[:-1] + 1])
        unit = np.array(named, np.int64)
        within = np.arange(len(unit)) - np.repeat(np.cumsum(per_text) - per_text - np.array(firsts, np.int64), per_text)
        seed = np.repeat(np.array(keys, np.uint64), per_text) + within.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        node, rows = last[unit], np.arange(len(unit))
        drawn = []
        step = 0
        while len(rows):
            u = _uniform(seed[rows] ^ np.uint64(step * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            width = (u[:, None] >= cumulated[node]).sum(1)  # the last is 1, above every draw
            piece = ids[node, width]
            drawn.append((rows, piece, code[node]))
            node = node - width - 1
            more = node > first[unit[rows]]
            rows, node, step = rows[more], node[more], step + 1
        n_ids = np.zeros(len(unit), np.int64)
        sizes = []
        for rows, piece, c in drawn:
            k = np.where(piece < self.size, 1, _utf8_length(c))
            sizes.append(k)
            n_ids[rows] += k
        end = np.cumsum(n_ids)
        out = np.zeros(end[-1], np.int32)
        for (rows, piece, c), k in zip(drawn, sizes, strict=True):
            end[rows] -= k
            whole = piece < self.size
            out[end[rows[whole]]] = piece[whole]
            for i in np.flatnonzero(~whole):
                at = end[rows[i]]
                raw = chr(_SPACE if c[i] == _MARK else int(c[i])).encode("utf-8", "surrogatepass")
                out[at : at + len(raw)] = self.byte_id[np.frombuffer(raw, np.uint8)]
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        totals = np.concatenate([[0], np.cumsum(n_ids)])
        return out, totals[bounds[1:]] - totals[bounds[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        length = self.raw_length[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.raw_start[ids] - (ends - length), length)
        data = self.raw[at].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [data[a + 1 : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _uniform(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)


def _utf8_length(code: np.ndarray) -> np.ndarray:
    c = np.where(code == _MARK, _SPACE, code)
    return 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)


def model(path: str, alpha: float) -> PieceModel:
    if (path, alpha) not in _MODELS:
        _MODELS[path, alpha] = PieceModel(path, alpha)
    return _MODELS[path, alpha]


def _units(text: str) -> list[str]:
    """A text's units, each without the one space that it begins with."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [u[1:] for u in _UNITS.findall(" " + text)]
    return text.split(" ")


def _encoded(own: PieceModel, keys: list, texts: list[str | None], seed: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = [xxhash.xxh64_intdigest(t or "" if k is None else str(k), seed=seed) for k, t in zip(keys, texts, strict=True)]
    return own.encode([t or "" for t in texts], seeds)


def _lists(ids: np.ndarray, counts: np.ndarray, texts: list[str | None]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=pa.array([t is None for t in texts]))


def encode_sampled(key: Column, text: Column, model_path: str, alpha: float = 1.0, seed: int = 0) -> Column:
    """Piece ids of a drawn segmentation of each text."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = model(model_path, alpha)
        for keys, texts in batches:
            listed = texts.to_pylist()
            yield _lists(*_encoded(own, keys.to_pylist(), listed, seed), listed)

    return encode(key, text)


def decode_pieces(ids: Column, model_path: str) -> Column:
    """The text of each list of piece ids."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model(model_path, 1.0)
        for lists in batches:
            counts = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            out = own.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.array([t if v else None for t, v in zip(out, lists.is_valid().to_pylist(), strict=True)], pa.string())

    return decode(ids)


def encode_checked(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """For each row: doc_id, ids, and `lossless`: whether decoding them gives the text. Both ways in one step, a window of rows at a time."""

    @tidy
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path, alpha)
        for batch in windows(batches, size=1 << 20):
            texts = batch.column("text").to_pylist()
            ids, counts = _encoded(own, batch.column("doc_id").to_pylist(), texts, seed)
            back = own.decode(ids, counts)
            same = pa.array([t is None or t == b for t, b in zip(texts, back, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids, counts, texts), same], ["doc_id", "ids", "lossless"])
            del texts, ids, counts, back
            release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(step, "doc_id long, ids array<int>, lossless boolean")
