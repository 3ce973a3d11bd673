"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

A text is cut into pre-tokens at every single ASCII space or newline that follows a non-space and precedes one. No
token of the byte-level tokenizer spans such a place, and what follows does not depend on what precedes it, so the
counts of the parts add up to the count of the text. Texts with other white space runs are cut where a run of
ASCII white space begins; texts with special strings or rarer white space only at single spaces and newlines between
printing ASCII characters, which neither touches (special strings with white space: not at all).

The join is skew-safe: the most frequent pre-tokens (every one that makes up at least `heavy_share` of some task's
text, at most `heavy_terms` in number) are counted first and broadcast, those of more than `heavy_bytes` by a digest
of 16 bytes, so the size is bounded; all the others meet their documents' frequencies in a shuffle by pre-token, where
each distinct one is counted once. A frequent long pre-token is counted once by each task that reads it. No ids are kept.

Null texts are empty and count 0 tokens. Repeated rows give a row each, null ids stay null. Very long texts are cut
like all others. An empty table gives an empty result. Only the id and text columns are read, so other columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, tidy, unique_ids, windows

#: White space that is not ASCII, or that libraries disagree on.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_SURE = re.compile(rb"(?<=[!-~])(?=[ \n][!-~])")
_RUNS = re.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a .json or .model file, read once per worker; from there a function of texts to id lists."""
    if path not in _TOKENIZERS:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _TOKENIZERS[path] = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            _TOKENIZERS[path] = lambda texts: [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]
    return _TOKENIZERS[path]


def pre_tokens(text: bytes, special: re.Pattern[bytes]) -> list[bytes]:
    """The parts of a text whose token counts add up to the text's."""
    if not text:
        return []
    if special.search(text) or (not text.isascii() and _ODD_SPACE.search(text.decode())) or (text.isascii() and re.search(rb"[\x1c-\x1f]", text)):
        return [text] if re.search(rb"\s", special.pattern.replace(b"(?!)", b"")) else _SURE.split(text)
    spaces = text.translate(_AS_SPACE)
    if b"  " in spaces or spaces[-1:] == b" " or b"\xff" in text:
        return _RUNS.findall(text)
    return text.replace(b" ", b"\xff ").replace(b"\n", b"\xff\n").split(b"\xff")


#: Every ASCII white space as a space.
_AS_SPACE = bytes(32 if 9 <= i <= 13 else i for i in range(256))


def added_tokens(path: str) -> list[str]:
    """The strings that a .json file's tokenizer treats as tokens of their own."""
    if not path.endswith(".json"):
        return []
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def _key(unit: bytes, most: int) -> bytes:
    """The pre-token; of a longer one its digest, behind a byte that no UTF-8 text holds."""
    return unit if len(unit) <= most else b"\xff" + hashlib.blake2b(unit, digest_size=16).digest()


def _special(strings: list[str]) -> re.Pattern[bytes]:
    return re.compile(b"|".join(re.escape(s.encode()) for s in strings) or rb"(?!)")


def pre_token_lines(texts: DataFrame, tokenizer_path: str, pattern: bytes, heavy_share: float, heavy_terms: int, heavy_bytes: int) -> DataFrame:
    """(row, doc_id, n_bytes, unit, n): for each row of (doc_id, text) a line with the pieces of its frequent pre-tokens, and one for each other with its frequency."""

    @tidy
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, held, total, rounds = re.compile(pattern), Counter(), 0, 0
        for batch in windows(batches):
            for text in batch.column("text").to_pylist():
                units = pre_tokens(text, mark)
                total += len(units)
                held.update(units if not units or len(max(units, key=len)) <= heavy_bytes else [_key(u, heavy_bytes) for u in units])
            while len(held) > 1_500_000:  # lossy counting: a count is too low by the number of rounds at most
                rounds += 1
                held = Counter({k: n - 1 for k, n in held.items() if n > 1})
        rows = [(k, n + rounds) for k, n in held.items() if n + rounds >= max(2, heavy_share * total)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["unit", "n"])

    heavy = texts.mapInArrow(frequent, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(heavy_terms).select("unit")
    units = heavy.toArrow().column(0).to_pylist()
    long = [u for u in units if u[:1] == b"\xff"]
    units = [u for u in units if u[:1] != b"\xff"]
    counts = dict(zip(units, map(len, tokenizer(tokenizer_path)([u.decode() for u in units])), strict=True))
    known = texts.sparkSession.sparkContext.broadcast(counts | dict.fromkeys(long))  # long: counted where they are met

    @tidy
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row one line with the pieces of its frequent pre-tokens, and one for each other pre-token."""
        mark, of, ids, met = re.compile(pattern), known.value, unique_ids(), {}

        def pieces(unit: bytes) -> int | None:
            """Of a long pre-token that is frequent, counted at its first place in the task."""
            key = _key(unit, heavy_bytes)
            if key not in met and key in of:
                met[key] = len(tokenizer(tokenizer_path)([unit.decode()])[0])
            return met.get(key)

        for batch in windows(batches, size=4 << 20):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                row, rest, n = next(ids), [], 0
                for unit in pre_tokens(text, mark):
                    try:
                        n += of[unit]
                    except KeyError:
                        k = pieces(unit) if len(unit) > heavy_bytes else None
                        if k is None:
                            rest.append(unit)
                        else:
                            n += k
                lines = [(row, doc_id, len(text), None, n)]
                lines += [(row, None, None, unit, k) for unit, k in Counter(rest).items()]
                for column, values in zip(cols, zip(*lines, strict=True), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int64())], ["row", "doc_id", "n_bytes", "unit", "n"])

    return texts.mapInArrow(frequencies, "row long, doc_id long, n_bytes long, unit binary, n long")


def token_counts(
    docs: DataFrame, tokenizer_path: str, special: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, heavy_share: float = 2e-6, heavy_terms: int = 150_000, heavy_bytes: int = 64
) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). special: by default the file's added tokens."""
    texts = text_bytes(docs, text_col, F.col(id_col).cast("long").alias("doc_id"))
    pattern = _special(added_tokens(tokenizer_path) if special is None else special).pattern

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by pre-token: each distinct one is counted once; its count times the frequency."""
        encode, last, last_n = tokenizer(tokenizer_path), None, 0
        for batch in windows(batches, "unit", 8 << 20):
            unit = batch.column("unit")
            distinct = [u for u in unit.unique().to_pylist() if u is not None]
            new = [u for u in distinct if u != last]
            size = {last: last_n} | dict(zip(new, map(len, encode([u.decode() for u in new])), strict=True))
            if distinct:
                last, last_n = distinct[-1], size[distinct[-1]]
            n = [k if u is None else k * size[u] for u, k in zip(unit.to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["row", "doc_id", "n_bytes", "n"])

    lines = pre_token_lines(texts, tokenizer_path, pattern, heavy_share, heavy_terms, heavy_bytes)
    dealt = lines.repartition(F.when(F.col("unit").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("unit")))
    parts = dealt.sortWithinPartitions("unit").mapInArrow(joined, "row long, doc_id long, n_bytes long, n long")
    return parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
