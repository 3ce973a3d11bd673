"""Document fingerprints by I-Match with randomised lexicons, in DataFrame functions only.

Terms are runs of letters and digits, lower case. The lexicon holds the terms whose document frequency lies between
`band[0]` and `band[1]` of all documents: at most (distinct terms of an average document) / band[0] terms, however
large the corpus. All of them are used, and no others.

A text's distinct terms in the lexicon, sorted, are hashed once whole, and once for each of `DRAWS` random draws. A draw numbers the lexicon's
terms at random, which deals it into nested random lexicons of one term in 2, in 4, in 8 and so on; the text is hashed on the smallest of
these that holds any of its terms. So texts of any length are hashed on one term or a few in each draw, by the same rule. A text without any
term of the lexicon has no hashes: its fingerprint is the word `empty`.

The likeness of two fingerprints is the share of the hashes on which they agree, 1 for equal fingerprints and 0 if one of them is
`empty`. Texts with equal terms have equal fingerprints.

Null texts are empty. The next document of a row is the one with the next id (repeated ids in the order of their texts' hashes, null ids
first), the first one for the last row, itself for a single row. Very long texts are handled whole. An empty table gives an empty result.
Only the id and text columns are read, so other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes of each term for the draws; each gives four draws of 16 bits.
HASHES = 6
DRAWS = 4 * HASHES
#: Buckets of neighbouring ids are at most so many, which bounds what the driver holds about them.
MAX_BUCKETS = 1 << 16


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def _in_band(docs: DataFrame, text_col: str, band: tuple[float, float]) -> DataFrame:
    """(term) by document frequency, over all documents."""
    total = docs.count()
    frequency = docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return frequency.where((F.col("n") >= max(2, band[0] * total)) & (F.col("n") <= band[1] * total)).select("term")


def lexicon(docs: DataFrame, text_col: str, band: tuple[float, float]) -> list[str]:
    """The terms of the lexicon."""
    return [r.term for r in _in_band(docs, text_col, band).collect()]


def _numbers(values: list) -> Column:
    """A constant array. Spark folds it into one literal, which costs the plan less than a list of literals."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _places(h: int, bits: int) -> tuple[int, int]:
    return h & (1 << bits) - 1, h >> 24 & (1 << bits) - 1


def hash_table(hashes: list[int]) -> tuple[list[int], int]:
    """(table, bits): each hash stands at one of its two places in a table of 2**bits."""
    bits = max(4, (3 * len(hashes)).bit_length())
    while True:
        table = [0] * (1 << bits)
        for h in hashes:
            at = _places(h, bits)[0]
            for _ in range(200):
                h, table[at] = table[at], h
                if not h:
                    break
                first, second = _places(h, bits)
                at = second if at == first else first
            if h:
                break
        else:
            return table, bits
        bits += 1


class Lexicon:
    """Whether a term is in the lexicon, as an expression on its hash."""

    def __init__(self, hashes: list[int]):
        made, self.bits = hash_table(hashes)
        self.table = _numbers(made)

    def __call__(self, h: Column) -> Column:
        mask = F.lit((1 << self.bits) - 1).cast("long")
        at = lambda x: F.get(self.table, x.bitwiseAND(mask).cast("int"))
        return (at(h) == h) | (at(F.shiftrightunsigned(h, 24)) == h)


def _each(seed: int) -> Callable[[Column], Column]:
    return lambda h: F.xxhash64(h, F.lit(seed))


def _number(k: int) -> Callable[[Column], Column]:
    """The k-th 16 bits."""
    return lambda h: F.shiftrightunsigned(h, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _below(k: int, bound: Column) -> Callable[[Column], Column]:
    return lambda h: _number(k)(h) < bound


def _with_parts(rows: DataFrame, text_col: str, among: Lexicon, out: str) -> DataFrame:
    """Add `out`: the hashes of a text's terms in the lexicon, whole and by draw; an empty array without any."""
    hashed = F.transform(F.array_sort(terms(F.col(text_col))), lambda t: F.xxhash64(t))
    rows = rows.withColumn("_listed", F.filter(hashed, lambda h: among(h)))
    rows = rows.withColumns({f"_hashed{j}": F.transform("_listed", _each(j)) for j in range(HASHES)})
    draws = [(j, k) for j in range(HASHES) for k in range(4)]
    # the smallest lexicon that holds the term with the least number: those below the next power of two. One column for all draws, because
    # Spark would move a column that is used once into the function over the terms and evaluate it for each
    least = [F.array_min(F.transform(f"_hashed{j}", _number(k))) for j, k in draws]
    rows = rows.withColumn("_bounds", F.array(*[F.pow(F.lit(2.0), F.floor(F.log2(x + 0.5)) + 1).cast("long") for x in least]))
    drawn = [F.xxhash64(F.filter(f"_hashed{j}", _below(k, F.get("_bounds", F.lit(i))))) for i, (j, k) in enumerate(draws)]
    parts = F.when(F.size("_listed") > 0, F.array(F.xxhash64("_listed"), *drawn)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn(out, parts).drop("_listed", "_bounds", *[f"_hashed{j}" for j in range(HASHES)])


def _string(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda h: F.hex(h)), "-")).otherwise("empty")


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of hashes: the share on which they agree."""
    agree = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"]))
    return F.when(a == b, F.lit(1.0)).otherwise(agree / F.lit(float(DRAWS + 1)))


def with_next(docs: DataFrame, n_rows: int, rows_a_bucket: int = 1024) -> DataFrame:
    """Rows (doc_id, text) with columns bucket and ghost, so that within a bucket every row but the ghost has its next row.

    Buckets are ranges of ids between quantiles, so they are of like size however the ids lie. A ghost is a copy of the first rows
    of the next bucket that has any; it comes last in its bucket.
    """
    count = max(1, min(MAX_BUCKETS, n_rows // rows_a_bucket))
    shares = F.split(F.lit(",".join(str(i / count) for i in range(1, count)) or "0"), ",").cast("array<double>")
    bounds = docs.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 20 * count))).alias("q")).first().q
    bounds = sorted(set(bounds or []))
    # how many of the sorted bounds are not above the id, by halving
    steps = F.array(*[F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)]) if bounds else None
    listed = _numbers(bounds) if bounds else None
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at)) if bounds else F.lit(0)
    placed = docs.withColumn("bucket", place)
    first = sorted(placed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("f")).select("bucket", "f.k", "f.doc_id").collect())
    before = [(row.bucket, row.k, row.doc_id, first[i - 1].bucket) for i, row in enumerate(first)]
    links = docs.sparkSession.createDataFrame(before, "bucket int, k boolean, first_id long, to int")
    found = placed.join(F.broadcast(links), "bucket").withColumn("leads", F.when(F.col("k"), F.col("doc_id") == F.col("first_id")).otherwise(F.col("doc_id").isNull()))
    copies = F.when(F.col("leads"), F.array(F.struct("bucket", F.lit(0).alias("ghost")), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("ghost")))).otherwise(F.array(F.struct("bucket", F.lit(0).alias("ghost"))))
    return found.select("doc_id", "text", F.explode(copies).alias("at")).select("doc_id", "text", "at.bucket", "at.ghost")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = (0.001, 0.1)) -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter of code points replaced by the first as many of the next document.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    among = Lexicon([r.h for r in _in_band(own, "text", band).select(F.xxhash64("term").alias("h")).collect()])
    rows = with_next(own, own.count())
    rows = _with_parts(rows.repartition("bucket"), "text", among, "parts")
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_parts": F.lead("parts").over(order)}).where("ghost = 0")
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 4) as int))"))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "parts", "next_parts", edited.alias("edited"))
    rows = _with_parts(rows, "edited", among, "edited_parts").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    return rows.select("doc_id", "n_chars", "edited_sha256", _string(F.col("parts")).alias("fingerprint"), _string(F.col("edited_parts")).alias("edited_fingerprint"), likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"), likeness(F.col("parts"), F.col("next_parts")).alias("near_next"))
