"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a row's language are combined by Bayes' rule:

* the text: hashed byte trigrams, all of them, under one multinomial per language, and under a flat one that stands for no language
  (`und`). Trigrams overlap and are not independent, so their likelihood is raised to the power `temper`, at every length alike;
* the declared markup language: how often each language is declared as each, as the texts of all rows tell;
* the address suffix: a country's suffix favours its language, others say nothing;
* the host: the languages of its other rows' texts, smoothed by those of its domain, which are smoothed by those of all rows. The counts are
  grouped aggregations over all rows, joined back by host; a row's own text is left out of its host's counts.

The trigram model is fitted on a bounded sample of labelled rows: `train_rows` for each language, those whose ids hash lowest. Everything
else covers all rows. A row is rejected if `und` is likeliest.

Numbers and marks say nothing about the language; a text of them alone is `und`. Null and empty texts have no text evidence: what is declared,
the suffix and the host decide; with none of these the row is `und`. Of equally likely languages the first of the list is taken. Null
hosts share the prior of all rows and take part in no join; frequent hosts are joined by broadcast. Very long texts are read whole. Repeated rows
are judged alike. An empty table gives an empty result. Other columns pass through, but for those that bear the name of an output column.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, skew_safe_join, text_bytes, windows

BUCKETS = 1 << 16
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_SCRIPT = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(rb"(?s)<[^>]*>")
#: Suffixes of countries and their languages.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en"}
#: How much likelier a country's suffix is under its language.
SUFFIX_ODDS = 20.0


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text in lower case; all that is no letter (ASCII), in runs, as one space."""
    return _buckets(np.frombuffer(b" " + b" ".join(text.lower().translate(_LETTERS).split()) + b" ", np.uint8))


def _buckets(b: np.ndarray) -> np.ndarray:
    b = b.astype(np.uint32)
    return ((b[:-2] * 961 + b[1:-1] * 31 + b[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64) if len(b) > 2 else np.zeros(0, np.int64)


def log_likelihoods(table: np.ndarray, text: bytes) -> np.ndarray | None:
    """Of a text under each row of the table; None without trigrams. Long texts are summed in parts."""
    b = np.frombuffer(b" " + b" ".join(text.lower().translate(_LETTERS).split()) + b" ", np.uint8)
    if len(b) < 3:
        return None
    return sum(table[:, _buckets(b[at : at + (1 << 16) + 2])].sum(1) for at in range(0, len(b) - 2, 1 << 16))


def markup_text(page: bytes) -> bytes:
    """Text of an HTML page, without scripts and styles."""
    return html.unescape(_TAG.sub(b" ", _SCRIPT.sub(b" ", page)).decode("utf-8", "replace")).encode()


def fit_trigrams(docs: DataFrame, languages: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 2000) -> np.ndarray:
    """Log probabilities, a row for each language and a last one that is flat."""
    known = docs.where(F.col(lang_col).isin(languages) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("_lang"))
    sampled = None
    for lang in languages:
        part = known.where(F.col("_lang") == lang).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        sampled = part if sampled is None else sampled.unionByName(part)
    texts = text_bytes(docs, text_col, F.col(id_col).alias("doc_id")).join(F.broadcast(sampled.distinct()), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in windows(batches):
            for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                total[languages.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
        row, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[row, bucket])], ["row", "bucket", "n"])

    counts = texts.select("_lang", "text").mapInArrow(count, "row int, bucket int, n long").groupBy("row", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(languages), BUCKETS))
    table[counts.column("row").to_numpy(), counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    table = np.log((table + 0.05) / (table.sum(1, keepdims=True) + 0.05 * BUCKETS))
    return np.vstack([table, np.full(BUCKETS, -math.log(BUCKETS))])


def _softmax(logs: np.ndarray) -> np.ndarray:
    w = np.exp(logs - logs.max(1, keepdims=True))
    return w / w.sum(1, keepdims=True)


def identify(
    rows: DataFrame, model: np.ndarray, languages: list[str], text_col: str, host: Column | None = None, declared: Column | None = None, markup: bool = False, temper: float = 0.25, strength: float = 5.0
) -> DataFrame:
    """rows without text_col, with language, probability, text_language, und_probability. text_col is read as markup if `markup`."""
    spark = rows.sparkSession
    names = [*languages, "und"]
    shared = spark.sparkContext.broadcast(model)
    size = len(languages)
    made = ("language", "probability", "text_language", "und_probability")
    kept = [c for c in rows.columns if c != text_col and c.lower() not in made]

    @F.arrow_udf("struct<logs:array<double>,soft:array<double>>")
    def evidence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """The text's log likelihoods, none for an empty one, and its languages' shares, none where `und` is likeliest."""
        table = shared.value
        for texts in batches:
            logs: list[list[float]] = []
            for text in texts.to_pylist():
                found = log_likelihoods(table, markup_text(text) if markup else text)
                if found is None and text.strip():  # marks and digits alone are no language
                    logs.append([-50.0] * size + [0.0])
                else:
                    logs.append([] if found is None else (found * temper).tolist())
            soft = [[0.0] * size if not x or max(x) == x[size] else _softmax(np.array([x[:size]]))[0].tolist() for x in logs]
            doubles = pa.list_(pa.float64())
            yield pa.StructArray.from_arrays([pa.array(logs, doubles), pa.array(soft, doubles)], ["logs", "soft"])
            release()

    host = F.lower(host) if host is not None else F.lit(None).cast("string")
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    said = F.lower(F.substring(declared, 1, 2)) if declared is not None else F.lit(None).cast("string")
    # the input's other columns travel in one, so that their names do not matter
    domain = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
    own = rows.select(
        F.struct(*([F.col(f"`{c}`") for c in kept] or [F.lit(0)])).alias("row"), host.alias("host"), domain.alias("domain"), F.element_at(labels, -1).alias("suffix"),
        F.when(said.isin(languages), said).alias("said"), evidence(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text"),
    )
    own = materialize(own.select("row", "host", "domain", "suffix", "said", "text.logs", "text.soft"), "evidence")
    sums = [F.sum(F.col("soft")[i]).alias(f"n{i}") for i in range(size)]

    # how often texts in each language declare each language: at most size x size numbers
    heard = {(r["said"], i): r[f"n{i}"] for r in own.where("said is not null").groupBy("said").agg(*sums).collect() for i in range(size)}
    likely = {d: [math.log((heard.get((d, i), 0) + 1) / (sum(heard.get((e, i), 0) for e in languages) + size)) for i in range(size)] for d in languages}
    # hosts, smoothed by their domains, smoothed by all
    everyone = own.agg(*sums, F.count("*").alias("k")).first()
    total = sum(everyone[f"n{i}"] or 0 for i in range(size))
    whole = np.array([((everyone[f"n{i}"] or 0) + 1) / (total + size) for i in range(size)])
    of = lambda c: F.array(*[F.col(f"n{i}") for i in range(size)]).alias(c)
    hosts = materialize(own.where("host is not null").groupBy("host", "domain").agg(*sums, F.count("*").alias("k")), "hosts")
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(size)], F.count("*").alias("hosts")).select("domain", of("of_domain"), "hosts")
    hosts = skew_safe_join(hosts.select("host", "domain", of("of_host"), "k"), domains, ["domain"], "hosts", everyone["k"]).drop("domain")
    none = F.lit(None).cast("array<double>")
    own = skew_safe_join(own.where("host is not null").drop("domain"), hosts, ["host"], "k", everyone["k"]).unionByName(own.where("host is null").drop("domain").withColumns({"of_host": none, "of_domain": none}))

    @F.arrow_udf("struct<language:string,probability:double,text_language:string,und_probability:double>")
    def fuse(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        def numbers(lists: pa.Array, width: int) -> np.ndarray:
            return np.array([x or [0.0] * width for x in lists.to_pylist()], float).reshape(-1, width)

        for logs, soft, of_host, of_domain, said, suffix in batches:
            mine, there = numbers(soft, size), np.array([bool(x) for x in logs.to_pylist()], bool)
            # the row's own text is left out of its host's and domain's counts
            site, wide = (np.maximum(numbers(c, size) - mine, 0) for c in (of_host, of_domain))
            smooth = (wide + strength * whole) / (wide.sum(1, keepdims=True) + strength)
            prior = (site + strength * smooth) / (site.sum(1, keepdims=True) + strength)
            told = np.array([likely.get(d, [0.0] * size) for d in said.to_pylist()]).reshape(-1, size)
            of_suffix = np.array([[math.log(SUFFIX_ODDS) if SUFFIXES.get(x) == lang else 0.0 for lang in languages] for x in suffix.to_pylist()]).reshape(-1, size)
            text = numbers(logs, size + 1)
            # without any evidence nothing speaks against `und`
            bare = ~there & ~said.is_valid().to_numpy(zero_copy_only=False) & ~of_host.is_valid().to_numpy(zero_copy_only=False)
            und = np.where(bare, 50.0, np.where(there, text[:, size], -50.0) + math.log(1e-3))
            p = _softmax(np.column_stack([text[:, :size] + told + of_suffix + np.log(prior), und]))
            best = p.argmax(1)
            cols = [pa.array([names[i] for i in best], pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array([names[i] if t else None for i, t in zip(text.argmax(1), there, strict=True)], pa.string()), pa.array(p[:, size])]
            yield pa.StructArray.from_arrays(cols, list(made))

    done = own.select("row", fuse("logs", "soft", "of_host", "of_domain", "said", "suffix").alias("found"))
    return done.select(*[F.col("row")[c].alias(c) for c in kept], "found.*")
