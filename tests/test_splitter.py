"""The splitter and its queries against a plain list-based one."""

import random
import re

from pyspark.sql import functions as F

from corpusmill import catalog
from corpusmill.functions import html_text, splitter
from corpusmill.functions import text as T
from corpusmill.operators import popularity

from .conftest import DATA


def plain_split(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """By lists of parts, one after the other."""
    separator = next(s for s in separators if s in text)
    finer = separators[separators.index(separator) + 1 :]
    parts = text.split(separator) if separator else list(text)
    parts = [p for p in (parts[:1] + [separator + p for p in parts[1:]]) if p]
    out, run = [], []

    def close():
        window = []
        for part in [*run, None]:
            if window and (part is None or len("".join(window)) + len(part) > size):
                if "".join(window).strip():
                    out.append("".join(window).strip())
                while part is not None and window and (len("".join(window)) > overlap or len("".join(window)) + len(part) > size):
                    del window[0]
            window.append(part)
        run.clear()

    for part in parts:
        if len(part) < size:
            run.append(part)
        else:
            close()
            out.extend(plain_split(part, size, overlap, finer) if finer else [part])
    close()
    return out


def plain_finish(chunks, least, min_words):
    """Every short chunk goes to the chunk before it, leading ones to the first long one."""
    chunks = [c for c in chunks if len(c.split()) >= least]
    if not min_words:
        return chunks
    groups = [[]]
    for c in chunks:
        if len(c.split()) >= min_words and any(len(x.split()) >= min_words for x in groups[-1]):
            groups.append([])
        groups[-1].append(c)
    out = []
    for group in groups:
        k = next((i for i, c in enumerate(group) if len(c.split()) >= min_words), len(group))
        lead = " ".join(group[:k]).strip()
        out.append(" ".join([lead] * (k > 0) + group[k:]))
    return out if chunks else []


def normalized(text):
    for pattern, to in ((r"\n{3,}", "\n\n"), (r" {3,}", " "), (r"\t{3,}", "\t"), (r"[ \t]*\n[ \t]*", "\n")):
        text = re.sub(pattern, to, text)
    return text


def texts(n, rng):
    return ["".join(rng.choice(["ab", "c", " ", "\n", "\n\n", "\t", "é", "\U0001f600", "　"]) for _ in range(rng.randrange(70))) for _ in range(n)]


def test_random_texts_split_alike():
    rng = random.Random(8)
    for text in texts(3000, rng):
        size = rng.randrange(1, 25)
        overlap = rng.randrange(0, size + 1)
        assert splitter.split_recursive(text, size, overlap) == (plain_split(text, size, overlap) if text else []), (text, size, overlap)


def test_a_very_long_text_without_blanks_is_split():
    chunks = splitter.split_recursive("x" * 3_000_000 + " y", 1000, 300)
    assert {len(c) for c in chunks[:-2]} == {1000} and "".join(c[300:] for c in chunks[1:-1]).count("x") + 1000 == 3_000_000 and chunks[-1] == "y"


def test_discarding_and_joining_equal_the_columns_and_the_plain_way(spark):
    rng = random.Random(4)
    lists = [[" ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))) + rng.choice(["", " "]) for _ in range(rng.randrange(9))] for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<string>")
    by_columns = {r.i: r.c for r in df.select("i", splitter.combine_short(splitter.discard_short(F.col("x"), 2), 5).alias("c")).collect()}
    for i, x in enumerate(lists):
        got = splitter.finished(x, 2, 5)
        assert [c for c, _ in got] == by_columns[i] == plain_finish(x, 2, 5)
        assert [k for _, k in got] == [len(c.split()) for c, _ in got]


def test_null_and_empty_texts_and_sizes_by_row(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "aa bb cc", 5), (4, "aa bb cc", 9)], "i int, t string, n int")
    got = {r.i: r.c for r in df.select("i", splitter.split_counted(F.col("t"), F.col("n"), 0).alias("c")).collect()}
    assert got[1] is None and got[2] == []
    assert [tuple(x) for x in got[3]] == [("aa bb", 2), ("cc", 1)] and [tuple(x) for x in got[4]] == [("aa bb cc", 3)]


def test_split_text_chunks_equals_the_plain_way(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text", popularity.random_chunk_size(F.col("doc_id")).alias("n")).collect()
    want = {(r.doc_id, k, c) for r in docs for k, c in enumerate(plain_finish(plain_split(normalized(r.text), r.n, 300) if r.text else [], 12, 45))}
    got = [tuple(r) for r in catalog.QUERIES["split_text_chunks"](spark, f"{DATA}/sf0.001").collect()]
    assert len(got) == len(want) and set(got) == want


def test_create_chunks_equals_the_plain_way(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").collect()
    found = {r.page_id: normalized(html_text.html_to_text(r.html)) for r in pages if r.html}
    want = {(f"Page {i}", k, c) for i, text in found.items() if text for k, c in enumerate(plain_split(text, 1000, 200))}
    got = catalog.QUERIES["create_chunks"](spark, f"{DATA}/sf0.001").select("source_title", "chunk_index", "chunk_text").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_prefix_chunks_equals_the_plain_way(spark):
    articles = catalog._articles(spark, f"{DATA}/sf0.001").select("title", "text", popularity.random_chunk_size(T.title_match(F.col("title"))).alias("n")).collect()
    want = []
    for r in articles:
        for k, c in enumerate(plain_finish(plain_split(normalized(r.text.strip()), r.n, 300) if (r.text or "").strip() else [], 12, 45)):
            want.append((r.title, k, f"This is text from the wikipedia article with title: '{r.title.strip()}'\n{c}", len(c.split()), r.n))
    got = catalog.QUERIES["prefix_chunks"](spark, f"{DATA}/sf0.001").select("title", "chunk_idx", "chunk_text", "word_count_chunk", "chunk_size").collect()
    assert sorted(map(tuple, got)) == sorted(want)
