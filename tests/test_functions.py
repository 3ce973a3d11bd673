import hashlib
import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import html_text, splitter, wikitext
from corpusmill.functions import text as T


def value(spark, column, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in cols.items()])
    return df.select(column.alias("v")).first().v


def test_whitespace(spark):
    assert value(spark, T.normalize_whitespace(F.col("x")), x="a\n \n \nb   c  d\t\t\te \n f\n\n\n\ng") == "a\n\n\nb c  d\te\nf\n\ng"


def test_title_keys(spark):
    assert value(spark, T.title_match(F.col("x")), x="Foo_Bar-Baz") == "foo bar-baz"
    assert value(spark, T.title_match_hyphen(F.col("x")), x=" Foo_Bar-Baz ") == "foo_barbaz"
    assert value(spark, T.title_normalized(F.col("x")), x=" Ðe Foo-Bär! ") == "e_foo-br"
    assert value(spark, T.vector_id(F.col("x"), F.lit(3)), x="A b") == "a_b_3"


def test_ids_and_urls(spark):
    title = "Þór & co/é*~+"
    assert value(spark, T.chunk_id(F.col("x"), F.lit("u"), F.lit(1)), x=title) == hashlib.md5((title + "u").encode()).hexdigest() + "#1"
    assert value(spark, T.quoted(F.col("x")), x=title) == urllib.parse.quote(title)
    assert value(spark, T.first_real_page_id(F.col("x")), x=["null", "7", None]) == "7"
    assert value(spark, T.first_real_page_id(F.col("x")), x=["null"]) is None
    assert value(spark, T.path_language(F.col("x")), x="a/is/dump.xml") == "is"


def test_word_counts(spark):
    x = " a\u00a0b\u2003c\x1cd  e\n"
    assert value(spark, T.word_count(F.col("x")), x=x) == len(x.split())
    assert value(spark, T.single_space_count(F.col("x")), x="a  b ") == 4
    assert value(spark, T.strip(F.col("x")), x=x) == x.strip()


def test_links_and_codes(spark):
    w = "[[A|b]] [[Category:C|k]] [[D]]"
    assert value(spark, T.link_targets(F.col("x")), x=w) == ["A", "Category:C", "D"]
    assert value(spark, T.category_bodies(F.col("x")), x=w) == ["C|k"]
    assert [tuple(r) for r in value(spark, T.symbol_counts(F.col("x")), x="A2B1\\3")] == [(1, 2), (2, 1), (28, 3)]
    assert value(spark, T.categories_of_links(F.col("x")), x=["Category: C ", "D"]) == ["C"]


@pytest.mark.parametrize(("text", "size", "overlap", "want"), [("aaa bbb ccc", 7, 3, ["aaa bbb", "ccc"]), ("aaa bbb ccc", 8, 4, ["aaa bbb", "bbb ccc"]), ("", 5, 0, []), ("abcdefgh", 3, 1, ["abc", "cde", "efg", "gh"])])
def test_splitter(text, size, overlap, want):
    assert splitter.split_recursive(text, size, overlap) == want


def test_splitter_properties():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "c", " ", "\n", "\n\n", "\U0001f600"]) for _ in range(rng.randrange(80)))
        size = rng.randrange(2, 20)
        chunks = splitter.split_recursive(text, size, rng.randrange(0, size))
        assert all(0 < len(c) <= size for c in chunks)
        assert set("".join(chunks)) - {" ", "\n"} == set(text) - {" ", "\n"}


def test_combine_short(spark):
    long_a, long_b = "a " * 5 + "A", "b " * 5 + "B"
    got = value(spark, splitter.combine_short(F.col("x"), 5), x=["s1", "s2", long_a, "s3", long_b, "s4"])
    assert got == [f"s1 s2 {long_a} s3", f"{long_b} s4"]
    assert value(spark, splitter.combine_short(F.col("x"), 5), x=["s1", "s2"]) == ["s1 s2"]
    assert value(spark, splitter.combine_short(F.array().cast("array<string>"), 5), x="") == []


def test_split_text_discards_and_joins(spark):
    got = value(spark, splitter.split_text(F.col("x"), 10, 0, 2, True, False, 0), x="aa bb cc\n\ndd\n\nee ff")
    assert got == ["aa bb cc", "dd\n\nee ff"] or got == ["aa bb cc", "ee ff"]


def test_html():
    page = '<p>a&amp;b</p><script>x</script><!-- c --><div id="s">pre<blockquote>q</blockquote><p>one</p>\n\n<p>two</p><p>Tilvísun: z</p><p>y</p></div>'
    assert html_text.html_to_text(page).split() == ["a&b", "pre", "q", "one", "two", "Tilvísun:", "z", "y"]
    assert html_text.main_article(page, "s", "Tilvísun:") == "one\ntwo"
    assert html_text.main_article(page, "none", "x") is None
    assert html_text.page_links('<div class="recent-answers x"><a href="/a"> A </a></div><a href="/b">B</a>', "recent-answers") == [{"name": "A", "url": "/a"}]


def test_wikitext():
    got = wikitext.parse_wikitext("'''Bold''' [[A|b]] {{T|x={{U}}}} [[Category:C]] [http://x.org site] <ref>r</ref>&amp; [[File:f.jpg|thumb|a [[B]]]]\n== H ==\n* item [[open")
    assert got["plain_text"].split() == ["Bold", "b", "site", "&", "H", "item", "[[open"]
    assert got["links"] == ["A", "Category:C", "B", "File:f.jpg"]
    assert got["templates"] == ["U", "T"]
    assert got["external_links"] == ["http://x.org"]


def test_pages_wait_for_no_collection_of_cycles_and_batches_are_small(spark):
    import gc

    import pyarrow as pa

    from corpusmill import catalog
    from corpusmill.functions import html_text

    page = "<div id=main><p>a<script>x</script><b>b</p>c<br/></div>" * 20
    gc.collect()
    gc.disable()
    try:
        html_text._map(pa.array([page] * 50), html_text.html_to_text, pa.string())
        html_text._map(pa.array([page] * 50), lambda v: html_text.main_article(v, "main", ""), pa.string())
        assert sum(isinstance(o, html_text._Node) for o in gc.get_objects()) == 0
    finally:
        gc.enable()
    assert html_text.html_to_text("<p>" * 5000 + "deep") == "deep"
    keys = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(k) for k in keys]
    try:
        pages = catalog.html_text_of_pages(spark, "/root/testdata/sf0.001")
        assert pages.count() == 50 and [int(spark.conf.get(k)) for k in keys] == [4 << 20, 500]
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
