import bz2
import datetime
import json

import pytest
from pyspark.sql import functions as F

from corpusmill import sinks
from corpusmill.functions import splitter
from corpusmill.operators import chunks, embedding, filters, graph, joins, popularity, rag, stats, vectors
from corpusmill.sources import pageviews, web, wikidump

LINES = "aa.wikibooks - null mobile-web 11 G2U1V8\nis.wikipedia Foo_Bar 12 desktop 6 A2B1M1V1\\1\nis.wikipedia Short desktop 3 A3\nis.wikipedia Foo_Bar null desktop x A2\n"


def test_pageviews(spark, tmp_path):
    (tmp_path / "pageviews-202409-user.bz2").write_bytes(bz2.compress(LINES.encode()))
    (tmp_path / "other.bz2").write_bytes(bz2.compress(LINES.encode()))
    lines = pageviews.read_lines(spark, str(tmp_path))
    assert [tuple(r) for r in pageviews.parse(lines, ["is.wikipedia"], "month").collect()] == [("202409", "is.wikipedia", "Foo_Bar", "12", 6)]
    assert pageviews.parse(lines).count() == 2
    strict = pageviews.parse_strict(lines.where("value not like '%x A2'"))
    assert strict.count() == 2
    with pytest.raises(Exception, match="unexpected columns"):
        pageviews.parse_strict(spark.createDataFrame([("a b",)], "value string")).collect()
    assert pageviews.previous_month(2024, 1) == (2023, 12)


PAGES = """<mediawiki><page><title>A</title><ns>0</ns><id>1</id><revision><id>9</id><timestamp>2024-09-01T12:34:56Z</timestamp><contributor><username>u</username><id>77</id></contributor><text>one two [[B]] [[Category:C]] {{T}}</text></revision></page>
<page><title>B</title><ns>0</ns><id>2</id><redirect title="A" /><revision><id>10</id><text>#REDIRECT [[A]]</text></revision></page>
<page><title>D</title><ns>0</ns><id>3</id><revision><id>11</id><text>{{disambiguation}} x</text></revision></page>
<page><title>T:x</title><ns>1</ns><id>4</id><revision><id>12</id><text>talk</text></revision></page></mediawiki>"""


def test_dump(spark, tmp_path):
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(PAGES[:300].encode()) + bz2.compress(PAGES[300:].encode()))
    pages = wikidump.read_pages(spark, str(tmp_path / "d.xml.bz2"))
    assert pages.count() == 4
    (row,) = wikidump.articles(pages, "is").collect()
    assert (row.page_id, row.title, row.url, row.word_count, row.outlink_count, row.categories, row.template_count) == (1, "A", "https://is.wikipedia.org/wiki/A", 3, 2, "C", 1)
    assert row.last_modified == datetime.datetime(2024, 9, 1, 12, 34, 56)
    counted = stats.counters(pages.withColumn("redirect", F.when(F.col("is_redirect"), "x"))).first()
    assert tuple(counted) == (3, 2, 1)
    (tmp_path / "i.txt").write_text("5:1:A\n5:2:B\nx\n3:1:C\n")
    assert [r.offset for r in wikidump.read_offsets(spark, str(tmp_path / "i.txt")).collect()] == [3, 5]
    assert [r.page_id for r in wikidump.first_pages(pages, 2).collect()] == [1, 2]


def test_web(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"name": "é", "url": "u", "main_text": "t"}]')
    assert tuple(web.read_json_array(spark, str(tmp_path / "a.json")).first()) == ("é", "u", "t")
    (tmp_path / "s.yaml").write_text('a:\n  b:\n    dimension: 1536  \n    is_local: false\n    n: "x y"\nc: 1.5 # note\n')
    assert web.settings(str(tmp_path / "s.yaml")) == {"a": {"b": {"dimension": 1536, "is_local": False, "n": "x y"}}, "c": 1.5}
    df = spark.createDataFrame([("u1",), (None,)], "url string").select(web.fetched(F.col("url"), lambda u: u.upper()).alias("b"))
    assert sorted((r.b or "") for r in df.collect()) == ["", "U1"]


def test_tables(spark, tmp_path):
    views = spark.createDataFrame([("is", "A", 1, ["1"], "202401"), ("is", "A", 2, ["1"], "202402")], "wiki_code string, article_title string, views long, page_ids array<string>, month string")
    for _ in range(2):
        sinks.write_views(views, str(tmp_path / "v"))
    assert sinks.read_views(spark, str(tmp_path / "v")).count() == 2
    store = sinks.chunk_store(spark, str(tmp_path / "c"))
    rows = chunks.create_chunks(spark.createDataFrame([("t", "u", "<p>x y</p>")], "title string, url string, text string"), "icelandic", "is-index", "n")
    sinks.insert_chunks(store, rows)
    sinks.insert_chunks(store, rows)
    assert store.read().count() == 1
    store.delete(rows.select("id"))
    assert store.read().count() == 0


def _articles(spark):
    df = spark.createDataFrame([("a b", "A b", "u", 40, "x " * 40), ("c", "C", "v", 3, "y z w")], "title_match string, title string, url string, word_count int, text string")
    return chunks.chunk_articles(df, "text", 30, 5, 0, 0)


def test_embed_resumes(spark, tmp_path):
    table = sinks.create_index(spark, str(tmp_path / "reg"), str(tmp_path / "ix"), "is-index", 16)
    articles, provider, path = _articles(spark), embedding.HashProvider(16), str(tmp_path / "ck")
    first = embedding.embed_articles(articles.where("title = 'C'"), table, "n", path, provider)
    rest = embedding.embed_articles(articles, table, "n", path, provider)
    total = articles.agg(F.sum("n_chunks")).first()[0]
    assert first + rest == total == table.read("n").count()
    assert embedding.embed_articles(articles, table, "n", path, provider) == 0
    assert joins.pending_articles(articles, spark.createDataFrame([("c", 0)], "title_match string, chunk_idx int")).count() == 1
    table.delete_all("n")
    assert table.read("n").count() == 0
    with pytest.raises(ValueError, match="16"):
        sinks.create_index(spark, str(tmp_path / "reg"), str(tmp_path / "ix"), "is-index", 8)


class _FailsOnce:
    """A provider that fails on texts with a word, as long as a file is there."""

    def __init__(self, word, flag):
        self.word, self.flag, self.given = word, flag, embedding.HashProvider(16)

    def __call__(self, texts):
        import os

        if os.path.exists(self.flag) and any(self.word in t for t in texts):
            raise RuntimeError("service is away")
        return self.given(texts)


def test_embed_keeps_batches_before_a_failure(spark, tmp_path):
    rows = [(f"t{i}", f"T{i}", "u", 2, f"word{i} end") for i in range(6)]
    articles = chunks.chunk_articles(spark.createDataFrame(rows, "title_match string, title string, url string, word_count int, text string"), "text", 30, 5, 0, 0)
    table = sinks.create_index(spark, str(tmp_path / "reg"), str(tmp_path / "ix"), "is-index", 16)
    bucket = table.of("n").bucket(vectors.vector_id(True))
    batch = {r.title_match: r.b for r in articles.withColumn("chunk_idx", F.lit(0)).select("title_match", F.floor(bucket * 3 / table.buckets).alias("b")).collect()}
    last = max(batch, key=batch.get)
    flag, path = tmp_path / "away", str(tmp_path / "ck")
    flag.touch()
    provider = _FailsOnce("word" + last[1:], str(flag))
    with pytest.raises(Exception, match="away"):
        embedding.embed_articles(articles, table, "n", path, provider, articles_per_batch=2)
    before = sum(b < batch[last] for b in batch.values())
    assert 0 < before == spark.read.parquet(path).count() == table.read("n").count()
    flag.unlink()
    assert embedding.embed_articles(articles, table, "n", path, provider, articles_per_batch=2) == len(rows) - before
    assert table.read("n").count() == spark.read.parquet(path).distinct().count() == len(rows)


def test_leading_short_chunks_are_stripped_as_a_whole(spark):
    df = spark.createDataFrame([([" a ", "b\t", "l o n g", "c ", "l o n g e r"],), ([" a ", " b "],), ([],)], "c array<string>")
    got = [r[0] for r in df.select(splitter.combine_short(F.col("c"), 3)).collect()]
    assert got == [["a  b l o n g c ", "l o n g e r"], ["a   b"], []]


def test_engine(spark):
    p = embedding.HashProvider(16)
    docs = spark.createDataFrame([("1", "red apple"), ("2", "green pear"), ("3", "blue sky")], "id string, chunk_text string")
    v = docs.select("id", embedding.embed(F.col("chunk_text"), p).alias("values"))
    engine = rag.Engine(v, docs, p, rag.EchoModel())
    row = engine.answer(spark.createDataFrame([(1, "red apple")], "qid int, question string"), "icelandic", top_k=2).first()
    assert row.chunks[0].id == "1" and row.answer.source_ids[0] == "1" and len(row.chunks) == 2
    told = rag.Engine(v, docs, p, lambda c, schema: [json.dumps({"response": m[0]["role"] + m[0]["content"] + m[1]["role"], "source_ids": schema["required"], "highlighted_response": []}) for m in c])
    row = told.answer(spark.createDataFrame([(1, "red apple")], "qid int, question string"), "icelandic").first()
    assert row.answer.response == "system" + rag.SYSTEM + "user" and row.answer.source_ids == ["response", "source_ids", "highlighted_response"]
    with pytest.raises(ValueError, match="Unsupported"):
        engine.answer(docs, "danish")
    with pytest.raises(Exception, match="lacks a field|JSON|json"):
        spark.range(1).select(rag.parse_response(F.lit('{"response": "x"}'))).collect()
    assert spark.range(1).select(rag.parse_response(F.lit("no"), strict=False).alias("a")).first().a is None


def test_scalable_ranks_are_not_gathered(spark):
    df = spark.createDataFrame([(1, 5), (2, 3), (3, 3), (4, None), (5, 9)], "id int, v int")
    got = {r.id: r.p for r in popularity.average_percent_rank(df, "v", "p", 3).collect()}
    assert got == {1: 0.75, 2: 0.375, 3: 0.375, 4: None, 5: 1.0}
    got = {r.id: r.p for r in popularity.percent_rank_scalable(df.where("v is not null").union(spark.createDataFrame([(6, 1)], "id int, v int")), "v", "p", 3).collect()}
    assert got == {5: 0.0, 1: 0.25, 2: 0.5, 3: 0.5, 6: 1.0}
    sizes = spark.range(500).select(popularity.random_chunk_size(F.col("id")).alias("s"))
    assert sizes.where("s < 1000 or s > 2000").count() == 0 and sizes.distinct().count() > 100


def test_filter_defaults_keep_all(spark):
    df = spark.createDataFrame([("a", "a", None, 1, 2, 3, 4)], "title string, title_match string, views long, word_count int, template_count int, outlink_count int, category_count int")
    kept, gone = filters.filter_articles(df, filters.FilterOptions())
    assert kept.count() == 1 and gone.count() == 0


def test_titles_of_one_key_are_not_discarded_beside_a_kept_one(spark):
    rows = [("Ab", "ab", 9, 1), ("AB", "ab", 0, 1), ("a_c", "a c", 0, 1), ("d", "d", 9, 1)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "title string, title_match string, views long, word_count int, template_count int, outlink_count int, category_count int")
    kept, gone = filters.filter_articles(df, filters.FilterOptions(min_views=5, min_word_count=2, keep_category_count=1))
    assert sorted(r.title for r in kept.collect()) == ["Ab", "d"] and [r.title_match for r in gone.collect()] == ["a c"]


def test_vectors_of_zeros(spark):
    v = spark.createDataFrame([("1", [0.0, 0.0]), ("2", [3.0, 4.0])], "id string, values array<float>")
    assert [(r.id, r.score) for r in vectors.search_one([0.0, 1.0], v, 2).collect()] == [("2", 0.8), ("1", 0.0)]
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 2.0])], "qid int, vector array<float>")
    got = {(r.qid, r.id): round(r.score, 6) for r in vectors.search(q, v, 2).collect()}
    assert got == {(1, "1"): 0.0, (1, "2"): 0.0, (2, "2"): 0.8, (2, "1"): 0.0}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f")], "src string, dst string")
    comp = {}
    for r in graph.strong_components(e).collect():
        comp.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, comp.values())) == [["a", "b", "c"], ["d", "e"], ["f"]]
    assert graph.largest_strong_component(e).first().size == 3
    ranks = {r.node: r["rank"] for r in graph.pagerank(e).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and max(ranks, key=ranks.get) == "d"
    assert {r.component for r in graph.weak_components(e).collect()} == {"a", "f"}


def test_search_checks(spark):
    v = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 2.0])], "id string, values array<float>")
    assert vectors.search_one([0.0, 1.0], v, 1).first().id == "2"
    with pytest.raises(Exception, match="does not have 3"):
        vectors.check_dimension(v, 3).collect()


def test_short_runs(spark):
    df = spark.createDataFrame([(1, ["a", "b", "l l l", "c", "l l l", "d"])], "k int, c array<string>")
    assert [r.joined for r in stats.short_runs(df, "k", "c", 3).collect()] == ["a | b", "c"]


def test_streaming(spark, tmp_path):
    from corpusmill.streaming.upserts import stream_upserts

    rows = chunks.prepare_chunks(_articles(spark))
    rows.write.parquet(str(tmp_path / "in"))
    table = sinks.VectorTable(spark, str(tmp_path / "ix"), 16)
    q = stream_upserts(spark, str(tmp_path / "in"), rows.schema.simpleString()[7:-1].replace(":", " "), table, "n", embedding.HashProvider(16), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert table.read("n").count() == rows.count()


def _bucket_files(path):
    found = {}
    for f in sorted(path.rglob("*.parquet")):
        found.setdefault(f.parent.name, []).append(f.name)
    return found


def test_an_upsert_rewrites_the_buckets_of_its_ids_only(spark, tmp_path):
    schema = "id string, v int"
    table = sinks.BucketTable(spark, str(tmp_path / "t"), schema, buckets=32)
    rows = [(f"k{i}", i) for i in range(500)]
    assert table.upsert(spark.createDataFrame(rows, schema)) == 500
    before = _bucket_files(tmp_path / "t")
    assert len(before) == 32 and all(len(f) == 1 for f in before.values())
    change = spark.createDataFrame([("k1", -1), ("k2", -2), ("new", 0), (None, 9)], schema)
    for _ in range(2):  # a repeated change gives the same table
        assert table.upsert(change) == 3
        after = _bucket_files(tmp_path / "t")
        assert 1 <= sum(after[b] != before[b] for b in before) <= 3
        assert {r.id: r.v for r in table.read().collect()} == dict(rows) | {"k1": -1, "k2": -2, "new": 0}
        assert table.read().count() == 501
    before = _bucket_files(tmp_path / "t")
    table.delete(spark.createDataFrame([("k5", 0), ("none", 0)], schema))
    assert sum(f != before[b] for b, f in _bucket_files(tmp_path / "t").items()) <= 2 and table.read().count() == 500
    table.clear()
    assert table.read().count() == 0
    table.clear()
    assert table.upsert(spark.createDataFrame([], schema)) == 0 and table.read().columns == ["id", "v"]
    assert table.upsert(spark.createDataFrame([("a", 1), ("a", 3), ("a", 2)], schema), F.desc("v")) == 3
    assert [tuple(r) for r in table.read().collect()] == [("a", 3)]


def test_a_bucket_that_loses_its_rows_is_empty(spark, tmp_path):
    table = sinks.BucketTable(spark, str(tmp_path / "t"), "id string, v int", buckets=4)
    table.upsert(spark.createDataFrame([("a", 1)], "id string, v int"))
    table.delete(spark.createDataFrame([("a", 1)], "id string, v int"))
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([("a", 2)], "id string, v int"))
    assert [r.v for r in table.read().collect()] == [2]


def test_an_articles_vectors_share_a_bucket_and_a_run_rewrites_each_once(spark, tmp_path):
    rows = [(f"t{i}", f"T{i}", "u", 2, f"word{i} end") for i in range(12)]
    articles = chunks.chunk_articles(spark.createDataFrame(rows, "title_match string, title string, url string, word_count int, text string"), "text", 30, 5, 0, 0)
    table = sinks.VectorTable(spark, str(tmp_path / "ix"), 16, buckets=8)
    assert embedding.embed_articles(articles, table, "n", str(tmp_path / "ck"), embedding.HashProvider(16), articles_per_batch=3) == 12
    assert all(len(f) == 1 for f in _bucket_files(tmp_path / "ix").values()) and table.read("n").count() == 12
    of = table.of("n")
    same = spark.createDataFrame([("ab_1",), ("ab_22",)], "id string").select(of.bucket(F.col("id")).alias("b")).distinct().count()
    assert same == 1


def test_search_in_blocks_of_queries(spark, monkeypatch):
    import random

    rng = random.Random(2)
    v = spark.createDataFrame([(str(i), [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)], "id string, values array<float>")
    q = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(50)], "qid int, vector array<float>")
    want = sorted((r.qid, r["rank"], r.id, round(r.score, 6)) for r in vectors.search(q, v, 3).collect())
    monkeypatch.setattr(vectors, "QUERY_BYTES", 500)
    got = vectors.search(q, v, 3)
    assert sorted((r.qid, r["rank"], r.id, round(r.score, 6)) for r in got.collect()) == want and len(want) == 150


def _deliver(folder, name, lines):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_bytes(bz2.compress("".join(f"{line}\n" for line in lines).encode()))


def test_late_and_repeated_pageview_files_give_the_table_of_the_batch_job(spark, tmp_path):
    from corpusmill.streaming.views import read_streamed_views, stream_views

    day = lambda k: [f"is.wikipedia T{i % 5} {'null' if i % 3 else i} desktop {i + k} A1" for i in range(20)] + ["is.wikipedia T short 3 A", "is.wikipedia T1 1 desktop x A", "fr.wikipedia T1 1 desktop 5 A"]
    files = {f"pageviews-2024{m:02}{d:02}-user.bz2": day(10 * m + d) for m in (1, 2) for d in (1, 2, 3)}
    names = sorted(files)
    inbox, args = tmp_path / "in", (str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "ck"), ["is.wikipedia"])
    rounds = [[(names[0], "a"), (names[4], "a")], [(names[1], "a"), (names[0], "again")], [(names[5], "b"), (names[5], "c"), (names[3], "a"), (names[2], "late")]]
    for delivered in rounds:
        for name, folder in delivered:
            _deliver(inbox / folder, name, files[name])
        assert stream_views(spark, *args).awaitTermination(120)
    got = sorted((r.month, r.article_title, r.views, tuple(r.page_ids)) for r in read_streamed_views(spark, args[1]).collect())
    for name, lines in files.items():
        _deliver(tmp_path / "all", name, lines)
    whole = popularity.monthly_views(pageviews.parse(pageviews.read_lines(spark, str(tmp_path / "all")), ["is.wikipedia"], "month"), "month")
    assert got == sorted((r.month, r.article_title, r.views, tuple(r.page_ids)) for r in whole.collect()) and len(got) == 10
    assert {r.wiki_code for r in read_streamed_views(spark, args[1]).collect()} == {"is.wikipedia"}


def test_readers_of_prefixes_samples_and_months(spark, tmp_path):
    (tmp_path / "x-user.bz2").write_bytes(bz2.compress(b"no.wikipedia A 1 desktop 2 A\nnov B 1 desktop 3 A\nis.wikipedia C 1 desktop 4 A\n"))
    lines = pageviews.read_lines(spark, str(tmp_path))
    assert sorted(r.article_title for r in pageviews.parse_strict(lines, "no").collect()) == ["A", "B"]
    assert pageviews.first_lines(lines, 2).count() == 2
    assert [r.url[-15:] for r in pageviews.month_urls(spark, "http://x/", 2023, 12, 2024, 1).collect()] == ["202312-user.bz2", "202401-user.bz2"]
    assert pageviews.urls_of_months(lines.select(F.lit(None).cast("timestamp").alias("t")), "t", "x").collect() == []


def test_articles_views_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "page_id int, title string")
    for lang in ("is", "no", "is"):
        sinks.write_articles(rows, str(tmp_path / "a"), lang)
    assert sorted((r.lang, r.page_id) for r in spark.read.parquet(str(tmp_path / "a")).collect()) == [("is", 1), ("no", 1)]
    assert sinks.create_if_absent(rows, "once") and not sinks.create_if_absent(rows.limit(0), "once") and spark.table("once").count() == 1
    sinks.create_view(rows, "seen")
    assert spark.table("seen").count() == 1
    for name in ("once", "seen", "once"):
        sinks.drop(spark, name)
    assert not spark.catalog.tableExists("once") and not spark.catalog.tableExists("seen")
    assert sinks.set_columns(rows, title=F.upper("title")).first().title == "A"
    sinks.write_json(spark.createDataFrame([("é",)], "t string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().t == "é" and any("é" in f.read_text() for f in (tmp_path / "j").glob("*.json"))


def test_first_of_repeated_pages(spark):
    pages = spark.createDataFrame([(1, 5, "b"), (1, 4, "c"), (2, None, "d"), (1, 4, "a")], "page_id int, revision_id int, title string")
    assert sorted((r.page_id, r.title) for r in wikidump.distinct_pages(pages).collect()) == [(1, "a"), (2, "d")]
    assert [tuple(r) for r in web.listing(spark.createDataFrame([('<div class="recent-answers"><a href="/a">A</a></div><a href="/b">B</a>',)], "h string"), "h").collect()] == [("A", "/a")]


def _plain_search(q, v, k):
    """Scores of all pairs, one number after the other; nulls last, ids decide."""
    out = []
    for qid, a in q:
        found = []
        for i, b in v:
            if a is None or b is None or len(a) != len(b):
                found.append((2, 0.0, i, None))
                continue
            d, x, y = (sum(map(float.__mul__, m, n)) if m else 0.0 for m, n in ((a, b), (a, a), (b, b)))
            s = max(-1.0, min(1.0, d / (x * y) ** 0.5)) if x and y else 0.0
            found.append((1, -s, i, s))
        out += [(qid, r, i, None if s is None else round(s, 9)) for r, (_, _, i, s) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_search_of_copies_zeros_nulls_and_other_dimensions_is_the_plain_search(spark, monkeypatch):
    import random

    rng = random.Random(5)
    own = [[float(rng.randrange(-4, 5)) for _ in range(3)] for _ in range(60)]
    v = [(str(i), own[rng.randrange(60)]) for i in range(400)] + [("z", [0.0] * 3), ("n", None), ("m", None), ("e", []), ("w", [1.0, 2.0]), ("w2", [3.0, 1.0])]
    q = [(i, own[i]) for i in range(40)] + [(40, None), (41, [0.0] * 3), (42, [1.0, 1.0]), (43, [])]
    monkeypatch.setattr(vectors, "_VECTORS", 16)
    tables = spark.createDataFrame(q, "qid int, vector array<float>"), spark.createDataFrame(v, "id string, values array<float>").repartition(3)
    got = sorted((r.qid, r["rank"], r.id, None if r.score is None else round(r.score, 9)) for r in vectors.search(*tables, 5).collect())
    assert got == _plain_search(q, v, 5)


def test_search_of_many_queries_scores_few_pairs_number_by_number(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.normal(size=(2000, 16))
    pairs = []
    plain = vectors._dot
    monkeypatch.setattr(vectors, "_dot", lambda a, b: pairs.append(len(a)) or plain(a, b))
    import pyarrow as pa

    top = vectors._Top(16, np.arange(200), values[:200], 5)
    for at in range(0, 2000, 500):
        some = values[at : at + 500]
        square = plain(some, some)
        top.add(some, square, vectors._unit(some, square), pa.array([str(i) for i in range(at, at + 500)]))
    assert sum(pairs[1:]) < 200 * 2000 / 50
    exact = (values[:200] @ values.T) / np.outer(np.linalg.norm(values[:200], axis=1), np.linalg.norm(values, axis=1))
    assert top.ids.to_pylist() == [str(i) for row in exact for i in np.argsort(-row)[:5]]


def test_search_deals_vectors_of_one_partition_to_tasks(spark, monkeypatch, tmp_path):
    plain, folder = vectors._best_of_task, str(tmp_path)

    def counted(batches, path, k):
        import uuid

        batches = list(batches)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(sum(b.num_rows for b in batches)))
        yield from plain(iter(batches), path, k)

    monkeypatch.setattr(vectors, "_best_of_task", counted)
    rows = [(i, [float(i % 7 + 1), float(i % 11), float(i % 13)]) for i in range(800)]
    v = spark.createDataFrame([(str(i), x) for i, x in rows], "id string, values array<float>").coalesce(1)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # so few rows would be merged again
    spark.conf.set(merging, "false")
    try:
        found = vectors.search(spark.createDataFrame(rows[::100], "qid int, vector array<float>"), v, 5).collect()
    finally:
        spark.conf.unset(merging)
    assert sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in found) == _plain_search(rows[::100], [(str(i), x) for i, x in rows], 5)
    seen = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(seen) == 800 and max(seen) < 400


def test_search_among_near_copies_is_exact_and_scores_few_pairs_at_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    values = rng.normal(size=32) + 1e-6 * rng.normal(size=(1000, 32))  # nearer to each other than products of floats can tell
    at_once, plain = [], vectors._dot
    square = plain(values, values)
    top = vectors._Top(32, np.arange(200), values[:200], 5)
    monkeypatch.setattr(vectors, "_dot", lambda a, b: at_once.append(len(a)) or plain(a, b))
    for at in range(0, 1000, 500):
        some = slice(at, at + 500)
        top.add(values[some], square[some], vectors._unit(values[some], square[some]), pa.array([f"{i:03}" for i in range(at, at + 500)]))
    assert sum(at_once) > 100_000 >= 3 * max(at_once)
    exact = [sorted((-min(1.0, s), f"{i:03}") for i, s in enumerate(plain(np.tile(values[q], (1000, 1)), values) / np.sqrt(square[q] * square)))[:5] for q in range(200)]
    assert list(zip((-top.score).tolist(), top.ids.to_pylist())) == [x for row in exact for x in row]
