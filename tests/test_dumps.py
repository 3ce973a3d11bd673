"""Dumps by offset, SQL dumps by byte range, wikitext forms."""

import bz2
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.wikitext import parse_wikitext
from corpusmill.sources import multistream, sqldump, wikidump

FORMS = {
    "nested templates": ("a {{T|x={{U|y}}|[[L]]}} b", "a  b", ["L"], ["U", "T"], []),
    "template over lines with a table": ("{{A\n|x=1\n|t={|\n|q\n|}\n}}z", "z", [], ["A"], []),
    "parameters": ("{{{p|def}}} {{{q}}} {{a|b}}}", "def  }", [], ["a"], []),
    "table": ("x\n{| class=y\n|-\n| [[A]] || {{B}}\n|}\nafter", "x\n\nafter", ["A"], ["B"], []),
    "table in a table": ("{|\n| a\n{|\n| [[I]]\n|}\n|}\nend", "\nend", ["I"], [], []),
    "file with a link in its caption": ("[[File:x.jpg|thumb|a [[B|bee]] c]] d", " d", ["B", "File:x.jpg"], [], []),
    "refs": ("x<ref>see [http://a.b c] {{cite}} [[R]]</ref> y <ref name=z/> z", "x y  z", ["R"], ["cite"], ["http://a.b"]),
    "ref in a template": ("{{T|a<ref>{{U}}</ref>}}b", "b", [], ["U", "T"], []),
    "nowiki, pre and comments": ("<nowiki>[[no]] ''q'' &amp;</nowiki><!-- [[c]] {{d}} --><pre>{{z}}\n* y</pre>", "[[no]] ''q'' &amp;{{z}}\n* y", [], [], []),
    "other languages' content": ("<math>x_{[[y]]}</math><gallery>\nFile:a.jpg|[[b]]\n</gallery>.", ".", [], [], []),
    "external links": ("[http://x.y/z shown text] http://bare.org/a. [//p.q r] [mailto:a@b.c m] [http://u.v]", "shown text http://bare.org/a. r m ", [], [], ["http://x.y/z", "http://bare.org/a", "//p.q", "mailto:a@b.c", "http://u.v"]),
    "lines": ("== H ==\n* item\n## [[n|m]]\n----\n:ind\na = b", "H\nitem\nm\n\nind\na = b", ["n"], [], []),
    "marks and tags": ("'''b''' ''i'' __NOTOC__<b>bold</b><br/> &lt;x&gt; <div class='c'>d</div>", "b i bold <x> d", [], [], []),
    "categories": ("[[Category:C|k]][[:Category:D]] [[a#s|t]]", "Category:D t", ["Category:C", ":Category:D", "a#s"], [], []),
    "link over a pipe in a template": ("[[a|{{b|c}}d]]", "d", ["a"], ["b"], []),
    "what is not closed": ("{{a|[[b}} c]] [[x {{y", " c]] [[x {{y", [], ["a"], []),
    "table that is not closed": ("a\n{| x\n| [[l]]", "a\n{| x\n| l", ["l"], [], []),
    "ends alone": ("a }} b ]] c ] d\n|}\ne", "a }} b ]] c ] d\n\ne", [], [], []),
    "nothing": ("", "", [], [], []),
}


@pytest.mark.parametrize("form", FORMS)
def test_wikitext_forms(form):
    text, *want = FORMS[form]
    got = parse_wikitext(text)
    assert [got["plain_text"], got["links"], got["templates"], got["external_links"]] == want


def test_wikitext_takes_any_marks():
    rng = random.Random(4)
    marks = ["{{", "}}", "[[", "]]", "{|", "\n{|", "\n|}", "|", "<ref>", "</ref>", "<nowiki>", "</nowiki>", "<!--", "-->", "{{{", "}}}", "[http://a ", "]", "''", "\n", "== ", "w", " "]
    for _ in range(2000):
        text = "".join(rng.choice(marks) for _ in range(rng.randrange(30)))
        got = parse_wikitext(text)
        assert got["plain_text"].count("w") <= text.count("w")
    deep = parse_wikitext("{{a|" * 5000 + "x" + "}}" * 5000)
    assert len(deep["templates"]) == 5000 and deep["plain_text"] == ""


# dumps


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dump")
    i = F.col("id")
    text = F.concat(F.lit("text é & <"), i.cast("string"), F.lit("> "), F.repeat(F.sha2(i.cast("string"), 256), 40))
    element = multistream.page_element(F.concat(F.lit("T"), i.cast("string")), F.lit(0), i, text, F.lit(None).cast("string"), F.lit("2024-09-01T12:34:56Z"))
    multistream.write_dump(spark.range(0, 700, 1, 2).select(i.alias("page_id"), F.concat(F.lit("T"), i.cast("string")).alias("title"), element.alias("record")), str(path), 20)
    return path


def offsets(spark, dump, tmp_path):
    multistream.write_offsets(spark, str(dump / "*-index.txt.bz2"), str(tmp_path / "o"))
    return str(tmp_path / "o")


def test_pages_by_offset_equal_those_of_the_whole(spark, dump):
    by_offset = wikidump.read_pages_by_offset(spark, str(dump), str(dump / "*-index.txt.bz2"), 3000)
    assert by_offset.rdd.getNumPartitions() > 10
    whole = wikidump.read_pages(spark, str(dump / "*.xml.bz2"))
    assert by_offset.count() == 700 and sorted(map(str, by_offset.collect())) == sorted(map(str, whole.collect()))
    # one file by its own name
    (name, *_) = sorted(dump.glob("*.xml.bz2"))
    one = wikidump.read_pages_by_offset(spark, str(name), str(dump / "*-index.txt.bz2"))
    assert one.count() == 350


def test_each_stream_is_read_by_one_task(spark, dump, tmp_path):
    rows = multistream.read_records(spark, str(dump), offsets(spark, dump, tmp_path), 2500).withColumn("task", F.spark_partition_id())
    seen = rows.groupBy("file", "offset").agg(F.countDistinct("task").alias("tasks"), F.count("*").alias("pages")).collect()
    assert len(seen) == 36 and all(r.tasks == 1 for r in seen) and sum(r.pages for r in seen) == 700


def test_a_damaged_stream_is_reported_and_the_others_are_read(spark, dump, tmp_path):
    at = offsets(spark, dump, tmp_path)
    found = sorted((r.file, r.offset) for r in spark.read.parquet(at).collect())
    broken = tmp_path / "broken"
    broken.mkdir()
    for f in dump.glob("*.xml.bz2"):
        data = bytearray(f.read_bytes())
        own = [o for n, o in found if n == f.name]
        data[own[3] + 200 : own[3] + 240] = bytes(40)
        (broken / f.name).write_bytes(data[: own[-1] + 50])  # the last stream is cut off
    rows = multistream.read_records(spark, str(broken), at, 4000)
    errors = rows.where("error is not null").collect()
    by_file = {n: [o for m, o in found if m == n] for n, _ in found}
    assert sorted((r.file, r.offset) for r in errors) == sorted((n, o[k]) for n, o in by_file.items() for k in (3, -1)) and all(r.record is None for r in errors)
    assert rows.where("record is not null").select("file", "offset").distinct().count() == len(found) - 4


def test_index_lines_without_a_number_and_repeated_ones(spark, tmp_path):
    (tmp_path / "d-index.txt").write_text("5:1:A\n5:2:B: x\nx\n\n3:1:C\n")
    multistream.write_offsets(spark, str(tmp_path / "d-index.txt"), str(tmp_path / "o"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).collect())) == [("d.xml.bz2", 3), ("d.xml.bz2", 5)]


def test_empty_dump(spark, tmp_path):
    multistream.write_dump(spark.createDataFrame([], "page_id long, title string, record string"), str(tmp_path / "e"))
    (tmp_path / "e-index.txt").write_text("")
    assert wikidump.read_pages_by_offset(spark, str(tmp_path / "e"), str(tmp_path / "e-index.txt")).collect() == []


def test_stream_of_several_reads(tmp_path):
    page = b"<page><title>" + random.Random(1).randbytes(3_000_000).hex().encode() + b"</title></page>"
    (tmp_path / "x").write_bytes(b"head" + bz2.compress(page * 2) + bz2.compress(b"<page>next</page>"))
    with open(tmp_path / "x", "rb") as f:
        got = list(multistream.stream_pages(f, 4))
        assert [r for records, _ in got for r in records] == [page.decode()] * 2 and all(e is None for _, e in got)


# SQL dumps

NASTY = ["a;\nb", "it's", "\\", "a\\'; b", '"', "`", "/* no", "*/", "-- x\n", "# y\n", "é 日本 😀", "", "\n\n;\n", "),(1,'x'", "NULL", "tab\tq\rw", "null\0x"]


def quoted(v):
    if v is None:
        return "NULL"
    if isinstance(v, int):
        return str(v)
    return "'" + v.replace("\\", "\\\\").replace("'", "''" if len(v) % 2 else "\\'").replace("\0", "\\0") + "'"


def statements(rng, table, rows):
    out, at = [], 0
    while at < len(rows):
        n = rng.randrange(1, 6)
        out.append(f"INSERT INTO `{table}` VALUES {rng.choice([',', ', ', ',\n']).join('(' + ','.join(map(quoted, r)) + ')' for r in rows[at : at + n])};")
        at += n
    return out


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_sql_dumps_by_range(spark, tmp_path, size):
    rng = random.Random(size)
    want = {}
    for lang in ("is", "no", "en"):
        rows = [(i, rng.choice(NASTY), rng.choice([None, *NASTY])) for i in range(12)]
        other = [(i, rng.choice(NASTY)) for i in range(5)]
        parts = statements(rng, "page", rows) + statements(rng, "pagelinks", other)
        rng.shuffle(parts)
        (tmp_path / lang).mkdir()
        head = "-- it's a dump; of\n/*!40000 ALTER TABLE `page` DISABLE; 'KEYS */;\nCREATE TABLE `page` (\n  `id` int COMMENT 'a;b',\n  `t` text\n);\n# don't\n"
        (tmp_path / lang / "d.sql").write_text(head + "\n".join(parts) + rng.choice(["", "\n", "\n-- end; 'x\n"]), newline="")
        want[lang] = sorted((str(a), b, c) for a, b, c in rows)
    (tmp_path / "notes.txt").write_text("INSERT INTO page VALUES (1,'x','y');")
    got = sqldump.read_sql_dumps(spark, str(tmp_path), "page", ["id", "a", "b"], ["is", "no"], size).collect()
    assert {r.schema for r in got} == {"iswiki", "nowiki"}
    for lang in ("is", "no"):
        assert sorted(((r.id, r.a, r.b) for r in got if r.lang == lang), key=str) == sorted(want[lang], key=str)
    whole = sqldump.read_sql_dump(spark, str(tmp_path / "en"), "pagelinks", ["id", "t", "more"], size)
    assert whole.where("more is not null").count() == 0 and whole.count() == 5


def test_sql_values():
    rows = lambda s: list(sqldump.sql_tuples(s))
    assert rows("INSERT INTO `t` VALUES (1,'a\\'b,(c)',NULL),(2,'it''s',3.5);") == [["1", "a'b,(c)", None], ["2", "it's", "3.5"]]
    assert rows("INSERT INTO t VALUES (1,'a;\nb'),(2,'c');") == [["1", "a;\nb"], ["2", "c"]]
    assert rows('INSERT IGNORE INTO `db`.`t` (`a`, b) VALUES\n ( -1.5e3 , _binary \'x\\n\', "q""r", 0x1F, now() );') == [["-1.5e3", "x\n", 'q"r', "0x1F", "now()"]]


def test_columns_in_the_statements_order(spark, tmp_path):
    (tmp_path / "a.sql").write_text("REPLACE INTO t (b, `A`) VALUES ('x', 1);\nINSERT INTO T VALUES (2, 'y');\nINSERT INTO tt VALUES (3, 'z')")
    got = sqldump.read_sql_dump(spark, str(tmp_path), "t", ["a", "b"]).collect()
    assert sorted(map(tuple, got)) == [("1", "x"), ("2", "y")]


def test_empty_sql_files(spark, tmp_path):
    (tmp_path / "a.sql").write_text("")
    (tmp_path / "b.sql").write_text("-- nothing\n")
    assert sqldump.read_sql_dump(spark, str(tmp_path), "t", ["a"]).collect() == []


def test_a_page_is_parsed_once_and_tokens_are_those_of_a_plain_search(spark, monkeypatch):
    import random

    from corpusmill.functions import wikitext
    from corpusmill.sources import wikidump

    rows = [("<page><title>A</title><ns>0</ns><id>7</id><revision><text>{{x}} [[Category:C]] one two</text></revision></page>",), ("<page><title>B</title><ns>1</ns><id>8</id><revision><text>talk</text></revision></page>",)]
    found = wikidump.articles(wikidump.pages_of(spark.createDataFrame(rows, "record string")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_xml(") == 1 and plan.count("ArrowEvalPython") == 1
    assert [(r.page_id, r.word_count, r.categories, r.template_count) for r in found.collect()] == [(7, 2, "C", 1)]

    rng, bits = random.Random(3), ["<!--", "-->", "<pre>", "</pre>", "<ref>", "</ref>", "{{{", "{{", "}}", "}", "[", "]", "[[", "]]", "|", "{|", "|}", "\n", " ", "\t", ":", "http://a.b/c", "HTTPS://x", "ftp://z", "//", "'", "'''", "_", "__TOC__", "ab", "== h ==", "#", "----"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(5000)]
    fast = [wikitext.parse_wikitext(t) for t in texts]
    monkeypatch.setattr(wikitext, "_next_token", lambda t, at: wikitext._TOKEN.search(t, at))
    assert fast == [wikitext.parse_wikitext(t) for t in texts]


def test_a_long_quoted_value_is_passed_over_without_a_note_for_each_character():
    import tracemalloc

    from corpusmill.sources import sqldump

    value = b"it\\'s " + b"x" * 1_000_000
    tracemalloc.start()
    try:
        assert sqldump.scan(value + b"';", "'") == ("", [len(value) + 2])
        assert sqldump.scan(value, "'") == ("'", [])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 10_000_000
    row = list(sqldump.sql_tuples("INSERT INTO `p` VALUES (1,'" + "y" * 100_000 + "''\\'" + "'),(2,NULL);"))
    assert row == [["1", "y" * 100_000 + "''"], ["2", None]]
