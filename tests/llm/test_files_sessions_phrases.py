"""Token files by round trip, session versions and collocations against brute force in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import collocations, late_sessions, queries, token_files

from ..conftest import DATA

WORDS = public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows, schema="doc_id long, text string, lang string, ids binary, start long, part int, f long, phrase string"):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, b"", 1, 2, 3, "x") for r in rows], schema)


# token files


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 62), max_size=700), st.integers(0, 1 << 40))
def test_elias_fano_gives_each_value_back(values, beyond):
    values = sorted(values)
    universe = (values[-1] if values else 0) + beyond
    data = token_files.EliasFano.encode(np.array(values, np.uint64), universe)
    found = token_files.EliasFano(len(values), universe, data)
    assert found.all().tolist() == values and [found.select(i) for i in range(len(values))] == values
    assert len(data) == sum(token_files.EliasFano.sizes(len(values), universe))


def test_elias_fano_takes_few_bits():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000)).astype(np.uint64)
    data = token_files.EliasFano.encode(ends, int(ends[-1]))
    assert len(data) * 8 / len(ends) < 2.3 + np.log2(float(ends[-1]) / len(ends))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["Alpha", "beta,", "été", "don't", "x1", "😀", "<|endoftext|>"]) for _ in range(n))
    rows = [(7, None, "en"), (None, "no id", "en"), (None, "no id either", None), (3, "", "en"), (-5, " \n\t", "de"), (3, "again", "en"), (3, "again", "en"), (1 << 61, text(60_000), "en"), (-(1 << 61), "far", "en")]
    return rows + [(rng.randrange(1000), text(rng.randrange(30)), "fr") for _ in range(300)]


def expected(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    rows = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x, _ in docs]
    return rows


@pytest.mark.parametrize("file_ids", [200, 1 << 23])
def test_token_files_round_trip(spark, docs, file_ids):
    path = token_files.write_token_files(table(spark, docs).repartition(3), WORDS, end_id=1, file_ids=file_ids)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens) for r in token_files.read_token_files(spark, path).collect()]
    got.sort(key=lambda r: r[1])
    want = expected(docs)
    assert Counter((i, tuple(ids)) for i, _, ids, _ in got) == Counter((i, tuple(ids)) for i, ids in want)
    assert all(n == len(ids) for _, _, ids, n in got)
    keys = [(i is not None, i or 0) for i, *_ in got]
    assert keys == sorted(keys)
    at = 0
    for _, start, ids, _ in got:
        assert start == at
        at += len(ids)
    # single documents by their place
    asked = [0, 1, 5, len(got) // 2, len(got) - 1, len(got), None, -1]
    one = token_files.fetch_documents(spark.createDataFrame([(p,) for p in asked], "position long"), path).collect()
    assert {r.position: (r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in one} == {p: (got[p][0], got[p][2]) for p in asked[:5]}


def test_token_files_are_cut_by_size_and_checked(spark, docs, tmp_path):
    path = token_files.write_token_files(table(spark, docs), WORDS, end_id=1, path=str(tmp_path / "ids"), file_ids=200)
    rows = token_files.manifest(spark, path).orderBy("first_id").collect()
    assert len(rows) > 1 and rows[0].first_id == rows[0].first_doc == 0
    assert all(a.first_id + a.n_ids == b.first_id and a.first_doc + a.n_docs == b.first_doc for a, b in zip(rows, rows[1:], strict=False))
    name = tmp_path / "ids/ids" / rows[0].file
    assert name.stat().st_size == rows[0].n_bytes
    name.write_bytes(name.read_bytes()[:-3])
    with pytest.raises(ValueError, match="cut off"):
        token_files.TokenFile(f"{path}/ids", rows[0].file)


def test_token_files_empty(spark):
    path = token_files.write_token_files(table(spark, []), WORDS, end_id=1)
    assert token_files.read_token_files(spark, path).collect() == []


def test_token_files_query(spark):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(WORDS), 0
    rows = {r.doc_id: r for r in queries.op11_token_files(spark, f"{DATA}/sf0.001").collect()}
    for doc in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*t.encode(doc.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(rows[doc.doc_id]) == (doc.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# late sessions


def sessions_by_force(events, gap):
    out, standing = {}, defaultdict(list)
    by_user = defaultdict(list)
    for u, s, b, h in events:
        by_user[u].append((s, b, h))
    for u, own in by_user.items():
        for batch in sorted({b for _, b, _ in own}):
            now = sorted(e for e in own if e[1] <= batch)
            groups = [[now[0]]]
            for e in now[1:]:
                groups.append([e]) if e[0] - groups[-1][-1][0] > gap else groups[-1].append(e)
            for g in groups:
                new = sum(b == batch for _, b, _ in g)
                if new:
                    key = (u, batch, g[0][0])
                    taken = [k for k in standing[u] if g[0][0] <= k[2] and out[k][0] <= g[-1][0]]
                    for k in taken:
                        standing[u].remove(k)
                        out[k][5:] = [batch, g[0][0]]
                    out[key] = [g[-1][0], len(g), new, len(taken), sum(h for *_, h in g), None, None]
                    standing[u].append(key)
    return sorted((*k, *v) for k, v in out.items())


def versions(spark, events, gap=600, schema="user long, seconds long, batch long, h long, first long, cell long, island string"):
    rows = late_sessions.session_versions(spark.createDataFrame([(*e, 1, 2, "x") for e in events], schema), gap).collect()
    return sorted((r.user, r.batch, r.start_s, r.end_s, r.n_events, r.n_new, r.n_retracted, r.h_sum, r.retracted_batch, r.retracted_start_s) for r in rows)


def reordered(rows):
    return sorted((u, b, s, e, n, new, taken, h, rb, rs) for u, b, s, e, n, new, taken, h, rb, rs in rows)


@pytest.mark.parametrize("seed", range(3))
def test_sessions_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    events = []
    for u in range(12):
        span = rng.choice([2_000, 20_000, 200_000])
        events += [(u, rng.randrange(span), rng.randrange(rng.choice([1, 3, 40, 3000])), rng.randrange(1 << 32)) for _ in range(rng.randrange(1, 90))]
    events += events[:20]  # repeated rows
    # one user with a long time line that is one session in the end, some of it late by many batches
    events += [(99, 400 * i, i // 3 + (rng.randrange(400) if i % 7 == 0 else 0), i) for i in range(900)]
    assert versions(spark, events) == reordered(sessions_by_force(events, 600))


def test_sessions_at_the_gap_exactly_and_odd_rows(spark):
    events = [(1, 0, 0, 5), (1, 600, 0, 6), (1, 1201, 0, 7), (1, 901, 5, 8), (2, -700, 0, 1), (2, -100, 1, 1), (2, 500, 2, None)]
    assert versions(spark, [*events, (None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1)]) == reordered(sessions_by_force([(u, s, b, h or 0) for u, s, b, h in events], 600))


def test_sessions_empty(spark):
    assert versions(spark, []) == []


def test_no_task_gets_a_hot_users_time_line(spark):
    """A user with a third of all events: the windows along users see a row for each block of cells."""
    hot = [(0, 650 * i, i, 1) for i in range(3000)]
    rest = [(1 + i % 200, 1000 * i, i, 1) for i in range(6000)]
    got = versions(spark, hot + rest)
    assert len(got) == 9000 and all(v[4] == 1 for v in got if v[0] == 0)


# collocations


def phrases_by_force(docs, least, share, top):
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    found = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    dropped = {(lang, w[i : i + 2]) for (lang, w), a in found.items() if len(w) == 3 for i in (0, 1) if 100 * a >= share * found[lang, w[i : i + 2]]}
    rows = defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in dropped:
            score, _, left, right = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            rows[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    word = lambda: f"w{int(rng.expovariate(0.3))}"
    rows = [(1, None, "en"), (2, "", None), (3, " .,;\n", "en"), (4, "Straße É x É x " * 20, "de"), (5, "New York City. " * 30 + "new\tyork; " * 5, None)]
    rows += [(i, "".join(word() + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", "! "]) for _ in range(rng.randrange(80))), rng.choice(["en", "en", "fr", None])) for i in range(10, 300)]
    return rows + rows[10:40] + [(999, "a b c " * 30_000, "es")]


@pytest.mark.parametrize(("bits", "top"), [(1 << 26, 2000), (64, 40)])
def test_collocations_equal_brute_force(spark, prose, bits, top):
    got = collocations.mine_collocations(table(spark, prose).repartition(5), top=top, filter_bits=bits).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == phrases_by_force(prose, 10, 50, top)


def test_collocations_of_small_shards(spark, prose, monkeypatch):
    """Counts of many shards add up; tasks are given the value by the closure."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", 500)
    docs = table(spark, prose).repartition(7)
    assert sorted(map(tuple, collocations._counted(collocations.shards(docs), 1, None).where("lang = 'fr'").collect())) == sorted(
        ("fr", w, k) for w, k in Counter(w for _, t, lang in prose if lang == "fr" for w in re.split(r"[\x20\x09.,;:!?\x0A-\x0D]+", t) if w).items()
    )


def test_shards_are_held_a_few_at_once(spark, prose, monkeypatch):
    """Row groups of a few shards, however many a task writes, and tasks of a few groups; the counts stay."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", 200)
    monkeypatch.setattr(collocations, "SPLIT_BYTES", 4000, raising=False)
    made, write, before = {}, collocations.materialize, spark.conf.get("spark.sql.files.maxPartitionBytes")

    def seen(df, name, *more):
        if name == "words":
            made["tasks"] = made["shards"].rdd.getNumPartitions()
        made[name] = write(df, name, *more)
        return made[name]

    monkeypatch.setattr(collocations, "materialize", seen)
    rows_key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(rows_key)
    spark.conf.set(rows_key, "5")
    try:
        got = collocations.mine_collocations(table(spark, prose).coalesce(1)).collect()
    finally:
        spark.conf.set(rows_key, usual)
    groups = [(f, g) for p in Path(made["shards"].written_to.removeprefix("file://")).glob("*.parquet") if (f := pq.ParquetFile(p).metadata) for g in range(f.num_row_groups)]
    rows = [f.row_group(g).num_rows for f, g in groups]
    assert sum(rows) > 50 and max(rows) <= 4 and made["tasks"] > 1
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == phrases_by_force(prose, 10, 50, 2000)


def test_suffix_array_sorts_and_shares():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 4, 500).astype(np.int32)
    at = np.flatnonzero(ids > 0)
    for depth in (1, 2, 3, 5):
        sa, lcp = collocations.suffix_array(ids, depth, at)
        cut = [tuple(ids[i : i + depth]) + (0,) * max(0, i + depth - len(ids)) for i in sa]
        assert sorted(sa) == at.tolist() and cut == sorted(cut)
        for a, b, shared in zip(cut, cut[1:], lcp, strict=False):
            k = 0
            while k < depth and a[k] == b[k] > 0:
                k += 1
            assert k == shared


def test_collocations_empty(spark):
    assert collocations.mine_collocations(table(spark, [])).collect() == []
    assert collocations.mine_collocations(table(spark, [(1, None, None)])).collect() == []
