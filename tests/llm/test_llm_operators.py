"""Operators against brute force, the tokenizers themselves, or exact round trips, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import exact_dedup, imatch, jaccard_join, language, packing, piece_sampling, quality, queries, substring_dedup, token_counts, url_filter
from corpusmill.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema="doc_id long, text string, kept boolean, sha string, n long, cid long, unit string"):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "x", 1, 2, "y") for i, t in rows], schema)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(7)
    long = words(rng, 30_000)
    base = words(rng, 300)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "A b"), (6, "a b c"), (7, long), (8, long + " end"), (9, base), (10, base), (10, base), (11, base.replace(" ", "\n", 3)), (None, base), (None, "only"), (12, "é 日本 😀 \u00a0x"), (13, base + " more words here"), (14, "same " * 50)]
    rows += [(100 + i, words(rng, rng.randrange(1, 60), 30)) for i in range(60)]
    return rows


# exact dedup


def test_exact_dedup_equals_brute_force(spark, odd):
    got = exact_dedup.exact_dedup(table(spark, odd).repartition(5), salts=3).collect()
    assert len(got) == len(odd)
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\r\x0b\x0c")
    groups = {}
    for i, t in odd:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for i, t in odd:
        g = groups[norm(t)]
        want[(i, min(g)[3], len(g), hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).collect() == []


# quality


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        rows.append((i, words(rng, 80) if good else " ".join(w + "###" for w in words(rng, 80).split())))
        labels.append((i, int(good) if i < 200 else None))
    labels += [(1, 1), (999, 0)]
    docs = table(spark, [*rows, (500, None), (501, ""), (None, "w1 w2"), (0, rows[0][1])])
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    weights = quality.fit_quality(docs, labels, bits=14, train_rows=120)
    got = quality.score_quality(docs, weights).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 for r in got)
    held = [(r.score, r.doc_id % 3 > 0) for r in got if r.doc_id is not None and 200 <= r.doc_id < 300]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)
    assert {r.score for r in got if r.doc_id in (500, 501)} == {float(1 / (1 + np.exp(-float(weights[-1]))))}


def test_quality_without_labels_or_rows(spark):
    docs, none = table(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, quality int")
    weights = quality.fit_quality(docs, none, bits=8)
    assert quality.score_quality(docs, weights).first().score == 0.5
    assert quality.score_quality(table(spark, []), weights).collect() == []


def test_ftrl_separates():
    rows = [(np.array([i % 2]), np.array([1.0]), i % 2) for i in range(200)]
    w = quality.train_ftrl(rows, 1)
    assert w[1] + w[2] > 1 > -1 > w[0] + w[2]


# Jaccard join


def exact_shingles(text, k):
    words = text.lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def brute_components(rows, k, percent):
    sets = [exact_shingles((t or "").encode(), k) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j = rows[b][0]
            both = len(sets[a] & sets[b])
            if i is not None and j is not None and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True))


def near_rows(seed, count):
    rng = random.Random(seed)
    bases = [words(rng, rng.choice([3, 5, 9, 15, 30, 80, 300])).split() for _ in range(count // 6)]
    rows = []
    for i in range(count):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [f"w{rng.randrange(400)}"]
        rows.append((i, " ".join(w).upper() if i % 2 else "\n".join(w)))
    return rows


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 8 << 20), (5, 80, 2000), (1, 85, 20_000)])
def test_jaccard_equals_brute_force(spark, odd, k, percent, block):
    rows = odd + [(i + 1000, t) for i, t in near_rows(k, 250)]
    got = jaccard_join.jaccard_components(table(spark, rows).repartition(3), words=k, percent=percent, block_bytes=block)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, k, percent)


@pytest.mark.parametrize("seed", range(3))
def test_links_join_all_of_a_large_cluster(seed):
    rng = random.Random(seed)
    bases = [[f"b{b}w{i}" for i in range(40)] for b in range(3)]
    members = []
    for i in range(300):
        w = list(bases[min(2, int(rng.random() ** 2 * 3)) if i < 150 else 2])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(60)}"
        members.append((i, None, False, " ".join(w).encode()))
    parent = list(range(300))

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in jaccard_join._joining_links(members, 80, 3):
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    want = brute_components([(i, t.decode()) for i, _, _, t in members], 3, 80)
    assert Counter(find(parent, i) for i in range(300)) == Counter({c: n for c, n in Counter(x[2] for x in want.elements()).items()})


def test_exact_sets_are_those_of_the_words():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("aBc") for _ in range(rng.randrange(9))) for _ in range(200)] + [" a\tb\nC  a ", ""]
    for k in range(1, 7):
        got = jaccard_join.exact_sets([t.encode() for t in texts], k)
        want = [exact_shingles(t.encode(), k) for t in texts]
        hashed = jaccard_join.shingles(pa.array([t.encode() for t in texts]), k)
        for a in range(0, len(texts), 7):
            for b in range(len(texts)):
                assert len(np.intersect1d(got[a], got[b])) == len(np.intersect1d(hashed[a], hashed[b])) == len(want[a] & want[b])


def test_jaccard_keeps_links_behind_frequent_shingles(spark):
    """A line that a third of the rows have, in near copies of each other and in others, and texts of frequent shingles alone."""
    rng = random.Random(9)
    line = words(random.Random(1), 12, 10_000)
    rows = []
    for i in range(400):
        own = words(random.Random(i // 2), rng.choice([6, 20, 90]), 5000).split()
        if i % 2:
            own[rng.randrange(len(own))] = "other"
        rows.append((i, " ".join(own) + (" " + line if i % 6 < 2 else "")))
    rows += [(1000 + i, line + " " + words(rng, i % 3, 9)) for i in range(60)]
    for block in (8 << 20, 3000):
        got = jaccard_join.jaccard_components(table(spark, rows).repartition(4), words=3, percent=80, block_bytes=block, hot_share=0.05)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, 3, 80)


def test_sketches_tell_unlike_sets_and_no_close_ones():
    rng = np.random.default_rng(8)
    for n in [1, 2, 9, 70, 300, 2000, 40_000, 90_000]:
        sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(3)]
        sets += [np.unique(np.concatenate([sets[0][k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (0, n // 30, n // 10)]
        bits = [jaccard_join.sketch(h) for h in sets]
        width = np.array([len(b) for b in bits])
        x, y = np.repeat(np.arange(6), 6), np.tile(np.arange(6), 6)
        apart = jaccard_join.distances(np.concatenate(bits), np.cumsum(width) - width, width, x, y)
        assert all(d <= len(np.setxor1d(sets[a], sets[b])) for a, b, d in zip(x, y, apart, strict=True))
        slack = jaccard_join.own_slack(np.array([len(h) for h in sets]), 80)
        far = apart > slack[x] + slack[y]
        assert not far[(x == 0) & (y > 2)].any()
        assert n < 70 or n > 70_000 or far[(x < 3) & (y < 3) & (x != y)].all()


def test_near_links_join_what_is_near():
    """Groups of near and unlike sets: the links join the same as all pairs that are near."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        bases = [rng.integers(0, 1 << 63, 200, dtype=np.uint64) for _ in range(int(rng.integers(1, 4)))]
        sets = []
        for _ in range(int(rng.integers(2, 12))):
            h = bases[int(rng.integers(len(bases)))].copy()
            h[: int(rng.integers(0, 50))] = rng.integers(0, 1 << 63, dtype=np.uint64)
            sets.append(np.unique(h))
        begins = np.unique([0, int(rng.integers(0, len(sets) + 1)), len(sets)])
        bits = [jaccard_join.sketch(h) for h in sets]
        width, n = np.array([len(b) for b in bits]), np.arange(len(sets))
        first, slack, flat = np.cumsum(width) - width, jaccard_join.own_slack(np.array([len(h) for h in sets]), 80), np.concatenate(bits)
        a, b = jaccard_join.near_links(n, slack, flat, first, width, begins)
        x, y = np.repeat(n, len(n)), np.tile(n, len(n))
        group = np.searchsorted(begins, n, "right")
        near = (jaccard_join.distances(flat, first, width, x, y) <= slack[x] + slack[y]) & (group[x] == group[y]) & (x != y)
        assert jaccard_join.forest(a, b).equals(jaccard_join.forest(x[near], y[near]))


@pytest.mark.parametrize("rounds", [1, 3])
def test_unlike_texts_that_share_a_run_of_words_do_not_meet(spark, monkeypatch, rounds):
    """Runs of a few words are in many texts, each in less than is frequent; texts that share no more than those are no candidates, so none is sent to many blocks."""
    met, meet = [], jaccard_join._meet
    monkeypatch.setattr(jaccard_join, "_meet", lambda rows, *more: met.append(rows.count()) or meet(rows, *more))
    rng = random.Random(12)
    runs = [words(random.Random(i), 14, 10_000) for i in range(30)]
    rows = [(i, " ".join(words(rng, 15, 100_000) + " " + rng.choice(runs) for _ in range(2))) for i in range(600)]
    rows += [(1000 + i, t + " end") for i, t in rows[:20]]
    got = jaccard_join.jaccard_components(table(spark, rows).repartition(4), words=5, percent=80, block_bytes=3000, hot_share=0.5, rounds=rounds)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, 5, 80)
    assert sum(met) < len(rows)


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(table(spark, [])).collect() == []
    assert sorted(r.component_id for r in jaccard_join.jaccard_components(table(spark, [(1, None), (2, "")])).collect()) == [1, 2]


@pytest.mark.parametrize("in_band", [10, 10_000_000])
def test_signatures_meet_for_every_close_pair(in_band):
    rng = np.random.default_rng(5)
    starts = jaccard_join.band_starts(85, 3000)
    plans = jaccard_join.allocate(starts, {k: in_band for k in range(len(starts))}, 85)
    for n in [1, 2, 5, 6, 7, 8, 12, 13, 14, 20, 33, 60, 100, 300, 1000]:
        for _ in range(20):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            gone = int(rng.integers(0, n + 1))
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 2)), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if not both or 100 * both < 85 * (len(a) + len(b) - both):
                continue
            for hot in (None, np.unique(rng.choice(a, len(a) // 3)), a):
                owner, sig = jaccard_join.signatures([a, b], starts, plans, hot)
                assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


# language


def test_language(spark):
    rng = random.Random(4)
    say = {"de": ["der", "und", "nicht", "auf", "ein"], "fr": ["le", "des", "une", "pour", "est"]}
    text = lambda x, n=40: " ".join(rng.choice(say[x]) for _ in range(n))
    docs = spark.createDataFrame([(i, text("de" if i % 2 else "fr"), "de" if i % 2 else "fr") for i in range(60)] + [(99, None, None)], "doc_id long, text string, lang string")
    langs = ["de", "fr"]
    model = language.fit_trigrams(docs, langs, train_rows=20)
    rows = [(1, text("de"), "a.x.org", "de"), (2, text("fr"), "b.x.org", None), (3, None, "s.de", None), (4, "", None, "fr-CA"), (5, None, None, None), (6, "\x01\x02\x7f\x05" * 40, None, None), (7, "", "b.x.org", None), (1, text("de"), "a.x.org", "de")]
    rows += [(10 + i, text("fr"), "b.x.org", "fr") for i in range(5)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, body string, site string, said string, language string")
    got = {r.id: r for r in language.identify(df, model, langs, "body", host=F.col("site"), declared=F.col("said")).collect()}
    assert {i: r.language for i, r in got.items() if i < 10} == {1: "de", 2: "fr", 3: "de", 4: "fr", 5: "und", 6: "und", 7: "fr"}
    assert language.identify(df.limit(0), model, langs, "body", host=F.col("site"), declared=F.col("said")).collect() == []
    page = b"<html><style>x{}</style><script>var a='</p>';</script><p>A&amp;b</p><!-- c --></html>"
    assert language.markup_text(page).split() == [b"A&b"]


# token counts


ALPHABET = ["a", "b ", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\u00a0", "\u2003", "\u2028", "é", "7", "12", "!", "...", "'s", "'ll", "<|endoftext|>", "日本", "\U0001f600", "\x1c", "\r\n", "e\u0301", "\x00", "\u200b", "\ufeff", "\x85"]


def test_token_counts_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, rng = Tokenizer.from_file(path), random.Random(0)
    rows = odd + [(1000 + i, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(15)))) for i in range(1500)]
    got = token_counts.token_counts(table(spark, rows).repartition(3), path, ["<|endoftext|>"], limit=20, heavy_terms=50).collect()
    want = Counter((i, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t in rows)
    assert Counter(tuple(r) for r in got) == want
    assert token_counts.token_counts(table(spark, []), path, []).collect() == []


def test_frequent_long_pre_tokens_do_not_meet(spark):
    """A rule of dashes in all rows, a longer one in two thirds: counted where they are read, so no line of theirs is shuffled."""
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(12)
    rule, other = "-" * 80, "=" * 3000
    rows = [(i, f"{words(rng, 3, 10**9)} {rule if i % 3 else other} {words(rng, 2)}\n{rule}") for i in range(1200)]
    docs, encode = table(spark, rows).repartition(6), token_counts.tokenizer(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert got == {i: len(encode([t])[0]) for i, t in rows}
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    lines = token_counts.pre_token_lines(texts, path, token_counts._special([]).pattern, 2e-6, 150_000, 64)
    assert lines.where("length(unit) > 64").isEmpty()
    assert lines.groupBy("unit").count().where("unit is not null").agg(F.max("count")).first()[0] < 10


# piece sampling


def test_pre_tokens_of_odd_texts_add_up():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.added_tokens(path) == ["<|endoftext|>"]
    encode, mark, rng = token_counts.tokenizer(path), token_counts._special(token_counts.added_tokens(path)), random.Random(6)
    parts = ["a", "B1", "'s", " ", " ", "\n", "  ", "\u00a0", "\u200b", "\u3000", "\x1c", "\x85", "<|endoftext|>", "é", "日", ".", "!?", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    for text, ids in zip(texts, encode(texts), strict=True):
        units = token_counts.pre_tokens(text.encode(), mark)
        assert b"".join(units) == text.encode()
        assert sum(map(len, encode([u.decode() for u in units]))) == len(ids), text


def test_sampled_pieces_decode_to_the_text(spark, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(1)
    rows = odd + [(1000 + i, "".join(rng.choice([*ALPHABET, "\u2581", " x"]) for _ in range(rng.randrange(15)))) for i in range(500)]
    df = table(spark, rows)
    coded = df.withColumn("ids", piece_sampling.encode_sampled(F.col("doc_id"), F.col("text"), path))
    got = coded.withColumn("back", piece_sampling.decode_pieces(F.col("ids"), path)).collect()
    assert all(r.back == r.text for r in got)
    assert all(lib.decode(r.ids) == r.text for r in got if r.text and "\u2581" not in r.text)
    again = df.repartition(7).withColumn("ids", piece_sampling.encode_sampled(F.col("doc_id"), F.col("text"), path)).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in coded.collect())


def test_draws_follow_the_lattice():
    path = public_tokenizers.path("piece_bpe_32k.model")
    m = piece_sampling.model(path, 0.5)
    n = 20_000
    ids, counts = m.encode(["abc"] * n, list(range(n)))
    ends = np.cumsum(counts)
    drawn = Counter(tuple(ids[e - c : e]) for e, c in zip(ends, counts, strict=True))

    def ways(text):
        if not text:
            yield (), 0.0
        for k in range(1, len(text) + 1):
            import sentencepiece

            lib = ways.lib = getattr(ways, "lib", None) or sentencepiece.SentencePieceProcessor(model_file=path)
            i = lib.piece_to_id(text[:k])
            if i != lib.unk_id() and not lib.is_byte(i):
                for rest, w in ways(text[k:]):
                    yield (i, *rest), w + m.weight[i]

    every = dict(ways("\u2581abc"))
    total = sum(np.exp(w) for w in every.values())
    assert set(drawn) <= set(every)
    for way, w in every.items():
        p = np.exp(w) / total
        assert abs(drawn[way] / n - p) < 4 * np.sqrt(p * (1 - p) / n) + 1e-3


# substring dedup


def brute_substring(rows, span, least, long):
    parts = [substring_dedup.sentences(t or "", long) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0))
    first, out = {}, {}
    for r in order:
        gone = set()
        p = parts[r]
        for b in range(len(p)):
            e = b
            while e < len(p) and (e - b < span or sum(x[2] for x in p[b:e]) < least):
                e += 1
            if e - b < span or sum(x[2] for x in p[b:e]) < least:
                continue
            key = tuple(x[3] for x in p[b:e])
            if first.setdefault(key, (r, b)) != (r, b):
                gone.update(range(b, e))
        t = rows[r][1]
        out[r] = t if t is None else "".join(t[a:z] for a, z in _kept(t, p, gone))
    return out


def _kept(text, parts, gone):
    at = 0
    for i in sorted(gone):
        yield at, parts[i][0]
        at = parts[i][1]
    yield at, len(text)


def test_substring_equals_brute_force(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(words(rng, rng.randrange(2, 9), 50).capitalize() + rng.choice([".", "!", ".\n"]) for _ in range(n))
    passages = [say(6) for _ in range(4)]
    rows = []
    for i in range(60):
        body = [say(rng.randrange(0, 5)), rng.choice([*passages, ""]), say(rng.randrange(0, 4)), rng.choice([*passages, ""])]
        rows.append((i, " ".join(body)))
    rows += [(100, None), (101, ""), (102, "x"), (103, " ".join(["la, la;"] * 60)), (104, passages[0]), (105, "\n".join([passages[1]] * 3))]
    df = table(spark, rows).withColumnRenamed("n", "n_removed")
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(df.repartition(4), span=3, span_words=12, long_words=20).collect()}
    want = brute_substring(rows, 3, 12, 20)
    assert len(got) == len(rows) and {i: r.text for i, r in got.items()} == {rows[r][0]: t for r, t in want.items()}
    assert all(len(t or "") - len(got[i].text or "") == got[i].removed_chars for i, t in rows)
    assert any(r.n_removed for r in got.values())


@pytest.mark.parametrize("marks", [0, 1, 2])
def test_substring_passages_of_over_50_words_anywhere(spark, marks):
    """One passage a pair of documents: without marks, of one sentence, of two; in mid-sentence or alone."""
    rng = random.Random(marks)
    rows = []
    for k in range(60):
        passage = words(rng, rng.randrange(51, 61), 10**6).split()
        for m in range(marks):
            passage[(m + 1) * len(passage) // marks - 1] += "."
        for i in (2 * k, 2 * k + 1):
            around = [words(rng, rng.randrange(40), 10**6) if k % 3 else "" for _ in range(2)]
            rows.append((i, f"{around[0]} {' '.join(passage)} {around[1]}".strip()))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, rows).repartition(4)).collect()}
    assert all((got[i].n_removed > 0) == (i % 2 == 1) for i, _ in rows)
    assert all(len(t.split()) - len(got[i].text.split()) in range(20, 61) for i, t in rows if i % 2)
    assert all(len(got[i].text.split()) <= 7 for i, _ in rows if i % 6 == 1)


def test_units_are_short_and_the_same_within_other_text():
    rng = random.Random(3)
    for _ in range(500):
        passage = " ".join(words(rng, 1, rng.choice([9, 10**6])) + rng.choice(["", "", "", "", ",", "."]) for _ in range(51))
        cuts = [{tuple(s) for s in substring_dedup.spans(f"{words(rng, rng.randrange(1, 40))} {passage} {words(rng, 30)}", 3, 20, 7).tolist()} for _ in range(2)]
        assert cuts[0] & cuts[1]
        assert max(n for _, _, n, _ in substring_dedup.sentences(passage, 7)) <= 7


def test_substring_odd_rows(spark, odd):
    got = substring_dedup.substring_dedup(table(spark, odd)).collect()
    assert len(got) == len(odd)
    assert substring_dedup.substring_dedup(table(spark, [])).collect() == []


# I-Match


def test_imatch(spark, odd):
    rows = [(i, t) for i, t in odd if i != 10]
    got = sorted(imatch.fingerprints(table(spark, rows).repartition(3), band=(0.02, 0.5)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    texts = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by_text = {}
    for i, r in enumerate(got):
        if r.doc_id is None:
            continue
        t, nxt = texts[i][1] or "", texts[(i + 1) % len(texts)][1] or ""
        if texts[(i + 1) % len(texts)][0] is not None:
            q = len(t) // 4
            edited = t[: len(t) - q] + nxt[:q]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            if edited == t:
                assert r.near_edited == 1.0
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert next(r for r in got if r.doc_id == 9).near_next == 1.0 or next(r for r in got if r.doc_id == 9).fingerprint != next(r for r in got if r.doc_id == 11).fingerprint
    assert imatch.fingerprints(table(spark, [])).collect() == []
    one = imatch.fingerprints(table(spark, [(5, "just one text here")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_imatch_lexicon_holds_the_whole_band(spark):
    texts = [" ".join(f"t{j}" for j in range(i % 500 * 20, i % 500 * 20 + 20)) + f" all once{i}" for i in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(imatch.lexicon(docs, "text", (0.002, 0.1))) == sorted(f"t{j}" for j in range(10_000))
    # the band's own default: a term of every thousandth document counts
    got = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    assert all(got[i].fingerprint == got[i + 500].fingerprint for i in range(500))
    assert len({r.fingerprint for r in got.values()}) == 500


def spark_hash(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def brute_parts(text, listed):
    """Hashes of a text's terms in the lexicon, by the definition."""
    found = sorted(set(re.findall(r"[^\W_]+", text.lower())) & listed)
    if not found:
        return []
    hashes = [spark_hash(t.encode()) for t in found]

    def whole(values):
        h = 42
        for v in values:
            h = spark_hash(v.to_bytes(8, "little"), h)
        return h

    out = [whole(hashes)]
    for j in range(imatch.HASHES):
        drawn = [spark_hash(j.to_bytes(4, "little"), spark_hash(h.to_bytes(8, "little"))) for h in hashes]
        for k in range(4):
            number = [d >> 16 * k & 0xFFFF for d in drawn]
            rate = 1 << min(number).bit_length()
            out.append(whole([d for d, n in zip(drawn, number, strict=True) if n < rate]))
    return out


def test_imatch_equals_brute_force(spark):
    rng = random.Random(11)
    texts = [words(rng, rng.choice([1, 2, 5, 30, 200, 900]), rng.choice([20, 300])) for _ in range(60)] + ["", "only-once here", "É_x W3 w3"]
    ids = rng.sample(range(10**6), len(texts))
    band = (0.02, 0.4)
    rows = sorted(zip(ids, texts, strict=True))
    tokens = [set(re.findall(r"[^\W_]+", t.lower())) for _, t in rows]
    df = Counter(t for s in tokens for t in s)
    listed = {t for t, n in df.items() if max(2, band[0] * len(rows)) <= n <= band[1] * len(rows)}
    got = {r.doc_id: r for r in imatch.fingerprints(table(spark, rows).repartition(3), band=band).collect()}
    name = lambda parts: "-".join(f"{h:X}" for h in parts) or "empty"
    like = lambda a, b: 1.0 if a == b else sum(x == y for x, y in zip(a, b, strict=False)) / (imatch.DRAWS + 1)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        own, other, then = brute_parts(t, listed), brute_parts(edited, listed), brute_parts(nxt, listed)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (name(own), name(other))
        assert abs(got[i].near_edited - like(own, other)) < 1e-9 and abs(got[i].near_next - like(own, then)) < 1e-9


def test_imatch_buckets_are_even_whatever_the_ids(spark):
    df = spark.createDataFrame([*((i, f"t{i}") for i in range(5000)), (4 * 10**18, "far")], "doc_id long, text string")
    placed = imatch.with_next(df, 5001, rows_a_bucket=250).where("ghost = 0").groupBy("bucket").count().collect()
    assert len(placed) >= 15 and max(r["count"] for r in placed) < 700


def test_imatch_neighbours_across_buckets(spark):
    rows = [(i * i, f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = imatch.with_next(df, 3000, rows_a_bucket=50)
    assert placed.where("ghost = 0").count() == 3000
    own = {}
    for r in placed.collect():
        own.setdefault(r.bucket, []).append((r.ghost, r.doc_id))
    ids = [i for i, _ in rows]
    nxt = {}
    for b in own.values():
        b.sort()
        for (g, i), (_, j) in zip(b, b[1:], strict=False):
            if not g:
                nxt[i] = j
    assert nxt == dict(zip(ids, ids[1:] + ids[:1], strict=True))


# URL filters


def test_names_of_the_operators_own_columns_pass_through(spark):
    names = ["key1", "key2", "_cover", "cover", "row", "done", "_host", "logs", "soft", "host", "domain", "found"]
    rows = spark.createDataFrame([(1, "one two three", *range(len(names)))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = substring_dedup.substring_dedup(rows).first()
    assert [got[n] for n in names] == list(range(len(names))) and got.text == "one two three"
    flat = np.zeros((3, language.BUCKETS)) - 11.0
    got = language.identify(rows, flat, ["de", "en"], "text").first()
    assert [got[n] for n in names] == list(range(len(names))) and got.doc_id == 1
    none = language.identify(rows.limit(0), flat, ["de", "en"], "text", host=F.lit("a.de"))
    assert none.collect() == []


def test_long_texts_are_judged_as_the_sum_of_their_parts():
    rng = np.random.default_rng(1)
    flat = np.log(rng.random((3, language.BUCKETS)))
    text = (" ".join(rng.choice(["abc", "de", "fghi"], 60_000))).encode()
    assert np.allclose(language.log_likelihoods(flat, text), flat[:, language.trigrams(text)].sum(1))
    assert language.log_likelihoods(flat, b"") is None


def test_urls(spark):
    rules = queries.URL_RULES
    urls = ["https://EXAMPLE.com/en/x?y", "http://www.example.com/en/", "http://a.b.com", "http://a.b.com/", "x://badexample.com/en/", "http://m.example.com/en", "http://net/es/a#b", "https://q.net/fr/", "net/es/", None, "", "://", "http://user@com:80/", "http://example.com?/en/", "a://b://com/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash")], "id int, url string, Host string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        at = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = rest[:at].lower(), rest[at:].split("?")[0].split("#")[0]
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[2], max(fits)[1]) if fits else (host, path, None, "allow")

    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(df.limit(0), rules).collect() == []
    trie = url_filter.HostTrie([("allow", "a.org", "/x/y"), ("block", "org", "/"), ("block", "a.org", "/x/y")])
    assert trie.match("b.a.org", "/x/yz") == ("block", "a.org/x/y")
    assert trie.match("a.org", "/x/") == ("block", "org/") and trie.match("aorg", "/") is None


# packing


def check_pieces(pieces, ids, size=4096):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        assert p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        assert zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[i])
    pad = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        pad += 0 if at & (at - 1) == 0 else size - at
    return pad


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, rng = Tokenizer.from_file(path), random.Random(3)
    rows = list({i: (i, t) for i, t in odd if i is not None}.values()) + [(1000 + i, words(rng, rng.randrange(1, 700))) for i in range(300)]
    ids = {i: [*own.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    got = packing.pack(table(spark, rows).repartition(3), path, 2).collect()
    pad = check_pieces(got, ids)
    assert pad <= 0.01 * sum(map(len, ids.values()))
    assert packing.pack(table(spark, []), path, 2).collect() == []
    twice = packing.pack(table(spark, [(1, "a b"), (1, "a b"), (None, "c")]), path, 2).collect()
    assert sum(p.length for p in twice) == 3 + 3 + 2
    full = packing.pack(table(spark, [(1, " ".join(["a"] * 4095)), (2, " ".join(["a"] * 9000))]), path, 2).collect()
    assert sum(p.length for p in full) == 4096 + 9001


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, rng = Tokenizer.from_file(path), random.Random(0)
    more = ["B ", "ÀB,", "&%$", "<|startoftext|>x", "ß", "ÿ×", "÷", "İ", "ǅ", "a_b", "^", "`~", "ſ", "K", "É"]
    texts = ["".join(rng.choice(ALPHABET + more) for _ in range(rng.randrange(12))) for _ in range(5000)]
    encoder = packing.WordEncoder(path, keep=500)
    got = [g.as_py() for i in range(0, 5000, 100) for g in encoder(pa.array([t.encode() for t in texts[i : i + 100]]), 2)]
    assert [np.frombuffer(g, encoder.kind).tolist() for g in got] == [[*e.ids, 2] for e in own.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_all_and_waste_little(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 500, 64) * (rng.random(64) < 0.7) // (1 + np.arange(64) // 3)
    patterns = packing.solve_patterns(counts)
    width = np.arange(1, 65)
    assert all((p * width).sum() <= 64 for p, _ in patterns)
    assert (sum(p * n for p, n in patterns) == counts).all()
    assert sum(n for _, n in patterns) <= 1.02 * (counts * width).sum() / 64 + 70
    assert packing.solve_patterns(np.zeros(8, int)) == []


def test_hot_copies_meet_one_row_a_group(spark):
    """A third of all rows are equal: before the last join there is a row for each group that a task has combined, not for each copy."""
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i}") for i in range(6000)]
    got = exact_dedup.exact_dedup(table(spark, rows).repartition(4))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # above it in the plan
    hot = got.where("group_size = 2000").collect()
    assert len(hot) == 2000 and {r.keep_id for r in hot} == {0} and got.count() == 6000


def test_names_of_outputs_in_another_case(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "a", "b", "c")], "page_id long, url string, _judged string, Host string, row string")
    assert url_filter.filter_urls(pages, queries.URL_RULES).collect()[0]["_judged"] == "a"
    docs = spark.createDataFrame([(1, "some text here", "x", 2, 3)], "doc_id long, text string, Language string, N_Removed int, row int")
    assert substring_dedup.substring_dedup(docs).select("n_removed", "row").first() == (0, 3)
    model = language.fit_trigrams(spark.createDataFrame([(1, "the text is here", "en"), (2, "le texte est ici", "fr")], "doc_id long, text string, lang string"), ["en", "fr"])
    assert language.identify(docs, model, ["en", "fr"], "text").select("language", "N_Removed").first()["N_Removed"] == 2
