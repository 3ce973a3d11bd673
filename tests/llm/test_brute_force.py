"""Quality training, language fusion and piece sampling against plain second implementations."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import language, piece_sampling, quality, queries

from ..conftest import DATA

M = 2**64


def plain_features(text, bits):
    hashes = []
    for word in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text):
        hashes.append(xxhash.xxh64_intdigest(word.lower()))
        if len(word) > 1 and word.isalpha() and word.isupper():
            hashes.append(0x9E3779B97F4A7C15)
    mix = 0xD6E8FEB86659FD93
    pairs = [0xC2B2AE3D27D4EB4F if a == b else (a * mix % M) ^ ((b + (a >> 7)) % M) for a, b in zip(hashes, hashes[1:])]
    n = Counter(h >> (64 - bits) for h in [*hashes, *(p * mix % M for p in pairs)])
    norm = math.sqrt(sum(k * k for k in n.values()))
    return {place: k / norm for place, k in n.items()}


def plain_ftrl(rows, epochs=5, alpha=0.5, beta=0.1, l1=0.02, l2=0.02):
    """A weight at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_quality_equals_plain_training_and_scores(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["Good", "fine", "SPAM", "buy!!", "x_1", "42", "é"][i % 2 :]) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    docs += [(60, "very long " * 200_000), (61, ""), (62, None), (None, "Good")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, quality int")
    w = quality.fit_quality(df, labels, bits=12, train_rows=200)
    order = [r.doc_id for r in df.where("doc_id < 61").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    features = {i: plain_features(t or "", 12) | {"bias": 1.0} for i, t in docs}
    want = plain_ftrl([(features[i], i % 2) for i in order])
    assert np.allclose(w, [*(want.get(i, 0.0) for i in range(1 << 12)), want["bias"]], atol=1e-4)
    got = quality.score_quality(df, w).collect()
    assert len(got) == len(docs)
    for r in got:
        x = features[r.doc_id]
        assert math.isclose(r.score, 1 / (1 + math.exp(-sum(want.get(i, 0.0) * v for i, v in x.items()))), abs_tol=1e-4)


def test_held_out_of_a_null_id_is_false(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.held_out for r in queries.QUERIES["op2_quality_classifier"](spark, str(tmp_path)).collect()}
    assert got == {1: zlib.crc32(b"1") % 5 == 0, None: False}


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def test_language_fusion_equals_plain_sums(spark):
    langs, rng = ["de", "en", "fr"], random.Random(9)
    model = np.log(np.random.default_rng(2).dirichlet(np.full(language.BUCKETS, 0.3), 3) + 1e-9)
    model = np.vstack([model, np.full(language.BUCKETS, -math.log(language.BUCKETS))])
    hosts = ["a.site.de", "b.site.de", "c.org", "d.fr:80", "localhost", None]
    rows = [(i, rng.choice([None, "", "12 ..", "".join(rng.choices("abcdefgh ", k=rng.randrange(3, 30)))]), rng.choice(hosts), rng.choice(["de", "EN", "fr-CA", "xx", None])) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, body string, site string, said string")
    got = {r.id: r for r in language.identify(df, model, langs, "body", host=F.col("site"), declared=F.col("said")).collect()}

    facts = {}
    for i, body, site, said in rows:
        found = language.log_likelihoods(model, (body or "").encode())
        logs = (found * 0.25).tolist() if found is not None else ([-50.0] * 3 + [0.0] if (body or "").strip() else None)
        soft = softmax(logs[:3]) if logs and max(logs) != logs[3] else [0.0] * 3
        labels = re.sub(r":\d*$", "", site).split(".") if site else []
        domain = ".".join(labels[-2:]) if len(labels) > 1 else site
        said = (said or "")[:2].lower()
        facts[i] = (logs, soft, site, domain, labels[-1] if labels else None, said if said in langs else None)

    def total(keep):
        return [sum(f[1][k] for f in facts.values() if keep(f)) for k in range(3)]

    whole = total(lambda f: True)
    whole = [(x + 1) / (sum(whole) + 3) for x in whole]
    heard = {d: total(lambda f, d=d: f[5] == d) for d in langs}
    for i, (logs, soft, site, domain, suffix, said) in facts.items():
        own_site = [max(0, x - y) for x, y in zip(total(lambda f: site and f[2] == site), soft)]
        own_domain = [max(0, x - y) for x, y in zip(total(lambda f: site and f[3] == domain), soft)]
        smooth = [(x + 5 * w) / (sum(own_domain) + 5) for x, w in zip(own_domain, whole)]
        prior = [(x + 5 * s) / (sum(own_site) + 5) for x, s in zip(own_site, smooth)]
        x = []
        for k, lang in enumerate(langs):
            told = math.log((heard[said][k] + 1) / (sum(heard[d][k] for d in langs) + 3)) if said else 0.0
            x.append((logs[k] if logs else 0.0) + told + (math.log(language.SUFFIX_ODDS) if language.SUFFIXES.get(suffix) == lang else 0.0) + math.log(prior[k]))
        und = (logs[3] if logs else -50.0) + math.log(1e-3)
        p = softmax([*x, 50.0 if logs is None and not said and not site else und])
        assert math.isclose(got[i].probability, max(p), rel_tol=1e-6) and math.isclose(got[i].und_probability, p[3], rel_tol=1e-6, abs_tol=1e-12), i
        assert math.isclose(p[[*langs, "und"].index(got[i].language)], max(p), rel_tol=1e-9)
    assert len(got) == len(rows) and len({r.language for r in got.values()}) > 2


def plain_decode(sp, ids):
    raw = b""
    for i in ids:
        raw += bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    return raw[1:].decode()


def test_sampled_pieces_of_several_windows_decode_by_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["the", "language", "naïve", "\U0001f600", "x  y", "Straße"]) for _ in range(rng.randrange(1, 60)))) for i in range(20)]
    rows += [(20, "word and word " * 90_000 + "end"), (21, ""), (22, None), (None, "no id"), (23, "after the long one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = piece_sampling.encode_checked(df, path).collect()
    texts = dict(rows)
    assert len(got) == len(rows) and all(r.lossless for r in got)
    for r in got:
        assert r.ids is None if texts[r.doc_id] is None else plain_decode(sp, r.ids) == texts[r.doc_id]
    # a row's draw depends on its key alone, not on its neighbours or the window it is in
    alone = piece_sampling.encode_checked(df.where("doc_id in (3, 23)"), path).collect()
    assert {r.doc_id: r.ids for r in alone} == {r.doc_id: r.ids for r in got if r.doc_id in (3, 23)}
    assert piece_sampling.encode_checked(df.limit(0), path).collect() == []


def test_piece_query_counts_and_digests_its_ids(spark):
    d, path = f"{DATA}/sf0.001", public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", piece_sampling.encode_sampled(F.col("doc_id"), F.col("text"), path).alias("ids")).collect()
    want = {r.doc_id: (len(r.ids), zlib.crc32(",".join(map(str, r.ids)).encode()), True) for r in docs}
    assert {r.doc_id: (r.n_pieces, r.ids_crc32, r.lossless) for r in queries.QUERIES["op6_piece_sampling"](spark, d).collect()} == want
