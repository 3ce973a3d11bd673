"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import collocations, exact_dedup, imatch, jaccard_join, language, late_sessions, packing, piece_sampling, quality, substring_dedup, token_counts, token_files, url_filter

#: Fixed values of the contract of op9: (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # a null id has no label
    weights = quality.fit_quality(docs.where(~held_out), _read(spark, sf_dir, "labels").where(~held_out))
    return quality.score_quality(docs, weights).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"), words=4, percent=85)


#: The languages of the labelled documents.
LANGUAGES = ["de", "en", "es", "fr"]


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit_trigrams(_read(spark, sf_dir, "documents"), LANGUAGES)
    pages = _read(spark, sf_dir, "pages").select("page_id", "html", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("html", r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([a-z]{2,3})""", 1).alias("declared"))
    return language.identify(pages, model, LANGUAGES, "html", host=F.col("host"), declared=F.col("declared"), markup=True).select("page_id", "language", "probability", "text_language", "declared")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = piece_sampling.encode_checked(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.crc32(F.array_join("ids", ",").cast("binary"))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), digest.alias("ids_crc32"), "lossless")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.substring_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), "removed_chars", F.length("text").cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = lambda *c: F.crc32(F.concat_ws(":", *c).cast("binary"))
    events = _read(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn", digits("conv_id").alias("c"), digits("conv_id", "turn").alias("h"))
    events = events.withColumns({"user": F.expr("2 * floor(conv_id / 8) + c % 2"), "seconds": F.expr("(c div 2) % 7200 + 300 * turn + h % 600"), "g": F.expr("h div 600")})
    events = events.withColumn("batch", F.expr("floor(seconds / 900) + CASE WHEN g % 5 = 0 THEN g % 4 ELSE 0 END"))
    return late_sessions.session_versions(events, gap=600)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_quality_classifier, op3_ngram_jaccard_join, op4_language_id, op5_token_counts, op6_piece_sampling, op7_substring_dedup, op8_imatch_fingerprints, op9_url_filters, op10_packing, op11_token_files, op12_late_sessions, op13_collocations)}

ORACLE = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, norm, CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
                     first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id FROM n)""",
    "op9_url_filters": r"""
        WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        fits AS (SELECT p.page_id, r.host || r.path AS rule, r.verdict,
                        row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, r.verdict DESC) AS k
                 FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1""",
    "op12_late_sessions": r"""
        WITH crc AS (SELECT x, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(x, ''), lambda d: [CAST(ascii(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                         lambda c, b: xor(xor(c, b) // 2, CASE WHEN xor(c, b) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS y
                     FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS x FROM conversations WHERE conv_id IS NOT NULL
                           UNION SELECT DISTINCT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
        raw AS (SELECT v.conv_id, v.turn, a.y AS c, b.y AS h FROM conversations v JOIN crc a ON a.x = CAST(v.conv_id AS VARCHAR) JOIN crc b ON b.x = CAST(v.conv_id AS VARCHAR) || ':' || CAST(v.turn AS VARCHAR)),
        timed AS (SELECT 2 * CAST(floor(conv_id / 8) AS BIGINT) + c % 2 AS u, (c // 2) % 7200 + 300 * turn + h % 600 AS s, h // 600 AS g, h FROM raw),
        ev AS (SELECT u, s, h, s // 900 + CASE WHEN g % 5 = 0 THEN g % 4 ELSE 0 END AS b FROM timed),
        snap AS (SELECT q.b AS batch, e.*, CASE WHEN e.s - lag(e.s) OVER w <= 600 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT u, b FROM ev) q JOIN ev e ON e.u = q.u AND e.b <= q.b WINDOW w AS (PARTITION BY e.u, q.b ORDER BY e.s)),
        numbered AS (SELECT *, sum(new) OVER (PARTITION BY u, batch ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT * FROM snap ORDER BY u, batch, s)),
        sess AS (SELECT u, batch, min(s) AS st, max(s) AS en, count(*) AS n, count(*) FILTER (b = batch) AS fresh, sum(h) AS hs FROM numbered GROUP BY u, batch, k),
        v AS (SELECT * FROM sess WHERE fresh > 0),
        links AS (SELECT a.u, a.batch, a.st, min(b.batch) AS by_batch, arg_min(b.st, b.batch) AS by_st FROM v a JOIN v b ON b.u = a.u AND b.batch > a.batch AND b.st <= a.st AND a.en <= b.en GROUP BY ALL),
        taken AS (SELECT u, by_batch, by_st, count(*) AS n FROM links GROUP BY ALL)
        SELECT v.u AS "user", v.batch, v.st AS start_s, v.en AS end_s, v.n AS n_events, v.fresh AS n_new, coalesce(t.n, 0) AS n_retracted, CAST(v.hs AS BIGINT) AS h_sum, l.by_batch AS retracted_batch, l.by_st AS retracted_start_s
        FROM v LEFT JOIN links l ON l.u = v.u AND l.batch = v.batch AND l.st = v.st LEFT JOIN taken t ON t.u = v.u AND t.by_batch = v.batch AND t.by_st = v.st""",
    "op13_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k))),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS p FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 10),
        inner_max AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest([p[1] || ' ' || p[2], p[2] || ' ' || p[3]]) AS phrase FROM f WHERE k = 3) GROUP BY ALL),
        cuts AS (SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, CAST(1000000 AS HUGEINT) * c.f * c.f // (CAST(l.f AS HUGEINT) * r.f) AS score
                 FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
                 JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.p[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.p[j + 1:], ' ')),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS pick FROM cuts),
        ranked AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, score
                   FROM best b LEFT JOIN inner_max m ON m.lang = b.lang AND m.phrase = b.phrase WHERE pick = 1 AND (m.longer IS NULL OR 100 * m.longer < 50 * a))
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}
