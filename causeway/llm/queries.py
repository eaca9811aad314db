"""The queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    best_two_fit,
    compression_quality,
    hard_negatives,
    html_text,
    jaccard_join,
    lexical_search,
    mixing,
    nn_descent,
    packing,
    pii,
    quality_rules,
    suffix_dedup,
    token_files,
)
from .tables import read


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and the forests' verdict for every document."""
    return quality_rules.rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are alike by 0.8 or more."""
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_texts(read(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated to square-root source weights, in globally shuffled order."""
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without repeated strings of 100 bytes."""
    return suffix_dedup.dedup(read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written, read back and summed up."""
    return token_files.round_trip(read(spark, sf_dir, "documents"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings alike by cosine 0.95 or more."""
    return nn_descent.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by two compression dictionaries."""
    return compression_quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by surrogates."""
    return pii.scrub(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels whose scores lie between the limits of each anchor's positives."""
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of 1024 tokens as best-two-fit finds."""
    return best_two_fit.digest(best_two_fit.pack(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_text, op2_mixing, op3_quality_rules, op4_ngram_jaccard_join, op5_suffix_dedup,
              op6_token_files, op7_nn_descent,
              op8_compression_quality,
              op9_packing, op10_pii_surrogates, op11_hard_negatives, op12_lexical_search, op13_best_two_fit)
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": """
WITH mass AS (SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS mass FROM documents GROUP BY source),
tot AS (SELECT sum(mass) AS m, sum(sqrt(mass)) AS w FROM mass),
rate AS (SELECT source, CASE WHEN mass > 0 AND w > 0 THEN sqrt(mass) / w * m / mass ELSE 1.0 END AS rate FROM mass, tot),
step AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT)) AS k FROM rate),
fact AS (SELECT source, rate, k, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0.0 END) OVER (
    PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS lf FROM step),
cdf AS (SELECT source, k, sum(CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lf) WHEN k = 0 THEN 1.0 ELSE 0.0 END)
    OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS p FROM fact),
doc AS (SELECT *, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0
    AS u FROM documents),
steps AS (SELECT source, list(p ORDER BY k) AS ps FROM cdf GROUP BY source),
drawn AS (SELECT d.*, least(len(list_filter(s.ps, lambda p: p <= d.u)), len(s.ps) - 1) AS n
    FROM doc d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source),
rows AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(n))::INTEGER AS copy FROM drawn)
SELECT *, md5('mix-1:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS mix_key FROM rows
""",
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, list_sort(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3),
    lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4]))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
docs AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, '|')) END AS c, s FROM sets),
classes AS (SELECT c, any_value(n) AS n, any_value(s) AS s, min(doc_id) AS low FROM docs WHERE c IS NOT NULL GROUP BY c),
inv AS (SELECT c, n, unnest(s) AS g FROM classes),
links AS (SELECT a.c AS p, b.c AS q FROM inv a JOIN inv b ON a.g = b.g AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
sym AS (SELECT p, q FROM links UNION ALL SELECT q, p FROM links),
spread AS (SELECT c, low FROM classes UNION SELECT sym.q, spread.low FROM spread JOIN sym ON sym.p = spread.c),
best AS (SELECT c, min(low) AS component_id FROM spread GROUP BY c)
SELECT d.doc_id, d.n AS n_shingles, coalesce(b.component_id, d.doc_id) AS component_id FROM docs d LEFT JOIN best b ON b.c = d.c
""",
    "op7_nn_descent": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS p, b.vec_id AS q FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) >= 0.95 * a.size * b.size),
spread AS (SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT links.q, spread.r FROM spread JOIN links ON links.p = spread.id),
best AS (SELECT id, min(r) AS component_id FROM spread GROUP BY id),
deg AS (SELECT p, count(*) AS n FROM links GROUP BY p)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = v.vec_id AS kept FROM v JOIN best ON id = v.vec_id
    LEFT JOIN deg ON p = v.vec_id
""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, a.label AS own, b.vec_id AS b, b.label AS other, list_dot_product(a.e, b.e)::BIGINT AS score
    FROM v a JOIN v b ON len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score, own FROM s WHERE own = other AND a <> b
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
    (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b))::INTEGER AS rank,
    s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND s.other <> p.own AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 10
""",
    "op12_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
al AS (SELECT count(*)::BIGINT AS nn, sum(len(ts))::BIGINT AS ll FROM d WHERE len(ts) > 0),
tf AS (SELECT r, doc_id, t, count(*)::BIGINT AS tf, n FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d)
    WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, t, n),
w AS (SELECT t, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, al GROUP BY t),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll)))))::BIGINT AS score
    FROM q JOIN tf USING (t) JOIN w USING (t), al GROUP BY item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s
WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
""",
}
