"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (decontam, fim, hardneg, langid, licenses, neardup, ngramjoin, pieces, quality_model, quality_rules,
               urlfilter, warc, wrappers)
from .common import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_sentencepiece(spark, sf_dir):
    """N-best SentencePiece segmentation of all documents, decoded again."""
    return pieces.encode(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    """Rule statistics of all documents, judged by an isolation forest."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_duplicates(spark, sf_dir):
    """Near-duplicate groups of all documents (HyperMinHash, verified on full sets)."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_url_filter(spark, sf_dir):
    """Verdicts of the contract's rules on all page URLs."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.contract_rules(spark))


def op5_language_id(spark, sf_dir):
    """Language of all documents by compression with per-language dictionaries."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark, sf_dir):
    """Main text of all pages by host wrappers."""
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op7_decontamination(spark, sf_dir):
    """Benchmark decontamination of all documents (prefix-filtered set join)."""
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark, sf_dir):
    """License notices in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_templates(spark))


def op9_quality_classifier(spark, sf_dir):
    """Quality of all documents by a weakly supervised hashed linear scorer."""
    return quality_model.classify(table(spark, sf_dir, "documents"))


def op10_warc_derivatives(spark, sf_dir):
    """Metadata and plain-text conversion records of all pages, by their digests."""
    return warc.digests(warc.derivatives(warc.page_responses(table(spark, sf_dir, "pages"))))


def op11_ngram_join(spark, sf_dir):
    """Components of the n-gram Jaccard join of all documents."""
    return ngramjoin.ngram_join(table(spark, sf_dir, "documents"), ngram=4, percent=85)


def op12_fill_in_middle(spark, sf_dir):
    """Fill-in-middle form of all documents, by its digests."""
    return fim.digests(fim.transform(table(spark, sf_dir, "documents")))


def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every fiftieth embedding against all embeddings."""
    return hardneg.mine(hardneg.relabelled(table(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_quality_rules, op3_near_duplicates, op4_url_filter, op5_language_id,
    op6_html_extraction, op7_decontamination, op8_license_scan, op9_quality_classifier,
    op10_warc_derivatives, op11_ngram_join, op12_fill_in_middle, op13_hard_negatives,
)}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op3_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE
      regexp_extract_all({_LOW.format('text')}, '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op4_url_filter": f"""
WITH r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, {_LOW.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
k AS (SELECT DISTINCT host, path FROM u),
b AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM k JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN b USING (host, path)""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE
      regexp_extract_all({_LOW.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') END AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + 9), ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT DISTINCT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op8_license_scan": licenses.oracle_sql(),
    "op11_ngram_join": ngramjoin.oracle_sql(),
    "op12_fill_in_middle": fim.oracle_sql(),
    "op13_hard_negatives": hardneg.oracle_sql(),
}
