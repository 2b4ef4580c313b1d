"""The queries opN_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import contamination
from .jump_sharding import assign_shards
from .ngram_jaccard_join import jaccard_components
from .pseudo_likelihood import pseudo_likelihoods
from .quality_classifier import classify, fit_classifier, rated
from .shared import table
from .source_mixing import mix_sources
from .token_counts import token_counts
from .token_id_files import token_ids
from .transport_stream import media_column, media_features
from .warc_archive import archived


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grades of all documents under a model of the rated ones; keep: more likely good than not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, fit_classifier(docs, rated(table(spark, sf_dir, "labels")))).drop("text")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 5-word shingle sets link at 80 percent."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def vocabulary(name: str) -> str:
    """Where the public tokenizers' files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in byte-plane files, read back."""
    return token_ids(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in ZIP-packaged archives, read back."""
    return archived(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of benchmark windows in all documents."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources at weights 5, 2, 1, repeating, of 150 percent of all words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihoods of all documents under a network trained on them."""
    return pseudo_likelihoods(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by the 32k piece model."""
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by jump consistent hashing of doc_id."""
    return assign_shards(table(spark, sf_dir, "documents"))


def op10_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as MPEG transport streams, and features read from these."""
    return media_features(media_column(table(spark, sf_dir, "documents"))).drop("times", "random_access", "damaged")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_token_ids": op3_token_ids,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_mixing_sources": op6_mixing_sources,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_token_counts": op8_token_counts,
    "op9_sharding": op9_sharding,
    "op10_transport_streams": op10_transport_streams,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE
lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM lists WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (
  SELECT x, y FROM both_ways
  UNION
  SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM both_ways GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN low ON low.x = d.doc_id
""",
    "op4_warc": """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages),
bits AS (
  SELECT *, [('0x' || substr(hex, 5 * k + 1, 5))::BIGINT FOR k IN range(8)] AS w FROM sized)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((w[1 + k // 4] >> (15 - 5 * (k % 4))) & 31)::INTEGER, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
""",
    "op5_decontamination": r"""
WITH
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM item_words WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, i, g.n FROM grams g JOIN windows v ON g.s = v.s AND g.n = v.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op6_mixing_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('6:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS draw
  FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ([5, 2, 1])[1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::HUGEINT AS weight
  FROM sized GROUP BY source),
caps AS (SELECT *, (source_size * 200)::HUGEINT AS cap, (sum(source_size) OVER () * 150)::HUGEINT AS total FROM weighed),
tested AS (
  SELECT *, (total - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
    > cap * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS over_cap
  FROM caps WINDOW w AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, encode(source) NULLS LAST)),
marked AS (
  SELECT *, bool_and(over_cap) OVER (ORDER BY source_size::DOUBLE / weight::DOUBLE, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS capped
  FROM tested),
level AS (
  SELECT max(total) - coalesce(sum(cap) FILTER (capped), 0) AS left_over, coalesce(sum(weight) FILTER (NOT capped), 0) * 100 AS free
  FROM marked),
plan AS (
  SELECT source, source_size,
    CASE WHEN capped THEN (source_size * 2)::DOUBLE ELSE (weight * left_over)::DOUBLE / nullif(free, 0)::DOUBLE END AS target
  FROM marked, level),
parts AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM plan),
drawn AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
    sum(size) OVER (PARTITION BY s.source ORDER BY draw, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN upto * 2 - size <= rest * 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
""",
}
