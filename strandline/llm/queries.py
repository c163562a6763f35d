"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.bpe import round_trip
from strandline.llm.chat import conversations_without_quotes
from strandline.llm.licence_templates import TEMPLATES
from strandline.llm.licences import scan_licences
from strandline.llm.mixing import label_domains, mixture
from strandline.llm.near_duplicates import near_duplicates
from strandline.llm.one_bit import neighbours
from strandline.llm.prefix_trie import prefix_trie
from strandline.llm.ranked_search import ranked
from strandline.llm.shared import documents_at
from strandline.llm.sharding import shard_documents
from strandline.llm.spotsigs import fingerprint_documents
from strandline.llm.token_shards import shard_digests
from strandline.llm.top_k import top_k
from strandline.llm.toxicity import toxicity


#: The shares of tokens that the mixture aims at.
TARGETS = {"high": 0.8, "low": 0.12, "toxic": 0.08}


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents_at(spark, sf_dir), label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents_at(spark, sf_dir), TEMPLATES)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents_at(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents_at(spark, sf_dir), 4, 80)


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digests(documents_at(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 0)


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents_at(spark, sf_dir), 24)


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_without_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents_at(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents_at(spark, sf_dir))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


def op11_rotated_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, 10)


def op12_windowed_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents_at(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_soft_mixing, op2_licence_scan, op3_byte_bpe, op4_setsketch_near_duplicates, op5_token_shards, op6_hash_tree_shards, op7_quotation_linking, op8_toxicity, op9_spotsigs, op10_exact_top_k, op11_rotated_one_bit_codes, op12_windowed_bucket_search, op13_prefix_trie)}

#: Words and shingles as the operator defines them; components by the smallest label that spreads over the links.
OP4_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
    FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS label FROM both_ways UNION SELECT l.b, r.label FROM reach r JOIN both_ways l ON l.a = r.node WHERE r.label < l.b),
low AS (SELECT node, min(label) AS label FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least(l.label, s.doc_id), s.doc_id) AS component_id, coalesce(least(l.label, s.doc_id), s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN low l ON l.node = s.doc_id
"""

OP10_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

#: The nearest by brute force: the query misses none of them but by an estimate that is off by more than its bound.
OP11_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), lambda a, b: a + b)) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

OP12_SQL = r"""
WITH t AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
d AS (SELECT r, doc_id, words, CAST(len(words) AS BIGINT) AS n FROM t WHERE len(words) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals GROUP BY term),
adds AS (SELECT r, doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS s FROM tf JOIN weights ON weights.term = tf.term, totals),
scores AS (SELECT item_id, r, doc_id, CAST(sum(s) AS BIGINT) AS score FROM adds JOIN asked ON asked.term = adds.term GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

OP13_SQL = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
original AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS turns FROM t GROUP BY conv_id),
crc AS (
    SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR k IN range(8)]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM original),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns[1:h], []), c.turns[h + 1:]) AS turns
    FROM crc c LEFT JOIN original b ON b.conv_id = c.conv_id - c.conv_id % 100),
members AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
nodes AS (
    SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
    FROM members GROUP BY 1, 2),
below AS (
    SELECT p.path, p.depth, count(k.path) AS n_children, any_value(p.conv_id) AS conv_id, any_value(p.n_convs) AS n_convs, any_value(p.ends_sha256) AS ends_sha256
    FROM nodes p LEFT JOIN nodes k ON k.depth = p.depth + 1 AND k.path[1:p.depth] = p.path GROUP BY 1, 2),
every AS (SELECT path AS node, n_children = 0 AS leaf, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END AS saved, unnest(range(0, depth + 1)) AS d FROM below),
sums AS (SELECT node[1:d] AS path, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM every GROUP BY 1)
SELECT b.conv_id, b.depth, p.conv_id AS parent_conv_id, b.n_convs, b.n_children, s.n_leaves, s.saved_tokens, b.ends_sha256
FROM below b JOIN sums s ON s.path = b.path LEFT JOIN nodes p ON b.depth > 0 AND p.depth = b.depth - 1 AND p.path = b.path[1:b.depth - 1]
"""

ORACLE_SQL: dict[str, str] = {
    "op4_setsketch_near_duplicates": OP4_SQL,
    "op10_exact_top_k": OP10_SQL,
    "op11_rotated_one_bit_codes": OP11_SQL,
    "op12_windowed_bucket_search": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
