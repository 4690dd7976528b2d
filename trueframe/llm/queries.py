"""The operators' named queries and their check SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, curriculum, hnsw, minhash, nn_descent, order_minhash, packing, periodic, prefix_trie, quality, runindex, toxicity, warc
from .common import prepare, table, written

WORD_BPE = "word_bpe_49k.json"


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mixed(table(prepare(spark), sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(prepare(spark), sf_dir, "embeddings"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(prepare(spark), sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_runindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.removal(table(prepare(spark), sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(prepare(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role",
                                       "'</s>[INST] ok [/INST]' AS text")
    segments = written(chat.format_chats(turns.unionByName(tricky)), "chat")
    return chat.read_digests(segments).drop("valid")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_catalogue(spark, warc.write_archive(table(prepare(spark), sf_dir, "pages")))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))


def op11_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(prepare(spark), sf_dir, "embeddings"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summaries(table(prepare(spark), sf_dir, "documents"), edit=True)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(prepare(spark), sf_dir, "conversations"))


QUERIES = {
    "op1_nn_descent": op1_nn_descent,
    "op2_order_minhash": op2_order_minhash,
    "op3_toxicity": op3_toxicity,
    "op4_mix": op4_mix,
    "op5_pack": op5_pack,
    "op6_quality": op6_quality,
    "op7_runindex": op7_runindex,
    "op8_chat": op8_chat,
    "op9_warc": op9_warc,
    "op10_minhash": op10_minhash,
    "op11_hnsw": op11_hnsw,
    "op12_periodic": op12_periodic,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op8_chat": r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
    SELECT *, length(text) + length(text) - length(replace(text, chr(92), ''))
           + len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<\|turn\|>|<\|text\|>|<\|end\|>'))
           + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE NULL END AS chars
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op9_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS owner FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM o""",
    "op4_mix": r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, '')) AS order_key
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
    FROM sized GROUP BY source),
capped AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, weight DESC, source NULLS LAST
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, weight DESC, source NULLS LAST
                                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM capped),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
placed AS (
    SELECT d.doc_id, d.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS passes,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.order_key, d.size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN source_size > 0 AND 2 * start + size <= 2 * (target - passes * source_size)
                              THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed""",
    "op13_prefix_trie": r"""
WITH RECURSIVE bits AS (
    SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) t(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
coded AS (
    SELECT *, substr(sha256(octet_length(encode(role)) || ':' || role || text), 1, 32) AS id, octet_length(encode(text)) AS size FROM turns),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, id) AS place FROM coded),
convs AS (
    SELECT conv_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
        lambda a, b: xor(a >> 8, tab[((xor(a, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crc),
rebuilt AS (
    SELECT c.conv_id, p.place, p.id, p.size FROM convs c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % 5 AND p.place <= c.h
    UNION ALL SELECT c.conv_id, p.place, p.id, p.size FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place > c.h),
steps AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth,
           string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS node, size
    FROM rebuilt
    UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
ends AS (SELECT conv_id, arg_max(node, depth) AS node FROM steps GROUP BY 1),
ended AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM ends GROUP BY 1),
nodes AS (
    SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
           CASE WHEN node <> '' THEN substr(node, 1, length(node) - 32) END AS parent
    FROM steps GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
every AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (node)),
subtrees AS (
    SELECT substr(node, 1, (32 * d)::BIGINT) AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM every) GROUP BY 1)
SELECT e.conv_id, e.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children::BIGINT AS n_children,
       s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(x.ids, '')) AS ends_sha256
FROM every e JOIN subtrees s USING (node) LEFT JOIN every p ON p.node = e.parent LEFT JOIN ended x ON x.node = e.node""",
}
