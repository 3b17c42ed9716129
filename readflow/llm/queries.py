"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, hard_negatives, jaccard_join, langid, mixing, prefix_trie, quality, sentence_pieces, substring_dedup, token_counts, topk, warc
from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    mixed = mixing.mix(sized, quality_col="quality", tie=F.col("text_hash"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~langid.held_out()))
    return quality.score(docs, model).withColumn("held_out", langid.held_out())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.digests(substring_dedup.dedup_substrings(docs))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_paths(chat.replies(rows)))


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = sentence_pieces.sample_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    back = F.sha2("decoded", 256).alias("decoded_sha256")
    return found.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), "log_prob", "log_inclusion", F.xxhash64("ids").alias("ids_hash"), back)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archived(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    return prefix_trie.nodes_with_ends(*prefix_trie.rebuilt(turns))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_fingerprints": op1_fingerprints, "op2_token_counts": op2_token_counts, "op3_topk": op3_topk, "op4_sentence_pieces": op4_sentence_pieces, "op5_jaccard_join": op5_jaccard_join, "op6_mixing": op6_mixing, "op7_chat_format": op7_chat_format, "op8_substring_dedup": op8_substring_dedup, "op9_quality": op9_quality, "op10_language_id": op10_language_id, "op11_warc": op11_warc, "op12_prefix_trie": op12_prefix_trie, "op13_hard_negatives": op13_hard_negatives}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": TOPK_SQL, "op7_chat_format": CHAT_SQL, "op8_substring_dedup": SUBSTRING_SQL, "op11_warc": WARC_SQL, "op12_prefix_trie": TRIE_SQL, "op13_hard_negatives": NEGATIVES_SQL}


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

SUBSTRING_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS code
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), f AS (
  SELECT code, min(doc_id) AS low FROM s GROUP BY code HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT s.doc_id, s.i + j AS pos FROM s JOIN f USING (code), range(0, 50) t(j) WHERE s.doc_id > f.low
), g AS (SELECT doc_id, count(*) AS n, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""

CHAT_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, list_reduce(['<|', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
    lambda t, x: replace(t, x, x[1] || chr(92) || x[2:]), replace(text, chr(92), chr(92) || chr(92))) AS safe FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|start|>') + length(role) + length('<|text|>') + length(safe) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
    CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM s WHERE alike
), n AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON place <= 5 AND s.anchor_id = p.anchor_id AND NOT alike
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

TRIE_SQL = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    md5(coalesce(role, '') || chr(10) || coalesce(text, '')) AS code,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT c, c - c % 20 AS head, CAST(xor(4294967295, list_reduce(
    list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, x: list_reduce(range(8), lambda b, i: xor(b >> 1, (b & 1) * 3988292384), xor(a, x)), 4294967295)) AS BIGINT) % 4 AS share
  FROM (SELECT DISTINCT c FROM t)
), b AS (
  SELECT k.c, least(k.share, count(h.pos)) AS begun, k.share, k.head
  FROM k LEFT JOIN t h ON h.c = k.head AND h.pos <= k.share GROUP BY k.c, k.share, k.head
), r AS (
  SELECT b.c, h.pos, h.code, h.words FROM b JOIN t h ON h.c = b.head AND h.pos <= b.share
  UNION ALL
  SELECT b.c, b.begun + t.pos - b.share, t.code, t.words FROM b JOIN t ON t.c = b.c AND t.pos > b.share
), s AS (
  SELECT k.c, coalesce(list(code ORDER BY pos) FILTER (WHERE code IS NOT NULL), []) AS codes, list(words ORDER BY pos) AS words
  FROM k LEFT JOIN r USING (c) GROUP BY k.c
), p AS (
  SELECT c, unnest(range(0, len(codes) + 1)) AS depth, codes, words FROM s
), q AS (
  SELECT c, depth, md5(array_to_string(codes[:depth], '')) AS node, CASE WHEN depth > 0 THEN md5(array_to_string(codes[:depth - 1], '')) END AS up,
    CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS w, depth = len(codes) AS ended FROM p
), n AS (
  SELECT node, depth, up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(w) AS own,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ended), '')) AS ends_sha256
  FROM q GROUP BY node, depth, up
), m AS (
  SELECT n.*, count(x.node) AS n_children, min(y.conv_id) AS parent_conv_id
  FROM n LEFT JOIN n x ON x.up = n.node AND x.depth = n.depth + 1 LEFT JOIN n y ON y.node = n.up AND y.depth = n.depth - 1 GROUP BY ALL
)
SELECT m.conv_id, m.depth, m.parent_conv_id, m.n_convs, m.n_children, CAST(sum(CASE WHEN z.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
  CAST(sum(z.own) AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN q ON q.node = m.node AND q.depth = m.depth JOIN m z ON z.conv_id = q.c AND z.depth >= m.depth
GROUP BY m.conv_id, m.depth, m.parent_conv_id, m.n_convs, m.n_children, m.ends_sha256
"""

WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS low, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS place FROM p
)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(d, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN low END AS refers_to
FROM g
"""
