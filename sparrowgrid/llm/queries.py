"""Queries over the driver's tables, one for each training-data operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowgrid.llm.common import settle
from sparrowgrid.session import read as read_table


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables, in a session set for the operators."""
    settle(spark)
    return read_table(spark, sf_dir, table)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the public 32k piece model."""
    import public_tokenizers

    from sparrowgrid.llm import pieces

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingle sets overlap by nine tenths."""
    from sparrowgrid.llm import jaccard

    return jaccard.jaccard_groups(read(spark, sf_dir, "documents"), n=3, num=90, den=100)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)
), r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of smaller ones."""
    from sparrowgrid.llm import repeats

    return repeats.digests(repeats.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), length=50))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back."""
    from sparrowgrid.llm import warc

    return warc.read(warc.write(read(spark, sf_dir, "pages"), least=0)).drop("url")


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, body, strlen(body) AS n, sha1(body) || '0' AS h FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM d
)
SELECT page_id, n AS payload_bytes,
  list_aggregate([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((((instr('0123456789abcdef', substr(h, CAST(1 + (5 * i) // 4 AS INT), 1)) - 1) * 16
      + instr('0123456789abcdef', substr(h, CAST(2 + (5 * i) // 4 AS INT), 1)) - 1) >> CAST(3 - (5 * i) % 4 AS INT)) & 31 AS INT), 1)
    FOR i IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and conversation -7, and read them back from the formatted text."""
    from sparrowgrid.llm import chat

    said = F.lit("\\### Assistant: </turn> ok")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = [F.struct(F.lit(-7).alias("conv_id"), F.lit(k).alias("turn"), F.lit(role).alias("role"), said.alias("text")) for k, role in enumerate(("user", "assistant"))]
    more = spark.range(1).select(F.inline(F.array(*turns))).select(*(F.col(c).cast(t).alias(c) for c, t in rows.dtypes))
    return chat.digests(chat.format_conversations(rows.unionByName(more)))


OP5_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(15 + length(role) + length(text) + length(text) - length(translate(text, '\<#', '')))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-bilinear and unigram scores of every document, a fifth of them held out."""
    from sparrowgrid.llm import neural_lm

    return neural_lm.score(read(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of embeddings with a cosine of nine tenths or more."""
    from sparrowgrid.llm import pivots

    return pivots.near_duplicates(read(spark, sf_dir, "embeddings"), limit=0.9)


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), e AS (
  SELECT a.vec_id AS p, b.vec_id AS q FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) >= 0.9 * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))
    AND list_dot_product(a.x, a.x) > 0 AND list_dot_product(b.x, b.x) > 0
), r(vec_id, reach) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, e.q FROM r JOIN e ON r.reach = e.p
)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id) c
LEFT JOIN (SELECT p, count(*) AS n FROM e GROUP BY p) n ON n.p = c.vec_id
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of the line-first rules for every document."""
    from sparrowgrid.llm import quality

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, cleaned=False).drop("text")


def quality_base_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 8's result that SQL can say."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), n AS (
  SELECT doc_id, t, ws, len(ws) AS n, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w
), g AS (
  SELECT doc_id, unnest(range(1, n - 1)) AS i, ws FROM n WHERE n >= 3
), h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS k FROM g
), c AS (
  SELECT doc_id, count(DISTINCT i + d) AS r FROM h, (VALUES (0), (1), (2)) v(d) WHERE k > 1 GROUP BY 1
)
SELECT n.doc_id, n AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, n < 50 OR 100 * coalesce(r, 0) > 50 * n AS base_failed
FROM n LEFT JOIN c USING (doc_id)
"""


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from sparrowgrid.llm import extract

    return extract.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in bins of 2,048 words, no two of a source or of a copy group in one bin."""
    from sparrowgrid.llm import packing

    return packing.pack(read(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that a document is of quality, by a model of the labels of three quarters of the ids."""
    from sparrowgrid.llm import ftrl

    return ftrl.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether it verifies after tampering."""
    from sparrowgrid.llm import merkle

    return merkle.manifest(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
    [coalesce(strlen(v) || ':' || v, '-') FOR v IN [doc_id::VARCHAR, source, lang, n_chars::VARCHAR]] AS f, text, replace(text, chr(10), '') AS cut,
    list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')],
      lambda a, b: list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents
), l AS (
  SELECT *, sha256(array_to_string(f, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    -- the checksum is the complement, so it is even where this is odd
    CASE WHEN crc % 2 = 1 THEN sha256(array_to_string(f, '') || coalesce(strlen(cut) || ':' || cut, '-')) END AS tampered
  FROM d
), k AS (
  SELECT doc_id, leaf, tampered, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM l
), low AS (
  SELECT tree, 0 AS level, i, n, leaf AS h FROM k
  UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, level, i // 3, n
), sub AS (
  SELECT tree, h, level FROM low WHERE n = 1
), top AS (
  SELECT -1::BIGINT AS tree, 0 AS level, tree AS i, (SELECT count(*) FROM sub) AS n, h FROM sub
  UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY tree, level, i // 3, n
), nodes AS (
  SELECT * FROM low UNION ALL SELECT * FROM top
), beside AS (
  SELECT tree, level, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY tree, level, i // 3 ORDER BY i)
), up AS (
  SELECT doc_id, leaf, tree AS own, tree, 0 AS level, i, coalesce(tampered, leaf) AS folded, '' AS proof, n = 1 AS ready FROM k
  UNION ALL
  SELECT doc_id, leaf, own, CASE WHEN ready THEN -1 ELSE up.tree END, CASE WHEN ready THEN 0 ELSE up.level + 1 END, CASE WHEN ready THEN up.tree ELSE up.i // 3 END,
    CASE WHEN ready THEN folded ELSE sha256(lefts || folded || rights) END, CASE WHEN ready THEN proof ELSE proof || lefts || rights END,
    NOT ready AND up.tree >= 0 AND up.level + 1 = sub.level
  FROM up LEFT JOIN beside b ON NOT ready AND b.tree = up.tree AND b.level = up.level AND b.i = up.i LEFT JOIN sub ON sub.tree = up.tree
  WHERE ready OR b.tree IS NOT NULL
), root AS (
  SELECT h FROM top WHERE n = 1
)
SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.h AS verified
FROM up JOIN sub ON sub.tree = own JOIN root ON TRUE
WHERE up.tree = -1 AND up.level = (SELECT max(level) FROM top)
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all 120 orders, for every language."""
    from sparrowgrid.llm import audit

    return audit.interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
      + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, FALSE)::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), o(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(filter_order, x)
), s AS (
  SELECT filter_order, k AS step, 1 << CAST(instr('ABCDE', filter_order[k]) - 1 AS INT) AS bit,
    coalesce(list_sum([1 << CAST(instr('ABCDE', filter_order[j]) - 1 AS INT) FOR j IN range(1, k)]), 0)::INT AS before
  FROM o, range(1, 6) r(k) WHERE length(filter_order) = 5
), f AS (
  SELECT part, filter_order, step::INT AS step, bit,
    coalesce(sum(n) FILTER (WHERE mask & (bit | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM f
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_warc": op4_warc,
    "op5_chat_format": op5_chat_format,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_html_text": op9_html_text,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_filter_audit": op13_filter_audit,
    "quality_base_figures": quality_base_figures,
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": OP2_SQL,
    "op4_warc": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op7_embedding_near_dedup": OP7_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
    "quality_base_figures": QUALITY_SQL,
}
