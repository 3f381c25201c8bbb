"""Registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewgate.llm import (
    backoff_lm,
    bpe,
    conversation_repair,
    cotraining,
    decontaminate,
    html_text,
    language_id,
    lexical,
    quality_rules,
    sharding,
    simhash,
    url_filter,
    warc,
)
from reviewgate.llm.frames import bounded_batches, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(run: Query) -> Query:
    def bounded(spark: SparkSession, sf: str) -> DataFrame:
        return run(bounded_batches(spark), sf)

    QUERIES[run.__name__] = bounded
    return run


@query
def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    found = sharding.interleaved(table(spark, sf, "documents"))
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


ORACLE["op1_sharding"] = r"""
WITH bytes AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
           list_prepend(b::BIGINT, range(8)::BIGINT[]),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS stratum,
         strlen(coalesce(text, ''))::BIGINT + 1 AS size,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                            lambda x: ('0x' || x)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])),
           4294967295)::BIGINT AS text_crc32,
         ('0x' || substr(md5('shard:0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT
           AS shuffled
  FROM documents, bytes
), ranked AS (
  SELECT *, row_number() OVER (
              PARTITION BY stratum ORDER BY shuffled, doc_id NULLS FIRST, text_crc32, size) AS rank,
         count(*) OVER (PARTITION BY stratum) AS of_stratum
  FROM docs
), placed AS (
  SELECT *, row_number() OVER (
              ORDER BY (2 * rank - 1)::DOUBLE / (2 * of_stratum)::DOUBLE, stratum, rank) - 1 AS pos,
         count(*) OVER () AS n
  FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 16 // n)::INTEGER AS shard,
       (pos - ((pos * 16 // n) * n + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""


@query
def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn(
        "held_out", language_id.held_out(F.col("doc_id"))
    )
    model = language_id.train(docs.filter("not held_out"))
    return language_id.identify(docs, model).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


@query
def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf, "documents"))
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return book.select(
        "doc_id",
        *[F.col(f"measured.{x}").alias(x) for x in measures],
        (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"),
        quality_rules.passes(quality_rules.CURRENT).alias("kept"),
        F.col("failed").alias("failed_bits"),
    )


ORACLE["op3_quality_rules"] = r"""
WITH words AS (
  SELECT rowid AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents)
), windows AS (
  SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows)
  WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n
  FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, ((n_words < 50)::BIGINT
             + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
             + 4 * (10 * n_symbols > n_words)::BIGINT
             + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
             + 16 * (word_chars < 2 * n_words)::BIGINT
             + 32 * (word_chars > 25 * n_words)::BIGINT)::BIGINT AS failed_bits
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM judged
"""


@query
def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_leaks(
        table(spark, sf, "documents"), table(spark, sf, "benchmark")
    )


@query
def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.archived(table(spark, sf, "pages"))
    return found.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE["op5_warc"] = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload,
         strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), keepers AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS keeper FROM payloads
), judged AS (
  SELECT *, payload_bytes >= 1000 AND keeper IS NOT NULL
            AND page_id IS DISTINCT FROM keeper AS revisit
  FROM keepers
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN keeper END AS refers_to
FROM judged
"""


@query
def op6_cotraining(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return cotraining.score(docs, cotraining.train(docs, table(spark, sf, "labels")))


@query
def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_texts(
        table(spark, sf, "documents"),
        public_tokenizers.path(VOCABULARY),
        public_tokenizers.PATTERN,
        ids=False,
    )


@query
def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


URL_RULES = [
    url_filter.Rule(url_filter.ALLOW, "org", "/"),
    url_filter.Rule(url_filter.BLOCK, "example.org", "/es/"),
    url_filter.Rule(url_filter.BLOCK, "example.org", "/en/1"),
    url_filter.Rule(url_filter.ALLOW, "com", "/fr/"),
    url_filter.Rule(url_filter.BLOCK, "com", "/de/"),
]


@query
def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled urls are those that a rule decides."""
    pages = table(spark, sf, "pages")
    parts = url_filter.with_parts(pages.select("url"))
    blocked = url_filter.ruled(URL_RULES)[1] == url_filter.BLOCK
    weights = url_filter.train(parts.select("url", blocked.alias("blocked")))
    found = url_filter.judge(pages, URL_RULES, weights)
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op10_html_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    found = html_text.extract(pages, html_text.host_paths(pages))
    return found.select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


@query
def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


ORACLE["op11_lexical_search"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), docs AS (
  SELECT *, len(terms)::BIGINT AS size FROM texts WHERE len(terms) > 0
), whole AS (
  SELECT count(*)::BIGINT AS documents, sum(size)::BIGINT AS length FROM docs
), asked AS (
  SELECT item_row, item_id, term, count(*)::BIGINT AS repeats
  FROM (SELECT row_number() OVER () AS item_row, item_id, unnest(regexp_extract_all(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark WHERE text IS NOT NULL)
  GROUP BY ALL
), counted AS (
  SELECT r, term, count(*)::BIGINT AS tf
  FROM (SELECT r, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term,
         floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT
           AS weight
  FROM counted, whole GROUP BY term
), scored AS (
  SELECT item_row, item_id, r, doc_id,
         sum(repeats * weight
             * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * documents) // length))))::BIGINT
           AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN docs USING (r), whole
  GROUP BY item_row, item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (
              PARTITION BY item_row ORDER BY score DESC, doc_id ASC NULLS FIRST)::INTEGER AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query
def op12_backoff_lm(spark: SparkSession, sf: str) -> DataFrame:
    return backoff_lm.score_texts(table(spark, sf, "documents"))


@query
def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf, "conversations"))
    return conversation_repair.repaired_digests(rows)


ORACLE["op13_conversation_repair"] = r"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
           list_prepend(b::BIGINT, range(8)::BIGINT[]),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), checked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT,
             list_transform(
               regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':'
                                             || coalesce(turn::VARCHAR, ' '))), '..'),
               lambda x: ('0x' || x)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])),
           4294967295)::BIGINT % 20 AS damage
  FROM conversations, bytes
), remaining AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM checked WHERE damage <> 0
), ordered AS (
  SELECT *, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i
  FROM remaining
), marked AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't'
              ELSE '-' END AS fault
  FROM ordered
), steps(q, x, q2) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), added(q, q2, cost, letters, lines) AS (
  SELECT q, q, 0, '', '' FROM (VALUES (0), (1), (2), (3)) AS all_states(q)
  UNION ALL SELECT q, 2, 3, 'I', chr(10) || 'user:' FROM (VALUES (0), (1), (3)) AS s(q)
  UNION ALL SELECT 2, 3, 3, 'I', chr(10) || 'assistant:'
  UNION ALL SELECT q, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'
            FROM (VALUES (0), (1), (3)) AS s(q)
  UNION ALL SELECT 2, 2, 6, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'
), edits AS (
  SELECT conv_id, i, q, q AS q2, 4 AS cost, 'D' AS letter, '' AS line
  FROM marked, (VALUES (0), (1), (2), (3)) AS s(q)
  UNION ALL
  SELECT conv_id, i, q, q2, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K',
         chr(10) || role || ':' || text
  FROM marked JOIN steps ON x = initial WHERE fault NOT IN ('b', 'd')
  UNION ALL
  SELECT conv_id, i, q, q2, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R',
         chr(10) || CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
  FROM marked, steps WHERE fault NOT IN ('b', 'd') AND x <> 's'
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS best
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.q2,
         min({'cost': w.best.cost + a.cost + e.cost, 'audit': w.best.audit || a.letters || e.letter,
              'lines': w.best.lines || a.lines || e.line})
  FROM walk w JOIN added a ON a.q = w.q
       JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.q = a.q2
  GROUP BY w.conv_id, w.i, e.q2
), counted AS (
  SELECT conv_id, count(*) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + a.cost, 'audit': w.best.audit || a.letters,
                         'lines': w.best.lines || a.lines}) AS best
  FROM walk w JOIN added a ON a.q = w.q AND a.q2 IN (0, 3)
       LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.i = coalesce(c.n, 0) GROUP BY w.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, best.cost AS cost, best.audit AS audit,
       sha256(substr(best.lines, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
