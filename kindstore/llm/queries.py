"""The registered query of each operator, over whole driver tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from kindstore.llm.bpe import round_trip
from kindstore.llm.conversations import repair_damaged
from kindstore.llm.exact import exact_groups
from kindstore.llm.hnsw import nearest_vectors
from kindstore.llm.language import fit_language, held_out, predict_language
from kindstore.llm.lengths import length_histogram, suffix_sums
from kindstore.llm.lexical import rank_documents
from kindstore.llm.linededup import dedup_lines
from kindstore.llm.mixing import mix_sources
from kindstore.llm.quality import fit_quality, quality_rules
from kindstore.llm.registry import ORACLES, QUERIES, query, table
from kindstore.llm.secrets import digest_spans, scan_secrets, secrets_sql
from kindstore.llm.simhash import near_groups
from kindstore.llm.toxicity import fit_toxicity, score_toxicity
from kindstore.llm.toxicity import held_out as toxicity_held_out
from kindstore.session import materialize

__all__ = ["ORACLES", "QUERIES"]

RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op4_byte_bpe")
def op4(spark, folder):
    path = public_tokenizers.path(RANKS)
    return round_trip(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query(
    "op8_exact_dedup",
    r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
)
def op8(spark, folder):
    return exact_groups(table(spark, folder, "documents"))


@query("op9_token_counts")
def op9(spark, folder):
    path = public_tokenizers.path(RANKS)
    histogram = length_histogram(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return suffix_sums(materialize(histogram, "length-histogram"))


@query("op5_simhash")
def op5(spark, folder):
    return near_groups(table(spark, folder, "documents"))


@query(
    "op2_mix_sources",
    r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n,
         1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source
), f AS (
  SELECT source, n, w, 3 * n AS cap,
         sum(n) OVER () - coalesce(sum(3 * n) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weight
  FROM s WINDOW before AS (ORDER BY 3.0::DOUBLE * n / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT rest, weight FROM f WHERE rest * w <= cap * weight ORDER BY weight DESC LIMIT 1
), t AS (
  SELECT source, n, CASE WHEN f.rest * w > cap * f.weight THEN CAST(cap AS DOUBLE)
         ELSE CAST(l.rest * w AS DOUBLE) / CAST(l.weight AS DOUBLE) END AS target
  FROM f LEFT JOIN l ON true
), q AS (
  SELECT source, n, target, CAST(floor(target + 0.5) AS BIGINT) AS words FROM t
), r AS (
  SELECT d.*, q.n, q.target, CASE WHEN n > 0 THEN words // n ELSE 0 END AS times, CASE WHEN n > 0 THEN words % n ELSE 0 END AS rest
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), u AS (
  SELECT source, o, CAST(sum(size) AS BIGINT) AS size, max(rest) AS rest FROM r WHERE size > 0 GROUP BY source, o
), e AS (
  SELECT source, list_reduce(
    list_prepend({'gap': max(rest), 'size': CAST(0 AS BIGINT), 'took': CAST([] AS VARCHAR[])},
                 list({'gap': CAST(0 AS BIGINT), 'size': size, 'took': [o]} ORDER BY o)),
    lambda a, x: CASE WHEN x.size <= a.gap
                      THEN {'gap': a.gap - x.size, 'size': CAST(0 AS BIGINT), 'took': list_concat(a.took, x.took)} ELSE a END) AS s
  FROM u GROUP BY source
), x AS (
  SELECT u.source, min(struct_pack(off := abs(u.size - e.s.gap), o := u.o)) AS best
  FROM u JOIN e ON u.source IS NOT DISTINCT FROM e.source
  WHERE NOT list_contains(e.s.took, u.o) AND abs(u.size - e.s.gap) < e.s.gap GROUP BY u.source
)
SELECT r.doc_id, r.size, r.n AS source_size, r.target,
       CAST(r.size * (r.times + CASE WHEN list_contains(e.s.took, r.o) OR r.o = x.best.o THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r LEFT JOIN e ON r.source IS NOT DISTINCT FROM e.source LEFT JOIN x ON r.source IS NOT DISTINCT FROM x.source
""",
)
def op2(spark, folder):
    mixed = mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_secret_scan", secrets_sql())
def op10(spark, folder):
    return digest_spans(scan_secrets(table(spark, folder, "documents")))


@query("op6_language")
def op6(spark, folder):
    docs = table(spark, folder, "documents")
    found = predict_language(docs.select("doc_id", "text"), fit_language(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op1_quality_rules")
def op1(spark, folder):
    docs = table(spark, folder, "documents")
    return quality_rules(docs, fit_quality(docs, table(spark, folder, "labels")))


@query("op7_toxicity")
def op7(spark, folder):
    docs = table(spark, folder, "documents")
    found = score_toxicity(docs, fit_toxicity(docs, table(spark, folder, "labels")))
    return found.select(
        "doc_id",
        toxicity_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


@query("op3_line_dedup")
def op3(spark, folder):
    found = dedup_lines(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_lines",
        F.size("deleted_lines").cast("bigint").alias("n_deleted"),
        F.array_join("deleted_lines", ",").alias("deleted_lines"),
        "copied_from",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


@query("op11_conversation_repair")
def op11(spark, folder):
    return repair_damaged(table(spark, folder, "conversations"))


@query("op12_nearest_vectors")
def op12(spark, folder):
    return nearest_vectors(table(spark, folder, "embeddings"))


@query(
    "op13_lexical_search",
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM d WHERE len(terms) > 0
), i AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY item_id, term
), f AS (
  SELECT r, term, count(*) AS tf
  FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight
  FROM f, g GROUP BY term, docs
), p AS (
  SELECT f.r, d.doc_id, f.term,
         w.weight * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (25 + (75 * len(d.terms) * g.docs) // g.words))) AS impact
  FROM f JOIN d USING (r) JOIN w USING (term), g
), s AS (
  SELECT i.item_id, p.r, p.doc_id, CAST(sum(i.times * p.impact) AS BIGINT) AS score
  FROM p JOIN i USING (term) GROUP BY i.item_id, p.r, p.doc_id
), k AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
""",
)
def op13(spark, folder):
    return rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
