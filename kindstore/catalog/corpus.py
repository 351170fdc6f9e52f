"""Corpus preparation, sampling, set operations and resuming."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindstore.catalog.registry import part, query, r6, rounded
from kindstore.catalog.texts import single
from kindstore.operators import corpus
from kindstore.operators.prefix import dense_ids
from kindstore.operators.results import concat_results, describe_by_group, group_counts

part(
    "split_scored",
    """
SELECT *, CASE WHEN toxicity > 0.5 THEN 'toxic' WHEN toxicity <= 0.1 THEN 'nontoxic' END AS store FROM scored_corpus""",
)
part(
    "split_labelled",
    """
SELECT *, CASE WHEN prompt_label >= 0.5 THEN 'toxic' WHEN prompt_label < 0.1 THEN 'nontoxic' END AS store FROM labelled_prompts""",
)


@query("split_by_toxicity", f"SELECT doc_id, store, {r6('toxicity', 'toxicity')} FROM split_scored WHERE store IS NOT NULL")
def split_by_toxicity(t):
    return rounded(corpus.split_by_toxicity(t.scored_corpus).select("doc_id", "store", "toxicity"))


@query("split_by_label", "SELECT conv_id, turn, store, md5(prompt) AS digest FROM split_labelled WHERE store IS NOT NULL")
def split_by_label(t):
    return corpus.split_by_label(t.labelled_prompts).select("conv_id", "turn", "store", F.md5("prompt").alias("digest"))


@query("limit_prompts", "SELECT prompt_idx, text FROM prompts WHERE prompt_idx >= 7 ORDER BY prompt_idx LIMIT 13")
def limit_prompts(t):
    done = t.prompts.where("prompt_idx < 7").select("prompt_idx")
    return corpus.limit_prompts(t.prompts, 20, done).select("prompt_idx", F.col("prompt.text").alias("text"))


@query(
    "holdout_split",
    """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < round((SELECT count(*) FROM documents) * 5 / 100.0)
  THEN 'validation' ELSE 'train' END AS split FROM documents""",
)
def holdout_split(t):
    return corpus.holdout_split(t.documents.select("doc_id"), "doc_id")


@query("dense_ids", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS entry_id, toxic FROM labels")
def _dense_ids(t):
    return dense_ids(t("labels").select("doc_id", "toxic"), "doc_id")


part(
    "prompt_lines",
    "SELECT DISTINCT store, unnest(string_split(prompt, '\\n- ')) AS text FROM split_labelled WHERE store IS NOT NULL",
)
_ws = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
part(
    "labelled_corpus",
    f"""
SELECT store, regexp_replace(trim(replace(text, '\\n', ''), '-'), '^{_ws}|{_ws}$', '', 'g') AS text FROM (
  SELECT store, text FROM prompt_lines UNION ALL SELECT store, generation FROM split_labelled WHERE store IS NOT NULL)""",
)


def labelled_corpus(t):
    return corpus.dedup_prompt_lines(corpus.split_by_label(t.labelled_prompts))


@query("dedup_prompt_lines", "SELECT store, text, count(*) AS n FROM labelled_corpus GROUP BY ALL")
def dedup_prompt_lines(t):
    return labelled_corpus(t).groupBy("store", "text").agg(F.count("*").alias("n"))


@query(
    "union_corpora",
    """
SELECT store, md5(text) AS digest, count(*) AS n FROM (
  SELECT store, text FROM split_scored WHERE store IS NOT NULL
  UNION ALL SELECT CASE toxic WHEN 1 THEN 'toxic' ELSE 'nontoxic' END, text FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT store, text FROM labelled_corpus) GROUP BY ALL""",
)
def union_corpora(t):
    scored = corpus.split_by_toxicity(t.scored_corpus).select("store", "text")
    parallel = t.documents.join(t("labels"), "doc_id").select(
        F.when(F.col("toxic") == 1, "toxic").otherwise("nontoxic").alias("store"), "text"
    )
    together = corpus.union_corpora(scored, parallel, labelled_corpus(t))
    return together.groupBy("store", F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query(
    "cumulative_domains",
    """
SELECT s.stage, c.store, c.domain, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM domain_corpus c JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS stage) s ON CAST(substr(c.domain, 2) AS INTEGER) <= s.stage
GROUP BY ALL""",
)
def cumulative_domains(t):
    grown = corpus.cumulative_domains(t.domain_corpus, [f"d{i}" for i in range(5)])
    return grown.groupBy("stage", "store", "domain").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


@query(
    "stratified_sample",
    """
SELECT id, domain FROM (SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('42:'||id), id) AS r
  FROM single WHERE toxic = 1) WHERE r <= 10""",
)
def stratified_sample(t):
    return corpus.stratified_sample(single(t).where("toxic = 1"), "domain", 10).select("id", "domain").orderBy("id")


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('42:'||doc_id), doc_id LIMIT 250")
def seeded_sample(t):
    return corpus.seeded_sample(t("documents").select("doc_id"), 250, ident="doc_id")


@query(
    "cumulative_counts",
    """
SELECT domain, n, CAST(sum(n) OVER (ORDER BY domain) AS BIGINT) AS n_cumulative
FROM (SELECT domain, count(*) AS n FROM single WHERE toxic = 1 AND split <> 'test' GROUP BY domain)""",
)
def cumulative_counts(t):
    return corpus.cumulative_counts(single(t).where("toxic = 1 and split <> 'test'"), "domain")


@query("group_counts", "SELECT split, domain, count(*) AS n, count(DISTINCT comment_text) AS n_distinct_comment_text FROM single GROUP BY ALL")
def _group_counts(t):
    return group_counts(single(t), ["split", "domain"], ["comment_text"])


@query(
    "describe_by_group",
    """
SELECT domain, count(*) AS "count", round(avg(toxicity), 3) AS mean, round(stddev_samp(toxicity), 3) AS std, round(min(toxicity), 3) AS "min",
       round(quantile_cont(toxicity, 0.25), 3) AS p25, round(quantile_cont(toxicity, 0.5), 3) AS p50,
       round(quantile_cont(toxicity, 0.75), 3) AS p75, round(max(toxicity), 3) AS "max"
FROM single GROUP BY domain""",
)
def _describe_by_group(t):
    return describe_by_group(single(t), "domain", "toxicity")


@query(
    "resume_pending",
    """
SELECT request_id, md5(text) AS digest FROM generations WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def resume_pending(t):
    done = t("labels").select(F.concat(F.lit("generation-"), F.col("doc_id").cast("string")).alias("request_id"))
    pending = corpus.resume_pending(t.generations, done)
    return pending.select("request_id", F.md5("text").alias("digest"))


@query(
    "concat_results",
    f"""
SELECT 'sources' AS experiment, source AS name, {r6("avg(n_chars)", "mean_chars")}, CAST(NULL AS BIGINT) AS n FROM documents GROUP BY source
UNION ALL SELECT 'languages', lang, NULL, count(*) FROM documents GROUP BY lang""",
)
def _concat_results(t):
    docs = t("documents")
    sources = docs.groupBy(F.col("source").alias("name")).agg(F.avg("n_chars").alias("mean_chars"))
    languages = docs.groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n"))
    return rounded(concat_results({"sources": sources, "languages": languages}))
