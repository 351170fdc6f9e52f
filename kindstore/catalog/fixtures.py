"""Inputs derived from the driver tables, in Spark and as SQL side by side.

Every derivation reads its whole table. ``U(s)`` is a reproducible uniform
number made from the md5 of a text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindstore.catalog.registry import part, u
from kindstore.functions.scalars import hash24, uniform, whole_div
from kindstore.schemas import ATTRIBUTES, DOMAINS
from kindstore.sources.readers import read_table

PER_PROMPT = 25
VOCABULARY = 10
STAGES = 5
WIDE_VOCABULARY = 50_000
WIDE_PROMPTS = 16  # of one task


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/documents.parquet", "doc_id", "text", spread="doc_id")

    # -- prompts, generations, scores

    @property
    def prompts(self) -> DataFrame:
        """One prompt per 25 documents; its text is the next benchmark item in turn."""
        bench = self("benchmark")
        n = bench.agg(F.count("*").alias("n")).scalar()
        idx = self("documents").select(whole_div(F.col("doc_id"), PER_PROMPT).alias("prompt_idx")).distinct()
        missing = F.col("prompt_idx") % 13 == 12
        record = F.struct(
            "text",
            F.when(~missing, uniform(F.lit("prompt:"), F.col("prompt_idx"))).alias("toxicity"),
        )
        return (
            idx.withColumn("item_id", F.col("prompt_idx") % n)
            .join(bench, "item_id")
            .select("prompt_idx", record.alias("prompt"), (F.col("prompt_idx") % 5 + 1).cast("string").alias("domain"))
        )

    @property
    def generations(self) -> DataFrame:
        idx = whole_div(F.col("doc_id"), PER_PROMPT)
        return self.documents.select(
            F.concat(F.lit("generation-"), F.col("doc_id").cast("string")).alias("request_id"),
            idx.alias("prompt_idx"),
            (F.col("doc_id") % PER_PROMPT).alias("pos"),
            "text",
        )

    @property
    def generation_lists(self) -> DataFrame:
        """At most 25 generations per row, by construction."""
        rows = self.generations.groupBy("prompt_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("_g"))
        return rows.select("prompt_idx", F.transform("_g", lambda g: g["text"]).alias("generations"))

    @property
    def scores(self) -> DataFrame:
        docs = read_table(self.spark, f"{self.folder}/documents.parquet", "doc_id", "n_chars", spread="doc_id")
        half = (F.col("n_chars") / 2).cast("int")

        def value(x):
            return F.struct(x.alias("value"), F.lit("PROBABILITY").alias("type"))

        def span(begin, end, tag, attribute):
            score = value(uniform(F.lit(f"{tag}:{attribute}:"), F.col("doc_id")))
            return F.struct(begin.alias("begin"), end.alias("end"), score.alias("score"))

        entries = []
        for a in ATTRIBUTES:
            whole = F.pow(uniform(F.lit(f"{a}:"), F.col("doc_id")), F.lit(16.0))
            spans = F.array(
                span(F.lit(0), half, "front", a), span(half, F.col("n_chars").cast("int"), "back", a)
            )
            entries += [F.lit(a.upper()), F.struct(value(whole).alias("summaryScore"), spans.alias("spanScores"))]
        failed = hash24(F.lit("null:"), F.col("doc_id")) % 50 == 0
        response = F.when(~failed, F.struct(F.create_map(*entries).alias("attributeScores")))
        return docs.select(
            F.concat(F.lit("generation-"), F.col("doc_id").cast("string")).alias("request_id"),
            response.alias("response"),
            F.when(failed, F.lit("HttpError")).alias("error"),
        )

    # -- corpora

    @property
    def scored_corpus(self) -> DataFrame:
        return self.documents.select("doc_id", "text", uniform(F.lit("toxicity:"), F.col("doc_id")).alias("toxicity"))

    @property
    def labelled_prompts(self) -> DataFrame:
        """Conversation turns, their line ends written as the literal line mark."""
        text = F.replace(F.col("text"), F.lit("\n"), F.lit("\\n- "))
        return self("conversations").select(
            "conv_id",
            "turn",
            text.alias("prompt"),
            F.concat(F.lit("-- "), F.col("role"), F.lit(" "), F.col("text"), F.lit(" \\n-")).alias("generation"),
            uniform(F.lit("pl:"), F.col("conv_id"), F.lit(":"), F.col("turn")).alias("prompt_label"),
        )

    @property
    def annotations(self) -> DataFrame:
        flags = {d: F.pow(uniform(F.lit(f"{d}:"), F.col("doc_id")), F.lit(8.0)) for d in DOMAINS}
        df = self.documents.select(
            F.col("doc_id").alias("id"),
            F.col("text").alias("comment_text"),
            F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 == 7, "val").otherwise("test").alias("split"),
            uniform(F.lit("toxicity:"), F.col("doc_id")).alias("toxicity"),
            *[v.alias(k) for k, v in flags.items()],
        )
        active = sum((F.when(F.col(d) >= 0.5, 1).otherwise(0) for d in DOMAINS), F.lit(0))
        return df.withColumn("identity_any", F.when(active > 0, 1.0).otherwise(0.0)).withColumn(
            "more_than_one_identity", active > 1
        )

    @property
    def domain_corpus(self) -> DataFrame:
        """Documents with a domain 0-4 (sources in groups of four) and a store."""
        domain = (F.substring("source", 4, 10).cast("int") / 4).cast("int")
        store = F.when(uniform(F.lit("toxicity:"), F.col("doc_id")) >= 0.5, "toxic").otherwise("nontoxic")
        return self("documents").select("doc_id", "text", F.concat(F.lit("d"), domain.cast("string")).alias("domain"), store.alias("store"))

    # -- vectors

    @property
    def keys(self) -> DataFrame:
        vec = F.col("vec_id")
        return self("embeddings").select(
            F.when(uniform(F.lit("store:"), vec) < 0.3, "toxic").otherwise("nontoxic").alias("store"),
            F.floor(uniform(F.lit("stage:"), vec) * 4.99999).cast("int").alias("stage"),
            vec.alias("entry_id"),
            F.col("embedding").alias("key"),
            F.col("label").alias("token"),
        )

    @property
    def queries(self) -> DataFrame:
        return self("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")

    def model_logits(self, tag: str) -> DataFrame:
        """Logits over the ten tokens for every query, in batches of 100 queries."""
        rows = self("embeddings").select(
            F.col("vec_id").alias("query_id"),
            whole_div(F.col("vec_id"), 100).alias("batch_id"),
            F.explode(F.sequence(F.lit(0), F.lit(VOCABULARY - 1))).alias("token"),
        )
        draw = uniform(F.lit(f"{tag}:"), F.col("query_id"), F.lit(":"), F.col("token"))
        return rows.withColumn("logp", F.lit(4.0) * draw)

    @property
    def wide_logits(self) -> DataFrame:
        """Logits over 50,000 tokens for every prompt, most of them small."""
        idx = self("documents").select(whole_div(F.col("doc_id"), PER_PROMPT).alias("query_id")).distinct()
        # A table of ids looks small and would be read by one task: deal it out for what it grows to.
        parts = max(self.spark.sparkContext.defaultParallelism, -(-idx.count() // WIDE_PROMPTS))
        rows = idx.repartition(parts, "query_id").select(
            "query_id", F.explode(F.sequence(F.lit(0), F.lit(WIDE_VOCABULARY - 1))).alias("token")
        )
        token = F.col("token").cast("bigint")
        draw = (F.col("query_id") * 7919 + token * 104729 + (token * token) % 65537) % 65536
        return rows.withColumn("logp", F.lit(14.0) * F.pow(draw / F.lit(65535.0), F.lit(4.0)))

    @property
    def vector_prompts(self) -> DataFrame:
        """A prompt for every vector."""
        ident = F.col("vec_id")
        record = F.struct(F.lit("").alias("text"), uniform(F.lit("prompt:"), ident).alias("toxicity"))
        domain = F.concat(F.lit("d"), (ident % 5).cast("string"))
        return self("embeddings").select(ident.alias("prompt_idx"), record.alias("prompt"), domain.alias("domain"))


# -- the same in SQL

part(
    "prompts",
    f"""
SELECT r.prompt_idx, b.text, CASE WHEN r.prompt_idx % 13 = 12 THEN NULL ELSE {u("'prompt:'||r.prompt_idx")} END AS toxicity,
       CAST(r.prompt_idx % 5 + 1 AS VARCHAR) AS domain
FROM (SELECT DISTINCT doc_id // {PER_PROMPT} AS prompt_idx FROM documents) r
JOIN benchmark b ON b.item_id = r.prompt_idx % (SELECT count(*) FROM benchmark)""",
)
part(
    "generations",
    f"""
SELECT 'generation-'||doc_id AS request_id, doc_id // {PER_PROMPT} AS prompt_idx, doc_id % {PER_PROMPT} AS pos, text, doc_id
FROM documents""",
)
_failed = "CAST('0x'||substr(md5('null:'||doc_id),1,6) AS BIGINT) % 50 = 0"
part(
    "scores",
    "SELECT doc_id, n_chars, 'generation-'||doc_id AS request_id,\n"
    + ",\n".join(f"CASE WHEN {_failed} THEN NULL ELSE pow({u(f"'{a}:'||doc_id")}, 16) END AS {a}" for a in ATTRIBUTES)
    + f",\nCASE WHEN {_failed} THEN 'HttpError' END AS error\nFROM documents",
)
part("scored_corpus", f"SELECT doc_id, text, {u("'toxicity:'||doc_id")} AS toxicity FROM documents")
part(
    "labelled_prompts",
    f"""
SELECT conv_id, turn, replace(text, chr(10), '\\n- ') AS prompt, '-- '||role||' '||text||' \\n-' AS generation,
       {u("'pl:'||conv_id||':'||turn")} AS prompt_label
FROM conversations""",
)
part(
    "flags",
    "SELECT doc_id AS id, text AS comment_text,\n"
    "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'val' ELSE 'test' END AS split,\n"
    f"{u("'toxicity:'||doc_id")} AS toxicity,\n"
    + ",\n".join(f"CAST(pow({u(f"'{d}:'||doc_id")}, 8) >= 0.5 AS INTEGER) AS {d}" for d in DOMAINS)
    + "\nFROM documents",
)
part("annotated", f"SELECT *, {' + '.join(DOMAINS)} AS n_active FROM flags")
part(
    "domain_corpus",
    f"""
SELECT doc_id, text, 'd'||(CAST(substr(source, 4) AS INTEGER) // 4) AS domain,
       CASE WHEN {u("'toxicity:'||doc_id")} >= 0.5 THEN 'toxic' ELSE 'nontoxic' END AS store
FROM documents""",
)
part(
    "store_keys",
    f"""
SELECT CASE WHEN {u("'store:'||vec_id")} < 0.3 THEN 'toxic' ELSE 'nontoxic' END AS store,
       CAST(floor({u("'stage:'||vec_id")} * 4.99999) AS INTEGER) AS stage,
       vec_id AS entry_id, CAST(embedding AS DOUBLE[]) AS key, label AS token
FROM embeddings""",
)
part("queries", "SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings")


def _logits(tag: str) -> str:
    return f"""
SELECT vec_id AS query_id, vec_id // 100 AS batch_id, CAST(token AS INTEGER) AS token, 4 * {u(f"'{tag}:'||vec_id||':'||token")} AS logit
FROM (SELECT vec_id, unnest(range({VOCABULARY})) AS token FROM embeddings)"""


for _name, _tag in (("lm_logits", "lm"), ("expert_logits", "exp"), ("anti_logits", "anti")):
    part(_name, _logits(_tag))

part(
    "wide_logits",
    f"""
SELECT query_id, CAST(token AS INTEGER) AS token, 14 * pow(h / 65535.0::DOUBLE, 4) AS logit FROM (
  SELECT query_id, token, (query_id * 7919 + token * 104729 + (token * token) % 65537) % 65536 AS h
  FROM (SELECT DISTINCT doc_id // {PER_PROMPT} AS query_id FROM documents), (SELECT unnest(range({WIDE_VOCABULARY})) AS token))""",
)
part(
    "vector_prompts",
    f"SELECT vec_id AS prompt_idx, {u("'prompt:'||vec_id")} AS prompt_toxicity, 'd'||(vec_id % 5) AS domain FROM embeddings",
)
