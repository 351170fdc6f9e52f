"""Round trips through files, and streams; all below the session's shared folder."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from kindstore.catalog.evaluation import METRICS
from kindstore.catalog.fixtures import STAGES
from kindstore.catalog.registry import part, query, r6, rounded
from kindstore.catalog.texts import single
from kindstore.operators.collate import collate
from kindstore.operators.plugins import score_texts
from kindstore.operators.results import unpivot_metrics
from kindstore.operators.texts import unpack_scores
from kindstore.plans.evaluation import evaluate_toxicity
from kindstore.schemas import ATTRIBUTES, DOMAINS
from kindstore.session import file_system, work_folder
from kindstore.sources import datastore, readers, results, writers
from kindstore.streaming.continual import continual_ingest, score_stream, stream_files


@query("read_prompts", f"SELECT prompt_idx, domain, text, {r6('toxicity', 'toxicity')} FROM prompts")
def read_prompts(t):
    path = work_folder(t.spark, "prompts")
    t.prompts.write.json(path)
    return rounded(readers.read_prompts(t.spark, path).select("prompt_idx", "domain", "text", "toxicity"))


@query(
    "read_generations",
    """
SELECT shape, prompt_idx, count(*) AS n, md5(string_agg(text, '|' ORDER BY pos)) AS digest
FROM generations, (SELECT unnest(['list', 'records']) AS shape) GROUP BY ALL
UNION ALL SELECT shape, doc_id, 1, md5(text) FROM generations, (SELECT unnest(['record', 'text']) AS shape)""",
)
def read_generations(t):
    lists, docs = t.generation_lists, t.documents
    record = F.struct("text")
    shapes = {
        "list": lists,
        "records": lists.withColumn("generations", F.transform("generations", lambda g: F.struct(g.alias("text")))),
        "record": docs.select(F.col("doc_id").alias("prompt_idx"), record.alias("generations")),
        "text": docs.select(F.col("doc_id").alias("prompt_idx"), F.col("text").alias("generations")),
    }
    out = None
    for shape, df in shapes.items():
        path = work_folder(t.spark, "generations")
        df.write.json(path)
        one = readers.read_generations(t.spark, path, shape).select(
            F.lit(shape).alias("shape"),
            "prompt_idx",
            F.size("generations").cast("bigint").alias("n"),
            F.md5(F.array_join("generations", "|")).alias("digest"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "read_scores",
    f"SELECT form, request_id, {', '.join(r6(a, a) for a in ATTRIBUTES)} FROM scores, (SELECT unnest(['nested', 'flat']) AS form)",
)
def read_scores(t):
    out = None
    for form, df in (("nested", t.scores), ("flat", t.scores.select("request_id", "response.attributeScores"))):
        path = work_folder(t.spark, "scores")
        df.write.json(path)
        one = unpack_scores(readers.read_scores(t.spark, path, form == "flat")).withColumn("form", F.lit(form))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(
    "read_corpus",
    """
SELECT form, digest, count(*) AS n FROM (
  SELECT form, md5(text) AS digest FROM documents, (SELECT unnest(['csv', 'json']) AS form)
  UNION ALL SELECT 'txt', md5(unnest(string_split(text, chr(10)))) FROM documents) GROUP BY ALL""",
)
def read_corpus(t):
    texts, out = t.documents.select("text"), None
    for form in readers.FORMATS:
        path = work_folder(t.spark, "corpus")
        if form == "csv":
            texts.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
        elif form == "json":
            texts.write.json(path)
        else:
            texts.write.text(path)
        one = readers.read_corpus(t.spark, path, form, keep_linebreaks=False)
        one = one.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n")).withColumn("form", F.lit(form))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "read_annotations",
    f"SELECT id, md5(comment_text) AS digest, split, {r6('toxicity', 'toxicity')}, {', '.join(DOMAINS)} FROM flags",
)
def read_annotations(t):
    path = work_folder(t.spark, "annotations")
    df = t.annotations.select(F.col("id").alias("_index"), *[c.name for c in readers.schemas.ANNOTATIONS])
    df.write.option("header", True).option("escape", '"').csv(path)
    back = readers.read_annotations(t.spark, path)
    flags = [F.when(F.col(d) >= 0.5, 1).otherwise(0).alias(d) for d in DOMAINS]
    return rounded(back.select("id", F.md5("comment_text").alias("digest"), "split", "toxicity", *flags))


@query(
    "write_collated",
    "SELECT p.prompt_idx, p.domain, count(*) AS n, md5(string_agg(g.text, '|' ORDER BY g.pos)) AS digest FROM generations g JOIN prompts p USING (prompt_idx) GROUP BY ALL",
)
def write_collated(t):
    path = work_folder(t.spark, "collated")
    writers.write_collated(collate(t.generations, t.scores, t.prompts), path)
    schema = "prompt_idx bigint, domain string, generations array<struct<text:string>>"
    g = F.transform("generations", lambda x: x["text"])
    return t.spark.read.schema(schema).json(path).select(
        "prompt_idx", "domain", F.size("generations").cast("bigint").alias("n"), F.md5(F.array_join(g, "|")).alias("digest")
    )


@query(
    "write_corpus",
    "SELECT CASE split WHEN 'test' THEN 'test' ELSE 'train' END AS split, CASE toxic WHEN 1 THEN 'toxic' ELSE 'nontoxic' END AS store, domain, count(*) AS n, md5(string_agg(comment_text, '|' ORDER BY md5(comment_text))) AS digest FROM single GROUP BY ALL",
)
def write_corpus(t):
    path = work_folder(t.spark, "corpora")
    rows = single(t).select(
        F.when(F.col("split") == "test", "test").otherwise("train").alias("split"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("nontoxic").alias("store"),
        "domain",
        F.col("comment_text").alias("text"),
    )
    writers.write_corpus(rows, path, ("split", "store", "domain"))
    back = t.spark.read.schema("text string, split string, store string, domain string").json(path)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.md5("text").alias("m"), "text"))), lambda x: x["text"])
    return back.groupBy("split", "store", "domain").agg(
        F.count("*").alias("n"), F.md5(F.array_join(ordered, "|")).alias("digest")
    )


part(
    "threshold_metrics",
    "\nUNION ALL\n".join(
        f"SELECT 'toxic={n}_nontoxic=None' AS run, '{n}' AS toxic, mode, {METRICS.replace('> 0.5', f'> {threshold}')} FROM worst_at_{n} GROUP BY mode"
        for n, threshold in ((1000, 0.5), (2000, 0.25))
    ),
)
for _n, _t in ((1000, 0.5), (2000, 0.25)):
    part(
        f"worst_at_{_n}",
        f"""
SELECT 'toxic' AS mode, * FROM worst WHERE prompt_toxicity > {_t}
UNION ALL SELECT 'nontoxic', * FROM worst WHERE prompt_toxicity <= {_t} UNION ALL SELECT 'full', * FROM worst WHERE prompt_toxicity <= 1.0""",
    )


@query(
    "scan_results",
    """
SELECT run, toxic, 'Expected Maximum Toxicity' AS metric, mode, avg_max AS value FROM threshold_metrics
UNION ALL SELECT run, toxic, 'Toxicity Probability', mode, toxicity_probability FROM threshold_metrics""",
)
def scan_results(t):
    root = work_folder(t.spark, "experiments")
    for n, threshold in ((1000, 0.5), (2000, 0.25)):
        table = rounded(evaluate_toxicity(t.generations, t.scores, t.prompts, None, threshold))
        long = unpivot_metrics(table, ["mode"], drop=())
        writers.write_metrics(long, f"{root}/toxic={n}_nontoxic=None/run_toxicity.csv")
    return results.scan_results(t.spark, root, "toxicity").select(
        "run", F.col("parameters")["toxic"].alias("toxic"), "metric", "mode", "value"
    )


part("grouped_metrics", f'SELECT mode, domain AS "group", {METRICS} FROM by_mode GROUP BY mode, domain')


@query(
    "scan_results_grouped",
    """
SELECT 'domain=0-news' AS run, 'big' AS model, rtp, metric, mode, "group", value FROM (
  SELECT 'Expected Maximum Toxicity' AS metric, mode, "group", avg_max AS value FROM grouped_metrics
  UNION ALL SELECT 'Toxicity Probability', mode, "group", toxicity_probability FROM grouped_metrics), (SELECT unnest([true, false]) AS rtp)""",
)
def scan_results_grouped(t):
    root = work_folder(t.spark, "experiments")
    table = rounded(evaluate_toxicity(t.generations, t.scores, t.prompts, "domain"))
    long = unpivot_metrics(table, ["mode", "domain"], drop=())
    for folder in ("model=big/domain=0-news", "model=big/domain=0-news/RTP"):
        writers.write_metrics(long, f"{root}/{folder}/run_toxicity_groupby.csv", "domain")
        writers.write_metrics(long, f"{root}/{folder}/run_toxicity.csv", wide=False)
    return results.scan_grouped_results(t.spark, root).select(
        "run", F.col("parameters")["model"].alias("model"), "rtp", "metric", "mode", "group", "value"
    )


part(
    "store_summary",
    """
SELECT store, stage, count(*) AS n, min(entry_id) AS first_entry, max(entry_id) AS last_entry, sum(token) AS tokens, round(sum(list_sum(key)), 3) AS total
FROM store_keys GROUP BY ALL""",
)


def _key_total():
    key = F.col("key").cast("array<double>")
    return F.round(F.sum(F.aggregate(key, F.lit(0.0), lambda a, x: a + x)), 3).alias("total")


def _summary(df):
    return df.groupBy("store", "stage").agg(
        F.count("*").alias("n"),
        F.min("entry_id").alias("first_entry"),
        F.max("entry_id").alias("last_entry"),
        F.sum("token").alias("tokens"),
        _key_total(),
    )


SUMMARY = "SELECT store, stage, n, first_entry, last_entry, CAST(tokens AS BIGINT) AS tokens, total + 0.0 AS total FROM store_summary"


@query("write_datastore", SUMMARY)
def write_datastore(t):
    path = work_folder(t.spark, "datastore")
    datastore.write_datastore(t.keys, path)
    return rounded(_summary(datastore.read_datastore(t.spark, path)), 3)


@query("datastore_size", "SELECT store, count(*) AS n FROM store_keys GROUP BY store UNION ALL SELECT 'other', NULL")
def datastore_size(t):
    path = work_folder(t.spark, "datastore")
    datastore.write_datastore(t.keys, path)
    known = datastore.datastore_size(t.spark, path)
    return known.unionByName(datastore.datastore_size(t.spark, path, "other"))


part(
    "renumbered",
    """
SELECT store, stage, token, key, row_number() OVER (PARTITION BY store ORDER BY stage, entry_id) - 1 AS entry_id FROM store_keys""",
)
RENUMBERED = SUMMARY.replace("FROM store_summary", "FROM renumbered_summary")
part(
    "renumbered_summary",
    """
SELECT store, stage, count(*) AS n, min(entry_id) AS first_entry, max(entry_id) AS last_entry, sum(token) AS tokens, round(sum(list_sum(key)), 3) AS total
FROM renumbered GROUP BY ALL""",
)


@query("append_datastore", RENUMBERED)
def append_datastore(t):
    """Stage after stage is added behind the entries already there."""
    path = work_folder(t.spark, "datastore")
    for stage in range(STAGES):
        for store in ("toxic", "nontoxic"):
            rows = t.keys.where((F.col("store") == store) & (F.col("stage") == stage))
            datastore.append_datastore(rows.withColumnRenamed("entry_id", "vec_id"), path, store, stage, stage, "vec_id")
    return rounded(_summary(datastore.read_datastore(t.spark, path)), 3)


part("store_sizes", "SELECT store, count(*) // 2 AS half FROM store_keys GROUP BY store")


@query(
    "read_first",
    """
SELECT store, stage, count(*) AS n, min(entry_id) AS first_entry, max(entry_id) AS last_entry, CAST(sum(token) AS BIGINT) AS tokens,
       round(sum(list_sum(key)), 3) + 0.0 AS total
FROM renumbered JOIN store_sizes USING (store) WHERE entry_id < half GROUP BY store, stage""",
)
def read_first(t):
    """The first half of each store, written in batches: later batches are not read."""
    path, out = work_folder(t.spark, "datastore"), None
    for stage in range(STAGES):
        for store in ("toxic", "nontoxic"):
            rows = t.keys.where((F.col("store") == store) & (F.col("stage") == stage))
            datastore.append_datastore(rows.withColumnRenamed("entry_id", "vec_id"), path, store, stage, stage, "vec_id")
    sizes = datastore.entry_ranges(t.spark, path).groupBy("store").agg(F.sum("n").alias("n"))
    for row in sizes.collect():
        one = datastore.read_first(t.spark, path, row["store"], row["n"] // 2)
        out = one if out is None else out.unionByName(one)
    return rounded(_summary(out), 3)


@query("continual_ingest", RENUMBERED)
def _continual_ingest(t):
    """The same through a file stream, one arriving stage per micro-batch."""
    arrivals, path, checkpoint = (work_folder(t.spark, n) for n in ("arrivals", "datastore", "checkpoint"))
    rows = t.keys.withColumnRenamed("entry_id", "vec_id")
    for stage in range(STAGES):
        rows.where(F.col("stage") == stage).coalesce(1).write.mode("append").json(arrivals)
    schema = "store string, stage int, vec_id bigint, key array<float>, token int"
    for _ in range(2):  # the second run finds nothing left to do
        continual_ingest(stream_files(t.spark, arrivals, schema), path, checkpoint).awaitTermination()
    return rounded(_summary(datastore.read_datastore(t.spark, path)), 3)


def digest_scorer(frame: pd.DataFrame) -> pd.DataFrame:
    """A stand-in scorer: a number from the md5 of the text."""

    def value(text: str) -> dict:
        number = int(hashlib.md5(text.encode()).hexdigest()[:6], 16) / 16777215.0
        return {"summaryScore": {"value": number, "type": "PROBABILITY"}, "spanScores": []}

    responses = [{"attributeScores": {"TOXICITY": value(text)}} for text in frame["text"]]
    return pd.DataFrame({"request_id": frame["request_id"], "response": responses, "error": None})


SCORED = f"SELECT request_id, {r6("CAST('0x'||substr(md5(text),1,6) AS BIGINT)/16777215.0", 'toxicity')} FROM generations"


@query("score_texts", SCORED)
def _score_texts(t):
    scored = score_texts(t.generations, digest_scorer, rate=500, partitions=8, interval=0.0)
    return rounded(unpack_scores(scored).select("request_id", "toxicity"))


# Texts of one micro-batch.
ARRIVAL_BYTES = 1 << 30


@query("score_stream", SCORED)
def _score_stream(t):
    arrivals, out, checkpoint = (work_folder(t.spark, n) for n in ("texts", "responses", "checkpoint"))
    texts = t.generations.select("request_id", "text")
    for _ in range(2):  # every text arrives twice and is scored once
        texts.write.mode("append").json(arrivals)
    # Four micro-batches at least, and as many more as keep each of them bounded.
    place, system = file_system(t.spark, arrivals)
    held = system.getContentSummary(place)
    files = max(1, held.getFileCount() * min(ARRIVAL_BYTES, held.getLength() // 4) // max(1, held.getLength()))
    stream = stream_files(t.spark, arrivals, "request_id string, text string", files)
    score_stream(stream, digest_scorer, out, checkpoint, rate=500, partitions=4, interval=0.0).awaitTermination()
    return rounded(unpack_scores(readers.read_scores(t.spark, out)).select("request_id", "toxicity"))
