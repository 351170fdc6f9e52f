"""Projections, flattening and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindstore.catalog.registry import part, query, r6, rounded, u
from kindstore.functions.scalars import uniform
from kindstore.operators import texts
from kindstore.operators.corpus import identity_filter
from kindstore.operators.results import flag_sums
from kindstore.schemas import ATTRIBUTES, DOMAINS



@query(
    "normalize_texts",
    """
SELECT 'record' AS shape, doc_id, 1 AS n, md5(text) AS digest FROM documents
UNION ALL SELECT 'records', doc_id, 2, md5(text || '|' || lang) FROM documents
UNION ALL SELECT 'list', doc_id, 2, md5(text || '|' || lang) FROM documents
UNION ALL SELECT 'text', doc_id, 1, md5(text) FROM documents""",
)
def normalize_texts(t):
    docs = t("documents")
    record = F.struct(F.col("text"))
    shapes = {
        "record": record,
        "records": F.array(record, F.struct(F.col("lang").alias("text"))),
        "list": F.array("text", "lang"),
        "text": F.col("text"),
    }
    out = None
    for shape, column in shapes.items():
        done = texts.normalize_texts(docs.select("doc_id", column.alias("generations"))).select(
            F.lit(shape).alias("shape"),
            "doc_id",
            F.size("generations").alias("n"),
            F.md5(F.array_join("generations", "|")).alias("digest"),
        )
        out = done if out is None else out.unionByName(done)
    return out


@query(
    "flatten_generations",
    "SELECT 'generation-' || (row_number() OVER (ORDER BY prompt_idx, pos) - 1) AS request_id, prompt_idx, pos, md5(text) AS digest FROM generations",
)
def flatten_generations(t):
    flat = texts.flatten_generations(t.generation_lists)
    return flat.withColumn("digest", F.md5("text")).drop("text")


@query(
    "rescore_prompts",
    f"""
SELECT prompt_idx, domain, text, {r6("toxicity", "original_toxicity")},
       {", ".join(r6(u(f"'{a}:p:'||prompt_idx"), a) for a in ATTRIBUTES)}
FROM prompts""",
)
def rescore_prompts(t):
    scores = t.prompts.select(
        "prompt_idx", *[uniform(F.lit(f"{a}:p:"), F.col("prompt_idx")).alias(a) for a in ATTRIBUTES]
    )
    done = texts.rescore_prompts(t.prompts, scores, carry=True)
    return rounded(done.select("prompt_idx", "domain", "original_toxicity", "prompt.*"))


@query("wrap_prompts", "SELECT doc_id, md5(text) AS digest, CAST(1.0 AS DOUBLE) AS toxicity FROM documents")
def wrap_prompts(t):
    done = texts.wrap_prompts(t.documents)
    return done.select("doc_id", F.md5("prompt.text").alias("digest"), F.col("prompt.toxicity").alias("toxicity"))


@query("binarize_flags", f"SELECT id, CAST(toxicity >= 0.5 AS INTEGER) AS toxicity, {', '.join(DOMAINS)} FROM flags")
def binarize_flags(t):
    return texts.binarize_flags(t.annotations, ["toxicity", *DOMAINS]).select("id", "toxicity", *DOMAINS)


part(
    "named",
    "SELECT *, list_filter([" + ", ".join(f"CASE WHEN {d} = 1 THEN '{d}' END" for d in DOMAINS)
    + "], lambda d: d IS NOT NULL) AS names FROM annotated",
)
part("single", "SELECT *, names[1] AS domain, CAST(toxicity >= 0.5 AS INTEGER) AS toxic FROM named WHERE n_active = 1")


def flagged(t):
    return texts.binarize_flags(t.annotations, DOMAINS)


def single(t):
    """Rows with exactly one identity, their domain and the toxic flag."""
    one = flagged(t).where((F.col("identity_any") == 1) & ~F.col("more_than_one_identity"))
    toxic = F.when(F.col("toxicity") >= 0.5, 1).otherwise(0)
    return texts.assign_domain(one, DOMAINS).withColumn("toxic", toxic)


@query("assign_domain", f"SELECT id, domain, toxic, {r6('toxicity', 'toxicity')} FROM single")
def assign_domain(t):
    return rounded(single(t).select("id", "domain", "toxic", "toxicity"))


@query("assign_domains_multi", "SELECT id, array_to_string(names, ', ') AS domain FROM named WHERE n_active > 0")
def assign_domains_multi(t):
    return texts.assign_domains_multi(flagged(t).where("identity_any = 1"), DOMAINS).select("id", "domain")


SPLITS = {"train": "train", "val": "train", "test": "test"}


@query("remap_values", "SELECT id, CASE split WHEN 'test' THEN 'test' ELSE 'train' END AS split FROM flags")
def remap_values(t):
    return texts.remap_values(t.annotations, "split", SPLITS).select("id", "split")


@query(
    "clean_numbers",
    """
SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 9378564.0 ELSE CAST(event_id * 1000 AS DOUBLE) END AS amount
FROM events""",
)
def clean_numbers(t):
    amount = (
        F.when(F.col("event_type") == "error", "-")
        .when(F.col("event_type") == "signup", "None")
        .otherwise(F.format_number(F.col("event_id") * 1000, 0))
    )
    return texts.clean_numbers(t("events").select("event_id", amount.alias("amount")), ["amount"], none_as=9378564)


@query(
    "row_totals",
    f"""
SELECT event_id, {r6("(value + user_id) / 3600", "both_hours")}, {r6("(CASE event_type WHEN 'error' THEN 0 ELSE value END) / 3600", "some_hours")}
FROM events""",
)
def row_totals(t):
    known = F.when(F.col("event_type") != "error", F.col("value"))
    groups = {"both_hours": ["value", "user_id"], "some_hours": ["known"]}
    done = texts.row_totals(t("events").withColumn("known", known), groups)
    return rounded(done.select("event_id", "both_hours", "some_hours"))


@query(
    "clean_texts",
    r"""
SELECT conv_id, turn, regexp_replace(trim(replace(generation, '\n', ''), '-'),
  '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') AS text
FROM labelled_prompts""",
)
def clean_texts(t):
    return texts.clean_texts(t.labelled_prompts, "generation").select("conv_id", "turn", F.col("generation").alias("text"))


@query("extract_domains", "SELECT DISTINCT CAST(substr(source, 4) AS INTEGER) % 10 || 'of10_' || lang AS domain FROM documents")
def extract_domains(t):
    number = (F.substring("source", 4, 10).cast("int") % 10).cast("string")
    path = F.concat(F.lit("/corpora/identity_"), number, F.lit("of10_"), F.col("lang"), F.lit("_toxic.json"))
    return texts.extract_domains(t("documents").select(path.alias("path")))


@query(
    "identity_filter",
    """
SELECT split, count(*) FILTER (n_active > 1) AS n_multiple, count(*) FILTER (n_active > 0) AS n_any,
       count(*) FILTER (n_active = 1) AS n_single, count(*) FILTER (n_active = 0) AS n_none
FROM annotated GROUP BY split""",
)
def _identity_filter(t):
    return identity_filter(t.annotations)


@query(
    "flag_sums",
    "SELECT split, CAST(toxicity >= 0.5 AS INTEGER) AS toxic, "
    + ", ".join(f"CAST(sum({d}) AS BIGINT) AS {d}" for d in DOMAINS)
    + " FROM flags GROUP BY ALL",
)
def _flag_sums(t):
    toxic = F.when(F.col("toxicity") >= 0.5, 1).otherwise(0)
    return flag_sums(flagged(t).withColumn("toxic", toxic), ["split", "toxic"], DOMAINS)


