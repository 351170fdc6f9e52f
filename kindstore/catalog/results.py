"""Sweeps and analysis of result tables computed from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindstore.catalog.evaluation import METRICS
from kindstore.catalog.registry import part, query, r6, rounded
from kindstore.operators import results
from kindstore.plans.evaluation import evaluate_toxicity

# Every (language, source) pair plays a model; the base of a language is its first source.
part(
    "model_results",
    """
SELECT lang || ':' || source AS model, lang || ':src0' AS base, avg(n_chars) AS mean_chars, CAST(max(n_chars) AS DOUBLE) AS max_chars
FROM documents GROUP BY lang, source""",
)
MODEL_METRICS = ("mean_chars", "max_chars")


def model_results(t):
    return (
        t("documents")
        .groupBy("lang", "source")
        .agg(F.avg("n_chars").alias("mean_chars"), F.max("n_chars").cast("double").alias("max_chars"))
        .select(
            F.concat_ws(":", "lang", "source").alias("model"),
            F.concat(F.col("lang"), F.lit(":src0")).alias("base"),
            *MODEL_METRICS,
        )
    )


@query(
    "relative_to_base",
    "SELECT m.model, m.base, "
    + ", ".join(r6(f"(m.{c} - b.{c}) / b.{c}", c) for c in MODEL_METRICS)
    + ", CASE WHEN m.model = m.base THEN 'base' ELSE 'mitigated' END AS kind FROM model_results m LEFT JOIN model_results b ON b.model = m.base AND b.base = b.model",
)
def relative_to_base(t):
    return rounded(results.relative_to_base(model_results(t), MODEL_METRICS))


part(
    "long_metrics",
    f"""
SELECT mode, domain, CASE metric WHEN 'avg_max' THEN 'Expected Maximum Toxicity' WHEN 'toxicity_probability' THEN 'Toxicity Probability' END AS metric, value
FROM (SELECT mode, domain, unnest(['avg_max', 'toxicity_probability']) AS metric, unnest([avg_max, toxicity_probability]) AS value FROM (
  SELECT mode, domain, {METRICS} FROM by_mode GROUP BY mode, domain))""",
)


def long_metrics(t):
    wide = rounded(evaluate_toxicity(t.generations, t.scores, t.prompts, "domain"))
    return results.unpivot_metrics(wide, ["mode", "domain"], rename=results.METRIC_NAMES)


@query("unpivot_metrics", "SELECT mode, domain, metric, value FROM long_metrics")
def unpivot_metrics(t):
    return long_metrics(t)


@query("sort_results", "SELECT mode, domain, metric, round(value, 2) AS value FROM long_metrics WHERE mode = 'toxic'")
def sort_results(t):
    return results.sort_results(long_metrics(t).where("mode = 'toxic'"))


@query(
    "pivot_mean",
    f"""
SELECT mode, metric, {", ".join(r6(f"avg(value) FILTER (domain = '{d}')", f'"{d}"') for d in (1, 2, 3, 4))} FROM long_metrics GROUP BY mode, metric""",
)
def pivot_mean(t):
    domains = [str(d) for d in range(1, 6)]
    return rounded(results.pivot_mean(long_metrics(t), ["mode", "metric"], "domain", "value", domains, drop=["5"]))


part(
    "size_sweep",
    """
SELECT toxic_size, nontoxic_size, avg(n_chars) AS value FROM (
  SELECT CAST(quality * 500 + 500 AS INTEGER) AS toxic_size, CAST(toxic * 500 + 500 AS INTEGER) AS nontoxic_size, n_chars FROM documents JOIN labels USING (doc_id))
GROUP BY ALL""",
)


@query(
    "vary_one_axis",
    f"""
SELECT 'vary_toxic_size' AS slice, toxic_size, nontoxic_size, {r6("value", "value")} FROM size_sweep WHERE nontoxic_size = 1000
UNION ALL SELECT 'vary_nontoxic_size', toxic_size, nontoxic_size, {r6("value", "value")} FROM size_sweep WHERE toxic_size = 1000
UNION ALL SELECT 'vary_both', toxic_size, nontoxic_size, {r6("value", "value")} FROM size_sweep WHERE toxic_size = nontoxic_size""",
)
def vary_one_axis(t):
    sweep = (
        t("documents")
        .join(t("labels"), "doc_id")
        .groupBy(
            (F.col("quality") * 500 + 500).alias("toxic_size"), (F.col("toxic") * 500 + 500).alias("nontoxic_size")
        )
        .agg(F.avg("n_chars").alias("value"))
    )
    return rounded(results.vary_one_axis(sweep, "toxic_size", "nontoxic_size", {"toxic_size": 1000, "nontoxic_size": 1000}))


@query(
    "timing_stats",
    f"""
SELECT event_type, count(value) AS n, {r6("avg(value)", "mean")}, {r6("stddev_pop(value)", "std")}, round(sum(value), 4) AS total
FROM events e JOIN (SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type) f USING (event_type)
WHERE e.event_id > f.first GROUP BY event_type""",
)
def timing_stats(t):
    done = results.timing_stats(t("events"), "event_type", "value", "event_id")
    return rounded(done.withColumn("total", F.round("total", 4)))
