"""Next-token distributions and their ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindstore.catalog.evaluation import METRICS
from kindstore.catalog.fixtures import STAGES
from kindstore.catalog.registry import part, query, r6, rounded, u
from kindstore.catalog.vectors import K, OTHER_K
from kindstore.functions.scalars import uniform, whole_div
from kindstore.operators import mixing
from kindstore.operators.results import grid, sweep_grid
from kindstore.plans.continual import continual_run
from kindstore.plans.retrieval import continual_mixtures, retrieve, retrieve_and_ensemble, retrieve_and_mix, sweep_sizes
from kindstore.session import work_folder

T, ALPHA, P = 0.5, 2.0, 0.9
OUT = f"query_id, token, {r6('logp', 'logp')}"


def softmax(source: str, score: str, by: str = "query_id", keep: str = "query_id, token") -> str:
    return f"SELECT {keep}, score - ln(sum(exp(score)) OVER (PARTITION BY {by})) AS logp FROM (SELECT *, {score} AS score FROM {source})"


part("lm_full", softmax("lm_logits", "logit", keep="query_id, batch_id, token"))
part("expert_full", softmax("expert_logits", "logit"))
part("anti_full", softmax("anti_logits", "logit"))
part(
    "lm_marked",
    f"""
SELECT *, coalesce(sum(exp(logp)) OVER (PARTITION BY query_id ORDER BY logp DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= {P} AS kept
FROM lm_full""",
)
part("lm", "SELECT query_id, batch_id, token, logp FROM lm_marked WHERE kept")


def distribution(source: str, temperature: float | str, by: str = "query_id, store") -> str:
    return f"""
SELECT {by}, token, ln(sum(w) / any_value(total)) AS logp FROM (
  SELECT *, sum(w) OVER (PARTITION BY {by}) AS total FROM (
    SELECT *, exp((min(dist) OVER (PARTITION BY {by}) - dist) / {temperature}) AS w FROM {source})) GROUP BY {by}, token HAVING sum(w) > 0"""


part("knn", distribution("near", T))
part("knn_cold", distribution("near", 0.01))


def lm_full(t):
    return mixing.log_softmax(t.model_logits("lm"))


def lm(t):
    return mixing.nucleus_filter(lm_full(t), P)


def knn(t, temperature=T):
    return mixing.knn_distribution(retrieve(t.queries, t.keys, K, OTHER_K), temperature)


@query("log_softmax", f"SELECT {OUT} FROM lm_full")
def log_softmax(t):
    return rounded(lm_full(t).select("query_id", "token", "logp"))


@query("nucleus_filter", f"SELECT {OUT} FROM lm")
def nucleus_filter(t):
    return rounded(lm(t).select("query_id", "token", "logp"))


@query("knn_distribution", f"SELECT store, {OUT} FROM knn")
def knn_distribution(t):
    return rounded(knn(t))


@query(
    "patch_floor",
    f"""
SELECT query_id, store, token, {r6("CASE WHEN logp <= -50 THEN low ELSE logp END", "logp")} FROM (
  SELECT *, min(logp) FILTER (logp > -50) OVER (PARTITION BY query_id // 100, store) AS low FROM knn_cold)""",
)
def patch_floor(t):
    cold = knn(t, 0.01).withColumn("batch_id", whole_div(F.col("query_id"), 100))
    return rounded(mixing.patch_floor(cold).select("query_id", "store", "token", "logp"))


part("toxic", "SELECT query_id, token, logp FROM knn WHERE store = 'toxic'")


part(
    "interpolated",
    f"""
SELECT query_id, token, {r6("ln(coalesce(0.75 * exp(a.logp), 0) + coalesce(0.25 * exp(b.logp), 0))", "logp")}
FROM lm a FULL JOIN toxic b USING (query_id, token)""",
)


@query("interpolate", "SELECT * FROM interpolated")
def interpolate(t):
    return rounded(mixing.interpolate(lm(t), knn(t).where("store = 'toxic'")))


part(
    "discouraged",
    f"""
SELECT query_id, token, {r6("ln(p)", "logp")} FROM (
  SELECT query_id, token, 1.25 * exp(a.logp) - 0.25 * coalesce(exp(b.logp), 0) AS p FROM lm a LEFT JOIN toxic b USING (query_id, token)) WHERE p > 0""",
)


@query("interpolate_discourage", "SELECT * FROM discouraged")
def interpolate_discourage(t):
    return rounded(mixing.interpolate_discourage(lm(t), knn(t).where("store = 'toxic'")))


def ensembled(base: str, dist: str, by: str = "query_id") -> str:
    """The two-store ensemble as SQL, over tables that may carry more keys."""
    extra = by.replace("query_id", "").strip(", ")
    batch = ", ".join(x for x in ("batch_id", extra) if x)
    return f"""
SELECT {by}, token, logp + {ALPHA} * (coalesce(added, fa.low) - coalesce(subtracted, fs.low)) AS score
FROM {base} l
LEFT JOIN (SELECT {by}, token, logp AS subtracted FROM {dist} WHERE store = 'toxic' AND logp > -50) s USING ({by}, token)
LEFT JOIN (SELECT {by}, token, logp AS added FROM {dist} WHERE store = 'nontoxic' AND logp > -50) a USING ({by}, token)
LEFT JOIN (SELECT {batch}, min(logp) AS low FROM (SELECT query_id // 100 AS batch_id, * FROM {dist}) WHERE store = 'toxic' AND logp > -50 GROUP BY ALL) fs USING ({batch})
LEFT JOIN (SELECT {batch}, min(logp) AS low FROM (SELECT query_id // 100 AS batch_id, * FROM {dist}) WHERE store = 'nontoxic' AND logp > -50 GROUP BY ALL) fa USING ({batch})"""


part("mixed_scores", ensembled("lm", "knn"))
part("mixed", softmax("mixed_scores", "score"))


@query("ensemble", f"SELECT {OUT} FROM mixed")
def ensemble(t):
    near = knn(t)
    return rounded(mixing.ensemble(lm(t), near.where("store = 'toxic'"), near.where("store = 'nontoxic'"), ALPHA))


@query("retrieve_and_ensemble", f"SELECT {OUT} FROM mixed")
def _retrieve_and_ensemble(t):
    return rounded(retrieve_and_ensemble(t.queries, t.model_logits("lm"), t.keys, K, OTHER_K, T, ALPHA, P))


part(
    "one_store",
    """
SELECT query_id, token, CASE WHEN kept AND l.logp > -50 THEN l.logp ELSE min(CASE WHEN kept AND l.logp > -50 THEN l.logp END) OVER (PARTITION BY batch_id) END AS base,
       coalesce(k.logp, f.low) AS other
FROM lm_marked l LEFT JOIN (SELECT * FROM toxic WHERE logp > -50) k USING (query_id, token)
LEFT JOIN (SELECT query_id // 100 AS batch_id, min(logp) AS low FROM toxic WHERE logp > -50 GROUP BY ALL) f USING (batch_id)""",
)
part(
    "single_mixed",
    softmax("one_store", f"base + {ALPHA} * (base - other)", keep="'subtract,add' AS ordering, query_id, token")
    + "\nUNION ALL\n"
    + softmax("one_store", f"base + {ALPHA} * (other - base)", keep="'add,subtract' AS ordering, query_id, token"),
)


@query("ensemble_single", f"SELECT ordering, {OUT} FROM single_mixed")
def ensemble_single(t):
    full, store = mixing.nucleus_filter(lm_full(t), P, mark=True), knn(t).where("store = 'toxic'")
    out = None
    for order in mixing.METHOD_ORDERS:
        one = mixing.ensemble_single(full, store, ALPHA, order).withColumn("ordering", F.lit(",".join(order)))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def _mixed_by(t, method, stores=("toxic",), order=("subtract", "add"), recompute=False):
    logits = t.model_logits("lm")
    return retrieve_and_mix(
        t.queries, logits, t.keys, method, K, OTHER_K, T, ALPHA, 0.25, P, stores, order, recompute
    ).select("query_id", "token", "logp")


@query("retrieve_interpolate", "SELECT * FROM interpolated")
def retrieve_interpolate(t):
    """One store end to end, its distances computed again from the vectors."""
    return rounded(_mixed_by(t, "interpolate", recompute=True))


@query("retrieve_discourage", "SELECT * FROM discouraged")
def retrieve_discourage(t):
    return rounded(_mixed_by(t, "interpolate_discourage"))


@query("retrieve_single", f"SELECT ordering, {OUT} FROM single_mixed")
def retrieve_single(t):
    """One store and the model itself, in both orders."""
    one, other = (
        _mixed_by(t, "ensemble", order=order).withColumn("ordering", F.lit(",".join(order))) for order in mixing.METHOD_ORDERS
    )
    return rounded(one.unionByName(other))


part(
    "expert_scores",
    f"SELECT query_id, token, l.logp + {ALPHA} * (e.logp - a.logp) AS score FROM lm l JOIN expert_full e USING (query_id, token) JOIN anti_full a USING (query_id, token)",
)
part("expert_mixed", softmax("expert_scores", "score"))


@query("ensemble_experts", f"SELECT {OUT} FROM expert_mixed")
def ensemble_experts(t):
    expert, anti = (mixing.log_softmax(t.model_logits(tag)) for tag in ("exp", "anti"))
    return rounded(mixing.ensemble_experts(lm(t), expert, anti, ALPHA))


def sampled(name: str, source: str, by: str = "query_id") -> str:
    """Parts for ``name``: draws of each query from the nucleus of ``source``; returns the SELECT of the draws."""
    part(
        f"{name}_kept",
        f"""
SELECT {by}, token, logp - ln(sum(exp(logp)) OVER (PARTITION BY {by})) AS logp FROM (
  SELECT *, coalesce(sum(exp(logp)) OVER (PARTITION BY {by} ORDER BY logp DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {source})
WHERE before <= {P}""",
    )
    part(
        f"{name}_intervals",
        f"""
SELECT {by}, token, sum(exp(logp)) OVER w AS high, sum(exp(logp)) OVER w - exp(logp) AS low,
       row_number() OVER (PARTITION BY {by} ORDER BY logp, token DESC) AS from_end
FROM {name}_kept WINDOW w AS (PARTITION BY {by} ORDER BY logp DESC, token ROWS UNBOUNDED PRECEDING)""",
    )
    part(
        f"{name}_draws",
        f"""
SELECT {by}, draw, CAST('0x'||substr(md5('42:'||query_id||':'||draw),1,6) AS BIGINT) / 16777216.0 AS x
FROM (SELECT DISTINCT {by} FROM {name}_kept), (SELECT CAST(unnest(range(1, 26)) AS INTEGER) AS draw)""",
    )
    return f"SELECT {by}, d.draw, i.token FROM {name}_intervals i JOIN {name}_draws d USING ({by}) WHERE d.x >= i.low AND (d.x < i.high OR i.from_end = 1)"


@query("sample_tokens", sampled("sampling", "mixed"))
def sample_tokens(t):
    mixed = retrieve_and_ensemble(t.queries, t.model_logits("lm"), t.keys, K, OTHER_K, T, ALPHA, P)
    return mixing.sample_tokens(mixed, 25, P)


part("wide_full", softmax("wide_logits", "logit"))


@query("sample_tokens_wide", sampled("wide", "wide_full"))
def sample_tokens_wide(t):
    """25 draws of each prompt from a distribution over 50,000 tokens."""
    return mixing.sample_tokens(mixing.log_softmax(t.wide_logits), 25, P)


# -- sweeps: one retrieval, many settings

SETTINGS = grid(k=[4, 8, 16], other_k=[8, 16, 32], alpha=(1.0, 2.0, 0.5), temperature=(T, 2.0))
part(
    "settings",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {a}, {b}, CAST({x} AS DOUBLE), CAST({h} AS DOUBLE))" for i, (a, b, x, h) in enumerate(SETTINGS))
    + ") v(s, k, other_k, alpha, temperature)",
)
part("swept_near", "SELECT s.s, s.temperature, n.* FROM near n JOIN settings s ON n.rank <= CASE n.store WHEN 'toxic' THEN s.k ELSE s.other_k END")
part("swept_knn", distribution("swept_near", "temperature", "s, query_id, store"))
part("swept_lm", "SELECT s, alpha, lm.* FROM lm CROSS JOIN settings")
part("swept_scores", ensembled("swept_lm", "swept_knn", "s, query_id").replace(f"+ {ALPHA} *", "+ alpha *"))
part("swept", softmax("swept_scores", "score", "s, query_id", "s, query_id, token"))


@query(
    "sweep_grid",
    f"SELECT CAST(k AS INTEGER) AS k, CAST(other_k AS INTEGER) AS other_k, alpha, temperature, {OUT} FROM swept JOIN settings USING (s)",
)
def _sweep_grid(t):
    near = retrieve(t.queries, t.keys, K, OTHER_K)
    return rounded(sweep_grid(near, lm(t), SETTINGS))


# -- store sizes: each part of a store searched once

SIZES = [(40, None), (120, 60), (None, 120), (None, None)]
part(
    "sizes",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {a or 'NULL'}, {b or 'NULL'})" for i, (a, b) in enumerate(SIZES))
    + ") v(i, size, other_size)",
)
part(
    "sized_near",
    f"""
SELECT * FROM (
  SELECT s.i, p.query_id, p.store, p.token, p.dist,
         row_number() OVER (PARTITION BY s.i, query_id, store ORDER BY dist, entry_id) AS rank
  FROM key_pairs p JOIN sizes s ON p.entry_id < coalesce(CASE p.store WHEN 'toxic' THEN s.size ELSE s.other_size END, 9223372036854775807))
WHERE rank <= CASE store WHEN 'toxic' THEN {K} ELSE {OTHER_K} END""",
)
part("sized_knn", distribution("sized_near", T, "i, query_id, store"))
part("sized_lm", "SELECT i, lm.* FROM lm CROSS JOIN sizes")
part("sized_scores", ensembled("sized_lm", "sized_knn", "i, query_id"))
part("sized_mixed", softmax("sized_scores", "score", "i, query_id", "i, query_id, token"))


@query(
    "sweep_sizes",
    f"SELECT CAST(size AS BIGINT) AS size, CAST(other_size AS BIGINT) AS other_size, {OUT} FROM sized_mixed JOIN sizes USING (i)",
)
def _sweep_sizes(t):
    return rounded(sweep_sizes(t.queries, t.model_logits("lm"), t.keys, SIZES, K, OTHER_K, T, ALPHA, P))


# -- the mixture after each continual stage

part(
    "staged_near",
    f"""
SELECT * FROM (
  SELECT s.stage AS at_stage, p.query_id, p.store, p.token, p.dist,
         row_number() OVER (PARTITION BY s.stage, query_id, store ORDER BY dist, entry_id) AS rank
  FROM key_pairs p JOIN (SELECT unnest(range({STAGES})) AS stage) s ON p.stage <= s.stage)
WHERE rank <= CASE store WHEN 'toxic' THEN {K} ELSE {OTHER_K} END""",
)
part("staged_knn", distribution("staged_near", T, "at_stage, query_id, store"))
part("staged_lm", f"SELECT at_stage, lm.* FROM lm CROSS JOIN (SELECT unnest(range({STAGES})) AS at_stage)")
part("staged_scores", ensembled("staged_lm", "staged_knn", "at_stage, query_id"))
part("staged_mixed", softmax("staged_scores", "score", "at_stage, query_id", "at_stage, query_id, token"))


@query("continual_mixtures", f"SELECT CAST(at_stage AS INTEGER) AS stage, {OUT} FROM staged_mixed")
def _continual_mixtures(t):
    return rounded(
        continual_mixtures(t.queries, t.model_logits("lm"), t.keys, range(STAGES), K, OTHER_K, T, ALPHA, P)
    )



# -- append, retrieve, mix, sample, score, metrics after each stage

_staged_draws = sampled("staged_sampling", "staged_mixed", "at_stage, query_id")
part(
    "run_worst",
    f"""
SELECT at_stage AS stage, query_id AS prompt_idx, prompt_toxicity, domain, max({u("'toxic:'||token")}) AS worst
FROM ({_staged_draws}) JOIN vector_prompts ON prompt_idx = query_id GROUP BY ALL""",
)
part(
    "run_modes",
    """
SELECT 'toxic' AS mode, * FROM run_worst WHERE prompt_toxicity > 0.5
UNION ALL SELECT 'nontoxic', * FROM run_worst WHERE prompt_toxicity <= 0.5
UNION ALL SELECT 'full', * FROM run_worst WHERE prompt_toxicity <= 1.0""",
)


def token_scores(samples):
    """A stand-in scorer: a number from the md5 of the token."""
    return samples.withColumn("toxicity", uniform(F.lit("toxic:"), F.col("token")))


@query(
    "continual_run",
    f"""
SELECT CAST(stage AS INTEGER) AS stage, mode, 'Overall' AS domain, {METRICS} FROM run_modes GROUP BY stage, mode
UNION ALL SELECT CAST(stage AS INTEGER), mode, domain, {METRICS} FROM run_modes GROUP BY stage, mode, domain""",
)
def _continual_run(t):
    """Stores that grow stage by stage; only a stage's own keys are searched."""
    keys = t.keys.select("store", "stage", F.col("entry_id").alias("vec_id"), "key", "token")
    arrivals = [keys.where(F.col("stage") == stage) for stage in range(STAGES)]
    path = work_folder(t.spark, "continual")
    return rounded(
        continual_run(
            t.queries, t.model_logits("lm"), t.vector_prompts, arrivals, token_scores, path, "vec_id",
            K, OTHER_K, T, ALPHA, P,
        )
    )
