"""Properties of the ensembles on a three-token vocabulary."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindstore.operators import mixing
from kindstore.operators.results import sweep_grid
from kindstore.operators.vectors import two_store_retrieve
from kindstore.plans import continual, retrieval
from kindstore.session import materialize, work_folder
from kindstore.sources.datastore import read_datastore


@pytest.fixture(scope="module")
def dists(spark):
    def dist(*p):
        rows = [(0, i, math.log(x)) for i, x in enumerate(p) if x > 0]
        return spark.createDataFrame(rows, "query_id bigint, token int, logp double")

    return {"lm": dist(0.33, 0.33, 0.33), "toxic": dist(0.0, 0.55, 0.45), "nontoxic": dist(0.55, 0.0, 0.45)}


def probs(df):
    return {r["token"]: math.exp(r["logp"]) for r in df.collect()}


def test_interpolate(dists):
    same = probs(mixing.interpolate(dists["lm"], dists["lm"]))
    assert same == pytest.approx({0: 0.33, 1: 0.33, 2: 0.33})
    p = probs(mixing.interpolate(dists["lm"], dists["toxic"]))
    assert p[1] > p[2] > p[0] and sum(p.values()) == pytest.approx(1, abs=0.02)


def test_interpolate_discourage(dists):
    same = probs(mixing.interpolate_discourage(dists["lm"], dists["lm"]))
    assert same == pytest.approx({0: 0.33, 1: 0.33, 2: 0.33})
    p = probs(mixing.interpolate_discourage(dists["lm"], dists["toxic"]))
    assert p[1] < p[2] < p[0]


def test_ensemble(dists):
    lm, toxic, nontoxic = dists["lm"], dists["toxic"], dists["nontoxic"]
    same = probs(mixing.ensemble(lm, lm, lm))
    assert same == pytest.approx({0: 1 / 3, 1: 1 / 3, 2: 1 / 3})
    against = probs(mixing.ensemble(lm, toxic, lm))
    single = probs(mixing.ensemble_single(lm, toxic))
    assert against == pytest.approx(single)
    towards = probs(mixing.ensemble(lm, lm, nontoxic))
    assert towards == pytest.approx(probs(mixing.ensemble_single(lm, nontoxic, order=("add", "subtract"))))
    both = probs(mixing.ensemble(lm, toxic, nontoxic))
    for p in (against, towards, both):
        assert sum(p.values()) == pytest.approx(1)
        assert p[1] < 1 / 3
    assert towards[0] > 1 / 3 and both[0] > both[2] > both[1]


def test_single_revives_cut_tokens(dists):
    marked = mixing.nucleus_filter(dists["lm"], 0.3, mark=True)
    assert sum(r["logp"] is None for r in marked.collect()) == 2  # only the first token is kept
    assert len(probs(mixing.ensemble_single(marked, dists["toxic"]))) == 3
    with pytest.raises(ValueError):
        mixing.ensemble_single(marked, dists["toxic"], order=("add", "add"))


def test_nucleus_keeps_the_crossing_token(spark):
    rows = [(0, i, math.log(p)) for i, p in enumerate((0.5, 0.3, 0.15, 0.05))]
    df = spark.createDataFrame(rows, "query_id bigint, token int, logp double")
    assert {r["token"] for r in mixing.nucleus_filter(df, 0.7).collect()} == {0, 1}
    assert {r["token"] for r in mixing.nucleus_filter(df, 0.01).collect()} == {0}
    assert mixing.nucleus_filter(df, 0).count() == 4


def test_patch_floor(spark):
    rows = [(0, 0, 1, -1.0), (0, 0, 2, -60.0), (0, 1, 1, -3.0), (1, 2, 1, -2.0), (1, 2, 2, -50.0)]
    df = spark.createDataFrame(rows, "batch_id bigint, query_id bigint, token int, logp double")
    got = {(r["query_id"], r["token"]): r["logp"] for r in mixing.patch_floor(df).collect()}
    assert got == {(0, 1): -1.0, (0, 2): -3.0, (1, 1): -3.0, (2, 1): -2.0, (2, 2): -2.0}
    own = {(r["query_id"], r["token"]): r["logp"] for r in mixing.patch_floor(df, scope="query").collect()}
    assert own[0, 2] == -1.0


def test_experts_fall_back_to_the_model(dists):
    p = probs(mixing.ensemble_experts(dists["lm"]))
    assert p == pytest.approx({0: 1 / 3, 1: 1 / 3, 2: 1 / 3})


def test_knn_distribution_sums_tokens(spark):
    rows = [(0, "s", 1, 10, 0.0, 7), (0, "s", 2, 11, 0.0, 7), (0, "s", 3, 12, 0.0, 8)]
    df = spark.createDataFrame(rows, "query_id bigint, store string, rank int, entry_id bigint, dist double, token int")
    assert probs(mixing.knn_distribution(df, 1.0)) == pytest.approx({7: 2 / 3, 8: 1 / 3})


def test_draws_fall_where_the_intervals_say(spark):
    """Against each draw looked up on its own; equal probabilities, a single token, and one draw a query."""
    rng = random.Random(4)
    rows = [(q, t, math.log(rng.choice([1, 1, 2, 8, 1e-9]))) for q in range(30) for t in range(rng.randint(1, 40))]
    df = mixing.log_softmax(spark.createDataFrame(rows, "query_id bigint, token int, logp double"))
    for p, n in ((0.9, 25), (0, 1)):
        kept = {}
        for r in mixing.log_softmax(mixing.nucleus_filter(df, p)).collect():
            kept.setdefault(r["query_id"], []).append((-r["logp"], r["token"]))
        want = set()
        for q, tokens in kept.items():
            tokens.sort()
            ends = np.cumsum([math.exp(-x) for x, _ in tokens])
            for draw in range(1, n + 1):
                at = int(hashlib.md5(f"42:{q}:{draw}".encode()).hexdigest()[:6], 16) / 16777216.0
                place = min(int(np.searchsorted(ends, at, side="right")), len(tokens) - 1)
                want.add((q, draw, tokens[place][1]))
        assert {tuple(r) for r in mixing.sample_tokens(df, n, p).collect()} == want


def test_sweep_equals_one_ensemble_each(spark):
    rng = random.Random(9)
    near = [(q, s, r, q * 100 + r, float(r) * rng.random(), rng.randrange(6)) for q in range(5) for s in ("toxic", "nontoxic") for r in range(1, 9)]
    near = spark.createDataFrame(near, "query_id bigint, store string, rank int, entry_id bigint, dist double, token int")
    lm = spark.createDataFrame([(q, t, -rng.random()) for q in range(5) for t in range(6)], "query_id bigint, token int, logp double")
    settings = [(2, 4, 1.0, 0.5), (2, 4, 2.0, 0.5), (8, 4, 1.0, 0.5), (2, 3, 1.0, 0.5), (2, 4, 1.0, 9.0)]
    got = {}
    for r in sweep_grid(near, lm, settings).collect():
        got.setdefault((r["k"], r["other_k"], r["alpha"], r["temperature"]), {})[r["query_id"], r["token"]] = r["logp"]
    assert got.keys() == set(settings)
    for k, other, alpha, heat in settings:
        dist = mixing.knn_distribution(near.where(f"rank <= CASE store WHEN 'toxic' THEN {k} ELSE {other} END"), heat)
        one = mixing.ensemble(lm, dist.where("store = 'toxic'"), dist.where("store = 'nontoxic'"), alpha)
        assert got[k, other, alpha, heat] == pytest.approx({(r["query_id"], r["token"]): r["logp"] for r in one.collect()})


def test_continual_run_goes_on_without_old_keys(spark, monkeypatch):
    """A second stage searches its own keys only, and a finished run searches and appends nothing again."""
    rng = np.random.default_rng(3)
    keys = [("toxic" if i % 2 else "nontoxic", i // 40, i, [float(x) for x in rng.normal(size=4)], i % 6) for i in range(120)]
    keys = materialize(spark.createDataFrame(keys, "store string, stage int, vec_id bigint, key array<float>, token int"), "keys")
    queries = spark.createDataFrame([(q, [float(x) for x in rng.normal(size=4)]) for q in range(8)], "query_id bigint, embedding array<double>")
    lm = spark.createDataFrame([(q, t, float(rng.random())) for q in range(8) for t in range(6)], "query_id bigint, token int, logp double")
    prompts = spark.createDataFrame([(q, ("", q / 7), "d") for q in range(8)], "prompt_idx bigint, prompt struct<text:string,toxicity:double>, domain string")
    arrivals = [keys.where(f"stage = {s}") for s in range(3)]
    scorer = lambda samples: samples.withColumn("toxicity", F.col("token") / 6.0)
    path = work_folder(spark, "continual")
    searched = []
    update = continual.update_neighbours
    monkeypatch.setattr(continual, "update_neighbours", lambda q, best, added, k: searched.append(added.count()) or update(q, best, added, k))
    run = lambda upto: continual.continual_run(queries, lm, prompts, arrivals[:upto], scorer, path, "vec_id", 5, 7, 1.0)
    assert {r["stage"] for r in run(2).collect()} == {0, 1}
    whole = sorted(map(str, run(3).collect()))
    assert searched == [40, 40, 40]
    assert sorted(map(str, run(3).collect())) == whole and searched == [40, 40, 40]
    near = spark.read.parquet(f"{path}/neighbours/2")
    stored = read_datastore(spark, f"{path}/datastore")
    every = two_store_retrieve(queries, stored, 5, 7)
    order = ["query_id", "store", "rank", "entry_id"]
    assert sorted(near.select(order).collect()) == sorted(every.select(order).collect())


def test_wide_logits_are_dealt_over_all_tasks(spark):
    from kindstore.catalog.fixtures import Tables

    wide = Tables(spark, "/root/testdata/sf0.001").wide_logits
    assert wide.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_mixtures_of_stages_rank_neighbours_once(spark):
    rng = np.random.default_rng(3)
    vecs = rng.integers(0, 3, (120, 2)).astype(float)  # many ties
    rows = [("toxic" if i % 3 else "nontoxic", i % 4, i, v.tolist(), int(i % 5)) for i, v in enumerate(vecs)]
    keys = spark.createDataFrame(rows, "store string, stage int, entry_id bigint, key array<double>, token int")
    queries = spark.createDataFrame([(i, [i * 0.3, 1.0]) for i in range(7)], "query_id bigint, embedding array<double>")
    lm = spark.createDataFrame([(i, i // 4, t, float(rng.normal())) for i in range(7) for t in range(5)], "query_id bigint, batch_id bigint, token int, logp double")
    staged = retrieval.continual_mixtures(queries, lm, keys, range(4), 3, 5, 1.0)
    # Lists are ranked before they are written; the ensemble, which reads them four times, sees distributions.
    assert "dist#" not in staged._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r["stage"], r["query_id"], r["token"]): r["logp"] for r in staged.collect()}
    for stage in range(4):
        alone = retrieval.retrieve_and_ensemble(queries, lm, keys.where(F.col("stage") <= stage), 3, 5, 1.0)
        want = {(stage, r["query_id"], r["token"]): r["logp"] for r in alone.collect()}
        assert {x: y for x, y in rows.items() if x[0] == stage} == pytest.approx(want)
