"""Hand-worked rows for metrics and collating."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kindstore.operators import metrics
from kindstore.operators.collate import collate, collate_flat
from kindstore.operators.plugins import score_texts
from kindstore.operators.texts import normalize_texts, unpack_scores
from kindstore.schemas import ATTRIBUTES, SCORES


def prompts_of(spark, rows):
    return spark.createDataFrame(
        [(i, {"text": f"p{i}", "toxicity": x}, g) for i, x, g in rows],
        "prompt_idx bigint, prompt struct<text:string,toxicity:double>, domain string",
    )


def response(value, kind="PROBABILITY"):
    score = {"value": value, "type": kind}
    return {"attributeScores": {"TOXICITY": {"summaryScore": score, "spanScores": []}}}


def test_toxicity_metrics(spark):
    prompts = prompts_of(spark, [(0, 0.9, "a"), (1, 0.5, "a"), (2, None, "b"), (3, 0.1, "b"), (4, 0.2, "b")])
    scored = spark.createDataFrame(
        [(0, 0.2), (0, 0.8), (1, 0.5), (1, None), (2, 0.9), (3, None), (4, 0.7), (4, float("nan"))],
        "prompt_idx bigint, toxicity double",
    )
    rows = {r["mode"]: r for r in metrics.toxicity_metrics(scored, prompts).collect()}
    assert set(rows) == {"toxic", "nontoxic", "full"}
    assert (rows["toxic"]["avg_max"], rows["toxic"]["toxicity_probability"]) == (0.8, 1.0)
    assert rows["toxic"]["std_max"] is None  # one prompt
    # 0.5 is not above the threshold; prompt 3 has no score left; prompt 2 has no toxicity.
    assert rows["nontoxic"]["avg_max"] == pytest.approx(0.6)
    assert rows["nontoxic"]["toxicity_probability"] == 0.5
    assert rows["nontoxic"]["std_max"] == pytest.approx(math.sqrt(0.02))
    assert rows["full"]["avg_max"] == pytest.approx(2.0 / 3)
    by_group = {(r["mode"], r["domain"]): r for r in metrics.toxicity_by_group(scored, prompts).collect()}
    assert set(by_group) == {("toxic", "a"), ("nontoxic", "a"), ("full", "a"), ("nontoxic", "b"), ("full", "b")}
    assert by_group["nontoxic", "b"]["avg_max"] == 0.7
    assert metrics.toxicity_by_group(scored, prompts.drop("domain")).count() == 0


def test_empty_mode_is_null(spark):
    prompts = prompts_of(spark, [(0, 0.1, "a")])
    scored = spark.createDataFrame([(0, 0.2)], "prompt_idx bigint, toxicity double")
    rows = {r["mode"]: r for r in metrics.toxicity_metrics(scored, prompts).collect()}
    assert rows["toxic"]["avg_max"] is None and rows["toxic"]["toxicity_probability"] is None


def test_distinctness_edges(spark):
    texts = [(0, ""), (0, " "), (1, "a  b"), (2, "word"), (3, "a_b c"), (3, "a b_c")]
    df = spark.createDataFrame(texts, "prompt_idx bigint, text string")
    got = {r["prompt_idx"]: r for r in metrics.distinctness_by_prompt(df).collect()}
    # '' is one empty word, ' ' two of them.
    assert (got[0]["dist1"], got[0]["dist2"], got[0]["dist3"]) == (1 / 3, 1 / 3, 0.0)
    assert (got[1]["dist1"], got[1]["dist2"], got[1]["dist3"]) == (1.0, 2 / 3, 1 / 3)
    assert (got[2]["dist1"], got[2]["dist2"], got[2]["dist3"]) == (1.0, 0.0, 0.0)
    assert got[3]["dist2"] == 1 / 4  # both bigrams read a_b_c


def test_perplexity(spark):
    rows = [(0, None, "prompt", None), (0, None, "prompt", -1.0)]
    rows += [(0, 1, "full", x) for x in (None, -1.0, -2.0, -4.0)] + [(0, 2, "full", x) for x in (None, -1.0, -60.0)]
    df = spark.createDataFrame(rows, "prompt_idx bigint, gen_id bigint, part string, logp double")
    each = {r["gen_id"]: r["perplexity"] for r in metrics.generation_perplexity(df).collect()}
    assert each[1] == pytest.approx(math.exp(3.0)) and each[2] > 1e4
    assert metrics.conditional_perplexity(df).first()[0] == pytest.approx(math.exp(3.0))
    huge = spark.createDataFrame([(-1000.0,)], "logp double")
    assert metrics.corpus_perplexity(huge).first()[0] == math.inf


def test_perplexity_modes_skip_equal_sizes(spark):
    prompts = prompts_of(spark, [(0, 0.9, "a"), (1, 0.1, "a")])
    rows = [(i, None, "prompt", None) for i in (0, 1)]
    rows += [(i, 0, "full", x) for i in (0, 1) for x in (None, -1.0)]
    df = spark.createDataFrame(rows, "prompt_idx bigint, gen_id bigint, part string, logp double")
    modes = {r["mode"] for r in metrics.perplexity_by_mode(df, prompts).collect()}
    assert modes == {"toxic", "full"}  # nontoxic has as many prompts as toxic


def test_collate(spark):
    prompts = prompts_of(spark, [(0, 0.9, "a"), (1, 0.5, "b"), (2, 0.5, "c")])
    generations = spark.createDataFrame(
        [(f"generation-{i}", i // 5, i % 5, f"t{i}") for i in range(10)],
        "request_id string, prompt_idx bigint, pos bigint, text string",
    )
    answers = [(f"generation-{i}", response(i / 10), None) for i in range(7)]
    answers += [("generation-3", None, "repeated"), ("generation-8", None, "HttpError")]
    scores = spark.createDataFrame(answers, SCORES)
    flat = {r["request_id"]: r["toxicity"] for r in collate_flat(generations, scores).collect()}
    assert len(flat) == 10 and flat["generation-3"] == 0.3 and flat["generation-8"] is None
    done = collate(generations, scores, prompts.withColumn("generations", F.lit("old"))).orderBy("prompt_idx").collect()
    assert [r["prompt_idx"] for r in done] == [0, 1]  # no generations, no row
    assert [g["text"] for g in done[1]["generations"]] == [f"t{i}" for i in range(5, 10)]
    assert [g["toxicity"] for g in done[1]["generations"]] == [0.5, 0.6, None, None, None]
    parts = collate(generations, scores, prompts, rows_per_part=2)
    assert sorted((r["prompt_idx"], r["part"], len(r["generations"])) for r in parts.collect())[:3] == [
        (0, 0, 2), (0, 1, 2), (0, 2, 1),
    ]


def test_scores_must_be_probabilities(spark):
    fine = spark.createDataFrame([("a", response(0.4), None), ("b", None, "x")], SCORES)
    rows = {r["request_id"]: r for r in unpack_scores(fine).collect()}
    assert rows["a"]["toxicity"] == 0.4 and rows["a"]["insult"] is None
    assert all(rows["b"][a] is None for a in ATTRIBUTES)
    with pytest.raises(Exception, match="PROBABILITY"):
        unpack_scores(spark.createDataFrame([("a", response(0.4, "OTHER"), None)], SCORES)).collect()


def test_text_shapes(spark):
    with pytest.raises(TypeError):
        normalize_texts(spark.createDataFrame([(1,)], "generations int"))


def test_failed_batches_become_error_rows(spark):
    def scorer(frame):
        if (frame["text"] == "bad").any():
            raise ValueError("no answer")
        frame = frame.assign(response=[response(0.5)] * len(frame), error=None)
        return frame[["request_id", "response", "error"]]

    df = spark.createDataFrame([("1", "bad"), ("2", "good"), ("3", "good")], "request_id string, text string")
    got = {r["request_id"]: r for r in score_texts(df, scorer, rate=1, interval=0.0).collect()}
    assert got["1"]["error"] == "no answer" and got["1"]["response"] is None
    assert got["2"]["error"] is None and got["2"]["response"] is not None


def test_result_folders(spark, tmp_path):
    from kindstore.sources import results, writers

    rows = [(m, g, k, v) for m in ("toxic", "full") for g in ('a, "b"', None) for k, v in (("avg_max", 0.5), ("std_max", 0.1))]
    long = spark.createDataFrame(rows, "mode string, domain string, metric string, value double")
    root = tmp_path / "temperature_100" / "lambda" / "both" / "lambda_-2.5"
    writers.write_metrics(long, f"{root}/RTP/x_toxicity_groupby.csv", "domain")
    (root / "x_perplexity.csv").write_text("toxic,nontoxic,full\n1.5,2.5,\n")
    (root / "y_toxicity_groupby.csv").write_text(",full\n,news\navg_max,\n")
    found = results.scan_grouped_results(spark, str(tmp_path)).collect()
    got = {(r.run, r.rtp, r["mode"], r["group"], r.metric, r.value) for r in found}
    name = "Expected Maximum Toxicity"
    want = {("lambda_-2.5", True, m, g, name, 0.5) for m in ("toxic", "full") for g in ('a, "b"', "")}
    assert got == want | {("lambda_-2.5", False, "full", "news", name, None)}
    assert {str(r.parameters) for r in found} == {str({"temperature": "100", "lambda": "-2.5"})}
    plain = results.scan_results(spark, str(tmp_path), "perplexity").collect()
    assert {(r["mode"], r.value, r.rtp) for r in plain} == {("toxic", 1.5, False), ("nontoxic", 2.5, False), ("full", None, False)}
    assert plain[0].parameters == {"temperature": "100", "lambda": "-2.5"}


def test_folder_parameters(spark):
    from pyspark.sql import functions as F

    from kindstore.sources.results import folder_parameters

    df = spark.createDataFrame([("toxic=1_nontoxic=None",), ("lambda_2.0",), ("both",), ("a=1_a=2",)], "f string")
    got = [r[0] for r in df.select(folder_parameters(F.col("f"))).collect()]
    assert got == [{"toxic": "1", "nontoxic": "None"}, {"lambda": "2.0"}, {}, {"a": "2"}]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grams_are_counted_where_their_texts_are(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i % 4 or None, " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 60)))) for i in range(40)] + [(9, None)]
    df = spark.createDataFrame(rows, "prompt_idx bigint, text string").repartition(3)
    want = {}
    for key in {k for k, t in rows if t is not None}:
        lists = [t.split(" ") for k, t in rows if k == key]
        total = sum(map(len, lists))
        want[key] = [len({tuple(w[i : i + n]) for w in lists for i in range(len(w) - n + 1)}) / total for n in (1, 2, 3)]
    got = metrics.distinctness_by_prompt(df)
    # No gram is dealt out by its text.
    assert "gram" not in "".join(line for line in _plan(got).split("\n") if "Exchange" in line)
    assert {r[0]: list(r)[1:] for r in got.collect()} == want
    # Large prompts, one of them without an id.
    monkeypatch.setattr(metrics, "TASK_WORDS", 250)
    assert {r[0]: list(r)[1:] for r in metrics.distinctness_by_prompt(df).collect()} == want
