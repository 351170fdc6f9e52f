"""Corpus operators, windows, offsets, datastores."""

import math
import random
import time
from collections import Counter
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindstore import session
from kindstore.operators import corpus, metrics, plugins, prefix, skew, texts, windows
from kindstore.operators.prefix import exclusive_prefix, running_sum
from kindstore.operators.results import exact_quantiles, grid, relative_to_base
from kindstore.session import materialize, work_folder
from kindstore.sources import datastore, writers


def test_prefix_over_sparse_ids(spark):
    rng = random.Random(0)
    ids = sorted(rng.sample(range(-5000, 10**9), 200)) + [2**40, 2**40 + 1]
    ids = [-(2**63), -(2**50)] + ids + [2**63 - 1]
    rows = [(i, rng.randrange(5)) for i in ids]
    df = spark.createDataFrame(rows, "id bigint, n bigint").repartition(5)
    got = {r["id"]: r["offset"] for r in exclusive_prefix(df, "id", "n").collect()}
    total = 0
    for i, n in rows:
        assert got[i] == total
        total += n


def test_prefix_sends_one_row_per_partition_to_one_task(spark):
    df = spark.range(20_000).select(F.xxhash64("id").alias("id"), F.lit(1).alias("n"))
    parts = []

    def spy(rows, *names):
        parts.append(rows.count())
        return running_sum(rows, *names)

    with mock.patch.object(prefix, "running_sum", spy):
        got = exclusive_prefix(df, "id", "n")
    assert parts[0] <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r["offset"] for r in got.collect()) == list(range(20_000))


def test_boundaries_differ_for_scores_and_labels(spark):
    df = spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.3, 0.5, 0.51)], "toxicity double")
    scored = {r["toxicity"]: r["store"] for r in corpus.split_by_toxicity(df).collect()}
    assert scored == {0.05: "nontoxic", 0.1: "nontoxic", 0.51: "toxic"}
    labelled = {r["toxicity"]: r["store"] for r in corpus.split_by_label(df, column="toxicity").collect()}
    assert labelled == {0.05: "nontoxic", 0.5: "toxic", 0.51: "toxic"}


def test_lines_are_compared_before_cleaning(spark):
    df = spark.createDataFrame(
        [("toxic", r"a\n- b\n- -a", "- g \\n"), ("toxic", r"b\n- c", "- g \\n")], "store string, prompt string, generation string"
    )
    got = sorted(r["text"] for r in corpus.dedup_prompt_lines(df).collect())
    assert got == ["a", "a", "b", "c", "g", "g"]


def test_domains(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 0, 1)], "id int, x int, y int")
    assert {r["id"]: r["domain"] for r in texts.assign_domain(df, ["x", "y"]).collect()} == {2: "x", 3: "y"}
    two = spark.createDataFrame([(1, 1, 1)], "id int, x int, y int")
    assert texts.assign_domains_multi(two, ["x", "y"]).first()["domain"] == "x, y"
    with pytest.raises(Exception, match="more than one domain"):
        texts.assign_domain(two, ["x", "y"]).collect()


def test_numbers(spark):
    df = spark.createDataFrame([("-",), ("1,234",), ("None",), (None,)], "x string")
    assert [r["x"] for r in texts.clean_numbers(df, ["x"], none_as=7).collect()] == [None, 1234.0, 7.0, None]


def test_holdout_is_the_head(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(50)], "id bigint")
    held = sorted(r["id"] for r in corpus.holdout_split(df, "id").where("split = 'validation'").collect())
    assert held == [0, 3, 6]  # round(2.5) of 50 rows, halves up


def expected_windows(tokens, block, stride):
    total = len(tokens)
    if total >= block:
        total -= total % block
    out = []
    for i in range(0, total, stride):
        begin, end = max(i + stride - block, 0), min(i + stride, total)
        ids = tokens[begin:end]
        labels = [-100] * (i - begin) + tokens[i:end]
        pad = block - len(ids)
        out.append((ids + [0] * pad, labels + [-100] * pad))
    return out


@pytest.mark.parametrize("lengths,block,stride", [([3, 4], 10, 5), ([6, 4], 10, 5), ([9, 0, 20, 8], 8, 8), ([30, 1, 7], 8, 3)])
def test_windows(spark, lengths, block, stride):
    rows, n = [], 0
    for i, length in enumerate(lengths):
        rows.append((i, list(range(n + 1, n + length + 1))))
        n += length
    df = spark.createDataFrame(rows, "doc_id bigint, input_ids array<int>")
    got = windows.sliding_windows(df, block, stride).orderBy("window_idx").collect()
    assert [(list(r["input_ids"]), list(r["labels"])) for r in got] == expected_windows(list(range(1, n + 1)), block, stride)
    assert all(list(r["attention_mask"]) == [1] * block for r in got)
    pairs = windows.next_token_pairs(windows.sliding_windows(df, block, stride)).orderBy("entry_id").collect()
    assert [r["entry_id"] for r in pairs] == list(range(len(pairs)))
    counted = windows.token_counts(windows.sliding_windows(df, block, stride)).first()["n_tokens"]
    assert counted == len(pairs)


def test_stride_must_not_exceed_block(spark):
    df = spark.createDataFrame([(0, [1])], "doc_id bigint, input_ids array<int>")
    with pytest.raises(ValueError):
        windows.sliding_windows(df, 4, 5)


def test_truncating_beyond_the_end_raises(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "entry_id bigint")
    assert windows.truncate_datastore(df, 3).count() == 3
    with pytest.raises(Exception, match="fewer than 6"):
        windows.truncate_datastore(df, 6).collect()


def test_large_lookup_path_equals_broadcast(spark, monkeypatch):
    words = ["the"] * 50 + [f"w{i}" for i in range(20)] + ["unknown"]
    left = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, word string")
    lookup = spark.createDataFrame([("the", 50, 0)] + [(f"w{i}", 1, i + 1) for i in range(20)], "word string, n bigint, token int")
    small = sorted(skew.lookup_join(left, lookup, ["word"], "n", "left").collect())
    monkeypatch.setattr(skew, "SMALL_ROWS", 5)
    monkeypatch.setattr(skew, "HEAVY_ROWS", 2)
    big = sorted(skew.lookup_join(left, lookup, ["word"], "n", "left").select("word", "id", "token").collect())
    assert [tuple(r) for r in big] == [tuple(r) for r in small] and len(big) == 71
    # Ranked by use on the left side, where a key the table does not know may be the most common one.
    left = left.unionByName(spark.range(200).select(F.col("id").cast("int").alias("id"), F.lit("strange").alias("word")))
    counted = skew.lookup_join(left, lookup.drop("n"), ["word"], how="left")
    assert counted.count() == 271 and counted.where("token is null").count() == 201
    assert skew.lookup_join(left, lookup.drop("n"), ["word"]).count() == 70


def test_append_keeps_old_rows(spark):
    path = work_folder(spark, "append")

    def rows(n, value):
        return spark.range(n).select(
            F.col("id").alias("i"),
            F.array_repeat(F.lit(float(value)), 10).alias("key"),
            F.lit(value).cast("int").alias("token"),
        )

    assert datastore.datastore_size(spark, path, "s").first()["n"] is None
    datastore.append_datastore(rows(1000, 1), path, "s", 0, 0, "i")
    for _ in range(2):  # a repeated batch changes nothing
        datastore.append_datastore(rows(500, 2), path, "s", 1, 1, "i")
    df = datastore.read_datastore(spark, path, "s")
    assert df.count() == 1500 and datastore.datastore_size(spark, path, "s").first()["n"] == 1500
    ordered = [r["token"] for r in df.orderBy("entry_id").collect()]
    assert ordered == [1] * 1000 + [2] * 500
    assert sorted(r[0] for r in df.select("entry_id").collect()) == list(range(1500))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=200), "b": np.repeat([1.0, 2.0], [150, 3]), "c": np.array([4.0])}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, x double")
    for r in exact_quantiles(df, "g", "x", (0.0, 0.25, 0.5, 0.9, 1.0), bins=7, few=3).collect():
        assert r["quantile"] == pytest.approx(np.quantile(values[r["g"]], r["share"]))


def test_sweep_grid_settings():
    assert grid(k=[1, 2], other_k=4, alpha=(0.5, 1.0, 0.5)) == [(k, 4, a, 100.0) for k in (1, 2) for a in (0.5, 1.0)]
    with pytest.raises(ValueError):
        grid(k=[1, 2], other_k=[1], alpha=(1, 1, 1))


def test_published_relative_differences(spark):
    rows = [("Large", "Large", 0.39), ("Large + retrieval", "Large", 0.22)]
    df = spark.createDataFrame(rows, "model string, base string, emt double")
    got = {r["kind"]: r["emt"] for r in relative_to_base(df, ["emt"]).collect()}
    assert got["base"] == 0 and got["mitigated"] == pytest.approx((0.22 - 0.39) / 0.39)


def test_windows_do_not_depend_on_gaps(spark):
    rows = [(i, list(range(i, i + 40))) for i in range(10)]
    dense = spark.createDataFrame(rows, "doc_id bigint, input_ids array<int>")
    spaced = dense.withColumn("doc_id", F.col("doc_id") * 5000)
    a, b = (windows.sliding_windows(d, block=64, stride=32).select("batch_id", "window_idx", "input_ids") for d in (dense, spaced))
    assert a.count() == 12 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_repeated_answers_are_not_blended(spark):
    from kindstore.operators.collate import best_scores
    from kindstore.schemas import ATTRIBUTES

    kinds = ", ".join(f"{a} double" for a in ATTRIBUTES)
    answers = [("r", *[0.9, *[0.1] * 7]), ("r", *[0.2, *[0.8] * 7]), ("r", *[None] * 8)]
    got = best_scores(spark.createDataFrame(answers, f"request_id string, {kinds}")).first()
    assert tuple(got) in {answers[0], answers[1]}


def test_quantiles_narrow_around_outliers(spark):
    rng = np.random.default_rng(3)
    groups = {
        "outlier": [*rng.normal(size=400).tolist(), 1e300, -1e300],
        "endless": [*rng.integers(0, 50, 200).astype(float).tolist(), float("inf"), float("-inf")],
        "equal": [2.0] * 30,
        "spread": (10.0 ** rng.uniform(-8, 8, 300)).tolist(),
        "one": [5.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, x double")
    shares = (0.1, 0.25, 0.5, 0.75)
    for few in (3, 100_000):
        got = {(r.g, r.share): r.quantile for r in exact_quantiles(df, "g", "x", shares, bins=256, few=few).collect()}
        assert len(got) == len(groups) * len(shares)
        for (g, share), value in got.items():
            assert np.isclose(value, np.quantile(groups[g], share)), (few, g, share)


@pytest.mark.parametrize("values", [[1, 2, 2], [1, None, 2], [None]])
def test_orders_without_places_raise(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "id bigint")
    with pytest.raises(ValueError, match="unique"):
        prefix.dense_ids(df, "id")


def test_several_sums_at_once(spark):
    df = spark.createDataFrame([(i * 7, i % 3, i) for i in range(50)], "id bigint, a bigint, b bigint").repartition(4)
    got = exclusive_prefix(df, "id", ["a", "b"], ["_a", "_b"]).orderBy("id").collect()
    for i, r in enumerate(got):
        assert (r["_a"], r["_b"]) == (sum(j % 3 for j in range(i)), sum(range(i)))


TEXTS = [(1, "the cat the dog"), (2, ""), (3, "a  b "), (4, None), (5, "strange words the"), (6, "w" * 50_000)]


def test_tokenizing_in_place_equals_the_join(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition(3)
    vocab = materialize(windows.build_vocab(df.where("doc_id < 5")), "vocab")
    near = windows.tokenize(df, vocab)
    assert "Exchange" not in windows.tokenize(materialize(df, "texts"), vocab)._jdf.queryExecution().executedPlan().toString()
    want = sorted(near.collect())
    monkeypatch.setattr(windows, "is_small", lambda *_: False)
    far = sorted((r["doc_id"], list(r["input_ids"])) for r in windows.tokenize(df, vocab).collect())
    assert [(r["doc_id"], list(r["input_ids"])) for r in want] == far
    assert [len(ids) for _, ids in far] == [4, 1, 4, 3, 1] and dict(far)[5][:2] == [-1, -1]
    with pytest.raises(ValueError):
        windows.vocabulary_tokenizer(vocab)


def test_any_tokenizer_is_made_once_a_task(spark):
    made = spark.sparkContext.accumulator(0)

    def lengths():
        made.add(1)
        return lambda texts: pa.array([[len(w) for w in t.split(" ")] for t in texts.to_pylist()], pa.list_(pa.int64()))

    df = materialize(spark.range(100).select(F.col("id").alias("doc_id"), F.lit("ab c def").alias("text")).coalesce(2), "texts")
    got = windows.tokenize_with(df, lengths).collect()
    assert len(got) == 100 and all(list(r["input_ids"]) == [2, 1, 3] for r in got) and made.value <= 4
    store = windows.build_datastore(df, block=8, stride=4, batch_size=10, tokenizer=lengths)
    # Ten batches of 30 tokens, of which 24 make whole blocks, and the first has no context.
    assert store.count() == 10 * 23 and {r["token"] for r in store.select("token").distinct().collect()} == {1, 2, 3}


def test_spans_give_the_pairs_of_padded_windows(spark):
    df = spark.createDataFrame([(i, list(range(i, i + n))) for i, n in enumerate([30, 1, 0, 7, 19])], "doc_id bigint, input_ids array<int>")
    padded = windows.next_token_pairs(windows.sliding_windows(df, 8, 3, batch_size=2))
    spans = windows.next_token_pairs(windows.window_spans(df, 8, 3, batch_size=2))
    assert sorted(padded.collect()) == sorted(spans.collect()) and spans.count() > 40


def test_windows_over_repeated_ids_raise(spark):
    df = spark.createDataFrame([(1, [1, 2]), (1, [3])], "doc_id bigint, input_ids array<int>")
    with pytest.raises(ValueError, match="unique"):
        windows.window_spans(df, 4, 2)


def _bigram_by_hand(corpus, text):
    pairs, before = Counter(), Counter()
    for t in corpus:
        w = t.split(" ")
        pairs.update(zip(w, w[1:]))
        before.update(w[:-1])
    size = len({w for t in corpus for w in t.split(" ")})
    w = text.split(" ")
    return [math.log((pairs[a, b] + 1) / (before[a] + size)) for a, b in zip(w, w[1:])]


def test_bigram_losses_by_both_ways(spark, monkeypatch):
    corpus_rows = [(0, "a b a b c"), (1, "b b"), (2, "c"), (3, "a  a")]
    texts = [(10, None, "a b zz a b"), (11, 1, "zz"), (12, 2, ""), (13, 3, "b b b c  a")]
    df = spark.createDataFrame(corpus_rows, "doc_id bigint, text string").repartition(2)
    asked = spark.createDataFrame(texts, "id bigint, part int, text string")
    known = plugins.BigramModel(df)
    want = {i: _bigram_by_hand([t for _, t in corpus_rows], t) for i, _, t in texts}
    for small in (True, False):
        if not small:
            monkeypatch.setattr(plugins, "BROADCAST_BIGRAMS", 0)
        got = {r["id"]: r for r in plugins.text_losses(asked, known, ["id", "part"]).collect()}
        for i, part, t in texts:
            assert got[i]["n"] == len(t.split(" ")) and got[i]["n_scored"] == len(want[i]) and got[i]["part"] == part
            assert got[i]["nll"] == (pytest.approx(-sum(want[i])) if want[i] else None)
    rows = plugins.ngram_logprobs(asked, known, ["id", "part"]).where("id = 13").orderBy("pos").collect()
    assert rows[0]["logp"] is None and [r["logp"] for r in rows[1:]] == pytest.approx(want[13])
    with pytest.raises(ValueError):
        known.over_windows()


def test_window_perplexity_counts_each_token_once(spark):
    """Over one text, windows of any overlap give the perplexity of the text itself."""
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefg") for _ in range(64))
    df = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    model = plugins.BigramModel(df)
    want = metrics.corpus_perplexity(plugins.text_losses(df, model, ["doc_id"])).first()[0]
    assert want == pytest.approx(metrics.corpus_perplexity(plugins.ngram_logprobs(df, model, ["doc_id"])).first()[0])
    tokens = windows.tokenize(df, model.vocab)
    for block, stride in ((8, 3), (16, 16), (64, 64), (8, 8)):
        losses = windows.window_losses(windows.window_spans(tokens, block, stride), model.over_windows())
        if block == stride and block < 64:  # the first token of each window has no context
            assert losses.agg(F.sum("n_scored")).first()[0] == 64 - 64 // block
        else:
            assert metrics.corpus_perplexity(losses).first()[0] == pytest.approx(want)
            padded = windows.window_losses(windows.sliding_windows(tokens, block, stride), model.over_windows())
            assert metrics.corpus_perplexity(padded).first()[0] == pytest.approx(want)


def _stored(spark, name, sizes):
    path = work_folder(spark, name)
    for batch, n in enumerate(sizes):
        rows = spark.range(n).select(F.col("id").alias("i"), F.array(F.col("id").cast("float")).alias("key"), F.lit(batch).alias("token"))
        datastore.append_datastore(rows, path, "s", batch % 2, batch, "i")
    return path


def test_first_entries_read_only_their_batches(spark):
    path = _stored(spark, "ranges", [100, 40, 60])
    ranges = {r["batch"]: (r["first"], r["last"], r["n"]) for r in datastore.entry_ranges(spark, path).collect()}
    assert ranges == {0: (0, 99, 100), 1: (100, 139, 40), 2: (140, 199, 60)}
    for n, batches in ((0, 0), (1, 1), (100, 1), (101, 2), (140, 2), (200, 3)):
        df = datastore.read_first(spark, path, "s", n)
        assert df.count() == n and sorted(r[0] for r in df.select("entry_id").collect()) == list(range(n))
        assert df.select("batch").distinct().count() == batches
    plan = datastore.read_first(spark, path, "s", 50)._jdf.queryExecution().executedPlan().toString()
    assert "batch#" in plan.split("PartitionFilters:")[1].split("]")[0] and "LessThan(entry_id,50)" in plan
    with pytest.raises(ValueError):
        datastore.read_first(spark, path, "s", 201)
    with pytest.raises(ValueError):
        datastore.read_first(spark, path, "other", 1)


def test_files_of_a_datastore_hold_ranges_of_ids(spark):
    path = work_folder(spark, "clustered")
    rows = spark.range(5000).select(
        F.col("id").alias("entry_id"), F.array(F.lit(1.0)).alias("key"), F.lit(1).alias("token"), F.lit("s").alias("store")
    )
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # a store this small would go into one file
    try:
        datastore.write_datastore(rows.repartition(7), path)
    finally:
        spark.conf.unset(merging)
    files = datastore.read_datastore(spark, path).groupBy(F.input_file_name()).agg(F.min("entry_id").alias("a"), F.max("entry_id").alias("b"))
    spans = sorted((r["a"], r["b"]) for r in files.collect())
    assert len(spans) > 1 and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_next_entry_reads_no_keys_and_ignores_a_broken_write(spark, monkeypatch):
    path = _stored(spark, "broken", [100])
    # A batch whose data were written but not its range does not count, and is replaced by the next try.
    monkeypatch.setattr(datastore, "_write_ranges", lambda *_: None)
    rows = spark.range(9).select(F.col("id").alias("i"), F.array(F.lit(0.0)).alias("key"), F.lit(7).alias("token"))
    datastore.append_datastore(rows, path, "s", 1, 1, "i")
    monkeypatch.undo()
    assert datastore.next_entry(spark, path, "s", 2) == 100
    monkeypatch.setattr(datastore, "read_datastore", lambda *_: pytest.fail("keys were read"))
    assert datastore.next_entry(spark, path, "s", 1) == 100 and datastore.next_entry(spark, path, "new", 5) == 0
    monkeypatch.undo()
    datastore.append_datastore(rows, path, "s", 1, 1, "i")
    assert datastore.next_entry(spark, path, "s", 2) == 109
    assert datastore.read_datastore(spark, path, "s").count() == 109


def test_first_rows_are_ranked_by_narrow_columns(spark):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "id bigint, text string").repartition(4)
    assert sorted(r["id"] for r in corpus.limit_prompts(df, 7, order="id").collect()) == list(range(7))
    done = spark.createDataFrame([(2,), (2,), (99,)], "id bigint")
    assert sorted(r["id"] for r in corpus.limit_prompts(df, 4, done, "id").collect()) == [0, 1, 3]
    sample = sorted(corpus.seeded_sample(df, 10).collect())
    assert len(sample) == 10 and sample == sorted(corpus.seeded_sample(df.repartition(9), 10).collect())
    assert corpus.seeded_sample(df, 500).count() == 50


def test_collated_parts_are_counted_by_prompt(spark):
    rows = [(0, p, 10_000 + p, p) for p in range(3)] + [(1, 0, 5, 5)]
    df = spark.createDataFrame(rows, "prompt_idx bigint, part int, a int, b int").withColumn("generations", F.array("a"))
    with pytest.warns(UserWarning, match="2 collated rows, expected 3"):
        assert writers.write_collated(df.where("part > 0 or prompt_idx = 1"), work_folder(spark, "collated"), 3) == 2


def test_intermediates_can_be_removed(spark):
    root = work_folder(spark, "remove")
    with mock.patch.object(session, "work_root", lambda spark: f"{root}/own"):
        kept = materialize(spark.range(5), "numbers")
        assert kept.count() == 5 and session.exists(spark, f"{root}/own")
        session.remove_work(spark)
        assert not session.exists(spark, f"{root}/own")


def test_window_losses_of_a_model_too_large_to_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(i))) for i in range(1, 30)], "doc_id bigint, text string")
    model = plugins.BigramModel(df)
    spans = materialize(windows.window_spans(model.tokenize(df), 8, 4, 3), "windows")
    small = sorted(model.window_losses(spans).collect())
    monkeypatch.setattr(plugins, "BROADCAST_BIGRAMS", 0)
    large = sorted(model.window_losses(spans).collect())
    assert [r[:2] + r[3:] for r in large] == [r[:2] + r[3:] for r in small]
    assert [r["nll"] for r in large] == pytest.approx([r["nll"] for r in small])


def test_a_broadcast_model_needs_no_package_in_its_workers(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b a c"), (2, "b a")], "doc_id bigint, text string")
    model, sent = plugins.BigramModel(df), []
    monkeypatch.setattr(plugins, "BigramScorer", lambda *parts: sent.append(parts))
    model.scorer()
    assert not sent  # made in a task, from arrays


def _exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]


@pytest.mark.parametrize("block,stride", [(8, 3), (8, 8)])
def test_windows_of_several_runs(spark, monkeypatch, block, stride):
    """Windows cut from runs, with offsets sent to the tokens or tokens sent to the offsets."""
    rng = random.Random(block)
    lists = [[rng.randrange(50) for _ in range(n)] for n in (30, 1, 0, 70, 19, 3, 3, 2, 200)]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id bigint, input_ids array<int>").repartition(3)
    batches = [lists[i : i + 4] for i in range(0, len(lists), 4)]
    wide = [w for b in batches for w in expected_windows([x for row in b for x in row], block, stride)]
    stream = [x for row in lists for x in row]
    for run in (16, 1 << 15):
        monkeypatch.setattr(windows, "RUN_TOKENS", run)
        monkeypatch.setattr(windows, "SMALL_ROWS", 0 if run == 16 else 100)
        got = windows.sliding_windows(df, block, stride, 4).orderBy("batch_id", "window_idx").collect()
        assert [(list(r["input_ids"]), list(r["labels"])) for r in got] == wide
        spans = materialize(windows.window_spans(df, block, stride, 4), "windows")
        pairs = windows.next_token_pairs(spans)
        padded = windows.next_token_pairs(windows.sliding_windows(df, block, stride, 4))
        assert sorted(pairs.collect()) == sorted(padded.collect())
        # Spans know their place: no window moves for its ids.
        assert not any("window_idx" in line for line in _exchanges(pairs))
        blocks = windows.fixed_blocks(df, block).orderBy("block_idx").collect()
        assert [list(r["input_ids"]) for r in blocks] == [stream[s : s + block] for s in range(0, len(stream) - block + 1, block)]
        assert [r["block_idx"] for r in blocks] == list(range(len(stream) // block))


def test_lines_are_looked_up_where_they_lie(spark, monkeypatch):
    texts = spark.createDataFrame([(0, "a b a c\n \n\nb  zz a"), (1, "c"), (2, None), (3, "")], "doc_id bigint, text string")
    vocab = materialize(windows.build_vocab(texts), "vocab")
    ids = {r["word"]: r["token"] for r in vocab.collect()}
    got = windows.line_blocks(texts, vocab, 3)
    assert not _exchanges(got)
    rows = sorted((r["doc_id"], r["line"], list(r["input_ids"])) for r in got.collect())
    unknown = lambda words: [ids.get(w, -1) for w in words]
    assert rows == [(0, 0, unknown(["a", "b", "a"])), (0, 3, unknown(["b", "", "zz"])), (1, 0, unknown(["c"]))]
    # Texts that share an id.
    again = windows.line_blocks(texts.where("doc_id = 0").unionByName(texts), vocab, 3)
    assert [len(r["input_ids"]) for r in again.orderBy("doc_id", "line").collect()] == [6, 6, 1]
    monkeypatch.setattr(windows, "is_small", lambda _: False)
    monkeypatch.setattr(windows, "CHUNK_CHARS", 7)
    joined = windows.line_blocks(texts, vocab, 3)
    assert joined.columns == got.columns and joined.dtypes == got.dtypes and sorted((r["doc_id"], r["line"], list(r["input_ids"])) for r in joined.collect()) == rows


def test_a_written_table_frees_its_shuffles(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = shuffles()
    rows = spark.range(1000).repartition(5, "id")
    kept = materialize(rows, "numbers")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before and kept.count() == 1000
    assert spark.conf.get(session.FREE_SHUFFLES, "false") == "false" and materialize(rows, "again").count() == 1000


def test_a_large_model_looks_up_each_bigram_once_a_chunk(spark, monkeypatch):
    """Texts of several chunks, words and bigrams of several buckets; no row a token moves."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "b", "", "\n", "ä", "cd"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    asked = [*texts[:30], "zz a", "", "zz", "a zz b", "a " * 200]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id bigint, text string").repartition(3)
    other = spark.createDataFrame([(i % 7 if i % 5 else None, i, t) for i, t in enumerate(asked)] + [(1, 99, None)], "k bigint, i bigint, text string")
    near = plugins.text_losses(other, plugins.BigramModel(df), ["k", "i"]).collect()
    monkeypatch.setattr(windows, "is_small", lambda *_: False)
    monkeypatch.setattr(plugins, "is_small", lambda *_: False)
    monkeypatch.setattr(windows, "CHUNK_CHARS", 300)
    monkeypatch.setattr(plugins, "CHUNK_TOKENS", 50)
    monkeypatch.setattr(plugins, "COUNT_TOKENS", 100)
    monkeypatch.setattr(plugins, "BUCKET_TOKENS", 100)
    monkeypatch.setattr(plugins.lookups, "BUCKET_ROWS", 2)
    monkeypatch.setattr(plugins.lookups, "PACKED_ROWS", 5)
    model = plugins.BigramModel(df)
    assert not model.is_small()
    losses = plugins.text_losses(other, model, ["k", "i"])
    assert "Generate" not in losses._jdf.queryExecution().executedPlan().toString()
    want, far = {r["i"]: r for r in near}, {r["i"]: r for r in losses.collect()}
    assert far.keys() == want.keys() == set(range(len(asked)))
    for i, t in enumerate(asked):
        hand = _bigram_by_hand(texts, t)
        assert far[i]["k"] == want[i]["k"] and far[i]["n"] == want[i]["n"] and far[i]["n_scored"] == len(hand)
        assert far[i]["nll"] == want[i]["nll"] if not hand else far[i]["nll"] == pytest.approx(-sum(hand))
    rows = plugins.ngram_logprobs(other, model, ["k", "i"]).where("i = 34").orderBy("pos").collect()
    assert rows[0]["logp"] is None and [r["logp"] for r in rows[1:]] == pytest.approx(_bigram_by_hand(texts, asked[34]))
    ids = {r["word"]: r["token"] for r in model.vocab.collect()}
    assert [r["token"] for r in rows] == [ids.get(w, -1) for w in asked[34].split(" ")]
    one = other.where("i = 30")
    assert [(r["nll"], r["n"], r["n_scored"]) for r in plugins.text_losses(one.unionByName(one), model, ["k", "i"]).collect()] == [(pytest.approx(2 * far[30]["nll"]), 4, 2)]
    alone = plugins.text_losses(other.where("i = 32"), model, ["k", "i"]).collect()  # a chunk that asks for nothing
    assert [(r["nll"], r["n"], r["n_scored"]) for r in alone] == [(None, 1, 0)]
    assert plugins.text_losses(other.where("i = -1"), model, ["k", "i"]).collect() == []
    nothing = plugins.BigramModel(df.where("doc_id < 0"))
    assert nothing.size == 0 and nothing.pairs.count() == 0
