"""Mixing, and the pipeline against a brute-force version."""

import hashlib
import itertools
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from kindstore.llm import queries
from kindstore.llm.bpe import read_ranks
from kindstore.llm.flow import route, water_fill
from kindstore.llm.language import fit_language, predict_language
from kindstore.llm.mixing import mix_sources
from kindstore.llm.simhash import near_groups
from pyspark.sql import functions as F
from tests import oracle

FOLDER = "/root/testdata/sf0.001"


def test_water_fill_by_rounds():
    random.seed(1)
    for _ in range(200):
        n = random.randint(1, 8)
        sizes, weights = [random.randint(0, 50) for _ in range(n)], [1 + i % 3 for i in range(n)]
        want, open_, rest = [0.0] * n, set(range(n)), float(sum(sizes))
        while open_:
            share = {s: rest * weights[s] / sum(weights[o] for o in open_) for s in open_}
            over = {s for s in open_ if share[s] > 3 * sizes[s] + 1e-9}
            if not over:
                for s in open_:
                    want[s] = share[s]
                break
            for s in over:
                want[s] = 3.0 * sizes[s]
                rest -= want[s]
            open_ -= over
        assert np.allclose(water_fill(sizes, weights, 3), want)


def test_route_is_cheapest():
    random.seed(2)
    for _ in range(40):
        sizes = [random.randint(0, 3) for _ in range(3)]
        members = [sorted(random.sample(range(2), random.randint(1, 2))) for _ in sizes]
        quotas = [random.randint(0, 5) for _ in range(2)]
        flows = route(sizes, members, quotas, 2)
        sent = [sum(f.values()) for f in flows]
        best = None
        for amounts in itertools.product(*[range(2 * s + 1) for s in sizes]):
            only = [sum(a for a, m in zip(amounts, members) if m == [s]) for s in (0, 1)]
            if sum(amounts) <= sum(quotas) and only[0] <= quotas[0] and only[1] <= quotas[1]:
                cost = sum(max(a - s, 0) for a, s in zip(amounts, sizes))
                best = max(best or (-1, 0), (sum(amounts), -cost))
        assert (sum(sent), -sum(max(a - s, 0) for a, s in zip(sent, sizes))) == best
        assert all(sum(f.get(s, 0) for f in flows) <= quotas[s] for s in (0, 1))


def test_mix_edges(spark, edge, docs):
    rows = mix_sources(edge).collect()
    assert len(rows) == 10 and all(r.taken % r.size == 0 and r.taken <= 3 * r.size for r in rows if r["size"])
    assert all(r.taken == 0 for r in rows if not r["size"]) and mix_sources(edge.limit(0)).count() == 0
    both = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit("all"))).otherwise(F.array("source")))
    mixed = mix_sources(both)
    assert mixed.count() == docs.count() and mixed.where("taken > 3 * size").count() == 0
    assert mixed.exceptAll(mix_sources(both)).count() == 0
    with pytest.raises(ValueError):
        mix_sources(docs, most_patterns=1)


def test_mix_goes_on_after_a_document_that_does_not_fit(spark):
    def order(i):
        return hashlib.md5(f"11:{i}".encode()).hexdigest()

    long = min(range(1000, 1400), key=order)  # before nearly all others in hash order
    rows = [(i, "w " * 10, "aaabb"[i % 5]) for i in range(600)]
    # The rows of the long one are taken or left together: 3600 words for a target of 3200.
    rows += [(long, "w " * 1800, "a"), (long, "w " * 1800, "a")]
    found = mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for source in "ab":
        mine = [r for r in found if r.pattern == f'["{source}"]']
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 5.5
    assert not any(r.taken for r in found if r.doc_id == long)


def test_mix_is_the_first_fit_in_hash_order(spark):
    random.seed(7)
    sizes = {i: random.choice([1, 3, 20, 100, 700]) for i in range(200)}
    rows = [(i, "w " * n, "ab"[i % 2]) for i, n in sizes.items()]
    found = mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for source in (0, 1):
        mine = sorted((r for r in found if r.doc_id % 2 == source), key=lambda r: hashlib.md5(f"11:{r.doc_id}".encode()).hexdigest())
        left = int(mine[0].target + 0.5) % mine[0].source_size
        times, extra = int(mine[0].target + 0.5) // mine[0].source_size, set()
        for r in mine:
            if r["size"] <= left:
                extra.add(r.doc_id)
                left -= r["size"]
        near = [(abs(r["size"] - left), at) for at, r in enumerate(mine) if r.doc_id not in extra and abs(r["size"] - left) < left]
        extra |= {mine[at].doc_id for _, at in sorted(near)[:1]}
        assert {r.doc_id: r.taken for r in mine} == {r.doc_id: r["size"] * (times + (r.doc_id in extra)) for r in mine}


def test_queries_match_sql(spark):
    con = oracle.connect(FOLDER)
    for name, sql in queries.ORACLES.items():
        df, twin = queries.QUERIES[name](spark, FOLDER), con.sql(sql)
        mine = oracle._rows(df.columns, [tuple(r) for r in df.collect()])
        assert mine and mine == oracle._rows(twin.columns, twin.fetchall()), name


def test_pipeline_brute_force(spark, docs):
    found = predict_language(docs, fit_language(docs)).where("lang_pred <> 'und' AND score >= 0.2").orderBy("doc_id").collect()
    seen, kept = set(), []
    for r in found:
        text = " ".join(r.text.replace("\t", " ").replace("\n", " ").split(" "))
        while "  " in text:
            text = text.replace("  ", " ")
        if text not in seen:
            kept.append(r.doc_id)
        seen.add(text)
    left = docs.where(F.col("doc_id").isin(kept))
    alone = [r.doc_id for r in near_groups(left).collect() if r.doc_id == r.component_id]
    mixed = {r.doc_id: r.taken // r["size"] for r in mix_sources(docs.where(F.col("doc_id").isin(alone))).where("taken > 0").collect()}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    want = Counter()
    for r in docs.where(F.col("doc_id").isin(list(mixed))).collect():
        ids = np.array(encoding.encode_ordinary(r.text), "<u4")
        digests = (hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
        want[r.doc_id, len(ids), *digests] += mixed[r.doc_id]
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()) == want


def test_pipeline_edges(spark, edge):
    clean = edge.withColumn("n_chars", F.length("text"))
    for rows in (clean, clean.limit(0)):
        step = rows
        for name, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, FOLDER)
            assert name == "encode" or step.columns == rows.columns
        assert step.count() <= 10


def test_pipeline_stages_keep_rows(spark):
    """Repeated ids, rows and texts, nulls and ties: which rows each stage keeps."""
    names = "doc_id bigint, text string, lang string, source string, n_chars int"
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(1, "a b", "en", "s", 3), (1, "a  b", "en", "s", 3), (1, "a b", "en", "s", 3), (1, "a b", "en", "r", 3)]
    rows += [(5, "x", None, "s", 1), (5, "y", None, "s", 1), (3, "y", None, "s", 1), (None, "y", None, "s", 1)]
    rows += [(7, None, None, None, None), (6, "", None, None, 0), (None, "z", None, None, 1), (None, "z", "en", None, 1)]
    rows += [(9, long, "en", "s", 1), (8, long + " more", "en", "s", 1), (9, long + " more", "en", "s", 1)]
    df = spark.createDataFrame(rows, names)

    def kept(stage, df=df):
        return Counter((r.doc_id, r.text, r.source) for r in stage(spark, df, FOLDER).collect())

    exact = {(1, "a b", "r"), (5, "x", "s"), (3, "y", "s"), (6, "", None), (None, "z", None), (9, long, "s"), (8, long + " more", "s")}
    # Of the rows of id 1 the one stays whose text has the smaller digest.
    digests = {t: hashlib.sha256(t.encode()).digest() for t in ("a b", "a  b")}
    if digests["a  b"] < digests["a b"]:
        exact = exact - {(1, "a b", "r")} | {(1, "a  b", "s")}
    assert kept(corpus_pipeline.exact_dedup) == Counter(exact)
    near = {r for r in exact if r[0] != 9}
    assert kept(corpus_pipeline.near_dedup) == Counter(near)
    assert kept(corpus_pipeline.exact_dedup, df.limit(0)) == kept(corpus_pipeline.near_dedup, df.limit(0)) == Counter()
    # Two sources under one id are taken each by its own multiple.
    mixed = [(1, "w " * 10, "en", "a", 1), (1, "w " * 10, "en", "b", 1), (2, "v " * 10, "en", "b", 1), (2, None, "en", "b", 1), (3, "", "en", "a", 1)]
    df = spark.createDataFrame(mixed, names)
    times = {(r.doc_id, r.pattern): r.taken // 10 for r in mix_sources(df).collect() if r.taken}
    want = Counter({(i, t, s): times[i, f'["{s}"]'] for i, t, _, s, _ in mixed if t and (i, f'["{s}"]') in times})
    assert kept(corpus_pipeline.mix, df) == want and sum(want.values()) >= 3
