"""Nearest neighbours against brute force, ties, hot cells and both search paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindstore.catalog import QUERIES
from kindstore.operators import cells, kernel, vectors
from kindstore.operators.kernel import TopK
from kindstore.session import file_system, materialize, work_folder
from kindstore.sources import index


def brute(queries, keys, ids, k):
    dist = ((queries[:, None] - keys[None]) ** 2).sum(-1)
    return [[ids[j] for j in sorted(range(len(keys)), key=lambda j: (row[j], ids[j]))[:k]] for row in dist]


def test_kernel_matches_brute_force():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 3, (5000, 4)).astype(float)  # many equal keys
    queries, ids = rng.normal(size=(7, 4)), rng.permutation(5000)
    top = TopK(queries, 40)
    for s in range(0, 5000, 700):
        top.add(keys[s : s + 700], ids[s : s + 700], ids[s : s + 700])
    want = brute(queries, keys, ids, 40)
    for q in range(7):
        assert list(top.ids[top.qi == q]) == want[q]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(1)
    keys, queries = rng.integers(0, 3, (300, 4)).astype(float), rng.normal(size=(50, 4))
    rows = [("hot" if i % 3 else "cold", i, [float(x) for x in v], i % 5) for i, v in enumerate(keys)]
    key_table = spark.createDataFrame(rows, "store string, entry_id bigint, key array<float>, token int")
    query_table = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id bigint, embedding array<double>"
    )
    return queries, keys, query_table, key_table


def found(df):
    return sorted((r["query_id"], r["store"], r["rank"], r["entry_id"]) for r in df.collect())


def test_both_paths_agree_with_brute_force(tables, monkeypatch):
    queries, keys, q, k = tables
    direct = found(vectors.knn_exact(q, k, {"hot": 9, "cold": 4}))
    hot = np.array([i for i in range(300) if i % 3])
    want = brute(queries, keys[hot], hot, 9)
    for i in range(50):
        assert [e for qq, s, _, e in direct if qq == i and s == "hot"] == want[i]
    monkeypatch.setattr(vectors, "KEY_BLOCK", 17)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 11)
    assert found(vectors.knn_exact(q, k, {"hot": 9, "cold": 4}, block=11)) == direct


@pytest.mark.parametrize("search", [vectors.knn_exact, vectors.knn_dot])
@pytest.mark.parametrize("block", [11, 4096])
def test_passes_agree_with_one_pass(tables, monkeypatch, search, block):
    _, _, q, k = tables
    amount = {"hot": 9, "cold": 4}
    direct = search(q, k, amount).collect()
    monkeypatch.setattr(vectors, "FIRST_KEYS", 40)
    monkeypatch.setattr(vectors, "GROWTH", 3)
    monkeypatch.setattr(vectors, "KEY_BLOCK", 17)
    assert sorted(search(q, k, amount, block=block).collect()) == sorted(direct)


def test_kernel_at_large_k_over_several_chunks(monkeypatch):
    monkeypatch.setattr(kernel, "KEY_CHUNK", 300)
    monkeypatch.setattr(kernel, "QUERY_CHUNK", 3)
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 3, (2500, 5)).astype(float)
    queries, ids = rng.normal(size=(8, 5)), rng.permutation(2500)
    top, limited = TopK(queries, 1024), TopK(queries, 1024, limit=np.full(8, 5.0))
    for t in (top, limited):
        t.add(keys, ids, ids)
    want = brute(queries, keys, ids, 1024)
    for q in range(8):
        assert list(top.ids[top.qi == q]) == want[q]
        assert list(limited.ids[limited.qi == q]) == [i for i, d in zip(want[q], top.dist[top.qi == q]) if d <= 5.0]


def test_probing_every_cell_is_exact(tables, monkeypatch):
    _, _, q, k = tables
    monkeypatch.setattr(vectors, "KEY_BLOCK", 20)  # hot cells are cut into blocks
    centroids = vectors.ivf_train(k, 6, method="sample")
    cells = vectors.ivf_assign(k, centroids)
    assert found(vectors.ivf_search(q, cells, centroids, 5, nprobe=6)) == found(vectors.knn_exact(q, k, 5))
    few = vectors.ivf_search(q, cells, centroids, 5, nprobe=3)
    recall = {r["store"]: r["recall"] for r in vectors.recall_at_k(few, vectors.knn_exact(q, k, 5), 5).collect()}
    assert all(0.4 < x <= 1.0 for x in recall.values())  # three of six cells: a thin search, for comparison only


def test_k_above_store_size_and_dot_order(tables):
    queries, keys, q, k = tables
    assert vectors.knn_exact(q.limit(1), k, 1000).count() == 300
    top = vectors.knn_dot(q, k, 1).collect()
    for r in top:
        rows = [i for i in range(300) if ("hot" if i % 3 else "cold") == r["store"]]
        assert r["dist"] == pytest.approx((keys[rows] @ queries[r["query_id"]]).max())


def test_quantised_search_then_exact_distances(tables):
    queries, keys, q, k = tables
    centroids = vectors.ivf_train(k, 4, method="sample")
    books = vectors.pq_train(k, 2, 9, seed=3)
    codes = vectors.ivf_assign(vectors.pq_encode(k, books), centroids)
    near = vectors.pq_search(q, codes, books, centroids, 5, nprobe=4)
    again = vectors.recompute_dists(near, q, k)
    for r in again.where("rank = 1").collect():
        assert r["dist"] == pytest.approx(((queries[r["query_id"]] - keys[r["entry_id"]]) ** 2).sum())
    # Nine codes cover all nine values of two ternary dimensions: codes are exact.
    exact = {(r["query_id"], r["store"], r["rank"]): r["dist"] for r in vectors.knn_exact(q, k, 5).collect()}
    for r in near.collect():
        assert r["dist"] == pytest.approx(exact[r["query_id"], r["store"], r["rank"]])


def test_too_many_cells(tables):
    with pytest.raises(ValueError):
        vectors.ivf_train(tables[3], vectors.MAX_CENTROIDS + 1)


def test_context_is_null_near_the_start(spark):
    store = spark.createDataFrame([("s", i, i * 2) for i in range(40)], "store string, entry_id bigint, token int")
    near = spark.createDataFrame(
        [(0, "s", 1, 35, 70), (0, "s", 2, 3, 6)], "query_id bigint, store string, rank int, entry_id bigint, token int"
    )
    got = {r["rank"]: r for r in vectors.neighbour_context(near, store).collect()}
    assert got[1]["context"] == [i * 2 for i in range(5, 35)] and got[1]["next_token"] == 70
    assert got[2]["context"] is None


def test_stored_index_reads_probed_folders_and_refuses_growth(tables, spark):
    _, _, q, k = tables
    centroids, path = vectors.ivf_train(k, 6, method="sample"), work_folder(spark, "index")
    index.write_index(k, centroids, path, bucket_cells=2)
    near = index.search_index(q, path, 5, nprobe=1, keys=k)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert found(near) == found(vectors.ivf_search(q, vectors.ivf_assign(k, centroids), centroids, 5, nprobe=1))
    more = k.unionByName(k.limit(1).withColumn("entry_id", F.lit(10**6).cast("bigint")))
    with pytest.raises(index.StaleIndex):
        index.search_index(q, path, 5, keys=more)
    with pytest.raises(index.StaleIndex):
        index.search_index(q, path + "-absent", 5, keys=k)


@pytest.mark.parametrize("scale", ["sf0.01"])
def test_every_index_query_finds_nine_of_ten(spark, scale):
    rows = QUERIES["index_recall"](spark, f"/root/testdata/{scale}").collect()
    assert {r["search"] for r in rows} == {"ivf", "append", "pq", "pq_index"} and len(rows) == 8
    assert min(r["recall"] for r in rows) >= 0.9


def clustered(spark, n=2000, cells=20):
    """Keys around well separated centres."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(cells, 6)) * 50
    keys = centres[rng.integers(0, cells, n)] + rng.normal(size=(n, 6))
    rows = [("s" if i % 4 else "t", i, [float(x) for x in v], i % 7) for i, v in enumerate(keys)]
    table = spark.createDataFrame(rows, "store string, entry_id bigint, key array<double>, token int")
    near = [(i, [float(x) for x in centres[i % cells] + rng.normal(size=6)]) for i in range(40)]
    return table, spark.createDataFrame(near, "query_id bigint, embedding array<double>")


def test_bounded_search_is_exact_and_reads_few_cells(tables, spark, monkeypatch):
    _, _, q, k = tables  # small whole numbers: many ties
    for key_rows, query_rows, cells_wanted in ((k, q, 6), (*clustered(spark), 20)):
        centroids = materialize(vectors.ivf_train(key_rows, cells_wanted, method="sample"), "centroids")
        assigned = materialize(vectors.ivf_assign(key_rows, centroids), "assigned")
        radii = cells.cell_radii(assigned, centroids)
        asked = []
        whole = vectors._by_blocks
        monkeypatch.setattr(cells, "_by_blocks", lambda probes, *a, **b: asked.append(probes.count()) or whole(probes, *a, **b))
        amount = {"hot": 9, "cold": 4} if key_rows is k else 7
        got = cells.ivf_search_bounded(query_rows, assigned, centroids, radii, amount, first=1)
        assert found(got) == found(vectors.knn_exact(query_rows, key_rows, amount))
        if key_rows is not k:  # the sampled centres of 20 clusters share some
            assert sum(asked) < 0.5 * 40 * cells_wanted
        monkeypatch.undo()
    nothing = cells.ivf_search_bounded(q.limit(0), assigned, centroids, radii, 3)
    assert nothing.count() == 0


def test_probes_for_recall_is_what_a_search_finds(spark):
    k, q = clustered(spark)
    centroids = materialize(vectors.ivf_train(k, 12, method="sample"), "centroids")
    assigned = materialize(vectors.ivf_assign(k, centroids), "assigned")
    exact = materialize(vectors.knn_exact(q, k, 30), "exact")
    for target in (0.5, 0.95):
        for r in cells.probes_for_recall(q, assigned, centroids, exact, target).collect():
            recall = {x["store"]: x["recall"] for x in vectors.recall_at_k(vectors.ivf_search(q, assigned, centroids, 30, r["nprobe"]), exact, 30).collect()}
            assert recall[r["store"]] == pytest.approx(r["recall"]) and r["recall"] >= target


def test_compressed_index_holds_no_keys(tables, spark):
    queries, keys, q, k = tables
    centroids = materialize(vectors.ivf_train(k, 4, method="sample"), "centroids")
    books = vectors.pq_train(cells.residuals(vectors.ivf_assign(k, centroids), centroids), 2, 200, seed=3)
    path = work_folder(spark, "index")
    index.write_index(k, centroids, path, 2, books)
    near = index.search_index(q, path, 5, nprobe=4)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "code:binary" in plan and "key:array" not in plan
    # So many codewords cover all residuals: distances are exact up to rounding.
    exact = {(r["query_id"], r["store"], r["rank"]): r["dist"] for r in vectors.knn_exact(q, k, 5).collect()}
    for r in near.collect():
        assert r["dist"] == pytest.approx(exact[r["query_id"], r["store"], r["rank"]], abs=1e-6)
    again = index.search_index(q, path, 5, nprobe=4, keys=k, shortlist=300)
    assert found(again) == found(vectors.knn_exact(q, k, 5))
    with pytest.raises(ValueError):
        index.search_index_exact(q, path, 5)


def test_index_grows_by_new_keys_and_survives_a_crash(tables, spark, monkeypatch):
    _, _, q, k = tables
    first, path = k.where("entry_id < 200"), work_folder(spark, "index")
    centroids = materialize(vectors.ivf_train(first, 6, method="sample"), "centroids")
    assert index.write_index(first, centroids, path, 2) == 1
    before = found(index.search_index_exact(q, path, 5, keys=first))
    # An addition that breaks off before its manifest is complete leaves the old version in force.
    monkeypatch.setattr(index, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.append_index(k, path)
    monkeypatch.undo()
    index.read_manifest(spark, path).write.json(f"{path}/manifests/2")
    place, system = file_system(spark, f"{path}/manifests/2/_SUCCESS")
    system.delete(place, False)
    assert index.index_versions(spark, path) == [1] and index.index_is_current(spark, path, first)
    assert found(index.search_index_exact(q, path, 5)) == before
    seen = []
    assign = index.ivf_assign
    monkeypatch.setattr(index, "ivf_assign", lambda keys, c: seen.append(keys.count()) or assign(keys, c))
    assert index.append_index(k, path) == 3 and seen == [100]
    assert index.append_index(k, path) == 3 and index.index_is_current(spark, path, k)
    assert found(index.search_index_exact(q, path, 5, keys=k)) == found(vectors.knn_exact(q, k, 5))
    assert found(index.search_index(q, path, 5, nprobe=6)) == found(vectors.knn_exact(q, k, 5))
    assert found(index.search_index(q, path, 5, nprobe=6, version=1)) == before
    with pytest.raises(index.StaleIndex):  # other entries than those indexed
        index.append_index(k.where("entry_id <> 7"), path)
    index.vacuum_index(spark, path)
    assert index.index_versions(spark, path) == [3]
    assert found(index.search_index(q, path, 5, nprobe=6)) == found(vectors.knn_exact(q, k, 5))


def test_rebuilding_under_other_centroids_switches_at_once(tables, spark, monkeypatch):
    _, keys, q, k = tables
    path = work_folder(spark, "index")
    index.write_index(k, vectors.ivf_train(k, 6, method="sample"), path, 2)
    monkeypatch.setattr(index, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.write_index(k, vectors.ivf_train(k, 6, seed=9, method="sample"), path, 2)
    monkeypatch.undo()
    own = k.select(F.col("entry_id").alias("query_id"), F.col("key").alias("embedding")).limit(20)
    first = index.search_index(own, path, 1, nprobe=1, keys=k).where("dist = 0")
    assert first.select("query_id").distinct().count() == 20


def test_keys_are_not_shuffled_for_several_query_blocks(tables, monkeypatch):
    _, _, q, k = tables
    plans = []
    whole = vectors._by_broadcast

    def watched(*args):
        out = whole(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(vectors, "_by_broadcast", watched)
    assert found(vectors.knn_exact(q, k, 7, block=17)) == found(vectors.knn_exact(q, k, 7))
    assert len(plans) >= 3 and not any("Exchange" in plan for plan in plans)


def test_update_neighbours_equals_a_search_of_all(tables):
    _, _, q, k = tables
    amount, best = {"hot": 9, "cold": 4}, None
    for low, high in ((0, 3), (3, 150), (150, 300)):  # at first fewer keys than neighbours
        added = k.where(f"entry_id >= {low} AND entry_id < {high}")
        best = materialize(vectors.update_neighbours(q, best, added, amount), "nearest")
        assert found(best) == found(vectors.knn_exact(q, k.where(f"entry_id < {high}"), amount))


def test_recomputed_distances_move_only_neighbours(tables):
    queries, keys, q, k = tables
    near = vectors.knn_exact(q, k, 3).withColumn("dist", F.lit(-1.0))
    for limit in (10**6, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(vectors, "BROADCAST_IDS", limit)
            patch.setattr(vectors, "PAIRS", 50)
            rows = vectors.recompute_dists(near, q, k).collect()
        assert len(rows) == 300
        for r in rows:
            assert r["dist"] == pytest.approx(((queries[r["query_id"]] - keys[r["entry_id"]]) ** 2).sum())


@pytest.mark.parametrize("pack", [30, 32, 4096])
def test_contexts_are_slices_of_blocks(spark, pack):
    tokens = {i: (i * 37) % 101 for i in range(200)}
    tokens |= {i: i % 7 for i in range(300, 420, 2)}  # ids with gaps
    store = spark.createDataFrame([("s", i, t) for i, t in tokens.items()], "store string, entry_id bigint, token int")
    near = [(i, "s", 1, i, tokens[i]) for i in tokens]
    df = spark.createDataFrame(near, "query_id bigint, store string, rank int, entry_id bigint, token int")
    for given in (store, materialize(vectors.pack_tokens(store, pack), "packed")):
        got = {r["entry_id"]: r["context"] for r in vectors.neighbour_context(df, given, pack=pack).collect()}
        assert got == {i: [tokens[j] for j in range(i - 30, i) if j in tokens] or None if i >= 30 else None for i in tokens}


@pytest.mark.parametrize("search", [vectors.knn_exact, vectors.knn_dot])
def test_many_queries_are_dealt_over_tasks(tables, monkeypatch, search):
    _, _, q, k = tables
    amount = {"hot": 9, "cold": 4}
    direct = sorted(search(q, k, amount).collect())
    monkeypatch.setattr(vectors, "KEY_BLOCK", 17)
    monkeypatch.setattr(vectors, "TASK_QUERIES", 3)
    monkeypatch.setattr(vectors, "_by_rounds", lambda *_: pytest.fail("a job for each block of queries"))
    assert sorted(search(q, k, amount, block=5).collect()) == direct


def test_keys_are_shuffled_to_few_blocks(spark):
    """Lists are short: 200,000 queries are four blocks, so no task more than a wave gets the keys."""
    q = spark.range(200_000).select(F.col("id").alias("query_id"), F.array(F.col("id").cast("float")).alias("embedding"), F.lit(0).alias("cell"))
    k = spark.range(3).select(F.lit("s").alias("store"), F.col("id").alias("entry_id"), F.array(F.lit(0.0)).alias("key"), F.lit(1).alias("token"), F.lit(0).alias("cell"))
    cores = spark.sparkContext.defaultParallelism
    for amount in (16, {f"s@{i}": 8 for i in range(10)}):
        assert vectors._by_blocks(q, k, amount, "l2").rdd.getNumPartitions() == -(-4 // cores) * cores


def test_limits_are_joined_once(tables):
    """An update of many queries counts, deals and searches a written table."""
    _, _, q, k = tables
    best = materialize(vectors.knn_exact(q, k.where("entry_id < 150"), 4), "nearest")
    grown = vectors.update_neighbours(q, best, k.where("entry_id >= 150"), 4, block=1)
    assert "LeftOuter" not in grown._jdf.queryExecution().optimizedPlan().toString()
    assert found(grown) == found(vectors.knn_exact(q, k, 4))


@pytest.mark.parametrize("codes", [False, True])
def test_keys_of_blocks_are_broadcast(tables, monkeypatch, codes):
    """Keys that a worker can hold are not shuffled once a block; larger ones are, with the same result."""
    _, _, q, k = tables
    centroids = vectors.ivf_train(k, 4, method="sample")
    assigned = vectors.ivf_assign(k.unionByName(k.where("entry_id < 20")), centroids)
    books = vectors.pq_train(k, 2, 9, seed=3)
    coded = vectors.pq_encode(assigned, books)
    monkeypatch.setattr(vectors, "KEY_BLOCK", 17)
    monkeypatch.setattr(vectors, "TASK_QUERIES", 3)
    for amount in (7, {"hot": 9, "cold": 4}):
        got = []
        for most in (0, 1 << 28):
            monkeypatch.setattr(vectors, "SHARED_BYTES", most)
            monkeypatch.setattr(vectors, "COPIED_BYTES", 0)
            some = vectors.pq_search(q, coded, books, centroids, amount, 3) if codes else vectors.ivf_search(q, assigned, centroids, amount, 3)
            # Keys go to the blocks that probe them, or stay out of the plan.
            assert ("_blocks" in some._jdf.queryExecution().executedPlan().toString()) == (most == 0)
            got.append(found(some))
        assert got[0] == got[1] and len(got[0]) > 100


def test_exact_distances_without_a_shuffle(tables, monkeypatch):
    """Neighbours are measured where they lie; repeated, missing and unknown ids as in a join."""
    _, _, q, k = tables
    near = vectors.knn_exact(q, k, 3).withColumn("dist", F.lit(-1.0))
    odd = near.withColumn("entry_id", F.when(F.col("rank") == 2, None).when(F.col("rank") == 3, -5).otherwise(F.col("entry_id")))
    near = materialize(near.unionByName(odd).unionByName(near.limit(5).withColumn("query_id", F.lit(-1).cast("bigint"))), "near")
    for keys in (k.unionByName(k.where("entry_id % 2 = 0")), k.drop("store")):
        got = []
        for most in (0, 1 << 28):
            monkeypatch.setattr(vectors, "SHARED_BYTES", most)
            some = vectors.recompute_dists(near, q, keys)
            assert ("Exchange" in some._jdf.queryExecution().executedPlan().toString()) == (most == 0)
            got.append(sorted(map(tuple, some.collect())))
        assert got[0] == got[1] and len(got[0]) > 300


def test_packed_tokens_move_as_lists(spark):
    """Entries in any order, with gaps, repeated ids and nulls; neighbouring ones are put together before they move."""
    rng = np.random.default_rng(5)
    rows = [("a", int(i), int(i) % 9) for i in rng.permutation(300)] + [("b", int(i), 1) for i in range(7, 200, 3)] + [("b", 10, 0), (None, 4, 4), ("a", None, 3), ("b", 11, None)]
    store = spark.createDataFrame(rows, "store string, entry_id bigint, token int").repartition(3)
    got = {(r["store"], r["block"]): (r["ids"], r["tokens"]) for r in vectors.pack_tokens(store, 64).collect()}
    want = {}
    for s, i, t in sorted(rows, key=lambda r: (r[0] or "", -1 if r[1] is None else r[1], -1 if r[2] is None else r[2])):
        ids, tokens = want.setdefault((s, None if i is None else i // 64), ([], []))
        ids.append(i)
        tokens.append(t)
    assert got == want
    whole = spark.range(20_000).select(F.lit("s").alias("store"), F.col("id").alias("entry_id"), F.lit(1).alias("token")).coalesce(1)
    pieces = whole.withColumn("block", F.expr("entry_id div 4096")).select("store", "block", "entry_id", "token").mapInArrow(vectors._pieces, vectors._PIECES).collect()
    assert len(pieces) < 12 and all(p["ids"] is None for p in pieces) and sum(len(p["tokens"]) for p in pieces) == 20_000
