"""Nearest-neighbour joins, exact and approximate."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindstore.catalog.registry import part, query, r6, rounded
from kindstore.operators import cells, vectors
from kindstore.session import materialize, work_folder
from kindstore.sources import index

# 13 of 16 probes: at least 0.9 of the exact neighbours on every scale (query recall_at_k).
K, OTHER_K, CELLS, PROBES = 16, 32, 16, 13
SUBSPACES, CODES, SHORTLIST = 32, 64, 128

part(
    "key_pairs",
    """
SELECT query_id, store, stage, entry_id, token, pow(list_distance(embedding, key), 2) AS dist FROM queries CROSS JOIN store_keys""",
)


def ranked(source: str, order: str = "dist, entry_id", by: str = "query_id, store") -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS INTEGER) AS rank FROM {source}"


part("near_all", ranked("key_pairs"))
FOUND = f"query_id, store, rank, entry_id, {r6('dist', 'dist')}, token"


@query("knn_exact", f"SELECT {FOUND} FROM near_all WHERE rank <= {K}")
def knn_exact(t):
    return rounded(vectors.knn_exact(t.queries, t.keys, K))


@query("knn_exact_blocks", f"SELECT {FOUND} FROM near_all WHERE rank <= {K}")
def knn_exact_blocks(t):
    """The path taken when the queries do not fit one block."""
    return rounded(vectors.knn_exact(t.queries, t.keys, K, block=128))


DEEP = 1024


@query("knn_exact_deep", f"SELECT {FOUND} FROM near_all WHERE rank <= {DEEP}")
def knn_exact_deep(t):
    """The default number of neighbours."""
    return rounded(vectors.knn_exact(t.queries, t.keys, DEEP))


part("dot_pairs", "SELECT query_id, store, entry_id, token, list_inner_product(embedding, key) AS dist FROM queries CROSS JOIN store_keys")
part("near_dot", ranked("dot_pairs", "dist DESC, entry_id"))


@query("knn_dot", f"SELECT {FOUND} FROM near_dot WHERE rank <= {K}")
def knn_dot(t):
    return rounded(vectors.knn_dot(t.queries, t.keys, K))


part("near", f"SELECT * FROM near_all WHERE rank <= CASE store WHEN 'toxic' THEN {K} ELSE {OTHER_K} END")


@query("two_store_retrieve", f"SELECT {FOUND} FROM near")
def two_store_retrieve(t):
    return rounded(vectors.two_store_retrieve(t.queries, t.keys, K, OTHER_K))


part(
    "centroids",
    f"""
SELECT CAST(row_number() OVER (ORDER BY md5('1:'||entry_id), entry_id) - 1 AS INTEGER) AS cell, key AS centroid
FROM (SELECT * FROM store_keys ORDER BY md5('1:'||entry_id), entry_id LIMIT {CELLS})""",
)
part(
    "assigned",
    """
SELECT * EXCLUDE (r, gap) FROM (
  SELECT k.*, c.cell, list_distance(k.key, c.centroid) AS gap, row_number() OVER (PARTITION BY entry_id ORDER BY list_distance(k.key, c.centroid), cell) AS r
  FROM store_keys k CROSS JOIN centroids c) WHERE r = 1""",
)
part(
    "probes",
    f"""
SELECT query_id, embedding, cell FROM (
  SELECT q.*, c.cell, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(q.embedding, c.centroid), cell) AS r
  FROM queries q CROSS JOIN centroids c) WHERE r <= {PROBES}""",
)
part(
    "ivf_pairs",
    "SELECT query_id, store, entry_id, token, pow(list_distance(embedding, key), 2) AS dist FROM probes JOIN assigned USING (cell)",
)
part("near_ivf", ranked("ivf_pairs"))


def centroids(t):
    return vectors.ivf_train(t.keys, CELLS, method="sample")


def assigned(t):
    return vectors.ivf_assign(t.keys, centroids(t))


def _joined(column, digits=4):
    return F.array_join(F.transform(column, lambda x: F.round(x.cast("double") * 10**digits).cast("bigint")), ",")


@query(
    "ivf_train",
    "SELECT cell, array_to_string(list_transform(centroid, lambda x: CAST(round(x * 10000) AS BIGINT)), ',') AS centroid FROM centroids",
)
def ivf_train(t):
    return centroids(t).select("cell", _joined("centroid").alias("centroid"))


@query("ivf_train_kmeans")
def ivf_train_kmeans(t):
    """Cell sizes of a k-means trained inverted file."""
    trained = vectors.ivf_train(t.keys, CELLS)
    return vectors.ivf_assign(t.keys, trained).groupBy("cell").agg(F.count("*").alias("n"))


def _squared(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x)


def _errors(keys, trained):
    """Squared distances of keys to their own centre and to the nearest one, over a table of few centres."""
    centres = [r["centroid"] for r in trained.orderBy("cell").collect()]
    key = F.col("key").cast("array<double>")
    every = F.array(*[_squared(key, F.array(*[F.lit(float(x)) for x in c])) for c in centres])
    cells = vectors.ivf_assign(keys, trained).withColumn("_every", every)
    return cells.select(F.get("_every", F.col("cell")).alias("own"), F.array_min("_every").alias("least"))


@query("kmeans_invariants", "SELECT count(*) AS n, true AS nearest, true AS better FROM store_keys")
def kmeans_invariants(t):
    """Each key lies in the cell of its nearest k-means centre, and k-means leaves less error than sampled centres."""
    few = CELLS // 4  # the distances to all centres are spelled out
    trained = _errors(t.keys, materialize(vectors.ivf_train(t.keys, few), "centroids"))
    sampled = _errors(t.keys, materialize(vectors.ivf_train(t.keys, few, method="sample"), "centroids"))
    error = sampled.agg(F.sum("own").alias("sampled"))
    return (
        trained.agg(F.count("*").alias("n"), F.max(F.col("own") - F.col("least")).alias("gap"), F.sum("own").alias("error"))
        .join(F.broadcast(error))
        .select("n", (F.col("gap") < 1e-9).alias("nearest"), (F.col("error") <= F.col("sampled")).alias("better"))
    )


@query("ivf_assign", "SELECT entry_id, store, cell FROM assigned")
def ivf_assign(t):
    return assigned(t).select("entry_id", "store", "cell")


@query("ivf_search", f"SELECT {FOUND} FROM near_ivf WHERE rank <= {K}")
def ivf_search(t):
    return rounded(vectors.ivf_search(t.queries, assigned(t), centroids(t), K, PROBES))


def _index(t, keys):
    path = work_folder(t.spark, "index")
    index.write_index(keys, centroids(t), path, CELLS // 4)
    return path


@query("write_index", f"SELECT {FOUND} FROM near_ivf WHERE rank <= {K}")
def write_index(t):
    """The same search from a stored index, in folders of cells."""
    return rounded(index.search_index(t.queries, _index(t, t.keys), K, PROBES, t.keys))


@query("append_invalidates_index", "SELECT store, count(*) AS n, count(*) = count(*) FILTER (stage = 0) AS is_current FROM store_keys GROUP BY store")
def append_invalidates_index(t):
    """An index of the first stage fits each store only until later stages are added."""
    first = t.keys.where("stage = 0")
    path = _index(t, first)
    sizes = index.read_manifest(t.spark, path).select("store", F.col("n").alias("_indexed"))
    now = t.keys.groupBy("store").agg(F.count("*").alias("n"))
    fits = index.index_is_current(t.spark, path, first) and not index.index_is_current(t.spark, path, t.keys)
    if not fits:
        raise ValueError("the index must fit its own stage only")
    return now.join(sizes, "store", "left").select(
        "store", "n", (F.coalesce("_indexed", F.lit(0)) == F.col("n")).alias("is_current")
    )


@query("ivf_search_bounded", f"SELECT {FOUND} FROM near_all WHERE rank <= {K}")
def ivf_search_bounded(t):
    """The exact neighbours, cell by cell until the bounds of the rest are beyond them."""
    keys = materialize(assigned(t), "assigned")
    radii = cells.cell_radii(keys, centroids(t))
    return rounded(cells.ivf_search_bounded(t.queries, keys, centroids(t), radii, K, first=2))


@query(
    "cell_radii",
    f"""
SELECT a.store, a.cell, {r6("max(list_distance(a.key, c.centroid))", "radius")}, count(*) AS n
FROM assigned a JOIN centroids c USING (cell) GROUP BY a.store, a.cell""",
)
def cell_radii(t):
    return rounded(cells.cell_radii(assigned(t), centroids(t)))


part(
    "cell_turns",
    """
SELECT q.query_id, c.cell, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(q.embedding, c.centroid), cell) AS nprobe
FROM queries q CROSS JOIN centroids c""",
)
part(
    "reached",
    f"""
SELECT store, nprobe, sum(n) OVER (PARTITION BY store ORDER BY nprobe) / sum(n) OVER (PARTITION BY store) AS recall FROM (
  SELECT n.store, c.nprobe, count(*) AS n FROM (SELECT * FROM near_all WHERE rank <= {K}) n
  JOIN assigned a USING (store, entry_id) JOIN cell_turns c ON c.query_id = n.query_id AND c.cell = a.cell GROUP BY n.store, c.nprobe)""",
)


@query("probes_for_recall", f"SELECT store, CAST(min(nprobe) AS INTEGER) AS nprobe, {r6('min(recall)', 'recall')} FROM reached WHERE recall >= 0.9 GROUP BY store")
def probes_for_recall(t):
    """How many cells a search must probe to find nine of ten exact neighbours."""
    keys = materialize(assigned(t), "assigned")
    exact = vectors.knn_exact(t.queries, t.keys, K)
    return rounded(cells.probes_for_recall(t.queries, keys, centroids(t), exact, 0.9))


_half = "entry_id < (SELECT count(*) // 2 FROM store_keys)"
part(
    "half_centroids",
    f"""
SELECT CAST(row_number() OVER (ORDER BY md5('1:'||entry_id), entry_id) - 1 AS INTEGER) AS cell, key AS centroid
FROM (SELECT * FROM store_keys WHERE {_half} ORDER BY md5('1:'||entry_id), entry_id LIMIT {CELLS})""",
)
part(
    "half_assigned",
    """
SELECT * EXCLUDE (r) FROM (
  SELECT k.*, c.cell, row_number() OVER (PARTITION BY entry_id ORDER BY list_distance(k.key, c.centroid), cell) AS r
  FROM store_keys k CROSS JOIN half_centroids c) WHERE r = 1""",
)
part(
    "half_probes",
    f"""
SELECT query_id, embedding, cell FROM (
  SELECT q.*, c.cell, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(q.embedding, c.centroid), cell) AS r
  FROM queries q CROSS JOIN half_centroids c) WHERE r <= {PROBES}""",
)
part(
    "half_pairs",
    "SELECT query_id, store, entry_id, token, pow(list_distance(embedding, key), 2) AS dist FROM half_probes JOIN half_assigned USING (cell)",
)
part("near_half", ranked("half_pairs"))


@query("append_index", f"SELECT {FOUND} FROM near_half WHERE rank <= {K}")
def append_index(t):
    """An index of the first half of the entries, the others added to its cells, searched at its newest version."""
    first = t.keys.where(F.col("entry_id") < F.lit(t.keys.count() // 2))
    path = work_folder(t.spark, "index")
    index.write_index(first, vectors.ivf_train(first, CELLS, method="sample"), path, CELLS // 4)
    index.append_index(t.keys, path)
    return rounded(index.search_index(t.queries, path, K, PROBES, t.keys))


part(
    "subspaces",
    f"SELECT unnest(range({SUBSPACES})) AS subspace",
)
WIDTH = 64 // SUBSPACES
PIECE = f"[subspace * {WIDTH} + 1 : (subspace + 1) * {WIDTH}]"
part(
    "codebooks",
    f"""
SELECT subspace, code, key{PIECE} AS codeword FROM subspaces CROSS JOIN (
  SELECT row_number() OVER (ORDER BY md5('1:'||entry_id), entry_id) - 1 AS code, key FROM store_keys) WHERE code < {CODES}""",
)
part(
    "key_codes",
    f"""
SELECT entry_id, store, token, subspace, code FROM (
  SELECT k.entry_id, k.store, k.token, b.subspace, b.code,
         row_number() OVER (PARTITION BY entry_id, subspace ORDER BY list_distance(k.key{PIECE}, b.codeword), code) AS r
  FROM store_keys k CROSS JOIN codebooks b) WHERE r = 1""",
)
part(
    "query_tables",
    f"SELECT query_id, subspace, code, pow(list_distance(embedding{PIECE}, codeword), 2) AS part FROM queries CROSS JOIN codebooks",
)
part(
    "pq_pairs",
    """
SELECT p.query_id, k.store, k.entry_id, k.token, list_sum(list(t.part ORDER BY t.subspace)) AS dist
FROM probes p JOIN assigned a USING (cell) JOIN key_codes k USING (entry_id) JOIN query_tables t USING (query_id, subspace, code) GROUP BY ALL""",
)
part("near_pq", ranked("pq_pairs", "round(dist, 10), entry_id"))
part(
    "pq_shortlist",
    f"SELECT query_id, store, entry_id, e.token, e.dist FROM near_pq n JOIN key_pairs e USING (query_id, store, entry_id) WHERE n.rank <= {SHORTLIST}",
)
part("pq_exact", ranked("pq_shortlist"))


def codebooks(t):
    return vectors.pq_train(t.keys, SUBSPACES, CODES, method="sample")


def encoded(t):
    return vectors.pq_encode(t.keys, codebooks(t))


def _pq(t, k=K):
    with_cells = vectors.ivf_assign(encoded(t).drop("cell"), centroids(t))
    return vectors.pq_search(t.queries, with_cells, codebooks(t), centroids(t), k, PROBES)


@query("pq_encode", "SELECT entry_id, string_agg(code, ',' ORDER BY subspace) AS codes FROM key_codes GROUP BY entry_id")
def pq_encode(t):
    return encoded(t).select("entry_id", F.array_join("codes", ",").alias("codes"))


@query("pq_train_kmeans")
def pq_train_kmeans(t):
    """How many keys use each code of k-means trained codebooks."""
    books = vectors.pq_train(t.keys, SUBSPACES, CODES)
    codes = vectors.pq_encode(t.keys, books).select(F.posexplode("codes").alias("subspace", "code"))
    return codes.groupBy("subspace", "code").agg(F.count("*").alias("n"))


@query("pq_invariants", f"SELECT count(*) AS n, {SUBSPACES} AS parts, true AS better FROM store_keys")
def pq_invariants(t):
    """Trained codebooks leave less error than sampled ones, over all keys and parts."""
    width = WIDTH

    def error(books):
        books = materialize(books, "codebooks")
        coded = vectors.pq_encode(t.keys, books).select("key", F.posexplode("codes").alias("subspace", "code"))
        piece = F.slice(F.col("key").cast("array<double>"), F.col("subspace") * width + 1, F.lit(width))
        found = coded.join(F.broadcast(books), ["subspace", "code"])  # subspaces x codes rows
        return found.select("subspace", _squared(piece, F.col("codeword")).alias("gap"))

    trained = error(vectors.pq_train(t.keys, SUBSPACES, CODES)).agg(
        (F.count("*") / F.count_distinct("subspace")).cast("bigint").alias("n"),
        F.count_distinct("subspace").cast("int").alias("parts"),
        F.sum("gap").alias("error"),
    )
    sampled = error(codebooks(t)).agg(F.sum("gap").alias("sampled"))
    return trained.join(F.broadcast(sampled)).select("n", "parts", (F.col("error") <= F.col("sampled")).alias("better"))


@query("pq_distances", f"SELECT {FOUND} FROM near_pq WHERE rank <= {K}")
def pq_distances(t):
    """Neighbours by codes alone."""
    return rounded(_pq(t))


@query("pq_search", f"SELECT {FOUND} FROM pq_exact WHERE rank <= {K}")
def pq_search(t):
    """A shortlist by codes, measured again on the keys."""
    return rounded(cells.rerank(materialize(_pq(t, SHORTLIST), "shortlist"), t.queries, t.keys, K))


@query(
    "recompute_dists",
    f"""
SELECT query_id, store, n.rank, entry_id, n.token, {r6("e.dist", "dist")}
FROM near_pq n JOIN key_pairs e USING (query_id, store, entry_id) WHERE n.rank <= {K}""",
)
def recompute_dists(t):
    return rounded(vectors.recompute_dists(materialize(_pq(t), "neighbours"), t.queries, t.keys))


@query(
    "recall_at_k",
    f"""
SELECT store, {r6("avg(CASE WHEN i.entry_id IS NULL THEN 0.0 ELSE 1.0 END)", "recall")}
FROM (SELECT * FROM near_all WHERE rank <= {K}) e LEFT JOIN (SELECT * FROM near_ivf WHERE rank <= {K}) i USING (query_id, store, entry_id)
GROUP BY store""",
)
def recall_at_k(t):
    found = vectors.ivf_search(t.queries, assigned(t), centroids(t), K, PROBES)
    return rounded(vectors.recall_at_k(found, vectors.knn_exact(t.queries, t.keys, K), K))


part(
    "residual_keys",
    """
SELECT a.entry_id, a.store, a.token, a.cell, list_transform(range(1, 65), lambda i: a.key[i] - c.centroid[i]) AS key
FROM assigned a JOIN centroids c USING (cell)""",
)
part(
    "residual_books",
    f"""
SELECT subspace, code, key{PIECE} AS codeword FROM subspaces CROSS JOIN (
  SELECT row_number() OVER (ORDER BY md5('1:'||entry_id), entry_id) - 1 AS code, key FROM residual_keys) WHERE code < {CODES}""",
)
part(
    "residual_codes",
    f"""
SELECT entry_id, store, token, cell, subspace, code FROM (
  SELECT k.entry_id, k.store, k.token, k.cell, b.subspace, b.code,
         row_number() OVER (PARTITION BY entry_id, subspace ORDER BY list_distance(k.key{PIECE}, b.codeword), code) AS r
  FROM residual_keys k CROSS JOIN residual_books b) WHERE r = 1""",
)
part(
    "residual_probes",
    """
SELECT p.query_id, p.cell, list_transform(range(1, 65), lambda i: p.embedding[i] - c.centroid[i]) AS embedding
FROM probes p JOIN centroids c USING (cell)""",
)
part(
    "residual_tables",
    f"SELECT query_id, cell, subspace, code, pow(list_distance(embedding{PIECE}, codeword), 2) AS part FROM residual_probes CROSS JOIN residual_books",
)
part(
    "residual_pairs",
    """
SELECT t.query_id, k.store, k.entry_id, k.token, list_sum(list(t.part ORDER BY t.subspace)) AS dist
FROM residual_codes k JOIN residual_tables t USING (cell, subspace, code) GROUP BY t.query_id, k.store, k.entry_id, k.token""",
)
part("near_residual", ranked("residual_pairs", "round(dist, 10), entry_id"))
part(
    "residual_shortlist",
    f"SELECT query_id, store, entry_id, e.token, e.dist FROM near_residual n JOIN key_pairs e USING (query_id, store, entry_id) WHERE n.rank <= {SHORTLIST}",
)
part("residual_exact", ranked("residual_shortlist"))


def _compressed(t):
    trained = centroids(t)
    books = vectors.pq_train(cells.residuals(assigned(t), trained), SUBSPACES, CODES, method="sample")
    path = work_folder(t.spark, "index")
    index.write_index(t.keys, trained, path, CELLS // 4, books)
    return path


@query("pq_index", f"SELECT {FOUND} FROM near_residual WHERE rank <= {K}")
def pq_index(t):
    """Neighbours from a stored index of residual codes; no key is read."""
    return rounded(index.search_index(t.queries, _compressed(t), K, PROBES))


@query("pq_index_reranked", f"SELECT {FOUND} FROM residual_exact WHERE rank <= {K}")
def pq_index_reranked(t):
    return rounded(index.search_index(t.queries, _compressed(t), K, PROBES, t.keys, SHORTLIST))


part("all_found", "\nUNION ALL\n".join(f"SELECT '{n}' AS search, query_id, store, entry_id FROM {p} WHERE rank <= {K}" for n, p in (
    ("ivf", "near_ivf"), ("append", "near_half"), ("pq", "pq_exact"), ("pq_index", "residual_exact"))))


@query(
    "index_recall",
    f"""
SELECT i.search, e.store, {r6(f"count(*) / (SELECT count(*) FROM near_all n WHERE n.rank <= {K} AND n.store = e.store)", "recall")}
FROM (SELECT * FROM near_all WHERE rank <= {K}) e JOIN all_found i USING (query_id, store, entry_id) GROUP BY i.search, e.store""",
)
def index_recall(t):
    """What each index query finds of the exact neighbours."""
    exact = materialize(vectors.knn_exact(t.queries, t.keys, K), "exact")
    searches = {"ivf": ivf_search, "append": append_index, "pq": pq_search, "pq_index": pq_index_reranked}
    out = None
    for name, search in searches.items():
        one = vectors.recall_at_k(search(t), exact, K).withColumn("search", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out)
