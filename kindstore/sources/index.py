"""A stored vector index: keys, or codes of them, by cell in Parquet folders that a search prunes.

Layout below the path: ``models/<id>`` (centroids, and codebooks of a compressed index),
``keys/part=<id>`` (keys or codes in folders of store and neighbouring cells), ``radii/part=<id>``
(of the cells), ``manifests/<version>`` (a row for each part and store). A version is committed by writing its
manifest last, and a reader takes the newest one that is complete: a build or an addition that broke
off is never seen, and a search that has begun keeps its own version. Adding keys assigns the new ones only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindstore.operators.cells import cell_radii, code_search, ivf_search_bounded, rerank, residual_codes
from kindstore.operators.vectors import Amount, ivf_assign, ivf_search, probe_cells
from kindstore.session import exists, file_system, folders_in, materialize

# Cells of one folder: with 4096 cells 256 folders a store, whose files stay large.
BUCKET_CELLS = 16
MANIFEST = "model string, part string, compressed boolean, bucket_cells int, store string, n bigint, first bigint, last bigint"


class StaleIndex(ValueError):
    """The datastore has other entries than those the index was built of."""


def _sizes(keys: DataFrame) -> DataFrame:
    span = (F.min("entry_id").alias("first"), F.max("entry_id").alias("last"))
    return keys.groupBy("store").agg(F.count("*").alias("n"), *span)


def index_versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, old to new."""
    names = folders_in(spark, f"{path}/manifests")
    return sorted(int(n) for n in names if n.isdigit() and exists(spark, f"{path}/manifests/{n}/_SUCCESS"))


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A row for each part and store of a version, the newest by default."""
    versions = index_versions(spark, path)
    if not versions or (version is not None and version not in versions):
        raise StaleIndex(f"there is no complete index at {path}")
    return spark.read.schema(MANIFEST).json(f"{path}/manifests/{versions[-1] if version is None else version}")


def _commit(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Write the next version; two writers of the same one can't both succeed."""
    version = max([0, *(int(n) for n in folders_in(spark, f"{path}/manifests") if n.isdigit())]) + 1
    rows.select(*[c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1).write.json(f"{path}/manifests/{version}")
    return version


def _write_part(keys: DataFrame, path: str, model: str, bucket_cells: int, compressed: bool) -> DataFrame:
    """Assign keys to the cells of a model and write them as a part; its manifest rows, not committed yet."""
    spark, part = keys.sparkSession, uuid.uuid4().hex
    centroids = spark.read.parquet(f"{path}/models/{model}/centroids")
    cells = ivf_assign(keys.select("store", "entry_id", "key", "token"), centroids)
    cells = materialize(cells, "assigned")
    cell_radii(cells, centroids).write.parquet(f"{path}/radii/part={part}")
    if compressed:
        cells = residual_codes(cells, centroids, spark.read.parquet(f"{path}/models/{model}/codebooks"))
    placed = cells.withColumn("bucket", F.floor(F.col("cell") / bucket_cells).cast("int"))
    placed.sortWithinPartitions("store", "bucket").write.partitionBy("store", "bucket").parquet(f"{path}/keys/part={part}")
    return _sizes(keys).select(
        F.lit(model).alias("model"), F.lit(part).alias("part"), F.lit(compressed).alias("compressed"),
        F.lit(bucket_cells).alias("bucket_cells"), "store", "n", "first", "last",
    )


def write_index(
    keys: DataFrame, centroids: DataFrame, path: str, bucket_cells: int = BUCKET_CELLS, codebooks: DataFrame | None = None
) -> int:
    """Build an index of all keys, and make it the newest version.

    Every key is assigned to its cell once. With ``codebooks`` (trained on ``cells.residuals``) files hold a byte for each part of a key
    in place of the key. Returns the version.
    """
    model = uuid.uuid4().hex
    centroids.write.parquet(f"{path}/models/{model}/centroids")
    if codebooks is not None:
        codebooks.write.parquet(f"{path}/models/{model}/codebooks")
    return _commit(keys.sparkSession, path, _write_part(keys, path, model, bucket_cells, codebooks is not None))


def append_index(keys: DataFrame, path: str) -> int:
    """Add what a datastore has beyond the index: only those keys are assigned, to the cells there are.

    ``keys`` is the datastore as it is now. Entries are appended behind the others, so
    the new ones of a store are those beyond the last indexed id; if the others are not those
    that were indexed (by number and range of ids), ``StaleIndex`` is raised. Returns the version, a new
    one unless there is nothing new.
    """
    spark = keys.sparkSession
    manifest = materialize(read_manifest(spark, path), "manifest")
    known = manifest.groupBy("store").agg(F.sum("n").alias("_n"), F.min("first").alias("_first"), F.max("last").alias("_last"))
    # A row a store.
    beside = keys.join(F.broadcast(known), "store", "left")
    old = _sizes(beside.where("entry_id <= _last"))
    changed = known.join(old, "store", "left").where("NOT (n <=> _n AND first <=> _first AND last <=> _last)")
    if not changed.isEmpty():
        raise StaleIndex(f"the index at {path} holds entries that its datastore no longer has")
    new = beside.where("_last IS NULL OR entry_id > _last").select("store", "entry_id", "key", "token")
    if new.isEmpty():
        return index_versions(spark, path)[-1]
    head = manifest.first()
    rows = _write_part(new, path, head["model"], head["bucket_cells"], head["compressed"])
    return _commit(spark, path, manifest.unionByName(rows))


def index_is_current(spark: SparkSession, path: str, keys: DataFrame) -> bool:
    """Whether the newest version holds as many entries of each store as ``keys`` has now, with the same ends.

    A row a store is compared; a datastore only grows, or is written anew.
    """
    if not index_versions(spark, path):
        return False
    parts = read_manifest(spark, path).groupBy("store").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    now = _sizes(keys).select(parts.columns)
    return parts.unionAll(now).groupBy(*parts.columns).count().where("count <> 2").isEmpty()


def vacuum_index(spark: SparkSession, path: str) -> None:
    """Remove parts, models and manifests that the newest version does not use; searches of older ones fail then."""
    newest = read_manifest(spark, path)
    version = index_versions(spark, path)[-1]
    parts = {f"part={r['part']}" for r in newest.select("part").distinct().collect()}
    used = {"keys": parts, "radii": parts, "models": {newest.first()["model"]}, "manifests": {str(version)}}
    for kind, names in used.items():
        for name in folders_in(spark, f"{path}/{kind}"):
            if name not in names:
                place, system = file_system(spark, f"{path}/{kind}/{name}")
                system.delete(place, True)


def _opened(spark: SparkSession, path: str, keys: DataFrame | None, version: int | None) -> tuple:
    if keys is not None and not index_is_current(spark, path, keys):
        raise StaleIndex(f"the index at {path} is missing or older than its datastore")
    manifest = read_manifest(spark, path, version)
    head = manifest.first()
    parts = sorted(r["part"] for r in manifest.select("part").distinct().collect())

    def committed(kind: str) -> DataFrame:
        """Folders of this version's parts, and no others."""
        return spark.read.option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/part={part}" for part in parts])

    rows = committed("keys").withColumn("store", F.col("store").cast("string"))
    return head, rows, committed("radii"), f"{path}/models/{head['model']}"


def search_index(
    queries: DataFrame,
    path: str,
    k: Amount = 1024,
    nprobe: int = 32,
    keys: DataFrame | None = None,
    shortlist: int | None = None,
    version: int | None = None,
) -> DataFrame:
    """Nearest neighbours within the probed cells of a stored index.

    Only folders with a probed cell are read, and no key is assigned again. With
    ``keys`` (the datastore as it is now) an index that no longer fits it raises
    ``StaleIndex``. A compressed index gives distances from its codes, unless a
    ``shortlist`` is asked for: then so many of each store are found by codes and measured
    again on ``keys``, and the ``k`` best of them returned.
    """
    spark = queries.sparkSession
    head, rows, _, model = _opened(spark, path, keys, version)
    centroids = spark.read.parquet(f"{model}/centroids")
    probes = materialize(probe_cells(queries, centroids, nprobe), "probes")
    bucket = F.floor(F.col("cell") / head["bucket_cells"]).cast("int")
    # At most one number for each folder of the index.
    folders = [row["b"] for row in probes.select(bucket.alias("b")).distinct().collect()]
    near = rows.where(F.col("bucket").isin(folders))
    if not head["compressed"]:
        return ivf_search(queries, near, centroids, k, nprobe, probes)
    found = code_search(queries, near, centroids, spark.read.parquet(f"{model}/codebooks"), shortlist or k, nprobe, probes)
    if shortlist is None:
        return found
    if keys is None:
        raise ValueError("a shortlist is measured on the keys: give them")
    return rerank(materialize(found, "shortlist"), queries, keys, k)


def search_index_exact(queries: DataFrame, path: str, k: Amount = 1024, keys: DataFrame | None = None) -> DataFrame:
    """The exact neighbours, from as few cells of a stored index as the bounds of its cells allow."""
    head, rows, radii, model = _opened(queries.sparkSession, path, keys, None)
    if head["compressed"]:
        raise ValueError("a compressed index has no keys to measure")
    return ivf_search_bounded(queries, rows, queries.sparkSession.read.parquet(f"{model}/centroids"), radii, k)
