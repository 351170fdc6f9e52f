"""Result folders whose names carry the parameters of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindstore.operators.texts import remap_values
from kindstore.operators.results import METRIC_NAMES

TOXICITY = T.StructType(
    [T.StructField("metric", T.StringType())]
    + [T.StructField(m, T.DoubleType()) for m in ("toxic", "nontoxic", "full")]
)
DIVERSITY = T.StructType([T.StructField(f"dist{n}", T.DoubleType()) for n in (1, 2, 3)])
PERPLEXITY = T.StructType([T.StructField(m, T.DoubleType()) for m in ("toxic", "nontoxic", "full")])
SCHEMAS = {"toxicity": TOXICITY, "diversity": DIVERSITY, "perplexity": PERPLEXITY}


def folder_parameters(folder: Column) -> Column:
    """``a=1_b=2`` as a map; other folder names give an empty map."""
    return _latest(_parameters(folder))


def _parameters(folder: Column) -> Column:
    """Name and value of each ``a=1`` of a folder, or of a folder ``a_1`` with one number."""
    pairs = F.filter(F.split(folder, "_"), lambda p: p.contains("="))
    named = F.transform(
        pairs,
        lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("key"), F.split_part(p, F.lit("="), F.lit(2)).alias("value")),
    )
    number = r"^([A-Za-z][A-Za-z_]*)_(-?[0-9]+(?:\.[0-9]+)?)$"
    single = F.struct(F.regexp_extract(folder, number, 1).alias("key"), F.regexp_extract(folder, number, 2).alias("value"))
    return F.when(F.size(named) > 0, named).when(folder.rlike(number), F.array(single)).otherwise(F.slice(F.array(single), 1, 0))


def _latest(entries: Column) -> Column:
    """A map of the entries, the last one of each key."""
    last = F.filter(
        entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"])
    )
    return F.map_from_entries(last)


def _place(df: DataFrame, root: str, depth: int) -> DataFrame:
    """Adds ``run``, ``file``, ``parameters`` and ``rtp`` from the ``_path`` of each row.

    A folder ``RTP`` below a run holds its results on the other prompts; it is not
    a run of its own. Parameters come from all folders between ``root`` and the
    file, the deeper ones first in line.
    """
    tail = root.split("://")[-1].removeprefix("file:").rstrip("/")
    below = F.element_at(F.split("_path", F.lit(r"\Q" + tail + r"\E"), 2), -1)
    parts = F.filter(F.split(below, "/"), lambda p: p != "")
    # A distributed writer puts part files into a folder named like the file.
    parts = F.when(F.element_at(parts, -1).startswith("part-"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    rtp = F.coalesce(F.try_element_at(folders, F.lit(-1)) == "RTP", F.lit(False))
    df = df.withColumn("file", F.element_at(parts, -1)).withColumn("rtp", rtp)
    df = df.withColumn("_folders", F.filter(folders, lambda p: p != "RTP"))
    entries = F.flatten(F.transform("_folders", _parameters))
    return df.withColumn("run", F.try_element_at("_folders", F.lit(-depth))).withColumn("parameters", _latest(entries)).drop(
        "_folders", "_path"
    )


def scan_results(spark: SparkSession, root: str, metric: str, depth: int = 1) -> DataFrame:
    """All ``*<metric>*.csv`` below ``root``, long, with the run's folder and parameters.

    ``depth`` counts folders upwards from the file (or from the folder a
    distributed writer put its part files in); parameters come from all folders
    below ``root``, and ``rtp`` tells results in a folder ``RTP``. Files of groups
    are left to ``scan_grouped_results``.
    """
    df = (
        spark.read.schema(SCHEMAS[metric])
        .option("header", True)
        .option("enforceSchema", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(root)
        .select("*", F.col("_metadata.file_path").alias("_path"))
    )
    df = _place(df, root, depth).where(F.col("file").contains(metric) & ~F.col("file").contains("groupby")).drop("file")
    ids = ["run", "parameters", "rtp"]
    ids += ["metric"] if metric == "toxicity" else []
    values = [c for c in SCHEMAS[metric].names if c not in ids]
    long = df.unpivot(ids, values, "mode", "value")
    if metric == "toxicity":
        long = remap_values(long.where("metric <> 'std_max'"), "metric", METRIC_NAMES)
    else:
        long = long.withColumn("metric", F.lit(metric))
    return long.select("run", "parameters", "rtp", "metric", "mode", "value")


def scan_grouped_results(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """All ``*groupby*`` result files below ``root``, long: ``run, parameters, rtp, metric, mode, group, value``.

    Such a file has two header rows, the mode and the group of each column. A file
    is read as one text: it holds a handful of rows.
    """
    df = (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True)
        .select("value", F.col("_metadata.file_path").alias("_path"))
    )
    df = _place(df, root, depth).where(F.col("file").contains("groupby")).drop("file")
    rows = F.filter(F.split("value", r"\r?\n"), lambda line: line != "")

    def cells(line: Column) -> Column:
        found = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
        return F.transform(found, lambda c: F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"')))

    df = df.withColumn("_rows", F.transform(rows, cells)).where(F.size("_rows") > 2)
    line = F.explode(F.slice("_rows", 3, F.size("_rows"))).alias("_line")
    df = df.select("run", "parameters", "rtp", F.get("_rows", F.lit(0)).alias("_modes"), F.get("_rows", F.lit(1)).alias("_groups"), line)
    long = df.select(
        "run", "parameters", "rtp", F.get("_line", F.lit(0)).alias("metric"), F.posexplode(F.arrays_zip("_modes", "_groups", "_line")).alias("_i", "_c")
    ).where("_i > 0 and metric <> 'std_max'")
    long = long.select(
        "run", "parameters", "rtp", "metric", F.col("_c._modes").alias("mode"), F.col("_c._groups").alias("group"), F.expr("try_cast(nullif(_c._line, '') AS double)").alias("value")
    )
    return remap_values(long, "metric", METRIC_NAMES)


def domain_of_run(df: DataFrame, column: str = "run") -> DataFrame:
    """``domain=<index>-<name>`` as two columns."""
    found = r"^domain=(\d+)-(.*)$"
    return df.withColumn("domain_idx", F.regexp_extract(column, found, 1).try_cast("int")).withColumn(
        "domain", F.regexp_extract(column, found, 2)
    )
