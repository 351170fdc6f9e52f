"""Reading prompts, generations, scores, corpora and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindstore import schemas
from kindstore.session import file_system
from kindstore.functions.scalars import nan_to_null
from kindstore.operators.texts import normalize_texts


def read_table(spark: SparkSession, path: str, *columns: str, spread: str | None = None) -> DataFrame:
    """Parquet columns; a table of few splits is spread over the cores by a key.

    A single small row group is one split, hence one task for whatever follows.
    Tables with a split for every core are read where they lie, unshuffled.
    """
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    if spread is not None and _splits(spark, path) < cores:
        return df.repartition(cores, spread)
    return df


def _splits(spark: SparkSession, path: str) -> int:
    """About how many splits a table has: one a file at least, and one for each so many bytes."""
    place, system = file_system(spark, path)
    size = system.getContentSummary(place)
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    return max(size.getFileCount(), size.getLength() // most)


def read_prompts(spark: SparkSession, path: str, schema: T.StructType = schemas.PROMPTS, flatten: bool = True) -> DataFrame:
    """JSON lines of prompts; a ``prompt`` record is flattened, other files stay as they are."""
    df = spark.read.schema(schema).json(path)
    if not flatten or "prompt" not in df.columns or not isinstance(df.schema["prompt"].dataType, T.StructType):
        return df
    others = [c for c in df.columns if c != "prompt"]
    inner = [c for c in df.schema["prompt"].dataType.names if c not in others]
    return df.select(*others, *[F.col(f"prompt.{c}").alias(c) for c in inner])


def read_generations(spark: SparkSession, path: str, shape: str = "list", column: str = "generations") -> DataFrame:
    """JSON lines of generations in one of the four shapes, as ``array<string>``."""
    schema = T.StructType(
        [
            T.StructField("prompt_idx", T.LongType()),
            T.StructField("prompt", T.StringType()),
            T.StructField(column, schemas.GENERATION_SHAPES[shape]),
        ]
    )
    return normalize_texts(spark.read.schema(schema).json(path), column)


def read_scores(spark: SparkSession, path: str, flat: bool = False) -> DataFrame:
    """Score responses; the flat variant is wrapped into ``response``."""
    if not flat:
        return spark.read.schema(schemas.SCORES).json(path)
    df = spark.read.schema(schemas.FLAT_SCORES).json(path)
    response = F.when(F.col("attributeScores").isNotNull(), F.struct("attributeScores"))
    return df.select("request_id", response.alias("response"), F.lit(None).cast("string").alias("error"))


FORMATS = ("csv", "json", "txt")


def read_corpus(
    spark: SparkSession, path: str, fmt: str | None = None, keep_linebreaks: bool = True, multi_line: bool = False
) -> DataFrame:
    """A text corpus by file extension; the column is ``text`` or else the first one.

    ``keep_linebreaks`` leaves each text line's end in place. JSON holds one
    record per line, or a list of records on one line; ``multi_line`` reads
    records spread over lines. Malformed JSON raises, and without a ``text``
    field the first one by name is the text.
    """
    fmt = fmt or path.rsplit(".", 1)[-1]
    if fmt not in FORMATS:
        raise ValueError(f"corpus format must be one of {FORMATS}")
    if fmt == "txt":
        df = spark.read.text(path).withColumnRenamed("value", "text")
        return df.withColumn("text", F.concat("text", F.lit("\n"))) if keep_linebreaks else df
    if fmt == "csv":
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return df if "text" in df.columns else df.withColumnRenamed(df.columns[0], "text")
    df = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    return df.select(F.col("text" if "text" in df.columns else df.columns[0]).cast("string").alias("text"))


def read_annotations(spark: SparkSession, path: str, schema: T.StructType = schemas.ANNOTATIONS) -> DataFrame:
    """Identity annotations with an index column; NaN becomes NULL."""
    df = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .schema(T.StructType([T.StructField("_index", T.LongType()), *schema.fields]))
        .csv(path)
        .drop("_index")
    )
    return df.withColumns({f.name: nan_to_null(F.col(f.name)) for f in schema if isinstance(f.dataType, T.DoubleType)})
