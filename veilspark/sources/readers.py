"""Readers of streams, evaluation series and predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import StreamSchema


def read_stream(spark: SparkSession, path: str, schema: StreamSchema, sep: str = ",", header: bool = True, streaming: bool = False) -> DataFrame:
    """A delimited file of the schema's columns in order; nothing is inferred. streaming: a folder that files come into."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema.struct()).option("sep", sep).option("header", header).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: StreamSchema) -> DataFrame:
    return read_stream(spark, path, schema, sep="\t", header=False)


def records(df: DataFrame, schema: StreamSchema) -> DataFrame:
    """(seq, quasi struct, sensitive)."""
    return df.select(F.col(schema.seq).alias("seq"), F.struct(*[F.col(f"`{a.name}`") for a in schema.quasi]).alias("quasi"), F.col(f"`{schema.sensitive.name}`").alias("sensitive"))


def read_series(spark: SparkSession, pattern: str) -> DataFrame:
    """Metric series of several runs as ``write_series`` leaves them: run, time, metric. pattern: their folder, or a pattern below it."""
    base = pattern.split("*")[0].rstrip("/")
    kinds = T.StructType([T.StructField("time", T.LongType()), T.StructField("metric", T.DoubleType()), T.StructField("run", T.StringType())])
    return spark.read.schema(kinds).option("header", True).option("basePath", base).csv(pattern).select("run", "time", "metric")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows that ``append_rows`` has written, by name, all as text; a field that a row was written without is null."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    folders = sorted(x.getPath().toString() for x in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place))  # one for each set of fields
    parts = [spark.read.option("header", True).csv(f) for f in folders]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    kinds = T.StructType([T.StructField("pred", T.StringType()), T.StructField("actual", T.StringType())])
    return spark.read.schema(kinds).csv(path)


def last_measures(df: DataFrame, names: list[str], order: str = "instances") -> DataFrame:
    """The last value of each measure; '?' for one that the results don't have."""
    return df.agg(*[F.max_by(F.col(n).cast("string"), order).alias(n) if n in df.columns else F.lit("?").alias(n) for n in names])
