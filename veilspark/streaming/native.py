"""The learners of ``learners.py`` inside the executors' JVM: ``Learners.java`` repeats them for streams that are too long for an interpreter.
Spark's own compiler translates it once for each driver, and Spark brings the classes to the executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import dealt

SOURCE = Path(__file__).with_name("Learners.java")
#: The compiler that holds the classes, by the id of the application that has them.
_compiled: dict[str, object] = {}


def learners_class(spark: SparkSession):
    """The class veilspark.Learners, which from then on every executor of the application has too."""
    app, jvm = spark.sparkContext.applicationId, spark.sparkContext._jvm
    if app not in _compiled:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE.read_text())
        handle, jar = tempfile.mkstemp(prefix="veilspark-learners-", suffix=".jar")
        os.close(handle)
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(jar)
        atexit.register(Path(jar).unlink, missing_ok=True)  # executors may ask for it as long as the driver lives
        _compiled[app] = compiler
    return _compiled[app].getClassLoader().loadClass("veilspark.Learners")


def prequential(df: DataFrame, shard: str, order: str, learners: str, label: str, sides: list[list[str]], positive: str) -> DataFrame:
    """Test-then-train of the learners that the column ``learners`` names (with commas) on each side's inputs, along each shard: (shard,
    order, learner, actual, pred_0, score_0, pred_1, ...). A shard names the same learners in all its rows. Rows of a shard arrive in order, so a
    task holds a shard's models and one row. Reads df twice, so it should be a table."""
    kinds = f"`{shard}` string, `{order}` bigint, learner string, actual string" + "".join(f", pred_{i} string, score_{i} double" for i in range(len(sides)))
    return _folded(df, shard, order, learners, label, sides, positive, False, kinds)


def prequential_sums(df: DataFrame, shard: str, order: str, learners: str, label: str, sides: list[list[str]], positive: str) -> DataFrame:
    """Of the same predictions what ranks and agreement need: (learner, side, score, p, q), the rows of the positive class and the others, where a
    score may stand more than once; and (learner, side, a, b, n), how often side 0 said a and this side b. The other columns are null."""
    kinds = "learner string, side int, score double, p bigint, q bigint, a string, b string, n bigint"
    return _folded(df, shard, order, learners, label, sides, positive, True, kinds)


def _folded(df: DataFrame, shard: str, order: str, learners: str, label: str, sides: list[list[str]], positive: str, sums: bool, kinds: str) -> DataFrame:
    spark = df.sparkSession
    inputs = [F.col(c).cast("double").alias(f"_{i}_{j}") for i, side in enumerate(sides) for j, c in enumerate(side)]
    rows = dealt(df.select(F.col(shard).cast("string").alias(shard), F.col(order).cast("bigint").alias(order), learners, F.col(label).alias("actual"), *inputs), shard, order)
    jvm, values = spark.sparkContext._jvm, (len(sides), len(sides[0]), positive, sums)
    given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, len(values))
    for i, v in enumerate(values):
        given[i] = v
    step = learners_class(spark).getConstructors()[0].newInstance(given)
    row = jvm.org.apache.spark.sql.Encoders.row(jvm.org.apache.spark.sql.types.StructType.fromDDL(kinds))
    return DataFrame(rows._jdf.mapPartitions(step, row), spark)
