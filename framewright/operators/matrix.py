"""Runs over plans: which files an entry reads, and all pairs of dataset and method with resume and failures apart."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAIR = ["dataset", "method"]


def _plain(path: Column) -> Column:
    """One spelling of a path: scheme and a single slash."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")


def plan_paths(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """(dataset, role, path) of every file that the globs of a plan (dataset, role, globs array) fit; a file that several globs of an entry fit counts once."""
    entries = plan.select("dataset", "role", F.explode("globs").alias("glob")).distinct()
    globs = [r.glob for r in entries.select("glob").distinct().collect()]  # one row a glob of a plan
    found = [spark.read.format("binaryFile").load(g).select(F.lit(g).alias("glob"), _plain(F.col("path")).alias("path")) for g in globs]
    return entries.join(F.broadcast(reduce(DataFrame.unionByName, found)), "glob").select("dataset", "role", "path").distinct()


def plan_rows(spark: SparkSession, plan: DataFrame, schema: StructType) -> DataFrame:
    """The rows of all entries in one scan, with dataset and role; a file of several entries stands in each."""
    paths = plan_paths(spark, plan)
    files = [r.path for r in paths.select("path").distinct().collect()]  # one row a file
    if not files:
        return spark.createDataFrame([], StructType([*schema]).add("dataset", "string").add("role", "string"))
    rows = spark.read.schema(schema).parquet(*files).select("*", _plain(F.col("_metadata.file_path")).alias("_path"))
    return rows.join(paths, rows["_path"] == paths["path"]).drop("_path", "path")


def _there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except PySparkException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_matrix(spark: SparkSession, pairs: Mapping[tuple[str, str], Callable[[], DataFrame]], metrics: Callable[[DataFrame, list[str]], DataFrame], schema: str, path: str) -> DataFrame:
    """dataset, method, the metrics of ``schema``, ok and error of every pair.

    ``pairs`` give scores (score, label), ``metrics`` turns scores into rows by (dataset, method).  Pairs whose metrics
    an earlier run has written below ``path`` are not computed again.  The others run in one pass; if that fails, one by
    one, and a pair that fails has a row with its error.  A pair's rows replace what stands there for it (writes by
    partition), so a run that was cut short can simply be repeated.
    """
    both = f"dataset string, method string, {schema}"
    failed = "dataset string, method string, error string"
    done = _there(spark, f"{path}/metrics", both)
    todo = spark.createDataFrame(list(pairs), "dataset string, method string").join(done.select(*PAIR).distinct(), PAIR, "left_anti")
    open_ = [(r.dataset, r.method) for r in todo.collect()]  # one row a pair of the plan

    def put(rows: DataFrame, where: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PAIR).parquet(f"{path}/{where}")

    def compute(some: list[tuple[str, str]]) -> None:
        named = [pairs[d, m]().select("score", "label", F.lit(d).alias("dataset"), F.lit(m).alias("method")) for d, m in some]
        put(metrics(reduce(DataFrame.unionByName, named), PAIR), "metrics")

    try:
        if open_:
            compute(open_)
    except Exception:  # which of them it was, and that the others do not suffer, is found below
        for pair in open_:
            try:
                compute([pair])
            except Exception as e:
                put(spark.createDataFrame([(*pair, f"{type(e).__name__}: {e}"[:2000])], failed), "failures")
    good = _there(spark, f"{path}/metrics", both).select("*", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    bad = _there(spark, f"{path}/failures", failed).join(good.select(*PAIR), PAIR, "left_anti").withColumn("ok", F.lit(False))
    return good.unionByName(bad, allowMissingColumns=True)
