"""Writers of rankings, runs, case results and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import cut


def write_rankings(rankings: DataFrame, path: str) -> None:
    """Rankings as Parquet, a folder for each method; ``/`` in a name becomes ``_``."""
    rankings.withColumn("method_name", F.translate("method", "/", "_")).write.mode("overwrite").partitionBy("method_name").parquet(path)


def append_run(rankings: DataFrame, path: str, patient_id: str, run_ts: str) -> None:
    """Append one run of one patient."""
    named = rankings.withColumns({"patient_id": F.lit(patient_id), "run_ts": F.lit(run_ts), "schema_version": F.lit("1.2")})
    named.write.mode("append").partitionBy("patient_id", "run_ts").option("partitionOverwriteMode", "dynamic").parquet(path)


def list_runs(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """``patient_id, run_ts, n_rows`` of the runs, newest first."""
    runs = spark.read.parquet(path).withColumns({"patient_id": F.col("patient_id").cast("string"), "run_ts": F.col("run_ts").cast("string")})
    return runs.where(F.col("patient_id").startswith(prefix)).groupBy("patient_id", "run_ts").agg(F.count("*").alias("n_rows")).orderBy(F.desc("run_ts"), "patient_id")


def upsert_cases(new: DataFrame, path: str) -> None:
    """Put rows ``dataset, method, case_index, ...`` into the table at ``path``.

    A case that is new replaces the old one of its dataset and method, others
    stay.  Only the folders of the datasets and methods in ``new`` are rewritten,
    and what they get is checkpointed first, so no file is read and replaced at once.
    """
    spark = new.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        keys = ["dataset", "method", "case_index"]
        old = spark.read.schema(new.schema).parquet(path)
        touched = old.join(new.select("dataset", "method").distinct(), ["dataset", "method"], "left_semi")
        new = cut(touched.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns).unionByName(new))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "method").parquet(path)


def check_aligned(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new``, whose read raises where a case has other terms or truth than in ``old``."""
    was = old.select("dataset", "case_index", F.col("hpo_terms").alias("_terms"), F.col("ground_truth").alias("_truth"))
    moved = F.col("_terms").isNotNull() & ((F.col("_terms") != F.col("hpo_terms")) | (F.col("_truth") != F.col("ground_truth")))
    stop = F.raise_error(F.concat(F.lit("case differs from the cached one: "), "dataset", F.lit(" "), F.col("case_index").cast("string"))).cast("int")
    joined = new.join(was, ["dataset", "case_index"], "left")
    return joined.withColumn("case_index", F.when(moved, stop).otherwise(F.col("case_index"))).select(*new.columns)


def write_summary(rows: DataFrame, path: str) -> None:
    """Tab separated rows with a header, nulls as ``None``."""
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "None").csv(path)


def write_artifact(table: DataFrame, path: str, keys: list[str], values: str) -> None:
    """One row for each key with its sorted distinct values."""
    table.groupBy(*keys).agg(F.array_sort(F.collect_set(values)).alias(values)).write.mode("overwrite").parquet(path)
