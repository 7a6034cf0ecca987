"""Shared storage used to cut lineage between the steps of an operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
HOT_KEYS = 100_000
TEXT_BATCH = 1024
LEAST_HOT = 1000  # keys of fewer rows are never hot
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset and
    Spark runs on one machine a temporary folder is made and remembered.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="phenoweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/phenoweave/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the reread table.

    The result has no lineage, survives lost executors and gives the same rows
    on every read (needed wherever ids of rows or random samples are used).
    ``batch`` is the most rows of an Arrow batch, for steps with long rows.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    settings = {DROP_SHUFFLES: "true"}  # the written rows are whole: nobody reads the shuffles again
    if batch:
        settings[BATCH_ROWS] = str(batch)
    was = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.select("*").write.parquet(path)  # a new query takes up the settings
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)


def remove(df_or_path, spark: SparkSession) -> None:
    """Delete a table made by :func:`materialize` that no later step reads."""
    paths = [df_or_path] if isinstance(df_or_path, str) else sorted({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    jvm = spark.sparkContext._jvm
    for path in paths:
        if "/phenoweave/" not in path:
            raise ValueError(f"not a scratch table: {path}")
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, and Arrow batches of TEXT_BATCH rows at most in its session from here on.

    Texts are long: the default of 10,000 rows holds hundreds of megabytes in each
    Python worker and as much in the executor's buffers.
    """
    conf = df.sparkSession.conf
    now = int(conf.get(BATCH_ROWS, "0"))
    if not 0 < now <= TEXT_BATCH:
        conf.set(BATCH_ROWS, str(TEXT_BATCH))
    return df


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of ``table`` for their keys, null where it has none.

    ``keys`` are unique in ``table``, and ``size`` says how many rows have them.
    Keys of more than a HOT_KEYS-th of all these rows are looked up by broadcast
    (at most HOT_KEYS of them); all others are joined by a shuffle, where none of
    them weighs much.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    most = max(LEAST_HOT, total // HOT_KEYS)
    hot = table.where(F.col(size) > most)
    names = [c for c in table.columns if c not in keys]
    if not hot.limit(1).count():
        return rows.join(table, keys, "left")
    hit = rows.join(F.broadcast(hot), keys).select(*rows.columns, *names)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(size) <= most), keys, "left")
    return hit.unionByName(rest.select(*rows.columns, *names))


def placed(docs: DataFrame, name: str = "_place") -> DataFrame:
    """``docs`` with a column that tells every row from every other.

    It is a hash of doc_id and text where no two rows share one, which a narrow
    count checks, so no copy of the texts is needed.  Otherwise (repeated rows)
    the table is written and a row's position is its name.
    """
    key = F.xxhash64("doc_id", "text")
    if docs.select(key.alias("k")).groupBy("k").count().where("count > 1").limit(1).count() == 0:
        return docs.withColumn(name, key)
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "placed")
