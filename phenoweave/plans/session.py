"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

FINER = 4  # parts of rows that are opened where they are counted, for one usual part


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder that the session names.

    Only where ``spark.checkpoint.dir`` is unset and Spark runs on one machine a
    temporary folder is used.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="phenoweave-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by ``keys``, in more and smaller parts than usual that aren't merged by the size of what is sent.

    Rows that are short when sent may open into many, so the memory of a task depends on their number.
    """
    return rows.repartition(FINER * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
