"""Scoring of arriving patients with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import sets


def score_stream(patient_terms: DataFrame, profile: DataFrame, method: str, target: str, checkpoint: str, k: int = 10) -> StreamingQuery:
    """Rank each micro-batch of ``patient_id, term`` rows and append to Parquet.

    A patient's terms must arrive in one batch.  Each batch goes to a folder of
    its own that a repeated batch overwrites.
    """
    def write(batch: DataFrame, number: int) -> None:
        sets.rank(batch.distinct(), profile, method, k).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return patient_terms.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
