"""All rows of one table against all of another, block by block.

Neither side is broadcast and no row is made for a pair: a task holds one block
of each side, scores them with numpy and gives back the best few of the block
for each query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import DIGITS

MOST_TASKS = 20_000


def best_columns(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` greatest values of each row, ties by column, NaN last; only those that can be among them are sorted."""
    s = np.where(np.isnan(s), -np.inf, s)
    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
    row, col = np.nonzero(s >= least[:, None])
    order = np.lexsort((col, -s[row, col], row))
    row, col = row[order], col[order]
    return (x[np.arange(len(row)) - np.searchsorted(row, row) < k] for x in (row, col))


def best_in_blocks(queries: DataFrame, items: DataFrame, score: Callable, k: int, query_block: int, item_block: int, digits: int = DIGITS, chunk: int | None = None, ready: Callable = list) -> DataFrame:
    """``patient_id, disease_id, score``: of each block of items the k best for each query.

    Scores are compared at ``digits`` places, ties by least id.

    ``queries (id, v)`` and ``items (id, v)``; ``score`` takes two lists of ``v``
    and gives a matrix.  ``ready`` makes what it takes of a list, once for a block;
    ``chunk`` queries are scored at a time, if given.
    """
    n, m = (max(1, -(-df.count() // size)) for df, size in ((queries, query_block), (items, item_block)))

    def side(df: DataFrame, own: str, parts: int, other: str, others: int, mark: int) -> DataFrame:
        dealt = df.select(F.lit(mark).alias("side"), "id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(own))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select("side", "id", "v", "p", "d")

    def run(block: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = block[block["side"] == 0], block[block["side"] == 1].sort_values("id")
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"patient_id": [], "disease_id": [], "score": []})
        own, other, found = ready(list(mine["v"])), ready(list(theirs["v"])), []
        for lo in range(0, len(own), chunk or len(own)):
            s = score(own[lo : lo + chunk] if chunk else own, other)
            row, col = best_columns(np.round(s, digits), k)
            found.append(pd.DataFrame({"patient_id": mine["id"].to_numpy()[lo + row], "disease_id": theirs["id"].to_numpy()[col], "score": s[row, col]}))
        return pd.concat(found)

    kinds = [df.schema["id"].dataType.simpleString() for df in (queries, items)]
    grid = side(queries, "p", n, "d", m, 0).unionByName(side(items, "d", m, "p", n, 1))
    tasks = min(n * m, MOST_TASKS)  # by number: rows are few for the work they make, so they must not be merged by size
    return grid.repartition(tasks, "p", "d").groupBy("p", "d").applyInPandas(run, "patient_id {}, disease_id {}, score double".format(*kinds))
