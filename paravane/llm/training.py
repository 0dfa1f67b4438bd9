"""Full-batch training: gradients are summed over a table's partitions by Spark, the step is taken on the driver."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(labels: DataFrame, bound: int) -> DataFrame:
    """About `bound` rows at most, chosen by a hash of doc_id; all rows of a smaller table."""
    n = labels.count()
    return labels if n <= bound else labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * bound / n))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The rows' arrays end to end, and each element's row."""
    arrays = [np.asarray(x) for x in column]
    return np.concatenate(arrays) if arrays else np.empty(0), np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])


def descend(rows: DataFrame, gradient: Callable, params: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """params after `steps` steps of Adam on the mean loss over rows, a small written table.

    gradient(params, pdf) gives the sum of the rows' gradients. Each partition sends one vector of params' size.
    """
    spark = rows.sparkSession
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        sent = spark.sparkContext.broadcast(params)

        def part(batches: Iterator, sent=sent) -> Iterator:
            import pandas as pd

            total, n = np.zeros_like(sent.value), 0
            for pdf in batches:
                total += gradient(sent.value, pdf)
                n += len(pdf)
            yield pd.DataFrame({"g": [pickle.dumps(total)], "n": [n]})

        parts = rows.mapInPandas(part, "g binary, n long").collect()
        g = sum(pickle.loads(p.g) for p in parts) / max(1, sum(p.n for p in parts))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        sent.destroy()
    return params
