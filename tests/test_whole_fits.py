"""Fits that begin on a sample end at the minimum over all rows; permutation importance over many blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paravane.functions.draws import normal, uniform
from paravane.operators import attribution as at
from paravane.operators import linear as ln
from paravane.operators import trees as tr


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("row_id")
    df = spark.range(600).withColumnRenamed("id", "row_id").withColumn("y", (uniform("y", i) < 0.4).cast("int"))
    return df.withColumns({"a": normal("a", i) + F.col("y"), "b": normal("b", i), "fold": (i % 2 + 1).cast("int")}).coalesce(1).cache()


def test_a_fit_that_begins_on_a_sample(spark, rows, monkeypatch):
    how = {"loss": "hinge", "balanced": True, "dims": 8}
    plain = ln.linear_scores(rows, [], ["a", "b"], [], [1, 2], **how).toPandas().set_index("row_id").p.astype(float).sort_index()
    seen, real = [], ln._descend
    monkeypatch.setattr(ln, "WARM_ROWS", 60)
    monkeypatch.setattr(ln, "_descend", lambda d, *a: (seen.append(d.count()), real(d, *a))[1])
    got = ln.linear_scores(rows, [], ["a", "b"], [], [1, 2], **how).toPandas().set_index("row_id").p.astype(float).sort_index()
    assert len(seen) == 2 and 0 < seen[0] < 300 and seen[1] == 600
    assert np.allclose(got, plain, atol=1e-6)


def test_rows_of_one_file_are_fitted_by_several_tasks(rows):
    assert rows.rdd.getNumPartitions() == 1
    assert len(ln.coded(rows, [], ["a", "b"], [], 4).inputFiles()) > 1


def test_histograms_of_weighted_rows(spark, rows):
    """The root of each tree holds the drawn weights of the rows outside its fold, whatever the feature."""
    table = tr.binned(rows, [], ["a", "b"], [], 8)
    got = tr.grow(table, [], [1, 2], 2, [0, 1], 1, 8)
    pdf = table.toPandas()
    for (k, t), tree in got.items():
        mine = pdf[pdf.fold != k]
        w = tr.poisson_weights(mine.row_id.to_numpy(), t, 42) * np.where(mine.y == 1, 0.5 / mine.y.mean(), 0.5 / (1 - mine.y.mean()))
        assert tree.value[0] == pytest.approx((w * mine.y).sum() / w.sum())


def test_importance_over_many_blocks(rows, monkeypatch):
    monkeypatch.setattr(at, "BLOCK_ROWS", 50)
    got = {r.feature: r.importance for r in at.permutation_importance(rows, ["a", "b"], lambda d: d.withColumn("p", 1 / (1 + F.exp(-F.col("a")))), 3).collect()}
    assert got["a"] > 0.1 and abs(got["b"]) < 1e-9
