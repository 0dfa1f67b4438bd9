"""Forests from histograms: splits against exhaustive search, folds that were held out, any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paravane.functions.draws import normal, uniform
from paravane.operators import trees as tr


def plain_gain(y, w, left):
    g = lambda m: 0.0 if not w[m].sum() else 2 * (w * y)[m].sum() * (w * (1 - y))[m].sum() / w[m].sum()
    return g(np.ones(len(y), bool)) - g(left) - g(~left)


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("row_id")
    df = spark.range(300).withColumnRenamed("id", "row_id").withColumns({"g": F.when(i % 3 == 0, "b").otherwise("a"), "fold": (i % 2 + 1).cast("int"), "a": F.round(normal("a", i), 1), "c": normal("c", i), "k": F.concat(F.lit("k"), (i % 5).cast("string"))})
    return df.withColumn("y", (uniform("y", i) < F.when((F.col("a") > 0) & (F.col("k") != "k1"), 0.85).otherwise(0.15)).cast("int")).cache()


def test_splits_are_those_of_exhaustive_search(spark, rows):
    table = tr.binned(rows, ["g"], ["a", "c"], ["k"], 16)
    model = tr.grow(table, ["g"], [1, 2], 3, [0], 2, 16, bootstrap=False, balanced=False)
    pdf = table.toPandas()
    x = np.stack([np.frombuffer(b, np.uint8) for b in pdf["b"]])
    assert set(model) == {(g, k, 0) for g in "ab" for k in (1, 2)}
    for (g, k, _), tree in model.items():
        mine = ((pdf.g == g) & (pdf.fold != k)).to_numpy()
        at = np.zeros(len(pdf), int)
        for node in (0, 1, 2):
            here = mine & (at == node)
            y, w = pdf.y.to_numpy(float)[here], np.ones(here.sum())
            options = {(f, b): plain_gain(y, w, x[here, f] <= b) for f in range(3) for b in range(15) if 0 < (x[here, f] <= b).sum() < here.sum()}
            f, b = tree.feature[node], tree.cut[node]
            assert options[f, b] == pytest.approx(max(options.values()))
            assert tree.value[node] == pytest.approx(y.mean())
            assert tree.value[2 * node + 1] == pytest.approx(y[x[here, f] <= b].mean())
            at = np.where(at == node, 2 * node + 1 + (x[:, f] > b), at) if node == 0 else at
    assert model["a", 1, 0].feature[0] == 0  # the column that decides


@pytest.mark.parametrize("random_cuts", [False, True])
def test_forest_scores_held_out_rows(spark, rows, random_cuts):
    got = tr.forest_scores(rows, ["g"], ["a", "c"], ["k"], [1, 2], trees=12, depth=4, random_cuts=random_cuts).toPandas().set_index("row_id").sort_index()
    assert len(got) == 300 and got.p.between(0, 1).all()
    assert got.p[got.y == 1].mean() > got.p[got.y == 0].mean() + 0.2
    other = rows.withColumn("y", F.when((F.col("fold") == 1) & (F.col("g") == "a"), 1 - F.col("y")).otherwise(F.col("y"))).repartition(7)
    new = tr.forest_scores(other, ["g"], ["a", "c"], ["k"], [1, 2], trees=12, depth=4, random_cuts=random_cuts).toPandas().set_index("row_id").sort_index()
    same = np.isclose(new.p, got.p)
    # labels of a fold don't move its own scores nor those of another group; partitioning moves none
    assert same[(got.fold == 1) | (got.g == "b")].all() and not same[(got.fold == 2) & (got.g == "a")].all()


def test_weights_are_poisson_and_blocks_change_nothing(spark, rows, monkeypatch):
    w = tr.poisson_weights(np.arange(200_000), 3, 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    one = {r.row_id: r.p for r in tr.forest_scores(rows, [], ["a", "c"], ["k"], [1, 2], trees=5, depth=3).collect()}
    monkeypatch.setattr(tr, "TASK_BYTES", 1)
    assert {r.row_id: r.p for r in tr.forest_scores(rows, [], ["a", "c"], ["k"], [1, 2], trees=5, depth=3).collect()} == pytest.approx(one)


def test_nulls_one_class_and_nothing(spark, rows):
    odd = rows.where("row_id < 40").withColumns({"a": F.lit(None).cast("double"), "k": F.lit(None).cast("string"), "y": F.lit(0)})
    assert {r.p for r in tr.forest_scores(odd, [], ["a", "c"], ["k"], [1, 2], trees=3, depth=2).collect()} == {0.0}
    assert tr.forest_scores(odd.limit(0), [], ["a", "c"], ["k"], [1, 2], trees=3, depth=2).collect() == []
