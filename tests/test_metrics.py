"""Hand tables for metrics: ties, one class, bin edges, thresholds."""

import pytest
from pyspark.sql import functions as F

from paravane.operators import metrics as mt


def scored(spark, pairs):
    return spark.createDataFrame([("g", float(y), float(p)) for y, p in pairs], "g string, y double, p double").withColumn("y", F.col("y").cast("int"))


def one(df):
    return df.collect()[0].asDict()


def test_auroc_counts_ties_half(spark):
    assert one(mt.auroc(scored(spark, [(0, 0.5), (1, 0.5), (0, 0.5)]), ["g"]))["auroc"] == 0.5
    assert one(mt.auroc(scored(spark, [(0, 0.1), (1, 0.9), (0, 0.95), (1, 0.95)]), ["g"]))["auroc"] == pytest.approx(2.5 / 4)


def test_auroc_of_negated_scores_is_the_rest(spark):
    data = [(i % 3 == 0, (i * 37 % 101) / 101) for i in range(200)]
    a = one(mt.auroc(scored(spark, data), ["g"]))["auroc"]
    b = one(mt.auroc(scored(spark, [(y, 1 - p) for y, p in data]), ["g"]))["auroc"]
    brute = sum((p > q) + 0.5 * (p == q) for y, p in data if y for z, q in data if not z) / (sum(y for y, _ in data) * sum(not y for y, _ in data))
    assert a + b == pytest.approx(1) and a == pytest.approx(brute)


def test_one_class_gives_nulls(spark):
    df = scored(spark, [(0, 0.2), (0, 0.7)])
    assert one(mt.auroc(df, ["g"]))["auroc"] is None
    assert one(mt.sensitivity_threshold(df, ["g"]))["thr"] == 1.0
    rates = one(mt.decision_rates(mt.confusion(df.withColumn("thr", F.lit(0.99)), ["g", "thr"]), F.lit(0.1)))
    assert rates["ppv"] is None and rates["sens"] is None and rates["spec"] == 1.0


def test_bin_edges(spark):
    df = scored(spark, [(0, 0.0), (1, 1 / 15), (1, 0.1), (1, 1.0)])
    bins = lambda mode, n: sorted(r.bin for r in mt.curve(df, ["g"], n, mode).collect())
    assert bins("floor", 15) == [0, 1]  # 1.0 lies in no bin; 1/15 and 0.1 share the second
    assert bins("closed", 10) == [0, 1, 9]
    assert bins("adaptive", 2) == [0, 1]


def test_average_precision(spark):
    assert one(mt.average_precision(scored(spark, [(1, 0.9), (0, 0.8), (1, 0.7)]), ["g"]))["auprc"] == pytest.approx((1 + 2 / 3) / 2)


def test_murphy_parts_add_up_when_bins_are_pure(spark):
    df = scored(spark, [(1, 0.75), (1, 0.75), (0, 0.75), (1, 0.75), (0, 0.25), (0, 0.25), (1, 0.25), (0, 0.25)])
    parts = one(mt.brier_parts(df, ["g"], 4, "floor"))
    brier = one(df.groupBy("g").agg(mt.brier().alias("b")))["b"]
    assert parts["brier_rel"] - parts["brier_res"] + parts["brier_unc"] == pytest.approx(brier)


def test_empty_table(spark):
    assert mt.metric_bundle(scored(spark, []), ["g"]).collect() == []
