"""Worlds, folds and samples: defined cases, and results that don't depend on partitioning."""

import pytest
from pyspark.sql import functions as F

from paravane.operators import sampling as sm
from paravane.operators import worlds as w
from paravane.sources import editions as src

NUM, CAT = ["a", "b"], ["c"]


@pytest.fixture(scope="module")
def base(spark):
    data = [(i, int(i % 4 == 0), float(i % 17), float((i * 7) % 23 - 11), "xyz"[i % 3] if i % 10 else None) for i in range(400)]
    return spark.createDataFrame(data, "row_id long, y int, a double, b double, c string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("kind", [(k, p) for _, k, p, _ in w.CATALOGUE], ids=lambda k: k[0])
def test_partitioning_changes_nothing(base, kind):
    # sums in another order may differ in the last digit
    tidy = lambda df: rows(df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))
    one = w.apply_world(base, kind[0], kind[1], [], NUM, CAT)
    many = w.apply_world(base.repartition(7, "b"), kind[0], kind[1], [], NUM, CAT)
    assert tidy(one) == tidy(many) and one.count() == 400


def test_constant_column(spark):
    df = spark.createDataFrame([(i, i % 2, 5.0) for i in range(10)], "row_id long, y int, a double")
    assert {r.a for r in w.additive_shift(df, [], ["a"], scale=0.3).collect()} == {5.3}
    assert {r.a for r in w.nonlinear(df, [], ["a"]).collect()} == {5.0}


def test_short_class_is_drawn_with_replacement(spark):
    df = spark.createDataFrame([(i, int(i < 2), 1.0) for i in range(10)], "row_id long, y int, a double")
    got = w.prevalence_resample(df, [], ["a"], target=0.6).collect()
    assert len(got) == 10 and sum(r.y for r in got) == 6 and {r.row_id for r in got if r.y} <= {0, 1}
    same = w.prevalence_resample(df.withColumn("y", F.lit(0)), [], ["a"])
    assert same.count() == 10


def test_folds_are_stratified(base):
    got = sm.stratified_folds(base, [], 5, 2).groupBy("fold", "y").count().collect()
    assert {r.fold for r in got} == set(range(1, 11)) and {r["count"] for r in got if r.y} == {20}
    assert sm.stratified_folds(base, [], 5, 2, mode="hash").count() == 800


def test_subsample_sizes(base):
    got = sm.stratified_subsample(base, [], 40, 3).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()
    assert [(r.n, r.pos) for r in got] == [(40, 10)] * 3
    assert sm.stratified_subsample(base, [], 1000).count() == 400


def test_safe_folds(base, spark):
    assert sm.safe_folds(base, [], 5).first().n_folds == 5
    few = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    assert sm.safe_folds(few, [], 5).first().n_folds == 0


def test_ingest_and_targets(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (None, 1.0), (0.0, float("inf"))], "t double, x double")
    clean = src.ingest(df)
    assert [r.x for r in clean.collect()] == [None, 1.0, None]
    assert src.with_target(clean, "t").count() == 2
    words = spark.createDataFrame([("yes",), ("no",)], "t string")
    assert rows(src.coerce_binary(words, "t")) == [("no", 0), ("yes", 1)]
    with pytest.raises(Exception, match="exactly two"):
        src.coerce_binary(spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), "t").collect()


def test_empty_table(base):
    none = base.where("false")
    assert w.all_worlds(none, [], NUM, CAT).count() == 0
    assert sm.stratified_folds(none, [], 3, 1).count() == 0
