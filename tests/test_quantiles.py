"""Quantiles from counts, against numpy over the plain values."""

import numpy as np
import pytest

from paravane.operators import quantiles as qs
from paravane.operators import worlds as w
from paravane.operators.models import median_imputed
from paravane.operators.quantiles import exact_quantiles, medians, table_quantile
from paravane.operators.stats import describe

SHARES = {"low": 0.0, "q1": 0.25, "mid": 0.5, "odd": 0.731, "top": 1.0}


def test_groups_of_many_shapes(spark):
    rng = np.random.default_rng(3)
    groups = {
        "skewed": np.exp(rng.normal(0, 4, 1500)), "tied": rng.integers(0, 3, 900).astype(float), "one": np.array([7.0]),
        "hot": np.r_[np.zeros(2000), rng.normal(size=301)], "negative": -rng.random(64), "pair": np.array([1.0, 2.0]),
    }
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None), ("none", None)]
    got = {r.g: r.asDict() for r in exact_quantiles(spark.createDataFrame(data, "g string, x double"), ["g"], "x", SHARES).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert [got[g][k] for k in SHARES] == pytest.approx([np.quantile(xs, s) for s in SHARES.values()]), g


def test_without_groups_and_empty(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    assert exact_quantiles(df, [], "x", {"q": 0.5}).collect()[0].q == 4.5
    assert [r.q for r in exact_quantiles(df.where("x < 0"), [], "x", {"q": 0.5}).collect()] == [None]
    assert exact_quantiles(df.withColumn("g", df.x * 0).where("x < 0"), ["g"], "x", {"q": 0.5}).collect() == []


def test_medians_fill_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 4.0, None)], "row_id int, a double, b double")
    assert tuple(medians(df, ["a", "b"]).collect()[0]) == (2.5, None)
    assert sorted(tuple(r) for r in median_imputed(df, df, ["a"]).select("row_id", "a").collect()) == [(1, 1.0), (2, 2.5), (3, 4.0)]


def test_describe_keeps_a_group_of_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)], "g string, x double")
    got = {r.g: (r.n, r.q50) for r in describe(df, ["g"], "x").collect()}
    assert got == {"a": (2, 2.0), "b": (0, None), None: (1, 5.0)}


def test_missingness_keeps_a_group_without_values(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 3, None)], "g string, row_id int, x double")
    assert sorted(r.row_id for r in w.missingness(df, ["g"], ["x"]).collect()) == [1, 2, 3]


@pytest.mark.parametrize("accuracy", [1000, 1])
def test_a_table_quantile_is_exact_however_rough_its_cuts(spark, monkeypatch, accuracy):
    monkeypatch.setattr(qs, "ACCURACY", accuracy)
    rng = np.random.default_rng(11)
    groups = {"wide": rng.normal(size=3000), "tied": rng.integers(0, 4, 700).astype(float), "narrow": 0.33 + 1e-9 * rng.random(2000), "one": np.array([2.0]), "two": np.array([1.0, 5.0])}
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(data, "g string, x double")
    for share in (0.0, 1 - 0.8, 0.5, 1.0):
        got = {r.g: r.thr for r in table_quantile(df, ["g"], "x", share, "thr").collect()}
        assert set(got) == set(groups) and all(got[g] == pytest.approx(np.quantile(xs, share), rel=1e-12) for g, xs in groups.items())
