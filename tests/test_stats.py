"""Statistics on hand tables with known results."""

import pytest
from pyspark.sql import functions as F

from paravane.operators import stats as st
from paravane.operators.compare import first_by_key, rank_agreement, unmatched
from paravane.operators.composite import composite


def table(spark, values):
    return spark.createDataFrame([("g", None if v is None else float(v)) for v in values], "g string, d double")


def one(df):
    return df.collect()[0].asDict()


def test_sign_test_of_seven(spark):
    assert one(st.sign_test(table(spark, range(1, 8)), ["g"], "d"))["p_sign"] == pytest.approx(0.015625)
    assert one(st.sign_test(table(spark, [0.0, None]), ["g"], "d"))["p_sign"] == 1.0


def test_wilcoxon_of_fifteen(spark):
    r = one(st.paired_tests(table(spark, range(1, 16)), ["g"], "d"))
    assert r["wilcoxon"] == 0 and r["wilcoxon_p"] == pytest.approx(6.103515625e-05) and r["rank_biserial"] == 1.0


def test_t_tail():
    assert st.t_tail(17.004881, 14) == pytest.approx(9.5768e-11, rel=1e-4)
    assert st.t_tail(0.0, 5) == 1.0
    assert st.t_tail(2.2281388519, 10) == pytest.approx(0.05, rel=1e-6)


def test_holm(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.02, None])], "i int, p double")
    got = [r.h for r in st.holm(df, [], "p", ["i"], "h").orderBy("i").collect()]
    assert got == pytest.approx([0.04, 0.06, 0.06, 1.0])
    got = [r.h for r in st.holm(df.where("i < 3"), [], "p", ["i"], "h").orderBy("i").collect()]
    assert got == pytest.approx([0.03, 0.04, 0.04])


def test_rank_correlations_of_seven(spark):
    df = spark.createDataFrame(list(zip("abcdefg", [1, 2, 3, 4, 5, 6, 7], [3, 1, 2, 4, 5, 6, 7])), "m string, a int, b int")
    r = one(rank_agreement(df, [], "m", "a", "b"))
    assert r["spearman"] == pytest.approx(0.892857, abs=1e-6) and r["kendall"] == pytest.approx(0.809524, abs=1e-6)


def test_constant_column_has_no_spearman(spark):
    df = spark.createDataFrame([("g", 1, 2), ("g", 1, 3)], "g string, a int, b int")
    assert one(st.spearman(df, ["g"], "a", "b"))["spearman"] is None


def test_effect_size_skips_null_pairs(spark):
    assert one(st.cohen_dz(table(spark, [1, 2, 3, None]), ["g"], "d"))["dz"] == pytest.approx(2.0)
    assert one(st.cohen_dz(table(spark, [1]), ["g"], "d"))["dz"] is None


def test_bootstrap_holds_the_mean(spark):
    r = one(st.bootstrap_mean(table(spark, range(20)), ["g"], "d", 300))
    assert r["n"] == 20 and r["ci_lo"] < r["mean"] == 9.5 < r["ci_hi"]
    p = one(st.bootstrap_mean(table(spark, range(20)), ["g"], "d", 300, mode="poisson"))
    assert p["ci_lo"] < 9.5 < p["ci_hi"]


def test_missing_e(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, None)], "r double, s double, c double, e double")
    args = [F.col(x) for x in "rsce"]
    assert one(df.select(composite(*args).alias("x")))["x"] == pytest.approx(0.45)
    assert one(df.select(composite(*args, missing_e="null").alias("x")))["x"] is None


def test_ols_recovers_a_line(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), 2.0 * i - 3.0 * (i * i % 7) + 1 + 0.01 * (-1) ** i) for i in range(30)], "a double, b double, y double")
    got = {r.term: r for r in st.ols(df, "y", ["a", "b"]).collect()}
    assert got["a"].coef == pytest.approx(2, abs=0.01) and got["b"].coef == pytest.approx(-3, abs=0.01) and got["a"].p < 1e-9
    with pytest.raises(ValueError):
        st.ols(df.limit(2), "y", ["a", "b"])


def test_unmatched_and_first(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (4,)], "k int")
    assert one(unmatched(a, b, ["k"])) == {"n_merged": 1, "n_left_only": 1, "n_right_only": 2}
    d = spark.createDataFrame([(1, 5), (1, 4), (2, 9)], "k int, v int")
    assert sorted(map(tuple, first_by_key(d, ["k"], ["v"]).collect())) == [(1, 4), (2, 9)]
