"""Grouped calibration against plain code, Fastfood features against the exact kernel, scored rows read once."""

import numpy as np
import pytest

from paravane.operators import metrics as mt
from paravane.operators.calibration import calibrate, isotonic_fit
from paravane.operators.models import fastfood, hadamard
from paravane.plans import views
from paravane.plans.views import KEYS, predictions


def plain_isotonic(x, y, at):
    """Isotonic regression by the min-max formula over distinct scores, linear in between, constant outside."""
    xs = np.unique(x)
    pos, n = np.array([y[x == v].sum() for v in xs], float), np.array([(x == v).sum() for v in xs], float)
    mean = lambda i, j: pos[i : j + 1].sum() / n[i : j + 1].sum()
    fitted = [max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))]
    return np.interp(at, xs, fitted)


def plain_sigmoid(x, y, at):
    m = lambda p: np.log((p + 1e-6) / (1 - p + 1e-6))
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = b = 0.0
    for _ in range(100_000):
        q = 1 / (1 + np.exp(-(a * m(x) + b)))
        a, b = a - 0.1 * np.mean((q - target) * m(x)), b - 0.1 * np.mean(q - target)
    return 1 / (1 + np.exp(-(a * m(at) + b)))


@pytest.fixture(scope="module")
def scored():
    rng, out = np.random.default_rng(5), []
    for g, n, digits in (("ties", 200, 1), ("fine", 150, 6), ("edge", 60, 2), ("falling", 80, 2), ("one class", 20, 2)):
        p = rng.random(n).round(digits)
        if g == "edge":
            p = np.where(rng.random(n) < 0.5, rng.choice([0.0, 1.0, 1e-9, 1 - 1e-9], n), p)
        y = (rng.random(n) < (1 - p if g == "falling" else p)).astype(int) if g != "one class" else np.zeros(n, int)
        out.append((g, p, y))
    return out


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration_is_that_of_plain_code_for_all_groups_at_once(spark, scored, method):
    fit = spark.createDataFrame([(g, float(p), int(y)) for g, ps, ys in scored for p, y in zip(ps, ys)], "g string, p double, y int")
    at = np.round(np.linspace(0, 1, 41), 3)
    tests = spark.createDataFrame([(g, float(p), i) for g, _, _ in scored for i, p in enumerate(at)] + [("nowhere", 0.5, 0)], "g string, p double, row_id int")
    got = {}
    for r in calibrate(fit, tests, ["g"], method).collect():
        got.setdefault(r.g, {})[r.row_id] = r.q
    assert set(got) == {g for g, _, _ in scored}
    for g, p, y in scored:
        plain = (plain_isotonic if method == "isotonic" else plain_sigmoid)(p, y, at)
        mine = np.array([got[g][i] for i in range(len(at))])
        assert np.allclose(mine, plain, atol=1e-9 if method == "isotonic" else 2e-3), g


def test_blocks_of_one_group_without_keys_and_nothing(spark):
    fit = spark.createDataFrame([(i / 100, (i * 7 % 10 < i / 10) * 1) for i in range(100)], "p double, y int")
    tests = spark.createDataFrame([(0.31, 1), (0.999, 2)], "p double, row_id int")
    p, y = np.arange(100) / 100, np.array([(i * 7 % 10 < i / 10) * 1 for i in range(100)])
    got = {r.row_id: r.q for r in calibrate(fit, tests, [], "isotonic").collect()}
    assert np.allclose([got[1], got[2]], plain_isotonic(p, y, [0.31, 0.999]))
    ends = isotonic_fit(mt.by_score(fit, []), []).collect()
    assert len({r.value for r in ends}) <= 100 ** (2 / 3) * 2
    for method in ("isotonic", "sigmoid"):
        assert calibrate(fit.limit(0), tests, [], method).count() == 0


def test_fastfood_approximates_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 13))
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 13)
    error = {d: np.abs(fastfood(x, d, 1 / 13) @ fastfood(x, d, 1 / 13).T - exact).mean() for d in (64, 4096)}
    assert error[4096] < 0.02 and error[64] < 0.12
    eye = hadamard(np.eye(8))
    assert (eye @ eye.T == 8 * np.eye(8)).all()


def _scans(df, table):
    return df._jdf.queryExecution().executedPlan().toString().count(f"{table}.parquet")


def test_scored_rows_are_read_once(spark, monkeypatch):
    """The rows with their folds are written by a plan that reads orders once; what follows reads only written tables."""
    seen, folds = [], []
    written = views.kept
    monkeypatch.setattr(views, "kept", lambda df, tag: (folds.append(_scans(df, "orders")), written(df, tag))[1])
    real = mt.kept
    monkeypatch.setattr(mt, "kept", lambda df, tag: (seen.append(_scans(df, "orders")), real(df, tag))[1])
    out = mt.metric_bundle(predictions(spark, "/root/testdata/sf0.001"), KEYS)
    assert seen == [0, 0] and _scans(out, "orders") == 0
    assert folds == [1]
    seen.clear()
    thr = mt.held_out_thresholds(predictions(spark, "/root/testdata/sf0.001").where("world = 'clean'"), ["edition", "model"], [1, 2, 3])
    assert seen == [0] and _scans(thr, "orders") == 0


def test_thresholds_of_other_folds_by_plain_code(spark):
    rng = np.random.default_rng(8)
    rows = [(g, int(rng.integers(1, 4)), round(float(rng.random()), d), int(rng.random() < 0.3)) for g, d, n in (("a", 1, 90), ("b", 6, 70), ("c", 3, 2)) for _ in range(n)]
    rows += [("d", 1, 0.4, 1), ("d", 2, 0.9, 0)]
    df = spark.createDataFrame(rows, "g string, fold int, p double, y int")
    got = {(r.g, r.fold): r.thr for r in mt.held_out_thresholds(df, ["g"], [1, 2, 3]).collect()}
    for g in "abcd":
        for k in (1, 2, 3):
            if any(x[0] == g and x[3] for x in rows):
                others = [p for h, f, p, y in rows if h == g and f != k and y]
                assert got[g, k] == pytest.approx(np.quantile(others, 0.2) if others else 1.0)


def test_no_threshold_without_rows_in_the_other_folds(spark):
    """As in the SQL: 1 where the other folds have rows but no positive, no row where they have no rows."""
    df = spark.createDataFrame([("a", 1, 0.3, 1), ("a", 1, 0.6, 0), ("b", 1, 0.2, 1), ("b", 3, 0.9, 0)], "g string, fold int, p double, y int")
    got = {(r.g, r.fold): r.thr for r in mt.held_out_thresholds(df, ["g"], [1, 2, 3]).collect()}
    assert got == {("a", 2): 0.3, ("a", 3): 0.3, ("b", 1): 1.0, ("b", 2): 0.2, ("b", 3): 0.2}
