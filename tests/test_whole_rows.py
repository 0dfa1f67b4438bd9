"""Attribution and calibration queries read all labelled rows, against brute force on a small table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paravane.operators import attribution as at
from paravane.operators import models as m
from paravane.operators import sampling as s
from paravane.plans import metric_queries as q
from paravane.plans import views as v
from paravane.plans.catalogue import QUERIES
from paravane.plans.ctes import ATTRIBUTED, MODELS
from paravane.sources import editions as src
from paravane.sources.editions import NUMERIC as NUM


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    orders = [(i, i % 11, "F" if i * 7 % 5 < 2 else "O", 1000.0 * (i * 37 % 101), "1-URGENT" if i % 3 else "5-LOW") for i in range(1, 61)]
    customer = [(i, 100.0 * (i * 5 % 11) - 300, i % 4, "BUILDING" if i % 2 else "MACHINERY") for i in range(11)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{top}/orders.parquet")
    spark.createDataFrame(customer, "c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string").write.parquet(f"{top}/customer.parquet")
    return top


@pytest.fixture(scope="module")
def worlds(spark, sf):
    """world -> rows x features of edition full: terms of plain naive Bayes log-odds less their means over the fitted rows."""
    rows = v.folded(spark, sf).where("edition = 'full'")
    train = rows.orderBy("row_id").toPandas()
    moved = v.four_worlds(rows).where("world <> 'label_noise'").toPandas().sort_values("row_id")
    assert len(train) == 60
    out = {}
    for world, mine in moved.groupby("world"):
        values = np.zeros((60, 3))
        for k in (1, 2, 3):
            fit = train[train.fold != k]
            more = 1e-9 * max(fit[c].var(ddof=0) for c in NUM)
            for j, c in enumerate(NUM):
                moments = [(fit[c][fit.y == y].mean(), fit[c][fit.y == y].var(ddof=0) + more) for y in (0, 1)]
                term = lambda x: sum(sign * (-0.5 * np.log(var) - (x - mean) ** 2 / (2 * var)) for sign, (mean, var) in zip((-1, 1), moments))  # noqa: B023, E731
                values[(mine.fold == k).to_numpy(), j] = term(mine[c][mine.fold == k]) - term(fit[c]).mean()
        out[world] = values
    return out


def cosine(a, b):
    return ((a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))).mean() / 2 + 0.5


def spearman(a, b):
    rank = lambda v: np.abs(v).mean(0).argsort().argsort()
    return np.corrcoef(rank(a), rank(b))[0, 1]


def top2(a):
    return set(np.abs(a).mean(0).argsort()[-2:])


def test_attributions_add_up(spark, sf, worlds):
    got = v.attributions(spark, sf).where("edition = 'full' AND model = 'nb_123'").toPandas()
    for world, values in worlds.items():
        mine = got[got.world == world].pivot(index="row_id", columns="feature", values="value")
        assert np.allclose(mine[NUM].to_numpy(), values, atol=1e-8)
    # to the log-odds of the score, less their mean over the rows that the model was fitted on
    p = v.predictions(spark, sf).where("edition = 'full' AND model = 'nb_123' AND world = 'noise'").toPandas().sort_values("row_id")
    gap = np.log(p.p / (1 - p.p)).to_numpy() - worlds["noise"].sum(axis=1)
    assert all(np.ptp(gap[(p.fold == k).to_numpy()]) < 1e-8 for k in (1, 2, 3))


def test_sampled_values_add_up_and_agree_with_the_exact_ones(spark, sf):
    rows = v.folded(spark, sf).where("edition = 'full'")
    stats = m.nb_statistics(rows, ["edition"], NUM, 3)
    calls = []
    score = lambda df: (calls.append(df.count()), m.nb_scored(df, stats, ["edition"], NUM))[1]
    got = at.sampled_shapley(rows, rows, NUM, score, 60).toPandas()
    assert calls == [60 * 60 * 4]  # prefixes of three features
    p = m.nb_scored(rows, stats, ["edition"], NUM).toPandas().set_index("row_id").p
    total = got.groupby("row_id").value.sum()
    # sums differ from p by the mean of the drawn background scores, so by little from each other within a fold
    base = p[total.index] - total
    assert base.std() < 0.1 and abs(base.mean() - p.mean()) < 0.1
    # a feature that the model doesn't read has no value
    few = at.sampled_shapley(rows.limit(5), rows, NUM, lambda df: m.nb_scored(df, stats, ["edition"], ["x1", "x2"]), 4).toPandas()
    assert (few[few.feature == "x3"].value.abs() < 1e-12).all() and len(few) == 15


def test_stability_enters_the_composite(spark, sf):
    parts = v.parts(spark, sf).toPandas()
    assert parts[parts.model.isin(ATTRIBUTED)].E.between(0, 1).all() and parts[~parts.model.isin(ATTRIBUTED)].E.isna().all()
    ranking = v.fitted_ranking(spark, sf).toPandas()
    assert ranking[ranking.model.isin(ATTRIBUTED)].E.between(0, 1).all() and ranking[~ranking.model.isin(ATTRIBUTED)].E.isna().all()
    r = ranking.iloc[0]
    assert math.isclose(r.score, 0.4 * r.R + 0.3 * r.S_drop + 0.2 * r.C_exp + 0.1 * (0 if math.isnan(r.E) else r.E), abs_tol=1e-9)


def test_costs_are_measured(spark, sf):
    got = v.costs(spark, sf).toPandas()
    assert len(got) == 2 * len(MODELS) * 3 and (got.time_fit > 0).all() and (got.time_total >= got.time_fit).all()
    assert got[got.model.isin(ATTRIBUTED)].time_attr.gt(0).all() and got[~got.model.isin(ATTRIBUTED)].time_attr.isna().all()


def test_attribution_queries_read_every_row(spark, sf, worlds):
    clean = worlds["clean"]
    others = {k: v for k, v in worlds.items() if k != "clean"}
    got = {r.world: r.cosine for r in QUERIES["i4_row_cosine"](spark, sf).collect()}
    assert set(got) == set(others) and all(math.isclose(got[k], cosine(v, clean), abs_tol=1e-6) for k, v in others.items())
    got = {r.world: r.spearman for r in QUERIES["i5_rank_similarity"](spark, sf).collect()}
    assert all(math.isclose(got[k], spearman(v, clean), abs_tol=1e-6) for k, v in others.items())
    got = {r.world: r.jaccard for r in QUERIES["i6_topk_jaccard"](spark, sf).collect()}
    assert all(math.isclose(got[k], len(top2(v) & top2(clean)) / len(top2(v) | top2(clean)), abs_tol=1e-6) for k, v in others.items())
    one = QUERIES["i7_stability_bundle"](spark, sf).first()
    assert math.isclose(one.E_cos, np.mean([cosine(v, clean) for v in others.values()]), abs_tol=1e-6)
    assert math.isclose(QUERIES["i10_importance_agreement"](spark, sf).first().spearman, spearman(others["noise"], clean), abs_tol=1e-6)


def test_calibration_trains_on_all_of_its_folds(spark, sf, monkeypatch):
    seen, real = [], m.linear_scores
    monkeypatch.setattr(m, "linear_scores", lambda rows, *a, **k: (seen.extend(rows.select("edition", "outer", "fold", "row_id").collect()), real(rows, *a, **k))[1])
    got = QUERIES["e13_calibration"](spark, sf).collect()
    tagged = s.stratified_folds(src.editions(spark, sf), ["edition"], 2, 1).collect()
    for edition in ("full", "demo"):
        ids = {k: {r.row_id for r in tagged if r.edition == edition and r.fold == k} for k in (1, 2)}
        for outer, other in ((1, 2), (2, 1)):
            mine = [r for r in seen if r.edition == edition and r.outer == outer]
            assert sorted(r.row_id for r in mine if r.fold is not None) == sorted(ids[other])
            assert sorted(r.row_id for r in mine if r.fold is None) == sorted(ids[outer])
    assert {r.fold for r in seen} == {1, 2, 3, None}
    full = sorted((r.method, r.row_id) for r in got if r.edition == "full")
    assert full == [(how, i) for how in ("isotonic", "sigmoid") for i in range(1, 61)]


def test_every_row_gets_a_score(spark, sf):
    got = QUERIES["e12_gaussian_nb"](spark, sf).collect()
    assert sorted(r.row_id for r in got) == list(range(1, 61)) and all(0 <= r.p <= 1 for r in got)
    got = [r for r in QUERIES["f18_ppv_run"](spark, sf).collect() if r.edition == "full"]
    assert sorted((r.model, r.fold) for r in got) == [(name, k) for name in sorted(q.PPV_MODELS) for k in (1, 2)]
    for name in q.PPV_MODELS:
        assert sum(r.tp + r.fp + r.tn + r.fn for r in got if r.model == name) == 60


def test_thresholds_come_from_the_other_folds(spark, sf):
    clean = v.predictions(spark, sf).where("world = 'clean'").toPandas()
    got = v.ppv_facts(spark, sf).collect()
    assert {(r.edition, r.model, r.fold) for r in got} == set(clean.groupby(["edition", "model", "fold"]).groups)
    for r in got:
        mine = clean[(clean.edition == r.edition) & (clean.model == r.model)]
        p = mine.p[(mine.fold != r.fold) & (mine.y == 1)]
        thr = np.quantile(p, 0.2) if len(p) else 1.0
        own = mine[mine.fold == r.fold]
        assert math.isclose(r.thr, thr, abs_tol=1e-9) and r.tp + r.fn == (own.y == 1).sum() and r.tp + r.fp == (own.p >= r.thr).sum()
