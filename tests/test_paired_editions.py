"""Paired comparisons of editions where a rate is undefined in one of them, against plain code on hand tables."""

import random
from statistics import mean, stdev

import duckdb
import pytest

from paravane.plans import metric_queries as q
from paravane.plans import views as v
from paravane.plans.catalogue import QUERIES, SQL

RATES = ("sens", "spec", "ppv", "ppv_std")
#: (model, fold) -> the rates of edition full and of edition demo; m2's PPV has no pair, m3's fold 2 is in one edition.
FACTS = {
    ("m1", 1): ((0.0, 1.0, None, None), (0.8, 0.25, 0.3, 0.35)),
    ("m1", 2): ((1.0, 0.0, 0.32, 0.33), (0.7, 0.5, 0.4, 0.45)),
    ("m1", 3): ((0.9, 0.1, 0.33, 0.34), (1.0, 0.0, 0.29, 0.32)),
    ("m2", 1): ((0.0, 1.0, None, None), (0.5, 0.5, 0.5, 0.5)),
    ("m2", 2): ((0.6, 0.4, 0.6, 0.7), (0.0, 1.0, None, None)),
    ("m3", 1): ((0.75, 0.5, 0.25, 0.2), (0.5, 0.5, 0.5, 0.5)),
    ("m3", 2): ((0.7, 0.3, 0.2, 0.1), None),
}


@pytest.fixture
def pairs(spark, monkeypatch):
    """(model, metric) -> pairs of defined values; the queries read FACTS."""
    rows = [(e, m, k, *r) for (m, k), sides in FACTS.items() for e, r in zip(("full", "demo"), sides) if r]
    facts = spark.createDataFrame(rows, "edition string, model string, fold int, " + ", ".join(f"{c} double" for c in RATES))
    monkeypatch.setattr(v, "ppv_facts", lambda *_: facts)
    out = {}
    for (m, _), (a, b) in FACTS.items():
        for c, x, y in zip(RATES, a, b or [None] * 4):
            if x is not None and y is not None:
                out.setdefault((m, c), []).append((x, y))
    return out


def test_means_of_both_editions_are_over_the_same_folds(spark, pairs):
    got = {(r.model, r.metric): r for r in q.m19_paired_editions(spark, "").collect()}
    assert set(got) == set(pairs) and ("m2", "ppv") not in got and len(pairs[("m1", "ppv")]) == 2
    for k, xs in pairs.items():
        r, d = got[k], [a - b for a, b in xs]
        assert r.n == len(xs) and r.mean_full == pytest.approx(mean(a for a, _ in xs)) and r.mean_demo == pytest.approx(mean(b for _, b in xs))
        assert r.mean_delta == pytest.approx(mean(d)) == pytest.approx(r.mean_full - r.mean_demo)
        assert r.sd is None if len(d) < 2 else r.sd == pytest.approx(stdev(d))


def test_topline_is_over_the_folds_of_both_editions(spark, pairs):
    got = {r.model: (r.full_ppv, r.demo_ppv) for r in q.m21_topline(spark, "").collect()}
    want = {m: tuple(map(mean, zip(*xs))) for (m, c), xs in pairs.items() if c == "ppv_std"}
    assert set(got) == set(want) == {"m1", "m3"}
    assert all(got[m] == pytest.approx(want[m]) for m in want)


def test_rows_that_no_fold_holds_count_in_the_prevalence(spark, tmp_path):
    """Orders without a key are in no fold, yet the SQL's prevalence, to which the PPV is standardised, is of all labelled rows."""
    rng = random.Random(4)
    orders = [(i if i <= 600 else None, rng.randrange(40), "F" if i > 600 or rng.random() < 0.4 else "O", rng.uniform(1e3, 4e5), "1-URGENT") for i in range(1, 901)]
    customer = [(i, rng.uniform(-999, 9999), i % 25, "BUILDING") for i in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(customer, "c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    db = duckdb.connect()
    for name in ("orders", "customer"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in ("m21_topline", "f17_standardised_ppv"):
        got, want = QUERIES[name](spark, str(tmp_path)), db.execute(SQL[name])
        cols = [d[0] for d in want.description]
        want = sorted(want.fetchall())
        assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == [pytest.approx(w) for w in want] and len(want) >= 4
