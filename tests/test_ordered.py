"""Metrics from sorted arrays, cut into slices or not, against plain code; E without joins against E from joined attributions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paravane.operators import metrics as mt
from paravane.operators import ordered as od
from paravane.operators.attribution import stability
from paravane.plans import views as v


def _plain(y, p, bins=15):
    y, p = np.array(y, float), np.array(p)
    q = np.clip(p, 1e-7, 1 - 1e-7)
    pos, neg = q[y == 1], q[y == 0]
    out = {"brier": np.mean((q - y) ** 2), "log_loss": -np.mean(np.log(np.where(y == 1, q, 1 - q)))}
    out["auroc"] = np.mean((pos[:, None] > neg) + (pos[:, None] == neg) / 2) if len(pos) and len(neg) else None
    out["auprc"] = np.mean([(pos >= x).sum() / (q >= x).sum() for x in pos]) if len(pos) else None
    cuts = np.r_[0, np.quantile(q, [i / bins for i in range(1, bins)]), 1]
    fixed, adaptive = np.searchsorted([i / bins for i in range(bins + 1)], q, "right") - 1, np.clip(np.searchsorted(cuts, q, "left") - 1, 0, bins - 1)
    gap = lambda b: sum(abs(y[b == k].sum() - q[b == k].sum()) for k in range(bins)) / len(y)
    out |= {"ece": gap(fixed), "aece": gap(adaptive), "n_eval": len(y), "prevalence": y.mean()}
    out["brier_rel"] = sum((adaptive == k).sum() * (q[adaptive == k].mean() - y[adaptive == k].mean()) ** 2 for k in set(adaptive)) / len(y)
    return out


@pytest.mark.parametrize("slice_scores", [1 << 19, 30])
def test_metrics_by_plain_code(spark, monkeypatch, slice_scores):
    monkeypatch.setattr(od, "SLICE_SCORES", slice_scores)
    rng, rows = np.random.default_rng(3), []
    for g, n, digits in (("a", 400, 9), ("b", 300, 1), ("c", 1, 3), (None, 90, 2)):
        rows += [(g, round(float(rng.random()), digits), int(rng.random() < 0.4)) for _ in range(n)]
    rows += [("one", 0.3, 1), ("one", 0.8, 1), ("ends", 0.0, 0), ("ends", 1.0, 1), ("ends", 1.0, 0), ("none", None, 1)]
    df = spark.createDataFrame(rows, "g string, p double, y int").repartition(5)
    got = {r.g: r.asDict() for r in mt.metric_bundle(df, ["g"]).collect()}
    assert set(got) == {"a", "b", "c", None, "one", "ends"}
    for g, r in got.items():
        want = _plain([y for k, p, y in rows if k == g and p is not None], [p for k, p, _ in rows if k == g and p is not None])
        assert {c: r[c] for c in want} == {c: pytest.approx(x, abs=1e-12) if x is not None else None for c, x in want.items()}
    for f, name in ((mt.auroc, "auroc"), (mt.average_precision, "auprc")):
        assert {r.g: r[name] for r in f(df.where("g IN ('a', 'b')"), ["g"]).collect()} == {g: pytest.approx(got[g][name]) for g in "ab"}


def test_a_group_of_any_size_is_many_small_arrays(spark, monkeypatch):
    monkeypatch.setattr(od, "SLICE_SCORES", 100)
    df = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") / 5000).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    parts = od.sliced(mt.kept(od.packed(df.repartition(4), ["g"]), "scores"), ["g"]).toPandas()
    assert sum(len(b) // 8 for b in parts.p) == 5000 and parts.groupby("slice").p.apply(lambda x: sum(len(b) // 8 for b in x)).max() <= 300


def test_stability_without_joins(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    rows, by = v.folded(spark, sf), ["edition", "model", "fold"]
    rows = v.kept(rows.withColumn("x1", F.when(F.col("row_id") % 7 != 0, F.col("x1"))), "some-nulls")
    monkeypatch.setattr(v, "folded", lambda *_: rows)
    want = stability(v.attributions(spark, sf).where("world <> 'label_noise'"), by, "clean", 2).collect()
    monkeypatch.setattr(v, "attributions", None)  # no attribution becomes a row
    got = {tuple(r[b] for b in by): r for r in v.fold_stability(spark, sf).collect()}
    assert len(got) == len(want) == 12
    for r in want:
        assert all(got[tuple(r[b] for b in by)][c] == pytest.approx(r[c], abs=1e-9) for c in ("E_cos", "E_rank", "E_jaccard", "E_mix"))
