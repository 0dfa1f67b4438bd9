"""Linear models of all groups and folds against plain code."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paravane.functions.draws import normal, uniform
from paravane.operators import linear as ln
from paravane.operators import models as m

NUM, CAT = ["a", "b"], ["k"]


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("row_id")
    df = spark.range(240).withColumnRenamed("id", "row_id").withColumns({"g": F.when(i % 3 == 0, "v").otherwise("u"), "fold": (i % 4 + 1).cast("int"), "a": normal("a", i) * 3 + 7, "b": F.exp(normal("b", i)), "k": F.concat(F.lit("k"), (i % 7).cast("string"))})
    df = df.withColumn("y", (uniform("y", i) < F.when((F.col("a") > 7) & (F.col("k") != "k1"), 0.85).otherwise(0.2)).cast("int"))
    # nulls in a number and a category, and a category that only one fold has
    return df.withColumns({"a": F.when(i % 9 != 2, F.col("a")), "k": F.when(i % 11 == 3, None).when((i % 4 == 1) & (i % 5 == 0), "only").otherwise(F.col("k"))}).cache()


def design(train: pd.DataFrame, test: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The prepared columns of train and test, by plain pandas."""
    middle, top = train[NUM].median(), sorted(train.k.dropna().value_counts().items(), key=lambda kv: (-kv[1], kv[0]))
    most = [k for k, n in top if n == top[0][1]]
    out = []
    for df in (train, test):
        filled = df[NUM].fillna(middle)
        ref = train[NUM].fillna(middle)
        z = ((filled - ref.mean()) / ref.std(ddof=0)).to_numpy()
        k = df.k.where(df.k.notna(), most[0])
        hot = np.stack([(k == c).to_numpy(float) for c in sorted(train.k.dropna().unique())], axis=1)
        out.append(np.c_[z, hot, np.ones(len(df))])
    return out[0], out[1]


def plain_logistic(z, y, w):
    beta, ridge = np.zeros(z.shape[1]), np.r_[np.ones(z.shape[1] - 1), 0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        slope = z.T @ (w * (p - y)) + ridge * beta
        beta = beta - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-12), slope)
    return beta


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_scores_are_those_of_plain_code(rows, balanced):
    got = ln.linear_scores(rows, ["g"], NUM, CAT, [1, 2, 3, 4], balanced=balanced).toPandas()
    pdf = rows.toPandas()
    assert sorted(got.row_id) == list(range(240)) and (got.held == got.fold).all()
    p = got.set_index("row_id").p
    for g in "uv":
        modes = pdf[pdf.g == g].k.value_counts()
        for k in (1, 2, 3, 4):
            train, test = pdf[(pdf.g == g) & (pdf.fold != k)], pdf[(pdf.g == g) & (pdf.fold == k)]
            counts = train.k.value_counts()
            tied = (counts == counts.max()).sum() > 1  # a tie goes to the category that the group has most of
            if tied:
                best = sorted(counts[counts == counts.max()].index, key=lambda c: (-modes[c], c))[0]
                train, test = train.assign(k=train.k.fillna(best)), test.assign(k=test.k.fillna(best))
            z, zt = design(train, test)
            y = train.y.to_numpy(float)
            w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
            plain = 1 / (1 + np.exp(-zt @ plain_logistic(z, y, w)))
            assert np.allclose(p[test.row_id], plain, atol=1e-6), (g, k)


def test_hinge_and_its_derivatives():
    z, y = np.linspace(-3, 3, 601), np.repeat([[0.0], [1.0]], 601, axis=1)
    for target in y:
        loss, slope, curve = ln.hinge_loss(z, target)
        exact = np.maximum(0, 1 - (2 * target - 1) * z)
        assert (loss >= exact - 1e-12).all() and (loss - exact).max() <= ln.CORNER / 4 + 1e-12
        up, down = ln.hinge_loss(z + 1e-6, target), ln.hinge_loss(z - 1e-6, target)
        assert np.allclose(slope, (up[0] - down[0]) / 2e-6, atol=1e-5)
        assert (curve <= ln.STEEPEST["hinge"]).all() and ((curve > 0) == (np.abs(1 - (2 * target - 1) * z) < ln.CORNER)).mean() > 0.99
    loss, slope, curve = ln.logistic_loss(np.array([-800.0, 0.0, 800.0]), np.array([0.0, 1.0, 1.0]))
    assert np.allclose(loss, [0, np.log(2), 0]) and np.isfinite(slope).all() and (curve <= 0.25).all()


def test_the_kernel_machine_reaches_its_minimum(rows):
    """At the fitted weights the loss, as plain code adds it up, has no slope."""
    table = ln.coded(rows, ["g"], NUM, CAT, 256)
    prepared = ln.preparations(table, ["g"], [1, 2], 2, 1, 16, 42)
    weights = ln.fit(table, ["g"], prepared, "hinge", True)
    pdf = table.toPandas()
    assert set(weights) == {(g, k) for g in "uv" for k in (1, 2)}
    for (g, k), w in weights.items():
        mine = pdf[(pdf.g == g) & (pdf.fold != k)]
        prep, n0, n1 = prepared[g, k]
        z, y = prep(np.stack(mine.x), np.stack(mine.c)), mine.y.to_numpy(float)
        heavy = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        assert (n0, n1) == ((1 - y).sum(), y.sum())
        total = lambda v: (heavy * ln.hinge_loss(z @ v, y)[0]).sum() + 0.5 * (v[:-1] ** 2).sum()  # noqa: B023, E731
        rng = np.random.default_rng(1)
        for _ in range(20):
            d = rng.normal(size=len(w))
            assert abs(total(w + 1e-5 * d) - total(w - 1e-5 * d)) / 2e-5 < 1e-3 * total(w)
            assert total(w) <= total(w + 0.1 * d)


def test_rows_without_a_fold_meet_every_model_and_held_labels_none(spark, rows):
    asked = rows.unionByName(rows.where("fold = 1").withColumn("fold", F.lit(None).cast("int")))
    got = ln.linear_scores(asked, ["g"], NUM, CAT, [1, 2, 3, 4]).toPandas()
    alone = ln.linear_scores(rows, ["g"], NUM, CAT, [1, 2, 3, 4]).toPandas().set_index("row_id").p
    extra = got[got.fold.isna()]
    assert len(extra) == 60 * 4 and np.allclose(extra[extra.held == 1].set_index("row_id").p, alone[extra[extra.held == 1].row_id])
    assert np.allclose(got[got.fold.notna()].set_index("row_id").p.sort_index(), alone.sort_index())
    other = rows.withColumn("y", F.when((F.col("fold") == 1) & (F.col("g") == "u"), 1 - F.col("y")).otherwise(F.col("y"))).repartition(7)
    new = ln.linear_scores(other, ["g"], NUM, CAT, [1, 2, 3, 4]).toPandas().set_index("row_id")
    same = np.isclose(new.p, alone[new.index], atol=1e-7)
    assert same[(new.fold == 1) | (new.g == "v")].all() and not same[(new.fold != 1) & (new.g == "u")].all()


def test_rare_categories_count_as_unseen_and_blocks_change_nothing(rows, monkeypatch):
    few = ln.linear_scores(rows, [], NUM, CAT, [1, 2], levels=2).toPandas().set_index("row_id").p
    most = [r.k for r in rows.where("k IS NOT NULL").groupBy("k").count().orderBy(F.desc("count"), "k").limit(2).collect()]
    coded = ln.coded(rows, [], NUM, CAT, 2).toPandas().set_index("row_id").c
    named = rows.toPandas().set_index("row_id").k
    assert all(c[0] == (0 if named[i] is None else most.index(named[i]) + 1 if named[i] in most else 3) for i, c in coded.items())
    monkeypatch.setattr(ln, "TASK_BYTES", 1)
    assert np.allclose(ln.linear_scores(rows, [], NUM, CAT, [1, 2], levels=2).toPandas().set_index("row_id").p.sort_index(), few.sort_index(), equal_nan=True)


def test_one_class_nulls_and_nothing(rows):
    odd = rows.where("row_id < 40").withColumns({"a": F.lit(None).cast("double"), "k": F.lit(None).cast("string"), "y": F.lit(0)})
    for how in m.LINEAR.values():
        got = ln.linear_scores(odd, ["g"], NUM, CAT, [1, 2, 3, 4], **how).toPandas()
        assert len(got) == 40 and got.p.between(0, 0.5).all()
    assert ln.linear_scores(odd.limit(0), ["g"], NUM, CAT, [1, 2]).collect() == []
    lone = ln.linear_scores(rows.where("fold = 1"), [], NUM, CAT, [1]).toPandas()
    assert len(lone) == 60 and lone.p.isna().all()


@pytest.mark.parametrize("name", ["logistic_l2", "random_forest", "gaussian_nb"])
def test_inner_scores_cover_the_training_rows_of_every_fold(rows, name):
    two = rows.withColumn("fold", (F.col("row_id") % 2 + 1).cast("int"))
    got = m.inner_scores(two, ["g"], name, NUM, CAT, 2, 2, trees=4, depth=3).toPandas()
    pdf = two.toPandas()
    for g in "uv":
        for k in (1, 2):
            mine = got[(got.g == g) & (got.outer == k)]
            assert sorted(mine.row_id) == sorted(pdf[(pdf.g == g) & (pdf.fold != k)].row_id) and mine.p.between(0, 1).all()
    tiny = m.inner_scores(two.where("row_id IN (0, 3)"), ["g"], "logistic_l2", NUM, CAT, 2, 2).toPandas()
    assert len(tiny) == 2 and tiny.p.notna().all()  # one row in a fold: no inner model, so the full one


def test_all_models_of_all_groups(rows):
    two = rows.drop("fold")
    got = m.evaluate_all(two, ["g"], ["logistic_l2", "svc_rbf", "extra_trees", "gaussian_nb"], NUM, CAT, trees=4, depth=3).toPandas()
    assert sorted(zip(got.g, got.model)) == sorted((g, n) for g in "uv" for n in ("logistic_l2", "svc_rbf", "extra_trees", "gaussian_nb"))
    assert (got.auroc > 0.5).all()
