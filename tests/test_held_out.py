"""Scores come from models that didn't see the row."""

import numpy as np
from pyspark.sql import functions as F

from paravane.functions.draws import normal, uniform
from paravane.operators import models as m
from paravane.operators import sampling as s


def test_subsample_scores_are_held_out(spark):
    i = F.col("row_id")
    df = spark.range(60).withColumnRenamed("id", "row_id").withColumns({"y": (uniform("y", i) < 0.4).cast("int"), "a": normal("a", i), "b": normal("b", i)})
    rows = s.stratified_folds(df.withColumn("run_id", F.explode(F.array(F.lit(1), F.lit(2)))), ["run_id"], 5, 1).cache()
    got = {(r.run_id, r.row_id): r.p for r in m.subsample_logistic(rows, ["run_id"], ["a", "b"]).collect()}
    assert len(got) == 120 and all(0 < p < 1 for p in got.values())
    other = rows.withColumn("y", F.when((i == 7) & (F.col("run_id") == 1), 1 - F.col("y")).otherwise(F.col("y")))
    fold = {(r.run_id, r.row_id): r.fold for r in rows.collect()}
    new = {(r.run_id, r.row_id): r.p for r in m.subsample_logistic(other, ["run_id"], ["a", "b"]).collect()}
    # a row's own label, and those of its fold, don't move its score; those of other folds do
    assert all(np.isclose(new[k], p) == (k[0] == 2 or fold[k] == fold[1, 7]) for k, p in got.items())


def test_fitted_models_in_worlds_are_those_of_plain_sums(spark):
    i = F.col("row_id")
    df = spark.range(90).withColumnRenamed("id", "row_id").withColumn("y", (uniform("y", i) < 0.4).cast("int"))
    df = df.withColumns({"a": normal("a", i) + F.col("y"), "b": normal("b", i), "k": F.when(i % 3 == 0, "e").otherwise("o"), "g": F.lit("all")})
    rows = s.stratified_folds(df, ["g"], 3, 1).drop("repeat").cache()
    used = {"both": ["a", "b"], "one": ["b"]}
    got = m.held_out_in_worlds(rows, ["g"], used, 3, ["a", "b"], ["k"]).toPandas()
    plain = rows.toPandas()
    worlds = {"W0_clean": lambda d: d, "W3_shift": lambda d: d.assign(**{c: d[c] + 0.3 * d.groupby("fold")[c].transform(lambda x: x.std(ddof=0)) for c in "ab"})}
    for world, change in worlds.items():
        for name, cols in used.items():
            found = got[(got.world == world) & (got.model == name)].set_index("row_id").p
            assert len(found) == 90
            moved = change(plain)
            for k in (1, 2, 3):
                train, test = plain[plain.fold != k], moved[moved.fold == k]
                more = 1e-9 * max(train[c].var(ddof=0) for c in cols)
                like = [np.log((train.y == c).sum()) + sum(-0.5 * np.log(v) - (test[x] - mean) ** 2 / (2 * v) for x in cols for mean, v in [(train[x][train.y == c].mean(), train[x][train.y == c].var(ddof=0) + more)]) for c in (0, 1)]
                assert np.allclose(found[test.row_id], 1 / (1 + np.exp(like[0] - like[1])))
    # every world keeps its number of rows, and rows without values are scored with the other folds' medians
    assert (got.groupby(["world", "model"]).size() == 90).all() and got.p.notna().all() and got.world.nunique() == 10


def test_cut_points_are_those_of_the_training_rows(spark):
    i = F.col("row_id")
    df = spark.range(80).withColumnRenamed("id", "row_id").withColumns({"y": (uniform("y", i) < 0.5).cast("int"), "a": normal("a", i)})
    score = m.fitted(df.withColumn("a", F.col("a") + F.col("y")), "extra_trees", ["a"], [], trees=5)
    whole = {r.row_id: r.p for r in score(df).collect()}
    # the score of a row doesn't depend on which rows are scored with it
    assert all(whole[r.row_id] == r.p for r in score(df.where("row_id < 3")).collect())


def test_calibrated_kernel_machine(spark):
    i = F.col("row_id")
    df = spark.range(200).withColumnRenamed("id", "row_id").withColumn("y", (uniform("y", i) < 0.4).cast("int"))
    df = df.withColumn("a", normal("a", i) + 2 * F.col("y")).cache()
    got = m.calibrated(df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1"), "svc_rbf", ["a"], [], "sigmoid", 2).toPandas()
    assert len(got) == 100 and got.p.between(0, 1).all()
    assert got.p[got.y == 1].mean() > got.p[got.y == 0].mean() + 0.2 and abs(got.p.mean() - got.y.mean()) < 0.15
