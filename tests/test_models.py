"""Models: shapes, sanity of scores, attribution."""

import pytest
from pyspark.sql import functions as F

from paravane.functions.draws import normal, uniform
from paravane.operators import attribution as at
from paravane.operators import metrics as mt
from paravane.operators import models as m


@pytest.fixture(scope="module")
def data(spark):
    i = F.col("row_id")
    df = spark.range(400).withColumnRenamed("id", "row_id").withColumn("y", (uniform("y", i) < 0.4).cast("int"))
    df = df.withColumns({"a": normal("a", i) + 1.5 * F.col("y"), "b": normal("b", i), "k": F.when(i % 2 == 0, "e").otherwise("o")})
    return df.withColumn("a", F.when(i % 50 != 3, F.col("a"))).cache()


@pytest.mark.parametrize("name", ["logistic_l2", "logistic_balanced", "random_forest", "extra_trees", "gradient_boosting", "svc_rbf", "mlp", "gaussian_nb"])
def test_models_rank_better_than_chance(data, name):
    scored = m.fit_score(data.where("row_id % 2 = 0"), data.where("row_id % 2 = 1"), name, ["a", "b"], ["k"], trees=8, rounds=5)
    assert scored.count() == 200 and scored.where("p < 0 OR p > 1 OR p IS NULL").count() == 0
    assert mt.auroc(scored.withColumn("g", F.lit(1)), ["g"]).first().auroc > 0.65


def test_attribution_of_a_linear_score(data):
    rows = data.na.fill(0.0)
    score = lambda d: d.withColumn("p", 2 * F.col("a") - F.col("b"))
    got = at.sampled_shapley(rows.limit(5), rows, ["a", "b"], score, 40)
    exact = at.linear_attribution(rows, {"a": 2.0, "b": -1.0}, [])
    both = got.join(exact.withColumnRenamed("value", "e"), ["row_id", "feature"]).collect()
    assert len(both) == 10 and all(abs(r.value - r.e) < 1.5 for r in both)


def test_permutation_importance_finds_the_feature(data):
    score = lambda d: d.withColumn("p", F.col("a"))
    got = {r.feature: r.importance for r in at.permutation_importance(data.na.fill(0.0), ["a", "b"], lambda d: score(d).withColumn("p", 1 / (1 + F.exp(-F.col("p")))), 3).collect()}
    assert got["a"] > 0.1 and abs(got["b"]) < 1e-9
