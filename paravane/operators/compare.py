"""Comparisons of editions, of models and of experiments: joins on keys, then deltas and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import average_rank, bootstrap_mean, correlation, kendall, min_rank, spearman


def edition_join(df: DataFrame, keys: list[str], values: list[str], a: str = "full", b: str = "demo") -> DataFrame:
    """Rows of two editions side by side: keys, value_a and value_b."""
    side = lambda e: df.where(F.col("edition") == e).select(*keys, *[F.col(v).alias(f"{v}_{e}") for v in values])
    return side(a).join(side(b), keys)


def deltas(joined: DataFrame, keys: list[str], values: list[str], a: str = "full", b: str = "demo") -> DataFrame:
    """joined with delta_value = value_a - value_b for each value."""
    return joined.withColumns({f"delta_{v}": F.col(f"{v}_{a}") - F.col(f"{v}_{b}") for v in values})


def long_form(df: DataFrame, keys: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row per key and value column."""
    return df.unpivot(keys, values, name, value)


def score_comparison(scores: DataFrame, score: str = "score") -> DataFrame:
    """Scores of both editions per model: delta, ranks (ties share the least) and the change of rank."""
    out = deltas(edition_join(scores, ["model"], [score]), ["model"], [score])
    out = out.withColumns({"rank_full": min_rank([], f"{score}_full"), "rank_demo": min_rank([], f"{score}_demo")})
    return out.withColumn("rank_change", F.col("rank_demo") - F.col("rank_full"))


def rank_agreement(joined: DataFrame, by: list[str], item: str, a: str, b: str) -> DataFrame:
    """n, Spearman and Kendall of two columns over items."""
    n = joined.groupBy(*by).agg(F.count("*").alias("n"))
    s, k = spearman(joined, by, a, b), kendall(joined, by, item, a, b)
    return n.join(s, by).join(k, by) if by else n.crossJoin(s).crossJoin(k)


def delta_intervals(delta_rows: DataFrame, by: str, replicates: int = 3500, seed: int = 42) -> DataFrame:
    """Mean delta of each metric per model or per world, with a bootstrap interval over the other key's rows."""
    return bootstrap_mean(delta_rows, ["metric", by], "delta", replicates, seed)


def model_pairs(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """All pairs m1 < m2 of models that share the keys: difference d = value1 - value2."""
    l, r = df.select(*by, F.col("model").alias("m1"), F.col(value).alias("v1")), df.select(*by, F.col("model").alias("m2"), F.col(value).alias("v2"))
    return l.join(r, by).where("m1 < m2").withColumn("d", F.col("v1") - F.col("v2"))


def unmatched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: merged keys, keys only on the left, keys only on the right."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return (
        n(a.join(b.select(*keys), keys), "n_merged").crossJoin(n(a.join(b, keys, "left_anti"), "n_left_only")).crossJoin(n(b.join(a, keys, "left_anti"), "n_right_only"))
    )


def curve_distance(curves: DataFrame, by: list[str], a: str = "full", b: str = "demo") -> DataFrame:
    """Count-weighted mean and greatest absolute gap of two editions' reliability curves, bin by bin."""
    joined = edition_join(curves, [*by, "bin"], ["y_mean", "n"], a, b)
    gap, n = F.abs(F.col(f"y_mean_{a}") - F.col(f"y_mean_{b}")), F.col(f"n_{a}") + F.col(f"n_{b}")
    return joined.groupBy(*by).agg(F.count("*").alias("n_bins"), (F.sum(gap * n) / F.sum(n)).alias("l1"), F.max(gap).alias("max_gap"))


def world_rank_matrix(facts: DataFrame, by: list[str], score: str = "auroc") -> DataFrame:
    """Spearman of the models' ranks between each two worlds (long form)."""
    ranks = facts.groupBy(*by, "model", "world").agg(F.avg(score).alias("s")).withColumn("r", average_rank([*by, "world"], "s"))
    l, r = ranks.select(*by, "model", F.col("world").alias("world_i"), F.col("r").alias("ri")), ranks.select(*by, "model", F.col("world").alias("world_j"), F.col("r").alias("rj"))
    return l.join(r, [*by, "model"]).groupBy(*by, "world_i", "world_j").agg(correlation("ri", "rj").alias("rho"))


def cost_choice(df: DataFrame, prefer: list[str]) -> Column:
    """The first of the preferred time columns that the table has."""
    return F.coalesce(*[F.col(c) for c in prefer if c in df.columns])


def first_by_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def reference_percentile(runs: DataFrame, reference: DataFrame, higher_better: list[str]) -> DataFrame:
    """Where a reference value lies among the runs (model, metric, value), as a percentage that it beats; and quantiles."""
    joined = runs.join(reference.withColumnRenamed("value", "ref"), ["model", "metric"])
    up = F.col("metric").isin(*higher_better)
    beats = F.when(up, F.col("value") < F.col("ref")).otherwise(F.col("value") > F.col("ref"))
    q = lambda x: F.expr(f"percentile(value, {x})")
    return joined.groupBy("model", "metric").agg(
        F.max("ref").alias("ref"), q(0.025).alias("q025"), q(0.5).alias("q50"), q(0.975).alias("q975"), (F.avg(beats.cast("double")) * 100).alias("percentile")
    )


def rank_stability(runs: DataFrame, reference: DataFrame, top: tuple[int, ...] = (1, 2, 3), higher_better: bool = True) -> DataFrame:
    """Per run_id: Spearman of the models' order with the reference's, and the shared part of each top k."""
    order = lambda by: Window.partitionBy(*by).orderBy(F.desc("value") if higher_better else F.asc("value"), "model")
    mine = runs.withColumns({"r": min_rank(["run_id"], "value", higher_better), "pos": F.row_number().over(order(["run_id"]))})
    ref = reference.select("model", min_rank([], "value", higher_better).alias("rr"), F.row_number().over(order([])).alias("rpos"))
    shared = [F.avg(F.when(F.col("rpos") <= k, (F.col("pos") <= k).cast("double"))).alias(f"top{k}") for k in top]
    return mine.join(ref, "model").groupBy("run_id").agg(correlation("r", "rr").alias("spearman"), *shared)


def decision_stability(runs: DataFrame, reference: DataFrame, k: int = 3, higher_better: bool = True) -> DataFrame:
    """One row: share of runs whose best model is the reference's best, and whose top k holds it."""
    order = lambda by: Window.partitionBy(*by).orderBy(F.desc("value") if higher_better else F.asc("value"), "model")
    best = reference.withColumn("p", F.row_number().over(order([]))).where("p = 1").select(F.col("model").alias("best"))
    placed = runs.withColumn("pos", F.row_number().over(order(["run_id"]))).join(F.broadcast(best), F.col("model") == F.col("best"))
    return placed.agg(F.avg((F.col("pos") == 1).cast("double")).alias("p_best"), F.avg((F.col("pos") <= k).cast("double")).alias("p_top"))


def jaccard_top(df: DataFrame, by: list[str], item: str, a: str, b: str, k: int) -> DataFrame:
    """Jaccard of the k items with the greatest |a| and those with the greatest |b|."""
    place = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.abs(c).desc(), item))
    flags = df.select(*by, (place(a) <= k).alias("ia"), (place(b) <= k).alias("ib"))
    return flags.groupBy(*by).agg(F.try_divide(F.count_if(F.col("ia") & F.col("ib")), F.count_if(F.col("ia") | F.col("ib"))).alias("jaccard"))


def row_cosine(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Mean over rows of the cosine between two attributions of a row's features, mapped to [0, 1]."""
    rows = df.groupBy(*by, "row_id").agg(F.try_divide(F.sum(F.col(a) * F.col(b)), F.sqrt(F.sum(F.col(a) * F.col(a)) * F.sum(F.col(b) * F.col(b)))).alias("c"))
    return rows.groupBy(*by).agg(((F.avg("c") + 1) / 2).alias("cosine"))


def stacked(parts: list[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns."""
    return reduce(DataFrame.unionByName, parts)
