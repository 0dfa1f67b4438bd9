"""Metrics of scored rows, each a grouped aggregation: all groups come out of one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paravane.functions.scalars import clip, closed_bin, floor_bin, quantile_bin, ratio
from paravane.sources.editions import kept

from .ordered import METRICS, areas, measured, packed
from .quantiles import quantiles_of_counts, table_quantile

#: Equal slices of the score range; the first and the last are cut again by powers of two.
SLICES, HALVINGS = 64, 24


def score_slice(p: Column) -> Column:
    """A number that rises with p: scores near 0 and 1, where rare classes lie, have finer slices."""
    fine = lambda x: F.least(F.floor(-F.log2(F.greatest(x, F.lit(2.0**-HALVINGS)))), F.lit(HALVINGS))
    low, high = F.lit(HALVINGS) - fine(p), F.lit(HALVINGS + SLICES) + fine(1 - p)
    return F.when(p < 1 / SLICES, low).when(p > 1 - 1 / SLICES, high).otherwise(HALVINGS + F.floor(p * SLICES)).cast("int")


def by_score(df: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives of each distinct score, written once: every metric is a function of these counts.

    Rows without a score are left out.
    """
    counts = df.where(F.col("p").isNotNull()).groupBy(*keys, "p")
    return kept(counts.agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg")), "by-score")


def cumulated(counts: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """counts(keys.., p, cols..), a table with a row for each score, with <col>_below of all lower scores and all_<col>.

    Sums run inside slices of the score range; totals of whole slices are added from a table of a few rows a group. So a
    group of any size is spread over tasks.
    """
    sliced = counts.withColumn("slice", score_slice(F.col("p")))
    over, all_ = Window.partitionBy(*keys).orderBy("slice"), Window.partitionBy(*keys)
    below = over.rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy(*keys, "slice").agg(*[F.sum(c).alias(f"s_{c}") for c in cols]).select(
        *keys, "slice", *[F.coalesce(F.sum(f"s_{c}").over(below), F.lit(0.0)).alias(f"b_{c}") for c in cols], *[F.sum(f"s_{c}").over(all_).alias(f"all_{c}") for c in cols]
    )
    inside = Window.partitionBy(*keys, "slice").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    out = sliced.join(slices, [*keys, "slice"])
    return out.withColumns({f"{c}_below": F.col(f"b_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0.0)) for c in cols}).drop(*[f"b_{c}" for c in cols])


def score_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives of each distinct score, with those of all lower scores and of all scores."""
    return cumulated(by_score(df, keys), keys, ["pos", "neg"])


def auroc(df: DataFrame, keys: list[str], name: str = "auroc") -> DataFrame:
    """Area under the ROC curve; ties count half, null for a group of one class."""
    return areas(kept(packed(df, keys), "scores"), keys).select(*keys, F.col("auroc").alias(name))


def average_precision(df: DataFrame, keys: list[str], name: str = "auprc") -> DataFrame:
    """Step-wise average precision; null without positives."""
    return areas(kept(packed(df, keys), "scores"), keys).select(*keys, F.col("auprc").alias(name))


def brier(y: str = "y", p: str = "p") -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), 2.0))


def log_loss(eps: float = 1e-7, y: str = "y", p: str = "p") -> Column:
    q = clip(F.col(p), eps, 1 - eps)
    return F.avg(-F.ln(F.when(F.col(y) == 1, q).otherwise(1 - q)))


def _cuts(bins: int) -> Column:
    """Over score_counts(): the edges of adaptive bins, with the outer ones at 0 and 1."""
    n, below, total = F.col("pos") + F.col("neg"), F.col("pos_below") + F.col("neg_below"), F.col("all_pos") + F.col("all_neg")
    return F.array(F.lit(0.0), *quantiles_of_counts([i / bins for i in range(1, bins)], n, below, total), F.lit(1.0))


def _bin(p: Column, bins: int, mode: str) -> Column:
    return quantile_bin(p, F.col("cuts")) if mode == "adaptive" else (floor_bin if mode == "floor" else closed_bin)(p, bins)


def _binned(df: DataFrame, keys: list[str], bins: int, mode: str) -> DataFrame:
    """keys, bin, n, p_sum, pos of all scored rows; rows that are in no bin have one outside the range."""
    if mode == "adaptive":
        counts = by_score(df, keys)
        cuts = cumulated(counts, keys, ["pos", "neg"]).groupBy(*keys).agg(_cuts(bins).alias("cuts"))
        counts, n = counts.join(F.broadcast(cuts) if not keys else cuts, keys), F.col("pos") + F.col("neg")
        return counts.groupBy(*keys, _bin(F.col("p"), bins, mode).alias("bin")).agg(F.sum(n).cast("long").alias("n"), F.sum(F.col("p") * n).alias("p_sum"), F.sum("pos").alias("pos"))
    binned = df.groupBy(*keys, _bin(F.col("p"), bins, mode).alias("bin"))
    return binned.agg(F.count("*").alias("n"), F.sum("p").alias("p_sum"), F.sum("y").cast("double").alias("pos"))


def curve(df: DataFrame, keys: list[str], bins: int = 15, mode: str = "floor") -> DataFrame:
    """Reliability curve: keys, bin, p_mean, y_mean, n; empty bins don't appear.

    mode "floor": left-closed bins, p = 1 is in none; "closed": the last bin holds 1; "adaptive": bins between the
    group's own score quantiles, right-closed.
    """
    points = _binned(df, keys, bins, mode).where((F.col("bin") >= 0) & (F.col("bin") < bins))
    return points.select(*keys, "bin", (F.col("p_sum") / F.col("n")).alias("p_mean"), (F.col("pos") / F.col("n")).alias("y_mean"), "n")


def ece(df: DataFrame, keys: list[str], bins: int = 15, mode: str = "floor", name: str = "ece") -> DataFrame:
    """Expected calibration error: mean gap of a curve's bins by their share of all rows. One pass over the rows."""
    gap = F.when((F.col("bin") >= 0) & (F.col("bin") < bins), F.abs(F.col("pos") - F.col("p_sum"))).otherwise(0.0)
    return _binned(df, keys, bins, mode).groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias(name))


def brier_parts(df: DataFrame, keys: list[str], bins: int = 15, mode: str = "adaptive") -> DataFrame:
    """Murphy's reliability, resolution and uncertainty over a curve's bins."""
    cells = _binned(df, keys, bins, mode)
    over = Window.partitionBy(*keys)  # a group has a row for each bin
    joined = cells.withColumns({"rows": F.sum("n").over(over), "base": F.sum("pos").over(over) / F.sum("n").over(over)})
    joined = joined.where((F.col("bin") >= 0) & (F.col("bin") < bins))
    share, p_mean, y_mean = F.col("n") / F.col("rows"), F.col("p_sum") / F.col("n"), F.col("pos") / F.col("n")
    return joined.groupBy(*keys).agg(
        F.sum(share * F.pow(p_mean - y_mean, 2.0)).alias("brier_rel"),
        F.sum(share * F.pow(y_mean - F.col("base"), 2.0)).alias("brier_res"),
        F.max(F.col("base") * (1 - F.col("base"))).alias("brier_unc"),
    )


def metric_bundle(df: DataFrame, keys: list[str], eps: float = 1e-7, bins: int = 15) -> DataFrame:
    """auroc, auprc, brier, log_loss, ece, aece, Brier parts, n_eval and prevalence of each group.

    Scores are first held to [eps, 1 - eps]. The scored rows are read once, into sorted arrays that are written; all values are
    functions of the counts of distinct scores, which slices of a group's range add up.
    """
    scores = kept(packed(df.withColumn("p", clip(F.col("p"), eps, 1 - eps)), keys), "scores")
    whole = kept(measured(scores, keys, bins), "metrics")  # a row for each group
    base = F.col("prevalence")
    return whole.select(*keys, *METRICS, (base * (1 - base)).alias("brier_unc"), "n_eval", "prevalence")


def pooled_curve(points: DataFrame, keys: list[str], over: str = "fold") -> DataFrame:
    """Curves of several folds as one: means weighted by n, and the folds' population spread of y_mean."""
    n = F.sum("n")
    return points.groupBy(*keys, "bin").agg(
        (F.sum(F.col("p_mean") * F.col("n")) / n).alias("p_mean"), (F.sum(F.col("y_mean") * F.col("n")) / n).alias("y_mean"),
        n.alias("n"), F.stddev_pop("y_mean").alias("y_sd"), F.count_distinct(over).alias("n_folds"),
    )


def sensitivity_threshold(df: DataFrame, keys: list[str], target: float = 0.80) -> DataFrame:
    """thr: the quantile 1 - target of the positives' scores; 1 without positives."""
    counts = score_counts(df, keys)
    thr = quantiles_of_counts([1 - target], F.col("pos"), F.col("pos_below"), F.col("all_pos"))[0]
    return counts.groupBy(*keys).agg(F.coalesce(thr, F.lit(1.0)).alias("thr"))


def held_out_thresholds(df: DataFrame, keys: list[str], folds: list[int], target: float = 0.80) -> DataFrame:
    """keys, fold, thr for each of folds: the quantile 1 - target of the positives' scores in the other folds.

    df has fold. Positives are written once, without a shuffle. 1 where the other folds have no positives; no row where
    they have no rows at all.
    """
    held = F.explode(F.array(*[F.lit(k) for k in folds])).alias("held")
    others = lambda d, *cols: d.select(*keys, "fold", *cols, held).where("held <> fold").drop("fold").withColumnRenamed("held", "fold")
    positives = kept(df.where((F.col("y") == 1) & F.col("p").isNotNull()).select(*keys, "fold", "p"), "positives")
    thr = table_quantile(others(positives, "p"), [*keys, "fold"], "p", 1 - target, "thr")
    present = others(df.select(*keys, "fold").distinct()).distinct()
    return present.join(F.broadcast(thr), [*keys, "fold"], "left").withColumn("thr", F.coalesce("thr", F.lit(1.0)))


def confusion(df: DataFrame, keys: list[str], thr: str = "thr") -> DataFrame:
    """tp, fp, tn and fn at p >= thr."""
    hit, y = F.col("p") >= F.col(thr), F.col("y") == 1
    return df.groupBy(*keys).agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn")
    )


def decision_rates(conf: DataFrame, prevalence: Column) -> DataFrame:
    """conf with sensitivity, specificity, observed PPV and PPV standardised to a prevalence; null where undefined."""
    out = conf.withColumns({
        "sens": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "spec": ratio(F.col("tn"), F.col("tn") + F.col("fp")),
        "ppv": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
    })
    up = F.col("sens") * prevalence
    return out.withColumn("ppv_std", ratio(up, up + (1 - F.col("spec")) * (1 - prevalence)))


def ppv_run(train: DataFrame, test: DataFrame, keys: list[str], prevalence: DataFrame, target: float = 0.80) -> DataFrame:
    """Thresholds from train's scores, applied to test's rows: confusion counts and rates per group.

    prevalence: one row, pi_ref, to which the predictive value is standardised.
    """
    thr = sensitivity_threshold(train, keys, target)
    conf = confusion(test.join(thr, keys), [*keys, "thr"])
    return decision_rates(conf.crossJoin(F.broadcast(prevalence)), F.col("pi_ref"))
