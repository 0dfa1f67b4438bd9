"""Facts that several queries start from, as Spark plans."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paravane.functions.draws import box_muller, with_uniforms
from paravane.operators.attribution import stability, stability_of
from paravane.operators.compare import deltas, edition_join, long_form
from paravane.operators.composite import components, composite, final_ranking, with_stability
from paravane.operators.metrics import auroc, confusion, decision_rates, held_out_thresholds, metric_bundle
from paravane.operators.models import closed_form_nb, held_out_in_worlds, held_out_nb, held_out_nb_attributions, nb_stability, nb_statistics
from paravane.operators.sampling import stratified_folds, stratified_subsample
from paravane.operators.worlds import all_worlds, with_stats
from paravane.sources.editions import CATEGORICAL, FOLDS, NUMERIC, dealt, editions, fold_of, kept, labelled

from .ctes import ATTRIBUTED, MODELS, NB_MODELS, RUNS

KEYS = ["edition", "model", "world", "severity", "fold"]
METRICS = ["auroc", "brier", "log_loss", "ece", "aece"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both editions' labelled rows with their fold, written once: fits, worlds and scores all read them."""
    rows = editions(spark, sf_dir).withColumn("fold", fold_of(F.col("row_id")))
    return kept(dealt(rows.select("edition", "fold", "row_id", "y", *NUMERIC)), "folded")


_NOISE = {f"__u{i}_{c}": (("noise", c), (42, i)) for c in NUMERIC for i in (1, 2)}


def _moved() -> tuple[dict, dict]:
    """The numeric columns in the worlds noise and shift, over with_stats() and the draws of _NOISE."""
    noisy = {c: F.col(c) + box_muller(F.col(f"__u1_{c}"), F.col(f"__u2_{c}")) * 0.2 * F.col(f"sd_{c}") for c in NUMERIC}
    return noisy, {c: F.col(c) + 0.3 * F.col(f"sd_{c}") for c in NUMERIC}


def four_worlds(rows: DataFrame) -> DataFrame:
    """rows in the worlds clean, noise, shift and label_noise, by each fold's own statistics, in one pass."""
    base = with_stats(with_uniforms(rows, _NOISE | {"__flip": (("flip",), (42,))}), ["edition", "fold"], NUMERIC, of=rows)
    noisy, moved = _moved()
    flipped = F.when(F.col("__flip") < 0.1, 1 - F.col("y")).otherwise(F.col("y"))
    same = {c: F.col(c) for c in NUMERIC}
    worlds = [("clean", 0, F.col("y"), same), ("noise", 1, F.col("y"), noisy), ("shift", 2, F.col("y"), moved), ("label_noise", 3, flipped, same)]
    each = F.array(*[F.struct(F.lit(n).alias("world"), F.lit(s).alias("severity"), y.alias("y"), *[x[c].alias(c) for c in NUMERIC]) for n, s, y, x in worlds])
    return base.select("edition", "fold", "row_id", F.explode(each).alias("w")).select("edition", "fold", "row_id", "w.*")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored-rows fact: edition, model, world, severity, fold, row_id, y, p.

    Naive Bayes models on different columns, fitted on the clean rows of the other folds, score each fold in each world.
    """
    rows = folded(spark, sf_dir)
    out = held_out_nb(rows, ["edition"], MODELS, FOLDS, test=four_worlds(rows), keep=("world", "severity", "fold"), fill=False)
    return out.select("edition", "model", "world", "severity", "fold", "row_id", "y", "p")


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edition, world, fold, model, row_id, feature, value: Shapley values of the models of ATTRIBUTED, of every row in every world."""
    rows = folded(spark, sf_dir)
    return held_out_nb_attributions(rows, ["edition"], {m: MODELS[m] for m in ATTRIBUTED}, FOLDS, test=four_worlds(rows), keep=("world", "fold"))


def fold_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E_cos, E_rank, E_jaccard and E_mix by edition, model and fold: attributions in the worlds against the clean ones."""
    rows, by = folded(spark, sf_dir), ["edition", "model", "fold"]
    if rows.where("edition = 'full' AND row_id IS NOT NULL").groupBy("row_id").count().where("count > 1").isEmpty():
        noisy, moved = _moved()
        worlds = {"clean": {c: F.col(c) for c in NUMERIC}, "noise": noisy, "shift": moved}  # label_noise has the clean features
        found = nb_stability(with_stats(with_uniforms(rows, _NOISE), ["edition", "fold"], NUMERIC, of=rows), rows, ["edition"], {m: MODELS[m] for m in ATTRIBUTED}, FOLDS, worlds, "clean")
        return kept(stability_of(*found, by, 2).coalesce(1), "stability")
    found = attributions(spark, sf_dir).where("world <> 'label_noise'")  # rows that share an id are compared with each other
    return kept(stability(found, by, "clean", 2), "stability")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics by edition, model, world, severity and fold: a few rows, written since comparisons read them often."""
    return kept(metric_bundle(predictions(spark, sf_dir), KEYS).coalesce(1), "facts")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by edition, fold and model; E is that of the models with attributions, null for the others."""
    keys = ["edition", "fold", "model"]
    found = components(facts(spark, sf_dir), keys)
    return kept(with_stability(found, fold_stability(spark, sf_dir).select(*keys, F.col("E_mix").alias("E")), keys).coalesce(1), "parts")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["R", "S_drop", "S_ratio", "C_exp", "C_linear", "E"]
    return parts(spark, sf_dir).groupBy("edition", "model").agg(*[F.avg(c).alias(c) for c in cols])


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir).select("edition", "model", composite(F.col("R"), F.col("S_drop"), F.col("C_exp"), F.col("E")).alias("score"))


def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite of each fold, with a missing E as 0 (score) and as null (score_e)."""
    args = [F.col(c) for c in ("R", "S_drop", "C_exp", "E")]
    return parts(spark, sf_dir).select("edition", "fold", "model", composite(*args).alias("score"), composite(*args, missing_e="null").alias("score_e"))


def fold_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = edition_join(fold_scores(spark, sf_dir), ["model", "fold"], ["score"])
    return deltas(joined, ["model", "fold"], ["score"]).select("model", "fold", F.col("delta_score").alias("d"))


def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = long_form(facts(spark, sf_dir), KEYS, METRICS)
    joined = edition_join(long, ["model", "world", "fold", "metric"], ["value"])
    return deltas(joined, [], ["value"]).select("model", "world", "fold", "metric", F.col("delta_value").alias("d"))


def clean_scores(rows: DataFrame) -> DataFrame:
    """edition, model, fold, row_id, y, p: the clean world of predictions(), of rows that folded() gave.

    No other world is made, and the models' statistics are written once, so that a row has the same p in every pass.
    """
    stats = kept(nb_statistics(rows, ["edition"], NUMERIC, FOLDS).coalesce(1), "nb-statistics")
    return held_out_nb(rows, ["edition"], MODELS, FOLDS, keep=("fold",), fill=False, stats=stats).select("edition", "model", "fold", "row_id", "y", "p")


def fold_thresholds(clean: DataFrame) -> DataFrame:
    """thr by edition, model and fold of clean_scores(): the positives of the other folds at a sensitivity of 0.8."""
    return held_out_thresholds(clean, ["edition", "model"], list(range(1, FOLDS + 1)), 0.8)


def ppv_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and rates by edition, model and fold; thresholds from the other folds' positives.

    The shared prevalence is that of all labelled rows, those that no fold scores included.
    """
    rows = folded(spark, sf_dir)
    clean, pi = clean_scores(rows), rows.where("edition = 'full'").agg(F.avg("y").alias("pi"))
    test = clean.join(F.broadcast(fold_thresholds(clean)), ["edition", "model", "fold"]).crossJoin(F.broadcast(pi))
    return decision_rates(confusion(test, ["edition", "model", "fold", "thr", "pi"]), F.col("pi"))


def held_out_areas(rows: DataFrame) -> DataFrame:
    """AUROC of the naive Bayes models by run_id: rows(run_id, fold, row_id, y, columns), a row's score from the other folds."""
    return auroc(held_out_nb(rows, ["run_id"], NB_MODELS, 5), ["run_id", "model"], "value")


def world_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both editions with stratified folds, written once, since every world reads them."""
    return kept(stratified_folds(editions(spark, sf_dir), ["edition"], FOLDS, 1).drop("repeat"), "world-folds")


def world_facts(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """All metrics by edition, model, world, severity and fold of fitted models.

    Each fold is perturbed as each of the ten worlds and scored by models of the other folds.
    """
    rows = world_rows(spark, sf_dir) if rows is None else rows
    return metric_bundle(held_out_in_worlds(rows, ["edition"], MODELS, FOLDS, NUMERIC, CATEGORICAL).drop("row_id"), KEYS)


def world_stability(rows: DataFrame) -> DataFrame:
    """E by edition, model and fold over the ten worlds, without those that change labels or replace rows."""
    tests = all_worlds(rows, ["edition", "fold"], NUMERIC, CATEGORICAL).where("NOT world IN ('W7_prevalence', 'W9_label_noise')")
    found = held_out_nb_attributions(rows, ["edition"], {m: MODELS[m] for m in ATTRIBUTED}, FOLDS, test=tests, keep=("world", "fold"), fill=True)
    return stability(kept(found, "world-attributions"), ["edition", "model", "fold"], "W0_clean", 2)


def fitted_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite and rank by edition of fitted models in the ten worlds; models without attributions have E null, which counts as 0."""
    rows, keys = world_rows(spark, sf_dir), ["edition", "fold", "model"]
    found = kept(world_facts(spark, sf_dir, rows), "world-facts")
    each = with_stability(components(found, keys, "W0_clean", "W9_label_noise"), world_stability(rows).select(*keys, F.col("E_mix").alias("E")), keys)
    mean = each.groupBy("edition", "model").agg(*[F.avg(c).alias(c) for c in ("R", "S_drop", "C_exp", "E")])
    score = composite(F.col("R"), F.col("S_drop"), F.col("C_exp"), F.col("E"))
    return final_ranking(mean.withColumn("score", score), ["edition"])


def reference_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out AUROC of each model over all labelled rows."""
    rows = stratified_folds(labelled(spark, sf_dir), [], 5, 1).withColumn("run_id", F.lit(0))
    return held_out_areas(rows).select("model", "value")


def run_scores(spark: SparkSession, sf_dir: str, runs: int = RUNS) -> DataFrame:
    """Held-out AUROC of each model in each of many subsamples of 252 rows, a small table that is kept while it is read again."""
    rows = kept(stratified_folds(stratified_subsample(labelled(spark, sf_dir), [], 252, runs), ["run_id"], 5, 1), "runs")
    return kept(held_out_areas(rows).coalesce(1), "run-scores")


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edition, model, fold, and the seconds that fitting, scoring, attributing and all of it took: measured, so they differ from run to run.

    Each model is fitted on the other folds, scores its fold in the four worlds, and is attributed where it can be; every
    one of these is a Spark job of its own, whose result goes nowhere.
    """
    rows, out = folded(spark, sf_dir), []
    tests = kept(four_worlds(rows), "four-worlds")

    def seconds(df: DataFrame) -> float:
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for edition in ("full", "demo"):
        for model, used in MODELS.items():
            for k in range(1, FOLDS + 1):
                mine = rows.where((F.col("edition") == edition) & (F.col("fold") != k))
                test = tests.where((F.col("edition") == edition) & (F.col("fold") == k))
                fit = seconds(mine.groupBy("y").agg(F.count("*"), *[f(c) for f in (F.avg, F.var_pop) for c in used]))
                both = max(fit, seconds(closed_form_nb(mine, test, [], used)))
                some = rows.where(F.col("edition") == edition).withColumn("fold", F.when(F.col("fold") == k, 1).otherwise(2))
                attr = seconds(held_out_nb_attributions(some, ["edition"], {model: used}, 2, test=test.withColumn("fold", F.lit(1)))) if model in ATTRIBUTED else None
                out.append((edition, model, k, fit, both - fit, attr, both + (attr or 0.0)))
    return spark.createDataFrame(out, "edition string, model string, fold int, time_fit double, time_pred double, time_attr double, time_total double")
