"""The composite score (discrimination R, robustness S, calibration C, attribution stability E) and its ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paravane.functions.scalars import clip

from .stats import average_rank, kendall, spearman

WEIGHTS = {"R": 0.4, "S": 0.3, "C": 0.2, "E": 0.1}
EPS = 1e-12


def components(facts: DataFrame, keys: list[str], clean: str = "clean", label_noise: str = "label_noise") -> DataFrame:
    """R, Q_label, S_drop, S_ratio, C_exp and C_linear of each group, from its facts (world, auroc, ece).

    Every other world is compared with the clean one; S and C leave out the clean and the label-noise world.
    """
    at = lambda w, c: F.max(F.when(F.col("world") == w, F.col(c)))
    base = facts.groupBy(*keys).agg(at(clean, "auroc").alias("auc0"), at(clean, "ece").alias("ece0"), at(label_noise, "auroc").alias("auc_ln"))
    others = facts.where(~F.col("world").isin(clean, label_noise)).join(base, keys)
    drift = F.abs(F.col("ece") - F.col("ece0")) / (F.col("ece0") + EPS)
    parts = others.groupBy(*keys).agg(
        clip(1 - F.avg(F.greatest(F.lit(0.0), F.col("auc0") - F.col("auroc")))).alias("S_drop"),
        F.avg(clip(F.col("auroc") / (F.col("auc0") + EPS))).alias("S_ratio"),
        F.avg(F.exp(-drift)).alias("C_exp"),
        clip(1 - F.avg(F.least(F.lit(1.0), drift))).alias("C_linear"),
    )
    return base.join(parts, keys, "left").select(
        *keys, F.col("auc0").alias("R"), clip(F.col("auc_ln") / (F.col("auc0") + EPS)).alias("Q_label"), "S_drop", "S_ratio", "C_exp", "C_linear"
    )


def with_stability(parts: DataFrame, stability: DataFrame, keys: list[str]) -> DataFrame:
    """Components with E where a group has it."""
    return parts.join(stability, keys, "left")


def composite(r: Column, s: Column, c: Column, e: Column, weights: dict[str, float] | None = None, missing_e: str = "zero") -> Column:
    """The weighted score, weights scaled to sum 1. missing_e "zero" counts a missing E as 0, "null" gives null."""
    w = weights or WEIGHTS
    total = sum(w.values())
    e = F.coalesce(e, F.lit(0.0)) if missing_e == "zero" else e
    return (w["R"] * r + w["S"] * s + w["C"] * c + w["E"] * e) / total


def variant_scores(summary: DataFrame, s: list[str], c: list[str], e: list[str], keys: list[str]) -> DataFrame:
    """Composite of each S, C and E form: keys, variant, score."""
    forms = [(f"{a}|{b}|{d}", composite(F.col("R"), F.col(a), F.col(b), F.col(d))) for a in s for b in c for d in e]
    rows = F.array(*[F.struct(F.lit(name).alias("variant"), score.alias("score")) for name, score in forms])
    return summary.withColumn("v", F.explode(rows)).select(*keys, "v.variant", "v.score")


def variant_agreement(scores: DataFrame, reference: str, by: list[str], item: str = "model") -> DataFrame:
    """Spearman and Kendall of each variant's ranking with the reference variant's."""
    ref = scores.where(F.col("variant") == reference).select(*by, item, F.col("score").alias("ref"))
    both = scores.join(ref, [*by, item])
    return spearman(both, [*by, "variant"], "score", "ref").join(kendall(both, [*by, "variant"], item, "score", "ref"), [*by, "variant"])


def weight_sweep(summary: DataFrame, keys: list[str], lo: float = 0.30, hi: float = 0.50, steps: int = 7) -> DataFrame:
    """Composite with the weight of R from lo to hi, the other weights keeping their ratio."""
    rest = 1 - WEIGHTS["R"]
    out = []
    for i in range(steps):
        w = lo + (hi - lo) * i / (steps - 1)
        weights = {"R": w} | {k: v / rest * (1 - w) for k, v in WEIGHTS.items() if k != "R"}
        out.append(F.struct(F.lit(w).alias("w_r"), composite(F.col("R"), F.col("S_drop"), F.col("C_exp"), F.col("E"), weights).alias("score")))
    return summary.withColumn("v", F.explode(F.array(*out))).select(*keys, "v.w_r", "v.score")


def severity_curve(facts: DataFrame) -> DataFrame:
    """facts with 0.5 auroc + 0.5 exp(-aece)."""
    return facts.withColumn("score", 0.5 * F.col("auroc") + 0.5 * F.exp(-F.col("aece")))


def final_ranking(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """scores with average rank `place` in each group and `position`, ties by model."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), "model")
    return scores.withColumns({"place": average_rank(by, score), "position": F.row_number().over(w)})
