"""Attribution of scores to features, and its stability between worlds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paravane.functions.draws import hash32, key
from paravane.sources.editions import kept, unkept

from .compare import jaccard_top, row_cosine
from .ordered import areas, packed
from .sampling import hash_rank
from .stats import spearman

#: Rows of a block inside which permutation importance shuffles values, about.
BLOCK_ROWS = 1 << 17


def linear_attribution(df: DataFrame, coef: DataFrame, num: list[str], keep: list[str]) -> DataFrame:
    """keep, row_id, feature, value: a fitted coefficient (coef: feature, coef) times the distance from the feature's mean."""
    means = df.agg(*[F.avg(c).alias(f"__a_{c}") for c in num])
    rows = df.crossJoin(F.broadcast(means)).withColumns({c: F.col(c) - F.col(f"__a_{c}") for c in num})
    long = rows.unpivot([*keep, "row_id"], num, "feature", "away")
    return long.join(F.broadcast(coef), "feature").select(*keep, "row_id", "feature", (F.col("coef") * F.col("away")).alias("value"))


def sampled_shapley(rows: DataFrame, background: DataFrame, num: list[str], score: Callable[[DataFrame], DataFrame], draws: int = 8, seed: int = 42) -> DataFrame:
    """row_id, feature, value: Shapley values by sampling orders of features (Strumbelj and Kononenko 2014).

    For each draw a background row is picked and features are ordered, both by keyed hashes. The prefixes of one order are
    scored once each: features in the prefix come from the row, the others from the background, and a feature's value is
    what p gains where it joins, so d features cost d + 1 scores a draw. The values of a row add up to its p less the
    mean p of the background rows that it drew. score() adds p to a table with rows' columns.
    """
    numbered = hash_rank(background.select("row_id", *num), [], key("background", F.col("row_id"), seed), name="i").drop("row_id")
    size = background.count()
    other = numbered.select("i", *[F.col(c).alias(f"o_{c}") for c in num])
    draw = key("pick", F.col("row_id"), F.col("draw"), seed)
    cases = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("i", hash32(draw) % size + 1).join(other, "i")
    place = F.array(*[F.struct(hash32(key("order", F.col("row_id"), F.col("draw"), c, seed)).alias("h"), F.lit(c).alias("c")) for c in num])
    cases = cases.withColumn("order", F.transform(F.sort_array(place), lambda x: x["c"]))
    cases = cases.withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit(len(num)))))
    mixed = cases.withColumns({c: F.when(F.array_position("order", c) <= F.col("prefix"), F.col(c)).otherwise(F.col(f"o_{c}")) for c in num}).drop(*[f"o_{c}" for c in num], "i")
    # p of a prefix counts for the feature that joined last and against the one that joins next
    joins = F.array(F.struct(F.get("order", F.col("prefix") - 1).alias("feature"), F.col("p").alias("v")), F.struct(F.get("order", F.col("prefix")).alias("feature"), (-F.col("p")).alias("v")))
    parts = score(mixed).select("row_id", F.explode(joins).alias("j")).where("j.feature IS NOT NULL")
    return parts.groupBy("row_id", F.col("j.feature").alias("feature")).agg((F.sum("j.v") / draws).alias("value"))


def mean_absolute(attr: DataFrame, by: list[str]) -> DataFrame:
    return attr.groupBy(*by, "feature").agg(F.avg(F.abs("value")).alias("mean_abs"))


def top_feature_pairs(attr: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """(by.., feature, row_id, x, value) of the feature with the greatest mean absolute attribution."""
    best = mean_absolute(attr, by)
    w = Window.partitionBy(*by).orderBy(F.desc("mean_abs"), "feature")
    best = best.withColumn("n", F.row_number().over(w)).where("n = 1").select(*by, "feature")
    return attr.join(F.broadcast(best), [*by, "feature"]).join(values, ["row_id", "feature"])


def stability(attr: DataFrame, by: list[str], clean: str, k: int = 20) -> DataFrame:
    """E_cos, E_rank, E_jaccard and E_mix of each group: means over the worlds compared with the clean one.

    attr: by.., world, row_id, feature, value.
    """
    base = attr.where(F.col("world") == clean).select(*by, "row_id", "feature", F.col("value").alias("v0"))
    pairs = attr.where(F.col("world") != clean).join(base, [*by, "row_id", "feature"])
    keys = [*by, "world"]
    means = pairs.groupBy(*keys, "feature").agg(F.avg(F.abs("value")).alias("m"), F.avg(F.abs("v0")).alias("m0"))
    return stability_of(means, row_cosine(pairs, keys, "value", "v0"), by, k)


def stability_of(means: DataFrame, cosines: DataFrame, by: list[str], k: int = 20) -> DataFrame:
    """stability() from means(by.., world, feature, m, m0) of absolute values and cosines(by.., world, cosine)."""
    keys = [*by, "world"]
    rank = spearman(means, keys, "m", "m0").select(*keys, ((F.coalesce("spearman", F.lit(0.0)) + 1) / 2).alias("rank"))
    out = cosines.join(rank, keys).join(jaccard_top(means, keys, "feature", "m", "m0", k), keys)
    mean = out.groupBy(*by).agg(F.avg("cosine").alias("E_cos"), F.avg("rank").alias("E_rank"), F.avg("jaccard").alias("E_jaccard"))
    return mean.withColumn("E_mix", (F.col("E_cos") + F.col("E_rank") + F.col("E_jaccard")) / 3)


def permutation_importance(df: DataFrame, num: list[str], score: Callable[[DataFrame], DataFrame], repeats: int = 10, seed: int = 42) -> DataFrame:
    """feature, importance: mean drop of the AUROC when the feature's values are dealt to other rows.

    Each repeat deals all rows into blocks by a hash and shuffles every feature's values inside a block, so rows shuffle
    once for all features, and a block is one task. Repeats follow one another, and the scores of one are deleted before the
    next, so disk holds one repeat's. score() adds p.
    """
    rows = df.select("row_id", "y", *num)
    blocks = max(1, rows.count() // BLOCK_ROWS)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def shuffled(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, block = int(pdf["rep"].iloc[0]), int(pdf["block"].iloc[0])
        pdf, out = pdf.drop(columns="block").sort_values(["row_id", "y", *num]), []
        for i, f in enumerate(num):
            order = np.random.default_rng([seed, rep, block, i]).permutation(len(pdf))
            out.append(pdf.assign(**{f: pdf[f].to_numpy()[order], "feature": f}))
        return pd.concat(out)

    def areas_of(scored: DataFrame, keys: list[str]) -> list:
        scores = kept(packed(scored, keys), "scores")
        found = areas(scores, keys).collect()
        unkept(scores)
        return found

    base = areas_of(score(rows).withColumn("g", F.lit(1)), ["g"])
    drops: list[tuple] = []
    for rep in range(1, repeats + 1):
        dealt = rows.withColumns({"rep": F.lit(rep), "block": F.pmod(F.xxhash64(F.lit(f"perm|{seed}|{rep}"), F.col("row_id")), F.lit(blocks))})
        mixed = dealt.groupBy("rep", "block").applyInPandas(shuffled, f"{types}, rep int, feature string")
        drops += [(r.feature, None if r.auroc is None else base[0].auroc - r.auroc) for r in areas_of(score(mixed), ["feature"])]
    return df.sparkSession.createDataFrame(drops, "feature string, drop double").groupBy("feature").agg(F.avg("drop").alias("importance"))


def importance_agreement(a: DataFrame, b: DataFrame, by: list[str], value: str = "importance") -> DataFrame:
    """Spearman of two importance tables over the features that both have."""
    return spearman(a.select(*by, "feature", F.col(value).alias("va")).join(b.select("feature", F.col(value).alias("vb")), "feature"), by, "va", "vb")
