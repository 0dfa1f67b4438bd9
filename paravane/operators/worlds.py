"""Worlds: named perturbations of test rows (row_id, y, numeric and categorical columns).

Statistics come from the rows being perturbed, one aggregation for each group; randomness is keyed by purpose,
column, row and seed, so results don't depend on partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane.functions.draws import key, normal, student3, uniform

from .quantiles import exact_quantiles, with_group_facts
from .sampling import hash_rank

# World, kind, parameters, severity.
CATALOGUE = [
    ("W0_clean", "clean", {}, 0),
    ("W1_noise_outliers", "noise_outliers", {"std_fraction": 0.20, "outlier_frac": 0.02}, 1),
    ("W2_missingness", "missingness", {"base_p": 0.10, "extra_p": 0.15}, 2),
    ("W3_shift", "shift", {"scale": 0.30}, 3),
    ("W4_surrogates", "surrogates", {"gamma": 0.50, "k": 3.0}, 4),
    ("W5_nonlinear", "nonlinear", {"alpha": 0.60}, 5),
    ("W6_subgroup", "subgroup", {"scale": 0.35}, 6),
    ("W7_prevalence", "prevalence", {"target": 0.35}, 7),
    ("W8_concept_drift", "concept_drift", {"k": 3.0, "scale": 0.35}, 8),
    ("W9_label_noise", "label_noise", {"eta": 0.10}, 9),
]


def catalogue(spark: SparkSession) -> DataFrame:
    """The worlds as a table: name, kind, params, severity."""
    return spark.createDataFrame(CATALOGUE, "name string, kind string, params map<string,double>, severity int")


def with_stats(df: DataFrame, by: list[str], cols: list[str], of: DataFrame | None = None) -> DataFrame:
    """df with avg_, sd_ (population, 0 as 1), sd0_ and min_ of each column in its group; one row a group is broadcast.

    of: the rows whose statistics these are, df where None.
    """
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"avg_{c}"), F.stddev_pop(c).alias(f"sd0_{c}"), F.min(c).alias(f"min_{c}")]
    stats = (df if of is None else of).groupBy(*by).agg(*aggs)
    stats = stats.withColumns({f"sd_{c}": F.when(F.coalesce(F.col(f"sd0_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"sd0_{c}")) for c in cols})
    return df.join(F.broadcast(stats), by) if by else df.crossJoin(F.broadcast(stats))


def _changed(df: DataFrame, by: list[str], cols: list[str], change: Callable[[str], Column]) -> DataFrame:
    return with_stats(df, by, cols).withColumns({c: change(c) for c in cols}).select(*df.columns)


def picked(cols: list[str], k: int, seed: int, purpose: str) -> list[str]:
    """k columns in keyed hash order of their names."""
    return sorted(sorted(cols, key=lambda c: hashlib.md5(f"{purpose}|{c}|{seed}".encode()).hexdigest())[:k])


def clean(df: DataFrame, by: list[str], num: list[str], seed: int = 42) -> DataFrame:
    return df


def gaussian_noise(df: DataFrame, by: list[str], num: list[str], seed: int = 42, std_fraction: float = 0.20) -> DataFrame:
    return _changed(df, by, num, lambda c: F.col(c) + normal("noise", c, F.col("row_id"), seed) * std_fraction * F.col(f"sd_{c}"))


def outliers(df: DataFrame, by: list[str], num: list[str], seed: int = 42, frac: float = 0.02, mode: str = "exact") -> DataFrame:
    """In each column max(1, int(frac * n)) rows move by Student's t(3) times three deviations.

    mode "hash" picks each row with probability frac instead and numbers nothing.
    """
    names, jump = df.columns, lambda c: F.col(c) + 3 * F.col(f"sd_{c}") * student3("outlier", c, F.col("row_id"), seed)
    if mode == "hash":
        return _changed(df, by, num, lambda c: F.when(uniform("outlier-row", c, F.col("row_id"), seed) < frac, jump(c)).otherwise(F.col(c)))
    sized = df.groupBy(*by).agg(F.count("*").alias("__n")) if by else df.agg(F.count("*").alias("__n"))
    out = with_stats(df, by, num)
    out = out.join(F.broadcast(sized), by) if by else out.crossJoin(F.broadcast(sized))
    for c in num:
        out = hash_rank(out, by, key("outlier-row", c, F.col("row_id"), seed), name=f"__r_{c}")
    hit = lambda c: F.col(f"__r_{c}") <= F.greatest(F.lit(1), F.floor(F.col("__n") * frac))
    return out.withColumns({c: F.when(hit(c), jump(c)).otherwise(F.col(c)) for c in num}).select(*names)


def missingness(df: DataFrame, by: list[str], num: list[str], seed: int = 42, base_p: float = 0.10, extra_p: float = 0.15) -> DataFrame:
    """Values go at random; then, where the first numeric column is in its upper quarter, more go."""
    u = lambda what, c: uniform(what, c, F.col("row_id"), seed)
    blank = df.withColumns({c: F.when(u("mcar", c) >= base_p, F.col(c)) for c in num})
    q = exact_quantiles(blank, by, num[0], {"__q": 0.75})
    blank = with_group_facts(blank, q, by, "left").withColumn("__hi", F.coalesce(F.col(num[0]) >= F.col("__q"), F.lit(False)))
    return blank.withColumns({c: F.when(~(F.col("__hi") & (u("mar", c) < extra_p)), F.col(c)) for c in num}).select(*df.columns)


def additive_shift(df: DataFrame, by: list[str], num: list[str], seed: int = 42, scale: float = 0.30) -> DataFrame:
    return _changed(df, by, num, lambda c: F.col(c) + scale * F.col(f"sd_{c}"))


def surrogates(df: DataFrame, by: list[str], num: list[str], seed: int = 42, gamma: float = 0.50, k: int = 3) -> DataFrame:
    """k columns are blended with x + 0.1 mean + N(0, 0.2 deviation)."""
    noise = lambda c: 0.2 * F.col(f"sd_{c}") * normal("surrogate", c, F.col("row_id"), seed)
    other = lambda c: F.col(c) + 0.1 * F.col(f"avg_{c}") + noise(c)
    return _changed(df, by, picked(num, int(k), seed, "surrogate"), lambda c: (1 - gamma) * F.col(c) + gamma * other(c))


def nonlinear(df: DataFrame, by: list[str], num: list[str], seed: int = 42, alpha: float = 0.60) -> DataFrame:
    """log1p where a column is never negative, else x^2 / (1 + |x|), blended in; constant columns stay."""
    def bent(c: str) -> Column:
        x = F.col(c)
        f = F.when(F.col(f"min_{c}") >= 0, F.log1p(F.greatest(x, F.lit(0.0)))).otherwise(x * x / (1 + F.abs(x)))
        return F.when(F.col(f"sd0_{c}") > 0, (1 - alpha) * x + alpha * f).otherwise(x)

    return _changed(df, by, num, bent)


def subgroup_mask(df: DataFrame, by: list[str], num: list[str], cat: list[str]) -> DataFrame:
    """df with `masked`: the most frequent value of the first category (ties: the smallest), else the upper quarter."""
    if cat:
        sizes = df.where(F.col(cat[0]).isNotNull()).groupBy(*by, cat[0]).agg(F.count("*").alias("n"))
        mode = sizes.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(cat[0]).alias("v"))).alias("m")).select(*by, F.col("m.v").alias("__m"))
        test = F.col(cat[0]) == F.col("__m")
    elif num:
        mode = exact_quantiles(df, by, num[0], {"__m": 0.75})
        test = F.col(num[0]) >= F.col("__m")
    else:
        return df.withColumn("masked", F.lit(False))
    out = df.join(F.broadcast(mode), by, "left") if by else df.crossJoin(F.broadcast(mode))
    return out.withColumn("masked", F.coalesce(test, F.lit(False))).drop("__m")


def subgroup_shift(df: DataFrame, by: list[str], num: list[str], seed: int = 42, cat: list[str] | None = None, scale: float = 0.35) -> DataFrame:
    masked = subgroup_mask(df, by, num, cat or [])
    return _changed(masked, by, num, lambda c: F.when(F.col("masked"), F.col(c) + scale * F.col(f"sd_{c}")).otherwise(F.col(c))).drop("masked")


def prevalence_resample(df: DataFrame, by: list[str], num: list[str], seed: int = 42, target: float = 0.35) -> DataFrame:
    """n rows with round(target * n) positives, with `slot` as their key; a class that is short is drawn with replacement.

    A group that lacks a class stays as it is.
    """
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"), F.sum("y").alias("__pos"))
    want_pos = F.round(F.lit(target) * F.col("__n")).cast("long")
    classes = sizes.withColumn("c", F.explode(F.array(
        F.struct(F.lit(1).alias("y"), F.col("__pos").cast("long").alias("have"), want_pos.alias("want")),
        F.struct(F.lit(0).alias("y"), (F.col("__n") - F.col("__pos")).cast("long").alias("have"), (F.col("__n") - want_pos).alias("want")),
    )))
    both = (F.col("__pos") > 0) & (F.col("__pos") < F.col("__n"))
    classes = classes.select(*by, "c.y", "c.have", F.when(both, F.col("c.want")).otherwise(F.col("c.have")).alias("want"))
    ranked = hash_rank(df, [*by, "y"], key("prevalence", F.col("row_id"), seed))
    ranked = ranked.join(F.broadcast(classes), [*by, "y"])
    enough = ranked.where(F.col("have") >= F.col("want")).where(F.col("rank") <= F.col("want")).withColumn("slot", F.col("rank"))
    slots = classes.where("have < want AND have > 0").withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("want"))))
    slots = slots.withColumn("rank", F.floor(uniform("prevalence-slot", F.col("y"), F.col("slot"), seed) * F.col("have")) + 1).select(*by, "y", "rank", "slot")
    drawn = ranked.where(F.col("have") < F.col("want")).join(slots, [*by, "y", "rank"])
    cols = [*df.columns, "slot"]
    return enough.select(*cols).unionByName(drawn.select(*cols))


def concept_drift(df: DataFrame, by: list[str], num: list[str], seed: int = 42, k: int = 3, scale: float = 0.35) -> DataFrame:
    """k columns move by scale deviations for rows with y = 1."""
    return _changed(df, by, picked(num, int(k), seed, "drift"), lambda c: F.when(F.col("y") == 1, F.col(c) + scale * F.col(f"sd_{c}")).otherwise(F.col(c)))


def label_noise(df: DataFrame, by: list[str], num: list[str], seed: int = 42, eta: float = 0.10) -> DataFrame:
    return df.withColumn("y", F.when(uniform("flip", F.col("row_id"), seed) < eta, 1 - F.col("y")).otherwise(F.col("y")).cast("int"))


def apply_world(df: DataFrame, kind: str, params: dict[str, float], by: list[str], num: list[str], cat: list[str], seed: int = 42) -> DataFrame:
    """The world of the given kind; seed is shifted by the caller for each fold."""
    if kind == "noise_outliers":
        return outliers(gaussian_noise(df, by, num, seed, params["std_fraction"]), by, num, seed, params["outlier_frac"])
    if kind == "subgroup":
        return subgroup_shift(df, by, num, seed, cat, params["scale"])
    kinds = {
        "clean": clean, "missingness": missingness, "shift": additive_shift, "surrogates": surrogates, "nonlinear": nonlinear,
        "prevalence": prevalence_resample, "concept_drift": concept_drift, "label_noise": label_noise,
    }
    return kinds[kind](df, by, num, seed, **params)


def all_worlds(df: DataFrame, by: list[str], num: list[str], cat: list[str], seed: int = 42) -> DataFrame:
    """Every world of the catalogue, stacked with world and severity."""
    out = None
    for name, kind, params, severity in CATALOGUE:
        one = apply_world(df, kind, params, by, num, cat, seed + 1000 * severity).select(*df.columns)
        one = one.withColumns({"world": F.lit(name), "severity": F.lit(severity)})
        out = one if out is None else out.unionByName(one)
    return out
