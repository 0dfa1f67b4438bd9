"""Ranks, tests, effect sizes and intervals over groups of a table."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paravane.functions.draws import uniform
from paravane.functions.scalars import finite, ratio

from .quantiles import exact_quantiles, with_group_facts


def average_rank(by: list[str], value: str, descending: bool = True) -> Column:
    """Rank in the group, ties sharing their mean rank."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def min_rank(by: list[str], value: str, descending: bool = True) -> Column:
    """Rank in the group, ties sharing the least rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc() if descending else F.col(value).asc()))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation of a group's two columns, null where one doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(df: DataFrame, by: list[str], a: str, b: str, name: str = "spearman") -> DataFrame:
    """Correlation of the average ranks of two columns; null under two rows or when one is constant."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.select(*by, average_rank(by, a).alias("ra"), average_rank(by, b).alias("rb"))
    return ranked.groupBy(*by).agg(correlation("ra", "rb").alias(name))


def kendall(df: DataFrame, by: list[str], item: str, a: str, b: str, name: str = "kendall") -> DataFrame:
    """Kendall's tau-b over all pairs of items; meant for few items in a group, such as models."""
    l, r = df.select(*by, F.col(item).alias("i"), F.col(a).alias("a1"), F.col(b).alias("b1")), df.select(*by, F.col(item).alias("j"), F.col(a).alias("a2"), F.col(b).alias("b2"))
    pairs = l.join(r, by).where("i < j") if by else l.join(r, F.col("i") < F.col("j"))
    sa, sb = F.signum(F.col("a1") - F.col("a2")), F.signum(F.col("b1") - F.col("b2"))
    return pairs.groupBy(*by).agg(F.try_divide(F.sum(sa * sb), F.sqrt(F.sum(sa * sa) * F.sum(sb * sb))).alias(name))


def holm(df: DataFrame, by: list[str], p: str, order: list[str], name: str) -> DataFrame:
    """df with Holm's step-down p-values in each group; a missing p counts as 1. `order` breaks ties."""
    w = Window.partitionBy(*by).orderBy("__p", *order)
    out = df.withColumn("__p", F.coalesce(F.nanvl(F.col(p).cast("double"), F.lit(1.0)), F.lit(1.0)))
    step = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy(*by)) - F.row_number().over(w) + 1) * F.col("__p"))
    out = out.withColumn("__s", step)
    return out.withColumn(name, F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__p", "__s")


def bootstrap_mean(df: DataFrame, by: list[str], value: str, replicates: int = 2000, seed: int = 42, level: float = 0.95, mode: str = "exact") -> DataFrame:
    """n, mean, ci_lo and ci_hi: percentile bootstrap of the mean of the finite values of each group.

    Rows are numbered by value, and each replicate draws n of those numbers by keyed hashes. mode "poisson" gives
    each row a Poisson(1) weight in each replicate instead: no numbering and no join, for large groups.
    """
    rows = df.where(finite(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("v"))
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    if mode == "poisson":
        u = uniform("poisson", *[F.col(c) for c in by], F.col("v"), F.col("rep"), seed)
        cuts, total, term = [], 0.0, math.exp(-1)
        for k in range(8):
            total += term
            cuts.append(F.when(u > total, 1).otherwise(0))
            term /= k + 1
        drawn = rows.withColumn("rep", reps).withColumn("w", sum(cuts[1:], cuts[0]))
        means = drawn.groupBy(*by, "rep").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"))
    else:
        numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("v")))
        sized = numbered.groupBy(*by).agg(F.count("*").alias("n"))
        draws = sized.withColumn("rep", reps).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        u = uniform("boot", F.col("rep"), F.col("slot"), seed)
        draws = draws.withColumn("i", F.floor(u * F.col("n")).cast("int") + 1)
        means = draws.join(numbered, [*by, "i"]).groupBy(*by, "rep").agg(F.avg("v").alias("m"))
    q = lambda x: F.expr(f"percentile(m, {x!r})")
    out = means.groupBy(*by).agg(q((1 - level) / 2).alias("ci_lo"), q((1 + level) / 2).alias("ci_hi"))
    plain = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    return plain.join(out, by) if by else plain.crossJoin(out)


def paired_t(df: DataFrame, by: list[str], d: str) -> DataFrame:
    """n, mean_delta and t statistic of the non-null differences; null t under two rows or without spread."""
    t = F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d).cast("double")))
    return df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_delta"), t.alias("t_stat"))


def cohen_dz(df: DataFrame, by: list[str], d: str) -> DataFrame:
    """Mean over sample deviation of the differences; null under two rows or without spread."""
    return df.groupBy(*by).agg(F.when(F.count(d) >= 2, F.try_divide(F.avg(d), F.stddev_samp(d))).alias("dz"))


def signed_ranks(df: DataFrame, by: list[str], d: str) -> DataFrame:
    """Of the non-zero differences: n, w_plus, w_minus, wilcoxon (the lesser), ties (sum of t^3 - t), rank_biserial."""
    rows = df.where(F.col(d).isNotNull() & (F.col(d) != 0)).withColumn("__m", F.abs(d))
    ranked = rows.select(*by, F.col(d).alias("d"), average_rank(by, "__m", descending=False).alias("r"), F.count("*").over(Window.partitionBy(*by, "__m")).alias("t"))
    plus, minus = F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n_nonzero"), plus.alias("w_plus"), minus.alias("w_minus"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("ties"))
    return out.withColumns({"wilcoxon": F.least("w_plus", "w_minus"), "rank_biserial": ratio(F.col("w_plus") - F.col("w_minus"), F.col("w_plus") + F.col("w_minus"))})


def sign_test(df: DataFrame, by: list[str], d: str) -> DataFrame:
    """n_pos, n_neg and the exact two-sided p of the sign test; zeros are left out, p is 1 without any row."""
    n = df.groupBy(*by).agg(F.count_if(F.col(d) > 0).alias("n_pos"), F.count_if(F.col(d) < 0).alias("n_neg"))
    total, low = F.col("n_pos") + F.col("n_neg"), F.least("n_pos", "n_neg")
    # log of n choose k, summed as logs of (n - k + i) / i
    choose = lambda k: F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), F.lit(0.0), lambda s, i: s + F.when(i <= k, F.ln((total - k + i) / i)).otherwise(0.0))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), low), F.lit(0.0), lambda s, k: s + F.exp(choose(k) - total * math.log(2)))
    return n.withColumn("p_sign", F.least(F.lit(1.0), 2 * tail))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    x = df / (df + t * t)
    front = math.exp(math.lgamma(df / 2 + 0.5) - math.lgamma(df / 2) - math.lgamma(0.5) + df / 2 * math.log(x) + 0.5 * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    if x < (df / 2 + 1) / (df / 2 + 2.5):
        return front * _beta_fraction(df / 2, 0.5, x) / (df / 2)
    return 1 - front * _beta_fraction(0.5, df / 2, 1 - x) / 0.5


def wilcoxon_tail(w: float, n: int, ties: float) -> float:
    """Two-sided p: exact up to 50 untied differences, else the normal approximation with its tie correction."""
    if n == 0:
        return 1.0
    if n <= 50 and ties == 0:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return min(1.0, math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * var))) if var > 0 else 1.0


def t_pvalue(t: Column, n: Column) -> Column:
    """p of a paired t statistic over n pairs; applied to aggregated rows only."""

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_tail(x, k - 1) if x == x and k > 1 else None for x, k in zip(t, n)], dtype=float)

    return p(t.cast("double"), n.cast("double"))


def wilcoxon_pvalue(w: Column, n: Column, ties: Column) -> Column:
    """p of a signed-rank statistic; applied to aggregated rows only."""

    @F.pandas_udf("double")
    def p(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon_tail(x, int(k), t) if x == x else None for x, k, t in zip(w, n, ties)], dtype=float)

    return p(w.cast("double"), n.cast("double"), ties.cast("double"))


def paired_tests(df: DataFrame, by: list[str], d: str, scope: list[str] | None = None) -> DataFrame:
    """All paired statistics of the differences in each group, p-values included, with Holm's over groups of `scope`."""
    out = paired_t(df, by, d).join(cohen_dz(df, by, d), by, "left").join(signed_ranks(df, by, d), by, "left")
    out = out.withColumns({"t_p": t_pvalue(F.col("t_stat"), F.col("n")), "wilcoxon_p": wilcoxon_pvalue(F.col("wilcoxon"), F.col("n_nonzero"), F.col("ties"))})
    return holm(holm(out, scope or [], "wilcoxon_p", by, "wilcoxon_p_holm"), scope or [], "t_p", by, "t_p_holm")


def describe(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of a column."""
    plain = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    quartiles = exact_quantiles(df, by, c, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return with_group_facts(plain, quartiles, by, "left").select(*by, "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def histogram(df: DataFrame, by: list[str], c: str, bins: int = 30) -> DataFrame:
    """(by.., bin, lo, n): equal-width counts between a group's least and greatest value; the last bin is closed."""
    ends = df.groupBy(*by).agg(F.min(c).alias("mn"), F.max(c).alias("mx"))
    rows = (df.join(F.broadcast(ends), by) if by else df.crossJoin(F.broadcast(ends))).where(F.col(c).isNotNull())
    place = F.when(F.col("mx") == F.col("mn"), 0).otherwise(F.floor((F.col(c) - F.col("mn")) / (F.col("mx") - F.col("mn")) * bins))
    rows = rows.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
    return rows.groupBy(*by, "bin").agg(F.min(F.col("mn") + (F.col("mx") - F.col("mn")) * F.col("bin") / bins).alias("lo"), F.count("*").alias("n"))


def ols(df: DataFrame, y: str, xs: list[str], by: list[str] | None = None) -> DataFrame:
    """Least squares of y on xs with an intercept in each group: by.., term, coef, se, t_stat, p, ci_lo, ci_hi, vif, r2, adj_r2, n.

    One aggregation gives the covariances of each group's complete rows; coefficients, errors and inflation factors come
    from the inverse of that small matrix. A group needs three complete rows at least, more rows than terms, and regressors
    that aren't collinear; others give no rows. Without `by`, too few rows are an error.
    """
    by, k = by or [], len(xs)
    names = [*xs, y]
    rows = df.select(*by, *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(names)]).dropna(subset=[f"__{i}" for i in range(k + 1)])
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.array(*[F.avg(f"__{i}") for i in range(k + 1)]).alias("mean"), F.array(*[F.covar_pop(f"__{i}", f"__{j}") for i, j in pairs]).alias("cov")
    )
    if not by and (n := rows.count()) < max(3, k + 2):
        raise ValueError(f"{n} complete rows are too few for {k} terms")
    terms = [*xs, "intercept"]
    fields = "term string, coef double, se double, t_stat double, p double, ci_lo double, ci_hi double, vif double, r2 double, adj_r2 double, n long"

    def solve(pdfs):
        import numpy as np
        import pandas as pd

        for pdf in pdfs:
            out = []
            for _, r in pdf.iterrows():
                n, c, m = int(r["n"]), np.zeros((k + 1, k + 1)), np.asarray(r["mean"], float)
                if n < max(3, k + 2):
                    continue
                for (i, j), v in zip(pairs, r["cov"]):
                    c[i, j] = c[j, i] = v
                if np.linalg.matrix_rank(c[:k, :k] / np.sqrt(np.outer(d := np.maximum(np.diag(c)[:k], 1e-300), d))) < k:
                    continue
                inverse = np.linalg.inv(c[:k, :k])
                slope = inverse @ c[:k, k]
                explained, free = slope @ c[:k, k], n - k - 1
                s2 = max(0.0, c[k, k] - explained) * n / free
                coef = np.append(slope, m[k] - slope @ m[:k])
                se = np.sqrt(s2 / n * np.append(np.diag(inverse), 1 + m[:k] @ inverse @ m[:k]))
                vif = [*(np.diag(inverse) * np.diag(c)[:k]).tolist(), None]
                r2 = explained / c[k, k] if c[k, k] > 0 else None
                adjusted = None if r2 is None else 1 - (1 - r2) * (n - 1) / free
                half = t_point(free)
                for name, b, e, f in zip(terms, coef.tolist(), se.tolist(), vif):
                    t = b / e if e > 0 else None
                    p = None if t is None else t_tail(abs(t), free)
                    out.append((*[r[g] for g in by], name, b, e, t, p, b - half * e, b + half * e, f, r2, adjusted, n))
            yield pd.DataFrame(out, columns=[*by, *[x.split()[0] for x in fields.split(", ")]])

    groups = [f"`{g}` {df.schema[g].dataType.simpleString()}" for g in by]
    return sums.mapInPandas(solve, ", ".join([*groups, fields]))


def t_point(free: float, tail: float = 0.05) -> float:
    """The two-sided point of Student's t."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_tail(mid, free) > tail else (lo, mid)
    return lo
