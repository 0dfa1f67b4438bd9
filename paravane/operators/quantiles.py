"""Exact quantiles from counts of distinct values, without one task for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group's distinct values are dealt into so many slices of about equal size, by their approximate quantiles.
SLICES, ACCURACY = 64, 1000


def quantiles_of_counts(shares: list[float], n: Column, below: Column, total: Column, value: str = "p") -> list[Column]:
    """Aggregates over counted values: their exact quantiles, interpolated between neighbours.

    n rows hold the value, `below` hold less, and total are in the group. The row at a place is the greatest value
    that has no more rows below it.
    """
    at = lambda place: F.max(F.when((n > 0) & (below <= place), F.col(value)))
    out = []
    for share in shares:
        place = (total - 1) * share
        low, high = at(F.floor(place)), at(F.ceil(place))
        up, down = F.max(place - F.floor(place)), F.max(F.ceil(place) - place)
        out.append(F.when(low == high, low).otherwise(down * low + up * high))
    return out


def with_group_facts(df: DataFrame, facts: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """df with the other columns of facts, which has one row for each group; null keys are groups too."""
    if not by:
        return df.crossJoin(F.broadcast(facts))
    named = facts.withColumnsRenamed({k: f"__by_{k}" for k in by})
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"__by_{k}")) for k in by], how).drop(*[f"__by_{k}" for k in by])


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by.., and a column for each of shares: exact quantiles of the non-null values, interpolated between neighbours.

    Rows shuffle once, as counts of distinct values. Totals of slices, SLICES rows a group, tell which slices hold the
    places that are asked for, and only their values are put in order. A group without values gives no row; without
    `by` there is always one row, of nulls for an empty table.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    cuts = F.percentile_approx("__v", [i / SLICES for i in range(1, SLICES)], ACCURACY)
    groups = counts.groupBy(*by).agg(cuts.alias("__cuts"), F.sum("__n").alias("__total"))
    sliced = with_group_facts(counts, groups, by).withColumn("__slice", F.size(F.filter("__cuts", lambda c: c <= F.col("__v")))).drop("__cuts")
    low = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy(*by, "__slice").agg(F.sum("__n").alias("__m"), F.max("__total").alias("__total"))
    slices = slices.withColumn("__low", F.coalesce(F.sum("__m").over(low), F.lit(0)))
    place = lambda share: (F.col("__total") - 1) * share
    asked = F.lit(False)
    for share in shares.values():
        asked = asked | ((F.col("__low") <= F.ceil(place(share))) & (F.col("__low") + F.col("__m") > F.floor(place(share))))
    near = with_group_facts(sliced, slices.where(asked).drop("__total", "__m"), [*by, "__slice"])
    inside = Window.partitionBy(*by, "__slice").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("__below", F.col("__low") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    found = quantiles_of_counts(list(shares.values()), F.col("__n"), F.col("__below"), F.col("__total"), "__v")
    return near.groupBy(*by).agg(*[q.alias(name) for q, name in zip(found, shares)])


def table_quantile(df: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """by.., and as name the exact quantile of the non-null values, for a written table, whose rows read the same each time.

    Rows don't shuffle: two approximate quantiles on both sides of the share cut each group into three slices, whose rows
    are counted, and only a slice that holds the places asked for is put in order, about n / SLICES rows. Where the cuts
    are off, that is another slice, never another value. A group without values gives no row.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    near = F.percentile_approx("__v", [max(share - 0.5 / SLICES, 0.0), min(share + 0.5 / SLICES, 1.0)], ACCURACY)
    slice_ = F.when(F.col("__v") < F.col("__cuts")[0], 0).when(F.col("__v") > F.col("__cuts")[1], 2).otherwise(1)
    sliced = rows.join(F.broadcast(rows.groupBy(*by).agg(near.alias("__cuts"))), by).select(*by, slice_.alias("__slice"), "__v")
    all_ = Window.partitionBy(*by)
    low = all_.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy(*by, "__slice").agg(F.count("*").alias("__m"))
    slices = slices.select("*", F.coalesce(F.sum("__m").over(low), F.lit(0)).alias("__low"), F.sum("__m").over(all_).alias("__total"))
    place = (F.col("__total") - 1) * share
    asked = slices.where((F.col("__low") <= F.ceil(place)) & (F.col("__low") + F.col("__m") > F.floor(place))).drop("__m")
    counts = sliced.join(F.broadcast(asked), [*by, "__slice"]).groupBy(*by, "__slice", "__low", "__total", "__v").agg(F.count("*").alias("__n"))
    inside = Window.partitionBy(*by, "__slice").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("__low") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    found = quantiles_of_counts([share], F.col("__n"), F.col("__below"), F.col("__total"), "__v")[0]
    return counts.withColumn("__below", below).groupBy(*by).agg(found.alias(name))


def medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: the exact median of each column under its name, null for a column without values."""
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])
    found = exact_quantiles(df.select(F.inline(each)), ["feature"], "v", {"q": 0.5})
    return found.agg(*[F.max(F.when(F.col("feature") == c, F.col("q"))).alias(c) for c in cols])
