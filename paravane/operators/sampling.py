"""Folds, subsamples and samples: exact counts by keyed hash order, without one task for a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paravane.functions.draws import Tails, hash32, key
from paravane.sources.editions import dealt, kept

#: A group's rows are numbered in 2 ** SLICE_BITS slices of the hash range, about equal, so a group of 4e9 rows has 1e6 in one.
SLICE_BITS = 12
#: Rows whose digests are made at once: what md5 works on stays in a core's cache.
DRAW_ROWS = 8192


def hash_rank(df: DataFrame, by: list[str], k: Column, row_id: str = "row_id", name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) in its group by the hash of k, ties by row_id."""
    return draw_rank(df, by, hash32(k), row_id, name)


def draw_rank(df: DataFrame, by: list[str], draw: Column, row_id: str = "row_id", name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) in its group by a 32-bit draw, ties by row_id.

    Rows are numbered inside slices of the draws' range; the counts of lower slices, 2 ** SLICE_BITS rows a group at most, are added.
    """
    rows = df.withColumn("__h", draw).withColumn("__s", F.shiftright("__h", 32 - SLICE_BITS).cast("int"))
    low = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy(*by, "__s").agg(F.count("*").alias("__n")).select(*by, "__s", F.coalesce(F.sum("__n").over(low), F.lit(0)).alias("__low"))
    inside = Window.partitionBy(*by, "__s").orderBy("__h", row_id)
    return rows.join(offset, [*by, "__s"]).withColumn(name, F.row_number().over(inside) + F.col("__low")).drop("__h", "__s", "__low")


def stratified_folds(df: DataFrame, by: list[str], k: int = 5, repeats: int = 3, seed: int = 42, mode: str = "exact") -> DataFrame:
    """df once for each repeat, with repeat and fold (1 .. k * repeats): class shares are the same in all folds.

    mode "hash" needs no numbering: fold sizes are then equal only in the mean.
    """
    many = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    draw = key("fold", F.col("repeat"), F.col("row_id"), seed)
    if mode == "hash":
        return many.withColumn("fold", (F.col("repeat") - 1) * k + (hash32(draw) % k).cast("int") + 1)
    ranked = hash_rank(many, [*by, "repeat", "y"], draw)
    return ranked.withColumn("fold", ((F.col("repeat") - 1) * k + (F.col("rank") - 1) % k + 1).cast("int")).drop("rank")


def class_targets(counts: DataFrame, by: list[str], n: int, floor: int = 2) -> DataFrame:
    """(by.., y, want): rows to draw of each class so that n are drawn and each class has `floor` where it can.

    Shares are rounded and held between the floor and the class size; the larger class takes up the difference.
    """
    total = Window.partitionBy(*by)
    share = F.round(F.lit(n) * F.col("n") / F.sum("n").over(total))
    held = counts.withColumn("__t", F.least(F.col("n"), F.greatest(F.least(F.lit(floor), F.col("n")), share)))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "y")) == 1
    rest = F.least(F.lit(n), F.sum("n").over(total)) - F.sum("__t").over(total)
    want = F.when(first, F.greatest(F.lit(0), F.least(F.col("n"), F.col("__t") + rest))).otherwise(F.col("__t"))
    return held.select(*by, "y", want.cast("long").alias("want"))


def run_draws(df: DataFrame, runs: int, bound: str, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """df's rows once for each run whose 32-bit draw is at most the column `bound`, with run_id and the draw h.

    A draw is eight hex digits of an md5, and one digest gives those of four runs. Rows are dealt anew before, since even a
    small file, which one task reads, has runs / 4 digests a row to make; they are made in Arrow batches.
    """
    tail = F.concat_ws("|", F.lit(""), F.col(row_id).cast("string"), F.lit(str(seed)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, DRAW_ROWS):
                batch = whole.slice(start, DRAW_ROWS)
                limit, tails = batch.column("__limit").to_numpy(), Tails(batch.column("__tail").to_pylist())
                at, run, h = [], [], []
                for block in range((runs + 3) // 4):
                    for i, word in enumerate(tails.md5_words(f"subsample|{block}")[: runs - 4 * block]):
                        hit = np.flatnonzero(word <= limit)
                        at.append(hit)
                        run.append(np.full(len(hit), 4 * block + i + 1, np.int32))
                        h.append(word[hit].astype(np.int64))
                rows = batch.drop_columns(["__limit", "__tail"]).take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(run)), pa.array(np.concatenate(h))], [*rows.schema.names, "run_id", "h"])

    asked = df.select("*", tail.alias("__tail"), F.col(bound).cast("long").alias("__limit"))
    return dealt(asked, row_id).mapInArrow(draw, df.withColumns({"run_id": F.lit(1), "h": F.lit(1).cast("long")}).schema)


def stratified_subsample(df: DataFrame, by: list[str], n: int, runs: int = 1, floor: int = 2, seed: int = 42) -> DataFrame:
    """`runs` subsamples of n rows of each group without replacement, with run_id; classes as class_targets() says.

    Of a row's draws for all runs only those under a bound, about where the wanted number ends and a wide margin beyond, are
    written, then numbered. Where the bound leaves a run short, all its rows are numbered.
    """
    sizes = df.groupBy(*by, "y").agg(F.count("*").alias("n"))
    want = kept(class_targets(sizes, by, n, floor).join(sizes, [*by, "y"]), "subsample-targets")
    share = F.least((F.col("want") + 12 * F.sqrt("want") + 20) / F.col("n"), F.lit(1.0))
    bound = lambda share: F.least(share * 2.0**32, F.lit(2.0**32 - 1)).cast("long")
    each = df.join(F.broadcast(want.select(*by, "y", "want", bound(share).alias("__bound"))), [*by, "y"])
    drawn = lambda d: run_draws(d, runs, "__bound", seed).select(*df.columns, "want", "run_id", "h")
    near = kept(drawn(each), "subsample-draws")
    groups = want.select(*by, "y", "want", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run_id"))
    held = near.groupBy(*by, "run_id", "y").agg(F.count("*").alias("__held"))
    short = kept(groups.join(held, [*by, "run_id", "y"], "left").where("coalesce(__held, 0) < want").select(*by, "y", "run_id"), "subsample-short")
    if not short.isEmpty():
        near = near.join(F.broadcast(short), [*by, "run_id", "y"], "left_anti")
        near = near.unionByName(drawn(each.withColumn("__bound", F.lit(2**32 - 1))).join(F.broadcast(short), [*by, "y", "run_id"]))
    ranked = draw_rank(near, [*by, "run_id", "y"], F.col("h"))
    return ranked.where(F.col("rank") <= F.col("want")).select(*df.columns, "run_id")


def safe_folds(df: DataFrame, by: list[str], desired: int) -> DataFrame:
    """n_folds of each group: the desired number or the size of the smallest class, 0 if under 2."""
    sizes = df.groupBy(*by, "y").agg(F.count("*").alias("n")).groupBy(*by).agg(F.min("n").alias("n"), F.count("*").alias("classes"))
    n = F.when(F.col("classes") < 2, 0).otherwise(F.least(F.lit(desired), F.col("n")))
    return sizes.select(*by, F.when(n < 2, 0).otherwise(n).cast("int").alias("n_folds"))


def fixed_sample(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k rows in keyed hash order."""
    return df.orderBy(hash32(key("sample", F.col("row_id"), seed)), "row_id").limit(k)
