"""Forests of all groups and held-out folds in one plan, grown level by level from histograms.

Features are binned once. For each level every task adds up, for the rows it has, the class weights by (group, held fold,
tree, node, feature, bin); Spark sums them, and each node's split is chosen from its own small histogram. A level is one
aggregation for all groups, folds and trees, whatever the number of rows; the driver holds the splits alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paravane.sources.editions import kept

from .quantiles import with_group_facts

#: Bytes of histograms that a task holds at most for each group; more trees are grown block by block.
TASK_BYTES = 1 << 26


def binned(rows: DataFrame, by: list[str], num: list[str], cat: list[str], bins: int = 32) -> DataFrame:
    """by.., fold, row_id, y, b: each feature's bin, as one array of bytes, written.

    Numbers are cut at their group's approximate quantiles (bin 0 holds nulls too); categories are numbered by frequency,
    and those beyond `bins` share the last bin.
    """
    cuts = rows.groupBy(*by).agg(*[F.percentile_approx(c, [i / bins for i in range(1, bins)], 10_000).alias(f"__q_{c}") for c in num])
    out = with_group_facts(rows, cuts, by, "left")
    parts = [F.coalesce(F.size(F.filter(F.array_distinct(f"__q_{c}"), lambda q: q < F.col(c))), F.lit(0)) for c in num]  # noqa: B023
    for c in cat:
        order = Window.partitionBy(*by).orderBy(F.desc("count"), c)
        codes = rows.where(F.col(c).isNotNull()).groupBy(*by, c).count().withColumn(f"__c_{c}", F.row_number().over(order) - 1)
        out = with_group_facts(out, codes.where(F.col(f"__c_{c}") < bins - 1).drop("count"), [*by, c], "left")
        parts.append(F.coalesce(f"__c_{c}", F.lit(bins - 1)))
    hexed = F.unhex(F.concat(*[F.lpad(F.hex(F.greatest(p, F.lit(0)).cast("long")), 2, "0") for p in parts]))
    return kept(out.select(*by, "fold", "row_id", "y", hexed.alias("b")), "binned")


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_weights(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample: Poisson(1), keyed by row, tree and seed."""
    with np.errstate(over="ignore"):
        key = _mixed(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mixed(np.uint64([tree * 1_000_003 + seed])))
    u = (key >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 16)])), u, "right").astype(float)


class Tree:
    """Splits of a binary tree in heap order: feature (-1: none), last bin of the left side, and the value of each node."""

    def __init__(self, depth: int):
        self.feature = np.full(2**depth - 1, -1, np.int16)
        self.cut, self.value = np.zeros(2**depth - 1, np.int16), np.zeros(2 ** (depth + 1) - 1)

    def place(self, x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's node after so many levels, and whether all of them had a split."""
        at, alive = np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for _ in range(levels):
            f = self.feature[np.minimum(at, len(self.feature) - 1)]
            alive &= f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[np.minimum(at, len(self.cut) - 1)]
            at = np.where(alive, 2 * at + 1 + right, at)
        return at, alive


def best_split(pos: np.ndarray, all_: np.ndarray, features: np.ndarray, random: np.random.Generator | None = None) -> tuple[int, int, float]:
    """Feature, last bin of the left side and Gini gain of a node with class weights pos of all_ by (feature, bin).

    With random each feature has one random cut between its ends, and the best of these is taken. (-1, 0, 0.0) if none gains.
    """
    impurity = lambda p, n: np.where(n > 0, 2 * p * (n - p) / np.maximum(n, 1e-300), 0.0)
    p, n = pos[0].sum(), all_[0].sum()
    left_p, left_n = np.cumsum(pos, axis=1)[:, :-1], np.cumsum(all_, axis=1)[:, :-1]
    gain = impurity(p, n) - impurity(left_p, left_n) - impurity(p - left_p, n - left_n)
    gain = np.round(gain / n, 10) * n  # so that equally good cuts are equal, in whatever order weights were added
    gain[(left_n <= 0) | (n - left_n <= 1e-12)] = 0.0
    allowed = np.zeros(len(pos), bool)
    allowed[features] = True
    gain[~allowed] = 0.0
    if random is not None:
        for f in features:
            held = np.flatnonzero(all_[f])
            only = random.integers(held[0], held[-1]) if len(held) > 1 else 0
            gain[f, np.arange(gain.shape[1]) != only] = 0.0
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(f), int(b), float(gain[f, b])) if gain[f, b] > 1e-12 * max(n, 1) else (-1, 0, 0.0)


def grow(
    rows: DataFrame, by: list[str], folds: list[int], width: int, trees: list[int], depth: int, bins: int = 32, few: int | None = None,
    bootstrap: bool = True, random_cuts: bool = False, balanced: bool = True, seed: int = 42,
) -> dict[tuple, Tree]:
    """(group.., held fold, tree) → Tree, fitted on binned() rows outside the held fold.

    few: features that a node may choose from, drawn by a hash of tree and node (all where None); balanced: classes weigh the
    same in each group and held fold.
    """
    spark, few = rows.sparkSession, few or width
    counts = rows.groupBy(*by, "fold").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).collect()
    totals: dict[tuple, list[float]] = {}
    for r in counts:
        for k in folds:
            mine = totals.setdefault((*[r[g] for g in by], k), [0.0, 0.0])
            if r.fold != k:
                mine[0], mine[1] = mine[0] + r.pos, mine[1] + r.n - r.pos
    weights = {key: ((a + b) / (2 * a), (a + b) / (2 * b)) if balanced and a and b else (1.0, 1.0) for key, (a, b) in totals.items()}
    model = {(*key, t): Tree(depth) for key in totals for t in trees}
    keys = [f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in by]
    at = [*by, "held", "tree", "node"]

    for level in range(depth):
        sent, first, nodes = spark.sparkContext.broadcast(model), 2**level - 1, 2**level

        def count(batches: Iterator[pd.DataFrame], sent=sent, first=first, nodes=nodes, level=level) -> Iterator[pd.DataFrame]:
            size = nodes * width * bins
            sums: dict[tuple, np.ndarray] = {}
            for pdf in batches:
                for name, part in pdf.groupby(by, dropna=False) if by else [((), pdf)]:
                    x = np.frombuffer(b"".join(part["b"]), np.uint8).reshape(-1, width)
                    y, fold, ids = part["y"].to_numpy(float), part["fold"].to_numpy(), part["row_id"].to_numpy()
                    y = y.astype(np.int64)
                    for t in trees:
                        drawn = poisson_weights(ids, t, seed) if bootstrap else np.ones(len(ids))
                        for k in folds:
                            key = (*name, k)
                            rows_ = np.flatnonzero((fold != k) & (drawn > 0))
                            node, alive = sent.value[(*key, t)].place(x[rows_], level)
                            rows_, node = rows_[alive], node[alive] - first
                            w = np.array(weights[key][::-1])[y[rows_]] * drawn[rows_]
                            base, mine = node * (width * bins) + y[rows_] * size, sums.setdefault((*key, t), np.zeros((2, size)))
                            for f in range(width):  # negatives come first, then positives
                                mine += np.bincount(base + (f * bins + x[rows_, f]), w, 2 * size).reshape(2, size)
            for key, mine in sums.items():
                mine = np.array([mine[1], mine[0] + mine[1]])
                found = np.flatnonzero(mine[1])
                out = pd.DataFrame({"node": found // (width * bins), "cell": found % (width * bins), "pos": mine[0][found], "n": mine[1][found]})
                for i, (g, value) in enumerate(zip([*by, "held", "tree"], key)):
                    out.insert(i, g, value)
                yield out

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            head = pdf.iloc[0]
            pos, all_ = np.zeros(width * bins), np.zeros(width * bins)
            pos[pdf["cell"]], all_[pdf["cell"]] = pdf["pos"], pdf["n"]
            pos, all_ = pos.reshape(width, bins), all_.reshape(width, bins)
            rng = np.random.default_rng([seed, int(head["tree"]), int(head["node"]) + first])  # noqa: B023
            f, b, gain = best_split(pos, all_, rng.choice(width, few, replace=False), rng if random_cuts else None)
            value = pos[0].sum() / all_[0].sum()
            left_n, right_n = (all_[f, : b + 1].sum(), all_[f, b + 1 :].sum()) if f >= 0 else (0.0, 0.0)
            sides = (pos[f, : b + 1].sum() / left_n, pos[f, b + 1 :].sum() / right_n) if f >= 0 else (value, value)
            return pd.DataFrame([(*[head[c] for c in at], f, b, gain, value, *sides)], columns=[*at, "feature", "cut", "gain", "value", "left", "right"])

        schema = ", ".join([*keys, "held int, tree int, node long"])
        sums = rows.mapInPandas(count, f"{schema}, cell long, pos double, n double").groupBy(*at, "cell").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
        chosen = sums.groupBy(*at).applyInPandas(choose, f"{schema}, feature int, cut int, gain double, value double, left double, right double").collect()
        for r in chosen:
            tree, node = model[(*[r[g] for g in by], r.held, r.tree)], first + r.node
            tree.value[node] = r.value
            if r.feature >= 0:
                tree.feature[node], tree.cut[node] = r.feature, r.cut
                tree.value[2 * node + 1], tree.value[2 * node + 2] = r["left"], r["right"]
        sent.destroy()
    return model


def forest_scores(
    rows: DataFrame, by: list[str], num: list[str], cat: list[str], folds: list[int], trees: int = 100, depth: int = 6, bins: int = 32, random_cuts: bool = False, seed: int = 42
) -> DataFrame:
    """by.., fold, row_id, y, p: each row's share of class 1 in the forest that didn't see its fold, for all groups and folds.

    rows(by.., fold, row_id, y, features). Trees choose among sqrt(features) at each node and weigh classes the same. With
    random_cuts each tree sees all rows and cuts at random places (extremely randomised trees); else it sees a bootstrap sample.
    """
    table, width = binned(rows, by, num, cat, bins), len(num) + len(cat)
    few = max(1, round(width**0.5))
    block = max(1, TASK_BYTES // (2 ** (depth - 1) * width * bins * 16 * len(folds)))
    model: dict[tuple, Tree] = {}
    for i in range(0, trees, block):
        model |= grow(table, by, folds, width, list(range(i, min(trees, i + block))), depth, bins, few, not random_cuts, random_cuts, True, seed)
    sent = table.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.frombuffer(b"".join(pdf["b"]), np.uint8).reshape(-1, width)
            p = np.full(len(pdf), np.nan)
            for name, where in pdf.reset_index(drop=True).groupby([*by, "fold"], dropna=False).groups.items():
                key, mine = name if isinstance(name, tuple) else (name,), np.asarray(where)
                p[mine] = np.mean([(tree := sent.value[(*key, t)]).value[tree.place(x[mine], depth)[0]] for t in range(trees)], axis=0)
            yield pdf.drop(columns="b").assign(p=p)

    cols = [*by, "fold", "row_id", "y"]
    return table.mapInPandas(score, table.select(*cols).withColumn("p", F.lit(0.0)).schema)
