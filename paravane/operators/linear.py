"""Linear models of all groups and held-out folds in one plan, fitted by Newton steps.

Rows are written once, as numbers and category codes; what prepares them (medians, means, deviations, modes) follows from
one small table of moments by group and fold. In each step every task adds up loss, gradient and curvature of all
models over its rows, Spark sums them, and the driver, which holds a vector of weights a model, solves for the next weights.
Logistic regression and the support-vector machine on random features of an RBF kernel differ in their loss alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paravane.sources.editions import dealt, kept

from .quantiles import exact_quantiles, with_group_facts

#: Bytes of curvature that a task holds at most; more models are fitted block by block.
TASK_BYTES = 1 << 27
#: Rows of the largest model in the sample on which a fit begins.
WARM_ROWS = 1 << 17
#: Width of the quadratic that rounds off the hinge loss on either side of its corner.
CORNER = 0.5


def hadamard(x):
    """The Walsh-Hadamard transform of each row, in place; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        pair = x.reshape(n, width // (2 * step), 2, step)
        low, high = pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]
        pair[:, :, 0], pair[:, :, 1] = low, high
        step *= 2
    return x


def fastfood(x, dims: int, gamma: float, seed: int = 42):
    """`dims` random features of each row of x, whose products approximate exp(-gamma * squared distance).

    Random signs, a Hadamard transform, a permutation, Gaussian weights and another transform stand in for a dense
    Gaussian matrix (Le, Sarlos, Smola 2013), so a row costs dims * log(width).
    """
    rng, width = np.random.default_rng(seed), 1 << max(0, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    out = []
    for _ in range(-(-dims // width)):
        sign, order, g = rng.choice([-1.0, 1.0], width), rng.permutation(width), rng.standard_normal(width)
        length = np.sqrt(rng.chisquare(width, width)) / np.linalg.norm(g)
        dot = hadamard(hadamard(padded * sign)[:, order] * g) * length / np.sqrt(width)
        out.append(np.cos(np.sqrt(2 * gamma) * dot + rng.uniform(0, 2 * np.pi, width)))
    return np.sqrt(2 / dims) * np.concatenate(out, axis=1)[:, :dims]


def logistic_loss(z, y):
    """Loss, slope and curvature of the log loss at margins z."""
    q = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return np.logaddexp(0, z) - y * z, q - y, q * (1 - q)


def hinge_loss(z, y):
    """Loss, slope and curvature of the hinge loss at margins z, with its corner rounded off by a quadratic."""
    sign = 2 * y - 1
    short = 1 - sign * z + CORNER
    inside = (short > 0) & (short < 2 * CORNER)
    loss = np.where(short >= 2 * CORNER, short - CORNER, np.where(inside, short**2 / (4 * CORNER), 0.0))
    slope = np.where(short >= 2 * CORNER, 1.0, np.where(inside, short / (2 * CORNER), 0.0))
    return loss, -sign * slope, inside / (2 * CORNER)


LOSSES = {"logistic": logistic_loss, "hinge": hinge_loss}
#: The greatest curvature of each loss.
STEEPEST = {"logistic": 0.25, "hinge": 1 / (2 * CORNER)}


class Preparation:
    """How one model prepares rows, from the rows it was fitted on: fills, scales and category codes, then kernel features."""

    def __init__(self, median, mean, sd, mode: list[int], seen: list[np.ndarray], dims: int | None, seed: int):
        self.median, self.mean, self.sd, self.mode, self.seen, self.dims, self.seed = median, mean, sd, mode, seen, dims, seed
        self.raw = len(mean) + sum(int(s.sum()) for s in seen)
        self.width = (dims or self.raw) + 1

    def __call__(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        parts = [(np.where(np.isnan(x), self.median, x) - self.mean) / self.sd]
        for i, seen in enumerate(self.seen):
            code = np.where(c[:, i] == 0, self.mode[i], c[:, i])  # 0: null, above the last code: rare
            hot = np.zeros((len(c), len(seen)))
            known = np.flatnonzero((code > 0) & (code <= len(seen)))
            hot[known, code[known] - 1] = 1.0
            parts.append(hot[:, seen])
        z = np.concatenate(parts, axis=1)
        if self.dims:
            z = fastfood(z, self.dims, 1 / max(1, self.raw), self.seed)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def coded(rows: DataFrame, by: list[str], num: list[str], cat: list[str], levels: int) -> DataFrame:
    """by.., fold, row_id, y, x, c, written: numbers (NaN for null) and category codes by frequency.

    Code 0 is null; categories beyond a group's `levels` most frequent share code levels + 1.
    """
    out, codes = rows, []
    for i, c in enumerate(cat):
        order = Window.partitionBy(*by).orderBy(F.desc("count"), c)
        found = rows.where(F.col(c).isNotNull() & F.col("fold").isNotNull()).groupBy(*by, c).count().withColumn(f"__c_{i}", F.row_number().over(order))
        out = with_group_facts(out, found.where(F.col(f"__c_{i}") <= levels).drop("count"), [*by, c], "left")
        codes.append(F.when(F.col(c).isNull(), 0).otherwise(F.coalesce(f"__c_{i}", F.lit(levels + 1))).cast("int"))
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in num]).cast("array<double>")
    return kept(dealt(out.select(*by, "fold", "row_id", "y", x.alias("x"), F.array(*codes).cast("array<int>").alias("c"))), "coded")


def preparations(table: DataFrame, by: list[str], folds: list[int], num: int, cat: int, dims: int | None, seed: int) -> dict[tuple, tuple[Preparation, float, float]]:
    """(group.., held fold) → (preparation, negatives, positives) of the coded() rows outside the held fold."""
    rows = table.where(F.col("fold").isNotNull())
    value = [F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(num)]
    moments = rows.groupBy(*by, "fold").agg(
        F.count("*").alias("n"), F.sum("y").cast("double").alias("pos"), *[f(v).alias(f"{k}{i}") for i, v in enumerate(value) for k, f in (("k", F.count), ("a", F.avg), ("v", F.var_pop))]
    ).collect()
    middle: dict[tuple, float] = {}
    if any(r[f"k{i}"] < r.n for r in moments for i in range(num)):  # only nulls need a median
        held = F.explode(F.array(*[F.lit(k) for k in folds])).alias("held")
        long = rows.select(*by, "fold", held, F.posexplode("x").alias("i", "v")).where((F.col("fold") != F.col("held")) & ~F.isnan("v"))
        for r in exact_quantiles(long, [*by, "held", "i"], "v", {"q": 0.5}).collect():
            middle[(*[r[g] for g in by], r.held, r.i)] = r.q
    seen: dict[tuple, dict[int, float]] = {}
    for r in rows.select(*by, "fold", F.posexplode("c").alias("i", "code")).groupBy(*by, "fold", "i", "code").count().collect() if cat else []:
        group = tuple(r[g] for g in by)
        for k in folds:
            if k != r.fold:
                mine = seen.setdefault((*group, k, r.i), {})
                mine[r.code] = mine.get(r.code, 0) + r["count"]
    parts: dict[tuple, list] = {}
    for r in moments:
        for k in folds:
            if k != r.fold:
                parts.setdefault((*[r[g] for g in by], k), []).append(r)
    out = {}
    for key, mine in parts.items():
        n, pos = sum(r.n for r in mine), sum(r.pos for r in mine)
        median, mean, sd = np.zeros(num), np.zeros(num), np.ones(num)
        for i in range(num):
            there = [r for r in mine if r[f"k{i}"]]
            k = sum(r[f"k{i}"] for r in there)
            median[i] = middle.get((*key, i)) or 0.0
            mean[i] = (sum(r[f"k{i}"] * r[f"a{i}"] for r in there) + (n - k) * median[i]) / n
            spread = sum(r[f"k{i}"] * (r[f"v{i}"] + (r[f"a{i}"] - mean[i]) ** 2) for r in there) + (n - k) * (median[i] - mean[i]) ** 2
            sd[i] = (spread / n) ** 0.5 if spread > 1e-20 * n * max(1.0, mean[i] ** 2) else 1.0
        modes, masks = [], []
        for i in range(cat):
            counts = seen.get((*key, i), {})
            known = {c: m for c, m in counts.items() if c > 0}
            modes.append(min(known, key=lambda c: (-known[c], c)) if known else 0)  # noqa: B023
            masks.append(np.array([c in known for c in range(1, max(known, default=0) + 1)], bool))
        out[key] = (Preparation(median, mean, sd, modes, masks, dims, seed), n - pos, pos)
    return out


class _Fit:
    """A model's weights on the way to the minimum: Newton steps, halved while they don't gain."""

    def __init__(self, width: int):
        self.w = self.best = np.zeros(width)
        self.loss, self.done, self.halved = np.inf, False, 0

    def step(self, loss: float, slope: np.ndarray, curve: np.ndarray, tolerance: float) -> None:
        ridge = np.r_[np.ones(len(self.w) - 1), 0.0]  # C = 1; the constant is free
        loss = loss + 0.5 * float(self.w[:-1] @ self.w[:-1])
        if loss > self.loss + 1e-12 * abs(self.loss):
            self.halved += 1
            self.done = self.halved > 30
            self.w = self.best if self.done else (self.w + self.best) / 2
            return
        self.best, self.loss, self.halved = self.w, loss, 0
        slope = slope + ridge * self.w
        move = np.linalg.solve(curve + np.diag(ridge + 1e-9), slope)
        self.done = float(slope @ move) <= tolerance * max(1.0, loss)
        self.w = self.best if self.done else self.best - move


def fit(
    table: DataFrame, by: list[str], prepared: dict[tuple, tuple[Preparation, float, float]], loss: str, balanced: bool, steps: int = 50, tolerance: float = 1e-10
) -> dict[tuple, np.ndarray]:
    """(group.., held fold) → weights of the prepared models: the least sum of losses plus half the squared weights.

    Where there are many rows, Newton steps begin on a hashed sample of them, whose losses are scaled up, and go on over all
    rows until the same tolerance is met there: the sum has one minimum, and only the way to it is shorter.
    """
    rows = table.where(F.col("fold").isNotNull())
    most = max((n0 + n1 for _, n0, n1 in prepared.values()), default=0)
    fits, every = {key: _Fit(p.width) for key, (p, _, _) in prepared.items()}, int(most // WARM_ROWS)
    if every > 1:
        near = {key: _Fit(p.width) for key, (p, _, _) in prepared.items()}
        _descend(rows.where(F.pmod(F.xxhash64("row_id"), F.lit(every)) == 0), by, prepared, near, loss, balanced, steps, 1e-6, float(every))
        for key, found in near.items():
            fits[key].w = fits[key].best = found.best
    _descend(rows, by, prepared, fits, loss, balanced, steps, tolerance)
    return {key: f.best for key, f in fits.items()}


def _descend(rows: DataFrame, by: list[str], prepared: dict, fits: dict[tuple, _Fit], loss: str, balanced: bool, steps: int, tolerance: float, scale: float = 1.0) -> None:
    """Newton steps of all fits over rows, each of which counts `scale` times."""
    spark = rows.sparkSession
    keys = ", ".join([*[f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in by], "held int"])
    widest = max((p.width for p, _, _ in prepared.values()), default=1)
    block, order = max(1, TASK_BYTES // (8 * widest * widest)), list(fits)
    flat = {key for key, f in fits.items() if not f.w.any()}

    for start in range(0, len(order), block):
        for turn in range(steps):
            open_ = {key: fits[key].w for key in order[start : start + block] if not fits[key].done}
            if not open_:
                break
            sent = spark.sparkContext.broadcast((open_, {key: prepared[key] for key in open_}))

            def add(batches: Iterator[pd.DataFrame], sent=sent, first=flat if turn == 0 else set()) -> Iterator[pd.DataFrame]:
                weights, how = sent.value
                of_group: dict[tuple, list[tuple]] = {}
                for key in weights:
                    of_group.setdefault(key[:-1], []).append(key)
                sums: dict[tuple, np.ndarray] = {}
                for pdf in batches:
                    for name, part in pdf.groupby(by, dropna=False) if by else [((), pdf)]:
                        x, c, y, fold = _arrays(part)
                        for key in of_group.get(name, []):
                            here = fold != key[-1]
                            if not here.any():
                                continue
                            prep, n0, n1 = how[key]
                            z, target = prep(x[here], c[here]), y[here]
                            each, slope, curve = LOSSES[loss](z @ weights[key], target)
                            if key in first:  # all rows count as curved as any can be, so that the first step gains
                                curve = np.full(len(target), STEEPEST[loss])
                            if scale != 1:
                                each, slope, curve = each * scale, slope * scale, curve * scale
                            if balanced and n0 and n1:
                                w = np.where(target == 1, (n0 + n1) / (2 * n1), (n0 + n1) / (2 * n0))
                                each, slope, curve = each * w, slope * w, curve * w
                            mine = sums.setdefault(key, np.zeros((prep.width + 1, prep.width + 1)))
                            mine[0, 0] += each.sum()
                            mine[0, 1:] += slope @ z
                            some = curve > 0
                            mine[1:, 1:] += (z[some] * curve[some, None]).T @ z[some]
                for key, mine in sums.items():
                    out = pd.DataFrame({"i": np.arange(len(mine)), "v": list(mine)})
                    for j, (g, v) in enumerate(zip([*by, "held"], key)):
                        out.insert(j, g, v)
                    yield out

            parts = rows.mapInPandas(add, f"{keys}, i int, v array<double>")
            total = parts.groupBy(*by, "held", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()
            found: dict[tuple, np.ndarray] = {}
            for r in total:
                key = (*[r[g] for g in by], r.held)
                found.setdefault(key, np.zeros((len(r.v), len(r.v))))[r.i] = r.v
            for key in open_:
                m = found.get(key)
                if m is None:
                    fits[key].done = True
                else:
                    fits[key].step(m[0, 0], m[0, 1:], m[1:, 1:], tolerance)
            sent.destroy()


def _arrays(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    stack = lambda c, kind: np.stack(part[c].to_numpy()).astype(kind) if len(part) else np.zeros((0, 0), kind)
    return stack("x", float), stack("c", int), part["y"].to_numpy(float), part["fold"].to_numpy(float)


def linear_scores(
    rows: DataFrame, by: list[str], num: list[str], cat: list[str], folds: list[int], loss: str = "logistic", balanced: bool = False,
    dims: int | None = None, levels: int = 256, steps: int = 50, seed: int = 42,
) -> DataFrame:
    """by.., held, fold, row_id, y, p: each row's score by the model that didn't see its fold, for all groups and folds.

    rows(by.., fold, row_id, y, features); y is 0 or 1. A row whose fold is null trains no model and is scored by each
    model of its group (held: the fold that a model didn't see). Numbers are filled with medians and standardised, categories
    are filled with the most frequent one (ties: the one that the group has most of) and one-hot coded, all by the rows that a model is fitted on; of a column's
    categories the `levels` most frequent of a group have codes, others count as unseen. loss "logistic" or "hinge", with
    `dims` random features of an RBF kernel (gamma: 1 over the prepared columns); balanced: classes weigh the same. p is the
    logistic of the margin. A group or fold without training rows gives null.
    """
    table = coded(rows, by, num, cat, levels)
    prepared = preparations(table, by, folds, len(num), len(cat), dims, seed)
    weights = fit(table, by, prepared, loss, balanced, steps)
    sent = table.sparkSession.sparkContext.broadcast({key: (prepared[key][0], w) for key, w in weights.items()})
    cols = [*by, "held", "fold", "row_id", "y"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, c, _, _ = _arrays(pdf)
            p = np.full(len(pdf), np.nan)
            for name, where in pdf.reset_index(drop=True).groupby([*by, "held"], dropna=False).groups.items():
                key, mine = name if isinstance(name, tuple) else (name,), np.asarray(where)
                if key in sent.value:
                    prep, w = sent.value[key]
                    p[mine] = 1 / (1 + np.exp(-np.clip(prep(x[mine], c[mine]) @ w, -500, 500)))
            yield pdf[cols].assign(p=pd.Series(p, pdf.index).astype(object).where(~np.isnan(p), None))

    own = F.when(F.col("fold").isNull(), F.array(*[F.lit(k) for k in folds])).otherwise(F.array(F.col("fold").cast("int")))
    asked = table.withColumn("held", F.explode(own))
    return asked.mapInPandas(score, asked.select(*cols, F.lit(None).cast("double").alias("p")).schema)
