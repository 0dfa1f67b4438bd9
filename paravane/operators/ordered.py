"""Metrics of scored rows from sorted arrays of scores: a group's rows are put in order slice by slice, not row by row.

Every task packs the scores it has into sorted arrays, one for each group and class, with how often each score occurs. Their
spaced values cut a group's range into slices of about SLICE_SCORES distinct scores; totals of slices say how many rows lie
below each; then a slice's arrays are merged in one task. What slices add up to are the exact sums over all distinct scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import with_group_facts

#: Rows that a task packs at once, distinct scores of a slice, and spaced values of each array.
PACK_ROWS, SLICE_SCORES, KNOTS = 1 << 21, 1 << 19, 64
METRICS = ["auroc", "auprc", "brier", "log_loss", "ece", "aece", "brier_rel", "brier_res"]


def _types(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def packed(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys.., pos, size, knots, p, n of df(keys.., y, p): sorted distinct scores and their counts, of positives or negatives.

    Rows without a score are left out; one without a label counts as neither, but its group stays.
    """

    def pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        y = table["__y"].combine_chunks()
        kind = np.where(y.is_null().to_numpy(False), 2, y.fill_null(0).to_numpy(False) == 1).astype(np.int64)
        coded = [table[k].combine_chunks().dictionary_encode(null_encoding="encode") for k in keys]
        group = np.zeros(len(kind), np.int64)
        for c in coded:
            group = np.unique(group * len(c.dictionary) + c.indices.to_numpy(False), return_inverse=True)[1] if len(c.dictionary) > 1 else group
        code = group * 3 + kind
        code = code.astype(np.uint16 if code.max() < 1 << 16 else np.int64)  # small codes are sorted by their bytes
        order = np.argsort(code, kind="stable")
        p, first = table["__p"].to_numpy()[order], np.flatnonzero(np.diff(code[order], prepend=-1))
        out = {"pos": [], "size": [], "knots": [], "p": [], "n": []}
        for a, b in zip(first, [*first[1:], len(order)]):
            k = kind[order[a]]
            x = np.sort(p[a:b]) if k < 2 else p[:0]
            start = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))]) if len(x) else np.zeros(0, int)
            n = np.diff(start, append=len(x)).astype(np.uint32)
            x = x[start]
            for name, v in zip(out, (k == 1, len(x), x[np.linspace(0, len(x) - 1, min(len(x), KNOTS)).astype(int)], x.tobytes(), n.tobytes())):
                out[name].append(v)
        rows = pa.array(order[first])
        types = {"pos": pa.bool_(), "size": pa.int64(), "knots": pa.list_(pa.float64()), "p": pa.binary(), "n": pa.binary()}
        cols = [table[k].combine_chunks().take(rows) for k in keys] + [pa.array(out[c], t) for c, t in types.items()]
        return pa.RecordBatch.from_arrays(cols, [*keys, *types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    rows = df.where(F.col("p").isNotNull()).select(*keys, F.col("y").cast("double").alias("__y"), F.col("p").cast("double").alias("__p"))
    return rows.mapInArrow(run, f"{_types(df, keys)}pos boolean, size long, knots array<double>, p binary, n binary")


def _cuts(pdf: pd.DataFrame, scores: int) -> list[float]:
    """Where slices begin, from the spaced values of a group's arrays, each standing for as many scores."""
    slices = -(-int(pdf["size"].sum()) // scores)
    if slices < 2:
        return []
    x = np.concatenate([np.asarray(k, float) for k in pdf["knots"]])
    w = np.concatenate([np.full(len(k), s / max(1, len(k))) for k, s in zip(pdf["knots"], pdf["size"])])
    order = np.argsort(x)
    below = np.cumsum(w[order])
    return np.unique(x[order][np.searchsorted(below, below[-1] * np.arange(1, slices) / slices)]).tolist()


def _cut(pdf: pd.DataFrame, keys: list[str], totals: bool) -> pd.DataFrame:
    """Each array's part of each slice, or only how many rows it holds."""
    out = []
    for r in pdf.to_dict("records"):
        p, n, cuts = np.frombuffer(r["p"]), np.frombuffer(r["n"], np.uint32), np.asarray(r["cuts"], float)
        ends = np.r_[0, np.searchsorted(p, cuts, "left"), len(p)]
        for i in np.flatnonzero(np.diff(ends)) if len(p) else [0]:
            a, b = ends[i], ends[i + 1]
            what = (float(n[a:b].sum()),) if totals else (p[a:b].tobytes(), n[a:b].tobytes())
            out.append((*[r[k] for k in keys], int(i), bool(r["pos"]), *what))
    return pd.DataFrame(out, columns=[*keys, "slice", "pos", *(["rows"] if totals else ["p", "n"])])


def sliced(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """packed() arrays cut into slices: keys.., slice, pos, p, n, with the rows below (b_pos, b_neg) and of the group (all_pos, all_neg)."""
    types, scores = _types(chunks, keys), SLICE_SCORES
    found = chunks.select(*keys, "size", "knots").groupBy(*keys).applyInPandas(
        lambda pdf: pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], _cuts(pdf, scores))], columns=[*keys, "cuts"]), f"{types}cuts array<double>"
    )
    cut = with_group_facts(chunks.select(*keys, "pos", "p", "n"), found, keys)
    rows = cut.mapInPandas(lambda it: (_cut(pdf, keys, True) for pdf in it), f"{types}slice int, pos boolean, rows double")
    over, all_ = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    each = rows.groupBy(*keys, "slice").agg(*[F.sum(F.when(F.col("pos") == F.lit(v), F.col("rows")).otherwise(0.0)).alias(c) for c, v in (("pos", True), ("neg", False))])
    below = [F.coalesce(F.sum(c).over(over), F.lit(0.0)).alias(f"b_{c}") for c in ("pos", "neg")]
    places = each.select(*keys, "slice", *below, *[F.sum(c).over(all_).alias(f"all_{c}") for c in ("pos", "neg")])
    parts = cut.mapInPandas(lambda it: (_cut(pdf, keys, False) for pdf in it), f"{types}slice int, pos boolean, p binary, n binary")
    return with_group_facts(parts, places, [*keys, "slice"])


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores of a slice in order, with positives and negatives of each."""
    p = np.concatenate([np.frombuffer(b) for b in pdf["p"]])
    n = np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["n"]]).astype(float)
    of = np.repeat(pdf["pos"].to_numpy(bool), [len(b) // 8 for b in pdf["p"]])
    order = np.argsort(p, kind="stable")
    p, pos, neg = p[order], np.where(of, n, 0.0)[order], np.where(of, 0.0, n)[order]
    if not len(p):
        return p, pos, neg
    start = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) & ~(np.isnan(p[1:]) & np.isnan(p[:-1]))])
    return p[start], np.add.reduceat(pos, start), np.add.reduceat(neg, start)


def areas(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys.., auroc, auprc of packed() rows: ties count half; null without positives, auroc without negatives too."""
    types = _types(chunks, keys)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        _, pos, neg = _merged(pdf)
        area, precision = _areas(pos, neg, head)
        return pd.DataFrame([(*[head[k] for k in keys], head["all_pos"], head["all_neg"], area, precision)], columns=[*keys, "all_pos", "all_neg", "area", "precision"])

    parts = sliced(chunks, keys).groupBy(*keys, "slice").applyInPandas(part, f"{types}all_pos double, all_neg double, area double, precision double")
    all_pos, all_neg = F.max("all_pos"), F.max("all_neg")
    return parts.groupBy(*keys).agg(F.try_divide(F.sum("area"), all_pos * all_neg).alias("auroc"), F.try_divide(F.sum("precision"), all_pos).alias("auprc"))


def _areas(pos: np.ndarray, neg: np.ndarray, head: pd.Series) -> tuple[float, float]:
    pos_below, neg_below = head["b_pos"] + np.cumsum(pos) - pos, head["b_neg"] + np.cumsum(neg) - neg
    tp, fp = head["all_pos"] - pos_below, head["all_neg"] - neg_below
    return float((pos * (neg_below + neg / 2)).sum()), float((pos * tp / np.maximum(tp + fp, 1)).sum())


def measured(chunks: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """keys.. and all metrics of metric_bundle() of packed() rows whose scores lie between 0 and 1, ends excluded."""
    types = _types(chunks, keys)
    edges, shares = np.array([i / bins for i in range(bins + 1)]), np.array([i / bins for i in range(1, bins)])

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        """A slice's sums; and of the rows around each quantile's place the scores, with count, score sum and positives up to them."""
        head = pdf.iloc[0]
        p, pos, neg = _merged(pdf)
        n, total, start = pos + neg, head["all_pos"] + head["all_neg"], head["b_pos"] + head["b_neg"]
        floor = np.searchsorted(edges, p, "right") - 1
        fixed = np.concatenate([np.bincount(floor, w, bins + 1)[:bins] for w in (n, p * n, pos)])
        sums = [*_areas(pos, neg, head), (pos * (1 - p) ** 2 + neg * p**2).sum(), (-pos * np.log(p) - neg * np.log(1 - p)).sum(), n.sum(), (p * n).sum(), pos.sum()]
        upto = np.c_[np.zeros(3), np.array([np.cumsum(n), np.cumsum(p * n), np.cumsum(pos)])]
        places, near = (total - 1) * shares, np.full((len(shares), 11), np.nan)
        for place, first in ((np.floor(places), 0), (np.ceil(places), 7)):
            at = np.searchsorted(upto[0], place - start, "right") - 1
            for i in np.flatnonzero((place >= start) & (place < start + upto[0, -1])):
                low = [p[at[i]], *upto[:, at[i]], *upto[:, at[i] + 1]]
                near[i, first : first + 7] = low if first == 0 else [low[0], *low[4:]]
        return pd.DataFrame([(*[head[k] for k in keys], head["slice"], total, head["all_pos"], sums, fixed, near.ravel())], columns=[*keys, "slice", "total", "all_pos", "sums", "fixed", "near"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slice")
        key, total, all_pos = [pdf[k].iloc[0] for k in keys], pdf["total"].iloc[0], pdf["all_pos"].iloc[0]
        if not total:
            return pd.DataFrame([(*key, *[None] * 10)], columns=[*keys, *METRICS, "n_eval", "prevalence"])
        sums, fixed = np.array(pdf["sums"].tolist()), np.array(pdf["fixed"].tolist()).sum(0).reshape(3, bins)
        near, below = np.array(pdf["near"].tolist()).reshape(len(pdf), len(shares), 11), np.cumsum(sums[:, 4:], 0) - sums[:, 4:]
        for first in (1, 4, 8):
            near[:, :, first : first + 3] += below[:, None, :]
        near = np.where(np.isnan(near), -np.inf, near).max(0)  # one slice has each
        all_ = sums.sum(0)
        places, low, high = (total - 1) * shares, near[:, 0], near[:, 7]
        cuts = np.where(low == high, low, (np.ceil(places) - places) * low + (places - np.floor(places)) * high)
        # rows up to a cut: between two neighbours there are none, but rounding can put it on one or below the low one
        upto = np.where((cuts >= high)[:, None], near[:, 8:], np.where((cuts >= low)[:, None], near[:, 4:7], near[:, 1:4]))
        upto = np.maximum.accumulate(np.r_[np.zeros((1, 3)), upto, all_[None, 4:]])
        own = np.diff(upto, axis=0).T
        base = all_[6] / total
        n, p_sum, pos = (x[np.flatnonzero(own[0])] for x in own)
        rel, res = (n * (p_sum / n - pos / n) ** 2).sum() / total, (n * (pos / n - base) ** 2).sum() / total
        ece, aece = np.abs(fixed[2] - fixed[1]).sum() / total, np.abs(pos - p_sum).sum() / total
        auroc = all_[0] / (all_pos * (total - all_pos)) if 0 < all_pos < total else None
        auprc = all_[1] / all_pos if all_pos else None
        return pd.DataFrame([(*key, auroc, auprc, all_[2] / total, all_[3] / total, ece, aece, rel, res, int(total), base)], columns=[*keys, *METRICS, "n_eval", "prevalence"])

    arrays = "sums array<double>, fixed array<double>, near array<double>"
    parts = sliced(chunks, keys).groupBy(*keys, "slice").applyInPandas(part, f"{types}slice int, total double, all_pos double, {arrays}")
    return parts.groupBy(*keys).applyInPandas(whole, types + ", ".join(f"{c} double" for c in METRICS) + ", n_eval long, prevalence double")
