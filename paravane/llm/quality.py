"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a row is linear in its number of non-zero features: the pairwise term is half the difference between
the square of the sum and the sum of the squares (Rendle 2010).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, written
from .shingles import words_of
from .training import bounded_sample, descend, flat

BUCKETS, FACTORS, STATS = 4096, 6, 14
#: A bounded sample of so many labelled rows, at most, trains the classifier.
TRAIN_ROWS = 12_000
STEPS, RATE = 60, 0.05

_KIND = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 punctuation
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 4 if _c.isspace() else 5


class Buckets(dict):
    """Hash buckets of words; keeps a bounded number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = crc32(word.encode("utf-8")) % BUCKETS
        return got


def features(text: str | None, n_chars: float | None, known: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a text's features; a null text counts as empty, null metadata as 0."""
    text = text or ""
    words = words_of(text)
    kinds = np.bincount(_KIND[np.frombuffer(text.encode("utf-8"), np.uint8)], minlength=6)
    total, n = max(1, int(kinds.sum())), len(words)
    counts = Counter(words)
    buckets = Counter()
    for w, c in counts.items():
        buckets[known[w]] += c
    lines = text.split("\n")
    bare = sum(c for w, c in counts.items() if not any(map(str.isalnum, w)))
    stats = [
        1.0, np.log10(1 + n) / 4, (kinds[0] + kinds[1] + kinds[2]) / total, kinds[1] / max(1, kinds[1] + kinds[2]), 4 * kinds[3] / total,
        4 * kinds[5] / total, len(counts) / max(1, n), total / max(1, n) / 10, 10 * len(lines) / (10 + n),
        max(counts.values(), default=0) / max(1, n), len(set(lines)) / len(lines), bare / max(1, n), sum(map(str.__eq__, words, words[1:])) / max(1, n - 1),
        0.0 if n_chars is None or n_chars != n_chars else np.log10(1 + max(0, n_chars)) / 5,
    ]
    idx = np.fromiter(buckets, np.int32, len(buckets))
    val = np.log1p(np.fromiter(buckets.values(), np.float64, len(buckets)))
    val /= max(1e-9, np.sqrt((val * val).sum()))
    return np.concatenate([idx, np.arange(BUCKETS, BUCKETS + STATS, dtype=np.int32)]), np.concatenate([val, stats])


def _split(params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = BUCKETS + STATS
    return params[:d], params[d:].reshape(d, FACTORS)


def _terms(params: np.ndarray, idx: np.ndarray, val: np.ndarray, row: np.ndarray, n: int):
    w, v = _split(params)
    xv = v[idx] * val[:, None]
    sums = np.stack([np.bincount(row, xv[:, f], n) for f in range(FACTORS)], axis=1)
    squares = np.bincount(row, (xv * xv).sum(axis=1), n)
    return np.bincount(row, w[idx] * val, n) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums, xv


def probability(params: np.ndarray, idx: np.ndarray, val: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_terms(params, idx, val, row, n)[0], -40, 40)))


def gradient(params: np.ndarray, pdf) -> np.ndarray:
    """Of the log loss with a little shrinkage, summed over the rows."""
    (idx, row), (val, _), n = flat(pdf["idx"]), flat(pdf["val"]), len(pdf)
    score, sums, xv = _terms(params, idx, val, row, n)
    err = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - pdf["y"].to_numpy())[row]
    d = BUCKETS + STATS
    gw = np.bincount(idx, err * val, d)
    dv = (err * val)[:, None] * (sums[row] - xv)
    gv = np.stack([np.bincount(idx, dv[:, f], d) for f in range(FACTORS)], axis=1)
    return np.concatenate([gw, gv.ravel()]) + 1e-5 * n * params


def scores(params: np.ndarray, texts: list, chars: list, known: Buckets) -> np.ndarray:
    """The probability of label 1 for each text, in blocks so that memory stays bounded."""
    out = np.empty(len(texts))
    for at in range(0, len(texts), 256):
        got = [features(t, c, known) for t, c in zip(texts[at : at + 256], chars[at : at + 256])]
        (idx, row), (val, _) = flat([g[0] for g in got]), flat([g[1] for g in got])
        out[at : at + 256] = probability(params, idx, val, row, len(got))
    return out


def _inputs(docs: DataFrame) -> DataFrame:
    meta = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", meta.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """The machine's parameters, from labels(doc_id, quality) whose crc32(doc_id) mod 5 is not 0."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    sample = bounded_sample(usable, train_rows)

    def featured(batches: Iterator) -> Iterator:
        import pandas as pd

        known = Buckets()
        for pdf in batches:
            got = [features(t, c, known) for t, c in zip(pdf["text"], pdf["n_chars"])]
            yield pd.DataFrame({"y": pdf["y"].to_numpy(), "idx": [g[0] for g in got], "val": [g[1] for g in got]})

    rows = _inputs(docs).join(F.broadcast(sample), "doc_id")
    rows = written(rows.select("text", "n_chars", "y").mapInPandas(featured, "y double, idx array<int>, val array<double>"), "quality-rows")
    params = np.random.default_rng(7).normal(0, 0.05, (BUCKETS + STATS) * (1 + FACTORS))
    params[: BUCKETS + STATS] = 0
    return params if rows.isEmpty() else descend(rows, gradient, params, STEPS, RATE)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= threshold).

    Learns from at most about train_rows labelled rows, never from those with crc32(doc_id as text) mod 5 = 0
    (held_out). Inputs are the whole text and n_chars; labels, lang, source and doc_id never are. Null or empty
    texts get a score too. Labels that repeat a doc_id count once, with the greatest value; null labels are left
    out; without any usable label the score is that of the untrained machine. An empty table gives no rows.
    """
    params = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows))

    def scored(batches: Iterator) -> Iterator:
        import pandas as pd

        known = Buckets()
        for pdf in batches:
            score = scores(params.value, pdf["text"].tolist(), pdf["n_chars"].tolist(), known)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": score})

    out = _inputs(docs).mapInPandas(scored, "doc_id long, score double")
    held = (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay. Cases as in quality_scores()."""
    params = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    meta = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def good(batches: Iterator) -> Iterator:
        known = Buckets()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            chars = batch.column(meta).to_pylist() if meta is not None else [None] * len(texts)
            yield batch.filter(pa.array(scores(params.value, texts, chars, known) >= threshold, pa.bool_()))

    return docs.mapInArrow(good, docs.schema)
