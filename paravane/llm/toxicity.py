"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade > k) = logistic(w . x - t_k): the weights are shared by the ordered thresholds. Features are the words most
associated with the labels. Labels are 0/1, so severity grades come from them and from the words: 0 for rows that
aren't toxic, else 1, 2 or 3 by how many distinct strongly associated words the row holds (up to 1, 2 to 3, more).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_or_empty, written
from .training import bounded_sample, descend, flat

GRADES, FEATURES, STEPS, RATE = 4, 512, 80, 0.1
#: A bounded sample of so many labelled rows, at most, trains the model.
TRAIN_ROWS = 40_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall((text or "").lower())


def associated(rows: DataFrame, features: int) -> list[tuple[str, bool]]:
    """The `features` words with the greatest association to the label, and which of them are strong signs of it.

    Association is the z value of the log-odds with an added half, from counts of rows that hold the word.
    """
    def distinct(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            found = [(w, y) for t, y in zip(pdf["text"], pdf["y"]) for w in set(words(t))]
            yield pd.DataFrame(found, columns=["word", "y"])

    n = rows.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
    counts = rows.mapInPandas(distinct, "word string, y double").groupBy("word").agg(F.sum("y").alias("a"), F.count("*").alias("c")).where("c >= 3")
    pos, neg = float(n.pos or 0), float((n.n or 0) - (n.pos or 0))
    a, b = F.col("a") + 0.5, F.col("c") - F.col("a") + 0.5
    odds = F.log(a / (pos - F.col("a") + 0.5)) - F.log(b / (neg - F.col("c") + F.col("a") + 0.5))
    z = odds / F.sqrt(1 / a + 1 / b)
    top = counts.select("word", z.alias("z"), odds.alias("odds")).orderBy(F.abs("z").desc(), "word").limit(features).collect()
    return [(r.word, bool(r.z > 4 and r.odds > 2)) for r in top]


def vector(text: str | None, at: dict[str, int]) -> tuple[list[int], list[float]]:
    """Indexes and log-counts of the known words of a whole text."""
    found = Counter(w for w in words(text) if w in at)
    return [at[w] for w in found], [float(np.log1p(c)) for c in found.values()]


def exceed(params: np.ndarray, dims: int, score: np.ndarray) -> np.ndarray:
    """P(grade > k) for each row and threshold."""
    t = np.cumsum(np.concatenate([params[dims : dims + 1], np.exp(params[dims + 1 :])]))
    return 1 / (1 + np.exp(-np.clip(score[:, None] - t[None, :], -40, 40)))


def gradient_for(dims: int):
    def gradient(params: np.ndarray, pdf) -> np.ndarray:
        (idx, row), (val, _), n = flat(pdf["idx"]), flat(pdf["val"]), len(pdf)
        idx = idx.astype(np.int64)
        above = exceed(params, dims, np.bincount(row, params[idx] * val, n))
        y = pdf["grade"].to_numpy().astype(int)
        # P(grade = y) = above[y-1] - above[y]; its derivative by score and by each threshold
        hi = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        slope = hi * (1 - hi)
        at = np.arange(n)
        p = np.maximum(hi[at, y] - hi[at, y + 1], 1e-12)
        d_score = -(slope[at, y] - slope[at, y + 1]) / p
        d_t = np.zeros((n, hi.shape[1]))
        d_t[at, y] += slope[at, y] / p
        d_t[at, y + 1] -= slope[at, y + 1] / p
        d_t = d_t[:, 1:-1].sum(axis=0)
        # thresholds are a first one and positive steps, so a step moves all later thresholds
        later = np.cumsum(d_t[::-1])[::-1]
        later[1:] *= np.exp(params[dims + 1 :])
        return np.concatenate([np.bincount(idx, d_score[row] * val, dims), later]) + 1e-4 * n * np.concatenate([params[:dims], np.zeros(GRADES - 1)])

    return gradient


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, severity (expected grade), grade (most likely), p_toxic, toxic.

    Learns from at most about train_rows of labels(doc_id, toxic), never from rows whose crc32(doc_id as text) mod
    5 is 0 (held_out). toxic says p_toxic = P(grade > 0) >= threshold. Whole texts are read; null or empty ones hold
    no word. Labels that repeat a doc_id count once, with the greatest value; null ones are left out; without labels
    of both kinds nothing is toxic and severity is 0. An empty table gives no rows; extra columns are ignored.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("y"))
    sample = bounded_sample(usable, train_rows)
    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = written(inputs.join(F.broadcast(sample), "doc_id").select("text", "y"), "toxicity-rows")
    known = associated(rows, FEATURES)
    at, strong = {w: i for i, (w, _) in enumerate(known)}, {w for w, s in known if s}
    dims = len(at)

    def graded(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for text, y in zip(pdf["text"], pdf["y"]):
                n = len(strong & set(words(text)))
                out.append((0 if y < 0.5 else 1 if n < 2 else 2 if n < 4 else 3, *vector(text, at)))
            yield pd.DataFrame(out, columns=["grade", "idx", "val"])

    both = rows.select("y").distinct().count() > 1
    params = np.concatenate([np.zeros(dims), [2.0 if both else 50.0], np.zeros(GRADES - 2)])
    if both:
        train = written(rows.mapInPandas(graded, "grade int, idx array<int>, val array<double>"), "toxicity-train")
        params = descend(train, gradient_for(dims), params, STEPS, RATE)

    def scored(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            score = np.array([sum(params[i] * x for i, x in zip(*vector(t, at))) for t in pdf["text"]], dtype=float).reshape(-1)
            above = exceed(params, dims, score)
            each = np.concatenate([np.ones((len(pdf), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(pdf), 1))], axis=1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "severity": above.sum(axis=1), "grade": each.argmax(axis=1), "p_toxic": above[:, 0]})

    out = inputs.mapInPandas(scored, "doc_id long, severity double, grade int, p_toxic double")
    return out.select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "severity", "grade", "p_toxic", (F.col("p_toxic") >= threshold).alias("toxic")
    )
