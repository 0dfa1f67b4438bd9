"""Factorisation machine and ordinal regression: plain sums, slopes, and rows that were held out."""

import itertools

import numpy as np
import pandas as pd
import pytest

from paravane.llm import quality, toxicity
from paravane.llm.common import table
from paravane.llm.queries import op6_toxicity, op9_quality

SF = "/root/testdata/sf0.01"


def _sparse(rng, rows):
    idx = [np.sort(rng.choice(quality.BUCKETS + quality.STATS, n, False)) for n in rows]
    return idx, [rng.normal(0, 1, len(i)) for i in idx]


def test_square_of_the_sum_less_sum_of_squares_is_the_double_sum():
    rng = np.random.default_rng(3)
    params = rng.normal(0, 0.3, (quality.BUCKETS + quality.STATS) * (1 + quality.FACTORS))
    idx, val = _sparse(rng, [1, 2, 7, 30])
    w, v = quality._split(params)
    plain = [w[i] @ x + sum((v[i[a]] @ v[i[b]]) * x[a] * x[b] for a, b in itertools.combinations(range(len(i)), 2)) for i, x in zip(idx, val)]
    row = np.repeat(np.arange(4), [len(i) for i in idx])
    got = quality._terms(params, np.concatenate(idx), np.concatenate(val), row, 4)[0]
    np.testing.assert_allclose(got, plain, rtol=1e-9)
    np.testing.assert_allclose(quality.probability(params, np.concatenate(idx), np.concatenate(val), row, 4), 1 / (1 + np.exp(-np.clip(plain, -40, 40))))


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(4)
    params = rng.normal(0, 0.1, (quality.BUCKETS + quality.STATS) * (1 + quality.FACTORS))
    idx, val = _sparse(rng, [3, 5, 8])
    pdf = pd.DataFrame({"idx": idx, "val": val, "y": [1.0, 0.0, 1.0]})

    def loss(p):
        row = np.repeat(np.arange(3), [3, 5, 8])
        score = quality._terms(p, np.concatenate(idx), np.concatenate(val), row, 3)[0]
        return np.sum(np.log1p(np.exp(-score * np.array([1, -1, 1])))) + 0.5e-5 * 3 * (p @ p)

    got, d = quality.gradient(params, pdf), quality.BUCKETS + quality.STATS
    for i in [*idx[0], *(d + idx[1] * quality.FACTORS + 2), *(d + idx[2] * quality.FACTORS + 5)]:
        step = np.zeros(len(params))
        step[i] = 1e-6
        assert got[i] == pytest.approx((loss(params + step) - loss(params - step)) / 2e-6, rel=1e-4, abs=1e-7)


def area(score, y):
    pairs = [(a > b) + (a == b) / 2 for a, ya in zip(score, y) for b, yb in zip(score, y) if ya and not yb]
    return sum(pairs) / len(pairs)


@pytest.mark.parametrize("query, label, column, least", [(op9_quality, "quality", "score", 0.95), (op6_toxicity, "toxic", "p_toxic", 0.8)])
def test_rows_that_were_held_out(spark, query, label, column, least):
    labels = {r.doc_id: r[label] for r in table(spark, SF, "labels").collect()}
    rows = [(r[column], labels[r.doc_id]) for r in query(spark, SF).collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert area(*zip(*rows)) >= least


def test_severity_by_plain_sums():
    """Thresholds rise, grades' probabilities add up, and severity is their mean."""
    rng = np.random.default_rng(5)
    params = rng.normal(0, 1, 6 + toxicity.GRADES - 1)
    score = rng.normal(0, 3, 50)
    above = toxicity.exceed(params, 6, score)
    cuts = [params[6], params[6] + np.exp(params[7]), params[6] + np.exp(params[7]) + np.exp(params[8])]
    np.testing.assert_allclose(above, [[1 / (1 + np.exp(-(s - t))) for t in cuts] for s in score])
    each = np.concatenate([np.ones((50, 1)), above], axis=1) - np.concatenate([above, np.zeros((50, 1))], axis=1)
    assert (each >= 0).all() and np.allclose(each @ np.arange(toxicity.GRADES), above.sum(axis=1))
