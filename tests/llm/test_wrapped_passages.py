"""Edited paragraphs over line breaks and inside other text: recall of repeated_passages, and clean texts left alone."""

import random

import numpy as np
import pyarrow as pa
import pytest

from paravane.llm.flat import Reader
from paravane.llm.passages import APART, MIN_WORDS, PARAGRAPH, Lines, repeated_passages

SCHEMA = "doc_id long, text string, n_words int, x string, keep_doc_id string, start int"


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "x", "k", 2) for i, t in pairs], SCHEMA)


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def wrap(ws, width):
    return "\n".join(" ".join(ws[i : i + width]) for i in range(0, len(ws), width))


def edited(rng, ws, edits):
    out = list(ws)
    for k in rng.sample(range(len(ws)), edits):
        out[k] = f"changed{rng.randrange(10**6)}"
    return out


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def found(spark, pairs):
    return {r.doc_id for r in repeated_passages(docs(spark, pairs)).collect()}


CASES = {  # words of the passage, edits, wrap of either copy, lines before and after
    "one line": (60, 1, None, None, 0), "wrapped at 12": (60, 1, 12, 12, 0), "wrapped at 8": (60, 1, 8, 8, 0), "wrapped at 18": (90, 2, 18, 18, 0),
    "wrapped among other lines": (60, 1, 12, 12, 6), "wrapped unlike": (60, 1, 12, 10, 0), "wrapped unlike among other lines": (90, 1, 12, 9, 5),
    "wrapped and in one line": (45, 1, 12, None, 0),
}


INSIDE = "inside long lines"  # no paragraph of its own: found by runs without an edit
N = 100


@pytest.fixture(scope="module")
def recall(spark):
    """The share of documents found, by case: all cases in one table."""
    rng, pairs, wanted = random.Random(3), [], {}
    for case, (n, edits, wrap_a, wrap_b, around) in CASES.items():
        for _ in range(N):
            a = words(rng, n)
            b = edited(rng, a, edits)
            while jaccard(a, b) < 0.75:
                b = edited(rng, a, edits)
            for ws, width in ((a, wrap_a), (b, wrap_b)):
                lines = [" ".join(words(rng, 12)) for _ in range(2 * around)]
                wanted.setdefault(case, set()).add(len(pairs))
                pairs.append((len(pairs), "\n".join([*lines[:around], wrap(ws, width or n), *lines[around:]])))
    for _ in range(N):
        a = words(rng, 60)
        for ws in (a, edited(rng, a, 1)):
            wanted.setdefault(INSIDE, set()).add(len(pairs))
            pairs.append((len(pairs), " ".join(words(rng, 40) + ws + words(rng, 40))))
    got = found(spark, pairs)
    return {case: len(ids & got) / len(ids) for case, ids in wanted.items()}


@pytest.mark.parametrize("case", CASES)
def test_recall_of_edited_passages(recall, case):
    assert recall[case] >= 0.95


def test_recall_of_edited_passages_inside_long_lines(recall):
    """README has the figure."""
    print(recall)
    assert recall[INSIDE] >= 0.7


def test_clean_texts_of_short_lines_stay(spark):
    rng = random.Random(9)
    pairs = [(i, "\n".join(" ".join(words(rng, rng.randrange(1, 15))) for _ in range(60))) for i in range(60)]
    assert found(spark, pairs) == set()


def test_a_shared_stanza_takes_only_itself(spark):
    """Windows of one text that overlap don't chain the rest of the text to what another text shares."""
    rng = random.Random(13)
    stanza = [" ".join(words(rng, 6)) for _ in range(12)]
    poems = [[" ".join(words(rng, 6)) for _ in range(60)] for _ in range(2)]
    pairs = [(k, "\n".join(p[:30] + stanza + p[30:])) for k, p in enumerate(poems)]
    got = {r.doc_id: r for r in repeated_passages(docs(spark, pairs)).collect()}
    assert set(got) == {0, 1} and got[1].removed and not got[0].removed
    assert all(MIN_WORDS <= r.n_words <= 72 + 12 for r in got.values())


def test_repeated_rows_and_very_long_texts(spark):
    rng = random.Random(15)
    shared = " ".join(words(rng, 50))
    long = "\n".join([" ".join(words(rng, 30)) for _ in range(3000)] + [shared])
    pairs = [(1, long)] * 30 + [(2, shared), (3, None), (4, "")]
    got = repeated_passages(docs(spark, pairs)).collect()
    assert sorted((r.doc_id, r.n_words, r.removed) for r in got) == [(1, 50, False), (2, 50, True)]


def test_wrapped_paragraphs_by_plain_rules():
    rng = random.Random(21)
    text = "\n".join(" ".join(words(rng, rng.choice([0, 1, 2, 3, 5, 9, 12, 19, 20, 30]))) for _ in range(400))
    w = next(Reader().words(pa.array([text])))
    of = Lines()
    first = np.flatnonzero(np.diff(w.row, prepend=-1) | np.diff(w.line, prepend=-1))
    end = np.append(first[1:], len(w.h))
    got = set(zip(*(x.tolist() for x in of._wrapped(w, first, end))))
    hashes, plain = of.one.of(w.h, first, end), set()
    short = [e - f < MIN_WORDS for f, e in zip(first, end)]
    for i in range(len(first)):
        stretch = {i}
        for step in (-1, 1):
            j = i
            while 0 <= j + step < len(first) and short[j] and short[j + step] and abs(w.line[first[j + step]] - w.line[first[j]]) == 1:
                j += step
                stretch.add(j)
        stop = min(first[i] + PARAGRAPH, max(end[j] for j in stretch))
        rivals = [j for j in stretch if j != i and abs(first[j] - first[i]) < APART]
        least = all((hashes[i], i) < (hashes[j], j) for j in rivals)
        if short[i] and stop - first[i] >= MIN_WORDS and least:
            plain.add((first[i], stop))
        if short[i] and i == min(stretch) and max(end[j] for j in stretch) - first[i] > PARAGRAPH:
            plain.add((first[i], max(end[j] for j in stretch)))
    assert got == plain and len(got) > 20
