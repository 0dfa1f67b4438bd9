"""Line runs and digest index after jobs that broke off, and the language model on texts of any length."""

import itertools
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from paravane.llm import exact_dedup, hmm, line_dedup
from paravane.llm.common import table
from paravane.llm.exact_dedup import DigestIndex
from paravane.llm.hmm import STATES, TAIL, Hmm, lm_scores, tail_class
from paravane.llm.line_dedup import LineRuns
from paravane.llm.queries import op3_lm_score
from paravane.llm.shingles import words_of

BATCHES = {"a": {1: 5, 2: 1}, "b": {1: 3, 3: 2}, "c": {2: 4, 4: 1}, "d": {1: 1, 4: 6}}
TOTAL = {1: 9, 2: 5, 3: 2, 4: 7}


class Broken(Exception):
    pass


def counts(spark, batch):
    return spark.createDataFrame([(bytes([k]), n) for k, n in batch.items()], "key binary, n_docs long")


@pytest.mark.parametrize("after", [False, True])
def test_line_runs_count_each_batch_once_wherever_a_job_breaks(spark, tmp_path, monkeypatch, after):
    write, mark = LineRuns._write, line_dedup.mark
    for k in range(30):
        steps, path = itertools.count(), f"file://{tmp_path}/runs-{after}-{k}"

        def breaks(real, *args):
            if next(steps) == k:
                if after:
                    real(*args)
                raise Broken
            return real(*args)

        monkeypatch.setattr(LineRuns, "_write", lambda self, rows, run: breaks(write, self, rows, run))
        monkeypatch.setattr(line_dedup, "mark", lambda spark, at: breaks(mark, spark, at))
        broke = False
        for name, batch in BATCHES.items():
            try:
                LineRuns(spark, path, fanout=2).add(counts(spark, batch), name)
            except Broken:
                broke = True
        monkeypatch.undo()
        for name, batch in BATCHES.items():  # the whole job again
            LineRuns(spark, path, fanout=2).add(counts(spark, batch), name)
        again = LineRuns(spark, path, fanout=2)
        assert {r.key[0]: r.n_docs for r in again.counts().collect()} == TOTAL
        again.drop()
        if not broke:
            return
    raise AssertionError("every step should have been reached")



@pytest.mark.parametrize("part", ["none", "some", "all"])
def test_digest_index_is_whole_after_a_broken_append(spark, tmp_path, monkeypatch, part):
    path, schema = f"file://{tmp_path}/index-{part}", "doc_id long, digest string"
    batch = lambda rows: spark.createDataFrame(rows, schema)
    first = DigestIndex(spark, path, buckets=3)
    first.add(batch([(1, "a"), (2, "b")]), "one")
    append = DigestIndex._append

    def broken(self, name, again=False):
        if part == "some":  # a part of the rows is there already
            rows = self._batch(name).where("digest = 'c'").repartition(self.buckets, "digest").sortWithinPartitions("digest")
            rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        if part == "all":
            monkeypatch.setattr(exact_dedup, "mark", lambda *_: (_ for _ in ()).throw(Broken()))
            append(self, name, again)
        raise Broken

    monkeypatch.setattr(DigestIndex, "_append", broken)
    with pytest.raises(Broken):
        first.add(batch([(5, "a"), (6, "c"), (7, "d"), (8, "d")]), "two")
    monkeypatch.undo()
    first.close()
    again = DigestIndex(spark.newSession(), path)
    assert sorted(map(tuple, again.rows().collect())) == [("a", 1), ("b", 2), ("c", 6), ("d", 8)]
    got = again.add(batch([(5, "a"), (6, "c"), (7, "d"), (8, "d")]), "two")
    assert sorted(map(tuple, got.collect())) == [("c", 6), ("d", 8)]
    assert again.rows().count() == 4


# ---------------------------------------------------------------- language model


def _model(seed, classes):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis=None: x / x.sum(axis=axis, keepdims=axis is not None)
    return Hmm(norm(rng.random(STATES)), norm(rng.random((STATES, STATES)), 1), norm(rng.random((classes, STATES)), 0))


@pytest.mark.parametrize("n", [1, 6, 7, 8, 14, 50])
def test_pieces_give_the_expected_counts_of_the_whole(n):
    model = _model(n, 9)
    tokens = np.random.default_rng(n).integers(0, 9, n).astype(np.uint16)
    empty = lambda: (np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((9, STATES)))
    whole, pieces = empty(), empty()
    model.expected(np.array([n]), tokens[:, None], whole)
    model.expected_long(tokens, pieces, piece=7)
    for a, b in zip(whole, pieces):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)


def test_training_on_a_text_longer_than_a_piece(spark, monkeypatch):
    texts = [(i, f"alpha beta w{i} gamma") for i in range(6)] + [(6, " ".join(f"alpha beta w{i} gamma" for i in range(40)))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    whole = {r.doc_id: r.score for r in lm_scores(frame).collect()}
    monkeypatch.setattr(hmm, "PIECE", 16)
    assert {r.doc_id: r.score for r in lm_scores(frame).collect()} == pytest.approx(whole)


def test_score_is_the_sum_over_all_state_paths(spark, monkeypatch):
    """Brute force on a whole small table: every path of states, words of shared classes by their share of the class."""
    texts = [(1, None), (2, "b a"), (3, "A a b"), (4, "c unseen"), (5, "zebra a"), (6, "a a a"), (7, "cobra b a"), (8, "zebra cobra"), (9, "b")]
    monkeypatch.setattr(hmm, "HEAD", 2)
    model = _model(4, 3 + TAIL)
    monkeypatch.setattr(hmm, "baum_welch", lambda coded, freq: model)
    train = [words_of(t) for i, t in texts if crc32(str(i).encode()) % 7 != 2]
    seen = Counter(w for ws in train for w in ws)
    head = sorted(seen, key=lambda w: (-seen[w], w))[:2]
    in_class, distinct = Counter(), Counter()
    for w, c in seen.items():
        if w not in head:
            in_class[tail_class(w, 2)] += c
            distinct[tail_class(w, 2)] += 1
    got = {r.doc_id: r.score for r in lm_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        cls, share = [], 0.0
        for w in words_of(t):
            cls.append(head.index(w) if w in head else tail_class(w, 2))
            if w not in head:
                share += math.log10((seen[w] + 1) / (in_class[cls[-1]] + distinct[cls[-1]] + 1))
        cls.append(2)
        total = 0.0
        for path in itertools.product(range(STATES), repeat=len(cls)):
            p = model.start[path[0]] * model.emit[cls[0], path[0]]
            for a, b, c in zip(path, path[1:], cls[1:]):
                p *= model.move[a, b] * model.emit[c, b]
            total += p
        assert got[i] == pytest.approx(math.log10(total) + share), (i, t)


def test_states_help_on_texts_that_were_held_out(spark):
    rows = [r for r in op3_lm_score(spark, "/root/testdata/sf0.001").collect() if r.held_out]
    assert len(rows) > 10 and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert len(rows) == sum(crc32(str(r.doc_id).encode()) % 7 == 2 for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id").collect())
