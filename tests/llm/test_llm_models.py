"""Language model, quality, toxicity, licences, decontamination, BPE and the pipeline."""

import itertools
import math
import random
from zlib import crc32

import numpy as np
import pytest

from paravane.llm import decontaminate as dc
from paravane.llm.bpe import Bpe, bpe_encode
from paravane.llm.hmm import Hmm, lm_scores
from paravane.llm.license_scan import license_matches
from paravane.llm.quality import keep_good, quality_scores
from paravane.llm.queries import vocab_path
from paravane.llm.shingles import words_of
from paravane.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, lang string, n_chars long, score double, ids string, grade int"


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in pairs], SCHEMA)


TEXTS = [
    None, "", " ", "hello world", "Hello  World\n\n tabs\tand\r\nmore", "don't we'll I'M", "naïve café ñandú çédille ß", "日本語のテキスト 漢字", "🙂🙃 mixed 12345 tokens!!!",
    "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "x" * 5000, " " * 300 + "end", " nbsp em \x1c\x1d \x85", "é combining", "0.1+2=3 --- ### $$$", "trailing   ",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab_path())


def test_bpe_is_that_of_the_library(spark, tokenizer):
    rng = random.Random(2)
    alphabet = "abc ABC  the ing\n\t0123'sé漢🙂.,!|#  "
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(200)]
    got = {r.doc_id: r for r in bpe_encode(docs(spark, list(enumerate(texts))), vocab_path(), with_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids, repr(text)
        assert got[i].n_tokens == len(ids) and got[i].decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe_encode(docs(spark, []), vocab_path()).collect() == []


def test_scan_and_heap_merge_alike():
    bpe, rng = Bpe(vocab_path()), random.Random(4)
    for _ in range(200):
        parts = [bpe.of_byte[b] for b in "".join(rng.choice("theinr ") for _ in range(rng.randrange(1, 90))).encode()]
        assert bpe._scan(list(parts)) == bpe._heap(list(parts))
    assert bpe.decode(bpe.encode("round trip é")) == "round trip é"


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    norm = lambda x, axis=None: x / x.sum(axis=axis, keepdims=axis is not None)
    model = Hmm(norm(rng.random(2)), norm(rng.random((2, 2)), 1), norm(rng.random((3, 2)), 0))
    seqs = [np.array([0, 2, 1, 1]), np.array([1]), np.array([2, 0])]
    lengths, tokens = np.array([4, 2, 1]), np.zeros((4, 3), int)
    for j, s in enumerate([seqs[0], seqs[2], seqs[1]]):
        tokens[: len(s), j] = s
    got = model.forward(lengths, tokens)
    for ll, s in zip(got, [seqs[0], seqs[2], seqs[1]]):
        total = 0.0
        for path in itertools.product(range(2), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.move[a, b] * model.emit[x, b]
            total += p
        assert ll == pytest.approx(math.log(total))
    into = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    model.expected(lengths, tokens, into)
    assert into[0].sum() == pytest.approx(3) and into[1].sum() == pytest.approx(4) and into[2].sum() == pytest.approx(7)
    assert into[2].sum(axis=1) == pytest.approx([2, 3, 2])


def test_lm_scores(spark):
    rng = random.Random(8)
    voc = {"a": [f"a{i}" for i in range(40)], "b": [f"b{i}" for i in range(40)]}
    pairs = [(i, " ".join(rng.choice(voc["ab"[i % 2]]) for _ in range(40))) for i in range(300)] + [(900, None), (901, "Unseen words Here"), (None, "a1")]
    got = {r.doc_id: r for r in lm_scores(docs(spark, pairs)).collect()}
    train, counts = [t for i, t in pairs if crc32(str(i if i is not None else "").encode()) % 7 != 2], {}
    for t in train:
        for w in words_of(t):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    for i, t in pairs:
        cs = [counts.get(w, 0) for w in words_of(t)] + [len(train)]
        r = got[i]
        assert r.train_tokens == n and r.n_tokens == len(cs) and r.n_known == sum(c > 0 for c in cs)
        assert r.base_score == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in cs))
        assert r.held_out == (crc32(str(i if i is not None else "").encode()) % 7 == 2) and r.score < 0
    held = [r for r in got.values() if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scores(docs(spark, [])).collect() == []


def test_empty_text_has_the_probability_of_its_end(spark):
    r = lm_scores(docs(spark, [(i, None) for i in range(20)])).collect()
    assert all(x.n_tokens == 1 and x.n_known == 1 for x in r)


@pytest.fixture(scope="module")
def labelled_docs(spark):
    rng, pairs, labels = random.Random(6), [], []
    for i in range(500):
        w = [rng.choice(["good", "plain", "word", "text", "line", "more"]) + str(rng.randrange(30)) for _ in range(rng.randrange(5, 60))]
        junk, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vile", "nasty"])
        text = " ".join(x + "$$$" if junk and rng.random() < 0.8 else x for x in w)
        pairs.append((i, text))
        labels.append((i, int(not junk), int(toxic), None))
    pairs += [(1000, None), (1001, ""), (1002, "long " * 40_000)]
    labels += [(5, None, None, None), (None, 1, 1, None), (7, 1, 1, "again")]
    return docs(spark, pairs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), dict(pairs)


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_quality(spark, labelled_docs):
    d, labels, texts = labelled_docs
    got = {r.doc_id: r for r in quality_scores(d, labels).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert auc([(r.score, i % 5 != 0) for i, r in got.items() if r.held_out and i < 500]) > 0.95
    kept = keep_good(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert quality_scores(d.where("false"), labels).collect() == []
    assert quality_scores(d, labels.where("false")).count() == len(texts)


def test_quality_ignores_labels_lang_and_ids(spark, labelled_docs):
    d, labels, _ = labelled_docs
    a = {r.doc_id: r.score for r in quality_scores(d, labels).collect()}
    b = {r.doc_id: r.score for r in quality_scores(d.selectExpr("doc_id", "text", "'xx' AS lang", "n_chars", "'s' AS source"), labels).collect()}
    assert all(a[i] == pytest.approx(b[i], abs=1e-6) for i in a)


def test_toxicity(spark, labelled_docs):
    d, labels, texts = labelled_docs
    got = {r.doc_id: r for r in toxicity(d, labels).collect()}
    assert len(got) == len(texts) and all(0 <= r.severity <= 3 and 0 <= r.p_toxic <= 1 for r in got.values())
    bad = {i for i, t in texts.items() if t and ("vile" in t or "nasty" in t)}
    assert {i for i, r in got.items() if r.toxic} == bad
    assert not got[1000].toxic and not got[1001].toxic
    assert toxicity(d.where("false"), labels).collect() == []
    none = toxicity(d, labels.where("false")).collect()
    assert len(none) == len(texts) and not any(r.toxic for r in none)


def test_licenses(spark):
    pairs = [
        (1, "some words\nReleased under the MIT License.\nmore"), (2, "released UNDER the mit license"), (3, "All rights reserved."), (4, "we released the book under review"), (5, None), (6, ""),
        (7, "text\n\nLicensed under the Apache\nLicense, Version 2.0.\n\ntext"), (8, "word " * 30_000),
    ]
    got = {(r.doc_id, r.license): r for r in license_matches(docs(spark, pairs)).collect()}
    assert set(got) == {(1, "MIT-notice"), (2, "MIT-notice"), (3, "proprietary-notice"), (7, "Apache-2.0-notice")}
    assert got[1, "MIT-notice"].dice == 1.0 and license_matches(docs(spark, [])).collect() == []


def edit(a, b):
    """Least edit distance of a to any substring of b, by the plain table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(12)
    for _ in range(150):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, n))) for n in (90, 120))
        assert dc.best_match(a, b)[0] == edit(a, b)


def test_contaminated(spark):
    rng = random.Random(13)
    name = lambda i: -1 if i is None else i
    text = lambda n: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    items = [(k, text(30)) for k in range(8)] + [(50, None), (51, ""), (52, "too short"), (0, "another text under the same number " * 3)]
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id long")
    pairs = [(1000, None), (1001, ""), (None, text(20) + " " + items[1][1])]
    for i in range(60):
        t = text(rng.randrange(10, 120))
        if i % 4 == 0:
            leak = list(items[i % 8][1])
            for _ in range(rng.randrange(0, 16)):
                leak[rng.randrange(len(leak))] = rng.choice("xyz")
            t += " " + "".join(leak).upper().replace(" ", "\n ", 1) + " " + text(10)
        pairs.append((i, t))
    got = sorted(((name(r.doc_id), r.item_id, r.distance) for r in dc.contaminated(docs(spark, pairs), bench).collect()))
    want = []
    for i, t in pairs:
        for k, item in set(items):
            n = dc.normal(item)
            if len(n) >= dc.MIN_CHARS and (d := edit(n, dc.normal(t))) <= dc.budget(n):
                want.append((name(i), k, d))
    assert got == sorted(want) and len(want) > 5
    left = dc.decontaminate(docs(spark, pairs), bench)
    assert sorted(name(r.doc_id) for r in left.collect()) == sorted(name(i) for i, _ in pairs if name(i) not in {w[0] for w in want})
    assert dc.contaminated(docs(spark, []), bench).collect() == [] and dc.contaminated(docs(spark, pairs), bench.where("false")).collect() == []


def test_short_items_count_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "Art is long"), (2, "a"), (3, ""), (4, None)], "item_id long, text string")
    pairs = [(1, "so ART is\nlong"), (2, "part is long"), (3, "a"), (4, "art is longer a"), (5, "none"), (None, "x art is long x")]
    got = {(r.doc_id, r.item_id, r.distance) for r in dc.contaminated(docs(spark, pairs), bench).collect()}
    assert got == {(1, 1, 0), (3, 2, 0), (4, 2, 0), (None, 1, 0)}
    assert sorted(r.doc_id for r in dc.decontaminate(docs(spark, pairs), bench).collect()) == [2, 5]


def test_long_text_keeps_its_item(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog every day")], "item_id long, text string")
    got = dc.contaminated(docs(spark, [(1, "word " * 60_000 + "the quick brown fax jumps over the lazy dog every day")]), bench).collect()
    assert [(r.item_id, r.distance) for r in got] == [(1, 1)]


def test_rows_repeat_and_ids_are_null(spark, labelled_docs):
    d, labels, texts = labelled_docs
    some = [(None, texts[0]), (None, None), (3, texts[3]), (3, texts[3]), (3, texts[5])]
    for out in (quality_scores(docs(spark, some), labels), toxicity(docs(spark, some), labels), bpe_encode(docs(spark, some), vocab_path()), lm_scores(docs(spark, some))):
        rows = out.collect()
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == [-1, -1, 3, 3, 3]
    lines = license_matches(docs(spark, [(None, "Released under the MIT License."), (3, "Released under the MIT License.")] * 2)).collect()
    assert {r.doc_id for r in lines} == {None, 3}


def test_gradients_are_slopes(spark):
    import pandas as pd

    from paravane.llm.toxicity import GRADES, exceed, gradient_for

    rng = np.random.default_rng(5)
    dims, n = 6, 40
    pdf = pd.DataFrame({
        "grade": rng.integers(0, GRADES, n), "idx": [rng.choice(dims, 3, replace=False) for _ in range(n)], "val": [rng.random(3) for _ in range(n)],
    })
    params = np.concatenate([rng.normal(size=dims), [0.5, -0.3, 0.2]])

    def loss(p):
        total = 0.0
        for g, i, v in zip(pdf["grade"], pdf["idx"], pdf["val"]):
            above = np.concatenate([[1.0], exceed(p, dims, np.array([float(p[i] @ v)]))[0], [0.0]])
            total -= math.log(above[g] - above[g + 1])
        return total + 0.5e-4 * n * float(p[:dims] @ p[:dims])

    got = gradient_for(dims)(params, pdf)
    for k in range(len(params)):
        step = np.zeros(len(params))
        step[k] = 1e-5
        assert got[k] == pytest.approx((loss(params + step) - loss(params - step)) / 2e-5, rel=1e-4, abs=1e-5)


def test_training_raises_the_likelihood():
    from paravane.llm.hmm import STATES, first_guess, maximised

    rng = np.random.default_rng(3)
    seqs = [np.where(rng.random(30) < 0.9, rng.integers(0, 5, 30) + 5 * (k % 3), 15) for k in range(60)]
    lengths, tokens = np.full(60, 30), np.stack(seqs, axis=1)
    model, before = first_guess(np.ones(16)), -np.inf
    for _ in range(12):
        now = model.forward(lengths, tokens).sum()
        assert now > before - 0.5  # the small prior counts may cost a trifle
        before = now
        into = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((16, STATES))
        model.expected(lengths, tokens, into)
        model = maximised(*into)
    assert now > first_guess(np.ones(16)).forward(lengths, tokens).sum() + 100


def test_pipeline_stages(spark, labelled_docs, tmp_path):
    import corpus_pipeline

    d, labels, _ = labelled_docs
    d = d.select("doc_id", "text", "lang", "n_chars")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "good1 plain2 word3 text4 line5 more6 good7")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert out.columns == d.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    lines = corpus_pipeline.lines(spark, docs(spark, [(i, f"same\nown {i}") for i in range(10)] + [(10, None)]), "").collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines) and {r.text for r in lines} == {None, *[f"own {i}" for i in range(10)]}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.where("false"), str(tmp_path)).count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, now.collect()))
