"""Exact, line, near and passage dedup against brute force on small tables."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest

from paravane.llm.exact_dedup import DigestIndex, digests, exact_dedup
from paravane.llm.line_dedup import LineRuns, drop_frequent_lines, line_dedup
from paravane.llm.near_dedup import keep_one_of_each, near_dedup
from paravane.llm.passages import repeated_passages
from paravane.llm.shingles import MinHash, WordHashes, hashed, most_unlike, shingle_set, words_of

SCHEMA = "doc_id long, text string, lang string, kept boolean, key string, node long"
low = lambda s: s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def docs(spark, pairs):
    """A table with extra columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, None, None, None, None) for i, t in pairs], SCHEMA)


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


EDGE = [(1, None), (2, ""), (3, "Ab"), (4, "aB"), (4, "aB"), (None, "ab"), (5, "É"), (6, "é"), (7, " "), (8, "x " * 50_000), (9, "\n\n")]


def test_exact(spark):
    got = {}
    for r in exact_dedup(docs(spark, EDGE)).collect():
        got[r.doc_id] = r
    assert len(exact_dedup(docs(spark, EDGE)).collect()) == len(EDGE)
    assert got[1].keep_id == got[2].keep_id == 2 and got[1].group_size == 2 and not got[1].kept and got[2].kept
    assert got[3].keep_id == 4 and got[4].group_size == 4 and got[4].kept and not got[None].kept
    assert got[5].kept and got[6].kept  # only A-Z are lower-cased
    assert got[3].text_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert exact_dedup(docs(spark, [])).collect() == []
    alone = exact_dedup(docs(spark, [(None, "only")])).collect()
    assert alone[0].kept and alone[0].keep_id is None


def test_index_keeps_what_earlier_batches_brought(spark):
    index = DigestIndex(spark)
    assert index.rows() is None
    first = index.add(digests(docs(spark, [(1, "a"), (2, "A"), (3, "b")])))
    second = index.add(digests(docs(spark, [(9, "a"), (10, "c")])))
    assert sorted(r.keep_id for r in first.collect()) == [2, 3] and [r.keep_id for r in second.collect()] == [10]
    assert sorted(r.keep_id for r in index.rows().collect()) == [2, 3, 10]


def brute_lines(pairs, least):
    holders = defaultdict(set)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            holders[low(line.strip(" \t\n\x0b\x0c\r"))].add(i)
    gone = {k for k, v in holders.items() if k and len(v) >= least}
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if low(x.strip(" \t\n\x0b\x0c\r")) not in gone]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def test_lines(spark):
    rng = random.Random(3)
    pairs = [(i, "\n".join(rng.choice(["A b", " a B\t", "c", "", "É", f"own {i}", "a b "]) for _ in range(rng.randrange(8)))) for i in range(60)]
    pairs += [(100, None), (101, ""), (102, "A b\n" * 500), (103, "z" * 100_000)]
    for batches in (1, 3):
        out = drop_frequent_lines(docs(spark, pairs), 10, batches=batches)
        assert out.columns == SCHEMA.replace(",", "").split(" ")[::2] + ["n_lines", "n_dropped"]
        text = {r.doc_id: r for r in out.collect()}
        assert text[100].text is None and text[102].n_dropped == 500 and text[102].text == ""
    assert sorted(map(tuple, line_dedup(docs(spark, pairs)).collect())) == brute_lines(pairs, 10)
    assert line_dedup(docs(spark, [])).collect() == []


def test_repeated_rows_are_one_document(spark):
    out = line_dedup(docs(spark, [(1, "same")] * 12)).collect()
    assert len(out) == 12 and all(r.n_dropped == 0 for r in out)
    assert all(r.n_dropped == 1 for r in line_dedup(docs(spark, [(i, "same") for i in range(10)])).collect())


def test_runs_compact_and_anti_join(spark):
    runs = LineRuns(spark, fanout=2)
    table = lambda ks: spark.createDataFrame([(bytes([k]), 1) for k in ks], "key binary, n_docs long")
    for part in ([1, 2], [2, 3], [3, 4]):
        runs.add(table(part))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert sorted((r.key[0], r.n_docs) for r in runs.counts().collect()) == [(1, 1), (2, 2), (3, 2), (4, 1)]
    assert [r.key[0] for r in runs.unseen(table([2, 9])).collect()] == [9]


def test_runs_and_index_reopen_by_path(spark, tmp_path):
    table = lambda ks: spark.createDataFrame([(bytes([k]), 1) for k in ks], "key binary, n_docs long")
    path = f"file://{tmp_path}/runs"
    for part in ([1, 2], [2, 3], [3, 4], [2, 5]):  # opened anew for each batch
        LineRuns(spark, path, fanout=3).add(table(part))
    again = LineRuns(spark.newSession(), path, fanout=3)
    assert again.levels == [[3], [2]]
    assert sorted((r.key[0], r.n_docs) for r in again.counts().collect()) == [(1, 1), (2, 3), (3, 2), (4, 1), (5, 1)]
    assert [r.key[0] for r in again.unseen(table([5, 9])).collect()] == [9]
    again.drop()
    assert LineRuns(spark, path).runs == []

    path = f"file://{tmp_path}/index"
    first = DigestIndex(spark, path, buckets=3)
    first.add(digests(docs(spark, [(1, "a"), (2, "A"), (3, "b")])))
    first.close()
    index = DigestIndex(spark.newSession(), path, buckets=8)
    assert index.buckets == 3 and sorted(r.keep_id for r in index.rows().collect()) == [2, 3]
    index.add(digests(docs(spark, [(9, "a"), (10, "c")])))
    assert sorted(r.keep_id for r in DigestIndex(spark, path).rows().collect()) == [2, 3, 10]


def test_texts_of_one_doc_id_are_one_document(spark):
    out = line_dedup(docs(spark, [(1, f"common\nown {i}") for i in range(12)])).collect()
    assert len(out) == 12 and all(r.n_dropped == 0 for r in out)
    out = line_dedup(docs(spark, [(None, f"common\nown {i}") for i in range(12)])).collect()
    assert len(out) == 12 and all(r.n_dropped == 1 for r in out)


def test_near_keeps_links_of_all_texts_of_a_doc_id(spark):
    rng = random.Random(21)
    a, b, c = (words(rng, 80, 10**6) for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(b)), (9, near(a)), (3, " ".join(c)), (3, " ".join(c)), (11, near(c))]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup(docs(spark, rows)).collect()}
    assert got == {(5, 5, True), (7, 5, False), (9, 5, False), (3, 3, True), (11, 3, False)}


def brute_near(pairs):
    def shingles(t):
        w = [x for x in low(t or "").replace("\n", " ").split(" ") if x]
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in pairs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


@pytest.fixture(scope="module")
def near_pairs():
    rng = random.Random(5)
    pairs, i = [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, " \n "), (905, "a b c d e")], 0
    for size in (2, 5, 90):  # the largest group has more members than a bucket compared by pairs
        base = words(rng, 120)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            pairs.append((i, " ".join(w)))
            i += 1
    pairs += [(i + k, " ".join(words(rng, 60))) for k in range(20)]
    pairs += [(i + 50 + k, pairs[10][1].upper()) for k in range(3)]
    return pairs


def test_near(spark, near_pairs):
    got = near_dedup(docs(spark, near_pairs))
    assert sorted(map(tuple, got.collect())) == brute_near(near_pairs)
    left = keep_one_of_each(docs(spark, near_pairs))
    assert left.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in left.collect()) == [r[0] for r in brute_near(near_pairs) if r[3]]


def test_near_edges(spark):
    assert near_dedup(docs(spark, [])).collect() == []
    got = near_dedup(docs(spark, [(None, "a b"), (3, "a b"), (3, "a b"), (2, "A B"), (7, "q " * 30_000)])).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(None, None, True), (3, 2, False), (3, 2, False), (2, 2, True), (7, 7, True)])


def test_sketch_bound_keeps_similar_pairs():
    rng, known, m = random.Random(9), WordHashes(), MinHash(32, 4, 1024)
    most = most_unlike(1024, 128, 0.55)
    for _ in range(60):
        a = [f"s{rng.randrange(10**6)}" for _ in range(300)]
        b = a[:258] + [f"t{rng.randrange(10**6)}" for _ in range(42)]
        sa, sb = shingle_set(hashed(a, known), 1), shingle_set(hashed(b, known), 1)
        x, y = (int.from_bytes(m.odd_sketch(m.samples(s)).tobytes(), "big") for s in (sa, sb))
        assert (x ^ y).bit_count() <= most  # similarity 0.75


def test_passages(spark):
    rng = random.Random(11)
    shared = words(rng, 60, 10**6)
    pairs = []
    for i in range(30):
        w = words(rng, 150, 10**6)
        if i % 3 == 0:  # the same passage inside other words, over a line break
            w[50:50] = shared
            w[70] += "\nnext"
            shared = shared[:20] + shared[20:]
        pairs.append((i, " ".join(w)))
    w = words(rng, 60, 10**6)
    pairs += [(100, "intro here\n" + " ".join(w)), (101, "other words before\n" + " ".join(w[:-1] + ["changed"]) + "\nend"), (200, None), (201, "")]
    pairs[0] = (0, pairs[0][1].replace("\nnext", ""))
    got = repeated_passages(docs(spark, pairs)).collect()
    found = {r.doc_id for r in got}
    assert {100, 101} <= found and {r.doc_id for r in got if r.doc_id < 100} <= {i for i in range(30) if i % 3 == 0}
    assert {i for i in range(0, 30, 3)} <= found
    assert all(r.removed == (r.doc_id != r.keep_doc_id) for r in got if r.doc_id in (100, 101))
    texts = dict(pairs)
    for r in got:
        assert len(words_of(texts[r.doc_id][r.start_char : r.end_char])) == r.n_words
    assert repeated_passages(docs(spark, [])).collect() == []
    assert repeated_passages(docs(spark, [(None, pairs[0][1]), (1, pairs[0][1])])).collect() == []


def test_long_common_passage_is_found_wherever_it_lies(spark):
    rng = random.Random(17)
    shared = words(rng, 51, 10**6)
    pairs = [(i, " ".join(words(rng, rng.randrange(0, 200), 10**6) + shared + words(rng, rng.randrange(0, 200), 10**6))) for i in range(40)]
    assert {r.doc_id for r in repeated_passages(docs(spark, pairs)).collect()} == set(range(40))


def test_whole_passages_against_brute_force(spark):
    """Every document with a run of 50 words that another has is found, and nothing without a run or a similar line."""
    rng = random.Random(23)
    shared = [words(rng, n, 10**6) for n in (49, 50, 50, 51, 60, 75, 120, 300)]
    pairs, at = [], 0
    for i in range(160):
        w = words(rng, rng.randrange(0, 160), 10**6)
        if i % 2 == 0:
            w += shared[at % len(shared)] + words(rng, rng.randrange(0, 90), 10**6)
            at += 1
        text = "".join(x + rng.choice(["\n", " ", " ", " ", "  ", "\t"]) for x in w)
        pairs.append((i, text.upper() if i % 5 == 0 else text))
    pairs += [(500, None), (501, ""), (502, "la " * 3000), (None, pairs[2][1]), (600, pairs[1][1]), (600, pairs[3][1])]

    def runs(t):
        w = words_of(t)
        return {tuple(w[k : k + 50]) for k in range(len(w) - 49)}

    holders = defaultdict(set)
    for i, t in pairs:
        for r in runs(t):
            holders[r].add(i)
    want = {i for i, t in pairs if i is not None and any(len(holders[r] - {None}) > 1 for r in runs(t))}
    got = repeated_passages(docs(spark, pairs), min_words=50).collect()
    assert {r.doc_id for r in got} == want and 502 not in want and 600 in want
    texts = dict(pairs[:160])
    for r in got:
        if r.doc_id in texts:
            assert len(words_of(texts[r.doc_id][r.start_char : r.end_char])) == r.n_words
            assert r.removed == (r.doc_id != r.keep_doc_id) and r.keep_doc_id <= r.doc_id


@pytest.mark.parametrize("which", ["lines", "documents"])
def test_recall_of_pairs_at_three_quarters(spark, which):
    """Pairs of 400 whose 5-word Jaccard is 0.75 to 0.80 are found at least 98 times in 100."""
    rng, pairs = random.Random(29), []
    for i in range(400):
        a = words(rng, 200, 10**6)
        b = [x if k not in (40, 80, 120, 160) else "changed" for k, x in enumerate(a)] + words(rng, 8 + 4 * (i % 3), 10**6)
        sa, sb = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        assert 0.75 <= len(sa & sb) / len(sa | sb) < 0.8
        pairs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    if which == "documents":
        joined = {r.doc_id for r in near_dedup(docs(spark, pairs)).collect() if not r.kept}
    else:
        joined = {r.doc_id for r in repeated_passages(docs(spark, pairs), min_words=195).collect() if r.removed}
    assert len(joined & {2 * i + 1 for i in range(400)}) >= 392
