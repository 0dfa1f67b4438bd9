"""Main text of pages, importance resampling and fill-in-middle."""

import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest

from paravane.llm import fim, importance
from paravane.llm.common import table
from paravane.llm.main_text import Page, Weights, best_run, extract, fit, main_text
from paravane.llm.queries import op11_main_text, op12_importance_resampling, op13_fill_in_middle

SF = "/root/testdata/sf0.001"
WORDS = "harbour lantern meadow quiet river stone timber under velvet window yellow zephyr".split()


def prose(seed, n=30):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def block(*parts):
    return "\n\n".join(parts)


# ---------------------------------------------------------------- main text


def test_best_run_is_the_greatest_sum_of_all_slices():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0, 4.0]) for _ in range(rng.randrange(0, 14))]
        first, last = best_run(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1)), default=0)
        assert sum(scores[first:last]) == max(0, best)
    assert best_run([]) == (0, 0) and best_run([-1.0, 0.0]) == (0, 0)


PAGES = {
    "marked": (
        f"<html><body><nav><a href=/>Home</a></nav><header><h2>Site</h2></header><article><h1>A title</h1><p>{prose(1)}</p>"
        f"<aside>{prose(2)}</aside><ul><li>one &amp; two<li>three</ul><div class='ad-slot'>{prose(3)}</div><p>End.</p></article><footer>(c)</footer>",
        block("A title", prose(1), "one & two", "three", "End."),
    ),
    "divs": (
        f"<body><div id=top><a href=/a>Home</a> <a href=/b>News</a> <a href=/c>About us</a></div><div class=wrap><div class='cookie-notice'>{prose(4)}</div>"
        f"<div class=text><h1>Plain page</h1><p>{prose(5)}</p><p>{prose(6)}</p></div><div class=sidebar><p>{prose(7, 80)}</p></div>"
        f"<div id='comments'><p>{prose(8, 90)}</p></div></div><div class='site-footer'>all rights</div></body>",
        block("Plain page", prose(5), prose(6)),
    ),
    "header inside": (f"<main><header><h1>T t</h1><p>by someone</p></header><p>{prose(9)}</p></main>", block("T t", prose(9))),
    "nested article is a comment": (f"<article><p>{prose(1)}</p><article>{prose(2)}</article></article>", prose(1)),
    "form": (f"<article><p>{prose(1)}</p><form>name <input><button>Send</button></form><p>{prose(2)}</p></article>", block(prose(1), prose(2))),
    "references and space": ("<article><p>  a&nbsp;&nbsp;b\n\t c<br>d &lt;p&gt; &eacute;&#x41;<b>x</b>y</p></article>", "a b c d <p> éAxy"),
    "script in a word": ("<article><p>one <script>if (a<b) { '</p>' }</script>two<!-- <p>no</p> --> three</p></article>", "one two three"),
    "broken": (f"<article><p><b>{prose(1)}<br><p>{prose(2)} < 3 <article", block(prose(1), f"{prose(2)} < 3")),
    "unclosed comment": (f"<p>{prose(1)}</p><!-- {prose(2)}", prose(1)),
    "attribute with >": (f'<article><p title="a > b">{prose(1)}</p></article>', prose(1)),
    "hidden": (f"<article><p>{prose(1)}</p><p hidden>{prose(2)}</p><p style='display: none'>x</p></article>", prose(1)),
    "none": ("<html><nav>menu</nav></html>", ""),
    "no markup": (prose(1), prose(1)),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_extract(name):
    source, expected = PAGES[name]
    assert extract(source, Weights()) == expected


def test_one_word_blocks_at_both_ends_stay():
    assert extract(f"<article><h1>X.</h1><p>{prose(1)}</p><p>Y.</p></article><footer>z</footer>", Weights()) == block("X.", prose(1), "Y.")


def test_very_long_and_deep_pages():
    many = [prose(i) for i in range(3000)]
    assert extract("<article>" + "".join(f"<p>{p}</p>" for p in many) + "</article>", Weights()) == block(*many)
    assert extract("<div><b>" * 20_000 + prose(1) + "</div>" * 30_000, Weights(cost=0.0)) == prose(1)


def _marked_text(source):
    """The text of generated pages by plain cutting: what stands between <article> tags, by paragraph."""
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S)[1]
    inside = re.sub("</?b>", "", inside).replace("<br>", " ")
    return block(*(t for b in re.split("</?(?:p|h1)>", inside) if (t := " ".join(html.unescape(b).split()))))


def test_whole_pages_table(spark):
    got = {r.page_id: r for r in op11_main_text(spark, SF).collect()}
    pages = table(spark, SF, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == _marked_text(p.html) and got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def test_weights_carry_over_to_pages_without_article(spark):
    weights = fit(table(spark, SF, "pages"))
    assert weights.outside["p"] < 0.05
    pages = table(spark, SF, "pages").limit(30).collect()  # the mark itself taken away
    for p in pages:
        bare = p.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert extract(bare, weights) == _marked_text(p.html)


def test_main_text_cases(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, k int"
    rows = [(1, "u", PAGES["marked"][0], "x", "y", 1)] * 2 + [(2, None, None, None, None, None), (None, "v", "", None, None, None), (3, "w", PAGES["divs"][0], None, None, None)]
    got = main_text(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == sorted([(1, PAGES["marked"][1])] * 2 + [(2, ""), (0, ""), (3, PAGES["divs"][1])])
    assert main_text(spark.createDataFrame([], schema)).collect() == []


def test_furniture_scores_nothing():
    page = Page(f"<nav>{prose(1)}</nav><p>{prose(2, 5)}</p>", {})
    assert sum(s for s in page.scores(Weights(cost=0.0), 0)) == 5


# ------------------------------------------------------- importance resampling

def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


TEXTS = [None, "", "a", "Hello wörld, the quick-brown fox", "x" * 3000 + " yy zz", "日本 語 ab12 c", "!!! ---", "A b a B", "long " * 20_000]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_crc_of_runs_from_prefixes(k):
    rng = random.Random(k)
    texts = TEXTS + ["".join(rng.choice("abC é1 .,\n") for _ in range(80)) for _ in range(60)]
    crc, row = importance.Prefixes([None if t is None else t.encode() for t in texts]).runs(k)
    words = [words_of(t) for t in texts]
    plain = [(zlib.crc32(" ".join(w[j : j + k]).encode()), i) for i, w in enumerate(words) for j in range(len(w) - k + 1)]
    assert list(zip(crc.tolist(), row.tolist())) == plain


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 1000, 64 * 33])
def test_running_registers(n):
    data = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
    at = np.arange(1, n + 1)
    got = importance.running(data, at) ^ importance.shifted(np.full(n, 0xFFFFFFFF), at) ^ importance.ONES
    assert got.tolist() == [zlib.crc32(data[:i].tobytes()) for i in at]


def _brute(docs, target, percent, min_words, buckets, n_max, seed):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n_max + 1) for i in range(len(w) - k + 1)], len(w)

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for b in features(text)[0]:
                counts[b] += 1
    out = []
    for doc_id, text in docs:
        fs, n = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in fs]
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((-o[3], o[0] is not None, o[0] or 0) for o in out if o[4] >= min_words)
    quota = percent * len(able) // 100
    ranks = {}
    for place, key in enumerate(able, 1):
        ranks.setdefault(key, place)
    rank = lambda o: ranks.get((-o[3], o[0] is not None, o[0] or 0)) if o[4] >= min_words else None
    return sorted(((*o[:4], r if (r := rank(o)) and r <= quota else None) for o in out), key=repr)


@pytest.mark.parametrize("percent, n_max", [(10, 1), (50, 3), (100, 2), (0, 1)])
def test_resampling_against_brute_force(spark, percent, n_max):
    rng = random.Random(percent)
    docs = [*enumerate(TEXTS), (None, prose(1)), (None, prose(2))] + [(100 + i, prose(i, rng.randrange(1, 60))) for i in range(150)] + [(100, prose(0, 40))] * 3 + [(7_000, prose(5))] * 4
    target = [None, "", "river stone timber", "river stone", "harbour " * 30]
    got = importance.importance_resample(
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, rank int"),
        spark.createDataFrame([(t,) for t in target], "text string"), percent, 20, 50, n_max,
    )
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute(docs, target, percent, 20, 50, n_max, "2024")


def test_resampling_empty_tables(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert importance.importance_resample(docs, target).collect() == []
    one = spark.createDataFrame([(1, prose(1)), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r["rank"] for r in importance.importance_resample(one, target, percent=100).collect()} == {1: 1, 2: None}


def test_resampling_query_draws_a_tenth(spark):
    got = op12_importance_resampling(spark, SF).collect()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    able = sum(len(words_of(t)) >= 20 for t in texts.values())
    assert len(got) == len(texts) and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, able // 10 + 1))


# ---------------------------------------------------------------- fill in middle


def test_sparse_index_converts_both_ways():
    for text in ["", "ascii only", "é", "aé漢🙂b", "🙂" * 50, "x" * 100 + "é" + "y" * 100]:
        index = fim.SparseIndex(np.frombuffer(text.encode(), np.uint8))
        byte = [len(text[:i].encode()) for i in range(len(text) + 1)]
        assert index.bytes(np.arange(len(text) + 1)).tolist() == byte
        assert index.chars(np.array(byte)).tolist() == list(range(len(text) + 1))
        assert len(index.at_byte) == sum(ord(c) > 127 for c in text)


def _plain(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_plain_strings(spark):
    rng = random.Random(6)
    alphabet = "abC é1漢🙂.\n\r\t<PSM>"
    docs = [*enumerate(TEXTS), (None, "no id at all"), (-5, "negative id"), (20, "holds <P> itself"), (21, "<M>"), (22, "<S"), (22, "<S")]
    docs += [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(120)))) for i in range(300)]
    frame = spark.createDataFrame([(i, t, 1, "f") for i, t in docs], "doc_id long, text string, n int, form string")
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode(), bytes(r.restored).decode()) for r in fim.fill_in_middle(frame).collect()), key=repr)
    assert got == sorted(((i, *_plain(i, t), t or "") for i, t in docs), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(frame.limit(0)).collect() == []


def test_fill_in_middle_query_restores_all(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    got = op13_fill_in_middle(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (*(p := _plain(r.doc_id, text))[:4], hashlib.sha256(p[4].encode()).hexdigest())
