"""Licence scans: the whole licence family, notices inside lines and over line breaks."""

import random

import duckdb
from paravane.llm.license_scan import ALL_TEMPLATES, TEMPLATES, bigrams, license_matches, windows, words_in
from paravane.llm.common import table
from paravane.llm.queries import op5_license_scan

def _license_sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    words = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return rf"""
WITH t AS (SELECT license, {words.format("body")} AS ws FROM (VALUES {values}) AS v(license, body)),
tg AS (SELECT license, {grams.format("ws")} AS g FROM t),
u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(trim(text, chr(10)), '\n([ \t\x0b\x0c\r]*\n)+'), [text])) AS unit FROM documents),
ug AS (SELECT doc_id, unit, {words.format("unit")} AS ws FROM u),
ub AS (SELECT doc_id, unit, {grams.format("ws")} AS g FROM ug WHERE len(ws) > 1),
p AS (SELECT doc_id, license, 2.0 * len(list_intersect(ub.g, tg.g)) / (len(ub.g) + len(tg.g)) AS dice FROM ub JOIN tg
  ON 2 * least(len(ub.g), len(tg.g)) >= 0.8 * (len(ub.g) + len(tg.g)))
SELECT doc_id, license, max(dice)::DOUBLE AS dice, count(*) AS n_units FROM p WHERE dice >= 0.8 GROUP BY doc_id, license
"""


LINES = [
    (1, "some text\nLicensed under CC BY-NC 4.0.\nmore text"), (2, "Copyright 2020 X. All rights reserved."), (3, "we say cc-by-nc-nd 3.0 for this picture, as ever"),
    (4, "words that stand before it\n# This work is licensed under a Creative\n# Commons Attribution 4.0 International\n# License. and more words that follow after it"), (5, "nothing here"),
]


def scan(spark, pairs, **more):
    rows = license_matches(spark.createDataFrame(pairs, "doc_id long, text string"), **more).collect()
    return {(r.doc_id, r.license): (r.dice, r.n_units) for r in rows}


def test_family_and_embedded_notices(spark):
    got = scan(spark, LINES)
    assert got[1, "CC-BY-NC-4.0-short"] == (1.0, 1) == got[1, "CC-BY-NC-4.0-tag"]
    assert got[2, "proprietary-notice"] == (1.0, 1) and got[3, "CC-BY-NC-ND-3.0-tag"] == (1.0, 1)
    assert got[4, "CC-BY-4.0-notice"] == (1.0, 1) and not [k for k in got if k[0] == 5]


def test_every_template_is_found_inside_a_line(spark):
    pairs = [(i, f"leading words {t} trailing words") for i, t in enumerate(ALL_TEMPLATES.values())]
    got = scan(spark, pairs)
    assert all(got[i, name][0] > 0.8 for i, name in enumerate(ALL_TEMPLATES))


def test_windows_are_those_of_plain_sets():
    r = random.Random(5)
    for _ in range(300):
        pairs = [(r.choice("abcd"), r.choice("abc")) for _ in range(r.randrange(1, 40))]
        grams = frozenset(r.sample(sorted({*pairs, ("x", "y"), ("y", "z")}), 2))
        starts, span = [i for i, g in enumerate(pairs) if g in grams], r.randrange(1, 5)
        dice = lambda s: (lambda w: 2 * len(w & grams) / (len(w) + len(grams)))(set(pairs[s : s + span]))
        got, all_dice = windows(pairs, starts, grams, span, 0.8), {s: dice(s) for s in starts}
        assert max((d for *_, d in got), default=0.0) == max((d for d in all_dice.values() if d >= 0.8), default=0.0)
        assert all(all_dice[s] == d and e == min(s + span, len(pairs)) for s, e, d in got)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        assert all(any(s < e and b < s + span for b, e, _ in got) for s, d in all_dice.items() if d >= 0.8)


def test_a_like_licence_does_not_count(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    got = scan(spark, [(1, f"text\n{gpl}\ntext"), (2, f"a long line of words, then {gpl} and then a good many more words"), (3, gpl.replace("3.", "2."))])
    assert {k[:2] for k in got} == {(1, "GPL-3.0-notice"), (2, "GPL-3.0-notice"), (3, "GPL-2.0-notice"), (3, "GPL-3.0-notice")}


def test_units_keep_the_results_of_the_sql(spark):
    texts = [*LINES, *[(10 + i, f"{t}\n\nplain words\n{t}\n") for i, t in enumerate(TEMPLATES.values())]]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    sql = {(d, name): (dice, n) for d, name, dice, n in db.execute(_license_sql()).fetchall()}
    got = scan(spark, texts)
    assert len(sql) >= len(TEMPLATES) and sql.items() <= got.items()
    assert {k for k in got if k[1] in TEMPLATES} - set(sql) >= {(2, "proprietary-notice"), (4, "CC-BY-4.0-notice")}
    assert len(bigrams("a b a b")) == 2 and words_in("É A-b") == ["a", "b"]


def plain_matches(text):
    """What the scan should find in a text, by plain sets: no index, no running counts, every start tried."""
    words = words_in(text)
    pairs = list(zip(words, words[1:]))
    known = {name: g for name, t in ALL_TEMPLATES.items() if (g := bigrams(t))}
    # a part's bigrams are the text's, so Dice 0.8 needs two thirds of a template's in the text
    known_here = {name: g for name, g in known.items() if len(g & set(pairs)) >= len(g) * 2 / 3 - 1e-9}
    lines, blocks = text.split("\n"), [[]]
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            blocks[-1].append(line)
        else:
            blocks.append([])
    found = {}
    for unit in dict.fromkeys([*lines, *["\n".join(b) for b in blocks if b], text]):
        g = bigrams(unit)
        dice = {name: 2 * len(g & t) / (len(g) + len(t)) for name, t in known_here.items() if g}
        for name, d in dice.items():
            if d >= 0.8 and (name in TEMPLATES or d == max(dice.values())):
                best, n = found.get(name, (0.0, 0))
                found[name] = (max(best, d), n + 1)
    places = {}
    for name, t in known_here.items():
        span, mine = len(words_in(ALL_TEMPLATES[name])) - 1, []
        for s in range(len(pairs)):
            part = set(pairs[s : s + span])
            d = 2 * len(part & t) / (len(part) + len(t))
            if pairs[s] not in t or d < 0.8:
                continue
            if not mine or s >= mine[-1][1]:
                mine.append((s, min(s + span, len(pairs)), d))
            elif d > mine[-1][2]:
                mine[-1] = (s, min(s + span, len(pairs)), d)
        places[name] = mine
    for name in places.keys() - found.keys():
        rival = lambda p: any(d > p[2] and 2 * (min(p[1], e) - max(p[0], s)) >= p[1] - p[0] for k, ps in places.items() if k != name for s, e, d in ps)  # noqa: B023, E731
        if left := [p for p in places[name] if name in TEMPLATES or not rival(p)]:
            found[name] = (max(p[2] for p in left), len(left))
    return found


def test_whole_table_against_plain_scan(spark):
    sf = "/root/testdata/sf0.001"
    want = {(r.doc_id, name): x for r in table(spark, sf, "documents").collect() for name, x in plain_matches(r.text or "").items()}
    got = {(r.doc_id, r.license): (r.dice, r.n_units) for r in op5_license_scan(spark, sf).collect()}
    assert got == want and want
    rng = random.Random(31)
    mixed = []
    for i, t in enumerate(ALL_TEMPLATES.values()):  # edited, wrapped, and between other words
        ws = t.split()
        ws[rng.randrange(len(ws))] = "other"
        mixed.append((i, "\n".join(["before these words", *[" ".join(ws[k : k + 7]) for k in range(0, len(ws), 7)], "and after them"]) + "\n\n" + rng.choice(list(ALL_TEMPLATES.values()))))
    assert scan(spark, mixed) == {(i, name): x for i, t in mixed for name, x in plain_matches(t).items()}
