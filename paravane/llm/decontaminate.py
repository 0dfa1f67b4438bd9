"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of e edits is cut into e + 1 pieces: a passage within e edits of it holds at least one
piece unchanged. Piece hits are found with an Aho-Corasick automaton, and the text around each hit is confirmed with
Myers' bit-parallel edit distance. Items too short for an edit must occur as whole words. Items go to the executors in
blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .shingles import words_of

#: Bytes of item text in one block, which is broadcast.
BLOCK_BYTES = 4_000_000
#: Items of fewer normalised characters are left out: only empty ones.
MIN_CHARS = 1


def normal(text: str | None) -> str:
    """Words, A-Z lower-cased, with single spaces."""
    return " ".join(words_of(text))


def budget(item: str) -> int:
    """Edits allowed for an item: one for each 16 characters."""
    return len(item) // 16


def pieces(item: str) -> list[tuple[int, str]]:
    """(start, piece): the item cut into budget + 1 pieces of nearly equal length."""
    n = budget(item) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of the item to any substring of text, and where that substring ends (Myers 1999)."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Finder:
    """An automaton of the pieces of some items; find() searches one text."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items, at = items, {}
        for i, (_, item) in enumerate(items):
            for start, piece in pieces(item):
                at.setdefault(piece, []).append((i, start))
        self.machine = ahocorasick.Automaton() if at else None
        for piece, where in at.items():
            self.machine.add_word(piece, (len(piece), where))
        if at:
            self.machine.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, budget, position) of each item within its budget, positions in the normal form."""
        if self.machine is None:
            return []
        text = normal(text)
        spans: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}
        for end, (n, where) in self.machine.iter(text):
            for i, start in where:
                item = self.items[i][1]
                e = budget(item)
                if not e:
                    # the piece is the whole item
                    if i not in exact and (end + 1 == n or text[end - n] == " ") and (end + 1 == len(text) or text[end + 1] == " "):
                        exact[i] = end + 1
                    continue
                lo = end - n + 1 - start - e
                hi = lo + len(item) + 2 * e
                mine = spans.setdefault(i, [])
                if mine and lo <= mine[-1][1]:
                    mine[-1] = [min(lo, mine[-1][0]), max(hi, mine[-1][1])]
                else:
                    mine.append([lo, hi])
        found = [(self.items[i][0], 0, 0, p) for i, p in exact.items()]
        for i, mine in spans.items():
            item_id, item = self.items[i]
            d, p = min((d, max(0, lo) + p) for lo, hi in mine for d, p in [best_match(item, text[max(0, lo) : max(0, hi)])])
            if d <= budget(item):
                found.append((item_id, d, budget(item), p))
        return found


def item_blocks(benchmark: DataFrame, min_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in normal form, in blocks of about BLOCK_BYTES: each is small enough for driver and broadcast."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    blocks = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES + 1
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield [(r.item_id, n) for r in block if len(n := normal(r.text)) >= min_chars]


def contaminated(docs: DataFrame, benchmark: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, budget, position): the items that a document holds within their error budget.

    Texts and items are compared as words with A-Z lower-cased and single spaces; position is where the best match
    ends in that form. Whole texts are searched. One row per row of docs and item: repeated rows give repeated rows,
    items that repeat an item_id and text count once. Null or empty texts hold nothing; null and empty
    items, and those under min_chars characters, are not searched; items under 16 characters have no error budget and
    count as whole words; an empty table gives no rows. Extra columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    schema = "doc_id long, item_id long, distance long, budget long, position long"
    parts = []
    for block in item_blocks(benchmark, min_chars):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator, sent=sent) -> Iterator:
            import pandas as pd

            finder = Finder(sent.value)
            for pdf in batches:
                rows = [(i, *x) for i, t in zip(pdf["doc_id"].astype("Int64"), pdf["text"]) for x in finder.find(t)]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "budget", "position"])
                yield out.astype({"doc_id": "Int64"})

        parts.append(texts.mapInPandas(search, schema))
    return reduce(DataFrame.unionByName, parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without the rows that hold a benchmark item within its error budget; all columns stay.

    Cases as in contaminated(). The search filters rows where they lie, so nothing shuffles.
    """
    for block in item_blocks(benchmark, min_chars):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator, sent=sent) -> Iterator:
            finder = Finder(sent.value)
            for batch in batches:
                yield batch.filter(pa.array([not finder.find(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
