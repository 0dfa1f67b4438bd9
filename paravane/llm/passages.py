"""Substring dedup: paragraph MinHash banding, exact Jaccard, removals by component.

Two kinds of paragraphs are compared. Lines of MIN_WORDS words or more, and paragraphs that are wrapped into shorter
lines, are banded by MinHash: BANDS bands of ROWS rows miss a pair at similarity 0.75 with probability 0.0013. A wrapped
paragraph may begin at any line of a stretch of short lines, so the PARAGRAPH words (fewer at the stretch's end) from
each such line over the line breaks are a paragraph, and a longer stretch as a whole is one. Paragraphs that are equal word by word are one node before they are
banded, colliding nodes are joined and verified by exact Jaccard over 5-word shingles, and links are clustered by
components. Passages that lie elsewhere in texts, over line breaks too, are found by windows of WINDOW words that start
at content-defined anchors (winnowing, Schleimer et al. 2003): any 50 words that texts share hold a common window,
and windows with equal words are one cluster. Where passages must have more words than a window and the windows found
cover fewer, all runs of so many words around them are compared, which settles whether that much is shared.

In a cluster the smallest doc_id keeps its paragraph. Overlapping and adjoining paragraphs of a text are one span.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, skew_join, text_or_empty, written
from .flat import Characters, Polynomial, Reader, Words, binary_rows, elements, int32, lists, string_column
from .near_links import candidates, near_components
from .shingles import MinHash, mixed, windows

WINDOW, REACH, ANCHOR = 24, 24, 3
MIN_WORDS, BANDS, ROWS, SHINGLE = 20, 8, 2, 5
#: Words of a wrapped paragraph, and the least distance of two that begin in one stretch: closer ones are alike by themselves.
PARAGRAPH, APART = 40, 8
#: Low bits of an anchor's hash that hold its place, so that the leftmost of equal ones is taken.
_PLACE = (1 << 28) - 1


def anchors(w: Words) -> np.ndarray:
    """Starts of windows: words whose 3-word hash is the leftmost least among REACH, in rows with WINDOW words left.

    Rows with fewer than REACH such hashes have one anchor, their least.
    """
    n = len(w.h) - ANCHOR + 1
    if n < 1:
        return np.empty(0, np.int64)
    near = windows(w.h, ANCHOR) & ~np.uint64(_PLACE) | np.arange(n, dtype=np.uint64)
    first = np.flatnonzero(np.diff(w.row, prepend=-1))
    end = np.append(first[1:], len(w.h))
    found = []
    least, span = near, 1
    while 2 * span <= REACH:
        least, span = np.minimum(least[:-span], least[span:]) if len(least) > span else least[:0], 2 * span
    if len(least) > REACH - span:
        least = np.minimum(least[: len(least) - (REACH - span)], least[REACH - span :])
        inside = w.row[: len(least)] == w.row[REACH + ANCHOR - 2 :]
        place = (least[inside] & np.uint64(_PLACE)).astype(np.int64)
        found.append(place[np.diff(place, prepend=-1) != 0])
    for a, b in zip(first, end):
        if ANCHOR <= b - a < REACH + ANCHOR - 1:
            found.append(np.array([a + int(near[a : b - ANCHOR + 1].argmin())]))
    at = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    return at[at + WINDOW <= end[np.searchsorted(first, at, "right") - 1]]


def run_keys(h: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits that stand for the `size` words from each place: a 64-bit and a 32-bit hash."""
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j in range(size):
        x = h[at + j]
        one = (one + x) * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
        two = (two ^ x) * np.uint64(0xC2B2AE3D27D4EB4F + 2 * j)
    return mixed(one).view(np.int64), (mixed(two) >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Lines:
    """Lines of MIN_WORDS words or more and wrapped paragraphs: their digests and band keys."""

    def __init__(self):
        self.one, self.two = Polynomial(0xD6E8FEB86659FD93), Polynomial(0xA0761D6478BD642F)
        self.minhash = MinHash(BANDS, ROWS, 64)

    def _wrapped(self, w: Words, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end words of paragraphs over line breaks: first and end are those of the lines with words.

        They begin at lines of less than MIN_WORDS words; of such lines that begin within APART words, at the one with the
        least hash, so that equal passages give equal paragraphs wherever they stand. A stretch of short lines with more than
        PARAGRAPH words is one too.
        """
        row, line, short = w.row[first], w.line[first], end - first < MIN_WORDS
        joined = np.zeros(len(first), bool)
        joined[1:] = short[1:] & short[:-1] & (row[1:] == row[:-1]) & (line[1:] == line[:-1] + 1)
        stretch = np.cumsum(~joined)
        last = np.append(np.flatnonzero(np.diff(stretch)), len(first) - 1) if len(first) else first
        until = end[last[stretch - 1]]
        hashes, begins = self.one.of(w.h, first, end) if len(first) else w.h[:0], short.copy()
        for d in range(1, min(APART, len(first))):
            near = (stretch[d:] == stretch[:-d]) & (first[d:] - first[:-d] < APART)
            begins[d:] &= ~near | (hashes[d:] < hashes[:-d])
            begins[:-d] &= ~near | (hashes[:-d] <= hashes[d:])
        stop = np.minimum(first + PARAGRAPH, until)
        begins &= stop - first >= MIN_WORDS
        whole = short & ~joined & (until - first > PARAGRAPH)
        return np.concatenate([first[begins], first[whole]]), np.concatenate([stop[begins], until[whole]])

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, end word, 16-byte digests (two columns of uint64) and band keys (a column each)."""
        first = np.flatnonzero(np.diff(w.row, prepend=-1) | np.diff(w.line, prepend=-1))
        end = np.append(first[1:], len(w.h))
        over, stop = self._wrapped(w, first, end)
        long = end - first >= MIN_WORDS
        first, end = np.concatenate([first[long], over]), np.concatenate([end[long], stop])
        order = np.argsort(first, kind="stable")
        first, end = first[order], end[order]
        if not len(first):
            return first, end, np.empty((0, 2), np.uint64), np.empty((0, BANDS), np.int64)
        digest = np.stack([self.one.of(w.h, first, end), self.two.of(mixed(w.h), first, end)], axis=1)
        grams = windows(w.h, SHINGLE)
        sizes = end - first - SHINGLE + 1
        cut = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mine = grams[np.arange(sizes.sum()) + np.repeat(first - cut, sizes)]
        return first, end, digest, self.minhash.band_keys_of(self.minhash.samples_of(mine, cut))


_UNITS = {
    "w_start": pa.int32(), "w_h": pa.int64(), "w_g": pa.int32(),
    "l_start": pa.int32(), "l_size": pa.int32(), "l_a": pa.int32(), "l_b": pa.int32(), "l_same": pa.binary(),
    **{f"l_band{k}": pa.int64() for k in range(BANDS)},
}


def units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text its windows and paragraphs, as arrays."""
    reader, of_lines = Reader(), Lines()
    for batch in batches:
        text, done = string_column(batch, "text"), 0
        chars = Characters(text)

        def out(lo: int, hi: int, rows_w: np.ndarray, rows_l: np.ndarray, values: dict) -> pa.RecordBatch:
            keep = batch.slice(lo, hi - lo)
            arrays = [lists((rows_w if c.startswith("w") else rows_l) - lo, hi - lo, v) for c, v in values.items()]
            return pa.RecordBatch.from_arrays([keep.column("doc_id"), keep.column("v"), *arrays], ["doc_id", "v", *values])

        for w in reader.words(text):
            lo, hi = done, int(w.row[-1]) + 1 if len(w.row) else done
            if hi == lo:
                continue
            row_first = np.searchsorted(w.row, np.arange(lo, hi))
            at = anchors(w)
            h, g = run_keys(w.h, at, WINDOW)
            first, end, digest, bands = of_lines.of(w)
            lr = w.row[first] if len(first) else np.empty(0, np.int64)
            a, b = (chars.of(w.start[first], lr), chars.of(w.end[end - 1], lr)) if len(first) else (lr, lr)
            yield out(lo, hi, w.row[at], lr, {
                "w_start": int32(at - row_first[w.row[at] - lo]), "w_h": pa.array(h, pa.int64()), "w_g": pa.array(g, pa.int32()),
                "l_start": int32(first - row_first[lr - lo]), "l_size": int32(end - first), "l_a": int32(a), "l_b": int32(b), "l_same": binary_rows(digest),
                **{f"l_band{k}": pa.array(bands[:, k], pa.int64()) for k in range(BANDS)},
            })
            done = hi


def in_runs(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of spans by row and start, and in that order the run of overlapping or adjoining spans and its words."""
    order = np.lexsort((end, start, row))
    gap = int(end.max(initial=0)) + 1
    base = row[order].astype(np.int64) * gap
    far = np.maximum.accumulate(base + end[order])
    new = np.ones(len(order), bool)
    new[1:] = base[1:] + start[order][1:] > far[:-1]
    run, first = np.cumsum(new) - 1, np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    return order, run, ((far - base)[last] - start[order][first])[run] if len(order) else run


def chains_of(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    """For each text its chains of windows, split by verdict, the keys of windows in chains under least_words, and x."""
    for batch in batches:
        n, (row, x) = len(batch), elements(batch, "x")
        start, keep, ids = x["start"], x["keep"], np.asarray(batch.column("doc_id"))
        order, _, words = in_runs(row, start, start + WINDOW)
        few = order[words < least_words]
        few = few[np.argsort(row[few], kind="stable")]
        gone = keep != ids[row]
        # a row's kept windows and its lost ones run apart
        order, run, words = in_runs(2 * row + gone, start, start + WINDOW)
        first = np.flatnonzero(np.diff(run, prepend=-1))
        least = np.minimum.reduceat(keep[order], first) if len(first) else keep
        at = order[first]
        chains = pa.StructArray.from_arrays([int32(start[at]), int32(words[first]), pa.array(least, pa.int64())], ["start", "size", "keep"])
        unsure = pa.StructArray.from_arrays([pa.array(x["h"][few], pa.int64()), int32(x["g"][few])], ["h", "g"])
        columns = [batch.column("doc_id"), batch.column("v"), lists(row[at], n, chains), lists(row[few], n, unsure), batch.column("x")]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "v", "chains", "unsure", "x"])


CHAIN, SEED, LINE = 0, 1, 2
_CUTS = "kind int, doc_id long, v long, start int, size int, a int, b int, keep long, h long, g int, same binary, grams array<long>"
_CUT_TYPES = [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]


def cuts_of(batches: Iterator[pa.RecordBatch], run_words: int) -> Iterator[pa.RecordBatch]:
    """What is wanted of each text: places of window chains, shingles of lines, and runs of run_words around windows."""
    reader, names = Reader(), [x.strip().split(" ")[0] for x in _CUTS.split(",")]
    for batch in batches:
        text = string_column(batch, "text")
        chars, ids, vs = Characters(text), np.asarray(batch.column("doc_id")), np.asarray(batch.column("v"))
        row, x = elements(batch, "want", "same")

        for w in reader.words(text):
            if not len(w.h):
                continue
            lo, hi = int(w.row[0]), int(w.row[-1]) + 1
            first = np.searchsorted(w.row, np.arange(lo, hi + 1))
            mine = slice(*np.searchsorted(row, [lo, hi]))
            r, kind, start, size, keep, same = row[mine], x["kind"][mine], x["start"][mine], x["size"][mine], x["keep"][mine], x["same"][mine]

            def cut(kind: int, r, start, size, keep=None, h=None, g=None, same=None, grams=None) -> pa.RecordBatch:
                at, n = first[r - lo] + start, len(r)
                a, b = chars.of(w.start[at], r), chars.of(w.end[at + size - 1], r)
                given = [keep, h, g, same, grams]
                columns = [int32(np.full(n, kind)), pa.array(ids[r]), pa.array(vs[r]), int32(start), int32(size), int32(a), int32(b)]
                columns += [pa.nulls(n, t) if c is None else c for c, t in zip(given, _CUT_TYPES[7:])]
                return pa.RecordBatch.from_arrays(columns, names)

            k = kind == CHAIN
            yield cut(CHAIN, r[k], start[k], size[k], keep=pa.array(keep[k], pa.int64()))
            k = kind == LINE
            at, values = first[r[k] - lo] + start[k], windows(w.h, SHINGLE) if len(w.h) >= SHINGLE else w.h[:0]
            sets = [np.unique(values[i : i + n - SHINGLE + 1]) for i, n in zip(at.tolist(), size[k].tolist())]
            grams = lists(np.repeat(np.arange(len(sets)), [len(z) for z in sets]), len(sets), pa.array(np.concatenate([*sets, w.h[:0]]).view(np.int64)))
            yield cut(LINE, r[k], start[k], size[k], same=same.filter(pa.array(k)), grams=grams)
            # starts of the runs that hold a window and lie in its text
            k = kind == SEED
            words = np.diff(first)[r[k] - lo]
            low, high = np.maximum(0, start[k] + WINDOW - run_words), np.minimum(start[k], words - run_words)
            n = np.maximum(0, high - low + 1)
            each = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else low
            packed = np.unique(np.repeat(r[k], n) << 32 | each)
            r, each = packed >> 32, packed & 0xFFFFFFFF
            h, g = run_keys(w.h, first[r - lo] + each, run_words)
            yield cut(SEED, r, each, np.full(len(r), run_words), h=pa.array(h, pa.int64()), g=int32(g))


def spans_of(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    """For each text its runs of least_words or more, split by verdict."""
    for batch in batches:
        (row, x), ids = elements(batch, "x"), np.asarray(batch.column("doc_id"))
        order, run, words = in_runs(row, x["start"], x["start"] + x["size"])
        order, run = order[words >= least_words], run[words >= least_words]
        gone = x["keep"][order] != ids[row[order]]
        # what a lost span covers is lost, whatever a window inside it says
        start, end = x["start"][order], (x["start"] + x["size"])[order]
        far = int(end.max(initial=0)) + 1
        covered = np.maximum.accumulate(np.where(gone, run * far + end, -1)) if len(order) else run
        stays = gone | (covered < run * far + end)
        order, run, gone = order[stays], run[stays], gone[stays]
        # a run's kept spans and its lost ones run apart
        again, run, words = in_runs(2 * run + gone, x["start"][order], (x["start"] + x["size"])[order])
        order, gone = order[again], gone[again]
        first = np.flatnonzero(np.diff(run, prepend=-1))
        over = lambda f, c: f.reduceat(x[c][order], first) if len(first) else x[c][:0]
        columns = [ids[row[order[first]]], over(np.minimum, "a"), over(np.maximum, "b"), words[first], gone[first], over(np.minimum, "keep")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()]
        names = ["doc_id", "start_char", "end_char", "n_words", "removed", "keep_doc_id"]
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types)], names)


def held_by_several(of: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """(keys, keep): the keys that rows of several doc_ids have, with the least doc_id; a written table."""
    ends = of.groupBy(*keys).agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"))
    return written(ends.where("keep <> last").drop("last"), tag)


def _want(kind: int, start: str, size: str | Column, keep: Column | None = None, same: Column | None = None) -> Column:
    none = F.lit(None)
    size = F.col(size) if isinstance(size, str) else size
    keep, same = none.cast("long") if keep is None else keep, none.cast("binary") if same is None else same
    return F.struct(F.lit(kind).alias("kind"), F.col(start).alias("start"), size.alias("size"), keep.alias("keep"), same.alias("same"))


def repeated_passages(docs: DataFrame, percent: int = 75, min_words: int = MIN_WORDS) -> DataFrame:
    """The passages of min_words or more that other documents repeat, as merged spans of each document.

    One row per text and span: doc_id, start_char, end_char, n_words, removed, keep_doc_id. A run of overlapping or
    adjoining paragraphs counts with min_words or more; inside it, paragraphs that all stay or all go are one
    span. Removed spans repeat a passage that a document with a smaller doc_id keeps (keep_doc_id, the least of the
    span's paragraphs). Whole texts are read. Every run of
    50 words or more that documents share is found, shorter ones where they hold a window; a span may start and end
    up to 26 words inside the shared run. Null or empty texts hold no passage. Rows without doc_id are left out,
    for nothing could name them. Rows that share a doc_id are one document, whose texts don't repeat one another; rows
    that repeat the text too count once, and each other text has spans of its own. An empty table gives no rows;
    extra columns are ignored.
    """
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # a hash of the text tells the texts of a doc_id apart; rows that repeat both are gathered as sets
    texts, row = texts.select("doc_id", F.xxhash64("text").alias("v"), "text"), ["doc_id", "v"]
    spark_type = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    schema = "doc_id long, v long, " + ", ".join(f"{c} array<{spark_type[t]}>" for c, t in _UNITS.items())
    units = written(texts.mapInArrow(units_of, schema), "passage-units")

    # windows with equal words
    x = units.select(*row, F.explode(F.arrays_zip("w_start", "w_h", "w_g")).alias("x"))
    seeds = x.select(*row, F.col("x.w_start").alias("start"), F.col("x.w_h").alias("h"), F.col("x.w_g").alias("g"))
    shared = held_by_several(seeds, ["h", "g"], "passage-shared")
    of_texts = skew_join(seeds, shared, ["h", "g"]).groupBy(*row).agg(F.collect_set(F.struct("start", "h", "g", "keep")).alias("x"))
    out = "doc_id long, v long, chains array<struct<start:int,size:int,keep:long>>, unsure array<struct<h:long,g:int>>, x array<struct<start:int,h:long,g:int,keep:long>>"
    chained = written(of_texts.mapInArrow(partial(chains_of, least_words=min_words), out), "passage-chains")
    discard(shared)
    # a chain that is too short to tell has all runs of min_words around its windows compared, wherever they occur
    unsure = written(chained.select(F.explode("unsure").alias("x")).select("x.h", "x.g").distinct(), "passage-unsure")
    found = chained.select(*row, F.explode("x").alias("x")).select(*row, "x.start", "x.h", "x.g")
    seeded = skew_join(found, unsure, ["h", "g"]).select(*row, _want(SEED, "start", F.lit(WINDOW)).alias("x"))
    chains = chained.select(*row, F.explode("chains").alias("c")).select(*row, _want(CHAIN, "c.start", "c.size", F.col("c.keep")).alias("x"))

    # lines: equal ones are a node, nodes that share a band are candidates
    bands = [f"band{k}" for k in range(BANDS)]
    x = units.select(*row, F.explode(F.arrays_zip(*[c for c in _UNITS if c.startswith("l_")])).alias("x"))
    lines = x.select(*row, *[F.col(f"x.l_{c}").alias(c) for c in ("start", "size", "a", "b", "same", *bands)])
    nodes = lines.groupBy("same").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), *[F.min(c).alias(c) for c in bands])
    nodes = written(nodes.select("same", "lo", "hi", F.array(*bands).alias("bands")), "passage-nodes")
    cands = candidates(nodes.select(F.explode("bands").alias("h"), F.col("same").alias("node")), "passage")
    wanted = written(cands.groupBy(F.col("node").alias("same")).agg(F.lit(True).alias("near")), "passage-wanted")
    held = nodes.select("same", "lo", "hi").join(wanted.hint("merge"), "same", "left").where("near OR lo <> hi")
    held = written(held.select("same", F.coalesce("near", F.lit(False)).alias("near")), "passage-held")
    lines = written(skew_join(lines.drop(*bands), held, "same"), "passage-lines")
    of_lines = lines.where("near").groupBy("same").agg(F.min(F.struct(*row, "start", "size")).alias("at"))
    of_lines = of_lines.select("at.*", "same").select(*row, _want(LINE, "start", "size", same=F.col("same")).alias("x"))

    want = written(chains.unionByName(seeded).unionByName(of_lines).groupBy(*row).agg(F.collect_set("x").alias("want")), "passage-want")
    cuts = written(texts.join(want.hint("merge"), row).select(*row, "text", "want").mapInArrow(partial(cuts_of, run_words=max(min_words, WINDOW)), _CUTS), "passage-cuts")
    discard(units, chained, unsure, held, want)

    runs = cuts.where(F.col("kind") == SEED).drop("keep")
    long_runs = held_by_several(runs, ["h", "g"], "passage-runs")
    contents = cuts.where(F.col("kind") == LINE).select(F.col("same").alias("node"), "grams").dropDuplicates(["node"])
    contents = written(contents.join(nodes.select(F.col("same").alias("node"), "bands").hint("merge"), "node"), "passage-contents")
    labels = near_components(cands, contents, percent, tag="passage")
    discard(cands, contents, wanted)
    rooted = skew_join(nodes.select(F.col("same").alias("node"), "lo", "hi"), labels, "node", "left").where("root IS NOT NULL OR lo <> hi")
    rooted = written(rooted.withColumn("root", F.coalesce("root", "node")), "passage-rooted")
    clusters = written(rooted.groupBy("root").agg(F.min("lo").alias("keep"), F.max("hi").alias("last")).where("keep <> last").select("root", "keep"), "passage-clusters")
    kept = written(skew_join(rooted, clusters, "root").select(F.col("node").alias("same"), "keep"), "passage-kept")

    cols = [*row, "start", "size", "a", "b", "keep"]
    spans = cuts.where(F.col("kind") == CHAIN).select(*cols)
    spans = spans.unionByName(skew_join(runs, long_runs, ["h", "g"]).select(*cols)).unionByName(skew_join(lines, kept, "same").select(*cols))
    spans = spans.groupBy(*row).agg(F.collect_set(F.struct("start", "size", "a", "b", "keep")).alias("x"))
    return spans.mapInArrow(partial(spans_of, least_words=min_words), "doc_id long, start_char int, end_char int, n_words long, removed boolean, keep_doc_id long")
