"""MinHash near-dedup with odd sketches.

Each document's shingles give MinHash samples; bands of samples propose candidates, and the samples folded into a
parity bitmap (an odd sketch) tell by an XOR's population count which candidates are far below the threshold. The
rest is confirmed on the full sets. Texts that are the same word by word are one node, whatever their number.

With 32 bands of 4 rows a pair at similarity 0.75 is missed with probability 5e-6; the sketch bound is the mean of
pairs at 0.55, between four and five standard deviations beyond that of pairs at 0.75.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, skew_join, text_or_empty, written
from .flat import Polynomial, Reader, Words, binary_rows, string_column
from .near_links import candidates, near_components
from .shingles import MinHash, mixed, most_unlike, shingle_set

BANDS, ROWS, BITS = 32, 4, 1024
#: Pairs whose sketches differ by more than pairs of this similarity do in the mean are not compared.
SURELY_LESS = 0.55


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, v, text): v is a hash of the text, which tells the texts of a doc_id apart."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("v"), text.alias("text"))


def shingles_by_row(w: Words, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows that hold words, and each one's sorted distinct k-word shingles."""
    rows, first = np.unique(w.row, return_index=True)
    bounds = np.append(first, len(w.h)).tolist()
    return rows, [shingle_set(w.h[a:b], k) for a, b in zip(bounds, bounds[1:])]


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, v, same, n_shingles, bands, sketch): same tells texts that are equal word by word."""

    def sketch(batches: Iterator) -> Iterator:
        reader, one, two, minhash = Reader(), Polynomial(0xD6E8FEB86659FD93), Polynomial(0xA0761D6478BD642F), MinHash(BANDS, ROWS, BITS)
        for batch in batches:
            n = len(batch)
            size, same = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
            bands, odd = np.zeros((n, BANDS), np.int64), np.zeros((n, BITS // 64), np.int64)
            for w in reader.words(string_column(batch, "text")):
                if not len(w.h):
                    continue
                rows, sets = shingles_by_row(w, k)
                first = np.searchsorted(w.row, rows)
                end = np.append(first[1:], len(w.h))
                size[rows] = [len(s) for s in sets]
                same[rows] = np.stack([one.of(w.h, first, end), two.of(mixed(w.h), first, end)], axis=1)
                samples = minhash.samples_of(np.concatenate(sets), np.concatenate([[0], np.cumsum(size[rows])[:-1]]))
                bands[rows], odd[rows] = minhash.band_keys_of(samples), minhash.odd_sketches(samples)
            each = lambda x, m: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(x.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("v"), binary_rows(same), pa.array(size), each(bands, BANDS), each(odd, BITS // 64)],
                ["doc_id", "v", "same", "n_shingles", "bands", "sketch"],
            )

    return texts_of(docs).mapInArrow(sketch, "doc_id long, v int, same binary, n_shingles long, bands array<long>, sketch array<long>")


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, grams) of texts(node, text): sorted distinct k-word shingles."""

    def grams(batches: Iterator) -> Iterator:
        reader = Reader()
        for batch in batches:
            for w in reader.words(string_column(batch, "text")):
                if len(w.h):
                    rows, sets = shingles_by_row(w, k)
                    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(rows)), values], ["node", "grams"])

    return texts.select("node", "text").mapInArrow(grams, "node binary, grams array<long>")


def near_dedup(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A document's set: distinct k-word shingles of its words ([^ \\t-\\r]+, A-Z lower-cased); fewer words make one
    shingle. Documents are linked if 100 * intersection >= percent * union; component_id is the smallest doc_id
    reachable, itself included, and kept says doc_id = component_id. Null or empty texts are linked with nothing.
    Rows that share a doc_id are one document: links of any of their texts count for it. A row without doc_id links
    nothing and is kept, with a null component_id. An empty table gives no rows; extra columns are ignored.
    """
    rows = written(sketches(docs, k), "near-sketches")
    sets = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # a node is a text, known by its digest; one of its rows stands for it
    nodes = sets.groupBy(F.col("same").alias("node")).agg(
        F.min(F.struct("doc_id", "v", F.col("n_shingles").cast("int").alias("n"), "bands", "sketch")).alias("x")
    )
    nodes = written(nodes.select("node", "x.*"), "near-nodes")
    cands = candidates(nodes.select(F.explode("bands").alias("h"), "node"), "near")
    needed = written(cands.select("node").distinct(), "near-needed")
    held = written(nodes.join(needed.hint("merge"), "node"), "near-held")
    sketched = written(cands.join(held.select("node", "n", "sketch").hint("merge"), "node"), "near-sketched")
    texts = texts_of(docs).join(held.select("doc_id", "v", "node").hint("merge"), ["doc_id", "v"]).select("node", "text")
    contents = shingle_sets(texts, k).groupBy("node").agg(F.any_value("grams").alias("grams"))
    contents = written(contents.join(held.select("node", "bands").hint("merge"), "node"), "near-contents")
    # the texts of a doc_id are linked
    several = sets.groupBy("doc_id").agg(F.min("same").alias("a"), F.max("same").alias("z")).where("a <> z").select("doc_id", "a")
    linked = written(skew_join(sets.select("doc_id", F.col("same").alias("b")), written(several, "near-several"), "doc_id").where("a <> b").select("a", "b").distinct(), "near-linked")
    labels = near_components(sketched, contents, percent, most_unlike(BITS, BANDS * ROWS, SURELY_LESS), linked=linked)
    discard(cands, needed, held, sketched, contents)
    rooted = nodes.select("node", "doc_id").join(labels.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "near-rooted")
    least = written(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "near-least")
    ids = written(skew_join(rooted, least, "root").select(F.col("node").alias("same"), "component_id"), "near-components")
    found = skew_join(rows.select("doc_id", "same", "n_shingles"), ids, "same", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near copies, the one with the smallest doc_id; all columns stay.

    Cases as in near_dedup(): rows without doc_id, and documents without words, stay. Rows that share a doc_id are
    one document and stay or go together.
    """
    gone = written(near_dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "near-gone")
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["__gone"], "left_anti")
