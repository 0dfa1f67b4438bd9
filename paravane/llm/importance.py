"""Importance resampling towards a target: hashed n-gram counts of corpus and target weigh each document (DSIR, Xie et al. 2023).

Documents, their words joined by single spaces, are scanned once: the running CRC-32 at each word's two borders is stored.
CRC is linear over GF(2), so the CRC of any run of words is that of the longer prefix, xor that of the shorter one
shifted by the run's length. Shifts by powers of two are tables, and numpy applies them to all runs of a length at once.
The same law lets the scan itself run in chunks side by side, whose states a prefix sum of shifts then joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import skew_join, written

# words: 0-9, letters, and all bytes of characters beyond ASCII
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = True
#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _tables() -> np.ndarray:
    """For each k, the shift by 2**k bytes as four tables over the bytes of a CRC."""
    columns = [1 << i for i in range(32)]  # the images of the 32 unit vectors
    for _ in range(8):  # one zero byte is eight zero bits
        columns = [(c >> 1) ^ (POLYNOMIAL if c & 1 else 0) for c in columns]
    tables = np.zeros((40, 4, 256), np.uint32)
    for k in range(len(tables)):
        for byte in range(4):
            for v in range(1, 256):
                low = v & -v
                tables[k, byte, v] = tables[k, byte, v ^ low] ^ np.uint32(columns[8 * byte + low.bit_length() - 1])
        step = tables[k]
        columns = [int(step[0, c & 255] ^ step[1, (c >> 8) & 255] ^ step[2, (c >> 16) & 255] ^ step[3, c >> 24]) for c in columns]
    return tables


_SHIFT: list[np.ndarray] = []
ONES = np.uint32(0xFFFFFFFF)
#: Bytes that one lane of the scan reads, a power of two.
CHUNK = 64


def _shift(crc: np.ndarray, k: int) -> np.ndarray:
    """Each register after 2**k zero bytes."""
    if not _SHIFT:
        _SHIFT.append(_tables())
    t = _SHIFT[0][k]
    return t[0, crc & 255] ^ t[1, (crc >> 8) & 255] ^ t[2, (crc >> 16) & 255] ^ t[3, crc >> 24]


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each register after so many zero bytes."""
    out = crc.astype(np.uint32)
    for k in range(int(length.max(initial=0)).bit_length()):
        some = np.flatnonzero((length >> k) & 1)
        out[some] = _shift(out[some], k)
    return out


def _step(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """Each register after one more byte."""
    return _shift(crc ^ np.asarray(byte, np.uint32), 0)


def running(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The CRC register, from zero, after the first at[i] bytes of data (at[i] > 0), in one scan."""
    n = -(-len(data) // CHUNK)
    lanes = np.zeros(n * CHUNK, np.uint8)
    lanes[: len(data)] = data
    lanes = lanes.reshape(n, CHUNK).T.copy()
    inner, state = np.empty((CHUNK, n), np.uint32), np.zeros(n, np.uint32)
    first = _shift(np.arange(256, dtype=np.uint32), 0)  # the register after one byte
    for t in range(CHUNK):
        inner[t] = state = first[(state ^ lanes[t]) & 255] ^ (state >> 8)
    whole, d, k = state.copy(), 1, CHUNK.bit_length() - 1
    while d < n:  # the register after each chunk, by doubling
        whole[d:] ^= _shift(whole[:-d], k)
        d, k = 2 * d, k + 1
    chunk, inside = (at - 1) // CHUNK, (at - 1) % CHUNK
    before = np.where(chunk > 0, whole[chunk - 1], np.uint32(0))
    return inner[inside, chunk] ^ shifted(before, inside + 1)


class Prefixes:
    """Running CRCs at the borders of the words of several texts (UTF-8 bytes), over all of them in one scan."""

    def __init__(self, texts: list):
        text = b"\n".join([*(t or b"" for t in texts), b""])
        size = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts)) + 1
        data = _LOWER[np.frombuffer(text, np.uint8)]
        inside = _IN_WORD[data]
        change = np.flatnonzero(np.diff(inside, prepend=False))
        start, end = change[::2], change[1::2]  # the text ends outside of words
        self.row = np.searchsorted(np.cumsum(size), start, "right")
        self.counts = np.bincount(self.row, minlength=len(texts))
        keep = inside.copy()
        keep[end] = True  # one separator after each word
        plain = data[keep]
        plain[~inside[keep]] = 32
        self.size = end - start
        self.at_after = np.cumsum(self.size + 1) - 1
        self.at_before = self.at_after - self.size
        self.after = running(plain, self.at_after) if len(start) else np.empty(0, np.uint32)
        self.before = np.zeros(len(start), np.uint32)
        self.before[1:] = _step(self.after[:-1], 32)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The CRC-32 of each run of k words of a text, and the text's number."""
        first = np.arange(max(0, len(self.row) - k + 1))
        if k > 1:
            first = first[self.row[first] == self.row[first + k - 1]]
        last = first + k - 1
        # the shorter prefix, and the register's initial ones, are shifted by the run's length and cancel
        crc = self.after[last] ^ shifted(self.before[first] ^ ONES, self.at_after[last] - self.at_before[first]) ^ ONES
        return crc, self.row[first]


def _blocks(batch: pa.RecordBatch, rows: int = 4096, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many rows, and so many bytes of text if no single text is longer."""
    lengths, at = pc.binary_length(batch["text"]).fill_null(0).to_pylist(), 0
    while at < batch.num_rows:
        end, total = at + 1, lengths[at]
        while end < batch.num_rows and end - at < rows and total + lengths[end] <= size:
            total += lengths[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def bucket_counts(texts: DataFrame, buckets: int, n_max: int) -> DataFrame:
    """(bucket, n): how many runs of 1 to n_max words of all texts fall into each bucket; each task sends one row a bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _blocks(batch):
                prefixes = Prefixes(part["text"].to_pylist())
                for k in range(1, n_max + 1):
                    total += np.bincount(prefixes.runs(k)[0] % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    parts = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(counted, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: floor(1000 ln of the ratio of its smoothed shares in target and corpus)."""
    b, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _vector(counts: DataFrame, buckets: int) -> np.ndarray:
    """Counts as an array of `buckets` numbers, which bounds what the driver gets."""
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():
        out[r.bucket] = r.n
    return out


def importance_scores(docs: DataFrame, target: DataFrame, buckets: int = 10_000, n_max: int = 1, seed: str = "2024") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_features, weight, score (all long).

    Features are runs of 1 to n_max words (0-9, letters, and all beyond ASCII, A-Z lower-cased). weight is the floored
    mean of their buckets' gains, 0 without features; score adds the floored Gumbel noise that seed and doc_id draw.
    Null texts count as empty, in both tables. Counts cover all rows of docs and target.
    """
    gain = docs.sparkSession.sparkContext.broadcast(
        gains(_vector(bucket_counts(docs, buckets, n_max), buckets), _vector(bucket_counts(target, buckets, n_max), buckets))
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch):
                prefixes, n = Prefixes(part["text"].to_pylist()), part.num_rows
                total, features = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for k in range(1, n_max + 1):
                    crc, row = prefixes.runs(k)
                    got = gain.value[crc % np.uint32(buckets)]
                    below = np.concatenate([[0], np.cumsum(got)])  # rows are in order, so sums are differences
                    ends = np.searchsorted(row, np.arange(n + 1))
                    total += below[ends[1:]] - below[ends[:-1]]
                    features += np.diff(ends)
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                ids = part["doc_id"].to_pylist()
                score = [w + _noise(i, seed) for w, i in zip(weight.tolist(), ids)]
                arrays = [pa.array(x, pa.int64()) for x in (ids, prefixes.counts, features, weight, score)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, n_words long, n_features long, weight long, score long")


def _noise(doc_id: int | None, seed: str) -> int:
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, buckets: int = 10_000, n_max: int = 1, seed: str = "2024"
) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (all long).

    Of the N rows with at least min_words words, floor(percent * N / 100) with the highest scores (ties: the smaller
    doc_id) are drawn without replacement and have their rank; rank is null for all others. Rows that repeat a doc_id
    and have the same score share the rank of the first of them, and are drawn if that rank is; a null doc_id comes
    first among ties. Tables without rows give none; with an empty target, its shares are even. Extra columns are ignored.

    Ranks need no order over the whole table: the numbers of rows per score, a table that the range of gains and noise
    bounds, tell where each score's rows begin, and only drawn rows are put in order, score by score.
    """
    rows = written(importance_scores(docs, target, buckets, n_max, seed), "importance-scores")
    rated = rows.where(F.col("n_words") >= min_words)
    # so many scores exist at most: gains and noise are whole numbers in a range that does not depend on the input
    by_score = sorted(((r.score, r.n) for r in rated.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    quota, before, starts = percent * sum(n for _, n in by_score) // 100, 0, []
    for score, n in by_score:
        if before >= quota:
            break
        starts.append((score, before))
        before += n
    lowest = starts[-1][0] if starts else None
    starts = docs.sparkSession.createDataFrame(starts, "score long, before long")
    drawable = (F.col("n_words") >= min_words) & (F.col("score") >= lowest) if lowest is not None else F.lit(False)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))  # null first
    drawn = rows.where(drawable).withColumn("id", key)
    ids = drawn.groupBy("score", "id").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("score").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    ranks = ids.select("score", "id", (F.coalesce(ahead, F.lit(0)) + 1).alias("place")).join(F.broadcast(starts), "score")
    ranks = written(ranks.select("score", "id", (F.col("place") + F.col("before")).alias("rank")).where(F.col("rank") <= quota), "importance-ranks")
    ranked = skew_join(drawn, ranks, ["score", "id"], "left").select("doc_id", "n_features", "weight", "score", "rank")
    rest = rows.where(~F.coalesce(drawable, F.lit(False)))
    return rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")).unionByName(ranked)
