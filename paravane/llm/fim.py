"""Fill-in-middle: texts are cut in three at token borders and put together anew around sentinels.

Cuts are found in UTF-8 bytes, lengths are told in code points. A sparse exception index converts between the two: it
holds only the multibyte characters of a text, their places and the bytes that they have over one, so it is empty for
ASCII texts, and between two exceptions a place is one addition away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_LETTER = np.zeros(256, bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True


class SparseIndex:
    """Code-point and byte places of a UTF-8 text, from its multibyte characters alone."""

    def __init__(self, data: np.ndarray):
        first = np.flatnonzero(data >= 0xC0)  # first bytes of multibyte characters
        lead = data[first]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(extra)])  # bytes over one in the first k exceptions
        self.at_byte = first
        self.at_char = first - self.excess[:-1]

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """The number of characters before each byte place, which must be a character's border."""
        return byte - self.excess[np.searchsorted(self.at_byte, byte)]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """The number of bytes before each character place."""
        return char + self.excess[np.searchsorted(self.at_char, char)]


def token_starts(data: np.ndarray) -> np.ndarray:
    """Byte places where tokens start: runs of A-Z and a-z are one token, any other character is one."""
    letter = _LETTER[data]
    inner = letter.copy()
    inner[0:1] = False
    inner[1:] &= letter[:-1]
    return np.flatnonzero(~inner & ((data & 0xC0) != 0x80))


def cut(text: bytes, h1: int, h2: int) -> tuple[int, list[int], list[int]]:
    """The tokens of the text, and the ends of prefix and middle in bytes and in code points."""
    data = np.frombuffer(text, np.uint8)
    starts = token_starts(data)
    n = len(starts)
    ends = np.append(starts, len(data))[sorted((h1 % (n + 1), h2 % (n + 1)))]
    return n, ends.tolist(), SparseIndex(data).chars(ends).tolist()


def restore(output: bytes, form: str, sentinels: tuple[bytes, bytes, bytes]) -> bytes:
    """The text that the output was made from."""
    p, s, m = sentinels
    if form == "plain":
        return output
    rest, _, middle = output.partition(m)
    if form == "psm":
        prefix, _, suffix = rest[len(p) :].partition(s)
    else:
        suffix, _, prefix = rest[len(s) :].partition(p)
    return prefix + middle + suffix


def fill_in_middle(
    docs: DataFrame, seed: str = "1", fim_percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)
) -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars, output, restored (both binary, UTF-8).

    Two cuts at token borders (tokens: runs of A-Z and a-z, or one other character), drawn by a hash of seed and
    doc_id, give prefix, middle and suffix. form tells their order: psm, spm, or plain for texts that stay as they are
    (empty ones, those that hold a sentinel, and 100 - fim_percent of the rest). prefix_chars and middle_chars are null
    if plain. A null text counts as empty, a null doc_id as the empty id. Rows that repeat a doc_id draw the same numbers;
    all rows stay. Texts are handled whole, one at a time. An empty table gives no rows; extra columns are ignored.
    """
    marks = tuple(x.encode() for x in sentinels)
    fields = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary"

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # outputs leave in small batches, so long texts do not pile up
                part, out = batch.slice(at, 64), []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    text = text or b""
                    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
                    h1, h2, h3, h4 = (int(key[k : k + 8], 16) for k in (0, 8, 16, 24))
                    n, (a, b), (left, mid) = cut(text, h1, h2)
                    if not text or h3 % 100 >= fim_percent or any(x in text for x in marks):
                        out.append((doc_id, n, "plain", None, None, text, text))
                        continue
                    form = "spm" if h4 % 100 < spm_percent else "psm"
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    made = b"".join((s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle))
                    out.append((doc_id, n, form, left, mid - left, made, restore(made, form, marks)))
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(transformed, fields)
