"""Words of many texts as flat numpy arrays, straight from the UTF-8 bytes of an Arrow column (inside tasks).

White space and A-Z are single bytes in UTF-8, so bytes are cut into words and lower-cased without making strings. A
word's hash is a polynomial over its bytes, taken from running sums; the same trick hashes a line from its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .shingles import mixed

#: Bytes that are worked on at once; longer texts are cut between words.
BLOCK = 1 << 18
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Polynomial:
    """Hashes of slices of a sequence: sum of x[i] * base**(i - start), modulo 2**64, for any slices at once."""

    def __init__(self, base: int):
        self.base, self.back = base | 1, pow(base | 1, -1, 1 << 64)
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            up, down = np.full(size, self.base, np.uint64), np.full(size, self.back, np.uint64)
            up[0] = down[0] = 1
            self.powers, self.inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def of(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of x[start:end] for each (start, end), end > start; x holds uint64."""
        self._reach(len(x))
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.powers[: len(x)], out=total[1:])
        return mixed((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words in order: hash, first and end byte (from the start of the batch's bytes), row of the batch, line of the row."""

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    line: np.ndarray


class Reader:
    """Cuts the texts of Arrow columns into words."""

    def __init__(self):
        self.letters = Polynomial(0x9E3779B97F4A7C15)

    def _cut(self, data: np.ndarray, row_start: np.ndarray, base: int) -> Words:
        """Words of data, whose rows start at row_start (from 0; rows hold bytes); base: the place of data in the batch."""
        space = _IS_SPACE[data]
        first, last = ~space, ~space
        first[1:] &= space[:-1]
        first[row_start] = ~space[row_start]
        last[:-1] &= space[1:]
        ends = row_start[1:] - 1
        last[ends] = ~space[ends]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        h = self.letters.of(_LOWER[data].astype(np.uint64) + np.uint64(1), start, end)
        row = np.searchsorted(row_start, start, "right") - 1
        breaks = np.flatnonzero(data == 10)
        # breaks before the word, less those before its row
        line = np.searchsorted(breaks, start) - np.searchsorted(breaks, row_start)[row]
        return Words(h, start + base, end + base, row, line)

    def words(self, column: pa.Array) -> Iterator[Words]:
        """Words of whole rows of a string column, some rows at a time."""
        n = len(column)
        at = np.frombuffer(column.buffers()[1], np.int32, n + 1, 4 * column.offset)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
            if at[j] - at[i] > BLOCK:
                yield self._long(data, int(at[i]), int(at[j]), i)
            else:
                rows = np.flatnonzero(at[i + 1 : j + 1] > at[i:j]) + i
                if len(rows):
                    got = self._cut(data[at[i] : at[j]], (at[rows] - at[i]).astype(np.int64), int(at[i]))
                    got.row = rows[got.row]
                    yield got
            i = j

    def _long(self, data: np.ndarray, lo: int, hi: int, row: int) -> Words:
        """The words of one long row, cut at white space into pieces of about BLOCK bytes."""
        parts, lines = [], 0
        while lo < hi:
            cut = min(hi, lo + BLOCK)
            if cut < hi:
                spaces = np.flatnonzero(_IS_SPACE[data[lo:cut]])
                while not len(spaces) and cut < hi:  # one word over the whole piece
                    cut = min(hi, cut + BLOCK)
                    spaces = np.flatnonzero(_IS_SPACE[data[lo:cut]])
                cut = lo + int(spaces[-1]) + 1 if len(spaces) else hi
            got = self._cut(data[lo:cut], np.zeros(1, np.int64), lo)
            got.line = got.line + lines
            lines += int(np.count_nonzero(data[lo:cut] == 10))
            parts.append(got)
            lo = cut
        h, start, end, line = (np.concatenate([getattr(p, c) for p in parts]) for c in ("h", "start", "end", "line"))
        return Words(h, start, end, np.full(len(h), row), line)


class Characters:
    """Character places of a batch's bytes."""

    def __init__(self, column: pa.Array):
        self.at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        self.ascii = not (self.data[self.at[0] : self.at[-1]] > 127).any()
        if not self.ascii:
            self.base = int(self.at[0])
            self.count = np.zeros(int(self.at[-1]) - self.base + 1, np.int64)
            np.cumsum((self.data[self.base : self.at[-1]] & 0xC0) != 0x80, out=self.count[1:])

    def of(self, byte: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Characters of the row before each byte place."""
        if self.ascii:
            return byte - self.at[row]
        return self.count[byte - self.base] - self.count[self.at[row] - self.base]


def int32(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.int32), pa.int32())


def binary_rows(x: np.ndarray) -> pa.Array:
    """Rows of 16 bytes as a binary column."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """values as one list for each of n rows; rows (rising) tells the row of each value."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def elements(batch: pa.RecordBatch, name: str, *as_arrow: str) -> tuple[np.ndarray, dict]:
    """The row of each element of a column of lists of structs, and the structs' fields; null numbers are 0."""
    column = batch.column(name)
    values = column.flatten()
    row = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths()))
    fields = {f.name: values.field(k) for k, f in enumerate(values.type)}
    return row, {c: v if c in as_arrow else np.asarray(v.fill_null(0)) for c, v in fields.items()}


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with 32-bit offsets and no nulls."""
    got = batch.column(name)
    return got if pa.types.is_string(got.type) else got.cast(pa.string())
