"""Keyed pseudo-random draws: the same key gives the same draw on any partitioning and in any SQL engine."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(*parts: Column | str | int) -> Column:
    """The key of a draw: its parts as text, with bars between them."""
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def hash32(k: Column) -> Column:
    """The first eight hex digits of the key's md5 as an integer."""
    return F.conv(F.substring(F.md5(k.cast("binary")), 1, 8), 16, 10).cast("long")


def hash_int(k: Column, mod: int = 2**31 - 1) -> Column:
    return hash32(k) % mod


def uniform(*parts: Column | str | int) -> Column:
    """Uniform in (0, 1)."""
    return (hash32(key(*parts)) + 0.5) / 2.0**32


def normal(*parts: Column | str | int) -> Column:
    """Standard normal by Box and Muller's transform of two uniforms."""
    return F.sqrt(-2 * F.ln(uniform(*parts, 1))) * F.cos(2 * math.pi * uniform(*parts, 2))


def box_muller(u: Column, v: Column) -> Column:
    """normal() from its two uniforms."""
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def with_uniforms(df: DataFrame, draws: dict[str, tuple[tuple, tuple]], row_id: str = "row_id") -> DataFrame:
    """df with a column of uniform(*before, row_id, *after) for each name → (before, after), in Arrow batches.

    Many draws in one expression make a method that is too long to be compiled.
    """
    ends = {after: f"__t{i}" for i, after in enumerate(dict.fromkeys(after for _, after in draws.values()))}
    tails = [F.concat_ws("|", F.lit(""), F.col(row_id).cast("string"), *[F.lit(str(x)) for x in after]).alias(t) for after, t in ends.items()]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = {after: Tails(batch.column(t).to_pylist()) for after, t in ends.items()}
            words = [texts[after].md5_words("|".join(map(str, before)))[0] for before, after in draws.values()]
            rows = batch.drop_columns(list(ends.values()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array((w + 0.5) / 2.0**32) for w in words]], [*rows.schema.names, *draws])

    return df.select("*", *tails).mapInArrow(draw, df.withColumns({name: F.lit(None).cast("double") for name in draws}).schema)


def student3(*parts: Column | str | int) -> Column:
    """Student's t with three degrees of freedom: a normal over the root of a mean of three squared ones."""
    squares = [F.pow(normal(*parts, "c", i), 2.0) for i in (1, 2, 3)]
    return normal(*parts, "n") / F.sqrt((squares[0] + squares[1] + squares[2]) / 3)


_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [7, 12, 17, 22, 5, 9, 14, 20, 4, 11, 16, 23, 6, 10, 15, 21]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


class Tails:
    """Many texts whose md5 is asked for behind one beginning after another, as arrays: a digest costs no Python call."""

    def __init__(self, texts: list[str]):
        self.size, self.of_length = len(texts), {}
        texts = [t.encode() for t in texts]
        lengths = np.array([len(t) for t in texts], int)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            self.of_length[int(n)] = rows, np.frombuffer(b"".join(texts[i] for i in rows), np.uint8).reshape(len(rows), n)

    def md5_words(self, head: str) -> list[np.ndarray]:
        """The four groups of eight hex digits of md5(head + text) of each text, as numbers."""
        head = head.encode()
        out = [np.zeros(self.size, np.uint32) for _ in range(4)]
        for n, (rows, tails) in self.of_length.items():
            if len(head) + n > 55:  # more than one block
                words = np.array([np.frombuffer(hashlib.md5(head + t.tobytes()).digest(), ">u4") for t in tails]).T
            else:
                block = np.zeros((len(rows), 64), np.uint8)
                block[:, : len(head)] = np.frombuffer(head, np.uint8)
                block[:, len(head) : len(head) + n] = tails
                block[:, len(head) + n] = 0x80
                block[:, 56:58] = np.frombuffer((8 * (len(head) + n)).to_bytes(2, "little"), np.uint8)
                words = _md5(np.ascontiguousarray(block.view("<u4").T))
            for o, w in zip(out, words):
                o[rows] = w
        return out


def _md5(m: np.ndarray) -> list[np.ndarray]:
    """The digests of one-block messages, m[i] being their i-th words: four words each, read as hex digits are."""
    a, b, c, d = (np.full(m.shape[1], x) for x in _START)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += m[g]
        f += _K[i]
        s = _TURNS[4 * turn + i % 4]
        high = f << np.uint32(s)
        f >>= np.uint32(32 - s)
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return [(x + y).byteswap() for x, y in zip((a, b, c, d), _START)]
