"""BPE encoding and decoding of whole texts with a byte-level vocabulary file.

A word's parts and the ranks of its adjacent pairs lie in two contiguous arrays: scan for the least rank, delete a
boundary, refresh the two neighbouring ranks, until no pair has a rank. Long words keep the same parts in a linked
list with a heap of ranks, for scanning costs the square of the length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

#: Words of more bytes than this are merged with a heap.
SHORT = 128
#: Words whose encodings a Python worker keeps; beyond that it starts anew.
CACHE = 300_000

# The pre-tokenizer's pattern, with its white space spelt out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class Bpe:
    """A vocabulary: encodes a text to ids and decodes ids to a text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        to_byte = {c: b for b, c in enumerate(chars)}
        self.of_byte = [vocab[c] for c in chars]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.rank[vocab[a], vocab[b]] = len(self.merged)
            self.merged.append(vocab[a + b])
        self.bytes_of = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, tuple[int, str, bytes]] = {}

    def encode_word(self, word: str) -> list[int]:
        parts = [self.of_byte[b] for b in word.encode("utf-8")]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank, none = self.rank.get, len(self.merged)
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i] = self.merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], after[i] = self.merged[r], 1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (q := rank((parts[left], parts[after[left]]))) is not None:
                    heapq.heappush(heap, (q, left, parts[left], parts[after[left]]))
        return [p for p, x in zip(parts, gone) if not x]

    def _known(self, word: str) -> tuple[int, str, bytes]:
        """Of a word: number of ids, the ids joined by commas, and the bytes that the ids decode to."""
        if len(self.cache) >= CACHE:
            self.cache.clear()
        ids = self.encode_word(word)
        got = self.cache[word] = (len(ids), ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids)))
        return got

    def encode_decode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, the text decoded from them."""
        found = []
        get, known = self.cache.get, self._known
        for piece in self.at_special.split(text) if self.at_special else [text]:
            if piece in self.special:
                i = self.special[piece]
                found.append((1, str(i), self.bytes_of[i]))
            else:
                found += [get(w) or known(w) for w in self.words.findall(piece)]
        if not found:
            return 0, "", ""
        n, ids, decoded = zip(*found)
        return sum(n), ",".join(ids), b"".join(decoded).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        ids = self.encode_decode(text)[1]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(1)
def load(path: str) -> Bpe:
    """The vocabulary, read once in each Python worker."""
    return Bpe(path)


def bpe_encode(docs: DataFrame, vocab_path: str, with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids and decoded.

    Special tokens' strings in a text become their ids. A null text counts as empty: no ids, and the digests are
    those of the empty string. Rows are worked on one by one, so repeated rows give repeated results, and an empty
    table gives none. Extra columns are ignored. vocab_path must be a file that each executor has.
    """

    def encoded(batches: Iterator) -> Iterator:
        import pandas as pd

        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        bpe = load(vocab_path)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                n, ids, decoded = bpe.encode_decode(text or "")
                rows.append((n, sha(ids), sha(decoded)) + (([int(i) for i in ids.split(",")] if ids else [], decoded) if with_ids else ()))
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
            yield pd.concat([pdf[["doc_id"]].astype("Int64").reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInPandas(encoded, schema)
