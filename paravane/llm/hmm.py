"""LM scoring with a hidden Markov model over words.

States emit classes of words: each of the most frequent training words is a class of its own, the end of a text is
one, and all other words share classes by their last letters. A word's probability within such a class comes from its
training count, joined to the documents for words that aren't frequent. Baum-Welch runs over all training documents:
each partition adds up expected counts, Spark sums them by class, and the driver only sees one row a class. The
training documents are dealt into groups that refresh their counts in turn (incremental EM, Neal and Hinton 1998), so
each sweep takes several steps. Scores come from the scaled forward recursion and are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, crc_mod, text_or_empty, written
from .shingles import words_of

STATES, HEAD, TAIL, GROUPS, SWEEPS = 8, 30_000, 2_048, 4, 2
#: Tokens whose forward variables one block holds.
BLOCK = 800_000
#: Of longer texts, training holds the forward variables of so many tokens at a time.
PIECE = 100_000
SUFFIX = 3


def tail_class(word: str, end: int) -> int:
    """Class of a word that isn't frequent: after that of the end of a text."""
    return end + 1 + crc32(word[-SUFFIX:].encode("utf-8")) % TAIL


class Classes(dict):
    """Classes of words: the frequent ones, and a bounded number of others as they come."""

    def __init__(self, head: dict[str, int], most: int = 300_000):
        super().__init__(head)
        self.head, self.most = head, most

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.head) + self.most:
            self.clear()
            self.update(self.head)
        got = self[word] = tail_class(word, len(self.head))
        return got


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over all words of train(text)."""
    words = F.split(ascii_lower(F.col("text")), "[\\x20\\x09-\\x0D]+")
    return train.select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("c"))


def blocks(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences in blocks of like length, longest first: their numbers, lengths, and tokens by (time, sequence)."""
    length = np.array([len(s) for s in sequences])
    order = np.argsort(-length, kind="stable")
    at = 0
    while at < len(order):
        longest = max(1, int(length[order[at]]))
        some = order[at : at + max(1, BLOCK // longest)]
        # numpy looks up 64-bit indexes fastest; a single text of any length stays as it is
        tokens = np.zeros((longest, len(some)), np.int64 if longest <= BLOCK else sequences[order[at]].dtype)
        for j, i in enumerate(some):
            tokens[: length[i], j] = sequences[i]
        yield some, length[some], tokens
        at += len(some)


class Hmm:
    """Start, transition and emission probabilities (emissions by class and state)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def forward(self, lengths: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Natural log-likelihoods."""
        total, a = np.zeros(len(lengths)), np.empty((0, len(self.start)))
        for t in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -t))  # lengths fall, so these sequences still run
            a = (np.broadcast_to(self.start, (live, len(self.start))) if t == 0 else a[:live] @ self.move) * self.emit[tokens[t, :live]]
            s = a.sum(axis=1)
            a /= s[:, None]
            total[:live] += np.log(s)
        return total

    def expected(self, lengths: np.ndarray, tokens: np.ndarray, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Add the block's expected counts of starts, moves and emissions.

        The tokens of all sequences that still run at a time lie end to end, time after time, so emissions are looked up once.
        """
        steps = int(lengths.max(initial=0))
        if not steps:
            return
        starts, moves, emits = into
        live = np.searchsorted(-lengths, -np.arange(steps))
        at = np.concatenate([[0], np.cumsum(live)])
        flat = np.concatenate([tokens[t, : live[t]] for t in range(steps)])
        given = self.emit[flat]
        alphas, scales, back = np.empty_like(given), np.empty(len(flat)), np.ascontiguousarray(self.move.T)
        for t in range(steps):
            i, j = at[t], at[t + 1]
            a = alphas[i:j]
            if t:
                np.matmul(alphas[at[t - 1] : at[t - 1] + j - i], self.move, out=a)
                a *= given[i:j]
            else:
                np.multiply(self.start, given[i:j], out=a)
            scales[i:j] = a.sum(axis=1)
            a /= scales[i:j, None]
        given /= scales[:, None]
        gammas, w = np.empty_like(alphas), np.empty((0, len(self.start)))
        for t in range(steps - 1, -1, -1):
            i, j, k = at[t], at[t + 1], len(w)
            b = np.ones((j - i, len(self.start)))
            if k:
                moves += self.move * (alphas[i : i + k].T @ w)
                b[:k] = w @ back
            np.multiply(alphas[i:j], b, out=gammas[i:j])
            w = b * given[i:j]
        starts += gammas[: at[1]].sum(axis=0)
        for k in range(len(self.start)):
            emits[:, k] += np.bincount(flat, gammas[:, k], len(emits))

    def _run(self, a: np.ndarray | None, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward variables and scales of one sequence's tokens; a: the variables before them, None at its start."""
        alphas, scales = np.empty((len(tokens), len(self.start))), np.empty(len(tokens))
        for t, k in enumerate(tokens):
            a = (self.start if a is None else a @ self.move) * self.emit[k]
            scales[t] = a.sum()
            alphas[t] = a = a / scales[t]
        return alphas, scales

    def expected_long(self, tokens: np.ndarray, into: tuple[np.ndarray, np.ndarray, np.ndarray], piece: int = PIECE) -> None:
        """As expected() for one sequence of any length: forward variables are kept at the borders of pieces only.

        The backward pass goes through the pieces from the last to the first and makes each one's forward variables anew;
        backward values pass over the borders, so the counts are those of the whole sequence.
        """
        starts, moves, emits = into
        entering: list[np.ndarray | None] = [None]
        for at in range(0, len(tokens) - piece, piece):
            entering.append(self._run(entering[-1], tokens[at : at + piece])[0][-1])
        w = None  # what the next token's emission, backward value and scale give
        for k in range(len(entering) - 1, -1, -1):
            part = tokens[k * piece : (k + 1) * piece]
            alphas, scales = self._run(entering[k], part)
            gammas = np.empty_like(alphas)
            for t in range(len(part) - 1, -1, -1):
                b = np.ones(len(self.start))
                if w is not None:
                    moves += self.move * np.outer(alphas[t], w)
                    b = self.move @ w
                gammas[t] = alphas[t] * b
                w = self.emit[part[t]] * b / scales[t]
            for s in range(len(self.start)):
                emits[:, s] += np.bincount(part, gammas[:, s], len(emits))
            if k == 0:
                starts += gammas[0]


def first_guess(freq: np.ndarray) -> Hmm:
    """States that differ a little from the words' overall shares, and seldom change."""
    rng = np.random.default_rng(11)
    emit = (freq[:, None] + 0.5) * rng.uniform(0.5, 1.5, (len(freq), STATES))
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Hmm(np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def maximised(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Hmm:
    """The M-step, with small prior counts so that nothing has probability zero."""
    s, m, e = starts + 0.5, moves + 0.5, emits + 0.02
    return Hmm(s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0))


def baum_welch(coded: DataFrame, freq: np.ndarray) -> Hmm:
    """Train on coded(cls binary, grp int); freq: the training count of each class."""
    spark, model = coded.sparkSession, first_guess(freq)
    columns = [f"s{k}" for k in range(STATES)]
    schema = "cls int, " + ", ".join(f"{c} double" for c in columns)
    latest: dict[int, tuple] = {}
    for step in range(GROUPS * SWEEPS):
        sent = spark.sparkContext.broadcast(model)

        def count(batches: Iterator, sent=sent) -> Iterator:
            import pandas as pd

            model = sent.value
            into = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(model.emit)
            for pdf in batches:
                texts = [np.frombuffer(b, np.uint16) for b in pdf["cls"]]
                for _, lengths, tokens in blocks([t for t in texts if len(t) <= PIECE]):
                    model.expected(lengths, tokens, into)
                for text in texts:
                    if len(text) > PIECE:
                        model.expected_long(text, into, PIECE)
            # moves from state k are row -1-k, starts row -1-STATES
            used = np.flatnonzero(into[2].sum(axis=1))
            rows = np.concatenate([into[2][used], into[1], into[0][None]])
            cls = np.concatenate([used, -1 - np.arange(STATES), [-1 - STATES]])
            yield pd.DataFrame(rows, columns=columns).assign(cls=cls.astype(np.int32))[["cls", *columns]]

        parts = coded.where(F.col("grp") == step % GROUPS).select("cls").mapInPandas(count, schema)
        sums = parts.groupBy("cls").agg(*[F.sum(c).alias(c) for c in columns]).collect()
        starts, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(model.emit)
        for r in sums:
            if r[0] >= 0:
                emits[r[0]] = r[1:]
            elif r[0] == -1 - STATES:
                starts += r[1:]
            else:
                moves[-1 - r[0]] = r[1:]
        latest[step % GROUPS] = starts, moves, emits
        model = maximised(*(sum(x) for x in zip(*latest.values())))
    return model


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words ([^ \\t-\\r]+, A-Z lower-cased), then one end of text. Learns from all rows whose crc32(doc_id as
    text) mod 7 is not 2; the others are held out. base_score sums log10((c + 1) / (N + V + 1)) with c the token's
    training count, N all training tokens and V the distinct ones; n_known counts tokens with c > 0; score is the
    model's log10 probability of the text. A null text counts as empty and is its end alone; a null doc_id counts as
    the empty text, so its row is trained on. Repeated rows count as often as they come. With nothing to train on,
    states stay as first guessed. An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    held = (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, text_or_empty().alias("text"))
    counts = written(word_counts(texts.where("not held_out").select("text")), "lm-counts")
    n_train = texts.where("not held_out").count()
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (total.n or 0) + n_train, (total.v or 0) + (n_train > 0)
    top = counts.orderBy(F.desc("c"), "word").limit(HEAD).collect()
    end = len(top)
    head = spark.sparkContext.broadcast({r.word: i for i, r in enumerate(top)})
    names = F.broadcast(spark.createDataFrame([(r.word,) for r in top], "word string"))
    by_tail = F.crc32(F.right("word", F.lit(SUFFIX)).cast("binary")) % TAIL
    tails = counts.join(names, "word", "left_anti").groupBy(by_tail.alias("t")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    in_class, distinct = np.zeros(TAIL), np.zeros(TAIL)
    for r in tails:
        in_class[r.t], distinct[r.t] = r.n, r.v
    freq = np.concatenate([[r.c for r in top], [n_train], in_class]).astype(float)
    # what a token of each class adds to the sums: the log of a frequent word's count, less the log of a shared class's size
    added = np.concatenate([np.log10(freq[:end] + 1), [np.log10(n_train + 1)], -np.log10(in_class + distinct + 1)])
    log_added = spark.sparkContext.broadcast(added)

    def code(batches: Iterator) -> Iterator:
        import pandas as pd

        class_of, logs = Classes(head.value), log_added.value
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = words_of(text)
                cls = np.empty(len(words) + 1, np.uint16)
                cls[:-1] = np.fromiter(map(class_of.__getitem__, words), np.uint16, len(words))
                cls[-1] = end
                tail, terms = cls > end, logs[cls]
                rest = Counter(compress(words, tail.tolist()))
                common = len(words) - int(tail.sum()) + (n_train > 0)
                out.append((cls.tobytes(), len(cls), float(terms[~tail].sum()), float(terms[tail].sum()), common, list(rest), list(rest.values())))
            new = pd.DataFrame(out, columns=["cls", "n_tokens", "common_sum", "class_sum", "common_known", "rare", "times"])
            yield pd.concat([pdf[["doc_id", "held_out"]].astype({"doc_id": "Int64"}).reset_index(drop=True), new], axis=1)

    schema = "doc_id long, held_out boolean, cls binary, n_tokens long, common_sum double, class_sum double, common_known long, rare array<string>, times array<int>"
    coded = texts.mapInPandas(code, schema).withColumn("rid", F.monotonically_increasing_id())
    coded = written(coded.withColumn("grp", F.pmod(F.hash("rid"), F.lit(GROUPS))), "lm-coded")
    model = spark.sparkContext.broadcast(baum_welch(coded.where("not held_out").select("cls", "grp"), freq))

    def likelihood(batches: Iterator) -> Iterator:
        for pdf in batches:
            ll = np.zeros(len(pdf))
            for some, lengths, tokens in blocks([np.frombuffer(b, np.uint16) for b in pdf["cls"]]):
                ll[some] = model.value.forward(lengths, tokens)
            yield pdf.drop(columns="cls").assign(doc_id=pdf["doc_id"].astype("Int64"), ll=ll / np.log(10))

    cols = ["rid", "doc_id", "held_out", "n_tokens", "common_sum", "class_sum", "common_known"]
    rows = coded.select("cls", *cols).mapInPandas(likelihood, coded.select(*cols).withColumn("ll", F.lit(0.0)).schema)
    rare = coded.select("rid", F.explode(F.arrays_zip(F.col("rare").alias("w"), F.col("times").alias("m"))).alias("x"))
    rare = rare.select("rid", F.col("x.w").alias("word"), F.col("x.m").alias("m")).join(counts, "word")
    rare = rare.groupBy("rid").agg(F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("rare_sum"), F.sum("m").alias("rare_known"))
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    return rows.join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("common_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("common_sum") + rare_sum - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("ll") + F.col("class_sum") + rare_sum).alias("score"),
    )
