"""From band keys to verified links to components, without all pairs of a bucket.

Candidates share a band key. In each star round every bucket that still holds several components picks one member,
and the members of other components are compared with it; that soon joins large groups of near copies. The last
round compares all pairs of a bucket that are still in different components, so no link between candidates is lost;
buckets of more than SMALL members do so in pairs of blocks, inside tasks of bounded size that give out links only.
Every comparison first looks at the odd sketches and is then confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, skew_join, written
from .components import components

#: A further star round must find links for this share of its pairs.
WORTH = 0.05


#: Larger buckets are compared in blocks of about so many members.
SMALL, BLOCK = 48, 512


def unlike(a: str, b: str, words: int) -> Column:
    """Unequal bits of two odd sketches: the population count of their XOR."""
    x, y = F.col(a), F.col(b)
    total = F.bit_count(x[0].bitwiseXOR(y[0]))
    for i in range(1, words):
        total = total + F.bit_count(x[i].bitwiseXOR(y[i]))
    return total


def _alike(x, y, percent: int) -> bool:
    """100 * intersection >= percent * union, for two sorted arrays of distinct values."""
    import numpy as np

    if not len(x) or not len(y) or min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    z = np.concatenate([x, y])
    z.sort(kind="stable")  # two sorted runs are merged
    both = int(np.count_nonzero(z[1:] == z[:-1]))
    return 100 * both >= percent * (len(z) - both)


def verified(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose contents(node, grams) have 100 * intersection >= percent * union."""

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sides = []
            for name in ("ga", "gb"):
                column = batch.column(name)
                sides.append((np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])))
            (xa, oa), (xb, ob) = sides
            keep = [_alike(xa[oa[r] : oa[r + 1]], xb[ob[r] : ob[r + 1]], percent) for r in range(len(batch))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: contents.select(F.col("node").alias(side), F.col("grams").alias(f"g{side}"))
    both = pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b")
    return both.select("a", "b", "ga", "gb").mapInArrow(compare, pairs.select("a", "b").schema)


def block_links(rows: DataFrame, contents: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Links (a, b) between members of large buckets with different labels: rows(h, size, a, la, an, asketch).

    A bucket is cut into blocks by a hash, and each pair of blocks is one group of about 2 * BLOCK rows. A pair is only
    looked at in the bucket of its first common band.
    """
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = rows.withColumn("i", F.pmod(F.hash("a"), count)).withColumn("j", F.explode(F.sequence(F.lit(0), count - 1)))
    cut = cut.select("*", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    cut = cut.join(contents.select(F.col("node").alias("a"), "grams", "bands").hint("merge"), "a")

    def compare(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.reset_index(drop=True)
        left = np.flatnonzero(pdf["i"] == pdf["lo"])
        right = np.flatnonzero(pdf["i"] == pdf["hi"])
        label, _ = pd.factorize(pdf["la"].map(str))
        ok = label[left][:, None] != label[right][None, :]
        if len(left) == len(right) and (left == right).all():
            ok &= left[:, None] < right[None, :]
        if most is not None:
            n, sketch = pdf["an"].to_numpy(), np.stack(pdf["asketch"].to_numpy()).view(np.uint64)
            ok &= np.minimum(n[left][:, None], n[right]) * 100 >= np.maximum(n[left][:, None], n[right]) * percent
            for r, x in enumerate(left):
                at = np.flatnonzero(ok[r])
                ok[r, at] = np.bitwise_count(sketch[x] ^ sketch[right[at]]).sum(axis=1) <= most
        here, bands = pdf["h"].iloc[0], np.stack(pdf["bands"].to_numpy())
        grams, node, found = pdf["grams"].tolist(), pdf["a"].tolist(), []
        for r, x in enumerate(left.tolist()):
            at = np.flatnonzero(ok[r])
            if len(at):
                common = bands[x] == bands[right[at]]
                at = at[bands[x][np.argmax(common, axis=1)] == here]
            for y in right[at].tolist():
                if _alike(grams[x], grams[y], percent):
                    found.append(sorted((node[x], node[y])))
        return pd.DataFrame(found, columns=["a", "b"])

    schema = rows.select("a", F.col("a").alias("b")).schema
    return cut.groupBy("h", "lo", "hi").applyInPandas(compare, schema).distinct()


def candidates(bands: DataFrame, tag: str) -> DataFrame:
    """The rows of bands(h, node) whose key h several nodes share, as a written table; no row comes twice."""
    shared = written(bands.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), f"{tag}-shared")
    cands = written(skew_join(bands, shared, "h"), f"{tag}-candidates")
    discard(shared)
    return cands


def near_components(cands: DataFrame, contents: DataFrame, percent: int, most: int | None = None, rounds: int = 3, tag: str = "near", linked: DataFrame | None = None) -> DataFrame:
    """(node, root) of all nodes that have a link: cands(h, node, n, sketch), contents(node, grams, bands).

    grams are a node's shingles, sorted and distinct. root is the least node of the component. With `most`, pairs
    whose set sizes n rule a link out, or that have more than so many unequal sketch bits, are not compared; without
    it all candidates are, and n and sketch aren't read. linked(a, b) are links that hold anyway.
    """
    labels, tried, got = None, 1, 1
    if linked is not None and not linked.isEmpty():
        labels = written(components(linked, f"{tag}-components"), f"{tag}-labels")
    extra, near = [], F.lit(True)
    if most is not None:
        extra, words = ["n", "sketch"], len(cands.first().sketch) if not cands.isEmpty() else 1
        near = (F.least("n", "bn") * 100 >= F.greatest("n", "bn") * percent) & (unlike("sketch", "bsketch", words) <= most)
    mine, given = cands, []  # tables of this round, which the next replaces
    for turn in range(rounds + 1):
        rows = mine.withColumn("label", F.col("node"))
        if labels is not None:
            rows = skew_join(mine, labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
            rows = written(rows, f"{tag}-rows")
            given.append(rows)
        center = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), F.col("node").alias("b"), F.col("label").alias("lb"), *[F.col(c).alias(f"b{c}") for c in extra]))
        open_ = rows.groupBy("h").agg(center.alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        open_ = written(open_.select("h", "size", "c.b", "c.lb", *[f"c.b{c}" for c in extra]), f"{tag}-open")
        if open_.isEmpty():
            break
        # only buckets that hold several components go on
        tries = (F.col("label") != F.col("lb")) & near
        live = written(skew_join(rows, open_, "h").select("h", "node", "label", *extra, "size", "b", tries.alias("tries")), f"{tag}-live")
        discard(*given, open_)
        mine, given = live.select("h", "node", *extra), [live]
        last = turn == rounds or got < WORTH * tried
        if last:
            left = live.select("h", F.col("node").alias("a"), F.col("label").alias("la"), "size", *[F.col(c).alias(f"a{c}") for c in extra])
            large, left = left.where(F.col("size") > SMALL), left.where(F.col("size") <= SMALL)
            other = left.select(F.col("h").alias("h2"), F.col("a").alias("b"), F.col("la").alias("lb"), *[F.col(f"a{c}").alias(f"b{c}") for c in extra])
            alike = F.lit(True)
            if most is not None:
                alike = (F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent) & (unlike("asketch", "bsketch", words) <= most)
            pairs = left.join(other.hint("merge"), (F.col("h") == F.col("h2")) & (F.col("la") < F.col("lb")) & alike)
        else:
            pairs = live.where("tries").select(F.col("node").alias("a"), "b")
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-pairs")
        found = verified(pairs, contents, percent)
        if last:
            found = found.unionByName(block_links(large, contents, percent, most))
        found = written(found, f"{tag}-links")
        tried, got = pairs.count(), found.count()
        discard(pairs)
        if got:
            # links of earlier rounds go on as one link of each node to its root
            so_far = found if labels is None else found.unionByName(labels.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
            labels = written(components(so_far, f"{tag}-components"), f"{tag}-labels")
        discard(found)
        if last:
            break
    if labels is None:
        return cands.select("node", F.col("node").alias("root")).where(F.lit(False))
    return labels
