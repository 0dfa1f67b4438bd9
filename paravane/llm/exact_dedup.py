"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

New rows are deduplicated among themselves by a partial aggregation, then by a sort-merge anti-join against the
index, and what is new is appended. The index is a bucketed and sorted Spark table, so only the new rows' digests
shuffle; the index side of the join does not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, complete, files, folders, fresh_path, mark, remove, skew_join, text_or_empty, written


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row: SHA-256 of the normalised text; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(ascii_lower(text_or_empty()), 256).alias("digest"))


class DigestIndex:
    """Digests that were seen so far, each with the doc_id of the row that stays.

    A digest is in the index once: the batch that brings it first decides which row stays, the one with its
    largest doc_id (null only if the batch has no other id for it). The index lives at its path, below a folder that
    tells the number of buckets; opening the path again, in this session or another, gives the same rows.

    What a batch brings is written to batches/<name> before it is appended, and commits/<name> is made after. Where the
    append broke off, opening the index or adding the batch again appends the rows that are still missing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "digest-index")
        made = [f.rsplit("/buckets-", 1)[1] for f in folders(spark, self.path) if "/buckets-" in f]
        self.buckets = int(made[0]) if made else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self._open, self.done = False, set(files(spark, f"{self.path}/commits"))
        if made:
            self._define()
        for folder in folders(spark, f"{self.path}/batches"):
            batch = folder.rsplit("/", 1)[1]
            if batch not in self.done and complete(spark, folder):
                self._append(batch, again=True)

    def _define(self) -> None:
        spark_path = f"{self.path}/buckets-{self.buckets}"
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{spark_path}'"
        )
        self._open = True

    def rows(self) -> DataFrame | None:
        """The index as (digest, keep_id), or None before the first batch."""
        return self.spark.table(self.name) if self._open else None

    def _batch(self, batch: str) -> DataFrame:
        return self.spark.read.schema("digest string, keep_id long").parquet(f"{self.path}/batches/{batch}")

    def _append(self, batch: str, again: bool = False) -> None:
        """Append a written batch; again: without the rows that an append which broke off has left."""
        if not self._open:
            self._define()
        rows = self._batch(batch)
        if again:
            rows = rows.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        # one task writes each bucket, so a batch adds one sorted file to it
        dealt = rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        dealt.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        mark(self.spark, f"{self.path}/commits/{batch}")
        self.done.add(batch)

    def add(self, batch: DataFrame, name: str | None = None) -> DataFrame:
        """Append to the index what batch(doc_id, digest) brings that is new; returns those (digest, keep_id).

        A batch is added once: one of the same name that was added before changes nothing and returns the same rows.
        """
        name = f"{len(self.done):06d}" if name is None else name
        if name not in self.done:
            known = self.rows()
            fresh = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
            if known is not None:
                fresh = fresh.join(known.select("digest").hint("merge"), "digest", "left_anti")
            fresh.select("digest", "keep_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/batches/{name}")
            self._append(name)
        return self._batch(name)

    def close(self) -> None:
        """Forget the table's name; the index stays at its path."""
        if self._open:
            self.spark.sql(f"DROP TABLE {self.name}")
            self._open = False

    def drop(self) -> None:
        """Delete the index."""
        self.close()
        remove(self.spark, self.path)


def exact_dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the row with
    the largest doc_id stays. The rows go through the index in `batches` ranges of doc_id, highest first, so a
    digest's first batch holds its largest doc_id. Rows that repeat a doc_id and its text are one document and share
    the verdict; group_size counts rows. A null doc_id is lower than any other, and such a row is kept only if its
    text has no other id. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = written(digests(docs), "digests")
    lo, hi = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    step = (hi - lo) // batches + 1
    index = DigestIndex(spark)
    for k in reversed(range(batches)):
        part = F.coalesce(F.floor((F.col("doc_id") - lo) / step), F.lit(0))
        index.add(rows.where(part == k), str(k))
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = written(index.rows().join(sizes, "digest"), "digest-groups")
    index.drop()
    return skew_join(rows, groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )
