"""Line dedup: levelled sorted runs of line hashes, compacted now and then; DataFrame functions only.

Each batch of documents is merge-anti-joined with the runs: the keys that no run has make the batch's own sorted run of
(line hash, documents that hold it), the others a run of additions. Runs lie on levels; when a level is full its runs
are merged into one of the next level, so that a look-up reads few runs. The number of documents that hold a line is the
sum over all runs. A batch counts when its commit file is there, which is written last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, complete, digest128, discard, files, folders, fresh_path, mark, remove, skew_join, text_or_empty, written


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """Sorted runs of (key, n_docs) below a path, by level; opening the path again finds them.

    A run is a folder level-<level>-<number>-<kind>; kind is `own` for keys that were new when it was written, `more` for
    additions to keys of older runs. A batch's runs count together, once commits/<number>-<name> is there: what a batch
    that broke off has left counts for nothing, and is written over when the batch comes again. A compaction writes the
    merged run first, under the number of its last part and the next level, and a level's runs that it covers are then
    void.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        self.spark, self.path, self.fanout = spark, path or fresh_path(spark, "line-runs"), fanout
        self.batches = dict(f.split("-", 1)[::-1] for f in files(spark, f"{self.path}/commits"))  # number by name
        committed, self.runs = {int(n) for n in self.batches.values()}, []  # level, number, kind
        for folder in folders(spark, self.path):
            if "/level-" in folder and complete(spark, folder):
                _, level, number, kind = folder.rsplit("/", 1)[1].split("-")
                if int(level) or int(number) in committed:
                    self.runs.append((int(level), int(number), kind))
        upper = {r: max((n for level, n, _ in self.runs if level > r[0]), default=-1) for r in self.runs}
        self.runs = [r for r in self.runs if r[1] > upper[r]]

    def _at(self, run: tuple[int, int, str]) -> str:
        return f"{self.path}/level-{run[0]}-{run[1]:06d}-{run[2]}"

    def _read(self, *runs: tuple[int, int, str]) -> DataFrame:
        return self.spark.read.schema("key binary, n_docs long").parquet(*map(self._at, runs))

    def _write(self, rows: DataFrame, run: tuple[int, int, str]) -> tuple[int, int, str]:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartition(parts, "key").sortWithinPartitions("key").write.mode("overwrite").parquet(self._at(run))
        return run

    @property
    def levels(self) -> list[list[int]]:
        """The numbers of the batches whose runs lie on each level; a batch's additions belong to its run."""
        top = max((r[0] for r in self.runs), default=0)
        return [sorted({r[1] for r in self.runs if r[0] == level}) for level in range(top + 1)]

    def add(self, counts: DataFrame, name: str | None = None) -> None:
        """Add a batch's (key, n_docs), then compact the levels that hold `fanout` batches.

        A batch is added once: one of the same name that was added before changes nothing, so a job that broke off can
        add all its batches again.
        """
        if name not in self.batches:
            counts = written(counts.select("key", F.col("n_docs").cast("long").alias("n_docs")), "line-counts")
            number = max(map(int, self.batches.values()), default=-1) + 1
            new = [self._write(self.unseen(counts), (0, number, "own"))]
            if self.runs:  # the batch's keys that aren't its own
                new.append(self._write(counts.join(self._read(new[0]).select("key").hint("merge"), "key", "left_anti"), (0, number, "more")))
            name = str(number) if name is None else name
            mark(self.spark, f"{self.path}/commits/{number}-{name}")
            self.batches[name] = str(number)
            self.runs += new
            discard(counts)
        level = 0
        while len(full := [r for r in self.runs if r[0] == level]) and len({r[1] for r in full}) >= self.fanout:
            merged = self._write(self._merged(full), (level + 1, max(r[1] for r in full), "own"))
            self.runs = [r for r in self.runs if r[0] != level] + [merged]
            for run in full:
                remove(self.spark, self._at(run))
            level += 1

    def _merged(self, runs: list[tuple[int, int, str]]) -> DataFrame:
        return self._read(*runs).groupBy("key").agg(F.sum("n_docs").alias("n_docs"))

    def counts(self) -> DataFrame:
        """(key, n_docs) over all runs."""
        return self._merged(self.runs) if self.runs else self.spark.createDataFrame([], "key binary, n_docs long")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys(key, ..) whose key no run has, by a sort-merge anti-join with each run."""
        for run in self.runs:
            if run[2] == "own":
                keys = keys.join(self._read(run).hint("merge"), "key", "left_anti")
        return keys

    def drop(self) -> None:
        """Delete all runs."""
        remove(self.spark, self.path)
        self.runs = []


def _row_key() -> Column:
    """16 bytes for a row's doc_id and text: rows that repeat both are one document."""
    return digest128(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_or_empty()))


def _lines() -> Column:
    return F.split(text_or_empty(), "\n", -1)


def frequent_line_positions(docs: DataFrame, min_docs: int = 10, min_key: int = 1, batches: int = 2) -> DataFrame:
    """(__row, __drops): the positions of the lines to lose, for each document that has any."""
    row = _row_key()
    # rows without doc_id are documents by their text
    alone = F.when(F.col("doc_id").isNull(), row)
    lines = docs.select(row.alias("row"), F.col("doc_id").alias("doc"), alone.alias("alone"), F.transform(_lines(), line_key).alias("keys"))
    lines = lines.select("row", "doc", "alone", F.posexplode("keys").alias("pos", "line")).where(F.char_length("line") >= min_key)
    lines = written(lines.select("row", "doc", "alone", "pos", digest128(F.col("line")).alias("key")), "line-keys")
    runs = LineRuns(docs.sparkSession, fanout=max(2, batches))
    for k in range(batches):
        batch = lines.where(F.pmod(F.hash("doc", "alone"), F.lit(batches)) == k)
        runs.add(batch.select("doc", "alone", "key").distinct().groupBy("key").agg(F.count("*").alias("n_docs")))
    frequent = written(runs.counts().where(F.col("n_docs") >= min_docs).select("key"), "frequent-lines")
    runs.drop()
    hits = skew_join(lines.select("row", "pos", "key"), frequent, "key")
    return hits.groupBy(F.col("row").alias("__row")).agg(F.collect_set("pos").alias("__drops"))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_key: int = 1, batches: int = 2) -> DataFrame:
    """docs without the lines that at least min_docs documents hold, plus n_lines (before) and n_dropped.

    Texts split at \\n; a null or empty text is one empty line. A line's key is the line without [ \\t-\\r] at its
    ends and A-Z lower-cased. Keys of at least min_key code points that at least min_docs documents hold lose all
    their lines everywhere; other lines stay, joined by \\n. Rows that share a doc_id are one document, rows without one
    are documents by their text; all rows stay in the result. Null texts stay null; a text that loses all its lines is empty. All columns of
    docs stay, except that n_lines and n_dropped are replaced. An empty table gives no rows. Documents go to the
    runs in `batches` parts, which changes nothing in the result.
    """
    cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    drops = frequent_line_positions(docs, min_docs, min_key, batches)
    both = docs.select(*cols, _row_key().alias("__row")).join(drops.hint("merge"), "__row", "left")
    both = both.withColumn("__lines", _lines())
    stay = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drops")), lambda p: F.get(F.col("__lines"), p)
    )
    text = F.when(F.col("__drops").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    return both.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in cols],
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_dedup(docs: DataFrame, min_docs: int = 10, min_key: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_sha256 (of the text that stays; null as empty)."""
    out = drop_frequent_lines(docs.select("doc_id", "text"), min_docs, min_key)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(text_or_empty().cast("binary"), 256).alias("kept_sha256"))
