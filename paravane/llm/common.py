"""What the operators of this subpackage share: the shared folder, text keys, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that the text contracts strip and split on: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and runs on this machine alone, as in tests, one is made here.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="paravane-")
    return _local[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/paravane/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors.

    The table is deleted when the application ends, if discard() hasn't done so before.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    at, store = _store(df.sparkSession, path)
    store.deleteOnExit(at)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _store(spark: SparkSession, path: str):
    """The path as Hadoop knows it, and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies."""
    at, store = _store(spark, path)
    store.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders under a path, none if it doesn't exist."""
    at, store = _store(spark, path)
    return sorted(f.getPath().toString() for f in store.listStatus(at) if f.isDirectory()) if store.exists(at) else []


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the path to its end."""
    at, store = _store(spark, f"{path}/_SUCCESS")
    return store.exists(at)


def mark(spark: SparkSession, path: str) -> None:
    """Make an empty file, which is there whole or not at all."""
    at, store = _store(spark, path)
    store.create(at, True).close()


def files(spark: SparkSession, path: str) -> list[str]:
    """The names of the files in a folder, without hidden ones; none if it doesn't exist."""
    at, store = _store(spark, path)
    names = [f.getPath().getName() for f in store.listStatus(at) if f.isFile()] if store.exists(at) else []
    return sorted(n for n in names if n[0] not in "._")


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing will read again, so that the shared folder stays small.

    Whatever was computed from them must be written by then.
    """
    for df in tables:
        remove(df.sparkSession, df.written_at)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of one byte a character take the quick way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_or_empty(c: str | Column = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def crc_mod(c: Column, m: int) -> Column:
    """crc32 of the column as text, modulo m; null counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def skew_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """left joined with right, whose key is unique, when some keys hold a large share of left's rows.

    A sort-merge join of two tables that are both shuffled for it: there AQE splits the partitions of hot keys and
    sends the one matching row of right to each part. left and right must not be grouped or windowed by the key
    just before, or they keep that partitioning. Null keys match nothing; with how="left" their rows stay.
    """
    return left.join(right.hint("merge"), key, how)


def digest128(c: Column) -> Column:
    """16 bytes that stand for a text in joins and groups."""
    return F.unhex(F.md5(c.cast("binary")))
