"""Sources and sinks: labelled tables, their editions, scored rows, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paravane.functions.draws import hash32, key
from paravane.functions.scalars import nulled

NUMERIC, CATEGORICAL = ["x1", "x2", "x3"], ["k1", "k2"]
WORLDS = ["clean", "noise", "shift", "label_noise"]
FOLDS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A labelled table from CSV with a given schema: files are split by Spark, nothing is inferred."""
    return spark.read.schema(schema).csv(path, header=True)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Write a table, split by the values of `by` (parquet) or with a header (csv)."""
    writer = df.write.mode("overwrite").partitionBy(*(by or [])) if by else df.write.mode("overwrite")
    writer.option("header", True).format(fmt).save(path)


def ingest(df: DataFrame) -> DataFrame:
    """NaN and infinities of float columns as null, so that plain aggregates skip them."""
    wrong = {f.name: nulled(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(wrong) if wrong else df


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows that have a target, with it as the integer y."""
    return df.dropna(subset=[target]).withColumn("y", F.col(target).cast("int"))


def without(df: DataFrame, columns: list[str]) -> DataFrame:
    """df without id and leakage columns; absent ones are passed over."""
    return df.drop(*columns)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their customer: row_id, y, three numeric and two categorical columns."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_totalprice").cast("double").alias("x1"),
        F.col("c_acctbal").cast("double").alias("x2"), F.col("c_nationkey").cast("double").alias("x3"), F.col("o_orderpriority").alias("k1"), F.col("c_mktsegment").alias("k2"),
    )


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled rows as edition full, and every twentieth again as edition demo."""
    one = labelled(spark, sf_dir)
    both = F.when(F.col("row_id") % 20 == 0, F.array(F.lit("full"), F.lit("demo"))).otherwise(F.array(F.lit("full")))
    return one.withColumn("edition", F.explode(both))


def fold_of(row_id: Column, k: int = FOLDS) -> Column:
    """A row's fold, null for a row without an id."""
    return F.when(row_id.isNotNull(), (hash32(key("fold", row_id)) % k + 1).cast("int"))


def profile(df: DataFrame, y: str) -> DataFrame:
    """One row per column: role, nulls, distinct values; with the table's rows and prevalence. One pass."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    cols = [c for c in df.columns if c != y]
    parts = [F.struct(F.lit(c).alias("column"), F.lit("numeric" if c in numeric else "categorical").alias("role"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(c).alias("n_distinct")) for c in cols]
    one = df.agg(F.count("*").alias("n_rows"), F.avg(y).alias("prevalence"), F.array(*parts).alias("c"))
    return one.select("n_rows", "prevalence", F.explode("c").alias("c")).select("n_rows", "prevalence", "c.*")


def binary_columns(df: DataFrame, known: list[str]) -> DataFrame:
    """(column, n_distinct, order) of columns that may be a target: at most two values; best first.

    Known names come first, in their order, then columns that aren't strings, in the table's order.
    """
    order = [c for c in known if c in df.columns] + [f.name for f in df.schema if f.name not in known and not isinstance(f.dataType, T.StringType)]
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("n_distinct"), F.lit(i).alias("order")) for i, c in enumerate(order)])
    return df.agg(parts.alias("c")).select(F.explode("c").alias("c")).select("c.*").where((F.col("n_distinct") <= 2) & (F.col("n_distinct") > 0))


def coerce_binary(df: DataFrame, target: str) -> DataFrame:
    """df with the target's smaller value as y = 0 and its larger as y = 1; an error unless it has two values."""
    ends = df.agg(F.min(target).alias("__lo"), F.max(target).alias("__hi"), F.count_distinct(target).alias("__n"))
    bad = F.raise_error(F.lit(f"{target} must have exactly two values"))
    y = F.when(F.col("__n") != 2, bad.cast("int")).when(F.col(target) == F.col("__hi"), 1).when(F.col(target) == F.col("__lo"), 0)
    return df.join(F.broadcast(ends)).withColumn("y", y).drop("__lo", "__hi", "__n")


def dealt(df: DataFrame, key: str = "row_id") -> DataFrame:
    """df's rows dealt over all tasks by a key: a small file is read by one task, whatever is then done with each row."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


_scratch: dict[str, str] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and runs on this machine alone, as in tests, a temporary one is made.
    """
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _scratch.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="paravane-")
        _scratch[app] = root
    return f"{root.rstrip('/')}/paravane/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, for what is read several times and costly to make again.

    The table is deleted when the application ends.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    write_table(df, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def unkept(df: DataFrame) -> None:
    """Delete a table that kept() made and that nothing will read again."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
