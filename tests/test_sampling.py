"""Subsample draws against hashlib, and that one file's rows are dealt over tasks."""

import hashlib

from pyspark.sql import functions as F

from paravane.functions.draws import Tails
from paravane.operators.sampling import run_draws, stratified_subsample


def _draw(row_id, run, seed=42):
    parts = ["subsample", str((run - 1) // 4), *([] if row_id is None else [str(row_id)]), str(seed)]
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[8 * ((run - 1) % 4) :][:8], 16)


def test_words_are_those_of_hashlib():
    texts = ["", "|7|42", "|-12|42", "é", "x" * 60, "|123456789|42"]
    for head in ("", "subsample|0", "subsample|249"):
        got = Tails(texts).md5_words(head)
        want = [hashlib.md5((head + t).encode()).hexdigest() for t in texts]
        assert ["".join(f"{w[i]:08x}" for w in got) for i in range(len(texts))] == want


def test_draws_of_one_file_are_made_by_several_tasks(spark):
    ids = [None, *range(-3, 1200), 10**15]
    rows = spark.createDataFrame([(i,) for i in ids], "row_id long").coalesce(1).withColumn("most", F.lit(2**31))
    got = run_draws(rows, 6, "most")
    assert got.rdd.getNumPartitions() > 1
    found = sorted(((r.row_id, r.run_id, r.h) for r in got.collect()), key=repr)
    assert found == sorted(((i, k, h) for i in ids for k in range(1, 7) if (h := _draw(i, k)) <= 2**31), key=repr)


def test_subsamples_are_the_rows_of_the_lowest_draws(spark):
    rows = spark.range(900).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = stratified_subsample(rows, [], 30, 5).collect()
    for run in range(1, 6):
        for y, n in ((1, 10), (0, 20)):
            lowest = sorted((_draw(i, run), i) for i in range(900) if (i % 3 == 0) == (y == 1))[:n]
            assert {r.row_id for r in got if r.run_id == run and r.y == y} == {i for _, i in lowest}
