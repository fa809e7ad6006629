"""Global row numbers and padded batches against plain Python, at every number of buckets."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textprov.operators import batches, numbering


def order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("bucket_rows", [5, 40, 10_000])
def test_numbers_equal_a_sort(spark, bucket_rows):
    ids = random.Random(1).sample(range(10**6), 3000)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "example_id long, _n string").repartition(6)
    got = numbering.number_rows(df, bucket_rows=bucket_rows)
    assert {r.example_id: r.row_no for r in got.collect()} == {i: n for n, i in enumerate(order(ids))}
    assert got.columns == ["example_id", "_n", "_bucket", "row_no"]


def test_more_digits_than_one_level(spark):
    ids = list(range(2000))
    df = spark.createDataFrame([(i,) for i in ids], "example_id long")
    got = numbering.number_rows(df, seed=7, digits=6)
    assert {r.example_id: r.row_no for r in got.collect()} == {i: n for n, i in enumerate(order(ids, 7))}


def test_digits_follow_the_rows():
    assert [numbering.bucket_digits(n) for n in (0, 50_000, 50_001, 800_000, 800_001, 10**9, 10**12)] == [0, 0, 1, 1, 2, 4, 7]


def test_null_ids_come_last_and_empty_table(spark):
    df = spark.createDataFrame([(1,), (None,), (2,), (None,)], "example_id long")
    got = sorted((r.row_no, r.example_id) for r in numbering.number_rows(df, bucket_rows=1).collect())
    assert [i for _, i in got][:2] == order([1, 2]) and [n for n, _ in got] == [0, 1, 2, 3]
    assert got[2][1] is None and got[3][1] is None
    assert numbering.number_rows(df.limit(0)).collect() == []


@pytest.mark.parametrize("bucket_rows,size,cap", [(3, 8, None), (50, 8, None), (50, 7, 5), (10_000, 16, None)])
def test_padded_batches_equal_two_steps(spark, bucket_rows, size, cap):
    rnd = random.Random(2)
    rows = [(i, [1] * n, n) for i, n in enumerate(rnd.randint(0, 40) for _ in range(700))]
    df = spark.createDataFrame(rows, "example_id long, input_ids array<int>, token_length int")
    got = {r.example_id: r for r in batches.padded_batches(df, size, cap=cap, bucket_rows=bucket_rows).collect()}
    number = {i: n for n, i in enumerate(order(range(700)))}
    longest = {}
    for i, _, n in rows:
        longest[number[i] // size] = max(longest.get(number[i] // size, 0), n)
    assert len(got) == 700
    for i, _, n in rows:
        r, seq = got[i], min(longest[number[i] // size], cap or 10**9)
        assert (r.batch_id, r.ordinal, r.seq_len) == (number[i] // size, number[i] % size + 1, seq)
        k = min(n, seq)
        assert r.padded_ids == [1] * k + [0] * (seq - k) and r.padded_mask == r.padded_ids


def test_arrays_are_shuffled_once(spark):
    df = spark.range(1000).select(F.col("id").alias("example_id"), F.sequence(F.lit(1), F.pmod("id", F.lit(9)) + 1).alias("input_ids"))
    df = df.withColumn("token_length", F.size("input_ids"))
    padded = batches.padded_batches(df, 8, bucket_rows=100)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = padded._jdf.queryExecution().explainString(mode)
    exchanges = [x.split("\n")[1] for x in plan.split("\n\n") if ") Exchange\n" in x + "\n"]
    assert len(exchanges) > 1
    assert sum("input_ids" in x for x in exchanges) == 1
