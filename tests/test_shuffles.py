"""How often whole rows are shuffled, and what stays the same."""

from pyspark.sql import functions as F

from mailtables.operators.keyed import join_unique, number_per_key
from mailtables.session import shared_dir
from mailtables.sources import buckets as B
from mailtables.sources.tables import VALUES

RUN, LATER = "timestamp_ntz'2025-01-01 00:00:00'", "timestamp_ntz'2025-02-02 00:00:00'"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_small_keys_need_one_window(spark):
    rows = spark.createDataFrame([(k, i, f"v{i}") for k in (1, 2, None) for i in range(3)], "k int, at int, v string")
    start = spark.createDataFrame([(1, 10), (None, 5)], "k int, start int")
    numbered = number_per_key(rows, "k", "at", "n", start)
    got = sorted(((r.k or 0), r.at, r.n) for r in numbered.collect())
    assert got == [(0, i, 6 + i) for i in range(3)] + [(1, i, 11 + i) for i in range(3)] + [(2, i, 1 + i) for i in range(3)]
    # Neither a range partitioning nor a stored copy: the rows go through one exchange by key.
    assert "REPARTITION_BY_NUM" in plan(numbered) and "parquet" not in plan(numbered)


def test_numbers_of_large_and_small_keys_together(spark):
    rows = spark.createDataFrame([(1, i) for i in range(40)] + [(None, i) for i in range(30)] + [(2, 7), (3, 8), (3, 9)], "k int, at int")
    start = spark.createDataFrame([(1, 100), (3, 1)], "k int, start int")
    got = sorted(((r.k or 0), r.at, r.n) for r in number_per_key(rows, "k", "at", "n", start, rows_per_task=10, fan=2).collect())
    assert got == [(0, i, i + 1) for i in range(30)] + [(1, i, 101 + i) for i in range(40)] + [(2, 7, 1), (3, 8, 2), (3, 9, 3)]


def test_left_rows_are_shuffled_once(spark):
    left = spark.createDataFrame([(i % 5, f"l{i}") for i in range(20)], "k int, v string")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(4)], "k int, w string")
    joined = join_unique(left, right, "k")
    assert joined.count() == 20
    assert "BroadcastHashJoin" in plan(joined)


def batch(spark, *rows):
    df = spark.createDataFrame(rows, "req_id long, core string, arrival long")
    kinds = {"translated": "boolean", "requires_human_review": "boolean", "processing_time_ms": "int"}
    return df.select("req_id", *[F.col(c) if c == "core" else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in VALUES], "arrival")


def test_bucket_merge_keeps_first_times_and_rows_without_request(spark):
    path = f"{shared_dir(spark, 'test-buckets')}/table"
    first = batch(spark, (1, "a", 1), (2, "b", 1), (None, "n1", 1))
    assert len(B.upsert_buckets(path, first, F.expr(RUN), buckets=3)) <= 3
    B.upsert_buckets(path, batch(spark, (2, "B", 1), (2, "older", 0), (3, "c", 1), (None, "n2", 1)), F.expr(LATER))
    schema = first.select("req_id", *VALUES, F.expr(RUN).alias("created_at")).schema
    rows = B.read_buckets(spark, path, schema).collect()
    assert sorted((r.req_id or 0, r.core, str(r.created_at)[:7]) for r in rows) == [
        (0, "n1", "2025-01"), (0, "n2", "2025-02"), (1, "a", "2025-01"), (2, "B", "2025-01"), (3, "c", "2025-02")]


def test_a_bucketed_batch_is_shuffled_by_bucket_once(spark):
    rows = batch(spark, (1, "a", 1)).drop("arrival").withColumn("bucket", F.lit(0))
    merged = B.merge_in_buckets(rows.withColumn("created_at", F.expr(RUN)), rows, F.expr(LATER))
    assert plan(merged).count("Exchange hashpartitioning") == 1
