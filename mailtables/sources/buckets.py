"""The snapshot of the cleaned table in hash buckets: an upsert rewrites the buckets that it touches."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.keyed import latest_per_key
from .manifest import Manifest
from .tables import VALUES, table_defaults

BUCKETS = 256


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("req_id"), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, path: str, schema, wanted: set = None) -> DataFrame:
    """The snapshot, or those of its buckets that are ``wanted``; ``schema`` says what an empty table has."""
    manifest = Manifest(spark, path)
    entries = [e for e in manifest.read() if wanted is None or e["bucket"] in wanted]
    if not entries:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*manifest.folders(entries))


def upsert_buckets(path: str, batch: DataFrame, run_ts: Column, arrival: str = "arrival", buckets: int = BUCKETS) -> list:
    """Merge ``batch`` into the snapshot under ``path``; returns the numbers of the rewritten buckets.

    The batch is reduced to one row a request and written once. Which of the ``buckets`` it touches is read from its narrow
    column; only those are read, merged and written as a new run, and the next manifest names, for each bucket, the run that
    holds it. Whole rows are shuffled twice: by request to reduce the batch, by bucket to merge it. A job that fails before the
    switch changes nothing. The number of buckets stays as the first upsert has set it.
    """
    spark = batch.sparkSession
    manifest = Manifest(spark, path)
    old = manifest.read()
    buckets = old[0]["of"] if old else buckets
    run = f"run-{manifest.version() + 1}-{uuid.uuid4().hex[:8]}"
    arrived = f"{path.rstrip('/')}/_arrived-{run}"
    newest = latest_per_key(batch, "req_id", arrival).withColumn("bucket", bucket_of(buckets))
    newest.write.parquet(arrived)
    newest = spark.read.schema(newest.schema).parquet(arrived)
    touched = sorted(r.bucket for r in newest.select("bucket").distinct().collect())
    if not touched:
        return []
    empty = newest.select("req_id", *VALUES, run_ts.alias("created_at")).schema
    current = read_buckets(spark, path, empty, set(touched)).withColumn("bucket", bucket_of(buckets))
    merge_in_buckets(current, newest, run_ts).write.partitionBy("bucket").parquet(f"{path}/{run}")
    kept = [e for e in old if e["bucket"] not in set(touched)]
    manifest.commit(kept + [{"bucket": b, "of": buckets, "folder": f"{run}/bucket={b}"} for b in touched])
    return touched


def merge_in_buckets(current: DataFrame, newest: DataFrame, run_ts: Column) -> DataFrame:
    """``merge_rows`` of two tables with a ``bucket``: rows are dealt by bucket and stay there for the merge and the writing.

    As in a join, rows without a request meet no other row.
    """
    rows = current.select("bucket", "req_id", *VALUES, "created_at", F.lit(0).alias("_new")).unionByName(
        table_defaults(newest).select("bucket", "req_id", *VALUES, run_ts.alias("created_at"), F.lit(1).alias("_new")))
    rows = rows.withColumn("_alone", F.when(F.col("req_id").isNull(), F.monotonically_increasing_id()))
    merged = rows.repartition("bucket").groupBy("bucket", "req_id", "_alone").agg(
        F.max_by(F.struct(*VALUES), "_new").alias("_row"), F.min_by("created_at", "_new").alias("created_at"))
    return merged.select("req_id", "_row.*", "created_at", "bucket")
