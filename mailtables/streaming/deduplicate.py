"""De-duplication of a stream with bounded state that loses no late delivery."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.keyed import one_per_key


def stream_dedup_bounded(deliveries, path: str, checkpoint: str, key: str, event_time: str, delay: str):
    """First deliveries of the files that ``deliveries()`` streams, under ``path/on_time`` and ``path/late``.

    Deliveries within ``delay`` of the newest event time go through the state store, which forgets keys behind the
    watermark; it would also drop rows that come later than that. A second stream over the same files keeps these: each of its
    micro-batches writes, one a key, the rows behind the newest event time that earlier ones had seen, less ``delay``.
    It may keep a row too many, never one too few; ``complete`` sorts that out. Returns the first stream.
    """
    kept = deliveries().withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    query = (
        kept.writeStream.format("parquet").option("path", f"{path}/on_time").option("checkpointLocation", f"{checkpoint}/on_time")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()

    def late(batch, batch_id):
        spark = batch.sparkSession
        seen = f"{path}/seen"
        newest = batch.agg(F.max(event_time).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{seen}/batch_id={batch_id}")
        before = spark.read.schema(f"newest {dict(batch.dtypes)[event_time]}, batch_id long").parquet(seen)
        top = before.filter(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        behind = batch.filter(F.col(event_time) <= F.lit(top) - F.expr(f"interval {delay}")) if top is not None else batch.limit(0)
        one_per_key(behind, key).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")

    second = (
        deliveries().writeStream.foreachBatch(late).option("checkpointLocation", f"{checkpoint}/late")
        .trigger(availableNow=True).start()
    )
    second.awaitTermination()
    return query


def complete(spark: SparkSession, path: str, schema, key: str) -> DataFrame:
    """Every key once: as it came in time, else as it came late."""
    on_time = spark.read.schema(schema).parquet(f"{path}/on_time")
    names = on_time.columns
    late = spark.read.schema(schema).parquet(f"{path}/late/*")
    rows = on_time.withColumn("_late", F.lit(0)).unionByName(late.select(*names).withColumn("_late", F.lit(1)))
    # A key whose deliveries lie far apart may have come in time more than once.
    best = rows.groupBy(key).agg(F.min(F.struct("_late", F.xxhash64(*names).alias("_hash"))).alias("_best"))
    rows = rows.withColumn("_hash", F.xxhash64(*names)).join(best.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")))
    rows = rows.filter((F.col("_late") == F.col("_best._late")) & (F.col("_hash") == F.col("_best._hash")))
    return rows.select(*names).dropDuplicates()
