"""A store of model replies by the content of the request: equal requests are asked once, and never again."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.manifest import Manifest
from .inference import infer_batches
from .keyed import join_unique

# Requests of one part; what a run that is killed has to ask again.
PART_ROWS = 100_000
REPLIES = "request string, kind string, reply string, in_tokens long, out_tokens long, latency_ms long, error string"


def request_of(kind="kind", prompt="prompt") -> Column:
    """Equal kinds and prompts have equal requests."""
    return F.sha2(F.concat(F.col(kind), F.lit("\n"), F.col(prompt)), 256)


def all_replies(spark: SparkSession, path: str) -> DataFrame:
    """Every call that was stored: a request that failed may have several."""
    manifest = Manifest(spark, path)
    entries = manifest.read()
    return spark.read.schema(REPLIES).parquet(*manifest.folders(entries)) if entries else spark.createDataFrame([], REPLIES)


def known_replies(spark: SparkSession, path: str) -> DataFrame:
    return all_replies(spark, path).filter("error is null")


def ask(prompts: DataFrame, model: Callable[[list], list], path: str, key: str = "rec_id", part_rows: int = PART_ROWS,
        **options) -> DataFrame:
    """``prompts`` (``key``, ``kind``, ``prompt``) with the replies of ``model``, through the store under ``path``.

    Requests without a stored reply are asked, each once however many rows have it, in parts of about ``part_rows``. A part
    counts when the manifest names it, so a run that is killed repeats at most the part it was in; failed requests are asked
    again by the next run. Rows of a NULL prompt are not asked and get no reply. ``options`` go to ``infer_batches``.
    """
    spark = prompts.sparkSession
    manifest = Manifest(spark, path)
    rows = prompts.select(key, "kind", "prompt").withColumn("request", request_of())
    distinct = rows.filter("request is not null").groupBy("request").agg(F.min("kind").alias("kind"), F.min("prompt").alias("prompt"))
    work = f"{path}/_open-{manifest.version() + 1}"
    distinct.join(known_replies(spark, path).select("request"), "request", "left_anti").write.mode("overwrite").parquet(work)
    waiting = spark.read.parquet(work)
    parts = -(-waiting.count() // part_rows)
    for part in range(parts):
        mine = waiting.filter(F.pmod(F.xxhash64("request"), F.lit(parts)) == part) if parts > 1 else waiting
        folder = f"part-{manifest.version() + 1}"
        replies = infer_batches(mine, model, key="request", **options)
        replies.select(*[f.split()[0] for f in REPLIES.split(", ")]).write.mode("overwrite").parquet(f"{path}/{folder}")
        manifest.commit(manifest.read() + [{"folder": folder}])
    return answered(rows, path)


def answered(rows: DataFrame, path: str) -> DataFrame:
    """Rows with their replies; of a request that only failed, the error."""
    replies = all_replies(rows.sparkSession, path).drop("kind")
    # A reply counts before an error; the store holds at most one reply a request.
    failed = replies.filter("error is not null").groupBy("request").agg(F.max("error").alias("error"))
    good = replies.filter("error is null").drop("error")
    best = good.join(failed, "request", "full_outer").withColumn("error", F.when(F.col("reply").isNull(), F.col("error")))
    return join_unique(rows.drop("prompt"), best, "request").drop("request")


def provider_totals(spark: SparkSession, path: str) -> DataFrame:
    """What the provider has counted: calls and tokens of every request as it was asked, not of every row that uses it."""
    return all_replies(spark, path).groupBy("kind").agg(
        F.count("*").alias("calls"), F.countDistinct("request").alias("requests"),
        F.count("error").alias("failed"), F.coalesce(F.sum("in_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("out_tokens"), F.lit(0)).alias("output_tokens"),
    )
