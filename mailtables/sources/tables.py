"""The two result tables: latest state per request and append-only reprocessing history."""

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.keyed import latest_per_key, number_per_key
from ..operators.paging import ordered_page

CLEANED, REPROCESS = "emails_cleaned", "emails_reprocess"
VALUES = [
    "pretext", "core", "posttext", "clean_text", "translated", "original_email",
    "translated_content", "analysis_result", "summary", "requires_human_review",
    "review_reason", "processing_time_ms",
]


def original_email_json(subject="original_subject", body="original_body", keep_null=False) -> Column:
    """``{subject, body}``; a NULL subject is left out, or written as null on request."""
    options = {"ignoreNullFields": "false"} if keep_null else {}
    return F.to_json(F.struct(F.col(subject).alias("subject"), F.col(body).alias("body")), options)


def table_defaults(df: DataFrame) -> DataFrame:
    """Empty texts become NULL, missing flags false, missing times 0."""
    return (
        df.withColumn("summary", F.nullif(F.col("summary"), F.lit("")))
        .withColumn("review_reason", F.nullif(F.col("review_reason"), F.lit("")))
        .withColumn("requires_human_review", F.coalesce("requires_human_review", F.lit(False)))
        .withColumn("translated", F.coalesce("translated", F.lit(False)))
        .withColumn("processing_time_ms", F.coalesce("processing_time_ms", F.lit(0)).cast("int"))
    )


def target_table(request_id) -> Column:
    """Name of the table a mail is stored in: reprocessing when a request id was given."""
    return F.when(request_id.isNotNull(), REPROCESS).otherwise(CLEANED)


def route_target(df: DataFrame, request_id: str = "request_id") -> tuple[DataFrame, DataFrame]:
    target = target_table(F.col(request_id))
    return df.filter(target == CLEANED), df.filter(target == REPROCESS)


def merge_rows(current: DataFrame, batch: DataFrame, run_ts: Column) -> DataFrame:
    """The next snapshot from a batch with one row per request; ``created_at`` stays the first.

    Both sides have one row per key, so no key is hot; a ``current`` that is bucketed by
    ``req_id`` is not shuffled. Write the result to a new path, never over the one being read.
    """
    new = table_defaults(batch).select("req_id", F.struct(*VALUES).alias("new"))
    old = current.select("req_id", F.struct(*VALUES).alias("old"), F.col("created_at").alias("old_at"))
    row = F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col("old"))
    return (
        old.join(new, "req_id", "full_outer")
        .withColumn("row", row)
        .select("req_id", "row.*", F.coalesce("old_at", run_ts).alias("created_at"))
    )


def upsert_cleaned(current: DataFrame, batch: DataFrame, run_ts: Column, arrival: str = "arrival") -> DataFrame:
    """The next snapshot from any batch: the last arrival of each request wins."""
    return merge_rows(current, latest_per_key(batch, "req_id", arrival), run_ts)


def empty_snapshot(batch: DataFrame, run_ts: Column) -> DataFrame:
    return batch.select("req_id", *VALUES, run_ts.alias("created_at")).limit(0)


def labelled(numbered: DataFrame, run_ts: Column) -> DataFrame:
    """History rows of a batch that has its ``process_number``."""
    label = F.concat(F.lit("process"), F.col("process_number").cast("string"))
    return table_defaults(numbered).select(
        "req_id", "process_number", label.alias("process_label"), *VALUES, run_ts.alias("created_at")
    )


def append_reprocess(history: DataFrame, batch: DataFrame, run_ts: Column, arrival: str = "arrival") -> DataFrame:
    """Rows to append, labelled ``process1``, ``process2``, ... after the ones already there."""
    start = history.groupBy("req_id").agg(F.count("*").alias("start"))
    return labelled(number_per_key(batch, "req_id", arrival, "process_number", start), run_ts)


def write_snapshot(snapshot: DataFrame, path: str, clustered: bool = False) -> None:
    """Write a snapshot to a path of its own.

    ``clustered`` sorts it by time into files with narrow ranges, which lets ``list_cleaned``
    read few of them; the request breaks ties, as a whole run has one time.
    """
    if clustered:
        snapshot = snapshot.repartitionByRange("created_at", "req_id").sortWithinPartitions("created_at", "req_id")
    snapshot.write.mode("errorifexists").parquet(path)


def write_history(rows: DataFrame, path: str, run: str) -> None:
    """Append the rows of one run; a repeated run replaces its own folder."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def list_cleaned(df: DataFrame, limit: int = 5, offset: int = 0) -> DataFrame:
    """Newest rows first; ties by request."""
    return ordered_page(df, [("created_at", False), ("req_id", True)], offset or 0, limit or 5)


def history_by_req(df: DataFrame, req_id) -> DataFrame:
    """History of one request in order of processing; JSON columns as VARIANT."""
    parsed = [F.try_parse_json(c).alias(c) for c in ["original_email", "translated_content", "analysis_result"]]
    return (
        df.filter(F.col("req_id") == req_id)
        .select("process_number", "req_id", "process_label", "pretext", "core", "posttext", "clean_text", *parsed, "created_at")
        .orderBy("process_number")
    )


def review_queue(df: DataFrame) -> DataFrame:
    """Rows that wait for a person, newest first."""
    return df.filter("requires_human_review").orderBy(F.col("created_at").desc(), F.col("req_id").asc())
