"""The whole path of a mail, as one lazy plan over tables, and the jobs that store its result."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CleanerConfig
from ..functions.stages import pin
from ..operators.analysis import STAGES, analyse, analysis_json
from ..operators.cleaning import clean_body, clean_emails, describe_mail
from ..operators import errors, replylog
from ..operators.keyed import join_unique, latest_per_key, number_per_key, one_per_key
from ..operators.prompts import action_prompts, analysis_prompts, summary_prompts
from ..operators.reports import run_report
from ..operators.translation import apply_email_translation, translation_prompts
from ..session import shared_dir
from ..sources.emails import isolate_bad_rows, only_type
from ..sources.tables import (
    CLEANED,
    REPROCESS,
    empty_snapshot,
    labelled,
    merge_rows,
    original_email_json,
)

REPLIES = ["analysis_text", "summary_text", "action_text", "translation_text", "latency_ms"]
TOKENS = [f"{prefix}{side}_tokens" for _, prefix, _ in STAGES for side in ("in", "out")]


def clean_and_join(emails: DataFrame, responses: DataFrame, config: CleanerConfig = CleanerConfig(),
                   latest_only: bool = False) -> DataFrame:
    """Cleaned mails with their replies; the only shuffle of the pipeline, on ``rec_id``.

    Mails travel as their clean text, which is much smaller than the HTML; the segments are cut
    from it behind the shuffle. ``latest_only`` keeps the last arrival of each key: the aggregate
    that does so leaves the mails where the join needs them, and no key is hot behind it.
    """
    cleaned = clean_body(emails, "body_html", config).drop("body_html")
    replies = responses.select("rec_id", *REPLIES, *[c for c in TOKENS if c in responses.columns])
    if latest_only:
        newest = latest_per_key(cleaned, "rec_id", "created_ts")
        joined = newest.join(one_per_key(replies, "rec_id"), "rec_id", "left")
    else:
        joined = join_unique(cleaned, replies, "rec_id", keys=emails.select("rec_id"))
    return describe_mail(joined).withColumn("body", F.col("clean_text"))


def process_emails(emails: DataFrame, responses: DataFrame, config: CleanerConfig = CleanerConfig(),
                   latest_only: bool = False) -> DataFrame:
    """One analysed row per mail; mails without a key are left to ``isolate_bad_rows``."""
    good, _ = isolate_bad_rows(emails)
    return analyse(apply_email_translation(clean_and_join(good, responses, config, latest_only)))


def storage_rows(processed: DataFrame, arrival: str = "created_ts", *others: str) -> DataFrame:
    """Columns of the result tables."""
    return processed.select(
        F.col("rec_id").alias("req_id"),
        "pretext", "core", "posttext", "clean_text",
        F.col("was_translated").alias("translated"),
        original_email_json().alias("original_email"),
        "translated_content",
        analysis_json().alias("analysis_result"),
        "summary", "requires_human_review", "review_reason", "processing_time_ms",
        F.col(arrival).alias("arrival"),
        *others,
    )


def ingest_batch(emails: DataFrame, responses: DataFrame, current: DataFrame, run_ts: Column,
                 config: CleanerConfig = CleanerConfig()):
    """Tickets into the next snapshot of the cleaned table: ``(snapshot, report, dead letters)``.

    Only the last arrival of each request can win the upsert, so only it is analysed. The batch is
    written to the shared folder once; snapshot and report both read it from there.
    """
    good, bad = isolate_bad_rows(only_type(emails))
    batch = storage_rows(process_emails(good, responses, config, latest_only=True))
    path = f"{shared_dir(emails.sparkSession, 'ingest')}/batch"
    batch.write.parquet(path)
    batch = emails.sparkSession.read.schema(batch.schema).parquet(path)
    report = run_report(batch.withColumn("table", F.lit(CLEANED)).withColumnRenamed("translated", "was_translated"))
    before = current if current is not None else empty_snapshot(batch, run_ts)
    return merge_rows(before, batch, run_ts), report, bad


def reprocess(emails: DataFrame, req_ids: DataFrame, responses: DataFrame, history: DataFrame, run_ts: Column,
              config: CleanerConfig = CleanerConfig()) -> DataFrame:
    """New history rows for the mails of the requested ids (column ``req_id``).

    The process numbers depend on keys and arrival times only. So they are found on narrow rows, which
    are written to the shared folder once, and joined back to the mails before the expensive steps; mails
    that are equal in every column are told apart by their numbers.
    """
    spark = emails.sparkSession
    wanted = req_ids.select(F.col("req_id").alias("rec_id"))
    chosen = only_type(emails).join(wanted, "rec_id", "left_semi")
    identity = ["rec_id", "created_ts", "_mail"]
    chosen = chosen.withColumn("_mail", F.xxhash64(*[c for c in chosen.columns if c not in identity]))
    work = shared_dir(spark, "reprocess")
    chosen.select(*identity).write.parquet(f"{work}/mails")
    narrow = spark.read.parquet(f"{work}/mails")
    start = history.groupBy(F.col("req_id").alias("rec_id")).agg(F.count("*").alias("start"))
    number_per_key(narrow, "rec_id", "created_ts", "process_number", start).write.parquet(f"{work}/numbers")
    numbers = spark.read.parquet(f"{work}/numbers").select(*[F.col(c).alias(f"_{c}") for c in identity], "process_number")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in identity])
    numbered = one_per_key(chosen, *identity).join(numbers, same).drop(*[f"_{c}" for c in identity], "_mail")
    rows = storage_rows(process_emails(numbered, responses, config), "created_ts", "process_number")
    return labelled(rows, run_ts)


def ingest_given(emails: DataFrame, responses: DataFrame, request_id: int = None,
                 config: CleanerConfig = CleanerConfig()):
    """Caller-supplied mails, any type: rows with their target table, and the dead letters."""
    if emails is None:
        raise ValueError("no mails given")
    good, bad = isolate_bad_rows(emails)
    rows = storage_rows(process_emails(good, responses, config))
    target = REPROCESS if request_id is not None else CLEANED
    return rows.withColumn("table", F.lit(target)), bad


def ingest_checked(landed: DataFrame, responses: DataFrame, longest: int, config: CleanerConfig = CleanerConfig()):
    """Landed mails, all columns text, into storage rows: ``(rows, dead letters, accounting)``.

    ``landed`` has ``rec_id, subject, body_html, type, created`` as text, ``responses`` a ``latency`` as text. A mail that fails a
    check of any stage is left out with the stage and the reason, and its later stages do no work; the others are not
    held up. Marked mails and results are each written once to the shared folder, where all three tables read them.
    """
    spark = landed.sparkSession
    work = shared_dir(spark, "checked")

    def written(df, name):
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    number, time = F.expr("try_cast(trim(rec_id) as bigint)"), F.expr("try_cast(created as timestamp_ntz)")
    rows = errors.check(landed, "scan", {
        "missing rec_id": F.col("rec_id").isNull(), "rec_id is no number": F.col("rec_id").isNotNull() & number.isNull(),
        "created is no time": F.col("created").isNotNull() & time.isNull(),
    })
    rows = errors.check(rows, "clean", {"body is too long": F.length("body_html") > longest})
    rows = rows.withColumns({"key": number, "created_ts": time})
    spent = F.expr("try_cast(latency as int)")
    wrong = responses.select(F.col("rec_id").alias("key"), (F.col("latency").isNotNull() & (spent.isNull() | (spent < 0))).alias("_wrong"))
    rows = join_unique(rows, wrong, "key")
    rows = written(errors.check(rows, "reply", {"latency is no time span": F.col("_wrong")}).drop("_wrong"), "marked")
    mails = errors.good_rows(rows).withColumn("rec_id", F.col("key")).drop("key", "created")
    replies = responses.withColumn("latency_ms", spent.cast("long"))
    made = storage_rows(process_emails(mails, replies, config))
    made = written(errors.check(made, "store", {"nothing to store": F.col("clean_text") == ""}), "made")
    dead = errors.dead_letters(rows, "rec_id").unionByName(
        errors.dead_letters(made.withColumn("rec_id", F.col("req_id").cast("string")), "rec_id"))
    good = errors.good_rows(made)
    return good, dead, errors.accounting(landed, good, dead)


def run_with_model(emails: DataFrame, model: Callable[[list], list], concurrency: int = None,
                   config: CleanerConfig = CleanerConfig(), work_dir: str = None) -> DataFrame:
    """The pipeline with a model function instead of a table of replies.

    Each phase writes its replies under the shared folder before the next one reads them: model
    calls are expensive and not repeatable, so a lost executor must not repeat finished ones. Replies are stored by
    the content of their request (``operators.replylog``): a run that is started again with the same ``work_dir``
    asks only what has no stored reply, and equal prompts are asked once.
    """
    spark = emails.sparkSession
    work_dir = work_dir or shared_dir(spark, "model-run")

    def exists(path):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def stored(df, name):
        if not exists(f"{work_dir}/{name}"):
            df.write.mode("overwrite").parquet(f"{work_dir}/{name}")
        return spark.read.parquet(f"{work_dir}/{name}")

    def ask(prompts):
        """Replies through the store of requests: equal prompts are asked once, finished ones never again."""
        return replylog.ask(prompts, model, f"{work_dir}/requests", concurrency=concurrency)

    def add(df, replies, **columns):
        picked = replies.select("rec_id", *[F.col(v).alias(k) for k, v in columns.items()])
        return join_unique(df, picked, "rec_id")

    good, _ = isolate_bad_rows(emails)
    cleaned = stored(clean_emails(good, "body_html", config).drop("body_html"), "cleaned")
    mails = cleaned.withColumn("body", F.col("clean_text"))
    mails = add(mails, ask(translation_prompts(mails)), translation_text="reply",
                translation_in_tokens="in_tokens", translation_out_tokens="out_tokens")
    mails = stored(apply_email_translation(mails), "translated")
    mails = stored(
        add(mails, ask(analysis_prompts(mails)), analysis_text="reply",
            in_tokens="in_tokens", out_tokens="out_tokens", latency_ms="latency_ms"),
        "analysed",
    )
    mails = stored(
        add(mails, ask(summary_prompts(mails)), summary_text="reply",
            summary_in_tokens="in_tokens", summary_out_tokens="out_tokens"),
        "summarised",
    )
    mails = add(mails, ask(action_prompts(mails)), action_text="reply",
                plan_in_tokens="in_tokens", plan_out_tokens="out_tokens")
    return analyse(mails)
