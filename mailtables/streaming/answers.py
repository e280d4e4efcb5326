"""Mails meet their replies while both arrive."""

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.analysis import analyse
from ..operators.cleaning import clean_body, describe_mail
from ..operators.keyed import join_unique, number_per_key, one_per_key
from ..operators.translation import apply_email_translation
from ..plans.pipeline import REPLIES, TOKENS, storage_rows
from ..sources.tables import labelled

MAIL = ["rec_id", "subject", "type", "created_ts", "clean_text"]


def stream_answers(mails: DataFrame, replies: DataFrame, limit: str, delay: str) -> DataFrame:
    """Each mail with the reply that comes within ``limit`` of it, or without one when the time is over.

    A stream-stream left outer join: both sides wait in the state store, mails as clean text, until the watermark (the newest
    event time less ``delay``) has passed the last time at which their partner could come, so the state holds about ``limit +
    delay`` of both streams. Event times are ``created_ts`` and ``replied_ts``. Replies that come later are
    not lost: ``late_rows`` finds them in the table of replies. Filter the stored table, not the stream: a filter on
    the result moves in front of the watermark, and rows that it drops no longer move the time on.
    """
    cleaned = clean_body(mails.withWatermark("created_ts", delay), "body_html").drop("body_html")
    found = replies.withWatermark("replied_ts", delay).withColumnRenamed("rec_id", "reply_to")
    in_time = (F.col("replied_ts") >= F.col("created_ts")) & (F.col("replied_ts") <= F.col("created_ts") + F.expr(f"interval {limit}"))
    return cleaned.join(found, (F.col("rec_id") == F.col("reply_to")) & in_time, "left_outer")


def stored_rows(joined: DataFrame, *others: str) -> DataFrame:
    """Storage rows of mails that are joined with their replies."""
    mails = describe_mail(joined).withColumn("body", F.col("clean_text"))
    return storage_rows(analyse(apply_email_translation(mails)), "created_ts", *others)


def late_rows(answered: DataFrame, replies: DataFrame, history: DataFrame, run_ts: Column) -> DataFrame:
    """History rows for the mails whose reply came after their row was stored without one.

    ``answered`` is what ``stream_answers`` has stored, ``replies`` all replies so far; the numbers go on from ``history``.
    """
    unanswered = answered.filter("reply_to is null").drop("reply_to", "replied_ts", *REPLIES, *TOKENS)
    late = one_per_key(replies.filter("rec_id is not null"), "rec_id")
    met = join_unique(unanswered, late.withColumn("reply_to", F.col("rec_id")), "rec_id").filter("reply_to is not null")
    start = history.groupBy(F.col("req_id").alias("rec_id")).agg(F.count("*").alias("start"))
    numbered = number_per_key(met, "rec_id", "created_ts", "process_number", start)
    return labelled(stored_rows(numbered, "process_number"), run_ts)
