"""Every registered query: ``name -> function(spark, sf_dir) -> DataFrame``.

All of them read whole tables. Results hold only flat columns.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.html import html_to_text, strip_html
from ..functions.text import normalise
from ..operators import analysis as A, cleaning as C, inference as I, prompts as P, replylog as L, reports as R
from ..operators import translation as T
from ..session import shared_dir
from ..sources import buckets as B, emails as S, pages as PG, tables as TB
from ..sources.emails import spread
from ..streaming import answers as AN, deduplicate as DD, levels as LV, streams as ST
from . import fixture as X, pipeline as PL
from .pipeline import clean_and_join, process_emails, storage_rows

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over the tasks that the session asks for, if any."""
    return spread(X.table(spark, sf_dir, name), spark.conf.get("spark.mailtables.tasks", None))


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.compose_emails(dealt(spark, sf_dir, "documents"))


# ---- cleaning --------------------------------------------------------------------------------


def texts(spark, sf_dir):
    """Mails with line ends normalised, the input of the single text steps."""
    return mails(spark, sf_dir).select("rec_id", normalise(F.col("body_html")).alias("text")).filter("text is not null")


@query
def thread_cut(spark, sf_dir):
    return C.cut_thread(texts(spark, sf_dir), "text", "thread_text").select("rec_id", "thread_text")


@query
def quotes_stripped(spark, sf_dir):
    return C.strip_quotes(texts(spark, sf_dir), "text", "quote_text").select("rec_id", "quote_text")


@query
def disclaimers_stripped(spark, sf_dir):
    df = C.strip_disclaimers(texts(spark, sf_dir), "text", "notice_text")
    return C.trim_disclaimer_tail(df, "notice_text", "tail_text").select("rec_id", "notice_text", "tail_text")


@query
def signature_cut(spark, sf_dir):
    df = C.trim_disclaimer_tail(texts(spark, sf_dir), "text", "tail_text")
    return C.cut_signature(df, "tail_text", "signature_text").select("rec_id", "signature_text")


@query
def segments(spark, sf_dir):
    return C.segment_mail(texts(spark, sf_dir), "text").select("rec_id", "pretext", "core", "posttext")


@query
def clean_emails(spark, sf_dir):
    return C.clean_emails(mails(spark, sf_dir)).select("rec_id", "pretext", "core", "posttext", "clean_text")


@query
def clean_metrics(spark, sf_dir):
    return C.clean_emails(mails(spark, sf_dir)).select(
        "rec_id", "preview", "original_length", "cleaned_length", "compression_ratio", "warning"
    )


@query
def html_text(spark, sf_dir):
    pages = dealt(spark, sf_dir, "pages")
    return html_to_text(pages, "html", "html_text").select("page_id", "url", "html_text")


@query
def html_hidden(spark, sf_dir):
    """Mails with hidden elements in every kind of disorder, as text."""
    return html_to_text(X.hidden(spark, sf_dir), "html", "html_text").select("doc_id", "html_text")


@query
def html_strip_fallback(spark, sf_dir):
    pages = dealt(spark, sf_dir, "pages")
    return pages.select("page_id", strip_html(F.col("html")).alias("html_text"))


@query
def pattern_hits(spark, sf_dir):
    return R.pattern_hits(C.clean_text_stages(mails(spark, sf_dir), "body_html"))


@query
def stage_removals(spark, sf_dir):
    return R.stage_removals(C.clean_text_stages(mails(spark, sf_dir), "body_html"))


# ---- sources ---------------------------------------------------------------------------------


@query
def scan_tickets_page(spark, sf_dir):
    """Second page of ten tickets, newest first."""
    page = S.page_emails(S.only_type(X.emails(spark, sf_dir)), page=2, size=10)
    return page.select("rec_id", "subject", "type", F.col("created_ts").cast("string").alias("created_ts"))


@query
def lookup_source(spark, sf_dir):
    return S.lookup_source(X.emails(spark, sf_dir), 42).select("rec_id", "subject", "body_html")


@query
def envelope_unnest(spark, sf_dir):
    return S.unnest_envelope(X.envelopes(spark, sf_dir))


@query
def envelope_listing(spark, sf_dir):
    return S.unnest_envelope(X.envelopes(spark, sf_dir), listing=True)


@query
def envelope_totals(spark, sf_dir):
    return S.page_totals(X.envelopes(spark, sf_dir)).select("page_no", "total")


@query
def envelope_dead_letters(spark, sf_dir):
    return S.envelope_dead_letters(X.envelopes(spark, sf_dir)).select("page_no", "position", "problem")


@query
def deep_page(spark, sf_dir):
    """The fifth page of twenty mails by subject."""
    good, _ = S.isolate_bad_rows(X.emails(spark, sf_dir))
    return S.page_emails(good, page=5, size=20, order_by="subject").select("rec_id", "subject", "type")


@query
def ranked_page(spark, sf_dir):
    """The same page from a table that was sorted when it was written: only the files that hold it are read."""
    good, _ = S.isolate_bad_rows(X.emails(spark, sf_dir))
    order = [("subject", False), ("rec_id", True)]
    path = f"{shared_dir(spark, 'ranked')}/table"
    PG.write_ranked(good.select("rec_id", "subject", "type"), path, order, files=12)
    return PG.ranked_page(spark, path, order, 80, 20)


@query
def dead_letters(spark, sf_dir):
    good, bad = S.isolate_bad_rows(X.emails(spark, sf_dir))
    return (
        bad.groupBy("problem").agg(F.count("*").alias("mails"))
        .unionByName(good.agg(F.lit("none").alias("problem"), F.count("*").alias("mails")))
    )


# ---- translation -----------------------------------------------------------------------------


def plain_mails(spark, sf_dir):
    return X.emails(spark, sf_dir).withColumn("body", F.col("body_html"))


def answered(spark, sf_dir):
    """Cleaned mails with their replies."""
    good, _ = S.isolate_bad_rows(mails(spark, sf_dir))
    return clean_and_join(good, X.responses(spark, sf_dir))


@query
def arabic_routing(spark, sf_dir):
    return T.route_languages(plain_mails(spark, sf_dir)).select("rec_id", "subject", "has_arabic", "language")


@query
def translation_prompts(spark, sf_dir):
    return T.translation_prompts(plain_mails(spark, sf_dir))


@query
def text_translation_prompts(spark, sf_dir):
    return T.text_translation_prompts(X.messages(spark, sf_dir), "conv_id", "turn")


@query
def translation_applied(spark, sf_dir):
    return T.apply_email_translation(answered(spark, sf_dir)).select(
        "rec_id", "subject", "body", "language", "was_translated", "translated_content"
    )


@query
def text_translation_applied(spark, sf_dir):
    return T.apply_text_translation(X.messages(spark, sf_dir))


# ---- prompts and replies ---------------------------------------------------------------------


@query
def analysis_prompts(spark, sf_dir):
    return P.analysis_prompts(plain_mails(spark, sf_dir))


@query
def summary_prompts(spark, sf_dir):
    return P.summary_prompts(T.apply_email_translation(answered(spark, sf_dir)))


@query
def action_prompts(spark, sf_dir):
    return P.action_prompts(T.apply_email_translation(answered(spark, sf_dir)))


def flat_pairs(col="structured_data"):
    return F.array_join(
        F.transform(col, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("?")), F.lit("@"), F.coalesce(e["confidence"].cast("string"), F.lit("?")))), ";"
    )


def flat_items(col="action_items"):
    return F.array_join(
        F.transform(col, lambda e: F.concat(F.coalesce(e["action"], F.lit("?")), F.lit("@"), e["confidence"].cast("string"))), ";"
    )


def flat_analysis():
    return [
        "rec_id",
        F.col("classification.category").alias("category"),
        F.col("classification.priority").alias("priority"),
        F.col("classification.sentiment").alias("sentiment"),
        F.col("classification.confidence").alias("class_confidence"),
        flat_pairs().alias("structured_data"),
        "structured_confidence",
        flat_items().alias("action_items"),
        *[F.col(f"confidence_scores.{n}").alias(f"score_{n}") for n in A.SCORES],
    ]


@query
def analysis_parsed(spark, sf_dir):
    """Normalised replies, before any fallback."""
    parsed = A.normalise_analysis(A.parse_analysis(X.responses(spark, sf_dir)))
    return parsed.select(F.col("raw").isNotNull().alias("parsed"), *flat_analysis())


@query
def analysis_members(spark, sf_dir):
    """Replies with further members: whole objects, corrected confidences in place."""
    parsed = A.normalise_analysis(A.parse_analysis(X.open_responses(spark, sf_dir)))
    return parsed.select("rec_id", *[F.to_json(c).alias(c) for c in A.OPEN])


@query
def analysis_result(spark, sf_dir):
    """The whole stored result of each mail."""
    return stored(spark, sf_dir).select("req_id", "analysis_result")


@query
def review_flags(spark, sf_dir):
    flagged = A.review_flags(A.parse_analysis(X.responses(spark, sf_dir)))
    return flagged.select("rec_id", "requires_human_review", "review_reason")


@query
def analysis_summary(spark, sf_dir):
    return processed(spark, sf_dir).select("rec_id", "summary")


@query
def analysis_fallback(spark, sf_dir):
    return processed(spark, sf_dir).select("failure", "requires_human_review", "review_reason", *flat_analysis())


def processed(spark, sf_dir):
    return process_emails(mails(spark, sf_dir), X.responses(spark, sf_dir))


@query
def next_action(spark, sf_dir):
    return processed(spark, sf_dir).select("rec_id", "next_best_action", "action_confidence", "action_reasoning")


@query
def token_usage(spark, sf_dir):
    return R.token_usage_report(processed(spark, sf_dir))


@query
def domain_violations(spark, sf_dir):
    return R.domain_check(processed(spark, sf_dir))


# ---- tables and pipelines --------------------------------------------------------------------


def at(text):
    return F.expr(f"timestamp_ntz'{text}'")


RUN_TS, EARLIER_TS = "2025-03-01 12:00:00", "2025-01-01 00:00:00"


def stored(spark, sf_dir):
    return storage_rows(processed(spark, sf_dir))


def deliveries(spark, sf_dir):
    """Small storage rows, two deliveries for every document of a web source or a long text."""
    docs = X.table(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("doc_id").alias("req_id"), F.col("lang").alias("pretext"), F.col("text").alias("core"),
        F.col("source").alias("posttext"), F.col("text").alias("clean_text"),
        (F.col("lang") == "en").alias("translated"), F.lit(None).cast("string").alias("original_email"),
        F.lit(None).cast("string").alias("translated_content"), F.lit(None).cast("string").alias("analysis_result"),
        F.when(F.col("n_chars") % 3 == 0, "").otherwise(F.col("lang")).alias("summary"),
        F.when(F.col("n_chars") % 4 == 0, F.lit(None)).otherwise(F.col("n_chars") % 4 == 1).alias("requires_human_review"),
        F.when(F.col("n_chars") % 4 == 1, "why").otherwise("").alias("review_reason"),
        F.when(F.col("n_chars") % 5 == 0, F.lit(None)).otherwise(F.col("n_chars")).alias("processing_time_ms"),
        F.col("n_chars").alias("arrival"), "lang",
    )
    second = rows.filter("arrival > 1000").withColumn("summary", F.lit("second")).withColumn("arrival", F.col("arrival") + 1)
    return rows.unionByName(second)


def small_current(spark, sf_dir):
    """The table before the batch: requests in German or French, and one per conversation."""
    docs = X.table(spark, sf_dir, "documents").filter("lang in ('de', 'fr')").select(F.col("doc_id").alias("req_id"), F.col("source").alias("core"))
    talks = X.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    talks = talks.select((F.col("conv_id") + 100_000_000).alias("req_id"), F.col("n").cast("string").alias("core"))
    rows = docs.unionByName(talks)
    empty = {"translated": "boolean", "requires_human_review": "boolean", "processing_time_ms": "int"}
    for c in TB.VALUES:
        if c != "core":
            rows = rows.withColumn(c, F.lit(None).cast(empty.get(c, "string")))
    return rows.select("req_id", *TB.VALUES, at(EARLIER_TS).alias("created_at"))


FLAT_TABLE = [
    "req_id", "pretext", "core", "posttext", "clean_text", "translated", "summary",
    "requires_human_review", "review_reason", "processing_time_ms",
]


def created_text(df):
    return df.withColumn("created_at", F.col("created_at").cast("string"))


@query
def upsert_snapshot(spark, sf_dir):
    snapshot = TB.upsert_cleaned(small_current(spark, sf_dir), deliveries(spark, sf_dir).drop("lang"), at(RUN_TS))
    return created_text(snapshot).select(*FLAT_TABLE, "created_at")


@query
def upsert_buckets(spark, sf_dir):
    """The same upsert into a bucketed snapshot that holds the earlier table."""
    path = f"{shared_dir(spark, 'buckets')}/table"
    earlier = small_current(spark, sf_dir).drop("created_at").withColumn("arrival", F.lit(0))
    B.upsert_buckets(path, earlier, at(EARLIER_TS), buckets=16)
    batch = deliveries(spark, sf_dir).drop("lang")
    B.upsert_buckets(path, batch, at(RUN_TS))
    schema = batch.select("req_id", *TB.VALUES, at(RUN_TS).alias("created_at")).schema
    return created_text(B.read_buckets(spark, path, schema)).select(*FLAT_TABLE, "created_at")


def history(spark, sf_dir):
    """Reprocessing history: one row per turn of a conversation, for the request of that number."""
    return X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("req_id"), F.col("turn"))


@query
def reprocess_labels(spark, sf_dir):
    batch = deliveries(spark, sf_dir).drop("lang")
    rows = TB.append_reprocess(history(spark, sf_dir), batch, at(RUN_TS))
    return created_text(rows).select("process_label", "process_number", *FLAT_TABLE, "created_at")


@query
def constraint_violations(spark, sf_dir):
    """Deliveries as they come break the key of the cleaned table; so do mails without a number."""
    raw = deliveries(spark, sf_dir).withColumn("req_id", F.when(F.col("arrival") % 97 != 0, F.col("req_id")))
    return R.check_constraints(raw, "emails_cleaned")


@query
def list_cleaned(spark, sf_dir):
    snapshot = TB.upsert_cleaned(small_current(spark, sf_dir), deliveries(spark, sf_dir).drop("lang"), at(RUN_TS))
    return created_text(TB.list_cleaned(snapshot, 5, 5)).select("req_id", "summary", "created_at")


@query
def history_by_req(spark, sf_dir):
    rows = TB.append_reprocess(history(spark, sf_dir), deliveries(spark, sf_dir).drop("lang"), at(RUN_TS))
    return created_text(TB.history_by_req(rows, 10)).select("process_number", "req_id", "process_label", "pretext", "core", "created_at")


@query
def review_queue(spark, sf_dir):
    snapshot = TB.upsert_cleaned(small_current(spark, sf_dir), deliveries(spark, sf_dir).drop("lang"), at(RUN_TS))
    return created_text(TB.review_queue(snapshot)).select("req_id", "review_reason", "created_at")


@query
def pipeline_rows(spark, sf_dir):
    rows = stored(spark, sf_dir)
    return rows.select(
        *FLAT_TABLE, "original_email", "translated_content",
        F.get_json_object("analysis_result", "$.next_best_action").alias("next_best_action"),
        F.get_json_object("analysis_result", "$.tokenUsage.totalTokens").alias("total_tokens"),
        F.col("arrival").cast("string").alias("arrival"),
    )


@query
def run_report(spark, sf_dir):
    """Tickets into the cleaned table, every other type as a reprocessing request."""
    rows = processed(spark, sf_dir).withColumn(
        "table", TB.target_table(F.when(F.col("type") != S.TICKETS, F.col("rec_id")))
    )
    return R.run_report(rows)


@query
def ingest_batch(spark, sf_dir):
    snapshot, _, _ = PL.ingest_batch(mails(spark, sf_dir), X.responses(spark, sf_dir), small_current(spark, sf_dir), at(RUN_TS))
    return created_text(snapshot).select("req_id", "core", "summary", "requires_human_review", "created_at")


LONGEST = 20_000


@query
def ingest_failures(spark, sf_dir):
    """Landed mails that fail, by stage and reason."""
    _, dead, _ = PL.ingest_checked(*X.landed(spark, sf_dir), LONGEST)
    return dead.select("rec_id", "stage", "reason")


@query
def ingest_accounting(spark, sf_dir):
    """Every landed mail is stored or a dead letter."""
    _, _, sums = PL.ingest_checked(*X.landed(spark, sf_dir), LONGEST)
    return sums


@query
def routed_tables(spark, sf_dir):
    """Rows by the table that they are bound for."""
    rows = deliveries(spark, sf_dir).withColumn("request_id", F.when(F.col("lang") == "de", F.col("req_id")))
    cleaned, again = TB.route_target(rows)
    return (
        cleaned.select(F.lit("emails_cleaned").alias("table"), "req_id", "core")
        .unionByName(again.select(F.lit("emails_reprocess").alias("table"), "req_id", "core"))
    )


@query
def history_violations(spark, sf_dir):
    """A history in which the runs of two jobs have the same labels."""
    batch = deliveries(spark, sf_dir).drop("lang")
    rows = TB.append_reprocess(history(spark, sf_dir), batch, at(RUN_TS)).select("req_id", "process_label")
    twice = rows.filter("req_id % 3 = 0")
    unlabelled = rows.withColumn("process_label", F.when(F.col("req_id") % 5 != 0, F.col("process_label")))
    return R.check_constraints(unlabelled.unionByName(twice), "emails_reprocess")


@query
def null_bodies(spark, sf_dir):
    """Mails analysed as they came: some have no body to quote."""
    good, _ = S.isolate_bad_rows(plain_mails(spark, sf_dir))
    joined = good.join(X.responses(spark, sf_dir), "rec_id", "left").withColumn("was_translated", F.lit(False))
    return A.analyse(joined).select("rec_id", "failure", "summary", "review_reason", "action_confidence", "action_reasoning")


@query
def reprocess_batch(spark, sf_dir):
    """Reprocess the mails that a conversation number asks for."""
    wanted = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("req_id")).distinct()
    rows = PL.reprocess(mails(spark, sf_dir), wanted, X.responses(spark, sf_dir), history(spark, sf_dir), at(RUN_TS))
    return created_text(rows).select("req_id", "process_label", "core", "summary", "review_reason", "created_at")


@query
def run_rows(spark, sf_dir):
    """What a reprocessing run reports for each mail."""
    rows = TB.append_reprocess(history(spark, sf_dir), deliveries(spark, sf_dir).drop("lang"), at(RUN_TS))
    return R.run_rows(rows.withColumnRenamed("translated", "was_translated"))


@query
def ingest_given(spark, sf_dir):
    """Mails of any type, as handed in, bound for the reprocessing table."""
    rows, _ = PL.ingest_given(mails(spark, sf_dir), X.responses(spark, sf_dir), request_id=1)
    return rows.select("req_id", "table", "core", "summary", "processing_time_ms")


@query
def infer_batches(spark, sf_dir):
    """Prompts through a deterministic stand-in for a model that rejects some of them."""

    def echo(prompts):
        if any("src3" in p for p in prompts):
            raise ValueError("rejected")
        return [{"reply": p.replace(" ", "_"), "in_tokens": len(p), "out_tokens": 40, "latency_ms": 1} for p in prompts]

    source = X.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("rec_id"), F.lit("echo").alias("kind"),
        F.concat("source", F.lit("|"), "text").alias("prompt"),
    )
    return I.infer_batches(source, echo).select(
        "rec_id", "reply", "in_tokens", F.col("error").isNotNull().alias("failed")
    )


def logged(spark, sf_dir):
    """Many equal prompts through the store of replies: the first run's model rejects some, the second asks only these."""

    def model(rejected):
        def reply(prompts):
            if any(rejected in p for p in prompts):
                raise ValueError("rejected")
            return [{"reply": p.replace("|", " "), "in_tokens": len(p), "out_tokens": 3, "latency_ms": 1} for p in prompts]

        return reply

    prompts = X.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("rec_id"), F.col("lang").alias("kind"),
        F.concat_ws("|", "source", (F.col("n_chars") % 10).cast("string")).alias("prompt"),
    )
    path = f"{shared_dir(spark, 'reply-log')}/requests"
    L.ask(prompts, model("src3"), path, part_rows=40)
    return L.ask(prompts, model("none"), path), path


@query
def reply_log(spark, sf_dir):
    rows, path = logged(spark, sf_dir)
    return rows.select("rec_id", "kind", "reply", "in_tokens", "error")


@query
def provider_totals(spark, sf_dir):
    """Calls and tokens as the provider counts them."""
    _, path = logged(spark, sf_dir)
    return L.provider_totals(spark, path)


# ---- streams ---------------------------------------------------------------------------------


def document_stream(spark, sf_dir):
    """The documents as arriving files: a pattern, which a single file matches as well as a folder of files."""
    schema = X.table(spark, sf_dir, "documents").schema
    return ST.read_stream(spark, f"{sf_dir}/documents.parque[t]", schema)


@query
def stream_clean(spark, sf_dir):
    work = shared_dir(spark, "stream-clean")
    cleaned = ST.stream_clean(X.compose_emails(document_stream(spark, sf_dir)))
    ST.append_stream(cleaned.select("rec_id", "core", "clean_text"), f"{work}/out", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/out")


@query
def stream_upsert(spark, sf_dir):
    work = shared_dir(spark, "stream-upsert")
    rows = document_stream(spark, sf_dir).select(
        F.col("doc_id").alias("req_id"), F.col("text").alias("core"), "lang", "source", "n_chars"
    )

    def prepare(batch):
        for name in TB.VALUES:
            if name != "core":
                kind = {"translated": "boolean", "requires_human_review": "boolean", "processing_time_ms": "int"}
                batch = batch.withColumn(name, F.lit(None).cast(kind.get(name, "string")))
        doubled = batch.unionByName(batch.withColumn("n_chars", F.col("n_chars") + 1).withColumn("core", F.col("source")).filter("lang = 'en'"))
        return doubled.withColumnRenamed("n_chars", "arrival")

    ST.stream_upsert(rows, f"{work}/table", f"{work}/checkpoint", at(RUN_TS), prepare=prepare)
    return created_text(ST.current_state(spark, f"{work}/table")).select("req_id", "core", "requires_human_review", "created_at")


@query
def stream_dedup(spark, sf_dir):
    """Every event delivered twice, in several files from the newest to the oldest; one of each is kept."""
    work = shared_dir(spark, "stream-dedup")
    twice = X.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("rec_id"), "ts", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery")
    )
    twice.repartitionByRange(6, "delivery", F.desc("ts")).write.parquet(f"{work}/in")
    events = ST.read_stream(spark, f"{work}/in", twice.schema, files_per_batch=1)
    ST.stream_dedup(events.select("rec_id", "event_type"), f"{work}/out", f"{work}/checkpoint")
    return ST.first_deliveries(spark, f"{work}/out")


@query
def stream_dedup_bounded(spark, sf_dir):
    """The same deliveries through a state store that forgets, with a table of what came too late for it."""
    work = shared_dir(spark, "stream-dedup-bounded")
    twice = X.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type",
        F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"),
    )
    twice.repartitionByRange(6, "delivery", F.desc("ts")).drop("delivery").write.parquet(f"{work}/in")
    schema = twice.drop("delivery").schema
    DD.stream_dedup_bounded(
        lambda: ST.read_stream(spark, f"{work}/in", schema, files_per_batch=1), work, f"{work}/checkpoint", "rec_id", "ts", "1 hour"
    )
    return DD.complete(spark, work, schema, "rec_id").select("rec_id", "event_type")


@query
def stream_upsert_levels(spark, sf_dir):
    """Six deliveries of growing sets of requests, upserted into merged levels."""
    work = shared_dir(spark, "stream-levels")
    docs = X.table(spark, sf_dir, "documents")

    def prepare(batch):
        kinds = {"translated": "boolean", "requires_human_review": "boolean", "processing_time_ms": "int"}
        return batch.select("*", *[F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in TB.VALUES if c != "core"])

    for i in range(6):
        part = docs.filter(f"doc_id % 6 <= {i}").select(
            F.col("doc_id").alias("req_id"), F.concat(F.lit(f"{i} "), "text").alias("core"), F.col("n_chars").alias("arrival"))
        part.write.mode("append").option("compression", LV.CODEC).parquet(f"{work}/in")
        # The stream goes on after each delivery and takes all files of it as one micro-batch; the delivery is not read again.
        rows = ST.read_stream(spark, f"{work}/in", part.schema, files_per_batch=None)
        LV.stream_upsert_levels(rows, f"{work}/table", f"{work}/checkpoint", at(RUN_TS), prepare=prepare, fan=2, sweep=True)
        ST.remove_taken(spark, f"{work}/in")
    return created_text(LV.current_levels(spark, f"{work}/table")).select("req_id", "core", "requires_human_review", "created_at")


@query
def stream_answers(spark, sf_dir):
    """Mails and replies from several files in disorder: stored rows, and history rows for replies that came late."""
    work = shared_dir(spark, "stream-answers")
    at_time = F.col("created_ts").cast("timestamp")
    good, _ = S.isolate_bad_rows(X.emails(spark, sf_dir))
    mails = good.withColumn("created_ts", at_time).select("rec_id", "subject", "body_html", "type", "created_ts")
    replied = at_time + F.when(F.col("rec_id") % 6 == 0, F.expr("interval 2 hours")).otherwise(F.expr("interval 20 minutes"))
    times = X.emails(spark, sf_dir).filter("rec_id % 10 != 3").select("rec_id", replied.alias("replied_ts"))
    replies = X.responses(spark, sf_dir).join(times, "rec_id")
    # Each micro-batch takes about a third of the files, as many as there are cores: order and batches are free.
    files = spark.sparkContext.defaultParallelism
    # A last row on either side, long after all others, ends the waiting.
    for name, rows, time in (("mails", mails, "created_ts"), ("replies", replies, "replied_ts")):
        rows.repartition(3 * files).write.parquet(f"{work}/{name}")
        for days in (30, 60):
            values = {time: F.col("t") + F.expr(f"interval {days} days"), "rec_id": F.lit(-1)}
            last = rows.agg(F.max(time).alias("t")).select(
                *[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in rows.dtypes])
            last.coalesce(1).write.mode("append").parquet(f"{work}/{name}")
    arriving = [ST.read_stream(spark, f"{work}/{name}", rows.schema, files_per_batch=files) for name, rows in (("mails", mails), ("replies", replies))]
    joined = AN.stream_answers(*arriving, "1 hour", "10 days")
    ST.append_stream(joined, f"{work}/answered", f"{work}/checkpoint")
    answered = spark.read.parquet(f"{work}/answered").filter("rec_id >= 0")
    names = ["req_id", "core", "summary", "requires_human_review", "review_reason"]
    stored = AN.stored_rows(answered).select(F.lit("emails_cleaned").alias("table"), F.lit(None).cast("string").alias("process_label"), *names)
    late = AN.late_rows(answered, spark.read.parquet(f"{work}/replies").filter("rec_id >= 0"), history(spark, sf_dir), at(RUN_TS))
    return stored.unionByName(late.select(F.lit("emails_reprocess").alias("table"), "process_label", *names))
