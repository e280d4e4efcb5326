"""Sources, result tables, skew-safe shuffles, the whole pipeline and streams."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from mailtables.operators import keyed as K, reports as R
from mailtables.operators.paging import ordered_page
from mailtables.operators.replylog import provider_totals
from mailtables.plans import fixture as X, pipeline as PL
from mailtables.session import shared_dir
from mailtables.sources import emails as S, tables as TB
from mailtables.streaming import streams as ST

from conftest import SMALL

AT = "timestamp_ntz'2025-01-01 00:00:00'"
LATER = "timestamp_ntz'2025-02-02 00:00:00'"


def batch(spark, *rows):
    df = spark.createDataFrame(list(rows), "req_id long, core string, arrival long")
    kinds = {"translated": "boolean", "requires_human_review": "boolean", "processing_time_ms": "int"}
    for name in TB.VALUES:
        if name != "core":
            df = df.withColumn(name, F.lit(None).cast(kinds.get(name, "string")))
    return df


def state(df):
    return sorted((r.req_id, r.core, str(r.created_at)[:10]) for r in df.collect())


def test_upsert_keeps_the_first_time_and_the_last_arrival(spark):
    first = batch(spark, (1, "a", 1), (2, "b", 1), (1, "c", 9), (1, "d", 5))
    one = TB.upsert_cleaned(TB.empty_snapshot(first, F.expr(AT)), first, F.expr(AT))
    assert state(one) == [(1, "c", "2025-01-01"), (2, "b", "2025-01-01")]
    two = TB.upsert_cleaned(one, batch(spark, (2, "B", 1), (3, "n", 1)), F.expr(LATER))
    assert state(two) == [(1, "c", "2025-01-01"), (2, "B", "2025-01-01"), (3, "n", "2025-02-02")]
    again = TB.upsert_cleaned(two, batch(spark, (2, "B", 1), (3, "n", 1)), F.expr("timestamp_ntz'2026-01-01 00:00:00'"))
    assert state(again) == state(two)
    assert one.filter("requires_human_review or processing_time_ms != 0").count() == 0


def test_an_update_may_clear_a_value(spark):
    first = batch(spark, (1, "a", 1)).withColumn("summary", F.lit("s"))
    one = TB.upsert_cleaned(TB.empty_snapshot(first, F.expr(AT)), first, F.expr(AT))
    two = TB.upsert_cleaned(one, batch(spark, (1, "a", 1)).withColumn("summary", F.lit("")), F.expr(LATER))
    assert two.first().summary is None


def test_labels_continue_the_history(spark):
    history = batch(spark, (1, "x", 0), (1, "y", 0))
    rows = TB.append_reprocess(history, batch(spark, (1, "a", 3), (1, "b", 2), (2, "c", 1)), F.expr(AT)).collect()
    assert sorted((r.req_id, r.core, r.process_label) for r in rows) == [(1, "a", "process4"), (1, "b", "process3"), (2, "c", "process1")]


@pytest.mark.parametrize("rows_per_task", [5, 40, 10_000])
def test_numbers_of_a_hot_key(spark, rows_per_task):
    """A third of the rows has one key, and many of them one arrival time."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("long").alias("k"),
        F.when(F.col("id") % 2 == 0, 100).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 900).alias("at"),
        F.col("id").alias("v"),
    )
    start = spark.createDataFrame([(7, 10)], "k long, start long")
    got = K.number_per_key(df, "k", "at", "n", start, rows_per_task).collect()
    assert len(got) == 3000
    by_key = {}
    for r in got:
        by_key.setdefault(r.k, []).append((r.n, r["at"]))
    for key, numbered in by_key.items():
        first = 11 if key == 7 else 1
        assert sorted(n for n, _ in numbered) == list(range(first, first + len(numbered)))
        order = [-1 if a is None else a for _, a in sorted(numbered)]
        assert order == sorted(order)


def test_numbering_splits_the_hot_key(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.lit(5).alias("at"), F.col("id").alias("v"))
    plan = K.number_per_key(df, "k", "at", "n", rows_per_task=10, fan=4)
    assert plan.agg(F.max("n")).first()[0] == 4000 and plan.select("n").distinct().count() == 4000


def test_no_task_numbers_many_rows_of_a_hot_key(spark):
    """Equal rows of one key, and levels above levels of sums."""
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, None).otherwise(F.lit(1)).alias("k"), F.lit(5).alias("at"))
    got = K.number_per_key(df, "k", "at", "n", rows_per_task=100, fan=6)
    assert got.groupBy("k").agg(F.countDistinct("n").alias("d"), F.max("n").alias("m")).orderBy("k").collect() == [(None, 2000, 2000), (1, 18000, 18000)]
    folder = max(glob.glob(f"{shared_dir(spark, 'x').rsplit('/', 1)[0]}/numbering-*"), key=os.path.getmtime)
    sizes = [r["count"] for r in spark.read.parquet(folder).groupBy("_part").count().collect()]
    assert len(sizes) >= 150 and max(sizes) <= 300


def test_join_with_a_hot_key(spark):
    left = spark.range(3000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(7, "seven"), (7, "sept"), (8, "eight"), (9999, "unused")], "k long, name string")
    joined = K.join_unique(left, right, "k", rows_per_task=100)
    assert joined.count() == 3000
    assert joined.select("v").distinct().count() == 3000
    names = {r.k: r["count"] for r in joined.filter("name is not null").groupBy("k").count().collect()}
    assert names == {7: 1001, 8: 1}
    assert joined.filter("k = 7").select("name").distinct().count() == 1


def test_latest_per_key_against_a_window(spark):
    docs = X.table(spark, SMALL, "documents").select((F.col("n_chars") % 5).alias("k"), "n_chars", "doc_id", "text")
    got = K.latest_per_key(docs, "k", "n_chars", "doc_id").select("k", "doc_id").collect()
    best = {}
    for r in docs.select("k", "n_chars", "doc_id").collect():
        best[r.k] = max(best.get(r.k, (-1, -1)), (r.n_chars, r.doc_id))
    assert {r.k: r.doc_id for r in got} == {k: d for k, (_, d) in best.items()}


def test_envelopes(spark):
    pages = [
        '{"Data":[{"RecId":1,"Subject":"a"},null],"TotalCount":9}', '{"Items":[{"RecId":2}]}', '[{"RecId":3},{"RecId":4}]', "{}", "broken", None,
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, payload string")
    assert [r.rec_id for r in S.unnest_envelope(df).collect()] == [1]
    assert [r.rec_id for r in S.unnest_envelope(df, listing=True).orderBy("rec_id").collect()] == [2, 3, 4]
    assert [r.total for r in S.page_totals(df).orderBy("i").collect()] == [9, 0, 2, 0, 0, 0]
    bad = S.envelope_dead_letters(df).orderBy("i").collect()
    assert [(r.i, r.position, r.problem) for r in bad] == [(0, 1, "null element"), (4, None, "page is no JSON"), (5, None, "empty page")]
    assert bad[1].raw == "broken"


def test_one_bad_element_loses_only_itself(spark):
    page = '{"Data":[5,{"RecId":2},{"RecId":"11","Subject":"s"},{"RecId":"x"},{"Subject":"none"},[1]],"TotalCount":"7"}'
    df = spark.createDataFrame([(1, page), (2, page[:30])], "i int, payload string")
    good, bad = S.unnest_envelope(df), S.envelope_dead_letters(df)
    assert [r.rec_id for r in good.orderBy("rec_id").collect()] == [None, 2, 11]
    assert sorted((r.i, r.position, r.problem) for r in bad.filter("i = 1").collect()) == [
        (1, 0, "element is no object"), (1, 3, "RecId is no number"), (1, 5, "element is no object"),
    ]
    assert bad.filter("i = 2").count() == 1
    assert [r.total for r in S.page_totals(df).orderBy("i").collect()] == [7, 0]


def test_late_rows_are_kept(spark):
    """Files from the newest to the oldest, one for each micro-batch, with repeats across them."""
    work = shared_dir(spark, "test-dedup")
    rows = spark.range(60).select(F.col("id").alias("rec_id"), F.timestamp_seconds(9_000_000 - F.col("id") * 90_000).alias("created_ts"))
    for k in range(4):
        rows.filter(F.col("rec_id") >= 15 * k - 5).filter(F.col("rec_id") < 15 * k + 15).coalesce(1).write.parquet(f"{work}/in/{k}")
    arriving = ST.read_stream(spark, f"{work}/in/*", rows.schema, files_per_batch=1)
    ST.stream_dedup(arriving, f"{work}/out", f"{work}/checkpoint")
    assert len({r.batch_id for r in spark.read.parquet(f"{work}/out").select("batch_id").distinct().collect()}) >= 4
    kept = ST.first_deliveries(spark, f"{work}/out")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))


def test_pages(spark):
    df = spark.range(25).select(F.col("id").alias("rec_id"), (F.col("id") % 5).alias("created_ts"))
    first = [r.rec_id for r in S.page_emails(df, 1, 10).collect()]
    second = [r.rec_id for r in S.page_emails(df, 2, 10).collect()]
    assert first == [4, 9, 14, 19, 24, 3, 8, 13, 18, 23] and second[:2] == [2, 7]
    assert [r.rec_id for r in S.page_emails(df, 0, 0, direction=1).collect()][:2] == [0, 5]


def test_constraints(spark):
    df = batch(spark, (1, "a", 1), (1, "b", 1), (None, "c", 1), (2, "d", 1))
    rows = {(r.rule, r.key, r.rows) for r in R.check_constraints(df, "emails_cleaned").collect()}
    assert rows == {("req_id is null", None, 1), ("unique req_id", "1", 2)}
    labelled = df.withColumn("process_label", F.col("core"))
    assert [r.rule for r in R.check_constraints(labelled, "emails_reprocess").collect()] == ["req_id is null"]
    assert R.check_constraints(df.filter("core = 'd'"), "emails_cleaned").count() == 0


def test_routes(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "i int, request_id long")
    cleaned, again = TB.route_target(df)
    assert [r.i for r in cleaned.collect()] == [1] and [r.i for r in again.collect()] == [2]


def test_original_email_json(spark):
    df = spark.createDataFrame([(None, "b")], "original_subject string, original_body string")
    assert df.select(TB.original_email_json()).first()[0] == '{"body":"b"}'
    assert df.select(TB.original_email_json(keep_null=True)).first()[0] == '{"subject":null,"body":"b"}'


def test_history_is_readable(spark):
    rows = TB.append_reprocess(batch(spark), batch(spark, (1, "a", 2), (1, "b", 1)).withColumn("original_email", F.lit('{"body":"x"}')), F.expr(AT))
    got = TB.history_by_req(rows, 1).select("core", F.expr("variant_get(original_email, '$.body', 'string') b")).collect()
    assert [(r.core, r.b) for r in got] == [("b", "x"), ("a", "x")]


def test_pipeline_keeps_every_keyed_mail_once(spark):
    mails, replies = X.emails(spark, SMALL), X.responses(spark, SMALL)
    rows = PL.process_emails(mails, replies)
    good = mails.filter("rec_id is not null")
    assert sorted(r.rec_id for r in rows.select("rec_id").collect()) == sorted(r.rec_id for r in good.select("rec_id").collect())
    checks = rows.agg(
        F.count_if((F.length("clean_text") > 10_003) | F.col("clean_text").contains("\n\n")).alias("bad_text"),
        F.count_if(~F.col("classification.confidence").between(0, 1) | ~F.col("action_confidence").between(0, 1)).alias("bad_confidence"),
        F.count_if(F.col("requires_human_review") != F.col("review_reason").isNotNull()).alias("bad_review"),
    ).first()
    assert tuple(checks) == (0, 0, 0)


def test_mails_without_reply_fall_back(spark):
    mails = X.emails(spark, SMALL)
    rows = PL.process_emails(mails, X.responses(spark, SMALL).limit(0))
    assert rows.filter("failure is null").count() == 0


def test_copies_of_a_mail_stay_separate_rows(spark):
    mails = X.emails(spark, SMALL).withColumn("rec_id", F.lit(12).cast("long"))
    assert PL.process_emails(mails, X.responses(spark, SMALL)).count() == mails.count()


def test_ingest_and_reprocess(spark):
    mails, replies = X.emails(spark, SMALL), X.responses(spark, SMALL)
    doubled = mails.unionByName(mails.withColumn("created_ts", F.col("created_ts") + F.expr("interval 1 day")).withColumn("body_html", F.lit("The newer text of the mail.")))
    snapshot, report, dead = PL.ingest_batch(doubled, replies, None, F.expr(AT))
    tickets = mails.filter("type = 'Tickets' and rec_id is not null").count()
    assert snapshot.count() == tickets == report.first().total
    assert snapshot.filter("clean_text != 'The newer text of the mail.'").count() == 0
    assert dead.count() == doubled.filter("type = 'Tickets' and rec_id is null").count() > 0
    wanted = spark.createDataFrame([(1,), (1,), (3,), (10**9,)], "req_id long")
    history = batch(spark, (1, "x", 0))
    rows = PL.reprocess(mails, wanted, replies, history, F.expr(AT)).collect()
    assert sorted((r.req_id, r.process_label) for r in rows) == [(1, "process2"), (3, "process1")]
    twice = PL.reprocess(mails.unionByName(mails), wanted.unionByName(wanted), replies, history, F.expr(AT)).collect()
    assert sorted((r.req_id, r.process_label) for r in twice) == [(1, "process2"), (1, "process3"), (3, "process1"), (3, "process2")]
    given, bad = PL.ingest_given(mails, replies, request_id=5)
    assert given.select("table").distinct().first()[0] == TB.REPROCESS and bad.count() + given.count() == mails.count()
    with pytest.raises(ValueError):
        PL.ingest_given(None, replies)


def test_model_run_skips_needless_calls(spark):
    mails = X.emails(spark, SMALL)

    def model(prompts):
        out = []
        for p in prompts:
            if p.startswith("Translate"):
                out.append({"reply": "Account\nI cannot sign in."})
            elif p.startswith("Read the e-mail"):
                low = 0.2 if "Invoice" in p or "src1" in p else 0.9
                out.append({"reply": json.dumps({"classification": {"category": "billing", "confidence": 0.9}, "summary": "s", "confidence_scores": {"overall": low}}), "in_tokens": 3, "out_tokens": 1})
            elif p.startswith("Sum up"):
                out.append({"reply": "Summary: short"})
            else:
                out.append({"reply": '{"action":"Create new ticket","confidence":0.8,"reasoning":"r"}', "in_tokens": 2, "out_tokens": 1})
        return out

    work = shared_dir(spark, "test-model")
    rows = PL.run_with_model(mails, model, concurrency=2, work_dir=work)
    done = rows.select("requires_human_review", "summary", "next_best_action", "token_usage.total", "was_translated", "body").collect()
    assert len(done) == mails.filter("rec_id is not null").count()
    for r in done:
        assert (r.summary, r.next_best_action, r.total) == (("short", "Escalate to agent", 4) if r.requires_human_review else ("s", "Create new ticket", 7))
        assert not r.was_translated or r.body == "I cannot sign in."
    reviewed = sum(r.requires_human_review for r in done)
    assert 0 < reviewed < len(done)
    # Only needed calls are made, and equal prompts are asked once: all planner prompts are equal here.
    asked = {r.kind: r for r in provider_totals(spark, f"{work}/requests").collect()}
    assert 0 < asked["summary"].requests <= reviewed and asked["action"].requests == 1
    assert 0 < asked["translation"].requests <= sum(r.was_translated for r in done)
    assert all(r.calls == r.requests and r.failed == 0 for r in asked.values())

    def silent(prompts):
        raise AssertionError("a stored reply was asked for again")

    again = PL.run_with_model(mails, silent, concurrency=2, work_dir=work)
    assert again.select("summary").subtract(rows.select("summary")).isEmpty() and again.count() == len(done)


def test_stream_restart_changes_nothing(spark):
    work = shared_dir(spark, "test-stream")
    source, table, check = f"{work}/in", f"{work}/table", f"{work}/check"
    schema = batch(spark).schema

    def run():
        ST.stream_upsert(ST.read_stream(spark, source, schema), table, check, F.expr(AT if not runs else LATER))
        runs.append(state(ST.current_state(spark, table)))
        return runs[-1]

    runs = []
    batch(spark, (1, "a", 1), (2, "b", 1)).write.parquet(source)
    assert run() == [(1, "a", "2025-01-01"), (2, "b", "2025-01-01")]
    assert run() == runs[0]
    batch(spark, (2, "B", 2), (3, "c", 1)).write.mode("append").parquet(source)
    assert run() == [(1, "a", "2025-01-01"), (2, "B", "2025-01-01"), (3, "c", "2025-02-02")]
    ST.compact(spark, table, f"{work}/compacted")
    assert state(ST.current_state(spark, f"{work}/compacted")) == runs[-1]


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def test_plan_has_no_python_and_one_mail_shuffle(spark):
    plan = PL.process_emails(X.emails(spark, SMALL), X.responses(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning(rec_id") <= 4


@pytest.mark.parametrize("kind", ["int", "string", "boolean", "timestamp"])
def test_deep_pages(spark, kind):
    """Heavy ties, NULLs, both directions and every type, against a sort on the driver."""
    number = F.when(F.col("id") % 3 == 0, 50).when(F.col("id") % 41 == 0, None).otherwise(F.col("id") % 90).cast("int")
    value = {
        "int": number, "string": F.lpad(number.cast("string"), 3, "0"), "boolean": number % 2 == 0,
        "timestamp": F.timestamp_seconds(number),
    }[kind]
    df = spark.range(1000).select(value.alias("at"), ((F.col("id") * 7919) % 1000).alias("k")).cache()
    rows = [(r["at"], r.k) for r in df.collect()]
    for up in (True, False):
        known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[1])
        known.sort(key=lambda r: r[0], reverse=not up)
        empty = sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
        ordered = empty + known if up else known + empty
        for offset in (0, 17, 420, 985, 2000):
            page = ordered_page(df, [("at", up), ("k", True)], offset, 12)
            assert [(r["at"], r.k) for r in page.collect()] == ordered[offset : offset + 12], (up, offset)


def test_sinks(spark):
    work = shared_dir(spark, "test-sinks")
    rows = TB.upsert_cleaned(TB.empty_snapshot(batch(spark), F.expr(AT)), batch(spark, (1, "a", 1), (2, "b", 1)), F.expr(AT))
    TB.write_snapshot(rows, f"{work}/v1", clustered=True)
    assert state(spark.read.parquet(f"{work}/v1")) == state(rows)
    labelled = TB.append_reprocess(batch(spark), batch(spark, (1, "a", 1)), F.expr(AT))
    for _ in range(2):
        TB.write_history(labelled, f"{work}/history", "1")
    again = TB.append_reprocess(spark.read.parquet(f"{work}/history"), batch(spark, (1, "b", 1)), F.expr(AT))
    TB.write_history(again, f"{work}/history", "2")
    assert sorted(r.process_label for r in spark.read.parquet(f"{work}/history").collect()) == ["process1", "process2"]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_results_do_not_depend_on_ansi_mode(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(1, "{}"), (2, "[{}]"), (3, None)], "i int, payload string")
        assert [r.total for r in S.page_totals(df).orderBy("i").collect()] == [0, 1, 0]
        rows = PL.process_emails(X.emails(spark, SMALL), X.responses(spark, SMALL))
        assert rows.filter("summary is null or clean_text is null").count() == 0
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_null_text_is_tolerated(spark):
    df = spark.createDataFrame([(1, None)], "rec_id long, body_html string")
    from mailtables.operators import cleaning as C

    row = C.clean_emails(df).first()
    assert (row.clean_text, row.core, row.original_length, row.compression_ratio) == ("", "", 0, "100.00%")


def test_scans_push_filters_and_prune_columns(spark):
    path = f"{shared_dir(spark, 'test-scan')}/mails"
    X.emails(spark, SMALL).write.parquet(path)
    plan = S.lookup_source(S.scan_emails(spark, path), 42).select("rec_id", "subject")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(type,Tickets)" in plan and "EqualTo(rec_id,42)" in plan
    assert "body_html" not in plan[plan.index("ReadSchema") :]
    page = S.page_emails(S.scan_emails(spark, path), 1, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in page


def test_filters_do_not_repeat_the_cleaning(spark):
    from mailtables.operators import cleaning as C

    df = C.clean_emails(X.emails(spark, SMALL)).filter("length(clean_text) > 50 and core not like 'x%'")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Begin forwarded message:") == 1
