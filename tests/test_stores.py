"""Stores that are switched by a manifest: reply log, bucketed snapshot, ranked pages, levels; bounded streams."""

import os
import random

import pytest
from pyspark.sql import functions as F

from mailtables.operators import replylog as L
from mailtables.operators.keyed import latest_of_repeated, latest_per_key
from mailtables.session import shared_dir
from mailtables.sources import buckets as B, pages as PG, tables as TB
from mailtables.sources.manifest import Manifest
from mailtables.streaming import deduplicate as DD, levels as LV, streams as ST

AT, LATER = "timestamp_ntz'2024-01-01 00:00:00'", "timestamp_ntz'2024-02-01 00:00:00'"
KINDS = {"translated": "boolean", "requires_human_review": "boolean", "processing_time_ms": "int"}


def storage(df):
    return df.select("*", *[F.lit(None).cast(KINDS.get(c, "string")).alias(c) for c in TB.VALUES if c != "core"])


def rows_of(spark, keys, core, arrival=1):
    return storage(spark.createDataFrame([(k, core, arrival) for k in keys], "req_id long, core string, arrival int"))


def test_manifest_switches_whole_versions(spark):
    path = shared_dir(spark, "manifest")
    m = Manifest(spark, path)
    assert m.read() == [] and m.version() == -1
    m.commit([{"folder": "a"}])
    m.commit([{"folder": "b", "n": 1}])
    os.makedirs(f"{path}/a"), os.makedirs(f"{path}/b")
    # A draft that was never renamed does not count.
    open(f"{path}/_manifest/_2", "w").close()
    assert Manifest(spark, path).read() == [{"folder": "b", "n": 1}] and m.sweep() == ["a"]


def test_equal_requests_are_asked_once_and_a_killed_run_goes_on(spark):
    path, calls = shared_dir(spark, "log"), shared_dir(spark, "calls")
    os.makedirs(calls)
    prompts = spark.createDataFrame([(i, "k", None if i == 99 else f"p{i % 10}") for i in range(100)], "rec_id int, kind string, prompt string")

    def model(broken):
        def reply(texts):
            for t in texts:
                open(f"{calls}/{t}", "a").write("x")
            if broken and "p7" in texts:
                os._exit(1)
            return [{"reply": t.upper(), "in_tokens": 1, "out_tokens": 1, "latency_ms": 1} for t in texts]

        return reply

    with pytest.raises(Exception):
        L.ask(prompts, model(True), path, part_rows=2, batch_size=1)
    done = {r.reply for r in L.known_replies(spark, path).collect()}
    rows = L.ask(prompts, model(False), path, part_rows=2, batch_size=1).collect()
    assert {(r.rec_id, r.reply) for r in rows} == {(i, None if i == 99 else f"P{i % 10}") for i in range(100)}
    for reply in done:
        # What a finished part holds was asked by the first run alone, and once for ten rows.
        assert open(f"{calls}/{reply.lower()}").read() == "x"
    before = {f: os.path.getsize(f"{calls}/{f}") for f in os.listdir(calls)}
    L.ask(prompts, model(True), path).collect()
    assert {f: os.path.getsize(f"{calls}/{f}") for f in os.listdir(calls)} == before
    assert [tuple(r) for r in L.provider_totals(spark, path).collect()] == [("k", 10, 10, 0, 10, 10)]


def test_an_upsert_writes_only_the_buckets_it_touches(spark):
    path = f"{shared_dir(spark, 'buckets')}/t"
    run = F.expr(AT)
    assert len(B.upsert_buckets(path, rows_of(spark, range(3000), "old"), run, buckets=64)) == 64
    before = {e["bucket"]: e["folder"] for e in Manifest(spark, path).read()}
    few = rows_of(spark, [5, 6, 5000], "new").unionByName(rows_of(spark, [5], "newest", 2))
    touched = B.upsert_buckets(path, few, F.expr(LATER))
    after = {e["bucket"]: e["folder"] for e in Manifest(spark, path).read()}
    assert 1 <= len(touched) <= 3 and {b for b in after if after[b] != before.get(b)} == set(touched)
    schema = few.select("req_id", *TB.VALUES, run.alias("created_at")).schema
    table = {r.req_id: (r.core, str(r.created_at)) for r in B.read_buckets(spark, path, schema).collect()}
    assert len(table) == 3001 and table[5] == ("newest", "2024-01-01 00:00:00") and table[5000] == ("new", "2024-02-01 00:00:00")
    assert table[7] == ("old", "2024-01-01 00:00:00")
    assert B.upsert_buckets(path, few.limit(0), run) == [] and len(Manifest(spark, path).read()) == 64


def test_a_page_opens_the_files_that_hold_it(spark):
    rows = [(i, f"s{i * 7 % 1000:04d}" if i % 50 else None) for i in range(1000)] + [(1, "s0007")] * 5
    df = spark.createDataFrame(rows, "k int, s string")
    for order in ([("s", False), ("k", True)], [("s", True), ("k", False)]):
        path = f"{shared_dir(spark, 'ranked')}/t"
        PG.write_ranked(df, path, order, files=10)
        up = dict(order)
        want = sorted(rows, key=lambda r: r[0] if up["k"] else -r[0])
        want = sorted(want, key=lambda r: (r[1] is not None, r[1] or ""), reverse=not up["s"])
        for offset, limit in ((0, 20), (333, 40), (990, 100), (5000, 5)):
            page = PG.ranked_page(spark, path, order, offset, limit)
            assert [tuple(r) for r in page.collect()] == want[offset : offset + limit]
        parts = {f.split("/")[-2] for f in os.popen(f"ls {path}/rows/*/*.parquet").read().split()}
        plan = PG.ranked_page(spark, path, order, 333, 40)._jdf.queryExecution().executedPlan().toString()
        assert len(parts) == 10 and "PartitionFilters: [_range" in plan and plan.count("_range#") and "IN (" in plan or " = " in plan


def test_levels_stay_few_and_a_restart_changes_nothing(spark, monkeypatch):
    path, live = shared_dir(spark, "levels"), []
    for batch in range(30):
        rows = spark.createDataFrame([(k, f"b{batch}") for k in range(batch % 3, 20, 3)], "req_id long, core string")
        rows = rows.withColumn("created_at", F.expr(AT) + F.expr(f"interval {batch} days"))
        if batch == 15:
            # The merge is cut off after its folder, before the switch.
            with monkeypatch.context() as m:
                m.setattr(Manifest, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
                with pytest.raises(RuntimeError):
                    LV.add_run(spark, path, rows, batch, fan=4)
        LV.add_run(spark, path, rows, batch, fan=4)
        LV.add_run(spark, path, rows, batch, fan=4)
        live.append(len(Manifest(spark, path).read()))
    assert max(live) <= 3 * 3
    table = {r.req_id: (r.core, r.created_at.day) for r in LV.current_levels(spark, path).collect()}
    assert table == {k: (f"b{27 + k % 3}", 1 + k % 3) for k in range(20)}
    Manifest(spark, path).sweep()
    assert len([f for f in os.listdir(path) if f.startswith("level")]) == live[-1]
    assert LV.current_levels(spark, path).count() == 20


@pytest.mark.parametrize("fan", [2, 3])
def test_levels_merge_in_one_step_and_leave_new_rows_where_they_are(spark, fan):
    path, rng, want = shared_dir(spark, "levels"), random.Random(fan), {}
    for batch in range(9):
        keys = rng.sample([*range(12), None], rng.randrange(0, 9))
        got = [(k, rng.choice([None, f"b{batch}"])) for k in keys]
        rows = spark.createDataFrame(got, "req_id long, core string")
        rows = rows.withColumn("created_at", F.expr(AT) + F.expr(f"interval {batch} days"))
        LV.add_run(spark, path, rows, batch, fan=fan)
        want |= {k: (core, want[k][1] if k in want else 1 + batch) for k, core in got}
        assert sorted(((r.req_id, r.core, r.created_at.day) for r in LV.current_levels(spark, path).collect()), key=str) == sorted(
            ((k, *v) for k, v in want.items()), key=str)
    # No run was written only to be merged.
    written = {2: {"0-0-0", "1-0-1", "0-2-2", "2-0-3", "0-4-4", "1-4-5", "0-6-6", "3-0-7", "0-8-8"},
               3: {"0-0-0", "0-1-1", "1-0-2", "0-3-3", "0-4-4", "1-3-5", "0-6-6", "0-7-7", "2-0-8"}}
    assert {f for f in os.listdir(path) if f.startswith("level")} == {f"level-{w}" for w in written[fan]}
    whole = spark.read.parquet(f"{path}/level-0-0-0")
    plan = LV.merged_rows(whole, whole)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_only_rows_of_repeated_keys_are_shuffled(spark):
    rows = [(k, n % 3, f"{k} {n}") for n in range(4) for k in (1, 2, None) if n < 3 or k == 1] + [(k, 0, "alone") for k in range(10, 40)]
    df = spark.createDataFrame(rows, "req_id long, arrival long, core string")
    want = sorted(map(str, latest_per_key(df, "req_id", "arrival").collect()))
    assert len(want) == 33
    for few in (100, 3, 1):
        assert sorted(map(str, latest_of_repeated(df, "req_id", "arrival", few=few).collect())) == want
    alone = latest_of_repeated(df.filter("core = 'alone'"), "req_id", "arrival")
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString() and alone.count() == 30


def test_bounded_state_loses_no_late_delivery(spark):
    work = shared_dir(spark, "bounded")
    schema = "rec_id long, ts timestamp, word string"
    for i in range(12):
        # Two hundred keys a file, each twice; and one delivery that is days late.
        rows = [(i * 200 + k % 200, f"2024-01-{i + 1:02d} 00:00:{k % 60:02d}", "w") for k in range(400)]
        rows += [(10_000 + i, "2023-12-01 00:00:00", "late"), (i * 200, "2023-11-01 00:00:00", "w")]
        df = spark.createDataFrame(rows, "rec_id long, ts string, word string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"{work}/in")
    query = DD.stream_dedup_bounded(lambda: ST.read_stream(spark, f"{work}/in", df.schema, files_per_batch=1), work, f"{work}/check", "rec_id", "ts", "1 hour")
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(states) >= 12 and max(states) <= 2 * 202
    got = [(r.rec_id, r.word) for r in DD.complete(spark, work, schema, "rec_id").collect()]
    assert sorted(got) == sorted([(k, "w") for k in range(2400)] + [(10_000 + i, "late") for i in range(12)])
