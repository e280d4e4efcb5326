"""Streaming queries on tables of several files, with rows of their own."""

import os

import pytest

from mailtables.plans import queries as Q
from mailtables.session import shared_dir
from mailtables.sources.manifest import Manifest


def documents(spark, rows):
    """``(doc_id, text, n_chars)`` as a ``documents`` table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de", f"src{i % 3}", n) for i, t, n in rows], schema)


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_tables_of_several_files(spark, files):
    sf_dir = shared_dir(spark, "test-tables")
    table = documents(spark, [(i, f"text {i}", 100 + i) for i in range(1, 13)])
    table.repartition(files).write.parquet(f"{sf_dir}/documents.parquet")
    assert {r.rec_id for r in Q.stream_clean(spark, sf_dir).collect()} == set(range(1, 13))
    # The later delivery of an English text has its source instead.
    rows = {r.req_id: r.core for r in Q.stream_upsert(spark, sf_dir).collect()}
    assert rows == {i: f"src{i % 3}" if i % 2 else f"text {i}" for i in range(1, 13)}


def test_levels_take_a_delivery_of_several_files_as_one_batch(spark, monkeypatch):
    sf_dir = shared_dir(spark, "test-tables")
    table = documents(spark, [(i, f"text {i}", 100 + i) for i in range(1, 41)])
    table.repartition(4).write.parquet(f"{sf_dir}/documents.parquet")
    added, add_run = [], Q.LV.add_run

    def noted(spark, path, rows, batch_id, fan):
        held = rows.inputFiles()
        added.append((batch_id, len(held), rows.count()))
        add_run(spark, path, rows, batch_id, fan)

    monkeypatch.setattr(Q.LV, "add_run", noted)
    rows = {r.req_id: r.core for r in Q.stream_upsert_levels(spark, sf_dir).collect()}
    assert rows == {i: f"5 text {i}" for i in range(1, 41)}
    assert [b for b, _, _ in added] == list(range(6))
    assert [n for _, _, n in added] == [sum(i % 6 <= k for i in range(1, 41)) for k in range(6)]


def test_levels_keep_only_what_is_still_needed(spark, monkeypatch):
    """A delivery goes once it is taken, merged runs and shuffle files once their micro-batch has ended."""
    sf_dir, seen, add_run = shared_dir(spark, "test-tables"), [], Q.LV.add_run
    documents(spark, [(i, f"text {i}", 100 + i) for i in range(1, 41)]).write.parquet(f"{sf_dir}/documents.parquet")

    def noted(session, path, rows, batch_id, fan):
        waiting = spark.read.parquet(f"{os.path.dirname(path)}/in").count()
        runs = [f for f in (os.listdir(path) if os.path.exists(path) else []) if f.startswith("level")]
        seen.append((path, waiting == rows.count(), len(runs), len(Manifest(spark, path).read())))
        add_run(session, path, rows, batch_id, fan)

    monkeypatch.setattr(Q.LV, "add_run", noted)
    rows = {r.req_id: r.core for r in Q.stream_upsert_levels(spark, sf_dir).collect()}
    assert rows == {i: f"5 text {i}" for i in range(1, 41)}
    assert all(alone and runs == live for _, alone, runs, live in seen)
    path = seen[0][0]
    assert sorted(f for f in os.listdir(path) if f.startswith("level")) == sorted(e["folder"] for e in Manifest(spark, path).read())
    assert not os.path.exists(f"{os.path.dirname(path)}/in")


def test_answers_are_written_by_more_than_three_tasks(spark, monkeypatch):
    sf_dir = shared_dir(spark, "test-tables")
    documents(spark, [(i, f"text {i} of some length", 100 + i) for i in range(1, 201)]).write.parquet(f"{sf_dir}/documents.parquet")
    spark.range(0).selectExpr("id as conv_id", "id as turn").write.parquet(f"{sf_dir}/conversations.parquet")
    limits, read_stream = [], Q.ST.read_stream

    def noted(spark, path, schema, files_per_batch=1000, **options):
        limits.append((files_per_batch, len(spark.read.parquet(path).inputFiles())))
        return read_stream(spark, path, schema, files_per_batch, **options)

    monkeypatch.setattr(Q.ST, "read_stream", noted)
    rows = Q.stream_answers(spark, sf_dir)
    good = {i for i in range(1, 201) if (100 + i) % 97}
    assert {r.req_id for r in rows.filter("table = 'emails_cleaned'").collect()} == good
    assert all(limit > 1 and files > 5 for limit, files in limits)
