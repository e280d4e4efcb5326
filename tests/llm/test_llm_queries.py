"""The registered queries of the folder, on whole small tables."""

import hashlib
import zlib
from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from compare import connect, difference, duck_rows, spark_rows
from conftest import SMALL
from test_pairs import brute_components
from test_rows import brute_spans

from mailtables.llm import pii, toxicity
from mailtables.llm.oracles import SQL
from mailtables.llm.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("select doc_id, text, lang, source from documents order by doc_id").fetchall()


def rows_of(spark, name):
    return entry.queries()[name](spark, SMALL).collect()


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, duck):
    ours = spark_rows(entry.queries()[name](spark, SMALL))
    assert ours[1]
    assert difference(ours, duck_rows(duck, SQL[name])) is None


def plain_ids(name, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, documents):
    ids, at, want = plain_ids("byte_bpe_50k.json", 2), 0, []
    for k, text, *_ in documents:
        one = ids(text)
        want.append((k, at, len(one), zlib.crc32(one.tobytes())))
        at += len(one)
    assert sorted(tuple(r) for r in rows_of(spark, "op5_token_files")) == want


def test_packing(spark, documents):
    check_packing(rows_of(spark, "op10_packing"), [(k, t) for k, t, *_ in documents])


def check_packing(rows, documents):
    ids, want = plain_ids("word_bpe_49k.json", 0), Counter()
    for k, text in documents:
        one = ids(text)
        for piece, at in enumerate(range(0, len(one), 2048)):
            part = one[at : at + 2048]
            want[k, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    filled, total = {}, 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
        total += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= 1.01 * -(-total // 2048) + 1


def test_personal_data(spark, documents):
    got = {r.doc_id: r for r in rows_of(spark, "op8_personal_data")}
    assert len(got) == len(documents)
    for k, text, *_ in documents:
        base = pii.written(brute_spans(text or ""))
        assert got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[k].spans.split(","))


def test_toxicity_on_held_out_labels(spark, duck):
    small = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in entry.queries()["op9_toxicity"](spark, small).collect()}
    labels = connect(small).execute("select doc_id, toxic from labels").fetchall()
    held = [(got[k], y) for k, y in labels if k in got and got[k].held_out]
    assert np.mean([r.predicted == y for r, y in held]) > 0.9
    assert np.mean([r.predicted for r, y in held if y == 0]) < 0.02


def test_near_copies_are_told_apart_by_row(spark):
    words = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, words("a")), (5, words("a") + " more"), (5, words("b")), (5, words("b")), (7, words("c")), (7, None),
            (8, words("b")), (None, words("a")), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()
    assert Counter(map(tuple, got)) == Counter([rows[i] for i in (0, 2, 4, 5, 7, 8)])


def test_pipeline(spark, documents, duck):
    """Every stage on what the one before has kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SMALL).cache()
    assert clean.columns == names
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert set(kept) == {k for k, *_ in documents} - rejected
    single = stages["near_copies"](spark, clean, SMALL).cache()
    assert single.columns == names
    firsts = sorted(c for k, _, c in brute_components(list(kept.items())) if k == c)
    assert sorted(r.doc_id for r in single.collect()) == firsts
    safe = stages["personal_data"](spark, single, SMALL).cache()
    assert safe.columns == names and safe.schema == docs.schema
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert sorted(texts) == firsts and not any(brute_spans(t or "") for t in texts.values())
    for k, t in texts.items():
        assert t == kept[k] or brute_spans(kept[k]) or "token" in kept[k]
    mixed = stages["mixing"](spark, safe, SMALL).cache()
    assert mixed.columns == names
    chosen = {r.doc_id: r.text for r in mixed.collect()}
    assert set(chosen) <= set(texts) and all(texts[k] == t for k, t in chosen.items())
    words = lambda t: len((t or "").split())
    share = sum(map(words, chosen.values())) / sum(map(words, texts.values()))
    assert 0.85 < share < 1
    check_packing(stages["packing"](spark, mixed, SMALL).collect(), list(chosen.items()))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_any_table(spark, stage):
    """Clashing names, NULLs, repeated rows, no n_chars, and no rows at all."""
    words = lambda c: " ".join(f"{c}{i}" for i in range(60))
    texts = [(1, words("a")), (2, words("a")), (2, words("b")), (2, words("b")), (None, words("c")), (4, None), (5, ""), (6, "mail me: x@example.org")]
    more = ["_at", "_kept", "_chosen", "_row", "row", "place", "c0", "0", "c1", "predicted", "chosen", "uid", "length", "part", "_hash"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in more)
    rows = [(k, t, None if k == 5 else "en", f"src{i}", *[f"{n}{i}" for n in more]) for i, (k, t) in enumerate(texts)]
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame(rows, schema)
    got = run(spark, docs, SMALL)
    if stage == "packing":
        assert sorted((r.doc_id or 0) for r in got.collect()) == sorted((k or 0) for k, _ in texts)
    else:
        assert got.columns == docs.columns
        for r in got.collect():
            i = int(r["_at"][3:])
            # Whatever a stage decides, a row's own values come with it.
            assert tuple(r)[2:] == rows[i][2:] and (stage == "personal_data" or tuple(r) == rows[i])
    assert run(spark, docs.limit(0), SMALL).isEmpty()
