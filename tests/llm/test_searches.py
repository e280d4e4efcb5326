"""Ranked search and hard negatives against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from mailtables.llm import negatives, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute_ranks(docs, items, k=20):
    held = [(key, terms(t)) for key, t in docs if key is not None]
    n_all, l_all = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for key, c in held:
            m = 75 + 25 * c.total() * n_all // max(l_all, 1)
            score = sum(
                q * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, q in terms(text).items() if c[t]
            )
            found.append((-score, key))
        out += [(item, i + 1, key, -s) for i, (s, key) in enumerate(sorted(f for f in found if f[0] < 0)[:k])]
    return sorted(out)


def ranks(spark, docs, items, **options):
    d = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, term string, score int")
    i = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, rank int")
    got = ranked.search(d, i, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("seed, block, segment, short, span", [(1, 16_384, 1 << 24, 32, 1_024), (2, 64, 3_000, 8, 16), (3, 50, 900, 2, 7)])
def test_ranks(spark, monkeypatch, seed, block, segment, short, span):
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(ranked, "GROUP", 4)
    monkeypatch.setattr(ranked.walk, "__defaults__", (short, span))
    rng = random.Random(seed)
    word = lambda: rng.choice(["der", "Die", "das", "Ünd"] if rng.random() < 0.5 else ["w%d" % rng.randrange(90)])
    text = lambda n: "".join(word() + rng.choice([" ", "-", "\n", ". ", "\x00"]) for _ in range(n))
    docs = [(rng.randrange(-500, 10_000) * 3 + i % 3, text(rng.randrange(0, 60))) for i in range(300)]
    docs += [(20_000 + i, docs[7][1]) for i in range(40)] + [(None, "w1 w2"), (30_000, None), (30_001, "  --")]
    items = [(i, text(rng.randrange(1, 12))) for i in range(11)] + [(50, "w1 w1 W1 w2"), (51, None), (52, "none of these"), (53, "")]
    docs = list(dict(docs).items())
    assert ranks(spark, docs, items) == brute_ranks(docs, items)


def test_ranks_of_odd_tables(spark):
    assert ranks(spark, [], [(1, "a")]) == ranks(spark, [(1, "a")], []) == ranks(spark, [(1, ""), (2, None)], [(1, "a")]) == []
    docs = [(1, "a b"), (1, "a b"), (2, "b " * 3_000), (None, "a")]
    # Rows of one key are documents of their own; of items with one key the smallest text counts; NULL items find nothing.
    got = ranks(spark, docs, [(7, "b"), (7, "a"), (None, "a")])
    assert got == sorted(brute_ranks(docs, [(7, "a")]))


def test_segments_are_read_and_sent_one_at_a_time(spark, monkeypatch):
    """Neither a row group nor a batch for Python holds the segments of a block, however many there are."""
    import pyarrow.parquet as pq

    name, seen, stored = "spark.sql.execution.arrow.maxBytesPerBatch", [], ranked.stored

    def noted(df, purpose, **more):
        made = stored(df, purpose, **more)
        seen.append((purpose, int(spark.conf.get(name).rstrip("b")), made))
        return made

    monkeypatch.setattr(ranked, "stored", noted)
    monkeypatch.setattr(ranked, "SEGMENT_BYTES", 1_000)
    before = spark.conf.get(name)
    docs = [(i, f"w{i % 7} w{i % 11} common {'x' * (i % 50)}") for i in range(200)]
    items = [(1, "w3 common"), (2, "w5 w9")]
    assert ranks(spark, docs, items) == brute_ranks(docs, items)
    assert [(purpose, size) for purpose, size, _ in seen] == [("segments", 4 << 20), ("items", 4 << 20), ("best", 4 << 20)]
    held = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in seen[0][2].inputFiles()]
    held = [one.row_group(i).num_rows for one in held for i in range(one.num_row_groups)]
    assert sum(held) >= 8 and max(held) == 1
    assert spark.conf.get(name) == before


def test_segments_go_on_over_batches(spark, monkeypatch):
    """The size of a segment does not follow that of the batches."""
    docs = spark.createDataFrame([(i, f"w{i % 7} common") for i in range(100)], "doc_id long, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10)
        one = ranked.build_index(docs).collect()
        monkeypatch.setattr(ranked, "SEGMENT_BYTES", 300)
        several = ranked.build_index(docs).collect()
    finally:
        spark.conf.set(name, before)
    assert len(one) == 1 and len(one[0].ids) == 800 and sorted(one[0].dfs)[-1] == 100 and len(one[0].terms) == 8
    assert 3 <= len(several) <= 6 and sum(r.n_docs for r in several) == 100
    assert sum(r.n_terms for r in several) == one[0].n_terms == 200


def test_passing_over():
    """Long lists are not read where their bounds cannot reach the entry score."""
    n = 4_000
    texts = ["common " + ("rare " if i < 30 else "") + "x%d" % i for i in range(n)]
    import pyarrow as pa

    hashes, owner = ranked.tokens(pa.array(texts))
    names, dfs, docs, tfs = ranked.postings(hashes, owner, n)
    row = {"ids": np.arange(n).astype("<i8").tobytes(), "lengths": np.bincount(owner).astype("<i8").tobytes(), "terms": names.view(np.int64),
           "dfs": dfs, "docs": docs.astype("<u4").tobytes(), "tfs": tfs.astype("<u4").tobytes()}
    asked = np.unique(ranked.tokens(pa.array(["common rare"]))[0])
    lists = ranked.Lists(row, asked, n, len(hashes))
    weights = np.where(np.diff(lists.start) == n, 10, 4_000)
    best = ranked.Best(20)
    scored = ranked.walk(lists, np.arange(2), weights, best, span=64)
    assert scored < 200 and list(best.ids) == list(range(20))


def brute_negatives(rows, every=100, scale=256):
    good = {}
    for key, vector, label in rows:
        if None in (key, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if key % 7 == 0 else label
        good[key] = min(good.get(key, (label, [])) if key in good else (label, [math.floor(scale * x) for x in vector]),
                        (label, [math.floor(scale * x) for x in vector]))
    out = []
    for a, (label, v) in good.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), k, one) for k, (one, w) in good.items() if k != a and len(w) == len(v)]
        scored.sort()
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            fit = [(k, -t) for t, k, one in scored if one != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, i + 1, k, -s, t) for i, (k, t) in enumerate(fit[:10])]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(k, v, c, 1, "x") for k, v, c in rows], "vec_id long, embedding array<double>, label int, dim int, block string")
    got = negatives.mine(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("seed, block, group", [(1, 4_096, 256), (2, 40, 3)])
def test_negatives(spark, monkeypatch, seed, block, group):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GROUP", group)
    rng = random.Random(seed)
    vector = lambda n, size=1.0: [rng.uniform(-size, size) for _ in range(n)]
    rows = []
    for k in range(700):
        n = rng.choice([12, 12, 12, 3, 0])
        rows.append((k, vector(n, 40.0 if rng.random() < 0.05 else 1.0), 3 if rng.random() < 0.4 else rng.randrange(10)))
    # Ties, repeated rows and rows that take no part.
    rows += [(700 + i, rows[0][1], i % 10) for i in range(60)] + rows[5:9] + [(-100, rows[1][1], 4)]
    rows += [(None, vector(12), 1), (2_000, None, 1), (2_100, [1.0, None], 1), (2_200, [float("nan")] * 12, 1), (2_300, vector(12), None)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_of_small_tables(spark):
    assert mined(spark, []) == [] == mined(spark, [(0, [1.0], 1)])
    rows = [(100, [1.0] * 9, 1), (1, [1.0] * 9, 1), (2, [0.5] * 9, 2)]
    assert mined(spark, rows) == brute_negatives(rows) != []


def test_scores_of_wide_numbers():
    rng = np.random.default_rng(5)
    m, a = rng.integers(-(10**6), 10**6, (90, 19)), rng.integers(-(10**6), 10**6, (70, 19))
    assert (negatives.scores(negatives.bit_planes(m), a) == m @ a.T).all()
