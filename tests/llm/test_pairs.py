"""Jaccard join, components, quality rules and top-k search against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from test_words import WORD, brute_set, texts

from mailtables.llm import jaccard, quality, topk
from mailtables.llm.components import components


def brute_components(rows):
    sets = [(k, brute_set(t or "")) for k, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            (a, x), (b, y) = sets[i], sets[j]
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, s) in enumerate(sets):
        groups.setdefault(find(i), []).append(k)
    return sorted(
        ((k, len(s), None if k is None else min(x for x in groups[find(i)] if x is not None)) for i, (k, s) in enumerate(sets)),
        key=repr,
    )


def corpus(seed, n_bases, copies):
    """Bases with copies at distances around the limit, chains of copies, and a passage shared by all."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    passage = [word() for _ in range(30)]
    made = []
    for _ in range(n_bases):
        base = [word() for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, copies)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 14)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                base = copy
            made.append(" ".join(copy + (passage if rng.random() < 0.4 else [])))
    return made


def same(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, 9, "x") for k, t in rows], "doc_id long, text string, c int, root string")
    got = jaccard.link(docs, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_components(rows)


def test_join_of_one_large_group(spark, monkeypatch):
    # Frequent shingles are found in small blocks and dealt over several groups.
    monkeypatch.setattr(jaccard, "HOT", 20)
    monkeypatch.setattr(jaccard, "HEAVY_BLOCK", 3000)
    same(spark, list(enumerate(corpus(5, 2, 150))))


def test_join_matches_brute_force(spark):
    given = corpus(1, 60, 9) + texts(4, 30)
    random.Random(1).shuffle(given)
    rows = list(enumerate(given))
    rows += [(5, "a b"), (5, "a b"), (None, "a b"), (9990, None), (9991, None), (9992, "x " * 20_000), (9993, "X " * 20_000)]
    same(spark, rows)
    assert jaccard.link(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(200, 260)] + [(0, i) for i in range(1, 90)] + [(7, 7)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    near = {x: {x} for x in got}
    for a, b in links:
        if a != b:
            joined = near[a] | near[b]
            for x in joined:
                near[x] = joined
    for x in got:
        assert {y for y in got if got[y] == got[x]} == near[x]


# ---- quality rules ---------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    rng = random.Random(2)
    given = [*texts(6), None, "a b c\na b c\n a b c\n\na b c", "#*$ %&| <> x" * 50, "a\n\na\n \na \n"]
    given += ["\n".join("".join(rng.choices("ab  é#", k=6)) for _ in range(rng.randrange(30))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "h", 1) for i, t in enumerate(given)], "doc_id long, text string, source string, kept int")
    got = {r[0]: tuple(r)[2:8] for r in quality.judge(docs).collect()}
    for i, t in enumerate(given):
        n = brute_counts(t)
        assert got[i] == (*n, n[0] < 50 or 100 * n[4] > 50 * n[0]), t


def test_hosts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [("good", good)] * 200 + [("good", "short")] * 10 + [("bad", "short")] * 95 + [("bad", good)] * 5
    rows += [("tiny", "short"), ("tiny", good), (None, good), (None, None)]
    docs = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50)
        # A document of a host that mostly fails goes; one failure of two says little about a host.
        assert r.kept == (not r.base_failed and r.source != "bad")
    assert quality.judge(docs.limit(0)).isEmpty()


@pytest.mark.parametrize("line", ["#*$%&|<>", "word word", "x", "averyveryverylongword"])
def test_every_rule_can_reject_a_host(spark, line):
    """Symbols, repeated lines, short and long words: the counts decide, though no document fails the base rules."""
    fine = lambda i: " ".join(f"word{i}x{j}" for j in range(80))
    odd = {
        "#*$%&|<>": lambda i: fine(i) + " " + "#" * 20, "word word": lambda i: fine(i) + "\n{}\n{}\n{}\n{}\n{}\n{}".format(*["same"] * 6),
        "x": lambda i: " ".join(chr(97 + (i * j + j * j // 7) % 26) for j in range(90)),
        "averyveryverylongword": lambda i: " ".join(f"averyveryverylong{i}x{j}" for j in range(80)),
    }[line]
    rows = [("good", fine(i)) for i in range(120)] + [("odd", odd(i)) for i in range(60)]
    docs = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = quality.judge(docs).collect()
    assert {(r.source, r.kept) for r in got if not r.base_failed} == {("good", True), ("odd", False)}
    assert sum(not r.base_failed for r in got if r.source == "odd") > 30


def test_prior_is_kept_between_hosts_that_do_not_differ(spark):
    hosts = spark.createDataFrame([(str(i), 100, 10) for i in range(8)], "host string, n_docs long, n_failed long")
    alpha, beta = quality.prior(hosts)
    assert alpha / (alpha + beta) == pytest.approx(0.1) and alpha + beta > 1e5


# ---- top-k -----------------------------------------------------------------------------------


def brute_topk(rows, every, k):
    vectors = {}
    for key, v in rows:
        if key is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(float(np.float32(x)) * 64)) for x in v]
        vectors[key] = min(vectors.get(key, w), w)
    out = []
    for q in sorted(vectors):
        if q % every == 0:
            scored = sorted(
                (-sum(a * b for a, b in zip(vectors[q], v)), key)
                for key, v in vectors.items() if key != q and len(v) == len(vectors[q])
            )
            out += [(q, n, key, -s) for n, (s, key) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("block", [7, 16_384])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(60)]  # a frequent vector, so many ties
    rows += [(300, None), (320, [1.0, None] * 4), (340, [float("nan")] * 8), (360, [float("inf")] * 8), (None, rows[0][1])]
    rows += [(20, rows[3][1]), (20, rows[3][1]), (400, [1.0, 2.0]), (401, [0.5, -2.0]), (420, []), (421, []), (440, [1e5] * 8)]
    df = spark.createDataFrame([(a, v, 1, 2) for a, v in rows], "vec_id long, embedding array<float>, dim int, block int")
    got = sorted(tuple(r) for r in topk.search(df, k=20).collect())
    assert got == sorted(brute_topk(rows, 20, 20))
    assert topk.search(df.limit(0)).isEmpty()


# ---- what of a pair travels ------------------------------------------------------------------


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 3000, 90).tolist() + [1, 90_000, 80_000]
    pool = rng.integers(0, 2**64, 100_000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, k)) for k in sizes]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    rows = jaccard.sketch(np.concatenate(sets), at)
    n = np.diff(at)
    for i in range(len(sets)):
        x, m = np.repeat(rows[i : i + 1], len(sets), 0), np.repeat(n[i], len(sets))
        most = jaccard.most_common(x, rows, m, n)
        assert all(len(np.intersect1d(sets[i], s)) <= k <= min(len(sets[i]), len(s)) for s, k in zip(sets, most.tolist()))
        assert most[i] == n[i]
    assert jaccard.sketch(np.zeros(0, np.uint64), np.array([0, 0])).tolist() == [[0] * jaccard.SKETCH]


def test_texts_that_share_a_passage_only_do_not_travel(spark, monkeypatch):
    rng = random.Random(8)
    passage = " ".join("p%d" % i for i in range(60))
    fresh = lambda: " ".join("w%d" % rng.randrange(10**6) for _ in range(150))
    rows = [(i, f"{fresh()} {passage}") for i in range(30)]
    rows += [(100 + i, t + " end") for i, t in rows[:5]]
    tables = {}
    monkeypatch.setattr(jaccard, "stored", lambda df, purpose, keep=jaccard.stored: tables.setdefault(purpose, []).append(keep(df, purpose)) or tables[purpose][-1])
    same(spark, rows)
    wanted = [r.doc_id for t in tables["wanted"] for r in t.collect()]
    assert len(wanted) <= 2 * 5 and {d % 100 for d in wanted} <= set(range(5))
