"""Repeated passages against a direct search for strings seen before."""

import hashlib
import random

import numpy as np
import pytest

from mailtables.llm import suffixes


def brute(rows, length=100):
    """``rows``: (key, text) in order; NULL keys last, rows of one key in the order given."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            one = data[p : p + length]
            if one in seen:
                gone[p : p + length] = [True] * length
            seen.add(one)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n, letters="abcdefghij  "):
    rng = random.Random(seed)
    make = lambda size: "".join(rng.choice(letters) for _ in range(size))
    passage, line, texts = make(170), make(130), []
    for i in range(n):
        text = make(rng.randrange(0, 900))
        if i and rng.random() < 0.5:
            text = rng.choice(texts)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(text) + 1)
                text = text[:at] + make(rng.randrange(0, 5)) + text[at + rng.randrange(0, 3) :]
        if rng.random() < 0.4:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + passage + text[at:]
        if rng.random() < 0.2:
            text += line * rng.randrange(1, 4)
        if rng.random() < 0.1:
            text += rng.choice(["a" * 350, "ab" * 200, "é" * 150, "xyz " * 90])
        texts.append(text)
    return texts


def check(spark, rows):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, chunk int, bucket string")
    got = suffixes.remove_repeats(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("seed, chunk, piece", [(1, 1 << 23, 1 << 22), (2, 2_000, 600), (3, 700, 250)])
def test_against_search(spark, monkeypatch, seed, chunk, piece):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    monkeypatch.setattr(suffixes, "BUCKET", 5_000)
    monkeypatch.setattr(suffixes, "VARIANTS", 2 if seed == 3 else 8)
    monkeypatch.setattr(suffixes, "MANY", 3 if seed == 2 else 1_000)
    monkeypatch.setattr(suffixes, "BATCH", 1_000 * seed)
    texts = corpus(seed, 120)
    keys = random.Random(seed).sample(range(-50, 500), len(texts))
    check(spark, list(zip(keys, texts)))


def test_odd_rows(spark):
    same = corpus(4, 1)[0] + "z" * 300
    check(spark, [(3, None), (2, ""), (1, same), (None, same), (5, same), (5, same), (-9, same[:99]), (7, "a" * 100), (8, "a" * 101)])
    check(spark, [])


def test_order_of_windows():
    """Dictionary and parse give the order of the windows' bytes."""
    texts = [t.encode() for t in corpus(5, 60)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    found = suffixes.phrases(data, starts, ends)
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(found["low"], found["high"])])
    assert sorted(windows) == [p for a, b in zip(starts, ends) for p in range(a, b - 99)]
    raw = data.tobytes()
    read = [raw[p : p + 100] for p in windows[suffixes.corpus_order(data, ends, windows)]]
    assert read == sorted(read)
