"""Sharding, mixing, archives, packing, personal data and toxicity against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mailtables.llm import mixing, packing, pii, sharding, toxicity, warc

# ---- sharding --------------------------------------------------------------------------------


def test_slots_are_filled_evenly_and_stay_when_a_shard_leaves():
    shards = {f"s{i}": 1 + (i == 0) for i in range(10)}
    owner = sharding.fill(shards, 2039)
    counts = Counter(owner)
    assert set(counts) == set(shards) and max(counts.values()) - counts["s0"] <= 0
    assert max(counts[s] for s in shards if s != "s0") - min(counts[s] for s in shards if s != "s0") <= 1
    fewer = sharding.fill({s: w for s, w in shards.items() if s != "s4"}, 2039)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != "s4")
    assert moved < 0.25 * 2039
    with pytest.raises(ValueError):
        sharding.fill(shards, 2040)
    with pytest.raises(ValueError):
        sharding.fill({})


def test_place(spark):
    rows = [(i, "x") for i in range(300)] + [(None, "n"), (7, "x"), (7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, slot string")
    got = sharding.place(df, "doc_id", {1: 1, 2: 1, 3: 2}, 101).collect()
    owner = sharding.fill({1: 1, 2: 1, 3: 2}, 101)
    assert len(got) == len(rows)
    for r in got:
        text = "null key" if r.doc_id is None else str(r.doc_id)
        assert r.slot == sharding.number_of(text) % 101 and r.shard == owner[r.slot]
    odd = sharding.place(spark.createDataFrame([("", 1, 2)], "`a b` string, `_slot` int, `_row` int"), "a b", {"x": 1}, 3)
    assert odd.columns == ["a b", "_slot", "_row", "slot", "shard"] and odd.count() == 1
    assert sharding.place(df.limit(0), "doc_id", {1: 1}).isEmpty()


# ---- mixing ----------------------------------------------------------------------------------

WEIGHTS = {"domain": {"web": 3, "books": 1}, "lang": {"en": 2}, "source": {"a": 5, "b": 2}}


def fill_up(budget, children):
    """``{name: (weight, limit)}`` filled by weight; whoever is full leaves the rest to the others."""
    out, open_ = {}, sorted(children, key=lambda c: (children[c][1] / children[c][0], str(c) if c is not None else ""))
    while open_:
        total = sum(children[c][0] for c in open_)
        if children[open_[0]][1] <= budget * children[open_[0]][0] // total:
            out[open_[0]] = children[open_[0]][1]
            budget -= out[open_.pop(0)]
        else:
            out |= {c: min(children[c][1], budget * children[c][0] // total) for c in open_}
            break
    return out


def brute_mix(rows, permille, epochs, seed, whole=False):
    leaves = Counter()
    for k, d, l, s, n in rows:
        leaves[d, l, s] += n
    limit = {p: n * epochs for p, n in leaves.items()}
    budgets = {(): min(sum(leaves.values()) * permille // 1000, sum(limit.values()))}
    for depth, level in enumerate(mixing.LEVELS):
        nodes = defaultdict(Counter)
        for p, n in limit.items():
            nodes[p[:depth]][p[depth]] += n
        new = {}
        for parent, children in nodes.items():
            known = {c: (WEIGHTS[level].get(c, 1), n) for c, n in children.items()}
            new |= {(*parent, c): b for c, b in fill_up(budgets[parent], known).items()}
        budgets = new
    out = []
    for leaf, budget in budgets.items():
        mine = [r for r in rows if r[1:4] == leaf]
        for epoch in range(epochs + 1):
            order = sorted(mine, key=lambda r: hashlib.md5(f"{seed} {epoch} {r[0]}".encode()).hexdigest())
            for r in order:
                if leaves[leaf] and budget > 0 and epoch < epochs:
                    out.append((r[0], epoch, r[4] if whole else min(r[4], budget)))
                    budget -= r[4]
    return out


@pytest.mark.parametrize("permille,epochs,whole", [(500, 1, False), (1500, 3, False), (900, 1, True), (5000, 2, False), (0, 1, False)])
def test_mix(spark, permille, epochs, whole):
    rng = random.Random(permille)
    rows = []
    for i in range(400):
        d = rng.choice(["web", "web", "web", "books", "code"])
        rows.append((i, d, rng.choice(["en", "de"]), rng.choice("aaaab") if d != "code" else "c", rng.randrange(1, 90)))
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n long")
    got = mixing.mix(df, "doc_id", F.col("n"), F.col("domain"), WEIGHTS, permille, epochs, 3, whole)
    got = sorted((r._row.doc_id, r.epoch, r.taken) for r in got.collect())
    assert got == sorted(brute_mix(rows, permille, epochs, 3, whole))


def test_mix_of_odd_rows(spark):
    rows = [(1, None, None, 5), (1, None, None, 5), (None, None, None, 3), (2, "en", "a", 0), (3, "en", "a", None), (4, "en", "b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n long").withColumn("taken", F.lit(1))
    got = mixing.mix(df, "doc_id", F.col("n"), F.lit("d"), {}, 1000, 1).collect()
    assert sum(r.taken for r in got) == 20 and Counter(r._row.doc_id for r in got)[1] == 2
    assert mixing.mix(df.limit(0), "doc_id", F.col("n"), F.lit("d"), {}, 1000, 1).isEmpty()


# ---- archives --------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, error string")


def test_archives_round_trip(spark):
    rng = random.Random(1)
    long = ["".join(rng.choices("<p>é\r\n x", k=n)) for n in (99, 100, 101, 1000, 5000, 40_000)]
    rows = [(i, f"http://h/{i}", long[i % 6], None) for i in range(40)]
    rows += [(50, None, None, "e"), (51, "u\r\nv", "", "e"), (52, "u", "WARC/1.1\r\n\r\n0\r\n\r\n", "e"), (None, "u", long[3], "e"), (53, "u", long[0], "e"), (53, "u", long[0], "e")]
    archives = warc.write_archives(pages(spark, rows), segment=3000, archive=20_000)
    records = warc.read_records(archives)
    assert records.filter("segment > 1").count() > 10
    got = warc.reassemble(records).withColumn("key", warc.page_key("record_id")).collect()
    assert len(got) == len(rows) and not any(r.error for r in got)
    first = {}
    for k, _, html, _ in rows:
        if k is not None:
            first[html or ""] = min(first.get(html or "", k), k)
    by_key = defaultdict(list)
    for r in got:
        by_key[r.key].append(r)
    for k, _, html, _ in rows:
        raw = (html or "").encode()
        for r in by_key[k]:
            revisit = len(raw) >= 100 and k != first[html or ""]
            assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
            assert r.record_type == ("revisit" if revisit else "response")
            assert revisit or bytes(r.payload) == raw
    own = {r.record_id: r for r in got}
    assert all(own[r.refers_to].payload_digest == r.payload_digest for r in got if r.refers_to)
    resolved = warc.resolve(warc.reassemble(records))
    assert resolved.filter("error is not null").isEmpty() and resolved.count() == len(rows)
    lost = warc.resolve(warc.reassemble(records.filter("record_type = 'revisit'"))).collect()
    assert lost and all(r.error == "no response" for r in lost)
    other = F.when(F.col("record_type") == "revisit", "sha256:00").otherwise(F.col("digest"))
    wrong = warc.resolve(warc.reassemble(records.withColumn("digest", other))).filter("record_type = 'revisit'").collect()
    assert len(wrong) == len(lost) and all(r.error == "differs from its response" for r in wrong)
    payloads = {k: html or "" for k, _, html, _ in rows}
    assert all(int(r.refers_to.split(":")[2]) == first[payloads[r.key]] for r in got if r.refers_to)
    assert warc.reassemble(warc.read_records(warc.write_archives(pages(spark, [])))).isEmpty()


def test_archives_are_read_and_sent_few_at_a_time(spark, monkeypatch):
    """Neither a row group nor a batch for Python holds all archives that one task has written."""
    name, seen, stored = "spark.sql.execution.arrow.maxBytesPerBatch", [], warc.stored

    def noted(df, *options, **more):
        seen.append((options[0], int(spark.conf.get(name).rstrip("b"))))
        return stored(df, *options, **more)

    monkeypatch.setattr(warc, "stored", noted)
    before = spark.conf.get(name)
    rows = pages(spark, [(i, "u", f"{i} " + "x" * 3000, "") for i in range(40)]).coalesce(1)
    archives = warc.write_archives(rows, archive=9_000)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in archives.inputFiles()]
    held = [g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)]
    assert sum(held) > 10 and max(held) == 1
    assert warc.resolve(warc.reassemble(warc.read_records(archives))).filter("error is null").count() == 40
    assert [size for purpose, size in seen if purpose in ("archives", "pages")] == [4 << 20] * 2
    assert spark.conf.get(name) == before


def test_broken_segments(spark):
    html = "x" * 9000
    records = warc.read_records(warc.write_archives(pages(spark, [(1, "u", html, ""), (2, "v", html + "y", "")]), segment=2000))
    doubled = records.unionByName(records.filter("segment = 2"))
    assert warc.reassemble(doubled).filter("error is null").count() == 2
    lost = warc.reassemble(records.filter("segment <> 3 or origin_id like '%:2:%'")).collect()
    assert sorted(r.error or "" for r in lost) == ["", "segments are missing"]
    cut = records.withColumn("block", F.when(F.col("segment") == 2, F.expr("substring(block, 1, 10)")).otherwise(F.col("block")))
    assert all("bytes instead of" in r.error for r in warc.reassemble(cut).collect())
    wrong = records.withColumn("digest", F.lit("sha256:00"))
    assert all("digest" in r.error for r in warc.reassemble(wrong.filter("segment > 0")).collect() if r.error)


# ---- packing ---------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_and_bounds(seed):
    rng = np.random.default_rng(seed)
    room = 60
    sizes = np.sort(rng.integers(1, 60 if seed % 2 else 25, 200))[::-1]
    bins, places = packing.best_fit(sizes, room)
    for b in range(bins.max() + 1):
        mine = np.flatnonzero(bins == b)
        assert sizes[mine].sum() <= room
        assert places[mine].tolist() == [0, *np.cumsum(sizes[mine])[:-1].tolist()]
    bound = packing.lower_bound(sizes, room)
    assert -(-int(sizes.sum()) // room) <= bound <= bins.max() + 1
    assert packing.lower_bound(np.array([31] * 7), 60) == 7 and packing.lower_bound(np.array([21, 21, 21]), 60) == 2


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(1)
    words = ["alpha", "beta", "gamma", "é", "x-y", "42"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(300)]
    rows += [(900, "long " * 500), (901, None), (902, ""), (None, "no key"), (5, rows[5][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, uid int")
    got = packing.pack_documents(docs, path, length=64, items=50).toPandas()
    want = Counter()
    for k, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[k, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter((None if pd.isna(r[0]) else int(r[0]), *map(int, r[1:])) for r in got[columns].itertuples(index=False)) == want
    got = got.sort_values(["sequence_id", "offset"])
    assert ((got.groupby("sequence_id")["length"].cumsum() - got["length"]) == got["offset"]).all()
    filled = got.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 64 and len(filled) <= packing.lower_bound(got["length"].to_numpy(), 64) + 3
    assert packing.pack_documents(docs.limit(0), path).isEmpty()
    # Small tables are certified too, in two partitions or more.
    for items in (50, 20_000):
        packed = packing.pack_documents(docs, path, length=64, items=items).cache()
        proofs = packing.certificates(packed).collect()
        assert len({p.part for p in proofs if p.round == 1}) >= 2 and all(p.gap >= 0 and p.bound > 0 for p in proofs)
        kept = packed.filter("round is not null").groupBy("round", "part").agg(F.countDistinct("sequence_id").alias("n")).collect()
        assert all(k.n <= next(p.bins for p in proofs if (p.round, p.part) == (k["round"], k.part)) for k in kept)
        assert sum(p.gap for p in proofs) <= 3


# ---- personal data ---------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m.group() if c in "0123456789")
            if kind == "ip" and max(int(p) for p in m.group().split(".")) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(2)
    parts = ["a", "@", ".", "b-c", " ", "-", "1", "23", "255", "256", "+", "(", ")", "é", "\n", "4111111111111111", "4111-1111 1111-1111", "1.2.3.4", "x.y@z.io", "+1 (743) 555-3824", "0001.2.3.4"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(30)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_long_runs_take_linear_time():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1(" * 100_000, "12 " * 100_000):
        pii.candidates(run, pii.base_spans(run))


def test_every_labeler_proposes():
    found = lambda t: [t[a:b] for k, a, b in pii.candidates(t, pii.base_spans(t)) if k >= 4]
    assert found("123-45-6789 078-05-1120 219-09-9999") == ["123-45-6789", "078-05-1120", "219-09-9999"]
    assert found("iban DE89 3704 0044 0532 0130 00 now") == ["DE89 3704 0044 0532 0130 00"]
    assert found("DE89370400440532013000") == ["DE89370400440532013000"]
    assert found("call 555.123.4567.") == ["555.123.4567"]
    assert found("555 123 4567 555 987 6543") == ["555 123 4567", "555 987 6543"]
    assert found("no 12 123-45-6789 and 1234567") == ["123-45-6789", "1234567"]
    assert found("Here Maria Schmidt spoke") == ["Maria Schmidt"]
    assert found("My name is Kofi Mensah, Dr. Wei Chen") == ["Kofi Mensah", "Wei Chen"]
    assert found("1.2.3.4 and 12 34") == []


def test_numbers_in_runs_and_names_without_title_are_accepted(spark):
    rows = [(i, f"ssn 123-45-{1000 + i} 078-05-{1200 + i} 219-09-{9000 + i}; my name is Maria Schmidt") for i in range(60)]
    rows += [(100 + i, f"version {20_000_000 + i} of the page") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all(clean[i] == "ssn [NUMBER] [NUMBER] [NUMBER]; my name is [NAME]" for i in range(60))
    assert all(clean[100 + i] == rows[60 + i][1] for i in range(60))


def test_find_and_redact(spark):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(i, f"text {i} token = \"{secret[i % 9 :]}{secret[: i % 9]}\" and mail u{i}@mail.example.com é 192.168.0.{i}", "x") for i in range(40)]
    rows += [(100 + i, f"the article of version {i} ends here", "x") for i in range(40)] + [(200, None, "x"), (201, "", "x"), (None, "+1 (743) 555-3824", "x"), (3, "4111111111111111", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `found.x` string")
    got = {(r.doc_id, r.base_sha256): r for r in pii.find(docs).collect()}
    assert len(got) == len(rows) - 0
    for k, t, _ in rows:
        base = pii.written(brute_spans(t or ""))
        r = got[k, hashlib.sha256(base.encode()).hexdigest()]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(f"{b}:") for b in pii.BASE]
        assert ("secret:" in r.spans) == (t is not None and "token" in t)
        if k is not None and 100 <= k < 200:
            assert r.spans == ""
    clean = {(r.doc_id, r.text) for r in pii.redact(docs).collect()}
    assert (3, "[CARD]") in clean and (200, None) in clean and (None, "[PHONE]") in clean
    assert (1, "text 1 token = \"[SECRET]\" and mail [EMAIL] é [IP]") in clean
    assert pii.redact(docs).columns == docs.columns and pii.find(docs.limit(0)).isEmpty() and pii.redact(docs.limit(0)).isEmpty()


def test_labelers_are_weighed():
    # The third labeler is noise; the others agree.
    rng = np.random.default_rng(1)
    truth = rng.random(3000) < 0.4
    right = lambda p: np.where(rng.random(3000) < p, truth, ~truth) * 2 - 1
    vote = np.stack([right(0.9), right(0.85), right(0.5), right(0.8)], 1)
    p = pii.estimate(vote, np.full(3000, 4), np.ones(3000))
    assert ((p > 0.5) == truth).mean() > 0.93


# ---- toxicity --------------------------------------------------------------------------------


def test_grammar():
    score = toxicity.Scorer({"idiot": 4.0, "lost": 2.0})
    kinds = lambda t: {k for k, v in score(t).items() if v and k in toxicity.FEATURES[:5]}
    assert kinds("an idiotic plan") == {"plain"}
    assert kinds("you are an idiot") == {"at_target"}
    assert kinds("you are not an idiot") == {"negated"}
    assert kinds("not here. you idiot") == {"at_target"}
    assert kinds("he said the idiot left") == {"reported"}
    assert kinds('he read "idiot" aloud, you idiot') == {"reported", "at_target"}
    assert kinds("i will kill time") == set() and kinds("you i will kill") == {"threat"}
    assert kinds("exidiot") == set() and kinds("") == set()


def labelled(spark, n=600):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(["en", "the", "on", "er", "st", "re"], k=rng.randrange(1, 4))) for _ in range(80)]
        bad = i % 7 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(80)] = rng.choice(["Idiot,", "zorb" + rng.choice(["on", "er", "st", "re"])])
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(bad)))
    rows += [(10_000, "", 0.5), (10_001, None, 0.5), (10_002, "idiot " * 50_000, 0.5), (None, "fine", 0.5)]
    labels += [(None, 1), (10_000, None), (3, 0), (3, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learned_on_one_part_holds_on_the_other(spark):
    docs, labels = labelled(spark)
    stems, weights = model = toxicity.train(docs, labels)
    assert any(s.startswith("idio") for s in stems) and any(s.startswith("zorb") for s in stems) and len(stems) < 8
    got = toxicity.score(docs, model).collect()
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    assert all(r.predicted == (r.doc_id % 7 == 0) for r in got if r.held_out and r.doc_id < 10_000)
    assert {r.predicted for r in got if not r.text or r.doc_id is None} == {0}
    assert toxicity.score(docs.limit(0), model).isEmpty()


def test_rare_languages_are_learned_and_near_copies_count_once(spark):
    rng = random.Random(9)
    said = lambda parts: ["".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(60)]
    rows, labels, langs = [], [], {}
    parts = {"en": ["en", "the", "on", "er", "st", "re"], "es": ["cion", "que", "los", "ar", "do", "mi"]}
    for i in range(3600):
        # 12 of some 400 toxic texts are Spanish, with an insult of their own.
        lang = langs[i] = "es" if i < 60 else "en"
        words, bad = said(parts[lang]), i % 5 == 0 if lang == "es" else i % 9 == 0
        for at in rng.sample(range(60), 3) if bad else ():
            words[at] = "zurrapo" if lang == "es" else rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    copied = said(["qua", "vex", "jol", "wym"])
    for i in range(4000, 4030):
        rows.append((i, " ".join([*copied, "moron", "idiot", str(i)])))
        labels.append((i, 1))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    stems, _ = model = toxicity.train(docs, labels)
    assert {s[:3] for s in stems} == {"idi", "mor", "zur"}
    truth = dict(labels.collect())
    held = [r for r in toxicity.score(docs, model).collect() if r.held_out and r.doc_id < 4000]
    for lang in ("en", "es"):
        of = [r for r in held if langs[r.doc_id] == lang]
        recall = np.mean([r.predicted for r in of if truth[r.doc_id]])
        assert recall == 1 and not any(r.predicted for r in of if not truth[r.doc_id]), (lang, recall)


def test_no_labels(spark):
    docs, labels = labelled(spark, 10)
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0}
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs.limit(0), labels)).collect()} == {0}
