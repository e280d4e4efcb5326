"""Quality rules of documents and of the hosts they come from."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, fields, stored
from .words import Words, _BASE, _PLAIN, _power, mix, pieces

SYMBOLS = b"#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_text(marks, rows):
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[rows[1:]] - total[rows[:-1]]


def _seen_before(text, value):
    """Which rows repeat an earlier (text, value), and which have any equal row in their text."""
    order = np.lexsort((value, text))
    t, v = text[order], value[order]
    same = np.zeros(len(order), bool)
    same[1:] = (t[1:] == t[:-1]) & (v[1:] == v[:-1])
    again = np.zeros(len(order), bool)
    again[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    shared = np.zeros(len(order), bool)
    shared[order] = both
    return again, shared


def count_rules(data, rows) -> dict:
    """The counts of a run of texts, see ``document_counts``."""
    words = Words(data, rows)
    n = len(rows) - 1
    visible = np.zeros(len(data) + 1, np.int64)
    np.add.at(visible, words.start, 1)
    np.add.at(visible, words.end, -1)
    in_word = np.cumsum(visible[:-1]) > 0
    # Lines: cut at line feeds and where a text ends.
    feeds = np.flatnonzero(data == 10)
    start = np.union1d(rows[:-1], feeds + 1)
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    end = end - (data[np.maximum(end, 1) - 1] == 10) * (end > start)
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[has_word], end[has_word]
    power = _power(_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_PLAIN[data] * power[: len(data)], out=total[1:])
    inverse = _power(pow(_BASE, -1, 1 << 64), len(data) + 1)
    line = mix((total[end] - total[start]) * inverse[start])
    line_text = np.searchsorted(rows, start, "right") - 1
    again, _ = _seen_before(line_text, line)
    window, window_text, at = words.windows(3)
    _, shared = _seen_before(window_text, window)
    covered = np.zeros(len(words.hash) + 2, bool)
    for k in range(3):
        covered[at[shared] + k] = True
    return {
        "n_words": words.count, "word_chars": _per_text(in_word & ((data & 0xC0) != 0x80), rows),
        "n_symbols": _per_text(_SYMBOL[data], rows), "n_dup_lines": np.bincount(line_text[again], minlength=n),
        "n_repeat_words": _per_text(covered[:-2], words.first),
    }


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with the counts that its rules use.

    ``n_words``; ``word_chars``, code points in words; ``n_symbols``; ``n_dup_lines``, lines with a word
    that equal an earlier line; ``n_repeat_words``, words in windows of three that occur twice or more
    in the text. NULL and empty texts have zeros. Columns named like a count are replaced.
    """
    names = [c.split()[0] for c in COUNTS.split(", ")]
    kept = [f for f in docs.schema if f.name != text and f.name not in names]
    chosen = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("_text"))

    def run(batch):
        for first, data, rows in pieces(batch["_text"]):
            part = batch.slice(first, len(rows) - 1)
            yield {f.name: part[f.name] for f in kept} | {k: pa.array(v) for k, v in count_rules(data, rows).items()}

    return arrow_map(chosen, run, fields(kept, COUNTS))


def base_failed():
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict:
    """What counts as a failure of a host's documents: the base rules, odd word lengths, symbols, repeated lines."""
    n = F.col("n_words")
    return {
        "base": base_failed(),
        "words": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n),
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 20 * F.col("n_dup_lines") > n,
    }


def prior(hosts: DataFrame, failed: str = "n_failed") -> tuple:
    """``(alpha, beta)`` of a beta distribution of the hosts' failure rates, by the method of moments.

    One row of sums over all hosts gives the mean and the spread of the rates beyond what chance
    makes of their sizes. Hosts that do not differ give a prior worth a million documents.
    """
    n, f = F.col("n_docs").cast("double"), F.col(failed).cast("double")
    sums = hosts.agg(F.count("*"), F.sum(n), F.sum(f), F.sum(n * n), F.sum(f * f / n)).first()
    count, docs, failed, squares, spread = (float(x or 0) for x in sums)
    if not docs:
        return 1.0, 1.0
    mean = failed / docs
    # Between-host variance: the weighted spread less what binomial draws add.
    room = docs - squares / docs
    between = ((spread - failed * mean) - (count - 1) * mean * (1 - mean)) / room if room > 0 else 0.0
    weight = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 0 else 1e6
    return max(mean * weight, 1e-3), max((1 - mean) * weight, 1e-3)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
          most: float = 0.5) -> DataFrame:
    """``key, host``, the counts, ``base_failed`` and ``kept`` of every row.

    A document is kept if it passes the base rules itself and its host passes every one of :func:`rules`: the host's
    rate of failures of a rule, shrunk towards the rate of all hosts by that rule's empirical beta prior, must not
    exceed ``most``. A host with few documents therefore needs more than a few failures to be rejected. Whole texts are
    counted, however long; other columns are ignored, whatever their names.

    The counts are map-only and written once; hosts are summed by a partial aggregate, and the verdicts
    of rejected hosts meet their documents in a join that Spark can split where a host is hot. NULL is
    a host of its own. Repeated rows count each; an empty table gives an empty one.
    """
    chosen = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    counted = stored(document_counts(chosen).withColumn("base_failed", base_failed()), "quality")
    failures = [F.sum(F.col(f"_{name}").cast("long")).alias(name) for name in rules()]
    flagged = counted.select("host", *[rule.alias(f"_{name}") for name, rule in rules().items()])
    hosts = stored(flagged.groupBy("host").agg(F.count("*").alias("n_docs"), *failures), "hosts")
    bad = F.lit(False)
    for name in rules():
        alpha, beta = prior(hosts, name)
        bad = bad | ((F.col(name) + alpha) / (F.col("n_docs") + alpha + beta) > most)
    rejected = hosts.filter(bad).select(F.col("host").alias("_host"), F.lit(True).alias("_rejected"))
    judged = counted.join(rejected, F.col("host").eqNullSafe(F.col("_host")), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("_rejected").isNull()).select(
        F.col("key").alias(key), F.col("host").alias(host), *[c.split()[0] for c in COUNTS.split(", ")],
        "base_failed", "kept",
    )
