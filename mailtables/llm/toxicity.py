"""Toxicity by a weighted finite-state grammar of clauses, with words and weights learned from labels."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import jaccard
from .common import arrow_map, fields, stored

SAMPLE = 20_000
CANDIDATES = 20_000
SHORTEST, LONGEST = 3, 16
EVIDENCE = 25.0
LEAST = 4
THRESHOLD = 0.7

# Words of the grammar in English, German, French and Spanish.
TARGETS = """you your you're yourself he him she her they them
du dich dir dein ihr euch sie er ihn
tu toi te vous vos il elle ils elles
tú tu te ti usted ustedes vosotros él ella ellos""".split()
NEGATIONS = """not no never isn't aren't wasn't don't
nicht kein keine keinen nie niemals
pas jamais aucun aucune
nunca ningún ninguna tampoco""".split()
REPORTS = """said says say wrote writes claimed claims called calls quoted reported
sagte sagt schrieb schreibt nannte behauptet
dit disait écrit appelle prétend
dijo dice escribió escribe llamó llama""".split()
THREATS = """kill hurt shoot stab strangle
töten umbringen erschießen
tuerai frapperai
mataré golpearé""".split()

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]|[\"“”«»]")
FEATURES = ["plain", "at_target", "negated", "reported", "threat", "hits", "stems"]


# ---- transducers: (state, symbol) -> (state, symbol), composed into one ------------------------

# Symbols: w any word, N negation, R reporting, Q quotation mark, T target, I insult, H threat, E clause end.
SYMBOLS = "wNRQTIHE"


class Transducer:
    """A deterministic machine that rewrites a sequence of symbols; ``step(state, symbol)``."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __matmul__(self, after):
        """First this machine, then ``after`` on what it writes."""

        def step(state, symbol):
            one, written = self.step(state[0], symbol)
            two, written = after.step(state[1], written)
            return (one, two), written

        return Transducer((self.start, after.start), step)

    def table(self, symbols):
        """All reachable transitions."""
        found, todo = {}, [self.start]
        while todo:
            state = todo.pop()
            for s in symbols:
                if (state, s) not in found:
                    found[state, s] = to, _ = self.step(state, s)
                    todo.append(to)
        return found


def _hit(symbol):
    return symbol[0] in "IH"


def _negation(left, symbol):
    """A hit within three words behind a negation is marked ``-``."""
    if symbol[0] == "E":
        return 0, symbol
    if symbol[0] == "N":
        return 3, symbol
    return max(left - 1, 0), symbol + "-" if _hit(symbol) and left else symbol


def _report(state, symbol):
    """Hits behind a reporting word, up to the clause's end, or inside quotation marks are marked ``'``."""
    said, quoted = state
    if symbol[0] == "E":
        return (False, quoted), symbol
    if symbol[0] == "R":
        return (True, quoted), symbol
    if symbol[0] == "Q":
        return (said, not quoted), symbol
    return state, symbol + "'" if _hit(symbol) and (said or quoted) else symbol


def _target(seen, symbol):
    """Hits behind a target in their clause are marked ``@``."""
    if symbol[0] == "E":
        return False, symbol
    return seen or symbol[0] == "T", symbol + "@" if _hit(symbol) and seen else symbol


GRAMMAR = Transducer(0, _negation) @ Transducer((False, False), _report) @ Transducer(False, _target)


class Scorer:
    """The features of a text: weights of the grammar's matches, summed over its clauses."""

    def __init__(self, stems: dict):
        import ahocorasick

        self.stems, self.table, self.start = stems, GRAMMAR.table(SYMBOLS), GRAMMAR.start
        self.find = ahocorasick.Automaton()
        for s in [*stems, *THREATS]:
            self.find.add_word(s, s)
        self.find.make_automaton()
        fixed = [("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("H", THREATS), ("Q", '"“”«»'), ("E", ".!?;:\n")]
        self.known = {word: tag for tag, words in fixed for word in words}
        self.lengths = sorted({len(s) for s in stems})

    def stem_of(self, word):
        return next((word[:n] for n in self.lengths if word[:n] in self.stems), None)

    def __call__(self, text):
        low = text.lower()
        # Most texts hold no stem at the start of a word; only the others are parsed.
        hit = any(at - len(s) < 0 or not low[at - len(s)].isalpha() for at, s in self.find.iter(low))
        made = dict.fromkeys(FEATURES, 0.0)
        if not hit:
            return made
        state, seen = self.start, set()
        clause = dict.fromkeys(FEATURES[:5], 0.0)
        for m in _WORD.finditer(low):
            word = m.group()
            stem = self.stem_of(word)
            tag = "I" if stem else self.known.get(word, "w")
            state, out = self.table[state, tag]
            if tag == "E":
                for k, v in clause.items():
                    made[k] += min(v, 10.0)
                    clause[k] = 0.0
            elif _hit(out):
                weight = self.stems[stem] if stem else 1.0
                kind = "negated" if "-" in out else "reported" if "'" in out else "threat" if tag == "H" else (
                    "at_target" if "@" in out else "plain")
                # A threat is one only with somebody it is aimed at.
                if tag == "I" or "@" in out:
                    clause[kind] += weight
                if stem:
                    made["hits"] += 1
                    seen.add(stem)
        for k, v in clause.items():
            made[k] += min(v, 10.0)
        for k in FEATURES[:5]:
            made[k] = float(np.log1p(made[k]))
        made["hits"], made["stems"] = float(np.log1p(made["hits"])), float(np.log1p(len(seen)))
        return made


# ---- learning --------------------------------------------------------------------------------


def prefix_counts(train: DataFrame) -> DataFrame:
    """``p, toxic, clean``: in how many texts a word begins with ``p``, each text counted by its ``weight``."""

    def run(batch):
        counts = {0: Counter(), 1: Counter()}
        for text, y, weight in zip(batch["text"], batch["toxic"].to_pylist(), batch["weight"].to_pylist()):
            words = {w for w in re.findall(r"[^\W\d_]+", (text.as_py() or "").lower())}
            count = counts[y]
            for p in {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)}:
                count[p] += weight
        keys = list(counts[0].keys() | counts[1].keys())
        yield {"p": keys, "toxic": [counts[1][k] for k in keys], "clean": [counts[0][k] for k in keys]}

    made = arrow_map(train.select("text", "toxic", "weight"), run, "p string, toxic double, clean double")
    # Rounded, so that the order of the sums decides nothing.
    return made.groupBy("p").agg(F.round(F.sum("toxic"), 6).alias("toxic"), F.round(F.sum("clean"), 6).alias("clean"))


def weighed(rows: DataFrame) -> DataFrame:
    """``text, toxic, weight``: near copies with one label weigh as much as one text together.

    Their words are no independent evidence. ``rows`` holds different texts, at most ``SAMPLE``; only
    numbers of them are broadcast.
    """
    rows = rows.withColumn("h", F.xxhash64("text"))
    groups = jaccard.link(rows, "h").select(F.col("doc_id").alias("h"), "component_id")
    groups = stored(groups.join(F.broadcast(rows.select("h", "toxic")), "h"), "copies")
    sizes = groups.groupBy("component_id", "toxic").agg((1 / F.count("*")).alias("weight"))
    weights = groups.join(F.broadcast(sizes), ["component_id", "toxic"]).select("h", "weight")
    return rows.join(F.broadcast(weights), "h").select("text", "toxic", "weight")


def learn_stems(counts: DataFrame, toxic: float, clean: float) -> dict:
    """``{stem: weight}``: beginnings of words that toxic texts hold far more often than others.

    The evidence alone decides, so that a word of a small language counts like any other.
    """
    if not toxic or not clean:
        return {}
    a, b = F.col("toxic") + 0.0, F.col("clean") + 0.0
    share = (a + b) / (toxic + clean)

    def part(seen, n):
        return F.when(seen > 0, seen * F.log(seen / (share * n))).otherwise(0.0)

    evidence = 2 * (part(a, toxic) + part(b, clean))
    strong = counts.filter((a / toxic > 4 * b / clean) & (a >= LEAST)).withColumn("g", evidence)
    strong = strong.filter(F.col("g") >= EVIDENCE).orderBy(F.desc("g"), "p").limit(CANDIDATES).toPandas()
    found = {p: (x, y, g) for p, x, y, g in strong[["p", "toxic", "clean", "g"]].itertuples(index=False)}
    # The beginning that tells most, and of equals the longest; nothing longer or shorter beside it.
    chosen, begun = {}, set()
    for p, (x, y, _) in sorted(found.items(), key=lambda i: (-i[1][2], -len(i[0]), i[0])):
        begins = [p[:n] for n in range(1, len(p) + 1)]
        if p not in begun and not any(q in chosen for q in begins):
            begun.update(begins)
            chosen[p] = float(np.log((x + 0.5) / (toxic + 1) * (clean + 1) / (y + 0.5)))
    return chosen


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the ridge pulls towards equal positive weights."""
    x = np.column_stack([x, np.ones(len(x))])
    centre = np.append(np.full(x.shape[1] - 1, 1.0), -2.0)
    w = centre.copy()
    pull = np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + pull * (w - centre)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(key: str):
    """Whether the key's CRC-32 leaves 1 when divided by 3; labels of such rows are never learned."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE):
    """``(stems, weights)`` from at most ``sample`` labelled rows that are not held out.

    The sample is the rows with the smallest hashes of their keys; only its keys and labels, at most
    ``sample`` of them, are broadcast to find the texts. Equal texts count once.
    """
    usable = labels.filter(F.col(f"`{key}`").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(key))
    usable = usable.groupBy(F.col(f"`{key}`").cast("long").alias("k")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("k"), "k").limit(sample)
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("text"))
    rows = texts.join(F.broadcast(chosen), "k").filter("text is not null")
    rows = rows.dropDuplicates(["text"]).select("text", "toxic")
    rows = stored(rows, "labelled")
    counted = stored(weighed(rows), "weighed")
    seen = dict(counted.groupBy("toxic").agg(F.round(F.sum("weight"), 6)).toPandas().itertuples(index=False))
    stems = learn_stems(prefix_counts(counted), seen.get(1, 0.0), seen.get(0, 0.0))

    def measure(batch):
        score = Scorer(stems)
        made = [score(t.as_py()) for t in batch["text"]]
        yield {f: [m[f] for m in made] for f in FEATURES} | {"toxic": batch["toxic"]}

    table = arrow_map(rows, measure, ", ".join(f"{f} double" for f in FEATURES) + ", toxic int").toPandas()
    return stems, fit(table[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), table["toxic"].to_numpy(float))


def score(docs: DataFrame, model: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``held_out, score, predicted``; the text decides alone.

    Map-only. NULL and empty texts score like texts without any match. Columns of ``docs`` named like
    the results are replaced; all others are kept. Equal texts score equally.
    """
    stems, weights = model
    made = ("held_out", "score", "predicted")
    kept = [f for f in docs.schema if f.name not in made]
    body = text if text in [f.name for f in kept] else "_body"
    more = [] if body == text else [F.col(f"`{text}`").alias(body)]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], *more, F.coalesce(held_out(key), F.lit(False)).alias("held_out"))

    def run(batch):
        scorer = Scorer(stems)
        x = np.array([[m[f] for f in FEATURES] for m in (scorer(t.as_py() or "") for t in batch[body])])
        x = x.reshape(-1, len(FEATURES))
        p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
        yield {f.name: batch[f.name] for f in kept} | {
            "held_out": batch["held_out"], "score": pa.array(p), "predicted": pa.array((p >= THRESHOLD).astype(np.int32))
        }

    return arrow_map(rows, run, fields(kept, "held_out boolean, score double, predicted int"))
