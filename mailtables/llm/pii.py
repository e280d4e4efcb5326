"""Personal data: base patterns, and further spans found by labelers that vote."""

import hashlib
import re
from math import log2

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, fields, stored

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret", "name", "number"]
ACCEPT = 0.9

# ---- base patterns -----------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text):
    """Every sign ``@`` is looked at once, so that a long run of letters costs no more than its length."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        # What a failing sign had before it cannot begin another match; the next sign starts behind it.
        end = host.end() if host else at + 1
        if host:
            yield start, end
        at = text.find("@", end)


def base_spans(text: str) -> list:
    """``(kind number, start, end)`` of the base patterns, in order."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(p[-9:]) <= 255 and len(p.lstrip("0")) < 4 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdecimal, m.group())) <= 15:
                found.append((3, m.start(), m.end()))
    return found


# ---- candidates and labelers -------------------------------------------------------------------

# Gazetteer and context words.
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora"]
GIVEN = """james john robert michael william david mary patricia jennifer linda elizabeth susan anna maria
hans peter thomas andreas sabine claudia pierre jean marie jacques sophie jose carlos carmen juan ana""".split()
PREFIXES = ["sk_", "pk_", "ghp_", "gho_", "AKIA", "xox", "eyJ"]
CUES = {
    "email": ["mail", "contact", "write", "kontakt", "correo"], "ip": ["ip", "host", "address", "server"],
    "card": ["card", "visa", "mastercard", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "call", "mobile", "fax"],
    "secret": ["token", "key", "secret", "password", "passwd", "pwd", "bearer"],
    "name": ["name", "contact", "dear", "regards", "signed"],
    "number": ["ssn", "passport", "account", "iban", "tax id", "phone", "tel", "call"],
}
AGAINST = ["version", "isbn", "license", "copyright", "page", "sha", "commit", "md5", "total", "price"]
_TITLE = re.compile(rf"\b(?:{'|'.join(TITLES)})\.? +([A-Z][\w'-]{{1,40}}(?: [A-Z][\w'-]{{1,40}})?)")
_TOKEN = re.compile(r"[A-Za-z0-9_-]+")
_CAPITALS = r"[A-Z][\w'-]{1,40}(?: [A-Z][\w'-]{1,40}){0,2}"
_KNOWN = re.compile(rf"\b(?:{'|'.join(n.title() for n in GIVEN)})\b(?: [A-Z][\w'-]{{1,40}}){{0,2}}")
_CUED = re.compile(rf"\b(?:(?i:{'|'.join(CUES['name'])}))\b(?: is)?[:,]?\s{{1,3}}({_CAPITALS})")
_NUMBER = r"[0-9]{3}-[0-9]{2}-[0-9]{4}|0[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,5}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}"
_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_STRICT = re.compile(rf"(?<![\w-])(?<![0-9]\.)(?:{_NUMBER}|{_IBAN})(?![\w-]|\.[0-9])")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * log2(c / n) for c in (s.count(x) for x in set(s)))


def iban(s: str) -> bool:
    """Whether ``s`` is a country, two check digits and the rest, and leaves 1 when divided by 97."""
    s = s.replace(" ", "")
    return re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}", s) is not None and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def strict_numbers(text: str):
    """The strict forms of numbers, wherever they stand; what looks like an IBAN must be one."""
    for m in _STRICT.finditer(text):
        a, b = m.span()
        if text[a].isdecimal():
            yield a, b
            continue
        # Groups behind an IBAN look like more of it.
        while b - a > 14 and not iban(text[a:b]):
            b = text.rfind(" ", a, b)
        if b - a > 14 and iban(text[a:b]):
            yield a, b


def digit_groups(text: str, strict: list):
    """Runs of digits between the strict forms; runs of over 19 digits by their blanks, short groups joined."""
    k = 0
    for m in _CARD.finditer(text):
        at, parts = m.start(), []
        while k < len(strict) and strict[k][1] <= m.start():
            k += 1
        i = k
        while i < len(strict) and strict[i][0] < m.end():
            parts.append((at, strict[i][0]))
            at, i = strict[i][1], i + 1
        for a, b in [*parts, (at, m.end())]:
            n = sum(map(str.isdecimal, text[a:b]))
            joined = None
            for g in re.finditer("[^ ]+", text[a:b]) if n > 19 else re.finditer("[0-9].*[0-9]", text[a:b]) if n >= 7 else ():
                digits = sum(map(str.isdecimal, g.group()))
                if digits > 19:
                    joined = None
                    continue
                joined = (joined[0], joined[1] + digits) if joined and joined[1] + digits <= 19 else (a + g.start(), digits)
                if joined[1] >= 7:
                    yield joined[0], a + g.end()
                    joined = None


def candidates(text: str, base: list) -> list:
    """Base spans and looser ones, proposed by every labeler.

    Long tokens with digits, strict forms of numbers and digit groups around them, capitals behind a
    title or a cue and at known names.
    """
    loose, end = [], 0
    for m in _DIGIT.finditer(text) if _DIGIT.search(text) else ():
        if m.start() < end:
            continue
        start = m.start()
        while start > end and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "_-"):
            start -= 1
        end = _TOKEN.match(text, start).end()
        token = text[start:end]
        if end - start >= 20 and not token.replace("-", "").isdecimal():
            loose.append((4, start, end))
    loose += [(5, m.start(1), m.end(1)) for m in (_TITLE.finditer(text) if any(t in text for t in TITLES) else ())]
    for pattern, group in ((_CUED, 1), (_KNOWN, 0)):
        loose += [(5, m.start(group), m.end(group)) for m in pattern.finditer(text)]
    if _DIGIT.search(text):
        strict = list(strict_numbers(text))
        loose += [(6, a, b) for a, b in strict] + [(6, a, b) for a, b in digit_groups(text, strict)]
        # A long token that is a strict number is that number.
        whole = set(strict)
        loose = [x for x in loose if x[0] != 4 or x[1:] not in whole]
    # One sweep: a looser span is kept if it meets neither a base span nor an earlier kept one.
    found, taken, last, k = list(base), merged([(a, b) for _, a, b in base]), 0, 0
    for one in sorted(loose, key=lambda x: (x[1], x[0])):
        while k < len(taken) and taken[k][1] <= one[1]:
            k += 1
        if one[1] >= last and (k == len(taken) or taken[k][0] >= one[2]):
            found.append(one)
            last = one[2]
    return found


def merged(spans: list) -> list:
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_EXACT = {
    "secret": re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[A-Za-z0-9_-]{36,}"),
    "name": re.compile(r"[A-Z][a-zà-ÿ]+ [A-Z][a-zà-ÿ]+"),
    "number": re.compile(rf"{_NUMBER}|{_IBAN}"),
}


def votes(text: str, kind: int, start: int, end: int) -> tuple:
    """What the labelers say about a candidate: 1 personal, -1 not, 0 nothing.

    Regex: the strict form of the kind. Gazetteer: known names and prefixes. Context: cue words in the 32
    characters before it. Shape: mixture of its characters.
    """
    name, s, before = KINDS[kind], text[start:end], text[max(0, start - 32) : start].lower()
    strict = 1 if kind < len(BASE) or _EXACT[name].fullmatch(s) else -1
    low = s.lower()
    known = 0
    if name == "secret":
        known = 1 if s.startswith(tuple(PREFIXES)) else 0
    elif name in ("name", "email"):
        known = 1 if any(part in GIVEN for part in re.split(r"[^a-zà-ÿ]+", low)) else 0
    context = 1 if any(c in before for c in CUES[name]) else -1 if any(c in before for c in AGAINST) else 0
    if name in ("secret", "email"):
        e = entropy(s)
        shape = 1 if e > 3.2 else -1 if e < 2.5 else 0
    elif name == "name":
        shape = 0 if len(s) < 30 else -1
    else:
        shape = -1 if len(set(s)) <= 2 else 1 if name != "number" else 0
    return strict, known, context, shape


def features(text: str, kind: int, start: int, end: int) -> tuple:
    """Small whole numbers that describe a candidate and what stands around it, for the final classifier."""
    s = text[start:end]
    digits = sum(map(str.isdecimal, s)) / max(len(s), 1)
    left, right = text[start - 1 : start], text[end : end + 1]
    before = text[max(0, start - 32) : start].lower()
    strict, known, _, _ = votes(text, kind, start, end)
    return (
        kind, strict + 1, known + 1, min((end - start).bit_length(), 7), int(digits * 4), int(left in ("'", '"', "=", ":")),
        int(right.isalnum()), int(any(c in before for c in CUES[KINDS[kind]])), int(any(c in before for c in AGAINST)),
    )


def code(values, width) -> int:
    out = 0
    for v in values:
        out = out * width + v
    return out


def decode(number, n, width):
    out = []
    for _ in range(n):
        out.append(number % width)
        number //= width
    return out[::-1]


# ---- learning ----------------------------------------------------------------------------------

N_VOTES, N_FEATURES, WIDTH = 4, 9, 8


def estimate(vote: np.ndarray, kind: np.ndarray, count: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The probability of each row (a pattern of votes, seen ``count`` times) to be personal data.

    Expectation-maximisation over labelers that err independently: every labeler has a probability for
    each of its three answers given the truth, and every kind a share of true candidates. Smoothing by
    the belief that votes are right in four of five cases keeps the two classes from changing places.
    """
    belief = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])  # truth, answer + 1
    answers = np.repeat(belief[:, None, :], vote.shape[1], axis=1)
    share = np.full(len(KINDS), 0.5)
    p = np.full(len(vote), 0.5)
    for _ in range(rounds):
        like = np.log(share[kind] / (1 - share[kind]))
        for j in range(vote.shape[1]):
            like = like + np.log(answers[1, j, vote[:, j] + 1] / answers[0, j, vote[:, j] + 1])
        new = 1 / (1 + np.exp(-np.clip(like, -30, 30)))
        done, p = np.abs(new - p).max(initial=0) < 1e-9, new
        for k in range(len(KINDS)):
            of = kind == k
            share[k] = (p[of] @ count[of] + 5) / (count[of].sum() + 10)
        for truth, weight in ((1, p * count), (0, (1 - p) * count)):
            for j in range(vote.shape[1]):
                seen = np.bincount(vote[:, j] + 1, weight, minlength=3)
                answers[truth, j] = (seen + 10 * belief[truth]) / (seen.sum() + 10)
        if done:
            break
    return p


def one_hot(f: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(WIDTH)[f[:, j]] for j in range(f.shape[1])] + [np.ones((len(f), 1))], axis=1)


def train(patterns) -> set:
    """The feature patterns that the final classifier accepts.

    ``patterns`` holds ``votes, features, n``; there are at most some thousands of different ones,
    whatever the data. The classifier is a logistic regression on the features, fitted to the
    labelers' estimated truth.
    """
    if not len(patterns):
        return set()
    vote = np.array([decode(v, N_VOTES, 3) for v in patterns["votes"]]) - 1
    f = np.array([decode(v, N_FEATURES, WIDTH) for v in patterns["features"]])
    n = patterns["n"].to_numpy(float)
    y = estimate(vote, f[:, 0], n)
    x = one_hot(f)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (p - y)) + w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return set(patterns["features"][p >= ACCEPT].tolist())


# ---- on tables ---------------------------------------------------------------------------------

FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found array<struct<kind: int, s: int, e: int, votes: int, features: int>>"


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with counts and digest of the base spans and all candidates."""
    made = [*[f"n_{k}" for k in BASE], "base_sha256", "found"]
    kept = [f for f in docs.schema if f.name not in made and f.name != text]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))

    def run(batch):
        counts, digests, found = [[] for _ in BASE], [], []
        for t in batch["_t"]:
            t = t.as_py()
            base = base_spans(t)
            for k, column in enumerate(counts):
                column.append(sum(1 for s in base if s[0] == k))
            digests.append(hashlib.sha256(written(base).encode()).hexdigest())
            found.append([
                {"kind": k, "s": a, "e": b, "votes": code([v + 1 for v in votes(t, k, a, b)], 3),
                 "features": code(features(t, k, a, b), WIDTH)}
                for k, a, b in candidates(t, base)
            ])
        yield {f.name: batch[f.name] for f in kept} | {f"n_{b}": c for b, c in zip(BASE, counts)} | {
            "base_sha256": digests, "found": found
        }

    return arrow_map(rows, run, fields(kept, FOUND))


def learn(scanned: DataFrame) -> set:
    """Votes and features of all candidates of the corpus, counted by pattern, then ``train``."""
    patterns = scanned.select(F.explode("found").alias("f")).groupBy("f.votes", "f.features").agg(F.count("*").alias("n"))
    return train(patterns.toPandas().sort_values(["votes", "features"], ignore_index=True))


def accepted_spans(model: set):
    """``found`` without the looser candidates that the classifier rejects, by kind and start."""
    keep = F.filter("found", lambda f: (f["kind"] < len(BASE)) | f["features"].isin(sorted(model) or [-1]))
    return F.array_sort(F.transform(keep, lambda f: F.struct(f["kind"], f["s"], f["e"])))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the numbers and SHA-256 of the base spans, and all ``spans`` of every row.

    ``spans`` lists ``kind:start:end`` by kind, then start, in code points, the end exclusive. Base spans
    always stay; looser candidates are added if the final classifier, trained on this corpus, accepts
    them. Texts are read once; what is written is small. NULL and empty texts have no spans; rows with
    NULL or repeated keys are scanned each; an empty table gives an empty one; other columns are ignored.
    """
    chosen = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_body"))
    scanned = stored(scan(chosen, "_body"), "spans")
    names = F.array(*[F.lit(k) for k in KINDS])
    texts = F.transform(accepted_spans(learn(scanned)), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["s"].cast("string"), s["e"].cast("string")))
    return scanned.select(
        F.col("_key").alias(key), *[f"n_{k}" for k in BASE], "base_sha256", F.array_join(texts, ",").alias("spans")
    )


def replaced(text: str, model: set) -> str:
    """``text`` with its accepted spans replaced; of overlapping ones the first names the place."""
    base = base_spans(text)
    spans = [
        (a, -b, k) for k, a, b in candidates(text, base)
        if k < len(BASE) or code(features(text, k, a, b), WIDTH) in model
    ]
    if not spans:
        return text
    parts, at = [], 0
    for a, b, k in sorted(spans):
        if a >= at:
            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, -b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind, as in ``[EMAIL]``.

    One pass counts the patterns of the corpus for the classifier, a second one replaces; no text is
    written in between. NULL stays NULL, and all columns keep their names and places.
    """
    model = learn(scan(docs.select(F.col(f"`{text}`").alias("_body")), "_body"))
    index = docs.columns.index(text)

    def run(batch):
        columns = dict(zip(batch.schema.names, batch.columns))
        columns[str(index)] = [None if t is None else replaced(t, model) for t in columns[str(index)].to_pylist()]
        yield columns

    # Columns travel under numbers, so that any names will do.
    numbered = docs.toDF(*[str(i) for i in range(len(docs.columns))])
    return arrow_map(numbered, run, numbered.schema).toDF(*docs.columns)
