"""Repeated passages by prefix-free parsing: phrases between hash triggers, their dictionary, and an order of suffixes."""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir
from .common import arrow_map, arrow_schema, record, ship, stored
from .words import U, _power, mix, pieces

LENGTH = 100
# A trigger is a string of so many bytes whose rolling hash is divisible by SOME.
WIDTH, SOME = 32, 4
# The same for the parse of phrases that share a trigger.
SHORT_WIDTH, RARE = 8, 16
CHUNK = 4 << 20
PIECE = 512 << 10
BUCKET = 16 << 20
# Of one trigger a chunk looks up so many different phrases. A trigger that reaches this, or has MANY in all, is a
# common one, whose phrases are compared by windows, spread by their names; no bucket gathers them.
VARIANTS, MANY = 8, 1_000
BATCH = 512 << 10
CLEAN, REPEATED, SHARED, COMMON = range(4)
_BASE = 0x9E3779B97F4A7C15 | 1
_CODE = mix(np.arange(1, 257, dtype=np.uint64), 3)
_NONE = U((1 << 64) - 1)
CHUNKS = "chunk long, size long, ids binary, unnamed binary, ends binary, texts binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
ASKED = "chunk long, bucket int, names binary, others binary, docs binary, places binary"
SAID = "chunk long, bucket int, route int, said binary"
DECIDED = (
    f"kind string, {RESULT}, {CHUNKS}, bucket int, names binary, others binary, docs binary, places binary, sizes binary,"
    " windows binary, classes binary, low binary, high binary, begin binary"
)


def columns(schema: str) -> list:
    return [part.split()[0] for part in schema.split(",")]


class Names:
    """64-bit names of all strings inside a run of bytes, from one pass of a rolling hash."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * _power(_BASE, n + 1)[:n], out=self.sums[1:])
        self.back = _power(pow(_BASE, -1, 1 << 64), n + 1)

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, width: int) -> np.ndarray:
        """The names of all strings of one width."""
        n = max(len(self.sums) - width, 0)
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n])


def phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict:
    """Phrases of texts ``data[start:end]``, which may overlap: ``low, high`` window starts, ``trigger`` and ``name``; and ``cuts``.

    Every window of ``LENGTH`` bytes inside a text is anchored at the trigger in it whose hash is smallest, the first of
    equal ones. Which one that is depends on the window's bytes alone, so equal windows have equal
    triggers at equal places. Windows in a row with one anchor form a phrase, ``data[low : high + LENGTH]``. A window
    without a trigger is a phrase of its own and its own trigger.
    """
    out = {"low": [], "high": [], "trigger": [], "name": []}
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + PIECE, "right")), i + 1)
        base, part = int(starts[i]), data[starts[i] : ends[j - 1]]
        if len(part) >= LENGTH:
            for k, v in piece_phrases(part, starts[i:j] - base, ends[i:j] - base).items():
                out[k].append(v + base if k in ("low", "high") else v)
        i = j
    kinds = {"trigger": np.uint64, "name": np.uint64}
    return {k: np.concatenate([np.zeros(0, kinds.get(k, np.int64)), *v]) for k, v in out.items()}


def piece_phrases(data, starts, ends) -> dict:
    names, n = Names(data), len(data)
    rolled = names.every(WIDTH)
    # The last places of a text hold no whole trigger and no whole window.
    whole = np.zeros(len(rolled) + 1, np.int32)
    fits = ends - starts >= WIDTH
    np.add.at(whole, starts[fits], 1)
    np.add.at(whole, ends[fits] - WIDTH + 1, -1)
    whole = np.cumsum(whole[:-1]) > 0
    at = np.flatnonzero(whole & (rolled % U(SOME) == 0))
    # Hash above, place below: the minimum is the first of the smallest.
    low_bits = U((1 << 23) - 1)
    least = np.full(len(rolled), _NONE, np.uint64)
    least[at] = (rolled[at] & ~low_bits) | at.astype(np.uint64)
    reach = LENGTH - WIDTH + 1
    span = 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if reach > span:
        least = np.minimum(least[: span - reach], least[reach - span :])
    begins = np.zeros(n + 1, bool)
    inside = np.zeros(n + 2, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:-2]) > 0
    inside = inside[: len(least)]
    begins[starts] = True
    own = least == _NONE
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | own[1:] | begins[1 : len(least)] | ~inside[:-1]
    low = np.flatnonzero(new & inside)
    stop = np.flatnonzero(new | ~inside)
    after = np.searchsorted(stop, low, "right")
    high = np.append(stop, len(least))[after] - 1
    anchor, alone = (least[low] & low_bits).astype(np.int64), own[low]
    name = names.of(low, high + LENGTH)
    trigger = np.where(alone, name, rolled[np.where(alone, 0, anchor)])
    return {"low": low, "high": high, "trigger": trigger, "name": name}


def ranks(codes: np.ndarray, left: np.ndarray, depth: int, known: int = 1) -> np.ndarray:
    """Ranks of all suffixes of strings to ``depth`` characters, by doubling.

    ``codes`` order the first ``known`` characters of each suffix; ``left`` counts the characters to its string's end.
    """
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    n = len(codes)
    while known < depth and n and int(rank.max()) < n:
        more = np.zeros(n, np.int64)
        has = np.flatnonzero(left > known)
        more[has] = rank[has + known]
        rank = np.unique(rank * np.int64(n + 2) + more, return_inverse=True)[1].astype(np.int64) + 1
        known *= 2
    return rank


def sevens(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next seven bytes of each suffix as one number; a byte behind the end counts below all others."""
    wide = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])
    out = np.zeros(len(text), np.int64)
    for k in range(7):
        out = (out << 9) + np.where(left > k, wide[k : k + len(text)], 0)
    return out


def corpus_order(data: np.ndarray, ends: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """``windows`` of texts that end at ``ends``, in the order of their first ``LENGTH`` bytes, by prefix-free parsing.

    Triggers, strings of ``SHORT_WIDTH`` bytes whose hash is divisible by ``RARE``, cut the texts into phrases; each runs to
    the end of the next trigger, or of its text, so that none is a prefix of another. The dictionary holds every phrase
    once. A window's place is the rank of its rest of a phrase among the suffixes of the dictionary, then the
    rank of what follows among the suffixes of the parse.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    rolled = Names(data).every(SHORT_WIDTH)
    cut = np.zeros(len(data) + 1, bool)
    cut[np.flatnonzero(rolled % U(RARE) == 0)] = True
    for k in range(1, SHORT_WIDTH):
        # A trigger does not cross the end of a text.
        cut[ends[ends >= k] - k] = False
    cut[starts] = True
    cuts = np.flatnonzero(cut[:-1])
    stop = ends[np.searchsorted(ends, cuts, "right")]
    following = np.append(cuts[1:], len(data))
    last = following >= stop
    stop = np.where(last, stop, np.minimum(following + SHORT_WIDTH, stop))
    first, owner = unique_strings(data, cuts, stop - cuts)
    size = (stop - cuts)[first]
    begin = np.cumsum(size) - size
    inside = np.arange(size.sum()) - np.repeat(begin, size)
    left = np.repeat(size, size) - inside
    suffix = ranks(sevens(data[np.repeat(cuts[first], size) + inside], left), left, LENGTH, 7)
    ending = np.flatnonzero(last)
    n = np.arange(len(cuts))
    parse = ranks(suffix[begin[owner]], ending[np.searchsorted(ending, n)] - n + 1, LENGTH)
    at = np.searchsorted(cuts, windows, "right") - 1
    rest = suffix[begin[owner[at]] + windows - cuts[at]]
    after = np.where(last[at], 0, parse[np.minimum(at + 1, len(cuts) - 1)])
    return np.lexsort((windows, after, rest))


def unique_strings(data, starts, sizes) -> tuple:
    """``(first, owner)``: the places of different strings and for each string which of them it equals."""
    names = np.zeros(len(starts), np.uint64)
    for i in range(0, len(starts), 1 << 16):
        a, size = starts[i : i + (1 << 16)], sizes[i : i + (1 << 16)]
        begin = np.concatenate([[0], np.cumsum(size)])
        inside = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
        hashed = Names(data[np.repeat(a, size) + inside])
        names[i : i + (1 << 16)] = hashed.of(begin[:-1], begin[1:])
    return np.unique(names, return_index=True, return_inverse=True)[1:]


def window_names(data: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The names of windows in ascending order, piece by piece."""
    out = [np.zeros(0, np.uint64)]
    i = 0
    while i < len(windows):
        j = int(np.searchsorted(windows, windows[i] + PIECE, "right"))
        part = Names(data[windows[i] : windows[j - 1] + LENGTH])
        out.append(part.of(windows[i:j] - windows[i], windows[i:j] - windows[i] + LENGTH))
        i = j
    return np.concatenate(out)


def small(a: np.ndarray) -> bytes:
    """Whole numbers as differences from the least, in as few bytes as the largest needs."""
    least = int(a.min(initial=0)) if len(a) else 0
    top = int(a.max()) - least if len(a) else 0
    kind = next(k for k, bits in ((1, 8), (2, 16), (4, 32), (8, 64)) if top < 1 << bits)
    return bytes([kind]) + least.to_bytes(8, "little", signed=True) + (a - least).astype(f"<u{kind}").tobytes()


def large(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=9).astype(np.int64) + int.from_bytes(raw[1:9], "little", signed=True)


def rising(a: np.ndarray) -> bytes:
    """Rising numbers by their steps."""
    return small(np.diff(a, prepend=0))


class Chunk:
    """Texts in the order of their keys, one after the other."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.unnamed = np.frombuffer(row["unnamed"], bool)
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"], max(row["size"], 1)), np.uint8)
        # Long texts are read in parts that share all but one byte of a window.
        parts = np.maximum(-(-(self.ends - self.starts) // PIECE), 1)
        shift = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * PIECE
        self.begin = np.repeat(self.starts, parts) + shift
        self.end = np.minimum(self.begin + PIECE + LENGTH - 1, np.repeat(self.ends, parts))

    def found(self) -> dict:
        """The phrases, with the ``lead`` ones, each the first of its name, in order of triggers, and which of these are ``sent``."""
        p = phrases(self.data, self.begin, self.end)
        order = np.lexsort((p["low"], p["name"], p["trigger"]))
        trigger, name = p["trigger"][order], p["name"][order]
        new_trigger = np.ones(len(order), bool)
        new_trigger[1:] = trigger[1:] != trigger[:-1]
        new = new_trigger.copy()
        new[1:] |= name[1:] != name[:-1]
        lead = order[new]
        counted = np.arange(len(lead))
        nth = counted - np.maximum.accumulate(np.where(new_trigger[new], counted, 0))
        return p | {"lead": lead, "sent": nth < VARIANTS}

    def where(self, places: np.ndarray) -> tuple:
        """``(key, byte in the text)`` of places; texts without a key come last."""
        doc = np.searchsorted(self.ends, places, "right")
        return np.where(self.unnamed[doc], np.iinfo(np.int64).max, self.ids[doc]), places - self.starts[doc]

    def results(self, marked: np.ndarray, docs: np.ndarray) -> dict:
        """The rows of ``docs``, where ``marked`` counts +1 and -1 at the ends of removed stretches."""
        out = {name: [] for name in columns(RESULT)}
        for d in docs:
            a, b = int(self.starts[d]), int(self.ends[d])
            gone = np.cumsum(marked[a:b]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if b > a else 0
            out["doc_id"].append(None if self.unnamed[d] else int(self.ids[d]))
            out["n_bytes"].append(b - a)
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(spans)
            out["kept_sha256"].append(hashlib.sha256(self.data[a:b][~gone].tobytes() if spans else self.data[a:b].tobytes()).hexdigest())
        return out

    def marks(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        marked = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(marked, low, 1)
        # A stretch that ends with a text must not reach the next one; each text is summed on its own.
        np.add.at(marked, high + LENGTH, -1)
        inner = self.starts[(self.starts > 0) & (self.starts < len(self.data))]
        ends_here = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(ends_here, high + LENGTH, -1)
        marked[inner] -= ends_here[inner]
        return marked


def in_buckets(chunk: int, buckets: int, names, others, docs, places):
    """Rows of look-ups in order of ``names``, one for each bucket of the highest bits."""
    bucket = bucket_of(names, buckets)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(names)]):
        yield {"chunk": [chunk], "bucket": [int(bucket[a])], "names": [names[a:b].tobytes()],
               "others": [others[a:b].tobytes() if others is not None else b""], "docs": [small(docs[a:b])], "places": [small(places[a:b])]}


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> U(40)) * U(buckets) >> U(24)).astype(np.int64)


def answer(group: pa.Table) -> pa.Table:
    """What a bucket knows about each name: whether an earlier place has it, and else whether its trigger has other names."""
    rows = group.to_pylist()
    names, others = (np.concatenate([np.frombuffer(r[c], "<u8") for r in rows]) for c in ("names", "others"))
    docs, places = (np.concatenate([large(r[c]) for r in rows]) for c in ("docs", "places"))
    counts = [len(r["names"]) // 8 for r in rows]
    chunk = np.repeat([r["chunk"] for r in rows], counts)
    kind = others if len(others) else names
    order = np.lexsort((chunk, places, docs, kind, names))
    names, kind, chunk = names[order], kind[order], chunk[order]
    new = changes(names)
    first = new | changes(kind)
    trigger = np.cumsum(new) - 1
    variants = np.bincount(trigger, first)
    said = np.where(~first, REPEATED, np.where(variants[trigger] > 1, SHARED, CLEAN)).astype(np.uint8)
    # The same for all phrases of a trigger: it has many in all, or as many in one chunk as that looks up.
    by_chunk = np.lexsort((chunk, trigger))
    own = changes(trigger[by_chunk]) | changes(chunk[by_chunk])
    most = np.bincount(np.cumsum(own) - 1)
    common = variants > MANY
    common[trigger[by_chunk][own][most >= VARIANTS]] = True
    said[(said == SHARED) & common[trigger]] = COMMON
    back = np.empty_like(said)
    back[order] = said
    return answers(rows, counts, back, 0)


def changes(sorted_values: np.ndarray) -> np.ndarray:
    out = np.ones(len(sorted_values), bool)
    out[1:] = sorted_values[1:] != sorted_values[:-1]
    return out


def answers(rows: list, counts: list, said: np.ndarray, route: int) -> pa.Table:
    ends = np.cumsum(counts)
    return pa.table({
        "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
        "route": pa.array([route] * len(rows), pa.int32()), "said": [said[e - c : e].tobytes() for c, e in zip(counts, ends)],
    })


def answer_texts(group: pa.Table) -> pa.Table:
    """For each window of phrases that share a trigger with another one: 1 if it also stands at an earlier place."""
    rows = group.to_pylist()
    squeezed = zstandard.ZstdDecompressor()
    sizes = [large(r["sizes"]) for r in rows]
    texts = [np.frombuffer(squeezed.decompress(r["others"]), np.uint8) for r in rows]
    trigger = np.concatenate([np.frombuffer(r["names"], "<u8") for r in rows])
    docs, places = (np.concatenate([large(r[c]) for r in rows]) for c in ("docs", "places"))
    chunk = np.repeat([r["chunk"] for r in rows], [len(x) for x in sizes])
    size, data = np.concatenate(sizes), np.concatenate(texts)
    length = size + LENGTH - 1
    begin, out = np.cumsum(length) - length, np.cumsum(size) - size
    said = np.zeros(int(size.sum()), np.uint8)
    order = np.argsort(trigger, kind="stable")
    # Equal windows have equal triggers, so triggers are taken in runs of about BATCH bytes.
    new = np.flatnonzero(changes(trigger[order]))
    run = np.cumsum(length[order])
    at = 0
    while at < len(order):
        fits = new[(new > at) & (run[new - 1] - run[at] + length[order[at]] <= BATCH)] if len(new) else new
        rest = new[new > at]
        end = int(len(order) if run[-1] - run[at] <= BATCH else fits[-1] if len(fits) else rest[0] if len(rest) else len(order))
        part = order[at:end]
        own = np.cumsum(length[part])
        text = data[np.repeat(begin[part] - own + length[part], length[part]) + np.arange(own[-1])]
        window = np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        windows = np.repeat(own - length[part], size[part]) + window
        names = window_names(text, windows)
        sorted_ = corpus_order(text, own, windows)
        equal = np.empty(len(windows), np.int64)
        equal[sorted_] = np.cumsum(changes(names[sorted_]))
        by = [np.repeat(x[part], size[part]) for x in (chunk, places, docs)]
        by[1] = by[1] + window
        ranked = np.lexsort((*by, equal))
        said[(np.repeat(out[part], size[part]) + window)[ranked]] = ~changes(equal[ranked])
        at = end
    return answers(rows, [int(x.sum()) for x in sizes], said, 1)


def said_of(rows: list, route: int = 0) -> np.ndarray:
    mine = sorted((r for r in rows if r["route"] == route), key=lambda r: r["bucket"])
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(r["said"], np.uint8) for r in mine)])


def chunks_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    ship(docs.sparkSession)
    target = arrow_schema(CHUNKS)

    def run(batches):
        made = 0
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids, unnamed = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for row, data, starts in pieces(batch.column(1), CHUNK):
                n = len(starts) - 1
                at = slice(row, row + n)
                order = np.lexsort((ids[at], unnamed[at]))
                size = np.diff(starts)[order]
                ends = np.cumsum(size)
                inside = np.concatenate([data[starts[o] : starts[o + 1]] for o in order])
                yield record({
                    "chunk": [(TaskContext.get().partitionId() << 32) + made], "size": [len(inside)],
                    "ids": [ids[at][order].astype("<i8").tobytes()], "unnamed": [unnamed[at][order].tobytes()],
                    "ends": [ends.astype("<i8").tobytes()], "texts": [squeeze(inside.tobytes())],
                }, target)
                made += 1

    return stored(rows.mapInArrow(run, CHUNKS), "chunks")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` after each byte has gone that a string of 100 bytes covers which
    also starts earlier: in a text of a smaller key, or earlier in the same text. Matches stay inside texts.

    Texts are taken as UTF-8 bytes, NULL as an empty text; texts under 100 bytes are whole. Rows with a NULL key come after all
    others and keep it; rows that repeat a key are texts of their own, in the order in which they are stored. Other
    columns are ignored, whatever their names. An empty table gives no rows.

    Texts are stored in chunks of about 4 MB. Each chunk names its different phrases once, and buckets by trigger tell which of
    them occur earlier and which share a trigger with another phrase. Only these latter ones are compared byte by byte: buckets by
    trigger put their windows into corpus order by prefix-free parsing. So a phrase, however often it occurs, is looked up at most
    once a chunk. Phrases of a trigger with very many of them are ordered in their chunks, and their windows are looked up by name.
    """
    chunks = chunks_of(df, key, text)
    buckets = max(-(-(chunks.agg(F.sum("size")).first()[0] or 0) // BUCKET), 1)

    def look_up(batch):
        for i in range(batch.num_rows):
            chunk = Chunk(batch.slice(i, 1).to_pylist()[0])
            p = chunk.found()
            at = p["lead"][p["sent"]]
            yield from in_buckets(chunk.number, buckets, p["trigger"][at], p["name"][at], *chunk.where(p["low"][at]))

    states = arrow_map(chunks, look_up, ASKED).groupBy("bucket").applyInArrow(answer, SAID)

    decided_as, result_as = arrow_schema(DECIDED), arrow_schema(RESULT)

    def decide(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = []
        for row in a.to_pylist():
            rows += [record(one, decided_as) for one in decided(Chunk(row), said_of(b.to_pylist()), buckets)]
        return pa.Table.from_batches(rows, decided_as)

    folder = shared_dir(df.sparkSession, "decided")
    parts = chunks.groupBy("chunk").cogroup(states.groupBy("chunk")).applyInArrow(decide, DECIDED)
    parts.write.partitionBy("kind").parquet(folder)
    parts = df.sparkSession.read.schema(DECIDED).parquet(folder)
    done = parts.filter("kind = 'done'").select(*columns(RESULT))
    asked = parts.filter("kind = 'asked'").select(*columns(ASKED)).groupBy("bucket").applyInArrow(answer, SAID)
    shared = parts.filter("kind = 'shared'").select(*columns(ASKED), "sizes").groupBy("bucket").applyInArrow(answer_texts, SAID)
    told = asked.unionByName(shared)
    waiting = parts.filter("kind = 'waiting'").select(*columns(CHUNKS), "windows", "classes", "low", "high", "begin", "sizes")

    def finish(a: pa.Table, b: pa.Table) -> pa.Table:
        said, rows = b.to_pylist(), []
        for row in a.to_pylist():
            chunk = Chunk(row)
            windows, low, begin = (np.cumsum(large(row[c])) for c in ("windows", "low", "begin"))
            classes, high = large(row["classes"]), low + large(row["high"])
            # Class 0 is known to be repeated.
            by_name = windows[np.append(True, said_of(said) == REPEATED)[classes]]
            by_text = ranges(begin, large(row["sizes"]))[said_of(said, 1) == 1]
            low, high = (np.concatenate([x, by_name, by_text]) for x in (low, high))
            rows.append(record(chunk.results(chunk.marks(low, high), np.arange(len(chunk.ids))), result_as))
        return pa.Table.from_batches(rows, result_as)

    rest = waiting.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, RESULT)
    return done.unionByName(rest)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``begin``, ``begin + 1``, ... of each range, one after the other."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def decided(chunk: Chunk, said: np.ndarray, buckets: int):
    """Rows of finished texts; phrases and windows to look up; and the texts that wait for them."""
    blank = {name: [None] for name in columns(DECIDED)}
    p = chunk.found()
    state = np.full(len(p["low"]), REPEATED, np.uint8)
    state[p["lead"]] = COMMON
    state[p["lead"][p["sent"]]] = said
    size = p["high"] - p["low"] + 1
    shared = p["lead"][state[p["lead"]] == SHARED]
    places = chunk.where(p["low"][shared])
    bucket = bucket_of(p["trigger"][shared], buckets)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    edges = np.flatnonzero(changes(bucket))
    for a, b in zip(edges, [*edges[1:], len(shared)]):
        part = shared[a:b]
        text = chunk.data[ranges(p["low"][part], size[part] + LENGTH - 1)].tobytes()
        yield blank | {
            "kind": ["shared"], "chunk": [chunk.number], "bucket": [int(bucket[a])], "names": [p["trigger"][part].tobytes()],
            "others": [squeeze(text)], "docs": [small(places[0][a:b])], "places": [small(places[1][a:b])], "sizes": [small(size[part])],
        }
    open_ = np.flatnonzero(state == COMMON)
    windows, classes = ranges(p["low"][open_], size[open_]), np.zeros(int(size[open_].sum()), np.int64)
    if len(windows):
        names = window_names(chunk.data, windows)
        text = ranges(p["low"][open_], size[open_] + LENGTH - 1)
        ends = np.cumsum(size[open_] + LENGTH - 1)
        inside = ranges(ends - size[open_] - LENGTH + 1, size[open_])
        order = corpus_order(chunk.data[text], ends, inside)
        # Equal windows are neighbours; the first of them is the one at the lowest place.
        ask = np.minimum.reduceat(order, np.flatnonzero(changes(names[order])))
        ask = ask[np.argsort(names[ask], kind="stable")]
        classes[ask] = np.arange(len(ask)) + 1
        for one in in_buckets(chunk.number, buckets, names[ask], None, *chunk.where(windows[ask])):
            yield blank | one | {"kind": ["asked"]}
    doc_of = lambda at: np.searchsorted(chunk.ends, at, "right")
    waits = np.zeros(len(chunk.ids), bool)
    waits[doc_of(p["low"][open_])] = True
    waits[doc_of(p["low"][shared])] = True
    known = state == REPEATED
    low, high = p["low"][known], p["high"][known]
    made = chunk.results(chunk.marks(low, high), np.flatnonzero(~waits))
    n = len(made["doc_id"])
    yield {k: [None] * n for k in blank} | made | {"kind": ["done"] * n}
    if waits.any():
        # The waiting texts move together.
        lengths = np.where(waits, chunk.ends - chunk.starts, 0)
        shift = chunk.starts - np.cumsum(lengths) + lengths
        moved = lambda at: at - shift[doc_of(at)]
        mine = waits[doc_of(low)]
        texts = b"".join(chunk.data[a:b].tobytes() for a, b in zip(chunk.starts[waits], chunk.ends[waits]))
        yield blank | {
            "kind": ["waiting"], "chunk": [chunk.number], "size": [len(texts)], "ids": [chunk.ids[waits].tobytes()],
            "unnamed": [chunk.unnamed[waits].tobytes()], "ends": [np.cumsum(lengths[waits]).astype("<i8").tobytes()],
            "texts": [squeeze(texts)], "windows": [rising(moved(windows))], "classes": [small(classes)],
            "low": [rising(moved(low[mine]))], "high": [small(high[mine] - low[mine])],
            "begin": [rising(moved(p["low"][shared]))], "sizes": [small(size[shared])],
        }
