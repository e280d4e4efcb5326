"""Exact Jaccard join of documents by their word shingles, in regions around pivots.

The distance of two sets is 1 minus their Jaccard similarity, a metric. Two documents link at a
distance of at most ``radius``.

First level. Whole documents make poor pivots here: nearly all others are at distance 1 from any of
them, in no region. So the pivots of the first level are the shingles themselves, as sets of one. A
document lies closest, and equally close, to the shingles it holds; the region of a shingle holds the
documents that could have it as their first common one, by an order from rare to frequent shingles.
That is the window: two documents that link share at least 3/4 of either, so they meet in a region
among the first quarter of each one's shingles.

Below. Each region takes one of its documents as a pivot, and the distances of the others to it are
computed exactly. Documents within the radius link to it and need no comparison among themselves.
Regions whose documents are in one component by then are done. In the others only pairs across
components are left, and of those only pairs that two windows allow: their distances to the region's
pivot must not differ by more than the radius (triangle inequality), and the places of the region's
shingle in both must leave enough room for what they have to share. Every pair that could link is thus
compared, or lies in one component already.

Texts travel to be compared only if they may link by their sketches: counts of shingles by range of
hashes, of which the smaller ones add up to a bound of what two sets share. Other pairs have a distance
beyond the radius, and its lower bound serves the triangle inequality.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, arrow_schema, fresh, record, ship, stored
from .components import components
from .words import U, mix, pieces, shingle_sets

SIZE = 5
PERCENT = 75
HEAVY = 1_000_000
HEAVY_BLOCK = 1 << 21
HEAVY_LEAST = 2
REGION_ROWS = 300_000
HOT = 100_000
FLUSH = 1 << 18
BITS = 1 << 23
GROUP = 64
SKETCH = 256
SKETCH_MOST = 255
SKETCH_ROWS = 1024


def class_key(shingles, at):
    """A 61-bit number of each set, the same for equal sets."""
    if not len(shingles):
        return np.zeros(len(at) - 1, np.int64)
    total = np.concatenate([[U(0)], np.cumsum(mix(shingles, 3), dtype=np.uint64)])
    return (mix((total[at[1:]] - total[at[:-1]]) + np.diff(at).astype(np.uint64)) >> U(3)).astype(np.int64)


def scan_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``doc_id, n, c, frequent``: a row of every document, its set's size and class, ``c`` NULL for empty sets.

    Rows marked ``frequent`` hold a shingle (``c``) and its number of texts (``n``) in a block of two million
    shingles, if that is two or more.
    """
    schema = "doc_id long, n long, c long, frequent boolean"
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    ship(docs.sparkSession)
    target = arrow_schema(schema)

    def counted(held):
        # All but the first of each are counted: few, so nothing as long as the block is made beside its copy.
        s = np.concatenate(held)
        s.sort()
        s, n = np.unique(s[1:][s[1:] == s[:-1]], return_counts=True)
        n += 1
        often = n >= HEAVY_LEAST
        s, n = s[often].view(np.int64), n[often]
        return record({"doc_id": pa.nulls(len(s), pa.int64()), "n": n, "c": s, "frequent": np.ones(len(s), bool)}, target)

    def run(batches):
        fresh()
        held, amount, seen = [], 0, set()
        for batch in batches:
            for first, data, rows in pieces(batch["t"]):
                shingles, at = shingle_sets(data, rows, size)
                n, c = np.diff(at), class_key(shingles, at)
                yield record({
                    "doc_id": batch["k"].slice(first, len(n)), "n": n, "c": pa.array(c, mask=n == 0),
                    "frequent": np.zeros(len(n), bool),
                }, target)
                for i, one in enumerate(c.tolist()):
                    if one not in seen:  # copies count once in a block
                        seen.add(one)
                        held.append(shingles[at[i] : at[i + 1]])
                        amount += len(held[-1])
                if amount >= HEAVY_BLOCK:
                    yield counted(held)
                    held, amount, seen = [], 0, set()
        if held:
            yield counted(held)

    return rows.mapInArrow(run, schema)


def frequent_shingles(scanned: DataFrame, most: int = HEAVY) -> tuple:
    """The most frequent shingles and their numbers, at most ``most``: 16 bytes each, to be broadcast.

    They only serve the order of shingles and the dealing of rows; results do not depend on them.
    """
    counted = scanned.filter("frequent").groupBy(F.col("c").alias("s")).agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "s").limit(most).toArrow()
    s, n = found["s"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


# What travels of a document to each of its regions, column by column.
ENTRY = [("s", "<u4"), ("c", "<i8"), ("n", "<u4"), ("pos", "<u2"), ("rare", "u1"), ("dealt", "u1")]


def pack_entries(columns: list) -> bytes:
    return b"".join(v.astype(kind).tobytes() for v, (_, kind) in zip(columns, ENTRY))


def unpack_entries(raw: bytes) -> list:
    widths = [np.dtype(kind).itemsize for _, kind in ENTRY]
    n, at, out = len(raw) // sum(widths), 0, []
    for width, (_, kind) in zip(widths, ENTRY):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * width
    return out


def may_link(n, pos, m, at, percent):
    """Whether sets of ``n`` and ``m`` shingles can link if their first common one is at ``pos`` and ``at``.

    What they share comes at or behind these places, and linking takes percent / (100 + percent) of both
    sizes together.
    """
    least = percent * (n + m)
    return ((100 + percent) * (n - pos) >= least) & ((100 + percent) * (m - at) >= least)


def has_partner(s, n, pos, percent, most=32):
    """Which rows of sorted regions ``s`` can link with another row of theirs; all rows of regions over ``most``."""
    begins = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    length = np.repeat(np.diff(np.append(begins, len(s))), np.diff(np.append(begins, len(s))))
    found = length > most
    left = np.flatnonzero((length > 1) & ~found)
    for step in range(1, most):
        left = left[left + step < len(s)]
        left = left[s[left] == s[left + step]]
        if not len(left):
            break
        ok = left[may_link(n[left], pos[left], n[left + step], pos[left + step], percent)]
        found[ok] = True
        found[ok + step] = True
    return found


def region_rows(docs: DataFrame, text: str, size: int, percent: int, known, buckets: int) -> DataFrame:
    """``s, c, n, pos, p, near``: the documents of every region with two or more, and the region's pivot.

    ``pos`` is the place of the region's shingle in the document's order, ``near`` says whether the document
    can link with the pivot through this region. The pivot is the document with the smallest share of
    shingles that no other has: an original rather than one of its changed copies. Tasks send their
    rows packed, by bucket of regions. A frequent shingle's documents are dealt over several groups,
    each with a pivot of its own.
    """
    ship(docs.sparkSession)
    packed = "b long, rows binary"
    target = arrow_schema(packed)

    def deal(held):
        s, c, n, pos, rare, salts = [np.concatenate(column) for column in zip(*held)]
        bucket = ((s >> U(32)) % U(buckets)).astype(np.int64)
        salt = (mix(c.astype(np.uint64), 9) % salts.astype(np.uint64)).astype(np.int64)
        group = salt * buckets + bucket
        order = np.argsort(group, kind="stable")
        columns = [v[order] for v in (s & U(0xFFFFFFFF), c, n, pos, rare, salts > 1)]
        group = group[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        return {
            "b": group[cuts[:-1]],
            "rows": [pack_entries([v[i:j] for v in columns]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())],
        }

    def send(batches):
        fresh()
        heavy, number = known.value
        held, amount, sent = [], 0, set()
        for batch in batches:
            for _, data, rows in pieces(batch["t"]):
                shingles, at = shingle_sets(data, rows, size)
                classes = class_key(shingles, at).tolist()
                place = np.searchsorted(heavy, shingles)
                place[place == len(heavy)] = 0
                count = np.where(heavy[place] == shingles, number[place], 0) if len(heavy) else np.zeros(len(shingles), int)
                level = np.frexp(count.astype(float))[1].astype(np.int8)
                for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    n, one = hi - lo, classes[i]
                    if not n or one in sent:
                        continue
                    if len(sent) < 1_000_000:
                        sent.add(one)
                    order = np.argsort(level[lo:hi], kind="stable")
                    # Linking documents share at least percent hundredths of either.
                    first = n + (-n * percent // 100) + 1
                    picked = order[:first] + lo
                    rare = 255 * int(np.count_nonzero(level[lo:hi] == 0)) // n
                    held.append((
                        shingles[picked], np.full(first, one, np.int64), np.full(first, n, np.uint32),
                        np.minimum(np.arange(first), 65_535).astype(np.uint16), np.full(first, rare, np.uint8),
                        np.maximum(count[picked] // HOT, 1).astype(np.uint32),
                    ))
                    amount += first
                if amount >= FLUSH:
                    yield record(deal(held), target)
                    held, amount = [], 0
        if held:
            yield record(deal(held), target)

    def regions(group: pa.Table) -> pa.Table:
        got = [np.concatenate(column) for column in zip(*[unpack_entries(r.as_py()) for r in group["rows"]])]
        bucket = group["b"][0].as_py() % buckets
        order = np.lexsort((got[1], got[4], got[0]))
        s, c, n, pos, rare, dealt = [column[order] for column in got]
        # A class sent by several tasks counts once.
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        s, c, dealt = s[new], c[new], dealt[new]
        n, pos = n[new].astype(np.int64), pos[new].astype(np.int64)
        # Only documents that can link with another one of the region stay in it.
        keep = has_partner(s, n, pos, percent) | (dealt > 0)
        s, c, n, pos = s[keep], c[keep], n[keep], pos[keep]
        begins = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        pivot = np.repeat(begins, np.diff(np.append(begins, len(s))))
        near = may_link(n, pos, n[pivot], pos[pivot], percent) & (c != c[pivot])
        return pa.table({
            "s": pa.array(s.astype(np.int64) | (bucket << 32)), "c": pa.array(c), "n": pa.array(n), "pos": pa.array(pos),
            "p": pa.array(c[pivot]), "near": pa.array(near),
        })

    texts = docs.select(F.col(f"`{text}`").alias("t"))
    dealt = texts.mapInArrow(send, packed).repartition("b")
    return dealt.groupBy("b").applyInArrow(regions, "s long, c long, n long, pos long, p long, near boolean")


def bit_of(key: str):
    return F.pmod(F.xxhash64(F.col(f"`{key}`").cast("long")), F.lit(BITS))


def bitmap(df: DataFrame, key: str) -> np.ndarray:
    """A megabyte of marks, whatever the data: a key's bit is set if ``df`` holds it, or one like it."""
    at = bit_of(key) + 1  # these functions count from 1
    rows = df.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    ).toArrow()
    marks = np.zeros(BITS // 8, np.uint8)
    for n, bits in zip(rows["n"].to_pylist(), rows["bits"].to_pylist()):
        first = (n - 1) * 4096
        marks[first : first + 4096] = np.frombuffer(bits, np.uint8)
    return marks


def in_bitmap(marks: np.ndarray, rows) -> np.ndarray:
    return (marks[rows >> 3] >> (rows & 7).astype(np.uint8) & 1).astype(bool)


def sketch(shingles, at):
    """A row for each set: how many of its shingles lie in each of ``SKETCH`` ranges, ``SKETCH_MOST`` for that many or more."""
    rows = np.zeros((len(at) - 1, SKETCH), np.uint8)
    for i in range(0, len(rows), SKETCH_ROWS):
        j = min(i + SKETCH_ROWS, len(rows))
        cell = (shingles[at[i] : at[j]] // U((1 << 64) // SKETCH)).astype(np.int64)
        cell += SKETCH * np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
        counts = np.bincount(cell, minlength=SKETCH * (j - i))
        rows[i:j] = np.minimum(counts, SKETCH_MOST).reshape(-1, SKETCH)
    return rows


def most_common(x, y, n, m):
    """The most shingles that sets of ``n`` and ``m`` with the sketches ``x`` and ``y`` can share."""
    low, smaller = np.minimum(x, y), np.minimum(n, m)
    most = np.minimum(low.sum(axis=1, dtype=np.int64), smaller)
    return np.where((low == SKETCH_MOST).any(axis=1), smaller, most)


def bounded(pairs: DataFrame, rows: DataFrame, keep, size: int, percent: int) -> DataFrame:
    """``a, b, d, may`` of pairs of classes, stored: whether they may link by their sketches, and the least distance they can have.

    ``keep`` picks from a batch of ``rows`` the texts ``t`` of all classes of the pairs, and perhaps others.
    """
    held = "c long, n long, sketch binary"

    def measure(batch):
        for _, data, at_rows in pieces(keep(batch)["t"]):
            shingles, at = shingle_sets(data, at_rows, size)
            made = sketch(shingles, at)
            yield {"c": class_key(shingles, at), "n": np.diff(at), "sketch": [row.tobytes() for row in made]}

    sketches = arrow_map(rows, measure, held).groupBy("c").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sketches = stored(sketches, "sketches")
    both = pairs.join(sketches.toDF("a", "n", "x"), "a").join(sketches.toDF("b", "m", "y"), "b")

    def judge(batch):
        x, y = [np.frombuffer(b"".join(batch[k].to_pylist()), np.uint8).reshape(-1, SKETCH) for k in ("x", "y")]
        n, m = batch["n"].to_numpy(), batch["m"].to_numpy()
        most = most_common(x, y, n, m)
        yield {
            "a": batch["a"], "b": batch["b"], "d": 1 - most / (n + m - most), "may": (100 + percent) * most >= percent * (n + m)
        }

    return stored(arrow_map(both, judge, "a long, b long, d double, may boolean"), "bounded")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, size: int,
           percent: int) -> DataFrame:
    """``a, b, lo, hi, linked`` of pairs of classes, stored: bounds of their distances, exact ones for pairs that may link.

    The text of ``b`` travels to the one of ``a``, once for each pair that may link by the sketches; what many pairs share
    as ``a`` is copied for every ``GROUP`` of them, so that no task gets more of one document's pairs. Rows arrive in order
    and are compared one by one with the last ``a``.
    """
    pairs = stored(pairs, "pairs")
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"), bit_of(key).alias("bit")
    )

    def keeper(wanted):
        marks = bitmap(wanted, "doc_id")

        def keep(batch):
            wanted_here = pa.array(in_bitmap(marks, batch["bit"].to_numpy()))
            return {k: batch[k].filter(wanted_here) for k in ("doc_id", "t")}

        return keep

    ends = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    ends = stored(ends.join(classes.select("c", "doc_id"), "c"), "ends")
    judged = bounded(pairs, rows, keeper(ends), size, percent)
    pairs = judged.filter("may").select("a", "b")
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    groups = stored(groups.withColumn("groups", F.col("groups").cast("int")), "groups")
    members = pairs.join(groups, "a").select(
        F.col("b").alias("c"), "a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"), F.lit(1).alias("turn")
    )
    leads = groups.select(
        F.col("a").alias("c"), "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("turn")
    )
    wanted = members.unionByName(leads).join(ends, "c")
    wanted = stored(wanted, "wanted")
    keep = keeper(wanted)

    def squeeze(batch):
        kept = keep(batch)
        texts = [(t or "").encode() for t in kept["t"].to_pylist()]
        yield {
            "doc_id": kept["doc_id"], "bytes": [len(t) for t in texts], "t": [pa.compress(t, "zstd", asbytes=True) for t in texts]
        }

    sent = arrow_map(rows, squeeze, "doc_id long, bytes long, t binary").join(wanted, "doc_id").drop("doc_id")
    sent = sent.repartition("a", "part").sortWithinPartitions("a", "part", "turn")
    found = "a long, b long, d double, linked boolean"
    target = arrow_schema(found)

    def compare(batches):
        fresh()
        at_hand, own = None, None
        for batch in batches:
            out = [[], [], [], []]
            keys = list(zip(*[batch[k].to_pylist() for k in ("a", "part", "turn", "c")]))
            texts = [pa.decompress(t, n, "zstd", asbytes=True) for t, n in zip(batch["t"].to_pylist(), batch["bytes"].to_pylist())]
            for first, data, at_rows in pieces(pa.array(texts, pa.large_binary())):
                shingles, at = shingle_sets(data, at_rows, size)
                classes_here = class_key(shingles, at).tolist()
                for k, one in enumerate(classes_here):
                    a, part, turn, c = keys[first + k]
                    if one != c:
                        continue  # another row that repeats the document's key
                    mine = shingles[at[k] : at[k + 1]]
                    if turn == 0:
                        at_hand, own = (a, part), mine.copy()
                    elif at_hand == (a, part):
                        place = np.searchsorted(own, mine)
                        place[place == len(own)] = 0
                        common = int(np.count_nonzero(own[place] == mine))
                        union = len(own) + len(mine) - common
                        for column, value in zip(out, (a, c, 1 - common / union, 100 * common >= percent * union)):
                            column.append(value)
                    else:
                        raise RuntimeError("a pair without its first document")
            yield record(dict(zip(("a", "b", "d", "linked"), out)), target)

    exact = sent.mapInArrow(compare, found).distinct().select("a", "b", F.col("d").alias("lo"), F.col("d").alias("hi"), "linked")
    apart = judged.filter("not may").select("a", "b", F.col("d").alias("lo"), F.lit(1.0).alias("hi"), F.lit(False).alias("linked"))
    return stored(exact.unionByName(apart), "distances")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Words are runs outside ``\\x20`` and ``\\x09-\\x0D`` with A-Z lower-cased; a set holds the distinct
    shingles of ``size`` words, or all words where there are fewer. Two rows link if their sets'
    similarity is at least ``percent`` hundredths; ``component_id`` is the smallest key that links lead to.

    NULL and empty texts have no set and link with nothing. Rows with a NULL key get their count and a
    NULL component, and are no part of other components. Repeated rows and equal sets are one class and
    link with each other. An empty table gives an empty one; other columns are ignored. Shingles and
    sets are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").alias(text))
    scanned = stored(scan_sets(docs, key, text, size), "sets")
    sets = scanned.filter("not frequent").select("doc_id", "n", "c")
    frequent = frequent_shingles(scanned)
    named = docs.filter(F.col(f"`{key}`").isNotNull())
    classes = sets.filter("doc_id is not null and n > 0").groupBy("c").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n")
    )
    classes = stored(classes, "classes")
    amount = classes.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    buckets = int(max(amount // REGION_ROWS + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    known = spark.sparkContext.broadcast(frequent)
    rows = stored(region_rows(named, text, size, percent, known, buckets), "regions")
    known.destroy()

    def checked(pairs):
        return verify(pairs.distinct(), classes, named, key, text, size, percent)

    # The pivot of each region with the others that it can link with.
    pivots = rows.filter("near").select(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b"))
    distances = checked(pivots)
    roots = components(distances.filter("linked"))
    # Rows of the regions that hold several components, with their roots and the largest one's.
    rooted = rows.join(roots.toDF("c", "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    rooted = stored(rooted.drop("near"), "rooted")
    mixed = rooted.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    open_rows = stored(rooted.join(stored(mixed.select("s"), "mixed"), "s"), "open")
    counts = open_rows.groupBy("s", "root").agg(F.count("*").alias("k"))
    main = counts.groupBy("s").agg(F.max(F.struct("k", "root")).alias("m")).select("s", F.col("m.root").alias("main"))
    ends, bounds = ("a", "b"), ("lo", "hi")
    to_pivot = distances.select(*ends, *bounds).unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), *bounds))
    placed = open_rows.join(stored(main, "mains"), "s").join(to_pivot.toDF("p", "c", *bounds), ["p", "c"], "left")
    # Nothing is known of those that cannot link with the pivot through this region.
    placed = placed.withColumns({
        k: F.when(F.col("p") == F.col("c"), 0.0).otherwise(F.coalesce(k, F.lit(unknown))) for k, unknown in zip(bounds, (0.0, 1.0))
    })
    placed = stored(placed, "placed")
    # The pairs across components that the places and the windows allow.
    outside = placed.filter("root <> main").alias("x")
    x, y = (lambda name: F.col(f"x.{name}")), (lambda name: F.col(f"y.{name}"))
    radius = F.lit(1 - percent / 100 + 1e-9)
    window = (x("p") != y("p")) | ((x("lo") - y("hi") <= radius) & (y("lo") - x("hi") <= radius))
    pairs = outside.join(placed.alias("y"), "s").filter(
        (x("root") != y("root")) & ((y("root") == y("main")) | (x("c") < y("c"))) & window
        & may_link(x("n"), x("pos"), y("n"), y("pos"), percent)
    ).select(F.least(x("c"), y("c")).alias("a"), F.greatest(x("c"), y("c")).alias("b")).distinct()
    pairs = pairs.join(distances.select("a", "b"), ["a", "b"], "left_anti")
    links = distances.filter("linked").unionByName(checked(pairs).filter("linked"))
    roots = components(links)
    labelled = classes.join(roots.toDF("c", "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    labelled = stored(labelled.select("c", "doc_id", "root"), "labelled")
    smallest = stored(labelled.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    by_class = stored(labelled.join(smallest, "root").select("c", "component_id"), "component-of")
    return sets.join(by_class, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
