"""Ranked lexical search: accumulators of short lists walked together with long lists, document by document."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import arrow_map, arrow_schema, fresh, record, ship, small_batches, stored
from .words import MARKS, Words, pieces

# Texts of one segment of the index, documents of one block of segments, items of one group: bounds of a cell of work.
SEGMENT_BYTES = 16 << 20
BLOCK = 16_384
GROUP = 256
SHORT = 32
SPAN = 1_024
SEGMENT = "seg long, n_docs long, n_terms long, ids binary, lengths binary, terms array<long>, dfs array<long>, docs binary, tfs binary"


def tokens(column) -> tuple:
    """``(hash, text)`` of every term of a run of texts."""
    hashes, text = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for row, data, starts in pieces(column):
        words = Words(data, starts, lower=True, between=MARKS)
        hashes.append(words.hash)
        text.append(row + np.repeat(np.arange(len(words.count)), words.count))
    return np.concatenate(hashes), np.concatenate(text)


def postings(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple:
    """``(terms, dfs, docs, tfs)``: terms in order, and of each its documents in order with the occurrences.

    ``text`` ascends and stays below ``n``.
    """
    order = np.argsort(hashes, kind="stable")
    hashes, text = hashes[order], text.astype(np.min_scalar_type(n))[order]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    pair = first.copy()
    pair[1:] |= text[1:] != text[:-1]
    at = np.flatnonzero(pair)
    tfs, begins = np.diff(at, append=len(hashes)), np.flatnonzero(first[at])
    return hashes[first], np.diff(begins, append=len(at)), text[at], tfs


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Inverted lists of all terms in segments of about 16 MB of text, each made where its texts are read.

    A row with a NULL key is left out; a NULL text has no terms; rows that repeat a key are documents of their own.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t")).filter("id is not null")
    ship(docs.sparkSession)
    target = arrow_schema(SEGMENT)

    def segment(made, held):
        ids, hashes, lengths = (np.concatenate(part) for part in zip(*held))
        terms, dfs, at, tfs = postings(hashes, np.repeat(np.arange(len(ids), dtype="<u4"), lengths), len(ids))
        return record({
            "seg": [(TaskContext.get().partitionId() << 32) + made], "n_docs": [int((lengths > 0).sum())],
            "n_terms": [len(hashes)], "ids": [ids.tobytes()],
            "lengths": [lengths.astype("<i8").tobytes()], "terms": [terms.view(np.int64)], "dfs": [dfs],
            "docs": [at.astype("<u4").tobytes()], "tfs": [tfs.astype("<u4").tobytes()],
        }, target)

    def run(batches):
        fresh()
        made, held, size = 0, [], 0
        for batch in batches:
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            for row, data, starts in pieces(column, SEGMENT_BYTES):
                n = len(starts) - 1
                if held and size + len(data) > SEGMENT_BYTES:
                    yield segment(made, held)
                    made, held, size = made + 1, [], 0
                hashes, owner = tokens(column.slice(row, n))
                held.append((ids[row : row + n].astype("<i8"), hashes, np.bincount(owner, minlength=n)))
                size += len(data)
        if held:
            yield segment(made, held)

    with small_batches(docs.sparkSession):
        return stored(rows.mapInArrow(run, SEGMENT), "segments", group=1)


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item, term, repeats``: one row for each term of an item; of rows that repeat a key the smallest text counts."""
    rows = items.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("long").alias("item")).agg(
        F.min(F.col(f"`{text}`")).alias("t"))

    def split(batch):
        hashes, owner = tokens(batch.column(1))
        terms, dfs, at, tfs = postings(hashes, owner, batch.num_rows)
        yield {"item": batch.column(0).to_numpy()[at], "term": np.repeat(terms, dfs).view(np.int64), "repeats": tfs}

    with small_batches(items.sparkSession):
        return stored(arrow_map(rows, split, "item long, term long, repeats long"), "items")


class Lists:
    """The lists of a segment for the terms of a group, with what each posting and at most each list adds to a weight."""

    def __init__(self, row: dict, vocabulary: np.ndarray, n_all: int, l_all: int):
        terms = np.asarray(row["terms"], np.int64).view(np.uint64)
        self.ids, lengths = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
        starts = np.concatenate([[0], np.cumsum(np.asarray(row["dfs"], np.int64))])
        place = np.minimum(np.searchsorted(terms, vocabulary), max(len(terms) - 1, 0))
        held = terms[place] == vocabulary if len(terms) else np.zeros(len(vocabulary), bool)
        first, count = starts[place] * held, (starts[place + 1] - starts[place]) * held if len(terms) else np.zeros(len(vocabulary), np.int64)
        self.start = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(first - self.start[:-1], count) + np.arange(self.start[-1])
        self.docs = np.frombuffer(row["docs"], "<u4")[at].astype(np.int64)
        tf = np.frombuffer(row["tfs"], "<u4")[at].astype(np.int64)
        m = 75 + 25 * lengths * n_all // max(l_all, 1)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.docs])
        self.most = np.zeros(len(vocabulary), np.int64)
        some = np.flatnonzero(count)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.impact, self.start[some])

    def one(self, term: int, weight: int) -> tuple:
        """``(documents, scores)`` of one list."""
        at = slice(self.start[term], self.start[term + 1])
        return self.docs[at], self.impact[at] * weight


class Best:
    """The ``k`` highest scores so far, ties to smaller keys; ``least`` is what a document needs to enter."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = max(int(self.scores[-1]), 1)


def walk(lists: Lists, terms: np.ndarray, weights: np.ndarray, best: Best, short: int = SHORT, span: int = SPAN) -> int:
    """Offer ``best`` the documents of a segment that can enter it; returns how many were scored in full.

    Lists of at most one ``short``-th of the documents are summed into accumulators, term at a time. These
    form one iterator, bounded by their largest sum, beside the long lists, bounded by their largest
    scores. Documents are taken in order, ``span`` numbers at a time: those in no iterator but ones whose bounds together stay below
    the entry score are passed over, and a document leaves as soon as its sum and the bounds not yet looked up stay below.
    """
    n, sizes = len(lists.ids), lists.start[terms + 1] - lists.start[terms]
    used = (sizes > 0) & (weights > 0)
    brief = used & (sizes * short <= n)
    sums = np.zeros(n, np.int64)
    for term, weight in zip(terms[brief], weights[brief]):
        docs, scores = lists.one(term, weight)
        sums[docs] += scores
    summed = np.flatnonzero(sums)
    iterators = [(int(sums[summed].max()), summed, sums[summed])] if len(summed) else []
    for i in np.flatnonzero(used & ~brief):
        iterators.append((int(lists.most[terms[i]] * weights[i]), *lists.one(terms[i], weights[i])))
    iterators.sort(key=lambda one: one[0])
    bounds = np.cumsum([one[0] for one in iterators])
    scored = 0
    for begin in range(0, n, span):
        # Documents that only stand in the first of these cannot enter.
        weak = int(np.searchsorted(bounds, best.least))
        if weak == len(iterators):
            break
        part = np.zeros(span, np.int64)
        for _, docs, scores in iterators[weak:]:
            a, b = np.searchsorted(docs, [begin, begin + span])
            part[docs[a:b] - begin] += scores[a:b]
        left = np.flatnonzero(part)
        total = part[left]
        for i in range(weak - 1, -1, -1):
            hope = total + bounds[i] >= best.least
            left, total = left[hope], total[hope]
            if not len(left):
                break
            _, docs, scores = iterators[i]
            at = np.searchsorted(docs, left + begin)
            at[at == len(docs)] = 0
            total = total + np.where(docs[at] == left + begin, scores[at], 0)
        good = total >= best.least
        scored += len(total)
        if good.any():
            best.add(lists.ids[left[good] + begin], total[good])
    return scored


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0, ties to smaller keys.

    Terms, weights and scores are those of a saturating term frequency with length norm in whole numbers:
    a term weighs ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and adds
    ``w * (10**9 * tf div (1000 * tf + 12 * m))`` for each of its repeats in the item, with ``m = 75 + 25 * n * N div L``.

    Rows with a NULL key take no part, not even in ``N`` and ``L``; a NULL or empty text has no terms: such a document is
    never found, such an item finds nothing. Of items that repeat a key the smallest text counts; documents that repeat a
    key are documents of their own. Other columns are ignored, whatever their names. Without documents or terms there are no rows.

    The index is cut by documents and made without a shuffle of texts. Every block of about 16,384 documents
    meets every group of 256 items once and gives at most k rows an item; entry scores carry over from segment to segment.
    A group comes before the segments of its block, which a worker takes one at a time.
    """
    index = build_index(docs, key, text)
    asked = item_terms(items, item, item_text)
    n_all, l_all, held = index.agg(F.sum("n_docs"), F.sum("n_terms"), F.sum(F.length("ids") / 8)).first()
    n_all, l_all, blocks = n_all or 0, l_all or 0, max(-(-int(held or 0) // BLOCK), 1)
    found = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).select(
        F.col("p.terms").alias("term"), F.col("p.dfs").alias("df"))
    dfs = found.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_all + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(dfs, "term").select("item", "term", (F.col("repeats") * weight).alias("weight"))
    groups = max(-(-asked.select("item").distinct().count() // GROUP), 1)
    weighed = weighed.withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
    target = arrow_schema("item_id long, doc_id long, score long")

    def pack(group: pa.Table) -> pa.Table:
        return pa.table({"grp": group["grp"][:1]} | {
            c: [group[c].to_numpy().astype("<i8").tobytes()] for c in ("item", "term", "weight")})

    def cells(batches):
        fresh()
        of, best = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c).slice(i, 1) for c in batch.schema.names}
                now = one["grp"][0].as_py(), one["block"][0].as_py()
                if not one["seg"].null_count:
                    # A group without items has no row of its own.
                    if of == now:
                        lists = Lists(
                            {c: one[c][0].as_buffer() for c in ("ids", "lengths", "docs", "tfs")}
                            | {c: one[c].flatten().to_numpy() for c in ("terms", "dfs")}, vocabulary, n_all, l_all)
                        for found, rows in zip(best, places):
                            walk(lists, place[rows], weights[rows], found)
                    continue
                if best:
                    yield offered(names, best)
                asked_items, term, weights = (np.frombuffer(one[c][0].as_py(), "<i8") for c in ("item", "term", "weight"))
                vocabulary, place = np.unique(term.view(np.uint64), return_inverse=True)
                names, owner = np.unique(asked_items, return_inverse=True)
                order = np.argsort(owner, kind="stable")
                ends = np.cumsum(np.bincount(owner))
                places = [order[i:j] for i, j in zip([0, *ends[:-1]], ends)]
                of, best = now, [Best(k) for _ in names]
        if best:
            yield offered(names, best)

    def offered(names, best):
        return record({
            "item_id": np.repeat(names, [len(o.ids) for o in best]),
            "doc_id": np.concatenate([o.ids for o in best]), "score": np.concatenate([o.scores for o in best]),
        }, target)

    left = weighed.groupBy("grp").applyInArrow(pack, "grp int, item binary, term binary, weight binary")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Tasks write about equal numbers of segments, which take turns.
    turn = F.shiftright("seg", 32) + F.col("seg").bitwiseAND((1 << 32) - 1)
    right = index.withColumn("block", F.pmod(turn, F.lit(blocks)).cast("int")).withColumn(
        "grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = left.unionByName(right, allowMissingColumns=True).repartition("grp", "block").sortWithinPartitions("grp", "block", "seg")
    with small_batches(docs.sparkSession):
        best = stored(met.mapInArrow(cells, "item_id long, doc_id long, score long"), "best")
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
