"""Packing of documents into sequences of a fixed length, certified by lower bounds."""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, record, ship, stored
from .tokens import encoder

LENGTH = 2048
ITEMS = 20_000
ROUNDS = 6
# A narrow row for each piece.
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(sizes: np.ndarray, room: int) -> int:
    """A number of bins that no packing can go below: the best of two families of dual feasible
    functions, which map sizes so that whatever fits into a bin still does."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=room + 1).astype(np.int64)
    x = np.arange(room + 1)
    best = -(-int(count @ x) // room)
    # Sizes over room - p count as a whole bin, those under p as nothing.
    total, items = np.concatenate([[0], np.cumsum(count * x)]), np.concatenate([[0], np.cumsum(count)])
    p = np.arange(1, room // 2 + 1)
    big = items[-1] - items[room - p + 1]
    middle = total[room - p + 1] - total[p]
    best = max(best, int(np.max(-(-(big * room + middle) // room))))
    for k in range(1, 51):
        whole = (x * (k + 1)) % room == 0
        scaled = np.where(whole, x * k, (x * (k + 1) // room) * room)
        best = max(best, -(-int(count @ scaled) // (room * k)))
    return best


def best_fit(sizes: np.ndarray, room: int) -> tuple:
    """Best fit decreasing of sizes in falling order: the bin and the place in it of each item."""
    open_bins = [[] for _ in range(room + 1)]  # by free room
    mask, n = 0, 0
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        fits = mask >> s
        if fits:
            free = (fits & -fits).bit_length() - 1 + s
            b = open_bins[free].pop()
            if not open_bins[free]:
                mask &= ~(1 << free)
        else:
            b, free, n = n, room, n + 1
        bins[i], places[i] = b, room - free
        left = free - s
        if not open_bins[left]:
            mask |= 1 << left
        open_bins[left].append(b)
    return bins, places


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
                 length: int = LENGTH) -> DataFrame:
    """``uid, doc_id, piece, start, length, ids_crc32``: whole texts as ids with ``end_id`` behind,
    cut into pieces of ``length`` ids where longer. ``uid`` is a number of the piece's own."""
    ship(docs.sparkSession)
    schema = arrow_schema(PIECES)
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))

    def run(batches):
        from pyspark import TaskContext

        encode, uid = encoder(tokenizer), TaskContext.get().partitionId() << 33
        for batch in batches:
            out = {f.name: [] for f in schema}
            for k, t in zip(batch["k"].to_pylist(), batch["t"]):
                ids = memoryview(encode(t.as_py()) + end)
                n = len(ids) // 4
                for piece, at in enumerate(range(0, n, length)):
                    part = ids[4 * at : 4 * (at + length)]
                    row = (uid, k, piece, at, len(part) // 4, zlib.crc32(part))
                    uid += 1
                    for column, value in zip(out.values(), row):
                        column.append(value)
            yield record(out, schema)

    return rows.mapInArrow(run, PIECES)


def pack(pieces: DataFrame, length: int = LENGTH, items: int = ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (a stored table with ``uid`` and ``length``) with ``sequence_id`` and ``offset``, and what certifies them.

    Pieces of full length fill a sequence alone. The others are dealt at random over partitions of
    about ``items``, at first two or more; each packs its own by best fit decreasing and compares its bins with its lower
    bound, in every round. ``round, part`` name the partition that a piece stays in, ``part_pieces, part_bins, part_bound`` say what
    that one packed, with those that it gave up; all NULL for pieces of full length. Partitions that need more bins than their bound (a gap) give up their emptiest bins, four
    for each bin too many; certified ones only their emptiest. What was given up is dealt anew over
    fewer partitions and packed again, until one partition holds all of it or the rounds end.

    Only these narrow rows are shuffled, never ids. A partition holds a bounded number of them
    whatever the keys are, so no key can be hot.
    """
    ship(pieces.sparkSession)
    columns = pieces.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)

    def packer(turn, final):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["length", "uid"], ascending=[False, True])
            sizes = group["length"].to_numpy()
            bins, places = best_fit(sizes, length)
            filled = np.bincount(bins, sizes)
            give = np.zeros(len(filled), bool)
            bound = lower_bound(sizes, length)
            if not final:
                gap = len(filled) - bound
                emptiest = np.argsort(filled, kind="stable")[: 4 * gap + 1]
                give[emptiest[filled[emptiest] < length]] = True
            part = int(group["part"].iloc[0])
            first = (turn << 55) + (part << 20)
            return group[columns].assign(
                sequence_id=first + bins, offset=places, round=turn, part=part, part_pieces=len(sizes), part_bins=len(filled),
                part_bound=bound, given=give[bins])

        return run

    whole = pieces.filter(F.col("length") >= length)
    said = [F.lit(None).cast("int").alias(c) for c in ("round", "part", "part_pieces", "part_bins", "part_bound")]
    done = whole.select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *said)
    rest = pieces.filter(F.col("length") < length)
    for turn in range(1, rounds + 1):
        left = rest.count()
        if not left:
            break
        parts = max(-(-left // items), min(left, 2) if turn == 1 else 1)
        final = parts == 1 or turn == rounds
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)))
        made = dealt.groupBy("part").applyInPandas(
            packer(turn, final), f"{schema}, sequence_id long, offset long, round int, part int, part_pieces int, part_bins int, part_bound int, given boolean"
        )
        made = stored(made, "packed")
        done = done.unionByName(made.filter("not given").drop("given"))
        rest = made.filter("given").select(*columns)
    return done


def certificates(packed: DataFrame) -> DataFrame:
    """``round, part, pieces, bins, bound, gap`` of each partition that keeps pieces; a gap of 0 proves that it could not do with fewer."""
    one = packed.filter("round is not null").groupBy("round", "part").agg(
        F.max("part_pieces").alias("pieces"), F.max("part_bins").alias("bins"), F.max("part_bound").alias("bound"))
    return one.withColumn("gap", F.col("bins") - F.col("bound"))


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
                   length: int = LENGTH, items: int = ITEMS) -> DataFrame:
    """Sequences of at most ``length`` ids that hold every document once, as few as the bounds allow.

    Returns a row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and the columns of ``pack``. Only
    documents longer than a sequence are cut. NULL texts count as empty and hold just their end;
    NULL and repeated keys are packed row by row; ties in length go by the piece's number; an empty
    table gives no rows; other columns are ignored.
    """
    pieces = stored(token_pieces(docs, tokenizer, key, text, end_id, length), "pieces")
    return pack(pieces, length, items).drop("uid")
