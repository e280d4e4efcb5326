"""Hard negatives by Four-Russians scoring: subset sums of anchors looked up by bit planes of candidates."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import arrow_schema, record, ship, stored
from .topk import narrow

# Rows of a block of candidates and of a group of anchors: bounds of one cell of work, not of the result.
BLOCK = 4_096
GROUP = 256
LANES = 64
FOUND = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def usable(df: DataFrame, key: str, vector: str, label: str, scale: int, noisy: int, classes: int) -> DataFrame:
    """``id, label, dim, v``: whole-number vectors with their (changed) labels, one row a key."""
    k, v, c = (F.col(f"`{name}`") for name in (key, vector, label))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(k.isNotNull() & c.isNotNull() & v.isNotNull() & good).select(
        k.cast("long").alias("id"), c.cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
    )
    rows = rows.withColumn("label", F.when(F.col("id") % noisy == 0, (F.col("label") + 1) % classes).otherwise(F.col("label")))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("id", "r.label", F.size("r.v").alias("dim"), "r.v")


def bit_planes(m: np.ndarray) -> tuple:
    """``(planes, eights, rows)`` bytes: bit b of eight neighbouring components is one byte.

    Numbers are in two's complement with as many planes as the widest needs; the last one counts negative.
    """
    n, dim = m.shape
    widest = int(np.where(m < 0, ~m, m).max(initial=0))
    padded = np.zeros((n, -(-dim // 8) * 8), np.int64)
    padded[:, :dim] = m
    planes = [np.packbits(((padded >> b) & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(widest.bit_length() + 1)]
    return np.ascontiguousarray(np.stack(planes))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """``(eights, 256, anchors)``: for each byte the sum of those of an anchor's eight components whose bits are set."""
    n, dim = anchors.shape
    padded = np.zeros((n, -(-dim // 8) * 8), np.int64)
    padded[:, :dim] = anchors
    sums = np.zeros((padded.shape[1] // 8, 1, n), np.int64)
    for j in range(8):
        sums = np.concatenate([sums, sums + padded[:, j::8].T[:, None, :]], axis=1)
    return sums


def scores(planes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, one row a candidate: look-ups added over the bytes of a plane, planes by shift and add."""
    depth, eights, n = planes.shape
    out = np.zeros((n, len(anchors)), np.int64)
    reach = int(np.abs(anchors.astype(np.float64)).sum(axis=1).max(initial=0)) << depth
    kind = np.int32 if reach < 1 << 31 else np.int64
    for a in range(0, len(anchors), LANES):
        sums = subset_sums(anchors[a : a + LANES]).astype(kind)
        width = sums.shape[2]
        for r in range(0, n, 2_048):
            part = planes[:, :, r : r + 2_048].astype(np.intp)
            total = np.zeros((part.shape[2], width), kind)
            looked = np.empty_like(total)
            for b in range(depth - 1, -1, -1):
                if b < depth - 1:
                    np.left_shift(total, 1, out=total)
                for g in range(eights):
                    np.take(sums[g], part[b, g], axis=0, out=looked, mode="clip")
                    total += looked
                if b == depth - 1:
                    np.negative(total, out=total)
            out[r : r + 2_048, a : a + LANES] = total
    return out


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by id."""
    if len(score) > k:
        rows = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        rows = np.arange(len(score))
    return rows[np.lexsort((ids[rows], -score[rows]))][:k]


def in_window(score: np.ndarray, positive: int, low: int, high: int) -> np.ndarray:
    """Places with ``low * positive <= 100 * score <= high * positive``, in whole numbers."""
    least, most = -(-(low * positive) // 100), high * positive // 100
    return np.flatnonzero((score >= least) & (score <= most)) if least <= most else np.zeros(0, np.int64)


def matrix(raw: bytes, kind: int, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{kind}").reshape(n, dim).astype(np.int64)


def packed(group: pa.Table, *extra: str) -> dict:
    """Vectors of one length in order of labels and ids, with the columns ``extra``."""
    ids, labels = group["id"].to_numpy(), group["label"].to_numpy()
    dim = group["dim"][0].as_py()
    flat = group["v"].combine_chunks().flatten().to_numpy()
    order = np.lexsort((ids, labels))
    m = flat.reshape(len(ids), dim)[order] if dim else np.zeros((len(ids), 0), np.int64)
    made = {"ids": [ids[order].astype("<i8").tobytes()], "labels": [labels[order].astype("<i8").tobytes()]}
    return made | {name: group[name].take(pa.array(order)) for name in extra} | {"m": m}


def pack_block(group: pa.Table) -> pa.Table:
    made = packed(group)
    planes = bit_planes(made.pop("m"))
    return pa.table({"dim": group["dim"][:1], "block": group["block"][:1], "b_ids": made["ids"], "b_labels": made["labels"],
                     "planes": [planes.tobytes()], "depth": pa.array([len(planes)], pa.int32())})


def pack_anchors(keys: list, schema: str):
    target = arrow_schema(schema)

    def pack(group: pa.Table) -> pa.Table:
        made = packed(group, *(n for n in ("wanted",) if n in target.names))
        small = narrow(made.pop("m"))
        made |= {n: [made[n].to_pylist()] for n in ("wanted",) if n in made} | {k: group[k][:1].to_pylist() for k in keys}
        return pa.Table.from_batches([record(made | {"anchors": [small.tobytes()], "bytes": [small.dtype.itemsize]}, target)])

    return pack


def cell_parts(row: dict) -> tuple:
    """``(anchor ids, labels, vectors, candidate ids, labels, planes)`` of one group of anchors and one block."""
    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
    b_ids, b_labels = np.frombuffer(row["b_ids"], "<i8"), np.frombuffer(row["b_labels"], "<i8")
    anchors = matrix(row["anchors"], row["bytes"], row["dim"], len(ids))
    planes = np.frombuffer(row["planes"], np.uint8).reshape(row["depth"], -(-row["dim"] // 8), len(b_ids))
    return ids, labels, anchors, b_ids, b_labels, planes


def mine(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100,
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, noisy: int = 7,
         classes: int = 10) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its
    best rows of the same label the first rows of other labels whose score is ``low`` to ``high`` hundredths of it.

    Components are ``floor(scale * x)`` as 64-bit integers; a row's score is its inner product with the anchor (64 bits),
    higher first, ties to smaller keys. Anchors are the rows whose key is divisible by ``every``; labels of keys divisible by
    ``noisy`` move to the next of ``classes``. NULL keys, labels, vectors, and vectors with NULL or non-finite components
    take no part; rows that repeat a key count once, with the smallest label and vector; vectors of
    different lengths are not compared, empty ones score 0; a positive scored below 0 has no negatives. Other columns,
    whatever their names, are ignored. An empty table gives no rows.

    Candidates are dealt into blocks of about 4,096, every label over as many places as it has rows for, so no label
    fills a block. An anchor meets the blocks of its own label for its positives, then, knowing the windows, all
    blocks for the negatives, in groups of 256: work grows with anchors times rows, as the anchors are stated so.
    """
    ship(df.sparkSession)
    rows = stored(usable(df, key, vector, label, scale, noisy, classes), "vectors")
    counts = rows.groupBy("dim", "label").agg(F.count("*").alias("n"))
    dims = counts.groupBy("dim").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    parts = F.ceil(F.col("n") * 4 / BLOCK).cast("int").alias("parts")
    counts = stored(counts.join(dims, "dim").select("dim", "label", "blocks", parts), "labels")

    def place(part):
        return F.pmod(F.xxhash64("label", part), F.col("blocks")).cast("int")

    dealt = rows.join(counts, ["dim", "label"]).withColumn("block", place(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    blocks = stored(dealt.groupBy("dim", "block").applyInArrow(
        pack_block, "dim int, block int, b_ids binary, b_labels binary, planes binary, depth int"), "planes")

    asked = rows.filter(F.col("id") % every == 0)
    met = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), place))
    homes = asked.join(counts, ["dim", "label"]).withColumn("block", F.explode(met))
    found = in_cells(homes, blocks, lambda row: own_label(row, positives), "anchor_id long, positive_id long, positive_score long")
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = stored(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives), "positives")

    wanted = first.groupBy(F.col("anchor_id").alias("id")).agg(
        F.collect_list(F.struct("positive_score", "positive_id")).alias("wanted"))
    mined = in_cells(asked.join(wanted, "id"), blocks, lambda row: other_labels(row, negatives, low, high), FOUND)
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def in_cells(anchors: DataFrame, blocks: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(row) -> dict of arrays`` over each group of about ``GROUP`` anchors and each block that they meet.

    Anchors that name a ``block`` meet this one, others all blocks of their length.
    """
    named = "block" in anchors.columns
    keys = ["dim", "block"] if named else ["dim"]
    kept = [n for n in ("wanted",) if n in anchors.columns]
    sizes = stored(anchors.groupBy(*keys).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("subs")), "groups")
    dealt = anchors.join(sizes, keys).withColumn("sub", F.pmod(F.xxhash64("id", F.lit(1)), F.col("subs")).cast("int"))
    shape = ", ".join(f"{k} int" for k in keys) + ", sub int, ids binary, labels binary, anchors binary, bytes int"
    shape += ", wanted array<array<struct<positive_score: long, positive_id: long>>>" if kept else ""
    groups = dealt.select(*keys, "sub", "id", "label", "v", *kept).groupBy(*keys, "sub").applyInArrow(pack_anchors([*keys, "sub"], shape), shape)
    if not named:
        groups = groups.join(blocks.select("dim", "block").toDF("dim", "block"), "dim")
    copies = blocks.join(sizes, keys).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")
    target = arrow_schema(schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return target.empty_table()
        return pa.Table.from_batches([record(fn(a.to_pylist()[0] | b.to_pylist()[0]), target)])

    cell = ["dim", "block", "sub"]
    return groups.groupBy(*cell).cogroup(copies.groupBy(*cell)).applyInArrow(run, schema)


def own_label(row: dict, k: int) -> dict:
    """The ``k`` best other rows of its label that a block holds, for each anchor."""
    ids, labels, anchors, b_ids, b_labels, planes = cell_parts(row)
    out = [[], [], []]
    for one in np.unique(labels):
        at = slice(np.searchsorted(b_labels, one), np.searchsorted(b_labels, one, "right"))
        asked = np.flatnonzero(labels == one)
        table = scores(planes[:, :, at], anchors[asked])
        for j, a in enumerate(asked):
            others = np.flatnonzero(b_ids[at] != ids[a])
            top = others[best(b_ids[at][others], table[others, j], k)]
            out[0].append(np.full(len(top), ids[a]))
            out[1].append(b_ids[at][top])
            out[2].append(table[top, j])
    return dict(zip(("anchor_id", "positive_id", "positive_score"), (np.concatenate(c) for c in out)))


def other_labels(row: dict, k: int, low: int, high: int) -> dict:
    """The ``k`` best rows of other labels in the window of each positive that a block holds."""
    ids, labels, anchors, b_ids, b_labels, planes = cell_parts(row)
    table = np.ascontiguousarray(scores(planes, anchors).T)
    out = [[] for _ in range(5)]
    for a, wanted in enumerate(row["wanted"]):
        others = np.flatnonzero(b_labels != labels[a])
        score, theirs = table[a][others], b_ids[others]
        for want in wanted:
            inside = in_window(score, want["positive_score"], low, high)
            top = inside[best(theirs[inside], score[inside], k)]
            for c, values in zip(out, (ids[a], want["positive_id"], theirs[top], want["positive_score"], score[top])):
                c.append(np.broadcast_to(values, len(top)))
    return dict(zip(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), map(np.concatenate, out)))
