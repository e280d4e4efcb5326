"""Exact top-k search by vector-approximation files."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import ship, stored

CELLS = 64
BLOCK = 16_384
QUERIES = 2_048
STEP = 64


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id, v``: one vector of whole numbers, ``floor(scale * x)``, for each key."""
    good = F.forall(F.col(f"`{vector}`"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = df.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & good)
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def matrix(group: pa.Table) -> tuple:
    """``(ids, one row a vector)`` of a group whose vectors have one length, in order of the ids."""
    ids = group["id"].to_numpy()
    flat = group["v"].combine_chunks().flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order] if len(flat) else np.zeros((len(ids), 0), np.int64)


def narrow(m: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        if not m.size or (m.min() >= np.iinfo(kind).min and m.max() <= np.iinfo(kind).max):
            return m.astype(kind)
    return m


def approximate(m: np.ndarray, cells: int = CELLS) -> tuple:
    """``(cell numbers, low ends, widths)``: every component's range is cut into at most ``cells`` cells."""
    low = m.min(axis=0, initial=np.iinfo(np.int64).max) if len(m) else np.zeros(m.shape[1], np.int64)
    top = m.max(axis=0, initial=np.iinfo(np.int64).min) if len(m) else low
    width = -(-(top - low + 1) // cells)
    return ((m - low) // width).astype(np.uint8), low, width


def best_of_block(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, cell: np.ndarray, low: np.ndarray,
                  width: np.ndarray, exact: np.ndarray, k: int):
    """The ``k`` best rows of a block for each query: yields ``(query number, ids, scores)``.

    The scan of the cells bounds each score from both sides. A row whose upper bound is below the k-th
    best lower bound cannot be among the best. The others' vectors are read from the highest upper
    bound on, until k of them score above every bound that is left.
    """
    corner = (low + cell.astype(np.int64) * width).astype(np.float64)
    more = (width - 1).astype(np.float64)
    for begin in range(0, len(queries), 64):
        part = queries[begin : begin + 64].astype(np.float64)
        scan = part @ corner.T
        up, down = np.maximum(part, 0) @ more, np.minimum(part, 0) @ more
        # For components beyond 2**20 or so the products are no longer exact; leave room for that.
        room = 1e-12 * (np.abs(part) @ (np.abs(low).astype(float) + width * CELLS)) if len(low) else 0 * up
        for i in range(len(part)):
            bound = scan[i] + up[i] + room[i]
            bound[ids == own[begin + i]] = -np.inf
            n = min(k, len(ids))
            # One row more than k, as the query's own may be among them.
            certain = np.partition(scan[i], -min(n + 1, len(ids)))[-min(n + 1, len(ids))] + down[i] - room[i]
            rows = np.flatnonzero((bound >= certain) & (bound > -np.inf))
            rows = rows[np.argsort(-bound[rows], kind="stable")]
            score = np.empty(0, np.int64)
            for at in range(0, len(rows), STEP):
                read = exact[rows[at : at + STEP]].astype(np.int64) @ queries[begin + i]
                score = np.concatenate([score, read])
                rest = at + STEP
                if len(score) >= k and rest < len(rows) and np.partition(score, -k)[-k] > bound[rows[rest]]:
                    break
            found = ids[rows[: len(score)]]
            order = np.lexsort((found, -score))[:k]
            yield begin + i, found[order], score[order]


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20,
           scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query, ties to smaller keys.

    Queries are the rows whose key is divisible by ``every``; candidates are all rows but the query's
    own. Components are ``floor(scale * x)``. Vectors that are NULL or hold NULL or non-finite
    components take no part, nor do NULL keys; rows that repeat a key count once, with their smallest
    vector; vectors of different lengths are not compared, and empty ones score 0. Scores must fit 64 bits.

    Vectors are dealt by a hash of their key into blocks of about 16,384 with approximations of 64 cells a component,
    queries into blocks of about 2,048. Every pair of blocks is one small group that gives k rows a query; no
    group grows with the data, and no vector, however frequent, can fill one. The work is that of
    comparing the stated queries with all rows: it grows with their product.
    """
    ship(df.sparkSession)
    vectors = whole_vectors(df, key, vector, scale).withColumn("dim", F.size("v"))
    vectors = stored(vectors, "vectors")
    asked = vectors.filter(F.col("id") % every == 0)
    dims = vectors.groupBy("dim").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.sum((F.col("id") % every == 0).cast("int")) / QUERIES), F.lit(1)).cast("int").alias("groups"),
    )
    dims = stored(dims, "dims")
    spread = F.pmod(F.xxhash64("id"), F.col("blocks"))
    blocks = vectors.join(dims, "dim").withColumn("block", spread.cast("int")).select("dim", "block", "groups", "id", "v")
    group_of = F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups"))
    groups = asked.join(dims, "dim").withColumn("grp", group_of.cast("int")).select("dim", "grp", "blocks", "id", "v")

    def pack_block(group: pa.Table) -> pa.Table:
        ids, m = matrix(group)
        cell, low, width = approximate(m)
        small = narrow(m)
        return pa.table({
            "dim": group["dim"][:1], "block": group["block"][:1], "groups": group["groups"][:1],
            "ids": [ids.tobytes()], "cells": [cell.tobytes()], "low": [low.tobytes()], "width": [width.tobytes()],
            "exact": [small.tobytes()], "bytes": pa.array([small.dtype.itemsize], pa.int32()),
        })

    def pack_group(group: pa.Table) -> pa.Table:
        ids, m = matrix(group)
        return pa.table({
            "dim": group["dim"][:1], "grp": group["grp"][:1], "blocks": group["blocks"][:1],
            "own": [ids.tobytes()], "queries": [m.astype(np.int64).tobytes()],
        })

    files = stored(blocks.groupBy("dim", "block").applyInArrow(
        pack_block, "dim int, block int, groups int, ids binary, cells binary, low binary, width binary, exact binary, bytes int"
    ), "va-file")
    asked = stored(groups.groupBy("dim", "grp").applyInArrow(
        pack_group, "dim int, grp int, blocks int, own binary, queries binary"
    ), "queries")
    left = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).drop("blocks")
    right = files.select("*", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp")).drop("groups")
    names = ["dim", "block", "grp"]

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], []]
        if a.num_rows and b.num_rows:
            one, two = a.to_pylist()[0], b.to_pylist()[0]
            d = one["dim"]
            read = lambda raw, kind, shape: np.frombuffer(raw, kind).reshape(shape)
            own, ids = np.frombuffer(one["own"], np.int64), np.frombuffer(two["ids"], np.int64)
            queries = read(one["queries"], np.int64, (len(own), d))
            parts = best_of_block(
                queries, own, ids, read(two["cells"], np.uint8, (len(ids), d)), np.frombuffer(two["low"], np.int64),
                np.frombuffer(two["width"], np.int64), read(two["exact"], f"<i{two['bytes']}", (len(ids), d)), k,
            )
            for i, found, score in parts:
                out[0].append(np.full(len(found), own[i]))
                out[1].append(found)
                out[2].append(score)
        q, v, s = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

    best = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(
        scan, "query_id long, vec_id long, score long"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
