"""Token ids in files of compressed bit or byte planes with a chunk index."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, arrow_schema, record, ship, stored
from .tokens import encoder

BLOCK = 65_536
CHUNK = 1 << 20
FILE = (
    "part int, chunk int, first long, n_ids long, n_docs int, planes binary, plane_index binary,"
    " doc_ids binary, doc_tokens binary"
)


def split_planes(ids: np.ndarray, kind: str) -> list:
    """The planes of one block, lowest first: every 8th bit or every byte of all its ids together."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]) for k in range((width + 7) // 8)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, :width]
    return list(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little"))


def join_planes(planes: list, n: int, kind: str) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, plane in enumerate(planes):
            raw[:, k] = plane
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(plane, count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


def pack(ids: np.ndarray, block: int = BLOCK, kind: str = "bit") -> tuple:
    """``(planes, index)``: the planes of all blocks, each a zstandard frame; the index says
    kind and block size, then of every plane its block and its end in the bytes."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    frames, index, end = [], [0 if kind == "bit" else 1, block], 0
    for at in range(0, len(ids), block):
        for plane in split_planes(ids[at : at + block], kind):
            frames.append(squeeze(plane.tobytes()))
            end += len(frames[-1])
            index += [at // block, end]
    return b"".join(frames), np.array(index, "<i8").tobytes()


def unpack(planes: bytes, index: bytes, n: int) -> np.ndarray:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    (kind, block), of = np.frombuffer(index, "<i8")[:2], np.frombuffer(index, "<i8")[2:].reshape(-1, 2)
    ends = np.concatenate([[0], of[:, 1]])
    out = []
    for b in range(-(-n // block)):
        lo, hi = np.searchsorted(of[:, 0], [b, b + 1])
        parts = [np.frombuffer(expand(planes[ends[k] : ends[k + 1]]), np.uint8) for k in range(lo, hi)]
        out.append(join_planes(parts, min(block, n - b * block), "byte" if kind else "bit"))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_ids(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2,
              kind: str = "bit", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Encode whole texts and write them in ascending order of ``key``; the written files.

    Every document's ids end with ``end_id``. A chunk holds whole documents, up to ``chunk`` ids or
    one longer document, and is cut into blocks of ``block`` ids whose planes are compressed one by
    one. ``part`` numbers follow the order of the keys. NULL texts count as empty and hold just the
    end; NULL keys come first; rows with equal keys are all written, ordered by a hash of their text
    that also deals a frequent key over several tasks; an empty table gives no chunks; other columns
    are ignored.
    """
    ship(docs.sparkSession)
    schema = arrow_schema(FILE)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), body.alias("t"), F.xxhash64(body).alias("h"))
    ordered = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h")

    def run(batches):
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        end = int(end_id).to_bytes(4, "little")
        held, keys, counts, size, first, number = [], [], [], 0, 0, 0

        def flush():
            ids = np.frombuffer(b"".join(held), "<u4")
            planes, index = pack(ids, block, kind)
            known = pa.array(keys, pa.int64())
            row = {
                "part": [part], "chunk": [number], "first": [first], "n_ids": [len(ids)], "n_docs": [len(keys)],
                "planes": [planes], "plane_index": [index], "doc_tokens": [np.array(counts, "<i8").tobytes()],
                # A NULL key is kept as the smallest number.
                "doc_ids": [known.fill_null(-(1 << 63)).to_numpy().astype("<i8").tobytes()],
            }
            return record(row, schema)

        for batch in batches:
            for k, t in zip(batch["k"].to_pylist(), batch["t"].to_pylist()):
                ids = encode(t) + end
                if held and size + len(ids) // 4 > chunk:
                    yield flush()
                    first, number = first + size, number + 1
                    held, keys, counts, size = [], [], [], 0
                held.append(ids)
                keys.append(k)
                counts.append(len(ids) // 4)
                size += len(ids) // 4
        if held:
            yield flush()

    return stored(ordered.mapInArrow(run, FILE), "ids")


def read_ids(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it: the totals of the parts come from the chunk
    index, one number for each task that wrote.
    """
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    parts = np.array([r.part for r in totals], np.int64)
    bases = np.concatenate([[0], np.cumsum([r.n for r in totals], dtype=np.int64)])
    chunks = files.select("part", "first", "n_ids", "planes", "plane_index", "doc_ids", "doc_tokens")

    def decode(batch):
        for row in batch.to_pylist():
            ids = unpack(row["planes"], row["plane_index"], row["n_ids"]).tobytes()
            keys = np.frombuffer(row["doc_ids"], "<i8")
            counts = np.frombuffer(row["doc_tokens"], "<i8")
            ends = np.cumsum(counts)
            at = bases[np.searchsorted(parts, row["part"])] + row["first"]
            view = memoryview(ids)
            crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
            yield {
                "doc_id": pa.array(keys, mask=keys == -(1 << 63)), "start": pa.array(at + ends - counts),
                "n_tokens": pa.array(counts), "ids_crc32": crcs,
            }

    return arrow_map(chunks, decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
