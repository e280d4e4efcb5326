"""WARC archives with segmented and revisit records: writing, reading, reassembly."""

import hashlib

from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, arrow_schema, record, ship, small_batches, stored

SEGMENT = 2 << 10
PORTION = 16 << 10
ARCHIVE = 4 << 20
SMALLEST = 100
ARCHIVES = "archive string, content binary"
RECORDS = (
    "record_id string, record_type string, uri string, origin_id string, segment int, total long,"
    " refers_to string, digest string, block binary"
)


def chunked(payload: bytes, portion: int = PORTION) -> bytes:
    """HTTP's chunked transfer framing."""
    parts = [payload[i : i + portion] for i in range(0, len(payload), portion)]
    return b"".join([b"%x\r\n%s\r\n" % (len(p), p) for p in parts]) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is longer than its size says")
        out.append(body[line + 2 : at])
        at += 2


def warc_record(headers: list, block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def headers_of(data: bytes, at: int) -> tuple:
    """The header fields that begin at ``at``, and where they end."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    return first, dict(x.split(": ", 1) for x in lines), end + 4


def records_of(data: bytes):
    """``(header fields, block)`` of every record of an archive."""
    at = 0
    while at < len(data):
        version, fields, body = headers_of(data, at)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        size = int(fields["Content-Length"])
        yield fields, data[body : body + size]
        at = body + size + 4


def name_of(key, copy) -> str:
    return f"<urn:page:{'' if key is None else key}:{copy}>"


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
                   segment: int = SEGMENT, smallest: int = SMALLEST, archive: int = ARCHIVE) -> DataFrame:
    """Write every row as a WARC record; the stored archives, ``archive, content``.

    Rows whose payload (UTF-8 bytes; NULL counts as empty) has ``smallest`` bytes or more are compared
    by SHA-256: the one with the smallest key is the response, the others revisit it and carry no
    payload. Responses travel in chunked framing; blocks of more than ``segment`` bytes are cut into
    segments with their origin's identifier, which need not stay in one archive. An archive is closed
    after ``archive`` bytes; only whole records are written.

    The smallest key of each payload comes from a partial aggregate; rows meet it in a join, in which a
    payload with a third of all rows is split by Spark's handling of skewed joins. A row with a NULL
    key is never revisited. Rows with equal keys each have a record of their own, told apart by a
    running number; if theirs is the smallest key, all of them are responses, and revisits refer to one. NULL urls are left out
    of the header, other columns are ignored, and an empty table gives no archives.
    """
    ship(pages.sparkSession)
    schema = arrow_schema(ARCHIVES)
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{url}`").alias("u"), body.alias("p"),
        F.sha2(body, 256).alias("d"), F.monotonically_increasing_id().alias("n"),
    )
    # The running number of a row is that of its place in the scan, which is the same each time.
    firsts = (
        rows.filter(F.length("p") >= smallest).filter("k is not null").groupBy("d")
        .agg(F.min(F.struct("k", "n")).alias("f"), F.count("*").alias("rows"))
        .filter("rows > 1").select("d", F.col("f.k").alias("f"), F.col("f.n").alias("m"))
    )
    firsts = stored(firsts, "first-pages")
    joined = rows.join(firsts, "d", "left")

    def run(batches):
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for d, k, u, p, n, f, m in zip(*[batch[c].to_pylist() for c in ("d", "k", "u", "p", "n", "f", "m")]):
                for made in page_records(k, u, p, d, n, f, m, segment):
                    held.append(made)
                    size += len(made)
                if size >= archive:
                    yield record({"archive": [f"{part:06d}-{number:06d}"], "content": [b"".join(held)]}, schema)
                    held, size, number = [], 0, number + 1
        if held:
            yield record({"archive": [f"{part:06d}-{number:06d}"], "content": [b"".join(held)]}, schema)

    with small_batches(pages.sparkSession):
        return stored(joined.mapInArrow(run, ARCHIVES), "archives", group=1)


def page_records(key, url, payload, digest, copy, first, first_copy, segment):
    """The record of a page, in segments if it is long; a revisit names the record of its response."""
    own = name_of(key, copy)
    about = [("WARC-Target-URI", url and url.replace("\r", "%0D").replace("\n", "%0A")),
             ("WARC-Payload-Digest", f"sha256:{digest}")]
    if first is not None and key != first:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield warc_record([
            ("WARC-Type", "revisit"), ("WARC-Record-ID", own), *about, ("WARC-Refers-To", name_of(first, first_copy)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ], http)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for number, part in enumerate(parts, 1):
        lead = number == 1
        yield warc_record([
            ("WARC-Type", "response" if lead else "continuation"),
            ("WARC-Record-ID", own if lead else f"{own[:-1]}:{number}>"), *(about if lead else []),
            ("WARC-Segment-Origin-ID", None if lead else own),
            ("WARC-Segment-Number", number if len(parts) > 1 else None),
            ("WARC-Segment-Total-Length", len(block) if number == len(parts) > 1 else None),
        ], part)


def read_records(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives."""

    def parse(batch):
        for content in batch["content"]:
            out = {f.split()[0]: [] for f in RECORDS.split(", ")}
            for fields, block in records_of(content.as_py()):
                own = fields["WARC-Record-ID"]
                row = (
                    own, fields["WARC-Type"], fields.get("WARC-Target-URI"), fields.get("WARC-Segment-Origin-ID", own),
                    int(fields.get("WARC-Segment-Number", 0)), int(fields.get("WARC-Segment-Total-Length", 0)),
                    fields.get("WARC-Refers-To"), fields.get("WARC-Payload-Digest"), block,
                )
                for column, value in zip(out.values(), row):
                    column.append(value)
            yield out

    return arrow_map(archives.select("content"), parse, RECORDS)


PAGES = (
    "record_id string, record_type string, uri string, refers_to string, payload_bytes long,"
    " payload_digest string, payload binary, error string"
)


def whole(kind: str, block: bytes, claimed: str) -> tuple:
    """``(bytes of the payload, digest, payload, error)`` of a complete block."""
    try:
        _, http, at = headers_of(block, 0)
        if kind == "revisit":
            return int(http["Content-Length"]), claimed.removeprefix("sha256:"), None, None
        payload = block[at:]
        if http.get("Transfer-Encoding") == "chunked":
            payload = unchunked(payload)
        digest = hashlib.sha256(payload).hexdigest()
        wrong = None if f"sha256:{digest}" == claimed else "the payload differs from its digest"
        return len(payload), digest, payload, wrong
    except (ValueError, KeyError) as e:
        return None, None, None, f"broken block: {e}"


def reassemble(records: DataFrame) -> DataFrame:
    """Complete records: segments of one origin joined in order, checked and decoded.

    Unsegmented records are decoded where they are read. Segments are grouped by their origin's
    identifier and ordered by number, and a task joins them as they come; a missing first or middle segment, or a length
    other than the total of the last one, gives ``error`` and no payload. Repeated segments count once.
    """
    ship(records.sparkSession)

    def decode(batch):
        got = [
            whole(k.as_py(), b.as_py(), d.as_py() or "")
            for k, b, d in zip(batch["record_type"], batch["block"], batch["digest"])
        ]
        columns = [list(c) for c in zip(*got)] or [[], [], [], []]
        yield {c: batch[c] for c in ("record_id", "record_type", "uri", "refers_to")} | {
            "payload_bytes": columns[0], "payload_digest": columns[1], "payload": columns[2], "error": columns[3]
        }

    target = arrow_schema(PAGES)

    def joined(parts):
        parts = list({p["segment"]: p for p in parts}.values())
        lead, numbers = parts[0], [p["segment"] for p in parts]
        block, total = b"".join([p["block"] for p in parts]), parts[-1]["total"]
        got = (None, None, None, "segments are missing")
        if numbers == list(range(1, len(numbers) + 1)) and total:
            got = (None, None, None, f"{len(block)} bytes instead of {total}")
            if len(block) == total:
                got = whole(lead["record_type"], block, lead["digest"] or "")
        return (lead["origin_id"], lead["record_type"], lead["uri"], lead["refers_to"], *got)

    def join(batches):
        held = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and held[0]["origin_id"] != row["origin_id"]:
                    out.append(joined(held))
                    held = []
                held.append(row)
            yield record(dict(zip(target.names, zip(*out) if out else [[]] * len(target.names))), target)
        if held:
            yield record(dict(zip(target.names, ([v] for v in joined(held)))), target)

    single = arrow_map(records.filter("segment = 0"), decode, PAGES)
    parts = records.filter("segment > 0").repartition("origin_id").sortWithinPartitions("origin_id", "segment")
    return single.unionByName(parts.mapInArrow(join, PAGES))


def resolve(pages: DataFrame) -> DataFrame:
    """``pages`` without payloads, revisits checked against the response that they name.

    A revisit has the ``error`` "no response" if there is no such whole record, and "differs from its response" if length or digest are
    not the same. The join is on the responses' identifiers, which are unique; Spark splits a response that very many name.
    """
    with small_batches(pages.sparkSession):
        pages = stored(pages.drop("payload"), "pages")
    found = pages.filter("record_type = 'response' and error is null").select(
        F.col("record_id").alias("_id"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    revisits = pages.filter("record_type = 'revisit'").join(found, F.col("refers_to") == F.col("_id"), "left")
    same = (F.col("payload_bytes") == F.col("_bytes")) & (F.col("payload_digest") == F.col("_digest"))
    wrong = F.when(F.col("_id").isNull(), "no response").when(~same, "differs from its response")
    checked = revisits.withColumn("error", F.coalesce("error", wrong)).select(*pages.columns)
    return pages.filter("record_type <> 'revisit' or record_type is null").unionByName(checked)


def page_key(name: str):
    """The key inside a record's identifier."""
    return F.nullif(F.split(F.col(name), ":")[2], F.lit("")).cast("long")
