"""WARC archives: records written with chunked transfer framing, long ones in segments, equal payloads as revisits; and
read back, with segments reassembled by origin, in order, to a verified total length.

An archive file is a sequence of records, each a header block of ASCII lines, a blank line, a block of Content-Length bytes
and two line ends. The writer makes each record a line of text that ends with a line end, so that Spark's text sink writes
archives to any file system; payloads are UTF-8, and segments and chunks end where a character does. The reader takes any
bytes, and any order and spread of a record's segments over files.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkboard.llm.common import small, stored

#: Bytes of a record's block at most before it goes on in another record, and of a chunk.
SEGMENT_BYTES = 48_000
CHUNK_BYTES = 8_192
#: Payloads of fewer bytes are never told by revisits.
LEAST_REVISIT = 1_000
#: Bytes of records that are written as one text, and such texts in a file at most: a reader takes a file at a time, of about 32 MB.
BUNDLE_BYTES, FILE_BUNDLES = 1 << 20, 32
END = b"\r\n"
DATE = "2020-01-01T00:00:00Z"


# ---- writing -------------------------------------------------------------------------------------------------------


def _cut(data: bytes, most: int) -> list[bytes]:
    """data in pieces of at most `most` bytes (4 at least) that end where a UTF-8 character does."""
    out, first = [], 0
    while first < len(data):
        end = min(first + most, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80 and end > first + 1:
            end -= 1
        out.append(data[first:end])
        first = end
    return out


def chunked(payload: bytes, most: int = CHUNK_BYTES) -> bytes:
    """payload in chunked transfer framing."""
    return b"".join(b"%X\r\n%s\r\n" % (len(c), c) for c in _cut(payload, most)) + b"0\r\n\r\n"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + END + block + END + END


def record_id(page_id, row: int, digest: str, segment: int = 1) -> str:
    """Of a page and its payload; row is 0 but for rows that share both."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {row} {digest} {segment}')}>"


def records(page_id, row: int, url: str, payload: bytes, size: int, digest: str, keeper: dict | None, revisit: bool) -> list[bytes]:
    """The records of one page: a response, in segments if long, or a revisit, which needs no payload, of the keeper's
    (page_id, alone) response; where the keeper isn't the only row of its id, no record id is told. size: bytes of the payload."""
    own = record_id(page_id, row, digest)
    line = "".join(c for c in url if c.isprintable())
    fields = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", line), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(size))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if revisit:
        of = [("WARC-Refers-To", record_id(keeper["page_id"], 0, digest))] if keeper["alone"] else []
        more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *of, ("X-Refers-To-Page-ID", str(keeper["page_id"])), kind]
        return [record(more + fields, http)]
    parts = _cut(http + chunked(payload), SEGMENT_BYTES)
    if len(parts) == 1:
        return [record([("WARC-Type", "response"), kind, *fields], parts[0])]
    out = [record([("WARC-Type", "response"), kind, *fields, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(sum(map(len, parts))))] if n == len(parts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, row, digest, n)), ("WARC-Date", DATE), ("WARC-Target-URI", line), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n)), *last], part))
    return out


def _lines(batches):
    """Records, about BUNDLE_BYTES of them as one text, without the last line end, which the sink adds."""
    for batch in batches:
        bundle, held = [], 0
        columns = [batch.column(c) for c in ("page_id", "row", "url", "html", "size", "digest", "keeper", "revisit")]
        for page_id, row, url, html, size, digest, keeper, revisit in zip(*columns, strict=True):
            for r in records(page_id.as_py(), row.as_py(), url.as_py() or "", (html.as_py() or "").encode(), size.as_py(), digest.as_py(), keeper.as_py(), revisit.as_py()):
                bundle.append(r)
                held += len(r)
                if held >= BUNDLE_BYTES:
                    yield _bundled(bundle)
                    bundle, held = [], 0
        if bundle:
            yield _bundled(bundle)


def _bundled(bundle: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(bundle)[: -len(END)].decode()], pa.string())], names=["value"])


def write(pages: DataFrame, path: str) -> None:
    """Archives of pages (page_id, url, html) at path. Null html counts as empty. Of rows with equal payloads of at least
    LEAST_REVISIT bytes, those with the largest page_id are responses (equal rows all are), others revisit it; null ids
    come last. A record's id follows from its page and payload, so a repeated task writes the same archive; only rows that share
    both are told apart by where they are read."""
    keyed = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    ids = stored(keyed.groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.max(F.coalesce(F.octet_length("html"), F.lit(0))).alias("size")), "warc-ids")
    keepers = ids.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.max(F.struct("page_id", (F.col("n") == 1).alias("alone"))).alias("keeper"), F.sum("n").alias("rows"))
    copied = stored(keepers.filter("rows > 1").select("digest", "keeper"), "warc-copied")
    equal = stored(ids.filter("n > 1").select("digest", F.col("page_id").alias("id"), F.lit(True).alias("equal")), "warc-equal")
    told = keyed.join(small(copied), "digest", "left").withColumn("revisit", F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper.page_id")))
    same = (told["digest"] == equal["digest"]) & told["page_id"].eqNullSafe(equal["id"])
    told = told.join(small(equal), same, "left").drop(equal["digest"], equal["id"])
    row = F.when(F.col("equal"), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)).cast("long")
    rows = told.select("page_id", row.alias("row"), "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"), "digest", "keeper", "revisit")
    rows.mapInArrow(_lines, "value string").write.option("lineSep", "\r\n").option("maxRecordsPerFile", FILE_BUNDLES).text(path)


# ---- reading -------------------------------------------------------------------------------------------------------

_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r?\n")


def parse(data: bytes):
    """(fields, block) of each record; field names in lower case. Raises ValueError where a record is cut short."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record begins at byte {at}")
        at = data.index(b"\n", at) + 1
        fields: dict[str, str] = {}
        while data[at : at + 1] not in (b"\r", b"\n"):
            m = _FIELD.match(data, at)
            if m is None:
                raise ValueError(f"no field at byte {at}")
            fields[m[1].decode().strip().lower()] = m[2].decode("utf-8", "replace").strip()
            at = m.end()
        at = data.index(b"\n", at) + 1
        size = int(fields.get("content-length", "0"))
        if at + size > len(data):
            raise ValueError(f"a record of {size} bytes is cut short at byte {at}")
        yield fields, data[at : at + size]
        at += size
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1


def dechunked(body: bytes) -> bytes:
    """What chunked framing holds. Raises ValueError if it ends before its last chunk."""
    out, at = [], 0
    while True:
        line = body.find(b"\n", at)
        if line < 0:
            raise ValueError("chunked framing is cut short")
        size = int(body[at:line].split(b";")[0].strip() or b"0", 16)
        if not size:
            return b"".join(out)
        if line + 1 + size > len(body):
            raise ValueError("a chunk is cut short")
        out.append(body[line + 1 : line + 1 + size])
        at = body.find(b"\n", line + 1 + size) + 1
        if not at:
            raise ValueError("chunked framing is cut short")


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message, without its head and transfer framing."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        return block
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head) else body


def _parsed(batches):
    names = {"type": "warc-type", "record_id": "warc-record-id", "origin": "warc-segment-origin-id", "segment": "warc-segment-number", "total": "warc-segment-total-length", "digest": "warc-payload-digest", "page_id": "x-page-id", "length": "x-payload-length", "refers_to": "x-refers-to-page-id"}
    for batch in batches:
        for content in batch.column("content"):
            rows: dict[str, list] = {k: [] for k in [*names, "block"]}
            held = 0
            for fields, block in parse(content.as_buffer().to_pybytes()):
                for k, name in names.items():
                    rows[k].append(fields.get(name) or None)
                rows["block"].append(block)
                held += len(block)
                if held > 4 << 20:
                    yield _record_batch(rows)
                    rows, held = {k: [] for k in rows}, 0
            if rows["block"]:
                yield _record_batch(rows)


def _record_batch(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(rows[k], pa.string()) for k in rows if k != "block"], pa.array(rows["block"], pa.binary())], names=list(rows))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at path: type, record_id, origin, segment, total, digest, page_id, length, refers_to, block."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = ", ".join(f"{k} string" for k in ("type", "record_id", "origin", "segment", "total", "digest", "page_id", "length", "refers_to"))
    return files.mapInArrow(_parsed, f"{schema}, block binary")


def reassembled(rows: DataFrame) -> DataFrame:
    """Records with blocks in place of block: those of one segment as they are, others as one each: continuations grouped by origin,
    in order of their numbers, each number once. The column whole tells whether 1 to the last are there and the total length is
    right. Blocks are joined where a payload is read, so that a page is copied once, not once a segment."""
    segment, one = F.col("segment").cast("int"), F.col("segment").isNull()
    single = rows.filter(one).withColumns({"whole": F.lit(True), "blocks": F.array("block")}).drop("block")
    parts = rows.filter(~one).withColumn("key", F.coalesce("origin", "record_id")).withColumn("n", segment)
    head = [c for c in rows.columns if c not in ("block", "segment", "total", "origin")]
    groups = parts.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("n", "block"))).alias("parts"), F.max(F.col("total").cast("long")).alias("sum"), *[F.max(F.when(F.col("n") == 1, F.col(c))).alias(c) for c in head])
    numbers = F.transform("parts", lambda p: p.n)
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + F.octet_length(p.block))
    whole = (numbers == F.sequence(F.lit(1), F.greatest(F.size("parts"), F.lit(1)))) & (size == F.col("sum"))
    joined = groups.withColumns({"whole": F.coalesce(whole, F.lit(False)), "blocks": F.transform("parts", lambda p: p.block), "segment": F.lit(None).cast("string"), "total": F.col("sum").cast("string"), "origin": F.lit(None).cast("string")})
    return single.unionByName(joined.select(*single.columns))


def _payloads(batches):
    names = ["page_id", "type", "told_bytes", "told_digest", "refers_to", "payload_bytes", "payload_digest", "payload"]
    for batch in batches:
        for first in range(0, batch.num_rows, 200):
            rows = batch.slice(first, 200)
            blocks = zip(rows.column("blocks"), rows.column("type").to_pylist(), rows.column("whole").to_pylist(), strict=True)
            payloads = [payload_of(b"".join(b.as_py())) if t == "response" and w else None for b, t, w in blocks]
            told = [None if d is None else d.removeprefix("sha1:") for d in rows.column("digest").to_pylist()]
            seen = [None if p is None else hashlib.sha1(p).hexdigest() for p in payloads]
            found = [pa.array(told, pa.string()), rows.column("refers_to"), pa.array([None if p is None else len(p) for p in payloads], pa.int64()), pa.array(seen, pa.string()), pa.array(payloads, pa.binary())]
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("type"), rows.column("length"), *found], names=names)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Each page of the archives at path: page_id, record_type, refers_to, payload (null for revisits), payload_bytes and
    payload_digest. The latter two are of the payload itself where there is one, and of a revisit what its header tells.
    sound: the segments were whole, and the payload has the length and digest that its header tells."""
    schema = "page_id string, type string, told_bytes string, told_digest string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    rows = reassembled(read(spark, path)).filter(F.col("type").isin("response", "revisit")).mapInArrow(_payloads, schema)
    told = F.col("told_bytes").cast("long")
    sound = (F.col("type") == "revisit") | (F.col("payload_bytes").eqNullSafe(told) & F.col("payload_digest").eqNullSafe(F.col("told_digest")))
    return rows.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("payload_bytes", told).alias("payload_bytes"), F.coalesce("payload_digest", "told_digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"), "payload", sound.alias("sound"))
