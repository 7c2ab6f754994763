"""WARC archives: writing, reading, and assembly of transactions.

``write`` makes three records for each page (request, response or revisit, metadata); request and metadata name the
capture in ``WARC-Concurrent-To``. Records are text (payloads are UTF-8), so Spark's own text writer stores them
gzip-compressed through its commit protocol: a task's files appear as a whole or not at all. A file holds at most
``PER_FILE`` captures. ``read`` streams compressed files: Spark's text reader cuts them at ``WARC/1.``, and the cuts that
lie inside a block are undone by ``Content-Length``, so one record is held at a time however large the file is.
``assemble`` joins request, response and metadata by the concurrent-to identifiers into one nested row per capture,
revisits with the response that they refer to.

Payloads travel deflated (``payload``: zlib of the payload's bytes) from the first shuffle to the nested row, where
``payload_text`` gives them back; lengths and digests are those of the full payload as read back.

Of captures with equal payloads of at least ``least`` bytes the one with the largest id is the response, the others
revisit it. Null payloads count as empty. Rows that repeat id and payload become equal records, and as many captures
come back. A null id comes back as null and is never referred to unless all ids of a payload are null. Empty tables
give archives without records. Extra columns are dropped. Uncompressed archives are read too, each as one value.

Only (digest, largest id) pairs are joined to the pages, so a payload that a third of the pages share is split by the
skew join.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, null_safe, scratch, table, written

_CRLF = "\r\n"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What every record begins with, up to the minor version.
_BEGIN = "WARC/1."
#: Captures in a file.
PER_FILE = 50_000


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(*parts: str) -> str:
    h = hashlib.md5("|".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(kind: str, fields: list[tuple[str, str | None]], block: str, size: int) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {_DATE}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {size}"]
    return _CRLF.join(lines) + _CRLF * 2 + block


def classified(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, sha (hexadecimal), payload (deflated) and refers (null for responses)."""
    html = pages.select("page_id", "url", null_safe("html").alias("html"))
    tops = html.where(F.octet_length("html") >= least).groupBy(F.sha1(F.col("html").cast("binary")).alias("sha")).agg(F.max("page_id").alias("top"))

    def make():
        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            payloads = b.column(2).cast(pa.binary()).to_pylist()
            shas = [hashlib.sha1(x).hexdigest() for x in payloads]
            return batch_of(["page_id", "url", "sha", "payload"], [b.column(0), b.column(1), pa.array(shas, pa.string()), pa.array([zlib.compress(x, 1) for x in payloads], pa.binary())])

        return fn

    rows = arrow_map(html, make, f"page_id {dict(pages.dtypes)['page_id']}, url string, sha string, payload binary")
    joined = rows.join(tops, "sha", "left")
    return joined.withColumn("refers", F.when(~F.col("page_id").eqNullSafe(F.col("top")) & F.col("top").isNotNull(), F.col("top"))).drop("top")


def capture_records(page_id: str | None, url: str | None, sha: str, payload: bytes, refers: str | None) -> str:
    """Request, response or revisit, and metadata record of one page, with the blank lines that end a record between."""
    page, digest = page_id if page_id is not None else "none", base64.b32encode(bytes.fromhex(sha)).decode()
    own = _urn(page, digest)
    url = (url if url is not None else "urn:none").replace("\r", "%0A").replace("\n", "%0A")
    target = ("WARC-Target-URI", url)
    first = refers is None
    head = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: {len(payload)}{_CRLF * 2}"
    main = _record(
        "response" if first else "revisit",
        [
            ("WARC-Record-ID", own), target, ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", None if first else _urn(refers, digest)),
            ("WARC-Profile", None if first else _PROFILE), ("Content-Type", "application/http;msgtype=response"),
        ],
        head + payload.decode("utf-8", "replace") if first else head, len(head) + len(payload) if first else len(head),
    )
    ask = f"GET {url} HTTP/1.1{_CRLF * 2}"
    note = f"page-id: {page_id}{_CRLF}" if page_id is not None else ""
    aside = lambda kind, mime: [("WARC-Record-ID", _urn(page, digest, kind)), target, ("WARC-Concurrent-To", own), ("Content-Type", mime)]
    request = _record("request", aside("request", "application/http;msgtype=request"), ask, len(ask.encode("utf-8", "surrogatepass")))
    metadata = _record("metadata", aside("metadata", "application/warc-fields"), note, len(note))
    return (_CRLF * 2).join([request, main, metadata])


def write(pages: DataFrame, path: str, least: int = 0, per_file: int = PER_FILE) -> None:
    """Archives of ``pages`` (page_id, url, html) below ``path``."""

    def make():
        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            made = [capture_records(p, u, s, zlib.decompress(x), r) for p, u, s, x, r in zip(*(c.to_pylist() for c in b.columns))]
            return batch_of(["value"], [pa.array(made, pa.string())])

        return fn

    rows = classified(pages, least)
    rows = rows.select(F.col("page_id").cast("string"), "url", "sha", "payload", F.col("refers").cast("string"))
    arrow_map(rows, make, "value string").write.option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


_FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Concurrent-To", "WARC-Refers-To", "WARC-Target-URI", "WARC-Payload-Digest", "Content-Type")
RECORD = "type string, record_id string, concurrent_to string, refers_to string, target string, declared_digest string, content_type string, payload_bytes long, digest string, payload binary, fields map<string,string>"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_KINDS = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string())]


def _parsed(named: dict[str, str], block: bytes) -> tuple:
    kind, body, fields = named["WARC-Type"], None, None
    if kind == "response":
        cut = block.find(b"\r\n\r\n")
        body = block[cut + 4 :] if cut >= 0 else block
    elif kind == "metadata":
        fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split(_CRLF) if ": " in x)
    held = body is not None
    return (*(named.get(x) for x in _FIELDS), len(body) if held else None, base32_sha1(body) if held else None, zlib.compress(body, 1) if held else None, fields)


def records_of(pieces):
    """One tuple per record of (file, bytes) pieces, the files' bytes cut at ``_BEGIN``; a broken header or a block that
    ends early raises ValueError."""
    begin = _BEGIN.encode()
    file, parts, missing, named, at = None, [], 0, {}, 0
    for where, piece in pieces:
        if where != file:
            if missing > 0:
                raise ValueError(f"the last record of {file} ends early")
            file, missing = where, 0
            if piece:
                raise ValueError(f"no WARC record at the start of {where}")
            continue
        if missing > 0:  # the cut lay inside the block
            parts += [begin, piece]
            missing -= len(begin) + len(piece)
        else:
            at = piece.find(b"\r\n\r\n")
            if at < 0:
                raise ValueError(f"no WARC header in {where}")
            named = dict(x.split(": ", 1) for x in piece[:at].decode("utf-8").split(_CRLF)[1:])
            parts, missing = [piece[at + 4 :]], int(named["Content-Length"]) - (len(piece) - at - 4)
        if missing <= 0:
            block = b"".join(parts)
            yield _parsed(named, block[: len(block) + missing])
    if missing > 0:
        raise ValueError(f"the last record of {file} ends early")


def _rows(rows) -> pa.RecordBatch:
    return batch_of(_NAMES, [pa.array([list(x.items()) if isinstance(x, dict) else x for x in col], kind) for col, kind in zip(zip(*rows), _KINDS)])


def _batches(pieces):
    rows, held = [], 0
    for r in records_of(pieces):
        rows.append(r)
        held += len(r[9] or b"")
        if len(rows) == 512 or held > 8_000_000:
            yield _rows(rows)
            rows, held = [], 0
    if rows:
        yield _rows(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``: files named .gz as streams, all others as one value each."""

    def streamed(batches):
        yield from _batches((f, x) for b in batches for f, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

    def whole(batches):
        yield from _batches((f, x) for b in batches for f, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in data.split(_BEGIN.encode()))

    packed = spark.read.option("lineSep", _BEGIN).option("pathGlobFilter", "*.gz").text(path)
    found = packed.select("_metadata.file_path", F.col("value").cast("binary")).mapInArrow(streamed, RECORD)
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*[!z]").load(path).select("path", "content").mapInArrow(whole, RECORD)
    return found.unionByName(plain)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: main (response or revisit), request, metadata, and the referred response.

    Equal repeated records come back as as many captures.
    """
    shape = F.struct("record_id", "type", "target", "refers_to", "declared_digest", "payload_bytes", "digest", "payload")
    main = F.col("type").isin("response", "revisit")
    captures = (
        records.where(main | F.col("type").isin("request", "metadata"))
        .groupBy(F.coalesce("concurrent_to", "record_id").alias("capture"))
        .agg(
            F.count(F.when(main, 1)).alias("copies"),
            F.any_value(F.when(main, shape), True).alias("main"),
            F.any_value(F.when(F.col("type") == "request", F.struct("record_id", "target", "content_type")), True).alias("request"),
            F.any_value(F.when(F.col("type") == "metadata", F.struct(F.col("record_id"), F.map_entries("fields").alias("fields"))), True).alias("metadata"),
        )
        .where("copies > 0")
        .withColumn("metadata", F.struct(F.col("metadata.record_id"), F.map_from_entries("metadata.fields").alias("fields")))
    )
    return captures.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")


def payload_text(captures: DataFrame) -> DataFrame:
    """Captures with the column ``payload_text``: the response's payload as text, null for revisits."""
    inflate = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else zlib.decompress(x).decode("utf-8", "replace")), "string")
    return captures.withColumn("payload_text", inflate("main.payload"))


def pages_of(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every capture."""
    page = F.col("metadata.fields")["page-id"].cast("long")
    flat = captures.select(
        F.col("capture"), page.alias("page_id"), F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("refers"),
        F.col("main.payload_bytes").alias("payload_bytes"), F.coalesce("main.digest", F.regexp_replace("main.declared_digest", "^sha1:", "")).alias("payload_digest"),
    )
    first = flat.where("record_type = 'response'")
    responses = first.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    heads = first.groupBy(F.col("capture").alias("head_capture")).agg(F.first("page_id").alias("head"), F.first("payload_bytes").alias("bytes"))
    revisits = flat.where("record_type = 'revisit'").join(heads, F.col("refers") == F.col("head_capture"), "left")
    return responses.unionByName(revisits.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("head").alias("refers_to")))


def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/warc"
    write(table(spark, sf_dir, "pages"), path)
    return pages_of(written(assemble(read(spark, path)), "captures"))


OP6_SQL = r"""
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT page_id, payload_bytes, h,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
         max(page_id) OVER (PARTITION BY h) AS top
  FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b
"""
