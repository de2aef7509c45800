"""WARC archives with revisit records for repeated payloads, written and read back."""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corestrata.llm.common import BATCH_ROWS, bounded_batches, scratch, spool
from corestrata.llm.exact import CELLS_A_ROW, bitmaps, cells, marked

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"
#: An archive ends after the record with which it reaches so many bytes, compressed.
FILE_BYTES = 32 << 20
#: A gzip member holds less than this, so that the last byte of its length is 0.
MEMBER_BYTES = 1 << 24
#: A table of repeated digests up to this size is broadcast; beyond, pages that a filter of this size knows are shuffled by digest.
BROADCAST_BYTES = 32 << 20
_FILE = pa.schema([("value", pa.binary())])
_HEADERS = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers", pa.string()), ("sound", pa.bool_())])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(text: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, text)}>"


def _original_id(page_id: int, digest: str) -> str:
    """The record ID of a response that revisits refer to: there is one for a page and payload."""
    return _urn(f"page:{page_id}/{digest}")


def _one_line(value: str | None) -> str:
    return "".join(c if " " <= c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record(record_id: str, page_id: int | None, url: str | None, html: str, original: int | None, original_url: str | None, date: str) -> bytes:
    """A response record, or with an original a revisit record: headers and the HTTP header alone."""
    body = html.encode()
    digest = payload_digest(body)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    revisit = original is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_original_id(original, digest)}", f"WARC-Refers-To-Target-URI: {_one_line(original_url)}", f"WARC-Refers-To-Date: {date}"]
    block = http if revisit else http + body
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + RECORD_END


def _info(record_id: str, date: str) -> bytes:
    block = b"software: corestrata\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + RECORD_END


def compressed(raw: bytes) -> bytes:
    """A record as a gzip member of its own; as several, if it is very long."""
    return b"".join(gzip.compress(raw[k : k + MEMBER_BYTES - 1], 6, mtime=0) for k in range(0, len(raw), MEMBER_BYTES - 1))


def _archives(run_id: str, date: str, file_bytes: int):
    def run(source):
        """A row for each archive, but for its last byte, which is 0 and which the text writer's line separator adds."""
        from pyspark import TaskContext

        context = TaskContext.get()
        number, parts, size = 0, [], 0
        own = f"run:{run_id}/{context.partitionId() if context else 0}"

        def out():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], schema=_FILE)

        for batch in source:
            for page_id, url, html, original, original_url, named, day in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not parts:
                    parts = [compressed(_info(_urn(f"{own}/{number}/info"), day or date))]
                    size = len(parts[0])
                html, number = html or "", number + 1
                record_id = _original_id(page_id, payload_digest(html.encode())) if named else _urn(f"{own}/{number}")
                parts.append(compressed(record(record_id, page_id, url, html, original, original_url, day or date)))
                size += len(parts[-1])
                if size >= file_bytes:
                    yield out()
                    parts = []
        if parts:
            yield out()

    return run


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, date: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, file_bytes: int = FILE_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> None:
    """Writes a record for each row of pages to archives (*.warc.gz, each record a gzip member) of about file_bytes under path.

    Only digests, page_ids and URLs are shuffled to find the repeated payloads (those of min_payload bytes or
    more, compared by SHA-256; null counts as empty); the originals, of the smallest page_id, then meet the pages.
    Of rows that tie for the original, repeating page_id and payload, one is (that of the least URL); rows of a
    null page_id never are. Pages whose digest occurs once never shuffle. Records are dated by date_col (ISO
    text), or else date, or else the time of the call. Payloads of any length; an empty table writes nothing.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    day = F.col(f"`{date_col}`").cast("string") if date_col else F.lit(None).cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"), day.alias("day"), F.when(F.octet_length(html) >= min_payload, F.unhex(F.sha2(F.encode(html, "UTF-8"), 256))).alias("key"))
    pairs = rows.where("key is not null").groupBy("key", "page_id").agg(F.count(F.lit(1)).alias("c"), F.min("url").alias("url"))
    seen = pairs.groupBy("key").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "c", "url"))).alias("first"), F.sum("c").alias("n"))
    repeated = spool(seen.where("n > 1 and first is not null").select("key", F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url"), (F.col("first.c") > 1).alias("tied")), "repeated")
    size = repeated.agg(F.coalesce(F.sum(F.lit(96) + F.coalesce(F.octet_length("original_url"), F.lit(0))), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(repeated), "key", "left")
    else:
        bits = max(15, min((repeated.count() * CELLS_A_ROW - 1).bit_length(), (max(1, broadcast_bytes) * 8).bit_length() - 1))
        known = marked(rows, "key", bitmaps(repeated.select(cells(F.col("key"), bits, 1)[0].alias("cell"))), bits, 1, True)
        none = {c: F.lit(None).cast(t) for c, t in repeated.dtypes if c != "key"}
        through = known.where("not _maybe").drop("_maybe").withColumns(none)
        joined = through.unionByName(known.where("_maybe").drop("_maybe").join(repeated, "key", "left"))
    same = F.col("page_id").eqNullSafe(F.col("original")) & F.col("original").isNotNull()
    tied = same & F.coalesce(F.col("tied"), F.lit(False))
    plain = joined.where(~tied).select("page_id", "url", "html", F.when(~same, F.col("original")).alias("original"), F.when(~same, F.col("original_url")).alias("original_url"), same.alias("named"), "day")
    # Rows that tie are numbered where they are written, so that one of them can be told from the others.
    ties = spool(joined.where(tied).select("key", "page_id", "url", "html", "original", "original_url", "day").withColumn("row", F.monotonically_increasing_id()), "ties") if repeated.where("tied").limit(1).count() else None
    if ties is not None:
        first = spool(ties.groupBy("key").agg(F.min(F.struct(F.col("url").isNotNull(), "url", "row"))["row"].alias("chosen")), "chosen")
        ours = F.col("row") == F.col("chosen")
        plain = plain.unionByName(ties.join(first, "key").select("page_id", "url", "html", F.when(~ours, F.col("original")).alias("original"), F.when(~ours, F.col("original_url")).alias("original_url"), ours.alias("named"), "day"))
    done = plain.mapInArrow(_archives(uuid.uuid4().hex, date, file_bytes), "value binary")
    done.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).mode("append").text(path)
    _name(spark, path)


def _name(spark: SparkSession, path: str) -> None:
    """Gives new archives their extension."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in files.listStatus(p(path)):
        at = f.getPath().toString()
        if at.endswith(".txt"):
            files.rename(p(at), p(at.removesuffix(".txt") + ".warc.gz"))


def parse(stream):
    """(headers, block) of each record, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


def _headers(source):
    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _HEADERS, strict=True)], schema=_HEADERS)

    for batch in source:
        for content in batch.column(0):
            rows = []
            with gzip.open(io.BytesIO(content.as_buffer())) as stream:
                for head, block in parse(stream):
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    told = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    whole, page = head["warc-type"] == "response", head.get("x-page-id")
                    rows.append((head["warc-record-id"], None if page is None else int(page), head["warc-type"], digest, len(body) if whole else told, head.get("warc-refers-to"), not whole or (payload_digest(body) == digest and told == len(body))))
                    if len(rows) >= BATCH_ROWS:
                        yield out(rows)
                        rows = []
            if rows:
                yield out(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each response and revisit: page_id, payload_bytes, payload_digest, record_type, refers_to, sound, resolved.

    A response's payload is digested anew (sound: it matches its headers). A revisit is joined by record ID to the
    response that it refers to, and takes the page_id and length found there; resolved is false where that
    response is missing or has another digest.
    """
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    found = spool(files.mapInArrow(_headers, "record_id string, page_id long, record_type string, digest string, payload_bytes long, refers string, sound boolean"), "records")
    whole = found.where("record_type = 'response'")
    again = found.where("record_type = 'revisit'")
    # Written first, so that adaptive execution may split the join at a response that many revisits name.
    named = spool(again.select(F.col("refers").alias("record_id")).distinct(), "named")
    targets = spool(whole.join(named, "record_id", "left_semi").select(F.col("record_id").alias("refers"), "digest", F.col("payload_bytes").alias("full"), F.col("page_id").alias("refers_to")), "targets")
    solved = again.join(targets, ["refers", "digest"], "left").select("page_id", F.coalesce("full", "payload_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", (F.col("full") == F.col("payload_bytes")).alias("sound"), F.col("full").isNotNull().alias("resolved"))
    return whole.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "sound", F.lit(True).alias("resolved")).unionByName(solved)


def deduplicated_archives(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes pages to archives under path (a new folder in the shared one, if none is given) and reads them back.

    Nulls, empty and long payloads, ties, repeated rows and empty tables as in write_archives(). Further columns
    are not read, whatever they are called.
    """
    path = path or scratch(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
