"""WARC archives: segmented, chunked records written by Spark and put together again."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise
from tidewatch.session import fresh_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
#: A record ends with two line ends, which Spark's text writer adds.
RECORD_END = "\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(text: str, chunk_chars: int) -> str:
    """A body in chunked transfer framing; sizes count UTF-8 bytes."""
    parts = [text[k:k + chunk_chars] for k in range(0, len(text), chunk_chars)]
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The entity body of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(kind: str, length: int, **fields) -> str:
    lines = [f"{k.replace('_', '-')}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}"
             for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *lines, f"Content-Length: {length}"]) + "\r\n\r\n"


def records_of(page: str | None, url: str | None, text: str, digest: str, first: str | None, revisit: bool,
               segment_chars: int, chunk_chars: int) -> Iterator[str]:
    """The records of one page, without the two line ends after each.

    A response whose block is longer than ``segment_chars`` is cut: the first record is the
    response, the others are continuations that name it, and the last gives the whole length.
    """
    name = f"<urn:page:{'' if page is None else page}:{digest}>"
    common = {"WARC_Target_URI": url, "X_Page_ID": page, "WARC_Payload_Digest": f"sha1:{digest}"}
    if revisit:
        yield _record("revisit", 0, WARC_Record_ID=f"{name[:-1]}:revisit>", **common, WARC_Profile=PROFILE,
                      WARC_Refers_To=f"<urn:page:{first}:{digest}>", X_Refers_To_Page_ID=first)
        return
    block = HEAD + chunked(text, chunk_chars)
    parts = [block[k:k + segment_chars] for k in range(0, len(block), segment_chars)]
    total = len(block.encode())
    for number, part in enumerate(parts, 1):
        cut = {"WARC_Segment_Number": number} if len(parts) > 1 else {}
        if number > 1:
            cut["WARC_Segment_Origin_ID"] = name
        if 1 < number == len(parts):
            cut["WARC_Segment_Total_Length"] = total
        own = name if number == 1 else f"{name[:-1]}:{number}>"
        yield _record("response" if number == 1 else "continuation", len(part.encode()), WARC_Record_ID=own,
                      **(common if number == 1 else {}), **cut) + part


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = 0, segment_chars: int = 65_536, chunk_chars: int = 16_384) -> None:
    """One record for each row of ``pages``, as gzipped archives below ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes those with the smallest id
    are responses and the others revisit them; rows that repeat that id are responses too,
    and so are rows without an id if no row with their payload has one. Null html is an empty
    payload. Records are short, as long blocks are segmented, and a file takes a bounded
    number of them, so that no file is larger than a reader can take.
    """
    body = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("string").alias("page"), F.col(id_col).alias("id"),
                        F.col(url_col).cast("string").alias("url"), body.alias("text"))
    rows = rows.withColumn("digest", F.sha1(F.col("text").cast("binary")))
    first = rows.where(F.octet_length("text") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"))
    typed = rows.join(first.hint("shuffle_hash"), "digest", "left").select(
        "page", "url", "text", "digest", F.col("first").cast("string").alias("first"),
        (~F.col("id").eqNullSafe(F.col("first")) & (F.octet_length("text") >= least_bytes)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for k in range(batch.num_rows):
                page, url, text, digest, origin, revisit = (batch.column(c)[k].as_py() for c in range(6))
                bare = base64.b32encode(bytes.fromhex(digest)).decode()
                for record in records_of(page, url, text, bare, origin, revisit, segment_chars, chunk_chars):
                    out.append(record)
                    size += len(record)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    typed.mapInArrow(run, "value string").write.option("lineSep", RECORD_END).option("compression", "gzip").option(
        "maxRecordsPerFile", 1024).text(path)


def _unzipped(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The data of one or more gzip members, or the content itself if it is not gzipped."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        inflate = zlib.decompressobj(31)
        data = content
        while data and not inflate.eof:
            yield inflate.decompress(data, step)
            data = inflate.unconsumed_tail
        content = inflate.unused_data


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[bytes, str], bytes]]:
    """Headers, by lower-case name, and block of each record in a stream of bytes."""
    buffer, at = bytearray(), 0
    parts = iter(parts)

    def more(until: int) -> bool:
        while len(buffer) < until:
            part = next(parts, None)
            if part is None:
                return False
            buffer.extend(part)
        return True

    while True:
        while (stop := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more(len(buffer) + 1):
                if bytes(buffer[at:]).strip():
                    raise ValueError("an archive ends within a record's head")
                return
        head = bytes(buffer[at:stop]).lstrip(b"\r\n")
        version, *lines = head.split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins here: {version[:40]!r}")
        fields = {k.strip().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
        begin, length = stop + 4, int(fields[b"content-length"])
        if not more(begin + length):
            raise ValueError("an archive ends within a block")
        yield fields, bytes(buffer[begin:begin + length])
        more(begin + length + 4)
        if buffer[begin + length:begin + length + 4] not in (b"\r\n\r\n", b""):
            raise ValueError("a block is longer than its length says")
        at = min(begin + length + 4, len(buffer))
        if at > 1 << 22:
            del buffer[:at]
            at = 0


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(page, url, record_type, refers_to, payload, payload_digest, intact)``, a row for each page.

    Continuation records are grouped by the record they continue and put in the order of
    their segment numbers; a response is ``intact`` if no number is missing, the whole length
    is as stated, its framing can be read and its digest is right. A response that is not has
    a null payload. Only segmented responses are shuffled; segments that repeat, because
    identical records were archived, count once for each first segment.
    """
    schema = ("page string, url string, record_type string, refers_to string, payload binary, payload_digest string, "
              "intact boolean, origin string, segment int, total bigint")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.binary(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int64()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for fields, block in parse(_unzipped(batch.column(0)[k].as_py())):
                    get = fields.get
                    kind, segment = get(b"warc-type"), get(b"warc-segment-number")
                    page, url = get(b"x-page-id"), get(b"warc-target-uri")
                    digest = (get(b"warc-payload-digest") or "").removeprefix("sha1:") or None
                    if kind == "revisit":
                        rows.append((page, url, kind, get(b"x-refers-to-page-id"), None, digest, True, None, None, None))
                    elif segment:
                        total = get(b"warc-segment-total-length")
                        origin = get(b"warc-segment-origin-id") or get(b"warc-record-id")
                        rows.append((page, url, kind, None, block, digest, None, origin, int(segment),
                                     None if total is None else int(total)))
                    elif kind == "response":
                        rows.append((page, url, kind, None, *checked(block, digest), None, None, None))
                    size += len(block)
                    if size > 8_000_000:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    def checked(block: bytes | None, digest: str | None) -> tuple[bytes | None, str | None, bool]:
        if block is None:
            return None, digest, False
        try:
            payload = payload_of(block)
        except ValueError:
            return None, digest, False
        own = base32_sha1(payload)
        return (payload, own, True) if digest in (None, own) else (None, digest, False)

    def join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts, totals = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                heads = batch.column(2)[k].as_py()
                parts.sort(key=lambda x: x["segment"])
                block = b"".join(x["payload"] for x in parts)
                whole = [x["segment"] for x in parts] == list(range(1, len(parts) + 1)) and totals == [len(block)]
                for head in heads:
                    payload, digest, intact = checked(block if whole else None, head["payload_digest"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip(
                            (head["page"], head["url"], "response", None, payload, digest, intact),
                            [pa.string()] * 4 + [pa.binary(), pa.string(), pa.bool_()], strict=True)], names[:7])

    records = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
    whole = records.where(F.col("origin").isNull()).select(names[:7])
    cut = records.where(F.col("origin").isNotNull()).groupBy("origin").agg(
        F.collect_set(F.struct("segment", "payload")).alias("parts"),
        F.collect_set("total").alias("totals"),
        F.collect_list(F.when(F.col("segment") == 1, F.struct("page", "url", "payload_digest"))).alias("heads"))
    joined = cut.select("parts", "totals", "heads").mapInArrow(join_segments, ", ".join(schema.split(", ")[:7]))
    return whole.union(joined)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                       least_bytes: int = 0, path: str | None = None, **sizes: int) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` as read back from archives.

    ``pages`` is written to archives at once, in a new folder of the shared one unless
    ``path`` is given. A revisit takes its payload's length from the response that it names.
    Rows with null or repeated ids, null html and repeated payloads: see ``write_archives``.
    An empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col, least_bytes, **sizes)
    read = materialise(read_archives(spark, path).select(
        "page", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("own_bytes"),
        F.coalesce("refers_to", "page").alias("source")), "records")
    responses = read.where("record_type = 'response'").groupBy(
        F.col("page").alias("source"), "payload_digest").agg(F.max("own_bytes").alias("bytes"))
    revisits = read.where("record_type = 'revisit'").join(responses, ["source", "payload_digest"], "left")
    return read.where("record_type = 'response'").select(
        F.col("page").cast(kind).alias("page_id"), F.col("own_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to")).union(revisits.select(
            F.col("page").cast(kind), "bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind)))
