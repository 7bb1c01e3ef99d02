"""Operator 10: WARC archives, written once per distinct payload and read back in splits.

Writing: payload digests are counted natively; of equal payloads of ``least`` bytes or more, the row
with the smallest page_id becomes a ``response``, the others ``revisit`` records that name it and hold
headers only. Each task writes archives of bounded size, one gzip member for each record, under names
that no other attempt uses, and returns what it has finished; only those archives are ever read, so a
lost or repeated task leaves no record twice.

Reading: archives are cut into byte ranges, whatever stands at their edges. A task looks for gzip magic
in its range, takes a place as a record's start only if the member there decodes to a WARC version line
and well-formed headers, and owns the records that start inside its range, also where they end beyond.
Where a record ends, or the archive begins, another record must start: whoever reads up to there looks, so
that a damaged record is found wherever ranges are cut. It is an error, or a row of the type ``damaged``.

Defined cases: a null html is an empty payload; payloads below ``least`` are always responses; rows
that repeat the smallest page_id of their payload are all responses (a record never revisits itself);
null page_ids are larger than others; an empty table gives no archives and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, sliced, table

LEAST = 100
#: a payload of more than this part of all rows counts as hot
HOT = 200
MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1.0\r\n"
_RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _filesystem(uri: str):
    """The file system and path of a URI, as tasks open it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def _line(text) -> str:
    """A header value: line breaks would end it, so they are percent-encoded."""
    return str(text).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(page_id, url, kind: str, digest: str, n: int, refers_to, payload: bytes) -> bytes:
    """One WARC record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return _VERSION + ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> dict[str, str] | None:
    """The headers of a record that starts ``raw``; None if they are not those of a WARC record."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(_VERSION):
        return None
    out = {}
    for line in raw[len(_VERSION) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "surrogatepass")
    return out if {"warc-type", "content-length"} <= out.keys() and out["content-length"].isdigit() else None


def parse_record(raw: bytes) -> tuple:
    """A row of the reader's schema from one uncompressed record; a response's payload is checked against its digest."""
    head = parse_headers(raw)
    at = raw.find(b"\r\n\r\n") + 4
    block = raw[at : at + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    page = lambda x: None if x is None or x == "<urn:page:none>" else int(x[len("<urn:page:") : -1])
    kind = head["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {head['warc-record-id']} is damaged")
    uri = head.get("warc-target-uri")
    return page(head["warc-record-id"]), None if uri is None else _unline(uri), kind, digest, length, page(head.get("warc-refers-to")), payload if kind == "response" else None


def write_warc(pages: DataFrame, scratch: Scratch, least: int = LEAST, archive_bytes: int = 256 << 20, level: int = 4) -> DataFrame:
    """Write ``pages(page_id, url, html)``; returns the finished archives as (path, size)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    marked = pages.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    # only payloads that occur again take part in the join: one row each, made from partial counts
    again = marked.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 and first_id is not null")
    # payloads that are a good part of all rows (so few in number) don't meet in one task: their first ids are broadcast
    again = scratch.save(again, "again")
    hot = again.where(F.col("copies") > max(1000, pages.count() // HOT)).select("digest", F.col("first_id").alias("hot_id"))  # less than HOT rows
    marked = marked.join(F.broadcast(hot), "digest", "left")
    meets = F.when(F.col("hot_id").isNull(), F.col("digest")).otherwise(F.concat("digest", F.xxhash64("page_id").cast("string")))
    marked = marked.withColumn("meets", meets).join(again.select(F.col("digest").alias("meets"), "first_id"), "meets", "left").withColumn("first_id", F.coalesce("hot_id", "first_id"))
    base = scratch.path("archives")

    def run(it: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{task.partitionId()}-{task.taskAttemptId()}"
        files, path = _filesystem(base)
        files.create_dir(path)
        done, out, size = [], None, 0
        for b in sliced(it, 200):
            for page_id, url, payload, digest, n, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "n", "first_id")), strict=True):
                revisit = first is not None and first != page_id
                deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = record_bytes(page_id, url, "revisit" if revisit else "response", digest, n, first if revisit else None, payload)
                if out is None:
                    own = f"{path}/{name}-{len(done)}.warc.gz"
                    out, size = files.open_output_stream(own, compression=None), 0
                data = deflate.compress(raw) + deflate.flush()
                out.write(data)
                size += len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{base}/{name}-{len(done)}.warc.gz", size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{base}/{name}-{len(done)}.warc.gz", size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([s for _, s in done], pa.int64())], names=["path", "size"])

    return scratch.save(marked.select("page_id", "url", "payload", "digest", "n", "first_id").mapInArrow(run, "path string, size long"), "manifest")


def range_records(file, begin: int, end: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, bytes | None]]:
    """(place, uncompressed record) of the records whose gzip member starts at a byte of [begin, end) of ``file``.

    A member that was read whole tells where the next one starts; magic is only searched for at the
    range's begin and after damaged bytes. A place where a record must start (after another one, also beyond
    the range, or at byte 0) but none does gives None.
    """
    at, must = begin, begin == 0 < size
    while at < end:
        file.seek(at)
        data = file.read(min(step, end + len(MAGIC) - 1 - at, size - at))
        found = data.find(MAGIC)
        if must and found != 0:
            yield at, None
        if found < 0:
            at, must = at + max(1, len(data) - len(MAGIC) + 1), False
            continue
        at, must = at + found, must and found == 0
        if at >= end:
            return
        whole, after = _member(file, at, size)
        if whole is None:
            if must:
                yield at, None
            at, must = at + 1, False
            continue
        yield at, whole
        at, must = after, after < size
    if must and at < size and _member(file, at, size)[0] is None:
        yield at, None


def _member(file, at: int, size: int) -> tuple[bytes | None, int]:
    """The record in the member at ``at`` and the place after it; None if no WARC record starts there."""
    inflate = zlib.decompressobj(31)
    file.seek(at)
    parts, got, read, valid = [], 0, at, False
    while not inflate.eof:
        data = file.read(min(1 << 16, size - read)) if read < size else b""
        if not data:
            return None, at
        read += len(data)
        try:
            parts.append(inflate.decompress(data))
        except zlib.error:
            return None, at
        got += len(parts[-1])
        if not valid and (got >= len(_VERSION) or inflate.eof):
            head = b"".join(parts)
            if not head.startswith(_VERSION):
                return None, at
            if b"\r\n\r\n" in head or inflate.eof:
                if parse_headers(head) is None:
                    return None, at
                valid = True
            parts = [head]
    return b"".join(parts), read - len(inflate.unused_data)


def read_warc(archives: DataFrame, split_bytes: int = 32 << 20, damaged: str = "raise") -> DataFrame:
    """Records of the archives (path, size), read in ranges of ``split_bytes`` wherever records begin and end.

    ``damaged``: ``raise`` an error at the first damaged record, or ``report`` each as a row of that type
    with its archive and place as url.
    """
    if damaged not in ("raise", "report"):
        raise ValueError("damaged is either raise or report")
    ranges = archives.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("begin"))
    tasks = max(1, ranges.count())
    # a range is a row of a few bytes; they are dealt one to a task
    dealt = ranges.repartition(min(tasks, 100_000), F.xxhash64("path", "begin")) if tasks > 1 else ranges

    def run(it: Iterator):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in it:
            for path, size, begin in zip(*(b.column(c).to_pylist() for c in ("path", "size", "begin")), strict=True):
                files, own = _filesystem(path)
                with files.open_input_file(own) as file:
                    held, room = [], 0
                    for at, raw in range_records(file, begin, min(begin + split_bytes, size), size):
                        try:
                            if raw is None:
                                raise ValueError("no record starts where one must")
                            held.append(parse_record(raw))
                            room += len(raw)
                        except ValueError as why:
                            if damaged == "raise":
                                raise ValueError(f"{path}, byte {at}: {why}") from why
                            held.append((None, f"{path}#{at}", "damaged", None, None, None, None))
                        if room > 16 << 20:
                            yield _rows(held, schema)
                            held, room = [], 0
                    if held:
                        yield _rows(held, schema)

    return dealt.mapInArrow(run, _RECORD)


def _rows(held: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(table(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    return read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS h FROM p),
     f AS (SELECT h, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY h)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f USING (h)
"""
