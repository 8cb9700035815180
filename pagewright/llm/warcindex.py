"""WARC archives written and read through an index.

Writing: every partition streams its records to gzip members of its own archive
files in the shared folder and returns one index row per record: file, offset,
length, URL, digest. Reading: chosen index rows are sorted by file and offset,
dealt out by file region, and neighbouring byte ranges are read together and cut
into records again.

A file that a failed task leaves behind is in no index row, so retries are safe.
Of equal payloads (by length and SHA-1) one is stored in full; its group is
found from digests alone, counted on the map side.
"""

from __future__ import annotations

import hashlib
import base64
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .scratch import scratch_path, ship, stored

DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 256 << 20
GAP, RUN = 64 << 10, 8 << 20  # bytes skipped rather than starting a new read; bytes read at once
REGION, LEAST_REGION = 32 << 20, 1 << 20  # bytes of archive that a task reads: the most, and the least for the sake of more tasks
INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id {kind}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page, url, payload: bytes, first, revisit: bool) -> tuple[bytes, str]:
    """One WARC record and its payload digest."""
    digest = digest32(payload)
    name = lambda x: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{x}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(first)}", f"X-Refers-To-Page: {quote(str(first), safe='')}"]
    if page is not None:
        lines.append(f"X-Page: {quote(str(page), safe='')}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def _writing(folder: str, kind: pa.DataType):
    def kernel(batches):
        files, here = fs.FileSystem.from_uri(folder)
        files.create_dir(here, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, url, payload, first, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first", "revisit"))):
                    if out is None or offset > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{here}/{name}", compression=None)
                    record, digest = _record(page, url, payload, first, revisit)
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = squeeze.compress(record) + squeeze.flush()
                    out.write(member)
                    rows.append((name, offset, len(member), url, digest, page))
                    offset += len(member)
                names = ["file", "offset", "length", "url", "digest", "page_id"]
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        finally:
            if out is not None:
                out.close()

    return kernel


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write one record per row of ``pages`` to ``folder``; the stored index, one row per record.

    Of records with equal payloads of at least ``least`` bytes the one with the
    largest id is a response and the others revisit it; smaller payloads are all
    responses. Null ids rank below all others, and rows that repeat the largest
    id of their group, or whose group has null ids only, are all responses. A null
    payload is empty; a null URL leaves its header out. Other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    kind = pages.schema[id_col].dataType
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"_sha": F.unhex(F.sha1("payload")), "_n": F.octet_length("payload")})
    top = stored(rows.where(F.col("_n") >= least).groupBy("_sha", "_n").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"), "payloads")
    marked = rows.join(top, ["_sha", "_n"], "left").select(
        "page_id", "url", "payload", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))
    from pyspark.sql.pandas.types import to_arrow_type

    return stored(marked.mapInArrow(_writing(folder, to_arrow_type(kind)), INDEX.format(kind=kind.simpleString())), "index")


def _header(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def parse_record(member: bytes) -> dict:
    """The WARC and HTTP headers and the payload of one gzip member; payload None for a revisit."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _header(head.decode().split("\r\n"))
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"warc": warc, "http": _header(http.decode().split("\r\n")), "payload": None if warc["warc-type"] == "revisit" else payload}


def _reading(folder: str, with_payload: bool):
    def kernel(batches):
        files, here = fs.FileSystem.from_uri(folder)
        held: dict[str, object] = {}

        def members(rows):
            """The bytes of each (file, offset, length), by coalesced reads."""
            at = 0
            while at < len(rows):
                name, start, length = rows[at]
                end, stop = start + length, at + 1
                while stop < len(rows) and rows[stop][0] == name and 0 <= rows[stop][1] - end <= GAP and rows[stop][1] + rows[stop][2] - start <= RUN:
                    end = rows[stop][1] + rows[stop][2]
                    stop += 1
                if name not in held:
                    for old in held.values():
                        old.close()
                    held.clear()
                    held[name] = files.open_input_file(f"{here}/{name}")
                data = held[name].read_at(end - start, start)
                for _, offset, size in rows[at:stop]:
                    yield data[offset - start : offset - start + size]
                at = stop

        for batch in batches:
            wanted = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            out = []
            for member in members(wanted):
                record = parse_record(member)
                warc, payload = record["warc"], record["payload"]
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                if payload is not None and digest32(payload) != digest:
                    raise ValueError(f"payload of {warc['warc-record-id']} does not match its digest")
                page, first = (x if x is None else unquote(x) for x in (warc.get("x-page"), warc.get("x-refers-to-page")))
                out.append((page, int(record["http"]["content-length"]), digest, warc["warc-type"], first,
                            payload.decode() if with_payload and payload is not None else None))
            columns = list(zip(*out)) or [()] * 6
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
            keep = 6 if with_payload else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)][:keep], names[:keep])
        for old in held.values():
            old.close()

    return kernel


def read_archives(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the index rows in ``index``, read from ``folder``.

    Columns: page_id (as in the index), payload_bytes and payload_digest (of the
    full payload), record_type, refers_to, and html if asked for (null for revisits).
    """
    spark = index.sparkSession
    ship(spark)
    kind = index.schema["page_id"].dataType.simpleString()
    # Index rows are few bytes, archives are many: the number of tasks comes from the archives' bytes.
    total = index.agg(F.sum("length")).first()[0] or 0
    size = min(max(total // (4 * spark.sparkContext.defaultParallelism), LEAST_REGION), REGION)
    region = F.floor(F.col("offset") / size)
    dealt = index.select("file", "offset", "length").repartition(total // size + 1, "file", region).sortWithinPartitions("file", "offset")
    schema = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", html string" * with_payload
    rows = dealt.mapInArrow(_reading(folder, with_payload), schema)
    return rows.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read every record back."""
    folder = scratch_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder, id_col, **options)
    return read_archives(index, folder).withColumnRenamed("page_id", id_col)
