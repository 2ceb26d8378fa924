"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as three records, a request, a response (or a revisit) and
a metadata record; the request and the metadata name the response in
``WARC-Concurrent-To``.  Of captures with equal payloads of at least
``revisit_bytes``, that with the largest page id is a response and the others
are revisits that keep its headers and digest but not its payload.

Tasks stream records into gzip members, close a file at ``file_bytes`` and
report its name once it is complete.  Only reported files are read, so what a
lost or repeated task has left behind does no harm.  Files are opened through
the file system of their URI (local, HDFS, S3 or GCS), never by local path.

Records come back as rows; all records of a capture have one capture id (their
``WARC-Concurrent-To``, or else their own id) and are joined by one grouping on
it into one nested row.

Defined cases: a null html is an empty payload; a null url becomes
``urn:page:<id>``; characters that may not stand in a header are escaped; a null
``page_id`` counts as the smallest and is read back as null; rows that repeat
the largest page id are all responses; an empty table writes no file and gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depinfer.llm.common import materialize, ship

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _header(value: str) -> str:
    from urllib.parse import quote

    return quote(value, safe="%/:=&?~#+!$,;'@()*[]")


def _record(kind: str, record_id: str, date: str, content_type: str, block: bytes, more: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), *more, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _capture(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, unique: str, date: str) -> list[bytes]:
    from base64 import b32encode
    from urllib.parse import urlsplit
    from uuid import NAMESPACE_URL, uuid5

    target = _header(url if url is not None else f"urn:page:{page_id}")
    own, request, metadata = (str(uuid5(NAMESPACE_URL, f"{kind}:{unique}:{page_id}")) for kind in ("response", "request", "metadata"))
    try:
        parts = urlsplit(target)
        host, path = parts.netloc, (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        host, path = "", "/"
    common, concurrent = [("WARC-Target-URI", target)], [("WARC-Concurrent-To", f"<urn:uuid:{own}>")]
    kept = [*common, ("WARC-Payload-Digest", "sha1:" + b32encode(bytes.fromhex(digest)).decode())]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page_id), ("refers-to-page-id", refers_to)) if v is not None).encode()
    return [
        _record("request", request, date, "application/http; msgtype=request", f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), common + concurrent),
        _record("revisit", own, date, "application/http; msgtype=response", http, [*kept, ("WARC-Profile", _PROFILE)]) if revisit else _record("response", own, date, "application/http; msgtype=response", http + payload, kept),
        _record("metadata", metadata, date, "application/warc-fields", fields, common + concurrent),
    ]


def _write_of(path: str, date: str, file_bytes: int, level: int):
    def write(batches):
        import zlib
        from uuid import uuid4

        import pyarrow as pa
        from pyspark import TaskContext

        part, at, out, held, name, done = TaskContext.get().partitionId(), 0, None, 0, "", []
        files, folder = _open(path)
        for batch in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit"))
            for page_id, url, html, digest, refers_to, revisit in zip(*columns):
                if out is None:
                    files.create_dir(folder)
                    name = f"part-{part:05d}-{uuid4().hex}.warc.gz"
                    out, held = files.open_output_stream(f"{folder}/{name}", compression=None), 0
                for record in _capture(page_id, url, html.encode(), digest, refers_to, revisit, f"{part}:{at}", date):
                    packer = zlib.compressobj(level, wbits=31)
                    data = packer.compress(record) + packer.flush()
                    out.write(data)
                    held += len(data)
                at += 1
                if held >= file_bytes:
                    out.close()
                    out = None
                    done.append(name)
        if out is not None:
            out.close()
            done.append(name)
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{x}" for x in done], pa.string())], names=["path"])

    return write


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 128 << 20, level: int = 2) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``path``; returns the written manifest (path)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    large = rows.filter(F.octet_length("html") >= revisit_bytes)
    groups = large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).filter("n > 1 and refers_to is not null").select("digest", "refers_to")
    # Written first: the join then knows its size, and splits a hot payload's rows if it has to shuffle.
    groups = materialize(groups, "op6-groups")
    joined = rows.join(groups, "digest", "left").withColumn("revisit", F.expr("refers_to is not null and not (page_id <=> refers_to)"))
    out = joined.select("page_id", "url", "html", "digest", F.expr("if(revisit, refers_to, null)").alias("refers_to"), "revisit")
    return materialize(out.mapInArrow(_write_of(path, date, file_bytes, level), "path string"), "op6-manifest")


RECORDS = "record_id string, capture_id string, type string, target_uri string, date string, payload_digest string, payload_bytes bigint, payload binary, fields map<string,string>"


def _records(stream):
    """Headers and block of each record of a stream of gzip members."""
    import gzip

    data = gzip.GzipFile(fileobj=stream)
    while line := data.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError("no WARC record where one should begin")
            continue
        head = {}
        while (line := data.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = data.read(size)
        if len(block) != size:
            raise EOFError("a WARC record is cut off")
        yield head, block


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k}


def _read_of(with_payload: bool):
    def read(batches):
        from base64 import b32decode

        import pyarrow as pa

        schema = pa.schema([("record_id", pa.string()), ("capture_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])
        rows, held = [], 0
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            files, name = _open(path)
            with files.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                for head, block in _records(stream):
                    kind, own = head["warc-type"], head["warc-record-id"].strip("<>")
                    payload = digest = size = None
                    fields = {}
                    if kind in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = head.get("warc-payload-digest", "").partition(":")[2]
                        digest, size = (b32decode(said).hex() if said else None), int(_fields(http).get("content-length", len(payload)))
                        if kind == "response":
                            actual = hashlib.sha1(payload).hexdigest()
                            if digest not in (None, actual) or size != len(payload):
                                raise ValueError(f"payload and headers of {own} differ")
                            digest = actual
                    elif kind == "metadata":
                        fields = _fields(block)
                    elif kind == "request":
                        fields = {"request-line": block.partition(b"\r\n")[0].decode("utf-8", "replace")}
                    rows.append((own, head.get("warc-concurrent-to", own).strip("<>"), kind, head.get("warc-target-uri"), head.get("warc-date"), digest, size, payload if with_payload else None, list(fields.items())))
                    held += len(payload or b"") if with_payload else 0
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return read


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the files that ``manifest`` (path) lists, a file to a task."""
    n = max(1, min(manifest.count(), 10_000))
    return manifest.repartition(n, "path").mapInArrow(_read_of(with_payload), RECORDS)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """``capture_id, response, request, metadata``: one nested row per capture.

    A capture without a response record is dropped; of several requests the one
    with the smallest id counts, the fields of several metadata records merge.
    """
    one = lambda kinds, *columns: F.min(F.when(F.col("type").isin(*kinds), F.struct("record_id", *columns)))
    grouped = records.groupBy("capture_id").agg(
        one(("response", "revisit"), "type", "target_uri", "date", "payload_digest", "payload_bytes", "payload").alias("response"),
        F.min(F.when(F.col("type") == "request", F.struct("record_id", "target_uri", F.col("fields")["request-line"].alias("request_line")))).alias("request"),
        F.collect_list(F.when(F.col("type") == "metadata", F.map_entries("fields"))).alias("entries"),
    )
    merged = F.aggregate(F.flatten("entries"), F.expr("cast(map() as map<string,string>)"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    return grouped.filter("response is not null").select("capture_id", "response", "request", merged.alias("metadata"))


ship(__name__)
