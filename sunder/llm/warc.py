"""Legacy archive converter: ARC files of version 1 and 2 to WARC, and a WARC reader.

An ARC file is a version block, then records: a header line whose fields depend on the version, so many bytes as it
declares, a line feed. Blocks are always taken by their declared lengths, never by searching for a separator, so
payloads may hold anything. For each record the converter synthesises what WARC has and ARC lacks:

* WARC-Record-ID: a name-based UUID of url, archive date, digest and the record's key, so that converting again gives the same;
* WARC-Date: the 14-digit (version 1 also 12-digit) archive date in ISO 8601, UTC;
* WARC-Type: response for HTTP blocks, resource for others, revisit for repeated payloads;
* WARC-Payload-Digest: sha256 of the payload, and Content-Length.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest key is the response; the
others refer to it and keep the HTTP header only. The first of each payload is found by a shuffle of digests and keys, with
map-side combination, not of payloads; only the table of repeated digests is joined back.

Archives are written by Spark's text sink through its committer, so any Hadoop file system, retried tasks and
speculative ones are fine; gzip is applied to whole files. Files roll after a number of records; a reader holds one file's
compressed bytes and parses them as a stream, so a task needs as much as FILE_RECORDS records take.

Defined cases: a null payload is an empty one; a record cut off before its declared length raises an error; empty
tables give no records; of rows that repeat a key and a payload none refers to another of them; a record without a key is never the
first of its payload unless none has one.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunder.llm.common import dropped, shared_folder, small_batches, written

MIN_REVISIT = 100
#: Bytes of an ARC file in memory, and records in a WARC file.
ARC_BYTES, FILE_RECORDS = 8 << 20, 5000

#: The fields of a header line in either version of the ARC format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Url and content type may hold blanks, so a header line is read by its address, date and the fields at its right end.
_ARC_LINE = {1: re.compile(r"(.*) (\S+) (\d{12,14}) (.*) (\d+)"), 2: re.compile(r"(.*) (\S+) (\d{12,14}) (.*) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+)")}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, names that are URLs
KEY_HEADER = b"X-Record-Key"


def arc_header(version: int, url: str, ip: str, date: str, kind: str, length: int, code: int = 200, checksum: str = "-", offset: int = 0, name: str = "-") -> bytes:
    """A record's header line. Blanks and line ends, which would break the line, are percent-encoded in the url."""
    safe = "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url) or "-"
    fields = [safe, ip, date, kind, length] if version == 1 else [safe, ip, date, kind, code, checksum, "-", offset, name, length]
    return " ".join(map(str, fields)).encode() + b"\n"


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 sunder\n{ARC_FIELDS[version]}\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), name=name) + body + b"\n"


def parse_arc(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of an ARC file: url, ip, date (ISO), kind, http (header bytes or None), payload. The version block tells how to read the header lines."""
    first = stream.readline()
    if not first:
        return
    if not first.startswith(b"filedesc:"):
        raise ValueError("an ARC file begins with its version block")
    body = _exactly(stream, int(first.split()[-1]))
    version = int(body.split(None, 1)[0])
    names = body.split(b"\n")[1].decode().split()
    if names != ARC_FIELDS.get(version, "").split():
        raise ValueError(f"unknown ARC version or fields: {version} {names}")
    while line := stream.readline():
        if not line.strip():
            continue  # the line feed after a block
        fields = _ARC_LINE[version].fullmatch(line.decode("utf-8", "replace").rstrip("\r\n"))
        if fields is None:
            raise ValueError(f"{len(names)} fields expected: {line[:200]!r}")
        at = dict(zip(names, fields.groups(), strict=True))
        block = _exactly(stream, int(at["Archive-length"]))
        http = None
        if block.startswith(b"HTTP/") and (end := block.find(b"\r\n\r\n")) >= 0:
            http, block = block[: end + 4], block[end + 4 :]
        yield {"url": at["URL"], "ip": at["IP-address"], "date": iso_date(at["Archive-date"]), "kind": at["Content-type"], "http": http, "payload": block}


def _exactly(stream: io.BufferedIOBase, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise EOFError(f"{n} bytes declared, {len(data)} there")
    return data


def iso_date(date: str) -> str:
    """YYYYMMDDhhmm[ss] as ISO 8601; what is missing is zero."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def header_value(block: bytes | None, name: bytes) -> bytes | None:
    for line in (block or b"").split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip()
    return None


def record_id(url: str, date: str, digest: str, key: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMESPACE, f'{url} {date} {digest} {key}')}"


def arc_archives(pages: DataFrame, key: str, url: str, payload: str, date: str = "20240101000000", size: int = ARC_BYTES) -> DataFrame:
    """(name, content): ARC files of about `size` bytes, one record for each row, versions taking turns."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total, n = [], 0, 0

        def close():
            return pa.RecordBatch.from_pydict({"name": [name], "content": [b"".join(parts)]}, schema=pa.schema([("name", pa.string()), ("content", pa.binary())]))

        for batch in batches:
            for k, u, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not parts:
                    version, name = 1 + n % 2, f"legacy-{uuid.uuid4().hex}.arc"
                    parts, n = [version_block(version, name, date)], n + 1
                    total = len(parts[0])
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(p)
                http += (KEY_HEADER + b": %d\r\n" % k if k is not None else b"") + b"\r\n"
                parts += [arc_header(version, u, "0.0.0.0", date, "text/html", len(http) + len(p), offset=total, name=name), http, p, b"\n"]
                total += sum(map(len, parts[-4:]))
                if total >= size:
                    yield close()
                    parts = []
        if parts:
            yield close()

    return rows.mapInArrow(pack, "name string, content binary")


def arc_records(archives: DataFrame, content: str = "content") -> DataFrame:
    """Records of ARC files, plain or gzipped, given as rows (such as those of Spark's binaryFile source): key, url, ip, date, kind, http, payload, payload_bytes, digest, record_id."""
    schema = "key long, url string, ip string, date string, kind string, http binary, payload binary, payload_bytes long, digest string, record_id string"
    arrow = pa.schema([("key", pa.int64()), *((c, pa.string()) for c in ("url", "ip", "date", "kind")), ("http", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("record_id", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                out, size = [], 0
                for r in parse_arc(_opened(data.as_py())):
                    key = header_value(r["http"], KEY_HEADER)
                    r["key"] = int(key) if key is not None else None
                    r["digest"] = hashlib.sha256(r["payload"]).hexdigest()
                    r["record_id"] = record_id(r["url"], r["date"], r["digest"], r["key"])
                    r["payload_bytes"] = len(r["payload"])
                    out.append(r)
                    size += len(r["payload"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return archives.select(content).mapInArrow(parse, schema)


def _opened(data: bytes | None) -> io.BufferedIOBase:
    data = data or b""
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def with_revisits(records: DataFrame, at_least: int = MIN_REVISIT) -> DataFrame:
    """records with first_key, first_id, first_url and first_date of the response that a repeated payload refers to, else null.

    The records are read twice, the first time without their payloads, so give a written table. Digests of one record don't reach the join; a hot one is
    one row on its right side, which is a written table, too, and so is broadcast only if its files are small enough.
    """
    known = F.struct(F.col("key").isNull().alias("none"), "key", "record_id", "url", "date")
    long = F.col("payload_bytes") >= at_least
    firsts = written(records.where(long).groupBy("digest").agg(F.min(known).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "firsts")
    out = records.join(firsts, "digest", "left")
    return out.withColumn("first", F.when(long & ~F.col("first.key").eqNullSafe(F.col("key")), F.col("first")))


def warc_records(records: DataFrame) -> DataFrame:
    """A column `value` of binary WARC records without the two line ends that close each."""
    http = F.col("http").isNotNull()
    kind = F.when(F.col("first").isNotNull(), "revisit").when(http, "response").otherwise("resource")
    block = F.when(F.col("first").isNotNull(), F.coalesce("http", F.lit(b""))).when(http, F.concat("http", "payload")).otherwise(F.col("payload"))
    head = records.withColumns({"_kind": kind, "_block": block})
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.concat(
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<"), "first.record_id", F.lit(">"))),
        line("WARC-Refers-To-Target-URI", F.col("first.url")), line("WARC-Refers-To-Date", F.col("first.date")), F.coalesce(line("X-Refers-To-Key", F.col("first.key").cast("string")), F.lit("")),
    )
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("_kind")), line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))), line("WARC-Target-URI", F.col("url")), line("WARC-Date", F.col("date")),
        line("WARC-IP-Address", F.col("ip")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), F.when(F.col("first").isNotNull(), revisit).otherwise(""),
        line("Content-Type", F.when(http, "application/http; msgtype=response").otherwise(F.col("kind"))), line("Content-Length", F.octet_length("_block").cast("string")), F.lit("\r\n"),
    )
    return head.select(F.concat(header.cast("binary"), F.col("_block")).alias("value"))


def write_warc(records: DataFrame, folder: str, file_records: int = FILE_RECORDS) -> None:
    """Writes gzipped WARC files. The text sink writes a string's bytes as they are, and ends each record by its line separator."""
    out = records.select(F.col("value").cast("string"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).option("zlib.compress.level", "BEST_SPEED").text(folder)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record, by declared length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record begins with its version: {line[:80]!r}")
        head = [line]
        while (line := stream.readline()).strip():
            head.append(line)
        header = b"".join(head)
        yield header, _exactly(stream, int(header_value(header, b"Content-Length")))


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of WARC files: key, record_id, record_type, url, date, payload_bytes, payload_digest, refers_to (a record id), refers_to_key, payload.

    payload_bytes and payload_digest are those of the full payload; for a revisit, whose payload isn't stored, they are
    what its headers declare. Of a stored payload the digest is computed, and one that differs from its header raises an error.
    """
    schema = "key long, record_id string, record_type string, url string, date string, payload_bytes long, payload_digest string, refers_to string, refers_to_key long" + ", payload binary" * with_payload
    arrow = pa.schema([("key", pa.int64()), *((c, pa.string()) for c in ("record_id", "record_type", "url", "date")), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("refers_to_key", pa.int64()), *[("payload", pa.binary())] * with_payload])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                out, size = [], 0
                for header, block in parse_warc(_opened(data.as_py())):
                    get = lambda name, at=header: (v := header_value(at, name)) and v.decode("utf-8", "replace")
                    is_http = (get(b"Content-Type") or "").startswith("application/http")
                    http, payload = (block[: (end := block.find(b"\r\n\r\n") + 4)], block[end:]) if is_http else (None, block)
                    kind, digest = get(b"WARC-Type"), (get(b"WARC-Payload-Digest") or "").removeprefix("sha256:")
                    if kind == "revisit":
                        n, payload = int(header_value(http, b"Content-Length") or 0), None
                    else:
                        n = len(payload)
                        if (real := hashlib.sha256(payload).hexdigest()) != (digest or real):
                            raise ValueError(f"{get(b'WARC-Record-ID')}: the payload's digest is {real}, not {digest}")
                        digest = real
                    key, to = header_value(http, KEY_HEADER), header_value(header, b"X-Refers-To-Key")
                    out.append({"key": int(key) if key else None, "record_id": (get(b"WARC-Record-ID") or "").strip("<>"), "record_type": kind, "url": get(b"WARC-Target-URI"), "date": get(b"WARC-Date"), "payload_bytes": n, "payload_digest": digest, "refers_to": (get(b"WARC-Refers-To") or "").strip("<>") or None, "refers_to_key": int(to) if to else None} | ({"payload": payload} if with_payload else {}))
                    size += len(payload or b"") * with_payload + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(parse, schema)


def convert(archives: DataFrame, folder: str, at_least: int = MIN_REVISIT) -> None:
    """ARC files, given as rows with their content, to WARC files in a folder. Each is parsed once, into a table in the shared folder."""
    records = written(arc_records(archives), "records")
    write_warc(warc_records(with_revisits(records, at_least)), folder)
    dropped(records)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", with_payload: bool = False) -> DataFrame:
    """Pages as legacy archives, those converted to WARC files in the shared folder, and these read back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    convert(arc_archives(pages, key, url, payload), folder)
    return read_warc(spark, folder, with_payload)
