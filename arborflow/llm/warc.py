"""WARC archives of pages: written as one gzip stream a file, normalised to one member a record with an offset index, and read by that index.

A whole-file stream can't be entered in the middle. The normaliser inflates it
once, from start to end, rewrites every record as a gzip member of its own and
notes each member's offset and length in a sidecar file, so that any record can
be read alone. Files lie in a shared folder and are reached by pyarrow.fs, so
the folder may be local, HDFS or an object store. Every attempt of a task
writes files of its own name; only those that a finished task reports are read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborflow.llm.common import bound_batches, materialize, scratch_folder
from arborflow.workers import ensure_importable

#: Payload bytes after which a task begins another file.
FILE_BYTES = 64 << 20
#: Bytes that are read, inflated and deflated at once.
CHUNK = 1 << 18
#: Effort of both compressions.
LEVEL = 4
#: Longest head of a record.
HEAD_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"
GZIP = 31
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, index string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long, payload binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    number = urn[len("<urn:page:") : -1] if urn else ""
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with its payload, or a revisit record that names the response and holds the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return ("\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def info(name: str) -> bytes:
    body = b"software: arborflow\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Names in lower case -> values of a record's head."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:80]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _inflated(source) -> Iterator[bytes]:
    """Chunks of a gzip file's content, of one member or of many."""
    stream, fresh = zlib.decompressobj(GZIP), True
    while data := source.read(CHUNK):
        while data:
            if out := stream.decompress(data, CHUNK):
                yield out
            fresh = False
            data = stream.unconsumed_tail
            if stream.eof:
                data, stream, fresh = stream.unused_data, zlib.decompressobj(GZIP), True
    if not fresh:
        raise ValueError("the gzip stream ends early")


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """(head, pieces) of each record; the pieces are its bytes, head included, and must be used up before the next record."""
    held = bytearray()

    def more() -> bool:
        piece = next(chunks, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if len(held) > HEAD_BYTES:
                raise ValueError("a record's head doesn't end")
            if not more():
                if held.strip():
                    raise ValueError("the file ends inside a record's head")
                return
        head = bytes(held[:end])
        length = end + 4 + int(fields(head)["content-length"]) + 4

        def pieces(left: int = length) -> Iterator[bytes]:
            while left:
                if not held and not more():
                    raise ValueError("the file ends inside a record")
                piece = bytes(held[:left])
                del held[:left]
                left -= len(piece)
                yield piece

        yield head, pieces()


def normalise(source, target, level: int = LEVEL) -> Iterator[dict]:
    """Copy a gzip file of WARC records to target with one member a record; yields each record's fields with offset and length of its member. Memory follows CHUNK, not the file or its records."""
    offset = 0
    for head, pieces in split_records(_inflated(source)):
        member, start = zlib.compressobj(level, zlib.DEFLATED, GZIP), offset
        for piece in pieces:
            offset += target.write(member.compress(piece))
        offset += target.write(member.flush())
        yield fields(head) | {"offset": start, "length": offset - start}


def read_member(source, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, body after the HTTP head) of one record."""
    source.seek(offset)
    whole = zlib.decompress(source.read(length), GZIP)
    end = whole.index(b"\r\n\r\n")
    head = fields(whole[:end])
    content = whole[end + 4 : end + 4 + int(head["content-length"])]
    http, _, body = content.partition(b"\r\n\r\n")
    names = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:])}
    return head, names, body


def _open(folder: str):
    where, path = pafs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    return where, path


class _Writer:
    """One whole-file gzip stream."""

    def __init__(self, folder: str):
        self.where, path = _open(folder)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.out = self.where.open_output_stream(f"{path}/{self.name}", compression=None)
        self.stream, self.records, self.bytes = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0, 0
        self.add(info(self.name))

    def add(self, data: bytes) -> None:
        self.out.write(self.stream.compress(data))
        self.records, self.bytes = self.records + 1, self.bytes + len(data)

    def close(self) -> tuple:
        self.out.write(self.stream.flush())
        self.out.close()
        return self.name, None, self.records - 1, self.bytes


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["archive", "index", "records", "bytes"])


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file, done = None, []
    for b in batches:
        page, url, html, digest, first, revisit = (b.column(k) for k in range(6))
        for p, u, h, d, f, r in zip(page.to_pylist(), url.to_pylist(), html.cast(pa.binary()).to_pylist(), digest.to_pylist(), first.to_pylist(), revisit.to_pylist()):
            file = file or _Writer(folder)
            file.add(record(p, u, h, d, f, r))
            if file.bytes >= FILE_BYTES:
                done.append(file.close())
                file = None
    if file:
        done.append(file.close())
    yield _manifest(done)


def write_archives(pages: DataFrame, folder: str, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(archive, index, records, bytes) of the files written to folder, one gzip stream each.

    Of pages with equal payloads of at least `least` bytes the one with the
    smallest id is a response, rows of equal id and payload too, and the others
    are revisits of it; a null id is never the smallest unless all are null. A null html is
    an empty payload, a null url is left out. An empty table writes no file.
    """
    spark = pages.sparkSession
    ensure_importable(spark)
    bound_batches(spark)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    long = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = materialize(long.where("n > 1").select("digest", "first"), "repeated-payloads")  # small ones Spark may broadcast, by their size
    revisit = F.coalesce((F.octet_length("html") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    told = rows.join(repeated, "digest", "left").select("page_id", "url", "html", "digest", "first", revisit.alias("revisit"))
    return materialize(told.mapInArrow(functools.partial(_write, folder), MANIFEST), "archives")


def _normalise(source: str, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from_fs, from_path = _open(source)
    to_fs, to_path = _open(folder)
    for b in batches:
        for archive in b.column(0).to_pylist():
            name = f"{uuid.uuid4().hex}.warc.gz"
            index, records = f"{name}.index.jsonl", 0
            with from_fs.open_input_stream(f"{from_path}/{archive}", compression=None) as src, to_fs.open_output_stream(f"{to_path}/{name}", compression=None) as dst, to_fs.open_output_stream(f"{to_path}/{index}", compression=None) as idx:
                size = 0
                for entry in normalise(src, dst):
                    idx.write((json.dumps({"archive": name, "type": entry["warc-type"], "id": entry.get("warc-record-id"), "uri": entry.get("warc-target-uri"), "digest": entry.get("warc-payload-digest"), "offset": entry["offset"], "length": entry["length"]}) + "\n").encode())
                    records, size = records + 1, entry["offset"] + entry["length"]
            yield _manifest([(name, index, records, size)])


def normalise_archives(manifest: DataFrame, source: str, folder: str) -> DataFrame:
    """The manifest of the files of `source` rewritten to folder with one member a record, each with a sidecar index; a task takes whole files of about FILE_BYTES."""
    spread = manifest.select("archive").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "archive")
    return materialize(spread.mapInArrow(functools.partial(_normalise, source, folder), MANIFEST), "members")


def _read(folder: str, with_payload: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    where, path = _open(folder)
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "archive", "offset", "length", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)

    for b in batches:
        for archive, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows, size = [], 0
            with where.open_input_stream(f"{path}/{index}", compression=None) as idx:
                entries = [json.loads(x) for x in idx.read().splitlines()]
            with where.open_input_file(f"{path}/{archive}") as src:
                for e in entries:
                    if e["type"] not in ("response", "revisit"):
                        continue
                    head, http, body = read_member(src, e["offset"], e["length"])
                    n, digest = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and (len(body) != n or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"{archive}: the record at {e['offset']} doesn't hold what its head says")
                    rows.append((page_of(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], page_of(head.get("warc-refers-to")), n, digest, archive, e["offset"], e["length"], body if with_payload and not revisit else None))
                    size += len(body) if with_payload else 64
                    if size > CHUNK:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the normalised files: page_id, url, record_type, refers_to, payload_bytes, payload_digest, archive, offset, length, payload (null for revisits). Every stored payload is held to its digest and length."""
    spread = manifest.select("archive", "index").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "archive")
    return spread.mapInArrow(functools.partial(_read, folder, with_payload), RECORDS)


def archive_digest(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages written, normalised and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, and where each record lies."""
    whole, members = (scratch_folder(pages.sparkSession, name) for name in ("warc-whole", "warc-members"))
    written = write_archives(pages, whole, least, id_col, url_col, html_col)
    records = read_archives(normalise_archives(written, whole, members), members, False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length")
