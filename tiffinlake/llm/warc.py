"""WARC archives: whole-file gzip streams are rewritten so that each record is a member of its own.

Pages are first written as crawlers often leave them, one gzip stream per archive. The normaliser
inflates such a stream once, from front to back and a record at a time, turns responses with a payload
seen before into revisits, compresses each record into its own member, and writes a sidecar index with
the offset and length of every member. Readers seek to a record by the sidecar.

Which record is the first of its payload is decided on narrow rows (digest, id, place), never on texts.
Files are written by tasks to the shared folder under names with the attempt's id; only names that a
finished attempt returned are used, so a lost or repeated task leaves no half-written archive in use.

Defined cases: a null html is an empty payload; empty payloads are equal payloads; of equal ids with
equal payloads the one stored first is the response; a null page_id counts as the largest; line breaks
in a url are percent-encoded; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..sources.files import shared_folder
from .common import stored

#: Payload bytes and records after which a new archive begins, and bytes inflated at once.
ARCHIVE_BYTES, ARCHIVE_RECORDS, CHUNK = 64 << 20, 50_000, 1 << 18
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"
GZIP = 31
#: How hard the passing whole-file streams and the final members are compressed.
STREAM_LEVEL, MEMBER_LEVEL = 1, 6


def open_fs(folder: str) -> tuple[fs.FileSystem, str]:
    found, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
    found.create_dir(path, recursive=True)
    return found, path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def response(page_id: int | None, url: str | None, payload: bytes, sha: str) -> bytes:
    name = "" if page_id is None else str(page_id)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{ID}{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    headers += [("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return record(headers, http.encode() + payload)


def revisit(headers: list[tuple[str, str]], block: bytes, refers_to: str) -> bytes:
    """The record without its payload; the kept HTTP headers still tell the payload's length."""
    kept = [(k, v) for k, v in headers if k not in ("WARC-Type", "Content-Length")]
    kept += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    return record([("WARC-Type", "revisit"), *kept], block[: block.index(b"\r\n\r\n") + 4])


def parse_headers(head: bytes) -> list[tuple[str, str]]:
    return [tuple(line.split(": ", 1)) for line in head.decode().split("\r\n")[1:] if ": " in line]


def inflate(source) -> Iterator[bytes]:
    """The inflated bytes of a gzip file, of one member or many."""
    stream = zlib.decompressobj(GZIP)
    while data := source.read(CHUNK):
        while data:
            yield stream.decompress(data)
            data = stream.unused_data
            if stream.eof:
                stream = zlib.decompressobj(GZIP)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes, bytes]]:
    """(headers, block, whole record) one after the other; only one record is held."""
    held = bytearray()

    def more() -> bool:
        for chunk in chunks:
            if chunk:
                held.extend(chunk)
                return True
        return False

    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("the archive ends inside a record's headers")
        headers = parse_headers(bytes(held[:end]))
        start = end + 4
        size = start + int(dict(headers)["Content-Length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        whole = bytes(held[:size])
        del held[:size]
        yield headers, whole[start : size - 4], whole


def write_streams(pages: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url, html as whole-file gzip archives; returns a narrow row per record, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, path = open_fs(folder)
        sink, name, count, size, number = None, "", 0, 0, 0
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None or size >= ARCHIVE_BYTES or count >= ARCHIVE_RECORDS:
                    if sink is not None:
                        sink.write(stream.flush())
                        sink.close()
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.gz"
                    sink, stream = files.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(STREAM_LEVEL, zlib.DEFLATED, GZIP)
                    count, size, number = 0, 0, number + 1
                payload = (html or "").encode()
                sha = digest(payload)
                sink.write(stream.compress(response(page_id, url, payload, sha)))
                rows.append((name, count, page_id, len(payload), sha))
                count, size = count + 1, size + len(payload)
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(columns, names=["archive", "place", "page_id", "payload_bytes", "sha"])
        if sink is not None:
            sink.write(stream.flush())
            sink.close()

    ddl = "archive string, place long, page_id long, payload_bytes long, sha string"
    return stored(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, ddl), "written")


def revisits(written: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Per archive: the places of records that repeat a payload, and whom they refer to."""
    order = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("id"), "archive", "place", "page_id")
    known = written.where(F.col("payload_bytes") >= least_bytes)
    first = known.groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = known.join(first, "sha").where("archive <> first.archive or place <> first.place")
    refers = F.coalesce(F.col("first.page_id").cast("string"), F.lit(""))
    places = again.groupBy("archive").agg(F.collect_list(F.struct("place", refers.alias("refers_to"))).alias("again"))
    return written.select("archive").distinct().join(places, "archive", "left")


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites archives (archive, again) with a member per record and sidecars; returns their names, stored.

    An archive holds at most ``ARCHIVE_RECORDS`` records, so its list of repeats is bounded.
    """

    def rewrite(name: str, again: dict[int, str], attempt: int) -> str:
        files, path = open_fs(source)
        out_files, out_path = open_fs(target)
        done = f"{name.removesuffix('.warc.gz')}-{attempt}.warc.gz"
        offset, index = 0, []
        with files.open_input_stream(f"{path}/{name}", compression=None) as raw, out_files.open_output_stream(f"{out_path}/{done}", compression=None) as out:
            for place, (headers, block, whole) in enumerate(records(inflate(raw))):
                if place in again:
                    whole = revisit(headers, block, again[place])
                packer = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, GZIP)
                member = packer.compress(whole) + packer.flush()
                out.write(member)
                index.append((offset, len(member), dict(headers)["WARC-Record-ID"]))
                offset += len(member)
        with out_files.open_output_stream(f"{out_path}/{done}.idx", compression=None) as sidecar:
            sidecar.write("".join(json.dumps(row) + "\n" for row in index).encode())
        return done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            names = []
            for name, again in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(rewrite(name, {a["place"]: a["refers_to"] for a in again or []}, attempt))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])

    archives = stored(archives.select("archive", "again"), "plan")
    return stored(a_task_each(archives).mapInArrow(run, "archive string"), "archives")


def a_task_each(archives: DataFrame) -> DataFrame:
    """A row stands for much work, so rows are dealt over as many tasks; a number given isn't folded by their few bytes."""
    return archives.repartition(max(1, archives.count()))


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(archives: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """A row per record, each read through its place in the sidecar. A payload that isn't what its digest says fails."""
    names = [f.split()[0] for f in READ.split(", ")] + ["payload"] * keep_payload

    def number(name: str | None) -> int | None:
        text = (name or "").strip("<>").removeprefix(ID)
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{path}/{name}.idx", compression=None) as sidecar:
                    index = [json.loads(line) for line in sidecar.read().splitlines()]
                with files.open_input_file(f"{path}/{name}") as archive:
                    for low in range(0, len(index), 256):
                        yield batch_of([row(archive, *place) for place in index[low : low + 256]])

    def row(archive, offset: int, length: int, record_id: str) -> tuple:
        archive.seek(offset)
        ((headers, block, _),) = records(iter([zlib.decompress(archive.read(length), GZIP)]))
        told = dict(headers)
        if told["WARC-Record-ID"] != record_id:
            raise ValueError(f"the sidecar doesn't fit the record at {offset}")
        end = block.index(b"\r\n\r\n") + 4
        sha = told["WARC-Payload-Digest"].removeprefix("sha1:")
        if told["WARC-Type"] == "response" and digest(block[end:]) != sha:
            raise ValueError(f"{record_id}: the payload doesn't have the digest {sha}")
        size = int(dict(parse_headers(block[:end]))["Content-Length"])
        return (number(record_id), told.get("WARC-Target-URI"), told["WARC-Type"], size, sha,
                number(told.get("WARC-Refers-To")), block[end:])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    return a_task_each(archives.select("archive")).mapInArrow(run, READ + ", payload binary" * keep_payload)


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """(names of the normalised archives of page_id, url, html; their folder)."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    written = write_streams(pages, f"{folder}/streams")
    plan = revisits(written, least_bytes)
    return normalise(plan, f"{folder}/streams", f"{folder}/archives"), f"{folder}/archives"
