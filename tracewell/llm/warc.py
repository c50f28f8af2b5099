"""WARC archives: one gzip member per record, read in sequence with incremental decompression.

Tasks write one archive per partition straight into the shared folder; the table of archives that a finished job leaves
names those of committed tasks only, so a task that is run again leaves an unread file and no double record. The reader
keeps one chunk of compressed bytes and one record in memory.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import hot_keys, join_spread, scratch, written

CHUNK = 1 << 16


class WarcError(ValueError):
    """An archive is cut short, framed wrongly or does not match its digests."""


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI of any kind that pyarrow knows: file, hdfs, s3, gs."""
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else f"file://{uri[5:]}")


def opened(uri: str, mode: str):
    """A binary stream; for writing, folders are made."""
    where, path = located(uri)
    if mode == "w":
        where.create_dir(path.rpartition("/")[0], recursive=True)
        return where.open_output_stream(path, compression=None)
    return where.open_input_stream(path, compression=None)


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def records(stream, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record, checking framing and block digests."""
    rest = stream.read(chunk)
    while rest:
        unpack, out = zlib.decompressobj(31), bytearray()
        head, need = None, None
        while not unpack.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise WarcError("the archive ends within a record")
            try:
                out += unpack.decompress(rest)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from None
            rest = unpack.unused_data
            if head is None and (at := out.find(b"\r\n\r\n")) >= 0:
                first, *lines = bytes(out[:at]).decode().split("\r\n")
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                if not first.startswith("WARC/") or not head.get("content-length", "").isdigit():
                    raise WarcError("no WARC record")
                need, out = int(head["content-length"]), out[at + 4 :]
        if head is None or len(out) != need + 4 or out[need:] != b"\r\n\r\n":
            raise WarcError("the content length does not frame the record")
        block = bytes(out[:need])
        if (want := head.get("warc-block-digest")) and want != f"sha1:{digest(block)}":
            raise WarcError("the block digest differs")
        yield head, block
        rest = rest or stream.read(chunk)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_from: int = 0) -> DataFrame:
    """Writes a record per row and returns the table (path, n_records) of the archives.

    Of rows with equal payloads of at least revisit_from bytes, that with the largest id is a response and the others are
    revisits of it. Null bodies are empty. Rows that repeat the largest id are responses too; a null id counts as least.
    Null urls are written as empty targets. An empty table gives no archive. Other columns do not matter, whatever their names.

    Who revisits whom is found on digests and ids alone, and the rows of a frequent digest are dealt over many tasks. Rows meet
    their verdicts by digest, id and url, so the copies of one payload are dealt as well.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("body", "utf-8"))).withColumn("at", F.xxhash64("url"))
    thin = written(rows.where(F.octet_length("body") >= revisit_from).select("sha1", "id", "at"), "digests")
    groups = written(thin.groupBy("sha1").agg(F.max("id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null"), "copies")
    hot = hot_keys(groups, "sha1", thin.count())
    revisits = join_spread(thin, groups.select("sha1", "first_id"), "sha1", hot, F.xxhash64("id", "at")).where(~F.col("id").eqNullSafe(F.col("first_id"))).distinct()
    revisits = revisits.select(F.col("sha1").alias("r_sha1"), F.col("id").alias("r_id"), F.col("at").alias("r_at"), "first_id")
    rows = rows.join(revisits, (F.col("sha1") == F.col("r_sha1")) & F.col("id").eqNullSafe(F.col("r_id")) & (F.col("at") == F.col("r_at")), "left")
    refers = F.col("first_id")
    folder = scratch(pages.sparkSession, "warc")

    def put(batches):
        path, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        out = None
        for batch in (part for whole in batches for part in tk.slices(whole, "body")):
            for page, url, body, refers_to in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "body", "refers_to")), strict=True):
                out = out or opened(path, "w")
                payload = body.encode()
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                block = http if refers_to is not None else http + payload
                kind = "revisit" if refers_to is not None else "response"
                head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join((url or "").split())),
                        ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
                        ("X-Payload-Length", str(len(payload))), ("X-Row-ID", "" if page is None else str(page))]
                if refers_to is not None:
                    head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Row-ID", str(refers_to))]
                out.write(member(head, block))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})

    made = rows.select("id", "url", "body", refers.alias("refers_to")).mapInArrow(put, "path string, n_records long")
    return written(made, "warc-index")


def read(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives at column path: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Digests of blocks and of responses' payloads are verified; a mismatch or a cut archive raises WarcError. payload is
    null unless asked for, and for revisits.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def take(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with opened(path, "r") as stream:
                    for head, block in records(stream):
                        kind, payload = head["warc-type"], block.partition(b"\r\n\r\n")[2]
                        said = head["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (digest(payload) != said or len(payload) != int(head["x-payload-length"])):
                            raise WarcError(f"{path}: the payload differs from its digest or length")
                        keep = payload if with_payload and kind == "response" else None
                        rows.append((int(head["x-row-id"]) if head["x-row-id"] else None, head["warc-target-uri"], int(head["x-payload-length"]), said, kind, int(x) if (x := head.get("x-refers-to-row-id")) else None, keep))
                        held += len(keep or b"")
                        if len(rows) >= 4096 or held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # an archive a task
    dealt = archives.select("path").repartition(max(1, archives.count()), "path")
    return dealt.mapInArrow(take, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
