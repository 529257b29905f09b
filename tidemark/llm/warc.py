"""WARC archives: a deduplicating writer and a sequential reader.

Writer: one gzip member per record, archives of bounded size in a folder that all
executors share. Reader: walks an archive member by member with incremental zlib
decompression, cuts the record by its Content-Length and checks its digest; it holds
one record at a time.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import fresh, ship, shuffle_partitions, table, written

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_SCHEMA = "file string, position long, record_id string, record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary, digest_ok boolean"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


# ---- records

def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """An uncompressed record: a response, or a revisit of the page `first`. The block of
    a revisit is the HTTP head alone; its headers carry the full payload's digest and length."""
    block = HTTP_HEAD if first is not None else HTTP_HEAD + payload
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if first is None else "revisit"),
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{url}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + quote(url or "", safe="!#$%&'()*+,/:;=?@[]-._~"),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {first}"]
    return "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Members:
    """The gzip members of a stream, one after the other, each as chunks of plain bytes."""

    def __init__(self, stream, chunk: int = 1 << 16):
        self.stream, self.chunk, self.rest, self.position = stream, chunk, b"", 0

    def __iter__(self) -> Iterator[tuple[int, Iterator[bytes]]]:
        while self.rest or self._more():
            start, inside = self.position, self._member()
            yield start, inside
            for _ in inside:  # what the caller left
                pass

    def _more(self) -> bool:
        self.rest = self.stream.read(self.chunk)
        return bool(self.rest)

    def _member(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self.rest and not self._more():
                raise ValueError(f"the archive ends inside the member at byte {self.position}")
            data, self.rest = self.rest, b""
            plain = z.decompress(data, self.chunk)
            while True:
                if plain:
                    yield plain
                if z.eof or not z.unconsumed_tail:
                    break
                plain = z.decompress(z.unconsumed_tail, self.chunk)
            self.rest = z.unused_data if z.eof else b""
            self.position += len(data) - len(self.rest)


def read_record(chunks: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and the block, framed by Content-Length."""
    held = bytearray()
    while (end := held.find(b"\r\n\r\n")) < 0:
        if not (more := next(chunks, b"")):
            raise ValueError("a record without the end of its head")
        held += more
    lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length, start = int(headers["content-length"]), end + 4
    while len(held) < start + length + 4:
        if not (more := next(chunks, b"")):
            break
        held += more
    if len(held) < start + length:
        raise ValueError(f"a block of {len(held) - start} bytes; Content-Length says {length}")
    if bytes(held[start + length :]) != b"\r\n\r\n":
        raise ValueError("no end of record after Content-Length bytes")
    return headers, bytes(held[start : start + length])


def read_archive(stream) -> Iterator[dict]:
    """The records of an archive in order; digest_ok tells whether the block's digest, and
    for responses also the payload's, are what the headers say."""
    for position, chunks in Members(stream):
        h, block = read_record(chunks)
        payload = block.partition(b"\r\n\r\n")[2]
        ok = "warc-block-digest" not in h or h["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        response = h["warc-type"] == "response"
        digest = hashlib.sha256(payload).hexdigest() if response else None
        said = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
        yield {
            "position": position, "record_id": h.get("warc-record-id"), "record_type": h["warc-type"], "page_id": int(h["x-page-id"]) if "x-page-id" in h else None,
            "target_uri": h.get("warc-target-uri"), "payload_bytes": len(payload) if response else int(h.get("x-payload-length", 0)), "payload_digest": digest if response else said,
            "refers_to": int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None, "payload": payload if response else None, "digest_ok": ok and (not response or said in (None, digest)),
        }


# ---- Spark

def _write(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        done, out, size, count = [], None, 0, 0

        def close():
            nonlocal out
            out.close()
            name = f"{root}/part-{ctx.partitionId():05d}-{len(done):05d}.warc.gz"
            fs.move(temp, name)  # a retried task writes the same file again
            done.append((name, count, size))
            out = None

        for b in batches:
            for page, url, html, digest, first in zip(*(b.column(i) for i in range(5))):
                if out is None:
                    temp = f"{root}/_{ctx.partitionId()}-{ctx.taskAttemptId()}-{len(done)}"
                    out, size, count = fs.open_output_stream(temp, compression=None), 0, 0
                data = gzip_member(record_bytes(page.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), first.as_py()))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= roll_bytes:
                    close()
        if out is not None:
            close()
        if done:
            files, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "records", "bytes"])

    return run


def _read(root: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(root)
        names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORD_SCHEMA.split(", ")])
        for b in batches:
            for file in b.column(0).to_pylist():
                held, size = [], 0
                with fs.open_input_stream(file, compression=None) as stream:
                    for r in read_archive(stream):
                        size += len(r["payload"] or b"") + 300
                        if not payloads:
                            r["payload"] = None
                        held.append(r | {"file": file})
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)
        assert names == schema.names

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 100, roll_bytes: int = 64 << 20, hot_rows: int = 1000) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html; other columns are
    ignored) and returns a row per archive: file, records, bytes.

    The payload is the html in UTF-8, a null counting as empty. Of the records with
    equal payloads of at least min_bytes, those with the smallest page_id are responses,
    all others revisits that name that page; smaller payloads are always responses. If a
    page_id is repeated with the same payload and is the smallest, each such row is a
    response. A null page_id never is the smallest; a group of nulls only is all
    responses. An empty table writes no archive. A payload of any length is one record.

    Payloads of more than hot_rows rows and 1/5,000 of all, 5,000 at most, are told to every
    task; their pages are then dealt out by themselves, not with their payload.
    """
    spark = pages.sparkSession
    ship(spark)
    html = F.coalesce(F.col("html"), F.lit(""))
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    firsts = pages.select(F.col("page_id").cast("long").alias("page_id"), html.alias("html")).where(F.octet_length("html") >= min_bytes).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = written(firsts, "warc-firsts")
    hot = F.col("n") > max(hot_rows, pages.count() // 5000)
    told = told.join(F.broadcast(firsts.where(hot).select("digest", F.col("first").alias("hot_first"), F.lit(True).alias("hot"))), "digest", "left")
    key = F.when(F.col("hot"), F.concat(F.col("digest"), F.lit(":"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("digest"))
    rows = told.withColumn("key", key).join(firsts.where(~hot).select(F.col("digest").alias("key"), F.col("first").alias("cold_first")), "key", "left")
    rows = rows.withColumn("first", F.coalesce("hot_first", "cold_first")).select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))
    return written(rows.mapInArrow(_write(folder, roll_bytes), "file string, records long, bytes long"), "warc-manifest")


def read_archives(files: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """The records (RECORD_SCHEMA) of the archives named in files.file, a task for each
    archive; root: a URI in their file system. A record whose digest is wrong has
    digest_ok false; a broken archive raises."""
    spark = files.sparkSession
    ship(spark)
    n = max(1, min(files.count(), 100_000))
    return files.select("file").repartition(max(n, shuffle_partitions(spark)), "file").mapInArrow(_read(root, payloads), RECORD_SCHEMA)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a record per page, reads the archives back, reports what was read."""
    folder = fresh(spark, "warc")
    files = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(files, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
     g AS (SELECT d, min(page_id) AS f FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY d)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.f IS NULL OR g.f = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.f <> p.page_id THEN g.f END AS refers_to, TRUE AS digest_ok
FROM p LEFT JOIN g ON p.d = g.d
"""
