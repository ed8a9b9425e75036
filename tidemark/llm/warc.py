"""WARC archives of pages, and a salvage reader.

The writer makes gzip-per-record files in a folder that all machines share; identical payloads are stored once, by the page with the
largest id, and revisited by the others. The reader checks each record (gzip CRC, header, length, payload digest). After a failed check it
searches for the next gzip member that opens with a version line, or the next version line, goes on there and logs the gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, cut, discard, fresh_path, pick

#: Bytes at which a file is closed, level of compression, and the most bytes that a gzip member may hold.
ROLL_BYTES, LEVEL, MAX_MEMBER = 32 << 20, 1, 1 << 30
#: The format's lines.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record, not compressed. A revisit has the HTTP head alone as its block."""
    block = HTTP + (payload if refers_to is None else b"")
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub('[\\x00-\\x20\\x7f]', lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Damaged(ValueError):
    pass


def _number(value: str) -> int | None:
    return int(value) if re.fullmatch(r"-?[0-9]+", value) else None


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts there, and where it ends."""
    if data[at : at + 7] != b"WARC/1.":
        raise Damaged("version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise Damaged("header")
    fields = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            raise Damaged("header")
        fields[k.decode("latin-1").lower()] = v.strip().decode("utf-8", "replace")
    if not all(f in fields for f in REQUIRED):
        raise Damaged("header")
    n = fields.get("content-length", "")
    if not n.isdigit():
        raise Damaged("length")
    body = data[head + 4 : head + 4 + int(n)]
    end = head + 4 + int(n) + 4
    if len(body) < int(n) or data[end - 4 : end] != b"\r\n\r\n":
        raise Damaged("length")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + digest(body):
        raise Damaged("block digest")
    kind = fields.get("warc-type", "")
    payload = body.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else body
    told = fields.get("warc-payload-digest", "sha1:").removeprefix("sha1:")
    if kind == "response" and told and told != digest(payload):
        raise Damaged("payload digest")
    size = len(payload) if kind == "response" else _number(fields.get("payload-length", ""))
    page = lambda f: _number(fields.get(f, "").removeprefix("<urn:page:").removesuffix(">"))
    return {"record_type": kind, "page_id": page("warc-record-id"), "refers_to": page("warc-refers-to"), "url": fields.get("warc-target-uri"), "payload_digest": told or None, "payload_bytes": size, "payload": payload if kind == "response" else None}, end


def _inflated(data: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member that starts there, and where it ends."""
    d, out, pos, size = zlib.decompressobj(31), [], at, 0
    try:
        while not d.eof:
            piece = data[pos : pos + 65536]
            if not len(piece):
                raise Damaged("gzip end")
            out.append(d.decompress(piece))
            pos, size = pos + len(piece), size + len(out[-1])
            if size > MAX_MEMBER:
                raise Damaged("member size")
    except zlib.error:
        raise Damaged("gzip") from None
    return b"".join(out), pos - len(d.unused_data)


def _opens(data: memoryview, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 512], 7) == b"WARC/1."
    except zlib.error:
        return False


def salvage(data: bytes) -> Iterator[dict]:
    """Records (with offset and length) and gaps (offset, length and the reason) of an archive, in its order; every byte is in one of them."""
    view, at, gap, why = memoryview(data), 0, None, None
    while at < len(data):
        try:
            if data[at : at + 3] == GZIP:
                raw, end = _inflated(view, at)
                rec, used = parse(raw)
                if used != len(raw):
                    raise Damaged("member")
            else:
                rec, end = parse(data, at)
        except Damaged as x:
            if gap is None:
                gap, why = at, str(x)
            at += 1
            while at < len(data):
                zip_at, line_at = data.find(GZIP, at), data.find(b"WARC/1.", at)
                at = min([p for p in (zip_at, line_at) if p >= 0], default=len(data))
                if at == len(data) or at == line_at or _opens(view, at):
                    break
                at += 1
            continue
        if gap is not None:
            yield {"gap": why, "offset": gap, "length": at - gap}
            gap = None
        yield rec | {"offset": at, "length": end - at}
        at = end
    if gap is not None:
        yield {"gap": why, "offset": gap, "length": len(data) - gap}


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """(path, records, bytes) of the files that hold the pages: columns page_id, url, html, refers_to. Run it once, by `cut`.

    A file's name has its task's attempt in it; those of failed or repeated attempts are in no manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        made, out, count, size = [], None, 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made.append((path, count, size))
                out = None

        for b in batches:
            for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    path, count, size = f"{root}/pages-{t.partitionId():06d}-{t.taskAttemptId()}-{len(made):04d}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                data = member(record(page_id, url, (html or "").encode(), refers_to))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ROLL_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return bounded(pages.select("page_id", "url", "html", "refers_to")).mapInArrow(run, "path string, records bigint, bytes bigint")


OUT = [("path", "string", pa.string()), ("gap", "string", pa.string()), ("offset", "bigint", pa.int64()), ("length", "bigint", pa.int64()), ("page_id", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_digest", "string", pa.string()), ("record_type", "string", pa.string()), ("refers_to", "bigint", pa.int64())]


def read_archives(paths: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """Every record and every gap of the files of a manifest. A file is held in memory whole; writers roll them at ROLL_BYTES."""
    fields = [*OUT, *([("url", "string", pa.string()), ("payload", "binary", pa.binary())] if keep_payload else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else pafs.LocalFileSystem()
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as f:
                    data = f.read()
                rows, held = [], 0
                for x in salvage(data):
                    payload = x.pop("payload", None)
                    rows.append(x | {"path": path} | ({"payload": payload} if keep_payload else {}))
                    held += len(payload or b"")
                    if len(rows) >= 5000 or keep_payload and held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, _, k in fields], names=[f[0] for f in fields])
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, _, k in fields], names=[f[0] for f in fields])

    return paths.select("path").mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in fields))


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, and in refers_to the largest page_id with an equal payload where that is larger than the row's own.

    Only digests that occur again are joined; the pages themselves move where those don't fit Spark's broadcast limit.
    """
    rows = pick(pages, key, url, html).select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    again = cut(rows.select("page_id", sha.alias("sha")).groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("sha", "top"), "again")
    return rows.withColumn("sha", sha).join(again, "sha", "left").select("page_id", "url", "html", F.when(F.col("page_id") < F.col("top"), F.col("top")).alias("refers_to"))


def quarantine(found: DataFrame) -> DataFrame:
    """(path, offset, length, reason) of the byte gaps that the reader passed over."""
    return found.where("gap is not null").select("path", "offset", "length", F.col("gap").alias("reason"))


def reconciled(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, records, read, gaps) of the files that gave other records than were written, or had gaps."""
    got = found.groupBy("path").agg(F.count_if(F.col("gap").isNull()).alias("read"), F.count("gap").alias("gaps"))
    both = manifest.select("path", "records").join(got, "path", "left").select("path", "records", F.coalesce("read", F.lit(0)).alias("read"), F.coalesce("gaps", F.lit(0)).alias("gaps"))
    return both.where("records <> read or gaps > 0")


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives it was written to.

    Null and empty html are empty payloads. Of equal payloads the row with the largest page_id is the response, all rows with that id
    where it repeats; a row without page_id is a response. An empty table gives no rows. What was read is held against the manifest: a
    gap or a missing record is an error here, where no byte may be lost, and the error names the table of quarantined gaps.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    manifest = cut(write_archives(with_revisits(pages, key, url, html), folder), "manifest")
    spread = manifest.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
    found = cut(read_archives(spread, folder), "records")
    wrong = reconciled(manifest, found).limit(5).collect()
    if wrong:
        log = cut(quarantine(found), "quarantine")
        raise RuntimeError(f"{len(wrong)} files or more differ from their manifest, such as {wrong[0].path}; gaps are listed in {log._written}")
    discard(manifest)
    return found.where("gap is null").select(F.col("page_id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
