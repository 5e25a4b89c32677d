"""WARC archives: a writer with revisit records and a splittable reader (operator 8).

Writing: every record is a gzip member of its own; each task writes one archive into a folder that
driver and executors share, under a temporary name that is renamed when complete, so a task that runs again
leaves one file. Of the records with equal payloads the one with the largest page_id is a response and
the others revisit it, payloads shorter than ``least`` bytes are responses all.

Reading: files are cut into byte ranges and dealt to tasks. A task looks for the gzip magic, takes a place for a
member only if its header decodes to the beginning of a WARC record, and owns the records whose members
start inside its range; the last of them may reach beyond the end, and a task whose range holds no start returns
nothing. After a member the search goes on behind it, so magic bytes within compressed data mislead nobody.

Paths go through pyarrow's file systems (file, hdfs, s3, gs by the URI's scheme), as executors cannot
reach Spark's own from Python. The registered query writes below spark.checkpoint.dir.

Edge cases. Null html is an empty payload, a null url is left out of the header, a null page_id is an empty
identifier and reads back as null; CR and LF in a url are escaped. Rows that are the same in page_id and payload and
hold the largest page_id are responses all. Empty tables write no records and read back as no rows. Extra columns
of pages are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_on_exit, shared_dir, spool, table

LEAST_BYTES, SPLIT_BYTES, DATE, LEVEL = 0, 4 << 20, "1970-01-01T00:00:00Z", 4
MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space for URLs


def record_id(page_id: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record as a gzip member; ``refers_to`` makes it a revisit."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = page_id or ""
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(own, digest),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-Id": own,
        "X-Payload-Bytes": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
    }
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="".join(map(chr, range(33, 127))).replace("%", ""))
    block = HTTP % len(payload)
    if refers_to is None:
        block += payload
    else:
        head |= {"WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-Id": refers_to, "WARC-Profile": PROFILE}
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> dict:
    """Header fields of a decoded record, with its payload under ``payload`` (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    out = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines if ": " in line)} | {"version": version}
    block = rest[: int(out["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    out["payload"] = None if out["warc-type"] == "revisit" else payload
    return out


def with_types(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id string, url, html, refers_to string): which earlier-found response a record revisits."""
    found = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "digest", F.unhex(F.sha1(F.encode("html", "UTF-8")))
    )
    groups = spool(
        found.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
        .where("n > 1").drop("n")
    )
    refers = F.when(F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), F.col("head").cast("string"))
    return found.join(groups, "digest", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "html", refers.alias("refers_to"))


def write(typed: DataFrame, folder: str) -> DataFrame:
    """Write with_types() rows as ``folder``/part-*.warc.gz; returns (file, records, bytes)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        name = f"{folder.rstrip('/')}/part-{context.partitionId():06d}.warc.gz"
        store, path = fs.FileSystem.from_uri(name)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        draft, records, size = f"{path}.{uuid.uuid4().hex}.draft", 0, 0
        with store.open_output_stream(draft, compression=None) as out:
            for frame in frames:
                for page_id, url, html, refers_to in zip(*(frame[c] for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    data = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)
                    out.write(data)
                    records, size = records + 1, size + len(data)
        store.move(draft, path)
        yield pd.DataFrame({"file": [name], "records": [records], "bytes": [size]})

    return typed.select("page_id", "url", "html", "refers_to").mapInPandas(run, "file string, records long, bytes long")


class Window:
    """A file read piece by piece; holds the bytes from ``start`` on and forgets what is behind."""

    def __init__(self, source, start: int, step: int = 1 << 18):
        self.source, self.step, self.start, self.data, self.ended = source, step, start, b"", False
        source.seek(start)

    def more(self) -> bool:
        part = b"" if self.ended else self.source.read(self.step)
        self.ended = not part
        self.data += part
        return bool(part)

    def forget(self, at: int) -> None:
        self.data, self.start = self.data[at - self.start :], at


def members(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the WARC members of an open file that start in [start, end)."""
    window = Window(source, start)
    at = start
    while at < end:
        found = window.data.find(MAGIC, at - window.start)
        if found < 0:
            # the last two bytes may begin the magic
            at = max(at, window.start + len(window.data) - len(MAGIC) + 1)
            window.forget(min(at, window.start + len(window.data)))
            if not window.more():
                return
            continue
        at = window.start + found
        if at >= end:
            return
        window.forget(at)
        packed, parts, used = zlib.decompressobj(31), [], 0
        try:
            while not packed.eof:
                if used >= len(window.data) and not window.more():
                    break
                parts.append(packed.decompress(window.data[used:]))
                used = len(window.data)
                begun = b"".join(parts[:2])[:5] if len(parts) <= 2 else b"WARC/"
                if begun and not b"WARC/".startswith(begun) and not begun.startswith(b"WARC/"):
                    raise zlib.error("not a WARC record")
        except zlib.error:
            at += 1
            continue
        data = b"".join(parts)
        if not packed.eof or not data.startswith(b"WARC/"):
            at += 1
            continue
        yield at, data
        at = window.start + used - len(packed.unused_data)


def ranges(spark: SparkSession, files: list[tuple[str, int]], split: int) -> DataFrame:
    """(file, start, end) of all byte ranges, dealt to tasks."""
    listed = spark.createDataFrame(files or [("", 0)], "file string, bytes long")
    starts = listed.where("bytes > 0").select(
        "file", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split))).alias("start")
    )
    cut = starts.select("file", "start", F.least(F.col("start") + split, "bytes").alias("end"))
    return cut.repartition(max(1, sum(-(-size // split) for _, size in files)), "file", "start")


def read(spark: SparkSession, folder: str, split: int = SPLIT_BYTES) -> DataFrame:
    """Every record of ``folder``/*.warc.gz: file, offset, record_type, page_id, url, payload_bytes,
    payload_digest, refers_to, payload. The digest of a response is worked out from its payload."""
    store, path = fs.FileSystem.from_uri(folder)
    listed = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    prefix = folder.rstrip("/")
    files = sorted((f"{prefix}/{i.base_name}", i.size) for i in listed if i.base_name.endswith(".warc.gz"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "offset", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for frame in frames:
            for file, start, end in zip(frame["file"], frame["start"], frame["end"], strict=True):
                where, inner = fs.FileSystem.from_uri(file)
                out = []
                with where.open_input_file(inner) as source:
                    for offset, data in members(source, int(start), int(end)):
                        r = parse(data)
                        payload = r["payload"]
                        digest = r["warc-payload-digest"].removeprefix("sha1:")
                        size = int(r["x-payload-bytes"])
                        if payload is not None:
                            digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        uri = r.get("warc-target-uri")
                        out.append((file, offset, r["warc-type"], r["x-page-id"] or None, uri and unquote(uri), size, digest, r.get("x-refers-to-page-id"), payload))
                        if len(out) >= 256:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                yield pd.DataFrame(out, columns=names)

    return ranges(spark, files, split).mapInPandas(
        run,
        "file string, offset long, record_type string, page_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary",
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives, then read the archives back."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    delete_on_exit(spark, folder)
    write(with_types(pages), folder).agg(F.sum("records")).first()
    return read(spark, folder).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


QUERIES = {"op8_warc": op8_warc}
