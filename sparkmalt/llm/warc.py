"""WARC archives with an index, and reads of chosen records by byte range.

``write`` makes one gzip member per record, as the format recommends, and an
index with file, offset, length, URL and digest of each; ``read`` takes index
rows, sorts them by file and offset, joins near ranges into one read, and
parses the records. Archives and index live in the shared folder; a task that
runs again writes files of its own, and the index names those of the run that
succeeded.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmalt.llm.store import fresh

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
SMALLEST = 100  # payloads of fewer bytes are never revisits
END = b"\r\n\r\n"
INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long"
RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One record; a revisit (``first``: the page it repeats) has the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """WARC fields, length that the HTTP head states, and payload of one record."""
    head, _, rest = raw.partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(END)
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, stated, payload


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; the names that Hadoop has for object stores are known, too."""
    scheme, sep, rest = path.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "gs": "gs"}.get(scheme, scheme) + sep + rest)


def page_of(uri: str) -> int | None:
    number = uri.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def with_repeats(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Adds digest and ``first``: the smallest page id with the same payload where that is another page's, else null."""
    keyed = pages.select("*", F.sha2(F.coalesce(F.col(html), F.lit("")), 256).alias("__digest"))
    ids = keyed.where(F.octet_length(html) >= SMALLEST).select(F.col(key).alias("__page"), "__digest")
    firsts = ids.groupBy("__digest").agg(F.min("__page").alias("__first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = ids.join(firsts, "__digest").where("__page > __first").distinct()
    return keyed.join(repeats.withColumnRenamed("__digest", "__same"), (F.col(key) == F.col("__page")) & (F.col("__digest") == F.col("__same")), "left").drop("__page", "__same")


def write(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", path: str | None = None, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row under ``path`` and returns the index, itself written there as Parquet.

    A null html is an empty payload, a null url leaves the field out, a row with
    a null page id is a response. Repeated rows of a response are responses; an
    empty table gives an empty index. Extra columns are left out.
    """
    spark = pages.sparkSession
    path = path or fresh(spark, "warc")
    files, root = store_of(path)
    files.create_dir(f"{root}/archives", recursive=True)
    rows = with_repeats(pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")), "page_id", "html")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store_of(path)
        out, name, at, index = None, "", 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{root}/archives/{name}", compression=None)
                payload = (row["html"] or "").encode()
                packer = zlib.compressobj(3, wbits=31)
                raw = packer.compress(record(row["page_id"], row["url"], payload, row["__digest"], row["__first"], date)) + packer.flush()
                out.write(raw)
                index.append((name, at, len(raw), row["url"], row["__digest"], "response" if row["__first"] is None else "revisit", row["page_id"]))
                at += len(raw)
        if out is not None:
            out.close()  # before the index names it
        for a in range(0, len(index), 10_000):
            part = index[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))], names=["file", "offset", "length", "url", "digest", "record_type", "page_id"])

    rows.select("page_id", "url", "html", "__digest", "__first").mapInArrow(archive, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index").withColumn("root", F.lit(path))


def runs(rows: list[dict], gap: int, most: int) -> Iterator[list[dict]]:
    """Sorted index rows in runs that one read covers: the same file, gaps of at most ``gap`` bytes, ``most`` bytes in all."""
    run: list[dict] = []
    for row in rows:
        if run and (row["file"] != run[0]["file"] or row["offset"] - (run[-1]["offset"] + run[-1]["length"]) > gap or row["offset"] + row["length"] - run[0]["offset"] > most):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read(index: DataFrame, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """The records that the rows of ``index`` point at; of revisits, length and digest come from the record's fields."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, tuple] = {}
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            for run in runs(batch.to_pylist(), gap, most):
                name = f"{run[0]['root']}/archives/{run[0]['file']}"
                if name not in files:
                    files.clear()
                    store, root = store_of(name)
                    files[name] = store.open_input_file(root)
                start = run[0]["offset"]
                data = files[name].read_at(run[-1]["offset"] + run[-1]["length"] - start, start)
                out = []
                for row in run:
                    fields, stated, payload = parse(zlib.decompress(data[row["offset"] - start : row["offset"] - start + row["length"]], wbits=31))
                    kind, first = fields["WARC-Type"], fields.get("WARC-Refers-To")
                    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    out.append((page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, payload, len(payload) if kind == "response" else stated, digest, first and page_of(first)))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=[f.split()[0] for f in RECORD.split(", ")])

    # a task gets whole stretches of files; neighbours in a file stay neighbours
    stretch = F.floor(F.col("offset") / most)
    return index.withColumn("stretch", stretch).repartition("root", "file", "stretch").sortWithinPartitions("root", "file", "offset").drop("stretch").mapInArrow(fetch, RECORD)
