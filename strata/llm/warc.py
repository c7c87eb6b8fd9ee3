"""WARC archives: write, index, and read selected records back by coalesced byte ranges.

Every writing task makes one archive of gzip members, one record each, in the
shared folder, and returns an index row per record: archive, offset, length, URL
and digest. Only the written index names archives, so files of a failed or
repeated attempt are never read. Reading starts from the index: chosen rows are
range-sorted by (archive, offset), and each task merges neighbouring ranges into
larger reads.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import HOT, fresh_path, materialize, parts, small_batches

#: Payloads shorter than this are never stored as revisits.
LEAST_SHARED = 100
#: Ranges this close are read together, up to this many bytes.
GAP, READ = 1 << 16, 4 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def filesystem(uri: str):  # noqa: ANN201
    """A file system and path for a URI (file:, hdfs:, s3:, ...)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI of the file system that Spark itself would take it for, so that driver and executors agree."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def member(data: bytes) -> bytes:
    """One gzip member."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, lead_url: str | None, place: str) -> bytes:
    """A response record (an HTTP message around the payload), or a revisit of another record with the same payload. Its id
    is a hash of its ``place`` (archive and offset), so records of repeated pages have ids of their own."""
    kind = "response" if refers_to is None else "revisit"
    block = b"" if refers_to is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Bytes: {len(payload)}"]
    if refers_to is not None:
        head += [f"X-Refers-To-Page: {refers_to}", f"WARC-Refers-To-Date: {DATE}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if lead_url:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(lead_url)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length does not match its header")
    return fields, rest[:size]


def with_revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, lead_url): refers_to is the smallest page with an equal payload of at
    least ``least`` bytes, null for that page itself and for payloads that occur once or are shorter.

    Shared digests are counted by an aggregate without payloads. Short payloads and those of hot digests, HOT at most,
    learn their leader by broadcast where they are read; only the other ones are shuffled by digest."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "long": F.octet_length("payload") >= least})
    found = rows.where("long").groupBy("digest").agg(F.min("page_id").alias("lead"), F.min_by("url", F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("lead_url"), F.count("*").alias("n"))
    shared = materialize(found.where("n > 1 and lead is not null"), "shared-payloads")
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot, cold = shared.where(F.col("n") * HOT > total).drop("n"), shared.where(F.col("n") * HOT <= total).drop("n")
    near = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left").where("hot or not long").drop("hot")
    far = rows.where("long").join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest", "left")
    other = F.col("long") & F.col("lead").isNotNull() & ~F.col("lead").eqNullSafe(F.col("page_id"))
    return near.unionByName(far).select("page_id", "url", "payload", "digest", F.when(other, F.col("lead")).alias("refers_to"), F.when(other, F.col("lead_url")).alias("lead_url"))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_SHARED) -> DataFrame:
    """Write a record for each row of (page_id, url, html); returns the index, itself a written table.

    A null html is an empty payload, a null url leaves the header out. Repeated
    rows are records of their own; where they hold the smallest id of their
    payload all of them are responses. Empty table: no archive, an empty index.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or fresh_path(spark, "warc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, at, name = TaskContext.get().partitionId(), None, 0, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, refers_to, lead_url in zip(*batch.columns, strict=True):
                    page_id, url, digest, refers_to, lead_url = page_id.as_py(), url.as_py(), digest.as_py(), refers_to.as_py(), lead_url.as_py()
                    if out is None:
                        store, path = filesystem(folder)
                        store.create_dir(path, recursive=True)
                        name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                        info = b"software: strata\r\nformat: WARC File Format 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        at = out.write(member(head.encode() + info + b"\r\n\r\n"))
                    data = member(record(page_id, url, payload.as_py(), digest, refers_to, lead_url, f"{folder}/{name}#{at}"))
                    out.write(data)
                    rows.append((f"{folder}/{name}", at, len(data), page_id, url, digest, "response" if refers_to is None else "revisit", refers_to))
                    at += len(data)
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return materialize(small_batches(with_revisits(pages, least)).mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """The records that rows of an index name: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload).

    Of responses, payload, size and digest are what the archive holds (a digest
    that differs from the header's raises); of revisits they are the header's,
    and payload is null.
    """
    spark = index.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = ("", None)
        for batch in batches:
            rows = []
            archives, offsets, sizes, urls = (c.to_pylist() for c in batch.columns)
            k = 0
            while k < len(archives):
                last, end = k, offsets[k] + sizes[k]
                while last + 1 < len(archives) and archives[last + 1] == archives[k] and offsets[last + 1] <= end + GAP and offsets[last + 1] + sizes[last + 1] - offsets[k] <= READ:
                    last += 1
                    end = max(end, offsets[last] + sizes[last])
                if opened[0] != archives[k]:
                    if opened[1] is not None:
                        opened[1].close()
                    store, path = filesystem(archives[k])
                    opened = (archives[k], store.open_input_file(path))
                data = opened[1].read_at(end - offsets[k], offsets[k])
                for j in range(k, last + 1):
                    a = offsets[j] - offsets[k]
                    rows.append((urls[j], *_told(zlib.decompress(data[a : a + sizes[j]], 31))))
                k = last + 1
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["url", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
            got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
            yield got.select([x.split()[0] for x in _RECORDS.split(", ")])
        if opened[1] is not None:
            opened[1].close()

    chosen = index.select("archive", "offset", "length", "url")
    near = chosen.repartitionByRange(max(8, parts(spark)), "archive", "offset").sortWithinPartitions("archive", "offset")
    return near.mapInArrow(run, _RECORDS)


def _told(data: bytes) -> tuple:
    fields, block = parse(data)
    page, lead = fields.get("x-page-id"), fields.get("x-refers-to-page")
    page_id, digest, size = None if page is None else int(page), fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-bytes"])
    if fields["warc-type"] == "revisit":
        return page_id, "revisit", int(lead), size, digest, None
    payload = block.partition(b"\r\n\r\n")[2]
    found = hashlib.sha256(payload).hexdigest()
    if found != digest or len(payload) != size:
        raise ValueError(f"the payload of page {page_id} is not what was written")
    return page_id, "response", None, len(payload), found, payload
