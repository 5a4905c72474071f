"""WARC archives of pages, written with an index first and read back by coalesced byte ranges.

Every record is a gzip member of its own. The index has a row per record: file, offset, length, URL, digest and kind; it is written
as Parquet, and only files named there count, so files of lost or repeated tasks are never read. Reading sorts the selected index
rows by file and offset and fetches neighbouring records with one read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import join_lookup, table
from evalloom.session import cut_lineage, run_dir

LEAST_PAYLOAD = 100  # bytes from which equal payloads become revisits
FILE_BYTES = 1 << 28  # a file is closed when it has grown beyond this
READ_BYTES = 1 << 23  # of one coalesced read
READ_GAP = 1 << 16  # bytes between two wanted records that are read over
DATE = "1970-01-01T00:00:00Z"  # the pages have no capture time
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, "
    "record_type string, refers_to long"
)
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_record_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``; revisits carry no payload.

    Of equal payloads of at least ``LEAST_PAYLOAD`` bytes the one with the smallest id is the response; the others refer to it. A
    repeated row of that id is a response as well, since a record cannot revisit itself; a null id comes after all others.
    """
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")
    ).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    eligible = F.when(F.col("payload_bytes") >= LEAST_PAYLOAD, F.col("payload_digest"))
    narrow = rows.select("page_id", eligible.alias("_copy")).where("_copy is not null")
    # one row per payload that occurs more than once
    firsts = cut_lineage(
        narrow.groupBy("_copy").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    )
    joined = join_lookup(rows.withColumn("_copy", eligible), firsts, "_copy", F.struct("page_id", "url"), how="left")
    later = F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("_first")))
    return joined.select(
        "page_id", "url", F.when(later, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "payload_bytes",
        "payload_digest", F.when(later, "revisit").otherwise("response").alias("record_type"),
        F.when(later, F.col("_first")).alias("refers_to"),
    )


def header_url(url: str | None) -> str | None:
    """The URL as a header can hold it."""
    return None if url is None else quote(url, safe="".join(map(chr, range(33, 127))).replace("%", ""))


def record_bytes(page_id, url, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member. Ids travel as extension fields; null fields are left out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{digest}|{url}")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", header_url(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", size),
        ("X-Page-ID", page_id),
        ("X-Refers-To-Page-ID", refers_to),
        ("WARC-Profile", REVISIT_PROFILE if kind == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    header = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return gzip.compress(header.encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (the body after the HTTP header) of one gzip member."""
    raw = zlib.decompress(member, wbits=31)
    header, _, rest = raw.partition(b"\r\n\r\n")
    lines = header.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of :func:`with_record_types` as ``*.warc.gz`` files under ``folder``; the index, read from Parquet.

    A file name has a part that is new for every attempt of a task, so attempts never write into each other's files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(f"{base}/archives", recursive=True)
        stream, name, at = None, None, 0
        for batch in batches:
            index = []
            for page_id, url, payload, size, digest, kind, refers_to in zip(*batch.columns):
                values = page_id.as_py(), url.as_py(), payload.as_py(), size.as_py(), digest.as_py(), kind.as_py()
                member = record_bytes(*values, refers_to.as_py())
                if stream is None or at >= file_bytes:
                    if stream is not None:
                        stream.close()
                    name, at = f"archives/{uuid.uuid4().hex}.warc.gz", 0
                    stream = system.open_output_stream(f"{base}/{name}", compression=None)
                stream.write(member)
                index.append((values[0], values[1], name, at, len(member), digest.as_py(), values[3], values[5], refers_to.as_py()))
                at += len(member)
            columns = list(zip(*index)) if index else [[]] * 9
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
                ))],
                ["page_id", "url", "file", "offset", "length", "payload_digest", "payload_bytes", "record_type", "refers_to"],
            )
        if stream is not None:
            stream.close()

    path = f"{folder}/index"
    records.mapInArrow(run, INDEX).write.parquet(path)
    return records.sparkSession.read.schema(INDEX).parquet(path)


def read_records(index: DataFrame, folder: str, wanted: Column | None = None, payloads: bool = True,
                 read_bytes: int = READ_BYTES, read_gap: int = READ_GAP) -> DataFrame:
    """The records of the index rows that ``wanted`` selects, from the archives: ``RECORD`` and, if asked for, ``payload``.

    Index rows of a stretch of ``read_bytes`` of a file meet in a task, in file order; records less than ``read_gap`` apart are
    fetched by one read. Id, URL, digest, size, type and reference of the index row are compared with the record's header, and a response's
    digest and length with its payload; a difference is an error.
    """
    chosen = index if wanted is None else index.where(wanted)
    ranges = (
        chosen.select("file", "offset", "length", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
        .withColumn("stretch", F.floor(F.col("offset") / read_bytes))
        .repartition("file", "stretch")
        .sortWithinPartitions("file", "offset")
        .drop("stretch")
    )
    names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * payloads
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def fetch(system, base: str, group: list[tuple]) -> pa.RecordBatch:
        name, start = group[0][:2]
        stop = max(row[1] + row[2] for row in group)
        with system.open_input_file(f"{base}/{name}") as source:
            data = source.read_at(stop - start, start)
        rows = []
        for _, offset, length, *listed in group:
            fields, payload = parse_record(data[offset - start : offset - start + length])
            digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
            kind = fields["WARC-Type"]
            if kind == "response":
                found = hashlib.sha256(payload).hexdigest()
                if (found, len(payload)) != (digest, size):
                    raise ValueError(f"{name} at {offset}: the payload is not the one that was written")
                digest, size = found, len(payload)
            page, other = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
            record = (
                None if page is None else int(page), fields.get("WARC-Target-URI"), size, digest, kind,
                None if other is None else int(other),
            )
            if record != (listed[0], header_url(listed[1]), *listed[2:]):
                raise ValueError(f"{name} at {offset}: the record is not the one of the index")
            rows.append((*record, *([payload] if payloads else [])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                name, offset, length = row[:3]
                if group:
                    first, last = group[0], group[-1]
                    near = offset - (last[1] + last[2]) <= read_gap and offset + length - first[1] <= read_bytes
                    if name != first[0] or not near:
                        yield fetch(system, base, group)
                        group = []
                group.append(row)
        if group:
            yield fetch(system, base, group)

    return ranges.mapInArrow(run, RECORD + ", payload binary" * payloads)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark itself resolves it: a path without one may lie in the cluster's own file system."""
    if "://" in folder:
        return folder
    spark.range(1).write.parquet(f"{folder}/probe")
    return spark.read.parquet(f"{folder}/probe").inputFiles()[0].rpartition("/probe/")[0]


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                  payloads: bool = False) -> DataFrame:
    """Write a record per page into the shared folder and read all of them back: ``RECORD`` per page.

    One row per input row. A null html is an empty payload, a null URL or id stays null, a URL is returned percent-encoded where a
    header cannot hold it. An empty table writes an empty index and gives no row. Only the three named columns are read.
    """
    folder = qualified(pages.sparkSession, run_dir(pages.sparkSession, "warc"))
    index = write_archives(with_record_types(pages, page_id, url, html), folder)
    return read_records(index, folder, payloads=payloads)


SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
sized AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM payloads),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM sized)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM firsts
"""


def op1_warc(spark, sf_dir):
    records = archive_pages(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
