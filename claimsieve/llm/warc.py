"""WARC archives, index first.

Each task writes one archive of gzip members, one per record, and returns the index rows of its records (file, offset,
length, URL, digest).  The index is a table; reading starts from any selection of its rows.  Selected rows of a file are
sorted by offset, and neighbours whose gap is small are read as one byte range of bounded size, so a full read is a
sequence of large reads and a sparse one touches only its records.

Payloads that are equal (SHA-1 and length) are stored once, in the record with the smallest ``page_id``; the others are
revisit records that name it.  Payloads shorter than ``min_bytes`` are always stored.

Defined results: null html is an empty payload, a null URL is an empty target; rows that repeat the smallest ``page_id``
of equal payloads are all stored; null ids come last, so they refer to an id if there is one; extra columns are ignored;
an empty table gives empty results.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from claimsieve.llm.files import AtomicFile, open_store, read_range
from claimsieve.llm.words import bounded_batches, encoded
from claimsieve.session import materialize, scratch_path

GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
TASK_BYTES = 64 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record_bytes(page_id: object, url: str, payload: bytes, digest: str, refers_to: object, revisit: bool) -> bytes:
    """One WARC/1.1 record, compressed as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_urn(refers_to)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(member: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict((k.lower(), v) for k, _, v in (x.partition(": ") for x in lines[1:]))
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"version": lines[0], "fields": fields, "payload": payload, "payload_bytes": length}


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write all pages and return the written index:
    ``page_id, url, file, offset, length, payload_digest, record_type, refers_to``."""
    bounded_batches(pages.sparkSession)
    id_type = pages.schema["page_id"].dataType
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("html").cast("string").alias("html"), F.sha1(body).alias("_sha"), F.octet_length(body).alias("_size"))
    # equal payloads, summed up before the shuffle; only those that occur more than once are looked up
    first = rows.filter(F.col("_size") >= min_bytes).groupBy("_sha", "_size").agg(F.count("*").alias("_n"), F.min("page_id").alias("_first")).filter("_n > 1").drop("_n")
    marked = rows.join(first, ["_sha", "_size"], "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    planned = marked.select("page_id", "url", "html", F.when(again, F.col("_first")).alias("refers_to"), again.alias("revisit"))
    names = ["page_id", "url", "file", "offset", "length", "payload_digest", "record_type", "refers_to"]
    schema = T.StructType([
        T.StructField("page_id", id_type), T.StructField("url", T.StringType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", id_type),
    ])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or AtomicFile(name)
            ids, urls, refs, seen = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            offsets, lengths, digests = [], [], []
            for i, url, payload, ref, revisit in zip(ids, urls, encoded(batch.column(2)), refs, seen):
                digests.append(base32_sha1(payload))
                data = record_bytes(i, url, payload, digests[-1], ref, revisit)
                offsets.append(out.write(data))
                lengths.append(len(data))
            kinds = ["revisit" if x else "response" for x in seen]
            columns = [batch.column(0), batch.column(1), pa.array([name] * len(ids)), pa.array(offsets), pa.array(lengths), pa.array(digests), pa.array(kinds), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names)
        if out:
            out.close()

    return materialize(planned.mapInArrow(write, schema), "warc-index")


def byte_ranges(index: DataFrame, gap: int = GAP_BYTES, size: int = RANGE_BYTES) -> DataFrame:
    """``file, start, end, records`` of coalesced ranges: rows sorted by offset within a file, split where the gap to the
    row before exceeds ``gap`` or a new stretch of ``size`` bytes begins."""
    by_file = W.partitionBy("file").orderBy("offset")
    stretch = F.floor(F.col("offset") / size)
    new = F.coalesce((F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by_file) > gap) | (stretch != F.lag(stretch).over(by_file)), F.lit(True))
    numbered = index.withColumn("_new", new.cast("long")).withColumn("_range", F.sum("_new").over(by_file))
    grouped = numbered.groupBy("file", "_range").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length", "page_id", "refers_to"))).alias("records")
    )
    return grouped.select("file", "start", "end", "records")


def read_records(spark: SparkSession, index: DataFrame, gap: int = GAP_BYTES, size: int = RANGE_BYTES, payload: bool = False) -> DataFrame:
    """Read the records of the selected index rows from the archives: ``page_id, url, payload_bytes, payload_digest,
    record_type, refers_to`` and, if asked for, the stored ``payload``.  Identity is checked against the record's own
    fields; a record that isn't the one indexed is an error."""
    id_type = index.schema["page_id"].dataType
    fields = [("page_id", id_type), ("url", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", id_type)]
    fields += [("payload", T.BinaryType())] if payload else []
    schema = T.StructType([T.StructField(k, t) for k, t in fields])
    # the index is small beside the records, so tasks are dealt by the bytes that they will read
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    ranges = byte_ranges(index, gap, size).repartition(tasks, F.xxhash64("file", "start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("records").type.value_type.field("page_id").type
            for i in range(batch.num_rows):
                file, start, end, records = (batch.column(k)[i].as_py() for k in range(4))
                store, path = open_store(file)
                with store.open_input_file(path) as handle:
                    raw = read_range(handle, start, end - start)
                columns: list[list] = [[] for _ in schema.names]
                for r in records:
                    got = parse_record(raw[r["offset"] - start : r["offset"] - start + r["length"]])
                    head = got["fields"]
                    if head["warc-record-id"] != record_urn(r["page_id"]):
                        raise ValueError(f"the record at {r['offset']} of {file} isn't the one that the index names")
                    revisit = head["warc-type"] == "revisit"
                    if revisit and head["warc-refers-to"] != record_urn(r["refers_to"]):
                        raise ValueError(f"the record at {r['offset']} of {file} refers to another record")
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and base32_sha1(got["payload"]) != digest:
                        raise ValueError(f"the record at {r['offset']} of {file} is damaged")
                    row = [r["page_id"], head["warc-target-uri"], got["payload_bytes"], digest, head["warc-type"], r["refers_to"] if revisit else None, got["payload"]]
                    for column, value in zip(columns, row):
                        column.append(value)
                types = [kind, pa.string(), pa.int64(), pa.string(), pa.string(), kind, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

    return ranges.mapInArrow(read, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page to archives in the shared folder and read all records back through the index."""
    spark = pages.sparkSession
    return read_records(spark, write_archives(pages, scratch_path(spark, "warc"), min_bytes))
