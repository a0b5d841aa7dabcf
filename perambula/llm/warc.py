"""WARC archives as a chunked record table.

A record is a run of rows (record_id, chunk_no, data, end, digest): its WARC header block is chunk 0, then
come payload chunks of bounded size, and the last row closes it. `digest` is the SHA-1 of the payload up to
and with that chunk, so a reader can check, and stop or resume, at any chunk. A row is never larger than
CHUNK_BYTES, however long the record is; the rows' data in order are a valid WARC file.

Written with Spark's Parquet writer, whose commit protocol survives lost executors, and sorted by record
within a file. The reader sorts each record's rows together and checks them as a stream.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perambula.llm.common import bound_batches, new_path, write_table

CHUNK_BYTES = 1 << 18
#: Payloads of fewer bytes are always stored in full.
MIN_REVISIT_BYTES = 1000
#: Decisions that are broadcast at most, rows of two ids and a digest: some 16 MB.
BROADCAST_ROWS = 200_000

CHUNKS = T.StructType(
    [
        T.StructField("record_id", T.LongType(), False),
        T.StructField("chunk_no", T.LongType(), False),
        T.StructField("data", T.BinaryType(), False),
        T.StructField("end", T.LongType(), False),
        T.StructField("digest", T.StringType(), False),
        T.StructField("last", T.BooleanType(), False),
    ]
)
CHUNKS_ARROW = pa.schema([("record_id", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("end", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())])
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType(), False),
        T.StructField("payload_digest", T.StringType(), False),
        T.StructField("record_type", T.StringType(), False),
        T.StructField("refers_to", T.LongType()),
    ]
)
RECORDS_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's for URLs


def _record_uuid(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    return " ".join(value.split())


def header(page_id: int | None, url: str | None, n: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The header block of one record; a revisit carries no payload, and names the record that has it."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_uuid(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_uuid(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else n}", "", ""]
    return "\r\n".join(lines).encode()


def chunks_of(record_id: int, head: bytes, payload: memoryview, size: int = CHUNK_BYTES) -> Iterator[tuple]:
    """The rows of one record, one at a time."""
    running = hashlib.sha1()
    n = len(payload)
    yield (record_id, 0, head, 0, running.hexdigest(), False)
    k = 1
    for at in range(0, n, size):
        part = payload[at : at + size]
        running.update(part)
        yield (record_id, k, bytes(part), at + len(part), running.hexdigest(), False)
        k += 1
    yield (record_id, k, b"\r\n\r\n", n, running.hexdigest(), True)


def decide(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, html, digest, keeper): keeper is the largest page_id of a payload that several have.

    Hot payloads meet in a partial aggregate; of the join only payloads with copies take part.
    """
    sizes = write_table(pages.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest")), "digests")
    shared = sizes.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    held = sizes.join(shared, "digest").where("page_id < keeper or page_id is null").select("page_id", "digest", "keeper").distinct()
    held = held.select(F.col("page_id").alias("held_id"), F.col("digest").alias("held_digest"), "keeper")
    held = write_table(held, "held")
    if held.count() <= BROADCAST_ROWS:  # else payloads are shuffled to their decisions
        held = F.broadcast(held)
    digest = F.sha1(F.col("html").cast("binary"))
    rows = pages.select("page_id", "url", "html", digest.alias("digest"))
    return rows.join(held, rows["page_id"].eqNullSafe(held["held_id"]) & (rows["digest"] == held["held_digest"]), "left").select("page_id", "url", "html", "digest", "keeper")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Writes one WARC record per row of pages, in chunk rows.

    Null html is an empty payload. A null page_id is written without its id, and is never the response that
    others refer to. Rows that repeat a page_id and payload have no larger page_id, and are responses. Only
    the three named columns are read, whatever else there is. An empty table gives no record.
    """
    bound_batches(pages.sparkSession)
    src = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    decided = decide(src, min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        record, rows, held = TaskContext.get().partitionId() << 36, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CHUNKS_ARROW, strict=True)], schema=CHUNKS_ARROW)

        for batch in batches:
            bodies = batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                page_id, url, digest, keeper = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4))
                payload = memoryview(bodies[i].as_buffer())
                head = header(page_id, url, len(payload), digest, keeper, keeper is not None)
                for row in chunks_of(record, head, payload if keeper is None else payload[:0], chunk_bytes):
                    rows.append(row)
                    held += len(row[2])
                    if held > 4 * chunk_bytes or len(rows) >= 4096:
                        yield flush()
                        rows, held = [], 0
                record += 1
        if rows:
            yield flush()

    decided.mapInArrow(run, CHUNKS).write.option("compression", "zstd").parquet(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) for x in lines[1:] if x)


def read_archives(chunks: DataFrame) -> DataFrame:
    """Per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to; the digests are checked.

    The rows of a record come one after another, and no more than a chunk of it is held. A missing or
    damaged chunk raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, running, fields, n, expect, out = None, None, {}, 0, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                rid, k, data, end, digest, last = (batch.column(c)[i] for c in range(6))
                rid, k = rid.as_py(), k.as_py()
                if rid != record or k == 0:
                    if record is not None:
                        raise ValueError(f"record {record} has no end")
                    if k != 0:
                        raise ValueError(f"record {rid} has no header")
                    record, running, fields, n, expect = rid, hashlib.sha1(), _fields(data.as_py()), 0, 0
                elif not last.as_py():
                    part = memoryview(data.as_buffer())
                    running.update(part)
                    n += len(part)
                if k != expect or end.as_py() != n or running.hexdigest() != digest.as_py():
                    raise ValueError(f"record {rid} is damaged at chunk {k}")
                expect += 1
                if last.as_py():
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if n != int(fields["Content-Length"]) or kind == "response" and said != running.hexdigest():
                        raise ValueError(f"record {rid} does not hold what its header says")
                    ref, page = fields.get("X-Refers-To-Page"), fields.get("X-Page-ID")
                    out.append((int(page) if page else None, fields.get("WARC-Target-URI"), int(fields["X-Payload-Length"]), said, kind, int(ref) if ref else None))
                    record = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RECORDS_ARROW, strict=True)], schema=RECORDS_ARROW)
                out = []
        if record is not None:
            raise ValueError(f"record {record} has no end")

    ordered = chunks.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return ordered.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, **named) -> DataFrame:
    """Writes the archives into the shared folder and reads them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, **named)
    return read_archives(spark.read.schema(CHUNKS).parquet(path))


def warc_bytes(rows: list) -> bytes:
    """The WARC file that chunk rows in order make up."""
    return b"".join(bytes(r["data"]) for r in sorted(rows, key=lambda r: (r["record_id"], r["chunk_no"])))


__all__ = ["chunks_of", "read_archives", "round_trip", "warc_bytes", "write_archives"]
