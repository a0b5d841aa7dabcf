"""Shared tables, block tables and the packed exchange that several operators use.

Block table: documents packed into rows of a few MB. Python tasks then work on whole blocks with
numpy, and what blocks must tell each other goes through `exchange`: each block sends one packed
binary message per hash bucket, a reducer answers every message, and `attach` brings the answers
back to the blocks. Keys that a block repeats are merged in the block, so that a hot key reaches its
bucket once per block, and never as one row per document.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text in a block. A longer document is a block of its own.
BLOCK_BYTES = 2 << 20
#: Bytes in an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: An estimate from here on means that Spark knows nothing of a plan's size.
UNKNOWN_BYTES = 1 << 57
#: Spark's own limit for the buckets of a table.
MOST_BUCKETS = 100_000
#: Compressed input bytes for each bucket of a block table.
BUCKET_BYTES = 16 << 20

_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share; one is made only where a local session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="perambula-"))
    return _own_root[0]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def _forget(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES, which bounds what a Python worker gets at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the driver ends."""
    path = f"{shared_root(spark)}/perambula/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again, which cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a plan's size, which for file scans is that of the files; 0 if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def of_worker(key: tuple, make: Callable):
    """What this Python worker made under the key in an earlier task, or makes now. Holds bounded things only."""
    import sys

    kept = sys.__dict__.setdefault("_perambula_worker", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


# Blocks --------------------------------------------------------------------------------------

BLOCK = T.StructType(
    [
        T.StructField("block_id", T.LongType(), False),
        T.StructField("ids", T.BinaryType(), False),  # int64
        T.StructField("no_id", T.BinaryType(), False),  # a byte each: 1 if the id is null
        T.StructField("digests", T.BinaryType(), False),  # 16 bytes each
        T.StructField("ends", T.BinaryType(), False),  # int64, of each text in data
        T.StructField("data", T.BinaryType(), False),
    ]
)


def block_schema(carried: T.DataType | None) -> T.StructType:
    """With `carried`, an array of what the documents carry along, in its own type."""
    return T.StructType([*BLOCK.fields, T.StructField("carried", T.ArrayType(carried))]) if carried else BLOCK


#: What a null id counts as: later than any other.
LAST = np.iinfo(np.int64).max


def spark_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    """The bucket that Spark gives a long: Murmur3 of its halves with seed 42, modulo n."""
    u = lambda x: np.uint32(x)
    turn = lambda x, k: (x << u(k)) | (x >> u(32 - k))
    raw = ids.astype(np.int64).view(np.uint64)
    h = np.full(len(ids), 42, np.uint32)
    for half in ((raw & np.uint64(0xFFFFFFFF)).astype(np.uint32), (raw >> np.uint64(32)).astype(np.uint32)):
        h = turn(h ^ (turn(half * u(0xCC9E2D51), 15) * u(0x1B873593)), 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32) % n


def ids_in_one_bucket(task: int, n: int) -> Iterator[int]:
    """Block ids of a task that all fall into one bucket, so that the task writes one file."""
    at = task << 36
    while True:
        ids = np.arange(at, at + 8192)
        yield from ids[spark_bucket(ids, n) == task % n].tolist()
        at += 8192


def build_blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (id, text, and perhaps carried) rows; what is carried stays in Arrow's form."""
    import xxhash

    schema = [("block_id", pa.int64()), ("ids", pa.binary()), ("no_id", pa.binary()), ("digests", pa.binary()), ("ends", pa.binary()), ("data", pa.binary())]
    names = ids_in_one_bucket(TaskContext.get().partitionId(), n)
    rows: list = []
    parts: list[pa.Array] = []
    size = 0

    def block() -> pa.RecordBatch:
        texts = [x[1] for x in rows]
        row = {
            "block_id": next(names),
            "ids": np.array([LAST if x[0] is None else x[0] for x in rows], np.int64).tobytes(),
            "no_id": bytes(x[0] is None for x in rows),
            "digests": b"".join(xxhash.xxh3_128_digest(t) for t in texts),
            "ends": np.cumsum([len(t) for t in texts], dtype=np.int64).tobytes(),
            "data": b"".join(texts),
        }
        columns = [pa.array([row[name]], kind) for name, kind in schema]
        if parts:
            columns.append(pa.ListArray.from_arrays([0, len(rows)], pa.concat_arrays(parts)))
        return pa.RecordBatch.from_arrays(columns, [name for name, _ in schema] + ["carried"] * bool(parts))

    for batch in batches:
        carried = batch.column(2) if batch.num_columns > 2 else None
        begin = 0
        for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True)):
            t = t.as_py() or b""
            if rows and size + len(t) > BLOCK_BYTES:
                if carried is not None and k > begin:
                    parts.append(carried.slice(begin, k - begin))
                yield block()
                rows, parts, size, begin = [], [], 0, k
            rows.append((i, t))
            size += len(t)
        if carried is not None and batch.num_rows > begin:
            parts.append(carried.slice(begin))
    if rows:
        yield block()
    give_back()


class Blocks:
    """A block table in the shared folder, bucketed by block_id so that answers join it unshuffled."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None):
        self.spark = spark = docs.sparkSession
        bound_batches(spark)
        carried = [F.struct(*[docs[c] for c in carry]).alias("c")] if carry else []
        rows = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t"), *carried)
        self.carried = rows.schema["c"].dataType if carry else None
        self.n = min(MOST_BUCKETS, max(shuffle_partitions(spark), input_bytes(docs) // BUCKET_BYTES))
        self.buckets = 4 * self.n
        self.name = f"perambula_blocks_{uuid.uuid4().hex}"
        atexit.register(_forget, spark, self.name)
        n = self.n
        (
            rows.mapInArrow(lambda batches: build_blocks(batches, n), block_schema(self.carried))
            .write.format("parquet")
            .option("path", new_path(spark, "blocks"))
            .option("compression", "zstd")
            .bucketBy(self.n, "block_id")
            .saveAsTable(self.name)
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def attach(self, **answers: DataFrame) -> DataFrame:
        """The blocks with one array column of (bucket, payload) structs for each exchange."""
        df = self.table()
        for name, rows in answers.items():
            found = rows.repartition(self.n, "block_id").groupBy("block_id").agg(F.collect_list(F.struct("bucket", "payload")).alias(name))
            df = df.join(found, "block_id", "left")
        return df

    def exchange(self, requests: DataFrame, reduce: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
        """Answers every (bucket, block_id, payload) message; reduce sees all payloads of a bucket."""

        def run(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("block_id").to_numpy(), kind="stable")
            table = table.take(pa.array(order))
            out = reduce([x.as_py() for x in table.column("payload")])
            give_back()
            return pa.table({"bucket": table.column("bucket"), "block_id": table.column("block_id"), "payload": pa.array(out, pa.binary())})

        return requests.repartition(self.n, "bucket").groupBy("bucket").applyInArrow(run, MESSAGE)


MESSAGE = T.StructType(
    [
        T.StructField("bucket", T.IntegerType(), False),
        T.StructField("block_id", T.LongType(), False),
        T.StructField("payload", T.BinaryType(), False),
    ]
)
MESSAGE_ARROW = pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("payload", pa.binary())])


def messages(block_id: int, payloads: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    got = list(payloads)
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in got], pa.int32()), pa.array([block_id] * len(got), pa.int64()), pa.array([p for _, p in got], pa.binary())],
        schema=MESSAGE_ARROW,
    )


class Block:
    """One row of a block table, in the task."""

    def __init__(self, row: dict):
        self.id = row["block_id"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.no_id = np.frombuffer(row["no_id"], np.uint8).astype(bool)
        self.digests = row["digests"]
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.starts = np.concatenate([np.zeros(1, np.int64), self.ends[:-1]]) if len(self.ends) else self.ends
        self.data = row.get("data")
        self.carried = row.get("carried")

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]

    def __len__(self) -> int:
        return len(self.ids)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row, so that at most one block's Python objects live at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            cells = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            yield {name: x.values if name == "carried" else x.as_py() for name, x in cells.items()}
    give_back()


def give_back() -> None:
    """Returns a worker's free memory to the system: the worker outlives its task."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def answers_of(row: dict, name: str) -> dict[int, bytes]:
    return {x["bucket"]: x["payload"] for x in row.get(name) or ()}


# First holders of equal texts ----------------------------------------------------------------

DIGEST = np.dtype([("d", "V16"), ("id", "<i8")])


def _digest_keys(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's distinct digests as pairs of uint64, and the number of each document's digest."""
    pairs = np.frombuffer(block.digests, np.uint64).reshape(-1, 2)
    keys, of = np.unique(pairs, axis=0, return_inverse=True)
    return keys, of.reshape(-1), np.minimum.reduceat(block.ids[np.argsort(of.reshape(-1), kind="stable")], np.searchsorted(np.sort(of.reshape(-1)), np.arange(len(keys)))) if len(keys) else block.ids


def first_holders(blocks: Blocks) -> DataFrame:
    """Answers with the smallest id that holds each distinct text of a block."""
    n = blocks.buckets

    def ask(batches):
        for row in rows_of(batches):
            keys, _, least = _digest_keys(Block(row))
            bucket = bucket_of(keys[:, 0], n)
            yield messages(row["block_id"], ((int(b), keys[bucket == b].tobytes() + least[bucket == b].tobytes()) for b in np.unique(bucket)))

    def reduce(payloads):
        counts = [len(p) // 24 for p in payloads]
        keys = np.concatenate([np.frombuffer(p, np.uint64, 2 * c).reshape(-1, 2) for p, c in zip(payloads, counts, strict=True)])
        ids = np.concatenate([np.frombuffer(p, np.int64, c, 16 * c) for p, c in zip(payloads, counts, strict=True)])
        _, of = np.unique(keys, axis=0, return_inverse=True)
        of = of.reshape(-1)
        least = np.full(of.max() + 1, LAST)
        np.minimum.at(least, of, ids)
        return [x.tobytes() for x in np.split(least[of], np.cumsum(counts)[:-1])]

    asked = blocks.table().select("block_id", "ids", "no_id", "digests", "ends").mapInArrow(ask, MESSAGE)
    return write_table(blocks.exchange(asked, reduce), "holders")


def first_ids(block: Block, answers: dict[int, bytes], n: int) -> np.ndarray:
    """For each document, the smallest id in the corpus with the same text."""
    keys, of, _ = _digest_keys(block)
    bucket = bucket_of(keys[:, 0], n)
    least = np.empty(len(keys), np.int64)
    for b in np.unique(bucket):
        least[bucket == b] = np.frombuffer(answers[int(b)], np.int64)
    return least[of]


# Hashing -------------------------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def stir(x: np.ndarray) -> np.ndarray:
    """A lighter mix, for hashes that are sums of random numbers already."""
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def runs(least: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of windows with the same anchor, each within one document.

    least: the anchor of the window at each place; starts and ends: of the documents, each with a window.
    """
    inside = np.ones(len(least), bool)
    for e in ends.tolist():
        inside[e - window + 1 : e] = False
    mark = np.empty(len(least), bool)
    mark[:1] = True
    np.not_equal(least[1:], least[:-1], out=mark[1:])
    mark[starts] = True
    first = np.flatnonzero(mark & inside)
    stops = np.append(np.flatnonzero(mark | ~inside), len(least))
    return first, stops[np.searchsorted(stops, first, side="right")] - first


class Rolling:
    """Hashes of all windows of any width over a sequence of uint64 symbols, modulo 2**64."""

    def __init__(self, symbols: np.ndarray, base: int = BASE):
        self.n = len(symbols)
        self.base = base
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(symbols * powers(base, self.n), out=self.sums[1:])

    def windows(self, width: int, finish=mix) -> np.ndarray:
        if self.n < width:
            return np.zeros(0, np.uint64)
        inverse = INVERSE if self.base == BASE else pow(self.base, -1, 1 << 64)
        found = self.sums[width:] - self.sums[:-width]
        found *= powers(inverse, self.n - width + 1)
        return finish(found)


def window_min(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    span = 1
    while span * 2 <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[:n], a[width - span : width - span + n])


def window_argmin(a: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each run of width values, and where it stands first."""
    n = len(a) - width + 1
    if n <= 0:
        return a[:0], np.zeros(0, np.int64)

    def least(one, other):
        smaller = other[0] < one[0]
        return np.where(smaller, other[0], one[0]), np.where(smaller, other[1], one[1])

    at, span = np.arange(len(a)), 1
    while span * 2 <= width:
        a, at = least((a[:-span], at[:-span]), (a[span:], at[span:]))
        span *= 2
    return least((a[:n], at[:n]), (a[width - span : width - span + n], at[width - span : width - span + n]))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """By the upper half of a hash; the lower half is then free to be a short key."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def split_by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of a sorted bucket column."""
    if len(bucket):
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
            yield int(bucket[a]), slice(int(a), int(b))


# Recurring anchors ---------------------------------------------------------------------------


def ask_anchors(block_id: int, anchors: np.ndarray, docs: np.ndarray, n: int) -> pa.RecordBatch:
    """Messages with the low halves of a block's anchors: those in one document, then those in more."""
    keys, many = distinct_anchors(anchors, docs)
    bucket = bucket_of(keys, n)
    low = keys.astype(np.uint32)

    def payloads():
        for b, at in split_by_bucket(bucket):
            one, more = low[at][~many[at]], low[at][many[at]]
            yield b, np.uint32(len(one)).tobytes() + one.tobytes() + more.tobytes()

    return messages(block_id, payloads())


def distinct_anchors(anchors: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct anchors, and whether more than one document of the block has each."""
    order = np.argsort(anchors)
    a, d = anchors[order], docs[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = a[1:] != a[:-1]
    starts = np.flatnonzero(fresh)
    change = np.zeros(len(a), bool)  # in any order, some neighbours differ if not all are the same
    change[1:] = (d[1:] != d[:-1]) & ~fresh[1:]
    many = np.add.reduceat(change, starts) > 0 if len(a) else fresh
    return a[starts], many


def reduce_anchors(payloads: list[bytes]) -> list[bytes]:
    """For each anchor of one document in its block, a bit: does another block have it?"""
    ones = [np.frombuffer(p, np.uint32, int(np.frombuffer(p, np.uint32, 1)[0]), 4) for p in payloads]
    mores = [np.frombuffer(p, np.uint32, -1, 4 + 4 * len(o)) for p, o in zip(payloads, ones, strict=True)]
    everything = np.sort(np.concatenate(ones + mores))
    twice = np.unique(everything[1:][everything[1:] == everything[:-1]])
    if not len(twice):
        return [np.packbits(np.zeros(len(o), bool)).tobytes() for o in ones]

    def bits(o: np.ndarray) -> bytes:
        at = np.minimum(np.searchsorted(twice, o), len(twice) - 1)
        return np.packbits(twice[at] == o).tobytes()

    return [bits(o) for o in ones]


def recurring_anchors(anchors: np.ndarray, docs: np.ndarray, answers: dict[int, bytes], n: int) -> np.ndarray:
    """The sorted anchors of a block that more than one document has."""
    keys, many = distinct_anchors(anchors, docs)
    bucket = bucket_of(keys, n)
    found = many.copy()
    for b, at in split_by_bucket(bucket):
        one = np.flatnonzero(~many[at]) + at.start
        if len(one):
            found[one] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(one)).astype(bool)
    return keys[found]


def is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values
