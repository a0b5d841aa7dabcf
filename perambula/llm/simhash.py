"""SimHash near-dedup with multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints at 3 or fewer differing bits
differ by at most one bit in one of the segments, so every distinct fingerprint enters its own two segment
values into the tables and visits the ball of radius one around each (33 values a segment). A table entry
and its visitors meet in the bucket of the segment's value; the whole distance is then verified. A bucket
returns a spanning forest of its links and never its pairs, and the forests are joined by components().

Equal fingerprints are merged before (partial aggregate), so copies cost one row. Visits are packed in
binary messages of 12 bytes a visit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perambula.llm.common import bound_batches, input_bytes, mix, shuffle_partitions, split_by_bucket, write_table
from perambula.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints in a message's chunk, and groups larger than this are cut by a further segment.
CHUNK = 1 << 14
LARGE = 1 << 13

FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType(), False)])
FINGERPRINTS_ARROW = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
VISITS = T.StructType([T.StructField("bucket", T.IntegerType(), False), T.StructField("payload", T.BinaryType(), False)])
VISITS_ARROW = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
EDGES = T.StructType([T.StructField("u", T.LongType(), False), T.StructField("v", T.LongType(), False)])


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of one text as an unsigned number; 0 if it has no word."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and space and \t to \r only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    counts = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    ends = ends[shingle - 1 :].tolist()
    for at in range(0, n, 1 << 18):  # bounds the memory for long texts
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 18)], ends[at : at + (1 << 18)])], np.uint64)  # noqa: B905
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            out = []
            for t in batch.column(1).cast(pa.binary()):
                b = t.as_py() or b""
                if b not in seen:
                    seen[b] = fingerprint(b, shingle, seed)
                out.append(seen[b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], schema=FINGERPRINTS_ARROW)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, FINGERPRINTS)


_BALL = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(32, dtype=np.uint64)])


def segment(fps: np.ndarray, table: int) -> np.ndarray:
    return (fps >> np.uint64(32)) if table == 0 else (fps & np.uint64(0xFFFFFFFF))


def _table_bucket(values: np.ndarray, table: int, n: int) -> np.ndarray:
    return (mix(values + np.uint64((table + 1) << 40)) % np.uint64(n)).astype(np.int64) * 2 + table


def _connect(fps: np.ndarray, exact: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of links within radius that have at least one exact member: breadth first, every member leaves the rest once reached."""
    edges: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= radius
            if not exact[x]:
                near &= exact[left]
            if near.any():
                reached = left[near]
                edges += [(int(fps[x]), int(fps[y])) for y in reached]
                frontier += reached.tolist()
                left = left[~near]
    return edges


def link_group(fps: np.ndarray, exact: np.ndarray, other: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links in a group that shares one segment; a large group is cut by the halves of the other segment.

    There, too, one half of 16 bits differs by at most one bit; a group with three quarters in common has
    at most 2**16 fingerprints.
    """
    if len(fps) <= LARGE:
        return _connect(fps, exact, radius)
    edges = []
    rest = segment(fps, other)
    for shift in (0, 16):
        quarter = (rest >> np.uint64(shift)) & np.uint64(0xFFFF)
        keys = (quarter[:, None] ^ _BALL[None, :17]).reshape(-1)
        of = np.repeat(np.arange(len(fps)), 17)
        order = np.argsort(keys, kind="stable")
        keys, of = keys[order], of[order]
        for a, b in zip([0, *(cuts := np.flatnonzero(np.diff(keys)) + 1)], [*cuts, len(keys)], strict=True):
            own = of[a:b]
            at_home = quarter[own] == keys[a]
            if at_home.any() and b - a > 1:
                # a link needs one end at home in the quarter and one in the segment, perhaps not the same
                edges += _connect_two(fps[own], exact[own], at_home, radius)
    return edges


def _connect_two(fps: np.ndarray, exact: np.ndarray, home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    edges: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = (np.bitwise_count(fps[left] ^ fps[x]) <= radius) & (exact[left] | exact[x]) & (home[left] | home[x])
            if near.any():
                reached = left[near]
                edges += [(int(fps[x]), int(fps[y])) for y in reached]
                frontier += reached.tolist()
                left = left[~near]
    return edges


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints (fp) within RADIUS, as a forest for each bucket."""
    spark = distinct.sparkSession
    parts = max(shuffle_partitions(spark), input_bytes(distinct) * 66 // (32 << 20))
    n = 2 * parts

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(fps), CHUNK):
                chunk = fps[at : at + CHUNK]
                rows = []
                for table in (0, 1):
                    values = (segment(chunk, table)[:, None] ^ _BALL[None, :]).reshape(-1)
                    whole = np.repeat(chunk, len(_BALL))
                    bucket = _table_bucket(values, table, n)
                    order = np.argsort(bucket, kind="stable")
                    values, whole, bucket = values[order].astype(np.uint32), whole[order], bucket[order]
                    rows += [(b, values[s].tobytes() + whole[s].tobytes()) for b, s in split_by_bucket(bucket)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=VISITS_ARROW)

    def verify(found: pa.Table) -> pa.Table:
        table = found.column("bucket")[0].as_py() % 2
        payloads = [x.as_py() for x in found.column("payload")]
        values = np.concatenate([np.frombuffer(p, np.uint32, len(p) // 12) for p in payloads]).astype(np.uint64)
        fps = np.concatenate([np.frombuffer(p, np.uint64, len(p) // 12, len(p) // 12 * 4) for p in payloads])
        order = np.lexsort((fps, values))
        values, fps = values[order], fps[order]
        exact = segment(fps, table) == values
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        sizes = np.diff(np.append(starts, len(values)))
        wanted = (np.logical_or.reduceat(exact, starts)) & (sizes > 1)
        edges: list[tuple[int, int]] = []
        for a, size in zip(starts[wanted].tolist(), sizes[wanted].tolist(), strict=True):
            edges += link_group(fps[a : a + size], exact[a : a + size], 1 - table)
        pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    visits = distinct.select("fp").mapInArrow(visit, VISITS)
    return visits.repartition(parts, "bucket").groupBy("bucket").applyInArrow(verify, EDGES)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, fp (signed), component_id (smallest doc_id reachable by links, itself included), root.

    root names the component: where an id has several texts, components may share a component_id.
    Null and empty texts have fingerprint 0 and link like any other. A null doc_id takes part, but is
    nobody's component_id; a component of null ids alone has a null one. Repeated rows are kept. Only the two
    named columns are read, whatever else there is. An empty table gives no row.
    """
    bound_batches(docs.sparkSession)
    rows = write_table(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    distinct = write_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = components(links(distinct))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = write_table(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = rooted.join(least, "root").select("fp", "component_id", "root")
    return rows.join(members, "fp").select("doc_id", "fp", "component_id", "root")
