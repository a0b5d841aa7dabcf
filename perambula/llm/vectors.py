"""Embedding near-dedup: every pair of a label, in blocks, with cells that bound what is compared.

Equal vectors of a label are merged first and counted with their multiplicity. A label of at most ONE_SHARD
distinct vectors is compared whole. A larger one is cut into cells: each vector is at home with its nearest
pivot, and pivots are vectors of a bounded sample. Of two linked vectors with different homes p and q, either
lies within the threshold's angle of the great sphere midway between p and q; so a vector visits each cell
before its own whose midway sphere is that near, and a pair meets in exactly one cell: that of the lesser
home. Members of a cell are compared with each other and with its visitors, in double precision. Nothing
within the threshold is left out, whatever the pivots are: they decide the cost only. Where vectors visit
many cells (no clusters, many dimensions), cells are made fewer, and the work is that of all pairs.

A cell with more than BLOCK members or visitors is a grid of tasks. A task returns a row for each vector
with links: their number, and the least vector it is connected to. No pair is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perambula.llm.common import mix, write_table
from perambula.llm.components import components

THRESHOLD = 0.93
#: Distinct vectors of a label that are compared whole, and those for each pivot of a larger label.
ONE_SHARD = 6000
SHARD = 3000
#: The sample that pivots come from, over all labels.
PIVOTS_MOST = 4096
#: Vectors on one side of a task, and cells that a vector visits on average, above which cells are made fewer.
BLOCK = 16384
VISITS = 4
#: Rows that are compared at once.
STRIP = 256
#: Added to the bound of a visit, against rounding.
ROUNDING = 1e-6

def usable(vector: str = "embedding") -> F.Column:
    """The vector as doubles if it has a direction, else null."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(v.isNotNull() & whole & F.exists(v, lambda x: x != 0), v)


def unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def homes_and_visits(v: np.ndarray, points: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the points to each vector, and for each vector a mask of the cells that it visits."""
    near = v @ points.T
    home = near.argmax(axis=1)
    sine = np.sqrt(max(0.0, 1 - threshold * threshold)) if threshold > 0 else np.inf
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (points[home] @ points.T)))
    bound = sine * apart + ROUNDING if threshold > 0 else np.full_like(apart, np.inf)
    visits = near[np.arange(len(v)), home][:, None] - near <= bound
    return home, visits & (np.arange(len(points)) < home[:, None])


def fewer_points(points: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """The points, halved while vectors visit many cells; the cost hangs on it and no result."""
    some = points[:STRIP]
    while len(points) > max(1, -(-n // BLOCK)) and homes_and_visits(some, points, threshold)[1].sum() > VISITS * len(some):
        points = points[: -(-len(points) // 2)]
    return points


def connect(v: np.ndarray, times: np.ndarray, n_left: int, within: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links and least connected place of each vector: all pairs of the first n_left with the rest, and within them if asked."""
    links, least = np.zeros(len(v), np.int64), np.arange(len(v))
    marked = np.zeros(len(v), bool)
    first = 0 if within else n_left
    others = v[first:].T
    for at in range(0, n_left if others.size else 0, STRIP):
        hit = v[at : min(at + STRIP, n_left)] @ others >= threshold
        if within:
            hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
        for k in np.flatnonzero(hit.any(axis=1)).tolist():
            q, near = at + k, np.flatnonzero(hit[k]) + first
            links[q] += times[near].sum()
            right = near[near >= n_left]
            links[right] += times[q]
            names = np.append(least[near], least[q])
            low = names.min()
            if (names != low).any():
                marked[names] = True
                least[marked[least]] = low
                marked[names] = False
    return links, least


FOUND = T.StructType([T.StructField("class_id", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType())])


def search_task(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("visitor", "ascending"), ("class_id", "ascending")])
        ids = table.column("class_id").to_numpy()
        times = table.column("n").to_numpy()
        v = unit(np.frombuffer(b"".join(x.as_py() for x in table.column("vector")), "<f8").reshape(len(ids), -1))
        n_left = len(ids) - int(np.count_nonzero(table.column("visitor").to_numpy(zero_copy_only=False)))
        within = table.column("one")[0].as_py() == table.column("other")[0].as_py()
        links, least = connect(v, times, n_left, within, threshold)
        linked = np.flatnonzero(links)
        return pa.table({"class_id": ids[linked], "links": links[linked], "root": ids[least[linked]]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components, and those of a null label,
    link with nothing and are their own component. Vectors of different lengths do not link. Equal vectors
    of a label link with each other. A null id links like any other, but is nobody's component_id;
    a component of null ids alone has a null one. Rows that repeat an id are rows of their own: with equal vectors
    they link with each other, otherwise their component is that of each row. Only the three named columns
    are read, whatever else there is. An empty table gives no row.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("long").alias("label"), vectors[vector_col].alias("embedding"))
    rows = rows.select("vec_id", "label", F.when(F.col("label").isNotNull(), usable()).alias("v"))
    # adding zero makes -0.0 equal to 0.0; the text of the doubles is exact and orders nothing
    pack = F.transform("v", lambda x: x + F.lit(0.0))

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if x.as_py() is None else np.array(x.as_py(), "<f8").tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["vec_id", "label", "vector"])

    rows = write_table(rows.select("vec_id", "label", pack.alias("v")).mapInArrow(binary, "vec_id long, label long, vector binary"), "vectors")
    good = rows.where("vector is not null")
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = write_table(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")  # ids may repeat, classes' numbers don't
    kinds = classes.groupBy("label", F.octet_length("vector").alias("width")).agg(F.count("*").alias("n"))
    large = kinds.where(F.col("n") > ONE_SHARD)
    total = large.agg(F.sum("n")).first()[0] or 0
    # a pivot for each SHARD vectors of a large label, and PIVOTS_MOST in all: those with the least hash
    cells: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
    blocks: dict[int, tuple[int, int]] = {}
    if total:
        share = min(1 / SHARD, PIVOTS_MOST / total)
        largest = large.orderBy(F.desc("n"), "label", "width").limit(PIVOTS_MOST)
        sizes = {(r["label"], r["width"]): r["n"] for r in largest.collect()}
        sample = classes.join(F.broadcast(largest.select("label", "width")), (classes["label"] == large["label"]) & (F.octet_length("vector") == large["width"]), "left_semi")
        sample = sample.where(F.pmod(F.xxhash64("class_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)).orderBy(F.xxhash64("class_id")).limit(PIVOTS_MOST).collect()
        drawn: dict[tuple[int, int], list[bytes]] = {}
        for r in sample:
            drawn.setdefault((r["label"], len(r["vector"])), []).append(bytes(r["vector"]))
        at = 0
        for key, n in sorted(sizes.items()):
            found = drawn.get(key)
            points = fewer_points(unit(np.frombuffer(b"".join(found), "<f8").reshape(len(found), -1)), n, threshold) if found else np.zeros((1, key[1] // 8))
            cells[key] = (points, at)
            at += len(points)

    def placed(batch: pa.RecordBatch) -> Iterator[tuple[list[dict], np.ndarray | None, np.ndarray | None]]:
        """Rows of a batch, with the cells they are at home in and (row, cell) of their visits; no cell where the label is one task."""
        by: dict[tuple[int, int], list[dict]] = {}
        for r in batch.to_pylist():
            by.setdefault((r["label"], len(r["vector"])), []).append(r)
        for key, members in by.items():
            if key not in cells:
                yield members, None, None
                continue
            points, first = cells[key]
            for at in range(0, len(members), STRIP):
                part = members[at : at + STRIP]
                home, visits = homes_and_visits(unit(np.frombuffer(b"".join(r["vector"] for r in part), "<f8").reshape(len(part), -1)), points, threshold)
                yield part, home + first, np.argwhere(visits) + [0, first]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, home, visits in placed(batch):
                if home is not None:
                    for cell, visitor in ((home, False), (visits[:, 1], True)):
                        names, n = np.unique(cell, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([visitor] * len(names), pa.bool_()), pa.array(n, pa.int64())], ["cell", "visitor", "n"])

    if cells:
        counted = classes.select("label", "vector").mapInArrow(count, "cell long, visitor boolean, n long").groupBy("cell", "visitor").agg(F.sum("n").alias("n")).collect()
        for r in counted:
            mine = blocks.get(r["cell"], (1, 0))
            parts = -(-r["n"] // BLOCK)
            blocks[r["cell"]] = (mine[0], parts) if r["visitor"] else (parts, mine[1])

    dealt_schema = "cell long, label long, width int, one int, other int, visitor boolean, class_id long, n long, vector binary"
    dealt_arrow = pa.schema([("cell", pa.int64()), ("label", pa.int64()), ("width", pa.int32()), ("one", pa.int32()), ("other", pa.int32()), ("visitor", pa.bool_()), ("class_id", pa.int64()), ("n", pa.int64()), ("vector", pa.binary())])

    def tasks(cell: int, visitor: bool, block: int) -> list[tuple[int, int, bool]]:
        """(one, other, as visitor) of the tasks of a cell's grid that a block of its members or visitors takes part in."""
        members, visitors = blocks[cell]
        if members == 1 and visitors <= 1:
            return [(0, 0, visitor)]
        if visitor:
            return [(k, members + block, True) for k in range(members)]
        return [(k, block, True) for k in range(block)] + [(block, k, False) for k in range(block, members + visitors)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, home, visits in placed(batch):
                out = []

                def put(r: dict, cell: int, one: int, other: int, visitor: bool) -> None:
                    out.append({"cell": cell, "width": len(r["vector"]), "one": one, "other": other, "visitor": visitor, **r})  # noqa: B023

                if home is None:
                    for r in members:
                        put(r, -1, 0, 0, False)
                else:
                    mixed = mix(np.array([r["class_id"] for r in members], np.int64).view(np.uint64)).tolist()
                    places = [(k, c, False) for k, c in enumerate(home.tolist())] + [(k, c, True) for k, c in visits.tolist()]
                    for k, cell, visitor in places:
                        for task in tasks(cell, visitor, mixed[k] % blocks[cell][visitor]):
                            put(members[k], cell, *task)
                for at in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_pylist(out[at : at + 4096], dealt_arrow)

    dealt = classes.select("label", "vector", "class_id", "n").mapInArrow(deal, dealt_schema)
    found = write_table(dealt.groupBy("cell", "label", "width", "one", "other").applyInArrow(search_task(threshold), FOUND), "found")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("class_id").alias("u"), F.col("root").alias("v")))
    known = classes.join(links, "class_id", "left").join(joined, classes["class_id"] == joined["node"], "left")
    known = known.select("label", "vector", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "class_id").alias("root"))
    known = known.join(known.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    own = rows.join(known, ["label", "vector"], "left")
    return own.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
