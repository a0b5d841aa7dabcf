"""Variable-capacity best-fit packing of token sequences.

Texts become token ids with a public tokenizer, each document followed by an end mark; documents longer than
the largest length are cut into pieces. Several sequence lengths are permitted. A piece goes into the open
bin whose room it leaves smallest; if none has room, a bin is opened, and in the end every bin is downsized
to the smallest permitted length that holds its contents. The lengths are optimised jointly: a group is packed
once for each policy of opening (the length that costs least for each token that may still come, and, for
each permitted length, that one or the least larger one that holds the piece), and the packing stays whose
bins cost least, a bin costing its length and a fixed part for a sequence.

Pieces are packed in groups of bounded size, dealt by a hash of the document's id and the row's place, so that
no source, key or copy gathers in a task; packing loses less than one bin a group to that.
"""

from __future__ import annotations

import base64
import bisect
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perambula.llm.common import bound_batches, give_back, of_worker, write_table

CAPACITIES = (512, 1024, 2048, 4096)
#: Tokens in a group on average.
GROUP_TOKENS = 1 << 18
#: Cost of a bin: its capacity and a fixed part for each sequence.
SEQUENCE_COST = 16

PACKED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.LongType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("bin_id", T.LongType(), False),
        T.StructField("bin_capacity", T.LongType(), False),
        T.StructField("bin_offset", T.LongType(), False),
    ]
)


def opening_size(length: int, rest: int, capacities: list[int], cost: int) -> int:
    """The permitted length with the least cost for the tokens it will carry: this piece and what may still follow."""
    best = None
    for c in capacities:
        if c >= length:
            price = (c + cost) / min(c, rest)
            if best is None or price < best[0]:
                best = (price, c)
    return best[1]


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, cost: int = SEQUENCE_COST, opening: Callable[[int, int, list[int], int], int] = opening_size) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and the capacity of each bin; longest pieces first, ties in order."""
    sizes = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    left = int(lengths.sum())
    rooms: list[int] = []  # sorted distinct rooms of open bins
    by_room: dict[int, list[int]] = {}  # heaps of bins with that room
    used: list[int] = []
    opened: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = heapq.heappop(by_room[room])
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        else:
            b = len(used)
            room = opening(n, max(left, 1), sizes, cost)
            used.append(0)
            opened.append(room)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        left -= n
        room -= n
        if room:
            if room not in by_room:
                by_room[room] = []
                bisect.insort(rooms, room)
            heapq.heappush(by_room[room], b)
    return bins, offsets, [next(c for c in sizes if c >= u) for u in used]


def at_least(size: int) -> Callable[[int, int, list[int], int], int]:
    """Opens bins at a permitted length, or the least larger one that holds the piece."""
    return lambda length, rest, sizes, cost: next(c for c in sizes if c >= max(size, length))


def cheapest(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, cost: int = SEQUENCE_COST) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """As pack, with the policy of opening whose bins cost least; the first of equals."""
    found = (pack(lengths, capacities, cost, opening) for opening in (opening_size, *map(at_least, sorted(capacities))))
    return min(found, key=lambda x: sum(x[2]) + cost * len(x[2]))


def pack_documents(docs: DataFrame, length_col: str, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Per piece: doc_id, piece, start and n_tokens in the document, bin_id, bin_capacity, bin_offset.

    A document of length null or 0 is one piece of no token; a negative length counts as 0. Null ids and
    repeated rows are packed like any other. An empty table gives no row.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    most = max(capacities)
    length = F.greatest(F.coalesce(docs[length_col].cast("long"), F.lit(0)), F.lit(0))
    items = write_table(docs.select(docs[id_col].cast("long").alias("doc_id"), length.alias("n")), "lengths")
    items = items.withColumn("row", F.monotonically_increasing_id())
    total = items.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    pieces = items.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(n - 1) div {most}"), F.lit(0)))).alias("piece"))
    pieces = pieces.select("doc_id", "row", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("long").alias("n_tokens"))
    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(groups)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "start", "n_tokens")}
        ids = table.column("doc_id").combine_chunks()
        known = ids.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((columns["n_tokens"], columns["piece"], known, np.asarray(ids.is_null())))
        lengths = columns["n_tokens"][order]
        bins, offsets, sizes = cheapest(lengths, capacities)
        group = table.column("bin_group")[0].as_py()
        return pa.table(
            {
                "doc_id": ids.take(pa.array(order)),
                "piece": columns["piece"][order],
                "start": columns["start"][order],
                "n_tokens": lengths,
                "bin_id": bins + (group << 32),
                "bin_capacity": np.array(sizes, np.int64)[bins] if len(bins) else bins,
                "bin_offset": offsets,
            }
        )

    return dealt.groupBy("bin_group").applyInArrow(run, PACKED)


# Sequences -----------------------------------------------------------------------------------

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("ids", T.BinaryType(), False)])
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
LONGS = T.ArrayType(T.LongType())
SEQUENCES = T.StructType(
    [
        T.StructField("bin_id", T.LongType(), False),
        T.StructField("bin_capacity", T.LongType(), False),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("doc_ids", LONGS),
        T.StructField("pieces", LONGS),
        T.StructField("offsets", LONGS),
        T.StructField("lengths", LONGS),
        T.StructField("ids", T.BinaryType(), False),
    ]
)


class Tokenizer:
    """A byte-pair vocabulary in tiktoken's format, and the pattern that cuts its texts."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())


def token_pieces(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, n_tokens, ids): whole texts' ids with the end mark in pieces of `most` at most, as little-endian unsigned 16-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = of_worker(("tiktoken", tokenizer_path), lambda: Tokenizer(tokenizer_path, pattern))
        if max(tokenizer.size, end_id + 1) > 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        for batch in batches:
            ids, piece, lengths, parts = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.append(tokenizer.encode(text.as_py() or ""), end_id).astype("<u2")
                for k in range(0, len(found), most):
                    part = found[k : k + most]
                    ids.append(i)
                    piece.append(k // most)
                    lengths.append(len(part))
                    parts.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary())], schema=PIECES_ARROW)
        give_back()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, PIECES)


def pack_texts(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Per sequence: bin_id, bin_capacity, n_tokens, ids, and in order of place its segments' doc_ids, pieces, offsets and lengths.

    ids are little-endian unsigned 16-bit, n_tokens of them; what is missing to bin_capacity is padding. A
    document's pieces are numbered from 0 and cut every max(capacities) tokens. A null or empty text is its
    end mark alone. Null ids and repeated rows are packed like any other. Only the two named columns are
    read, whatever else there is. An empty table gives no row.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    bound_batches(docs.sparkSession)
    pieces = write_table(token_pieces(docs, tokenizer_path, pattern, end_id, max(capacities), id_col, text_col), "pieces")
    total = pieces.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "n_tokens")}
        docs_ = table.column("doc_id").combine_chunks()
        known = docs_.fill_null(-1).to_numpy(zero_copy_only=False)
        texts = [x.as_py() for x in table.column("ids")]
        order = np.array(sorted(range(len(texts)), key=lambda i: (docs_[i].is_valid, known[i], columns["piece"][i], texts[i])), np.int64)
        bins, offsets, sizes = cheapest(columns["n_tokens"][order], capacities)
        place = np.lexsort((offsets, bins))
        order, bins, offsets = order[place], bins[place], offsets[place]
        lengths = columns["n_tokens"][order]
        cuts = np.searchsorted(bins, np.arange(len(sizes) + 1))
        used = np.bincount(bins, lengths, len(sizes)).astype(np.int64)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
        ends = np.concatenate([[0], np.cumsum(2 * used)]).astype(np.int32)
        whole = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join([texts[i] for i in order.tolist()]))])
        group = table.column("bin_group")[0].as_py()
        return pa.table(
            {
                "bin_id": np.arange(len(sizes)) + (group << 32),
                "bin_capacity": np.array(sizes, np.int64),
                "n_tokens": used,
                "doc_ids": lists(docs_.take(pa.array(order))),
                "pieces": lists(pa.array(columns["piece"][order])),
                "offsets": lists(pa.array(offsets)),
                "lengths": lists(pa.array(lengths)),
                "ids": whole,
            }
        )

    return dealt.groupBy("bin_group").applyInArrow(run, SEQUENCES)


# Words ---------------------------------------------------------------------------------------


def token_length(text: str) -> F.Column:
    """Words of a text (runs of characters other than space and \\t to \\r) and one end mark; 1 if null."""
    bare = F.expr(f"trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM {text})")
    gaps = F.length(F.regexp_replace(bare, "[^\\x20\\x09-\\x0D]+", "x")) - F.length(F.regexp_replace(bare, "[^\\x20\\x09-\\x0D]+", ""))
    return F.coalesce(gaps, F.lit(0)).cast("long") + 1
