"""Token ids in binary files under a static range asymmetric numeral system.

One table of symbol frequencies, counted over the whole corpus, is shared by all blocks. A block holds the
ids of consecutive documents; its symbols are dealt to LANES interleaved coders whose states move together,
so numpy codes a row of lanes at a time. Each block is decoded on its own, and has checkpoints (the states
and the place in its words every CHECKPOINT rows) from which a decoder can start in its middle, a checksum of
its words and one of the ids from each checkpoint to the next.

A folder of token files holds `blocks`, Parquet rows of one block each in ascending order of document id,
written by Spark's committer (the `block` column is the binary format below), and `table`, one row with the
frequencies and their checksum: any session can decode the folder. Documents are sorted by range partitioning
on id, length and a hash of the ids, so that rows that share an id are dealt out, too; what the driver
gathers is one row a shard and one count for each symbol.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perambula.llm.common import bound_batches, give_back, input_bytes, new_path, of_worker, shuffle_partitions, write_table

LANES = 4096
CHECKPOINT = 128
SCALE_BITS = 18
BLOCK_TOKENS = 1 << 20
MAGIC = b"RANS\x02\x00\x00\x00"
HEAD = "<8sQQQQII"  # magic, ids, lanes, rows, words, crc of what follows, rows from checkpoint to checkpoint
TABLE_MAGIC = b"RANSTAB\x01"
LOW = np.uint64(1 << 31)
#: Compressed bytes of tokens in a shard.
SHARD_BYTES = 32 << 20


# The coder -----------------------------------------------------------------------------------


class Table:
    """Frequencies that add up to 2**SCALE_BITS; symbols that the corpus has get at least one."""

    def __init__(self, counts: np.ndarray, bits: int = SCALE_BITS):
        counts = np.asarray(counts, np.int64)
        present = np.flatnonzero(counts)
        if len(present) > 1 << bits:
            raise ValueError("more symbols than slots")
        self.bits = bits
        self.freq = np.zeros(len(counts), np.uint64)
        if len(present):
            total, slots = int(counts.sum()), 1 << bits
            share = np.maximum(1, counts[present] * slots // total)
            order = np.argsort(-share, kind="stable")
            over = int(share.sum()) - slots
            k = 0
            while over > 0:  # taken from the largest
                cut = min(over, int(share[order[k]]) - 1, max(1, int(share[order[k]]) // 8))
                share[order[k]] -= cut
                over -= cut
                k = (k + 1) % len(order)
            share[order[0]] -= over
            self.freq[present] = share
        self.fill()

    def fill(self) -> None:
        self.first = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    def to_bytes(self) -> bytes:
        body = self.freq.astype("<u4").tobytes()
        return struct.pack("<8sIII", TABLE_MAGIC, self.bits, len(self.freq), zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        magic, bits, n, crc = struct.unpack_from("<8sIII", raw)
        body = raw[struct.calcsize("<8sIII") :]
        if magic != TABLE_MAGIC or len(body) != 4 * n or zlib.crc32(body) != crc:
            raise ValueError("a damaged table")
        found = cls.__new__(cls)
        found.bits, found.freq = bits, np.frombuffer(body, "<u4").astype(np.uint64)
        found.fill()
        return found

    def encode(self, ids: np.ndarray, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> bytes:
        """One block."""
        n = len(ids)
        rows = -(-n // lanes)
        filler = self.symbol[0] if len(self.symbol) else 0
        grid = np.full(rows * lanes, filler, np.int64)
        grid[:n] = ids
        freq, first = self.freq[grid].reshape(rows, lanes), self.first[grid].reshape(rows, lanes)
        if n and not freq.all():
            raise ValueError("a symbol that the table does not have")
        state = np.full(lanes, LOW, np.uint64)
        bits, room = np.uint64(self.bits), np.uint64(63 - self.bits)
        words: list[np.ndarray] = []
        points: list[np.ndarray] = []
        low32, half = np.uint64(0xFFFFFFFF), np.uint64(32)
        written = 0
        marks: list[int] = []
        for r in range(rows - 1, -1, -1):
            f = freq[r]
            full = state >= (f << room)
            out = (state[full] & low32).astype(np.uint32)
            state[full] >>= half
            words.append(out)
            written += len(out)
            q = state // f
            state = (q << bits) + (state - q * f) + first[r]
            if r % checkpoint == 0:
                points.append(state.copy())
                marks.append(written)
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        places = np.array([written - m for m in marks[::-1]], np.uint64)  # words before each checkpoint
        states = np.concatenate(points[::-1]) if points else np.zeros(0, np.uint64)
        raw, step = memoryview(np.ascontiguousarray(ids, "<u4").tobytes()), 4 * lanes * checkpoint
        sums = np.array([zlib.crc32(raw[k * step : (k + 1) * step]) for k in range(len(points))], "<u4")
        body = places.astype("<u8").tobytes() + states.astype("<u8").tobytes() + sums.tobytes() + stream.astype("<u4").tobytes()
        return struct.pack(HEAD, MAGIC, n, lanes, rows, len(stream), zlib.crc32(body), checkpoint) + body

    def decode(self, block: bytes, point: int = 0, points: int | None = None) -> np.ndarray:
        """The ids of a block, or of so many checkpoints from one on; checksums are verified."""
        magic, n, lanes, rows, n_words, crc, checkpoint = struct.unpack_from(HEAD, block)
        body = memoryview(block)[struct.calcsize(HEAD) :]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("a damaged block")
        total = -(-rows // checkpoint)
        places = np.frombuffer(body, "<u8", total)
        states = np.frombuffer(body, "<u8", total * lanes, 8 * total).reshape(total, lanes)
        sums = np.frombuffer(body, "<u4", total, 8 * total * (1 + lanes))
        stream = np.frombuffer(body, "<u4", n_words, 8 * total * (1 + lanes) + 4 * total).astype(np.uint64)
        last = total if points is None else min(total, point + points)
        if point >= last:
            return np.zeros(0, np.uint32)
        state, at = states[point].copy(), int(places[point])
        begin, end = point * checkpoint, min(rows, last * checkpoint)
        out = np.empty((end - begin, lanes), np.uint32)
        mask, bits, half = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), np.uint64(32)
        symbol, freq, first = self.symbol, self.freq, self.first
        for r in range(end - begin):
            slot = state & mask
            s = symbol[slot.astype(np.int64)]
            out[r] = s
            state = freq[s] * (state >> bits) + slot - first[s]
            empty = state < LOW
            k = int(np.count_nonzero(empty))
            if k:
                state[empty] = (state[empty] << half) | stream[at : at + k]
                at += k
        ids = out.reshape(-1)[: max(0, n - begin * lanes)]
        raw, step = memoryview(ids.astype("<u4").tobytes()), 4 * lanes * checkpoint
        if any(zlib.crc32(raw[k * step : (k + 1) * step]) != sums[point + k] for k in range(last - point)):
            raise ValueError("a block that does not give its ids back")
        return ids

    def decode_range(self, block: bytes, first: int, n: int) -> np.ndarray:
        """n ids of a block from one on, decoded from the checkpoint before it."""
        _, _, lanes, _, _, _, checkpoint = struct.unpack_from(HEAD, block)
        step = lanes * checkpoint
        point = first // step
        return self.decode(block, point, -(-(first + n) // step) - point)[first - point * step :][:n]


# Tokens --------------------------------------------------------------------------------------


class Pieces(dict):
    """Piece to number; a new piece gets the next one and waits in `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        found = self[piece] = len(self)
        return found


class Tokens:
    """Texts to ids with the tokenizers library, which gets each distinct piece once.

    A text is cut at single spaces between two other characters: there the pre-tokenizer always cuts, the
    space belongs to what follows, and no later token reaches back over it. Marks at the end of a piece
    are cut off, too, as letters and marks never share a token. New pieces are encoded together as one
    text; each begins at the only token of its own that starts with a space.
    """

    #: New pieces in one text for the library, and texts that it gets at once: its answers are large.
    TOGETHER = 1000
    TEXTS = 16
    MARKS = ".,;:!?%$#&*|)(\"-"

    def __init__(self, path: str, most: int = 300_000):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        vocabulary = self.model.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that start with a space
        self.begins[[i for w, i in vocabulary.items() if w.startswith("\u0120")]] = True
        self.specials = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.most = most
        self.place = Pieces()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.edged = np.zeros(1 << 12, bool)  # pieces that are empty, or have white space at an end
        self.times = np.zeros(1 << 12, np.int64)  # how often a piece was met
        self.tails: dict[str, tuple[int, int]] = {}

    def forget(self) -> None:
        """Keeps the pieces that were met twice or more, and of those no more than half of what there is room for."""
        names, n = list(self.place), len(self.place)
        kept = np.flatnonzero(self.times[:n] >= 2)
        if len(kept) > self.most // 2:
            kept = np.sort(kept[np.argsort(-self.times[kept], kind="stable")[: self.most // 2]])
        lengths = self.lengths[kept]
        stop = np.cumsum(lengths)
        pool = self.pool[np.repeat(self.starts[kept] - stop + lengths, lengths) + np.arange(int(lengths.sum()))]
        self.place = Pieces()
        self.place.update(zip((names[i] for i in kept.tolist()), range(len(kept)), strict=True))
        self.pool, self.used = pool if len(pool) else np.zeros(1, np.uint32), len(pool)
        self.starts, self.lengths = stop - lengths, lengths
        self.edged, self.times = self.edged[kept], self.times[kept] // 2
        self.tails = {}

    def keep(self, ids: np.ndarray) -> int:
        """Puts ids into the pool; where they start."""
        at = self.used
        self.used += len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[at : self.used] = ids
        return at

    def raw(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; few of the library's answers, which are many times a text's size, live at a time."""
        at = 0
        while at < len(texts):
            stop, size = at + 1, len(texts[at])
            while stop < len(texts) and stop < at + self.TEXTS * self.TOGETHER and size < self.TEXTS * 6 * self.TOGETHER:
                size += len(texts[stop])
                stop += 1
            for x in self.model.encode_batch_fast(texts[at:stop], add_special_tokens=False):
                yield np.array(x.ids, np.uint32)
            at = stop

    def learn(self) -> None:
        """Ids of the pieces that are new."""
        place, new, marks = self.place, self.place.new, self.MARKS
        base = len(place) - len(new)
        plain, odd, edged, whole, cores, tails = [], [], [], [], [], []
        for k, p in enumerate(new):  # grows: letters without their marks are pieces, too
            if p.isalpha():
                plain.append(k)
                continue
            if not p or p[0].isspace() or p[-1].isspace():
                edged.append(k)
            core = p.rstrip(marks)
            if core.isalpha():
                whole.append(k)
                cores.append(place[core])
                tails.append(p[len(core) :])
            elif not p or " " in p or "<" in p:
                odd.append(k)
            else:
                plain.append(k)
        if len(place) > len(self.starts):
            room = max(len(self.starts), len(place) - len(self.starts))
            self.starts, self.lengths, self.edged, self.times = (np.concatenate([x, np.zeros(room, x.dtype)]) for x in (self.starts, self.lengths, self.edged, self.times))
        self.edged[np.array(edged, np.int64) + base] = True
        groups = [plain[i : i + self.TOGETHER] for i in range(0, len(plain), self.TOGETHER)]
        for group, ids in zip(groups, self.raw(["".join([" " + new[k] for k in g]) for g in groups]), strict=True):
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(group):
                odd += group
                continue
            at = np.array(group) + base
            self.starts[at] = starts + self.keep(ids)
            self.lengths[at] = np.diff(np.append(starts, len(ids)))
        for k, ids in zip(odd, self.raw([" " + new[k] for k in odd]), strict=True):
            self.starts[base + k], self.lengths[base + k] = self.keep(ids), len(ids)
        if whole:
            fresh = sorted(set(tails).difference(self.tails))
            for t, ids in zip(fresh, self.raw(fresh), strict=True):
                self.tails[t] = (self.keep(ids), len(ids))
            cores = np.array(cores)
            ends = np.array([self.tails[t] for t in tails])
            starts = np.stack([self.starts[cores], ends[:, 0]], 1).reshape(-1)
            n = np.stack([self.lengths[cores], ends[:, 1]], 1).reshape(-1)
            stop = np.cumsum(n)
            at = np.array(whole) + base
            self.lengths[at] = n[::2] + n[1::2]
            self.starts[at] = stop[1::2] - self.lengths[at] + self.keep(self.pool[np.repeat(starts - stop + n, n) + np.arange(int(stop[-1]))])
        place.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text ends."""
        if len(self.place) > self.most:
            self.forget()
        heads, parts = [], []
        get = self.place.__getitem__
        for t in texts:
            cut = t.split(" ")
            if not cut[0] or cut[0][-1].isspace():
                cut = self.cut.split(t)
            heads.append(cut[0])
            parts.append(np.fromiter(map(get, cut[1:]), np.int64, len(cut) - 1))
        self.learn()
        where = np.concatenate(parts)
        if self.edged[where].any():  # some spaces stand beside other white space
            for k, part in enumerate(parts):
                if self.edged[part].any():
                    cut = self.cut.split(texts[k])
                    heads[k], parts[k] = cut[0], np.fromiter(map(get, cut[1:]), np.int64, len(cut) - 1)
            self.learn()
            where = np.concatenate(parts)
        self.times += np.bincount(where, minlength=len(self.times))
        heads = list(self.raw(heads))
        pool, begin, n = self.pool, self.starts[where], self.lengths[where]
        stop = np.cumsum(n)
        body = pool[np.repeat(begin - stop + n, n) + np.arange(int(stop[-1]) if len(stop) else 0)]
        cuts = np.concatenate([np.zeros(1, np.int64), stop])[np.cumsum([len(p) for p in parts])]
        # each text's first piece stands before its others
        lengths = np.array([len(h) for h in heads], np.int64)
        first = np.concatenate(heads) if heads else np.zeros(0, np.uint32)
        out = np.insert(body, np.repeat(np.concatenate([np.zeros(1, np.int64), cuts[:-1]]), lengths), first)
        return out, cuts + np.cumsum(lengths)


TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType(), False), T.StructField("ids", T.BinaryType(), False)])
TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids): whole texts' ids with the end id, 16-bit if all ids of the vocabulary are."""
    from tokenizers import Tokenizer

    from perambula.llm.lexicon import grouped

    kind = id_type(Tokenizer.from_file(tokenizer_path).get_vocab_size())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = of_worker(("tokens", tokenizer_path), lambda: Tokens(tokenizer_path))
        end = np.array([end_id], kind)
        for ids, texts in grouped(batches, 2 << 20):
            flat, ends = tokens.encode(texts)
            whole = np.insert(flat.astype(kind), ends, end[0])
            ends = ends + np.arange(1, len(ends) + 1)
            offsets = np.concatenate([np.zeros(1, np.int64), ends]) * whole.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(whole.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(offsets) // whole.itemsize), packed], schema=TOKENS_ARROW)
        give_back()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, TOKENS)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def symbol_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each symbol occurs in the whole table; one row a symbol and task is shuffled."""
    kind = id_type(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            joined = b"".join(x.as_py() for x in batch.column(0))
            total += np.bincount(np.frombuffer(joined, kind), minlength=vocabulary)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["symbol", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for s, n in tokens.select("ids").mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n")).collect():
        counts[s] = n
    return counts


FILE = T.StructType(
    [
        T.StructField("shard", T.IntegerType(), False),
        T.StructField("number", T.LongType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("doc_ids", T.ArrayType(T.LongType()), False),
        T.StructField("lengths", T.ArrayType(T.LongType()), False),
        T.StructField("block", T.BinaryType(), False),
    ]
)
FILE_ARROW = pa.schema([("shard", pa.int32()), ("number", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("block", pa.binary())])


class TokenFiles:
    """A folder of token files, and the shared table that decodes them."""

    def __init__(self, path: str, table: Table):
        self.path, self.table = path, table

    @classmethod
    def open(cls, spark, path: str) -> TokenFiles:
        """A folder that any session wrote; the table's checksum is verified."""
        rows = spark.read.schema("frequencies binary").parquet(f"{path}/table").collect()  # one row
        return cls(path, Table.from_bytes(bytes(rows[0][0])))

    def blocks(self, spark) -> DataFrame:
        return spark.read.schema(FILE).parquet(f"{self.path}/blocks")


def write_files(tokens: DataFrame, path: str, vocabulary: int, block_tokens: int = BLOCK_TOKENS) -> TokenFiles:
    """Writes (doc_id, n, ids) rows as blocks in ascending order of doc_id; null ids come first, equal ids by length and content."""
    kind = id_type(vocabulary)
    table = Table(symbol_counts(tokens, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        docs, lengths, parts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            row = {"shard": shard, "number": number, "start": start, "n_tokens": held, "doc_ids": docs, "lengths": lengths, "block": table.encode(np.concatenate(parts))}
            return pa.RecordBatch.from_pylist([row], FILE_ARROW)

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(x.as_buffer(), kind)
                if docs and held + len(ids) > block_tokens:
                    yield block()
                    docs, lengths, parts, number, start, held = [], [], [], number + 1, start + held, 0
                docs.append(i)
                lengths.append(len(ids))
                parts.append(ids)
                held += len(ids)
        if docs:
            yield block()
        give_back()

    shards = max(shuffle_partitions(tokens.sparkSession) // 2, input_bytes(tokens) // SHARD_BYTES, 1)
    ordered = tokens.repartitionByRange(shards, "doc_id", "n", F.xxhash64("ids")).sortWithinPartitions("doc_id", "n", F.xxhash64("ids"), "ids")
    ordered.mapInArrow(run, FILE).write.option("compression", "none").parquet(f"{path}/blocks")
    tokens.sparkSession.createDataFrame([(bytearray(table.to_bytes()),)], "frequencies binary").coalesce(1).write.parquet(f"{path}/table")
    return TokenFiles(path, table)


READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("ids", T.BinaryType(), False)])
READ_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def shard_starts(rows: DataFrame) -> dict[int, int]:
    """Ids before each shard; one row a shard reaches the driver."""
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("shard").agg(F.sum("n_tokens")).collect())
    before, total = {}, 0
    for shard, n in sizes:
        before[shard] = total
        total += n
    return before


def read_files(spark, files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids as little-endian unsigned 32-bit, and how many come before."""
    rows = files.blocks(spark)
    before, table = shard_starts(rows), files.table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, _, start, _, docs, lengths, block = (batch.column(k)[i].as_py() for k in range(7))
                ids = table.decode(block).astype("<u4")
                ends = np.cumsum(lengths)
                raw = ids.tobytes()
                parts = [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - lengths + start + before[shard]), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary())], schema=READ_ARROW)
        give_back()

    return rows.mapInArrow(run, READ)


def read_range(spark, files: TokenFiles, first: int, n: int) -> DataFrame:
    """(start, ids) of the blocks' parts that hold n ids of the corpus from one on; decoding starts at checkpoints."""
    rows = files.blocks(spark)
    before, table = shard_starts(rows), files.table
    place = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("shard")] + F.col("start") if before else F.lit(0).cast("long")
    found = rows.select(place.alias("start"), "n_tokens", "block").where((F.col("start") < first + n) & (F.col("start") + F.col("n_tokens") > first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, held, block = (batch.column(k)[i].as_py() for k in range(3))
                a, b = max(first, start), min(first + n, start + held)
                ids = table.decode_range(block, a - start, b - a).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([ids], pa.binary())], ["start", "ids"])

    return found.mapInArrow(run, "start long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes, writes files into the shared folder, and reads them back by their path.

    Null and empty texts are the end id alone. Rows with a null id come first in the files; rows that share
    an id stay rows of their own, by length and content. Only the two named columns are read, whatever else
    there is. A document longer than a block is a block of its own. An empty table gives no row.
    """
    from tokenizers import Tokenizer

    bound_batches(docs.sparkSession)
    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    tokens = write_table(tokenize(docs, tokenizer_path, end_id, id_col, text_col), "tokens")
    files = write_files(tokens, new_path(docs.sparkSession, "rans"), vocabulary)
    return read_files(docs.sparkSession, TokenFiles.open(docs.sparkSession, files.path))
