"""Substring dedup on words by repeated-phrase automata.

A passage is `window` consecutive words. It is repeated if a document with a smaller id has it too.

1. Every window names one anchor phrase of `phrase` words, the one with the least hash in it, so equal
   windows name equal phrases. Blocks exchange the phrases' hashes and learn which recur in a second
   document: the recurring phrases.
2. The automata are sharded by block, so that a document meets the phrases that it can hold and no others:
   a block compiles its recurring phrases into one Aho-Corasick automaton, over its words as numbers, and
   streams all its documents through it. The automaton locates every occurrence, those in windows that name
   another phrase and those in other documents of the block included.
3. Windows around occurrences are candidates. Blocks exchange 128-bit digests of their text with the
   smallest id that has each, and a passage is confirmed where a second document has it. A block gets one
   bit for each of its windows, and cuts out the words that repeated windows cover.

Copies of a whole text are settled by a digest first: only the smallest holder goes through the steps.
Shuffled are 4 bytes for about one word in 17, and 24 bytes and one bit for each candidate window; texts are
read from the block table three times and never shuffled. A hot passage comes once per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perambula.llm.common import (
    INVERSE,
    MESSAGE,
    Block,
    Blocks,
    Rolling,
    answers_of,
    ask_anchors,
    bucket_of,
    first_holders,
    first_ids,
    messages,
    mix,
    powers,
    recurring_anchors,
    reduce_anchors,
    rows_of,
    runs,
    split_by_bucket,
    stir,
    window_argmin,
    write_table,
)

WINDOW = 50
PHRASE = 16
#: Characters that stand for a word: all of Unicode but surrogates and zero.
LETTERS = 0x110000 - 0x800 - 1

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


#: Bytes that are cut into words together.
PIECE = 1 << 17
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pieces(block: Block, which: np.ndarray, most: int = PIECE) -> Iterator[np.ndarray]:
    """The documents in groups of about so many bytes."""
    group, size = [], 0
    for i in which.tolist():
        n = int(block.ends[i] - block.starts[i])
        if group and size + n > most:
            yield np.array(group)
            group, size = [], 0
        group.append(i)
        size += n
    if group:
        yield np.array(group)


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop; the data ends with white space."""
    edges = np.diff(SPACES[data].view(np.int8), prepend=1)
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


class Words:
    """The words of a block's documents that have a window, as one sequence of hashes.

    Words are found and hashed over the bytes of some documents at a time; no word becomes an object. The
    text of words that stand side by side is data[begin of the first : end of the last], with one space
    between two.
    """

    def __init__(self, block: Block, which: np.ndarray, window: int):
        docs, symbols, counts, texts, begin, end = [], [], [], [], [], []
        size = 0
        for group in pieces(block, which):
            data = np.frombuffer(b" ".join([block.text(i) for i in group]) + b" ", np.uint8)
            begins = np.cumsum([0, *[int(block.ends[i] - block.starts[i]) + 1 for i in group[:-1]]])
            starts, stops = word_edges(data)
            sums = Rolling(BYTES[data]).sums
            hashes = mix((sums[stops] - sums[starts]) * powers(INVERSE, len(data))[starts])
            of = np.searchsorted(begins, starts, side="right") - 1
            n = np.bincount(of, minlength=len(group))
            enough = n >= window
            own = enough[of]
            docs.append(group[enough])
            counts.append(n[enough])
            symbols.append(hashes[own])
            plain = ~SPACES[data]
            plain[stops] = True
            plain = np.where(SPACES[data[plain]], np.uint8(32), data[plain])
            after = np.cumsum(stops - starts + 1)
            end.append(after[own] - 1 + size)
            begin.append(end[-1] - (stops - starts)[own])
            texts.append(plain)
            size += len(plain)
        join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        self.docs, lengths, self.symbols = join(docs, np.int64), join(counts, np.int64), join(symbols, np.uint64)
        self.data, self.begin, self.end = join(texts, np.uint8), join(begin, np.int64), join(end, np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.doc_of = np.repeat(np.arange(len(lengths)), lengths)
        self.room = np.repeat(self.ends, lengths) - np.arange(len(self.symbols))  # words from here to the document's end

    def anchors(self, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each run of windows' anchor, mixed; where it stands first; the run's document."""
        least, place = window_argmin(Rolling(self.symbols).windows(phrase, stir), window - phrase + 1)
        first, _ = runs(least, self.starts, self.ends, window) if len(least) else (self.starts[:0], None)
        return mix(least[first]), place[first], self.doc_of[first]  # least hashes are small; mixed, they spread over all buckets

    def letters(self) -> str:
        """The words as characters, equal ones for equal words; different ones for different words of up to LETTERS."""
        _, number = np.unique(self.symbols, return_inverse=True)
        code = (number % LETTERS).astype(np.uint32) + np.uint32(1)
        code[code >= 0xD800] += np.uint32(0x800)
        return code.tobytes().decode("utf-32-le")

    def digests(self, at: np.ndarray, window: int) -> np.ndarray:
        """128-bit digests of the texts of windows, as pairs."""
        import xxhash

        text = memoryview(self.data.tobytes())
        make = xxhash.xxh3_128_digest
        found = b"".join([make(text[a:b]) for a, b in zip(self.begin[at].tolist(), self.end[at + window - 1].tolist(), strict=True)])
        return np.frombuffer(found, np.uint64).reshape(-1, 2)


def occurrences(words: Words, places: np.ndarray, phrase: int) -> np.ndarray:
    """Where the phrases that stand at the places occur: all words are streamed through the phrases' automaton."""
    import ahocorasick

    if not len(places):
        return np.zeros(0, np.int64)
    text = words.letters()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p in places.tolist():
        automaton.add_word(text[p : p + phrase], p)
    automaton.make_automaton()
    found = np.fromiter((x for hit in automaton.iter(text) for x in hit), np.int64).reshape(-1, 2)
    at, model = found[:, 0] - phrase + 1, found[:, 1]
    inside = words.room[at] >= phrase
    at, model = at[inside], model[inside]
    same = np.ones(len(at), bool)
    for k in range(phrase):  # compared word by word: letters may be shared
        same &= words.symbols[at + k] == words.symbols[model + k]
    return at[same]


def candidates(words: Words, places: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Starts of all windows that hold one of the places' phrases."""
    n = len(words.symbols)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.maximum(places - (window - phrase), words.starts[words.doc_of[places]]), 1)
    np.add.at(step, places + 1, -1)
    return np.flatnonzero((np.cumsum(step[:n]) > 0) & (words.room >= window))


#: The bucket of what a block tells itself.
OWN = -1


def ask_windows(block: Block, words: Words, at: np.ndarray, window: int, n: int) -> pa.RecordBatch:
    """One record per distinct window: its digest and the smallest id in the block; and to itself where each of them stands."""
    digests = words.digests(at, window)
    docs = words.docs[words.doc_of[at]]
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    sorted_ = digests[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
    number = np.empty(len(order), np.uint32)
    number[order] = np.cumsum(fresh) - 1
    distinct = sorted_[fresh]
    least = np.minimum.reduceat(block.ids[docs][order], np.flatnonzero(fresh))
    starts = (at - words.starts[words.doc_of[at]]).astype(np.int64)
    change = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    lengths = np.diff(np.append(change, len(at)))

    def payloads():
        for b, part in split_by_bucket(bucket_of(distinct[:, 0], n)):
            yield b, distinct[part].tobytes() + least[part].tobytes()
        head = np.array([len(at), len(change)], np.int64)
        yield OWN, head.tobytes() + docs[change].tobytes() + starts[change].tobytes() + lengths.tobytes() + number.tobytes()

    return messages(block.id, payloads())


def reduce_windows(payloads: list[bytes]) -> list[bytes]:
    """For each window of a block a bit: does a document with a smaller id than the block's own have it?"""
    counts = np.array([len(p) // 24 for p in payloads])
    pairs = list(zip(payloads, counts.tolist(), strict=True))
    digests = np.concatenate([np.frombuffer(p, np.uint64, 2 * c).reshape(-1, 2) for p, c in pairs])
    ids = np.concatenate([np.frombuffer(p, np.int64, c, 16 * c) for p, c in pairs])
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    digests = digests[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (digests[1:] != digests[:-1]).any(axis=1)
    starts = np.flatnonzero(fresh)
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.append(starts, len(ids))))
    smaller = np.split(least < ids, np.cumsum(counts)[:-1])
    return [np.uint32(len(x)).tobytes() + np.packbits(x).tobytes() for x in smaller]


def repeated(block: Block, own: bytes, answers: dict[int, bytes]) -> dict[int, np.ndarray]:
    """The starts, counted in words, of each document's windows that also start in a smaller document."""
    n, n_runs = np.frombuffer(own, np.int64, 2).tolist()
    docs, starts, lengths = (np.frombuffer(own, np.int64, n_runs, 16 + 8 * n_runs * k) for k in range(3))
    number = np.frombuffer(own, np.uint32, n, 16 + 24 * n_runs)
    smaller = [np.unpackbits(np.frombuffer(p, np.uint8, -1, 4), count=int(np.frombuffer(p, np.uint32, 1)[0])) for _, p in sorted(answers.items())]
    docs = np.repeat(docs, lengths)
    starts = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(n)
    ids = block.ids[docs]
    least = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids)
    hit = np.flatnonzero((np.concatenate(smaller)[number] > 0) | (ids > least[number]))
    by = np.argsort(docs[hit], kind="stable")
    docs, starts = docs[hit][by], starts[hit][by]
    return {d: starts[part] for d, part in split_by_bucket(docs)}


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, spans (removed runs of words), cut_text, kept_text, and with carry: row, carried.

    cut_text is the text without the spans, otherwise as it was: a span goes with the white space after it.
    kept_text has its words joined by one space. Words are maximal runs of bytes other than space and \\t to
    \\r. Null text: no words. Null id: later than every id, and kept null. Rows that repeat an id do not
    remove each other's words; equal rows stay as many as they are. An empty table gives an empty table.
    `carry` names columns that come back in the struct `row` in their own types, whatever their names, and
    as JSON in `carried`.
    """
    blocks = Blocks(docs, id_col, text_col, carry)
    n = blocks.buckets
    holders = first_holders(blocks)

    def active(row: dict) -> tuple[Block, np.ndarray, np.ndarray]:
        block = Block(row)
        first = first_ids(block, answers_of(row, "holders"), n)
        return block, first, np.flatnonzero((first == block.ids) & (block.ends - block.starts >= 2 * window - 1))

    def ask_phrases(batches):
        for row in rows_of(batches):
            block, _, which = active(row)
            words = Words(block, which, window)
            anchors, _, of = words.anchors(window, phrase)
            yield ask_anchors(block.id, anchors, words.docs[of] if len(of) else of, n)

    def locate(batches):
        for row in rows_of(batches):
            block, _, which = active(row)
            words = Words(block, which, window)
            anchors, places, of = words.anchors(window, phrase)
            recurring = recurring_anchors(anchors, words.docs[of] if len(of) else of, answers_of(row, "phrases"), n)
            kinds, first = np.unique(anchors, return_index=True)
            at = candidates(words, occurrences(words, places[first[np.isin(kinds, recurring, assume_unique=True)]], phrase), window, phrase)
            if len(at):
                yield ask_windows(block, words, at, window, n)

    def finish(batches):
        for row in rows_of(batches):
            block = Block(row)
            first = first_ids(block, answers_of(row, "holders"), n)
            own = answers_of(row, "own").get(OWN)
            yield _settle(block, first, repeated(block, own, answers_of(row, "windows")) if own else {}, window)

    phrases = blocks.exchange(blocks.attach(holders=holders).drop("carried").mapInArrow(ask_phrases, MESSAGE), reduce_anchors)
    asked = write_table(blocks.attach(holders=holders, phrases=phrases).drop("carried").mapInArrow(locate, MESSAGE), "windows")
    windows = blocks.exchange(asked.where(F.col("bucket") >= 0), reduce_windows)
    result = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("cut_text", T.StringType())])
    if blocks.carried:
        result = T.StructType([*result.fields, T.StructField("row", blocks.carried)])
    found = blocks.attach(holders=holders, windows=windows, own=asked.where(F.col("bucket") == OWN)).mapInArrow(finish, result)
    kept = F.regexp_replace(F.expr("trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM cut_text)"), "[\\x20\\x09-\\x0D]+", " ").alias("kept_text")
    more = [F.col("row"), F.to_json("row", {"ignoreNullFields": "false"}).alias("carried")] if blocks.carried else []
    return found.select("doc_id", "n_words", "spans", "cut_text", kept, *more)


def _settle(block: Block, first: np.ndarray, repeats: dict[int, np.ndarray], window: int) -> pa.RecordBatch:
    """The rows of a block, with what goes cut out of the texts."""
    counts, all_spans, texts = [], [], []
    for i in range(len(block)):
        text = block.text(i)
        starts, stops = word_edges(np.frombuffer(text + b" ", np.uint8))
        n, spans = len(starts), []
        if first[i] < block.ids[i] and n >= window:
            spans = [(0, n)]
        elif i in repeats:
            step = np.zeros(n + 1, np.int32)
            np.add.at(step, repeats[i], 1)
            np.add.at(step, repeats[i] + window, -1)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(step[:-1]) > 0).astype(np.int8), [0]]))).tolist()
            spans = list(zip(edges[::2], edges[1::2], strict=True))
        if spans:
            goes = [(int(starts[a]), int(starts[b]) if b < n else int(stops[n - 1])) for a, b in spans]
            text = b"".join(text[a:b] for a, b in zip([0, *[x[1] for x in goes]], [*[x[0] for x in goes], len(text)], strict=True))
        counts.append(n)
        all_spans.append([{"start": a, "stop": b} for a, b in spans])
        texts.append(text.decode("utf-8", "replace"))
    ids = pa.array(block.ids, mask=block.no_id)
    columns = [ids, pa.array(counts, pa.int64()), pa.array(all_spans, SPANS_ARROW), pa.array(texts, pa.string())]
    names = ["doc_id", "n_words", "spans", "cut_text"]
    return pa.RecordBatch.from_arrays(columns + ([block.carried] if block.carried is not None else []), names + ["row"] * (block.carried is not None))


def removed(spans: str = "spans") -> F.Column:
    """How many words the spans hold."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
