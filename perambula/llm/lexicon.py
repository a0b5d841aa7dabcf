"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus's frequent words are compiled, with their ids as outputs, into a minimal acyclic automaton: words
share prefixes and suffixes, and the numbers on a word's path add up to its place in the table of id
sequences. The automaton is a flat binary that each worker memory-maps. A word that it doesn't hold is
merged exactly by the ranks of the tokenizer's file. Which words the lexicon holds never changes a result.

Texts are cut at white space, which no token crosses; each distinct run is resolved once a batch.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perambula.llm.common import bound_batches, give_back, of_worker

#: Words in the lexicon at most, and the count from which a task reports a word.
LEXICON_WORDS = 50_000
REPORT_FROM = 4
#: Distinct runs that a worker remembers.
REMEMBER = 250_000
#: Texts are resolved together up to so many characters.
BATCH_CHARS = 4 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Merger:
    """Exact merges of one word, from a tokenizers BPE file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {tuple(m): k for k, m in enumerate(pairs)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()

    def merge(self, word: str) -> list[int]:
        parts = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.suffix
        ranks = self.ranks
        while len(parts) > 1:
            least, best = None, None
            for pair in zip(parts, parts[1:]):  # noqa: B905
                r = ranks.get(pair)
                if r is not None and (least is None or r < least):
                    least, best = r, pair
            if best is None:
                break
            a, b = best
            out, i, n = [], 0, len(parts)
            while i < n:
                if i + 1 < n and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.vocab[p] for p in parts]


#: Bytes from which a word is merged on its own: rounds over all words would take as many as it has.
LONG = 2048


class Merges:
    """The exact merges of many words at once.

    Symbols of all words stand in one array. Each round looks up all neighbouring pairs, merges in every
    word its pairs of least rank, from the left, and sets aside words that have none left.
    """

    NONE = np.int64(1) << 62

    def __init__(self, merger: Merger):
        vocab, self.wide = merger.vocab, np.int64(1 << 20)
        ordered = sorted(merger.ranks.items(), key=lambda x: x[1])
        self.pair = np.array([vocab[a] * int(self.wide) + vocab[b] for (a, b), _ in ordered] + [-1], np.int64)
        self.made = np.array([vocab[a + b] for (a, b), _ in ordered] + [-1], np.int64)
        self.inner = np.array([vocab[x] for x in merger.letters], np.int64)
        self.last = np.array([vocab[x + merger.suffix] for x in merger.letters], np.int64)
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left = np.arange(len(ordered))
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            if not len(left):
                break
            slot = self._slot(self.pair[left], np.uint64(factor))
            table = np.full(1 << 19, len(ordered), np.int64)
            table[slot[::-1]] = left[::-1]
            self.tables.append((np.uint64(factor), table))
            left = left[table[slot] != left]
        self.rest = {int(self.pair[i]): int(i) for i in left}
        self.rank_of: dict[int, int] = {}

    @staticmethod
    def _slot(keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((keys.astype(np.uint64) * factor) >> np.uint64(45)).astype(np.int64)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), self.NONE)
        for factor, table in self.tables:
            at = table[self._slot(keys, factor)]
            hit = self.pair[at] == keys
            found[hit] = at[hit]
        if self.rest:
            for i, k in enumerate(keys.tolist()):
                if k in self.rest:
                    found[i] = self.rest[k]
        return found

    def merge_one(self, flat: np.ndarray) -> np.ndarray:
        """One long word: a heap of (rank, place) over a linked list, in n log n steps."""
        if not self.rank_of:
            self.rank_of = {int(x): i for i, x in enumerate(self.pair[:-1])}
        rank_of, made, wide = self.rank_of, self.made, int(self.wide)
        ranks = self.ranks(flat[:-1] * self.wide + flat[1:])
        some = np.flatnonzero(ranks != self.NONE)
        heap = list(zip(ranks[some].tolist(), some.tolist(), strict=True))
        heapq.heapify(heap)
        symbol: list = flat.tolist()
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
        end = len(symbol)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < end:
                r = rank_of.get(symbol[i] * wide + symbol[after[i]])
                if r is not None:
                    heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if symbol[i] is None or after[i] >= end or rank_of.get(symbol[i] * wide + symbol[after[i]]) != r:
                continue  # one of the two has been merged since
            gone = after[i]
            symbol[i], symbol[gone] = int(made[r]), None
            after[i] = after[gone]
            if after[i] < end:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([x for x in symbol if x is not None], np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each has)."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        data = np.frombuffer(b"".join(coded), np.uint8)
        flat = self.inner[data]
        ends = np.cumsum(n)
        flat[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), n)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(n > LONG).tolist():
            ids = self.merge_one(flat[ends[k] - n[k] : ends[k]])
            done.append((np.full(len(ids), k), ids))
        if done:
            short = n[word] <= LONG
            flat, word = flat[short], word[short]
        while len(flat):
            rank = np.full(len(flat), self.NONE)
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside] = self.ranks(flat[inside] * self.wide + flat[inside + 1])
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(flat))))
            over = best == self.NONE
            if over.any():
                done.append((word[over], flat[over]))
                flat, word, rank, best = flat[~over], word[~over], rank[~over], best[~over]
                if not len(flat):
                    break
            chosen = rank == best
            at = np.flatnonzero(chosen)
            fresh = np.concatenate([[True], np.diff(at) > 1])  # of runs like a a a only every other pair
            offset = np.arange(len(at)) - np.repeat(np.flatnonzero(fresh), np.diff(np.append(np.flatnonzero(fresh), len(at))))
            at = at[offset % 2 == 0]
            flat[at] = self.made[rank[at]]
            keep = np.ones(len(flat), bool)
            keep[at + 1] = False
            flat, word = flat[keep], word[keep]
        if not done:
            return flat, n
        word = np.concatenate([w for w, _ in done])
        flat = np.concatenate([f for _, f in done])
        order = np.argsort(word, kind="stable")
        return flat[order], np.bincount(word, minlength=len(words))


class Splitter:
    """A run without white space to the words that are merged on their own, and special tokens as they are."""

    def __init__(self, specials: Iterable[str]):
        import re

        import regex

        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.marks = [s[0] for s in specials]

    def plain(self, run: str) -> list[str]:
        if run.isascii():
            run = run.lower()
            return [run] if run.isalpha() else self.word.findall(run)
        run = unicodedata.normalize("NFC", run)
        run = "".join([c.lower() for c in run]) if "Σ" in run else run.lower()
        return self.word.findall(run)

    MARKS = ".,;:!?%$#&*|)(\"-"

    def quick(self, run: str) -> list[str] | None:
        """As plain, of letters with marks at their end; None for other runs."""
        core = run if run.isalpha() else run.rstrip(self.MARKS)
        if not core.isalpha():
            return None
        tail = run[len(core) :]
        if not core.isascii():
            core = unicodedata.normalize("NFC", core)
            if "Σ" in core:
                return None
            core = core.lower()
            if not core.isalpha():
                return None
        else:
            core = core.lower()
        return [core, tail] if tail else [core]

    def split(self, run: str) -> list[tuple[str, bool]]:
        if self.special and any(m in run for m in self.marks) and self.special.search(run):
            out: list[tuple[str, bool]] = []
            for k, part in enumerate(self.special.split(run)):
                out += [(part, True)] if k % 2 else [(w, False) for w in self.plain(part)]
            return out
        return [(w, False) for w in self.plain(run)]


# The transducer ------------------------------------------------------------------------------


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """A minimal acyclic automaton over the words' UTF-8 bytes, built from the sorted words.

    Layout: counts; then, sorted by source state and byte, each arc's key (state * 256 + byte), target and
    skip (words that come before through smaller arcs); accepting states; the ends of the words' id
    sequences in sorted order; the ids.
    """
    keys = sorted({w.encode(): ids for w, ids in words.items() if w}.items())
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []  # (accepting, ((byte, target), ...))

    def settle(node: list) -> int:
        """The number of the state that equals node, whose children are settled."""
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs_of)
            arcs_of.append(key)
        return register[key]

    root: list = [False, []]
    path, before = [root], b""
    for word, _ in keys:
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        while len(path) - 1 > common:
            child = settle(path.pop())
            path[-1][1].append((before[len(path) - 1], child))
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        before = word
    while len(path) > 1:
        child = settle(path.pop())
        path[-1][1].append((before[len(path) - 1], child))
    top = settle(root)
    n = len(arcs_of)
    count = [0] * n  # words from each state on; children have smaller numbers
    for s, (final, arcs) in enumerate(arcs_of):
        count[s] = int(final) + sum(count[t] for _, t in arcs)
    key, target, skip = [], [], []
    for s, (final, arcs) in enumerate(arcs_of):
        passed = int(final)
        for b, t in arcs:
            key.append(s * 256 + b)
            target.append(t)
            skip.append(passed)
            passed += count[t]
    ids = [i for _, x in keys for i in x]
    parts = [
        np.array([n, len(key), len(keys), len(ids), top], np.int64),
        np.array(key, np.int64),
        np.array(target, np.int64),
        np.array(skip, np.int64),
        np.array([f for f, _ in arcs_of], np.int64),
        np.cumsum([len(x) for _, x in keys], dtype=np.int64),
        np.array(ids, np.int64),
    ]
    return b"".join(p.astype("<i8").tobytes() for p in parts)


class Lexicon:
    """The memory-mapped transducer; lookups go through all words of a batch byte by byte."""

    def __init__(self, image: bytes):
        fd, path = tempfile.mkstemp(prefix="lexicon-")
        with os.fdopen(fd, "wb") as f:
            f.write(image)
        self.image = np.memmap(path, np.int64, "r")
        os.unlink(path)  # the map keeps it
        n, arcs, words, ids, self.top = self.image[:5].tolist()
        cuts = np.cumsum([5, arcs, arcs, arcs, n, words, ids])
        self.key, self.target, self.skip, self.final, self.ends, self.ids = (self.image[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def find(self, words: list[str]) -> np.ndarray:
        """Each word's place in the sorted lexicon, or -1."""
        place = np.full(len(words), -1, np.int64)
        if not len(self.key) or not words:
            return place
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        order = np.argsort(-lengths, kind="stable")
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(coded), np.uint8)
        live, state, sums = order, np.full(len(words), self.top, np.int64), np.zeros(len(words), np.int64)
        k = 0
        while len(live):
            done = lengths[live] == k
            if done.any():
                ended = live[done]
                ok = self.final[state[ended]] == 1
                place[ended[ok]] = sums[ended[ok]]
                live = live[~done]
                if not len(live):
                    break
            want = state[live] * 256 + data[starts[live] + k]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            found = self.key[at] == want
            live, at = live[found], at[found]
            state[live] = self.target[at]
            sums[live] += self.skip[at]
            k += 1
        return place


# Encoding ------------------------------------------------------------------------------------

_ODD = "\x1c\x1d\x1e\x1f"  # str.split() cuts there, the tokenizer doesn't


def runs_of(text: str) -> list[str]:
    if any(c in text for c in _ODD):
        import re

        return [x for x in re.split("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+", text) if x]
    return text.split()


class Runs(dict):
    """Run to number; a new run gets the next one and waits in `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, run: str) -> int:
        self.new.append(run)
        found = self[run] = len(self)
        return found


class Encoder:
    """Runs to ids, remembered up to a bound; words are looked up in the lexicon, and merged if it lacks them."""

    def __init__(self, path: str, image: bytes, remember: int = REMEMBER):
        self.merger = Merger(path)
        self.merges = Merges(self.merger)
        self.splitter = Splitter(self.merger.specials)
        self.lexicon = Lexicon(image)
        names = {i: w for w, i in self.merger.vocab.items()} | {i: w for w, i in self.merger.specials.items()}
        coded = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.name_bytes = np.frombuffer(b"".join(coded), np.uint8)
        self.name_ends = np.cumsum([len(c) for c in coded])
        self.name_lengths = np.array([len(c) for c in coded], np.int64)
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        self.place = Runs()
        self.known: dict[str, tuple[int, int]] = {}  # words to start and length in pool
        self.pool, self.starts, self.lengths = array("I"), array("q"), array("q")

    def learn(self) -> None:
        """Ids of the runs that are new."""
        known, specials = self.known, self.merger.specials
        quick, split = self.splitter.quick, self.splitter.split
        cut = [quick(r) or split(r) for r in self.place.new]
        words = list({w for parts in cut for w in (parts if type(parts[0]) is str else [w for w, special in parts if not special]) if w not in known})
        if words:
            places = self.lexicon.find(words)
            inside = np.flatnonzero(places >= 0)
            ends = self.lexicon.ends
            for k, p in zip(inside.tolist(), places[inside].tolist(), strict=True):
                a, b = (int(ends[p - 1]) if p else 0), int(ends[p])
                known[words[k]] = (len(self.pool), b - a)
                self.pool.frombytes(self.lexicon.ids[a:b].astype(np.uint32).tobytes())
            unseen = [words[k] for k in np.flatnonzero(places < 0).tolist()]
            if unseen:
                flat, n = self.merges.merge(unseen)
                at = (np.cumsum(n) - n + len(self.pool)).tolist()
                self.pool.frombytes(flat.astype(np.uint32).tobytes())
                known.update(zip(unseen, zip(at, n.tolist(), strict=True), strict=True))
        pool, starts, lengths = self.pool, self.starts, self.lengths
        for parts in cut:
            if len(parts) == 1 and type(parts[0]) is str:
                start, n = known[parts[0]]
            else:
                start = len(pool)
                for part in parts:
                    w, special = (part, False) if type(part) is str else part
                    if special:
                        pool.append(specials[w])
                    else:
                        a, n = known[w]
                        pool.extend(pool[a : a + n])
                n = len(pool) - start
            starts.append(start)
            lengths.append(n)
        self.place.new = []
        if len(known) > self.remember:
            known.clear()

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """(ids, decoded text in UTF-8) of each text."""
        if len(self.place) > self.remember:
            self.forget()
        get = self.place.__getitem__
        parts = []
        for t in texts:
            runs = runs_of(t)
            parts.append(np.fromiter(map(get, runs), np.int64, len(runs)))
        self.learn()
        starts, lengths, pool = np.array(self.starts, np.int64), np.array(self.lengths, np.int64), np.array(self.pool, np.uint32)
        for where in parts:
            n = lengths[where]
            stop = np.cumsum(n)
            ids = pool[np.repeat(starts[where] - stop + n, n) + np.arange(int(stop[-1]) if len(stop) else 0)]
            yield ids, self.decode(ids)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' names with a space between them, as a tokenizer without a decoder joins them."""
        n = self.name_lengths[ids]
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        return self.name_bytes[np.repeat(self.name_ends[ids] - stop, n) + np.arange(total)].tobytes()[:-1]


def grouped(batches: Iterator[pa.RecordBatch], chars: int = BATCH_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Rows of (id, text) in groups of about so many characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def frequent_words(docs: DataFrame, path: str, most: int = LEXICON_WORDS, report_from: int = REPORT_FROM) -> list[str]:
    """The words with the largest counts over all documents; a task leaves out runs it has met fewer than report_from times."""
    special = list(Merger(path).specials)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(special)
        runs: Counter = Counter()

        def words() -> pa.RecordBatch:
            found: Counter = Counter()
            for run, n in runs.items():
                if n >= report_from:
                    for w, mark in splitter.split(run):
                        if not mark:
                            found[w] += n
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                runs.update(runs_of(t.as_py() or ""))
                if len(runs) > 2 * REMEMBER:
                    yield words()
                    runs.clear()
        yield words()

    counted = docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r[0] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]  # `most` words


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("decoded", T.StringType(), False)])
ENCODED_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("decoded", pa.string())])


def encode_and_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Per row: doc_id, ids (little-endian unsigned 32-bit), n_tokens, decoded.

    Null and empty texts have no ids and decode to an empty text. Null ids and repeated rows are kept. Only
    the two named columns are read, whatever else there is. An empty table gives an empty lexicon and no row.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    merger = Merger(tokenizer_path)
    words = frequent_words(src.select("text"), tokenizer_path, lexicon_words)
    image = docs.sparkSession.sparkContext.broadcast(compile_lexicon({w: merger.merge(w) for w in words}))

    job = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = of_worker(("encoder",), dict)  # the last job's only
        if job not in kept:
            kept.clear()
            kept[job] = Encoder(tokenizer_path, image.value)
        encoder = kept[job]
        for ids, texts in grouped(batches):
            found = list(encoder.encode(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([len(x) for x, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary()).cast(pa.string())],
                schema=ENCODED_ARROW,
            )
        encoder.forget()
        give_back()

    return src.mapInArrow(run, ENCODED)
