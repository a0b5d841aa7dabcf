"""Every operator against a brute-force version, on tables with nulls, ties, repeated rows and odd texts."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from perambula.llm import common, html_text, lexicon, packing, phrases, quality, queries, simhash, suffixes, token_files, vectors, warc
from perambula.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, ties, nulls, long and odd texts."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)] + ["é", "ß,", "Ünï", "日本", "a.b", "|", "%%%"]

    def some(n):
        return " ".join(rng.choice(words, n))

    passage, line = some(70), some(12)
    base = some(300)
    rows = [(i, some(int(rng.integers(1, 120)))) for i in range(60)]
    rows += [(100 + i, base) for i in range(15)]  # copies
    for i in range(15):  # near copies
        w = base.split(" ")
        w[int(rng.integers(0, 300))] = "edit"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, f"{some(30)}\n{passage} {some(20)}\t{line}\n{line}") for i in range(12)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "one"), (404, "x " * 3000), (405, passage), (405, passage), (406, base + "  " + passage), (None, passage), (None, base), (407, "Don't STOP, it's <|endoftext|> a\xa0b\x1cc\r\n")]
    rows += [(408, "a" * 5000), (409, "ab" * 2000 + "é" * 300), (410, "the same line\n" * 40)]
    rows += [(411, "f of the leaf f"), (412, "\x0cform\x0bfeed \x0cf\x0c"), (413, f"f {passage} of"), (414, passage + " half")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{k % 3}", None, k) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block_id string, bucket string, fp long").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def key(i):
    return float("inf") if i is None else i


def covered(items: list[tuple], width: int) -> list[list[bool]]:
    """Which parts of each sequence a window covers that also starts under a smaller id."""
    first: dict = {}
    for i, seq in items:
        for k in range(len(seq) - width + 1):
            w = tuple(seq[k : k + width])
            first[w] = min(first.get(w, float("inf")), key(i))
    out = []
    for i, seq in items:
        gone = [False] * len(seq)
        for k in range(len(seq) - width + 1):
            if first[tuple(seq[k : k + width])] < key(i):
                gone[k : k + width] = [True] * width
        out.append(gone)
    return out


def test_substring_dedup_on_words(docs, empty):
    items = [(i, WORD.findall(t or "")) for i, t in texts()]
    want = sorted((str(i), len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y)) for (i, w), g in zip(items, covered(items, 50), strict=True))
    rows = phrases.remove_repeated_passages(docs, carry=["lang", "block_id", "bucket", "fp"])
    got = rows.select("doc_id", "n_words", phrases.removed().alias("r"), "kept_text").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert sum(r[2] > 0 for r in got) > 30
    carried = rows.select(F.get_json_object("carried", "$.fp").cast("long")).collect()
    assert sorted(r[0] for r in carried) == list(range(len(items)))
    assert phrases.remove_repeated_passages(empty).count() == 0


@pytest.mark.parametrize("hot", [64, 1])
def test_substring_dedup_on_bytes(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    items = [(i, (t or "").encode()) for i, t in texts()]
    want = []
    for (i, b), g in zip(items, covered(items, 50), strict=True):
        runs = sum(y and (k == 0 or not g[k - 1]) for k, y in enumerate(g))
        want.append((str(i), len(b), sum(g), runs, bytes(x for x, y in zip(b, g, strict=True) if not y)))
    got = suffixes.remove_repeated_bytes(docs).select("doc_id", "n_bytes", suffixes.removed().alias("r"), F.size("spans"), "kept").collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], bytes(r[4])) for r in got) == sorted(want)
    assert suffixes.remove_repeated_bytes(empty).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for _ in range(150):
        k = int(rng.choice([1, 2, 4, 30, 3000]))
        s = [*rng.integers(1, k + 1, int(rng.integers(1, 80))).tolist(), 0]
        order = suffixes.suffix_array(np.array(s, np.int64), k + 1).tolist()
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        shared = suffixes.common_prefixes(np.array(s, np.int64), np.array(order), 9)
        for a, b in zip(order[1:], order, strict=False):
            n = 0
            while n < 9 and max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert shared[a] == n


def test_block_ids_fall_into_one_bucket(spark):
    for n in (1, 7, 49, 211):
        ids = [0, 1, -1, 5, 1 << 40, (3 << 36) + 17, -(1 << 62)]
        df = spark.createDataFrame([(i,) for i in ids], "i long")
        want = {r.i: r.b for r in df.select("i", F.expr(f"pmod(hash(i), {n})").alias("b")).collect()}
        assert dict(zip(ids, common.spark_bucket(np.array(ids), n).tolist(), strict=True)) == want
        names = common.ids_in_one_bucket(5, n)
        assert {int(x) for x in common.spark_bucket(np.array([next(names) for _ in range(20)]), n)} == {5 % n}


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def test_simhash(docs, empty):
    rows = texts()
    fps = [brute_fingerprint(t) for _, t in rows]
    of = groups(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    least: dict = {}
    for (i, _), g in zip(rows, of, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted((str(i), fp, least.get(g)) for (i, _), fp, g in zip(rows, fps, of, strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_link_group_cuts_large_groups(monkeypatch):
    rng = np.random.default_rng(3)
    base = np.uint64(0xABCDEF0123456789)
    fps = np.unique(np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(32, int(rng.integers(0, 6)), replace=False))) for _ in range(300)], np.uint64))
    exact = np.ones(len(fps), bool)

    def joined(edges):
        return len(set(groups(len(fps), lambda a, b: (int(fps[a]), int(fps[b])) in edges)))

    both = lambda e: set(e) | {(b, a) for a, b in e}
    whole = joined(both(simhash.link_group(fps, exact, 1)))
    monkeypatch.setattr(simhash, "LARGE", 10)
    assert joined(both(simhash.link_group(fps, exact, 1))) == whole


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    df = spark.createDataFrame(edges + [(None, 1)], "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    pairs = {*edges, *[(b, a) for a, b in edges]}
    of = groups(len(nodes), lambda a, b: (nodes[a], nodes[b]) in pairs)
    assert got == {n: nodes[g] for n, g in zip(nodes, of, strict=True)}
    assert components(df.limit(0)).count() == 0


def test_quality_counts(spark, docs, empty):
    trusted = docs.where("doc_id < 30").select("doc_id")
    got = {(r.doc.fp): r for r in quality.quality_rules(docs, trusted).collect()}
    for k, (_, t) in enumerate(texts()):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        times = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        mark = [0] * len(w)
        for i in range(len(w) - 2):
            if times[tuple(w[i : i + 3])] > 1:
                mark[i : i + 3] = [1] * 3
        r, n = got[k], sum(mark)
        failed = len(w) < 50 or 100 * n > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n, failed), k
        assert r.kept == (not failed and r.score >= quality.THRESHOLD)
    assert quality.quality_rules(empty, trusted).count() == 0
    assert all(r.score in (None, 0.0) for r in quality.quality_rules(docs, trusted.limit(0)).collect())


def test_quality_score_against_brute_force(docs):
    """Hashed words and pairs, both multinomials, folds, the raise and the verdict, all made again in Python."""
    import math

    n, rows = quality.FEATURES, texts()
    hashed = lambda *w: xxhash.xxh64_intdigest(w[-1].encode(), hashed(*w[:-1]) if len(w) > 1 else 42)
    words = [WORD.findall(t or "") for _, t in rows]
    feats = [[hashed(x) % n for x in w] + [hashed(a, b) % n for a, b in zip(w, w[1:], strict=False)] for w in words]
    fold = lambda i: xxhash.xxh64_intdigest(int(i).to_bytes(8, "little"), hashed("fold")) % quality.FOLDS
    trusted = [k for k, (i, _) in enumerate(rows) if i is not None and (i < 40 or 300 <= i < 306)]
    corpus = np.bincount([f for fs in feats for f in fs], minlength=n)
    share = (corpus + 1) / (corpus.sum() + n)

    def ratio(members):
        target = np.bincount([f for k in members for f in feats[k]], minlength=n)
        return np.log((target + 0.1 * target.sum() * share) / (1.1 * target.sum()) / share)

    got = {r.doc.fp: r for r in quality.quality_rules(docs, docs.where("doc_id < 40 or doc_id between 300 and 305").select("doc_id")).collect()}
    own = [ratio([j for j in trusted if fold(rows[j][0]) != fold(rows[k][0])])[feats[k]].mean() for k in trusted if not got[k].base_failed]
    low = sorted(own)[max(0, math.ceil(quality.QUANTILE * len(own)) - 1)]
    weight, raised = ratio(trusted), max(0.0, quality.THRESHOLD - low)
    assert raised > 0
    for k, fs in enumerate(feats):
        if not got[k].base_failed:
            want = weight[fs].mean() + raised
            assert abs(got[k].score - want) < 1e-4 and got[k].kept == (want >= quality.THRESHOLD)


@pytest.mark.parametrize("broadcast", [10**9, 0])
def test_quality_fits_and_holds_out_every_trusted_document(spark, monkeypatch, broadcast):
    """Texts that only those 200 of 20,200 trusted documents have whose ids' hashes are the greatest."""
    monkeypatch.setattr(quality, "BROADCAST_MOST", broadcast, raising=False)
    ranked = [r.id for r in spark.range(20_200).orderBy(F.xxhash64("id"), "id").collect()]
    rare = set(ranked[20_000:])
    plain, other = " ".join(f"w{k}" for k in range(50)), " ".join(f"r{k}" for k in range(50))
    docs = spark.createDataFrame([(i, other if i in rare else plain) for i in range(20_200)], "doc_id long, text string")
    rows = quality.quality_rules(docs, docs.select("doc_id")).groupBy("kept").count().collect()
    assert {r["kept"]: r["count"] for r in rows} == {True: 20_200}


def test_quality_separates_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (queries.table(spark, sf, n) for n in ("documents", "labels"))
    fit = labels.where("doc_id % 2 = 0")
    rows = quality.quality_rules(docs, quality.trusted_documents(fit)).select("doc.doc_id", "base_failed", "kept").join(labels.where("doc_id % 2 = 1"), "doc_id")
    kept = {r.quality: r.share for r in rows.where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.99 and kept[0] < 0.3


def test_quality_with_few_labels(spark):
    """Some 300 labels tell junk from clean documents as thousands do, and a handful rejects no clean one."""
    for sf, most in (("sf0.01", None), ("sf0.1", 300), ("sf0.01", 10)):
        docs, labels = (queries.table(spark, f"/root/testdata/{sf}", n) for n in ("documents", "labels"))
        trusted = quality.trusted_documents(labels)
        rows = quality.quality_rules(docs, trusted.orderBy("doc_id").limit(most) if most else trusted)
        rows = rows.select("doc.doc_id", "base_failed", "kept").join(labels, "doc_id").where("not base_failed and (quality = 0 or toxic = 0)")
        kept = {r.quality: r.share for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
        assert kept[1] > 0.97, (sf, most, kept)
        assert most == 10 or kept[0] < 0.15, (sf, most, kept)


def test_packing(docs, empty):
    lengths = docs.select("doc_id", F.when(F.col("fp") % 7 == 0, None).otherwise(F.length("text")).cast("long").alias("n"), "bucket")
    rows = packing.pack_documents(lengths, "n", group_tokens=4000).collect()
    total = lengths.agg(F.sum("n")).first()[0]
    assert sum(r.n_tokens for r in rows) == total
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        used = sum(r.n_tokens for r in b)
        size = b[0].bin_capacity
        assert used <= size and size == min(c for c in packing.CAPACITIES if c >= used)
        ends = sorted((r.bin_offset, r.bin_offset + r.n_tokens) for r in b)
        assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:], strict=False))
    assert sum(b[0].bin_capacity for b in bins.values()) < 1.3 * total
    assert packing.pack_documents(empty.select("doc_id", F.lit(1).alias("n")), "n").count() == 0


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, sizes = packing.pack(np.array([60, 50, 40, 30, 10, 0]), (64, 100))
    assert bins.tolist()[:3] == [0, 1, 0] and offsets.tolist()[2] == 60
    assert sum(sizes) <= 264 and packing.pack(np.array([], np.int64))[2] == []


def brute_pack(lengths, sizes, cost, opening):
    """Best fit by looking at every bin for every piece."""
    rooms, bins, left = [], {}, sum(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = [(room, b) for b, (room, _) in enumerate(rooms) if room >= n > 0 or (n == 0 and room > 0)]
        if fits:
            b = min(fits)[1]
        else:
            b = len(rooms)
            rooms.append((opening(n, max(left, 1), sizes, cost), 0))
        room, used = rooms[b]
        bins[i] = (b, used)
        rooms[b] = (room - n, used + n)
        left -= n
    return [bins[i] for i in range(len(lengths))], [next(c for c in sizes if c >= used) for _, used in rooms]


def test_best_fit_against_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(60):
        lengths = rng.integers(0, 101, int(rng.integers(1, 60)))
        costs = []
        for opening in (packing.opening_size, *map(packing.at_least, (25, 50, 100))):
            bins, offsets, sizes = packing.pack(lengths, (25, 50, 100), 4, opening)
            places, want = brute_pack(lengths.tolist(), [25, 50, 100], 4, opening)
            assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == places and sizes == want
            costs.append(sum(sizes) + 4 * len(sizes))
        assert sum(x := packing.cheapest(lengths, (25, 50, 100), 4)[2]) + 4 * len(x) == min(costs)


def test_packed_sequences(spark, docs, empty):
    """Ids of all rows, those that share an id or have none included, come back whole; copies lie in many groups."""
    import public_tokenizers

    path = queries.tokenizer("byte_bpe_50k.tiktoken")
    whole = packing.Tokenizer(path, public_tokenizers.PATTERN)
    rows = [(i, t) for i, t in texts()] + [(None, "copy")] * 40 + [(7, "copy")] * 40 + [(500, "a" * 300_000), (501, "x \n" * 100_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(4)
    got = packing.pack_texts(df, path, public_tokenizers.PATTERN, 50256, group_tokens=4000).collect()
    pieces = collections.Counter()
    for r in got:
        ids = np.frombuffer(r.ids, "<u2")
        assert r.n_tokens == sum(r.lengths) == len(ids) <= r.bin_capacity == min(c for c in packing.CAPACITIES if c >= r.n_tokens)
        pieces.update((d, p, tuple(ids[a : a + n].tolist())) for d, p, a, n in zip(r.doc_ids, r.pieces, r.offsets, r.lengths, strict=True))
    want = collections.Counter()
    for i, t in rows:
        ids = [*whole.encode(t or "").tolist(), 50256]
        want.update((i, k // 4096, tuple(ids[k : k + 4096])) for k in range(0, len(ids), 4096))
    assert pieces == want
    assert len({r.bin_id >> 32 for r in got if None in r.doc_ids}) > 1
    assert packing.pack_texts(empty, path, public_tokenizers.PATTERN, 50256).count() == 0


def test_token_length(docs):
    got = {r.fp: r.n for r in docs.select("fp", packing.token_length("text").alias("n")).collect()}
    assert got == {k: len(WORD.findall(t or "")) + 1 for k, (_, t) in enumerate(texts())}


def tokenizer(name):
    from tokenizers import Tokenizer

    return queries.tokenizer(name), Tokenizer.from_file(queries.tokenizer(name))


def test_token_files(docs, empty):
    path, t = tokenizer("byte_bpe_50k.json")
    rows = sorted(((i, x) for i, x in texts() if i is not None), key=lambda r: r[0])
    got = token_files.round_trip(docs.where("doc_id is not null"), path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    at = 0
    for r, (_, text) in zip(got, rows, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.round_trip(docs.where("doc_id is null"), path).count() == 2
    assert token_files.round_trip(empty, path).count() == 0


def test_coder():
    rng = np.random.default_rng(4)
    counts = np.zeros(5000, np.int64)
    ids = np.minimum(rng.geometric(0.01, 60_000), 4999)
    np.add.at(counts, ids, 1)
    table = token_files.Table(counts)
    assert int(table.freq.sum()) == 1 << token_files.SCALE_BITS
    for n in (0, 1, 63, 64, 65, 60_000):
        block = table.encode(ids[:n], 64, 16)
        assert (table.decode(block) == ids[:n]).all()
    assert (table.decode(block, 3, 2) == ids[3 * 1024 : 5 * 1024]).all()
    entropy = -(counts[counts > 0] / 60_000 * np.log2(counts[counts > 0] / 60_000)).sum() / 8 * 60_000
    plain = table.encode(ids, 64, 1 << 20)
    assert len(plain) < 1.02 * entropy + 1500
    broken = bytearray(block)
    broken[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        table.decode(bytes(broken))
    with pytest.raises(ValueError, match="does not have"):
        table.encode(np.array([4999]) if not counts[4999] else np.flatnonzero(counts == 0)[:1])


def test_transducer_bpe(docs, empty):
    path, t = tokenizer("word_bpe_49k.json")
    got = {}
    rows = lexicon.encode_and_decode(docs.withColumn("doc_id", F.col("fp")), path, lexicon_words=300).collect()
    got = {r.doc_id: r for r in rows}
    for k, (_, text) in enumerate(texts()):
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = got[k]
        assert (r.n_tokens, bytes(r.ids), r.decoded) == (len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)), text
    assert lexicon.encode_and_decode(empty, path).count() == 0


def test_transducer_bpe_of_nulls_and_repeated_ids(spark, docs):
    """Rows that share an id, equal rows and null ids are rows of their own; columns named like results are left alone."""
    path, t = tokenizer("word_bpe_49k.json")
    named = docs.select("doc_id", "text", F.col("lang").alias("ids"), F.col("fp").alias("n_tokens"))
    got = sorted((str(r.doc_id), bytes(r.ids)) for r in lexicon.encode_and_decode(named, path, lexicon_words=50).collect())
    assert got == sorted((str(i), np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, x in texts())


def test_merges_of_a_very_long_word():
    """A word of a megabyte takes seconds, and the ids of the library."""
    import time

    path, t = tokenizer("word_bpe_49k.json")
    merges = lexicon.Merges(lexicon.Merger(path))
    rng = np.random.default_rng(3)
    word = "".join(rng.choice(list("abcdefghiéß"), 1 << 20))
    began = time.perf_counter()
    flat, n = merges.merge(["short", word, "a" * 5000, "é" * 3000, "x"])
    assert time.perf_counter() - began < 60
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [t.encode(w, add_special_tokens=False).ids for w in ("short", word, "a" * 5000, "é" * 3000, "x")]


def test_lexicon_is_minimal_and_merges_agree():
    path, _ = tokenizer("word_bpe_49k.json")
    merger = lexicon.Merger(path)
    words = ["nation", "station", "nations", "stations", "ration", "été", "a"]
    found = lexicon.Lexicon(lexicon.compile_lexicon({w: merger.merge(w) for w in words}))
    order = sorted(words, key=str.encode)
    assert found.find([*words, "nat", "", "zzz"]).tolist() == [order.index(w) for w in words] + [-1] * 3
    for w in words:
        p = int(found.find([w])[0])
        assert found.ids[found.ends[p - 1] if p else 0 : found.ends[p]].tolist() == merger.merge(w)
    assert len(found.final) < sum(map(len, words))  # suffixes are shared
    some = ["aaaa", "aaaaaaa", "hahaha", "internationalization", "été", "日本", "x"]
    flat, n = lexicon.Merges(merger).merge(some)
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [merger.merge(w) for w in some]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><p>x";</script><style>p{}</style></head><body>
<nav><ul><li><a href=/>Home of the best</a></li></ul></nav><div class="cookie-notice">We use the cookies of this and that to be of help to you and your own.</div>
<article><header><h1>The  heading &amp; more</h1></header><p>This is the first of the paragraphs that are in the article and it is as long as it has to be for that.<br>Next line
<p>Short.</p><aside><p>See the other pages of this site, and all of the links that are on them too.</p></aside>
<p>Then the last of the paragraphs is here, and it is also as long as it has to be, so it stays &eacute;&#233;.</p></article>
<section id="comments"><p>I think that this is the best of the articles that are on this site, so it is.</p></section>
<form><p>Name of the user and the password that is to be in it for all of us</p></form><footer>&copy; of the site and the people in it for all of the time that is</footer></body>"""


def test_main_text(spark):
    want = "The heading & more\n\nThis is the first of the paragraphs that are in the article and it is as long as it has to be for that. Next line\n\nShort.\n\nThen the last of the paragraphs is here, and it is also as long as it has to be, so it stays éé."
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, None), (2, "u", "", None), (2, "u", "<p>Only this.", None), (3, "u", "<div>" * 3000 + "deep and the rest of it" + "<p>a" * 3000, None)], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract_main_text(pages).collect()]
    assert got[0] == (1, want, len(want))
    assert got[1:4] == [(None, "", 0), (2, "", 0), (2, "Only this.", 10)]
    assert got[4][1].startswith("deep")
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


LONG = "This is a paragraph of the article that is about as long as it has to be, and it has many of the words that are in all texts."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body class="home has-sidebar"><p>{LONG}</p></body>', LONG),
        (f'<article class="post comments-open"><p>{LONG}</p></article>', LONG),
        (f'<main class="site-content header-fixed"><p>{LONG}</p></main>', LONG),
        (f'<div class="market-share"><p>{LONG}</p></div>', LONG),
        (f'<div class="share"><p>{LONG}</p></div>', LONG),
        (f"<a name=top><p>{LONG}</p>", LONG),
        (f'<p><a href="/x">a link that is never closed</p><p>{LONG}</p>', LONG),
        (f"<p>{'İ' * 60}</p><button>x</button><p>{LONG}</p>", f"{'İ' * 60}\n\n{LONG}"),
        (f"<p>{LONG}</p><div><a href=http://x.org/>some links to the other pages that are on this site and on all of the others</a></div>", LONG),
        (f"<article><p>{LONG}</p></article><div>{'cheap pills casino ' * 9}</div>", LONG),
        (f"<article><p>{LONG}</p><p>Anna Berta Carl Dora Emil Fritz Gerd Hans Ida Jan Karl Lena Mia</p><p>{LONG}</p></article>", f"{LONG}\n\nAnna Berta Carl Dora Emil Fritz Gerd Hans Ida Jan Karl Lena Mia\n\n{LONG}"),
        (f'<article><p>{LONG}</p></article><div id="comments"><article class="comment-body"><p>{LONG} I think.</p></article></div>', LONG),
        (f'<div class="page"><div class="menu left"><p>{LONG}</p></div><article><p>{LONG} Yes.</p></article></div>', f"{LONG} Yes."),
        (f"<P>{LONG}</P><SCRIPT>if (a < b) x()</Script ><p>{LONG}", f"{LONG}\n\n{LONG}"),
        ("<p>短い日本語のページです。</p>", "短い日本語のページです。"),
    ],
)
def test_main_text_by_density(page, want):
    assert html_text.main_text(page) == want


def test_second_pass_against_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(400):
        n = int(rng.integers(0, 9))
        labels, containers, headings = rng.choice([1, 0, -1, -1, 2], n).tolist(), rng.integers(0, 3, n).tolist(), (rng.random(n) < 0.3).tolist()
        want = []
        for i, x in enumerate(labels):
            left = [k for k in range(i) if labels[k] in (0, 1)][-1:]
            right = [k for k in range(i + 1, n) if labels[k] in (0, 1)][:1]
            good = [k for k in left + right if labels[k] == 1]
            home = [k for k in good if containers[k] == containers[i]]
            if x in (0, 1):
                want.append(x == 1)
            elif x == 2:
                want.append(bool(home))
            else:
                want.append(good == left + right or bool(home) or (headings[i] and bool(right) and right[0] in good))
        assert html_text.second_pass(labels, containers, headings) == want


def test_main_text_of_a_very_long_page(spark):
    """A page larger than an Arrow batch, in one block and in many."""
    one, many = f"<p>{LONG * 40_000}</p>", f"<p>{LONG}</p>" * 40_000
    pages = spark.createDataFrame([(1, "u", one, "a"), (2, "u", many, "b")], "page_id long, url string, html string, n_chars string")
    got = {r.page_id: r.text for r in html_text.extract_main_text(pages).collect()}
    assert got == {1: LONG * 40_000, 2: "\n\n".join([LONG] * 40_000)}


def test_main_text_of_all_pages(spark):
    """Pages of the test table hold their text in one article element."""
    import html

    rows = queries.op1_html_extraction(spark, "/root/testdata/sf0.01").collect()
    pages = {r.page_id: r.html for r in queries.table(spark, "/root/testdata/sf0.01", "pages").collect()}
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p)


def test_warc(spark):
    big = "x" * 700_000
    rows = [(1, "a", "p" * 999), (2, "b", "p" * 999), (3, "c", "é" * 600), (4, "d", "é" * 600), (5, None, None), (6, "e\r\nf", big), (7, "g", big), (8, "h", "é" * 600), (7, "g", big), (None, "i", "é" * 600)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        largest = max(j for j, _, o in rows if j is not None and (o or "").encode() == b)
        revisit = len(b) >= 1000 and (i is None or i < largest)
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", largest if revisit else None))
    assert got == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_rows_make_a_file_and_damage_is_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "hello" * 300)], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w", chunk_bytes=256)
    chunks = spark.read.parquet(f"file://{tmp_path}/w")
    rows = chunks.collect()
    assert max(len(r.data) for r in rows if r.chunk_no) <= 256
    whole = warc.warc_bytes(rows)
    head, _, rest = whole.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\n") and rest == b"hello" * 300 + b"\r\n\r\n"
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(chunks.where("chunk_no <> 2")).collect()


def vector_rows():
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1, None):
        centres = rng.normal(size=(12, 16))
        for k in range(90):
            v = centres[k % 12] + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.4])
            rows.append((v.tolist(), label))
    rows += [(rows[0][0], 0)] * 5 + [([0.0] * 16, 0), (None, 0), ([float("nan")] * 16, 1), ([None] + [1.0] * 15, 1), ([1.0, 2.0], 0), ([], 0), ([float("inf")] + [0.0] * 15, 0)]
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("one_shard", [6000, 20])
def test_near_vectors(spark, monkeypatch, one_shard):
    monkeypatch.setattr(vectors, "ONE_SHARD", one_shard)
    monkeypatch.setattr(vectors, "SHARD", 40)
    rows = vector_rows()
    good = [v is not None and len(v) > 0 and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]

    def near(a, b):
        if not (good[a] and good[b]) or rows[a][2] != rows[b][2] or len(rows[a][1]) != len(rows[b][1]):
            return False
        x, y = np.array(rows[a][1]), np.array(rows[b][1])
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    links = [sum(near(a, b) for b in range(len(rows)) if b != a) for a in range(len(rows))]
    found = sum(got[i].n_links for i in range(len(rows)))
    assert all(got[i].n_links <= links[i] for i in range(len(rows))) and found >= 0.97 * sum(links)
    if one_shard == 6000:
        assert [got[i].n_links for i in range(len(rows))] == links
        assert [got[i].component_id for i in range(len(rows))] == groups(len(rows), near)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.05], 0), (None, [1.0, 0.0], 0), (None, [-1.0, 0.0], 0), (4, [-1.0, -0.01], 0)]
    df = spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], "vec_id long, embedding array<double>, label int, class_id string")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in vectors.near_vectors(df).collect())
    assert got == sorted([("1", 3, "1", True), ("1", 3, "1", True), ("1", 0, "1", True), ("2", 3, "1", False), ("None", 3, "1", False), ("None", 1, "4", False), ("4", 1, "4", True)])


def test_near_vectors_finds_every_pair_of_a_large_label(spark, monkeypatch):
    """Loose vectors with a near copy each, and a dense group: links and components are those of brute force."""
    for name, value in (("ONE_SHARD", 200), ("SHARD", 20), ("BLOCK", 50)):
        monkeypatch.setattr(vectors, name, value, raising=False)
    rng = np.random.default_rng(7)
    turn = lambda x, c: c * x + np.sqrt(1 - c * c) * rng.normal(size=x.shape) / np.sqrt(x.shape[-1])
    loose = rng.normal(size=(400, 32))
    loose /= np.linalg.norm(loose, axis=1, keepdims=True)
    rows = np.concatenate([loose, turn(loose, 0.95), turn(np.repeat(loose[:1], 300, axis=0), 0.97)])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    want = [(i, int(near[i].sum()), g) for i, g in enumerate(groups(len(rows), lambda a, b: near[a, b]))]
    assert sum(w[1] for w in want) > 10_000
    for visits in (1000, 1):
        monkeypatch.setattr(vectors, "VISITS", visits, raising=False)
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()) == want


def test_near_vectors_finds_every_pair_of_one_shard(spark):
    """Few links for each vector: an audit of some vectors sees next to none of what is missed."""
    rng = np.random.default_rng(2)
    loose, turn = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(2500, 64)), rng.normal(size=(2500, 64))))
    rows = np.concatenate([loose, 0.945 * loose + np.sqrt(1 - 0.945**2) * turn])
    near = vectors.unit(rows) @ vectors.unit(rows).T >= 0.93
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links) for r in vectors.near_vectors(df).collect())
    assert got == [(i, int(n) - 1) for i, n in enumerate(near.sum(axis=1))]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, name):
    import oracle

    assert oracle.differences(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLES[name]) == []


def test_token_files_are_read_by_another_session(spark, docs):
    """Only the folder is handed over; parts of the corpus are decoded from checkpoints."""
    path, t = tokenizer("byte_bpe_50k.json")
    folder = common.new_path(spark, "rans")
    tokens = common.write_table(token_files.tokenize(docs.where("doc_id is not null"), path), "tokens")
    token_files.write_files(tokens, folder, t.get_vocab_size(), block_tokens=3000)
    other = spark.newSession()
    files = token_files.TokenFiles.open(other, folder)
    rows = token_files.read_files(other, files).orderBy("start").collect()
    whole = b"".join(bytes(r.ids) for r in rows)
    assert len(rows) == docs.where("doc_id is not null").count()
    for first, n in ((0, 10), (1234, 5000), (len(whole) // 4 - 3, 3)):
        parts = sorted((r.start, bytes(r.ids)) for r in token_files.read_range(other, files, first, n).collect())
        assert b"".join(p for _, p in parts) == whole[4 * first : 4 * (first + n)]
    damaged = bytearray(files.table.to_bytes())
    damaged[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.Table.from_bytes(bytes(damaged))


def test_tokens_remember_a_quarter_of_a_million_pieces():
    import public_tokenizers

    tokens = token_files.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    text = " ".join(f"p{k}" for k in range(250_000))
    first = tokens.encode([text])[0]
    known = tokens.place
    again = tokens.encode([text])[0]
    assert tokens.place is known and len(known) == 249_999 and (first == again).all()
    assert first[:2000].tolist() == tokens.model.encode(text[:20_000], add_special_tokens=False).ids[:2000]


def test_tokens_keep_what_is_met_again():
    """With room for few pieces, ids stay those of the library, and frequent pieces stay."""
    path, t = tokenizer("byte_bpe_50k.json")
    tokens = token_files.Tokens(path, most=200)
    rng = np.random.default_rng(5)
    for k in range(30):
        some = [" ".join(["the", "house", *(f"u{x}." for x in rng.integers(0, 10**6, 60)), "the"]) for _ in range(3)]
        flat, ends = tokens.encode(some)
        assert [x.tolist() for x in np.split(flat, ends[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in some]
    assert len(tokens.place) < 800 and "house" in tokens.place


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts larger than a block and an Arrow batch: one, a part of it in a small text, a copy, one without spaces."""
    words = [f"w{i}" for i in range(700_000)]
    rows = [(1, " ".join(words)), (2, "start " + " ".join(words[1000:1060]) + " end " + " ".join(words[5:30])), (3, " ".join(words)), (4, "ab" * 2_600_000)]
    assert min(len(rows[k][1]) for k in (0, 2, 3)) > max(common.BLOCK_BYTES, common.BATCH_BYTES)
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def test_very_long_texts_in_dedup(long_docs):
    rows, df = long_docs
    got = {r.doc_id: (r.n_words, r.removed) for r in phrases.remove_repeated_passages(df).select("doc_id", "n_words", phrases.removed().alias("removed")).collect()}
    assert got == {1: (700_000, 0), 2: (87, 60), 3: (700_000, 700_000), 4: (1, 0)}
    long, small = rows[0][1].encode(), rows[1][1].encode()
    gone = [False] * len(small)
    for i in range(len(small) - 49):
        if small[i : i + 50] in long:
            gone[i : i + 50] = [True] * 50
    got = {r.doc_id: (r.n_bytes, r.removed) for r in suffixes.remove_repeated_bytes(df).select("doc_id", "n_bytes", suffixes.removed().alias("removed")).collect()}
    assert got == {1: (len(long), 0), 2: (len(small), sum(gone)), 3: (len(long), len(long)), 4: (5_200_000, 0)}


def test_very_long_texts_in_other_operators(long_docs):
    rows, df = long_docs
    path, t = tokenizer("byte_bpe_50k.json")
    n = {r.doc_id: (r.n_tokens, r.crc) for r in token_files.round_trip(df, path).select("doc_id", "n_tokens", F.crc32("ids").alias("crc")).collect()}
    for i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert n[i] == (len(ids), zlib.crc32(ids.tobytes()))
    counts = {r.doc.doc_id: (r.n_words, r.word_chars, r.n_repeat_words) for r in quality.base(df).collect()}
    assert counts == {i: (len(x.split()), len("".join(x.split())), 0) for i, x in rows}
    fps = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()}

    def fingerprint(text):
        words = text.lower().split()
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
        h = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], np.uint64)
        return sum(1 << b for b in range(64) if 2 * int(np.count_nonzero(h >> np.uint64(b) & np.uint64(1))) > len(h))

    assert {i: f for i, (f, _) in fps.items()} == {i: fingerprint(x) for i, x in rows}
    assert fps[3][1] == 1


def test_crc_column(docs):
    path, t = tokenizer("byte_bpe_50k.json")
    r = token_files.round_trip(docs.where("doc_id = 403"), path).select(F.crc32("ids")).first()[0]
    assert r == zlib.crc32(np.array([*t.encode("one", add_special_tokens=False).ids, 0], "<u4").tobytes())
