"""The pipeline's stages against brute-force versions, and its registration."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from perambula.llm import packing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The table before the pipeline and after each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = queries.table(spark, SF, "documents")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"file://{folder}/{k}")
        out.append(spark.read.parquet(f"file://{folder}/{k}"))
    return out


def test_columns_and_rows(stages):
    for table in stages[1:-1]:
        assert table.columns == stages[0].columns and table.dtypes == stages[0].dtypes
    counts = [t.count() for t in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_quality_stage_keeps_rows_as_they_are(stages):
    kept = {tuple(r) for r in stages[1].collect()}
    assert kept <= {tuple(r) for r in stages[0].collect()}


def test_near_copy_stage_keeps_one_of_each_group(stages):
    from test_operators import brute_fingerprint, groups

    rows = sorted((r.doc_id, r.text) for r in stages[1].collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    of = groups(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({rows[g][0] for g in of})


def cut(text, gone):
    """The text without runs of words, each with the white space after it; what stays is as it was."""
    words = list(WORD.finditer(text))
    out, at = [], 0
    for k, m in enumerate(words):
        if gone[k] and not (k and gone[k - 1]):
            out.append(text[at : m.start()])
            rest = [x for x in range(k, len(words)) if not gone[x]]
            at = words[rest[0]].start() if rest else words[-1].end()
    return "".join(out) + text[at:]


def test_passage_stage(stages):
    from test_operators import covered

    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    items = [(i, WORD.findall(t)) for i, t in rows]
    want = {}
    for (i, w), (_, t), gone in zip(items, rows, covered(items, 50), strict=True):
        kept = [x for x, y in zip(w, gone, strict=True) if not y]
        text = cut(t, gone)
        assert WORD.findall(text) == kept
        if kept or not any(gone):
            want[i] = text
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[3].collect()}
    assert {i: t for i, (t, _) in got.items()} == want
    assert all(n == len(t) for t, n in got.values())
    assert any("\n" in t for t, _ in got.values())


def test_passage_stage_keeps_texts_and_columns(spark):
    """White space, microseconds, nulls, equal rows and columns with clashing names come out as they went in."""
    import datetime

    passage = " ".join(f"p{k}" for k in range(60))
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 456789)
    base = [
        (1, f"one\n\n  two\t{passage}\r\n three  "),
        (2, f"  four\n five {passage}\n\n  six\n\tseven\n"),
        (2, "another text\n of the same id"),
        (3, None),
        (4, ""),
        (5, " \n a  b \n"),
        (5, " \n a  b \n"),
        (6, f"{passage}  "),
        (None, f"x {passage}\n"),
    ]
    rows = [(i, t, "en", k, at, [k], {"block_id": k}) for k, (i, t) in enumerate(base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, row int, block_id timestamp_ntz, no_text array<int>, rest struct<block_id: int>").repartition(3)
    got = sorted((r.row, r.doc_id, r.text, r.spans, r.block_id, list(r.no_text), r.rest.block_id) for r in corpus_pipeline.drop_repeated_passages(spark, docs, SF).collect())
    want = {k: t for k, (_, t) in enumerate(base)}
    want[1], want[8] = "  four\n five six\n\tseven\n", "x \n"
    del want[7]  # nothing is left of it
    assert got == [(k, base[k][0], t, "en", at, [k], k) for k, t in want.items()]
    assert corpus_pipeline.drop_repeated_passages(spark, docs, SF).dtypes == docs.dtypes


def test_packing_stage(stages):
    """Every document's ids are in the sequences, whole and in order, with its end mark."""
    import numpy as np

    tokenizer = packing.Tokenizer(queries.tokenizer("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN)
    got: dict = {}
    for r in stages[4].collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.n_tokens <= r.bin_capacity in packing.CAPACITIES
        assert [*r.offsets, r.n_tokens] == np.cumsum([0, *r.lengths]).tolist()
        for d, p, at, n in zip(r.doc_ids, r.pieces, r.offsets, r.lengths, strict=True):
            got.setdefault(d, {})[p] = ids[at : at + n].tolist()
    want = {r.doc_id: [*tokenizer.encode(r.text).tolist(), 50256] for r in stages[3].collect()}
    assert {d: [x for k in sorted(parts) for x in parts[k]] for d, parts in got.items()} == want


def test_run_equals_its_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1].count()


def test_stages_take_nulls_and_empty_tables(spark):
    base = queries.table(spark, SF, "documents")
    odd = base.limit(20).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (1, None, "en", None, 3), (1, None, "en", None, 3)], base.schema))
    kept = corpus_pipeline.keep_quality(spark, odd, SF).collect()
    assert 0 < len(kept) <= 20 and all(r.text for r in kept)  # no words: a failed base rule
    nulls = odd.where("text is null or text = ''")
    got = sorted(map(str, corpus_pipeline.drop_near_copies(spark, nulls, SF).collect()))
    assert got == sorted(map(str, nulls.distinct().collect()))  # rows without an id stay, of equal rows one
    passed = corpus_pipeline.drop_repeated_passages(spark, odd, SF)
    assert sorted(map(str, passed.where("text is null or text = ''").collect())) == sorted(map(str, nulls.collect()))
    assert corpus_pipeline.pack(spark, nulls, SF).select(F.sum("n_tokens"), F.sum(F.size("doc_ids"))).first() == (4, 4)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, base.limit(0), SF)
        assert none.count() == 0
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0


def test_near_copy_stage_decides_by_row_where_ids_repeat(spark):
    base = queries.table(spark, SF, "documents")
    a, b, c = (" ".join(f"{x}{(i * i + k) % 97}" for i in range(80)) for k, x in enumerate("abc"))
    rows = [(1, a), (5, a), (5, b), (5, b), (5, c), (7, c), (9, b), (None, a)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in order], base.schema)
        got = corpus_pipeline.drop_near_copies(spark, docs, SF).select("doc_id", "text").collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", a), ("5", b), ("5", c), ("None", a)])


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if re.match(r"op\d+_", x)}
    assert names["pipeline"] is corpus_pipeline.run
