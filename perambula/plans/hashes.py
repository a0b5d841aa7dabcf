"""Queries whose draws are hashes of keys, with the hash written out in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from perambula.operators import evaluate, mobility
from perambula.plans import fixtures as fx
from perambula.plans.mobility import _STARTS, query

# XXH64 of whole numbers, by its published definition. SQL has 64-bit factors as unsigned 128-bit products.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_ALL = 18446744073709551616


def _u(x: str) -> str:
    return f"CAST(({x}) AS UBIGINT)"


def _mul(x: str, p: int) -> str:
    return _u(f"CAST({x} AS UHUGEINT) * {p}::UHUGEINT % {_ALL}::UHUGEINT")


def _add(x: str, p: int) -> str:
    return _u(f"(CAST({x} AS UHUGEINT) + {p}::UHUGEINT) % {_ALL}::UHUGEINT")


def _turn(x: str, r: int) -> str:
    return _u(f"CAST({x} AS UHUGEINT) * {1 << r}::UHUGEINT % {_ALL}::UHUGEINT + ({x} >> {64 - r})")


def hashed(key: str, seed: int, name: str, of: str) -> str:
    """Common table expressions that add h, the signed hash of (key, seed), to the table `of`; the last is `name`. Keys are not negative."""
    step = lambda k, x: f"{name}{k} AS (SELECT *, {x} AS h{k} FROM {name}{k - 1})"
    first = (42 + _P5 + 8) % _ALL
    long = [
        step(1, _mul(_turn(_mul(_u(key), _P2), 31), _P1)),
        step(2, f"xor({first}::UBIGINT, h1)"),
        step(3, _add(_mul(_turn("h2", 27), _P1), _P4)),
    ]
    mixed = lambda k: [step(k, _mul(f"xor(h{k - 1}, h{k - 1} >> 33)", _P2)), step(k + 1, _mul(f"xor(h{k}, h{k} >> 29)", _P3)), step(k + 2, f"xor(h{k + 1}, h{k + 1} >> 32)")]
    whole = [
        step(7, f"xor({_add('h6', (_P5 + 4) % _ALL)}, {(seed * _P1) % _ALL}::UBIGINT)"),
        step(8, _add(_mul(_turn("h7", 23), _P2), _P3)),
    ]
    last = f"{name} AS (SELECT * EXCLUDE ({', '.join(f'h{k}' for k in range(1, 12))}), CASE WHEN h11 >= 9223372036854775808::UBIGINT THEN CAST(h11 AS HUGEINT) - {_ALL}::HUGEINT ELSE CAST(h11 AS HUGEINT) END AS h FROM {name}11)"
    return ", ".join([f"{name}0 AS (SELECT * FROM {of})", *long, *mixed(4), *whole, *mixed(9), last])


@query(
    f"WITH {_STARTS}, a AS (SELECT user_id, list(start ORDER BY start) AS all_starts FROM s GROUP BY 1), {hashed('user_id', 42, 'hu', 'a')},"
    " f AS (SELECT user_id, all_starts[CAST((h % len(all_starts) + len(all_starts)) % len(all_starts) AS BIGINT) + 1] AS start FROM hu)"
    " SELECT event_id, user_id, date FROM stay JOIN f USING (user_id) WHERE date BETWEEN start AND start + 6"
)
def week_hash_sample(spark, sf):
    return mobility.sample_week(fx.staypoints(spark, sf)).select("event_id", "user_id", "date")


@query(
    f"WITH {hashed('vec_id', 42, 'hv', '(SELECT vec_id, label FROM embeddings)')}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM hv),"
    f" p AS (SELECT vec_id, label, CASE WHEN k <= round(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r), {hashed('vec_id', 7, 'hi', 'p')},"
    " q AS (SELECT *, row_number() OVER (PARTITION BY part, label ORDER BY h, vec_id) AS k, count(*) OVER (PARTITION BY part, label) AS n FROM hi)"
    " SELECT vec_id, label, part, CASE WHEN part = 'train' THEN k <= round(n * 0.15) END AS validation FROM q"
)
def split_members(spark, sf):
    """Who is in the test part, and in the inner validation part of the rest."""
    outer = evaluate.split(fx.read(spark, sf, "embeddings").select("vec_id", "label"), 0.2, 42, "vec_id", "label")
    inner = evaluate.split(outer.where("part = 'train'").drop("part"), 0.15, 7, "vec_id", "label").select("vec_id", (F.col("part") == "test").alias("validation"))
    return outer.join(inner, "vec_id", "left").select("vec_id", "label", "part", "validation")


@query(f"WITH {hashed('c_custkey', 42, 'hc', 'customer')} SELECT c_custkey AS user_id, CASE WHEN (h % 1000000 + 1000000) % 1000000 < 200000 THEN 'test' ELSE 'train' END AS part FROM hc")
def split_plain(spark, sf):
    return evaluate.split(fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))).select("user_id", "part")
