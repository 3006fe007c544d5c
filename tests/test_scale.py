"""Operators that must stay exact where one group holds most rows."""

import random

from pyspark.sql import functions as F

from sparkdocs.operators.hierarchy import folder_paths
from sparkdocs.operators.sizes import fits_broadcast, keyed_join, number_rows, top_per_group


def skewed(spark, n=3000):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{rng.randint(0, 50)}", rng.randint(0, 10**6), i) for i in range(n)]
    return spark.createDataFrame(rows, "g string, v int, id int"), rows


def test_number_rows(spark):
    df, rows = skewed(spark)
    got = number_rows(df, ["g"], [F.col("v"), F.col("id")], "no", total="n").collect()
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == g)
        want |= {i: (k + 1, len(mine)) for k, (_, i) in enumerate(mine)}
    assert {r.id: (r.no, r.n) for r in got} == want


def test_number_rows_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, v int")
    got = number_rows(df, ["g"], [F.col("v")], "no").collect()
    assert sorted((r.g or "", r.v, r.no) for r in got) == [("", 1, 1), ("", 2, 2), ("a", 1, 1)]


def test_top_per_group(spark):
    df, rows = skewed(spark)
    got = top_per_group(df, ["g"], [F.desc("v"), F.col("id")], 7, spread=["id"], salts=8).collect()
    want = set()
    for g in {r[0] for r in rows}:
        want |= {i for _, i in sorted((-r[1], r[2]) for r in rows if r[0] == g)[:7]}
    assert {r.id for r in got} == want


def test_keyed_join_salts_hot_keys(spark):
    df, rows = skewed(spark)
    keys = sorted({r[0] for r in rows})
    right = spark.createDataFrame([(k, f"{k}-{j}") for k in keys if k != "k1" for j in (1, 2)], "g string, x string")
    for how in ("inner", "left"):
        plain = df.join(right, ["g"], how)
        salted = keyed_join(df, right, ["g"], how, hot_rows=100, salts=4, broadcast_rows=1)
        assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_fits_broadcast(spark):
    df = spark.range(100)
    assert fits_broadcast(df) and not fits_broadcast(df, rows=50)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert not fits_broadcast(wide, size=5000)


def test_long_chains_cycles_and_unknown_parents(spark):
    chain = [(str(i), str(i - 1) if i else "", f"t{i}") for i in range(300)]
    odd = [("c1", "c2", "C1"), ("c2", "c1", "C2"), ("below", "c1", "B"), ("lost", "nowhere", "L"), ("self", "self", "S")]
    df = spark.createDataFrame(chain + odd, "id string, parent_id string, title string")
    got = {r.id: r.folder_path for r in folder_paths(df).collect()}
    assert len(got) == 305
    assert got["299"] == "/".join(f"t{i}" for i in range(300))
    assert got["lost"] == "L"
    assert all(got[k] is None for k in ("c1", "c2", "below", "self"))
