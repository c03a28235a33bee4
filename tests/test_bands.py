"""Band tables: refusals, edges, and the cell join against a loop over all bands."""
import random

import pytest
from pyspark.sql import functions as F

from veilspan.operators import bands as B

SCHEMA = "k string, band string, low double, high double, low_incl boolean, high_incl boolean"


def held(v, low, high, li, hi):
    return (low is None or v > low or (v == low and li)) and (high is None or v < high or (v == high and hi))


@pytest.mark.parametrize("rows, fault", [
    ([("a", "x", 0.0, 10.0, True, True), ("a", "y", 10.0, 20.0, True, False)], "overlap"),
    ([("a", "x", None, 10.0, True, False), ("a", "y", None, 5.0, True, False)], "overlap"),
    ([("a", "x", 0.0, None, True, False), ("a", "y", 5.0, 6.0, True, False)], "overlap"),
    ([("a", "x", 0.0, 0.0, True, False)], "empty"),
    ([("a", "x", 3.0, 2.0, True, True)], "empty"),
])
def test_faulty_tables_are_refused(spark, rows, fault):
    bands = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError, match=fault):
        B.with_band(spark.createDataFrame([("a", 1.0)], "k string, v double"), "v", bands, ("k",))


def test_touching_bands_and_points_are_fine(spark):
    rows = [("a", "x", 0.0, 10.0, True, False), ("a", "ten", 10.0, 10.0, True, True), ("a", "y", 10.0, None, False, False), (None, "z", None, None, True, True)]
    values = [("a", -1.0), ("a", 0.0), ("a", 9.5), ("a", 10.0), ("a", 10.5), ("a", None), ("b", 1.0), (None, 5.0), ("a", float("nan"))]
    got = B.with_band(spark.createDataFrame(values, "k string, v double"), "v", spark.createDataFrame(rows, SCHEMA), ("k",)).collect()
    assert {(r.k, str(r.v)): r.band for r in got} == dict(zip(((k, str(v)) for k, v in values), [None, "x", "x", "ten", "y", None, None, "z", "y"]))


@pytest.mark.parametrize("cells", [1, 7, 256])
def test_cells_equal_a_loop(spark, cells):
    rnd = random.Random(5)
    rows = []
    for k in ("a", "b", None):
        edges = sorted(rnd.sample(range(3000), 400))
        pairs = [(None, edges[0]), *zip(edges, edges[1:]), (edges[-1], None)]
        rows += [(k, f"{k}{i}", None if lo is None else float(lo), None if hi is None else float(hi), i % 2 == 0, i % 2 == 0) for i, (lo, hi) in enumerate(pairs) if i % 9]
    values = [(rnd.choice(["a", "a", "b", None, "c"]), float(rnd.choice([rnd.randint(-5, 3005), rnd.random() * 3000]))) for _ in range(1500)]
    got = B.with_band(spark.createDataFrame(values, "k string, v double"), "v", spark.createDataFrame(rows, SCHEMA), ("k",), few=0, most_cells=cells)
    want = [(k, v, next((b for kk, b, *edge in rows if kk == k and held(v, *edge)), None)) for k, v in values]
    order = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_without_keys_and_empty_tables(spark):
    values = spark.range(100).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("band_before"))
    bands = spark.createDataFrame([("a", f"b{i}", float(i), float(i + 1), True, False) for i in range(50)], SCHEMA)
    assert {r.v: r.band for r in B.with_band(values, "v", bands, few=0).collect()} == {float(i): f"b{i}" if i < 50 else None for i in range(100)}
    assert B.with_band(values.limit(0), "v", bands).collect() == []
    assert all(r.band is None for r in B.with_band(values, "v", bands.limit(0)).collect())


def test_policies(spark):
    df = spark.createDataFrame([("Ana", 3, "x")], "name string, n int, note string")
    got = B.applied(df, [("name", "first"), ("n", "keep"), ("note", "drop")], {"first": lambda c: F.substring(c, 1, 1)})
    assert got.columns == ["name", "n"] and tuple(got.first()) == ("A", 3)
    for bad in ([("name", "nothing")], [("other", "keep")], [("n", "keep"), ("n", "drop")]):
        with pytest.raises(ValueError):
            B.applied(df, bad, {})
