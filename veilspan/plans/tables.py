"""Queries whose rules are rows: bands, price steps, column policies."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veilspan.functions import fixed as V
from veilspan.functions import numbers as N
from veilspan.functions.text import squeeze
from veilspan.operators import bands as B
from veilspan.plans.base import PROFILES, profiles
from veilspan.plans.people import _GAPS, _GTQ
from veilspan.plans.registry import query
from veilspan.session import table

BANDS = "variant string, band string, low double, high double, low_incl boolean, high_incl boolean"


def band_rows() -> list[tuple]:
    """The three built-in tables as rows; a band begins where the one before it ends."""
    out = []
    for variant, edges in V.BANDS.items():
        open_low = True
        for name, lo, hi, hi_incl in edges:
            out.append((variant, name, None if lo is None else float(lo), None if hi is None else float(hi), open_low, hi_incl))
            open_low = not hi_incl
    return out


_ONE = "SELECT id, '{v}' AS variant, round(p, 6) AS gap_pct, {band} AS band FROM (SELECT id, {expr} AS p FROM (SELECT id, CAST(cur AS DOUBLE) AS cur, {g} AS g FROM profiles))"


@query("gap_bands_by_table", f"WITH {PROFILES} " + " UNION ALL ".join(
    _ONE.format(v=v, band=band, expr=expr, g=_GTQ.format(fx=fx)) for v, (expr, fx, band) in _GAPS.items()))
def gap_bands_by_table(spark, sf):
    gap = lambda v: N.gap_pct(
        N.to_gtq(F.col("current_salary"), F.col("current_currency"), v), N.to_gtq(F.col("desired_salary"), F.col("desired_currency"), v), v)
    p = profiles(spark, sf).select("id", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), gap(v).alias("p")) for v in "ABC"])).alias("g"))
    rows = B.with_band(p.select("id", "g.*"), "p", spark.createDataFrame(band_rows(), BANDS), ("variant",))
    return rows.select("id", "variant", F.round("p", 6).alias("gap_pct"), "band")


@query("price_steps_by_brand", """
WITH e AS (SELECT DISTINCT p_brand, p_retailprice FROM part),
b AS (SELECT p_brand, p_retailprice AS low, lead(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS high FROM e),
l AS (SELECT l_orderkey, l_linenumber, p_brand, l_extendedprice / l_quantity AS unit FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, l.p_brand, low, high FROM l LEFT JOIN b ON l.p_brand = b.p_brand AND unit >= low AND (high IS NULL OR unit < high)
""")
def price_steps_by_brand(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    after = F.lead("p_retailprice").over(Window.partitionBy("p_brand").orderBy("p_retailprice"))
    steps = part.select("p_brand", "p_retailprice").distinct().select(
        "p_brand", F.col("p_retailprice").alias("low"), after.alias("high"), F.lit(True).alias("low_incl"), F.lit(False).alias("high_incl"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand", "unit")
    steps = steps.withColumns({"step_low": F.col("low"), "step_high": F.col("high")})
    d = B.with_band(lines, "unit", steps, ("p_brand",), ("step_low", "step_high"))
    return d.select("l_orderkey", "l_linenumber", "p_brand", F.col("step_low").alias("low"), F.col("step_high").alias("high"))


@query("profile_by_policy", f"WITH {PROFILES} SELECT id, trim(regexp_replace(desired_role, '\\s+', ' ', 'g')) AS desired_role, substr(name, 1, 1) AS name, years FROM profiles")
def profile_by_policy(spark, sf):
    policy = [("id", "keep"), ("name", "initial"), ("desired_role", "squeeze"), ("years", "keep"), ("employer", "drop")]
    return B.applied(profiles(spark, sf), policy, {"initial": lambda c: F.substring(c, 1, 1), "squeeze": squeeze})
