"""Point-in-interval lookup: first match by start, matched-but-NULL is kept, default only without match."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from panelcraft.operators.intervals import day_block, day_scale, impute_from_base, point_in_interval, ratio_to_base


def _d(y, m=1, d=1):
    return dt.date(y, m, d)


def test_point_in_interval_semantics(spark):
    iv = spark.createDataFrame([
        ("UT", _d(2003), _d(2019, 12, 31), None, 1),       # matched, value missing -> stays missing (N8)
        ("UT", _d(2020), _d(2023, 12, 31), 0.41, 2),
        ("CA", _d(2003), _d(2010, 12, 31), 0.20, 3),
        ("CA", _d(2005), _d(2012, 12, 31), 0.99, 4),       # overlaps: first by start wins (N9)
    ], "unit string, s date, e date, v double, k int")
    pts = spark.createDataFrame([(u, y, _d(y), dflt) for u, dflt in [("UT", 0.5), ("CA", 0.3), ("NV", 0.7)]
                                 for y in (2004, 2011, 2021)], "unit string, year int, p date, dflt double")
    res = {(r["unit"], r["year"]): (r["value"], r["matched"]) for r in
           point_in_interval(pts, iv, ["unit"], "p", "s", "e", "v", tiebreak=["k"], default="dflt").collect()}
    assert res[("UT", 2004)] == (None, True)
    assert res[("UT", 2021)] == (0.41, True)
    assert res[("CA", 2011)] == (0.99, True)
    assert res[("CA", 2021)] == (0.3, False)
    assert res[("CA", 2004)] == (0.20, True)
    assert res[("NV", 2004)] == (0.7, False)


def test_intervals_of_all_lengths_and_a_hot_unit(spark):
    rng = random.Random(4)
    day = lambda n: dt.date(1990, 1, 1) + dt.timedelta(days=n)
    ivs = []
    for k in range(1500):
        start = rng.randint(-4000, 6000)
        length = rng.choice([0, 0, 1, 2, 3, 7, 8, 31, 365, 1024, 5000])
        ivs.append(("hot" if rng.random() < 0.9 else rng.choice("abc"), day(start), day(start + length), k if k % 7 else None, k))
    ivs += [("a", day(5), day(4), 1, 9001), ("a", None, day(4), 1, 9002), ("a", day(4), None, 1, 9003)]
    pts = [(u, i, day(n)) for u in ("hot", "a", "b", "z") for i, n in enumerate(range(-4100, 12000, 37))]
    got = {(r["unit"], r["i"]): (r["value"], r["matched"]) for r in point_in_interval(
        spark.createDataFrame(pts, "unit string, i int, p date"), spark.createDataFrame(ivs, "unit string, s date, e date, v int, k int"),
        ["unit"], "p", "s", "e", "v", tiebreak=["k"]).collect()}
    for u, i, p in pts:
        hits = sorted((s, k, v) for unit, s, e, v, k in ivs if unit == u and s and e and s <= p <= e)
        assert got[u, i] == ((hits[0][2], True) if hits else (None, False))
    # the hot unit's rows lie in many (scale, block) groups, and none costs more than two rows
    iv = spark.createDataFrame(ivs, "unit string, s date, e date, v int, k int").where("s <= e")
    level = day_scale(F.col("s"), F.col("e"))
    blocks = iv.withColumn("n", day_block(F.col("e"), level) - day_block(F.col("s"), level) + 1).withColumn("l", level)
    assert blocks.agg(F.max("n")).first()[0] <= 2
    assert blocks.where("unit = 'hot'").select("l", day_block(F.col("s"), level)).distinct().count() > 300


def test_base_period_imputation(spark):
    loaded = spark.createDataFrame([("A", 2007, 10.0), ("B", 2007, 20.0), ("A", 2008, 11.0)],
                                   "unit string, year int, vmt double")
    nat = spark.createDataFrame([(2005, 50.0), (2006, 75.0), (2007, 100.0)], "year int, nat double")
    grid = spark.createDataFrame([(u, y) for u in "AB" for y in (2005, 2006, 2007, 2008)], "unit string, year int")
    ratios = ratio_to_base(nat, "year", "nat", 2007)
    out = {(r["unit"], r["year"]): (r["vmt"], r["imputed"]) for r in
           impute_from_base(loaded, grid, ["unit"], "year", "vmt", ratios, 2007).collect()}
    assert out[("A", 2005)] == (5.0, 1) and out[("B", 2006)] == (15.0, 1)
    assert out[("A", 2008)] == (11.0, 0)
    assert ("B", 2008) not in out  # no ratio for 2008 -> stays missing


def test_exploded_points_are_never_broadcast(spark):
    # the estimate of the points does not see what explode makes of them, so small tables planned a broadcast of all of them
    units = spark.range(50).select(F.col("id").alias("unit"))
    pts = units.withColumn("p", F.explode(F.sequence(F.lit(_d(2000)), F.lit(_d(2000, 3)))))
    iv = units.select("unit", F.lit(_d(2000, 1, 5)).alias("s"), F.lit(_d(2000, 2, 5)).alias("e"), F.col("unit").alias("v"))
    res = point_in_interval(pts, iv, ["unit"], "p", "s", "e", "v")
    assert res.where("matched").count() == 50 * 32
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[[^\]]*__b#", plan) and not re.search(r"BroadcastHashJoin \[[^\]]*__b#", plan)
