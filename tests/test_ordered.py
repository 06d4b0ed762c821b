"""Bucketed (skew-safe) ordered scans equal the plain per-key windows."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcraft.functions.ordered import row_index, running_totals, shift_rows


def _events(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(3000):
        key = 0 if rng.random() < 0.5 else int(rng.integers(1, 20))  # one hot key with half the rows
        rows.append((key, i, int(rng.integers(0, 400)), float(rng.normal())))
    return spark.createDataFrame(rows, "k int, id int, t int, v double")


def test_shift_rows_bucketed_equals_window(spark):
    df = _events(spark)
    plain = shift_rows(df, ["k"], ["t", "id"], ["v", "t"], [1, 2, -1])
    buck = shift_rows(df, ["k"], ["t", "id"], ["v", "t"], [1, 2, -1], bucket=F.floor(F.col("t") / 37))
    cols = ["id", "v_lag1", "v_lag2", "v_lead1", "t_lag1", "t_lag2", "t_lead1"]
    assert sorted(plain.select(*cols).collect()) == sorted(buck.select(*cols).collect())


def test_running_totals_and_index_bucketed(spark):
    df = _events(spark)
    a = running_totals(df, ["k"], ["t", "id"], {"cs": F.col("v"), "cnt": F.lit(1)})
    b = running_totals(df, ["k"], ["t", "id"], {"cs": F.col("v"), "cnt": F.lit(1)}, bucket=F.floor(F.col("t") / 50))
    ra = {r["id"]: (r["cs"], r["cnt"]) for r in a.collect()}
    rb = {r["id"]: (r["cs"], r["cnt"]) for r in b.collect()}
    assert ra.keys() == rb.keys()
    for k in ra:
        assert ra[k][1] == rb[k][1] and abs(ra[k][0] - rb[k][0]) < 1e-9
    idx = row_index(df, ["k"], ["t", "id"], bucket=F.floor(F.col("t") / 50))
    w = Window.partitionBy("k").orderBy("t", "id")
    ref = df.withColumn("rn", F.row_number().over(w))
    assert sorted((r["id"], r["row_idx"]) for r in idx.collect()) == sorted((r["id"], r["rn"]) for r in ref.collect())


def test_shift_one_row_bucketed_equals_window(spark):
    """Lag 1 / lead 1 take the boundary rows from the neighbour buckets (empty buckets skipped, NULL values
    kept as values), with the bucket as an expression and as an existing column."""
    df = _events(spark).withColumn("v", F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("v")))
    plain = shift_rows(df, ["k"], ["t", "id"], ["v", "id"], [1, -1])
    cols = ["id", "v_lag1", "v_lead1", "id_lag1", "id_lead1"]
    want = sorted(plain.select(*cols).collect())
    for bucket in (F.floor(F.col("t") / 37), F.floor(F.col("t") / 3)):
        buck = shift_rows(df, ["k"], ["t", "id"], ["v", "id"], [1, -1], bucket=bucket)
        assert sorted(buck.select(*cols).collect()) == want
    named = shift_rows(df.withColumn("b", F.floor(F.col("t") / 50)), ["k"], ["t", "id"], ["v", "id"], [1, -1], bucket="b")
    assert sorted(named.select(*cols).collect()) == want and "b" in named.columns


def test_tables_of_buckets_are_never_broadcast(spark):
    # there may be as many buckets as rows
    df = spark.range(200).select((F.col("id") % 40).alias("k"), F.col("id").alias("t"))
    bucket = F.floor(F.col("t") / 50)
    for d in (shift_rows(df, ["k"], ["t"], ["t"], [-1], bucket=bucket),
              running_totals(df, ["k"], ["t"], {"n": F.lit(1)}, bucket=bucket)):
        assert d.count() == 200
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [k" in plan and "BroadcastHashJoin" not in plan
