"""Sources, sinks and report parts that no registered query runs."""

import hashlib
import json

from pyspark.sql import functions as F

from panelcraft.functions.clean import fmt_or_na, nan_to_null, nans_to_nulls, zero_pad
from panelcraft.operators.report import change_between_ends, counts_by, mean_post_effect, report_tables
from panelcraft.plans.pipeline import wave_features
from panelcraft.session import checkpoint_dir
from panelcraft.sources.files import (columns_with_prefix, read_csv, read_parquet, write_csv, write_json_meta,
                                      write_parquet)
from panelcraft.sources.landed import append_manifest_rows, file_manifest, json_records


def test_csv_parquet_and_meta_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2020, "a,b", None), (2, 2021, 'q"', 0.5)], "id int, year int, s string, v double")
    write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    write_parquet(df, str(tmp_path / "p"), partition_by=["year"])
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"year=2020", "year=2021"}
    write_parquet(df, str(tmp_path / "q"))
    write_parquet(df, str(tmp_path / "q"))  # overwrites
    assert read_parquet(spark, str(tmp_path / "q"), ["id", "v"]).columns == ["id", "v"]
    assert read_parquet(spark, [str(tmp_path / "q"), str(tmp_path / "q")]).count() == 4
    write_json_meta(spark, {"encoder": "x", "n_dims": 3}, str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"encoder": "x", "n_dims": 3}
    assert columns_with_prefix(df.withColumns({"emb_000": F.lit(1), "emb_001": F.lit(2), "remb_": F.lit(3)}), "emb_") == ["emb_000", "emb_001"]


def test_json_records_with_predicate_columns_and_limit(spark, tmp_path):
    rows = [{"year": str(2000 + i), "locationabbr": "A" if i % 2 else "B", "value": None if i == 3 else str(i)} for i in range(9)]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "year string, locationabbr string, value string, absent string"
    got = json_records(spark, str(tmp_path / "r.json"), schema, where=F.col("locationabbr") == "A", columns=["year", "value", "absent"])
    assert sorted(map(tuple, got.collect())) == [("2001", "1", None), ("2003", None, None), ("2005", "5", None), ("2007", "7", None)]
    assert json_records(spark, str(tmp_path / "r.json"), schema, limit=5).count() == 5


def test_manifest_lists_files_without_a_byte(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_bytes(b"hello")
    (tmp_path / "d" / "e" / "none.bin").write_bytes(b"")
    (tmp_path / "d" / "e" / "b b.bin").write_bytes(b"\0\1")
    got = {r["path"]: (r["bytes"], r["sha256"]) for r in file_manifest(spark, str(tmp_path / "d")).collect()}
    assert {k.replace("%20", " "): v for k, v in got.items()} == {
        "a.txt": (5, hashlib.sha256(b"hello").hexdigest()), "e/none.bin": (0, hashlib.sha256(b"").hexdigest()),
        "e/b b.bin": (2, hashlib.sha256(b"\0\1").hexdigest())}
    rows = spark.createDataFrame([("x", 1)], "path string, bytes long")
    append_manifest_rows(rows, str(tmp_path / "man"))
    append_manifest_rows(rows, str(tmp_path / "man"))
    assert spark.read.parquet(str(tmp_path / "man")).count() == 2


def test_small_column_functions(spark):
    df = spark.createDataFrame([(1, float("inf"), 1.23456, 1.5), (12, float("nan"), None, float("-inf")), (345, 2.0, float("-0.5"), 0.0)],
                               "code int, x double, y double, z float")
    got = df.select(zero_pad("code").alias("c"), nan_to_null("x").alias("x"), fmt_or_na("y").alias("y"), fmt_or_na("y", 1).alias("y1")).collect()
    assert [tuple(r) for r in got] == [("01", None, "1.235", "1.2"), ("12", None, "NA", "NA"), ("34", 2.0, "-0.500", "-0.5")]
    assert [(r["x"], r["z"]) for r in nans_to_nulls(df).collect()] == [(None, 1.5), (None, None), (2.0, 0.0)]
    assert [r["x"] == r["x"] for r in nans_to_nulls(df, ["y"]).collect()] == [True, False, True]


def test_wave_features(spark):
    panel = spark.createDataFrame([(u, t, u * 10 + t, 1) for u in (1, 2) for t in range(4)], "u int, t int, c int, other int")
    waves = spark.createDataFrame([(1, 0, 5.0), (1, 2, None), (1, 3, 7.0), (2, 3, 1.0), (3, 1, 2.0)], "u int, t int, w double")
    got = wave_features(waves, panel, ["u"], "t", ["c"], ["w"])
    assert got.columns == ["u", "t", "w", "c", "w_lag1"]
    assert sorted(map(tuple, got.collect())) == [(1, 0, 5.0, 10, None), (1, 2, None, 12, 5.0), (1, 3, 7.0, 13, None), (2, 3, 1.0, 23, None),
                                                 (3, 1, 2.0, None, None)]


def test_change_between_the_first_and_last_period(spark):
    rows = [("A", 2000, 1.0), ("A", 2001, 9.0), ("A", 2002, 4.0), ("B", 2000, None), ("B", 2002, 2.0), ("C", 2001, 1.0), ("D", 2000, 5.0)]
    got = change_between_ends(spark.createDataFrame(rows, "u string, t int, v double"), ["u"], "t", "v")
    assert sorted(map(tuple, got.collect())) == [("A", 1.0, 4.0, 3.0), ("B", None, 2.0, None)]


def test_report_tables(spark):
    panel = spark.createDataFrame([(u, t, float(i * (t - 2000))) for i, u in enumerate("ABCDEFG") for t in (2000, 2001, 2003)],
                                  "unit string, year int, rate double")
    waves = spark.createDataFrame([("A", 2001, 1.0, "S", "observed"), ("A", 2003, None, "E", "missing"), ("B", 2001, 2.0, "S", "observed"),
                                   ("C", 2001, None, None, "missing")], "unit string, year int, use double, source string, coverage_flag string")
    coefs = spark.createDataFrame([("rate", 1, 2.0, 1.0, 3.0, 0.1), ("rate", -2, 0.5, 0.0, 1.0, 0.6), ("other", 0, 9.0, 8.0, 10.0, 0.0)],
                                  "outcome string, event_time int, coef double, ci_low double, ci_high double, p_value double")
    summary = spark.createDataFrame([("rate", 21.0, 0.5, 0.1, 0.0, 1.0)], "outcome string, nobs double, r2 double, pretrend_pvalue double, "
                                                                          "placebo_mean double, placebo_std double")
    evals = spark.createDataFrame([("t", "b", 2.0, 1.0, 0.1), ("t", "a", 1.0, 1.0, 0.2), ("s", "c", 3.0, 1.0, 0.3)],
                                  "task string, model string, test_rmse double, test_mae double, test_r2 double")
    got = {k: [tuple(r) for r in v.collect()] for k, v in report_tables(panel, waves, coefs, summary, evals, "unit", "year", "rate", "use",
                                                                        outcome="rate").items()}
    assert dict(got["coverage"]) == {"rows": "21", "units": "7", "periods": "2000-2003", "wave_rows": "4", "wave_observations": "2"}
    assert got["causal"] == [("rate", 21.0, 0.5, 0.1, 0.0, 1.0)]
    assert [r[0] for r in got["event"]] == [-2, 1]
    assert [r[1] for r in got["models"]] == ["c", "a", "b"]
    assert [r[1] for r in got["state_change"] if r[0] == "most_improved"] == list("ABCDE")
    assert [(r[1], r[4]) for r in got["state_change"] if r[0] == "most_worsened"] == [("G", 18.0), ("F", 15.0), ("E", 12.0), ("D", 9.0), ("C", 6.0)]
    assert sorted(got["wave_coverage"]) == [("E", "missing", 1), ("S", "observed", 2)]
    assert mean_post_effect(coefs) == 5.5 and mean_post_effect(coefs.where("event_time < 0")) is None
    assert sorted(map(tuple, counts_by(waves, ["source"]).collect())) == [("E", 1), ("S", 2)]


def test_a_checkpoint_folder_is_set_only_where_none_is(spark):
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir") == checkpoint_dir(spark)
