"""Landed-file sources: zip members, series files, HTML tables, JSON picks, manifests, fallbacks."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from panelcraft.sources.files import read_first_available, require_columns
from panelcraft.sources.landed import (file_manifest, html_first_table_cells, pick_from_json_array,
                                       series_files, table_key_values, zip_csv_members)


def test_zip_csv_members(spark, tmp_path):
    for year, enc in [(2019, "utf-8"), (2020, "latin-1")]:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as zf:
            zf.writestr(f"cases{year}/ACCIDENT.CSV", f"STATE,ST_CASE,FATALS,NAME\n1,10001,2,Zoë\n2,20001,1,x\n".encode(enc))
            zf.writestr(f"cases{year}/vehicle.csv", "STATE,ST_CASE\n1,1\n")
        (tmp_path / f"cases{year}.zip").write_bytes(buf.getvalue())
    df = zip_csv_members(spark, str(tmp_path), "accident.csv", ["STATE", "ST_CASE", "FATALS", "MISSING"])
    rows = sorted(df.collect())
    assert len(rows) == 4
    assert rows[0]["archive"] == "cases2019.zip" and rows[0]["FATALS"] == "2" and rows[0]["MISSING"] is None


def test_series_files_one_scan(spark, tmp_path):
    (tmp_path / "ALUR.csv").write_text("observation_date,ALUR\n2003-01-01,5.5\n2003-02-01,6.5\n2004-01-01,.\n")
    (tmp_path / "AKPOP.csv").write_text("observation_date,AKPOP\n2003-01-01,650.1\n")
    df = series_files(spark, str(tmp_path / "*.csv"), r"^([A-Z]{2})(UR|PCPI|POP)\.csv$", {"unit": 1, "metric": 2})
    rows = sorted((r["unit"], r["metric"], str(r["date"]), r["value"]) for r in df.collect())
    assert rows == [("AK", "POP", "2003-01-01", 650.1), ("AL", "UR", "2003-01-01", 5.5),
                    ("AL", "UR", "2003-02-01", 6.5), ("AL", "UR", "2004-01-01", None)]


def test_html_first_table(spark):
    html = ("<html><body><p>x</p><table><tr><th>State</th><th>Rural</th><th>TOTAL</th></tr>"
            "<tr><td>Alabama</td><td>1,000</td><td>2,500</td></tr>"
            "<tr><td>Alaska</td><td>-</td><td>300</td></tr></table>"
            "<table><tr><td>second</td></tr></table></body></html>")
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    cells = html_first_table_cells(pages, "page_id", "html")
    kv = sorted((r["key_text"], r["value_text"]) for r in table_key_values(cells).collect())
    assert kv == [("Alabama", "2,500"), ("Alaska", "300")]


def test_json_array_pick(spark):
    rows = [json.dumps([{"StratType": "Sex", "SubStrat": "Male", "MainValue": "1"},
                        {"StratType": "Total", "SubStrat": "Total", "MainValue": "29.5"}]),
            json.dumps([{"StratType": "Total", "SubStrat": "Total", "MainValue": "n/a"}]),
            json.dumps([])]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    pred = lambda x: (x["StratType"] == "Total") & (x["SubStrat"] == "Total")
    got = [r[0] for r in df.select(pick_from_json_array(F.col("j"), "struct<StratType:string,SubStrat:string,MainValue:string>",
                                                        pred, "MainValue")).collect()]
    assert got == [29.5, None, None]


def test_file_manifest(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"hello")
    (tmp_path / "y.bin").write_bytes(b"\x00\x01\x02")
    m = {r["path"]: (r["bytes"], r["sha256"]) for r in file_manifest(spark, str(tmp_path)).collect()}
    import hashlib
    assert m["a/x.txt"] == (5, hashlib.sha256(b"hello").hexdigest())
    assert m["y.bin"][0] == 3


def test_fallback_and_required_columns(spark, tmp_path):
    p = tmp_path / "manual.csv"
    p.write_text("unit,year,v\nAA,2001,1.5\n")
    df = read_first_available(spark, [(str(tmp_path / "missing.parquet"), "parquet"), (str(p), "csv")],
                              "unit string, year int, v double")
    assert df.count() == 1
    empty = read_first_available(spark, [(str(tmp_path / "nope.csv"), "csv")], "unit string", required=False)
    assert empty.count() == 0 and empty.columns == ["unit"]
    with pytest.raises(FileNotFoundError):
        read_first_available(spark, [(str(tmp_path / "nope.csv"), "csv")], "unit string")
    with pytest.raises(ValueError):
        require_columns(df, ["unit", "treatment_time"])
