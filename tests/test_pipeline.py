"""The three pipeline entries end to end on small literal inputs."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelcraft.plans.pipeline import (causal, features, parse_policy_pages, policy_event_counts, predict,
                                       text_embeddings)

NAMES = [("Alpha Land", "AL"), ("Beta Land", "BL"), ("Gamma Land", "GL")]

VALUES = "Alpha Land\nAL\n1/1/2021\n$1.00\nBeta Land\nBL\n1/1/2021\n$0.50\nGamma Land\nGL\n1/1/2021\n$0.70\n"
INTERVALS = ("Alpha Land\nAL\n1/1/2003\n12/31/2004\n$0.10\n"
             "Alpha Land\nAL\n1/1/2005\n12/31/2006\n"
             "Beta Land\nBL\n1/1/2003\n12/31/2005\n$0.30\n")


def test_parse_policy_pages(spark):
    names = spark.createDataFrame(NAMES, "name string, code string")
    vp = spark.createDataFrame([(1, VALUES)], "page_id long, text string")
    ip = spark.createDataFrame([(2, INTERVALS)], "page_id long, text string")
    out = {(r["unit"], r["year"]): (r["value"], r["matched"]) for r in
           parse_policy_pages(vp, ip, names, 2003, 2007).collect()}
    assert len(out) == 15
    assert out[("AL", 2003)] == (0.10, True)
    assert out[("AL", 2005)] == (None, True)      # interval matched, amount missing: stays missing
    assert out[("AL", 2007)] == (1.00, False)     # no interval: current value
    assert out[("BL", 2005)] == (0.30, True) and out[("BL", 2006)] == (0.50, False)
    assert out[("GL", 2004)] == (0.70, False)


def test_policy_event_counts(spark):
    names = spark.createDataFrame(NAMES, "name string, code string")
    ev = ("x Change for Alpha Land in 2005 Effective Date of Change:**3/1/2005 **Change:**A\n"
          "Change for Alpha Land in 2005 Effective Date of Change:**3/1/2005 **Change:**A again\n"
          "Change for Beta Land in 2006 Effective Date of Change:**6/1/2006 **Change:**B\n")
    pages = spark.createDataFrame([(1, "sunday", ev), (2, "underage", ev.split("\n")[2])],
                                  "page_id long, topic string, text string")
    events, counts = policy_event_counts(pages, names, {"sunday": "n_sunday", "underage": "n_underage"}, 2004, 2007)
    c = {(r["unit"], r["year"]): (r["n_sunday"], r["n_underage"]) for r in counts.collect()}
    assert len(c) == 12 and c[("AL", 2005)] == (2, 0) and c[("BL", 2006)] == (1, 1) and c[("GL", 2004)] == (0, 0)
    _, dedup = policy_event_counts(pages, names, {"sunday": "n_sunday"}, 2004, 2007, dedupe=True)
    assert {(r["unit"], r["year"]): r["n_sunday"] for r in dedup.collect()}[("AL", 2005)] == 1


def _sim_panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for u in range(20):
        tax = 1.0
        jump = rng.choice([2006, 2009, None, None])
        for t in range(2003, 2013):
            if jump is not None and t == jump:
                tax += 0.5
            y = 10 + u * 0.1 + 0.2 * (t - 2003) - (1.0 if (jump is not None and t >= jump) else 0) + rng.normal() * 0.3
            rows.append((f"U{u:02d}", t, float(tax), float(y), float(rng.normal())))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["unit", "year", "tax", "rate", "cov"]))


def test_features_and_causal(spark):
    p = features(_sim_panel(spark), ["unit"], "year", "tax", ["rate", "cov"])
    assert {"tax_delta", "tax_increase_event", "rate_lag1", "cov_lag2"} <= set(p.columns)
    res = causal(p, "unit", "year", "tax_increase_event", ["rate"], ["cov"], n_draws=5)
    es = res["event_study"].collect()
    assert len(es) == 10
    post = [r["coef"] for r in es if r["event_time"] >= 0 and r["coef"] is not None]
    assert np.mean(post) < -0.5
    s = res["summary"].first()
    assert s["nobs"] == 200 and 0 < s["r2"] <= 1
    dyn = {r["event_time"]: r["att"] for r in res["att_dynamic"].collect()}
    assert dyn[0] < -0.5


def test_text_embeddings_and_predict(spark):
    grid = spark.createDataFrame([(u, t) for u in ("AL", "BL", "GL") for t in range(2003, 2009)], "unit string, year int")
    ev = spark.createDataFrame([("AL", 2004, "sunday", "Sunday sales allowed", 1), ("AL", 2004, "tax", "Beer tax raised", 2),
                                ("BL", 2006, "underage", "Purchase age enforcement", 1),
                                ("GL", 2007, "tax", "Beer tax lowered", 1)],
                               "unit string, year int, topic string, change string, pos int")
    emb = text_embeddings(grid, ev, ["unit", "year"], F.concat_ws(": ", "topic", "change"), ["topic", "pos"],
                          "No change recorded.", max_features=64, dims=4)
    rows = {(r["unit"], r["year"]): r for r in emb.collect()}
    assert len(rows) == 18
    assert rows[("AL", 2004)]["policy_text"] == "sunday: Sunday sales allowed ; tax: Beer tax raised"
    assert rows[("AL", 2003)]["policy_text"] == "No change recorded."
    assert all(len(r["embedding"]) == 4 for r in rows.values())
    panel = _sim_panel(spark)
    ev_, pred = predict(panel, ["tax", "cov"], "rate", ["unit", "year"], "year", "rate",
                        (2003, 2008), (2009, 2010), (2011, 2012),
                        models={"ElasticNet": {"scale": True, "kind": "enet"}})
    r = ev_.first()
    assert r["n_train"] == 120 and r["n_val"] == 40 and r["n_test"] == 40
    assert pred.count() == 40


def test_the_last_block_of_a_unit_gives_its_current_value(spark):
    names = spark.createDataFrame([("Ruritania", "RU")], "name string, code string")
    body = "\n".join(["Ruritania", "RU", "1/1/2020", "$0.30", "Ruritania", "RU", "1/1/2021", "$0.70"])
    pages = spark.createDataFrame([("p1", body)], "page_id string, text string")
    none = spark.createDataFrame([], "page_id string, text string")
    got = {r["year"]: r["value"] for r in parse_policy_pages(pages, none, names, 2019, 2020).collect()}
    assert got == {2019: 0.7, 2020: 0.7}
