"""Block parser and timeline parser on literal pages (two units, invented names)."""

from pyspark.sql import functions as F

from panelcraft.operators.segment import (block_fields, current_values, interval_values, line_tokens,
                                          segment_blocks, timeline_events)

NAMES = [("Alpha Land", "AL"), ("Beta Land", "BL"), ("Gamma Land", "GL")]

VALUE_PAGE = """# Beer tax
| --- | --- |
![logo](x.png)
Alpha Land
AL
1/1/2020
$1.05
3 Citations

Beta Land
BL
7/1/2019
$0.20
$0.30
Gamma Land
no code line here
"""

INTERVAL_PAGE = """intro line
Alpha Land
AL
1/1/2003
12/31/2010
$0.50
Alpha Land
AL
1/1/2011
12/31/2023
Beta Land
BL
1/1/2003
"""


def _pages(spark, text):
    return spark.createDataFrame([(1, text)], "page_id long, text string")


def _names(spark):
    return spark.createDataFrame(NAMES, "name string, code string")


def test_line_tokens_drop_rules_images_blanks(spark):
    toks = [r["token"] for r in line_tokens(_pages(spark, VALUE_PAGE), "page_id", "text").orderBy("pos").collect()]
    assert toks[0] == "# Beer tax"
    assert "| --- | --- |" not in toks and not any(t.startswith("![") for t in toks) and "" not in toks


def test_two_blocks_first_name_second_code(spark):
    b = segment_blocks(line_tokens(_pages(spark, VALUE_PAGE), "page_id", "text"), ["page_id"], "pos", "token",
                       _names(spark))
    heads = b.groupBy("block_no", "block_name", "block_code").count().orderBy("block_no").collect()
    assert len(heads) == 2
    assert heads[0]["block_name"] == "Alpha Land"
    assert heads[1]["block_code"] == "BL"
    # "Gamma Land" without its code does not start a block: it stays inside block 2
    assert heads[1]["count"] == 7


def test_current_values_first_date_first_amount(spark):
    b = segment_blocks(line_tokens(_pages(spark, VALUE_PAGE), "page_id", "text"), ["page_id"], "pos", "token",
                       _names(spark))
    cur = {r["unit"]: r for r in current_values(block_fields(b, ["page_id"], "pos", "token")).collect()}
    assert cur["AL"]["as_of"] == "1/1/2020" and cur["AL"]["value"] == 1.05
    assert cur["BL"]["value"] == 0.20


def test_intervals_need_two_dates_and_keep_missing_amount(spark):
    b = segment_blocks(line_tokens(_pages(spark, INTERVAL_PAGE), "page_id", "text"), ["page_id"], "pos", "token",
                       _names(spark))
    iv = interval_values(block_fields(b, ["page_id"], "pos", "token")).orderBy("start_dt").collect()
    assert [r["unit"] for r in iv] == ["AL", "AL"]  # BL has one date only
    assert iv[0]["value"] == 0.5 and iv[1]["value"] is None
    assert str(iv[1]["start_dt"]) == "2011-01-01"


TIMELINE = (
    "header text Change for Alpha Land in 2005 * **Jurisdiction:** x Effective Date of Change:**3/15/2005 "
    "**Change:**Sunday sales allowed\n"
    "Change for  Beta Land in 2007 * **Jurisdiction:** Effective Date of Change:**1/1/2007 no change field\n"
    "Change for Nowhere in 2008 Effective Date of Change:**1/1/2008 **Change:**x\n"
    "Change for Gamma Land in 1999 Effective Date of Change:**1/1/1999 **Change:**too early\n"
    "Change for Alpha Land in 2009 Effective Date of Change:**13/45/2009 **Change:**bad date\n")


def test_timeline_events(spark):
    pages = spark.createDataFrame([(1, "sunday_sales", TIMELINE)], "page_id long, topic string, text string")
    ev = timeline_events(pages, "page_id", "text", _names(spark), "topic", 2003, 2023).orderBy("part_no").collect()
    assert [(r["unit"], r["year"], r["change_text"]) for r in ev] == [
        ("AL", 2005, "Sunday sales allowed"), ("BL", 2007, "Policy change")]


def test_search_resumes_after_the_opening_pair(spark):
    names = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "C")], "name string, code string")
    texts = {1: "x A B C y A B z", 2: "A B C C C C x", 3: "B C C C C C C C", 4: "C", 5: "A", 6: "x y"}

    def greedy(tokens):
        starts, i, code = [], 0, dict([("A", "B"), ("B", "C"), ("C", "C")])
        while i < len(tokens) - 1:
            if code.get(tokens[i]) == tokens[i + 1]:
                starts.append(i)
                i += 2
            else:
                i += 1
        return starts

    rows = [(p, i, t) for p, text in texts.items() for i, t in enumerate(text.split())]
    tokens = spark.createDataFrame(rows, "page_id long, pos int, token string")
    for bucket in (None, F.floor(F.col("pos") / 2), F.floor(F.col("pos") / 100)):
        blocks = segment_blocks(tokens, ["page_id"], "pos", "token", names, bucket=bucket)
        got = {}
        for b in blocks.collect():
            got.setdefault((b["page_id"], b["block_no"], b["block_name"], b["block_code"]), []).append(b["pos"])
        want = {}
        for p, text in texts.items():
            t = text.split()
            for k, i in enumerate(starts := greedy(t)):
                want[p, k + 1, t[i], t[i + 1]] = list(range(i, starts[k + 1] if k + 1 < len(starts) else len(t)))
        assert {k: sorted(v) for k, v in got.items()} == want
