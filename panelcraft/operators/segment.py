"""Semi-structured text: clean lines, block segmentation and block fields.

A page (one row: id + whole text) becomes its cleaned line tokens INSIDE the row (array functions, no
shuffle).  Blocks start where a line is a known name and the next line is that name's code; a block
runs to the next start and lines before the first start are dropped.  For row-per-line inputs with a
possibly huge document, the ordered scans take a ``bucket`` (see ``functions.ordered``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcraft.functions.clean import DATE_MDY_FULL, DOLLAR_PATTERN, TABLE_RULE_PATTERN, normalize_name, parse_mdy
from panelcraft.functions.ordered import running_totals, shift_rows
from panelcraft.functions.partitioning import bounded_broadcast, spread
from panelcraft.session import cut_lineage

# Fixed values of the reference's page formats (markers of the timeline page).
LINE_SPLIT = r"\r\n|\r|\n"
CHANGE_MARKER = "Change for "
JURISDICTION_MARKER = "* **Jurisdiction:**"
EFFECTIVE_DATE_PATTERN = r"Effective Date of Change:\*\*(\d{1,2}/\d{1,2}/\d{4})"
CHANGE_TEXT_PATTERN = r"\*\*Change:\*\*([^\n\r|]+)"
DEFAULT_CHANGE_TEXT = "Policy change"
WS = "[\\s ]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def clean_line_array(text: Column) -> Column:
    """S14 as an array expression: split into lines, strip, drop blank, table-rule and image lines."""
    lines = F.transform(F.split(text, LINE_SPLIT), _strip)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(TABLE_RULE_PATTERN) & ~x.startswith("!["))


def line_tokens(df: DataFrame, doc: str, text: str, pos: str = "pos", token: str = "token") -> DataFrame:
    """One row per kept line token: (doc, pos 0.., token)."""
    return spread(df).select(F.col(doc), F.posexplode(clean_line_array(F.col(text))).alias(pos, token))


def segment_blocks(tokens: DataFrame, part: Sequence[str], pos: str, token: str, names: DataFrame,
                   name_col: str = "name", code_col: str = "code", block: str = "block_no",
                   bucket: Column | None = None, with_heads: bool = True) -> DataFrame:
    """Block number per token (1, 2, ...); tokens before the first block start are dropped.

    A block can start at token i when token i is a name and token i+1 its code; the search for the next start resumes at
    i+2, so a start pair inside a block's opening pair opens nothing.  In a run of adjacent possible starts these are
    the first, third, fifth ...: the parity of the place in the run decides, no row-by-row scan does.

    ``names`` is the dimension (name, code); it is broadcast when its counted size allows.  The start name/code are
    kept as ``block_name``/``block_code`` on every token; ``with_heads=False`` leaves them out for callers that aggregate
    per block anyway (block_name = min_by(token, pos)).  Without ``bucket`` everything comes from one shuffle and sort;
    with it the tokens are written once and a huge document is spread over its buckets.
    """
    part = list(part)
    dim = bounded_broadcast(names.select(F.col(name_col).alias(token), F.col(code_col).alias("__code")))
    start = F.coalesce(F.col("__next") == F.col("__code"), F.lit(False))
    if bucket is None:
        w = Window.partitionBy(*part).orderBy(pos)
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        t = tokens.withColumn("__next", F.lead(token).over(w)).join(dim, on=token, how="left").withColumn("__s", start)
        t = t.withColumns({"__before": F.lag("__s", 1, False).over(w), "__i": F.row_number().over(w)})
        t = t.withColumn("__run", F.max(F.when(F.col("__s") & ~F.col("__before"), F.col("__i"))).over(so_far))
        t = t.withColumn("__start", F.col("__s") & ((F.col("__i") - F.col("__run")) % 2 == 0))
        heads = {} if not with_heads else {
            "block_name": F.last(F.when(F.col("__start"), F.col(token)), ignorenulls=True).over(so_far),
            "block_code": F.last(F.when(F.col("__start"), F.col("__next")), ignorenulls=True).over(so_far)}
        t = t.withColumns({block: F.sum(F.col("__start").cast("int")).over(so_far), **heads}).where(F.col(block) > 0)
        return t.select(*tokens.columns, block, *heads)

    b = "__seg_b"  # one bucket column for all scans: they share the (part, bucket) partitioning
    t = shift_rows(cut_lineage(tokens.withColumn(b, bucket)), part, [pos], [token], [-1], bucket=b, suffix=lambda c, k: "__next")
    t = t.join(dim, on=token, how="left").withColumn("__s", start)
    # a run of possible starts has the number of other tokens before it in common
    t = running_totals(t, part, [pos], {"__others": (~F.col("__s")).cast("int")}, bucket=b)
    place = F.row_number().over(Window.partitionBy(*part, "__others").orderBy(pos))
    t = t.withColumn("__start", F.col("__s") & (place % 2 == F.when(F.col("__others") == 0, 1).otherwise(0)))
    t = cut_lineage(t.select(*tokens.columns, b, "__next", "__start"))
    t = running_totals(t, part, [pos], {block: F.col("__start").cast("int")}, bucket=b).where(F.col(block) > 0)
    if not with_heads:
        return t.select(*tokens.columns, block)
    heads = t.where("__start").select(*part, block, F.col(token).alias("block_name"), F.col("__next").alias("block_code"))
    return t.select(*tokens.columns, block).join(heads, on=[*part, block], how="inner")


def block_fields(blocks: DataFrame, part: Sequence[str], pos: str, token: str,
                 block: str = "block_no", n_dates: int = 2) -> DataFrame:
    """per block the first ``n_dates`` full-match dates and the first dollar amount, in order.

    Output columns ``date_1..date_n`` (text), ``amount`` (double, may be NULL), ``n_dates_found``.
    Every field is a ``min_by`` aggregate (the k-th date: the first date after the (k-1)-th), so no
    block is ever collected into one array -- a huge block is combined map-side like any group.
    """
    keys = [*part, block]
    is_date = F.col(token).rlike(DATE_MDY_FULL)
    amount = F.regexp_extract(F.col(token), DOLLAR_PATTERN, 1)
    heads = blocks.groupBy(*keys, "block_name", "block_code").agg(
        F.min_by(F.when(amount != "", amount), F.when(amount != "", F.col(pos))).alias("__a"))
    dates = blocks.where(is_date).select(*keys, pos, token)
    found = dates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_dates_found"),
                                     F.min_by(token, pos).alias("date_1"), F.min(pos).alias("__p1"))
    out = heads.join(found, on=keys, how="left")
    prev = found.select(*keys, "__p1")
    for i in range(2, n_dates + 1):
        nxt = (dates.join(prev, on=keys).where(F.col(pos) > F.col(f"__p{i - 1}"))
               .groupBy(*keys).agg(F.min_by(token, pos).alias(f"date_{i}"), F.min(pos).alias(f"__p{i}")))
        out = out.join(nxt.drop(f"__p{i}"), on=keys, how="left")
        prev = nxt.select(*keys, f"__p{i}")
    return out.select(*keys, "block_name", "block_code", *[f"date_{i}" for i in range(1, n_dates + 1)],
                      F.col("__a").try_cast("double").alias("amount"),
                      F.coalesce(F.col("n_dates_found"), F.lit(0)).cast("int").alias("n_dates_found"))


def current_values(fields: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """blocks with at least one date -> (``keep``, name, code, as_of, value)."""
    return fields.where(F.col("n_dates_found") >= 1).select(
        *keep, F.col("block_name").alias("unit_name"), F.col("block_code").alias("unit"),
        F.col("date_1").alias("as_of"), F.col("amount").alias("value"))


def interval_values(fields: DataFrame) -> DataFrame:
    """blocks with at least two dates -> (name, code, start, end, value) with parsed dates."""
    return fields.where(F.col("n_dates_found") >= 2).select(
        F.col("block_name").alias("unit_name"), F.col("block_code").alias("unit"),
        parse_mdy(F.col("date_1")).alias("start_dt"), parse_mdy(F.col("date_2")).alias("end_dt"),
        F.col("amount").alias("value"))


def timeline_events(pages: DataFrame, page: str, text: str, names: DataFrame, topic: Column | str,
                    first_year: int | None = None, last_year: int | None = None,
                    name_col: str = "name", code_col: str = "code", aliases: DataFrame | None = None) -> DataFrame:
    """F1 + P3: parse "Change for <name> in ..." sections into (topic, unit_name, unit, date, year, text).

    The page is split in-row (``posexplode(split())``, part 0 skipped); names are normalised and
    looked up in the dimension (plus optional ``aliases`` (alias, name)); unknown names are dropped.
    """
    parts = pages.select(F.col(page), (F.col(topic) if isinstance(topic, str) else topic).alias("topic_key"),
                         F.posexplode(F.split(F.col(text), CHANGE_MARKER)).alias("part_no", "part"))
    parts = parts.where(F.col("part_no") > 0)
    head = _strip(F.split_part(F.col("part"), F.lit(JURISDICTION_MARKER), F.lit(1)))
    raw_name = F.when(F.instr(head, " in ") > 0, normalize_name(F.split_part(head, F.lit(" in "), F.lit(1))))
    date_txt = F.regexp_extract(F.col("part"), EFFECTIVE_DATE_PATTERN, 1)
    change = _strip(F.regexp_extract(F.col("part"), CHANGE_TEXT_PATTERN, 1))
    ev = parts.select(F.col(page), "topic_key", "part_no", raw_name.alias("__raw"),
                      F.when(date_txt != "", date_txt).alias("effective_date"),
                      F.when(F.col("part").rlike(CHANGE_TEXT_PATTERN), change)
                      .otherwise(F.lit(DEFAULT_CHANGE_TEXT)).alias("change_text"))
    dim = names.select(F.col(name_col).alias("__raw"), F.col(name_col).alias("unit_name"),
                       F.col(code_col).alias("unit"))
    if aliases is not None:
        al = aliases.toDF("__raw", "unit_name").join(
            names.select(F.col(name_col).alias("unit_name"), F.col(code_col).alias("unit")), on="unit_name")
        dim = dim.unionByName(al.select("__raw", "unit_name", "unit"))
    ev = ev.join(dim, on="__raw", how="inner")
    ev = ev.withColumn("effective_dt", parse_mdy(F.col("effective_date"))).where(F.col("effective_dt").isNotNull())
    ev = ev.withColumn("year", F.year("effective_dt"))
    if first_year is not None:
        ev = ev.where(F.col("year") >= first_year)
    if last_year is not None:
        ev = ev.where(F.col("year") <= last_year)
    return ev.select(F.col(page), "part_no", "topic_key", "unit_name", "unit", "effective_date", "year", "change_text")
