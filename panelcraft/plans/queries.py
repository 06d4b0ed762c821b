"""Registered queries over the driver tables, each paired with an equivalent DuckDB SQL oracle.

Re-aim of the reference's operators onto the TPC-H-like tables (SURVEY section 7.3): unit = nation
(``c_nationkey`` of the ordering customer), time = order year, unless a query says otherwise.  Every
query reads the whole tables.  Doubles are rounded in BOTH the Spark query and the SQL (parallel sums
reorder additions); counts are BIGINT, years INT.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE_SQL[name] -> str``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcraft.functions.clean import indicator, rate_per
from panelcraft.functions.partitioning import spread
from panelcraft.session import cut_lineage, persisted
from panelcraft.operators.cases import existence_flags, flagged_sums
from panelcraft.operators.panel import key_qa, left_join_sources, missing_rates, time_bounds_expr, time_grid
from panelcraft.plans.solve_sql import inverse_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r(c, n: int = 2) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---------------------------------------------------------------------------------------------
# shared building blocks
# ---------------------------------------------------------------------------------------------

def orders_by_nation(spark: SparkSession, d: str, nation: int | None = None) -> DataFrame:
    """Orders with the customer's nation and the order year (the case table of most queries); ``nation`` is a filter that
    reaches the scan of the customers."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
                                         "o_orderstatus", "o_orderdate",
                                         F.year("o_orderdate").alias("year"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                           F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c if nation is None else c.where(F.col("n_nationkey") == nation), on="o_custkey", how="inner")


def nation_year_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every nation x every order year between the first and the last order year."""
    lo, hi = time_bounds_expr(table(spark, d, "orders").select(F.year("o_orderdate").alias("year")), "year")
    return time_grid(table(spark, d, "nation").select("n_nationkey"), "year", lo, hi)


GRID_SQL = """
SELECT n_nationkey, CAST(y AS INT) AS year
FROM nation, range((SELECT min(year(o_orderdate)) FROM orders),
                   (SELECT max(year(o_orderdate)) FROM orders) + 1) t(y)
"""

ORDERS_NATION_SQL = """
SELECT o.*, CAST(year(o_orderdate) AS INT) AS year, c.c_nationkey AS n_nationkey
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""


# ---------------------------------------------------------------------------------------------
# J9, A2, J13 -- totals of flagged cases
# ---------------------------------------------------------------------------------------------

@register("case_flag_totals", f"""
WITH f AS (
  SELECT l_orderkey, bool_or(l_returnflag = 'R') AS has_return,
         bool_or(l_quantity BETWEEN 45 AND 50) AS has_bulk
  FROM lineitem WHERE l_returnflag = 'R' OR l_quantity BETWEEN 45 AND 50 GROUP BY l_orderkey)
SELECT n_nationkey, year, CAST(count(*) AS BIGINT) AS n_orders,
       round(sum(o_totalprice), 2) AS revenue,
       round(coalesce(sum(CASE WHEN coalesce(has_return, false) THEN o_totalprice END), 0), 2) AS revenue_returned,
       round(coalesce(sum(CASE WHEN coalesce(has_bulk, false) THEN o_totalprice END), 0), 2) AS revenue_bulk
FROM ({ORDERS_NATION_SQL}) o LEFT JOIN f ON f.l_orderkey = o.o_orderkey
GROUP BY n_nationkey, year
""")
def q_case_flag_totals(spark, d):
    li = table(spark, d, "lineitem")
    flags = existence_flags(li, ["l_orderkey"], {
        "has_return": F.col("l_returnflag") == "R",
        "has_bulk": F.col("l_quantity").between(45, 50),
    }).withColumnRenamed("l_orderkey", "o_orderkey")
    cases = orders_by_nation(spark, d)
    out = flagged_sums(cases, ["o_orderkey"], ["n_nationkey", "year"], "o_totalprice", flags,
                       ["has_return", "has_bulk"], total_name="revenue",
                       out_names={"has_return": "revenue_returned", "has_bulk": "revenue_bulk"},
                       count_name="n_orders")
    return out.select(
        "n_nationkey", "year", "n_orders", r("revenue").alias("revenue"),
        r("revenue_returned").alias("revenue_returned"), r("revenue_bulk").alias("revenue_bulk"))


# ---------------------------------------------------------------------------------------------
# P1, J1, P6, N10 -- grid with three left-joined sources
# ---------------------------------------------------------------------------------------------

def panel_grid(spark, d, nation: int | None = None) -> DataFrame:
    on = orders_by_nation(spark, d, nation)
    # two measures of the same (nation, year) key from one pass: the filtered average is conditional
    # (NULL where no order qualifies, exactly like a left-joined source without that key)
    big_urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 480000)
    src_orders = on.groupBy("n_nationkey", "year").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("revenue"),
        F.avg(F.when(big_urgent, F.col("o_totalprice"))).alias("urgent_big_avg"))
    li = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                           F.col("s_nationkey").alias("n_nationkey"))
    s = s if nation is None else s.where(F.col("n_nationkey") == nation)
    src_ship = li.join(s, on="l_suppkey").groupBy("n_nationkey", "year").agg(
        F.count(F.lit(1)).alias("n_shipped"))
    grid = nation_year_grid(spark, d)
    grid = grid if nation is None else grid.where(F.col("n_nationkey") == nation)
    return left_join_sources(grid, ["n_nationkey", "year"],
                             [src_orders, src_ship], zero_fill_cols=["n_orders", "n_shipped"])


PANEL_GRID_SQL = f"""
WITH g AS ({GRID_SQL}),
on_ AS ({ORDERS_NATION_SQL}),
a AS (SELECT n_nationkey, year, count(*) AS n_orders, sum(o_totalprice) AS revenue FROM on_ GROUP BY 1, 2),
b AS (SELECT n_nationkey, year, avg(o_totalprice) AS urgent_big_avg FROM on_
      WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 480000 GROUP BY 1, 2),
c AS (SELECT s_nationkey AS n_nationkey, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n_shipped
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT g.n_nationkey, g.year, CAST(coalesce(a.n_orders, 0) AS BIGINT) AS n_orders, a.revenue,
       b.urgent_big_avg, CAST(coalesce(c.n_shipped, 0) AS BIGINT) AS n_shipped
FROM g LEFT JOIN a USING (n_nationkey, year) LEFT JOIN b USING (n_nationkey, year)
       LEFT JOIN c USING (n_nationkey, year)
"""


@register("panel_grid_left", f"""
SELECT n_nationkey, year, n_orders, round(revenue, 2) AS revenue, round(urgent_big_avg, 6) AS urgent_big_avg,
       n_shipped FROM ({PANEL_GRID_SQL})
""")
def q_panel_grid_left(spark, d):
    p = panel_grid(spark, d)
    return p.select("n_nationkey", "year", "n_orders", r("revenue").alias("revenue"),
                    r("urgent_big_avg", 6).alias("urgent_big_avg"), "n_shipped")


# ---------------------------------------------------------------------------------------------
# P7, N2 -- rates with zero denominators
# ---------------------------------------------------------------------------------------------

RATES_SQL = f"""
WITH p AS ({PANEL_GRID_SQL}),
den AS (SELECT c_nationkey AS n_nationkey,
               count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE' AND c_acctbal < 0) AS n_den
        FROM customer GROUP BY 1)
SELECT p.*, den.n_den,
       CAST(p.n_orders AS DOUBLE) / nullif(CAST(den.n_den AS DOUBLE) * 1000.0, 0) * 100000.0 AS orders_per_100k
FROM p LEFT JOIN den USING (n_nationkey)
"""


def panel_rates(spark, d) -> DataFrame:
    den = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count_if((F.col("c_mktsegment") == "AUTOMOBILE") & (F.col("c_acctbal") < 0)).alias("n_den"))
    p = panel_grid(spark, d).join(den, on="n_nationkey", how="left")
    return p.withColumn("orders_per_100k", rate_per("n_orders", "n_den", 100000.0, 1000.0))


@register("panel_rates", f"""
SELECT n_nationkey, year, CAST(n_den AS BIGINT) AS n_den, round(orders_per_100k, 4) AS orders_per_100k
FROM ({RATES_SQL})
""")
def q_panel_rates(spark, d):
    return panel_rates(spark, d).select("n_nationkey", "year", F.col("n_den").cast("bigint").alias("n_den"),
                                        r("orders_per_100k", 4).alias("orders_per_100k"))


# ---------------------------------------------------------------------------------------------
# A11 -- missing rate per column
# ---------------------------------------------------------------------------------------------

@register("panel_missingness", f"""
WITH p AS ({RATES_SQL})
SELECT "column", round(missing_rate, 6) AS missing_rate FROM (
  SELECT 'n_orders' AS "column", avg(CASE WHEN n_orders IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS missing_rate FROM p
  UNION ALL SELECT 'revenue', avg(CASE WHEN revenue IS NULL OR isnan(revenue) THEN 1.0 ELSE 0.0 END)::DOUBLE FROM p
  UNION ALL SELECT 'urgent_big_avg', avg(CASE WHEN urgent_big_avg IS NULL OR isnan(urgent_big_avg) THEN 1.0 ELSE 0.0 END)::DOUBLE FROM p
  UNION ALL SELECT 'n_shipped', avg(CASE WHEN n_shipped IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE FROM p
  UNION ALL SELECT 'orders_per_100k', avg(CASE WHEN orders_per_100k IS NULL OR isnan(orders_per_100k) THEN 1.0 ELSE 0.0 END)::DOUBLE FROM p)
""")
def q_panel_missingness(spark, d):
    p = panel_rates(spark, d)
    m = missing_rates(p, ["n_orders", "revenue", "urgent_big_avg", "n_shipped", "orders_per_100k"])
    return m.select("column", r("missing_rate", 6).alias("missing_rate"))


# ---------------------------------------------------------------------------------------------
# X5 -- key QA of a (customer, year) panel that has duplicates and gaps
# ---------------------------------------------------------------------------------------------

@register("panel_key_qa", """
WITH k AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1, 2),
s AS (SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_keys,
             CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicate_keys,
             CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_units, CAST(count(DISTINCT year) AS BIGINT) AS n_periods
      FROM k)
SELECT *, n_units * n_periods AS n_expected, n_units * n_periods - n_keys AS n_missing_keys FROM s
""")
def q_panel_key_qa(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return key_qa(o, ["o_custkey"], "year")


# ---------------------------------------------------------------------------------------------
# W1, W2, P15 -- lags, first difference, increase indicator (flagship)
# ---------------------------------------------------------------------------------------------

def nation_year_prices(spark, d) -> DataFrame:
    return orders_by_nation(spark, d).groupBy("n_nationkey", "year").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price"))


PRICES_SQL = f"""
SELECT n_nationkey, year, count(*) AS n_orders, avg(o_totalprice) AS mean_price
FROM ({ORDERS_NATION_SQL}) GROUP BY 1, 2
"""


@register("lag_diff_features", f"""
WITH p AS ({PRICES_SQL})
SELECT n_nationkey, year, CAST(n_orders AS BIGINT) AS n_orders, round(mean_price, 6) AS mean_price,
       round(mean_price - lag(mean_price) OVER w, 6) AS mean_price_delta,
       CAST(coalesce(mean_price - lag(mean_price) OVER w > 0, false) AS INT) AS price_increase,
       round(lag(mean_price, 1) OVER w, 6) AS mean_price_lag1, round(lag(mean_price, 2) OVER w, 6) AS mean_price_lag2,
       CAST(lag(n_orders, 1) OVER w AS BIGINT) AS n_orders_lag1, CAST(lag(n_orders, 2) OVER w AS BIGINT) AS n_orders_lag2
FROM p WINDOW w AS (PARTITION BY n_nationkey ORDER BY year)
""")
def q_lag_diff_features(spark, d):
    from panelcraft.operators.features import add_diff, add_lags
    p = nation_year_prices(spark, d)
    p = add_diff(p, ["n_nationkey"], "year", "mean_price", "mean_price_delta", "price_increase", 0.0)
    p = add_lags(p, ["n_nationkey"], "year", ["mean_price", "n_orders"], [1, 2])
    return p.select("n_nationkey", "year", "n_orders", r("mean_price", 6).alias("mean_price"),
                    r("mean_price_delta", 6).alias("mean_price_delta"), "price_increase",
                    r("mean_price_lag1", 6).alias("mean_price_lag1"), r("mean_price_lag2", 6).alias("mean_price_lag2"),
                    "n_orders_lag1", "n_orders_lag2")


# ---------------------------------------------------------------------------------------------
# G1, A6, J11, P16, P17 -- treatment cohorts, event time and dummies
# ---------------------------------------------------------------------------------------------

# treatment event: a year-on-year increase of the nation's mean order price above TREAT_SD standard
# deviations of that nation's own year-on-year changes (scale-free: treated and never-treated nations
# exist at every scale factor)
TREAT_SD = 1.2
EVENT_TERMS = [k for k in range(-5, 6) if k != -1]


def _evt_name(k: int) -> str:
    return f"evt_m{abs(k)}" if k < 0 else f"evt_p{k}"


def treated_panel(spark, d) -> DataFrame:
    from panelcraft.operators.features import add_diff, add_event_dummies, add_event_time
    p = nation_year_prices(spark, d)
    p = add_diff(p, ["n_nationkey"], "year", "mean_price", "mean_price_delta", "increase", threshold_sd=TREAT_SD)
    p = add_event_time(p, ["n_nationkey"], "year", "increase", "treatment_year", "event_time")
    p, _ = add_event_dummies(p, "event_time", "treatment_year")
    return p


TREATED_SQL = f"""
WITH p AS ({PRICES_SQL}),
d0 AS (SELECT *, mean_price - lag(mean_price) OVER (PARTITION BY n_nationkey ORDER BY year) AS dd FROM p),
d AS (SELECT *, stddev_samp(dd) OVER (PARTITION BY n_nationkey) AS sd FROM d0),
t AS (SELECT n_nationkey, min(year) AS treatment_year FROM d WHERE coalesce(dd > {TREAT_SD}::DOUBLE * sd, false)
      GROUP BY 1)
SELECT d.*, t.treatment_year, CAST(d.year - t.treatment_year AS INT) AS event_time
FROM d LEFT JOIN t USING (n_nationkey)
"""

_DUMMY_SQL = ",\n       ".join(
    f"CAST(coalesce(event_time = {k} AND treatment_year IS NOT NULL, false) AS INT) AS {_evt_name(k)}"
    for k in EVENT_TERMS)


@register("treatment_cohorts", f"""
SELECT n_nationkey, year, treatment_year, event_time,
       {_DUMMY_SQL}
FROM ({TREATED_SQL})
""")
def q_treatment_cohorts(spark, d):
    p = treated_panel(spark, d)
    return p.select("n_nationkey", "year", "treatment_year", "event_time", *[_evt_name(k) for k in EVENT_TERMS])


# ---------------------------------------------------------------------------------------------
# W3 -- lag by previous observed wave on a gappy (user, day) panel
# ---------------------------------------------------------------------------------------------

def user_day_panel(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    return e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("v"))


@register("wave_lag", """
WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_events, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT user_id, day, CAST(n_events AS BIGINT) AS n_events, round(v, 2) AS v,
       round(lag(v) OVER w, 2) AS v_lag1, lag(day) OVER w AS day_lag1,
       CAST(date_diff('day', lag(day) OVER w, day) AS INT) AS gap_days
FROM p WINDOW w AS (PARTITION BY user_id ORDER BY day)
""")
def q_wave_lag(spark, d):
    from panelcraft.operators.features import add_lags
    p = add_lags(user_day_panel(spark, d), ["user_id"], "day", ["v", "day"], [1])
    return p.select("user_id", "day", "n_events", r("v").alias("v"), r("v_lag1").alias("v_lag1"), "day_lag1",
                    F.datediff("day", "day_lag1").alias("gap_days"))


# ---------------------------------------------------------------------------------------------
# A3 -- annual mean of a monthly series; J6 -- full outer merge of three series
# ---------------------------------------------------------------------------------------------

@register("annual_mean_series", f"""
WITH m AS (SELECT n_nationkey, date_trunc('month', o_orderdate) AS month, avg(o_totalprice) AS monthly_mean
           FROM ({ORDERS_NATION_SQL}) GROUP BY 1, 2)
SELECT n_nationkey, CAST(year(month) AS INT) AS year, round(avg(monthly_mean), 6) AS mean_of_months
FROM m GROUP BY 1, 2
""")
def q_annual_mean_series(spark, d):
    from panelcraft.operators.series import annual_mean
    m = (orders_by_nation(spark, d)
         .groupBy("n_nationkey", F.date_trunc("month", "o_orderdate").alias("month"))
         .agg(F.avg("o_totalprice").alias("monthly_mean")))
    a = annual_mean(m, ["n_nationkey"], "month", "monthly_mean", "mean_of_months")
    return a.select("n_nationkey", "year", r("mean_of_months", 6).alias("mean_of_months"))


SERIES_TYPES = ["view", "click", "purchase", "signup", "error"]


@register("series_outer", "\n".join([
    "WITH " + ",\n".join(
        f"s_{t} AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS {t}_value FROM events "
        f"WHERE event_type = '{t}' GROUP BY 1, 2)" for t in SERIES_TYPES),
    "SELECT user_id, day, " + ", ".join(f"round({t}_value, 2) AS {t}_value" for t in SERIES_TYPES),
    "FROM s_view " + " ".join(f"FULL OUTER JOIN s_{t} USING (user_id, day)" for t in SERIES_TYPES[1:])]))
def q_series_outer(spark, d):
    from panelcraft.operators.series import long_to_wide
    # the three series live in one long table: the full outer merge on (user, day) is one pivot with the
    # known series names (one scan, one shuffle); ``outer_merge`` is for series from separate sources
    e = (table(spark, d, "events").where(F.col("event_type").isin(SERIES_TYPES))
         .select("user_id", F.to_date("ts").alias("day"), "event_type", "value"))
    m = long_to_wide(e, ["user_id", "day"], "event_type", "value", SERIES_TYPES, agg="sum")
    return m.select("user_id", "day", *[r(t).alias(f"{t}_value") for t in SERIES_TYPES])


# ---------------------------------------------------------------------------------------------
# J10, N8, N9 -- point-in-interval lookup with first match and default
# ---------------------------------------------------------------------------------------------

@register("interval_lookup", """
WITH iv AS (
  SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS s,
         CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS e,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS v
  FROM orders),
pts AS (SELECT c_custkey, c_acctbal, CAST(y AS INT) AS year, make_date(CAST(y AS INT), 1, 1) AS p
        FROM customer, (SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS y FROM orders)),
hits AS (SELECT c_custkey, year, v, 1 AS hit,
                row_number() OVER (PARTITION BY c_custkey, year ORDER BY s, o_orderkey) AS rn
         FROM pts JOIN iv ON iv.o_custkey = pts.c_custkey AND iv.s <= pts.p AND pts.p <= iv.e)
SELECT c_custkey, year, round(CASE WHEN h.hit = 1 THEN h.v ELSE c_acctbal END, 2) AS value,
       coalesce(h.hit = 1, false) AS matched
FROM pts LEFT JOIN (SELECT * FROM hits WHERE rn = 1) h USING (c_custkey, year)
""")
def q_interval_lookup(spark, d):
    from panelcraft.functions.clean import jan_first
    from panelcraft.functions.ordered import shift_rows
    from panelcraft.operators.intervals import point_in_interval
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    o = shift_rows(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderdate"], [-1],
                   bucket=F.year("o_orderdate"))
    iv = cut_lineage(o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.to_date("o_orderdate").alias("s"),
                              F.to_date("o_orderdate_lead1").alias("e"),
                              F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v")))
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"))
    pts = time_grid(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "year", *time_bounds_expr(years, "year")) \
        .withColumn("p", jan_first("year"))
    res = point_in_interval(pts, iv, ["c_custkey"], "p", "s", "e", "v", out="value",
                            tiebreak=["o_orderkey"], default="c_acctbal")
    return res.select("c_custkey", "year", r("value").alias("value"), "matched")


# ---------------------------------------------------------------------------------------------
# U5, J12, A14 -- impute missing periods from a base period and a national ratio
# ---------------------------------------------------------------------------------------------

IMPUTE_BASE = 1997


@register("base_period_impute", f"""
WITH on_ AS ({ORDERS_NATION_SQL}),
loaded AS (SELECT n_nationkey, year, sum(o_totalprice) AS revenue FROM on_ WHERE year >= {IMPUTE_BASE} GROUP BY 1, 2),
nat AS (SELECT year, sum(o_totalprice) AS nat_rev FROM on_ GROUP BY 1),
ratio AS (SELECT year, nat_rev / (SELECT nat_rev FROM nat WHERE year = {IMPUTE_BASE}) AS ratio FROM nat),
g AS ({GRID_SQL}),
miss AS (SELECT g.* FROM g ANTI JOIN loaded USING (n_nationkey, year)),
base AS (SELECT n_nationkey, revenue AS base_rev FROM loaded WHERE year = {IMPUTE_BASE})
SELECT n_nationkey, year, round(revenue, 2) AS revenue, imputed FROM (
  SELECT n_nationkey, year, revenue, 0 AS imputed FROM loaded
  UNION ALL
  SELECT miss.n_nationkey, miss.year, base.base_rev * ratio.ratio, 1
  FROM miss JOIN base USING (n_nationkey) JOIN ratio USING (year))
""")
def q_base_period_impute(spark, d):
    from panelcraft.operators.intervals import impute_from_base, ratio_to_base
    # one pass over the cases: (unit, period) totals, written once; loaded cells, national totals and
    # the base value all derive from this small table
    cells = cut_lineage(orders_by_nation(spark, d).groupBy("n_nationkey", "year").agg(
        F.sum("o_totalprice").alias("revenue")))
    loaded = cells.where(F.col("year") >= IMPUTE_BASE)
    nat = cells.groupBy("year").agg(F.sum("revenue").alias("nat_rev"))
    ratios = ratio_to_base(nat, "year", "nat_rev", IMPUTE_BASE)
    out = impute_from_base(loaded, nation_year_grid(spark, d), ["n_nationkey"], "year", "revenue", ratios,
                           IMPUTE_BASE)
    return out.select("n_nationkey", "year", r("revenue").alias("revenue"), "imputed")


# ---------------------------------------------------------------------------------------------
# W4, W5, P23, J14, O5 -- dedupe, source priority, shortest code
# ---------------------------------------------------------------------------------------------

@register("dedupe_keep_last", """
SELECT user_id, day, event_type, event_id, value FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, event_type, event_id, value,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""")
def q_dedupe_keep_last(spark, d):
    from panelcraft.operators.dedupe import keep_last
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return keep_last(e, ["user_id", "day", "event_type"], ["ts", "event_id"], ["event_id", "value"])


PRIORITIES = {"purchase": 3, "click": 2, "view": 1}


@register("source_priority", """
SELECT user_id, day, event_type, event_id, priority FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, event_type, event_id,
         CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS priority,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE)
                            ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END DESC,
                                     ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""")
def q_source_priority(spark, d):
    from panelcraft.operators.dedupe import consolidate_sources
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id", "ts")
    out = consolidate_sources(e, ["user_id", "day"], "event_type", PRIORITIES, tiebreak=["ts", "event_id"])
    return out.select("user_id", "day", "event_type", "event_id", "priority")


@register("shortest_code", """
SELECT p_brand, p_name, p_partkey, CAST(length(p_name) AS INT) AS name_len FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name), p_name, p_partkey) AS rn FROM part)
WHERE rn = 1
""")
def q_shortest_code(spark, d):
    from panelcraft.operators.dedupe import keep_first
    p = table(spark, d, "part").withColumn("name_len", F.length("p_name"))
    return keep_first(p, ["p_brand"], ["name_len", "p_name", "p_partkey"], ["p_name", "p_partkey", "name_len"])


# ---------------------------------------------------------------------------------------------
# A5 -- per-topic counts on the full (nation, month) grid
# ---------------------------------------------------------------------------------------------

@register("topic_counts_pivot", f"""
WITH on_ AS (SELECT *, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS month_idx
             FROM ({ORDERS_NATION_SQL})),
g AS (SELECT n_nationkey, CAST(m AS INT) AS month_idx FROM nation,
      range((SELECT min(month_idx) FROM on_), (SELECT max(month_idx) FROM on_) + 1) t(m)),
c AS (SELECT n_nationkey, month_idx, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
             count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS n_high
      FROM on_ WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2)
SELECT g.n_nationkey, g.month_idx, CAST(coalesce(n_urgent, 0) AS BIGINT) AS n_urgent,
       CAST(coalesce(n_high, 0) AS BIGINT) AS n_high
FROM g LEFT JOIN c USING (n_nationkey, month_idx)
""")
def q_topic_counts_pivot(spark, d):
    from panelcraft.operators.series import topic_counts_on_grid
    on = orders_by_nation(spark, d).withColumn(
        "month_idx", (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int"))
    lo, hi = time_bounds_expr(on.select("month_idx"), "month_idx")
    grid = time_grid(table(spark, d, "nation").select("n_nationkey"), "month_idx", lo, hi)
    return topic_counts_on_grid(on, grid, ["n_nationkey", "month_idx"], "o_orderpriority",
                                {"1-URGENT": "n_urgent", "2-HIGH": "n_high"})


# ---------------------------------------------------------------------------------------------
# W5, P23 -- priority by source AND flag; J14, P3 -- names matched to codes; P12 -- ranges by period
# ---------------------------------------------------------------------------------------------

FLAG_RULES = [(3, {"event_type": "purchase", "flag": "observed"}), (2, {"event_type": "click"})]


@register("source_flag_priority", """
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, event_id, ts,
                  CASE WHEN value >= 50 THEN 'observed' ELSE 'missing' END AS flag FROM events),
s AS (SELECT *, CASE WHEN event_type = 'purchase' AND flag = 'observed' THEN 3 WHEN event_type = 'click' THEN 2 ELSE 1 END AS priority FROM e)
SELECT user_id, day, event_type, flag, event_id, priority FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY priority DESC, ts DESC, event_id DESC) AS rn FROM s) WHERE rn = 1
""")
def q_source_flag_priority(spark, d):
    from panelcraft.operators.dedupe import consolidate_sources
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id", "ts",
                                         F.when(F.col("value") >= 50, "observed").otherwise("missing").alias("flag"))
    out = consolidate_sources(e, ["user_id", "day"], None, FLAG_RULES, tiebreak=["ts", "event_id"], default=1)
    return out.select("user_id", "day", "event_type", "flag", "event_id", "priority")


@register("name_lookup", """
WITH e AS (
  SELECT c_custkey, n_nationkey, 'L' || c_custkey AS code, CASE c_custkey % 4
    WHEN 0 THEN n_name WHEN 1 THEN chr(160) || replace(n_name, '_', '  ') || ' ' WHEN 2 THEN 'N-' || n_nationkey ELSE 'other ' || n_name END AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (
  SELECT n_nationkey, code FROM e WHERE c_custkey % 4 IN (0, 1) OR (c_custkey % 4 = 2 AND n_nationkey % 2 = 0)),
best AS (
  SELECT n_nationkey, arg_min(code, length(code) * 1000000000 + CAST(substr(code, 2) AS BIGINT)) AS location_code, count(*) AS k FROM m GROUP BY 1)
SELECT n_nationkey, replace(n_name, '_', ' ') AS n_name, location_code, CAST(coalesce(k, 0) AS BIGINT) AS n_entries
FROM nation LEFT JOIN best USING (n_nationkey)
""")
def q_name_lookup(spark, d):
    from panelcraft.operators.dedupe import inverse_lookup
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    turn = F.col("c_custkey") % 4
    spelled = (F.when(turn == 0, F.col("n_name"))
               .when(turn == 1, F.concat(F.lit("\u00a0"), F.replace("n_name", F.lit("_"), F.lit("  ")), F.lit(" ")))
               .when(turn == 2, F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")))
               .otherwise(F.concat(F.lit("other "), F.col("n_name"))))
    entries = c.select(spelled.alias("name"), F.concat(F.lit("L"), F.col("c_custkey").cast("string")).alias("location_code"))
    plain = F.replace("n_name", F.lit("_"), F.lit(" "))
    aliases = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")), plain).toDF("a", "n")
    aliases = aliases.unionByName(nation.select(F.col("n_name").alias("a"), plain.alias("n")))
    return inverse_lookup(nation.withColumn("n_name", plain), "n_name", entries, "name", "location_code", aliases,
                          out="location_code", count="n_entries")


# the coding of a quantity as "bulk" changes with the year of shipping; the last rule to begin holds
BULK_RULES = [(1992, 1994, 40, 50), (1995, 1996, 45, 48), (1996, 1999, 30, 35)]


@register("flagged_by_period", f"""
WITH rules AS (SELECT * FROM (VALUES {", ".join(map(str, BULK_RULES))}) r(a, z, lo, hi)),
per AS (SELECT y AS year, arg_max(lo, a) AS lo, arg_max(hi, a) AS hi FROM range(1992, 2000) t(y) JOIN rules ON y BETWEEN a AND z GROUP BY y),
f AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN per ON year(l_shipdate) = per.year WHERE l_quantity BETWEEN lo AND hi)
SELECT n_nationkey, o.year, CAST(count(*) AS BIGINT) AS n_orders, round(sum(o_totalprice), 2) AS revenue,
       round(coalesce(sum(CASE WHEN f.l_orderkey IS NOT NULL THEN o_totalprice END), 0), 2) AS revenue_bulk
FROM ({ORDERS_NATION_SQL}) o LEFT JOIN f ON f.l_orderkey = o.o_orderkey GROUP BY n_nationkey, o.year
""")
def q_flagged_by_period(spark, d):
    from panelcraft.operators.cases import flags_by_period, thresholds_by_period
    rules = spark.createDataFrame(BULK_RULES, "period_from int, period_to int, lo int, hi int")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", F.year("l_shipdate").alias("ship_year"))
    flags = flags_by_period(li, ["o_orderkey"], "l_quantity", "ship_year", thresholds_by_period(rules, "ship_year"), "has_bulk")
    out = flagged_sums(orders_by_nation(spark, d), ["o_orderkey"], ["n_nationkey", "year"], "o_totalprice", flags, ["has_bulk"],
                       total_name="revenue", out_names={"has_bulk": "revenue_bulk"}, count_name="n_orders")
    return out.select("n_nationkey", "year", "n_orders", r("revenue").alias("revenue"), r("revenue_bulk").alias("revenue_bulk"))


# ---------------------------------------------------------------------------------------------
# T1, A9, P21 -- ordered text aggregation onto a (unit, time) grid with a default text
# ---------------------------------------------------------------------------------------------

NO_TEXT = "No order recorded."


@register("event_text_agg", f"""
WITH g AS (SELECT c_custkey, CAST(y AS INT) AS year FROM customer,
           range((SELECT min(year(o_orderdate)) FROM orders), (SELECT max(year(o_orderdate)) FROM orders) + 1) t(y)),
t AS (SELECT o_custkey AS c_custkey, CAST(year(o_orderdate) AS INT) AS year,
             string_agg(o_orderpriority || ': ' || o_orderstatus, ' ; ' ORDER BY o_orderdate, o_orderkey) AS policy_text
      FROM orders GROUP BY 1, 2)
SELECT c_custkey, year, coalesce(policy_text, '{NO_TEXT}') AS policy_text FROM g LEFT JOIN t USING (c_custkey, year)
""")
def q_event_text_agg(spark, d):
    from panelcraft.operators.text import text_panel
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"),
                                         "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus")
    lo, hi = time_bounds_expr(o, "year")
    grid = time_grid(table(spark, d, "customer").select("c_custkey"), "year", lo, hi)
    return text_panel(grid, o, ["c_custkey", "year"], F.concat_ws(": ", "o_orderpriority", "o_orderstatus"),
                      ["o_orderdate", "o_orderkey"], default=NO_TEXT, bucket=F.date_trunc("month", "o_orderdate"))


# ---------------------------------------------------------------------------------------------
# S14, W7 -- block segmentation of conversations (start = a role followed by its partner role)
# ---------------------------------------------------------------------------------------------

# block-start dimension: (line value, value that must follow it)
TURN_STARTS = [("user", "assistant"), ("system", "user"), ("assistant", "user")]


@register("block_segments", """
WITH RECURSIVE c AS (
  SELECT *, lead(role) OVER w AS next_role, row_number() OVER w AS i FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT *, (role = 'user' AND next_role = 'assistant') OR (role = 'system' AND next_role = 'user')
             OR (role = 'assistant' AND next_role = 'user') AS can_start FROM c),
walk(conv_id, i, started) AS (
  SELECT conv_id, i, coalesce(can_start, false) FROM f WHERE i = 1
  UNION ALL
  SELECT f.conv_id, f.i, coalesce(f.can_start, false) AND NOT walk.started FROM walk JOIN f ON f.conv_id = walk.conv_id AND f.i = walk.i + 1),
b AS (SELECT f.*, sum(CASE WHEN started THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS block_no
      FROM f JOIN walk USING (conv_id, i))
SELECT conv_id, CAST(block_no AS BIGINT) AS block_no, arg_min(role, turn) AS block_name,
       min(turn) AS first_turn, max(turn) AS last_turn, CAST(count(*) AS BIGINT) AS n_turns,
       CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM b WHERE block_no > 0 GROUP BY conv_id, block_no
""")
def q_block_segments(spark, d):
    from panelcraft.operators.segment import segment_blocks
    conv = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n_chars"))
    names = spark.createDataFrame(TURN_STARTS, "name string, code string")
    b = segment_blocks(conv, ["conv_id"], "turn", "role", names, bucket=F.floor(F.col("turn") / 4096),
                       with_heads=False)
    # the block's name is its first token: a partial aggregate, no join back to the block heads
    return b.groupBy("conv_id", "block_no").agg(
        F.min_by("role", "turn").alias("block_name"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        F.count(F.lit(1)).alias("n_turns"), F.sum("n_chars").cast("bigint").alias("n_chars")) \
        .select("conv_id", F.col("block_no").cast("bigint").alias("block_no"), "block_name", "first_turn",
                "last_turn", "n_turns", "n_chars")


# ---------------------------------------------------------------------------------------------
# S11-S13 -- HTML tables: a page per market segment is written from the tables and read back
# ---------------------------------------------------------------------------------------------

def segment_pages(spark, d) -> DataFrame:
    """(page_id, c_mktsegment, html): customers by nation with the region as a cell over its nations' rows, a header of two
    rows, and cells without end tags."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = (table(spark, d, "customer").groupBy("c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
         .agg(F.count_if(F.col("c_acctbal") >= 0).alias("n_pos"), F.count_if(F.col("c_acctbal") < 0).alias("n_neg"),
              F.sum("c_acctbal").alias("balance")))
    td = lambda x: F.concat(F.lit("<td>"), x)
    row = F.concat(td(F.col("n_name")), *(td(F.col(x).cast("string")) for x in ("n_pos", "n_neg")),
                   td(F.format_number("balance", 2)), td((F.col("n_pos") + F.col("n_neg")).cast("string")))
    regions = (c.join(nation, "n_nationkey").groupBy("c_mktsegment", "r_name")
               .agg(F.array_sort(F.collect_list(row)).alias("rows")))
    body = F.concat(F.lit("<tr><th rowspan="), F.size("rows").cast("string"), F.lit(">"), F.col("r_name"),
                    F.array_join("rows", "<tr>"))
    head = ("<p>by segment</p><table class=x><thead><tr><th rowspan=2>Region<th rowspan='2'>Nation &amp; State<th colspan=3>TOTAL by sign"
            "<th rowspan=2>All<br>TOTAL<tr><th>positive<th>negative<th>balance</thead><tbody>")
    tail = "</table><table><tr><td>another</table>"
    return (regions.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_list(body)), "").alias("body"))
            .select(F.xxhash64("c_mktsegment").alias("page_id"), "c_mktsegment",
                    F.concat(F.lit(head), "body", F.lit(tail)).alias("html")))


@register("html_table", """
SELECT c_mktsegment, n_name, CAST(count(*) AS BIGINT) AS n_customers, round(sum(c_acctbal), 2) AS balance, r_name AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY c_mktsegment, n_name, r_name
""")
def q_html_table(spark, d):
    from panelcraft.functions.clean import clean_numeric
    from panelcraft.sources.landed import html_first_table_cells, table_key_values
    pages = cut_lineage(segment_pages(spark, d))
    cells = cut_lineage(html_first_table_cells(pages, "page_id", "html"))
    read = table_key_values(cells)
    for value_like in ("BALANCE", "REGION"):
        more = table_key_values(cells, value_like=value_like)
        read = read.join(more.select("page", "row", F.col("value_text").alias(value_like)), ["page", "row"])
    return (read.join(pages.select(F.col("page_id").alias("page"), "c_mktsegment"), "page")
            .select("c_mktsegment", F.col("key_text").alias("n_name"), F.col("value_text").cast("bigint").alias("n_customers"),
                    r(clean_numeric("BALANCE")).alias("balance"), F.col("REGION").alias("region")))


# ---------------------------------------------------------------------------------------------
# S14 -- clean line tokens of whole documents
# ---------------------------------------------------------------------------------------------

_WS_SQL = "[\\s ]"


@register("token_lines", f"""
WITH l AS (SELECT doc_id, regexp_replace(x, '^{_WS_SQL}+|{_WS_SQL}+$', '', 'g') AS line
           FROM (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS x FROM documents)),
k AS (SELECT doc_id, line, line <> '' AND NOT regexp_full_match(line, '[|\\-: ]+') AND NOT starts_with(line, '![') AS keep
      FROM l)
SELECT doc_id, CAST(count(*) FILTER (WHERE keep) AS BIGINT) AS n_tokens,
       CAST(coalesce(sum(length(line)) FILTER (WHERE keep), 0) AS BIGINT) AS chars_kept,
       CAST(count(*) FILTER (WHERE line <> '' AND regexp_full_match(line, '[|\\-: ]+')) AS BIGINT) AS n_rules
FROM k GROUP BY doc_id
""")
def q_token_lines(spark, d):
    from panelcraft.functions.clean import TABLE_RULE_PATTERN
    from panelcraft.operators.segment import LINE_SPLIT, _strip
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    # the stripped lines are computed once; both filters read them (the projection is not re-inlined)
    lines = docs.select("doc_id", F.transform(F.split(F.col("text"), LINE_SPLIT), _strip).alias("lines"))
    kept = F.filter("lines", lambda x: (x != "") & ~x.rlike(TABLE_RULE_PATTERN) & ~x.startswith("!["))
    rules = F.filter("lines", lambda x: (x != "") & x.rlike(TABLE_RULE_PATTERN))
    return lines.select(
        "doc_id", F.size(kept).cast("bigint").alias("n_tokens"),
        F.aggregate(kept, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x)).alias("chars_kept"),
        F.size(rules).cast("bigint").alias("n_rules"))


# ---------------------------------------------------------------------------------------------
# F5, F6 -- regex fields of whole documents
# ---------------------------------------------------------------------------------------------

@register("regex_fields", r"""
SELECT doc_id,
       CASE WHEN regexp_extract(text, '\$\s*([0-9]+(?:\.[0-9]+)?)', 1) <> ''
            THEN TRY_CAST(regexp_extract(text, '\$\s*([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) END AS first_amount,
       CAST(len(regexp_extract_all(text, '\$\s*([0-9]+(?:\.[0-9]+)?)', 0)) AS BIGINT) AS n_amounts,
       split_part(text, ' ', 1) AS first_word,
       CAST(len(regexp_extract_all(text, '[0-9]+', 0)) AS BIGINT) AS n_numbers,
       contains(lower(text), 'license') AS mentions_license
FROM documents
""")
def q_regex_fields(spark, d):
    from panelcraft.functions.clean import DOLLAR_PATTERN, first_dollar_amount
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", first_dollar_amount("text").alias("first_amount"),
        F.size(F.regexp_extract_all("text", F.lit(DOLLAR_PATTERN), 0)).cast("bigint").alias("n_amounts"),
        F.split_part("text", F.lit(" "), F.lit(1)).alias("first_word"),
        F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).cast("bigint").alias("n_numbers"),
        F.lower("text").contains("license").alias("mentions_license"))


# ---------------------------------------------------------------------------------------------
# F8, S16 -- JSON field pick and filtered totals
# ---------------------------------------------------------------------------------------------

@register("json_pick", """
WITH e AS (SELECT event_type, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_type, CAST(count(*) AS BIGINT) AS n_events, CAST(sum(k) AS BIGINT) AS sum_k,
       CAST(count(*) FILTER (WHERE k > 50) AS BIGINT) AS n_k_over_50, CAST(count(k) AS BIGINT) AS n_with_k
FROM e GROUP BY event_type
""")
def q_json_pick(spark, d):
    from panelcraft.sources.landed import pick_from_json_array
    picked = pick_from_json_array(F.concat(F.lit("["), "props", F.lit("]")), "struct<k:string>", lambda x: x["k"].isNotNull(), "k")
    e = table(spark, d, "events").select("event_type", picked.cast("int").alias("k"))
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("k").cast("bigint").alias("sum_k"),
        F.count_if(F.col("k") > 50).alias("n_k_over_50"), F.count("k").alias("n_with_k"))


# ---------------------------------------------------------------------------------------------
# P5 -- clean numeric text: format amounts with $ and thousands separators, '-' for missing, parse back
# ---------------------------------------------------------------------------------------------

@register("clean_numeric", """
WITH f AS (SELECT o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN '-'
                                      ELSE '$' || format('{:,.2f}', o_totalprice) END AS txt FROM orders),
p AS (SELECT o_orderstatus, TRY_CAST(nullif(nullif(regexp_replace(txt, '[,$% ]', '', 'g'), '-'), '') AS DOUBLE) AS v
      FROM f)
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(count(v) AS BIGINT) AS n_parsed,
       round(coalesce(sum(v), 0), 2) AS sum_parsed
FROM p GROUP BY o_orderstatus
""")
def q_clean_numeric(spark, d):
    from panelcraft.functions.clean import clean_numeric
    o = table(spark, d, "orders").select(
        "o_orderstatus", F.when(F.col("o_orderstatus") == "P", F.lit("-"))
        .otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("txt"))
    p = o.withColumn("v", clean_numeric("txt"))
    return p.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_parsed"),
        r(F.coalesce(F.sum("v"), F.lit(0.0))).alias("sum_parsed"))


# ---------------------------------------------------------------------------------------------
# S17, F9 -- content manifest: size and SHA-256 of every whole document
# ---------------------------------------------------------------------------------------------

@register("file_manifest", """
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents
""")
def q_file_manifest(spark, d):
    from panelcraft.sources.landed import content_manifest
    return content_manifest(spread(table(spark, d, "documents")), "doc_id", "text")


# ---------------------------------------------------------------------------------------------
# G2 (one regressor), W8 -- two-way fixed-effects slope
# ---------------------------------------------------------------------------------------------

def nation_year_covariates(spark, d) -> DataFrame:
    return orders_by_nation(spark, d).groupBy("n_nationkey", "year").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price"),
        F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent_share"))


COVARIATES_SQL = f"""
SELECT n_nationkey, year, count(*) AS n_orders, avg(o_totalprice) AS mean_price,
       avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS urgent_share
FROM ({ORDERS_NATION_SQL}) GROUP BY 1, 2
"""


@register("twfe_within", f"""
WITH p AS ({COVARIATES_SQL}),
d AS (SELECT mean_price - avg(mean_price) OVER (PARTITION BY n_nationkey) - avg(mean_price) OVER (PARTITION BY year)
             + avg(mean_price) OVER () AS yy,
             urgent_share - avg(urgent_share) OVER (PARTITION BY n_nationkey) - avg(urgent_share) OVER (PARTITION BY year)
             + avg(urgent_share) OVER () AS xx FROM p)
SELECT 'urgent_share' AS term, round(sum(xx * yy) / sum(xx * xx), 2) AS coef, CAST(count(*) AS BIGINT) AS nobs FROM d
""")
def q_twfe_within(spark, d):
    from panelcraft.operators.regression import fit_twfe
    with persisted(nation_year_covariates(spark, d)) as p:
        fit = fit_twfe(p, "mean_price", ["urgent_share"], ["n_nationkey"], "year")
    return spark.createDataFrame([("urgent_share", round(float(fit.coef[0]), 2), fit.nobs)],
                                 "term string, coef double, nobs bigint")


# ---------------------------------------------------------------------------------------------
# G2-G6 -- event study with clustered standard errors (numpy-checked in tests; rows only here)
# ---------------------------------------------------------------------------------------------

def treated_covariate_panel(spark, d) -> DataFrame:
    cov = nation_year_covariates(spark, d).select("n_nationkey", "year", "urgent_share")
    return treated_panel(spark, d).join(cov, on=["n_nationkey", "year"], how="left")


_EVENT_COLS = [_evt_name(k) for k in EVENT_TERMS]
_LEADS = [EVENT_TERMS.index(k) + 1 for k in (-5, -4, -3, -2)]

# ordinary least squares on event dummies, the covariate and dummies of every unit and every period but the first; scores
# summed by unit; the normal and F tails by Simpson's rule (2,000 steps) and a finite beta integral
EVENT_STUDY_BASE_SQL = f"""
p AS (
  SELECT t.n_nationkey AS u, t.year AS t, t.event_time, t.treatment_year, mean_price AS y, urgent_share AS x
  FROM ({TREATED_SQL}) t JOIN (SELECT n_nationkey, year, urgent_share FROM ({COVARIATES_SQL})) c
    ON t.n_nationkey = c.n_nationkey AND t.year = c.year WHERE mean_price IS NOT NULL AND urgent_share IS NOT NULL),
entries AS (
  SELECT u, t, j, 1.0::DOUBLE AS v FROM p JOIN (VALUES {", ".join(f"({i + 1}, {k})" for i, k in enumerate(EVENT_TERMS))}) e(j, k)
    ON p.event_time = e.k AND treatment_year IS NOT NULL
  UNION ALL SELECT u, t, {len(EVENT_TERMS) + 1}, x FROM p
  UNION ALL SELECT u, t, {len(EVENT_TERMS) + 1} + dense_rank() OVER (ORDER BY u), 1 FROM p
  UNION ALL SELECT u, t, 1000 + dense_rank() OVER (ORDER BY t), 1 FROM p QUALIFY dense_rank() OVER (ORDER BY t) > 1),
ids AS (SELECT j, row_number() OVER (ORDER BY j) AS i FROM (SELECT DISTINCT j FROM entries)),
design AS (SELECT u, t, i, v FROM entries JOIN ids USING (j)),
matrix AS (
  SELECT a.i, b.i AS j, coalesce(sum(x.v * z.v), 0) AS v FROM ids a CROSS JOIN ids b
  LEFT JOIN (design x JOIN design z ON x.u = z.u AND x.t = z.t) ON x.i = a.i AND z.i = b.i GROUP BY a.i, b.i),
{inverse_sql("inv", "matrix")},
xy AS (SELECT i, sum(v * y) AS v FROM design JOIN p USING (u, t) GROUP BY i),
b AS (SELECT inv.i, sum(inv.v * xy.v) AS b FROM inv JOIN xy ON inv.j = xy.i GROUP BY inv.i),
res AS (SELECT p.u, p.t, any_value(y) AS y, any_value(y) - sum(v * b) AS e FROM p JOIN design USING (u, t) JOIN b USING (i) GROUP BY p.u, p.t),
size AS (SELECT count(*) AS n, count(DISTINCT u) AS g, (SELECT count(*) FROM ids) AS k, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM res),
score AS (SELECT u, i, sum(v * e) AS s FROM design JOIN res USING (u, t) GROUP BY u, i),
half AS (SELECT u, inv.i, sum(inv.v * s) AS w FROM inv JOIN score ON inv.j = score.i GROUP BY u, inv.i),
cov AS (
  SELECT a.i, c.i AS j, any_value((g / (g - 1.0)) * ((n - 1.0) / (n - k))) * sum(a.w * c.w) AS v
  FROM half a JOIN half c USING (u), size GROUP BY a.i, c.i),
lead_cov AS (
  SELECT dense_rank() OVER (ORDER BY i) AS i, dense_rank() OVER (ORDER BY j) AS j, v FROM cov
  WHERE i IN ({", ".join(map(str, _LEADS))}) AND j IN ({", ".join(map(str, _LEADS))})),
{inverse_sql("lead_inv", "lead_cov")},
wald AS (
  SELECT sum(x.b * v * z.b) / count(DISTINCT x.i) AS f, count(DISTINCT x.i) AS q FROM lead_inv
  JOIN (SELECT row_number() OVER (ORDER BY i) AS i, b FROM b WHERE i IN ({", ".join(map(str, _LEADS))})) x ON x.i = lead_inv.i
  JOIN (SELECT row_number() OVER (ORDER BY i) AS i, b FROM b WHERE i IN ({", ".join(map(str, _LEADS))})) z ON z.i = lead_inv.j),
beta AS (SELECT (g - 1) / 2.0 AS a, q / 2.0 AS c, (g - 1) / (g - 1 + q * f) AS top FROM wald, size),
pretrend AS (
  SELECT sum(CASE WHEN s IN (0, 2000) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END * pow(top * s / 2000.0, a - 1) * pow(1 - top * s / 2000.0, c - 1))
    * any_value(top) / 6000.0 * exp(any_value(lgamma(a + c) - lgamma(a) - lgamma(c))) AS p
  FROM beta, range(2001) r(s)),
terms AS (
  SELECT term, event_time, b AS coef, sqrt(v) AS se FROM
    (VALUES {", ".join(f"({i + 1}, '{_evt_name(k)}', {k})" for i, k in enumerate(EVENT_TERMS))}) e(i, term, event_time)
  JOIN b USING (i) JOIN cov ON cov.i = e.i AND cov.j = e.i),
tails AS (
  SELECT term, 1 - 2 * any_value(abs(coef / se)) / 6000.0 * sum(CASE WHEN s IN (0, 2000) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END
    * exp(-0.5 * pow(coef / se * s / 2000.0, 2))) / sqrt(2 * pi()) AS p FROM terms, range(2001) r(s) GROUP BY term)
"""
EVENT_STUDY_SQL = f"""
WITH RECURSIVE {EVENT_STUDY_BASE_SQL}
SELECT 'mean_price' AS outcome, term, event_time, coef, se, coef - 1.959963984540054 * se AS ci_low, coef + 1.959963984540054 * se AS ci_high,
       tails.p AS p_value, pretrend.p AS pretrend_pvalue FROM terms JOIN tails USING (term), pretrend
"""


def event_study_table(spark, d) -> DataFrame:
    from panelcraft.operators.regression import event_study
    with persisted(treated_covariate_panel(spark, d)) as p:
        table, _ = event_study(p, "mean_price", ["urgent_share"], ["n_nationkey"], "year",
                               "event_time", "treatment_year")
        return spark.createDataFrame(table.collect(), table.schema)  # small result, computed while cached


@register("event_study", f"""
SELECT outcome, term, event_time, round(coef, 3) AS coef, round(se, 3) AS se, round(ci_low, 3) AS ci_low, round(ci_high, 3) AS ci_high,
       round(p_value, 6) AS p_value, round(pretrend_pvalue, 6) AS pretrend_pvalue FROM ({EVENT_STUDY_SQL})
""")
def q_event_study(spark, d):
    t = event_study_table(spark, d)
    return t.select("outcome", "term", "event_time", *[r(c, 3).alias(c) for c in ("coef", "se", "ci_low", "ci_high")],
                    *[r(c, 6).alias(c) for c in ("p_value", "pretrend_pvalue")])


@register("event_plot_data", f"""
SELECT event_time, round(coef, 3) AS coef, round(coef - ci_low, 3) AS err_low, round(ci_high - coef, 3) AS err_high FROM ({EVENT_STUDY_SQL})
""")
def q_event_plot_data(spark, d):
    """Error-bar data of the event study (coef, lower and upper bar lengths)."""
    from panelcraft.operators.report import event_plot_data
    t = event_plot_data(event_study_table(spark, d))
    return t.select("event_time", *[r(c, 3).alias(c) for c in ("coef", "err_low", "err_high")])


# ---------------------------------------------------------------------------------------------
# G7, R5 -- placebo distribution (integer-hash draws) and its histogram
# ---------------------------------------------------------------------------------------------

N_DRAWS = 100
PLACEBO_SEED = 42


def placebo_draws(spark, d, panel: DataFrame | None = None, covariates: tuple[str, ...] = ()) -> DataFrame:
    """``panel``: an already persisted treated panel to reuse (e.g. the event study's); else built here."""
    from panelcraft.operators.regression import hash_assignments, placebo_coefficients

    def draws(p):
        treated = p.where(F.col("treatment_year").isNotNull()).select("n_nationkey")
        a = hash_assignments(treated, "n_nationkey", p.select("year"), "year", N_DRAWS, PLACEBO_SEED)
        return placebo_coefficients(p, "mean_price", list(covariates), "n_nationkey", "year", a)  # computed eagerly

    if panel is not None:
        c = draws(panel)
    else:
        with persisted(treated_panel(spark, d)) as p:
            c = draws(p)
    return c.select("draw", "coef")


PLACEBO_SQL = f"""
WITH t AS ({TREATED_SQL}),
tr AS (SELECT DISTINCT n_nationkey FROM t WHERE treatment_year IS NOT NULL),
yrs AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS pi FROM (SELECT DISTINCT year FROM t)),
dr AS (SELECT CAST(x AS INT) AS draw FROM range(0, {N_DRAWS}) r(x)),
a AS (SELECT dr.draw, tr.n_nationkey, yrs.year AS g FROM tr CROSS JOIN dr JOIN yrs
      ON yrs.pi = (({PLACEBO_SEED} * 1000003 + (CAST(dr.draw AS BIGINT) + 1) * 2654435761
                   + CAST(tr.n_nationkey AS BIGINT) * 40503) % 2147483647) % (SELECT count(*) FROM yrs)),
x AS (SELECT dr.draw, t.n_nationkey, t.year, t.mean_price AS y,
             CASE WHEN a.g IS NOT NULL AND t.year >= a.g THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS d
      FROM t CROSS JOIN dr LEFT JOIN a ON a.draw = dr.draw AND a.n_nationkey = t.n_nationkey),
m AS (SELECT draw,
             y - avg(y) OVER (PARTITION BY draw, n_nationkey) - avg(y) OVER (PARTITION BY draw, year)
               + avg(y) OVER (PARTITION BY draw) AS yy,
             d - avg(d) OVER (PARTITION BY draw, n_nationkey) - avg(d) OVER (PARTITION BY draw, year)
               + avg(d) OVER (PARTITION BY draw) AS dd FROM x)
SELECT draw, sum(dd * yy) / sum(dd * dd) AS coef FROM m GROUP BY draw
"""


@register("placebo_distribution", f"SELECT draw, round(coef, 2) AS coef FROM ({PLACEBO_SQL})")
def q_placebo_distribution(spark, d):
    return placebo_draws(spark, d).select("draw", r("coef").alias("coef"))


@register("placebo_hist", f"""
WITH c AS ({PLACEBO_SQL}), mm AS (SELECT min(coef) AS lo, max(coef) AS hi FROM c)
SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((coef - lo) / (hi - lo) * 20.0::DOUBLE) + 1, 20) END AS INT) AS bin,
       CAST(count(*) AS BIGINT) AS n, round(lo, 4) AS lo, round(hi, 4) AS hi
FROM c, mm GROUP BY 1, mm.lo, mm.hi
""")
def q_placebo_hist(spark, d):
    from panelcraft.operators.regression import histogram
    return histogram(placebo_draws(spark, d), "coef", 20).select("bin", "n", r("lo", 4).alias("lo"), r("hi", 4).alias("hi"))


@register("causal_summary", f"""
WITH RECURSIVE {EVENT_STUDY_BASE_SQL},
tr AS (SELECT DISTINCT u FROM p WHERE treatment_year IS NOT NULL),
yrs AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS pi FROM (SELECT DISTINCT t FROM p)),
a AS (
  SELECT CAST(draw AS BIGINT) AS draw, tr.u, yrs.t AS g FROM tr CROSS JOIN range({N_DRAWS}) r(draw) JOIN yrs
  ON yrs.pi = (({PLACEBO_SEED} * 1000003 + (CAST(draw AS BIGINT) + 1) * 2654435761 + CAST(tr.u AS BIGINT) * 40503) % 2147483647) % (SELECT count(*) FROM yrs)),
post AS (
  SELECT r.draw, p.u, p.t, p.y, p.x, CASE WHEN a.g IS NOT NULL AND p.t >= a.g THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS d
  FROM p CROSS JOIN range({N_DRAWS}) r(draw) LEFT JOIN a ON a.draw = r.draw AND a.u = p.u),
within AS (
  SELECT draw, {", ".join(f"{c} - avg({c}) OVER (PARTITION BY draw, u) - avg({c}) OVER (PARTITION BY draw, t) + avg({c}) OVER (PARTITION BY draw) AS {c}{c}" for c in "yxd")}
  FROM post),
coefs AS (
  SELECT draw, (sum(dd * yy) - sum(dd * xx) * sum(xx * yy) / sum(xx * xx)) / (sum(dd * dd) - sum(dd * xx) * sum(dd * xx) / sum(xx * xx)) AS coef
  FROM within GROUP BY draw)
SELECT 'mean_price' AS outcome, CAST(any_value(n) AS DOUBLE) AS nobs, round(any_value(r2), 6) AS r2, round(any_value(pretrend.p), 6) AS pretrend_pvalue,
  round(avg(coef), 2) AS placebo_mean, round(stddev_samp(coef), 2) AS placebo_std FROM coefs, size, pretrend
""")
def q_causal_summary(spark, d):
    """G6 + A13: nobs, R^2, pre-trend p and placebo mean / sample sd of one outcome, the covariate in both regressions."""
    from panelcraft.operators.regression import event_study
    # one persisted panel for both steps (a left join on unique (unit, year) cells adds the covariate only)
    with persisted(treated_covariate_panel(spark, d)) as p:
        _, s = event_study(p, "mean_price", ["urgent_share"], ["n_nationkey"], "year", "event_time", "treatment_year")
        draws = placebo_draws(spark, d, panel=p, covariates=("urgent_share",))
    return draws.agg(F.avg("coef").alias("m"), F.stddev_samp("coef").alias("sd")).select(
        F.lit("mean_price").alias("outcome"), F.lit(s["nobs"]).alias("nobs"), r(F.lit(s["r2"]), 6).alias("r2"),
        r(F.lit(s["pretrend_pvalue"]), 6).alias("pretrend_pvalue"), r("m").alias("placebo_mean"), r("sd").alias("placebo_std"))


# ---------------------------------------------------------------------------------------------
# G8 -- group-time ATT (never-treated controls, varying base) and dynamic aggregation
# ---------------------------------------------------------------------------------------------

ATT_SQL = f"""
WITH t AS ({TREATED_SQL}),
bal AS (SELECT * FROM t WHERE n_nationkey IN (
          SELECT n_nationkey FROM t GROUP BY 1 HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM t))),
cm AS (SELECT CAST(coalesce(treatment_year, 0) AS INT) AS g, year AS t, avg(mean_price) AS m, count(*) AS n
       FROM bal WHERE mean_price IS NOT NULL GROUP BY 1, 2),
tr AS (SELECT *, CASE WHEN t >= g THEN g - 1 ELSE t - 1 END AS b FROM cm WHERE g > 0),
c AS (SELECT t, m AS mc, n AS nc FROM cm WHERE g = 0)
SELECT tr.g, tr.t, tr.b AS base_t, (tr.m - tb.m) - (c.mc - cb.mc) AS att, CAST(tr.n AS BIGINT) AS n_treated,
       CAST(c.nc AS BIGINT) AS n_control
FROM tr JOIN cm tb ON tb.g = tr.g AND tb.t = tr.b JOIN c ON c.t = tr.t JOIN c cb ON cb.t = tr.b
"""


def att_table(spark, d) -> DataFrame:
    from panelcraft.operators.did import att_gt
    return att_gt(treated_panel(spark, d), ["n_nationkey"], "year", "mean_price", "treatment_year")


@register("att_gt", f"SELECT g, t, base_t, round(att, 4) AS att, n_treated, n_control FROM ({ATT_SQL})")
def q_att_gt(spark, d):
    return att_table(spark, d).select("g", "t", "base_t", r("att", 4).alias("att"), "n_treated", "n_control")


ATT_DYN_SQL = f"""
SELECT CAST(t - g AS INT) AS event_time, sum(att * n_treated) / sum(n_treated) AS att,
       CAST(count(*) AS BIGINT) AS n_cohorts FROM ({ATT_SQL}) GROUP BY 1
"""


@register("att_dynamic", f"SELECT event_time, round(att, 4) AS att, n_cohorts FROM ({ATT_DYN_SQL})")
def q_att_dynamic(spark, d):
    from panelcraft.operators.did import att_dynamic
    return att_dynamic(att_table(spark, d)).select("event_time", r("att", 4).alias("att"), "n_cohorts")


# ---------------------------------------------------------------------------------------------
# M1, M2, A17 -- splits
# ---------------------------------------------------------------------------------------------

TRAIN, VAL, TEST = (1995, 1998), (1999, 1999), (2000, 2001)


@register("time_split", f"""
WITH p AS ({PRICES_SQL}),
s AS (SELECT *, CASE WHEN year BETWEEN {TRAIN[0]} AND {TRAIN[1]} THEN 'train'
                     WHEN year BETWEEN {VAL[0]} AND {VAL[1]} THEN 'val'
                     WHEN year BETWEEN {TEST[0]} AND {TEST[1]} THEN 'test' END AS split FROM p)
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS n_units,
       min(year) AS first_year, max(year) AS last_year FROM s WHERE split IS NOT NULL GROUP BY split
""")
def q_time_split(spark, d):
    from panelcraft.operators.predict import split_with_fallback
    s = split_with_fallback(nation_year_prices(spark, d), "year", TRAIN, VAL, TEST)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("n_nationkey").alias("n_units"),
                                  F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@register("quantile_split", """
WITH p AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM p)),
c AS (SELECT (SELECT day FROM d WHERE i = CAST(floor((SELECT count(*) FROM d) * 0.6) AS BIGINT)) AS c1,
             (SELECT day FROM d WHERE i = CAST(floor((SELECT count(*) FROM d) * 0.8) AS BIGINT)) AS c2)
SELECT split, CAST(count(*) AS BIGINT) AS n, min(day) AS first_day, max(day) AS last_day FROM (
  SELECT p.*, CASE WHEN day <= c1 THEN 'train' WHEN day <= c2 THEN 'val' ELSE 'test' END AS split FROM p, c)
GROUP BY split
""")
def q_quantile_split(spark, d):
    from panelcraft.operators.predict import quantile_split
    p = user_day_panel(spark, d).select("user_id", "day")
    s = quantile_split(p, "day")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"),
                                  F.max("day").alias("last_day"))


# ---------------------------------------------------------------------------------------------
# M3, M4 -- train-fitted exact-median imputation and population-sd scaling
# ---------------------------------------------------------------------------------------------

FEATURES = ["mean_price_lag1", "n_orders_lag1", "urgent_big_avg"]


def feature_panel(spark, d) -> DataFrame:
    from panelcraft.operators.features import add_lags
    p = nation_year_covariates(spark, d)
    p = add_lags(p, ["n_nationkey"], "year", ["mean_price", "n_orders"], [1])
    g = panel_grid(spark, d).select("n_nationkey", "year", "urgent_big_avg")
    # a (unit, period) panel read by every fit / statistic of the prediction steps: written once to the
    # shared checkpoint folder, so the source tables are scanned once per query
    return cut_lineage(p.join(g, on=["n_nationkey", "year"], how="left"))


FEATURE_SQL = f"""
SELECT p.*, lag(p.mean_price) OVER (PARTITION BY p.n_nationkey ORDER BY p.year) AS mean_price_lag1,
       lag(p.n_orders) OVER (PARTITION BY p.n_nationkey ORDER BY p.year) AS n_orders_lag1, g.urgent_big_avg
FROM ({COVARIATES_SQL}) p LEFT JOIN ({PANEL_GRID_SQL}) g USING (n_nationkey, year)
"""

_TRAIN_PRED = f"year BETWEEN {TRAIN[0]} AND {TRAIN[1]}"


@register("impute_scale", f"""
WITH b AS ({FEATURE_SQL}),
med AS (SELECT {", ".join(f"median(CAST({c} AS DOUBLE)) AS med_{c}" for c in FEATURES)} FROM b WHERE {_TRAIN_PRED}),
i AS (SELECT b.n_nationkey, b.year, b.year BETWEEN {TRAIN[0]} AND {TRAIN[1]} AS is_train,
             {", ".join(f"coalesce(CAST({c} AS DOUBLE), med_{c}) AS i_{c}" for c in FEATURES)} FROM b, med),
st AS (SELECT {", ".join(f"avg(i_{c}) AS m_{c}, stddev_pop(i_{c}) AS s_{c}" for c in FEATURES)} FROM i WHERE is_train)
SELECT n_nationkey, year,
       {", ".join(f"round((i_{c} - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0::DOUBLE ELSE s_{c} END, 6) AS z_{c}"
                  for c in FEATURES)}
FROM i, st
""")
def q_impute_scale(spark, d):
    from panelcraft.operators.predict import apply_preprocess, fit_preprocess
    p = feature_panel(spark, d)
    pp = fit_preprocess(p.where(F.col("year").between(*TRAIN)), FEATURES)
    z = apply_preprocess(p, pp, scale=True, suffix="__z")
    # a feature that is entirely missing in train is dropped by the imputer; keep the column, as NULL
    return z.select("n_nationkey", "year", *[
        (r(f"{c}__z", 6) if c in pp.medians else F.lit(None).cast("double")).alias(f"z_{c}") for c in FEATURES])


# ---------------------------------------------------------------------------------------------
# A16 -- MAE / RMSE / R^2 of two baseline predictors by split; A8 best per split
# ---------------------------------------------------------------------------------------------

def baseline_predictions(spark, d) -> DataFrame:
    from panelcraft.operators.predict import fit_preprocess, time_split
    p = time_split(feature_panel(spark, d), "year", TRAIN, VAL, TEST)
    train = p.where(F.col("split") == "train")
    med = fit_preprocess(train, ["mean_price_lag1"], scale=False).medians["mean_price_lag1"]
    g_mean = train.agg(F.avg("mean_price")).first()[0]
    unit_mean = train.groupBy("n_nationkey").agg(F.avg("mean_price").alias("um"))
    p = p.join(unit_mean, on="n_nationkey", how="left")
    naive = p.select("n_nationkey", "year", "split", F.lit("naive_lag1").alias("model"),
                     F.col("mean_price").alias("y_true"),
                     F.coalesce(F.col("mean_price_lag1"), F.lit(med)).alias("y_pred"))
    um = p.select("n_nationkey", "year", "split", F.lit("unit_mean").alias("model"),
                  F.col("mean_price").alias("y_true"), F.coalesce(F.col("um"), F.lit(g_mean)).alias("y_pred"))
    return naive.unionByName(um)


EVAL_SQL = f"""
WITH b AS (SELECT *, CASE WHEN year BETWEEN {TRAIN[0]} AND {TRAIN[1]} THEN 'train'
                          WHEN year BETWEEN {VAL[0]} AND {VAL[1]} THEN 'val'
                          WHEN year BETWEEN {TEST[0]} AND {TEST[1]} THEN 'test' END AS split FROM ({FEATURE_SQL})),
tr AS (SELECT * FROM b WHERE split = 'train'),
med AS (SELECT median(mean_price_lag1) AS med, avg(mean_price) AS gm FROM tr),
um AS (SELECT n_nationkey, avg(mean_price) AS um FROM tr GROUP BY 1),
pr AS (SELECT split, 'naive_lag1' AS model, mean_price AS y_true, coalesce(mean_price_lag1, med) AS y_pred FROM b, med
       UNION ALL
       SELECT split, 'unit_mean', mean_price, coalesce(um.um, gm) FROM b LEFT JOIN um USING (n_nationkey), med),
m AS (SELECT model, split, count(*) AS n, avg(abs(y_true - y_pred)) AS mae,
             sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
             1 - sum((y_true - y_pred) * (y_true - y_pred))
                 / (sum(y_true * y_true) - sum(y_true) * sum(y_true) / count(*)) AS r2
      FROM pr WHERE split IS NOT NULL GROUP BY 1, 2)
SELECT model, split, CAST(n AS BIGINT) AS n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 6) AS r2 FROM m
"""


def eval_table(spark, d) -> DataFrame:
    from panelcraft.operators.predict import regression_metrics
    m = regression_metrics(baseline_predictions(spark, d).where(F.col("split").isNotNull()),
                           "y_true", "y_pred", ["model", "split"])
    return m.select("model", "split", "n", r("mae", 4).alias("mae"), r("rmse", 4).alias("rmse"),
                    r("r2", 6).alias("r2"))


@register("eval_metrics", EVAL_SQL)
def q_eval_metrics(spark, d):
    return eval_table(spark, d)


@register("best_per_group", f"""
SELECT split, model, rmse FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY rmse, model) AS rn FROM ({EVAL_SQL})) WHERE rn = 1
""")
def q_best_per_group(spark, d):
    from panelcraft.operators.dedupe import keep_first
    return keep_first(eval_table(spark, d), ["split"], ["rmse", "model"], ["model", "rmse"])


# ---------------------------------------------------------------------------------------------
# M5-M10 -- model ladder (Spark ML; rows only: metric bands, not values, are comparable)
# ---------------------------------------------------------------------------------------------

@register("model_ladder")
def q_model_ladder(spark, d):
    from panelcraft.operators.predict import model_ladder, time_split
    p = time_split(feature_panel(spark, d), "year", TRAIN, VAL, TEST)
    ev, _ = model_ladder(p, ["mean_price_lag1", "n_orders_lag1", "urgent_share"], "mean_price",
                         ["n_nationkey", "year"], "nation_price")
    return ev


# ---------------------------------------------------------------------------------------------
# J3, M11, M9, M10 -- vectors joined to the panel as features of a closed-form rung, with its predictions
# ---------------------------------------------------------------------------------------------

RIDGE = {"Ridge": {"scale": True, "kind": "ridge", "alpha": 1.0}}


def vector_predictions(spark, d) -> tuple[DataFrame, DataFrame]:
    from panelcraft.operators.text import pooled_vectors
    from panelcraft.plans.pipeline import predict
    e = table(spark, d, "embeddings").where("label <> 3").select(
        (F.col("vec_id") % 25).cast("int").alias("n_nationkey"),
        (F.expr("1995 + (vec_id div 25) % 7")).cast("int").alias("year"), "embedding")
    return predict(feature_panel(spark, d), FEATURES, "mean_price", ["n_nationkey", "year"], "year", "nation_price",
                   TRAIN, VAL, TEST, models=RIDGE, vectors=pooled_vectors(e, ["n_nationkey", "year"], "embedding", out="emb"))


VECTOR_RIDGE_SQL = f"""
WITH RECURSIVE panel AS (
  SELECT *, CASE WHEN {_TRAIN_PRED} THEN 'train' WHEN year BETWEEN {VAL[0]} AND {VAL[1]} THEN 'val' ELSE 'test' END AS split
  FROM ({FEATURE_SQL}) WHERE mean_price IS NOT NULL AND year BETWEEN {TRAIN[0]} AND {TEST[1]}),
e AS (
  SELECT CAST(vec_id % 25 AS INT) AS n_nationkey, CAST(1995 + (vec_id // 25) % 7 AS INT) AS year, unnest(embedding) AS v,
         unnest(range(len(embedding))) AS dim FROM embeddings WHERE label <> 3),
pooled AS (SELECT n_nationkey, year, dim, sum(CAST(v AS DOUBLE)) / count(*) AS v FROM e GROUP BY ALL),
long AS (
  {" UNION ALL ".join(f"SELECT n_nationkey, year, split, {i} AS f, CAST({c} AS DOUBLE) AS v FROM panel" for i, c in enumerate(FEATURES))}
  UNION ALL
  SELECT n_nationkey, year, split, {len(FEATURES)} + dim, pooled.v
  FROM panel CROSS JOIN (SELECT DISTINCT dim FROM e) LEFT JOIN pooled USING (n_nationkey, year, dim)),
med AS (
  SELECT f, m, row_number() OVER (ORDER BY f) AS i FROM (SELECT f, median(v) AS m FROM long WHERE split = 'train' GROUP BY f) WHERE m IS NOT NULL),
filled AS (SELECT n_nationkey, year, split, i, coalesce(v, m) AS v FROM long JOIN med USING (f)),
st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM filled WHERE split = 'train' GROUP BY i),
z AS (SELECT n_nationkey, year, split, i, (v - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM filled JOIN st USING (i)),
centre AS (SELECT avg(mean_price) AS y0, count(*) AS n FROM panel WHERE split = 'train'),
matrix AS (
  SELECT a.i, b.i AS j, sum(a.z * b.z) + CASE WHEN a.i = b.i THEN any_value(n) ELSE 0 END AS v
  FROM z a JOIN z b ON a.n_nationkey = b.n_nationkey AND a.year = b.year, centre WHERE a.split = 'train' GROUP BY a.i, b.i),
rhs AS (SELECT i, sum(z * (mean_price - y0)) AS v FROM z JOIN panel USING (n_nationkey, year), centre WHERE z.split = 'train' GROUP BY i),
{inverse_sql("inv", "matrix")},
w AS (SELECT inv.i, sum(inv.v * rhs.v) AS w FROM inv JOIN rhs ON inv.j = rhs.i GROUP BY inv.i),
p AS (SELECT n_nationkey, year, any_value(z.split) AS split, any_value(y0) + sum(w * z) AS y_pred FROM z JOIN w USING (i), centre GROUP BY n_nationkey, year),
scored AS (SELECT p.*, mean_price AS y_true FROM p JOIN panel USING (n_nationkey, year))
"""


@register("vector_ladder", VECTOR_RIDGE_SQL + """,
m AS (
  SELECT split, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) ** 2)) AS rmse,
         1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) AS r2, count(*) AS n FROM scored GROUP BY split)
SELECT 'nation_price' AS task, 'Ridge' AS model, round(v.mae, 4) AS val_mae, round(v.rmse, 4) AS val_rmse, round(v.r2, 6) AS val_r2,
       round(t.mae, 4) AS test_mae, round(t.rmse, 4) AS test_rmse, round(t.r2, 6) AS test_r2, t0.n AS n_train, v.n AS n_val, t.n AS n_test
FROM m v, m t, m t0 WHERE v.split = 'val' AND t.split = 'test' AND t0.split = 'train'
""")
def q_vector_ladder(spark, d):
    ev, _ = vector_predictions(spark, d)
    places = {c: (6 if c.endswith("r2") else 4) for c in ev.columns if c.startswith(("val_", "test_"))}
    return ev.select(*[r(c, places[c]).alias(c) if c in places else F.col(c) for c in ev.columns])


@register("model_predictions", VECTOR_RIDGE_SQL + """
SELECT n_nationkey, year, 'nation_price' AS task, 'Ridge' AS model, round(y_true, 4) AS y_true, round(y_pred, 4) AS y_pred
FROM scored WHERE split = 'test'
""")
def q_model_predictions(spark, d):
    _, pred = vector_predictions(spark, d)
    return pred.withColumns({"y_true": r("y_true", 4), "y_pred": r("y_pred", 4)})


# ---------------------------------------------------------------------------------------------
# T2 -- TF-IDF vocabulary of whole documents; T4 -- masked mean pooling; T3 -- SVD projection
# ---------------------------------------------------------------------------------------------

TOP_TERMS = 200


@register("tfidf_terms", rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS toks FROM documents),
g AS (SELECT doc_id, unnest(toks) AS term FROM t
      UNION ALL
      SELECT doc_id, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) FROM t),
s AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM g GROUP BY term),
n AS (SELECT count(*) AS n FROM documents)
SELECT term, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df,
       round(ln(CAST(1 + n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1, 6) AS idf
FROM s, n ORDER BY tf DESC, term LIMIT {TOP_TERMS}
""")
def q_tfidf_terms(spark, d):
    from panelcraft.operators.text import tfidf_vocabulary
    docs = table(spark, d, "documents").select("doc_id", "text")
    n = docs.count()
    v = tfidf_vocabulary(docs, "doc_id", "text", TOP_TERMS)
    return v.select("term", F.col("tf").cast("bigint").alias("tf"), F.col("df").cast("bigint").alias("df"),
                    r(F.log((F.lit(1.0) + F.lit(float(n))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0), 6).alias("idf"))


@register("tfidf_weights", rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS toks FROM documents),
g AS (SELECT doc_id, unnest(toks) AS term FROM t
      UNION ALL
      SELECT doc_id, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) FROM t),
vocab AS (
  SELECT term, df, ln(CAST(1 + (SELECT count(*) FROM documents) AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM (
    SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM g GROUP BY term ORDER BY tf DESC, term LIMIT {{TOP_TERMS}})),
w AS (SELECT doc_id, term, count(*) * any_value(idf) AS w FROM g JOIN vocab USING (term) GROUP BY doc_id, term)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w
""".replace("{TOP_TERMS}", str(TOP_TERMS)))
def q_tfidf_weights(spark, d):
    from panelcraft.operators.text import tfidf_vectors
    rows, vocab = tfidf_vectors(table(spark, d, "documents").select("doc_id", "text"), "text", TOP_TERMS)
    sparse = rows.select("doc_id", F.unwrap_udt("tfidf").alias("v"))
    long = sparse.select("doc_id", F.inline_outer(F.arrays_zip("v.indices", "v.values")).alias("term_index", "weight")).where("weight > 0")
    return long.join(vocab.select("term_index", "term"), "term_index").select("doc_id", "term", r("weight", 6).alias("weight"))


@register("mean_pool", """
WITH e AS (SELECT label, embedding,
                  CASE WHEN list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) > 0
                       THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask FROM embeddings),
u AS (SELECT label, mask, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim FROM e)
SELECT label, CAST(dim AS INT) AS dim, round(sum(CAST(v AS DOUBLE) * mask) / greatest(sum(mask), 1e-9), 6) AS pooled
FROM u GROUP BY label, dim
""")
def q_mean_pool(spark, d):
    from panelcraft.operators.text import mean_pool
    e = table(spark, d, "embeddings")
    sq = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0),
                     lambda a, b: a + b)
    m = mean_pool(e, ["label"], "embedding", mask=F.when(sq > 0, 1.0).otherwise(0.0))
    return m.select("label", F.col("dim").cast("int").alias("dim"), r("pooled", 6).alias("pooled"))


@register("svd_embed")
def q_svd_embed(spark, d):
    from panelcraft.operators.regression import svd_project
    e = table(spark, d, "embeddings")
    dims = len(e.select("embedding").first()[0])
    proj, _ = svd_project(e, "embedding", dims)
    return proj.select("vec_id", "label", "svd")


# ---------------------------------------------------------------------------------------------
# A7, J7, O4 -- first/last non-null change per unit and the top movers
# ---------------------------------------------------------------------------------------------

CHANGE_SQL = f"""
WITH p AS ({PANEL_GRID_SQL}), nn AS (SELECT * FROM p WHERE urgent_big_avg IS NOT NULL)
SELECT n_nationkey, min(year) AS first_year, max(year) AS last_year,
       arg_min(urgent_big_avg, year) AS first_value, arg_max(urgent_big_avg, year) AS last_value,
       arg_max(urgent_big_avg, year) - arg_min(urgent_big_avg, year) AS delta
FROM nn GROUP BY n_nationkey
"""


def change_table(spark, d) -> DataFrame:
    from panelcraft.operators.dedupe import first_last_non_null
    f = first_last_non_null(panel_grid(spark, d), ["n_nationkey"], "year", "urgent_big_avg",
                            first_time="first_year", last_time="last_year")
    return f.withColumn("delta", F.col("last_value") - F.col("first_value"))


@register("first_last_change", f"""
SELECT n_nationkey, first_year, last_year, round(first_value, 6) AS first_value, round(last_value, 6) AS last_value,
       round(delta, 6) AS delta FROM ({CHANGE_SQL})
""")
def q_first_last_change(spark, d):
    c = change_table(spark, d)
    return c.select("n_nationkey", "first_year", "last_year", r("first_value", 6).alias("first_value"),
                    r("last_value", 6).alias("last_value"), r("delta", 6).alias("delta"))


@register("top_movers", f"""
SELECT * FROM (SELECT 'largest_decrease' AS grp, n_nationkey, round(delta, 6) AS delta FROM ({CHANGE_SQL})
               ORDER BY delta, n_nationkey LIMIT 5)
UNION ALL
SELECT * FROM (SELECT 'largest_increase' AS grp, n_nationkey, round(delta, 6) AS delta FROM ({CHANGE_SQL})
               ORDER BY delta DESC, n_nationkey LIMIT 5)
""")
def q_top_movers(spark, d):
    from panelcraft.operators.report import top_and_bottom
    # both top-5 lists read the per-unit change table (#units rows): written once, not derived twice
    c = cut_lineage(change_table(spark, d).select("n_nationkey", "delta"))
    return top_and_bottom(c, "delta", ["n_nationkey"], 5).select("grp", "n_nationkey", r("delta", 6).alias("delta"))


@register("change_between_ends", f"""
WITH p AS ({PANEL_GRID_SQL}), e AS (SELECT min(year) AS lo, max(year) AS hi FROM p)
SELECT a.n_nationkey, round(a.urgent_big_avg, 6) AS rate_base, round(z.urgent_big_avg, 6) AS rate_latest,
       round(z.urgent_big_avg - a.urgent_big_avg, 6) AS delta
FROM p a JOIN p z USING (n_nationkey), e WHERE a.year = e.lo AND z.year = e.hi
""")
def q_change_between_ends(spark, d):
    from panelcraft.operators.report import change_between_ends
    c = change_between_ends(cut_lineage(panel_grid(spark, d).select("n_nationkey", "year", "urgent_big_avg")), ["n_nationkey"], "year", "urgent_big_avg")
    return c.select("n_nationkey", *[r(x, 6).alias(x) for x in ("rate_base", "rate_latest", "delta")])


@register("wave_context", f"""
WITH w AS (SELECT n_nationkey, year, round(max(o_totalprice), 2) AS top FROM ({ORDERS_NATION_SQL}) WHERE (year + n_nationkey) % 2 = 0 GROUP BY 1, 2)
SELECT w.n_nationkey, w.year, w.top, p.n_orders, p.n_shipped, lag(w.top) OVER (PARTITION BY w.n_nationkey ORDER BY w.year) AS top_lag1
FROM w LEFT JOIN ({PANEL_GRID_SQL}) p ON p.n_nationkey = w.n_nationkey AND p.year = w.year
""")
def q_wave_context(spark, d):
    """Every second year is a wave; the panel's counts of the same cell and the value of the wave before."""
    from panelcraft.plans.pipeline import wave_features
    waves = (orders_by_nation(spark, d).where((F.col("year") + F.col("n_nationkey")) % 2 == 0)
             .groupBy("n_nationkey", "year").agg(r(F.max("o_totalprice")).alias("top")))
    return wave_features(waves, panel_grid(spark, d), ["n_nationkey"], "year", ["n_orders", "n_shipped"], ["top"])


# ---------------------------------------------------------------------------------------------
# A10 coverage stats, P22 + A4 coverage flags, R6 one unit's series, P26 + W6 scenarios
# ---------------------------------------------------------------------------------------------

@register("coverage_stats", f"""
WITH p AS ({PANEL_GRID_SQL})
SELECT metric, value FROM (
  SELECT 'n_rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM p
  UNION ALL SELECT 'n_units', CAST(count(DISTINCT n_nationkey) AS BIGINT) FROM p
  UNION ALL SELECT 'first_year', CAST(min(year) AS BIGINT) FROM p
  UNION ALL SELECT 'last_year', CAST(max(year) AS BIGINT) FROM p
  UNION ALL SELECT 'n_observed_urgent_big_avg', CAST(count(urgent_big_avg) AS BIGINT) FROM p)
""")
def q_coverage_stats(spark, d):
    from panelcraft.operators.report import coverage_long
    return coverage_long(panel_grid(spark, d), ["n_nationkey"], "year", ["urgent_big_avg"]).select(
        F.when(F.col("metric") == "first_period", "first_year").when(F.col("metric") == "last_period", "last_year")
        .otherwise(F.col("metric")).alias("metric"), F.col("value").cast("bigint").alias("value"))


@register("coverage_flags", """
WITH g AS (SELECT c_custkey, CAST(y AS INT) AS year FROM customer,
           range((SELECT min(year(o_orderdate)) FROM orders), (SELECT max(year(o_orderdate)) FROM orders) + 1) t(y)),
o AS (SELECT o_custkey AS c_custkey, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1, 2),
any_o AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders),
f AS (SELECT CASE WHEN o.n IS NOT NULL THEN 'observed'
                  WHEN a.c_custkey IS NOT NULL THEN 'missing_no_unit_data'
                  ELSE 'missing_no_code' END AS coverage_flag
      FROM g LEFT JOIN o USING (c_custkey, year) LEFT JOIN any_o a ON a.c_custkey = g.c_custkey)
SELECT coverage_flag, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1
""")
def q_coverage_flags(spark, d):
    from panelcraft.operators.panel import coverage_flags
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
    # the (unit, period) cells with orders: one pass over orders; the period bounds and the units with
    # any order derive from this table (#units x #periods), not from further scans
    seen = cut_lineage(o.groupBy("c_custkey", "year").agg(F.count(F.lit(1)).alias("n_orders")))
    lo, hi = time_bounds_expr(seen, "year")
    grid = time_grid(table(spark, d, "customer").select("c_custkey"), "year", lo, hi)
    f = coverage_flags(grid, ["c_custkey"], "year", seen, ["n_orders"], seen)
    return f.groupBy("coverage_flag").agg(F.count(F.lit(1)).alias("n"))


@register("unit_series", f"""
SELECT n_nationkey, year, n_orders, round(revenue, 2) AS revenue FROM ({PANEL_GRID_SQL})
WHERE n_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7')
""")
def q_unit_series(spark, d):
    """The time series of one unit, sorted (the sort is the feature of this report); only its customers and suppliers
    are joined to the facts."""
    key = table(spark, d, "nation").where(F.col("n_name") == "NATION_7").select("n_nationkey").first()
    p = panel_grid(spark, d, -1 if key is None else key[0])
    return p.select("n_nationkey", "year", "n_orders", r("revenue").alias("revenue")).orderBy("year")


SCENARIOS = [("raise", 1), ("hold", 0), ("cut", -1)]


@register("scenario", f"""
WITH latest AS (SELECT n_nationkey, max(year) AS latest_year, arg_max(mean_price, year) AS latest FROM ({PRICES_SQL}) GROUP BY 1),
eff AS (SELECT coalesce(avg(coef), 0.0::DOUBLE) AS effect FROM ({EVENT_STUDY_SQL}) WHERE event_time >= 0),
s AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {v})" for n, v in SCENARIOS)}) v(scenario, direction))
SELECT n_nationkey, scenario, latest_year, round(latest, 4) AS latest,
       round(greatest(0.0::DOUBLE, latest + effect * sign(direction)), 3) AS projected
FROM latest, eff, s
""")
def q_scenario(spark, d):
    """The mean coefficient after the event, by the sign of the change, on every unit's latest value."""
    from panelcraft.operators.dedupe import latest_per_unit
    from panelcraft.operators.report import mean_post_effect, scenarios
    latest = latest_per_unit(nation_year_prices(spark, d), ["n_nationkey"], "year", ["mean_price"])
    s = scenarios(latest, "mean_price", mean_post_effect(event_study_table(spark, d)), SCENARIOS)
    return s.select("n_nationkey", "scenario", F.col("year").alias("latest_year"),
                    r("mean_price", 4).alias("latest"), r("projected", 3).alias("projected"))


# ---------------------------------------------------------------------------------------------
# G8 -- doubly robust ATT(g, t) with a covariate (its SQL walks Newton's steps in a recursive CTE), and its event-time
# aggregation with a bootstrap band (numpy-checked in tests, rows only here)
# ---------------------------------------------------------------------------------------------

ATT_DR_SQL = f"""
WITH RECURSIVE p AS (
  SELECT t.n_nationkey AS u, t.year AS t, mean_price AS y, coalesce(treatment_year, 0) AS g, urgent_share AS x
  FROM ({TREATED_SQL}) t JOIN (SELECT n_nationkey, year, urgent_share FROM ({COVARIATES_SQL})) c
    ON t.n_nationkey = c.n_nationkey AND t.year = c.year WHERE mean_price IS NOT NULL AND urgent_share IS NOT NULL),
s AS (SELECT * FROM p WHERE u IN (SELECT u FROM p GROUP BY u HAVING count(*) = (SELECT count(DISTINCT t) FROM p))),
times AS (SELECT DISTINCT t FROM s),
cells AS (
  SELECT * FROM (
    SELECT g, t, CASE WHEN t >= g THEN (SELECT max(e.t) FROM times e WHERE e.t < c.g) ELSE (SELECT max(e.t) FROM times e WHERE e.t < times.t) END AS b
    FROM (SELECT DISTINCT g FROM s WHERE g > 0) c, times WHERE g > (SELECT min(t) FROM times))
  WHERE b IS NOT NULL AND EXISTS (SELECT 1 FROM s WHERE g = 0)),
units AS (
  SELECT c.g, c.t, c.b, o.u, CASE WHEN o.g = c.g THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS d, o.y - e.y AS dy, e.x
  FROM cells c JOIN s o ON o.t = c.t AND (o.g = c.g OR o.g = 0) JOIN s e ON e.u = o.u AND e.t = c.b),
walk(i, g, b, d, x, b0, b1, step) AS (
  SELECT 0, g, b, list(d ORDER BY u), list(x ORDER BY u), ln(sum(d) / (count(*) - sum(d))), 0.0::DOUBLE, 1.0::DOUBLE
  FROM (SELECT DISTINCT g, b, u, d, x FROM units) GROUP BY g, b
  UNION ALL
  SELECT i + 1, g, b, d, x, b0 + (h11 * g0 - h01 * g1) / det, b1 + (h00 * g1 - h01 * g0) / det,
    greatest(abs((h11 * g0 - h01 * g1) / det), abs((h00 * g1 - h01 * g0) / det))
  FROM (
    SELECT *, h00 * h11 - h01 * h01 AS det FROM (
      SELECT *, list_sum(list_transform(q, lambda v, j: d[j] - v)) AS g0, list_sum(list_transform(q, lambda v, j: (d[j] - v) * x[j])) AS g1,
        list_sum(list_transform(q, lambda v: v * (1 - v))) AS h00, list_sum(list_transform(q, lambda v, j: v * (1 - v) * x[j])) AS h01,
        list_sum(list_transform(q, lambda v, j: v * (1 - v) * x[j] * x[j])) AS h11
      FROM (SELECT *, list_transform(x, lambda v: 1 / (1 + exp(-(b0 + b1 * v)))) AS q FROM walk WHERE i < 25 AND step >= 1e-10)))),
logit AS (
  SELECT g, b, arg_max(b0, i) AS b0, arg_max(b1, i) AS b1, coalesce(arg_max(step, i) < 1e-10, false) AS converged FROM walk GROUP BY g, b),
ols AS (SELECT t, b, regr_intercept(dy, x) AS a0, regr_slope(dy, x) AS a1 FROM (SELECT DISTINCT t, b, u, dy, x FROM units WHERE d = 0) GROUP BY t, b),
w AS (
  SELECT *, q * (1 - d) / (1 - q) AS wc FROM (
    SELECT units.*, converged, dy - a0 - a1 * x AS r, 1 / (1 + exp(-(b0 + b1 * x))) AS q
    FROM units JOIN logit USING (g, b) JOIN ols USING (t, b))),
m AS (
  SELECT g, t, b, any_value(converged) AS converged, count(*) AS n, sum(d) AS n1, sum(wc) AS swc, sum(d * r) / sum(d) AS et, sum(wc * r) / sum(wc) AS ec,
    sum(1 - d) AS c0, sum((1 - d) * x) AS c1, sum((1 - d) * x * x) AS c2, sum(q * (1 - q)) AS h0, sum(q * (1 - q) * x) AS h1,
    sum(q * (1 - q) * x * x) AS h2, sum(d * x) AS t1, sum(wc * x) AS s1, sum(wc * r * x) AS v1, sum(wc * r) AS v0 FROM w GROUP BY g, t, b),
k AS (
  SELECT *, (c2 * n1 - c1 * t1) / (c0 * c2 - c1 * c1) AS ot0, (c0 * t1 - c1 * n1) / (c0 * c2 - c1 * c1) AS ot1,
    (c2 * swc - c1 * s1) / (c0 * c2 - c1 * c1) AS oc0, (c0 * s1 - c1 * swc) / (c0 * c2 - c1 * c1) AS oc1,
    (h2 * (v0 - ec * swc) - h1 * (v1 - ec * s1)) / (h0 * h2 - h1 * h1) AS ps0, (h0 * (v1 - ec * s1) - h1 * (v0 - ec * swc)) / (h0 * h2 - h1 * h1) AS ps1
  FROM m),
f AS (
  SELECT g, t, b, (d * (r - et) - (1 - d) * r * (ot0 + ot1 * x)) / (n1 / n)
    - (wc * (r - ec) + (d - q) * (ps0 + ps1 * x) - (1 - d) * r * (oc0 + oc1 * x)) / (swc / n) AS inf
  FROM w JOIN k USING (g, t, b) WHERE k.converged)
SELECT CAST(k.g AS INT) AS g, CAST(k.t AS INT) AS t, CAST(k.b AS INT) AS base_t, CASE WHEN k.converged THEN round(et - ec, 2) END AS att,
  round(e.se, 2) AS se, CAST(n1 AS BIGINT) AS n_treated, CAST(n - n1 AS BIGINT) AS n_control, k.converged
FROM k LEFT JOIN (SELECT g, t, b, stddev_samp(inf) / sqrt(count(*)) AS se FROM f GROUP BY g, t, b) e USING (g, t, b)
"""


@register("att_gt_dr", ATT_DR_SQL)
def q_att_gt_dr(spark, d):
    from panelcraft.operators.did import att_gt_dr
    with persisted(treated_covariate_panel(spark, d)) as p:
        out = att_gt_dr(p, "n_nationkey", "year", "mean_price", "treatment_year", ["urgent_share"])
    # a cohort that the covariate separates from the controls has no finite logit, and no estimate to report
    return out.withColumns({c: F.when(F.col("converged"), r(c)) for c in ("att", "se")})


@register("att_dynamic_dr")
def q_att_dynamic_dr(spark, d):
    from panelcraft.operators.did import att_dynamic_dr
    with persisted(treated_covariate_panel(spark, d)) as p:
        out = att_dynamic_dr(p, "n_nationkey", "year", "mean_price", "treatment_year", ["urgent_share"],
                             n_boot=999, seed=42)
        return spark.createDataFrame(out.collect(), out.schema)  # small result, computed while cached
