"""Distributed least squares: Gram aggregation, two-way fixed effects with cluster-robust covariance,
event studies, placebo distributions and a Gram-based SVD (G2-G7, W8, T3).

Only p x p matrices reach the driver.  The data passes are:

1. unit means of y and every regressor (``groupBy(unit)``; map-side combine, then a join back that
   AQE broadcasts when the per-unit table is small and splits when a unit is skewed),
2. the Gram ``[X y]'[X y]`` of the unit-demeaned rows (partial Grams per Arrow batch, summed by
   position),
3. for clustered standard errors: per-cluster score sums ``X_g'u_g`` (``groupBy(cluster)``), then
   the Gram of the score table.

Unit and period effects are absorbed by the within transformation (Frisch-Waugh-Lovell; alternating demeaning
where the panel is not balanced), so the design holds no dummies.  Columns are equilibrated by their Gram
diagonal before solving, and a rank check drops collinear columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcraft.functions.partial import partial_sums
from panelcraft.functions.partitioning import bounded_broadcast
from panelcraft.functions.stats import Z_975, f_sf, normal_two_sided_p
from panelcraft.session import cut_lineage

# ------------------------------------------------------------------------------------------------
# Gram aggregation
# ------------------------------------------------------------------------------------------------


def _flat(batch, cols: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols])


def _from_triangle(flat: np.ndarray, p: int) -> np.ndarray:
    g = np.zeros((p, p))
    g[np.triu_indices(p)] = flat
    return g + np.triu(g, 1).T


def gram(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Sum over rows of x x' for the listed numeric columns; rows with a NULL or NaN in any of them do not count.

    One pass, a partial Gram per task; only p (p + 1) / 2 numbers leave a task."""
    cols = list(cols)
    iu = np.triu_indices(len(cols))

    def add(batch):
        x = _flat(batch, cols)
        return (x.T @ x)[iu]

    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    whole = values.dropna().where(" AND ".join(f"NOT isnan(c{i})" for i in range(len(cols)))) if cols else values
    cols = whole.columns
    return _from_triangle(partial_sums(whole, len(iu[0]), add), len(cols))


def array_gram(df: DataFrame, vec: str, dims: int) -> np.ndarray:
    """Gram of an ``array<float|double>`` column (e.g. embeddings); rows without an array do not count."""
    iu = np.triu_indices(dims)

    def add(batch):
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        return (x.T @ x)[iu]

    arrays = df.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"))
    return _from_triangle(partial_sums(arrays, len(iu[0]), add), dims)


# ------------------------------------------------------------------------------------------------
# within transformation
# ------------------------------------------------------------------------------------------------


def demean_by_unit(df: DataFrame, unit: Sequence[str], cols: Sequence[str], suffix: str = "") -> DataFrame:
    """``c - avg(c) over unit`` for every column, as aggregate + join (not a per-unit window)."""
    unit = list(unit)
    means = df.groupBy(*unit).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    j = df.join(means, on=unit, how="inner")
    return j.withColumns({f"{c}{suffix}": F.col(c) - F.col(f"__m_{c}") for c in cols}).drop(
        *[f"__m_{c}" for c in cols])


def demean_two_way(df: DataFrame, unit: Sequence[str], time: str, cols: Sequence[str], tol: float = 1e-11,
                   max_sweeps: int = 1000) -> DataFrame:
    """Residuals of ``cols`` on unit and period effects by alternating demeaning: unit means and period means are taken
    off in turn until a sweep would move no value by more than ``tol`` times its column's range.

    A balanced panel is done after one sweep, a second one sees it.  A sweep is two aggregations with map-side combine,
    joined back, and is written to the shared checkpoint folder; neither the number of periods nor their list enters the
    plan or the driver.  Rows must be free of NULLs in ``cols``."""
    unit, cols = list(unit), list(cols)
    rest = [c for c in df.columns if c not in cols]
    spread = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in cols]).first()
    for _ in range(max_sweeps):
        df = demean_by_unit(demean_by_unit(df, unit, cols), [time], cols)
        df = cut_lineage(df.select(*rest, *cols))
        # the period means are 0 now; the unit means are what the next sweep would take off
        means = df.groupBy(*unit).agg(*[F.avg(c).alias(c) for c in cols])
        left = means.agg(*[F.max(F.abs(c)).alias(c) for c in cols]).first()
        if all((left[c] or 0.0) <= tol * (spread[c] or 0.0) for c in cols):
            return df
    raise RuntimeError(f"alternating demeaning did not settle in {max_sweeps} sweeps")


def connected_parts(df: DataFrame, unit: Sequence[str], time: str) -> int:
    """Connected parts of the graph of units and periods: so many of the unit and period dummies depend on the others.
    One where any unit is observed in every period; else the smallest period of a unit's periods is spread until it stays."""
    unit = list(unit)
    cells = df.select(*unit, time).distinct()
    most = cells.groupBy(*unit).count().agg(F.max("count")).first()[0]
    if most is None or most == cells.select(time).distinct().count():
        return 0 if most is None else 1
    cells = cut_lineage(cells)
    label = cut_lineage(cells.select(time).distinct().withColumn("__l", F.col(time)))
    while True:
        per_unit = cells.join(label, time).groupBy(*unit).agg(F.min("__l").alias("__u"))
        spread = cut_lineage(cells.join(per_unit, unit).groupBy(time).agg(F.min("__u").alias("__n")).join(label, time))
        if spread.where("__n < __l").isEmpty():
            return label.select("__l").distinct().count()
        label = spread.select(time, F.col("__n").alias("__l"))


def period_dummies(df: DataFrame, time: str, periods: Sequence[int], prefix: str = "__t_") -> tuple[DataFrame, list[str]]:
    """Dummy columns for every period except the first (the baseline)."""
    names = [f"{prefix}{p}" for p in periods[1:]]
    return df.withColumns({n: (F.col(time) == F.lit(p)).cast("double") for n, p in zip(names, periods[1:])}), names


# ------------------------------------------------------------------------------------------------
# two-way fixed effects
# ------------------------------------------------------------------------------------------------


@dataclass
class FitResult:
    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    nobs: int
    n_units: int
    n_clusters: int
    rank: int
    k: int
    r2: float
    ssr: float

    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def wald_f(self, terms: Sequence[str]) -> tuple[float, float]:
        """Joint test that the listed coefficients are 0: F on (q, G-1) degrees of freedom, p-value."""
        idx = [self.terms.index(t) for t in terms if t in self.terms]
        if not idx:
            return float("nan"), float("nan")
        b = self.coef[idx]
        v = self.cov[np.ix_(idx, idx)]
        stat = float(b @ np.linalg.pinv(v) @ b) / len(idx)
        return stat, f_sf(stat, len(idx), self.n_clusters - 1)


def _solve(xtx: np.ndarray, xty: np.ndarray, rtol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, int]:
    d = np.sqrt(np.clip(np.diag(xtx), 1e-300, None))
    a = xtx / np.outer(d, d)
    w, v = np.linalg.eigh(a)
    keep = w > rtol * max(w.max(), 1e-300)
    inv_a = (v[:, keep] / w[keep]) @ v[:, keep].T
    inv = inv_a / np.outer(d, d)
    return inv @ xty, inv, int(keep.sum())


def fit_twfe(df: DataFrame, y: str, x: Sequence[str], unit: Sequence[str], time: str | None = None,
             cluster: Sequence[str] | None = None, absorb_time: bool = True) -> FitResult:
    """OLS of ``y`` on ``x`` + unit effects (+ period effects) with cluster-robust covariance.

    ``V = G/(G-1) (n-1)/(n-k) B^-1 M B^-1`` with ``k`` = rank of the full dummy design (absorbed units and
    periods count).  Rows with a missing ``y`` or regressor are dropped first (P13).  ``cluster`` defaults to the
    unit.  Both kinds of effects are taken off y and x (Frisch-Waugh-Lovell), so the design holds no dummies, however
    many units and periods there are; coefficients and scores equal those of the dummy design.
    """
    unit, x = list(unit), list(x)
    cluster = list(cluster or unit)
    keep = list(dict.fromkeys(unit + cluster + ([time] if time else [])))
    values = {c: f"__c{i}" for i, c in enumerate([*x, y])}
    d = df.select(*keep, *[F.col(c).cast("double").alias(v) for c, v in values.items()]).dropna(subset=list(values.values()))
    d = cut_lineage(d)  # the estimation sample: read by the sweeps and the totals
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*[F.col(u) for u in unit]).alias("g_units"),
                  F.count_distinct(*[F.col(c) for c in cluster]).alias("g"),
                  (F.var_pop(values[y]) * F.count(F.lit(1))).alias("sst")).first()
    cols = [values[c] for c in x]
    if absorb_time and time:
        dm = demean_two_way(d, unit, time, list(values.values()))
        n_periods = d.select(time).distinct().count()
        absorbed = int(stats["g_units"]) + n_periods - connected_parts(d, unit, time)
    else:
        dm, absorbed = cut_lineage(demean_by_unit(d, unit, list(values.values()))), int(stats["g_units"])
    p = len(cols)
    g_all = gram(dm, [*cols, values[y]])
    xtx, xty, yty = g_all[:p, :p], g_all[:p, p], g_all[p, p]
    # a column that the effects explain is zero but for rounding: it must not look like a regressor
    raw = gram(d, cols)
    xtx = np.where(np.outer(*[np.diag(xtx) <= 1e-20 * np.diag(raw)] * 2), 0.0, xtx)
    b, inv, rank = _solve(xtx, xty)
    ssr = float(yty - 2 * b @ xty + b @ xtx @ b)
    n, k = int(stats["n"]), rank + absorbed
    u = F.col(values[y]) - sum((F.lit(float(bi)) * F.col(c) for bi, c in zip(b, cols)), F.lit(0.0))
    scores = dm.withColumn("__u", u).groupBy(*cluster).agg(
        *[F.sum(F.col(c) * F.col("__u")).alias(f"__s{i}") for i, c in enumerate(cols)])
    meat = gram(scores, [f"__s{i}" for i in range(p)])
    g = int(stats["g"])
    scale = (g / (g - 1.0)) * ((n - 1.0) / (n - k)) if g > 1 and n > k else float("nan")
    cov = scale * inv @ meat @ inv
    sst = float(stats["sst"] or 0.0)
    return FitResult(x, b, cov, n, int(stats["g_units"]), g, rank, k, 1.0 - ssr / sst if sst > 0 else float("nan"), ssr)


def coefficient_table(spark: SparkSession, fit: FitResult, outcome: str, decode=None) -> DataFrame:
    """(outcome, term, event_time, coef, se, ci_low, ci_high, p_value) with normal-based CI and p."""
    se = fit.se()
    rows = []
    for t, b, s in zip(fit.terms, fit.coef, se):
        z = b / s if s > 0 else float("nan")
        rows.append((outcome, t, decode(t) if decode else None, float(b), float(s), float(b - Z_975 * s),
                     float(b + Z_975 * s), float(normal_two_sided_p(z)) if s > 0 else None))
    schema = ("outcome string, term string, event_time int, coef double, se double, ci_low double, "
              "ci_high double, p_value double")
    return spark.createDataFrame(rows, schema)


def event_study(df: DataFrame, y: str, covariates: Sequence[str], unit: Sequence[str], time: str,
                event_time: str = "event_time", treat_col: str = "treatment_time", min_k: int = -5,
                max_k: int = 5, omit_k: int = -1, lead_test: Sequence[int] = (-5, -4, -3, -2)) -> tuple[DataFrame, dict]:
    """Event-time dummies + covariates + unit and period effects, clustered by unit.

    Returns the coefficient table (with the joint pre-trend p-value on every row, sorted by event time)
    and a summary dict (nobs, r2, pretrend_pvalue, pretrend_f).
    """
    from panelcraft.functions.clean import event_term_name
    from panelcraft.operators.features import add_event_dummies

    d, evt = add_event_dummies(df, event_time, treat_col, min_k, max_k, omit_k)
    fit = fit_twfe(d, y, [*evt, *covariates], unit, time)
    decode = {event_term_name(k): k for k in range(min_k, max_k + 1)}
    table = coefficient_table(df.sparkSession, fit, y, decode.get)
    leads = [event_term_name(k) for k in lead_test if k != omit_k and min_k <= k <= max_k]
    f, pf = fit.wald_f(leads)
    table = (table.where(F.col("term").isin(evt)).withColumn("pretrend_pvalue", F.lit(pf))
             .orderBy("event_time"))
    return table, {"nobs": float(fit.nobs), "r2": fit.r2, "pretrend_pvalue": pf, "pretrend_f": f,
                   "fit": fit}


# ------------------------------------------------------------------------------------------------
# placebo distribution
# ------------------------------------------------------------------------------------------------


def hash_assignments(treated: DataFrame, unit: str, periods: DataFrame, time: str, n_draws: int,
                     seed: int = 42) -> DataFrame:
    """(draw, unit, placebo_time): each treated unit draws a period by an integer hash of
    (seed, draw, unit) -- reproducible in any engine, no driver-side table.  Draws are generated per
    treated unit (``explode(sequence)``), the period table (one row per period) is broadcast."""
    from pyspark.sql import Window

    idx_periods = periods.select(time).distinct()
    n_p = idx_periods.count()
    idx_periods = idx_periods.withColumn("__pi", (F.row_number().over(Window.orderBy(time)) - 1).cast("bigint"))
    integral = dict(treated.dtypes)[unit] in ("tinyint", "smallint", "int", "bigint")
    a = (treated.select(unit).distinct()
         .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
         .withColumn("__pi", F.pmod(hash_index_expr(F.col("draw"), F.col(unit), seed, integral), F.lit(n_p))))
    return a.join(bounded_broadcast(idx_periods), on="__pi").select("draw", unit, F.col(time).alias("placebo_time"))


def hash_index_expr(draw, unit, seed: int = 42, integral_unit: bool = True):
    """Integer mixing of (seed, draw, unit) with 64-bit wrap-free arithmetic (values stay < 2^62), so
    the draws can be reproduced in any SQL engine; units that are not integers are hashed first."""
    u = F.pmod(unit.cast("bigint") if integral_unit else F.xxhash64(unit.cast("string")), F.lit(2147483647))
    return F.pmod(F.lit(seed) * F.lit(1000003) + (draw.cast("bigint") + F.lit(1)) * F.lit(2654435761)
                  + u * F.lit(40503), F.lit(2147483647))


def numpy_rng_assignments(spark: SparkSession, treated_units: Sequence, years: Sequence[int], n_draws: int,
                          seed: int = 42, unit: str = "unit") -> DataFrame:
    """Reference-compatible draws: ``default_rng(seed).choice(sorted years, size=#treated)`` per draw,
    treated units in sorted order.  Driver-side table of draws x treated units: use only when that is
    small (the reference's 100 x 10)."""
    rng = np.random.default_rng(seed)
    rows = []
    units = sorted(treated_units)
    for draw in range(n_draws):
        ys = rng.choice(sorted(years), size=len(units), replace=True)
        rows += [(draw, u, int(y)) for u, y in zip(units, ys)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["draw", unit, "placebo_time"]))


def placebo_coefficients(df: DataFrame, y: str, covariates: Sequence[str], unit: str, time: str,
                         assignments: DataFrame) -> DataFrame:
    """Coefficient of ``post = 1[time >= placebo_time]`` in y ~ post + covariates + unit + period
    effects, for EVERY draw of ``assignments`` (draw, unit, placebo_time) in one job.

    Frisch-Waugh: with W the unit-demeaned controls (covariates, period dummies) and post demeaned
    within unit, ``b = (d'y - d'W A w_y) / (d'd - d'W A W'd)`` where A = (W'W)^-1.  The per-draw sums
    only need suffix sums over ``time >= g`` per (unit, g), so the panel is NOT replicated per draw:
    the work is #panel rows + #draws x #treated units.
    """
    from pyspark.sql import Window

    d0 = df.select(unit, time, y, *covariates).dropna(subset=[y, *covariates]).persist()
    periods = [r[0] for r in d0.select(time).distinct().orderBy(time).collect()]
    d, tcols = period_dummies(d0, time, periods)
    wcols = [*covariates, *tcols]
    dm = demean_by_unit(d.withColumn(y, F.col(y).cast("double")), [unit], [*wcols, y]).persist()
    try:
        g_all = gram(dm, [*wcols, y])
        q = len(wcols)
        a_inv = _solve(g_all[:q, :q], g_all[:q, q])[1]
        wy = g_all[:q, q]
        # per unit row counts
        n_i = dm.groupBy(unit).agg(F.count(F.lit(1)).alias("__n"))
        # candidate thresholds: every (treated unit, drawn period) pair, as zero rows in the suffix scan
        cand = assignments.select(unit, F.col("placebo_time").alias(time)).distinct()
        vals = [y, *wcols]
        real = dm.select(unit, time, *[F.col(c).alias(f"__v{i}") for i, c in enumerate(vals)],
                         F.lit(1.0).alias("__c"), F.lit(0).alias("__kind"))
        zero = cand.select(unit, time, *[F.lit(0.0).alias(f"__v{i}") for i in range(len(vals))],
                           F.lit(0.0).alias("__c"), F.lit(1).alias("__kind"))
        both = real.unionByName(zero).join(cand.select(unit).distinct(), on=unit, how="left_semi")
        # suffix sums over time >= g: rows per unit = its periods + its candidates (bounded by periods)
        w = Window.partitionBy(unit).orderBy(F.desc(time), F.asc("__kind")).rowsBetween(Window.unboundedPreceding, 0)
        suf = both.select(unit, time, "__kind",
                          *[F.sum(f"__v{i}").over(w).alias(f"__S{i}") for i in range(len(vals))],
                          F.sum("__c").over(w).alias("__C")).where(F.col("__kind") == 1).drop("__kind")
        suf = suf.join(n_i, on=unit)
        per = (assignments.select("draw", unit, F.col("placebo_time").alias(time))
               .join(suf, on=[unit, time], how="inner"))
        agg = per.groupBy("draw").agg(
            *[F.sum(f"__S{i}").alias(f"__S{i}") for i in range(len(vals))],
            F.sum(F.col("__C") - F.col("__C") * F.col("__C") / F.col("__n")).alias("__dd"))
        rows = agg.collect()
    finally:
        dm.unpersist()
        d0.unpersist()
    out = []
    for r in rows:
        dy = r["__S0"]
        dw = np.array([r[f"__S{i}"] for i in range(1, len(vals))])
        num = dy - dw @ a_inv @ wy
        den = r["__dd"] - dw @ a_inv @ dw
        out.append((int(r["draw"]), float(num / den) if abs(den) > 1e-12 else None))
    return df.sparkSession.createDataFrame(out, "draw int, coef double")


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max]; the maximum falls in the last bin (bin numbers 1..bins).
    The two bounds are one small aggregate; the counting is one grouped aggregate."""
    s = df.where(F.col(value).isNotNull())
    mm = s.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if mm["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, n bigint, lo double, hi double")
    lo, hi = float(mm["lo"]), float(mm["hi"])
    width = hi - lo
    b = F.lit(1) if width == 0 else F.least(
        F.floor((F.col(value) - F.lit(lo)) / F.lit(width) * F.lit(float(bins))) + 1, F.lit(bins))
    return s.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"lo": F.lit(lo), "hi": F.lit(hi)})


# ------------------------------------------------------------------------------------------------
# SVD projection
# ------------------------------------------------------------------------------------------------


def svd_project(df: DataFrame, vec: str, dims: int, k: int | None = None, out: str = "svd") -> tuple[DataFrame, np.ndarray]:
    """Truncated SVD (not centred) of the row vectors via the dims x dims Gram: X'X = V S^2 V'.
    Rows are projected to ``X V_k`` (= U_k S_k) inside the executors.  Returns (rows with the ``out``
    array column, singular values).  Signs of components are arbitrary (made deterministic: the largest
    absolute loading of each component is positive)."""
    k = k or min(64, max(2, dims - 1))
    g = array_gram(df, vec, dims)
    w, v = np.linalg.eigh(g)
    order = np.argsort(w)[::-1][:k]
    w, v = w[order], v[:, order]
    flip = np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
    v = v * np.where(flip == 0, 1, flip)
    sv = np.sqrt(np.clip(w, 0, None))
    vb = df.sparkSession.sparkContext.broadcast(v)  # dims x k, a fixed small size

    @F.pandas_udf("array<double>")
    def project(s: pd.Series) -> pd.Series:
        x = np.vstack([np.asarray(a, dtype=np.float64) for a in s]) if len(s) else np.zeros((0, dims))
        return pd.Series(list(x @ vb.value))

    return df.withColumn(out, project(F.col(vec))), sv


SPARSE_BLOCK = 256  # rows that are laid out densely at once


def _sparse_blocks(batch, p: int):
    """Dense blocks of the rows of a batch of sparse ML vectors (column ``v``)."""
    v = batch.column("v")
    v = v.storage if hasattr(v, "storage") else v
    indices, values = v.field("indices"), v.field("values")
    edges, cols, x = indices.offsets.to_numpy(), indices.values.to_numpy(), values.values.to_numpy()
    if not np.array_equal(edges, values.offsets.to_numpy()):
        raise ValueError("the vectors must be sparse")
    for at in range(0, len(v), SPARSE_BLOCK):
        n = min(SPARSE_BLOCK, len(v) - at)
        block = np.zeros((n, p))
        lo, hi = edges[at], edges[at + n]
        block[np.repeat(np.arange(n), np.diff(edges[at:at + n + 1])), cols[lo:hi]] = x[lo:hi]
        yield block


def sparse_gram(df: DataFrame, vec: str, p: int) -> np.ndarray:
    """Gram of a column of sparse ML vectors of width ``p``: one pass, a partial Gram per task, added up row by row."""
    def run(batches):
        total, seen = np.zeros((p, p)), False
        for batch in batches:
            for block in _sparse_blocks(batch, p):
                total += block.T @ block
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    def add(table):
        rows = table.column("v").combine_chunks()
        total = rows.flatten().to_numpy().reshape(-1, p).sum(axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "v": pa.array([total], pa.list_(pa.float64()))})

    parts = df.select(F.col(vec).alias("v")).mapInArrow(run, "i long, v array<double>")
    g = np.zeros((p, p))
    for row in parts.groupBy("i").applyInArrow(add, "i long, v array<double>").collect():
        g[row["i"]] = row["v"]
    return g


def sparse_svd_project(df: DataFrame, vec: str, n_cols: int, k: int, out: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """T3 for sparse ML vectors, e.g. TF-IDF: truncated, uncentred SVD from the Gram (n_cols is bounded by the
    vocabulary), and the projection ``X V`` inside each row's task with the broadcast loadings.  Signs are fixed as in
    :func:`svd_project`; without a row, or with fewer directions than ``k``, the rest is 0."""
    spark = df.sparkSession
    w, v = np.linalg.eigh(sparse_gram(df, vec, n_cols))
    order = np.argsort(w)[::-1][:k]
    w, v = np.clip(w[order], 0, None), v[:, order]
    flip = np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
    v = v * np.where(flip == 0, 1, flip)
    v[:, w <= 1e-12 * max(w.max(initial=0.0), 1e-300)] = 0.0
    loadings = spark.sparkContext.broadcast(v)  # n_cols x k
    rest = [c for c in df.columns if c != vec]

    def run(batches):
        for batch in batches:
            x = [block @ loadings.value for block in _sparse_blocks(batch, n_cols)]
            x = np.concatenate(x) if x else np.zeros((0, v.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(list(x), pa.list_(pa.float64()))], names=["row", out])

    packed = df.select(F.struct(*rest).alias("row"), F.col(vec).alias("v"))
    kind = packed.schema["row"].dataType.simpleString()
    projected = packed.mapInArrow(run, f"row {kind}, {out} array<double>")
    return projected.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], out), np.sqrt(w)
