"""Group-time average treatment effects (G8, P25) and their dynamic aggregation.

ATT(g, t) compares the change of the mean outcome of cohort g (units first treated at g) with that of
the never-treated units, between t and a base period b: b = g - 1 for t >= g, b = t - 1 before
treatment ("varying" base).  On a balanced panel this only needs the cohort-by-period means, so the
whole panel is touched by ONE aggregation (cohort, period) -> (mean, n); everything after works on
that small table (#cohorts x #periods rows).  Units not observed in every period are dropped first
(balanced panel), cohorts treated in the first period have no base and are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcraft.functions.partial import partial_sums
from panelcraft.session import cut_lineage


def balance(df: DataFrame, unit: Sequence[str], time: str) -> DataFrame:
    """Keep only units observed in every period of the panel (left semi join to the complete units)."""
    unit = list(unit)
    n_periods = df.select(time).distinct().count()
    full = df.groupBy(*unit).agg(F.count_distinct(time).alias("__n")).where(F.col("__n") == n_periods)
    return df.join(full.select(*unit), on=unit, how="left_semi")


def cohort_means(df: DataFrame, unit: Sequence[str], time: str, y: str, cohort: str) -> DataFrame:
    """(cohort, time, mean_y, n): cohort 0 = never treated (P25)."""
    return (df.where(F.col(y).isNotNull())
            .groupBy(F.coalesce(F.col(cohort), F.lit(0)).cast("int").alias("g"), F.col(time).alias("t"))
            .agg(F.avg(F.col(y).cast("double")).alias("m"), F.count(F.lit(1)).alias("n")))


def att_gt(df: DataFrame, unit: Sequence[str], time: str, y: str, cohort: str, balanced: bool = True) -> DataFrame:
    """(g, t, base_t, att, n_treated, n_control) for every treated cohort g and period t with a base."""
    df = df.where(F.col(y).isNotNull())  # complete cases first: a unit with a gap is not balanced
    d = balance(df, unit, time) if balanced else df
    # the (cohort, period) table is read four times below: compute it from the panel ONCE
    cm = cut_lineage(cohort_means(d, unit, time, y, cohort))
    treated = cm.where(F.col("g") > 0)
    ctrl = cm.where(F.col("g") == 0).select(F.col("t"), F.col("m").alias("mc"), F.col("n").alias("nc"))
    # base: the last observed period before treatment, or the observed period before t (one row per cohort and period)
    own = Window.partitionBy("g")
    cells = treated.withColumn("b", F.when(
        F.col("t") >= F.col("g"), F.max(F.when(F.col("t") < F.col("g"), F.col("t"))).over(own))
        .otherwise(F.lag("t").over(own.orderBy("t"))))
    base_t = treated.select(F.col("g"), F.col("t").alias("b"), F.col("m").alias("mb"))
    base_c = ctrl.select(F.col("t").alias("b"), F.col("mc").alias("mcb"))
    return (cells.join(base_t, on=["g", "b"], how="inner")
            .join(ctrl, on="t", how="inner").join(base_c, on="b", how="inner")
            .select("g", "t", F.col("b").alias("base_t"),
                    ((F.col("m") - F.col("mb")) - (F.col("mc") - F.col("mcb"))).alias("att"),
                    F.col("n").alias("n_treated"), F.col("nc").alias("n_control")))


def att_dynamic(att: DataFrame, min_e: int | None = None, max_e: int | None = None) -> DataFrame:
    """(event_time, att, n_cohorts): cohort-size weighted mean of ATT(g, g + e) over cohorts."""
    a = att.withColumn("event_time", (F.col("t") - F.col("g")).cast("int"))
    if min_e is not None:
        a = a.where(F.col("event_time") >= min_e)
    if max_e is not None:
        a = a.where(F.col("event_time") <= max_e)
    return a.groupBy("event_time").agg(
        (F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("att"),
        F.count(F.lit(1)).alias("n_cohorts"))


def simple_2x2(df: DataFrame, unit: Sequence[str], time: str, y: str, treated: str, post: str) -> DataFrame:
    """Classic 2x2 difference in differences from the four cell means (one aggregation)."""
    m = df.groupBy(F.col(treated).alias("tr"), F.col(post).alias("po")).agg(F.avg(y).alias("m"))
    p = m.groupBy().pivot("tr", [0, 1]).agg(
        F.first(F.when(F.col("po") == 1, F.col("m")), ignorenulls=True).alias("post"),
        F.first(F.when(F.col("po") == 0, F.col("m")), ignorenulls=True).alias("pre"))
    return p.select(((F.col("1_post") - F.col("1_pre")) - (F.col("0_post") - F.col("0_pre"))).alias("did"))


# ------------------------------------------------------------------------------------------------
# doubly robust ATT(g, t) with covariates
# ------------------------------------------------------------------------------------------------

# Mammen's two-point multiplier weights (mean 0, variance 1): fixed values of the bootstrap.
_SQ5 = 5 ** 0.5
MAMMEN_LOW, MAMMEN_HIGH = (1 - _SQ5) / 2, (1 + _SQ5) / 2
MAMMEN_P_LOW = (_SQ5 + 1) / (2 * _SQ5)
NORMAL_IQR = 1.3489795003921634  # interquartile range of the standard normal
BOOT_UNITS = 1024  # units whose weights of all draws are held at once


def unit_arrays(df: DataFrame, unit: str, time: str, y: str, cohort: str, covariates: Sequence[str]) -> tuple[DataFrame, list]:
    """((unit, g, z, seed), periods): one row per unit observed in every period, with z = (y, covariates) of period after
    period; g = 0 is never treated.  Rows with a missing outcome or covariate go first.  One shuffle of the panel, written
    once: everything after reads these rows only."""
    d = (df.select(F.col(unit).alias("unit"), F.col(time).alias("t"), F.coalesce(F.col(cohort), F.lit(0)).cast("int").alias("g"),
                   *[F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate([y, *covariates])])
         .dropna(subset=["t", *[f"z{i}" for i in range(len(covariates) + 1)]]))
    z = F.array(*[f"z{i}" for i in range(len(covariates) + 1)])
    rows = cut_lineage(d.groupBy("unit").agg(F.max("g").alias("g"), F.array_sort(F.collect_list(F.struct("t", z.alias("z")))).alias("r")))
    periods = sorted(r[0] for r in rows.select(F.explode(F.transform("r", lambda x: x["t"])).alias("t")).distinct().collect())
    complete = (F.size("r") == len(periods)) & (F.size(F.array_distinct(F.transform("r", lambda x: x["t"]))) == len(periods))
    return (rows.where(complete).select("unit", "g", F.flatten(F.transform("r", lambda x: x["z"])).alias("z"),
                                        F.xxhash64(F.col("unit").cast("string")).alias("seed")), periods)


@dataclass
class DoublyRobust:
    """A fitted estimator: ``cells`` (g, t index, base index) and everything that a unit's influence value needs."""
    periods: list
    cells: list[tuple[int, int, int]]
    sizes: dict[int, int]
    k: int
    beta: dict[tuple[int, int], np.ndarray]
    gamma: dict[tuple[int, int], np.ndarray]
    consts: np.ndarray
    att: np.ndarray
    converged: dict[tuple[int, int], bool]

    def n(self, cell: int) -> int:
        return self.sizes[self.cells[cell][0]] + self.sizes[0]


def _batch(batch, n_periods: int) -> tuple[np.ndarray, np.ndarray]:
    g = batch.column("g").to_numpy()
    return g, batch.column("z").flatten().to_numpy().reshape(len(g), n_periods, -1)


def _design(z: np.ndarray, b: int) -> np.ndarray:
    return np.concatenate([np.ones((len(z), 1)), z[:, b, 1:]], axis=1)


def _logistic(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -700, 700)))


def _cell_terms(fit: DoublyRobust, g_of: np.ndarray, z: np.ndarray, c: int) -> tuple[np.ndarray, ...]:
    """Of one cell: the units' places, design, D, propensity, control weight and residual change."""
    g, t, b = fit.cells[c]
    own = np.flatnonzero((g_of == g) | (g_of == 0))
    x, d = _design(z[own], b), (g_of[own] == g).astype(float)
    p = np.minimum(_logistic(x, fit.beta[g, b]), 1 - 1e-16)
    r = z[own, t, 0] - z[own, b, 0] - x @ fit.gamma[b, t]
    return own, x, d, p, p * (1 - d) / (1 - p), r


def fit_doubly_robust(df: DataFrame, unit: str, time: str, y: str, cohort: str, covariates: Sequence[str],
                      max_iter: int = 25, tol: float = 1e-10) -> tuple[DataFrame, DoublyRobust | None]:
    """Propensity scores and outcome regressions of all cells from passes over one array row per unit.

    A pass adds up a fixed number of sums per cell in numpy, batch by batch; a control unit's row serves all cells as it
    stands, it is not repeated per cell.  Cells with the same cohort and base share the logit, cells with the same base and
    period the regression on the controls.  Returns the unit rows and the fit; no fit without a treated cohort that has a
    base period, or without anybody to compare with."""
    rows, periods = unit_arrays(df, unit, time, y, cohort, covariates)
    sizes = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}
    n_periods, k = len(periods), len(covariates) + 1
    cells = []
    for g in sorted(x for x in sizes if x > 0):
        before = [i for i, t in enumerate(periods) if t < g]
        for i, t in enumerate(periods):
            base = before[-1] if t >= g and before else i - 1
            if before and base >= 0:
                cells.append((g, i, base))
    if not cells or not sizes.get(0):
        return rows, None
    pairs = sorted({(g, b) for g, _, b in cells})
    changes = sorted({(b, t) for _, t, b in cells})

    # outcome regressions on the controls
    def regressions(batch):
        g_of, z = _batch(batch, n_periods)
        z = z[g_of == 0]
        out = []
        for b in sorted({b for b, _ in changes}):
            x = _design(z, b)
            out.append((x.T @ x).ravel())
            out += [x.T @ (z[:, t, 0] - z[:, b, 0]) for bb, t in changes if bb == b]
        return np.concatenate(out)

    bases = sorted({b for b, _ in changes})
    sums, at = partial_sums(rows.select("g", "z"), len(bases) * k * k + len(changes) * k, regressions), 0
    gamma, xx_inv = {}, {}
    for b in bases:
        xx = sums[at:at + k * k].reshape(k, k)
        at += k * k
        xx_inv[b] = np.linalg.pinv(xx)
        for bb, t in changes:
            if bb == b:
                gamma[b, t] = np.linalg.lstsq(xx, sums[at:at + k], rcond=None)[0]
                at += k

    # logits by Newton's method, from the intercept-only solution
    beta = {(g, b): np.r_[np.log(sizes[g] / sizes[0]), np.zeros(k - 1)] for g, b in pairs}
    converged = dict.fromkeys(pairs, False)

    def scores(batch):
        g_of, z = _batch(batch, n_periods)
        out = []
        for g, b in pairs:
            own = (g_of == g) | (g_of == 0)
            x = _design(z[own], b)
            p = _logistic(x, beta[g, b])
            out += [x.T @ ((g_of[own] == g) - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()]
        return np.concatenate(out)

    for _ in range(max_iter):
        sums = partial_sums(rows.select("g", "z"), len(pairs) * k * (k + 1), scores).reshape(len(pairs), k * (k + 1))
        steps = {}
        for pair, s in zip(pairs, sums):
            steps[pair] = np.linalg.lstsq(s[k:].reshape(k, k), s[:k], rcond=None)[0]
        beta = {pair: beta[pair] + steps[pair] for pair in pairs}
        converged = {pair: bool(np.abs(steps[pair]).max() < tol) for pair in pairs}
        if all(converged.values()):
            break

    # weighted means, and the constants of the influence function
    fit = DoublyRobust(periods, cells, sizes, k, beta, gamma, np.zeros(0), np.zeros(0), converged)

    def means(batch):
        g_of, z = _batch(batch, n_periods)
        out = []
        for c in range(len(cells)):
            _, x, d, p, wc, r = _cell_terms(fit, g_of, z, c)
            out += [[wc.sum(), (d * r).sum(), (wc * r).sum()], x.T @ d, x.T @ wc, x.T @ (wc * r),
                    ((x * (p * (1 - p))[:, None]).T @ x).ravel()]
        return np.concatenate(out)

    width = 3 + 3 * k + k * k
    sums = partial_sums(rows.select("g", "z"), len(cells) * width, means).reshape(len(cells), width)
    consts, att = [], []
    for c, ((g, t, b), s) in enumerate(zip(cells, sums)):
        n = fit.n(c)
        swc, st, sc = s[:3]
        m1, m3, m2, h = s[3:3 + k], s[3 + k:3 + 2 * k], s[3 + 2 * k:3 + 3 * k], s[3 + 3 * k:].reshape(k, k)
        eta_t, eta_c = st / sizes[g], (sc / swc if swc else 0.0)
        att.append(eta_t - eta_c)
        # the sums are per unit (m / n); the inverses are of sums / n, so the n's cancel
        consts.append(np.concatenate([[eta_t, eta_c, sizes[g] / n, swc / n], xx_inv[b] @ m1, xx_inv[b] @ m3,
                                      np.linalg.pinv(h) @ (m2 - eta_c * m3)]))
    fit.consts, fit.att = np.array(consts), np.array(att)
    return rows, fit


def _influence(fit: DoublyRobust, g_of: np.ndarray, z: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, D, influence values) of one cell's units."""
    own, x, d, p, wc, r = _cell_terms(fit, g_of, z, c)
    q, k = fit.consts[c], fit.k
    ols, ps = (1 - d) * r, d - p
    treated = (d * (r - q[0]) - ols * (x @ q[4:4 + k])) / q[2]
    control = (wc * (r - q[1]) + ps * (x @ q[4 + 2 * k:]) - ols * (x @ q[4 + k:4 + 2 * k])) / (q[3] or np.inf)
    return own, d, treated - control


DR_SCHEMA = ("g int, t int, base_t int, att double, se double, n_treated bigint, n_control bigint, converged boolean")


def att_gt_dr(df: DataFrame, unit: str, time: str, y: str, cohort: str, covariates: Sequence[str],
              max_iter: int = 25, tol: float = 1e-10) -> DataFrame:
    """Doubly robust ATT(g, t) (Sant'Anna and Zhao 2020, panel case): never-treated controls, varying
    base period (the last observed one before treatment, or before t), covariates at the base period, propensity score by
    logit, outcome regression of the change on the controls; standard errors from the influence function.

    Output: (g, t, base_t, att, se, n_treated, n_control, converged); ``converged`` is false where Newton's steps did not
    fall below ``tol`` within ``max_iter`` (the covariates separate a cohort from the controls): such a cell has no
    finite logit, its estimate rests on weights at the edge.
    """
    spark = df.sparkSession
    rows, fit = fit_doubly_robust(df, unit, time, y, cohort, covariates, max_iter, tol)
    if fit is None:
        return spark.createDataFrame([], DR_SCHEMA)
    n_periods, n_cells = len(fit.periods), len(fit.cells)

    def squares(batch):
        g_of, z = _batch(batch, n_periods)
        values = [_influence(fit, g_of, z, c)[2] for c in range(n_cells)]
        return np.array([[v.sum(), (v * v).sum()] for v in values]).ravel()

    sums = partial_sums(rows.select("g", "z"), 2 * n_cells, squares).reshape(n_cells, 2)
    out = []
    for c, ((g, t, b), (s, ss)) in enumerate(zip(fit.cells, sums)):
        n = fit.n(c)
        se = float(np.sqrt(max(ss - s * s / n, 0.0) / (n - 1) / n)) if n > 1 else None
        out.append((g, int(fit.periods[t]), int(fit.periods[b]), float(fit.att[c]), se, fit.sizes[g], fit.sizes[0],
                    fit.converged[g, b]))
    return spark.createDataFrame(out, DR_SCHEMA)


def _mammen(seeds: np.ndarray, seed: int, draws: int) -> np.ndarray:
    """(unit, draw) multiplier weights from a hash of (seed, unit, draw)."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    steps = (np.arange(1, draws + 1, dtype=np.uint64) + np.uint64(seed % (1 << 32)) * np.uint64(1_000_003)) * odd
    x = seeds.astype(np.int64).view(np.uint64)[:, None] + steps
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    low = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53) < MAMMEN_P_LOW
    return np.where(low, MAMMEN_LOW, MAMMEN_HIGH)


def att_dynamic_dr(df: DataFrame, unit: str, time: str, y: str, cohort: str, covariates: Sequence[str],
                   n_boot: int = 999, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Event-time aggregation of the doubly robust ATT(g, t): (event_time, att, se, se_boot, crit_val).

    att(e) = sum_g w_g ATT(g, g+e) / sum_g w_g with w_g the cohort size.  A unit's influence values of
    every cell are rescaled to the full sample and combined in its row; the weights are estimated too
    (w_g = p_g / S_e, p_g = n_g / N, S_e = sum over the cohorts at e), whose influence term reduces to
    1{unit in cohort g} (ATT(g, g+e) - att(e)) / S_e for the treated units of a cell and 0 otherwise;
    se(e) = sqrt(sum_i IF_i(e)^2) / N.  The uniform band's critical value comes from a multiplier
    bootstrap with Mammen weights v_ib hashed from (seed, unit, b): the draws att*_b(e) = sum_i v_ib
    IF_i(e) / N are one matrix product per batch of units, (draws x units) times (units x event times),
    summed over the batches; crit_val = (1 - alpha) quantile of max_e |att*_b(e)| / se_b(e), se_b from the
    interquartile range.  Nothing is replicated per draw, and n_boot x #event times numbers leave a task.
    """
    spark = df.sparkSession
    schema = "event_time int, att double, se double, se_boot double, crit_val double"
    rows, fit = fit_doubly_robust(df, unit, time, y, cohort, covariates)
    if fit is None:
        return spark.createDataFrame([], schema)
    n_periods, n_all = len(fit.periods), sum(fit.sizes.values())
    events = np.array([int(fit.periods[t]) - g for g, t, _ in fit.cells])
    treated = np.array([fit.sizes[g] for g, _, _ in fit.cells], dtype=float)
    es = np.unique(events)
    place = np.searchsorted(es, events)
    total = np.bincount(place, weights=treated)
    att = np.bincount(place, weights=treated * fit.att) / total
    scale = treated / total[place] * n_all / np.array([fit.n(c) for c in range(len(events))])
    weight = (fit.att - att[place]) * n_all / total[place]
    width = len(es)

    def draws(batch):
        g_of, z = _batch(batch, n_periods)
        seeds = batch.column("seed").to_numpy()
        inf = np.zeros((len(g_of), width))
        for c in range(len(events)):
            own, d, values = _influence(fit, g_of, z, c)
            inf[own, place[c]] += values * scale[c] + d * weight[c]
        out = np.zeros((n_boot, width))
        for a in range(0, len(g_of), BOOT_UNITS):
            out += _mammen(seeds[a:a + BOOT_UNITS], seed, n_boot).T @ inf[a:a + BOOT_UNITS]
        return np.concatenate([(inf * inf).sum(axis=0), out.ravel()])

    sums = partial_sums(rows.select("g", "z", "seed"), width * (n_boot + 1), draws)
    se, boot = np.sqrt(sums[:width]) / n_all, sums[width:].reshape(n_boot, width) / n_all
    high, low = np.quantile(boot, 0.75, axis=0), np.quantile(boot, 0.25, axis=0)
    se_b = (high - low) / NORMAL_IQR
    ok = se_b > 1e-12
    crit = float(np.quantile(np.max(np.abs(boot[:, ok]) / se_b[ok], axis=1), 1 - alpha)) if ok.any() else float("nan")
    return spark.createDataFrame([(int(e), float(a), float(s), float(b), crit) for e, a, s, b in zip(es, att, se, se_b)], schema)
