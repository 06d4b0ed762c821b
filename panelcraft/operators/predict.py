"""Out-of-time prediction: splits, train-fitted imputation/scaling, metrics and a model ladder (M1-M11,
A16, A17, P14).

Fitting statistics come from aggregations over the train rows in long form (exact medians by sketch and bracket, N7;
population sd, N6); applying them is a projection.  Models are Spark ML estimators trained on the cluster; the
elastic net reproduces the scikit-learn objective by pre-scaling the target (see ``elastic_net``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcraft.functions.clean import nan_to_null
from panelcraft.functions.quantile import exact_medians
from panelcraft.session import cut_lineage

SPLITS = ("train", "val", "test")


def time_split(df: DataFrame, time: str, train: tuple[int, int], val: tuple[int, int], test: tuple[int, int],
               out: str = "split") -> DataFrame:
    """M1: split label by period windows (rows outside every window get NULL)."""
    t = F.col(time)
    return df.withColumn(out, F.when(t.between(*train), "train").when(t.between(*val), "val")
                         .when(t.between(*test), "test"))


def quantile_split(df: DataFrame, time: str, q1: float = 0.6, q2: float = 0.8, out: str = "split") -> DataFrame:
    """M2: cut at the periods at positions int(q1 n) and int(q2 n) of the sorted distinct periods:
    train <= cut1 < val <= cut2 < test.  Needs >= 3 periods (else everything is train).
    The distinct periods are few (one row each), so the two cuts are fetched as scalars."""
    periods = [r[0] for r in df.select(time).distinct().orderBy(time).collect()]
    if len(periods) < 3:
        return df.withColumn(out, F.lit("train"))
    c1, c2 = periods[int(len(periods) * q1)], periods[int(len(periods) * q2)]
    t = F.col(time)
    return df.withColumn(out, F.when(t <= F.lit(c1), "train").when(t <= F.lit(c2), "val").otherwise("test"))


def split_with_fallback(df: DataFrame, time: str, train, val, test, out: str = "split") -> DataFrame:
    """M1 + M2: the period windows, or the quantile cuts when val or test would be empty."""
    labelled = time_split(df, time, train, val, test, out)
    present = {r[0] for r in labelled.where(F.col(out).isNotNull()).select(out).distinct().collect()}
    if "val" not in present or "test" not in present:
        return quantile_split(df, time, out=out)
    return labelled.where(F.col(out).isNotNull())


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    """A17."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Preprocess:
    medians: dict[str, float]
    means: dict[str, float] = field(default_factory=dict)
    sds: dict[str, float] = field(default_factory=dict)
    entries: list[str] = field(default_factory=list)  # every scalar, then every entry of every vector, missing ones included
    vectors: dict[str, int] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return list(self.medians)


def vector_widths(df: DataFrame, vectors: Sequence[str]) -> dict[str, int]:
    """Entries of each array column; arrays of unequal length raise, a column without any array has none."""
    if not vectors:
        return {}
    row = df.agg(*[F.min(F.size(F.when(F.col(v).isNotNull(), F.col(v)))).alias(f"lo_{i}") for i, v in enumerate(vectors)],
                 *[F.max(F.size(F.when(F.col(v).isNotNull(), F.col(v)))).alias(f"hi_{i}") for i, v in enumerate(vectors)]).first()
    for i, v in enumerate(vectors):
        if row[f"lo_{i}"] != row[f"hi_{i}"]:
            raise ValueError(f"the vectors of {v} have between {row[f'lo_{i}']} and {row[f'hi_{i}']} entries")
    return {v: max(row[f"hi_{i}"] or 0, 0) for i, v in enumerate(vectors)}


def _values(cols: Sequence[str], widths: Mapping[str, int]) -> Column:
    """One array of the scalars and the entries of the vectors; a missing vector has only missing entries."""
    scalars = F.array(*[nan_to_null(F.col(c).cast("double")) for c in cols]) if cols else F.array().cast("array<double>")
    parts = [F.coalesce(F.transform(F.col(v).cast("array<double>"), nan_to_null), F.array_repeat(F.lit(None).cast("double"), n))
             for v, n in widths.items()]
    return F.concat(scalars, *parts) if parts else scalars


def fit_preprocess(train: DataFrame, cols: Sequence[str], scale: bool = True, vectors: Sequence[str] = ()) -> Preprocess:
    """M3/M4: exact train medians; entries that are entirely missing in train are dropped (as the
    reference's imputer does); then mean and population sd of the imputed train values.

    ``vectors`` are array columns (M11): entry i of ``emb`` is the feature ``emb_00i``.  All features go through the same
    three aggregations in long form, whose results have one row a feature."""
    cols = list(cols)
    widths = vector_widths(train, list(vectors))
    entries = cols + [f"{v}_{i:03d}" for v, n in widths.items() for i in range(n)]
    if not entries:
        return Preprocess({})
    values = train.select(_values(cols, widths).alias("__values"))
    found = exact_medians(values.select(F.posexplode("__values").alias("__f", "__v")), "__f", "__v")
    medians = {r["__f"]: float(r["median"]) for r in found.collect()}
    pp = Preprocess({entries[i]: medians[i] for i in sorted(medians)}, entries=entries, vectors=widths)
    if scale and medians:
        fill = F.array(*[F.lit(medians.get(i)).cast("double") for i in range(len(entries))])
        filled = values.select(F.posexplode(F.zip_with("__values", fill, lambda v, m: F.coalesce(v, m))).alias("__f", "__v"))
        rows = {r["__f"]: r for r in filled.where(F.col("__v").isNotNull()).groupBy("__f")
                .agg(F.avg("__v").alias("m"), F.stddev_pop("__v").alias("s")).collect()}
        pp.means = {entries[i]: float(rows[i]["m"]) for i in sorted(medians)}
        pp.sds = {entries[i]: float(rows[i]["s"]) or 1.0 for i in sorted(medians)}
    return pp


def apply_preprocess(df: DataFrame, pp: Preprocess, scale: bool = True, suffix: str = "") -> DataFrame:
    """Imputed (and scaled) scalar features as columns."""
    exprs = {}
    for c, m in pp.medians.items():
        if pp.entries and c not in pp.entries[:len(pp.entries) - sum(pp.vectors.values())]:
            continue
        v = F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(m))
        if scale and pp.sds:
            v = (v - F.lit(pp.means[c])) / F.lit(pp.sds[c])
        exprs[f"{c}{suffix}"] = v
    return df.withColumns(exprs)


def model_vector(pp: Preprocess, scale: bool = True) -> Column:
    """The imputed (and scaled) features, scalars and vector entries alike, as one ML vector."""
    from pyspark.ml.functions import array_to_vector

    kept = [i for i, c in enumerate(pp.entries) if c in pp.medians]
    literal = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    scalars = pp.entries[:len(pp.entries) - sum(pp.vectors.values())]
    values = _values(scalars, pp.vectors)
    if len(kept) < len(pp.entries):
        whole = values
        values = F.transform(F.array(*[F.lit(i) for i in kept]), lambda i: F.get(whole, i))
    x = F.zip_with(values, literal(pp.medians[pp.entries[i]] for i in kept), lambda v, m: F.coalesce(v, m))
    if scale and pp.sds:
        x = F.zip_with(x, literal(pp.means[pp.entries[i]] for i in kept), lambda v, m: v - m)
        x = F.zip_with(x, literal(pp.sds[pp.entries[i]] for i in kept), lambda v, s: v / s)
    return array_to_vector(x)


def join_vectors(panel: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The vectors of a (unit, time) table beside the panel's columns; cells without one get NULL."""
    return panel.join(vectors, on=list(keys), how="left")


def regression_metrics(df: DataFrame, y: str, yhat: str, group: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R^2 (1 - SSE/SST around the evaluated rows' own mean) per group."""
    e = F.col(y) - F.col(yhat)
    g = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("__sse"), (F.var_pop(F.col(y)) * F.count(F.col(y))).alias("__sst"))  # var_pop: no cancellation
    return g.withColumn("r2", F.lit(1.0) - F.try_divide(F.col("__sse"), F.col("__sst"))).drop("__sse", "__sst")


# ------------------------------------------------------------------------------------------------
# model ladder
# ------------------------------------------------------------------------------------------------


def elastic_net(features: str, label: str, alpha: float = 0.1, l1_ratio: float = 0.5, sigma_y: float = 1.0):
    """M5: Spark ``LinearRegression`` set up to minimise the scikit-learn elastic-net objective for a
    target pre-divided by its population sd ``sigma_y`` (Spark rescales the penalty by the target's
    sd): l1 = alpha r / sigma, l2 = alpha (1 - r)."""
    from pyspark.ml.regression import LinearRegression

    l1 = alpha * l1_ratio / sigma_y
    l2 = alpha * (1.0 - l1_ratio)
    reg = l1 + l2
    return LinearRegression(featuresCol=features, labelCol=label, regParam=reg,
                            elasticNetParam=(l1 / reg) if reg > 0 else 0.0, standardization=False,
                            tol=1e-9, maxIter=500, fitIntercept=True)


def default_models(n_trees: int = 400, max_depth: int = 30, gbt_iter: int = 100) -> dict[str, dict]:
    """M5-M8 rungs: name -> {"scale": bool, "kind": ...}.  Tree depth/count are parameters; the defaults are
    the reference's 400 trees and 100 rounds, its trees of any depth stop at the 30 levels Spark can build."""
    return {
        "ElasticNet": {"scale": True, "kind": "enet"},
        "RandomForestRegressor": {"scale": False, "kind": "rf", "n_trees": n_trees, "max_depth": max_depth},
        "GBTRegressor": {"scale": False, "kind": "gbt", "max_iter": gbt_iter},
        "FMRegressor": {"scale": True, "kind": "fm"},
    }


def ridge(features: str, label: str, alpha: float = 1.0):
    """A closed-form rung: minimises 1/(2n) |y - Xw - b|^2 + alpha/2 |w|^2 by its normal equations, for a target
    pre-divided by its population sd (Spark divides the penalty by that)."""
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(featuresCol=features, labelCol=label, regParam=alpha, elasticNetParam=0.0, standardization=False,
                            solver="normal", fitIntercept=True)


TRAIN_ROWS_A_TASK = 50_000  # the iterations of the trees run one job each: few rows, few tasks


def _fit(name: str, spec: dict, train: DataFrame, target: str, center: float, sigma: float, seed: int):
    """(model, scale, shift of its predictions)."""
    from pyspark.ml.regression import FMRegressor, GBTRegressor, RandomForestRegressor

    kind = spec["kind"]
    if kind == "enet":
        return elastic_net("__x", "__ys", sigma_y=sigma).fit(train.withColumn("__ys", F.col(target) / F.lit(sigma))), sigma, 0.0
    if kind == "ridge":
        return ridge("__x", "__ys", spec.get("alpha", 1.0)).fit(train.withColumn("__ys", F.col(target) / F.lit(sigma))), sigma, 0.0
    if kind == "fm":  # gradient steps of a fixed size need a target of unit scale
        train = train.withColumn("__ys", (F.col(target) - F.lit(center)) / F.lit(sigma))
        return FMRegressor(featuresCol="__x", labelCol="__ys", factorSize=8, seed=seed, maxIter=spec.get("max_iter", 200),
                           stepSize=0.05, tol=1e-6, solver="adamW").fit(train), sigma, center
    if kind == "rf":
        return RandomForestRegressor(featuresCol="__x", labelCol=target, numTrees=spec["n_trees"], maxDepth=spec["max_depth"],
                                     minInstancesPerNode=2, featureSubsetStrategy="all", seed=seed).fit(train), 1.0, 0.0
    if kind == "gbt":
        return GBTRegressor(featuresCol="__x", labelCol=target, maxDepth=6, maxIter=spec["max_iter"], stepSize=0.1,
                            minInstancesPerNode=20, seed=seed).fit(train), 1.0, 0.0
    raise ValueError(f"{name}: unknown kind of model {kind}")


def model_ladder(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], task: str,
                 split: str = "split", models: dict | None = None, seed: int = 42,
                 vectors: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Fit every rung on train, evaluate on val and test.

    ``vectors`` are array columns (e.g. text embeddings, J3/M11) whose entries are features beside the scalar ones.
    Returns (eval table: task, model, val_/test_ mae/rmse/r2, n_train/n_val/n_test) and the long test
    prediction table (keys, task, model, y_true, y_pred).  A task with an empty split is skipped.
    """
    spark = df.sparkSession
    models = models or default_models()
    data = df.withColumn(target, nan_to_null(F.col(target).cast("double"))).where(F.col(target).isNotNull())
    sizes = {r[split]: r["n"] for r in split_sizes(data, split).collect()}
    eval_schema = ("task string, model string, val_mae double, val_rmse double, val_r2 double, test_mae double, "
                   "test_rmse double, test_r2 double, n_train bigint, n_val bigint, n_test bigint")
    pred_cols = [*keys, "task", "model", "y_true", "y_pred"]
    if any(sizes.get(s, 0) == 0 for s in SPLITS):
        return spark.createDataFrame([], eval_schema), data.select(*keys).limit(0).withColumns(
            {"task": F.lit(None).cast("string"), "model": F.lit(None).cast("string"),
             "y_true": F.lit(None).cast("double"), "y_pred": F.lit(None).cast("double")})
    is_train = F.col(split) == "train"
    pp = fit_preprocess(data.where(is_train), features, scale=True, vectors=vectors)
    center, sigma = data.where(is_train).agg(F.avg(target), F.stddev_pop(target)).first()
    sigma = sigma or 1.0
    tasks = -(-sizes["train"] // TRAIN_ROWS_A_TASK)
    train = {}
    for scaled in {spec["scale"] for spec in models.values()}:
        x = data.where(is_train).select(target, model_vector(pp, scaled).alias("__x"))
        train[scaled] = x.coalesce(tasks).persist()
    evals, preds = [], []
    for name, spec in models.items():
        model, scale, shift = _fit(name, spec, train[spec["scale"]], target, center, sigma, seed)
        rest = data.where(~is_train).withColumn("__x", model_vector(pp, spec["scale"]))
        scored = cut_lineage(model.transform(rest).select(
            *keys, split, F.col(target).alias("y_true"), (F.col("prediction") * F.lit(scale) + F.lit(shift)).alias("y_pred")))
        met = {r[split]: r for r in regression_metrics(scored, "y_true", "y_pred", [split]).collect()}
        evals.append((task, name, met["val"]["mae"], met["val"]["rmse"], met["val"]["r2"], met["test"]["mae"],
                      met["test"]["rmse"], met["test"]["r2"], sizes["train"], sizes["val"], sizes["test"]))
        preds.append(scored.where(F.col(split) == "test").select(
            *keys, F.lit(task).alias("task"), F.lit(name).alias("model"), "y_true", "y_pred"))
    for x in train.values():
        x.unpersist()
    pred = preds[0]
    for p in preds[1:]:
        pred = pred.unionByName(p)
    return spark.createDataFrame(evals, eval_schema), pred.select(*pred_cols)
