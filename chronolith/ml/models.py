"""Regressors on the log target, their tuning, explanation and ablation, all on pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.errors import error_frame, extremes, metrics
from ..operators.splits import curve_folds, group_places, group_windows, in_order, time_folds
from ..schema import NOT_FEATURES
from ..session import checkpointed
from . import trees as TR
from .boosting import Blocks, Boosted, Params, blocks_of, boosted, fit_boosted
from .tuning import Number, Space, Trial, best, search

_GBT = {"maxIter": 20, "stepSize": 0.1, "maxDepth": 5, "seed": 42}
#: Estimators of Spark by name.
MODELS = {
    # The same normal equations as LinearRegression's, whose fit reads all rows once more for a summary.
    "linear_regression": lambda **p: GeneralizedLinearRegression(**({"family": "gaussian", "link": "identity", "regParam": 0.0} | p)),
    "random_forest": lambda **p: RandomForestRegressor(**({"numTrees": 20, "maxDepth": 6, "seed": 42} | p)),
    "gradient_boosting": lambda **p: GBTRegressor(**(_GBT | p)),
}
#: Boosting by gradients and Hessians: by level, and by leaf with the absolute loss.
BOOSTED = {
    "xgboost": {"learning_rate": 0.3, "max_depth": 5},
    "lightgbm": {"learning_rate": 0.1, "max_depth": 12, "leaves": 31, "min_child_samples": 20, "absolute": True},
}
SPACES: dict[str, Space] = {
    "random_forest": {"numTrees": Number(50, 500, whole=True), "maxDepth": Number(5, 25, whole=True, step=5), "minInstancesPerNode": Number(1, 10, whole=True), "featureSubsetStrategy": ("sqrt", "log2", "0.3", "0.5", "0.75"), "bootstrap": (True, False), "minInfoGain": Number(0.0, 0.2), "subsamplingRate": Number(0.5, 1.0)},
    "gradient_boosting": {"maxIter": Number(100, 1000, whole=True), "stepSize": Number(0.01, 0.1, log=True), "maxDepth": Number(3, 10, whole=True), "minInstancesPerNode": Number(1, 5, whole=True), "featureSubsetStrategy": ("sqrt", "log2", "0.3", "0.5"), "minInfoGain": Number(0.0, 0.2), "subsamplingRate": Number(0.6, 1.0)},
    "xgboost": {"n_estimators": Number(100, 1000, whole=True), "learning_rate": Number(0.01, 0.3, log=True), "max_depth": Number(3, 10, whole=True), "subsample": Number(0.6, 1.0), "colsample_bytree": Number(0.6, 1.0), "reg_alpha": Number(1e-8, 1.0, log=True), "reg_lambda": Number(1e-8, 1.0, log=True), "gamma": Number(1e-8, 1.0, log=True), "min_child_weight": Number(1, 10, whole=True)},
    "lightgbm": {"n_estimators": Number(100, 1000, whole=True), "learning_rate": Number(0.01, 0.1, log=True), "leaves": Number(31, 256, whole=True), "min_child_samples": Number(5, 100, whole=True), "min_child_weight": Number(1e-3, 10.0, log=True), "gamma": Number(0.0, 0.3), "subsample": Number(0.5, 1.0), "colsample_bytree": Number(0.5, 1.0), "reg_alpha": Number(1e-8, 10.0, log=True), "reg_lambda": Number(1e-8, 10.0, log=True)},
    "linear_regression": {"regParam": Number(1e-4, 1.0, log=True)},
}


def feature_columns(df: DataFrame, flags: list[str] = ()) -> list[str]:
    """Numeric columns but keys, labels and the raw size, and the given 0/1 columns."""
    kinds = ("integer", "long", "double", "float", "short")
    return [f.name for f in df.schema.fields if f.name not in (*NOT_FEATURES, "label", "split") and (f.dataType.typeName() in kinds or f.name in flags)]


def chosen(columns: list[str], wanted: list[str]) -> list[str]:
    """The columns that are named, or that begin with a name that ends in an underscore."""
    return [c for c in columns if any(c.startswith(w) if w.endswith("_") else c == w for w in wanted)]


def prepared(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns} | {"label": S.log_target(F.col("days_until_completion"))})


def fit(train: DataFrame, columns: list[str], model: str = "linear_regression", binned: Blocks | None = None, **params) -> PipelineModel | Boosted:
    """binned: what blocks() made of the training rows and of these columns or more, for boosted models."""
    if model in BOOSTED:
        p = Params(**(BOOSTED[model] | params))
        return boosted(binned, columns, p) if binned else fit_boosted(prepared(train, columns), columns, "label", p)
    stages = [VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), MODELS[model](**params).setFeaturesCol("features").setLabelCol("label").setPredictionCol("pred_log")]
    return Pipeline(stages=stages).fit(prepared(train, columns))


def blocks(train: DataFrame, columns: list[str], model: str, **params) -> Blocks:
    """Training rows binned once, for any number of boosted models on some of the columns."""
    return blocks_of(prepared(train, columns), columns, "label", Params(**(BOOSTED[model] | params)))


def predict(model: PipelineModel, df: DataFrame, columns: list[str]) -> DataFrame:
    return model.transform(prepared(df, columns))


def evaluate(model: PipelineModel, test: DataFrame, columns: list[str]) -> DataFrame:
    return metrics(error_frame(predict(model, test, columns)))


def importances(model: PipelineModel, columns: list[str], n: int = 20) -> list[tuple[str, float]]:
    last = model.stages[-1]
    found = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(zip(columns, found.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def fold_pairs(train: DataFrame, k: int, grouped: bool) -> list[tuple[DataFrame, DataFrame]]:
    """k pairs of training and test rows, tests later than training: windows over paths by their first commit, or growing
    stretches of all rows by time."""
    if not grouped:
        rows = checkpointed(time_folds(train, k))
        return [(rows.where(F.col("fold") < f), rows.where(F.col("fold") == f)) for f in range(1, k + 1)]
    places = checkpointed(group_places(train))
    rows = checkpointed(train.join(places.select("path", "place"), "path"))
    at = F.col("place")
    return [(rows.where((at >= a) & (at < b)), rows.where((at >= b) & (at < c))) for a, b, c in group_windows(places.count(), k)]


def cv_error(pairs: list[tuple[DataFrame, DataFrame]], columns: list[str], model: str, params: dict, binned: list[Blocks] | None = None) -> float:
    """Mean of the folds' mean absolute errors on the scale of the label; binned: blocks() of each fold's training rows."""
    found = []
    for k, (before, now) in enumerate(pairs):
        scored = predict(fit(before, columns, model, binned[k] if binned else None, **params), now, columns)
        found.append(scored.agg(F.avg(F.abs(F.col("pred_log") - F.col("label")))).first()[0])
    found = [x for x in found if x is not None]
    return sum(found) / len(found) if found else float("nan")


def tune(train: DataFrame, columns: list[str], model: str, trials: int = 100, seed: int = 42, k: int = 5, grouped: bool = True, parallel: int = 8, pairs: list[tuple[DataFrame, DataFrame]] | None = None) -> list[Trial]:
    """All trials of the Parzen search over the model's space, `parallel` at a time; tuning.best() is what to refit with.
    pairs: the folds, if they are there. Boosted models bin a fold's rows once for all trials."""
    pairs = pairs or fold_pairs(train, k, grouped)
    binned = [blocks(before, columns, model) for before, _ in pairs] if model in BOOSTED else None
    return search(lambda p: cv_error(pairs, columns, model, p, binned), SPACES[model], trials, seed, parallel)


def tuned(train: DataFrame, columns: list[str], model: str, **how) -> tuple[PipelineModel | Boosted, Trial]:
    """The model refitted on all training rows with the best parameters found."""
    found = best(tune(train, columns, model, **how))
    return fit(train, columns, model, **found[0]), found


def learning_curve(train: DataFrame, columns: list[str], model: str, shares: tuple[float, ...] = (0.1, 0.325, 0.55, 0.775, 1.0), k: int = 5) -> list[tuple[float, int, float]]:
    """(share, fold, mean squared error on the label's scale): of each fold, models of growing nested samples of the others."""
    rows = checkpointed(curve_folds(train, shares, k))
    out = []
    for i, share in enumerate(shares):
        for f in range(k):
            scored = predict(fit(rows.where((F.col("fold") != f) & (F.col("level") <= i)), columns, model), rows.where(F.col("fold") == f), columns)
            out.append((share, f, scored.agg(F.avg((F.col("pred_log") - F.col("label")) ** 2)).first()[0]))
    return out


def predict_unlabelled(model: PipelineModel, df: DataFrame, columns: list[str], latest_only: bool = False, most_days: float = 1000.0) -> DataFrame:
    """Predicted days and date for rows without a label; predictions are capped at most_days."""
    rows = df.where(F.col("days_until_completion").isNull())
    if latest_only:
        from ..sources.upserts import latest

        rows = latest(rows)
    days = F.greatest(F.expm1(F.least(F.col("pred_log"), F.log1p(F.lit(most_days)))), F.lit(0.0))
    found = predict(model, rows, columns).withColumn("predicted_days_until_completion", days)
    return found.withColumn("completion_date_predicted", F.timestamp_micros((F.unix_micros("date") + F.col("predicted_days_until_completion") * 86_400_000_000).cast("long"))).select("path", "date", "predicted_days_until_completion", "completion_date_predicted")


def linear_contributions(model: PipelineModel, df: DataFrame, columns: list[str], keep: tuple[str, ...] = ("ord", "path")) -> DataFrame:
    """Exact Shapley values of a linear model."""
    coef = model.stages[-1].coefficients.toArray().tolist()
    return given_contributions(dict(zip(columns, coef, strict=True)), prepared(df, columns), keep)


def given_contributions(weights: dict[str, float], rows: DataFrame, keep: tuple[str, ...] = ("ord", "path")) -> DataFrame:
    """Exact Shapley values of a weighted sum: weight times distance from the mean."""
    means = rows.agg(*[F.avg(c).alias(f"{c}__mean") for c in weights])
    return rows.crossJoin(F.broadcast(means)).select(*keep, *[(F.lit(w) * (F.col(c) - F.col(f"{c}__mean"))).alias(c) for c, w in weights.items()])  # one row


def node_tables(model: PipelineModel | Boosted) -> list[TR.Tree]:
    last = model.stages[-1]
    return last.trees if isinstance(last, Boosted) else TR.from_spark(last)


def tree_contributions(model: PipelineModel | Boosted, df: DataFrame, columns: list[str], keep: tuple[str, ...] = ("ord", "path")) -> DataFrame:
    """Exact path-dependent Shapley values of a tree model, on the scale of the label."""
    return TR.contributions(node_tables(model), prepared(df, columns), columns, list(keep))


def extreme_contributions(model: PipelineModel | Boosted, errors: DataFrame, columns: list[str], n: int = 3) -> DataFrame:
    """(kind, ord, residual, feature, contribution): of the n worst and n best predictions, columns that contribute."""
    rows = extremes(errors, n).withColumn("kind", F.lit("worst")).unionByName(extremes(errors, n, worst=False).withColumn("kind", F.lit("best")))
    found = tree_contributions(model, rows, columns, ("kind", "ord", "residual"))
    return found.unpivot(["kind", "ord", "residual"], columns, "feature", "contribution").where("contribution <> 0")


#: Pairs that are always asked for, where the columns are there.
PAIRS = (("age_in_days", "lag_1_size"), ("commit_interval_days", "age_in_days"))


def strongest_interactions(model: PipelineModel | Boosted, df: DataFrame, columns: list[str], n: int = 3) -> DataFrame:
    """(feature, other, mean_abs, mean): interactions of the column of greatest mean absolute contribution with the next
    n - 1, and of PAIRS, over all rows."""
    top = [r.feature for r in mean_tree_contributions(model, df, columns, n).collect()]
    wanted = [(top[0], c) for c in top[1:]] + [p for p in PAIRS if set(p) <= set(columns)]
    return TR.mean_interactions(node_tables(model), prepared(df, columns), columns, wanted)


def mean_contributions(contributions: DataFrame, columns: list[str], n: int = 20) -> DataFrame:
    one = contributions.agg(*[F.avg(F.abs(c)).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "mean_abs").orderBy(F.desc("mean_abs"), "feature").limit(n)


def mean_tree_contributions(model: PipelineModel | Boosted, df: DataFrame, columns: list[str], n: int = 20) -> DataFrame:
    """mean_contributions() of a tree model over all rows of df, summed where the rows are."""
    one = TR.mean_absolute(node_tables(model), prepared(df, columns), columns)
    return one.unpivot([], columns, "feature", "mean_abs").orderBy(F.desc("mean_abs"), "feature").limit(n)


def commonest(df: DataFrame, group: str, n: int) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), group).limit(n)


def tree_contributions_by(model: PipelineModel | Boosted, df: DataFrame, columns: list[str], group: str, n: int = 5) -> DataFrame:
    """contributions_by() of a tree model: only rows of the commonest values are explained, once, and summed where they are."""
    rows = prepared(df, columns).join(F.broadcast(commonest(df, group, n).select(group)), group)  # n rows
    return TR.mean_absolute(node_tables(model), rows, columns, group)


def contributions_by(contributions: DataFrame, group: str, columns: list[str], n: int = 5) -> DataFrame:
    """Mean absolute contributions for each of the n commonest values of group."""
    top = commonest(contributions, group, n)
    return contributions.join(F.broadcast(top), group).groupBy(group).agg(F.max("rows").alias("rows"), *[F.avg(F.abs(c)).alias(c) for c in columns])  # n rows


def permutation_importance(model: PipelineModel | Boosted, df: DataFrame, columns: list[str], seed: int = 42) -> list[tuple[str, float]]:
    """Rise of the mean absolute error when one column is taken from another row, for models without exact contributions.

    Rows are put in order of a hash once and each takes its values from the one before it, the first from the last. All
    columns are scored in one pass without a further shuffle: a row is scored as it is and once for each column.
    """
    placed = in_order(df.withColumn("_h", F.xxhash64("ord", F.lit(seed))), "_h", "ord")
    other = placed.select(F.pmod(F.col("place") + 1, F.col("rows")).alias("place"), F.struct(*columns).alias("_other"))
    which = F.explode(F.array(F.lit(""), *[F.lit(c) for c in columns]))
    many = placed.join(other, "place").withColumn("_which", which)
    many = many.withColumns({c: F.when(F.col("_which") == c, F.col("_other")[c]).otherwise(F.col(c)) for c in columns}).drop("_other")
    found = error_frame(predict(model, many, columns)).groupBy("_which").agg(F.avg("abs_error").alias("mae"))
    mae = {r["_which"]: r.mae for r in found.collect()}  # a row a column
    return sorted([(c, mae[c] - mae[""]) for c in columns if c in mae], key=lambda x: (-x[1], x[0]))


def partial_dependence(model: PipelineModel, sample: DataFrame, columns: list[str], feature: str, grid: list[float], ice: bool = False) -> DataFrame:
    """Mean prediction with the feature set to each value of a short grid, over a bounded sample (ice: per row)."""
    points = sample.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("value"))
    spread = sample.drop(feature).crossJoin(F.broadcast(points)).withColumn(feature, F.col("value"))
    found = predict(model, spread, columns)
    return found.select("ord", "value", "pred_log") if ice else found.groupBy("value").agg(F.avg("pred_log").alias("mean_pred"))


def partial_dependence_2d(model: PipelineModel, sample: DataFrame, columns: list[str], feature: str, grid: list[float], flag: str) -> DataFrame:
    both = sample.sparkSession.range(1).select(F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("flag_value"))
    points = sample.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("value"))
    spread = sample.drop(feature, flag).crossJoin(F.broadcast(points.crossJoin(both))).withColumns({feature: F.col("value"), flag: F.col("flag_value")})
    return predict(model, spread, columns).groupBy("value", "flag_value").agg(F.avg("pred_log").alias("mean_pred"))


def ablation(df: DataFrame, groups: dict[str, list[str]], model: str = "linear_regression") -> list[tuple[str, float]]:
    """Test error with all feature groups and with each left out; df carries split and is cached once."""
    df = df.cache()
    train, test = df.where(F.col("split") == "train"), df.where(F.col("split") == "test")
    out = []
    for name in ["ALL", *groups]:
        columns = [c for g, cs in groups.items() if g != name for c in cs]
        out.append((name if name == "ALL" else f"without_{name}", evaluate(fit(train, columns, model), test, columns).first().mae))
    df.unpersist()
    return out


def cluster(df: DataFrame, columns: list[str], k: int, bisecting: bool = False) -> DataFrame:
    """Cluster number and vector per row; bisecting k-means gives a hierarchy (Ward linkage of files: graph.ward_linkage)."""
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    est = (BisectingKMeans if bisecting else KMeans)(k=k, seed=42, featuresCol="features", predictionCol="cluster")
    return est.fit(rows).transform(rows).withColumn("vector", vector_to_array("features")).drop("features")


def elbow(df: DataFrame, columns: list[str], ks: tuple[int, ...] = (2, 3, 4, 5)) -> list[tuple[int, float]]:
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(df).cache()
    found = [(k, KMeans(k=k, seed=42).fit(rows).summary.trainingCost) for k in ks]
    rows.unpersist()
    return found
