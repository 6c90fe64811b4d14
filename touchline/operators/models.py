"""Component models on Spark ML: start, attack and clean sheet; evaluation, grid search, full backtest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import clip
from touchline.operators import boosting, features, scoring
from touchline.operators.backtest import overall_metrics, overall_rank, period_metrics
from touchline.operators.stage import stage_in

START_INPUTS = features.START_FEATURES
LAG_INPUTS = [f"{s}_lag_{n}" for s in ("xg", "xa", "cs") for n in features.LAGS] + [f"{s}_rolling_{n}" for s in ("xg", "xa", "cs") for n in features.WINDOWS]
ATTACK_INPUTS = ["xg_per_90", "xa_per_90", "goals_per_90", "assists_per_90", "blocks_per_90", "interventions_per_90", "passes_per_90", *LAG_INPUTS]
DEFENSE_INPUTS = ["xgc_per_90", "goals_conceded_per_90", "cs_rate", "blocks_per_90", "interventions_per_90", "passes_per_90", *LAG_INPUTS]


def _pipeline(inputs: Sequence[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), estimator])


def start_pipeline(trees: int = 40, depth: int = 5, step: float = 0.1, forest: bool = False, inputs: Sequence[str] = START_INPUTS, label: str = "label") -> Pipeline:
    if forest:
        return _pipeline(inputs, RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=42))
    return _pipeline(inputs, GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, seed=42))


def attack_pipeline(label: str, trees: int = 40, depth: int = 5, step: float = 0.1, inputs: Sequence[str] = ATTACK_INPUTS, validation: str | None = None) -> Pipeline:
    gbt = GBTRegressor(labelCol=label, predictionCol=f"p_{label}", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, seed=42)
    return _pipeline(inputs, gbt.setValidationIndicatorCol(validation) if validation else gbt)


def clean_sheet_pipeline(trees: int = 40, depth: int = 5, step: float = 0.1, inputs: Sequence[str] = DEFENSE_INPUTS, label: str = "label_cs") -> Pipeline:
    return _pipeline(inputs, GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, seed=42))


def probability(c: str = "probability"):
    return vector_to_array(F.col(c))[1]


def predict_start(model: PipelineModel, df: DataFrame) -> DataFrame:
    """With p_start, and xmins by the recent minutes."""
    out = model.transform(df).withColumn("p_start", probability()).drop("_raw", "features", "rawPrediction", "probability", "prediction")
    return out.withColumn("xmins", scoring.expected_minutes(F.col("p_start"))) if "recent_minutes" in df.columns else out


def predict_attack(models: tuple[PipelineModel, PipelineModel], df: DataFrame, opponent_defense: str | None = None) -> DataFrame:
    """With xg and xa, floored at 0 and scaled by the opponent's defence. A trained model's own labels are replaced."""
    out = models[0].transform(df).drop("_raw", "features")
    out = models[1].transform(out).drop("_raw", "features")
    m = scoring.attack_multiplier(F.coalesce(F.col(opponent_defense), F.lit(0.0))) if opponent_defense else F.lit(1.0)
    return out.withColumns({"xg": F.greatest(F.lit(0.0), F.col("p_label_xg") * m), "xa": F.greatest(F.lit(0.0), F.col("p_label_xa") * m)}).drop("p_label_xg", "p_label_xa")


def predict_clean_sheet(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("xcs", clip(probability(), 0.0, 1.0)).drop("_raw", "features", "rawPrediction", "probability", "prediction")


def grid_search(pipeline: Pipeline, df: DataFrame, evaluator, trees: Sequence[int] = (20, 40), depths: Sequence[int] = (3, 5), steps: Sequence[float] = (0.05, 0.1), folds: int = 3, parallelism: int = 4):
    """(best model, table of settings and mean error). Folds and settings run as Spark jobs side by side."""
    gbt = pipeline.getStages()[-1]
    grid = ParamGridBuilder().addGrid(gbt.maxIter, list(trees)).addGrid(gbt.maxDepth, list(depths)).addGrid(gbt.stepSize, list(steps)).build()
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, parallelism=parallelism, seed=42).fit(df)
    rows = [(p[gbt.maxIter], p[gbt.maxDepth], p[gbt.stepSize], float(m)) for p, m in zip(grid, cv.avgMetrics)]
    return cv.bestModel, df.sparkSession.createDataFrame(rows, "trees int, depth int, step double, error double")


def evaluate_probability(df: DataFrame, p: str, label: str) -> DataFrame:
    """log-loss, accuracy, auc, means of a scored table. The area is the rank statistic over distinct scores, by aggregates."""
    eps = 1e-7
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    loss = -(F.col(label) * F.ln(q) + (1 - F.col(label)) * F.ln(1 - q))
    m = df.agg(F.count("*").alias("n"), F.avg(loss).alias("log_loss"), F.avg(F.when((F.col(p) >= 0.5) == (F.col(label) > 0), 1.0).otherwise(0.0)).alias("accuracy"), F.avg(p).alias("mean_predicted"), F.avg(label).alias("mean_actual"))
    counts = df.groupBy(F.col(p).alias("_p")).agg(F.sum(label).alias("_pos"), F.count("*").alias("_n"))
    ranked = counts.join(overall_rank(df, p, "_rank"), F.col("_p") == F.col(p))
    a = ranked.agg(F.sum(F.col("_pos") * F.col("_rank")).alias("s"), F.sum("_pos").alias("pos"), F.sum("_n").alias("all"))
    negatives = F.col("all") - F.col("pos")
    area = F.when((F.col("pos") > 0) & (negatives > 0), (F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * negatives))
    return m.join(F.broadcast(a.select(area.alias("auc"))))


def evaluate_value(df: DataFrame, p: str, label: str) -> DataFrame:
    d = F.col(p) - F.col(label)
    return df.agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(p).alias("mean_predicted"), F.avg(label).alias("mean_actual"))


def regression_error(label: str) -> RegressionEvaluator:
    return RegressionEvaluator(labelCol=label, predictionCol=f"p_{label}", metricName="mae")


@dataclass
class Components:
    start: PipelineModel
    xg: PipelineModel
    xa: PipelineModel
    clean_sheet: PipelineModel


def training_frame(stats: DataFrame, players: DataFrame) -> DataFrame:
    """All features of all periods in one plan: every column looks at earlier rows only, so folds are filters on it."""
    df = stats.join(players.select("player_id", "position", "price", "status"), "player_id")
    df = features.start_frame(df)
    w = features.before(features.in_order())
    minutes = F.coalesce(F.sum("minutes").over(w), F.lit(0))
    rates = {f"{c}_per_90": features.per_90(F.coalesce(F.sum(F.col(c).cast("double")).over(w), F.lit(0.0)), minutes) for c in ("xg", "xa", "goals", "assists", "xgc", "goals_conceded")}
    recent = {"recent_minutes": F.reverse(F.collect_list(F.col("minutes").cast("double")).over(features.before(features.in_order(), 5)))}
    df = features.lag_features(features.defcon_to_date(df)).withColumns(rates | recent)
    return df.withColumns({"label_xg": F.col("xg"), "label_xa": F.col("xa"), "label_cs": F.when(F.col("clean_sheets") > 0, 1.0).otherwise(0.0), "ict": F.coalesce(F.lag("ict_index", 1).over(features.in_order()), F.lit(0.0))})


def train_components(frame: DataFrame, trees: int = 20, depth: int = 4) -> Components:
    """Three kinds of models over one cached frame. The start model needs both outcomes; a frame of starters only gets a constant row of the other."""
    data = frame.persist()
    try:
        one = data.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).head()
        start = data if one["lo"] != one["hi"] else data.unionByName(data.limit(1).withColumn("label", F.lit(1.0 - (one["lo"] or 0.0))))
        return Components(
            start_pipeline(trees, depth).fit(start), attack_pipeline("label_xg", trees, depth).fit(data), attack_pipeline("label_xa", trees, depth).fit(data), clean_sheet_pipeline(trees, depth).fit(data),
        )
    finally:
        data.unpersist()


def score(models: Components, frame: DataFrame) -> DataFrame:
    """player_id, gameweek, xp and its parts."""
    df = predict_start(models.start, frame)
    df = predict_attack((models.xg, models.xa), df)
    return _points(predict_clean_sheet(models.clean_sheet, df))


def _points(df: DataFrame) -> DataFrame:
    df = df.withColumn("xcs", F.when(F.col("position").isin("GK", "DEF"), F.col("xcs")).otherwise(0.0))
    df = df.withColumn("defcon_points", F.col("floor_points")).withColumn("form", F.col("form_score") * 10).withColumn("ict_index", F.col("ict"))
    return scoring.expected_points(df)


def early_calibrated(out: DataFrame, least: int) -> DataFrame:
    """out with `predicted` calibrated in every period from the first that has `least` predictions before it; the calibration is fitted once, on those earlier ones."""
    before, start = 0, None
    for row in sorted(out.groupBy("gameweek").count().collect()):
        if before >= least:
            start = row["gameweek"]
            break
        before += row["count"]
    fitted = None if start is None else scoring.fit_calibration(out.filter(F.col("gameweek") < start)).head()
    if fitted is None:
        return out
    later = F.greatest(F.lit(0.0), F.col("predicted") * fitted["scale"] + fitted["offset"])
    return out.withColumn("predicted", F.when(F.col("gameweek") >= start, later).otherwise(F.col("predicted")))


#: Label, inputs, whether it is a probability, and the prediction's name of each component.
COMPONENTS = (("label", START_INPUTS, True, "p_start"), ("label_xg", ATTACK_INPUTS, False, "p_label_xg"), ("label_xa", ATTACK_INPUTS, False, "p_label_xa"), ("label_cs", DEFENSE_INPUTS, True, "p_cs"))


def fold_predictions(frame: DataFrame, periods: Sequence[int], stage, trees: int = 20, depth: int = 4, columns: Sequence[str] = ()) -> DataFrame:
    """For each of `periods` the rows of that period with xp and its parts, by components fitted on all earlier periods. All folds and components grow in one plan."""
    ids = [c for c in ("season", "player_id", "gameweek") if c in frame.columns]
    inputs = list(dict.fromkeys(c for _, own, _, _ in COMPONENTS for c in own))
    data = boosting.binned(frame, inputs, [c[0] for c in COMPONENTS], [F.col("gameweek") < p for p in periods], ids, stage)
    fits = [boosting.Fit(label, tuple(own), k, logistic, trees, depth) for label, own, logistic, _ in COMPONENTS for k in range(len(periods))]
    forests = boosting.fit_all(data, fits, stage)
    which = {name: range(i * len(periods), (i + 1) * len(periods)) for i, (_, _, _, name) in enumerate(COMPONENTS)}
    fold = F.element_at(F.create_map(*[F.lit(x) for k, p in enumerate(periods) for x in (p, k)]), F.col("gameweek").cast("int"))
    made = boosting.predicted(data, fits, forests, which, fold)
    df = frame.drop("xg", "xa", "xcs", "p_start", "xmins").join(made, ids)
    df = df.withColumns({"xmins": scoring.expected_minutes(F.col("p_start")), "xg": F.greatest(F.lit(0.0), "p_label_xg"), "xa": F.greatest(F.lit(0.0), "p_label_xa"), "xcs": clip(F.col("p_cs"), 0.0, 1.0)})
    return _points(df)


def full_backtest(stats: DataFrame, players: DataFrame, test_periods: Sequence[int] | None = None, checkpoint: str | None = None, trees: int = 20, depth: int = 4, min_train: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, metrics by period, overall metrics with the final calibration). Periods: those asked for, or all, that have min_train earlier periods.

    Features are computed once; all folds and components are fitted in one plan. Predictions are calibrated early once there are max(5, a third of the periods) of them.
    """
    stage = stage_in(stats.sparkSession, checkpoint)
    frame = stage(training_frame(stats, players), "frame")
    known = sorted(row["gameweek"] for row in frame.select("gameweek").distinct().collect())
    asked = known if test_periods is None else sorted(test_periods)
    ready = [p for p in asked if sum(q < p for q in known) >= min_train]
    if ready:
        made = fold_predictions(frame, ready, stage, trees, depth).select("player_id", "gameweek", F.col("xp").alias("predicted"), F.col("total_points").cast("double").alias("points"))
        made = stage(made, "predictions")
    else:
        made = frame.filter("false").select("player_id", "gameweek", F.lit(0.0).alias("predicted"), F.col("total_points").cast("double").alias("points"))
    out = early_calibrated(made, max(5, len(asked) // 3))
    calibration = scoring.fit_calibration(out)
    return out, period_metrics(out), overall_metrics(out).join(F.broadcast(calibration.select("scale", "offset", "rmse_after")))


def boosted_grid(frame: DataFrame, inputs: Sequence[str], label: str, ids: Sequence[str], trees: Sequence[int] = (20, 40), depths: Sequence[int] = (3, 5), steps: Sequence[float] = (0.05, 0.1), subsamples: Sequence[float] = (0.8,), folds: int = 3, halving: bool = True, logistic: bool = False, checkpoint: str | None = None) -> tuple[dict, DataFrame]:
    """(best setting, table of all settings with their mean error over the folds).

    All settings and folds grow in one plan on features cut once. A setting of fewer trees is the beginning of one of more, so it is not fitted again. halving gives up the worse half
    of what is left whenever a number of `trees` is reached; the table then has no error of the given-up ones beyond.
    """
    stage = stage_in(frame.sparkSession, checkpoint)
    part = F.pmod(F.xxhash64(F.lit(7), *ids), F.lit(folds))
    data = boosting.binned(frame, inputs, [label], [part != k for k in range(folds)], ids, stage)
    settings = [(d, s, u) for d in depths for s in steps for u in subsamples]
    most = sorted(trees)
    fits = [boosting.Fit(label, tuple(inputs), k, logistic, most[-1], d, s, u) for d, s, u in settings for k in range(folds)]
    table: dict[tuple, float] = {}
    gone: set[int] = set()

    def drop(n: int, forests: list[boosting.Forest]) -> set[int]:
        if n not in most:
            return set()
        left = [k for k in range(len(fits)) if k not in gone]
        found = dict(zip(left, boosting.errors(data, [fits[k] for k in left], [forests[k] for k in left])))
        mean = {i: sum(found[i * folds + k] for k in range(folds)) / folds for i in range(len(settings)) if i * folds in found}
        table.update({(n, *settings[i]): e for i, e in mean.items()})
        worse = sorted(mean, key=lambda i: (mean[i], i))[(len(mean) + 1) // 2 :] if halving else []
        gone.update(i * folds + k for i in worse for k in range(folds))
        return set(gone)

    boosting.fit_all(data, fits, stage, drop)
    rows = [(*key, float(table[key]) if key in table else None) for key in ((n, *s) for n in most for s in settings)]
    best = min((r for r in rows if r[-1] is not None), key=lambda r: (r[-1], r))
    return dict(zip(("trees", "depth", "step", "subsample", "error"), best)), frame.sparkSession.createDataFrame(rows, "trees int, depth int, step double, subsample double, error double")
