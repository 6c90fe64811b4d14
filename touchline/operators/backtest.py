"""Backtests and metrics. Closed-form predictors are windows over per-period sums; other predictors run fold by fold."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import correlation, finite
from touchline.operators.stage import stage_in

Predictor = Callable[[DataFrame, DataFrame], DataFrame]


def mean_backtest(df: DataFrame, min_train: int = 5, window: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of tested periods with `predicted`, the mean points of all earlier periods (or of the `window` periods before).

    df: player_id, gameweek, points. Periods are summed first; the window runs over one row
    a period, and its result is broadcast back to the rows. No fold is computed twice.
    """
    per = df.groupBy(*keys, "gameweek").agg(F.sum("points").alias("s"), F.count("points").alias("c"))
    w = Window.partitionBy(*keys).orderBy("gameweek")
    span = w.rowsBetween(Window.unboundedPreceding if window is None else -window, -1)
    per = per.withColumn("predicted", F.sum("s").over(span) / F.sum("c").over(span)).withColumn("_i", F.row_number().over(w))
    start = min_train if window is None else window
    tested = per.filter(F.col("_i") > start).select(*keys, "gameweek", "predicted")
    return df.join(tested, [*keys, "gameweek"])


def fold_backtest(df: DataFrame, predictor: Predictor, min_train: int = 5, window: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """The same for any predictor(train, test) -> (player_id, predicted). Missing predictions count as 0.

    The predictors in AT_ONCE have all folds in one plan. Of any other, one fold is one Spark job over the (cached) facts; folds
    are written one by one to the checkpoint folder, so lineage does not grow and a lost executor repeats one fold.
    """
    if predictor in AT_ONCE:
        return AT_ONCE[predictor](df, min_train, window)
    spark = df.sparkSession
    base = checkpoint or spark.conf.get("spark.checkpoint.dir", None)
    periods = [row["gameweek"] for row in df.select("gameweek").distinct().orderBy("gameweek").collect()]  # one row a period
    start = min_train if window is None else window
    out = None
    for i in range(start, len(periods)):
        low = periods[0] if window is None else periods[i - window]
        train = df.filter((F.col("gameweek") < periods[i]) & (F.col("gameweek") >= low))
        test = df.filter(F.col("gameweek") == periods[i])
        fold = test.join(predictor(train, test).select("player_id", "predicted"), "player_id", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0.0)))
        if base:
            path = f"{base}/fold-{uuid.uuid4().hex}"
            fold.write.parquet(path)
            fold = spark.read.schema(fold.schema).parquet(path)
        out = fold if out is None else out.unionByName(fold)
    return out if out is not None else df.withColumn("predicted", F.lit(0.0)).limit(0)


def mean_predictor(train: DataFrame, test: DataFrame) -> DataFrame:
    return test.select("player_id").join(F.broadcast(train.agg(F.avg("points").alias("predicted"))))


def last_predictor(train: DataFrame, test: DataFrame) -> DataFrame:
    """Each player's mean over the training rows."""
    return train.groupBy("player_id").agg(F.avg("points").alias("predicted"))


def player_backtest(df: DataFrame, min_train: int = 5, window: int | None = None) -> DataFrame:
    """All folds of last_predictor in one plan: rows of tested periods with the player's mean points of the earlier ones (or of those among the `window` periods before), 0 without any.

    Periods are numbered over all players, so that a window counts those in which a player has no row, too.
    """
    numbers = df.select("gameweek").filter("gameweek IS NOT NULL").distinct().withColumn("_i", F.row_number().over(Window.orderBy("gameweek")))  # one row a period
    per = df.groupBy("player_id", "gameweek").agg(F.sum("points").alias("s"), F.count("points").alias("c")).join(numbers, "gameweek")
    w = Window.partitionBy("player_id").orderBy("_i").rangeBetween(Window.unboundedPreceding if window is None else -window, -1)
    mean = F.when(F.col("player_id").isNotNull(), F.try_divide(F.sum("s").over(w), F.sum("c").over(w)))
    tested = per.withColumn("predicted", F.coalesce(mean, F.lit(0.0))).filter(F.col("_i") > (min_train if window is None else window))
    tested = tested.select(F.col("player_id").alias("_p"), F.col("gameweek").alias("_g"), "predicted")
    return df.join(tested, df["player_id"].eqNullSafe(F.col("_p")) & (df["gameweek"] == F.col("_g"))).drop("_p", "_g")


def _mean_at_once(df: DataFrame, min_train: int, window: int | None) -> DataFrame:
    out = mean_backtest(df.filter("gameweek IS NOT NULL"), min_train, window)
    return out.withColumn("predicted", F.coalesce("predicted", F.lit(0.0)))


#: Predictors whose folds are windows.
AT_ONCE = {mean_predictor: _mean_at_once, last_predictor: player_backtest}


def average_rank(c: str, keys: tuple[str, ...] = ("gameweek",)) -> Column:
    """Rank from the lowest; equal values share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2.0


def _errors(x: Column, y: Column) -> dict[str, Column]:
    return {"rmse": F.sqrt(F.avg((x - y) * (x - y))), "mae": F.avg(F.abs(x - y)), "mean_predicted": F.avg(x), "mean_actual": F.avg(y)}


def period_metrics(df: DataFrame, predicted: str = "predicted", actual: str = "points", keys: tuple[str, ...] = ("gameweek",)) -> DataFrame:
    """rmse, mae, spearman, n and means by period; rows that are not finite are dropped; an undefined correlation is 0."""
    good = df.withColumns({"_p": finite(predicted), "_a": finite(actual)}).dropna(subset=["_p", "_a"])
    ranked = good.withColumn("_rp", average_rank("_p", keys)).withColumn("_ra", average_rank("_a", keys))
    e = _errors(F.col("_p"), F.col("_a"))
    m = ranked.groupBy(*keys).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in e.items()], correlation("_rp", "_ra").alias("spearman"))
    return m.withColumn("spearman", F.coalesce(finite("spearman"), F.lit(0.0)))


def overall_rank(df: DataFrame, c: str, name: str) -> DataFrame:
    """c -> average rank over all rows. Only distinct values are ordered; their counts are summed by value ranges first, so no task orders all rows. The ranges are written once, as both sums must see the same ones."""
    counts = df.groupBy(c).agg(F.count("*").alias("_n"))
    bounds = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = stage_in(df.sparkSession)(counts.repartitionByRange(int(bounds), c).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_part").agg(F.sum("_n").alias("_t"))
    totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_in", inner).join(totals, "_part").select(c, (F.col("_base") + F.col("_in") + (F.col("_n") + 1) / 2.0).alias(name))


def overall_metrics(df: DataFrame, predicted: str = "predicted", actual: str = "points") -> DataFrame:
    """rmse, mae, spearman, r_squared, n over all rows. Ranks come from distinct values and prefix sums, not from one global window."""
    good = df.select(finite(predicted).alias("_p"), finite(actual).alias("_a")).dropna()
    pairs = good.groupBy("_p", "_a").agg(F.count("*").alias("_k"))
    ranked = pairs.join(overall_rank(good, "_p", "_rp"), "_p").join(overall_rank(good, "_a", "_ra"), "_a")
    k, s = F.col("_k"), lambda c: F.sum(c * F.col("_k"))
    x, y = F.col("_rp"), F.col("_ra")
    r = ranked.agg(F.sum(k).alias("n"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy"))
    n = F.col("n")
    top = n * F.col("sxy") - F.col("sx") * F.col("sy")
    bottom = F.sqrt(n * F.col("sxx") - F.col("sx") * F.col("sx")) * F.sqrt(n * F.col("syy") - F.col("sy") * F.col("sy"))
    spearman = r.select(F.when(bottom > 0, top / bottom).otherwise(0.0).alias("spearman"))
    e = _errors(F.col("_p"), F.col("_a"))
    d = F.col("_a") - F.col("_p")
    m = good.agg(F.count("*").alias("n"), *[c.alias(k) for k, c in e.items()], F.sum(d * d).alias("_res"), (F.var_pop("_a") * F.count("*")).alias("_tot"))
    m = m.withColumn("r_squared", F.when(F.col("_tot") > 0, 1 - F.col("_res") / F.col("_tot")).otherwise(0.0)).drop("_res", "_tot")
    return m.join(F.broadcast(spearman))


def diagnostics(df: DataFrame, predicted: str = "predicted", actual: str = "points") -> DataFrame:
    """Bias, bias in percent, ratio of variances and whether it is below one half."""
    good = df.select(finite(predicted).alias("p"), finite(actual).alias("a")).dropna()
    m = good.agg(F.avg("p").alias("mean_predicted"), F.avg("a").alias("mean_actual"), F.var_pop("p").alias("vp"), F.var_pop("a").alias("va"))
    m = m.withColumn("bias", F.col("mean_predicted") - F.col("mean_actual")).withColumn("bias_pct", F.when(F.col("mean_actual") != 0, F.col("bias") / F.col("mean_actual") * 100).otherwise(0.0))
    m = m.withColumn("variance_ratio", F.when(F.col("va") > 0, F.col("vp") / F.col("va")).otherwise(0.0))
    return m.withColumn("low_variance", F.col("variance_ratio") < 0.5).drop("vp", "va")


def stored_performance(predictions: DataFrame, stats: DataFrame, keys: tuple[str, ...] = ("player_id", "gameweek", "season")) -> DataFrame:
    """Stored predictions against what happened, by period: mae, rmse, accuracy (within one point)."""
    df = predictions.join(stats.select(*keys, "total_points"), list(keys))
    d = F.col("xp") - F.col("total_points")
    return df.groupBy("season", "gameweek").agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.when(F.abs(d) <= 1, 1.0).otherwise(0.0)).alias("accuracy"))


def compare_models(df: DataFrame, models: dict[str, Predictor], min_train: int = 5) -> tuple[DataFrame, DataFrame]:
    """Overall metrics of each model, and the one with the lowest error."""
    out, stage = None, stage_in(df.sparkSession)
    for name, predictor in models.items():
        m = overall_metrics(stage(fold_backtest(df, predictor, min_train), "tested")).withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out, out.agg(F.min_by("model", F.struct("rmse", "model")).alias("best_model"), F.min("rmse").alias("rmse"))


def matching_seasons(seasons: DataFrame, wanted: str, c: str = "season") -> DataFrame:
    """The season itself if it is there, else those that hold the wanted text or are held by it."""
    exact = F.max(F.when(F.col(c) == wanted, 1).otherwise(0)).over(Window.partitionBy())
    loose = F.col(c).contains(wanted) | F.lit(wanted).contains(F.col(c))
    return seasons.select(c).distinct().withColumn("_e", exact).filter(F.when(F.col("_e") == 1, F.col(c) == wanted).otherwise(loose)).select(c)


def performance_of(results: DataFrame, season: str, version: str | None = None) -> DataFrame:
    """Stored results of a season by period; values that are not finite become null."""
    df = results.filter(F.col("season") == season)
    if version:
        df = df.filter(F.col("model_version") == version)
    return df.withColumns({c: finite(c) for c in ("rmse", "mae", "spearman") if c in df.columns}).orderBy("gameweek")
