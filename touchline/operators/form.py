"""Search for the decay of form that predicts the next points best."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.features import KEYS

DEFAULT_ALPHA = 0.5
#: Alphas from 0.1 to 1.0.
GRID = tuple(round(0.1 + 0.05 * i, 2) for i in range(19))


def _with_last(stats: DataFrame, points: str, k: int, keys: Sequence[str]) -> DataFrame:
    """Rows with k earlier values at least; _last: those values, most recent first."""
    w = Window.partitionBy(*keys).orderBy("gameweek")
    lags = [F.lag(F.col(points).cast("double"), i).over(w) for i in range(1, k + 1)]
    return stats.withColumn("_last", F.array(*lags)).filter(F.col("_last")[k - 1].isNotNull())


def _form(alpha, k: int):
    top = sum((F.col("_last")[i] * F.pow(alpha, F.lit(i)) for i in range(k)), F.lit(0.0))
    return top / sum((F.pow(alpha, F.lit(i)) for i in range(k)), F.lit(0.0))


def alpha_grid(stats: DataFrame, points: str = "total_points", k: int = 5, grid: Sequence[float] = GRID, keys: Sequence[str] = KEYS) -> DataFrame:
    """alpha, rmse, n: the error of decayed form, scaled by minutes / 90, as a forecast of each row from the k before it. One pass over the rows; the grid is a literal array."""
    rows = _with_last(stats, points, k, keys).select("_last", F.col(points).cast("double").alias("_y"), (F.coalesce(F.col("minutes"), F.lit(90)) / 90.0).alias("_share"))
    rows = rows.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in grid])))
    error = _form(F.col("alpha"), k) * F.col("_share") - F.col("_y")
    return rows.groupBy("alpha").agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count("*").alias("n"))


def best_alpha(stats: DataFrame, points: str = "total_points", k: int = 5, refine: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """optimal_alpha, rmse, n, converged: the grid's best, refined around it by a finer grid; the default without rows that reach k back."""
    grid = alpha_grid(stats, points, k, GRID, keys)
    if refine:
        # The finer grid is a function of the coarse best, so it is joined as one row, not collected.
        best = grid.agg(F.min_by("alpha", F.struct("rmse", "alpha")).alias("_a"))
        rows = _with_last(stats, points, k, keys).select("_last", F.col(points).cast("double").alias("_y"), (F.coalesce(F.col("minutes"), F.lit(90)) / 90.0).alias("_share"))
        fine = best.select(F.explode(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda i: F.round(F.least(F.greatest(F.col("_a") + i * 0.01, F.lit(0.1)), F.lit(1.0)), 2))).alias("alpha")).distinct()
        rows = rows.join(F.broadcast(fine))  # nine rows
        error = _form(F.col("alpha"), k) * F.col("_share") - F.col("_y")
        grid = rows.groupBy("alpha").agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count("*").alias("n"))
    best = grid.agg(F.min_by("alpha", F.struct("rmse", "alpha")).alias("a"), F.min("rmse").alias("rmse"), F.max("n").alias("n"))
    return best.select(F.coalesce("a", F.lit(DEFAULT_ALPHA)).alias("optimal_alpha"), F.coalesce("rmse", F.lit(1e6)).alias("rmse"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("a").isNotNull().alias("converged"))


def against_baseline(grid: DataFrame, baseline: float = DEFAULT_ALPHA) -> DataFrame:
    """The best alpha of a grid against the baseline's row: improvement in percent."""
    g = grid.agg(F.min_by("alpha", F.struct("rmse", "alpha")).alias("alpha"), F.min("rmse").alias("rmse"), F.max(F.when(F.col("alpha") == baseline, F.col("rmse"))).alias("baseline_rmse"))
    return g.withColumn("improvement_pct", F.when(F.col("baseline_rmse") > 0, (F.col("baseline_rmse") - F.col("rmse")) / F.col("baseline_rmse") * 100).otherwise(0.0))


def stored_alpha(table: DataFrame, gameweek: int | None = None) -> DataFrame:
    """The stored alpha of a period, or of the latest."""
    df = table if gameweek is None else table.filter(F.col("gameweek") == gameweek)
    return df.agg(F.max_by("optimal_alpha", "gameweek").alias("optimal_alpha"), F.max("gameweek").alias("gameweek"))
