"""Summaries and leak-free window features. All windows share one specification, so Spark plans one exchange and one sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import col, filled, mean_of
from touchline.operators.clean import floor_points

KEYS = ("season", "player_id")
LAGS = (1, 3, 5)
WINDOWS = (3, 5)


def in_order(keys: Sequence[str] = KEYS, order: str = "gameweek"):
    return Window.partitionBy(*keys).orderBy(order)


def before(w, n: int | None = None):
    """The n rows before the current one, or all of them."""
    return w.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def per_90(total: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, total / minutes * 90.0).otherwise(0.0)


# ---------------------------------------------------------------- summaries

def history_summary(stats: DataFrame, keys: Sequence[str] = ("player_id",), recent: int = 5) -> DataFrame:
    """One row per player: totals, per-90 rates, the latest values oldest first, form and expected minutes. The latest rows are found before the aggregate, so no list grows with the history."""
    last = stats.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("gameweek").desc())))
    lately = F.when(F.col("_r") <= recent, F.struct(F.col("gameweek"), F.col("minutes").cast("double").alias("minutes"), filled("xg").alias("xg"), filled("xa").alias("xa"), F.col("total_points").cast("double").alias("points")))
    g = last.groupBy(*keys).agg(
        F.sum("minutes").cast("double").alias("minutes"), *[F.sum(filled(c)).alias(f"total_{c}") for c in ("xg", "xa", "goals", "assists")],
        F.count_if(F.col("minutes") > 0).alias("games_played"), F.array_sort(F.collect_list(lately)).alias("_last"),
    )
    g = g.withColumns({f"{c}_per_90": per_90(F.col(f"total_{c}"), F.col("minutes")) for c in ("xg", "xa", "goals", "assists")})
    g = g.withColumns({f"recent_{c}": F.col(f"_last.{c}") for c in ("minutes", "xg", "xa")}).withColumn("form", F.coalesce(mean_of(F.col("_last.points")), F.lit(0.0)))
    played = F.filter("recent_minutes", lambda m: m > 0)
    return g.withColumn("expected_minutes", F.coalesce(mean_of(played), F.lit(0.0))).drop("_last", "total_goals", "total_assists")


def latest_rows(stats: DataFrame, keys: Sequence[str] = ("player_id",), before_period: int | None = None, order: str = "gameweek") -> DataFrame:
    """The latest row of each player (before a period) with form = points / 10."""
    df = stats if before_period is None else stats.filter(F.col(order) < before_period)
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_row"))
    return last.select(*keys, "_row.*").withColumn("form", F.col("total_points") / 10.0)


def latest_with_history(stats: DataFrame, target: int, recent: int = 5, keys: Sequence[str] = ("player_id",)) -> DataFrame:
    """The newest row before the target period, with up to five values of points, minutes, xg and xa before it, newest first."""
    known = stats.filter(F.col("gameweek") < target).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("gameweek").desc())))
    kept = known.filter(F.col("_r") <= recent)
    lists = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", *[F.col(c).cast("double").alias(c) for c in ("total_points", "minutes", "xg", "xa")]))).alias("_l"))
    lists = lists.select(*keys, F.col("_l.total_points").alias("historical_points"), F.col("_l.minutes").alias("recent_minutes"), F.col("_l.xg").alias("recent_xg"), F.col("_l.xa").alias("recent_xa"))
    return known.filter("_r = 1").drop("_r").join(lists, list(keys))


def category_counts(df: DataFrame, category: str = "category") -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n"))


def score_range(df: DataFrame, score: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, mean, std, min, max, nulls: one aggregate for all columns, then one row for each."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts.append(F.struct(F.lit(c).alias("column"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(x.isNull()).alias("nulls")))
    return df.agg(F.array(*parts).alias("_p")).select(F.inline("_p"))


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c)


def dashboard(board: DataFrame, low_owned: float = 15.0, least: float = 3.0) -> DataFrame:
    """Mean expected points, the top player, and the best low-owned one by points per owned percent."""
    value = F.when((F.col("ownership") < low_owned) & (F.col("xp") > least), F.col("xp") / F.greatest(F.col("ownership"), F.lit(0.1)))
    pick = lambda by: F.max_by("player_id", F.struct(by, -F.col("player_id")))
    return board.agg(F.avg("xp").alias("mean_xp"), pick(F.col("xp")).alias("top_player"), F.max("xp").alias("top_xp"), F.max_by("player_id", F.when(value.isNotNull(), F.struct(value, -F.col("player_id")))).alias("best_low_owned"))


def team_stats(stats: DataFrame, players: DataFrame) -> DataFrame:
    """Team and period: what the players' rows add up to; goals conceded and clean sheets hold for the team, so they are not summed."""
    df = stats.join(players.select("player_id", "team_id"), "player_id")
    return df.groupBy("team_id", "season", "gameweek").agg(F.sum("xg").alias("xgs"), F.max("xgc").alias("xgc"), F.sum("goals").alias("goals_scored"), F.max("goals_conceded").alias("goals_conceded"), F.max("clean_sheets").alias("clean_sheets"))


def goal_averages(fixtures: DataFrame) -> DataFrame:
    """Team: mean goals for and against at home and away; attack and defence against 1.5 goals a match."""
    sides = fixtures.select(F.explode(F.array(
        F.struct(F.col("team_h").alias("team"), F.lit(True).alias("home"), F.col("goals_h").alias("gf"), F.col("goals_a").alias("ga")),
        F.struct(F.col("team_a").alias("team"), F.lit(False).alias("home"), F.col("goals_a").alias("gf"), F.col("goals_h").alias("ga")),
    )).alias("s")).select("s.*")
    side = lambda c, home: F.avg(F.when(F.col("home") == home, F.col(c)))
    g = sides.groupBy("team").agg(side("gf", True).alias("home_for"), side("ga", True).alias("home_against"), side("gf", False).alias("away_for"), side("ga", False).alias("away_against"))
    mean = lambda a, b: (F.coalesce(F.col(a), F.lit(1.5)) + F.coalesce(F.col(b), F.lit(1.5))) / 2
    return g.withColumn("attack_strength", mean("home_for", "away_for") - 1.5).withColumn("defense_strength", 1.5 - mean("home_against", "away_against"))


# ---------------------------------------------------------------- windows

def lag_features(df: DataFrame, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS, keys: Sequence[str] = KEYS) -> DataFrame:
    """With lags and rolling means of xg, xa and clean sheets over earlier rows only; 0 where the rows do not reach back so far; cs_rate over earlier rows with minutes."""
    w = in_order(keys)
    out = {}
    for short, c in (("xg", "xg"), ("xa", "xa"), ("cs", "clean_sheets")):
        for n in lags:
            out[f"{short}_lag_{n}"] = F.coalesce(F.lag(F.col(c).cast("double"), n).over(w), F.lit(0.0))
        for n in windows:
            held = F.count(F.lit(1)).over(before(w, n)) >= n
            out[f"{short}_rolling_{n}"] = F.when(held, F.coalesce(F.avg(F.col(c).cast("double")).over(before(w, n)), F.lit(0.0))).otherwise(0.0)
    played = F.sum(F.when(F.col("minutes") > 0, 1).otherwise(0)).over(before(w))
    clean = F.sum(F.when((F.col("minutes") > 0) & (F.col("clean_sheets") > 0), 1).otherwise(0)).over(before(w))
    out["cs_rate"] = F.when(played > 0, clean / played).otherwise(0.0)
    return df.withColumns(out)


def defcon_to_date(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """With per-90 rates, means per game and floor points of defensive work over earlier rows; 0 without minutes."""
    w = before(in_order(keys))
    total = lambda c: F.coalesce(F.sum(filled(c)).over(w), F.lit(0.0))
    minutes = total("minutes")
    games = F.greatest(F.coalesce(F.sum(F.when(F.col("minutes") > 0, 1).otherwise(0)).over(w), F.lit(0)), F.lit(1))
    out = {}
    for c in ("blocks", "interventions", "passes"):
        out[f"{c}_per_90"] = per_90(total(c), minutes)
        out[f"avg_{c}"] = F.when(minutes > 0, total(c) / games).otherwise(0.0)
    df = df.withColumns(out)
    return df.withColumn("floor_points", floor_points("blocks_per_90", "interventions_per_90", "passes_per_90", "position", F.lit(90.0)))


def cumulative_rates(df: DataFrame, recent: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Earlier rows only: per-90 rates, minutes, the last values (oldest first), expected minutes. Rows without a history are dropped."""
    w = in_order(keys)
    minutes = F.coalesce(F.sum(F.col("minutes").cast("double")).over(before(w)), F.lit(0.0))
    out = {f"{c}_per_90": per_90(F.coalesce(F.sum(filled(c)).over(before(w)), F.lit(0.0)), minutes) for c in ("xg", "xa", "goals", "assists")}
    out |= {f"recent_{c}": F.collect_list(filled(c)).over(before(w, recent)) for c in ("xg", "xa", "minutes")}
    out |= {"history_minutes": minutes, "form": F.coalesce(F.lag(F.col("total_points"), 1).over(w), F.lit(0)) / 10.0}
    df = df.withColumns(out).filter(F.size("recent_xg") > 0)
    return df.withColumn("expected_minutes", F.coalesce(mean_of("recent_minutes"), F.lit(0.0)))


# How far a player's state keeps him out.
INJURY = {"a": 0, "d": 1, "i": 2, "n": 0, "s": 2}


def injury_code(status: str = "status") -> Column:
    s = F.lower(F.coalesce(col(status), F.lit("a")))
    return F.when(s == "d", 1.0).when(s.isin("i", "s"), 2.0).otherwise(0.0)


def start_frame(df: DataFrame, keys: Sequence[str] = KEYS, compat: bool = False) -> DataFrame:
    """Training frame of the start model: eight features and the label minutes > 0. Form is that of the row before; compat takes the row's own."""
    w = in_order(keys)
    played = F.avg(F.when(F.col("minutes") > 0, F.col("minutes"))).over(before(w, 3))
    points = F.col("total_points") if compat else F.coalesce(F.lag("total_points", 1).over(w), F.lit(0))
    return df.withColumns({
        "days_since_last_match": F.coalesce((F.col("gameweek") - F.lag("gameweek", 1).over(w)) * 7.0, F.lit(14.0)),
        "is_cup_week": F.lit(0.0), "injury_status": injury_code(), "recent_minutes_share": F.coalesce(played / 90.0, F.lit(0.5)), "position_depth": F.lit(2.0 / 3.0),
        "form_score": points / 10.0, "price_share": F.coalesce(F.col("price"), F.lit(5.0)) / 100.0, "rotation": F.lit(0.5), "label": F.when(F.col("minutes") > 0, 1.0).otherwise(0.0),
    })


START_FEATURES = ["days_since_last_match", "is_cup_week", "injury_status", "recent_minutes_share", "position_depth", "form_score", "price_share", "rotation"]


def with_mapping_flag(df: DataFrame, mappings: DataFrame, id_col: str = "player_id") -> DataFrame:
    """With has_mapping; rows without one stay."""
    known = mappings.select(F.col(id_col)).distinct().withColumn("has_mapping", F.lit(True))
    return df.join(known, id_col, "left").withColumn("has_mapping", F.coalesce("has_mapping", F.lit(False)))


def minutes_frame(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Component frame for minutes: defensive work to date, lags, price, label."""
    return lag_features(defcon_to_date(df, keys), keys=keys).withColumn("label", F.when(F.col("minutes") > 0, 1.0).otherwise(0.0))


def attack_frame(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Component frame for attack: defensive work, lags, cumulative per-90 rates, labels xg and xa."""
    w = before(in_order(keys))
    minutes = F.coalesce(F.sum("minutes").over(w), F.lit(0))
    rates = {f"{c}_per_90": per_90(F.coalesce(F.sum(filled(c)).over(w), F.lit(0.0)), minutes) for c in ("xg", "xa", "goals", "assists")}
    return lag_features(defcon_to_date(df, keys), keys=keys).withColumns(rates).withColumn("label_xg", filled("xg")).withColumn("label_xa", filled("xa"))


def defense_frame(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Component frame for defence: defensive work, lags, goals conceded per 90, label clean sheet."""
    w = before(in_order(keys))
    minutes = F.coalesce(F.sum("minutes").over(w), F.lit(0))
    rates = {f"{c}_per_90": per_90(F.coalesce(F.sum(filled(c)).over(w), F.lit(0.0)), minutes) for c in ("xgc", "goals_conceded")}
    return lag_features(defcon_to_date(df, keys), keys=keys).withColumns(rates).withColumn("label_cs", F.when(F.col("clean_sheets") > 0, 1.0).otherwise(0.0))


def decayed_form(points: str = "total_points", alpha: Column | float = 0.5, k: int = 5, keys: Sequence[str] = KEYS) -> Column:
    """Mean of the last k values, each older one weighing alpha times as much; null without any."""
    w, a = in_order(keys), alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    top = bottom = F.lit(0.0)
    for i in range(1, k + 1):
        x = F.lag(F.col(points).cast("double"), i).over(w)
        weight = F.pow(a, F.lit(i - 1))
        top = top + F.coalesce(x * weight, F.lit(0.0))
        bottom = bottom + F.when(x.isNotNull(), weight).otherwise(0.0)
    plain = F.avg(F.col(points).cast("double")).over(before(w, k))
    return F.when(bottom > 0, top / bottom).otherwise(plain)


def form_of(values: Column | str, alpha: float = 0.5, k: int = 5) -> Column:
    """The same over an array, most recent first; 0 for an empty one."""
    x = F.slice(col(values), 1, k)
    n = F.size(x)
    top = F.aggregate(F.transform(x, lambda p, i: p * F.pow(F.lit(alpha), i)), F.lit(0.0), lambda a, p: a + p)
    bottom = F.aggregate(F.transform(x, lambda p, i: F.pow(F.lit(alpha), i)), F.lit(0.0), lambda a, p: a + p)
    return F.when(n > 0, F.when(bottom > 0, top / bottom).otherwise(mean_of(x))).otherwise(0.0)


def trend(points: str = "total_points", keys: Sequence[str] = KEYS) -> Column:
    """Mean of the last three values less the mean of the three before; 0 with fewer than three, or than six."""
    w, p = in_order(keys), F.col(points).cast("double")
    n = F.count(F.lit(1)).over(before(w))
    return F.when(n >= 6, F.avg(p).over(w.rowsBetween(-3, -1)) - F.avg(p).over(w.rowsBetween(-6, -4))).otherwise(0.0)


def momentum(df: DataFrame, values: str = "historical_points") -> DataFrame:
    """With trend, momentum and forecast of an array of points, most recent first."""
    x = F.col(values)
    n = F.size(x)
    recent = mean_of(F.slice(x, 1, 3))
    previous = F.when(n >= 6, mean_of(F.slice(x, 4, 3))).when(n >= 3, mean_of(F.slice(x, 2, 1000))).otherwise(F.try_element_at(x, F.lit(-1)))
    rise = F.when(n >= 2, recent - previous).otherwise(0.0)
    return df.withColumn("trend", rise).withColumn("momentum", F.col("trend")).withColumn("forecast", F.when(n >= 2, recent + F.col("trend")).otherwise(F.coalesce(F.try_element_at(x, F.lit(1)), F.lit(0.0))))


def declining(df: DataFrame, n: int = 3, drop: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """With declining: expected points more than `drop` below the mean of the n rows before, which must exist."""
    w = in_order(keys)
    return df.withColumn("declining", F.coalesce((F.count(F.lit(1)).over(before(w, n)) >= n) & (F.col("xp") < F.avg("xp").over(before(w, n)) - drop), F.lit(False)))


def running_total(df: DataFrame, value: str, keys: Sequence[str] = ("season",), order: str = "gameweek", name: str = "cumulative") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def dense_ranks(df: DataFrame, keys: Sequence[str] = ("season", "gameweek")) -> DataFrame:
    """With xp_rank and ownership_rank, from the highest, within a period."""
    rank = lambda c: F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col(c).desc()))
    return df.withColumn("xp_rank", rank("xp")).withColumn("ownership_rank", rank("ownership"))


