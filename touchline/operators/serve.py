"""Boards, sorting, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.columns import by_position
from touchline.operators.features import latest_rows
from touchline.operators.squad import formation, greedy_squads, starting_xi


def player_board(players: DataFrame, teams: DataFrame, predictions: DataFrame, stats: DataFrame | None, gameweek: int, limit: int | None = 500) -> DataFrame:
    """Players with team, predictions of the period, latest form and ownership; fallbacks by position where no prediction is stored."""
    p = predictions.filter(F.col("gameweek") == gameweek)
    known = [c for c in ("xp", "xg", "xa", "xmins", "xcs", "defcon_score") if c in p.columns]
    df = players.join(teams.select("team_id", "team_name"), "team_id", "left").join(p.select("player_id", *known, F.lit(True).alias("_stored")), "player_id", "left")
    if stats is not None:
        df = df.join(latest_rows(stats).select("player_id", "form"), "player_id", "left")
    form = F.col("form") if stats is not None else F.lit(None).cast("double")
    stored = F.coalesce(F.col("_stored"), F.lit(False))
    part = lambda c, missing: F.when(stored, F.coalesce(F.col(c), F.lit(0.0)) if c in known else F.lit(0.0)).otherwise(missing)
    out = df.select(
        "player_id", F.coalesce("name", F.lit("Unknown Player")).alias("name"), F.coalesce("position", F.lit("MID")).alias("position"), F.coalesce("team_name", F.lit("Unknown")).alias("team"), "team_id",
        F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"), F.round(part("xp", by_position("position", 1.5, 1.5, 2.0, 2.5, 1.5)), 2).alias("expected_points"),
        F.round(F.coalesce(F.col("ownership").cast("double"), F.lit(0.0)), 1).alias("ownership_percent"), F.round(F.coalesce(form, F.lit(0.0)), 1).alias("form"),
        F.round(part("xg", F.lit(0.0)), 3).alias("xg"), F.round(part("xa", F.lit(0.0)), 3).alias("xa"), F.round(part("xmins", F.lit(45.0)), 1).alias("xmins"), F.round(part("xcs", F.lit(0.0)), 3).alias("xcs"),
    )
    return out if limit is None else out.orderBy("player_id").limit(limit)


def basic_board(players: DataFrame, teams: DataFrame, limit: int | None = 500) -> DataFrame:
    """The board with constants only."""
    empty = players.sparkSession.createDataFrame([], "player_id long, gameweek int, xp double")
    return player_board(players, teams, empty, None, 0, limit)


def dream_team(board: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(eleven, totals) of the greedy squad over a board."""
    df = board.select(F.lit(1).alias("gameweek"), "player_id", "position", F.coalesce("team_id", F.lit(0)).alias("team_id"), "price", F.col("expected_points").alias("xp"))
    squad = greedy_squads(df)
    xi = starting_xi(squad)
    total = formation(xi).join(squad.groupBy("gameweek").agg(F.sum("price").alias("total_cost"), F.count("*").alias("squad_size")), "gameweek")
    return xi, total


def sorted_by(df: DataFrame, column: str, descending: bool = False, tie: str = "player_id") -> DataFrame:
    """Any column, null as 0 or the empty text."""
    text = isinstance(df.schema[column].dataType, T.StringType)
    key = F.coalesce(F.col(column), F.lit("") if text else F.lit(0))
    return df.orderBy(key.desc() if descending else key.asc(), tie)


def page(df: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(order).offset(offset).limit(limit)


def union_of(a: DataFrame, b: DataFrame, distinct: bool = True) -> DataFrame:
    out = a.unionByName(b)
    return out.distinct() if distinct else out


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def only_first(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).exceptAll(b.select(key))
