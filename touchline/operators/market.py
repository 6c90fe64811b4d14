"""Market intelligence: ranks, arbitrage, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.features import dense_ranks

OVERVALUED, DIFFERENTIAL = 30.0, 10.0


def ranked_players(predictions: DataFrame, players: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """Predictions with players (both known), ownership from the fresh source, else the table, else 0, and ranks within the period."""
    df = predictions.select("player_id", "gameweek", "season", "xp").join(players.select("player_id", "name", "position", "team_id", "price", F.col("ownership").cast("double").alias("_own")), "player_id")
    if fresh is not None:
        df = df.join(fresh.select("player_id", F.col("ownership").cast("double").alias("_fresh")), "player_id", "left")
    else:
        df = df.withColumn("_fresh", F.lit(None).cast("double"))
    return dense_ranks(df.withColumn("ownership", F.coalesce("_fresh", "_own", F.lit(0.0))).drop("_fresh", "_own"))


def fresh_ownership(bootstrap_players: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """player_id, ownership from the bootstrap's text column, for the ids asked for."""
    df = bootstrap_players.select("player_id", F.col("selected_by_percent").try_cast("double").alias("ownership"))
    return df if ids is None else df.join(ids.select("player_id"), "player_id", "left_semi")


def with_arbitrage(ranked: DataFrame, overvalued: float = OVERVALUED, differential: float = DIFFERENTIAL) -> DataFrame:
    """arbitrage_score = xp_rank - ownership_rank, and the category."""
    df = ranked.withColumn("arbitrage_score", (F.col("xp_rank") - F.col("ownership_rank")).cast("double"))
    s, own = F.col("arbitrage_score"), F.col("ownership")
    return df.withColumn("category", F.when((own > overvalued) & (s > 0), "Overvalued").when((own < differential) & (s < 0), "Differential").otherwise("Neutral"))


def market_summary(market: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("category") == k).alias(k.lower())
    return market.groupBy("season", "gameweek").agg(F.count("*").alias("n"), n("Overvalued"), n("Differential"), n("Neutral"), F.min("arbitrage_score").alias("min_score"), F.max("arbitrage_score").alias("max_score"))


def market_table(market: DataFrame, teams: DataFrame) -> DataFrame:
    """As presented: with the team's name, and how many rows of the period share the category."""
    counts = market.groupBy("season", "gameweek", "category").agg(F.count("*").alias("category_n"))
    return market.join(teams.select("team_id", "team_name"), "team_id", "left").join(counts, ["season", "gameweek", "category"])
