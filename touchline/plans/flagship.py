"""The market table in one plan: scan, history, arrays, scoring rules, ranks, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import features, market, scoring
from touchline.plans import project as P
from touchline.plans.q_scoring import SUMMARY, xp_sql
from touchline.plans.registry import query, r

_PRED = xp_sql("SELECT *, xg_per_90 AS xg, xa_per_90 AS xa, CASE WHEN position IN ('GK', 'DEF') THEN 0.25 ELSE 0.0 END AS xcs FROM m")


@query("flagship_market", P.ctes(P.STATS, P.PLAYERS, SUMMARY) + f"""
SELECT player_id, round(xp, 4) AS xp, xp_rank, ownership_rank, category FROM (
  SELECT *, CASE WHEN ownership > 30 AND xp_rank > ownership_rank THEN 'Overvalued' WHEN ownership < 10 AND xp_rank < ownership_rank THEN 'Differential' ELSE 'Neutral' END AS category FROM (
    SELECT player_id, ownership, xp, CAST(dense_rank() OVER (ORDER BY round(xp + 1e-9, 6) DESC) AS INTEGER) AS xp_rank, CAST(dense_rank() OVER (ORDER BY ownership DESC) AS INTEGER) AS ownership_rank FROM ({_PRED})))""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = P.players(spark, sf_dir).select("player_id", "position", "status", "ownership")
    history = features.history_summary(P.stats(spark, sf_dir)).join(players, "player_id")
    scored = scoring.predict(history).withColumn("_exact", F.col("xp")).withColumn("xp", F.round(F.col("xp") + 1e-9, 6)).withColumn("season", F.lit("2025-26")).withColumn("gameweek", F.lit(31))
    ranked = market.with_arbitrage(features.dense_ranks(scored))
    return ranked.select("player_id", r("_exact", 4, "xp"), "xp_rank", "ownership_rank", "category")
