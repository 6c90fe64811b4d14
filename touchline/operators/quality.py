"""Data quality: uniqueness, domains, references, ranks, market rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.features import declining


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """key, rule for every row and rule whose condition does not hold (null counts as a violation)."""
    flags = F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(c, F.lit(False)).alias("ok")) for k, c in rules.items()])
    return df.select(key, F.explode(flags).alias("f")).filter(~F.col("f.ok")).select(key, "f.rule")


def player_rules() -> dict[str, Column]:
    return {"position": F.col("position").isin("GK", "DEF", "MID", "FWD"), "name": F.col("name").isNotNull(), "ownership": F.col("ownership").between(0, 100)}


def mapping_rules() -> dict[str, Column]:
    return {"confidence": F.col("confidence").between(0, 1), "canonical_name": F.col("canonical_name").isNotNull()}


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is not null and not in the parent."""
    p = parent.select(F.col(parent_key).alias("_k")).distinct()
    return df.filter(F.col(key).isNotNull()).join(p, F.col(key) == F.col("_k"), "left_anti")


def rank_check(df: DataFrame, rank: str, value: str, keys: Sequence[str]) -> DataFrame:
    """Per group: ranks start at 1, have no gaps, and rank 1 holds the highest value."""
    g = df.groupBy(*keys).agg(F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.countDistinct(rank).alias("n"), F.max(value).alias("top"), F.max(F.when(F.col(rank) == 1, F.col(value))).alias("first"))
    return g.select(*keys, ((F.col("lo") == 1) & (F.col("hi") == F.col("n"))).alias("no_gaps"), (F.col("top") == F.col("first")).alias("top_first"))


def market_issues(market: DataFrame, predictions: DataFrame, players: DataFrame, season: str, gameweek: int, owned: float = 30.0, earlier: int = 3) -> DataFrame:
    """severity, issue, player_id for one period: highly owned players without a row or prediction, declining ones not flagged, wrong scores, wrong flags, orphans."""
    m = market.filter((F.col("season") == season) & (F.col("gameweek") == gameweek)).select("player_id", "xp_rank", "ownership_rank", "arbitrage_score", "category")
    own = players.select("player_id", F.col("ownership").cast("double").alias("_own"))
    trend = declining(predictions.filter((F.col("season") == season) & (F.col("gameweek") <= gameweek)), earlier).filter(F.col("gameweek") == gameweek).select("player_id", "declining")
    high = own.filter(F.col("_own") > owned).join(m, "player_id", "left").join(trend, "player_id", "left")
    row, seen = F.col("category").isNotNull(), F.col("declining").isNotNull()
    issue = lambda df, cond, severity, name: df.filter(cond).select(F.lit(severity).alias("severity"), F.lit(name).alias("issue"), "player_id")
    wrong = F.abs(F.col("arbitrage_score") - (F.col("xp_rank") - F.col("ownership_rank"))) > 0.01
    out = issue(high, ~row, "warning", "no_market_row")
    out = out.unionByName(issue(high, row & ~seen, "warning", "no_prediction"))
    out = out.unionByName(issue(high, row & seen & F.col("declining") & (F.col("category") != "Overvalued"), "error", "declining_not_overvalued"))
    out = out.unionByName(issue(high, row & seen & wrong, "error", "score_mismatch"))
    flagged = m.filter("category = 'Overvalued'").join(own, "player_id", "left")
    out = out.unionByName(issue(flagged, F.col("_own").isNull(), "warning", "orphan"))
    return out.unionByName(issue(flagged, (F.col("_own") <= owned) & (F.col("arbitrage_score") <= 0), "warning", "false_overvalued"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issues by kind, and whether the period is valid (no error)."""
    g = issues.groupBy("severity", "issue").agg(F.count("*").alias("n"))
    return g.withColumn("valid", F.max(F.when(F.col("severity") == "error", 1).otherwise(0)).over(Window.partitionBy()) == 0)
