"""Trained models (P2, P6, P7, P9, P11, P16, B5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import models
from touchline.plans import project as P
from touchline.plans.registry import query, r


def frame(spark, d):
    return models.training_frame(P.stats(spark, d), P.players(spark, d))


def regular(df):
    """The start label of the projection is constant; playing more than an hour stands in for it."""
    return df.withColumn("label", F.when(F.col("minutes") > 60, 1.0).otherwise(0.0))


@query("p2_start_model")
def p2(spark, d):
    f = regular(frame(spark, d)).persist()
    model = models.start_pipeline(10, 3).fit(f.filter("gameweek < 20"))
    return models.predict_start(model, f.filter("gameweek >= 20")).select("player_id", "gameweek", "p_start", "xmins")


@query("p6_attack_models")
def p6(spark, d):
    f = frame(spark, d).persist()
    train = f.filter("gameweek < 20")
    pair = models.attack_pipeline("label_xg", 10, 3).fit(train), models.attack_pipeline("label_xa", 10, 3).fit(train)
    return models.predict_attack(pair, f.filter("gameweek >= 20")).select("player_id", "gameweek", "xg", "xa")


@query("p7_grid_search")
def p7(spark, d):
    return models.boosted_grid(frame(spark, d), models.ATTACK_INPUTS, "label_xg", ("season", "player_id", "gameweek"), (8, 16), (3, 4), (0.05, 0.1), (0.8, 1.0))[1]


@query("p9_clean_sheet_model")
def p9(spark, d):
    f = frame(spark, d).persist()
    model = models.clean_sheet_pipeline(10, 3).fit(f.filter("gameweek < 20"))
    return models.predict_clean_sheet(model, f.filter("gameweek >= 20")).select("player_id", "gameweek", "xcs")


@query("p11_evaluation", P.ctes(P.STATS) + "SELECT count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 4) AS log_loss, round(avg(CASE WHEN (p >= 0.5) = (y > 0) THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round((sum(CASE WHEN y > 0 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 4) AS auc FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM (SELECT CAST(clean_sheets AS DOUBLE) AS y, 1 / (1.0 + exp(xgc - 0.5)) AS p FROM stats))")
def p11(spark, d):
    s = P.stats(spark, d).select(F.col("clean_sheets").cast("double").alias("y"), (1 / (1 + F.exp(F.col("xgc") - 0.5))).alias("p"))
    return models.evaluate_probability(s, "p", "y").select("n", r("log_loss"), r("accuracy"), r("auc"))


@query("p16_b5_full_backtest")
def b5(spark, d):
    return models.full_backtest(P.stats(spark, d), P.players(spark, d))[1]
