"""Summaries and windows (A, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import features
from touchline.plans import project as P
from touchline.plans.registry import query, r


def joined(spark, d):
    return P.stats(spark, d).join(P.players(spark, d).select("player_id", "position", "price", "status", "team_id"), "player_id")


_JOINED = "j AS (SELECT s.*, p.position, p.price, p.status, p.team_id FROM stats s JOIN players p USING (player_id))"
_W = "WINDOW w AS (PARTITION BY season, player_id ORDER BY gameweek), b AS (PARTITION BY season, player_id ORDER BY gameweek ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b3 AS (PARTITION BY season, player_id ORDER BY gameweek ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), b5 AS (PARTITION BY season, player_id ORDER BY gameweek ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b64 AS (PARTITION BY season, player_id ORDER BY gameweek ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING)"


@query("a1_history_summary", P.ctes(P.STATS) + """
SELECT player_id, CAST(sum(minutes) AS DOUBLE) AS minutes, round(sum(xg) / sum(minutes) * 90, 4) AS xg_per_90, round(sum(xa) / sum(minutes) * 90, 4) AS xa_per_90,
       round(CAST(sum(goals) AS DOUBLE) / sum(minutes) * 90, 4) AS goals_per_90, round(CAST(sum(assists) AS DOUBLE) / sum(minutes) * 90, 4) AS assists_per_90, count(*) FILTER (minutes > 0) AS games_played,
       round(avg(total_points) FILTER (r <= 5), 4) AS form, round(avg(minutes) FILTER (r <= 5 AND minutes > 0), 4) AS expected_minutes,
       array_to_string(list(minutes ORDER BY gameweek) FILTER (r <= 5), ',') AS recent_minutes
FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY gameweek DESC) AS r FROM stats) GROUP BY player_id""")
def a1(spark, d):
    h = features.history_summary(P.stats(spark, d))
    return h.select("player_id", "minutes", r("xg_per_90"), r("xa_per_90"), r("goals_per_90"), r("assists_per_90"), "games_played", r("form"), r("expected_minutes"), F.array_join(F.transform("recent_minutes", lambda m: m.cast("long").cast("string")), ",").alias("recent_minutes"))


_A2 = """
SELECT player_id, gameweek, position, m, CASE WHEN m > 0 THEN b / m * 90 ELSE 0.0 END AS blocks_per_90, CASE WHEN m > 0 THEN i / m * 90 ELSE 0.0 END AS interventions_per_90, CASE WHEN m > 0 THEN p / m * 90 ELSE 0.0 END AS passes_per_90,
       CASE WHEN m > 0 THEN b / greatest(g, 1) ELSE 0.0 END AS avg_blocks
FROM (SELECT player_id, gameweek, position, CAST(coalesce(sum(minutes) OVER b, 0) AS DOUBLE) AS m, CAST(coalesce(sum(blocks) OVER b, 0) AS DOUBLE) AS b, CAST(coalesce(sum(interventions) OVER b, 0) AS DOUBLE) AS i,
             CAST(coalesce(sum(passes) OVER b, 0) AS DOUBLE) AS p, coalesce(sum(CASE WHEN minutes > 0 THEN 1 ELSE 0 END) OVER b, 0) AS g FROM j """ + _W + ")"


@query("a2_defcon_to_date", P.ctes(P.STATS, P.PLAYERS, _JOINED) + f"SELECT player_id, gameweek, round(blocks_per_90, 4) AS blocks_per_90, round(interventions_per_90, 4) AS interventions_per_90, round(passes_per_90, 4) AS passes_per_90, round(avg_blocks, 4) AS avg_blocks, round(CASE WHEN position IN ('DEF', 'MID') THEN blocks_per_90 ELSE 0.0 END + interventions_per_90 + passes_per_90 / 100.0, 4) AS floor_points FROM ({_A2})")
def a2(spark, d):
    return features.defcon_to_date(joined(spark, d)).select("player_id", "gameweek", r("blocks_per_90"), r("interventions_per_90"), r("passes_per_90"), r("avg_blocks"), r("floor_points"))


@query("a3_latest_row", P.ctes(P.STATS) + "SELECT player_id, gameweek, total_points, total_points / CAST(10.0 AS DOUBLE) AS form FROM stats QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY gameweek DESC) = 1")
def a3(spark, d):
    return features.latest_rows(P.stats(spark, d)).select("player_id", "gameweek", "total_points", "form")


@query("a4_latest_with_history", P.ctes(P.STATS) + "SELECT player_id, max(gameweek) AS gameweek, array_to_string(list(total_points ORDER BY gameweek DESC), ',') AS historical_points FROM (SELECT * FROM stats WHERE gameweek < 20 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY gameweek DESC) <= 5) GROUP BY player_id")
def a4(spark, d):
    return features.latest_with_history(P.stats(spark, d), 20).select("player_id", "gameweek", F.array_join(F.transform("historical_points", lambda p: p.cast("long").cast("string")), ",").alias("historical_points"))


@query("a5_counts_and_range", P.ctes(P.ALL_PLAYERS) + "SELECT position, count(*) AS n, min(price) AS min_price, max(price) AS max_price FROM players GROUP BY position")
def a5(spark, d):
    p = P.players(spark, d, every=True)
    n = features.category_counts(p, "position")
    return n.join(p.groupBy("position").agg(F.min("price").alias("min_price"), F.max("price").alias("max_price")), "position")


@query("a6_profile", P.ctes(P.STATS) + " UNION ALL ".join(f'SELECT \'{c}\' AS "column", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, count(*) FILTER ({c} IS NULL) AS nulls FROM stats' for c in ("minutes", "xg", "total_points")))
def a6(spark, d):
    return features.profile(P.stats(spark, d), ["minutes", "xg", "total_points"]).select("column", r("mean"), r("std"), "min", "max", "nulls")


@query("a7_distinct_periods", P.ctes(P.STATS) + "SELECT DISTINCT gameweek FROM stats ORDER BY gameweek")
def a7(spark, d):
    return features.distinct_values(P.stats(spark, d), "gameweek")


_BOARD = "b AS (SELECT q.player_id, q.xp, p.ownership FROM predictions q JOIN players p USING (player_id) WHERE q.gameweek = 20)"


@query("a8_dashboard", P.ctes(P.STATS, P.PLAYERS, P.PREDICTIONS, _BOARD) + """
SELECT (SELECT round(avg(xp), 4) FROM b) AS mean_xp, (SELECT player_id FROM b ORDER BY xp DESC, player_id LIMIT 1) AS top_player, (SELECT max(xp) FROM b) AS top_xp,
       (SELECT player_id FROM b WHERE ownership < 15 AND xp > 3 ORDER BY xp / greatest(ownership, CAST(0.1 AS DOUBLE)) DESC, player_id LIMIT 1) AS best_low_owned""")
def a8(spark, d):
    b = P.predictions(spark, d).filter("gameweek = 20").join(P.players(spark, d).select("player_id", "ownership"), "player_id")
    return features.dashboard(b).withColumn("mean_xp", r("mean_xp"))


@query("a9_team_stats", P.ctes(P.STATS, P.PLAYERS) + "SELECT team_id, gameweek, round(sum(xg), 3) AS xgs, max(xgc) AS xgc, CAST(sum(goals) AS BIGINT) AS goals_scored, max(goals_conceded) AS goals_conceded, max(clean_sheets) AS clean_sheets FROM stats JOIN players USING (player_id) GROUP BY team_id, season, gameweek")
def a9(spark, d):
    return features.team_stats(P.stats(spark, d), P.players(spark, d)).select("team_id", "gameweek", r("xgs", 3), "xgc", "goals_scored", "goals_conceded", "clean_sheets")


GOAL_AVERAGES = """
ga AS (
  SELECT team, (coalesce(avg(gf) FILTER (home), 1.5) + coalesce(avg(gf) FILTER (NOT home), 1.5)) / 2 - 1.5 AS attack_strength, 1.5 - (coalesce(avg(ga) FILTER (home), 1.5) + coalesce(avg(ga) FILTER (NOT home), 1.5)) / 2 AS defense_strength
  FROM (SELECT team_h AS team, true AS home, goals_h AS gf, goals_a AS ga FROM fixtures UNION ALL SELECT team_a, false, goals_a, goals_h FROM fixtures) GROUP BY team
)"""


@query("a10_goal_averages", P.ctes(P.FIXTURES, GOAL_AVERAGES) + "SELECT team, round(attack_strength, 4) AS attack_strength, round(defense_strength, 4) AS defense_strength FROM ga")
def a10(spark, d):
    return features.goal_averages(P.fixtures(spark, d)).select("team", r("attack_strength"), r("defense_strength"))


_LAGS = ", ".join(
    [f"coalesce(lag(CAST({c} AS DOUBLE), {n}) OVER w, 0.0) AS {s}_lag_{n}" for s, c in (("xg", "xg"), ("xa", "xa"), ("cs", "clean_sheets")) for n in (1, 3, 5)]
    + [f"round(CASE WHEN count(*) OVER b{n} >= {n} THEN avg({c}) OVER b{n} ELSE 0.0 END, 4) AS {s}_rolling_{n}" for s, c in (("xg", "xg"), ("xa", "xa"), ("cs", "clean_sheets")) for n in (3, 5)]
    + ["round(CASE WHEN coalesce(sum(CASE WHEN minutes > 0 THEN 1 ELSE 0 END) OVER b, 0) > 0 THEN CAST(sum(CASE WHEN minutes > 0 AND clean_sheets > 0 THEN 1 ELSE 0 END) OVER b AS DOUBLE) / sum(CASE WHEN minutes > 0 THEN 1 ELSE 0 END) OVER b ELSE 0.0 END, 4) AS cs_rate"]
)
LAG_COLUMNS = [f"{s}_lag_{n}" for s in ("xg", "xa", "cs") for n in (1, 3, 5)]
ROLL_COLUMNS = [f"{s}_rolling_{n}" for s in ("xg", "xa", "cs") for n in (3, 5)] + ["cs_rate"]


@query("w1_lag_features", P.ctes(P.STATS) + f"SELECT player_id, gameweek, {_LAGS} FROM stats {_W}")
def w1(spark, d):
    return features.lag_features(P.stats(spark, d)).select("player_id", "gameweek", *LAG_COLUMNS, *[r(c) for c in ROLL_COLUMNS])


_RATE = "round(CASE WHEN coalesce(sum(minutes) OVER b, 0) > 0 THEN CAST(sum({c}) OVER b AS DOUBLE) / sum(minutes) OVER b * 90 ELSE 0.0 END, 4) AS {c}_per_90"


@query("w2_cumulative_rates", P.ctes(P.STATS) + "SELECT * FROM (SELECT player_id, gameweek, " + ", ".join(_RATE.format(c=c) for c in ("xg", "xa", "goals", "assists")) + f", round(avg(minutes) OVER b5, 4) AS expected_minutes, CAST(coalesce(sum(minutes) OVER b, 0) AS DOUBLE) AS history_minutes, coalesce(lag(total_points, 1) OVER w, 0) / CAST(10.0 AS DOUBLE) AS form FROM stats {_W}) WHERE expected_minutes IS NOT NULL")
def w2(spark, d):
    return features.cumulative_rates(P.stats(spark, d)).select("player_id", "gameweek", *[r(f"{c}_per_90") for c in ("xg", "xa", "goals", "assists")], r("expected_minutes"), "history_minutes", "form")


_START = "coalesce((gameweek - lag(gameweek, 1) OVER w) * 7.0, 14.0)"


@query("w3_start_frame", P.ctes(P.STATS, P.PLAYERS, _JOINED) + f"SELECT player_id, gameweek, CAST({_START} AS DOUBLE) AS days_since_last_match, CAST(CASE status WHEN 'd' THEN 1 WHEN 'i' THEN 2 WHEN 's' THEN 2 ELSE 0 END AS DOUBLE) AS injury_status, round(coalesce(avg(CASE WHEN minutes > 0 THEN minutes END) OVER b3 / 90.0, 0.5), 4) AS recent_minutes_share, coalesce(lag(total_points, 1) OVER w, 0) / CAST(10.0 AS DOUBLE) AS form_score, round(price / 100, 4) AS price_share, CAST(CASE WHEN minutes > 0 THEN 1 ELSE 0 END AS DOUBLE) AS label FROM j {_W}")
def w3(spark, d):
    return features.start_frame(joined(spark, d)).select("player_id", "gameweek", "days_since_last_match", "injury_status", r("recent_minutes_share"), "form_score", r("price_share"), "label")


def frame_sql(extra: str) -> str:
    return P.ctes(P.STATS, P.PLAYERS, _JOINED) + f"SELECT f.*, round(a.blocks_per_90, 4) AS blocks_per_90, round(a.passes_per_90, 4) AS passes_per_90 FROM (SELECT player_id, gameweek, {_LAGS}, {extra} FROM j {_W}) f JOIN ({_A2}) a USING (player_id, gameweek)"


def framed(df, *extra):
    return df.select("player_id", "gameweek", *LAG_COLUMNS, *[r(c) for c in ROLL_COLUMNS], r("blocks_per_90"), r("passes_per_90"), *extra)


@query("w4_minutes_frame", frame_sql("price, CAST(CASE WHEN minutes > 0 THEN 1 ELSE 0 END AS DOUBLE) AS label"))
def w4(spark, d):
    return framed(features.minutes_frame(joined(spark, d)), "price", "label")


@query("w5_attack_frame", frame_sql(", ".join(_RATE.format(c=c) for c in ("xg", "xa", "goals", "assists")) + ", xg AS label_xg, xa AS label_xa"))
def w5(spark, d):
    return framed(features.attack_frame(joined(spark, d)), *[r(f"{c}_per_90") for c in ("xg", "xa", "goals", "assists")], "label_xg", "label_xa")


@query("w6_defense_frame", frame_sql(", ".join(_RATE.format(c=c) for c in ("xgc", "goals_conceded")) + ", CAST(clean_sheets AS DOUBLE) AS label_cs"))
def w6(spark, d):
    return framed(features.defense_frame(joined(spark, d)), *[r(f"{c}_per_90") for c in ("xgc", "goals_conceded")], "label_cs")


def form_sql(alpha: str, k: int = 5) -> str:
    top = " + ".join(f"coalesce(lag(total_points, {i}) OVER w * pow({alpha}, {i - 1}), 0.0)" for i in range(1, k + 1))
    bottom = " + ".join(f"CASE WHEN lag(total_points, {i}) OVER w IS NOT NULL THEN pow({alpha}, {i - 1}) ELSE 0.0 END" for i in range(1, k + 1))
    return f"CASE WHEN {bottom} > 0 THEN ({top}) / ({bottom}) END"


@query("w7_decayed_form", P.ctes(P.STATS) + f"SELECT player_id, gameweek, round({form_sql('0.6')}, 4) AS form FROM stats {_W}")
def w7(spark, d):
    return P.stats(spark, d).withColumn("form", features.decayed_form(alpha=0.6)).select("player_id", "gameweek", r("form"))


@query("w8_trend", P.ctes(P.STATS) + f"SELECT player_id, gameweek, round(CASE WHEN count(*) OVER b >= 6 THEN avg(total_points) OVER b3 - avg(total_points) OVER b64 ELSE 0.0 END, 4) AS trend FROM stats {_W}")
def w8(spark, d):
    return P.stats(spark, d).withColumn("trend", features.trend()).select("player_id", "gameweek", r("trend"))


@query("w9_momentum", P.ctes(P.STATS) + """
SELECT player_id, round(CASE WHEN n >= 2 THEN recent - previous ELSE 0.0 END, 4) AS trend, round(CASE WHEN n >= 2 THEN 2 * recent - previous ELSE list_extract(x, 1) END, 4) AS forecast
FROM (SELECT player_id, x, len(x) AS n, list_avg(x[1:3]) AS recent, CASE WHEN len(x) >= 6 THEN list_avg(x[4:6]) WHEN len(x) >= 3 THEN list_avg(x[2:]) ELSE x[-1] END AS previous
      FROM (SELECT player_id, list(CAST(total_points AS DOUBLE) ORDER BY gameweek DESC) AS x FROM stats WHERE gameweek < 12 - player_id % 10 GROUP BY player_id))""")
def w9(spark, d):
    s = P.stats(spark, d).filter(F.col("gameweek") < 12 - F.col("player_id") % 10)
    lists = s.groupBy("player_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("gameweek", "total_points")), False), lambda x: x["total_points"].cast("double")).alias("historical_points"))
    return features.momentum(lists).select("player_id", r("trend"), r("forecast"))


@query("w10_dense_ranks", P.ctes(P.STATS, P.PLAYERS, P.PREDICTIONS) + "SELECT player_id, gameweek, CAST(dense_rank() OVER (PARTITION BY season, gameweek ORDER BY xp DESC) AS INTEGER) AS xp_rank, CAST(dense_rank() OVER (PARTITION BY season, gameweek ORDER BY ownership DESC) AS INTEGER) AS ownership_rank FROM predictions JOIN players USING (player_id)")
def w10(spark, d):
    return features.dense_ranks(P.predictions(spark, d).join(P.players(spark, d).select("player_id", "ownership"), "player_id")).select("player_id", "gameweek", "xp_rank", "ownership_rank")


@query("w11_declining", P.ctes(P.STATS, P.PREDICTIONS) + f"SELECT player_id, gameweek, coalesce(count(*) OVER b3 >= 3 AND xp < avg(xp) OVER b3 - 0.5, false) AS declining FROM predictions {_W}")
def w11(spark, d):
    return features.declining(P.predictions(spark, d)).select("player_id", "gameweek", "declining")


@query("w12_running_total", P.ctes(P.STATS) + "SELECT gameweek, CAST(points AS BIGINT) AS points, CAST(sum(points) OVER (ORDER BY gameweek) AS BIGINT) AS cumulative FROM (SELECT gameweek, sum(total_points) AS points FROM stats GROUP BY gameweek)")
def w12(spark, d):
    weekly = P.stats(spark, d).groupBy("season", "gameweek").agg(F.sum("total_points").alias("points"))
    return features.running_total(weekly, "points").select("gameweek", "points", "cumulative")


@query("w13_mapping_flag", P.ctes(P.STATS, P.PLAYERS) + "SELECT player_id, gameweek, coalesce(m.known, false) AS has_mapping FROM stats LEFT JOIN (SELECT player_id, true AS known FROM players WHERE position <> 'GK') m USING (player_id)")
def w13(spark, d):
    return features.with_mapping_flag(P.stats(spark, d), P.players(spark, d).filter("position <> 'GK'")).select("player_id", "gameweek", "has_mapping")
