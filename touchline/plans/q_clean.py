"""Cleaning queries (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.columns import finite, parsed, parsed_int, parsed_loose, position_of
from touchline.operators import clean
from touchline.plans import project as P
from touchline.plans.registry import query, r

_TEXT = "concat_ws('', o_orderpriority, ' ', cast(cast(floor(o_totalprice) as bigint) as string))"


@query("c1_safe_numbers", "SELECT o_orderkey, CAST(replace(replace(trim(' ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ',000 '), ',', ''), ' ', '') AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM orders")
def c1(spark, d):
    o = P.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit(" "), F.floor("o_totalprice").cast("string"), F.lit(",000 ")).alias("a"), F.col("o_orderpriority").alias("b"))
    return clean.to_numbers(o, ["a", "b"])


@query("c2_type_changes")
def c2(spark, d):
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").cast("string").alias("price"), "o_orderpriority")
    return clean.type_changes(o, clean.to_numbers(o, ["k", "price"]))


@query("c3_loose_numbers", "SELECT p_partkey, coalesce(TRY_CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT), 0) AS digits, CAST(p_size AS DOUBLE) / 10 AS number FROM part")
def c3(spark, d):
    return P.table(spark, d, "part").select("p_partkey", parsed_int("p_brand").alias("digits"), parsed_loose(F.concat(F.lit("GBP "), (F.col("p_size") / 10).cast("string"), F.lit("m"))).alias("number"))


_C5 = """
SELECT player_id, gameweek, CAST(least(greatest(round_even(minutes / CAST(90.0 AS DOUBLE), 0), 0), 2) AS INTEGER) AS matches_played, total_points FROM stats"""


@query("c4_c5_double_periods", P.ctes(P.STATS) + f"SELECT player_id, gameweek, matches_played, round(CASE matches_played WHEN 0 THEN 0.0 WHEN 1 THEN total_points ELSE total_points / CAST(matches_played AS DOUBLE) END, 4) AS normalized_points FROM ({_C5})")
def c5(spark, d):
    return clean.normalise_history(P.stats(spark, d)).select("player_id", "gameweek", "matches_played", r("normalized_points"))


_DEF = """
SELECT s.player_id, s.gameweek, position, minutes,
       greatest(0.0, (CASE WHEN position IN ('DEF', 'MID') THEN blocks * 90.0 / greatest(minutes, 1) ELSE 0.0 END + interventions * 90.0 / greatest(minutes, 1) + passes * 90.0 / greatest(minutes, 1) / 100.0)) AS full_match
FROM stats s JOIN players p USING (player_id)"""


@query("c6_c7_defcon", P.ctes(P.STATS, P.PLAYERS) + f"SELECT player_id, gameweek, round(CAST(full_match * minutes / 90.0 AS DOUBLE), 4) AS floor_points, round(CAST(full_match AS DOUBLE), 4) AS floor_points_90 FROM ({_DEF})")
def c7(spark, d):
    df = P.stats(spark, d).join(P.players(spark, d).select("player_id", "position"), "player_id")
    return clean.defcon_metrics(clean.defcon_rates(df)).select("player_id", "gameweek", r("floor_points"), r("floor_points_90"))


@query("c8_defcon_service", P.ctes(P.STATS, P.PLAYERS) + """
SELECT player_id, sum_minutes AS minutes_played, games_played, round(CAST(greatest(0.0, (CASE WHEN position IN ('DEF', 'MID') THEN b ELSE 0.0 END + i + p / 100.0)) * scale AS DOUBLE), 3) AS defcon_score
FROM (SELECT player_id, position, CAST(sum(minutes) AS BIGINT) AS sum_minutes, count(*) AS games_played, sum(blocks) AS b, sum(goals_conceded) AS i, sum(passes) AS p,
             CAST(90.0 AS DOUBLE) / greatest(sum(minutes) / CAST(count(*) AS DOUBLE), 1.0) / count(*) AS scale
      FROM stats JOIN players USING (player_id) GROUP BY player_id, position)""")
def c8(spark, d):
    df = P.stats(spark, d).groupBy("player_id").agg(F.sum("minutes").alias("minutes_played"), F.count("*").alias("games_played"), F.sum("blocks").alias("blocks"), F.sum("goals_conceded").alias("interceptions"), F.sum("passes").alias("passes"))
    df = df.join(P.players(spark, d).select("player_id", "position"), "player_id").withColumn("minutes", F.lit(90.0))
    return clean.defcon_from_service(df).select("player_id", "minutes_played", "games_played", r("defcon_score", 3))


@query("c9_defcon_model", P.ctes(P.STATS, P.PLAYERS) + """
SELECT player_id, round(CAST(greatest(0.0, (CASE WHEN position IN ('DEF', 'MID') THEN b ELSE 0.0 END + i + p / 100.0) * 60 / 90.0) AS DOUBLE), 4) AS defcon_points
FROM (SELECT player_id, position, avg(blocks) AS b, avg(interventions) AS i, avg(passes) AS p FROM stats JOIN players USING (player_id) GROUP BY player_id, position)""")
def c9(spark, d):
    df = P.stats(spark, d).groupBy("player_id").agg(F.avg("blocks").alias("avg_blocks"), F.avg("interventions").alias("avg_interventions"), F.avg("passes").alias("avg_passes"))
    df = df.join(P.players(spark, d).select("player_id", "position"), "player_id").withColumn("expected_minutes", F.lit(60.0))
    return clean.defcon_for_model(df).select("player_id", r("defcon_points"))


@query("c10_clean_players", P.ctes(P.STATS, P.PLAYERS) + f"""
SELECT count(*) AS total, count(*) FILTER (matches_played > 1) AS double_periods, count(*) FILTER (matches_played = 0) AS blank_periods, count(*) FILTER (full_match > 0) AS with_defcon
FROM ({_DEF}) JOIN ({_C5}) USING (player_id, gameweek)""")
def c10(spark, d):
    df = P.stats(spark, d).withColumn("xg", F.col("xg").cast("string")).join(P.players(spark, d).select("player_id", "position"), "player_id")
    return clean.cleaning_counts(clean.clean_players(df, ["xg"]))


@query("c11_fill_features", P.ctes(P.STATS) + """
SELECT player_id, gameweek, CASE WHEN goals = 0 THEN 3.0 ELSE round(CAST(assists AS DOUBLE) / goals, 4) END AS fdr, CASE WHEN saves = 0 THEN 0.25 ELSE CAST(1.0 AS DOUBLE) / saves END AS clean_sheet_prob FROM stats""")
def c11(spark, d):
    s = P.stats(spark, d)
    df = s.select("player_id", "gameweek", F.round(F.when(F.col("goals") == 0, F.lit(float("nan"))).otherwise(F.col("assists") / F.col("goals")), 4).alias("fdr"), F.when(F.col("saves") > 0, 1.0 / F.col("saves")).alias("clean_sheet_prob"))
    return clean.fill_features(df, columns=["fdr", "clean_sheet_prob"])


@query("c12_availability", P.ctes(P.STATS, P.PLAYERS, P.PREDICTIONS) + """
SELECT player_id, gameweek, CASE WHEN out THEN 0.0 ELSE xp END AS xp, CASE WHEN out THEN 0.0 ELSE xmins END AS xmins
FROM (SELECT q.*, CASE player_id % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE status IN ('d', 'i', 'n', 's', 'u') END AS out FROM predictions q JOIN players USING (player_id))""")
def c12(spark, d):
    chance = F.when(F.col("player_id") % 5 == 0, 25).when(F.col("player_id") % 5 == 1, 75)
    df = P.predictions(spark, d).join(P.players(spark, d).select("player_id", "status"), "player_id").withColumn("chance_of_playing", chance)
    return clean.availability(df).select("player_id", "gameweek", "xp", "xmins")


@query("c13_fixture_difficulty", P.ctes(P.FIXTURES, P.TEAMS) + """
SELECT fixture_id, h.team_name AS team_h_name, a.team_name AS team_a_name,
       CAST(least(greatest(round_even(a.strength_attack_away / CAST(1000.0 AS DOUBLE) * 5, 0), 1), 5) AS INTEGER) AS team_h_difficulty,
       CAST(least(greatest(round_even(h.strength_attack_home / CAST(1000.0 AS DOUBLE) * 5, 0), 1), 5) AS INTEGER) AS team_a_difficulty
FROM fixtures f LEFT JOIN teams h ON h.team_id = f.team_h LEFT JOIN teams a ON a.team_id = f.team_a""")
def c13(spark, d):
    return clean.fixtures_with_difficulty(P.fixtures(spark, d), P.teams(spark, d)).select("fixture_id", "team_h_name", "team_a_name", "team_h_difficulty", "team_a_difficulty")


@query("c14_positions", "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 1 THEN 'GK' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD' WHEN 5 THEN 'GK' ELSE 'MID' END AS position FROM supplier")
def c14(spark, d):
    raw = F.when(F.col("s_suppkey") % 6 == 5, "gkp").otherwise((F.col("s_suppkey") % 6).cast("string"))
    return P.table(spark, d, "supplier").select("s_suppkey", position_of(raw).alias("position"))


@query("c15_search", P.ctes(P.ALL_PLAYERS) + "SELECT player_id, name FROM players WHERE contains(lower(name), '#00000001') AND price <= 9.5 AND position = 'DEF'")
def c15(spark, d):
    return clean.search(P.players(spark, d, every=True), "#00000001", max_price=9.5, position="DEF").select("player_id", "name")


@query("c16_safe_output", P.ctes(P.STATS) + "SELECT player_id, gameweek, CASE WHEN goals > 0 THEN round(CAST(assists AS DOUBLE) / goals, 4) END AS ratio FROM stats")
def c16(spark, d):
    return P.stats(spark, d).select("player_id", "gameweek", finite(F.when(F.col("goals") == 0, F.lit(float("inf"))).otherwise(F.round(F.col("assists") / F.col("goals"), 4))).alias("ratio"))
