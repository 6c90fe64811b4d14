"""League tables derived from the given tables, as DataFrames and as SQL for the oracle.

Both forms use integer arithmetic and casts that mean the same in either engine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.plans.registry import BODY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landing(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and all runs in one process (tests), below a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/touchline-landing-{uuid.uuid4().hex}"


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    of = lambda kind: F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0))
    worth = lambda kind: F.round(F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0)) / 100, 4)
    g = ev.groupBy(F.col("user_id").cast("long").alias("player_id"), (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("gameweek")).agg(
        F.count("*").alias("n"),
        of("purchase").alias("goals"), of("click").alias("assists"), of("error").alias("goals_conceded"), of("view").alias("saves"), of("signup").alias("yellow_cards"),
        worth("purchase").alias("xg"), worth("click").alias("xa"), worth("error").alias("xgc"),
        F.round(F.sum("value") / 10, 4).alias("ict_index"), F.floor(F.round(F.sum("value"), 4)).cast("long").alias("passes"),
    )
    clean = F.when(F.col("goals_conceded") == 0, 1).otherwise(0).cast("long")
    return g.select(
        "player_id", "gameweek", F.lit("2025-26").alias("season"), "n",
        F.least(F.lit(180), 30 * F.col("n")).cast("long").alias("minutes"),
        "goals", "assists", "goals_conceded", "saves", "yellow_cards", clean.alias("clean_sheets"),
        (4 * F.col("goals") + 3 * F.col("assists") + clean - F.col("yellow_cards")).alias("total_points"),
        "xg", "xa", "xgc", "ict_index", F.col("saves").alias("blocks"), (F.col("goals_conceded") + F.col("yellow_cards")).alias("interventions"), "passes",
        ((F.col("player_id") + F.col("gameweek")) % 2 == 0).alias("was_home"), ((F.col("player_id") * 7 + F.col("gameweek")) % 25).cast("long").alias("opponent_team"),
    )


STATS = """
stats AS (
  SELECT player_id, gameweek, '2025-26' AS season, n, CAST(least(180, 30 * n) AS BIGINT) AS minutes, goals, assists, goals_conceded, saves, yellow_cards,
         CAST(CASE WHEN goals_conceded = 0 THEN 1 ELSE 0 END AS BIGINT) AS clean_sheets,
         4 * goals + 3 * assists + (CASE WHEN goals_conceded = 0 THEN 1 ELSE 0 END) - yellow_cards AS total_points,
         xg, xa, xgc, ict_index, saves AS blocks, goals_conceded + yellow_cards AS interventions, passes,
         (player_id + gameweek) % 2 = 0 AS was_home, CAST((player_id * 7 + gameweek) % 25 AS BIGINT) AS opponent_team
  FROM (
    SELECT CAST(user_id AS BIGINT) AS player_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS gameweek, count(*) AS n,
           count(*) FILTER (event_type = 'purchase') AS goals, count(*) FILTER (event_type = 'click') AS assists, count(*) FILTER (event_type = 'error') AS goals_conceded,
           count(*) FILTER (event_type = 'view') AS saves, count(*) FILTER (event_type = 'signup') AS yellow_cards,
           round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0) / 100, 4) AS xg, round(coalesce(sum(value) FILTER (event_type = 'click'), 0.0) / 100, 4) AS xa,
           round(coalesce(sum(value) FILTER (event_type = 'error'), 0.0) / 100, 4) AS xgc, round(sum(value) / 10, 4) AS ict_index, CAST(floor(round(sum(value), 4)) AS BIGINT) AS passes
    FROM events GROUP BY 1, 2
  )
)"""


def players(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    if not every:
        users = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")).distinct()
        c = c.join(users, "c_custkey", "left_semi")
    k = F.col("c_custkey").cast("long")
    slot, state = k % 15, k % 20
    return c.select(
        k.alias("player_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("team_id"),
        F.when(slot <= 1, "GK").when(slot <= 6, "DEF").when(slot <= 11, "MID").otherwise("FWD").alias("position"),
        (F.lit(4.0) + ((k * 37) % 90) / 10.0).alias("price"), (((k * 7919) % 1000) / 10.0).alias("ownership"),
        F.when(state == 0, "i").when(state == 1, "d").when(state == 2, "s").otherwise("a").alias("status"),
    )


_PLAYER = """
  SELECT CAST(c_custkey AS BIGINT) AS player_id, c_name AS name, CAST(c_nationkey AS BIGINT) AS team_id,
         CASE WHEN c_custkey % 15 <= 1 THEN 'GK' WHEN c_custkey % 15 <= 6 THEN 'DEF' WHEN c_custkey % 15 <= 11 THEN 'MID' ELSE 'FWD' END AS position,
         CAST(4.0 AS DOUBLE) + ((CAST(c_custkey AS BIGINT) * 37) % 90) / CAST(10.0 AS DOUBLE) AS price, ((CAST(c_custkey AS BIGINT) * 7919) % 1000) / CAST(10.0 AS DOUBLE) AS ownership,
         CASE c_custkey % 20 WHEN 0 THEN 'i' WHEN 1 THEN 'd' WHEN 2 THEN 's' ELSE 'a' END AS status
  FROM customer"""
PLAYERS = f"players AS ({_PLAYER} WHERE c_custkey IN (SELECT user_id FROM events))"
ALL_PLAYERS = f"players AS ({_PLAYER})"


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    s = 1000 + k * 20
    return table(spark, sf_dir, "nation").select(
        k.alias("team_id"), F.col("n_name").alias("team_name"), F.substring("n_name", 1, 3).alias("short_name"), s.alias("strength"),
        (s + 10).alias("strength_attack_home"), (s - 10).alias("strength_attack_away"), (s + 5).alias("strength_defence_home"), (s - 5).alias("strength_defence_away"),
    )


TEAMS = """
teams AS (
  SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS team_name, substr(n_name, 1, 3) AS short_name, CAST(1000 + n_nationkey * 20 AS BIGINT) AS strength,
         CAST(1010 + n_nationkey * 20 AS BIGINT) AS strength_attack_home, CAST(990 + n_nationkey * 20 AS BIGINT) AS strength_attack_away,
         CAST(1005 + n_nationkey * 20 AS BIGINT) AS strength_defence_home, CAST(995 + n_nationkey * 20 AS BIGINT) AS strength_defence_away
  FROM nation
)"""


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k, home = F.col("o_orderkey").cast("long"), F.col("c_nationkey").cast("long")
    away = (home + 1 + k % 24) % 25
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        k.alias("fixture_id"), home.alias("team_h"), away.alias("team_a"), (k % 38 + 1).cast("int").alias("gameweek"),
        F.floor(F.col("o_totalprice") / 120000).cast("long").alias("goals_h"), (k % 4).alias("goals_a"), (F.col("o_orderstatus") != "O").alias("finished"),
        F.col("o_orderdate").cast("date").alias("kickoff_time"), (1 + away % 5).alias("team_h_difficulty"), (1 + home % 5).alias("team_a_difficulty"),
    )


FIXTURES = """
fixtures AS (
  SELECT k AS fixture_id, home AS team_h, away AS team_a, CAST(k % 38 + 1 AS INTEGER) AS gameweek, CAST(floor(o_totalprice / 120000) AS BIGINT) AS goals_h, k % 4 AS goals_a,
         o_orderstatus <> 'O' AS finished, CAST(o_orderdate AS DATE) AS kickoff_time, 1 + away % 5 AS team_h_difficulty, 1 + home % 5 AS team_a_difficulty
  FROM (SELECT *, CAST(o_orderkey AS BIGINT) AS k, CAST(c_nationkey AS BIGINT) AS home, CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS BIGINT) AS away
        FROM orders JOIN customer ON o_custkey = c_custkey)
)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("season", "player_id").orderBy("gameweek").rowsBetween(-3, -1)
    last = lambda c, d: F.round(F.coalesce(F.avg(c).over(w), F.lit(d)), 4)
    return stats(spark, sf_dir).select("player_id", "gameweek", "season", last("total_points", 2.0).alias("xp"), last("xg", 0.0).alias("xg"), last("xa", 0.0).alias("xa"), last("minutes", 45.0).alias("xmins"), F.lit(0.7).alias("confidence"))


PREDICTIONS = """
predictions AS (
  SELECT player_id, gameweek, season, round(coalesce(avg(total_points) OVER w, 2.0), 4) AS xp, round(coalesce(avg(xg) OVER w, 0.0), 4) AS xg,
         round(coalesce(avg(xa) OVER w, 0.0), 4) AS xa, round(coalesce(avg(minutes) OVER w, 45.0), 4) AS xmins, CAST(0.7 AS DOUBLE) AS confidence
  FROM stats WINDOW w AS (PARTITION BY season, player_id ORDER BY gameweek ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
)"""


def names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two lists of the same names, spelt differently: (id, name, team)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("long")
    a = p.select(k.alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), (k % 20).alias("team"))
    flipped = F.concat_ws(" ", "p_brand", "p_name")
    odd = F.when(k % 3 == 0, F.translate(flipped, "eao", "éäô")).when(k % 3 == 1, F.expr("substring(concat_ws(' ', p_brand, p_name), 1, length(concat_ws(' ', p_brand, p_name)) - 1)")).otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    return a, p.select((k + 1_000_000).alias("id"), odd.alias("name"), (k % 20).alias("team"))


NAMES = """
names_a AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_name || ' ' || p_brand AS name, CAST(p_partkey % 20 AS BIGINT) AS team FROM part),
names_b AS (
  SELECT CAST(p_partkey AS BIGINT) + 1000000 AS id, CASE p_partkey % 3 WHEN 0 THEN translate(p_brand || ' ' || p_name, 'eao', 'éäô')
         WHEN 1 THEN substr(p_brand || ' ' || p_name, 1, length(p_brand || ' ' || p_name) - 1) ELSE p_name || ' ' || p_brand END AS name, CAST(p_partkey % 20 AS BIGINT) AS team
  FROM part
)"""


def market_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players with what is known of their latest period."""
    w = Window.partitionBy("player_id").orderBy(F.col("gameweek").desc())
    s = stats(spark, sf_dir).join(predictions(spark, sf_dir).select("player_id", "gameweek", "xp"), ["player_id", "gameweek"])
    s = s.withColumn("r", F.row_number().over(w)).filter("r <= 3")
    last = s.groupBy("player_id").agg(
        F.max(F.when(F.col("r") == 1, F.col("xp"))).alias("expected_points"), F.max(F.when(F.col("r") == 1, F.col("minutes"))).cast("double").alias("expected_minutes"),
        F.transform(F.array_sort(F.collect_list(F.struct("r", "minutes"))), lambda x: x["minutes"].cast("double")).alias("recent_minutes"),
    )
    return players(spark, sf_dir).join(last, "player_id").select("player_id", "name", "position", "price", "team_id", F.col("ownership").alias("ownership_percent"), "expected_points", "status", "expected_minutes", ((F.col("player_id") % 5) / 10.0).alias("rotation_risk"), "recent_minutes")


MARKET_PLAYERS = """
market_players AS (
  SELECT p.player_id, p.name, p.position, p.price, p.team_id, p.ownership AS ownership_percent, l.expected_points, p.status, l.expected_minutes,
         (p.player_id % 5) / CAST(10.0 AS DOUBLE) AS rotation_risk, l.recent_minutes
  FROM players p JOIN (
    SELECT player_id, max(xp) FILTER (r = 1) AS expected_points, CAST(max(minutes) FILTER (r = 1) AS DOUBLE) AS expected_minutes, list(CAST(minutes AS DOUBLE) ORDER BY r) AS recent_minutes
    FROM (SELECT s.player_id, s.minutes, q.xp, row_number() OVER (PARTITION BY s.player_id ORDER BY s.gameweek DESC) AS r FROM stats s JOIN predictions q ON q.player_id = s.player_id AND q.gameweek = s.gameweek)
    WHERE r <= 3 GROUP BY player_id
  ) l USING (player_id)
)"""

QUOTA = {"GK": 2, "DEF": 5, "MID": 5, "FWD": 3}


def squads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan_id, week, player_id, position, price, team_id, in_xi, xp, p_start for plans 1 to 4 and weeks 1 to 5."""
    p = players(spark, sf_dir, every=True)
    grid = p.withColumn("plan_id", F.explode(F.array(*[F.lit(k) for k in range(1, 5)]))).withColumn("week", F.explode(F.array(*[F.lit(k) for k in range(1, 6)])))
    order = (F.col("player_id") * 31 + F.col("week") * F.col("plan_id") * 17) % 997
    w = Window.partitionBy("plan_id", "week", "position").orderBy(order, "player_id")
    quota = F.when(F.col("position") == "GK", 2).when(F.col("position") == "FWD", 3).otherwise(5)
    s = grid.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= quota)
    s = s.withColumn("xp", ((F.col("player_id") * 13 + F.col("week") * 7) % 80) / 10.0).withColumn("p_start", ((F.col("player_id") + F.col("week")) % 10 + 1) / 10.0)
    keep = F.when(F.col("position") == "GK", F.col("r") <= 1).when(F.col("position") == "DEF", F.col("r") <= 4).when(F.col("position") == "MID", F.col("r") <= 4).otherwise(F.col("r") <= 2)
    return s.select("plan_id", "week", "player_id", "position", "price", "team_id", keep.alias("in_xi"), "xp", "p_start")


SQUADS = """
squads AS (
  SELECT plan_id, week, player_id, position, price, team_id, CASE position WHEN 'GK' THEN r <= 1 WHEN 'DEF' THEN r <= 4 WHEN 'MID' THEN r <= 4 ELSE r <= 2 END AS in_xi,
         ((player_id * 13 + week * 7) % 80) / CAST(10.0 AS DOUBLE) AS xp, ((player_id + week) % 10 + 1) / CAST(10.0 AS DOUBLE) AS p_start
  FROM (
    SELECT *, row_number() OVER (PARTITION BY plan_id, week, position ORDER BY (player_id * 31 + week * plan_id * 17) % 997, player_id) AS r
    FROM players, (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS plan_id), (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS week)
  ) WHERE r <= CASE position WHEN 'GK' THEN 2 WHEN 'FWD' THEN 3 ELSE 5 END
)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts) + f"\n{BODY}\n"
