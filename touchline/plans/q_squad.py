"""Squads, serving, sets and quality (S, V, X, DQ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import quality, serve, squad
from touchline.plans import project as P
from touchline.plans.q_market import MARKET, market_rows
from touchline.plans.registry import query, r


def pool(spark, d):
    return P.predictions(spark, d).join(P.players(spark, d), "player_id")


def greedy_sql(rows: str) -> str:
    """gr: the greedy squads of rows (gameweek, player_id, position, team_id, xp). Players in order, one a step: taken if places of the position and of the team are left."""
    return f"""
o AS (SELECT *, row_number() OVER (PARTITION BY gameweek ORDER BY xp DESC, player_id) AS i FROM ({rows})),
gr(gameweek, i, player_id, taken, chosen, teams) AS (
  SELECT DISTINCT gameweek, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]) FROM o
  UNION ALL
  SELECT gameweek, i, player_id, fits, CASE WHEN fits THEN list_append(chosen, position) ELSE chosen END, CASE WHEN fits THEN list_append(teams, team_id) ELSE teams END
  FROM (SELECT o.gameweek, o.i, o.player_id, o.position, o.team_id, gr.chosen, gr.teams,
          len(list_filter(gr.chosen, lambda x: x = o.position)) < CASE o.position WHEN 'GK' THEN 2 WHEN 'FWD' THEN 3 ELSE 5 END AND (o.team_id = 0 OR len(list_filter(gr.teams, lambda x: x = o.team_id)) < 3) AS fits
        FROM gr JOIN o ON o.gameweek = gr.gameweek AND o.i = gr.i + 1 WHERE len(gr.chosen) < 15))"""


def eleven_sql(keys: str, squads: str) -> str:
    """x: the elevens of squads."""
    return f"""
x AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys}, k ORDER BY xp DESC, player_id) AS f, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}) AS sure FROM (
      SELECT *, CASE WHEN p <= CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN 3 WHEN 'MID' THEN 2 ELSE 1 END THEN 0 WHEN p <= CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN 5 WHEN 'MID' THEN 5 ELSE 3 END THEN 1 ELSE 2 END AS k
      FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, position ORDER BY xp DESC, player_id) AS p FROM {squads})))
  WHERE k = 0 OR (k = 1 AND f <= 11 - sure)
)"""


def recursive(*parts: str) -> str:
    return P.ctes(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


_CHOSEN = "chosen AS (SELECT o.* FROM o JOIN gr ON gr.gameweek = o.gameweek AND gr.i = o.i AND gr.taken)"


@query("s1_greedy_squads", recursive(P.STATS, P.PLAYERS, P.PREDICTIONS, greedy_sql("SELECT q.gameweek, q.player_id, position, team_id, price, q.xp FROM predictions q JOIN players USING (player_id)"), _CHOSEN) + "SELECT gameweek, player_id, position, team_id, price, xp FROM chosen")
def s1(spark, d):
    return squad.greedy_squads(pool(spark, d))


_SQ = (P.ALL_PLAYERS, P.SQUADS)
_XI = eleven_sql("plan_id, week", "squads")
KEYS = ("plan_id", "week")


@query("s2_starting_xi", P.ctes(*_SQ, _XI) + "SELECT plan_id, week, player_id FROM x")
def s2(spark, d):
    return squad.starting_xi(P.squads(spark, d), KEYS).select("plan_id", "week", "player_id")


@query("s3_formation", P.ctes(*_SQ, _XI) + "SELECT plan_id, week, count(*) FILTER (position = 'DEF') || '-' || count(*) FILTER (position = 'MID') || '-' || count(*) FILTER (position = 'FWD') AS formation, round(sum(xp), 4) AS total_xp FROM x GROUP BY plan_id, week")
def s3(spark, d):
    return squad.formation(squad.starting_xi(P.squads(spark, d), KEYS), KEYS).select("plan_id", "week", "formation", r("total_xp"))


@query("s4_captains", P.ctes(*_SQ, _XI, "c AS (SELECT *, row_number() OVER w AS rk, first_value(position) OVER w AS cp FROM x WINDOW w AS (PARTITION BY plan_id, week ORDER BY xp * p_start DESC, player_id))") + "SELECT plan_id, week, max(player_id) FILTER (rk = 1) AS captain_id, coalesce(arg_min(player_id, rk) FILTER (rk > 1 AND position <> cp), max(player_id) FILTER (rk = 2)) AS vice_id FROM c GROUP BY plan_id, week")
def s4(spark, d):
    return squad.captains(squad.starting_xi(P.squads(spark, d), KEYS), KEYS).select("plan_id", "week", "captain_id", "vice_id")


_EVAL = """
mv AS (
  SELECT plan_id, week, count(*) AS transfers FROM (
    SELECT a.plan_id, a.week, a.player_id FROM squads a LEFT JOIN squads b ON b.plan_id = a.plan_id AND b.week = a.week - 1 AND b.player_id = a.player_id WHERE b.player_id IS NULL AND a.week > 1
    UNION ALL SELECT a.plan_id, a.week + 1, a.player_id FROM squads a LEFT JOIN squads b ON b.plan_id = a.plan_id AND b.week = a.week + 1 AND b.player_id = a.player_id WHERE b.player_id IS NULL AND a.week < 5)
  GROUP BY plan_id, week
), ev AS (
  SELECT plan_id, week, week_xp, budget, coalesce(transfers, 0) AS transfers, greatest(0, coalesce(transfers, 0) - 1) * CAST(4.0 AS DOUBLE) AS cost
  FROM (SELECT plan_id, week, sum(xp) FILTER (in_xi) AS week_xp, sum(price) AS budget FROM squads GROUP BY plan_id, week) LEFT JOIN mv USING (plan_id, week)
)"""


@query("s5_evaluate_plans", P.ctes(*_SQ, _EVAL) + "SELECT plan_id, week, transfers, cost, round(week_xp, 4) AS week_xp, round(week_xp * pow(0.9, week - 1), 4) AS discounted_xp, round(budget, 4) AS budget_used FROM ev")
def s5(spark, d):
    return squad.evaluate_plans(P.squads(spark, d)).select("plan_id", "week", "transfers", "cost", r("week_xp"), r("discounted_xp"), r("budget_used"))


_VIOL = """
vi AS (
  SELECT plan_id, week, 'budget' AS rule, sum(price) AS value FROM squads GROUP BY plan_id, week HAVING sum(price) > 100
  UNION ALL SELECT plan_id, week, 'team', CAST(count(*) AS DOUBLE) FROM squads GROUP BY plan_id, week, team_id HAVING count(*) > 3
)"""


@query("s6_plan_violations", P.ctes(*_SQ, _VIOL) + "SELECT plan_id, week, rule, round(value, 4) AS value FROM vi")
def s6(spark, d):
    return squad.plan_violations(P.squads(spark, d)).select("plan_id", "week", "rule", r("value"))


@query("s7_score_plans", P.ctes(*_SQ, _EVAL) + "SELECT plan_id, round(sum(week_xp * pow(0.9, week - 1)) - sum(cost), 4) AS score FROM ev GROUP BY plan_id")
def s7(spark, d):
    return squad.score_plans(P.squads(spark, d), budget=200.0).select("plan_id", r("score"))


@query("s8_week_arrays", P.ctes(P.ALL_PLAYERS, P.SQUADS, "w AS (SELECT player_id, week, any_value(xp) AS xp FROM squads GROUP BY player_id, week)") + "SELECT p.player_id, round(coalesce(a.xp, 0), 4) AS week_1, round(coalesce(b.xp, a.xp, 0), 4) AS week_2, round(coalesce(c.xp, a.xp, 0), 4) AS week_3 FROM players p LEFT JOIN w a ON a.player_id = p.player_id AND a.week = 1 LEFT JOIN w b ON b.player_id = p.player_id AND b.week = 2 LEFT JOIN w c ON c.player_id = p.player_id AND c.week = 3")
def s8(spark, d):
    weekly = P.squads(spark, d).groupBy("player_id", "week").agg(F.max("xp").alias("xp"), F.max("p_start").alias("p_start"))
    a = squad.week_arrays(P.players(spark, d, every=True), weekly)
    return a.select("player_id", *[r(F.col("expected_points")[k], 4, f"week_{k + 1}") for k in range(3)])


@query("s9_heatmap", P.ctes(*_SQ, "b AS (SELECT *, CASE WHEN xp / 15 >= 0.8 THEN 5 WHEN xp / 15 >= 0.6 THEN 4 WHEN xp / 15 >= 0.4 THEN 3 WHEN xp / 15 >= 0.2 THEN 2 ELSE 1 END AS band FROM squads)") + "SELECT plan_id, player_id, CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN 2 WHEN 'MID' THEN 3 ELSE 4 END AS position_order, coalesce(max(band) FILTER (week = 1), 0) AS week_1, coalesce(max(band) FILTER (week = 2), 0) AS week_2 FROM b WHERE week <= 2 GROUP BY plan_id, player_id, position")
def s9(spark, d):
    return squad.heatmap(P.squads(spark, d).filter("week <= 2"), [1, 2]).select("plan_id", "player_id", "position_order", "week_1", "week_2")


@query("s10_bench", P.ctes(*_SQ) + "SELECT plan_id, week, player_id FROM squads WHERE NOT in_xi")
def s10(spark, d):
    s = P.squads(spark, d)
    return squad.bench(s, s.filter("in_xi")).select("plan_id", "week", "player_id")


_SWAP = """
sw AS (
  SELECT o.plan_id, o.player_id AS out_id, p.player_id AS in_id, (p.player_id * 13 % 80) / CAST(10.0 AS DOUBLE) - o.xp AS gain
  FROM (SELECT * FROM squads WHERE week = 1) o JOIN players p ON p.position = o.position
  WHERE p.player_id NOT IN (SELECT player_id FROM squads s WHERE s.week = 1 AND s.plan_id = o.plan_id)
    AND (SELECT sum(price) FROM squads s WHERE s.week = 1 AND s.plan_id = o.plan_id) - o.price + p.price <= 130
    AND (SELECT count(*) FROM squads s WHERE s.week = 1 AND s.plan_id = o.plan_id AND s.team_id = p.team_id AND s.player_id <> o.player_id) < 3
)"""


@query("s11_swap_candidates", P.ctes(*_SQ, _SWAP) + "SELECT plan_id, out_id, count(*) AS n, round(max(gain), 4) AS best_gain FROM sw GROUP BY plan_id, out_id")
def s11(spark, d):
    candidates = P.players(spark, d, every=True).withColumn("xp", (F.col("player_id") * 13 % 80) / 10.0)
    got = squad.swap_candidates(P.squads(spark, d).filter("week = 1"), candidates, 130.0)
    return got.groupBy("plan_id", "out_id").agg(F.count("*").alias("n"), r(F.max("gain"), 4, "best_gain"))


@query("s12_shown_captains", P.ctes(*_SQ) + "SELECT plan_id, week, max(player_id) FILTER (k = 1) AS captain_id, max(player_id) FILTER (k = 2) AS vice_id FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, week ORDER BY xp DESC, player_id) AS k FROM squads WHERE in_xi) GROUP BY plan_id, week")
def s12(spark, d):
    return squad.shown_captains(P.squads(spark, d).filter("in_xi"), KEYS)


_PERIODS = "SELECT q.gameweek, q.player_id, position, coalesce(team_id, opponent_team) AS team_id, CASE WHEN price > 100 THEN price / 10 ELSE price END AS price, q.xp, total_points FROM predictions q JOIN stats s ON s.player_id = q.player_id AND s.gameweek = q.gameweek JOIN players p ON p.player_id = q.player_id"


@query("s13_squad_values", recursive(P.STATS, P.PLAYERS, P.PREDICTIONS, greedy_sql(_PERIODS), _CHOSEN, eleven_sql("gameweek", "chosen")) + "SELECT gameweek, points, xi_size, round(price, 4) AS price, squad_size FROM (SELECT gameweek, CAST(sum(total_points) AS BIGINT) AS points, count(*) AS xi_size FROM x GROUP BY gameweek) JOIN (SELECT gameweek, sum(price) AS price, count(*) AS squad_size FROM chosen GROUP BY gameweek) USING (gameweek)")
def s13(spark, d):
    return squad.squad_values(P.stats(spark, d), P.predictions(spark, d), P.players(spark, d)).select("gameweek", "points", "xi_size", r("price"), "squad_size")


@query("s14_plan_records", P.ctes(*_SQ) + """SELECT plan_id, CAST(to_json(list({'week': week, 'squad': squad, 'xi': xi, 'points': points} ORDER BY week)) AS VARCHAR) AS record, round(sum(points), 4) AS total_points, count(*) AS horizon FROM (
SELECT plan_id, week, list(player_id ORDER BY player_id) AS squad, list(player_id ORDER BY player_id) FILTER (in_xi) AS xi, round(sum(xp) FILTER (in_xi), 4) AS points FROM squads GROUP BY plan_id, week) GROUP BY plan_id""")
def s14(spark, d):
    return squad.plan_records(P.squads(spark, d))


_BOARD = """
SELECT p.player_id, name, position, coalesce(team_name, 'Unknown') AS team, round(coalesce(q.xp, CASE position WHEN 'FWD' THEN 2.5 WHEN 'MID' THEN 2.0 ELSE 1.5 END) + 1e-9, 2) AS expected_points, round(ownership, 1) AS ownership_percent, round(coalesce(l.total_points, 0) / CAST(10.0 AS DOUBLE), 1) AS form
FROM players p LEFT JOIN teams USING (team_id) LEFT JOIN (SELECT * FROM predictions WHERE gameweek = 20) q ON q.player_id = p.player_id
LEFT JOIN (SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY gameweek DESC) = 1) l ON l.player_id = p.player_id"""


@query("v1_player_board", P.ctes(P.STATS, P.ALL_PLAYERS, P.PREDICTIONS, P.TEAMS) + _BOARD)
def v1(spark, d):
    predictions = P.predictions(spark, d).withColumn("xp", F.col("xp") + 1e-9)
    b = serve.player_board(P.players(spark, d, every=True), P.teams(spark, d), predictions, P.stats(spark, d), 20, None)
    return b.select("player_id", "name", "position", "team", "expected_points", "ownership_percent", "form")


@query("v2_basic_board", P.ctes(P.ALL_PLAYERS) + "SELECT player_id, CAST(CASE position WHEN 'FWD' THEN 2.5 WHEN 'MID' THEN 2.0 ELSE 1.5 END AS DOUBLE) AS expected_points, CAST(45.0 AS DOUBLE) AS xmins FROM players")
def v2(spark, d):
    return serve.basic_board(P.players(spark, d, every=True), P.teams(spark, d), None).select("player_id", "expected_points", "xmins")


_DREAM = "SELECT 1 AS gameweek, p.player_id, position, coalesce(team_id, 0) AS team_id, price, round(coalesce(q.xp, CASE position WHEN 'FWD' THEN 2.5 WHEN 'MID' THEN 2.0 ELSE 1.5 END) + 1e-9, 2) AS xp FROM players p LEFT JOIN (SELECT * FROM predictions WHERE gameweek = 20) q ON q.player_id = p.player_id"


@query("v3_dream_team", recursive(P.STATS, P.PLAYERS, P.PREDICTIONS, greedy_sql(_DREAM), _CHOSEN, eleven_sql("gameweek", "chosen")) + "SELECT gameweek, formation, round(total_xp, 4) AS total_xp, players, round(total_cost, 4) AS total_cost, squad_size FROM (SELECT gameweek, count(*) FILTER (position = 'DEF') || '-' || count(*) FILTER (position = 'MID') || '-' || count(*) FILTER (position = 'FWD') AS formation, sum(xp) AS total_xp, count(*) AS players FROM x GROUP BY gameweek) JOIN (SELECT gameweek, sum(price) AS total_cost, count(*) AS squad_size FROM chosen GROUP BY gameweek) USING (gameweek)")
def v3(spark, d):
    predictions = P.predictions(spark, d).withColumn("xp", F.col("xp") + 1e-9)
    b = serve.player_board(P.players(spark, d), P.teams(spark, d), predictions, P.stats(spark, d), 20, None)
    return serve.dream_team(b)[1].select("gameweek", "formation", r("total_xp"), "players", r("total_cost"), "squad_size")


@query("v4_v5_sorted_page", P.ctes(P.ALL_PLAYERS) + "SELECT player_id, price FROM (SELECT * FROM players ORDER BY price DESC, player_id LIMIT 30) ORDER BY player_id LIMIT 10 OFFSET 5")
def v4(spark, d):
    top = serve.sorted_by(P.players(spark, d, every=True), "price", True).limit(30)
    return serve.page(top, "player_id", 10, 5).select("player_id", "price")


@query("x1_union", P.ctes(P.FIXTURES) + "SELECT team_h AS team FROM fixtures UNION SELECT team_a FROM fixtures")
def x1(spark, d):
    f = P.fixtures(spark, d)
    return serve.union_of(f.select(F.col("team_h").alias("team")), f.select(F.col("team_a").alias("team")))


@query("x2_intersection", P.ctes(*_SQ) + "SELECT player_id FROM squads WHERE plan_id = 1 INTERSECT SELECT player_id FROM squads WHERE plan_id = 2")
def x2(spark, d):
    s = P.squads(spark, d)
    return serve.in_both(s.filter("plan_id = 1"), s.filter("plan_id = 2"), "player_id")


@query("x3_difference", P.ctes(*_SQ) + "SELECT player_id FROM squads WHERE plan_id = 1 AND week = 1 EXCEPT SELECT player_id FROM squads WHERE plan_id = 1 AND week = 1 AND in_xi")
def x3(spark, d):
    s = P.squads(spark, d).filter("plan_id = 1 AND week = 1")
    return serve.only_first(s, s.filter("in_xi"), "player_id")


@query("dq1_duplicates", "SELECT CAST(user_id AS BIGINT) AS player_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS gameweek, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def dq1(spark, d):
    ev = P.table(spark, d, "events").select(F.col("user_id").cast("long").alias("player_id"), (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("gameweek"))
    return quality.duplicates(ev, ["player_id", "gameweek"])


@query("dq2_violations", P.ctes(P.ALL_PLAYERS) + "SELECT player_id, 'ownership' AS rule FROM players WHERE ownership + 5 > 100 UNION ALL SELECT player_id, 'position' FROM players WHERE position = 'GK'")
def dq2(spark, d):
    p = P.players(spark, d, every=True).withColumn("ownership", F.col("ownership") + 5).withColumn("position", F.when(F.col("position") == "GK", "KEEPER").otherwise(F.col("position")))
    return quality.violations(p, quality.player_rules(), "player_id")


@query("dq3_orphans", P.ctes(P.STATS, P.PLAYERS) + "SELECT s.player_id, s.gameweek FROM stats s LEFT JOIN (SELECT * FROM players WHERE position <> 'FWD') p USING (player_id) WHERE p.name IS NULL")
def dq3(spark, d):
    return quality.orphans(P.stats(spark, d), "player_id", P.players(spark, d).filter("position <> 'FWD'").withColumnRenamed("player_id", "pid"), "pid").select("player_id", "gameweek")


@query("dq4_rank_check", P.ctes(P.STATS, P.PLAYERS, P.PREDICTIONS, MARKET) + "SELECT gameweek, min(xp_rank) = 1 AND max(xp_rank) = count(DISTINCT xp_rank) AS no_gaps, max(xp) = max(CASE WHEN xp_rank = 1 THEN xp END) AS top_first FROM mk GROUP BY gameweek")
def dq4(spark, d):
    return quality.rank_check(market_rows(spark, d), "xp_rank", "xp", ["gameweek"])


_ISSUES = P.ctes(P.STATS, P.PLAYERS, P.PREDICTIONS, MARKET, """
tr AS (SELECT player_id, gameweek, coalesce(count(*) OVER b >= 3 AND xp < avg(xp) OVER b - 0.5, false) AS declining FROM predictions WHERE gameweek <= 20 WINDOW b AS (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
m20 AS (SELECT * FROM mk WHERE gameweek = 20),
hi AS (SELECT p.player_id, m.category, m.xp_rank, m.ownership_rank, m.arbitrage_score, t.declining FROM players p LEFT JOIN m20 m USING (player_id) LEFT JOIN (SELECT * FROM tr WHERE gameweek = 20) t USING (player_id) WHERE p.ownership > 30),
fl AS (SELECT m.player_id, m.arbitrage_score, p.ownership AS own FROM m20 m LEFT JOIN players p USING (player_id) WHERE m.category = 'Overvalued'),
issues AS (
SELECT 'warning' AS severity, 'no_market_row' AS issue, player_id FROM hi WHERE category IS NULL
UNION ALL SELECT 'warning', 'no_prediction', player_id FROM hi WHERE category IS NOT NULL AND declining IS NULL
UNION ALL SELECT 'error', 'declining_not_overvalued', player_id FROM hi WHERE category IS NOT NULL AND declining AND category <> 'Overvalued'
UNION ALL SELECT 'error', 'score_mismatch', player_id FROM hi WHERE category IS NOT NULL AND declining IS NOT NULL AND abs(arbitrage_score - (xp_rank - ownership_rank)) > 0.01
UNION ALL SELECT 'warning', 'orphan', player_id FROM fl WHERE own IS NULL
UNION ALL SELECT 'warning', 'false_overvalued', player_id FROM fl WHERE own <= 30 AND arbitrage_score <= 0)""")


@query("dq5_market_issues", _ISSUES + "SELECT * FROM issues")
def dq5(spark, d):
    return quality.market_issues(market_rows(spark, d), P.predictions(spark, d), P.players(spark, d), "2025-26", 20)


@query("dq5_issue_summary", _ISSUES + "SELECT severity, issue, count(*) AS n, max(max(CASE severity WHEN 'error' THEN 1 ELSE 0 END)) OVER () = 0 AS valid FROM issues GROUP BY severity, issue")
def dq5s(spark, d):
    return quality.issue_summary(quality.market_issues(market_rows(spark, d), P.predictions(spark, d), P.players(spark, d), "2025-26", 20))
