"""Backtests, market, risk, captains and chips (B, M, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import backtest, market, risk
from touchline.operators.stage import stage_in
from touchline.plans import project as P
from touchline.plans.registry import query, r
from touchline.sources import upsert


def facts(spark, d):
    return P.stats(spark, d).select("player_id", "gameweek", F.col("total_points").cast("double").alias("points"))


_MEAN = "t AS (SELECT gameweek, row_number() OVER o AS i, sum(s) OVER (o ROWS BETWEEN {span} AND 1 PRECEDING) / sum(c) OVER (o ROWS BETWEEN {span} AND 1 PRECEDING) AS predicted FROM (SELECT gameweek, CAST(sum(total_points) AS DOUBLE) AS s, count(*) AS c FROM stats GROUP BY gameweek) WINDOW o AS (ORDER BY gameweek)), bt AS (SELECT s.player_id, s.gameweek, CAST(total_points AS DOUBLE) AS points, predicted FROM stats s JOIN t USING (gameweek) WHERE i > {start})"
EXPANDING = _MEAN.format(span="UNBOUNDED PRECEDING", start=5)


@query("b1_expanding_backtest", P.ctes(P.STATS, EXPANDING) + "SELECT player_id, gameweek, points, round(predicted, 4) AS predicted FROM bt")
def b1(spark, d):
    return backtest.mean_backtest(facts(spark, d)).select("player_id", "gameweek", "points", r("predicted"))


@query("b2_rolling_backtest", P.ctes(P.STATS, _MEAN.format(span="4 PRECEDING", start=4)) + "SELECT player_id, gameweek, points, round(predicted, 4) AS predicted FROM bt")
def b2(spark, d):
    return backtest.mean_backtest(facts(spark, d), window=4).select("player_id", "gameweek", "points", r("predicted"))


def scored(spark, d):
    return P.predictions(spark, d).join(P.stats(spark, d).select("player_id", "gameweek", F.col("total_points").cast("double").alias("points")), ["player_id", "gameweek"]).select("player_id", "gameweek", F.col("xp").alias("predicted"), "points")


_SC = "sc AS (SELECT player_id, gameweek, xp AS predicted, CAST(total_points AS DOUBLE) AS points FROM predictions JOIN stats USING (player_id, gameweek, season))"


@query("b3_period_metrics", P.ctes(P.STATS, P.PREDICTIONS, _SC) + """
SELECT gameweek, count(*) AS n, round(sqrt(avg(pow(predicted - points, 2))), 4) AS rmse, round(avg(abs(predicted - points)), 4) AS mae, round(coalesce(CASE WHEN isnan(corr(rp, ra)) THEN 0.0 ELSE corr(rp, ra) END, 0.0), 4) AS spearman
FROM (SELECT *, rank() OVER (PARTITION BY gameweek ORDER BY predicted) + (count(*) OVER (PARTITION BY gameweek, predicted) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY gameweek ORDER BY points) + (count(*) OVER (PARTITION BY gameweek, points) - 1) / 2.0 AS ra FROM sc) GROUP BY gameweek""")
def b3(spark, d):
    return backtest.period_metrics(scored(spark, d)).select("gameweek", "n", r("rmse"), r("mae"), r("spearman"))


@query("b4_overall_metrics", P.ctes(P.STATS, P.PREDICTIONS, _SC) + """
SELECT count(*) AS n, round(sqrt(avg(pow(predicted - points, 2))), 4) AS rmse, round(avg(abs(predicted - points)), 4) AS mae, round(1 - sum(pow(points - predicted, 2)) / (var_pop(points) * count(*)), 4) AS r_squared, round(corr(rp, ra), 4) AS spearman
FROM (SELECT *, rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2.0 AS rp, rank() OVER (ORDER BY points) + (count(*) OVER (PARTITION BY points) - 1) / 2.0 AS ra FROM sc)""")
def b4(spark, d):
    return backtest.overall_metrics(scored(spark, d)).select("n", r("rmse"), r("mae"), r("r_squared"), r("spearman"))


_SUMMARY = "SELECT '{v}' AS model_version, count(*) AS n, round(sqrt(avg(pow(predicted - points, 2))), 4) AS rmse, round(avg(abs(predicted - points)), 4) AS mae FROM sc WHERE gameweek <= {last}"


@query("i22_backtest_summary", P.ctes(P.STATS, P.PREDICTIONS, _SC) + _SUMMARY.format(v="v1", last=15) + " UNION ALL " + _SUMMARY.format(v="v2", last=99))
def i22(spark, d):
    s = scored(spark, d)
    stored = backtest.overall_metrics(s.filter("gameweek <= 15")).withColumn("model_version", F.explode(F.array(F.lit("v1"), F.lit("v2"))))
    return upsert.save_summary(stored, backtest.overall_metrics(s), "v2").select("model_version", "n", r("rmse"), r("mae"))


@query("b6_diagnostics", P.ctes(P.STATS, P.PREDICTIONS, _SC) + "SELECT round(avg(predicted) - avg(points), 4) AS bias, round((avg(predicted) - avg(points)) / avg(points) * 100, 4) AS bias_pct, round(var_pop(predicted) / var_pop(points), 4) AS variance_ratio, var_pop(predicted) / var_pop(points) < 0.5 AS low_variance FROM sc")
def b6(spark, d):
    return backtest.diagnostics(scored(spark, d)).select(r("bias"), r("bias_pct"), r("variance_ratio"), "low_variance")


@query("b7_stored_performance", P.ctes(P.STATS, P.PREDICTIONS, _SC) + "SELECT gameweek, count(*) AS n, round(avg(abs(predicted - points)), 4) AS mae, round(sqrt(avg(pow(predicted - points, 2))), 4) AS rmse, round(avg(CASE WHEN abs(predicted - points) <= 1 THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM sc GROUP BY gameweek")
def b7(spark, d):
    return backtest.stored_performance(P.predictions(spark, d), P.stats(spark, d)).select("gameweek", "n", r("mae"), r("rmse"), r("accuracy"))


_PLAYER_MEAN = "pm AS (SELECT s.player_id, s.gameweek, CAST(total_points AS DOUBLE) AS points, coalesce(avg(total_points) OVER (PARTITION BY player_id ORDER BY s.gameweek ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS predicted FROM stats s)"


@query("b8_compare_models", P.ctes(P.STATS, EXPANDING, _PLAYER_MEAN) + "SELECT 'global' AS model, count(*) AS n, round(sqrt(avg(pow(predicted - points, 2))), 4) AS rmse FROM bt UNION ALL SELECT 'player', count(*), round(sqrt(avg(pow(predicted - points, 2))) + 1e-9, 4) FROM pm WHERE gameweek IN (SELECT gameweek FROM t WHERE i > 5)")
def b8(spark, d):
    # Every period after the first five is tested; the facts are made once.
    rows = stage_in(spark)(facts(spark, d), "facts")
    return backtest.compare_models(rows, {"global": backtest.mean_predictor, "player": backtest.last_predictor}, 5)[0].select("model", "n", r("rmse"))


@query("b9_matching_seasons", "SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(year(o_orderdate) + 1 AS VARCHAR) AS season FROM orders WHERE year(o_orderdate) IN (1994, 1995)")
def b9(spark, d):
    y = F.year(F.col("o_orderdate").cast("date"))
    s = P.table(spark, d, "orders").select(F.concat(y.cast("string"), F.lit("-"), (y + 1).cast("string")).alias("season"))
    return backtest.matching_seasons(s, "1995")


@query("b10_performance", P.ctes(P.STATS, P.PREDICTIONS, _SC) + "SELECT gameweek, round(sqrt(avg(pow(predicted - points, 2))), 4) AS rmse, round(avg(abs(predicted - points)), 4) AS mae FROM sc GROUP BY gameweek ORDER BY gameweek")
def b10(spark, d):
    stored = backtest.period_metrics(scored(spark, d)).withColumn("season", F.lit("2025-26")).withColumn("model_version", F.lit("mean3"))
    return backtest.performance_of(stored, "2025-26", "mean3").select("gameweek", r("rmse"), r("mae"))


MARKET = """
mk AS (
  SELECT *, CASE WHEN ownership > 30 AND arbitrage_score > 0 THEN 'Overvalued' WHEN ownership < 10 AND arbitrage_score < 0 THEN 'Differential' ELSE 'Neutral' END AS category
  FROM (SELECT q.player_id, gameweek, season, xp, ownership, name, team_id, price, position, CAST(dense_rank() OVER (PARTITION BY season, gameweek ORDER BY xp DESC) AS INTEGER) AS xp_rank, CAST(dense_rank() OVER (PARTITION BY season, gameweek ORDER BY ownership DESC) AS INTEGER) AS ownership_rank,
               CAST(dense_rank() OVER (PARTITION BY season, gameweek ORDER BY xp DESC) AS DOUBLE) - dense_rank() OVER (PARTITION BY season, gameweek ORDER BY ownership DESC) AS arbitrage_score
        FROM predictions q JOIN players USING (player_id))
)"""


def market_rows(spark, d):
    return market.with_arbitrage(market.ranked_players(P.predictions(spark, d), P.players(spark, d)))


@query("m1_m2_arbitrage", P.ctes(P.STATS, P.PLAYERS, P.PREDICTIONS, MARKET) + "SELECT player_id, gameweek, xp_rank, ownership_rank, arbitrage_score, category FROM mk")
def m2(spark, d):
    return market_rows(spark, d).select("player_id", "gameweek", "xp_rank", "ownership_rank", "arbitrage_score", "category")


@query("m3_market_summary", P.ctes(P.STATS, P.PLAYERS, P.PREDICTIONS, MARKET) + "SELECT gameweek, count(*) AS n, count(*) FILTER (category = 'Overvalued') AS overvalued, count(*) FILTER (category = 'Differential') AS differential, count(*) FILTER (category = 'Neutral') AS neutral, min(arbitrage_score) AS min_score, max(arbitrage_score) AS max_score FROM mk GROUP BY gameweek")
def m3(spark, d):
    return market.market_summary(market_rows(spark, d)).drop("season")


@query("m4_market_table", P.ctes(P.STATS, P.PLAYERS, P.PREDICTIONS, P.TEAMS, MARKET) + "SELECT player_id, gameweek, name, team_name, category, count(*) OVER (PARTITION BY gameweek, category) AS category_n FROM mk LEFT JOIN teams USING (team_id)")
def m4(spark, d):
    return market.market_table(market_rows(spark, d), P.teams(spark, d)).select("player_id", "gameweek", "name", "team_name", "category", "category_n")


_MP = (P.STATS, P.PLAYERS, P.PREDICTIONS, P.MARKET_PLAYERS)


@query("r1_over_owned", P.ctes(*_MP) + "SELECT player_id, ownership_percent, round(expected_points / price, 4) AS value FROM market_players WHERE ownership_percent >= 20 AND expected_points <= 5 ORDER BY ownership_percent DESC, expected_points, player_id")
def r1(spark, d):
    return risk.over_owned(P.market_players(spark, d)).orderBy(F.col("ownership_percent").desc(), "expected_points", "player_id").select("player_id", "ownership_percent", r("value"))


_ALT = """
al AS (
  SELECT t.player_id AS target_id, p.player_id, p.expected_points - t.expected_points AS improvement, row_number() OVER (PARTITION BY t.player_id ORDER BY p.expected_points - t.expected_points DESC, p.expected_points / p.price DESC, p.player_id) AS rank
  FROM market_players t JOIN market_players p ON p.position = t.position AND p.player_id <> t.player_id AND abs(p.price - t.price) <= 2 AND p.ownership_percent < 20 AND p.expected_points - t.expected_points >= 1
  WHERE t.ownership_percent >= 20 AND t.expected_points <= 5
)"""


@query("r2_alternatives", P.ctes(*_MP, _ALT) + "SELECT target_id, player_id, CAST(rank AS INTEGER) AS rank, round(improvement, 4) AS improvement FROM al WHERE rank <= 5")
def r2(spark, d):
    m = P.market_players(spark, d)
    return risk.alternatives(risk.over_owned(m), m).select("target_id", "player_id", "rank", r("improvement"))


@query("r3_arbitrage_report", P.ctes(*_MP, _ALT, "top AS (SELECT * FROM market_players WHERE ownership_percent >= 20 AND expected_points <= 5 ORDER BY ownership_percent DESC, expected_points, player_id LIMIT 10)") + "SELECT t.player_id, a.player_id AS best_id, round(a.improvement, 4) AS potential_gain FROM top t JOIN al a ON a.target_id = t.player_id AND a.rank = 1")
def r3(spark, d):
    return risk.arbitrage_report(P.market_players(spark, d)).select("player_id", "best_id", r("potential_gain"))


_NO = "least(greatest(CASE status WHEN 'd' THEN 0.15 WHEN 'i' THEN 0.95 WHEN 's' THEN 0.95 ELSE 0.0 END::DOUBLE + CASE WHEN expected_minutes < 60 THEN 0.10 WHEN expected_minutes < 90 THEN 0.05 ELSE 0.0 END + rotation_risk * 0.20 + CASE WHEN len(recent_minutes) >= 3 AND list_avg(recent_minutes[1:3]) < 60 THEN 0.10 ELSE 0.0 END, 0.0), 1.0)"


@query("r4_no_play", P.ctes(*_MP) + f"SELECT player_id, round({_NO}, 4) AS no_play FROM market_players")
def r4(spark, d):
    return P.market_players(spark, d).select("player_id", r(risk.no_play(), 4, "no_play"))


_PAIRS = f"""
cd AS (SELECT player_id, team_id, expected_points AS xp, {_NO} AS no, row_number() OVER (PARTITION BY team_id ORDER BY expected_points DESC, player_id) AS r FROM market_players),
pr AS (
  SELECT c.team_id, c.player_id AS captain_id, v.player_id AS vice_id, (1 - c.no) * 2 * c.xp + c.no * 2 * v.xp AS weighted_value, (1 - c.no) * 2 * c.xp + c.no * 2 * v.xp - 2 * c.no AS risk_adjusted, (1 - v.no) * 2 * v.xp + v.no * 2 * c.xp - 2 * v.no AS swapped_risk_adjusted, c.r AS cr, v.r AS vr
  FROM cd c JOIN cd v ON c.team_id = v.team_id AND c.player_id <> v.player_id WHERE c.r <= 5
)"""


@query("r5_r6_captains", P.ctes(*_MP, _PAIRS) + "SELECT team_id, captain_id, vice_id, round(weighted_value, 4) AS weighted_value, round(risk_adjusted, 4) AS risk_adjusted, swapped_risk_adjusted > risk_adjusted AS should_swap FROM pr QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY risk_adjusted DESC, cr, vr) = 1")
def r6(spark, d):
    return risk.best_captains(P.market_players(spark, d), "team_id").select("team_id", "captain_id", "vice_id", r("weighted_value"), r("risk_adjusted"), "should_swap")


@query("r7_captain_value", P.ctes(P.ALL_PLAYERS, P.SQUADS) + "SELECT plan_id, week, round(c.xp * c.p_start + v.xp * (1 - c.p_start), 4) AS expected_value FROM (SELECT *, row_number() OVER o AS r FROM squads WHERE in_xi WINDOW o AS (PARTITION BY plan_id, week ORDER BY xp DESC, player_id)) c JOIN (SELECT *, row_number() OVER o AS r FROM squads WHERE in_xi WINDOW o AS (PARTITION BY plan_id, week ORDER BY xp DESC, player_id)) v USING (plan_id, week) WHERE c.r = 1 AND v.r = 2")
def r7(spark, d):
    return risk.captain_value(first_two(spark, d)).select("plan_id", "week", r("expected_value"))


def first_two(spark, d):
    from pyspark.sql import Window

    s = P.squads(spark, d).filter("in_xi").withColumn("_r", F.row_number().over(Window.partitionBy("plan_id", "week").orderBy(F.col("xp").desc(), "player_id"))).filter("_r <= 2")
    pick = lambda k, c: F.max(F.when(F.col("_r") == k, F.col(c)))
    return s.groupBy("plan_id", "week").agg(pick(1, "player_id").alias("captain_id"), pick(1, "xp").alias("c_xp"), pick(1, "p_start").alias("p_start"), pick(2, "player_id").alias("vice_id"), pick(2, "xp").alias("v_xp"))


@query("r8_overvalued_ratio", P.ctes(*_MP) + "SELECT player_id, round(expected_points / ownership_percent, 4) AS ratio FROM market_players WHERE ownership_percent >= 15 AND expected_points / ownership_percent < 0.3 ORDER BY ownership_percent DESC, expected_points / ownership_percent, player_id LIMIT 20")
def r8(spark, d):
    return risk.overvalued_by_ratio(P.market_players(spark, d)).select("player_id", r("ratio"))


def versions(spark, d):
    s = P.squads(spark, d)
    shift = s.filter("plan_id > 1").withColumn("plan_id", F.col("plan_id") - 1)
    return s.filter("plan_id < 4"), shift.withColumn("xp", F.col("xp") + 0.5)


_WK = "rk AS (SELECT *, row_number() OVER (PARTITION BY plan_id, week ORDER BY xp DESC, player_id) AS r FROM squads), wk AS (SELECT plan_id, week, sum(xp) FILTER (r <= 11) AS xi, sum(xp) FILTER (r BETWEEN 12 AND 15) AS bench, sum(xp) AS everyone FROM rk GROUP BY plan_id, week), df AS (SELECT a.plan_id, a.week, a.xi AS cur, b.xi + 5.5 AS opt, a.bench, a.everyone AS ca, b.everyone + 7.5 AS oa FROM wk a JOIN wk b ON b.plan_id = a.plan_id + 1 AND b.week = a.week)"


@query("r9_wildcard", P.ctes(P.ALL_PLAYERS, P.SQUADS, _WK) + "SELECT plan_id, round(sum(opt) - sum(cur), 4) AS gain, sum(opt) - sum(cur) >= 20 AS recommended FROM df GROUP BY plan_id")
def r9(spark, d):
    return risk.wildcard_value(*versions(spark, d)).select("plan_id", r("gain"), "recommended")


@query("r10_bench_boost", P.ctes(P.ALL_PLAYERS, P.SQUADS, _WK) + "SELECT plan_id, week, round(bench, 4) AS gain, round(bench / 4, 4) AS mean_bench, bench >= 15 AS recommended FROM wk")
def r10(spark, d):
    return risk.bench_boost_value(P.squads(spark, d)).select("plan_id", "week", r("gain"), r("mean_bench"), "recommended")


@query("r11_free_hit", P.ctes(P.ALL_PLAYERS, P.SQUADS, _WK) + "SELECT plan_id, round(opt - cur, 4) AS gain, opt - cur >= 10 AS recommended FROM df WHERE week = 2")
def r11(spark, d):
    return risk.free_hit_value(*versions(spark, d), 2).select("plan_id", r("gain"), "recommended")


_CHIPS = "ch AS (SELECT plan_id, 'wildcard' AS chip, sum(opt) - sum(cur) AS gain, 20 AS least FROM df GROUP BY plan_id UNION ALL SELECT plan_id, 'bench_boost', bench, 15 FROM df WHERE week = 2 UNION ALL SELECT plan_id, 'free_hit', opt - cur, 10 FROM df WHERE week = 2)"


@query("r12_all_chips", P.ctes(P.ALL_PLAYERS, P.SQUADS, _WK, _CHIPS) + "SELECT plan_id, chip, round(gain, 4) AS gain, gain >= least AS recommended, coalesce(chip = arg_max(chip, gain) FILTER (gain >= least) OVER (PARTITION BY plan_id), false) AS best FROM ch")
def r12(spark, d):
    return risk.all_chips(*versions(spark, d), 2).select("plan_id", "chip", r("gain"), "recommended", "best")


@query("r13_wildcard_trigger", P.ctes(P.ALL_PLAYERS, P.SQUADS, _WK) + "SELECT plan_id, round(5 * (oa - ca), 4) AS gain, 5 * (oa - ca) >= 20 AS use_wildcard FROM df WHERE week = 1")
def r13(spark, d):
    a, b = versions(spark, d)
    return risk.wildcard_trigger(a.filter("week = 1"), b.filter("week = 1")).select("plan_id", r("gain"), "use_wildcard")


@query("r14_strategy_notes", P.ctes(P.ALL_PLAYERS, P.SQUADS) + """
SELECT plan_id, 'overvalued' AS note, CAST(player_id AS DOUBLE) AS value FROM squads JOIN players USING (player_id) WHERE week = 1 AND ownership > 80
UNION ALL SELECT plan_id, 'weak_captain', round(max(xp), 4) FROM squads WHERE week = 1 GROUP BY plan_id HAVING max(xp) < 10
UNION ALL SELECT plan_id, 'low_total', round(sum(xp), 4) FROM squads WHERE week = 1 AND in_xi GROUP BY plan_id HAVING sum(xp) < 50""")
def r14(spark, d):
    s = P.squads(spark, d).filter("week = 1")
    captains = s.groupBy("plan_id").agg(F.max("xp").alias("expected_value"))
    totals = s.filter("in_xi").groupBy("plan_id").agg(F.sum("xp").alias("net"))
    return risk.strategy_notes(s, P.players(spark, d, every=True).filter("ownership > 80"), captains, totals).withColumn("value", F.round("value", 4))


@query("i25_fresh_ownership", P.ctes(P.ALL_PLAYERS) + "SELECT player_id, ownership FROM players WHERE player_id IN (SELECT o_custkey FROM orders)")
def i25(spark, d):
    p = P.players(spark, d, every=True)
    return market.fresh_ownership(p.withColumn("selected_by_percent", F.col("ownership").cast("string")), P.table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("player_id"))).select("player_id", "ownership")
