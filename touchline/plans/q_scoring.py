"""Form search, difficulty and expected points (F, D, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import clean, difficulty, features, form, scoring
from touchline.plans import project as P
from touchline.plans.q_features import GOAL_AVERAGES, form_sql, joined
from touchline.plans.registry import query, r

_LAST = "p AS (SELECT player_id, gameweek, total_points AS y, minutes / CAST(90.0 AS DOUBLE) AS share, " + ", ".join(f"CAST(lag(total_points, {i}) OVER w AS DOUBLE) AS l{i}" for i in range(1, 6)) + " FROM stats WINDOW w AS (PARTITION BY season, player_id ORDER BY gameweek))"


def _grid(alphas: str) -> str:
    top, bottom = " + ".join(f"l{i} * pow(a, {i - 1})" for i in range(1, 6)), " + ".join(f"pow(a, {i - 1})" for i in range(1, 6))
    return f"SELECT a AS alpha, sqrt(avg(pow(({top}) / ({bottom}) * share - y, 2))) AS rmse, count(*) AS n FROM p, ({alphas}) WHERE l5 IS NOT NULL GROUP BY a"


_COARSE = "SELECT unnest([" + ", ".join(f"CAST({a} AS DOUBLE)" for a in form.GRID) + "]) AS a"


@query("f1_f2_alpha_grid", P.ctes(P.STATS, _LAST) + f"SELECT alpha, round(rmse, 4) AS rmse, n FROM ({_grid(_COARSE)})")
def f1(spark, d):
    return form.alpha_grid(P.stats(spark, d)).select("alpha", r("rmse"), "n")


@query("f2_best_alpha", P.ctes(P.STATS, _LAST, f"g AS ({_grid(_COARSE)})", "best AS (SELECT alpha AS b FROM g ORDER BY rmse, alpha LIMIT 1)", "fine AS (" + _grid("SELECT DISTINCT round(least(greatest(b + i * 0.01, 0.1), 1.0), 2)::DOUBLE AS a FROM best, (SELECT unnest(range(-4, 5)) AS i)") + ")") + "SELECT alpha AS optimal_alpha, round(rmse, 4) AS rmse, n, true AS converged FROM fine ORDER BY rmse, alpha LIMIT 1")
def f2(spark, d):
    return form.best_alpha(P.stats(spark, d)).select("optimal_alpha", r("rmse"), "n", "converged")


@query("f3_against_baseline", P.ctes(P.STATS, _LAST, f"g AS ({_grid(_COARSE)})") + "SELECT arg_min(alpha, rmse) AS alpha, round(min(rmse), 4) AS rmse, round((max(rmse) FILTER (alpha = 0.5) - min(rmse)) / max(rmse) FILTER (alpha = 0.5) * 100, 4) AS improvement_pct FROM g")
def f3(spark, d):
    return form.against_baseline(form.alpha_grid(P.stats(spark, d))).select("alpha", r("rmse"), r("improvement_pct"))


@query("f4_stored_alpha", P.ctes(P.STATS) + "SELECT (gameweek % 10) / CAST(10.0 AS DOUBLE) AS optimal_alpha, gameweek FROM (SELECT DISTINCT gameweek FROM stats) ORDER BY gameweek DESC LIMIT 1")
def f4(spark, d):
    t = P.stats(spark, d).select("gameweek").distinct().withColumn("optimal_alpha", (F.col("gameweek") % 10) / 10.0)
    return form.stored_alpha(t)


def strengths(spark, d):
    return features.goal_averages(P.fixtures(spark, d)).select("team", "attack_strength", "defense_strength")


def expected(spark, d):
    return difficulty.expected_goals(P.fixtures(spark, d), strengths(spark, d))


_XG = """
x AS (
  SELECT f.*, exp(0.25 + h.attack_strength - a.defense_strength) AS xg_h, exp(a.attack_strength - h.defense_strength) AS xg_a
  FROM fixtures f JOIN ga h ON h.team = f.team_h JOIN ga a ON a.team = f.team_a
)"""
_SIDES = """
s AS (
  SELECT fixture_id, team_h AS team, true AS is_home, xg_h AS xg_for, xg_a AS xg_against, team_h_difficulty AS official, goals_h AS goals_for, goals_a AS goals_against FROM x
  UNION ALL SELECT fixture_id, team_a, false, xg_a, xg_h, team_a_difficulty, goals_a, goals_h FROM x
), sf AS (SELECT *, least(greatest(1 + xg_against / 2, 1.0), 5.0) AS fdr_mean FROM s)"""
_POISSON = lambda v: "[" + ", ".join(f"exp(-{v}) * pow({v}, {k}) / {f}" for k, f in enumerate((1, 1, 2, 6, 24, 120, 720))) + "]"


@query("d0_with_results", P.ctes(P.FIXTURES) + "SELECT count(*) AS n, CAST(sum(goals_h) AS DOUBLE) AS goals_h, CAST(sum(goals_a) AS DOUBLE) AS goals_a FROM fixtures WHERE goals_a < 3")
def d0(spark, d):
    f = P.fixtures(spark, d).withColumn("goals_a", F.when(F.col("goals_a") < 3, F.col("goals_a")))
    return difficulty.with_results(f).agg(F.count("*").alias("n"), F.sum("goals_h").alias("goals_h"), F.sum("goals_a").alias("goals_a"))


@query("d1_fit_strengths")
def d1(spark, d):
    got, home = difficulty.fit_strengths(P.fixtures(spark, d))
    return got.withColumn("home_term", F.lit(home))


@query("d2_d3_expected_goals", P.ctes(P.FIXTURES, GOAL_AVERAGES, _XG) + "SELECT fixture_id, round(xg_h, 4) AS xg_h, round(xg_a, 4) AS xg_a, round(least(greatest(1 + xg_a / 2, 1.0), 5.0), 4) AS fdr_h FROM x")
def d2(spark, d):
    return expected(spark, d).withColumn("fdr_h", difficulty.difficulty_of("xg_a")).select("fixture_id", r("xg_h"), r("xg_a"), r("fdr_h"))


@query("d4_stochastic", P.ctes(P.FIXTURES, GOAL_AVERAGES, _XG, _SIDES) + f"""
SELECT fixture_id, is_home, round(fdr_mean, 4) AS fdr_mean, round(sqrt(xg_against) / 2, 4) AS fdr_std, round(gc[1], 4) AS clean_sheet_prob, round(win / total, 4) AS win_prob, round(draw / total, 4) AS draw_prob, round(1 - (win + draw) / total, 4) AS loss_prob
FROM (SELECT *, list_sum(list_transform(range(1, 8), lambda i: gf[i] * coalesce(list_sum(gc[1:i - 1]), 0.0))) AS win, list_sum(list_transform(range(1, 8), lambda i: gf[i] * gc[i])) AS draw, list_sum(gf) * list_sum(gc) AS total
      FROM (SELECT *, {_POISSON("xg_for")} AS gf, {_POISSON("xg_against")} AS gc FROM sf))""")
def d4(spark, d):
    s = difficulty.stochastic(difficulty.by_side(expected(spark, d), ("fixture_id",)))
    return s.select("fixture_id", "is_home", *[r(c) for c in ("fdr_mean", "fdr_std", "clean_sheet_prob", "win_prob", "draw_prob", "loss_prob")])


@query("d5_compare_official", P.ctes(P.FIXTURES, GOAL_AVERAGES, _XG, _SIDES) + "SELECT count(*) AS n, round(corr(fdr_mean, official), 4) AS correlation, round(avg(abs(fdr_mean - official)), 4) AS mean_absolute_error, round(1 - sum(pow(official - fdr_mean, 2)) / (var_pop(official) * count(*)), 4) AS r_squared FROM sf")
def d5(spark, d):
    s = difficulty.stochastic(difficulty.by_side(expected(spark, d)))
    return difficulty.compare_official(s).select("n", r("correlation"), r("mean_absolute_error"), r("r_squared"))


@query("d6_verify_outcomes", P.ctes(P.FIXTURES, GOAL_AVERAGES, _XG, _SIDES) + "SELECT round(corr(xg_for, goals_for), 4) AS correlation_goals_for, round(corr(xg_against, goals_against), 4) AS correlation_goals_against, round(avg(((abs(xg_for - goals_for) < 0.5)::INT + (abs(xg_against - goals_against) < 0.5)::INT) / 2.0) FILTER (is_home), 4) AS prediction_accuracy FROM sf")
def d6(spark, d):
    return difficulty.verify_outcomes(difficulty.by_side(expected(spark, d))).select(r("correlation_goals_for"), r("correlation_goals_against"), r("prediction_accuracy"))


_NEXT = "nx AS (SELECT team, xg_against, xg_for, is_home, fixture_id FROM sf QUALIFY row_number() OVER (PARTITION BY team ORDER BY fixture_id) = 1)"


def next_fixture(spark, d):
    s = difficulty.stochastic(difficulty.by_side(expected(spark, d), ("fixture_id",)))
    return s.groupBy(F.col("team").cast("long").alias("team_id")).agg(F.min_by(F.struct("fdr_mean", "win_prob", "clean_sheet_prob", "xg_for", "xg_against", "is_home"), "fixture_id").alias("f")).select("team_id", "f.*")


@query("d7_d8_features", P.ctes(P.STATS, P.PLAYERS, "j AS (SELECT s.*, p.position, p.team_id FROM stats s JOIN players p USING (player_id))", P.FIXTURES, GOAL_AVERAGES, _XG, _SIDES, _NEXT) + f"""
SELECT player_id, gameweek, round(coalesce(form, 0.0), 4) AS form, round(trend, 4) AS trend, round(least(greatest(1 + xg_against / 2, 1.0), 5.0), 4) AS fdr_mean, round(exp(-xg_against), 4) AS clean_sheet_prob
FROM (SELECT player_id, gameweek, team_id, {form_sql('0.5')} AS form, CASE WHEN count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 6 THEN avg(total_points) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - avg(total_points) OVER (w ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING) ELSE 0.0 END AS trend
      FROM j WINDOW w AS (PARTITION BY season, player_id ORDER BY gameweek)) LEFT JOIN nx ON nx.team = team_id""")
def d7(spark, d):
    df = joined(spark, d).withColumn("form", features.decayed_form(alpha=0.5)).withColumn("trend", features.trend())
    df = clean.defcon_metrics(clean.defcon_rates(df)).join(next_fixture(spark, d), "team_id", "left")
    df = clean.fill_features(df, columns=["form", "trend", "fdr_mean", "clean_sheet_prob", "floor_points"])
    return df.select("player_id", "gameweek", r("form"), r("trend"), r("fdr_mean"), r("clean_sheet_prob"))


@query("d9_goals_from_clean_sheet", "SELECT s_suppkey, round(least(greatest(-ln((s_suppkey % 99 + 1) / 100.0), 0.0), 5.0), 4) AS goals FROM supplier")
def d9(spark, d):
    return P.table(spark, d, "supplier").select("s_suppkey", r(difficulty.goals_from_clean_sheet((F.col("s_suppkey") % 99 + 1) / 100.0), 4, "goals"))


def summary(spark, d):
    return features.history_summary(P.stats(spark, d)).join(P.players(spark, d).select("player_id", "position", "status", "team_id", "price", "ownership"), "player_id")


SUMMARY = """
h AS (
  SELECT t.*, p.position, p.status, p.team_id, p.price, p.ownership, list_avg(recent[1:3]) AS first3, list_avg(list_filter(recent, lambda m: m > 0)) AS played
  FROM (SELECT player_id, CAST(sum(minutes) AS DOUBLE) AS minutes, sum(xg) / sum(minutes) * 90 AS xg_per_90, sum(xa) / sum(minutes) * 90 AS xa_per_90, avg(total_points) FILTER (r <= 5) AS form, list(CAST(minutes AS DOUBLE) ORDER BY gameweek) FILTER (r <= 5) AS recent
        FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY gameweek DESC) AS r FROM stats) GROUP BY player_id) t JOIN players p USING (player_id)
), m AS (
  SELECT *, coalesce(least(1.0, first3 / 90), 0.7) AS p_start, least(greatest(coalesce(least(1.0, first3 / 90), 0.7) * coalesce(played, 85.0), 0.0), 90.0) AS xmins FROM h
)"""


@query("p1_start_features", P.ctes(P.STATS, P.PLAYERS, SUMMARY) + "SELECT player_id, CAST(date_diff('day', DATE '2024-01-20', DATE '2024-02-01') AS DOUBLE) AS days_since_last_match, CASE status WHEN 'd' THEN 1.0 WHEN 'i' THEN 2.0 WHEN 's' THEN 2.0 ELSE 0.0 END::DOUBLE AS injury_status, round(coalesce(first3, 90) / 90, 4) AS recent_minutes_share, round(form / 10, 4) AS form_score, round(price / 100, 4) AS price_share FROM m")
def p1(spark, d):
    df = summary(spark, d).withColumns({"last_match_date": F.lit("2024-01-20"), "is_cup_week": F.lit(False), "position_depth": F.lit(2.0), "rotation_risk": F.lit(0.5)})
    return scoring.start_features(df, "2024-02-01").select("player_id", "days_since_last_match", "injury_status", r("recent_minutes_share"), r("form_score"), r("price_share"))


@query("p3_p4_p19_minutes", P.ctes(P.STATS, P.PLAYERS, SUMMARY) + "SELECT player_id, round(p_start, 4) AS p_start, round(xmins, 4) AS xmins FROM m")
def p3(spark, d):
    return scoring.predict_minutes(summary(spark, d)).select("player_id", r("p_start"), r("xmins"))


@query("p5_attack_features", P.ctes(P.STATS, P.PLAYERS, SUMMARY) + "SELECT player_id, round(xg_per_90 * 1.2 / 1.5, 4) AS f_norm_xg, CASE position WHEN 'GK' THEN 0.0 WHEN 'DEF' THEN round(1 / 3.0, 4) WHEN 'MID' THEN round(2 / 3.0, 4) ELSE 1.0 END::DOUBLE AS f_position, round(0.8, 4)::DOUBLE AS f_factor FROM m")
def p5(spark, d):
    df = scoring.attack_features(summary(spark, d).withColumn("opponent_xgc", F.lit(1.2)))
    return df.select("player_id", r("f_norm_xg"), F.round("f_position", 4).alias("f_position"), F.round("f_factor", 4).alias("f_factor"))


@query("p8_attack", P.ctes(P.STATS, P.PLAYERS, SUMMARY) + "SELECT player_id, round(xg_per_90 * (1.5 - 0.1 * o) / 1.5 * least(greatest(1 - 0.3 * o, 0.7), 1.4), 4) AS xg, round(xa_per_90 * least(greatest(1 - 0.3 * o, 0.7), 1.4), 4) AS xa FROM (SELECT *, ((team_id % 9) - 4) / CAST(2.0 AS DOUBLE) AS o FROM m)")
def p8(spark, d):
    o = ((F.col("team_id") % 9) - 4) / 2.0
    return scoring.untrained_attack(summary(spark, d), 1.5 - 0.1 * o, o).select("player_id", r("xg"), r("xa"))


@query("p10_clean_sheet", P.ctes(P.FIXTURES, P.TEAMS) + "SELECT fixture_id, round(exp(-least(greatest(1.5 / (h.strength_defence_home / 1000.0) * (a.strength_attack_away / 1000.0) * 0.9, 0.0), 3.0)), 4) AS xcs FROM fixtures f JOIN teams h ON h.team_id = team_h JOIN teams a ON a.team_id = team_a")
def p10(spark, d):
    t = P.teams(spark, d)
    f = P.fixtures(spark, d).join(t.select(F.col("team_id").alias("team_h"), F.col("strength_defence_home").alias("sd")), "team_h").join(t.select(F.col("team_id").alias("team_a"), F.col("strength_attack_away").alias("sa")), "team_a")
    return f.select("fixture_id", r(scoring.clean_sheet_probability(F.col("sd"), F.col("sa"), F.lit(True)), 4, "xcs"))


def xp_sql(source: str, defcon: str = "0.0", ict: str = "0.0", form: str = "form") -> str:
    """player_id and all of source with raw expected points; source has position, xmins, xg, xa, xcs."""
    return f"""
SELECT *, greatest(0.0, CASE WHEN raw < 1 AND f > 0.1 THEN greatest(raw, f) ELSE raw END) AS xp FROM (
  SELECT *, f * ((g + a) * boost + c + dc) + 2 * f + bonus * boost AS raw FROM (
    SELECT *, CASE WHEN (xg > 0.5 OR xa > 0.3 OR ict > 50 OR frm > 5) AND f * (g + a + c + dc) + 2 * f < 5 THEN 1.15 + least(0.15, (xg + xa) * 0.1) ELSE 1.0 END AS boost FROM (
      SELECT *, xmins / 90 AS f, CASE WHEN position IN ('GK', 'DEF') THEN 6 WHEN position = 'MID' THEN 5 ELSE 4 END * xg AS g, 3 * xa AS a, CASE WHEN position IN ('GK', 'DEF') THEN 4 WHEN position = 'MID' THEN 1 ELSE 0 END * xcs AS c,
             {defcon} AS dc, {ict} AS ict, {form} AS frm, least(greatest((CASE WHEN position IN ('GK', 'DEF') THEN 6 WHEN position = 'MID' THEN 5 ELSE 4 END * xg + 3 * xa) * 0.15 + ({ict}) * 0.02, 0.0), 3.0) AS bonus
      FROM ({source}))))"""


_RAW = xp_sql("SELECT s.*, p.position, CAST(s.minutes AS DOUBLE) AS xmins, 0.25 AS xcs, CAST(0.0 AS DOUBLE) AS form FROM stats s JOIN players p USING (player_id)", "0.5", "ict_index", "total_points")


@query("p12_expected_points", P.ctes(P.STATS, P.PLAYERS) + f"SELECT player_id, gameweek, round(xp, 4) AS xp FROM ({_RAW})")
def p12(spark, d):
    df = joined(spark, d).withColumns({"xmins": F.col("minutes").cast("double"), "xcs": F.lit(0.25), "form": F.col("total_points").cast("double"), "defcon_points": F.lit(0.5)})
    return scoring.expected_points(df).select("player_id", "gameweek", r("xp"))


_PRED = xp_sql("SELECT *, xg_per_90 AS xg, xa_per_90 AS xa, CASE WHEN position IN ('GK', 'DEF') THEN 0.25 ELSE 0.0 END AS xcs FROM m")
_CONF = "least(greatest(0.7 + CASE WHEN minutes > 500 THEN 0.1 ELSE 0.0 END + CASE WHEN p_start > 0.8 THEN 0.1 ELSE 0.0 END - CASE WHEN status = 'd' THEN 0.2 WHEN status IN ('i', 's') THEN 0.3 ELSE 0.0 END, 0.0), 1.0)"


@query("p13_p14_predict", P.ctes(P.STATS, P.PLAYERS, SUMMARY) + f"SELECT player_id, round(xp, 4) AS xp, round({_CONF}::DOUBLE, 4) AS confidence FROM ({_PRED})")
def p14(spark, d):
    return scoring.predict(summary(spark, d)).select("player_id", r("xp"), r("confidence"))


_CAL = "(SELECT CAST(total_points AS DOUBLE) AS a, xp AS p FROM stats JOIN predictions USING (player_id, gameweek, season))"


@query("p15_calibration", P.ctes(P.STATS, P.PREDICTIONS, f"v AS (SELECT count(*) AS n, avg(p) AS mp, avg(a) AS ma, var_pop(p) AS vp, covar_pop(p, a) AS cv FROM {_CAL})", "k AS (SELECT *, CASE WHEN vp > 0.1 AND abs(cv / vp) < 5 THEN 0.6 * cv / vp + 0.4 * (CASE WHEN mp > 0 THEN ma / mp ELSE 1.0 END) ELSE CASE WHEN mp > 0 THEN ma / mp ELSE 1.0 END END AS scale FROM v)", 'c AS (SELECT n, scale, least(greatest(ma - scale * mp, -2.0), 2.0) AS "offset" FROM k)')
       + f'SELECT any_value(n) AS n, round(any_value(scale), 4) AS scale, round(any_value("offset"), 4) AS "offset", round(sqrt(avg(pow(a - p, 2))), 4) AS rmse_before, round(sqrt(avg(pow(a - greatest(0.0, p * scale + "offset"), 2))), 4) AS rmse_after FROM {_CAL}, c')
def p15(spark, d):
    df = P.stats(spark, d).join(P.predictions(spark, d).select("player_id", "gameweek", "season", F.col("xp").alias("predicted")), ["player_id", "gameweek", "season"]).withColumn("points", F.col("total_points"))
    return scoring.fit_calibration(df).select("n", r("scale"), r("offset"), r("rmse_before"), r("rmse_after"))


@query("p17_batch_predictions", P.ctes(P.STATS, P.PLAYERS, SUMMARY.replace("FROM stats)", "FROM stats WHERE gameweek < 25)")) + f"SELECT player_id, 25 AS gameweek, round(CASE WHEN status IN ('d', 'i', 's') THEN 0.0 ELSE xp END, 4) AS xp, round(CASE WHEN status IN ('d', 'i', 's') THEN 0.0 ELSE xmins END, 4) AS xmins, round({_CONF}::DOUBLE, 4) AS confidence FROM ({_PRED})")
def p17(spark, d):
    history = features.history_summary(P.stats(spark, d).filter("gameweek < 25")).join(P.players(spark, d).select("player_id", "position", "status"), "player_id")
    df = clean.availability(scoring.predict(history).withColumn("chance_of_playing", F.lit(None).cast("int")))
    return df.select("player_id", F.lit(25).alias("gameweek"), r("xp"), r("xmins"), r("confidence"))


@query("p18_solver_points", P.ctes(P.STATS, P.PLAYERS) + "SELECT player_id, gameweek, round(CASE WHEN position IN ('MID', 'FWD') THEN (CASE position WHEN 'FWD' THEN 5 ELSE 4 END * xg + 3 * xa) * minutes / 90.0 + least(1.0, (xg + xa) / 2) ELSE 4 * 0.25 * minutes / 90.0 END + CASE WHEN minutes >= 60 THEN 2 ELSE 1 END * minutes / 90.0, 4) AS solver_xp FROM stats JOIN players USING (player_id)")
def p18(spark, d):
    return scoring.solver_points(joined(spark, d).withColumns({"xmins": F.col("minutes").cast("double"), "xcs": F.lit(0.25)})).select("player_id", "gameweek", r("solver_xp"))
