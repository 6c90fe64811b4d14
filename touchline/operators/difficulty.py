"""Fixture difficulty: team strengths by Poisson regression, expected goals, outcome probabilities."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import clip, col, correlation, goal_probabilities, outcome
from touchline.operators.features import goal_averages
from touchline.operators.stage import stage_in

HOME_ADVANTAGE = 0.25


def with_results(fixtures: DataFrame) -> DataFrame:
    """Fixtures with both goals known."""
    return fixtures.filter(F.col("goals_h").isNotNull() & F.col("goals_a").isNotNull()).withColumns({"goals_h": F.col("goals_h").cast("double"), "goals_a": F.col("goals_a").cast("double")})


#: Limit of the library's least-squares solver; beyond it strengths are fitted by alternating updates.
MOST_COEFFICIENTS = 4096
#: Alternating updates end when no strength moves by more than this, or after so many rounds.
STILL, ROUNDS = 1e-6, 200
#: Goals that a team without any counts as, so that its strength stays finite.
SCARCE = 1e-6


def fit_strengths(fixtures: DataFrame, ridge: float = 1e-6) -> tuple[DataFrame, float]:
    """(team, attack_strength, defense_strength) and the home term, by a Poisson regression of home goals on the home team's attack and the away team's defence.

    Strengths are centred, higher is better for both; the removed means go into the home
    term. Up to MOST_COEFFICIENTS coefficients (two a team) the library's solver is used, which
    brings them to the driver; beyond that fit_by_turns, whose figures are the same. Falls back
    to goal averages where the regression cannot be fitted: no matches, or a singular system.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    known = with_results(fixtures).select(F.col("team_h").cast("string").alias("home"), F.col("team_a").cast("string").alias("away"), "goals_h")
    spark = fixtures.sparkSession
    teams = known.agg(F.count_distinct("home").alias("h"), F.count_distinct("away").alias("a")).head()
    if teams["h"] + teams["a"] > MOST_COEFFICIENTS:
        return fit_by_turns(known)
    if not teams["h"] or not teams["a"]:
        return goal_averages(with_results(fixtures)).select("team", "attack_strength", "defense_strength"), HOME_ADVANTAGE
    try:
        index = StringIndexer(inputCols=["home", "away"], outputCols=["home_i", "away_i"], stringOrderType="alphabetAsc").fit(known)
        encode = OneHotEncoder(inputCols=["home_i", "away_i"], outputCols=["attack", "defense"], dropLast=False)
        glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol="goals_h", regParam=ridge, maxIter=50)
        model = Pipeline(stages=[encode, VectorAssembler(inputCols=["attack", "defense"], outputCol="features"), glm]).fit(index.transform(known)).stages[-1]
    except Exception as e:  # noqa: BLE001  the solver reports a singular system in several ways
        if not re.search("(?i)singular|not positive definite|constant label|SingularMatrix|lapack|NaN", str(e)):
            raise
        return goal_averages(with_results(fixtures)).select("team", "attack_strength", "defense_strength"), HOME_ADVANTAGE
    homes, aways = index.labelsArray
    c = model.coefficients.toArray()
    attack, defense = dict(zip(homes, c[: len(homes)])), dict(zip(aways, c[len(homes) :]))
    mean_a, mean_d = sum(attack.values()) / len(attack), sum(defense.values()) / len(defense)
    rows = [(t, float(attack.get(t, mean_a) - mean_a), float(mean_d - defense.get(t, mean_d))) for t in sorted({*homes, *aways})]
    return spark.createDataFrame(rows, "team string, attack_strength double, defense_strength double"), float(model.intercept + mean_a + mean_d)


def fit_by_turns(known: DataFrame) -> tuple[DataFrame, float]:
    """fit_strengths() of matches (home, away, goals_h) for any number of teams.

    Expected goals are a * d, of the home and the away team. Where the likelihood is highest, either side's goals are its expected ones, so each round sets
    a = goals of the team / sum of its opponents' d, then d in the same way: two group-bys over distinct pairings, pre-aggregated, and two small joins.
    """
    stage = stage_in(known.sparkSession)
    pairs = stage(known.groupBy("home", "away").agg(F.sum("goals_h").alias("goals"), F.count("*").alias("n")), "pairings")
    enough = lambda c: F.greatest(F.sum(c), F.lit(SCARCE))
    attack = None
    defense = stage(pairs.groupBy("away").agg((enough("goals") / F.sum("n")).alias("d")), "defense")
    for _ in range(ROUNDS):
        # Goals add up by team however they are met, so the sums are taken in one pass.
        new_a = stage(pairs.join(defense, "away").groupBy("home").agg((enough("goals") / F.sum(F.col("n") * F.col("d"))).alias("a")), "attack")
        new_d = stage(pairs.join(new_a, "home").groupBy("away").agg((enough("goals") / F.sum(F.col("n") * F.col("a"))).alias("d")), "defense")
        moved = defense.withColumnRenamed("d", "old").join(new_d, "away").agg(F.max(F.abs(F.ln("d") - F.ln("old"))).alias("m")).head()["m"]
        attack, defense = new_a, new_d
        if moved is None or moved < STILL:
            break
    a, d = attack.select(F.col("home").alias("team"), F.ln("a").alias("a")), defense.select(F.col("away").alias("team"), F.ln("d").alias("d"))
    means = a.agg(F.avg("a").alias("mean_a")).join(F.broadcast(d.agg(F.avg("d").alias("mean_d")))).head()
    centred = lambda c, mean: F.coalesce(F.col(c) - F.lit(mean), F.lit(0.0))
    rows = a.join(d, "team", "full_outer").select("team", centred("a", means["mean_a"]).alias("attack_strength"), (-centred("d", means["mean_d"])).alias("defense_strength"))
    return rows, float(means["mean_a"] + means["mean_d"])


def expected_goals(fixtures: DataFrame, strengths: DataFrame, home_advantage: float = HOME_ADVANTAGE, home: str = "team_h", away: str = "team_a") -> DataFrame:
    """With xg_h and xg_a; unknown teams have strength 0, without any strengths both are 1.5."""
    side = lambda key, p: strengths.select(F.col("team").alias(key), F.col("attack_strength").alias(f"{p}_att"), F.col("defense_strength").alias(f"{p}_def"))
    df = fixtures.join(side(home, "_h"), home, "left").join(side(away, "_a"), away, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = df.withColumn("xg_h", F.exp(F.lit(home_advantage) + z("_h_att") - z("_a_def"))).withColumn("xg_a", F.exp(z("_a_att") - z("_h_def")))
    return df.drop("_h_att", "_h_def", "_a_att", "_a_def")


def difficulty_of(goals_against):
    """1 to 5."""
    return clip(1 + col(goals_against) / 2.0, 1.0, 5.0)


def by_side(fixtures: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per team and match: team, opponent, is_home, xg_for, xg_against, official difficulty and goals where the fixtures have them."""
    has = set(fixtures.columns)

    def row(me: str, other: str):
        parts = [F.col(f"team_{me}").cast("string").alias("team"), F.col(f"team_{other}").cast("string").alias("opponent"), F.lit(me == "h").alias("is_home"), F.col(f"xg_{me}").alias("xg_for"), F.col(f"xg_{other}").alias("xg_against")]
        if "team_h_difficulty" in has:
            parts.append(F.col(f"team_{me}_difficulty").cast("double").alias("official"))
        if "goals_h" in has:
            parts += [F.col(f"goals_{me}").cast("double").alias("goals_for"), F.col(f"goals_{other}").cast("double").alias("goals_against")]
        return F.struct(*parts)

    return fixtures.select(*columns, F.explode(F.array(row("h", "a"), row("a", "h"))).alias("_s")).select(*columns, "_s.*")


def stochastic(sides: DataFrame) -> DataFrame:
    """With fdr_mean, fdr_std, win, draw and loss, clean sheet, and the two goal distributions (arrays of 0 to 6 goals). All by array expressions, no join."""
    df = sides.withColumn("goals_for_probs", goal_probabilities("xg_for")).withColumn("goals_against_probs", goal_probabilities("xg_against"))
    win, draw, loss = outcome(F.col("goals_for_probs"), F.col("goals_against_probs"))
    return df.withColumns({"win_prob": win, "draw_prob": draw, "loss_prob": loss, "clean_sheet_prob": F.col("goals_against_probs")[0], "fdr_mean": difficulty_of("xg_against"), "fdr_std": F.sqrt("xg_against") / 2.0})


def compare_official(sides: DataFrame) -> DataFrame:
    """Correlation, mean absolute error and R-squared of fdr_mean against the official difficulty; zeros below two rows."""
    df = sides.filter(F.col("official").isNotNull())
    x, y = F.col("fdr_mean"), F.col("official")
    g = df.agg(F.count("*").alias("n"), correlation(x, y).alias("c"), F.avg(F.abs(x - y)).alias("m"), F.sum((y - x) * (y - x)).alias("res"), (F.var_pop(y) * F.count("*")).alias("tot"))
    safe = lambda c: F.when(F.col("n") >= 2, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return g.select("n", safe(F.col("c")).alias("correlation"), safe(F.col("m")).alias("mean_absolute_error"), safe(F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot"))).alias("r_squared"))


def verify_outcomes(sides: DataFrame) -> DataFrame:
    """Correlations of expected with actual goals over both sides; accuracy within half a goal over the home side's two forecasts."""
    df = sides.filter(F.col("goals_for").isNotNull() & F.col("goals_against").isNotNull())
    close = lambda p, a: F.when(F.abs(F.col(p) - F.col(a)) < 0.5, 1.0).otherwise(0.0)
    right = F.avg(F.when(F.col("is_home"), (close("xg_for", "goals_for") + close("xg_against", "goals_against")) / 2))
    return df.agg(F.coalesce(correlation("xg_for", "goals_for"), F.lit(0.0)).alias("correlation_goals_for"), F.coalesce(correlation("xg_against", "goals_against"), F.lit(0.0)).alias("correlation_goals_against"), F.coalesce(right, F.lit(0.0)).alias("prediction_accuracy"))


def goals_from_clean_sheet(p):
    """Goals against that a clean-sheet probability stands for, 0 to 5."""
    return clip(-F.ln(col(p)), 0.0, 5.0)
