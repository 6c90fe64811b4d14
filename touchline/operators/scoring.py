"""Expected points: minutes, attack and defence without trained models, scoring rules, confidence, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import by_position, clip, col, filled, finite, mean_of
from touchline.operators.features import injury_code

# Points by position.
GOALS = {"GK": 6.0, "DEF": 6.0, "MID": 5.0, "FWD": 4.0}
CLEAN_SHEET = {"GK": 4.0, "DEF": 4.0, "MID": 1.0, "FWD": 0.0}
ASSIST = 3.0


def positional(table: dict[str, float], position: str = "position", other: float | None = None) -> Column:
    return by_position(position, table["GK"], table["DEF"], table["MID"], table["FWD"], other)


# ---------------------------------------------------------------- minutes

def start_features(df: DataFrame, as_of: str) -> DataFrame:
    """Eight features of the start model; days since the last match count from as_of (7 where unknown)."""
    days = F.datediff(F.lit(as_of).cast("date"), F.col("last_match_date").try_cast("date"))
    recent = mean_of(F.slice("recent_minutes", 1, 3))
    return df.withColumns({
        "days_since_last_match": F.coalesce(days.cast("double"), F.lit(7.0)), "is_cup_week": F.when(F.coalesce(F.col("is_cup_week"), F.lit(False)), 1.0).otherwise(0.0), "injury_status": injury_code(),
        "recent_minutes_share": F.coalesce(recent, F.lit(90.0)) / 90.0, "position_depth": F.coalesce(F.col("position_depth"), F.lit(2.0)) / 3.0,
        "form_score": F.coalesce(F.col("form"), F.lit(0.0)) / 10.0, "price_share": F.coalesce(F.col("price"), F.lit(50.0)) / 100.0, "rotation": F.coalesce(F.col("rotation_risk"), F.lit(0.5)),
    })


def untrained_start(recent: str = "recent_minutes") -> Column:
    """Mean of three recent matches over 90, 1 at most; 0.7 without any."""
    share = mean_of(F.slice(recent, 1, 3)) / 90.0
    return F.when(share.isNotNull(), F.least(F.lit(1.0), share)).otherwise(0.7)


def expected_minutes(p_start: Column, recent: str = "recent_minutes") -> Column:
    played = F.filter(recent, lambda m: m > 0)
    return clip(p_start * F.coalesce(mean_of(played), F.lit(85.0)), 0.0, 90.0)


def predict_minutes(df: DataFrame) -> DataFrame:
    df = df.withColumn("p_start", untrained_start())
    return df.withColumn("xmins", expected_minutes(F.col("p_start")))


# ---------------------------------------------------------------- attack and defence

def attack_multiplier(opponent_defense: Column) -> Column:
    return clip(1.0 - 0.3 * opponent_defense, 0.7, 1.4)


def attack_features(df: DataFrame) -> DataFrame:
    """Seventeen features of the attack models."""
    z = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in df.columns else F.lit(d)
    xgc = z("opponent_xgc", 1.5)
    factor = xgc / 1.5
    return df.withColumns({
        "f_norm_xg": z("xg_per_90") * factor, "f_norm_xa": z("xa_per_90") * factor, "f_xg": z("xg_per_90"), "f_xa": z("xa_per_90"), "f_goals": z("goals_per_90"), "f_assists": z("assists_per_90"),
        "f_recent_xg": F.coalesce(mean_of("recent_xg"), z("xg_per_90")), "f_recent_xa": F.coalesce(mean_of("recent_xa"), z("xa_per_90")), "f_xgc": xgc,
        "f_opp_defense": z("opponent_defense"), "f_opp_attack": z("opponent_attack"), "f_fdr": z("fdr", 3.0) / 5.0, "f_home": F.when(z("is_home", 0.0) > 0, 1.0).otherwise(0.0),
        "f_position": by_position("position", 0.0, 1.0, 2.0, 3.0) / 3.0, "f_team_attack": z("team_attack_strength"), "f_minutes": z("expected_minutes", 90.0) / 90.0, "f_factor": factor,
    })


ATTACK_FEATURES = ["f_norm_xg", "f_norm_xa", "f_xg", "f_xa", "f_goals", "f_assists", "f_recent_xg", "f_recent_xa", "f_xgc", "f_opp_defense", "f_opp_attack", "f_fdr", "f_home", "f_position", "f_team_attack", "f_minutes", "f_factor"]


def untrained_attack(df: DataFrame, opponent_xgc: Column | float = 1.5, opponent_defense: Column | float = 0.0) -> DataFrame:
    """xg and xa out of per-90 rates, the opponent's goals conceded (xg only) and its defence."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    m = attack_multiplier(lit(opponent_defense))
    return df.withColumn("xg", F.greatest(F.lit(0.0), F.col("xg_per_90") * lit(opponent_xgc) / 1.5 * m)).withColumn("xa", F.greatest(F.lit(0.0), F.col("xa_per_90") * m))


def normalised_strength(c: Column) -> Column:
    """Around 1: nothing or less is 1, small scales are clipped to 0.1 to 2, ratings are per thousand."""
    return F.when(c <= 0, 1.0).when(c <= 10, clip(c, 0.1, 2.0)).otherwise(c / 1000.0)


def clean_sheet_probability(defense: Column, opponent_attack: Column, is_home: Column) -> Column:
    """exp(-goals expected against); 0.25 where a strength is unknown."""
    rate = clip(1.5 / normalised_strength(defense) * normalised_strength(opponent_attack) * F.when(is_home, 0.9).otherwise(1.0), 0.0, 3.0)
    return F.coalesce(F.exp(-rate), F.lit(0.25))


# ---------------------------------------------------------------- points

def expected_points(df: DataFrame, scale: float = 1.0, offset: float = 0.0, defcon: str = "defcon_points") -> DataFrame:
    """With xp and its parts from xg, xa, xcs, xmins, ict_index, form, position and defensive points of a full match."""
    z = lambda c: filled(c) if c in df.columns else F.lit(0.0)
    factor = z("xmins") / 90.0
    goal, assist, cs = positional(GOALS, other=4.0) * z("xg"), ASSIST * z("xa"), positional(CLEAN_SHEET, other=0.0) * z("xcs")
    appearance = factor * 2.0
    bonus = clip((goal + assist) * 0.15 + z("ict_index") * 0.02, 0.0, 3.0)
    strong = (z("xg") > 0.5) | (z("xa") > 0.3) | (z("ict_index") > 50) | (z("form") > 5.0)
    first = factor * (goal + assist + cs + z(defcon)) + appearance
    boost = F.when(strong & (first < 5.0), 1.15 + F.least(F.lit(0.15), (z("xg") + z("xa")) * 0.1)).otherwise(1.0)
    df = df.withColumns({"xmins_factor": factor, "goal_component": goal * boost, "assist_component": assist * boost, "cs_component": cs, "appearance_points": appearance, "expected_bonus": bonus * boost})
    raw = F.col("xmins_factor") * (F.col("goal_component") + F.col("assist_component") + F.col("cs_component") + z(defcon)) + F.col("appearance_points") + F.col("expected_bonus")
    low = F.when((raw < 1.0) & (F.col("xmins_factor") > 0.1), F.greatest(raw, F.col("appearance_points") * 0.5)).otherwise(raw)
    return df.withColumn("xp", F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), low) * scale + offset))


def confidence(minutes: str = "minutes", p_start: str = "p_start", status: str = "status") -> Column:
    add = F.when(col(minutes) > 500, 0.1).otherwise(0.0) + F.when(col(p_start) > 0.8, 0.1).otherwise(0.0)
    less = F.when(col(status) == "d", 0.2).when(col(status).isin("i", "s"), 0.3).otherwise(0.0)
    return clip(F.lit(0.7) + add - less, 0.0, 1.0)


def predict(history: DataFrame, fixtures: DataFrame | None = None) -> DataFrame:
    """Untrained path: minutes, attack, clean sheets, defence, points, confidence. history: summaries with position and status; fixtures: by player_id with opponent_defense, own defense, opponent_attack and is_home."""
    df = history
    if fixtures is not None:
        df = df.join(fixtures, "player_id", "left")
        df = untrained_attack(df, 1.5 - 0.1 * F.coalesce(F.col("opponent_defense"), F.lit(0.0)), F.coalesce(F.col("opponent_defense"), F.lit(0.0)))
        cs = clean_sheet_probability(F.col("team_defense"), F.col("opponent_attack"), F.coalesce(F.col("is_home"), F.lit(True)))
    else:
        df, cs = untrained_attack(df), F.lit(0.25)
    df = predict_minutes(df).withColumn("xcs", F.when(F.col("position").isin("GK", "DEF"), cs).otherwise(0.0))
    return expected_points(df).withColumn("confidence", confidence())


def fit_calibration(df: DataFrame, predicted: str = "predicted", actual: str = "points") -> DataFrame:
    """One row: scale, offset, rmse_before, rmse_after. Two aggregates; the first's single row is broadcast to the second."""
    good = df.select(finite(predicted).alias("p"), finite(actual).alias("a")).dropna()
    m = good.agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("a").alias("ma"), F.var_pop("p").alias("vp"), F.covar_pop("p", "a").alias("cov"))
    ratio = F.when(F.col("mp") > 0, F.col("ma") / F.col("mp")).otherwise(1.0)
    slope = F.col("cov") / F.col("vp")
    m = m.withColumn("scale", F.when((F.col("vp") > 0.1) & (F.abs(slope) < 5.0), 0.6 * slope + 0.4 * ratio).otherwise(ratio))
    m = m.withColumn("offset", clip(F.col("ma") - F.col("scale") * F.col("mp"), -2.0, 2.0)).filter("n > 0")
    fitted = F.greatest(F.lit(0.0), F.col("p") * F.col("scale") + F.col("offset"))
    sq = lambda c: (F.col("a") - c) * (F.col("a") - c)
    both = good.join(F.broadcast(m.select("scale", "offset", "n"))).groupBy("scale", "offset", "n").agg(F.sqrt(F.avg(sq(F.col("p")))).alias("rmse_before"), F.sqrt(F.avg(sq(fitted))).alias("rmse_after"))
    return both.withColumn("improvement_pct", F.when(F.col("rmse_before") > 0, (F.col("rmse_before") - F.col("rmse_after")) / F.col("rmse_before") * 100).otherwise(0.0))


def solver_points(df: DataFrame, floor: str | None = None) -> DataFrame:
    """The solver's variant: attack counts for midfielders (goals 4) and forwards (goals 5) only, clean sheets for the others; appearance by the hour mark."""
    f = filled("xmins") / 90.0
    attacker = F.col("position").isin("MID", "FWD")
    attack = (F.when(F.col("position") == "FWD", 5.0).otherwise(4.0) * filled("xg") + ASSIST * filled("xa")) * f + F.least(F.lit(1.0), (filled("xg") + filled("xa")) / 2.0)
    appear = F.when(filled("xmins") >= 60, 2.0 * f).otherwise(f)
    xp = F.when(attacker, attack).when(F.col("position").isin("GK", "DEF"), 4.0 * filled("xcs") * f).otherwise(0.0) + appear
    return df.withColumn("solver_xp", F.greatest(xp, filled(floor)) if floor else xp)
