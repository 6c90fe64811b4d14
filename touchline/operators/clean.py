"""Cleaning: numbers out of text, double periods, defensive floor points, defaults, availability, difficulty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.columns import by_position, clip, col, filled, finite, parsed

# Points by position for a block and an intervention; a tenth of a point for ten passes.
BLOCK_POINTS = {"GK": 0.0, "DEF": 1.0, "MID": 1.0, "FWD": 0.0}
PASS_BONUS = 0.1

# Defaults of features that are missing or not finite.
FEATURE_DEFAULTS = {"fdr": 3.0, "fdr_mean": 3.0, "fdr_std": 0.0, "win_prob": 0.33, "draw_prob": 0.34, "loss_prob": 0.33, "clean_sheet_prob": 0.25, "expected_goals_for": 1.5, "expected_goals_against": 1.5, "form_alpha": 0.5}


def to_numbers(df: DataFrame, columns: Sequence[str], default: float | None = 0.0) -> DataFrame:
    """Text columns as doubles; commas and blanks are dropped, what is no number becomes the default."""
    return df.withColumns({c: parsed(c, default) for c in columns if c in df.columns})


def type_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """column, old_type, new_type of columns whose type changed."""
    old, new = dict(before.dtypes), dict(after.dtypes)
    rows = [(c, old[c], new[c]) for c in before.columns if c in new and old[c] != new[c]]
    return after.sparkSession.createDataFrame(rows, "column string, old_type string, new_type string")


def normalised_points(points, matches):
    """Points of one match: 0 for a blank period, the mean for a double one."""
    points, matches = col(points).cast("double"), col(matches)
    return F.when(matches == 0, 0.0).when(matches == 1, points).otherwise(points / matches)


def matches_from_minutes(minutes):
    """Matches in a period, 0 to 2, from the minutes played; 1 where they are unknown."""
    return F.coalesce(clip(F.bround(col(minutes) / 90.0), 0, 2).cast("int"), F.lit(1))


def normalise_history(df: DataFrame, points: str = "total_points", minutes: str | None = "minutes") -> DataFrame:
    """With matches_played and normalized_points."""
    matches = matches_from_minutes(minutes) if minutes and minutes in df.columns else F.lit(1)
    return df.withColumn("matches_played", matches).withColumn("normalized_points", normalised_points(points, "matches_played"))


def floor_points(blocks_90, interventions_90, passes_90, position, minutes):
    """Points that defensive work alone brings in so many minutes; goalkeepers score as forwards do."""
    factor = col(minutes) / 90.0
    blocks = by_position(position, *(BLOCK_POINTS[p] for p in ("GK", "DEF", "MID", "FWD")), 0.0) * col(blocks_90)
    return F.when(col(minutes) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (blocks + col(interventions_90) + col(passes_90) / 10.0 * PASS_BONUS) * factor))


def defcon_rates(df: DataFrame, blocks: str = "blocks", interventions: Sequence[str] = ("interventions",), passes: str = "passes", minutes: str = "minutes", games: str | None = None) -> DataFrame:
    """Per-90 rates from totals: the mean per game over the mean minutes per game (1 at least)."""
    n = F.when(col(games) > 0, col(games)).otherwise(1) if games else F.lit(1)
    scale = 90.0 / F.greatest(col(minutes) / n, F.lit(1.0)) / n
    rate = lambda c: F.when(col(minutes) > 0, c * scale).otherwise(0.0)
    work = sum((filled(c) for c in interventions), F.lit(0.0))
    return df.withColumns({"blocks_per_90": rate(filled(blocks)), "interventions_per_90": rate(work), "passes_per_90": rate(filled(passes))})


def defcon_metrics(df: DataFrame, position: str = "position", minutes: str = "minutes") -> DataFrame:
    """With floor_points for the minutes at hand, floor_points_90 and defcon_score for a full match. Needs the per-90 rates."""
    points = lambda m: floor_points("blocks_per_90", "interventions_per_90", "passes_per_90", position, m)
    return df.withColumns({"floor_points": points(col(minutes)), "floor_points_90": points(F.lit(90.0)), "defcon_score": points(F.lit(90.0))})


def defcon_from_service(df: DataFrame, minutes: str = "minutes", played: str = "minutes_played", games: str = "games_played") -> DataFrame:
    """The feature service's variant: interceptions only; without minutes played, totals over the expected minutes in matches (1 at least)."""
    n = F.when(col(games) > 0, col(games)).otherwise(1)
    known = 90.0 / F.greatest(col(played) / n, F.lit(1.0)) / n
    scale = F.when(col(played) > 0, known).otherwise(1.0 / F.greatest(col(minutes) / 90.0, F.lit(1.0)))
    rates = {f"{k}_per_90": filled(c) * scale for k, c in (("blocks", "blocks"), ("interventions", "interceptions"), ("passes", "passes"))}
    return defcon_metrics(df.withColumns(rates), minutes=minutes)


def defcon_for_model(df: DataFrame, expected_minutes: str = "expected_minutes") -> DataFrame:
    """The defence model's variant: per-90 rates, else averages."""
    rates = {f"{k}_per_90": F.coalesce(*[finite(c) for c in (f"{k}_per_90", f"avg_{k}") if c in df.columns], F.lit(0.0)) for k in ("blocks", "interventions", "passes")}
    df = df.withColumns(rates)
    return df.withColumn("defcon_points", floor_points("blocks_per_90", "interventions_per_90", "passes_per_90", "position", expected_minutes))


def clean_players(df: DataFrame, numeric: Sequence[str], points: str = "total_points", minutes: str = "minutes") -> DataFrame:
    """Numbers out of text, points of one match (the original kept), defensive metrics."""
    df = to_numbers(df, numeric).withColumn("original_points", col(points))
    df = normalise_history(df, points, minutes)
    return defcon_metrics(defcon_rates(df), minutes=minutes)


def cleaning_counts(df: DataFrame) -> DataFrame:
    """Rows in all, double and blank periods, rows with defensive points."""
    return df.agg(
        F.count("*").alias("total"), F.count_if(F.col("matches_played") > 1).alias("double_periods"),
        F.count_if(F.col("matches_played") == 0).alias("blank_periods"), F.count_if(F.col("floor_points") > 0).alias("with_defcon"),
    )


def fill_features(df: DataFrame, defaults: dict[str, float] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Null, NaN and infinite features replaced by their defaults (0 where none is named)."""
    defaults = FEATURE_DEFAULTS if defaults is None else defaults
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.withColumns({c: filled(c, defaults.get(c, 0.0)) for c in columns})


# Chances of playing and states that take a player out.
OUT_CHANCES = [0, 25, 50]
OUT_STATES = ["d", "i", "n", "s", "u"]


def availability(df: DataFrame, chance: str = "chance_of_playing", status: str = "status", columns: Sequence[str] = ("xp", "xmins")) -> DataFrame:
    """Predictions set to 0 for players who are out or doubtful; an unknown chance leaves it to the status."""
    out = col(chance).isin(OUT_CHANCES) | (col(chance).isNull() & F.coalesce(col(status), F.lit("a")).isin(OUT_STATES))
    return df.withColumns({c: F.when(F.coalesce(out, F.lit(False)), 0.0).otherwise(col(c)) for c in columns})


def strength_difficulty(strength):
    """Difficulty 1 to 5 of meeting a team of so much strength (around 1000)."""
    s = F.greatest(F.when(F.coalesce(col(strength), F.lit(0)) == 0, 1000).otherwise(col(strength)), F.lit(100))
    return clip(F.bround(s / 1000.0 * 5), 1, 5).cast("int")


def fixtures_with_difficulty(fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """Fixtures with both teams' names and difficulties. Teams are a small dimension; Spark broadcasts it by its size."""
    side = lambda k, s: teams.select(F.col("team_id").alias(f"team_{k}"), F.col("team_name").alias(f"team_{k}_name"), F.col(s).alias(f"strength_{k}"))
    df = fixtures.drop("team_h_difficulty", "team_a_difficulty").join(side("h", "strength_attack_home"), "team_h", "left").join(side("a", "strength_attack_away"), "team_a", "left")
    return df.withColumn("team_h_difficulty", strength_difficulty("strength_a")).withColumn("team_a_difficulty", strength_difficulty("strength_h"))


def search(df: DataFrame, term: str | None = None, columns: Sequence[str] = ("name",), max_price: float | None = None, **equal: str) -> DataFrame:
    """Rows that hold the term in any of the columns, whatever the case, cost no more, and equal the given values."""
    if term:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.lower(c).contains(term.lower())
        df = df.filter(hit)
    if max_price is not None:
        df = df.filter(F.col("price") <= max_price)
    for c, value in equal.items():
        df = df.filter(F.col(c) == value)
    return df
