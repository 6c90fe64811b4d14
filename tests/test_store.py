"""The ledger of landed files, and team strengths for many teams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import difficulty
from touchline.sources import ledger


def test_files_are_taken_once(spark, tmp_path):
    at = {k: f"file://{tmp_path}/{k}" for k in ("files", "store", "ledger", "staging")}
    seen = []

    def facts(df):
        seen.append(df.count())
        return df.select("player_id", F.lit("s").alias("season"), "gameweek", "points")

    land = lambda rows, k: spark.createDataFrame(rows, "player_id int, gameweek int, points int").coalesce(1).write.mode("overwrite").parquet(f"{at['files']}/{k}")
    sync = lambda: ledger.sync(spark, at["files"], at["store"], at["ledger"], at["staging"], facts)
    stored = lambda: sorted((r.player_id, r.gameweek, r.points) for r in spark.read.parquet(at["store"]).collect())
    assert sync() == 0
    land([(1, 1, 5), (2, 1, 3), (1, 2, 7)], "a")
    assert sync() == 1 and sync() == 0 and stored() == [(1, 1, 5), (1, 2, 7), (2, 1, 3)]
    land([(2, 1, 9), (2, 2, 1)], "b")
    assert sync() == 1 and sync() == 0 and stored() == [(1, 1, 5), (1, 2, 7), (2, 1, 9), (2, 2, 1)]
    land([(3, 3, 1), (3, 3, 2)], "b")  # written anew: another file
    assert sync() == 1 and stored()[-1] == (3, 3, 2) and seen == [3, 2, 2]


def test_a_run_that_ends_before_the_ledger_changes_nothing(spark, tmp_path):
    at = {k: f"file://{tmp_path}/{k}" for k in ("files", "store", "ledger", "staging", "other")}
    spark.createDataFrame([(1, 1, 5)], "player_id int, gameweek int, points int").write.parquet(f"{at['files']}/a")
    facts = lambda df: df.withColumn("season", F.lit("s"))
    # The first run's ledger is lost.
    assert ledger.sync(spark, at["files"], at["store"], at["other"], at["staging"], facts) > 0
    assert ledger.sync(spark, at["files"], at["store"], at["ledger"], at["staging"], facts) > 0
    assert [(r.player_id, r.points) for r in spark.read.parquet(at["store"]).collect()] == [(1, 5)]


def matches(teams, n, seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        h, a = r.sample(range(teams), 2)
        out.append((h, a, min(9, int(r.expovariate(1 / (0.5 + (h % 5) * 0.4 + (a % 3) * 0.2)))), 0))
    return out


def test_strengths_by_turns_equal_the_regression(spark, monkeypatch):
    df = spark.createDataFrame(matches(25, 900), "team_h int, team_a int, goals_h int, goals_a int")
    want, home = difficulty.fit_strengths(df, 0.0)
    monkeypatch.setattr(difficulty, "MOST_COEFFICIENTS", 10)
    got, again = difficulty.fit_strengths(df)
    assert again == pytest.approx(home, abs=1e-4)
    want = {r.team: (r.attack_strength, r.defense_strength) for r in want.collect()}
    got = {r.team: (r.attack_strength, r.defense_strength) for r in got.collect()}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t], abs=1e-4) for t in want)


def test_strengths_of_many_teams(spark, monkeypatch):
    monkeypatch.setattr(difficulty, "ROUNDS", 3)
    df = spark.createDataFrame(matches(50_000, 100_000), "team_h int, team_a int, goals_h int, goals_a int")
    got, home = difficulty.fit_strengths(df)
    assert got.count() > 45_000 and got.filter(F.isnan("attack_strength") | F.isnan("defense_strength") | F.col("attack_strength").isNull()).count() == 0
