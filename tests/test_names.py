"""Fuzzy names: batched scorers against the plain ones, indexed candidates against all pairs, the simple score against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import similarity
from touchline.functions.columns import name_score
from touchline.operators import resolve
from touchline.sources import ingest

WORDS = "ann joanna rooney vini bo ek carl von essen de gea pjanic o'neill ö x old silva silva-santos fernandes brand2 brand17 small ring".split()


def names(seed, n, longest=4):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        x = " ".join(r.choices(WORDS, k=r.choice([1, 1, 2, 2, 3, longest])))
        for _ in range(r.choice([0, 0, 1, 2])):
            i = r.randrange(len(x) + 1)
            x = x[:i] + r.choice(["q", "", " ", "b", "  ", "\t", "\u00a0"]) + x[i + r.choice([0, 1]) :]
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("kind", sorted(similarity.SCORERS))
def test_batched_scorers_equal_the_plain_ones(kind):
    a, b = names(1, 60, 14), names(2, 60, 30)
    pairs = [(x, y) for x in [*a, "", " ", "x" * 64, "x" * 65 + "y" * 20] for y in random.Random(3).sample(b, 20) + ["", "y" * 70 + "x", "x" * 64]]
    x, y = [p[0] for p in pairs], [p[1] for p in pairs]
    want = np.array([similarity.SCORERS[kind](*p) for p in pairs])
    assert np.abs(similarity.many(kind, x, y) - want).max() < 1e-9
    for least in (40, 60, 75, 90):
        got = similarity.many(kind, x, y, least)
        assert (got <= want + 1e-9).all() and (np.abs(got - want)[want >= least] < 1e-9).all()


@pytest.mark.parametrize("scorer", sorted(resolve.SCORERS))
def test_the_index_finds_all_pairs(spark, monkeypatch, scorer):
    a, b = names(4, 40, 6), names(5, 60, 9)
    monkeypatch.setattr(resolve, "HOT", 50)  # frequent keys are split
    monkeypatch.setattr(resolve, "PART", 7)
    frames = [spark.createDataFrame(list(enumerate(x)), "id int, name string") for x in (a, b)]
    clean = lambda x: x.lower().strip(" ")
    for threshold in (55, 80):
        score = {(p, q): similarity.SCORERS[scorer](p, q) for p in {clean(x) for x in a} - {""} for q in {clean(x) for x in b} - {""}}
        got = {(r.target, r.cand): r.score for r in resolve.similar_names(*frames, scorer, threshold).collect()}
        assert got == {p: pytest.approx(s) for p, s in score.items() if s >= threshold}


def test_best_matches_of_repeated_names(spark):
    a = spark.createDataFrame([(k, n) for k, n in enumerate(["Ann Lee", "ann lee ", "Bo Ek", None, ""])], "id int, name string")
    b = spark.createDataFrame([(k, n) for k, n in enumerate(["ann lee", "ann leh", "ann lee", "Ann Lee", "bo", None])], "id int, name string")
    got = sorted((r.target_id, r["rank"], r.cand_id) for r in resolve.best_matches(a, b, 80, 3).collect())
    # Equal scores by name, then id; capitals sort first.
    assert got == [(0, 1, 3), (0, 2, 0), (0, 3, 2), (1, 1, 3), (1, 2, 0), (1, 3, 2), (2, 1, 4)]


def test_resolution_does_not_depend_on_files(spark):
    r = random.Random(6)
    pool = names(7, 40)
    rows = [(k, r.choice(pool), 100 + k, r.choice(pool), str(200 + k), r.choice([*pool, None])) for k in range(50)]
    asked = spark.createDataFrame([(1000 + k, n) for k, n in enumerate(names(8, 60))], "id bigint, name string")
    got = [sorted(map(str, resolve.resolve(asked, spark.createDataFrame(rows, ingest.ID_MAP).repartition(parts)).collect())) for parts in (1, 8)]
    assert got[0] == got[1] and any("fuzzy" in x for x in got[0])


def simple_best(spark, players, external, threshold):
    t = spark.createDataFrame(players, "target_id int, target string, tt int")
    c = spark.createDataFrame(external, "cand_id int, cand string, ct int")
    every = t.crossJoin(c).select("*", F.least(F.lit(1.0), name_score("target", "cand") + F.when(F.col("tt") == F.col("ct"), 0.1).otherwise(0.0)).alias("score"))
    best = {}
    for r in every.collect():
        if r.score is not None and r.score >= threshold and (r.target_id not in best or (-r.score, r.cand_id) < best[r.target_id]):
            best[r.target_id] = (-r.score, r.cand_id)
    return {k: (v[1], round(-v[0], 9)) for k, v in best.items()}


def test_external_names_that_hold_each_other(spark):
    players = [(1, "ann", 1), (2, "rooney", 1), (3, "vini", 1), (4, "de gea", 1)]
    external = [(11, "joanna", 1), (12, "wrooneyx", 1), (13, "oldvini", 1), (14, "ade geazx", 1)]
    frames = spark.createDataFrame(players, "id int, name string, team int"), spark.createDataFrame(external, "id int, name string, team int")
    assert {(r.target_id, r.cand_id, r.score) for r in resolve.external_matches(*frames).collect()} == {(1, 11, 1.0), (2, 12, 1.0), (3, 13, 1.0), (4, 14, 1.0)}


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.95])
def test_external_matches_equal_all_pairs(spark, threshold):
    r = random.Random(9)
    pool = names(10, 80, 5)
    players = [(k, r.choice([*pool, "X", "", " Jr", None]), r.choice([1, 2, 3, None])) for k in range(120)]
    external = [(k, r.choice([*pool, "silva iv", "", "Y", None]), r.choice([1, 2, 3, None])) for k in range(150)]
    frames = spark.createDataFrame(players, "id int, name string, team int"), spark.createDataFrame(external, "id int, name string, team int")
    got = {x.target_id: (x.cand_id, round(x.score, 9)) for x in resolve.external_matches(*frames, threshold).collect()}
    assert got == simple_best(spark, players, external, threshold)


def test_a_name_of_many_rows_meets_one_row_of_the_map(spark, monkeypatch):
    names = spark.createDataFrame([(k, "Same Name") for k in range(50)], "id long, name string")
    rows = [(k, "same name", k, "SAME NAME", str(k), "same  name") for k in range(40, 90)]
    table = spark.createDataFrame(rows, "id long, name string, source_a_id long, source_a_name string, source_b_id string, source_b_name string")
    made, real = [], type(names).join
    monkeypatch.setattr(type(names), "join", lambda self, *a, **k: made.append(real(self, *a, **k)) or made[-1])
    got = {r["id"]: (r["step"], r["map_id"]) for r in resolve.exact_resolution(names, table).collect()}
    assert got == {k: (0, k) if k >= 40 else (1, 40) for k in range(50)}
    assert made and all(d.count() <= 50 for d in made)
