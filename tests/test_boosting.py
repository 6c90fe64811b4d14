"""Boosted trees of many fits in one plan against fits one by one, and against plain loops over rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import boosting, models
from touchline.operators.stage import stage_in


def rows(n=240):
    r = np.random.default_rng(1)
    out = []
    for i in range(n):
        x = r.normal(size=3)
        y = float(x[0] > 0) + 0.3 * float(x[1]) + 0.05 * float(r.normal())
        out.append((i, i % 6, float(x[0]), None if i % 17 == 0 else float(x[1]), float(round(x[2])), y, float(y > 0.4)))
    return out


def plain(x, y, forest, fit, draw):
    """The same trees by loops: x: rows of bins, y: labels of the fit's rows."""
    margin = np.full(len(y), (np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if fit.logistic else y.mean()))
    value = lambda g, h: -fit.step * g / (h + boosting.PENALTY)
    for t in range(fit.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y, p * (1 - p)) if fit.logistic else (margin - y, np.ones(len(y)))
        used = boosting._drawn(draw, t, fit.subsample)
        leaves = [(np.arange(len(y)), 0.0)]
        for _ in range(fit.depth):
            new = []
            for at, old in leaves:
                own = at[used[at]]
                worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + boosting.PENALTY)
                best = (1e-9, None, None)
                for f in range(x.shape[1]):
                    for cut in range(boosting.BINS - 1):
                        left, right = own[x[own, f] <= cut], own[x[own, f] > cut]
                        if h[left].sum() > 1e-9 and h[right].sum() > 1e-9:
                            gain = round(worth(left) + worth(right) - worth(own), 9)
                            if gain > best[0]:
                                best = (gain, f, cut)
                if best[1] is None:
                    new.append((at, value(g[own].sum(), h[own].sum()) if len(own) else 0.0))
                    continue
                for side in (x[:, best[1]] <= best[2], x[:, best[1]] > best[2]):
                    rows_in = at[side[at]]
                    new.append((rows_in, value(g[rows_in[used[rows_in]]].sum(), h[rows_in[used[rows_in]]].sum())))
            leaves = new
        for at, v in leaves:
            margin[at] += v
    return margin


@pytest.fixture(scope="module")
def data(spark):
    df = spark.createDataFrame(rows(), "i int, part int, a double, b double, c double, y double, z double").repartition(3)
    stage = stage_in(spark)
    return boosting.binned(df, ["a", "b", "c"], ["y", "z"], [F.col("part") != 0, F.col("part") < 4], ["i", "part"], stage), stage


FITS = [boosting.Fit("y", ("a", "b"), 0, trees=3, depth=2), boosting.Fit("z", ("c", "a", "b"), 1, True, trees=5, depth=3, subsample=1.0), boosting.Fit("y", ("a", "b", "c"), 1, trees=4, depth=1, step=0.3)]


def test_equals_plain_loops(data, spark):
    held, stage = data
    forests = boosting.fit_all(held, FITS, stage)
    table = sorted(held.rows.collect(), key=lambda r: r["i"])
    x = np.array([list(r["bins"]) for r in table])
    draw = np.array([r["draw"] for r in table], np.int64)
    for k, f in enumerate(FITS):
        mine = np.array([bool(r["folds"][f.fold]) for r in table])
        y = np.array([r["labels"][0 if f.label == "y" else 1] for r in table])
        own = x[mine][:, [("a", "b", "c").index(c) for c in f.inputs]]
        got = np.array([boosting._margin(forests[k], x[mine].astype(np.uint8))]).ravel()
        assert np.allclose(got, plain(own, y[mine], forests[k], f, draw[mine]))


def test_one_by_one_and_rewritten_margins_change_nothing(data, monkeypatch):
    held, stage = data
    x = np.random.default_rng(2).integers(0, boosting.BINS, (200, 3)).astype(np.uint8)
    together = boosting.fit_all(held, FITS, stage)
    monkeypatch.setattr(boosting, "KEEP", 2)
    for k, f in enumerate(FITS):
        alone = boosting.fit_all(held, [f], stage)[0]
        assert np.allclose(boosting._margin(alone, x), boosting._margin(together[k], x))


def test_predictions_and_errors(data):
    held, stage = data
    forests = boosting.fit_all(held, FITS, stage)
    got = {r["i"]: (r["p"], r["q"]) for r in boosting.predicted(held, FITS, forests, {"p": [0, 2], "q": [1, 1]}, F.when(F.col("part") < 3, F.col("part") % 2)).collect()}
    table = {r["i"]: r for r in held.rows.collect()}
    assert set(got) == {i for i, r in table.items() if r["part"] < 3}
    for i, (p, q) in got.items():
        x = np.array([list(table[i]["bins"])], np.uint8)
        assert p == pytest.approx(boosting._margin(forests[[0, 2][table[i]["part"] % 2]], x)[0]) and q == pytest.approx(1 / (1 + np.exp(-boosting._margin(forests[1], x)[0])))
    out = [r for r in table.values() if r["part"] == 0]
    want = np.mean([abs(boosting._margin(forests[0], np.array([list(r["bins"])], np.uint8))[0] - r["labels"][0]) for r in out])
    assert boosting.errors(held, FITS, forests)[0] == pytest.approx(want)


def test_the_grid_learns_and_halves(spark):
    df = spark.createDataFrame(rows(), "i int, part int, a double, b double, c double, y double, z double")
    best, table = models.boosted_grid(df, ["a", "b", "c"], "y", ["i"], (5, 20), (1, 3), (0.1, 0.3))
    got = table.collect()
    assert len(got) == 8 and sum(r["error"] is not None for r in got) == 6 and best["trees"] == 20 and best["error"] < 0.2 < np.std([r[5] for r in rows()])
    full = {tuple(r)[:4]: r["error"] for r in models.boosted_grid(df, ["a", "b", "c"], "y", ["i"], (5, 20), (1, 3), (0.1, 0.3), halving=False)[1].collect()}
    assert all(r["error"] is None or r["error"] == pytest.approx(full[tuple(r)[:4]]) for r in got) and None not in full.values()


def test_backtest_folds_see_earlier_periods_only(spark):
    from touchline.plans import project

    d = "/root/testdata/sf0.001"
    stats, players = project.stats(spark, d).filter("gameweek <= 9"), project.players(spark, d)
    one = models.full_backtest(stats, players, [8], trees=3, depth=2)[0]
    # Labels of later periods do not matter; later rows only move the cuts, so the same rows stay.
    changed = stats.withColumns({c: F.when(F.col("gameweek") >= 8, F.col(c) * 0).otherwise(F.col(c)) for c in ("xg", "xa", "clean_sheets")})
    frame = models.training_frame(stats, players)
    stage = stage_in(spark)
    ids = ("season", "player_id", "gameweek")
    fits = [boosting.Fit("label_xg", tuple(models.ATTACK_INPUTS), 0, trees=3, depth=2)]
    made = []
    for s in (stats, changed):
        labels = models.training_frame(s, players).select(*ids, F.col("label_xg").alias("l"))
        held = boosting.binned(frame.drop("label_xg").join(labels.withColumnRenamed("l", "label_xg"), list(ids)), models.ATTACK_INPUTS, ["label_xg"], [F.col("gameweek") < 8], ids, stage)
        forests = boosting.fit_all(held, fits, stage)
        made.append({(r["player_id"], r["gameweek"]): r["p"] for r in boosting.predicted(held, fits, forests, {"p": [0]}).collect()})
    assert made[0] == made[1] and one.select("gameweek").distinct().collect()[0][0] == 8


def test_places_equal_a_walk_and_inputs_of_few_bins_share_codes():
    r = np.random.default_rng(3)
    for depth in (1, 3, 5):
        size = 2 ** (depth + 1) - 1
        tree = (r.integers(0, 4, size), np.where(r.random(size) < 0.2, 255, r.integers(0, 31, size)), r.normal(size=size))
        x = r.integers(0, boosting.BINS, (300, 4)).astype(np.uint8)
        node = np.zeros(300, np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[np.arange(300), tree[0][node]] > tree[1][node])
        assert (boosting._places(tree, np.ascontiguousarray(x.T), depth) == node - (2**depth - 1)).all()
        assert boosting._margin(boosting.Forest(0.5, [tree]), x) == pytest.approx(0.5 + tree[2][node])
    sizes = [32, 3, 3, 14, 1, 32]
    groups = boosting._together(sizes)
    assert sorted(k for g in groups for k in g) == list(range(len(sizes))) and len(groups) == 2 and all(np.prod([sizes[k] for k in g]) <= boosting.CODES for g in groups)
