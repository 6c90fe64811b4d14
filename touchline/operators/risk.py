"""Ownership risk, captains and chips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import clip, mean_of

XP, OWN = "expected_points", "ownership_percent"
PRICE_RANGE = 2.0


def over_owned(df: DataFrame, least_owned: float = 20.0, most_xp: float = 5.0) -> DataFrame:
    value = F.when(F.col("price") > 0, F.col(XP) / F.col("price")).otherwise(0.0)
    return df.filter((F.col(OWN) >= least_owned) & (F.col(XP) <= most_xp)).withColumn("value", value)


def alternatives(targets: DataFrame, pool: DataFrame, most_owned: float = 20.0, better: float = 1.0, k: int = 5, price_range: float = PRICE_RANGE) -> DataFrame:
    """For each target the k best others of its position within the price range, owned less and expected to score more.

    Which of two players is better does not depend on the target, so of each position and price only the k + 1 best can be in any answer (one more, as a target is no alternative
    to itself). Prices are cut into buckets of the range's width; a target meets what is left of its own bucket and both neighbours by an equi-join: with prices in tenths at most
    some 60 * (k + 1) rows, however many players there are.
    """
    width = max(price_range, 0.1)
    t = targets.select(F.col("player_id").alias("target_id"), "position", F.col("price").alias("_p"), F.col(XP).alias("_xp"))
    t = t.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("_p") / width) + i)))
    best = Window.partitionBy("position", "price").orderBy(F.col(XP).desc(), "player_id")
    p = pool.filter(F.col(OWN) < most_owned).withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= k + 1).drop("_k").withColumn("_b", F.floor(F.col("price") / width))
    pairs = t.join(p, ["position", "_b"]).filter((F.col("player_id") != F.col("target_id")) & (F.abs(F.col("price") - F.col("_p")) <= price_range) & (F.col(XP) - F.col("_xp") >= better))
    pairs = pairs.withColumn("improvement", F.col(XP) - F.col("_xp")).withColumn("value", F.when(F.col("price") > 0, F.col(XP) / F.col("price")).otherwise(0.0))
    w = Window.partitionBy("target_id").orderBy(F.col("improvement").desc(), F.col("value").desc(), "player_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("target_id", "player_id", "rank", "improvement", "value", "price", OWN)


def arbitrage_report(df: DataFrame, top: int = 10, advised: int = 5) -> DataFrame:
    """The most over-owned players that have an alternative: the best one, the gain, and advice for the first few. The report is a top list, hence its limit."""
    first = over_owned(df).orderBy(F.col(OWN).desc(), XP, "player_id").limit(top)
    best = alternatives(first, df).groupBy("target_id").agg(F.min_by("player_id", "rank").alias("best_id"), F.max("improvement").alias("potential_gain"), F.count("*").alias("n_alternatives"))
    out = first.join(best, first["player_id"] == best["target_id"]).drop("target_id")
    place = F.row_number().over(Window.orderBy(F.col(OWN).desc(), XP, "player_id"))  # ten rows
    out = out.withColumn("place", place).withColumn("total_gain", F.sum("potential_gain").over(Window.partitionBy()))
    text = F.format_string("Consider %s in place of %s (+%.1f points)", F.col("best_id").cast("string"), F.col("name"), F.col("potential_gain"))
    return out.select("place", "player_id", "best_id", "n_alternatives", "potential_gain", "total_gain", F.when(F.col("place") <= advised, text).alias("advice"))


def no_play(status: str = "status", minutes: str = "expected_minutes", rotation: str = "rotation_risk", recent: str = "recent_minutes") -> Column:
    """Probability of not playing."""
    s = F.lower(F.coalesce(F.col(status), F.lit("a")))
    base = F.when(s.isin("a", "n"), 0.0).when(s == "d", 0.15).when(s.isin("i", "s"), 0.95).otherwise(0.05)
    m = F.coalesce(F.col(minutes), F.lit(90.0))
    few = F.when(m < 60, 0.10).when(m < 90, 0.05).otherwise(0.0)
    low = F.when((F.size(recent) >= 3) & (mean_of(F.slice(recent, 1, 3)) < 60), 0.10).otherwise(0.0)
    return clip(base + few + F.coalesce(F.col(rotation), F.lit(0.0)) * 0.20 + low, 0.0, 1.0)


def pair_values(pairs: DataFrame) -> DataFrame:
    """pairs: c_xp, c_no, v_xp, v_no. With the weighted and risk-adjusted values of the pair, of the swapped pair, and the gain of swapping."""
    value = lambda p, a, b: (1 - p) * 2 * a + p * 2 * b
    c, cn, v, vn = (F.col(k) for k in ("c_xp", "c_no", "v_xp", "v_no"))
    df = pairs.withColumn("weighted_value", value(cn, c, v)).withColumn("swapped_value", value(vn, v, c))
    df = df.withColumn("risk_adjusted", F.col("weighted_value") - 2 * cn).withColumn("swapped_risk_adjusted", F.col("swapped_value") - 2 * vn)
    return df.withColumn("should_swap", F.col("swapped_risk_adjusted") > F.col("risk_adjusted")).withColumn("swap_gain", F.col("swapped_risk_adjusted") - F.col("risk_adjusted"))


def best_captains(candidates: DataFrame, group: str = "group_id", top: int = 5) -> DataFrame:
    """The best captain and vice-captain of each group: the five with the most points as captains, anyone else as vice.

    For a given captain the value grows with the vice's points, so only the two best
    players of a group can be a best vice: five captains meet two vices, not the group.
    """
    w = Window.partitionBy(group).orderBy(F.col(XP).desc(), "player_id")
    ranked = candidates.withColumn("_no", no_play()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top)
    c = ranked.select(group, F.col("player_id").alias("captain_id"), F.col(XP).alias("c_xp"), F.col("_no").alias("c_no"), F.col("_r").alias("_c"))
    v = ranked.filter("_r <= 2").select(group, F.col("player_id").alias("vice_id"), F.col(XP).alias("v_xp"), F.col("_no").alias("v_no"), F.col("_r").alias("_v"))
    pairs = pair_values(c.join(v, group).filter(F.col("captain_id") != F.col("vice_id")))
    best = pairs.groupBy(group).agg(F.max_by(F.struct(*[x for x in pairs.columns if x not in (group, "_c", "_v")]), F.struct("risk_adjusted", -F.col("_c"), -F.col("_v"))).alias("b"))
    return best.select(group, "b.*")


def captain_value(df: DataFrame) -> DataFrame:
    """Expected value of captain and vice: xp_c * p + xp_v * (1 - p)."""
    a, b = F.col("c_xp") * F.col("p_start"), F.col("v_xp") * (1 - F.col("p_start"))
    return df.withColumns({"captain_part": a, "vice_part": b, "expected_value": a + b})


def overvalued_by_ratio(df: DataFrame, least_owned: float = 15.0, most: float = 0.3, k: int = 20) -> DataFrame:
    """The k most owned players whose points per owned percent stay below the limit."""
    ratio = F.when(F.col(OWN) > 0, F.col(XP) / F.col(OWN)).otherwise(0.0)
    return df.withColumn("ratio", ratio).filter((F.col(OWN) >= least_owned) & (F.col("ratio") < most)).orderBy(F.col(OWN).desc(), "ratio", "player_id").limit(k)


# ---------------------------------------------------------------- chips

def _ranked_weeks(squads: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return squads.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "week").orderBy(F.col("xp").desc(), "player_id")))


def week_values(squads: DataFrame, keys: tuple[str, ...] = ("plan_id",)) -> DataFrame:
    """Per squad and week: points of the best eleven, of ranks 12 to 15, and players."""
    r = _ranked_weeks(squads, keys)
    return r.groupBy(*keys, "week").agg(F.sum(F.when(F.col("_r") <= 11, F.col("xp")).otherwise(0.0)).alias("best_xi"), F.sum(F.when(F.col("_r").between(12, 15), F.col("xp")).otherwise(0.0)).alias("bench"), F.count("*").alias("players"))


def wildcard_value(current: DataFrame, optimised: DataFrame, keys: tuple[str, ...] = ("plan_id",), weeks: int = 5, last: int = 38, threshold: float = 20.0) -> DataFrame:
    """Best-eleven points over the coming weeks, optimised against current."""
    total = lambda df, name: week_values(df, keys).filter((F.col("week") <= weeks) & (F.col("week") <= last)).groupBy(*keys).agg(F.sum("best_xi").alias(name))
    df = total(current, "current").join(total(optimised, "optimised"), list(keys))
    return df.withColumn("gain", F.col("optimised") - F.col("current")).withColumn("recommended", F.col("gain") >= threshold)


def bench_boost_value(squads: DataFrame, keys: tuple[str, ...] = ("plan_id",), threshold: float = 15.0) -> DataFrame:
    """Points of the bench by week; 0 for squads below fifteen."""
    df = week_values(squads, keys).withColumn("gain", F.when(F.col("players") >= 15, F.col("bench")).otherwise(0.0))
    return df.withColumn("mean_bench", F.col("gain") / 4).withColumn("recommended", F.col("gain") >= threshold).select(*keys, "week", "gain", "mean_bench", "recommended")


def free_hit_value(current: DataFrame, optimised: DataFrame, week: int, keys: tuple[str, ...] = ("plan_id",), threshold: float = 10.0) -> DataFrame:
    """Best-eleven difference for one week."""
    one = lambda df, name: week_values(df.filter(F.col("week") == week), keys).select(*keys, F.col("best_xi").alias(name))
    df = one(current, "current").join(one(optimised, "optimised"), list(keys))
    return df.withColumn("gain", F.col("optimised") - F.col("current")).withColumn("recommended", F.col("gain") >= threshold)


def all_chips(current: DataFrame, optimised: DataFrame, week: int, keys: tuple[str, ...] = ("plan_id",)) -> DataFrame:
    """chip, gain, recommended for each squad, with the best playable chip marked."""
    rows = wildcard_value(current, optimised, keys).select(*keys, F.lit("wildcard").alias("chip"), "gain", "recommended")
    rows = rows.unionByName(bench_boost_value(current, keys).filter(F.col("week") == week).select(*keys, F.lit("bench_boost").alias("chip"), "gain", "recommended"))
    rows = rows.unionByName(free_hit_value(current, optimised, week, keys).select(*keys, F.lit("free_hit").alias("chip"), "gain", "recommended"))
    best = F.max_by("chip", F.when(F.col("recommended"), F.struct("gain", "chip"))).over(Window.partitionBy(*keys))
    return rows.withColumn("best", F.coalesce(F.col("chip") == best, F.lit(False)))


def wildcard_trigger(current: DataFrame, optimised: DataFrame, keys: tuple[str, ...] = ("plan_id",), horizon: int = 5, threshold: float = 20.0) -> DataFrame:
    """Whole-squad points times the horizon."""
    total = lambda df, name: df.groupBy(*keys).agg((F.sum("xp") * horizon).alias(name))
    df = total(current, "current").join(total(optimised, "optimised"), list(keys))
    return df.withColumn("gain", F.col("optimised") - F.col("current")).withColumn("use_wildcard", F.col("gain") >= threshold)


def strategy_notes(squad: DataFrame, overvalued: DataFrame, captains: DataFrame, totals: DataFrame, keys: tuple[str, ...] = ("plan_id",)) -> DataFrame:
    """Notes per squad: overvalued members, a weak captain (expected value below 10), a low net total (below 50)."""
    a = squad.join(overvalued.select("player_id"), "player_id", "left_semi").select(*keys, F.lit("overvalued").alias("note"), F.col("player_id").cast("double").alias("value"))
    b = captains.filter(F.col("expected_value") < 10).select(*keys, F.lit("weak_captain").alias("note"), F.col("expected_value").alias("value"))
    c = totals.filter(F.col("net") < 50).select(*keys, F.lit("low_total").alias("note"), F.col("net").alias("value"))
    return a.unionByName(b).unionByName(c)
