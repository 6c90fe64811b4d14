"""Squads, elevens, captains, plans."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import by_position

# How many of each position a squad has, and an eleven at least and at most.
QUOTA = {"GK": 2, "DEF": 5, "MID": 5, "FWD": 3}
LEAST = {"GK": 1, "DEF": 3, "MID": 2, "FWD": 1}
MOST = {"GK": 1, "DEF": 5, "MID": 5, "FWD": 3}
PER_TEAM = 3
ORDER = ["GK", "DEF", "MID", "FWD"]


def limit_of(table: dict[str, int], position: str = "position") -> Column:
    return by_position(position, *(table[p] for p in ORDER))


def pruned(df: DataFrame, key: str = "gameweek") -> DataFrame:
    """Rows that a greedy squad can still choose: of a team and position the three best (of team 0, as many as the quota). What is left is bounded by teams and positions."""
    w = Window.partitionBy(key, "position", "team_id").orderBy(F.col("xp").desc(), "player_id")
    cap = F.when(F.col("team_id") == 0, limit_of(QUOTA)).otherwise(F.least(limit_of(QUOTA), F.lit(PER_TEAM)))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")


def greedy_squads(df: DataFrame, key: str = "gameweek") -> DataFrame:
    """For each key: players by xp, within the position quota and three a team, up to fifteen."""
    cols = [key, "player_id", "position", "team_id", "price", "xp"]
    small = pruned(df.select(*cols), key)
    schema = small.select(*cols).schema

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["xp", "player_id"], ascending=[False, True], kind="stable")
        places, teams, rows = dict.fromkeys(QUOTA, 0), {}, []
        for i, (position, team) in enumerate(zip(pdf["position"], pdf["team_id"])):
            if places[position] < QUOTA[position] and (team == 0 or teams.get(team, 0) < PER_TEAM):
                places[position] += 1
                teams[team] = teams.get(team, 0) + 1
                rows.append(i)
                if len(rows) == sum(QUOTA.values()):
                    break
        return pdf.iloc[rows]

    return small.groupBy(key).applyInPandas(choose, schema)


def starting_xi(squads: DataFrame, keys: Sequence[str] = ("gameweek",)) -> DataFrame:
    """The eleven: the minimum of each position, then the best others within the maximum. All by windows."""
    own = Window.partitionBy(*keys, "position").orderBy(F.col("xp").desc(), "player_id")
    df = squads.withColumn("_p", F.row_number().over(own))
    sure = F.col("_p") <= limit_of(LEAST)
    free = ~sure & (F.col("_p") <= limit_of(MOST))
    kind = F.when(sure, 0).when(free, 1).otherwise(2)
    df = df.withColumn("_k", kind)
    df = df.withColumn("_sure", F.sum(F.when(sure, 1).otherwise(0)).over(Window.partitionBy(*keys)))
    df = df.withColumn("_f", F.row_number().over(Window.partitionBy(*keys, "_k").orderBy(F.col("xp").desc(), "player_id")))
    return df.filter((F.col("_k") == 0) | ((F.col("_k") == 1) & (F.col("_f") <= 11 - F.col("_sure")))).drop("_p", "_k", "_f", "_sure")


def formation(xi: DataFrame, keys: Sequence[str] = ("gameweek",)) -> DataFrame:
    n = lambda p: F.count_if(F.col("position") == p).cast("string")
    return xi.groupBy(*keys).agg(F.concat_ws("-", n("DEF"), n("MID"), n("FWD")).alias("formation"), F.sum("xp").alias("total_xp"), F.count("*").alias("players"))


def captains(xi: DataFrame, keys: Sequence[str] = ("gameweek",)) -> DataFrame:
    """Captain: highest xp * p_start; vice: the next of another position, else the second."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "player_id")
    df = xi.withColumn("score", F.col("xp") * F.coalesce(F.col("p_start"), F.lit(0.7)))
    df = df.withColumn("_r", F.row_number().over(w)).withColumn("_c", F.first("position").over(w))
    other = F.min_by("player_id", F.when((F.col("_r") > 1) & (F.col("position") != F.col("_c")), F.col("_r")))
    pick = lambda k, c: F.max(F.when(F.col("_r") == k, F.col(c)))
    return df.groupBy(*keys).agg(pick(1, "player_id").alias("captain_id"), F.coalesce(other, pick(2, "player_id")).alias("vice_id"), pick(1, "score").alias("captain_score"))


def shown_captains(xi: DataFrame, keys: Sequence[str] = ("gameweek",)) -> DataFrame:
    """First and second by xp, as the board shows them."""
    df = xi.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("xp").desc(), "player_id"))).filter("_r <= 2")
    pick = lambda k: F.max(F.when(F.col("_r") == k, F.col("player_id")))
    return df.groupBy(*keys).agg(pick(1).alias("captain_id"), pick(2).alias("vice_id"))


# ---------------------------------------------------------------- plans

def transfers(squads: DataFrame, current: DataFrame | None = None, key: str = "plan_id") -> DataFrame:
    """plan, week, player, kind in or out, against the week before (week 0: the current squad). Weeks are consecutive."""
    have = squads.select(key, "week", "player_id")
    if current is not None:
        have = have.unionByName(current.select(key, F.lit(0).alias("week"), "player_id"))
    spans = squads.groupBy(key).agg(F.max("week").alias("_last"), (F.lit(0) if current is not None else F.min("week")).alias("_first"))
    moved = have.withColumn("week", F.col("week") + 1)
    into = have.join(moved, [key, "week", "player_id"], "left_anti").withColumn("kind", F.lit("in"))
    out = moved.join(have, [key, "week", "player_id"], "left_anti").withColumn("kind", F.lit("out"))
    return into.unionByName(out).join(spans, key).filter((F.col("week") > F.col("_first")) & (F.col("week") <= F.col("_last"))).drop("_first", "_last")


def evaluate_plans(squads: DataFrame, current: DataFrame | None = None, free: int = 1, penalty: float = 4.0, discount: float = 0.9, key: str = "plan_id") -> DataFrame:
    """Per plan and week: transfers (ins and outs both count), extra ones, their cost, points of the eleven and discounted, budget used."""
    moves = transfers(squads, current, key).groupBy(key, "week").agg(F.count("*").alias("transfers"))
    week = squads.groupBy(key, "week").agg(F.sum(F.when(F.col("in_xi"), F.col("xp")).otherwise(0.0)).alias("week_xp"), F.sum("price").alias("budget_used"))
    df = week.join(moves, [key, "week"], "left").withColumn("transfers", F.coalesce("transfers", F.lit(0)))
    df = df.withColumn("extra", F.greatest(F.lit(0), F.col("transfers") - free)).withColumn("cost", F.col("extra") * penalty)
    return df.withColumn("discounted_xp", F.col("week_xp") * F.pow(F.lit(discount), F.col("week") - 1))


def plan_violations(squads: DataFrame, budget: float = 100.0, locked: Sequence[int] = (), excluded: Sequence[int] = (), key: str = "plan_id") -> DataFrame:
    """plan, week, rule, value for every rule that a squad breaks: sizes, positions, eleven, budget, teams, locked and excluded players."""
    n = lambda cond: F.count_if(cond)
    pos, xi = F.col("position"), F.col("in_xi")
    week = squads.groupBy(key, "week").agg(
        F.count("*").alias("squad_size"), n(xi).alias("xi_size"), F.sum("price").alias("budget"),
        *[n(pos == p).alias(f"squad_{p}") for p in ORDER], *[n(xi & (pos == p)).alias(f"xi_{p}") for p in ORDER],
        *[n(F.col("player_id") == p).alias(f"locked_{p}") for p in locked], *[n(F.col("player_id") == p).alias(f"excluded_{p}") for p in excluded],
    )
    least = {"GK": 1, "DEF": 3, "MID": 3, "FWD": 1}
    rules = {"squad_size": F.col("squad_size") != 15, "xi_size": F.col("xi_size") != 11, "budget": F.col("budget") > budget}
    rules |= {f"squad_{p}": F.col(f"squad_{p}") != QUOTA[p] for p in ORDER} | {f"xi_{p}": F.col(f"xi_{p}") < least[p] for p in ORDER}
    rules |= {f"locked_{p}": F.col(f"locked_{p}") == 0 for p in locked} | {f"excluded_{p}": F.col(f"excluded_{p}") > 0 for p in excluded}
    found = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).cast("double").alias("value"), cond.alias("broken")) for k, cond in rules.items()])
    flags = week.select(key, "week", F.explode(found).alias("f")).filter("f.broken").select(key, "week", "f.rule", "f.value")
    teams = squads.groupBy(key, "week", "team_id").agg(F.count("*").alias("n")).filter(F.col("n") > PER_TEAM)
    return flags.unionByName(teams.select(key, "week", F.lit("team").alias("rule"), F.col("n").cast("double").alias("value")))


def score_plans(squads: DataFrame, current: DataFrame | None = None, budget: float = 100.0, scenario: str | None = None, key: str = "plan_id", **rules) -> DataFrame:
    """Plans by discounted points less transfer cost, feasible or not, the best feasible of each scenario marked."""
    e = evaluate_plans(squads, current, key=key, **rules).groupBy(key).agg((F.sum("discounted_xp") - F.sum("cost")).alias("score"))
    bad = plan_violations(squads, budget, key=key).groupBy(key).agg(F.count("*").alias("violations"))
    df = e.join(bad, key, "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    if scenario:
        df = df.join(squads.select(key, scenario).distinct(), key)
    w = Window.partitionBy(*([scenario] if scenario else []))
    best = F.max_by(key, F.when(F.col("violations") == 0, F.struct("score", -F.col(key)))).over(w)
    return df.withColumn("best", F.coalesce(F.col(key) == best, F.lit(False)))


def swap_candidates(squad: DataFrame, pool: DataFrame, budget: float = 100.0, key: str = "plan_id") -> DataFrame:
    """One-transfer swaps: a member out, a player of the same position in who is not in the squad, within budget and three a team."""
    total = squad.groupBy(key).agg(F.sum("price").alias("_spent"))
    teams = squad.groupBy(key, "team_id").agg(F.count("*").alias("_n"))
    out = squad.select(key, F.col("player_id").alias("out_id"), "position", F.col("price").alias("_out"), F.col("team_id").alias("_team"), F.col("xp").alias("_xp"))
    cand = pool.select(F.col("player_id").alias("in_id"), "position", "price", "team_id", "xp")
    pairs = out.join(cand, "position").join(squad.select(key, F.col("player_id").alias("in_id")), [key, "in_id"], "left_anti")
    pairs = pairs.join(total, key).filter(F.col("_spent") - F.col("_out") + F.col("price") <= budget).join(teams, [key, "team_id"], "left")
    room = F.coalesce("_n", F.lit(0)) - F.when(F.col("_team") == F.col("team_id"), 1).otherwise(0) < PER_TEAM
    return pairs.filter(room).select(key, "out_id", "in_id", (F.col("xp") - F.col("_xp")).alias("gain"), (F.col("price") - F.col("_out")).alias("cost_change"))


def week_arrays(players: DataFrame, weekly: DataFrame, weeks: int = 3) -> DataFrame:
    """player_id with arrays of xp and p_start for weeks 1 to n; a missing week takes week 1, a missing player 0 and 0.7."""
    long = weekly.filter(F.col("week") <= weeks).groupBy("player_id").agg(F.map_from_entries(F.collect_list(F.struct("week", F.struct("xp", "p_start")))).alias("_m"))
    df = players.select("player_id").join(long, "player_id", "left")
    value = lambda c, default: F.transform(F.sequence(F.lit(1), F.lit(weeks)), lambda k: F.coalesce(F.try_element_at("_m", k)[c], F.try_element_at("_m", F.lit(1))[c], F.lit(default)))
    return df.select("player_id", value("xp", 0.0).alias("expected_points"), value("p_start", 0.7).alias("p_start"))


def heatmap(squads: DataFrame, weeks: Sequence[int], most: float = 15.0, key: str = "plan_id") -> DataFrame:
    """A row for each player of a plan in position order, a band 1 to 5 of the week's xp for each week (0: not in the squad)."""
    share = F.col("xp") / most
    band = F.when(share >= 0.8, 5).when(share >= 0.6, 4).when(share >= 0.4, 3).when(share >= 0.2, 2).otherwise(1)
    df = squads.withColumn("_b", band).groupBy(key, "player_id", "position").pivot("week", list(weeks)).agg(F.max("_b"))
    for w in weeks:
        df = df.withColumnRenamed(str(w), f"week_{w}")
    return df.fillna(0, [f"week_{w}" for w in weeks]).withColumn("position_order", by_position("position", 1, 2, 3, 4))


def bench(squads: DataFrame, xi: DataFrame, keys: Sequence[str] = ("plan_id", "week")) -> DataFrame:
    """Squad less eleven."""
    return squads.join(xi.select(*keys, "player_id"), [*keys, "player_id"], "left_anti")


def squad_values(stats: DataFrame, predictions: DataFrame, players: DataFrame) -> DataFrame:
    """Per period, the points that a greedy squad by predictions would have scored, and its price."""
    price = F.when(F.col("price") > 100, F.col("price") / 10).otherwise(F.col("price"))
    df = predictions.select("player_id", "gameweek", "xp").join(stats.select("player_id", "gameweek", "total_points", "opponent_team"), ["player_id", "gameweek"])
    df = df.join(players.select("player_id", "position", "team_id", price.alias("price")), "player_id").withColumn("team_id", F.coalesce("team_id", "opponent_team"))
    chosen = greedy_squads(df)
    xi = starting_xi(chosen).join(df.select("player_id", "gameweek", "total_points"), ["player_id", "gameweek"])
    return xi.groupBy("gameweek").agg(F.sum("total_points").alias("points"), F.count("*").alias("xi_size")).join(chosen.groupBy("gameweek").agg(F.sum("price").alias("price"), F.count("*").alias("squad_size")), "gameweek")


def plan_records(squads: DataFrame, key: str = "plan_id") -> DataFrame:
    """One JSON record a plan: weeks with squad and eleven. A squad is fifteen rows, a plan a few weeks."""
    week = squads.groupBy(key, "week").agg(F.sort_array(F.collect_list("player_id")).alias("squad"), F.sort_array(F.collect_list(F.when(F.col("in_xi"), F.col("player_id")))).alias("xi"), F.round(F.sum(F.when(F.col("in_xi"), F.col("xp"))), 4).alias("points"))
    return week.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct("week", "squad", "xi", "points")))).alias("record"), F.round(F.sum("points"), 4).alias("total_points"), F.count("*").alias("horizon"))
