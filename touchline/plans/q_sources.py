"""Sources and sinks (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.plans import project as P
from touchline.plans.registry import query, r
from touchline.sources import ingest, ledger, upsert


def bootstrap(spark, d):
    """Documents as they land, one a league; leagues are the remainders of the player id."""
    p = P.players(spark, d, every=True).withColumn("league", (F.col("player_id") % 40).cast("string"))
    element = F.struct(
        F.col("player_id").alias("id"), F.col("name").alias("web_name"), F.lit("Ann ").alias("first_name"), F.col("name").alias("second_name"), F.col("team_id").alias("team"),
        (F.when(F.col("position") == "GK", 1).when(F.col("position") == "DEF", 2).when(F.col("position") == "MID", 3).otherwise(7)).cast("long").alias("element_type"),
        F.round(F.col("price") * 10).cast("long").alias("now_cost"), "status", F.col("ownership").cast("string").alias("selected_by_percent"), F.lit("x").alias("form"), (F.col("player_id") % 90).alias("minutes"),
    )
    teams = P.teams(spark, d).agg(F.collect_list(F.struct(F.col("team_id").alias("id"), F.col("team_name").alias("name"), "short_name", "strength", "strength_attack_home", "strength_attack_away", "strength_defence_home", "strength_defence_away")).alias("teams"))
    kinds = F.array(*[F.struct(F.lit(k).cast("long").alias("id"), F.lit(n).alias("singular_name_short")) for k, n in enumerate(("GKP", "DEF", "MID"), 1)])
    last = F.col("league").cast("int") % 38 + 1
    events = F.transform(F.sequence(F.lit(1), F.lit(38)), lambda k: F.struct(k.cast("long").alias("id"), ((k == last) & (F.col("league").cast("int") % 2 == 0)).alias("is_current"), ((k == last + 1) & (F.col("league").cast("int") % 3 == 0)).alias("is_next"), (k < last).alias("finished")))
    return p.groupBy("league").agg(F.collect_list(element).alias("elements")).join(F.broadcast(teams)).withColumn("element_types", kinds).withColumn("events", events)


@query("i1_players", P.ctes(P.ALL_PLAYERS, P.TEAMS) + "SELECT CAST(player_id % 40 AS VARCHAR) AS league, player_id, 'Ann  ' || name AS full_name, CASE position WHEN 'GK' THEN 'GKP' WHEN 'FWD' THEN 'UNKNOWN' ELSE position END AS position, team_name, round(price * 10) / 10.0 AS price, ownership AS selected_by_percent, CAST(0 AS DOUBLE) AS form, player_id % 90 AS minutes FROM players LEFT JOIN teams USING (team_id)")
def i1(spark, d):
    return ingest.extract_players(bootstrap(spark, d)).select("league", "player_id", "full_name", "position", "team_name", "price", "selected_by_percent", "form", "minutes")


@query("i2_i16_teams", P.ctes(P.TEAMS) + "SELECT CAST(l AS VARCHAR) AS league, team_id, team_name AS name, CAST((strength_attack_home + strength_attack_away) / 2 AS INTEGER) AS strength_attack, CAST((strength_defence_home + strength_defence_away) / 2 AS INTEGER) AS strength_defense FROM teams, (SELECT DISTINCT c_custkey % 40 AS l FROM customer)")
def i2(spark, d):
    t = ingest.extract_teams(bootstrap(spark, d))
    s = ingest.teams_for_store(t.filter("league = '0'")).select("team_id", "strength_attack", "strength_defense")
    return t.join(s, "team_id").select("league", "team_id", "name", "strength_attack", "strength_defense")


def histories(spark, d):
    s = P.stats(spark, d)
    match = F.struct(F.col("gameweek").cast("long").alias("round"), F.col("gameweek").cast("long").alias("fixture"), "opponent_team", "was_home", "minutes", "total_points", (F.col("player_id") % 60 + 40).alias("value"), F.col("goals").alias("goals_scored"), "assists", F.col("xg").cast("string").alias("expected_goals"))
    return s.groupBy((F.col("player_id") % 40).cast("string").alias("league"), "player_id").agg(F.collect_list(match).alias("history"))


@query("i3_history", P.ctes(P.STATS) + "SELECT player_id, gameweek::BIGINT AS gameweek, minutes, CAST(CASE WHEN minutes > 90 THEN 2 ELSE 1 END AS INTEGER) AS matches_played, CASE WHEN minutes > 90 THEN total_points / CAST(2 AS DOUBLE) ELSE total_points END AS normalized_points, (player_id % 60 + 40) / CAST(10 AS DOUBLE) AS price, xg AS expected_goals FROM stats")
def i3(spark, d):
    return ingest.extract_history(histories(spark, d)).select("player_id", "gameweek", "minutes", "matches_played", "normalized_points", "price", "expected_goals")


@query("i4_current_period", "SELECT CAST(l AS VARCHAR) AS league, CASE WHEN l % 2 = 0 THEN l % 38 + 1 WHEN l % 3 = 0 AND l % 38 + 2 <= 38 THEN l % 38 + 2 WHEN l % 38 > 0 THEN l % 38 END AS current, CASE WHEN l % 3 = 0 AND l % 38 + 2 <= 38 THEN l % 38 + 2 ELSE l % 38 + 1 END AS next FROM (SELECT DISTINCT CAST(c_custkey % 40 AS BIGINT) AS l FROM customer)")
def i4(spark, d):
    return ingest.current_period(bootstrap(spark, d))


@query("i5_fixtures", P.ctes(P.FIXTURES) + "SELECT fixture_id, gameweek FROM fixtures WHERE gameweek = 7 AND NOT finished")
def i5(spark, d):
    return ingest.fixtures_of(P.fixtures(spark, d), [7], future_only=True).select("fixture_id", "gameweek")


@query("i6_future_fixtures", P.ctes(P.FIXTURES) + "SELECT fixture_id, team_h, team_a FROM fixtures WHERE gameweek IN (7, 8, 9) AND (team_h = 3 OR team_a = 3) AND NOT finished")
def i6(spark, d):
    return ingest.fixtures_of(P.fixtures(spark, d), [7, 8, 9], 3, True).select("fixture_id", "team_h", "team_a")


def asked(spark, d):
    """Ids of the players with orders."""
    return P.table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("player_id")).distinct()


@query("i7_bulk_histories", P.ctes(P.STATS) + "SELECT player_id, count(*) AS n, max(gameweek) AS last_period FROM stats WHERE player_id IN (SELECT o_custkey FROM orders) GROUP BY player_id")
def i7(spark, d):
    return ingest.histories_of(P.stats(spark, d), asked(spark, d))


def script_pages(spark, d):
    """Pages whose script assigns the players of a team, as landed; the trailing comma is part of it."""
    one = F.to_json(F.struct(F.col("name").alias("player_name"), F.col("team_id").cast("string").alias("team_title"), F.col("minutes").cast("string").alias("time"), F.col("xg").cast("string").alias("xG"), F.col("xa").cast("string").alias("xA")))
    p = P.stats(spark, d).groupBy("player_id").agg(F.sum("minutes").alias("minutes"), F.round(F.sum("xg"), 4).alias("xg"), F.round(F.sum("xa"), 4).alias("xa")).join(P.players(spark, d), "player_id")
    pages = p.groupBy("team_id").agg(F.array_join(F.collect_list(one), ",").alias("rows")).select(F.concat(F.lit("team/"), F.col("team_id").cast("string")).alias("url"), F.concat(F.lit("<html><script>var playersData = ["), "rows", F.lit(",];</script></html>")).alias("html"))
    return pages.unionByName(P.table(spark, d, "pages").select("url", "html"))


@query("i8_script_rows", P.ctes(P.STATS, P.PLAYERS) + "SELECT 'team/' || team_id AS url, name, CAST(m AS DOUBLE) AS minutes, xg, round(xg / m * 90, 3) AS xg_per_90 FROM (SELECT player_id, sum(minutes) AS m, round(sum(xg), 4) AS xg FROM stats GROUP BY player_id) JOIN players USING (player_id)")
def i8(spark, d):
    return ingest.expected_stats(ingest.script_rows(script_pages(spark, d), "playersData"), None).select("url", "name", "minutes", "xg", r("xg_per_90", 3))


def table_pages(spark, d):
    p = P.stats(spark, d).groupBy("player_id").agg(F.sum("minutes").alias("m"), F.sum("blocks").alias("b"), F.sum("interventions").alias("t"), F.sum("goals_conceded").alias("i"), F.sum("passes").alias("c")).join(P.players(spark, d), "player_id")
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *[cell(c) for c in ("name", "team_id", "position", "m", "t", "i", "b", "c")], F.lit("</tr>"))
    head = "<table id='other'><tr><th>Nation</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table><table id='stats_defense'><tr>" + "".join(f"<th>{h}</th>" for h in ("Player", "Squad", "Pos", "Min", "Tkl", "Int", "Blocks", "Cmp")) + "</tr>"
    pages = p.groupBy("team_id").agg(F.array_join(F.collect_list(row), "").alias("rows")).select(F.concat(F.lit("team/"), F.col("team_id").cast("string")).alias("url"), F.concat(F.lit(head), "rows", F.lit("</table>")).alias("html"))
    return pages.unionByName(P.table(spark, d, "pages").select("url", "html"))


@query("i9_i10_defensive_stats", P.ctes(P.STATS, P.PLAYERS) + "SELECT 'team/' || team_id AS url, name, m AS minutes, t + i AS interventions, round(CAST(b AS DOUBLE) / m * 90, 3) AS blocks_per_90 FROM (SELECT player_id, CAST(sum(minutes) AS BIGINT) AS m, CAST(sum(blocks) AS BIGINT) AS b, CAST(sum(interventions) AS BIGINT) AS t, CAST(sum(goals_conceded) AS BIGINT) AS i FROM stats GROUP BY player_id) JOIN players USING (player_id)")
def i9(spark, d):
    return ingest.defensive_stats(table_pages(spark, d), None).select("url", "name", "minutes", "interventions", r("blocks_per_90", 3))


_WORDS = ", ".join(f"('{c}', '{w}')" for c, words in ingest.DEFENSE_COLUMNS.items() for w in words)
_HEADS = "(VALUES (0, 0, 'nation'), (1, 0, 'player'), (1, 1, 'squad'), (1, 2, 'pos'), (1, 3, 'min'), (1, 4, 'tkl'), (1, 5, 'int'), (1, 6, 'blocks'), (1, 7, 'cmp')) h(table_no, place, head)"


@query("c17_header_places", P.ctes(P.STATS, P.PLAYERS) + f"SELECT 'team/' || team_id AS url, table_no, field, min(place) AS place FROM (SELECT DISTINCT team_id FROM stats JOIN players USING (player_id)) t, {_HEADS}, (VALUES {_WORDS}) w(field, word) WHERE contains(head, word) GROUP BY ALL")
def c17(spark, d):
    return ingest.header_places(ingest.table_rows(table_pages(spark, d))).select("url", F.col("table").alias("table_no"), F.col("column").alias("field"), "place")


@query("i12_training_facts", P.ctes(P.STATS, P.PLAYERS) + "SELECT player_id, gameweek, position, price FROM stats JOIN players USING (player_id) WHERE gameweek BETWEEN 1 AND 10")
def i12(spark, d):
    return ingest.training_facts(P.stats(spark, d), P.players(spark, d), "2025-26", range(1, 11)).select("player_id", "gameweek", "position", "price")


@query("i13_period_facts", P.ctes(P.STATS, P.PLAYERS) + "SELECT s.player_id, coalesce(position, 'MID') AS position, coalesce(price, 5.0) AS price FROM stats s LEFT JOIN (SELECT * FROM players WHERE player_id IN (SELECT o_custkey FROM orders)) p USING (player_id) WHERE gameweek = 11")
def i13(spark, d):
    return ingest.period_facts(P.stats(spark, d), P.players(spark, d).join(asked(spark, d), "player_id", "left_semi"), "2025-26", 11).select("player_id", "position", "price")


@query("i14_upsert_players", P.ctes(P.ALL_PLAYERS) + "SELECT player_id, name || CASE WHEN player_id % 3 = 0 THEN ' new' ELSE '' END AS name, position, CASE WHEN player_id % 3 = 0 THEN 7.5 ELSE price END AS price FROM players WHERE player_id % 2 = 0 OR player_id % 3 = 0")
def i14(spark, d):
    p = P.players(spark, d, every=True)
    old = ingest.players_for_store(p.filter("player_id % 2 = 0"))
    new = ingest.players_for_store(p.filter("player_id % 3 = 0").withColumn("name", F.concat("name", F.lit(" new"))).withColumn("price", F.lit(75.0)))
    return upsert.upsert(old, new.withColumn("price", F.lit(7.5)), ["player_id"]).select("player_id", "name", "position", "price")


@query("i15_i20_upsert_facts", P.ctes(P.STATS) + "SELECT player_id, gameweek, season, CASE WHEN gameweek >= 20 THEN total_points + 100 ELSE total_points END AS total_points FROM stats WHERE gameweek <= 25 OR gameweek >= 20")
def i15(spark, d):
    s = P.stats(spark, d).select("player_id", "gameweek", "season", "total_points")
    return upsert.upsert(s.filter("gameweek <= 25"), s.filter("gameweek >= 20").withColumn("total_points", F.col("total_points") + 100), ["player_id", "gameweek", "season"])


@query("i17_i21_bulk_counts", P.ctes(P.STATS) + "SELECT count(*) AS total, count(*) FILTER (player_id % 10 = 0) AS errors, count(*) FILTER (player_id % 10 > 0 AND gameweek > 25) AS inserted, count(*) FILTER (player_id % 10 > 0 AND gameweek <= 25) AS updated FROM stats WHERE gameweek >= 20")
def i17(spark, d):
    s = P.stats(spark, d).select("player_id", "gameweek", "season", "total_points")
    new = s.filter("gameweek >= 20").withColumn("season", F.when(F.col("player_id") % 10 > 0, F.col("season")))
    return upsert.upsert_counts(s.filter("gameweek <= 25"), new, ["player_id", "gameweek", "season"])


_SYNC = """
SELECT player_id, gameweek, CASE position WHEN 'FWD' THEN 'MID' ELSE position END AS position, minutes, b AS blocks, t + i AS interventions, c AS passes
FROM stats JOIN players USING (player_id) JOIN (SELECT player_id, CAST(sum(blocks) AS BIGINT) AS b, CAST(sum(interventions) AS BIGINT) AS t, CAST(sum(goals_conceded) AS BIGINT) AS i, CAST(sum(passes) AS BIGINT) AS c FROM stats GROUP BY player_id) USING (player_id)"""


@query("i18_i19_sync", P.ctes(P.STATS, P.ALL_PLAYERS) + _SYNC)
def i18(spark, d):
    """Histories land in two rounds of files; each round goes through the ledger into the store, the second with corrected rows of the first, and a third finds nothing new."""
    players = ingest.players_for_store(ingest.extract_players(bootstrap(spark, d)))
    defence = ingest.defensive_stats(table_pages(spark, d)).join(players.select("player_id", "name"), "name")
    at = P.landing(spark)
    players.write.parquet(f"{at}/players")
    defence.write.parquet(f"{at}/defence")
    players, defence = spark.read.parquet(f"{at}/players"), spark.read.parquet(f"{at}/defence")

    def facts(landed):
        rows = ingest.stats_with_defence(ingest.extract_history(landed), defence).withColumn("season", F.lit("2025-26"))
        return rows.join(players.select("player_id", "position"), "player_id").select("player_id", "season", "gameweek", "position", "minutes", "blocks", "interventions", "passes")

    landed = histories(spark, d)
    early = landed.withColumn("history", F.transform(F.filter("history", lambda h: h["round"] <= 16), lambda h: F.when(h["round"] < 15, h).otherwise(h.withField("minutes", F.lit(0).cast("long")))))
    for k, batch in enumerate((early, landed.withColumn("history", F.filter("history", lambda h: h["round"] >= 15)), None)):
        if batch is not None:
            batch.write.parquet(f"{at}/files/{k}")
        ledger.sync(spark, f"{at}/files", f"{at}/store", f"{at}/ledger", f"{at}/staging", facts)
    return spark.read.parquet(f"{at}/store").select("player_id", F.col("gameweek").cast("long").alias("gameweek"), "position", "minutes", "blocks", "interventions", "passes")


@query("i24_backfill", P.ctes(P.ALL_PLAYERS) + "SELECT name, player_id FROM players")
def i24(spark, d):
    p = P.players(spark, d, every=True)
    holes = p.select("name", F.when(F.col("player_id") % 2 == 0, F.col("player_id")).alias("key"))
    return upsert.renamed(upsert.backfilled(holes, "key", p, "name", "player_id"), {"key": "player_id", "gone": "other"}).select("name", "player_id")
