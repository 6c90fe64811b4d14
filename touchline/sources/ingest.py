"""Landed JSON, HTML and CSV to tables. Every document is one row; many leagues and seasons are read at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.columns import filled, parsed_int, parsed_loose, position_of
from touchline.operators.clean import normalised_points

# Schemas of the documents. Numbers that arrive as text stay text until they are parsed.
_TEXT_METRICS = ["selected_by_percent", "form", "points_per_game", "influence", "creativity", "threat", "ict_index", "value_form", "value_season", "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded"]
_COUNTS = ["total_points", "goals_scored", "assists", "clean_sheets", "saves", "bonus", "bps", "transfers_in", "transfers_out", "minutes", "goals_conceded", "yellow_cards", "red_cards", "penalties_saved", "penalties_missed"]
ELEMENT = "id:bigint,web_name:string,first_name:string,second_name:string,team:bigint,element_type:bigint,now_cost:bigint,cost_change_start:bigint,status:string,news:string," + ",".join([f"{c}:string" for c in _TEXT_METRICS] + [f"{c}:bigint" for c in _COUNTS])
TEAM = "id:bigint,name:string,short_name:string,strength:bigint,strength_attack_home:bigint,strength_attack_away:bigint,strength_defence_home:bigint,strength_defence_away:bigint"
BOOTSTRAP = f"league string, elements array<struct<{ELEMENT}>>, teams array<struct<{TEAM}>>, element_types array<struct<id:bigint,singular_name_short:string>>, events array<struct<id:bigint,is_current:boolean,is_next:boolean,finished:boolean>>"
_MATCH_COUNTS = ["goals_scored", "assists", "clean_sheets", "goals_conceded", "saves", "bonus", "bps"]
_MATCH_TEXT = ["expected_goals", "expected_assists", "expected_goals_conceded", "influence", "creativity", "threat", "ict_index"]
HISTORY = "league string, player_id bigint, history array<struct<round:bigint,fixture:bigint,opponent_team:bigint,was_home:boolean,minutes:bigint,total_points:bigint,value:bigint," + ",".join([f"{c}:bigint" for c in _MATCH_COUNTS] + [f"{c}:string" for c in _MATCH_TEXT]) + ">>"
ID_MAP = "id bigint, name string, source_a_id bigint, source_a_name string, source_b_id string, source_b_name string"


def read_bootstrap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOOTSTRAP).option("multiLine", True).json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).json(path)


def read_id_map(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """CSV with a header; the fallback copy if the first has no rows."""
    df = spark.read.schema(ID_MAP).option("header", True).csv(path)
    return spark.read.schema(ID_MAP).option("header", True).csv(fallback) if fallback and df.isEmpty() else df


def extract_players(bootstrap: DataFrame, key: str = "league") -> DataFrame:
    """A row for each element with its team and position; an unmatched position is UNKNOWN. Lookups go by league and id; Spark broadcasts them by their size."""
    e = bootstrap.select(key, F.explode("elements").alias("e")).select(key, "e.*")
    has = set(e.columns)
    teams = bootstrap.select(key, F.explode("teams").alias("t")).select(key, F.col("t.id").alias("team_id"), F.col("t.name").alias("team_name"), F.col("t.short_name").alias("team_short_name"))
    kinds = bootstrap.select(key, F.explode("element_types").alias("k")).select(key, F.col("k.id").alias("position_id"), F.col("k.singular_name_short").alias("position"))
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in has else F.lit("")
    df = e.select(
        key, F.col("id").alias("player_id"), text("web_name").alias("web_name"), F.trim(F.concat_ws(" ", text("first_name"), text("second_name"))).alias("full_name"),
        F.col("team").alias("team_id"), F.col("element_type").alias("position_id"), (F.coalesce("now_cost", F.lit(0)) / 10.0).alias("price"),
        F.coalesce("status", F.lit("a")).alias("status"), *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in _TEXT_METRICS if c in has], *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _COUNTS if c in has],
    )
    return df.join(teams, [key, "team_id"], "left").join(kinds, [key, "position_id"], "left").withColumn("position", F.coalesce("position", F.lit("UNKNOWN"))).fillna("", ["team_name", "team_short_name"])


def extract_teams(bootstrap: DataFrame, key: str = "league") -> DataFrame:
    return bootstrap.select(key, F.explode("teams").alias("t")).select(key, "t.*").withColumnRenamed("id", "team_id")


def extract_history(history: DataFrame, key: str = "league") -> DataFrame:
    """A row for each match: over 90 minutes count as two; points of one match; value in tenths."""
    h = history.select(key, "player_id", F.explode("history").alias("h")).select(key, "player_id", "h.*")
    has = set(h.columns)
    minutes = F.coalesce("minutes", F.lit(0))
    df = h.withColumn("minutes", minutes).withColumn("matches_played", F.when(minutes > 90, 2).otherwise(1)).withColumn("points", F.coalesce("total_points", F.lit(0)))
    df = df.withColumn("normalized_points", normalised_points("points", "matches_played")).withColumn("price", F.coalesce("value", F.lit(0)) / 10.0).withColumnRenamed("round", "gameweek")
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in _MATCH_TEXT if c in has}).drop("total_points", "value")


def current_period(bootstrap: DataFrame, key: str = "league") -> DataFrame:
    """key, current, next: current is the marked one, else the next, else the last finished; next is the marked one, else the first unfinished."""
    e = bootstrap.select(key, F.explode("events").alias("e")).select(key, "e.*")
    at = lambda f, c: f(F.when(c, F.col("id")))
    marked, following, done = F.col("is_current"), F.col("is_next"), F.col("finished")
    return e.groupBy(key).agg(F.coalesce(at(F.min, marked), at(F.min, following), at(F.max, done)).alias("current"), F.coalesce(at(F.min, following), at(F.min, ~done)).alias("next"))


def fixtures_of(fixtures: DataFrame, gameweeks: Sequence[int] | None = None, team_id: int | None = None, future_only: bool = False) -> DataFrame:
    """By periods, by team on either side, unfinished only."""
    df = fixtures
    if gameweeks is not None:
        df = df.filter(F.col("gameweek").isin(list(gameweeks)))
    if team_id is not None:
        df = df.filter((F.col("team_h") == team_id) | (F.col("team_a") == team_id))
    return df.filter(~F.col("finished")) if future_only else df


def histories_of(stats: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the players asked for, and how many each has."""
    return stats.join(ids.select("player_id").distinct(), "player_id", "left_semi").groupBy("player_id").agg(F.count("*").alias("n"), F.max("gameweek").alias("last_period"))


def training_facts(stats: DataFrame, players: DataFrame, season: str, gameweeks: Sequence[int] | None = None) -> DataFrame:
    """Facts of players that are known, with position and price or their defaults."""
    df = stats.filter(F.col("season") == season)
    df = df.filter(F.col("gameweek").isin(list(gameweeks))) if gameweeks is not None else df
    return _defaults(df.join(players.select("player_id", "position", "price"), "player_id"))


def period_facts(stats: DataFrame, players: DataFrame, season: str, gameweek: int) -> DataFrame:
    """Facts of one period; players that are not known stay, with defaults."""
    return _defaults(stats.filter((F.col("season") == season) & (F.col("gameweek") == gameweek)).join(players.select("player_id", "position", "price"), "player_id", "left"))


def _defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({"position": F.coalesce("position", F.lit("MID")), "price": F.coalesce(F.col("price").cast("double"), F.lit(5.0))})


# ---------------------------------------------------------------- pages

def script_rows(pages: DataFrame, variable: str, url: str = "url", html: str = "html") -> DataFrame:
    """url, row (map of text) for each entry of the JSON that a page's script assigns to the variable: a list, {"players": [...]}, or the values of an object. Trailing commas go; what cannot be read gives no rows."""
    assigned = F.regexp_extract(html, rf"(?s)\b{variable}\s*=\s*(?:JSON\.parse\s*\(\s*['\"])?([\[{{].*?[\]}}])(?:['\"]\s*\))?\s*;", 1)
    text = F.regexp_replace(assigned, r",\s*([\]}])", "$1")
    rows = F.from_json("_json", "array<map<string,string>>")
    inner = F.from_json(F.get_json_object("_json", "$.players"), "array<map<string,string>>")
    values = F.map_values(F.from_json("_json", "map<string,map<string,string>>"))
    df = pages.filter(F.col(html).contains(variable)).select(url, text.alias("_json")).filter("_json <> ''")
    listed = F.when(F.col("_json").startswith("["), rows).when(F.get_json_object("_json", "$.players").isNotNull(), inner).otherwise(values)
    return df.select(url, F.explode(listed).alias("row")).filter(F.col("row").isNotNull())


def expected_stats(rows: DataFrame, digits: int | None = 3) -> DataFrame:
    """Named columns of script rows under any of their names, with per-90 rates."""
    of = lambda *names: F.coalesce(*[F.element_at("row", F.lit(n)) for n in names])
    num = lambda *names: parsed_loose(of(*names))
    df = rows.select("url", of("player_name", "name").alias("name"), of("team_title", "team").alias("team"), of("position").alias("position"), num("games").alias("games"), num("time", "minutes").alias("minutes"), num("goals").alias("goals"), num("assists").alias("assists"), num("xG", "xg").alias("xg"), num("xA", "xa").alias("xa"), num("npxG", "npxg").alias("npxg"))
    per = lambda c: F.when(F.col("minutes") > 0, F.col(c) / F.col("minutes") * 90).otherwise(0.0)
    return df.withColumns({f"{c}_per_90": F.round(per(c), digits) if digits is not None else per(c) for c in ("xg", "xa", "npxg")})


class _Tables(HTMLParser):
    """Cells of every table: (table number, id and class, row number, cells, whether all are headers)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, str, int, list[str], bool]] = []
        self.table, self.stack, self.cells, self.heads, self.text = -1, [], None, True, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table += 1
            got = dict(attrs)
            self.stack.append([self.table, f"{got.get('id') or ''} {got.get('class') or ''}".strip(), 0])
        elif tag == "tr" and self.stack:
            self.cells, self.heads = [], True
        elif tag in ("td", "th") and self.cells is not None:
            self.text, self.heads = [], self.heads and tag == "th"

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.text is not None and self.cells is not None:
            self.cells.append(" ".join("".join(self.text).split()))
            self.text = None
        elif tag == "tr" and self.cells is not None and self.stack:
            top = self.stack[-1]
            if self.cells:
                self.rows.append((top[0], top[1], top[2], self.cells, self.heads))
                top[2] += 1
            self.cells = None
        elif tag == "table" and self.stack:
            self.stack.pop()


def table_rows(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, table, label, row, cells, is_header of all HTML tables; pages without one are left out before parsing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for u, text in zip(pdf["url"], pdf["html"]):
                parser = _Tables()
                parser.feed(text)
                out += [(u, *r) for r in parser.rows]
            yield pd.DataFrame(out, columns=["url", "table", "label", "row", "cells", "is_header"])

    df = pages.filter(F.lower(html).contains("<table")).select(F.col(url).alias("url"), F.col(html).alias("html"))
    return df.mapInPandas(run, "url string, table int, label string, row int, cells array<string>, is_header boolean")


# Words by which a column of the defensive table is known.
DEFENSE_COLUMNS = {"name": ["player"], "team": ["squad", "team"], "position": ["pos"], "minutes": ["min"], "games": ["mp", "matches"], "blocks": ["blocks", "blk"], "tackles": ["tkl", "tackles"], "interceptions": ["int"], "passes": ["cmp", "passes"]}


def header_places(rows: DataFrame, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """url, table, column, place: the first header cell that holds any of the column's words."""
    columns = columns or DEFENSE_COLUMNS
    heads = rows.filter("is_header").groupBy("url", "table").agg(F.min_by("cells", "row").alias("cells")).select("url", "table", F.posexplode("cells").alias("place", "head"))
    words = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.array(*[F.lit(w) for w in ws]).alias("words")) for c, ws in columns.items()]))
    heads = heads.withColumn("w", words).filter(F.exists("w.words", lambda x: F.lower("head").contains(x)))
    return heads.groupBy("url", "table", F.col("w.column").alias("column")).agg(F.min("place").alias("place"))


def defensive_stats(pages: DataFrame, digits: int | None = 3) -> DataFrame:
    """The defensive table of each page: the one whose id, class or headers speak of defence; whole numbers parsed, per-90 rates, interventions = tackles + interceptions; header and short rows are skipped."""
    rows = table_rows(pages)
    places = header_places(rows).groupBy("url", "table").pivot("column", list(DEFENSE_COLUMNS)).agg(F.min("place"))
    chosen = rows.groupBy("url", "table").agg(F.max(F.lower("label")).alias("label")).join(places, ["url", "table"])
    fits = F.col("label").rlike("defen") | (F.col("tackles").isNotNull() & F.col("interceptions").isNotNull())
    chosen = chosen.filter(fits & F.col("name").isNotNull()).groupBy("url").agg(F.min_by(F.struct("table", *DEFENSE_COLUMNS), F.struct((~F.col("label").rlike("defen")).cast("int"), "table")).alias("p"))
    df = rows.filter("NOT is_header").join(chosen, "url").filter((F.col("table") == F.col("p.table")) & (F.size("cells") >= 3))
    cell = lambda c: F.try_element_at("cells", F.col(f"p.{c}") + 1)
    text = {c: F.coalesce(cell(c), F.lit("")).alias(c) for c in ("name", "team", "position")}
    nums = {c: parsed_int(F.coalesce(cell(c), F.lit(""))).alias(c) for c in ("minutes", "games", "blocks", "tackles", "interceptions", "passes")}
    df = df.select("url", *text.values(), *nums.values()).filter((F.col("name") != "") & (F.lower("name") != "player")).withColumn("interventions", F.col("tackles") + F.col("interceptions"))
    per = lambda c: F.when(F.col("minutes") > 0, F.col(c) / F.col("minutes") * 90).otherwise(0.0)
    return df.withColumns({f"{c}_per_90": F.round(per(c), digits) if digits is not None else per(c) for c in ("blocks", "interventions", "passes")})


def stats_with_defence(history: DataFrame, defence: DataFrame, key: str = "player_id") -> DataFrame:
    """Match rows with the external defensive columns of the player; missing ones are 0."""
    cols = ["blocks", "interventions", "passes"]
    d = defence.groupBy(key).agg(*[F.max(c).alias(c) for c in cols])
    return history.join(d, key, "left").fillna(0, cols)


def players_for_store(players: DataFrame) -> DataFrame:
    """Extracted or raw player rows as the store keeps them: one position code, price in millions."""
    has = set(players.columns)
    first = lambda *cs: F.coalesce(*[F.col(c) for c in cs if c in has]) if any(c in has for c in cs) else F.lit(None)
    raw = F.col("now_cost") / 10.0 if "now_cost" in has else F.lit(None).cast("double")
    price = F.col("price").cast("double") if "price" in has else F.lit(None).cast("double")
    return players.select(
        first("player_id", "id").cast("long").alias("player_id"), F.coalesce(first("web_name", "name"), F.lit("")).alias("name"), F.nullif(first("team_id", "team").cast("long"), F.lit(0)).alias("team_id"),
        position_of(first("element_type", "position_id", "position")).alias("position"), F.coalesce(raw, F.when(price > 100, price / 10).otherwise(price), F.lit(0.0)).alias("price"), first("selected_by_percent", "ownership").try_cast("double").alias("ownership"),
    )


def teams_for_store(teams: DataFrame) -> DataFrame:
    """Strengths as the whole mean of home and away, null when both are 0."""
    mean = lambda a, b: F.when(filled(a) + filled(b) > 0, ((filled(a) + filled(b)) / 2).cast("int"))
    return teams.select("team_id", F.col("name"), F.col("short_name"), mean("strength_attack_home", "strength_attack_away").alias("strength_attack"), mean("strength_defence_home", "strength_defence_away").alias("strength_defense"), F.nullif(F.col("strength"), F.lit(0)).cast("int").alias("strength_overall"))
