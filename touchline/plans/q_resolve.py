"""Names and entity resolution (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.columns import canonical_name, light_name_key, name_key, name_score
from touchline.operators import resolve
from touchline.plans import project as P
from touchline.plans.registry import query, r
from touchline.sources import ingest

_FROM, _TO = "àáâãäåèéêëìíîïòóôõöùúûüçñ", "aaaaaaeeeeiiiiooooouuuucn"


def key_sql(c: str) -> str:
    x = f"translate(trim(lower({c})), '{_FROM}ýÿ', '{_TO}yy')"
    for pattern in (r"\s+[jr]\.?\s*$", r"\s+[ivx]+$", r"^\s*[ivx]+\s+"):
        x = f"regexp_replace({x}, '{pattern}', '')"
    return f"trim(regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def light_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(trim(lower({c})), '{_FROM}', '{_TO}'), '\\s+[jr]\\.?\\s*$', ''), '\\s+[ivx]+$', ''))"


# Names with the endings and marks that the normalisers treat.
_ODD = "CASE id % 5 WHEN 0 THEN name || ' Jr' WHEN 1 THEN 'IV  ' || name || ' r.' WHEN 2 THEN name || ' iii' WHEN 3 THEN ' D. van ' || name ELSE 'FC ' || name END"


def odd_names(spark, d):
    _, b = P.names(spark, d)
    k = F.col("id") % 5
    n = F.col("name")
    odd = F.when(k == 0, F.concat(n, F.lit(" Jr"))).when(k == 1, F.concat(F.lit("IV  "), n, F.lit(" r."))).when(k == 2, F.concat(n, F.lit(" iii"))).when(k == 3, F.concat(F.lit(" D. van "), n)).otherwise(F.concat(F.lit("FC "), n))
    return b.select("id", odd.alias("name"))


_OD = f"od AS (SELECT id, {_ODD} AS name FROM names_b)"


@query("e1_e2_name_keys", P.ctes(P.NAMES, _OD) + f"SELECT id, {key_sql('name')} AS key, {light_sql('name')} AS light FROM od")
def e1(spark, d):
    return odd_names(spark, d).select("id", name_key("name").alias("key"), light_name_key("name").alias("light"))


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(name), '\s+', ' ', 'g'), '\b([A-Z])\.\s+', '\1 ', 'g'), '\s+[JjRr]\.?\s*$', ''))"


@query("e3_canonical_names", P.ctes(P.NAMES, _OD) + f"""
SELECT id, array_to_string(list_transform(string_split({_CLEAN}, ' '), lambda w: CASE WHEN w = upper(w) AND w <> lower(w) AND length(w) <= 3 THEN w WHEN lower(w) IN ('van', 'de', 'da', 'del', 'der', 'den', 'von', 'le', 'la', 'el') THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS canonical FROM od""")
def e3(spark, d):
    return odd_names(spark, d).select("id", canonical_name("name").alias("canonical"))


@query("e4_chosen_names", P.ctes(P.NAMES) + """
SELECT a.id, array_to_string(list_transform(string_split(CASE WHEN a.id % 2 = 0 THEN a.name WHEN length(a.name) >= length(b.name) THEN a.name ELSE b.name END, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS chosen
FROM names_a a JOIN names_b b ON b.id = a.id + 1000000""")
def e4(spark, d):
    a, b = P.names(spark, d)
    j = a.join(b.select((F.col("id") - 1_000_000).alias("id"), F.col("name").alias("other")), "id")
    return j.select("id", resolve.chosen_name(F.when(F.col("id") % 2 == 0, F.col("name")), F.col("name"), F.col("other")).alias("chosen"))


def id_map(spark, d):
    a, b = P.names(spark, d)
    j = a.filter("id % 2 = 0").join(b.select((F.col("id") - 1_000_000).alias("id"), F.col("name").alias("other")), "id")
    return j.select("id", "name", (F.col("id") + 1_000_000).alias("source_a_id"), F.col("other").alias("source_a_name"), (F.col("id") + 2_000_000).alias("source_b_id"), F.upper("name").alias("source_b_name"))


@query("i11_id_map", P.ctes(P.NAMES) + "SELECT a.id, a.name, a.id + 1000000 AS source_a_id, b.name AS source_a_name, CAST(a.id + 2000000 AS VARCHAR) AS source_b_id, upper(a.name) AS source_b_name FROM names_a a JOIN names_b b ON b.id = a.id + 1000000 WHERE a.id % 2 = 0")
def i11(spark, d):
    # The first copy has only its header, so the fallback is read.
    m, at = id_map(spark, d), P.landing(spark)
    for name, rows in (("first", m.filter("id < 0")), ("copy", m)):
        rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{at}/{name}")
    return ingest.read_id_map(spark, f"{at}/first", f"{at}/copy")


_MAP = f"im AS (SELECT a.id, {key_sql('a.name')} AS k1, {key_sql('b.name')} AS k2 FROM names_a a JOIN names_b b ON b.id = a.id + 1000000 WHERE a.id % 2 = 0), nm AS (SELECT id, {key_sql('name')} AS k FROM names_a)"
_E5 = "e5 AS (SELECT id, min(step) AS step, arg_min(map_id, step * 100000000 + map_id) AS map_id FROM (SELECT nm.id, 0 AS step, im.id AS map_id FROM nm JOIN im USING (id) UNION ALL SELECT nm.id, 1, im.id FROM nm JOIN im ON k = k1 UNION ALL SELECT nm.id, 2, im.id FROM nm JOIN im ON k = k2) GROUP BY id)"


@query("e5_exact_resolution", P.ctes(P.NAMES, _MAP, _E5) + "SELECT nm.id, coalesce(step, -1) AS step, coalesce(map_id, -1) AS map_id FROM nm LEFT JOIN e5 USING (id)")
def e5(spark, d):
    a, _ = P.names(spark, d)
    return resolve.exact_resolution(a.select("id", "name"), id_map(spark, d)).select("id", F.coalesce("step", F.lit(-1)).alias("step"), F.coalesce("map_id", F.lit(-1)).cast("long").alias("map_id"))


def distinct_names(spark, d):
    """Both lists without repeated names."""
    return tuple(x.groupBy("name").agg(F.min("id").alias("id"), F.min("team").alias("team")).select("id", "name", "team") for x in P.names(spark, d))


@query("e6_e7_scores")
def e6(spark, d):
    a, b = P.names(spark, d)
    pairs = a.join(b.withColumn("aid", F.col("id") - 1_000_000).select("aid", F.col("name").alias("cand"), F.col("id").alias("cand_id")), a["id"] == F.col("aid")).select(F.col("id").alias("target_id"), F.col("name").alias("target"), "cand_id", "cand")
    df = pairs
    for kind in resolve.SCORERS:
        df = resolve.scored(df, kind).withColumnRenamed("score", kind)
    return df.withColumn("is_match", F.col("weighted") >= 80.0)


@query("e8_e9_best_matches")
def e8(spark, d):
    a, b = distinct_names(spark, d)
    return resolve.fuzzy_match(a, b, 0.8)


@query("e10_multi_source")
def e10(spark, d):
    a, b = distinct_names(spark, d)
    both = b.withColumn("source", F.lit("source_a")).unionByName(a.select((F.col("id") + 2_000_000).alias("id"), F.upper("name").alias("name"), "team").withColumn("source", F.lit("source_b")))
    return resolve.fuzzy_multi_source(a, both, 0.9)


@query("e11_e12_resolve")
def e11(spark, d):
    _, b = distinct_names(spark, d)
    return resolve.resolve(b.select("id", "name"), id_map(spark, d)).select("id", "method", "confidence", "map_id", "matched")


def resolved(spark, d):
    a, _ = P.names(spark, d)
    x = resolve.exact_resolution(a.select("id", "name"), id_map(spark, d))
    return x.select("id", "name", F.col("step").isNotNull().alias("matched"), F.when(F.col("step") == 0, 1.0).when(F.col("step").isNotNull(), 0.8).otherwise(0.0).alias("confidence"))


@query("e13_report", P.ctes(P.NAMES, _MAP, _E5) + "SELECT count(*) AS total, count(step) AS matched, count(*) FILTER (step IS NULL) AS unmatched, count(*) FILTER (step = 0) AS high_confidence, count(*) FILTER (step > 0) AS low_confidence, round(count(step) * 100.0 / count(*), 4) AS accuracy FROM nm LEFT JOIN e5 USING (id)")
def e13(spark, d):
    return resolve.resolution_report(resolved(spark, d)).select("total", "matched", "unmatched", "high_confidence", "low_confidence", r("accuracy"))


@query("e14_unmatched", P.ctes(P.NAMES, _MAP, _E5) + "SELECT id, name FROM names_a LEFT JOIN e5 USING (id) WHERE step IS NULL")
def e14(spark, d):
    return resolve.unmatched(resolved(spark, d))


def mappings(spark, d, where: str = "player_id % 3 > 0"):
    a, b = P.names(spark, d)
    m = a.join(b.select((F.col("id") - 1_000_000).alias("id"), F.col("name").alias("other")), "id")
    return m.select(F.col("id").alias("player_id"), F.when(F.col("id") % 4 > 0, F.col("other")).alias("source_a_name"), F.upper("name").alias("source_b_name"), F.col("name").alias("canonical_name"), (F.col("id") % 10 / 10.0).alias("confidence"), (F.col("id") % 6 == 0).alias("verified")).filter(where)


_MG = "mg AS (SELECT a.id AS player_id, CASE WHEN a.id % 4 > 0 THEN b.name END AS source_a_name, upper(a.name) AS source_b_name, a.name AS canonical_name, (a.id % 10) / CAST(10.0 AS DOUBLE) AS confidence, a.id % 6 = 0 AS verified FROM names_a a JOIN names_b b ON b.id = a.id + 1000000)"


@query("e15_upsert_mappings", P.ctes(P.NAMES, _MG, "o AS (SELECT * FROM mg WHERE player_id % 3 > 0)", "n AS (SELECT player_id, '' AS source_a_name, lower(source_b_name) AS source_b_name, canonical_name || '!' AS canonical_name, CASE WHEN player_id % 7 > 0 THEN confidence END AS confidence, verified FROM mg WHERE player_id % 2 = 0)") + "SELECT coalesce(n.player_id, o.player_id) AS player_id, coalesce(nullif(n.source_a_name, ''), o.source_a_name) AS source_a_name, coalesce(n.source_b_name, o.source_b_name) AS source_b_name, coalesce(n.canonical_name, o.canonical_name) AS canonical_name, coalesce(n.confidence, o.confidence) AS confidence, coalesce(n.verified, o.verified) AS verified FROM o FULL JOIN n ON o.player_id = n.player_id")
def e15(spark, d):
    new = mappings(spark, d, "player_id % 2 = 0").select("player_id", F.lit("").alias("source_a_name"), F.lower("source_b_name").alias("source_b_name"), F.concat("canonical_name", F.lit("!")).alias("canonical_name"), F.when(F.col("player_id") % 7 > 0, F.col("confidence")).alias("confidence"), "verified")
    return resolve.upsert_mappings(mappings(spark, d), new)


@query("e16_manual_mappings", P.ctes(P.NAMES, _MG) + "SELECT player_id, CASE WHEN player_id % 3 > 0 THEN coalesce(source_a_name, 'manual') ELSE 'manual' END AS source_a_name, CASE WHEN player_id % 3 > 0 THEN source_b_name ELSE 'other' END AS source_b_name FROM mg WHERE player_id % 3 > 0 OR player_id % 2 = 0")
def e16(spark, d):
    old = mappings(spark, d).select("player_id", F.coalesce("source_a_name", F.when(F.col("player_id") % 2 > 0, "manual")).alias("source_a_name"), "source_b_name")
    new = mappings(spark, d, "player_id % 2 = 0").select("player_id", F.lit("manual").alias("source_a_name"), F.lit("other").alias("source_b_name"))
    return resolve.add_manual(old, new, "player_id")


_RQ = "rq AS (SELECT player_id, CASE WHEN player_id % 5 = 0 THEN 'NEW ' || player_id ELSE source_b_name END AS external_name FROM mg WHERE player_id % 5 < 2)"
_OV = "ov AS (SELECT rq.player_id, rq.external_name, CASE WHEN rq.player_id % 3 = 0 THEN 'missing' WHEN EXISTS (SELECT 1 FROM mg WHERE player_id % 3 > 0 AND mg.source_b_name = rq.external_name AND mg.player_id <> rq.player_id) THEN 'conflict' END AS reason FROM rq)"


@query("e17_override", P.ctes(P.NAMES, _MG, _RQ, _OV) + "SELECT player_id, external_name, reason FROM ov WHERE reason IS NOT NULL")
def e17(spark, d):
    req = mappings(spark, d, "player_id % 5 < 2").select("player_id", F.when(F.col("player_id") % 5 == 0, F.concat(F.lit("NEW "), F.col("player_id").cast("string"))).otherwise(F.col("source_b_name")).alias("external_name"))
    return resolve.override(mappings(spark, d), req, "source_b_name")[1]


@query("e17_override_accepted", P.ctes(P.NAMES, _MG, _RQ, _OV) + "SELECT mg.player_id, coalesce(ov.external_name, mg.source_b_name) AS source_b_name, ov.player_id IS NOT NULL OR verified AS verified, CASE WHEN ov.player_id IS NOT NULL THEN 1.0 ELSE confidence END AS confidence FROM mg LEFT JOIN (SELECT * FROM ov WHERE reason IS NULL) ov ON ov.player_id = mg.player_id WHERE mg.player_id % 3 > 0")
def e17b(spark, d):
    req = mappings(spark, d, "player_id % 5 < 2").select("player_id", F.when(F.col("player_id") % 5 == 0, F.concat(F.lit("NEW "), F.col("player_id").cast("string"))).otherwise(F.col("source_b_name")).alias("external_name"))
    return resolve.override(mappings(spark, d), req, "source_b_name")[0].select("player_id", "source_b_name", "verified", "confidence")


@query("e18_lookup", P.ctes(P.NAMES, _MG) + "SELECT player_id, canonical_name FROM mg WHERE player_id % 3 > 0 AND NOT verified ORDER BY player_id LIMIT 50 OFFSET 20")
def e18(spark, d):
    return resolve.lookup(mappings(spark, d), verified=False, limit=50, offset=20).select("player_id", "canonical_name")


@query("e19_apply_changes", P.ctes(P.NAMES, _MG) + "SELECT player_id, CASE WHEN player_id % 4 = 1 THEN 1.0 WHEN player_id % 2 = 0 AND player_id % 20 < 10 THEN 0.25 ELSE confidence END AS confidence, player_id % 4 = 1 OR verified AS verified FROM mg WHERE player_id % 3 > 0 AND player_id % 11 > 0")
def e19(spark, d):
    m = mappings(spark, d)
    change = m.filter("player_id % 2 = 0").select("player_id", F.when(F.col("player_id") % 20 < 10, 0.25).otherwise(1.5).alias("confidence"))
    return resolve.apply_changes(m, change, m.filter("player_id % 4 = 1"), m.filter("player_id % 11 = 0")).select("player_id", "confidence", "verified")


def score_sql(a: str, b: str) -> str:
    u, v = (f"list_filter(list_distinct(string_split_regex({x}, '\\s+')), lambda w: w <> '')" for x in (a, b))
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.9 ELSE CAST(len(list_intersect({u}, {v})) AS DOUBLE) / greatest(len(list_distinct(list_concat({u}, {v}))), 1) END"


@query("e20_name_scores", P.ctes(P.NAMES, f"k AS (SELECT a.id, {light_sql('a.name')} AS x, {light_sql('b.name')} AS y FROM names_a a JOIN names_b b ON b.id = a.id + 1000000)") + f"SELECT id, round({score_sql('x', 'y')}, 4) AS score FROM k")
def e20(spark, d):
    a, b = P.names(spark, d)
    j = a.join(b.select((F.col("id") - 1_000_000).alias("id"), F.col("name").alias("other")), "id")
    return j.select("id", r(name_score("name", "other"), 4, "score"))


_DN = f"da AS (SELECT min(id) AS id, name, min(team) AS team, {light_sql('name')} AS x FROM names_a GROUP BY name), db AS (SELECT min(id) AS id, name, min(team) AS team, {light_sql('name')} AS y FROM names_b GROUP BY name)"


@query("e21_external_matches", P.ctes(P.NAMES, _DN) + f"SELECT target_id, cand_id, round(score, 4) AS score FROM (SELECT da.id AS target_id, db.id AS cand_id, least(1.0, {score_sql('x', 'y')} + CASE WHEN da.team = db.team THEN 0.1 ELSE 0.0 END) AS score FROM da, db) WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY score DESC, cand_id) = 1")
def e21(spark, d):
    a, b = distinct_names(spark, d)
    return resolve.external_matches(a, b).select("target_id", "cand_id", r("score"))


@query("e22_map_external")
def e22(spark, d):
    a, b = distinct_names(spark, d)
    return resolve.map_external(b, a, id_map(spark, d))


@query("e23_map_sorted_tokens")
def e23(spark, d):
    a, b = distinct_names(spark, d)
    return resolve.map_by_sorted_tokens(b, a, id_map(spark, d))


@query("e24_mapping_counts", P.ctes(P.NAMES, _MAP, _E5) + "SELECT CASE step WHEN 0 THEN 'id' ELSE 'name' END AS method, count(*) AS matched, count(*) FILTER (step = 0) AS high_confidence FROM e5 GROUP BY 1")
def e24(spark, d):
    x = resolved(spark, d).filter("matched").withColumn("method", F.when(F.col("confidence") == 1.0, "id").otherwise("name"))
    return resolve.mapping_counts(x)


@query("e25_enriched", P.ctes(P.STATS, P.PLAYERS, "s AS (SELECT player_id, sum(xg) / sum(minutes) * 90 AS xg_per_90, CAST(sum(blocks) AS DOUBLE) / sum(minutes) * 90 AS blocks_per_90 FROM stats GROUP BY player_id)") + "SELECT p.player_id, round(CASE WHEN player_id % 2 = 0 THEN xg_per_90 ELSE 0.0 END, 4) AS xg_per_90, round(CASE WHEN player_id % 3 = 0 THEN blocks_per_90 ELSE 0.0 END, 4) AS blocks_per_90 FROM players p JOIN s USING (player_id)")
def e25(spark, d):
    s = P.stats(spark, d).groupBy("player_id").agg(r(F.sum("xg") / F.sum("minutes") * 90, 4, "xg_per_90"), r(F.sum("blocks") / F.sum("minutes") * 90, 4, "blocks_per_90")).withColumn("id", F.col("player_id") + 5)
    ids = s.select("id", "player_id")
    return resolve.enriched(P.players(spark, d).select("player_id"), ids.filter("player_id % 2 = 0"), s.select("id", "xg_per_90"), ids.filter("player_id % 3 = 0"), s.select("id", "blocks_per_90"), ("xg_per_90",), ("blocks_per_90",))
