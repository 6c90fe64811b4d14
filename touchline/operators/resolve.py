"""Entity resolution: exact cascades by equi-joins, fuzzy scores over all candidate pairs that can reach the threshold, mappings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import canonical_name, col, key_score, light_name_key, name_key
from touchline.functions.similarity import SCORERS, many
from touchline.operators.stage import stage_in

MAP_COLUMNS = ["id", "name", "source_a_id", "source_a_name", "source_b_id", "source_b_name"]


def chosen_name(primary: Column, a: Column, b: Column) -> Column:
    """The primary name if there is one; else the name whose key more than one source has; else the longest. Cleaned for display."""
    primary, a, b = col(primary), col(a), col(b)
    ka, kb = name_key(a), name_key(b)
    agreed = F.when((ka != "") & (ka == kb), a).when((ka != "") & (kb == ""), a).when((kb != "") & (ka == ""), b)
    longest = F.when(F.length(F.coalesce(a, F.lit(""))) >= F.length(F.coalesce(b, F.lit(""))), a).otherwise(b)
    return F.when(canonical_name(primary) != "", canonical_name(primary)).otherwise(F.coalesce(canonical_name(F.coalesce(agreed, longest)), F.lit("")))


def row_order(id_map: DataFrame) -> Column:
    """The order of the map's rows: the columns file and at where the reader knows them (read_id_map), else the values themselves. It does not depend on how many files or tasks there are."""
    if {"_file", "_at"} <= set(id_map.columns):
        return F.struct("_file", "_at")
    return F.struct(*[F.col(c) for c in MAP_COLUMNS])


def exact_resolution(names: DataFrame, id_map: DataFrame) -> DataFrame:
    """names (id, name, source_a_name, source_b_name; the last two may be missing) with the first row of the map that matches by id, then by name against the map's three names, then by the sources' names. One equi-join per step, the best step kept."""
    m = id_map.withColumn("_row", row_order(id_map)).select(*MAP_COLUMNS, "_row")

    def first_of(key: Column, c: str) -> DataFrame:
        """The first row of the map under each key, so that a name of many rows meets one of them and not all."""
        return m.select(key.alias(c), "_row", F.struct(*MAP_COLUMNS).alias("_m")).groupBy(c).agg(F.min("_row").alias("_row"), F.min_by("_m", "_row").alias("_m"))

    keys = {c: first_of(name_key(c), "_k").filter("_k <> ''") for c in ("name", "source_a_name", "source_b_name")}
    steps = [names.select(F.col("id").alias("_id")).join(first_of(F.col("id"), "_id"), "_id").select("_id", F.lit(0).alias("_step"), "_row", "_m")]
    asked = [("name", "name"), ("name", "source_a_name"), ("name", "source_b_name"), ("source_a_name", "source_a_name"), ("source_b_name", "source_b_name")]
    for k, (mine, theirs) in enumerate(asked, 1):
        if mine in names.columns:
            steps.append(names.select(F.col("id").alias("_id"), name_key(mine).alias("_k")).join(keys[theirs], "_k").select("_id", F.lit(k).alias("_step"), "_row", "_m"))
    found = steps[0]
    for s in steps[1:]:
        found = found.unionByName(s)
    first = found.groupBy("_id").agg(F.min_by(F.struct("_step", "_m"), F.struct("_step", "_row")).alias("f"))
    out = names.join(first, names["id"] == first["_id"], "left")
    return out.select(*[names[c] for c in names.columns], F.col("f._step").alias("step"), *[F.col(f"f._m.{c}").alias(f"map_{c}") for c in MAP_COLUMNS])


# ---------------------------------------------------------------- fuzzy

#: Pairs of names under one key from which the key is split over tasks, and names of one part of it.
HOT, PART = 200_000, 300
_BLANKS = r"(?U)[\s\x1c-\x1f]+"


@dataclass(frozen=True)
class Bounds:
    """What two names must have in common for a score; t: scores from 0 to 1, c: the name's length, z: that of its distinct words.

    ratio: a whole-name ratio t needs t / (2 - t) of either name's characters, as a common subsequence has so many: the least of such shares of c and of z.
    words: shared words must make up t / (2 - t) of one of the names (z); near: only names of like length (1.5).
    partial: (share of c, share of z, least and most ratio of lengths, whether any shared word is enough): the shorter name's characters in the longer one.
    """

    ratio: tuple[float, float] | None
    words: float | None
    near: bool
    partial: tuple[tuple[float, float, float, float, bool], ...]


def bounds(scorer: str, threshold: float) -> Bounds:
    share = lambda t: t / (2 - t) if t <= 1 else inf
    t = threshold / 100
    if t <= 0:
        raise ValueError("a threshold of 0 takes all pairs")
    if scorer == "partial":
        return Bounds(None, None, False, ((share(t), inf, 1.0, inf, False),))
    if scorer == "ratio":
        return Bounds((share(t), inf), None, False, ())
    if scorer == "token_sort":
        return Bounds((inf, share(t)), None, False, ())
    if scorer == "token_set":
        return Bounds((inf, share(t)), share(t), False, ())
    lengths = ((0.9, 1.5, 8.0), (0.6, 8.0, inf))
    partial = tuple((share(t / k), share(t / k / 0.95), lo, hi, 0.95 * k >= t - 1e-12) for k, lo, hi in lengths if t <= k + 1e-12)
    return Bounds((share(t), share(t / 0.95)), share(t / 0.95) if t <= 0.95 + 1e-12 else None, True, partial)


def cleaned(name: Column) -> Column:
    """A name as the scorers see it."""
    return F.coalesce(F.trim(F.lower(col(name))), F.lit(""))


def _ordered(names: DataFrame, keys: Column, counts: DataFrame) -> DataFrame:
    """name -> its keys, rarest first, as hashes."""
    each = names.select("name", F.explode(keys).alias("k")).join(counts, "k")
    return each.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "k"))).alias("keys"))


def _counts(a: DataFrame, b: DataFrame, keys: Column) -> DataFrame:
    """k, n: in how many names of both lists a key is."""
    return a.select(F.explode(keys).alias("k")).unionByName(b.select(F.explode(keys).alias("k"))).groupBy("k").agg(F.count("*").alias("n"))


def _hashes(c: str) -> Column:
    return F.transform(c, lambda x: F.xxhash64(x["k"]))


def name_index(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lists (name, distinct) with length c, length z of the distinct words, and their characters (numbered where they recur) and words, rarest in both lists first."""
    # All white space as blanks, as joined words have them.
    chars = F.filter(F.split(F.regexp_replace("name", r"(?U)[\s\x1c-\x1f]", " "), ""), lambda x: x != "")
    numbered = F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda y: y == x)).cast("string")))
    words = F.array_distinct(F.filter(F.split("name", _BLANKS), lambda w: w != ""))
    by_char, by_word = _counts(a, b, numbered), _counts(a, b, words)

    def side(names: DataFrame) -> DataFrame:
        held = _ordered(names, numbered, by_char).select("name", _hashes("keys").alias("chars"))
        worded = _ordered(names, words, by_word).select("name", _hashes("keys").alias("words"), F.transform("keys", lambda x: F.length(x["k"])).alias("lengths"))
        full = names.join(held, "name").join(worded, "name", "left")
        all_words = F.split("name", _BLANKS)
        return full.select("name", F.length("name").alias("c"), F.length(F.array_join(words, " ")).alias("z"), (F.size(F.filter(all_words, lambda w: w != "")) > F.size(words)).alias("repeats"), "chars", F.coalesce("words", F.array().cast("array<bigint>")).alias("words"), "lengths")

    return side(a), side(b)


def _under_keys(names: DataFrame, columns: list[str], keys: Column, c: str) -> DataFrame:
    """k and a struct c of the columns and the rarer keys of the same name: a pair's first common key is the one before which they have none in common."""
    each = names.select(*columns, keys.alias("_keys")).select(*columns, "_keys", F.posexplode("_keys").alias("_i", "k"))
    return each.select("k", F.struct(*columns, F.slice("_keys", F.lit(1), F.col("_i")).alias("rarer")).alias(c))


def meet(x: DataFrame, y: DataFrame) -> DataFrame:
    """x (k, x) with y (k, y) by k: x, y. A key of many pairs is split over tasks: each side is cut in parts of about PART rows and meets all parts of the other."""
    nx, ny = (d.groupBy("k").agg(F.count("*").alias(n)) for d, n in ((x, "nx"), (y, "ny")))
    cuts = lambda n: F.ceil(F.col(n) / PART).cast("int")
    hot = nx.join(ny, "k").filter(F.col("nx") * F.col("ny") > HOT).select("k", cuts("nx").alias("sx"), cuts("ny").alias("sy"))

    def cut(d: DataFrame, own: str, other: str, c: str) -> DataFrame:
        part = F.pmod(F.xxhash64(F.col(c)["name"]), F.coalesce(own, F.lit(1))).cast("int")
        d = d.join(hot, "k", "left").select("k", c, part.alias(f"p{own}"), F.coalesce(other, F.lit(1)).alias("_n"))
        return d.select("k", c, f"p{own}", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias(f"p{other}"))

    # Few bytes become many pairs, so the number of tasks must not follow the bytes.
    spark, keys = x.sparkSession, ["k", "psx", "psy"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return cut(x, "sx", "sy", "x").repartition(tasks, *keys).join(cut(y, "sy", "sx", "y").repartition(tasks, *keys).hint("shuffle_hash"), keys)


def candidate_names(targets: DataFrame, candidates: DataFrame, scorer: str = "weighted", threshold: float = 75.0) -> DataFrame:
    """target, cand: pairs of distinct cleaned names, among them all that the scorer puts at or over the threshold; a pair may come once for each kind of bound.

    Of n keys (characters, or words) of which o must be shared, the n - o + 1 rarest of each name are looked up, as the rarest shared key is one of them; a pair is kept under that key only.
    """
    stage = stage_in(targets.sparkSession)
    a, b = (stage(side, "index") for side in name_index(targets, candidates))
    rule = bounds(scorer, threshold)
    found = []

    def joined(x: DataFrame, y: DataFrame, keys_x: Column, keys_y: Column, held: Column | None = None, flip: bool = False) -> None:
        """keys_x looked up among keys_y; held: what a pair must fulfil besides."""
        pairs = meet(_under_keys(x, ["name", "c", "z"], keys_x, "x"), _under_keys(y, ["name", "c", "z"], keys_y, "y"))
        first = ~F.arrays_overlap("x.rarer", "y.rarer")
        pairs = pairs.filter(first if held is None else held & first)
        found.append(pairs.select(F.col("y.name" if flip else "x.name").alias("target"), F.col("x.name" if flip else "y.name").alias("cand")))

    def needed(shares: tuple[float, float]) -> Column:
        parts = [F.col(c) * s for c, s in zip("cz", shares) if s < inf]
        return F.greatest(F.ceil((parts[0] if len(parts) == 1 else F.least(*parts)) - 1e-9), F.lit(1)).cast("int")

    prefix = lambda o: F.slice("chars", F.lit(1), F.greatest(F.size("chars") - o + 1, F.lit(0)))
    x_c, y_c, x_z, y_z = (F.col(c) for c in ("x.c", "y.c", "x.z", "y.z"))
    ratio = F.greatest(x_c, y_c) / F.least(x_c, y_c)
    if rule.ratio:
        keys = prefix(needed(rule.ratio))
        joined(a, b, keys, keys)
    for x, y, flip in ((a, b, False), (b, a, True)):
        if rule.words is not None:
            # Words from which on those left could still make up the share.
            rest = lambda i: F.aggregate(F.slice("lengths", i + 1, F.size("lengths")), F.lit(-1), lambda s, n: s + n + 1)
            keys = F.filter("words", lambda w, i: rest(i) >= F.col("z") * rule.words - 1e-9)
            joined(x, y, keys, F.col("words"), ratio < 1.5 if rule.near else None, flip=flip)
        for share_c, share_z, lo, hi, any_word in rule.partial:
            far = ((ratio >= lo) & (ratio < hi)) if hi < inf else ratio >= lo
            shorter = far & ((x_c <= y_c) | (x_z <= y_z))
            joined(x, y, prefix(needed((share_c, share_z))), F.col("chars"), shorter, flip=flip)
            if any_word and not flip:
                joined(x, y, F.col("words"), F.col("words"), far)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def scored(pairs: DataFrame, scorer: str = "weighted", normalise: bool = True, least: float = 0.0) -> DataFrame:
    """target, cand with score, 0 to 100; scores below `least` may be less than they are."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(many(scorer, a.tolist(), b.tolist(), least), dtype="float64")

    clean = cleaned if normalise else lambda c: F.coalesce(F.col(c), F.lit(""))
    return pairs.withColumn("score", score(clean("target"), clean("cand")))


def similar_names(targets: DataFrame, candidates: DataFrame, scorer: str = "weighted", threshold: float = 75.0, exact: bool = False) -> DataFrame:
    """target, cand, score: all pairs of distinct cleaned names at or over the threshold. exact compares all pairs, for tests."""
    names = lambda df: df.select(cleaned("name").alias("name")).filter("name <> ''").distinct()
    stage = stage_in(targets.sparkSession)
    a, b = stage(names(targets), "targets"), stage(names(candidates), "candidates")
    if exact:
        pairs = a.withColumnRenamed("name", "target").crossJoin(b.withColumnRenamed("name", "cand"))
    else:
        pairs = candidate_names(a, b, scorer, threshold)
    return scored(pairs, scorer, normalise=False, least=threshold).filter(F.col("score") >= threshold).dropDuplicates(["target", "cand"])


def best_matches(targets: DataFrame, candidates: DataFrame, threshold: float = 80.0, k: int = 1, scorer: str = "weighted", exact: bool = False) -> DataFrame:
    """The k best candidates of each target at or over the threshold; equal scores by name, then id. Names are compared once however often they recur: of equal candidates the first k count."""
    pairs = similar_names(targets, candidates, scorer, threshold, exact)
    c = candidates.select(F.col("id").alias("cand_id"), F.col("name").alias("cand"), cleaned("name").alias("_c")).filter("_c <> ''")
    own = Window.partitionBy("_c").orderBy("cand", "cand_id")
    c = c.withColumn("_i", F.row_number().over(own)).filter(F.col("_i") <= k).drop("_i")
    w = Window.partitionBy("_t").orderBy(F.col("score").desc(), "cand", "cand_id")
    top = pairs.select(F.col("target").alias("_t"), F.col("cand").alias("_c"), "score").join(c, "_c").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    t = targets.select(F.col("id").alias("target_id"), F.col("name").alias("target"), cleaned("name").alias("_t"))
    return t.join(top, "_t").select("target_id", "target", "cand_id", "cand", "score", "rank")


def fuzzy_match(targets: DataFrame, candidates: DataFrame, threshold: float = 0.8, k: int = 1) -> DataFrame:
    """By normalised names, scores 0 to 1, original names returned."""
    keyed = lambda df: df.select("id", name_key("name").alias("name")).filter("name <> ''")
    got = best_matches(keyed(targets), keyed(candidates), threshold * 100, k).select("target_id", "cand_id", "rank", (F.col("score") / 100).alias("score"))
    return got.join(candidates.select(F.col("id").alias("cand_id"), F.col("name").alias("matched_name")), "cand_id")


def fuzzy_multi_source(targets: DataFrame, candidates: DataFrame, threshold: float = 0.85) -> DataFrame:
    """candidates with a source column: per target and source, the matches best first."""
    got = fuzzy_match(targets, candidates, threshold, 10).join(candidates.select(F.col("id").alias("cand_id"), "source"), "cand_id")
    pairs = F.sort_array(F.collect_list(F.struct("score", "matched_name", "cand_id")), False)
    return got.groupBy("target_id", "source").agg(pairs.alias("matches"))


def resolve(names: DataFrame, id_map: DataFrame, high: float = 0.85, low: float = 0.75) -> DataFrame:
    """id, name -> matched, method, confidence and the map's ids. Exact cascade; then the best source name at `high` or over; then any name at `low` or over; the matched name leads back to the map."""
    stage = stage_in(names.sparkSession)
    step = stage(exact_resolution(names, id_map), "steps")
    sure = step.filter(F.col("step").isNotNull()).select("id", "name", F.lit("master_map").alias("method"), F.lit(1.0).alias("confidence"), *[f"map_{c}" for c in MAP_COLUMNS])
    rest = step.filter(F.col("step").isNull()).select("id", "name")
    m = id_map.withColumn("_row", row_order(id_map)).select(*MAP_COLUMNS, "_row")
    every = None
    for source in ("source_a_name", "source_b_name", "name"):
        part = m.filter(F.col(source).isNotNull()).select("_row", F.struct(*MAP_COLUMNS).alias("_m"), name_key(source).alias("name"), F.lit(source != "name").alias("_source"))
        every = part if every is None else every.unionByName(part)
    # Of equal names the first row of the map counts.
    every = stage(every.filter("name <> ''").groupBy("name", "_source").agg(F.min("_row").alias("_row"), F.min_by("_m", "_row").alias("_m")), "map")
    keyed = rest.select("id", "name", name_key("name").alias("_k"))
    got = similar_names(keyed.select(F.col("_k").alias("name")), every, threshold=low * 100).join(every.withColumnRenamed("name", "cand"), "cand")
    hit = F.col("_source") & (F.col("score") >= high * 100)
    w = Window.partitionBy("target").orderBy(F.col("hit").desc(), F.col("score").desc(), "_row")
    best = got.withColumn("hit", hit.cast("int")).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    best = stage(best, "best")
    fuzzy = keyed.join(best, keyed["_k"] == best["target"]).select("id", "name", F.when(F.col("hit") == 1, "fuzzy_match").otherwise("fuzzy_match_general").alias("method"), (F.col("score") / 100).alias("confidence"), *[F.col(f"_m.{c}").alias(f"map_{c}") for c in MAP_COLUMNS])
    none = rest.join(fuzzy.select("id"), "id", "left_anti").select("id", "name", F.lit(None).cast("string").alias("method"), F.lit(0.0).alias("confidence"), *[F.lit(None).cast(dict(id_map.dtypes)[c]).alias(f"map_{c}") for c in MAP_COLUMNS])
    return sure.unionByName(fuzzy).unionByName(none).withColumn("matched", F.col("method").isNotNull())


def resolution_report(resolved: DataFrame, total: int | None = None, high: float = 0.85) -> DataFrame:
    """Counts, and accuracy in percent; rows without id or name are left out of the matches but stay in the total."""
    ok = F.col("id").isNotNull() & F.col("name").isNotNull() & (F.col("name") != "")
    m = ok & F.col("matched")
    g = resolved.agg(
        (F.count("*") if total is None else F.lit(total)).cast("long").alias("total"), F.count_if(m).alias("matched"), F.count_if(ok & ~F.col("matched")).alias("unmatched"),
        F.count_if(m & (F.col("confidence") >= high)).alias("high_confidence"), F.count_if(m & (F.col("confidence") < high)).alias("low_confidence"),
    )
    return g.withColumn("accuracy", F.when(F.col("total") > 0, F.col("matched") / F.col("total") * 100).otherwise(0.0))


def unmatched(resolved: DataFrame) -> DataFrame:
    return resolved.filter(~F.col("matched")).select("id", "name")


def external_matches(players: DataFrame, external: DataFrame, threshold: float = 0.7) -> DataFrame:
    """For each player the best external name by the simple score, with 0.1 for the same team; the first best wins.

    Light keys are made once a name, and equal ones are compared once. Three kinds of pairs can score: equal keys meet by the key; a key in another one shares its
    rarest three characters with it (fewer in shorter keys); words with a Jaccard coefficient j share a word among the n - j * n + 1 rarest of either name.
    A name whose key is empty is in every other: it meets the first name of each team and the first of all, which are the only ones that can be its best.
    """
    least = max(threshold - 0.1, 1e-9)
    t = players.select(F.col("id").alias("target_id"), "name", F.col("team").alias("_t"), light_name_key("name").alias("_x"))
    c = external.select(F.col("id").alias("cand_id"), F.col("name").alias("cand"), F.col("team").alias("_c"), light_name_key("name").alias("_y"))
    c = c.groupBy("_y", "_c").agg(F.min("cand_id").alias("cand_id"), F.min_by("cand", "cand_id").alias("cand"))
    stage = stage_in(players.sparkSession)
    c = stage(c, "external")
    a, b = (stage(d.select(F.col(k).alias("name")).filter("name <> ''").distinct(), "keys") for d, k in ((t, "_x"), (c, "_y")))
    words = F.array_distinct(F.filter(F.split("name", r"\s+"), lambda w: w != ""))
    by_word = _counts(a, b, words)

    def worded(d: DataFrame) -> DataFrame:
        held = _ordered(d, words, by_word).select("name", _hashes("keys").alias("words"))
        return _under_keys(held, ["name", "words"], F.slice("words", F.lit(1), F.size("words") - F.ceil(F.size("words") * least - 1e-9).cast("int") + 1), "x")

    alike = meet(worded(a), worded(b).withColumnRenamed("x", "y")).filter(~F.arrays_overlap("x.rarer", "y.rarer"))
    alike = alike.filter(F.size(F.array_intersect("x.words", "y.words")) >= F.size(F.array_union("x.words", "y.words")) * least - 1e-9).select(F.col("x.name").alias("_x"), F.col("y.name").alias("_y"))
    pairs = a.select(F.col("name").alias("_x"), F.col("name").alias("_y")).unionByName(alike)
    for inner, outer, flip in ((a, b, False), (b, a, True)):
        pairs = pairs.unionByName(_contained(inner, outer).select(*[F.col(n).alias(m) for n, m in zip(("inner", "outer"), ("_y", "_x") if flip else ("_x", "_y"))]))
    pairs = stage(pairs.distinct(), "pairs")
    bare = c.filter("_y = ''")
    some = lambda d: d.groupBy("_c").agg(F.min("cand_id").alias("cand_id"), *[F.min_by(k, "cand_id").alias(k) for k in ("cand", "_y")])
    one = lambda d: d.agg(F.min("cand_id").alias("cand_id"), *[F.min_by(k, "cand_id").alias(k) for k in ("cand", "_y", "_c")]).filter("cand_id IS NOT NULL")
    empty = t.filter("_x = ''")
    met = t.join(pairs, "_x").join(c, "_y")
    for mine, theirs in ((empty, c), (t, bare)):
        met = met.unionByName(mine.join(some(theirs), F.col("_t") == F.col("_c")).select(met.columns)).unionByName(mine.join(F.broadcast(one(theirs))).select(met.columns))
    score = F.least(F.lit(1.0), key_score("_x", "_y") + F.when(F.col("_t") == F.col("_c"), 0.1).otherwise(0.0))
    w = Window.partitionBy("target_id").orderBy(F.col("score").desc(), "cand_id")
    return met.withColumn("score", score).filter(F.col("score") >= threshold).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("target_id", "cand_id", "cand", "score")


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner, outer: names (name, distinct, not empty) that are part of another. Each looks for its rarest three characters, or itself where it is shorter, among all stretches of the others."""
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - n + 1, F.lit(1))), lambda i: F.substring("name", i, n))
    every = lambda n: outer.filter(F.length("name") >= n).select(F.explode(F.array_distinct(pieces(F.lit(n)))).alias("k"), F.struct("name").alias("y"))
    keys = every(1).unionByName(every(2)).unionByName(every(3))
    n = keys.groupBy("k").agg(F.count("*").alias("n"))
    own = inner.select("name", F.explode(F.array_distinct(pieces(F.least(F.length("name"), F.lit(3))))).alias("k")).join(n, "k", "left")
    # A stretch that is nowhere rules the name out.
    rarest = own.groupBy("name").agg(F.min_by("k", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k")).alias("k"))
    return meet(rarest.select("k", F.struct("name").alias("x")), keys).filter(F.col("y.name").contains(F.col("x.name"))).select(F.col("x.name").alias("inner"), F.col("y.name").alias("outer"))


def map_external(external: DataFrame, players: DataFrame, id_map: DataFrame) -> DataFrame:
    """External rows -> player ids with the method: resolution at 0.85, else fuzzy at 0.7, and if nothing maps at all, the simple name score."""
    stage = stage_in(external.sparkSession)
    r = resolve(external.select("id", "name"), id_map).filter(F.col("matched") & (F.col("confidence") >= 0.85)).select("id", F.col("map_id").alias("player_id"), F.lit("entity_resolution").alias("method"), "confidence")
    r = stage(r, "resolved")
    rest = external.join(r.select("id"), "id", "left_anti")
    f = fuzzy_match(rest, players, 0.7).select(F.col("target_id").alias("id"), F.col("cand_id").alias("player_id"), F.lit("fuzzy_fallback").alias("method"), F.col("score").alias("confidence"))
    out = stage(r.unionByName(f), "mapped")
    if out.isEmpty():
        s = external_matches(players, external)
        out = s.select(F.col("cand_id").alias("id"), F.col("target_id").alias("player_id"), F.lit("simple_name_match").alias("method"), F.col("score").alias("confidence"))
    return out


def map_by_sorted_tokens(external: DataFrame, players: DataFrame, id_map: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Id map first, then sorted words at the threshold."""
    step = exact_resolution(external.select("id", "name"), id_map).filter(F.col("step").isNotNull()).select("id", F.col("map_id").alias("player_id"), F.lit("id_map").alias("method"))
    rest = external.join(step.select("id"), "id", "left_anti")
    f = best_matches(rest, players, threshold, 1, "token_sort").select(F.col("target_id").alias("id"), F.col("cand_id").alias("player_id"), F.lit("token_sort").alias("method"))
    return step.unionByName(f)


def mapping_counts(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("method").agg(F.count("*").alias("matched"), F.count_if(F.col("confidence") >= 0.85).alias("high_confidence"))


# ---------------------------------------------------------------- mappings

_NAMES = ["source_a_name", "source_b_name"]


def upsert_mappings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per id: names kept where the new one is null or empty, canonical name always set, confidence only if given."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col("o.player_id") == F.col("n.player_id"), "full_outer")
    fresh = lambda c: F.nullif(F.col(f"n.{c}"), F.lit(""))
    return j.select(
        F.coalesce("n.player_id", "o.player_id").alias("player_id"), *[F.coalesce(fresh(c), F.col(f"o.{c}")).alias(c) for c in _NAMES],
        F.when(F.col("n.player_id").isNotNull(), F.col("n.canonical_name")).otherwise(F.col("o.canonical_name")).alias("canonical_name"),
        F.coalesce("n.confidence", "o.confidence").alias("confidence"), F.coalesce("n.verified", "o.verified", F.lit(False)).alias("verified"),
    )


def add_manual(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the id map: absent ids are added, present ones get only their nulls filled."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return j.select(*[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in old.columns])


def override(mappings: DataFrame, requests: DataFrame, source: str = "source_a_name") -> tuple[DataFrame, DataFrame]:
    """requests (player_id, external_name) -> (new mappings, rejected with a reason): the name belongs to another id, or the id is missing. Accepted ones are verified with confidence 1."""
    taken = mappings.select(F.col(source).alias("external_name"), F.col("player_id").alias("_owner"))
    owner = requests.join(taken, "external_name", "left").groupBy("player_id", "external_name").agg(F.max(F.when(F.col("_owner") != F.col("player_id"), F.col("_owner"))).alias("_other"))
    known = mappings.select("player_id").distinct().withColumn("_known", F.lit(True))
    checked = owner.join(known, "player_id", "left").withColumn("reason", F.when(F.col("_known").isNull(), "missing").when(F.col("_other").isNotNull(), "conflict"))
    ok = checked.filter(F.col("reason").isNull()).select(F.col("player_id").alias("_id"), F.col("external_name").alias("_name"))
    j = mappings.join(ok, F.col("player_id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    new = j.withColumns({source: F.when(hit, F.col("_name")).otherwise(F.col(source)), "verified": hit | F.col("verified"), "confidence": F.when(hit, 1.0).otherwise(F.col("confidence"))}).drop("_id", "_name")
    return new, checked.filter(F.col("reason").isNotNull()).select("player_id", "external_name", "reason")


def lookup(mappings: DataFrame, verified: bool | None = None, limit: int | None = None, offset: int = 0, **equal) -> DataFrame:
    """Mappings by any column, by verification, in order of id, paged."""
    df = mappings
    for c, v in equal.items():
        df = df.filter(F.col(c) == v)
    if verified is not None:
        df = df.filter(F.col("verified") == verified)
    df = df.orderBy("player_id").offset(offset)
    return df if limit is None else df.limit(limit)


def apply_changes(mappings: DataFrame, confidence: DataFrame | None = None, verify: DataFrame | None = None, delete: DataFrame | None = None) -> DataFrame:
    """Confidence updates within 0 to 1 (others are ignored), verification (sets 1), deletions."""
    df = mappings
    if confidence is not None:
        c = confidence.filter(F.col("confidence").between(0, 1)).select("player_id", F.col("confidence").alias("_c"))
        df = df.join(c, "player_id", "left").withColumn("confidence", F.coalesce("_c", "confidence")).drop("_c")
    if verify is not None:
        v = verify.select("player_id").distinct().withColumn("_v", F.lit(True))
        df = df.join(v, "player_id", "left").withColumn("confidence", F.when(F.col("_v"), 1.0).otherwise(F.col("confidence"))).withColumn("verified", F.coalesce("_v", "verified")).drop("_v")
    return df if delete is None else df.join(delete.select("player_id"), "player_id", "left_anti")


def enriched(players: DataFrame, mapping_a: DataFrame, source_a: DataFrame, mapping_b: DataFrame, source_b: DataFrame, columns_a=("xg_per_90", "xa_per_90"), columns_b=("blocks_per_90", "interventions_per_90", "passes_per_90")) -> DataFrame:
    """Players with the columns of both sources through their mappings (id -> player_id); missing ones are 0."""
    side = lambda m, s, cols: m.select("id", "player_id").join(s.select("id", *cols), "id").groupBy("player_id").agg(*[F.max(c).alias(c) for c in cols])
    df = players.join(side(mapping_a, source_a, columns_a), "player_id", "left").join(side(mapping_b, source_b, columns_b), "player_id", "left")
    return df.fillna(0.0, [*columns_a, *columns_b])
