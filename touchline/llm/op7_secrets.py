"""Secret scan: fixed formats, and sliding-window Shannon entropy (native).

Base spans come from three formats (assignments, access keys, hexadecimal runs).
The method adds entropy spans: over every candidate string (a run of at least
WINDOW token characters) a window slides one character at a time. Its character
counts (five bits each) and the sum of c*log2(c) over them (in whole 2**-32) are carried
along and changed for the character that enters and the one that leaves only, so each
step costs the same and nothing drifts. A window whose entropy reaches the limit of the
candidate's character class opens or prolongs a span. Candidates on the allow-list
(UUIDs, words joined by separators, counting sequences, published sample keys) and
spans inside a base span are suppressed; base spans always stay.

The work grows with the length of a text: running sums and maxima over its matches are
taken in chunks, and no expression that reads a whole text stands inside a step.

Positions are code points, end exclusive. Defined results: null and empty texts
have no spans (counts 0, spans '', base_sha256 of the empty text); repeated rows
give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import table

WINDOW = 20
#: Bits by character class of a candidate. The most that a window can hold is log2(20) = 4.32.
LIMITS = {"hex": 2.9, "mixed": 3.6, "letters": 4.1}

# The formats of base spans, in the order of their kinds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "entropy"]
# What is on the allow-list beside words that are joined by separators.
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SEQUENCE = "0123456789|abcdef|ABCDEF"
SAMPLE = "EXAMPLE(?:KEY)?$"

#: Lowest code of a candidate's characters, counts in one 64-bit word, words for codes up to that of z.
_LOW, _IN_WORD, _WORDS = 43, 12, 7
_UNIT = 1 << 32
_CHUNK = 256

_NONE = "array<struct<start:int,kind:int,end:int,found:string>>"


def given(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, also where f uses it inside lambdas."""
    return F.element_at(F.transform(F.array(x), f), 1)


def running(items: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """For each item the joined values (from 0) of the items before it."""

    def grown(values: Column, start: Column) -> Column:
        states = F.aggregate(values, F.array(start), lambda a, v: F.concat(a, F.array(join(F.element_at(a, -1), v))))
        return F.slice(states, F.lit(1), F.size(values))

    def over(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), join))
        return F.flatten(F.zip_with(chunks, given(totals, lambda t: grown(t, F.lit(0))), grown))

    def cut(values: Column) -> Column:
        last = F.greatest(F.floor((F.size(values) - 1) / _CHUNK), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * _CHUNK + 1, F.lit(_CHUNK)))

    return given(F.transform(items, value), lambda v: given(cut(v), over))


def found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """Leftmost matches of the pattern, one after the other, whose group has the least length: start, kind, end, matched text."""
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    items = F.zip_with(F.zip_with(whole, part, lambda a, b: F.struct(a.alias("whole"), b.alias("part"))), F.split(text, pattern, -1), lambda a, g: F.struct(a["whole"].alias("whole"), a["part"].alias("part"), g.alias("gap")))
    items = F.filter(items, lambda x: x["whole"].isNotNull())  # one gap more than matches

    def spans(items: Column) -> Column:
        at = running(items, lambda x: F.length(x["gap"]) + F.length(x["whole"]), lambda a, b: a + b)

        def span(x: Column, before: Column) -> Column:
            start = before + F.length(x["gap"])
            return F.when(F.length(x["part"]) >= least, F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["whole"])).alias("end"), x["whole"].alias("found")))

        return F.filter(F.zip_with(items, at, span), lambda x: x.isNotNull())

    return F.when(text.rlike(pattern), given(items, spans)).otherwise(F.array().cast(_NONE))


def allowed(text: Column) -> Column:
    joined = text.rlike("^[A-Za-z][A-Za-z_/+=-]*$") & text.rlike("[-_/+=][A-Za-z]")
    counting = text.rlike(f"^(?:{SEQUENCE})") & (F.length(F.regexp_replace(text, SEQUENCE, "")) <= 4)
    return joined | text.rlike(UUID) | counting | text.rlike(SAMPLE)


def hot_range(text: Column, limit: Column, window: int = WINDOW) -> Column:
    """first and last (from 1) of the characters in windows whose entropy reaches the limit; -1 if none does."""
    if not 1 < window < 32:
        raise ValueError("a window has 2 to 31 characters")
    part = [round(n * math.log2(n) * _UNIT) if n else 0 for n in range(window + 1)]
    more = F.array(*[F.lit(b - a) for a, b in zip(part, part[1:])])  # by the count before one more
    # A window is hot if its sum is at most this.
    bound = F.floor((math.log2(window) + 1e-9 - limit) * float(window * _UNIT)).cast("long")
    codes = F.transform(F.slice(F.split(text, ""), F.lit(1), F.length(text)), lambda c: F.ascii(c) - _LOW)
    moves = given(codes, lambda c: F.zip_with(c, F.slice(F.concat(F.array_repeat(F.lit(-1), window), c), F.lit(1), F.size(c)), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves"))))
    word, bits = lambda k: F.floor(k / _IN_WORD).cast("int"), lambda k: 5 * (k % _IN_WORD)

    def step(acc: Column, x: Column) -> Column:
        count = lambda k: F.call_function("shiftright", F.element_at(acc["counts"], word(k) + 1), bits(k)).bitwiseAND(F.lit(31)).cast("int")
        enters, leaves, full = x["enters"], x["leaves"], x["leaves"] >= 0
        gone = F.when(full, F.element_at(more, count(leaves))).otherwise(F.lit(0).cast("long"))
        come = F.element_at(more, count(enters) + 1 - F.when(enters == leaves, 1).otherwise(0))
        one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), bits(k))
        counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == word(enters), one(enters)).otherwise(F.lit(0).cast("long")) - F.when(full & (j == word(leaves)), one(leaves)).otherwise(F.lit(0).cast("long")))
        i, s = acc["i"] + 1, acc["s"] + come - gone
        hot = (i >= window) & (s <= acc["bound"])
        first = F.when(hot & (acc["first"] < 0), i - window + 1).otherwise(acc["first"])
        return F.struct(i.alias("i"), s.alias("s"), counts.alias("counts"), first.alias("first"), F.when(hot, i).otherwise(acc["last"]).alias("last"), acc["bound"].alias("bound"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("s"), F.array_repeat(F.lit(0).cast("long"), _WORDS).alias("counts"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), bound.alias("bound"))
    return F.aggregate(moves, start, step)


def entropy_limit(text: Column, limits: dict[str, float]) -> Column:
    digit, letter = text.rlike("[0-9]"), text.rlike("[A-Za-z]")
    return F.when(digit & letter & text.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), limits["hex"]).when(digit & letter, limits["mixed"]).when(letter, limits["letters"]).otherwise(F.lit(99.0))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, limits: dict[str, float] | None = None) -> DataFrame:
    """doc_id and spans: array of (start, kind, end, found), ordered; kind is an index of KINDS."""
    limits = limits or LIMITS
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    base = F.concat(found(text, ASSIGN, 0, 2, 8), found(text, ACCESS, 1), found(text, HEX, 2))
    rows = rows.select("doc_id", base.alias("base"), found(text, CANDIDATE, 3).alias("candidates"))
    kept = F.filter("candidates", lambda c: ~allowed(c["found"]))
    ranged = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["found"].alias("found"), hot_range(c["found"], entropy_limit(c["found"], limits), window).alias("r")))
    spans = F.transform(
        F.filter(ranged, lambda c: c["r"]["first"] > 0),
        lambda c: F.struct((c["start"] + c["r"]["first"] - 1).alias("start"), F.lit(3).alias("kind"), (c["start"] + c["r"]["last"]).alias("end"), c["found"].substr(c["r"]["first"], c["r"]["last"] - c["r"]["first"] + 1).alias("found")),
    )
    spans = F.when(F.size("candidates") > 0, spans).otherwise(F.array().cast(_NONE))
    rows = rows.select("doc_id", "base", spans.alias("more"))
    # In order of start and kind: a span lies in a base span if one before it ends there or later.
    rows = rows.select("doc_id", F.array_sort(F.concat("base", "more")).alias("spans"), (F.size("more") > 0).alias("mixed"))
    until = running(F.col("spans"), lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0), lambda a, b: F.greatest(a, b))
    told = F.zip_with("spans", until, lambda s, e: F.when((s["kind"] < 3) | (s["end"] > e), s))
    return rows.select("doc_id", F.when(F.col("mixed"), F.filter(told, lambda s: s.isNotNull())).otherwise(F.col("spans")).alias("spans"))


def _joined(spans: Column) -> Column:
    name = lambda k: F.when(k == 0, KINDS[0]).when(k == 1, KINDS[1]).when(k == 2, KINDS[2]).otherwise(KINDS[3])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = _joined(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op7_secrets": op7_secrets}
ORACLES: dict[str, str] = {}
