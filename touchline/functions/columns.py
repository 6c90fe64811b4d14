"""Column functions shared by the operators. All are built-in expressions; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIONS = ["GK", "DEF", "MID", "FWD"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column, low: float, high: float) -> Column:
    """c between low and high; null stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def finite(c: Column) -> Column:
    """Null in place of NaN and infinities."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def filled(c: Column, default: float = 0.0) -> Column:
    """The default in place of null, NaN and infinities."""
    return F.coalesce(finite(c), F.lit(float(default)))


def parsed(c: Column, default: float | None = 0.0) -> Column:
    """A number out of text with commas and blanks; the default (or null) if there is none."""
    number = F.expr("NULL").cast("double") if c is None else F.replace(F.replace(F.trim(col(c).cast("string")), F.lit(",")), F.lit(" ")).try_cast("double")
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def parsed_int(c: Column) -> Column:
    """The digits of a text as a whole number; 0 without digits."""
    return F.coalesce(F.regexp_replace(col(c).cast("string"), r"[^0-9]", "").try_cast("long"), F.lit(0).cast("long"))


def parsed_loose(c: Column) -> Column:
    """The number that is left when all but digits, points and minus signs go; 0 if none is."""
    return F.coalesce(F.regexp_replace(col(c).cast("string"), r"[^0-9.\-]", "").try_cast("double"), F.lit(0.0))


def present(*cs: Column) -> Column:
    """The first that is neither null nor 0, else the last."""
    cs = [col(c) for c in cs]
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cs[:-1]], cs[-1])


def position_of(c: Column) -> Column:
    """GK, DEF, MID or FWD from a number 1 to 4 or a short name; MID otherwise."""
    p = F.upper(F.trim(col(c).cast("string")))
    return F.when(p.isin("1", "GK", "GKP"), "GK").when(p.isin("2", "DEF"), "DEF").when(p.isin("3", "MID"), "MID").when(p.isin("4", "FWD"), "FWD").otherwise("MID")


def by_position(c: Column, gk, defender, mid, fwd, other=None) -> Column:
    """A value by position; other positions get `other`, or what midfielders get."""
    c = col(c)
    return F.when(c == "GK", F.lit(gk)).when(c == "DEF", F.lit(defender)).when(c == "FWD", F.lit(fwd)).when(c == "MID", F.lit(mid)).otherwise(F.lit(mid if other is None else other))


def mean_of(array: Column) -> Column:
    """Mean of an array's values; null for an empty or null array."""
    array = col(array)
    return F.when(F.size(array) > 0, F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(array))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, an aggregate; null where either side does not vary."""
    x, y = col(x), col(y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


# ---------------------------------------------------------------- names

_ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüçñ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucn"


def folded(c: Column, y: bool = True) -> Column:
    """Accents off: eight classes of lower-case letters, or seven without y."""
    return F.translate(col(c), _ACCENTED + "ýÿ" * y, _PLAIN + "yy" * y)


def name_key(c: Column) -> Column:
    """A name for comparison: lower case, no accents, no lone j or r and no Roman numerals at the ends, no punctuation, single blanks."""
    x = folded(F.trim(F.lower(F.coalesce(col(c), F.lit("")))))
    x = F.regexp_replace(x, r"\s+[jr]\.?\s*$", "")
    x = F.regexp_replace(x, r"\s+[ivx]+$", "")
    x = F.regexp_replace(x, r"^\s*[ivx]+\s+", "")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def light_name_key(c: Column) -> Column:
    """The lighter form: y keeps its accent; punctuation and leading numerals stay."""
    x = folded(F.trim(F.lower(F.coalesce(col(c), F.lit("")))), y=False)
    x = F.regexp_replace(x, r"\s+[jr]\.?\s*$", "")
    return F.trim(F.regexp_replace(x, r"\s+[ivx]+$", ""))


# Particles that stay in lower case.
PARTICLES = ["van", "de", "da", "del", "der", "den", "von", "le", "la", "el"]


def canonical_name(c: Column) -> Column:
    """A name for display: single blanks, no points after initials, no lone j or r at the end; particles in lower case, short words in capitals kept, others capitalised."""
    x = F.trim(F.regexp_replace(F.trim(F.coalesce(col(c), F.lit(""))), r"\s+", " "))
    x = F.regexp_replace(x, r"\b([A-Z])\.\s+", "$1 ")
    x = F.regexp_replace(x, r"\s+[JjRr]\.?\s*$", "")

    def word(w: Column) -> Column:
        capitals = (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) <= 3)
        return F.when(capitals, w).when(F.lower(w).isin(PARTICLES), F.lower(w)).otherwise(F.concat(F.upper(w.substr(1, 1)), F.lower(F.substring(w, 2, 1000))))

    return F.when(x == "", "").otherwise(F.array_join(F.transform(F.split(x, " "), word), " "))


def key_score(x: Column, y: Column) -> Column:
    """Of two light keys: 1 if equal, 0.9 if one holds the other, else the Jaccard coefficient of their words."""
    x, y = col(x), col(y)
    u, v = (F.filter(F.array_distinct(F.split(k, r"\s+")), lambda w: w != "") for k in (x, y))
    shared, joint = F.size(F.array_intersect(u, v)), F.size(F.array_union(u, v))
    jaccard = F.when((F.size(u) > 0) & (F.size(v) > 0), shared / F.greatest(joint, F.lit(1))).otherwise(0.0)
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.9).otherwise(jaccard)


def name_score(a: Column, b: Column) -> Column:
    return key_score(light_name_key(a), light_name_key(b))


# ---------------------------------------------------------------- Poisson

FACTORIALS = [1, 1, 2, 6, 24, 120, 720]


def goal_probabilities(rate: Column) -> Column:
    """Array of the probabilities of 0 to 6 goals."""
    rate = col(rate)
    return F.array(*[F.exp(-rate) * F.pow(rate, F.lit(k)) / f for k, f in enumerate(FACTORIALS)])


def outcome(goals_for: Column, goals_against: Column) -> tuple[Column, Column, Column]:
    """Win, draw and loss over the 7 by 7 grid, scaled to a sum of 1."""
    n = len(FACTORIALS)
    cell = lambda i, j: goals_for[i] * goals_against[j]
    win = sum((cell(i, j) for i in range(n) for j in range(i)), F.lit(0.0))
    draw = sum((cell(i, i) for i in range(n)), F.lit(0.0))
    loss = sum((cell(i, j) for i in range(n) for j in range(i + 1, n)), F.lit(0.0))
    total = win + draw + loss
    return tuple(F.when(total > 0, x / total).otherwise(0.0) for x in (win, draw, loss))
