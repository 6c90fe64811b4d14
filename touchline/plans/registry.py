"""Queries and their SQL by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Rounded values get this much first, in both engines, so that exact ties do not depend on the last bit.
TIE = 1e-9
BODY = "/* body */"


def r(c: Column | str, n: int = 4, name: str | None = None) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + TIE, n).alias(name or c)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            head, _, body = sql.rpartition(BODY)
            ORACLES[name] = head + re.sub(r", ([34])\) AS ", rf" + {TIE}, \1) AS ", body)
        return f

    return add
