"""Diagnostics: distinct, sorted, taken apart and explained."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import first_of, group_or_null


def distinct(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of the parts with one row for each key: the values are those of its
    last row, the place is that of its first."""
    rows = reduce(DataFrame.unionByName, parts)
    rest = [c for c in rows.columns if c not in [*keys, "ord"]]
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ord").alias("r"), F.min("ord").alias("place"))
    return got.select(*keys, "place", "r.*")


def first_with_total(rows: DataFrame, order: list[str], most: int = 10) -> DataFrame:
    """The first rows, the number of all, and whether some are left out."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > most)


#: The order of diagnostics: by file, none first, then line, column, code and place.
IN_ORDER = ("file", "line", "col", "code", "ord")


#: The shapes of messages that name a type, and those that name a property.
TYPE_PATTERNS = (r"Type '([^']+)' is not assignable", r"Argument of type '([^']+)'", r"missing in type '([^']+)'", r"on type '([^']+)'")
PROPERTY_PATTERNS = (r"Property '([^']+)'", r"property '([^']+)'")


#: All shapes of messages. The first that a message has names its types; each that it has names a property.
TYPES = (
    r"Type '([^']+)' is not assignable to type '([^']+)'",
    r"Argument of type '([^']+)' is not assignable to parameter of type '([^']+)'",
    r"Type ([\w$]+(?:\.[\w$]+)*) is not assignable to type ([\w$]+(?:\.[\w$]+)*)",
    r"Argument of type ([\w$]+(?:\.[\w$]+)*) is not assignable to parameter of type ([\w$]+(?:\.[\w$]+)*)",
    r"Property '[^']+' does not exist on type '([^']+)'",
    r"Property '[^']+' is missing in type '([^']+)' but required in type '([^']+)'",
    r"Property ([\w$]+) is missing in type ([\w$]+(?:\.[\w$]+)*) but required in type ([\w$]+(?:\.[\w$]+)*)",
    r"Type '([^']+)' has no properties in common with type '([^']+)'",
)
PROPERTIES = (r"Property '([^']+)' does not exist", r"Property '([^']+)' is missing", r"Property ([\w$]+) does not exist", r"Property ([\w$]+) is missing", r"Did you mean '([^']+)'\?")


def message_evidence(rows: DataFrame) -> DataFrame:
    """`rows` with types and properties, the names that their messages give; the texts of object types are none."""
    text = F.col("message")

    def groups(pattern: str) -> Column:
        return F.array(*[group_or_null(text, pattern, i + 1) for i in range(re.compile(pattern).groups)])

    types = F.coalesce(*[F.when(text.rlike(p), groups(p)) for p in TYPES], F.array().cast("array<string>"))
    named = F.filter(types, lambda x: x.isNotNull() & ~(x.startswith("{") & x.endswith("}")))
    return rows.withColumn("types", named).withColumn("properties", F.array_compact(F.array(*[group_or_null(text, p) for p in PROPERTIES])))


def message_parts(rows: DataFrame) -> DataFrame:
    text = F.col("message")
    return rows.withColumn("type_name", first_of(text, *TYPE_PATTERNS)).withColumn("property_name", first_of(text, *PROPERTY_PATTERNS))


def explanation(code: Column) -> Column:
    """What kind of explanation a code gets."""
    return F.when(code.isin(2322, 2345), "not assignable").when(code == 2339, "unknown property").when(code == 2741, "missing property").otherwise("other")
