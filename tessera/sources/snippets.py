"""Snippets: which names one binds itself, and which it needs from elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import catalog
from tessera.sources import modules, scopes
from tessera.sources.scopes import NAME
from tessera.sources.typescript import KINDS

CLAUSE = rf"""^\s*import\s+(?:type\s+)?(?:({NAME})\s*,?\s*)?(?:\*\s*as\s+({NAME})|\{{([^}}]*)\}})?\s*from\b"""


def bound_names(snippets: DataFrame) -> DataFrame:
    """file, name: the names that each snippet (file, text) binds at its top: what it
    imports, declares, or takes out of an object or array by a pattern."""
    parsed = scopes.parsed(snippets)
    top = parsed.where((F.col("scope") == -1) & F.col("kind").isin(*KINDS, "namespace") & F.col("name").isNotNull()).select("file", "name")
    inside = parsed.where("role = 'pattern' and kind = 'member'")
    # `a` and `a = 1` bind a, `a: b` binds b
    taken = inside.select("file", F.when(F.col("type").isNull(), F.col("name")).otherwise(F.regexp_extract("type", rf"^({NAME})$", 1)).alias("name")).where("name <> ''")
    clauses = modules.statements(snippets, modules.IMPORT).select("file", F.regexp_extract("s", CLAUSE, 1).alias("a"), F.regexp_extract("s", CLAUSE, 2).alias("b"), F.regexp_extract("s", CLAUSE, 3).alias("listed"))
    whole = clauses.select("file", F.explode(F.array("a", "b")).alias("name")).where("name <> ''")
    named = modules.items(clauses.select("file", "listed"), F.col("listed")).select("file", F.col("as_name").alias("name"))
    return top.union(taken).union(whole).union(named).distinct()


def needed_imports(snippets: DataFrame, exports: DataFrame) -> DataFrame:
    """file, source, names: the import that each snippet needs from each source.

    exports: package, file, name, is_index, is_src, as `catalog.import_names`
    takes them. A name that a snippet binds itself, or that comes behind a
    point, is not needed.
    """
    words = scopes.tokens(snippets)
    before = F.lag("token").over(scopes.Window.partitionBy("file").orderBy("ord"))
    used = words.withColumn("before", before).where(F.col("token").rlike(rf"^{NAME}$") & ~F.coalesce(F.col("before").isin(".", "?."), F.lit(False))).select("file", F.col("token").alias("name")).distinct()
    free = used.join(bound_names(snippets), ["file", "name"], "left_anti")
    owned = catalog.import_names(exports).select(F.col("file").alias("source"), F.explode(F.split("names", ",")).alias("name"))
    return free.join(owned, "name").groupBy("file", "source").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
