"""Catalogs of packages and symbols: list, search, resolve, merge.

A symbol has ord (its place in the scan), name, kind and file; a package has
name and ord. First and last always mean by ord and then by the columns named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import matches


def first_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in `order`."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def last_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the last by `order`: summed before the shuffle, not sorted."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def packages(files: DataFrame, root: str) -> DataFrame:
    """Packages with their files' number, the root first and named (root): place, name, n_files."""
    name = F.when(F.col("package") == root, "(root)").otherwise(F.col("package"))
    found = files.groupBy("package").agg(F.count("*").alias("n_files")).select(name.alias("name"), "n_files")
    order = Window.orderBy((F.col("name") != "(root)"), "name")
    return found.withColumn("place", F.row_number().over(order).cast("long"))


def resolve_package(selectors: DataFrame, packages: DataFrame) -> DataFrame:
    """The first package that each selector names: exactly, without a leading slash, or by its end.

    Packages are joined by all ends of their names, so that no selector is
    compared with every package.
    """
    begins = F.explode(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1)))).alias("begin")
    ends = packages.select("name", "ord", begins).select("name", "ord", F.expr("substring(name, begin)").alias("selector"), F.when(F.col("begin") == 1, 0).otherwise(2).alias("how"))
    bare = selectors.select("selector", F.ltrim("selector", F.lit("/")).alias("name")).where("selector <> name").join(packages, "name")
    found = selectors.join(ends, "selector").select("selector", "name", "ord", "how").union(bare.select("selector", "name", "ord", F.lit(1)))
    first = found.groupBy("selector").agg(F.min_by("name", F.struct("how", "ord")).alias("package"))
    return selectors.join(first, "selector", "left")


def nearest_folder(files: DataFrame, folders: DataFrame) -> DataFrame:
    """file, folder: the deepest of `folders` (folder, ending in a slash) that holds each file; null if none does.

    A file is joined by the folders on its own path and by no others, so that
    files and folders may both be many.
    """
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n > 0, F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))).otherwise(""))
    found = files.select("file", F.explode(above).alias("folder")).join(folders.select("folder").distinct(), "folder")
    return files.select("file").join(found.groupBy("file").agg(F.max_by("folder", F.length("folder")).alias("folder")), "file", "left")


def list_symbols(symbols: DataFrame, pattern: str | None = None, kind: str = "all", file: str | None = None, limit: int = 100, index_file: str | None = None, collation: str | None = None) -> DataFrame:
    """Symbols that match, those of the index file first, then by name, with the total before the limit.
    Names are in code point order, or in the order of a collation (`UNICODE`: as readers sort)."""
    found = symbols
    if pattern is not None:
        found = found.where(matches(F.col("name"), pattern))
    if kind != "all":
        found = found.where(F.col("kind") == kind)
    if file is not None:
        found = found.where(matches(F.col("file"), file))
    total = found.agg(F.count("*").alias("total"))
    first = F.col("file") == index_file if index_file is not None else F.lit(False)
    name = F.col("name") if collation is None else F.collate("name", collation)
    top = found.withColumn("is_index", first).orderBy(F.desc("is_index"), name, "ord").limit(limit)
    return top.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def search(symbols: DataFrame, members: DataFrame | None = None, has: str | None = None, bases: DataFrame | None = None, extends: str | None = None, pattern: str | None = None, query: str | None = None, limit: int | None = 25) -> DataFrame:
    """Types in the order of the scan, by name, by a member and by a direct base.

    `pattern` replaces `query`. members: ord, member; bases: ord, base.
    """
    found = symbols
    if (name := pattern if pattern is not None else query) is not None:
        found = found.where(matches(F.col("name"), name))
    if has is not None:
        found = found.join(members.where(F.col("member") == has).select("ord"), "ord", "left_semi")
    if extends is not None:
        found = found.join(bases.where(F.col("base") == extends).select("ord"), "ord", "left_semi")
    return found if limit is None else found.orderBy("ord").limit(limit)


def import_names(files: DataFrame) -> DataFrame:
    """Which file each name is imported from: an index file alone if there is one,
    else files under src, else the rest, the first by path: package, file, names."""
    rank = F.when(F.col("is_index"), 0).when(F.col("is_src"), 1).otherwise(2)
    ranked = files.withColumn("rank", rank)
    best = ranked.groupBy("package").agg(F.min("rank").alias("best"))
    open_ = ranked.join(best, "package").where((F.col("best") > 0) | (F.col("rank") == 0))
    owned = open_.groupBy("package", "name").agg(F.min_by("file", F.struct("rank", "file")).alias("file"))
    return owned.groupBy("package", "file").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def resolve_aliases(exports: DataFrame, aliases: DataFrame, declarations: DataFrame) -> DataFrame:
    """Each export with the symbol it stands for and that symbol's first declaration with a name.

    exports: export, symbol. aliases: symbol, target; a re-export may lead to
    another alias, which is followed once more. declarations: symbol, ord, name.
    Exports without such a declaration keep a null name.
    """
    step = aliases.groupBy("symbol").agg(F.min("target").alias("target"))
    rows = exports
    for _ in range(2):
        rows = rows.join(step, "symbol", "left").select("export", F.coalesce("target", "symbol").alias("symbol"))
    first = declarations.where("name is not null").groupBy("symbol").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name"))
    return rows.join(first, "symbol", "left").select("export", "symbol", "ord", "name")
