"""Which declaration a name in a file stands for, through imports and re-exports of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import masked
from tessera.operators.pointers import ends
from tessera.operators.rounds import held
from tessera.sources.scopes import NAME, nested, tokens

IMPORT = rf"""\bimport\s+(?:type\s+)?(?:({NAME})\s*,?\s*)?(?:\*\s*as\s+({NAME})|\{{([^}}]*)\}})?\s*from\s*["']([^"'\n]+)["']"""
EXPORT = rf"""\bexport\s+(?:type\s+)?(?:\*\s*(?:as\s+({NAME}))?|\{{([^}}]*)\}})\s*(?:from\s*["']([^"'\n]+)["'])?"""
DEFAULT = rf"\bexport\s+default\s+({NAME})\s*(?:;|$)"
ITEM = rf"^\s*(?:type\s+)?({NAME})(?:\s+as\s+({NAME}))?\s*$"
LOCAL, OUT = "local", "export"


def node(file: Column | str, space: str, name: Column | str) -> Column:
    """A name in a file: as the file's own texts use it, or as it exports it."""
    return F.concat_ws("\n", F.col(file) if isinstance(file, str) else file, F.lit(space), F.col(name) if isinstance(name, str) else name)


def statements(files: DataFrame, pattern: str) -> DataFrame:
    """file and the statements of a pattern that don't lie in comments or texts."""
    code = masked(F.col("text"))
    # a statement counts if the code, texts blanked, begins it in the same way at the same place
    word = F.lit(rf"\b({'import' if 'import' in pattern[:10] else 'export'})\b")
    live = files.select("file", "text", F.regexp_count(code, word).alias("n")).where("n > 0")
    return live.select("file", F.explode(F.regexp_extract_all(F.regexp_replace("text", r"(?m)^\s*//.*$|/\*[\s\S]*?\*/", ""), F.lit(pattern), F.lit(0))).alias("s"))


def items(rows: DataFrame, listed: Column) -> DataFrame:
    """`rows` with one row for each name in braces: name and as_name."""
    one = rows.withColumn("item", F.explode(F.split(listed, ","))).where(F.col("item").rlike(ITEM))
    name = F.regexp_extract("item", ITEM, 1)
    return one.select(*rows.columns, name.alias("name"), F.coalesce(F.nullif(F.regexp_extract("item", ITEM, 2), F.lit("")), name).alias("as_name"))


def resolved(rows: DataFrame, files: DataFrame) -> DataFrame:
    """`rows` (file, module, ...) with target, the file that a relative module names; others go."""
    stem = F.regexp_replace("file", r"(?:/index)?(?:\.d)?\.[cm]?tsx?$", "")
    known = files.select(F.col("file").alias("target"), stem.alias("stem")).groupBy("stem").agg(F.min("target").alias("target"))
    folder = F.split(F.regexp_replace("file", r"/?[^/]*$", ""), "/")
    walk = F.aggregate(
        F.split(F.regexp_replace("module", r"\.[cm]?[jt]sx?$", ""), "/"),
        folder,
        lambda at, part: F.when(part.isin(".", ""), at).when(part == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(part))),
    )
    path = F.regexp_replace(F.array_join(F.filter(walk, lambda x: F.lit(True)), "/"), "(?:^|/)index$", "")
    return rows.where(F.col("module").startswith(".")).withColumn("stem", F.regexp_replace(path, "^/(?=[^/])", "/")).join(known, "stem").drop("stem", "module")


def pointers(files: DataFrame, declared: DataFrame) -> DataFrame:
    """node and next of all names that stand for others. `declared` has file, name, exported, is_default."""
    imports = statements(files, IMPORT).select("file", F.regexp_extract("s", IMPORT, 1).alias("default"), F.regexp_extract("s", IMPORT, 3).alias("listed"), F.regexp_extract("s", IMPORT, 4).alias("module"))
    imports = resolved(imports, files)
    named = items(imports.select("file", "target", "listed"), F.col("listed")).select(node("file", LOCAL, "as_name").alias("node"), node("target", OUT, "name").alias("next"))
    default = imports.where("default <> ''").select(node("file", LOCAL, "default").alias("node"), node("target", OUT, F.lit("default")).alias("next"))
    exports = statements(files, EXPORT).select("file", F.regexp_extract("s", EXPORT, 2).alias("listed"), F.regexp_extract("s", EXPORT, 3).alias("module"), F.col("s").rlike(r"export\s+(?:type\s+)?\*\s*from").alias("star"))
    own = items(exports.where("module = ''").select("file", "listed"), F.col("listed")).select(node("file", OUT, "as_name").alias("node"), node("file", LOCAL, "name").alias("next"))
    outer = resolved(exports.where("module <> ''"), files)
    passed = items(outer.where("not star").select("file", "target", "listed"), F.col("listed")).select(node("file", OUT, "as_name").alias("node"), node("target", OUT, "name").alias("next"))
    said = statements(files, DEFAULT).select(node("file", OUT, F.lit("default")).alias("node"), node("file", LOCAL, F.regexp_extract("s", DEFAULT, 1)).alias("next"))
    marked = declared.where("exported").select(node("file", OUT, F.when(F.col("is_default"), F.lit("default")).otherwise(F.col("name"))).alias("node"), node("file", LOCAL, "name").alias("next"))
    rows = held(named.union(default).union(own).union(passed).union(said).union(marked).distinct())
    more = starred(rows, outer.where("star").select("file", "target").distinct())
    # a name has one meaning: its own statements go before what stars bring
    return rows.groupBy("node").agg(F.min("next").alias("next")).unionByName(more.join(rows.select("node").distinct(), "node", "left_anti"))


def starred(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """node and next of the names that a file exports because a file it re-exports whole does.

    Rounds follow the longest chain of stars; each carries what the round before has brought.
    """
    parts = F.split("node", "\n")
    known = held(rows.select(parts[0].alias("target"), parts[1].alias("space"), parts[2].alias("name")).where((F.col("space") == OUT) & (F.col("name") != "default")).select("target", "name"))
    stars = held(stars)
    if stars.isEmpty():
        return rows.limit(0)
    new, all_, out = known, known, None
    while not new.isEmpty():
        brought = new.join(stars, "target").select("file", "name", "target")
        fresh = held(brought.join(all_.select(F.col("target").alias("file"), "name"), ["file", "name"], "left_anti").groupBy("file", "name").agg(F.min("target").alias("target")))
        step = fresh.select(node("file", OUT, "name").alias("node"), node("target", OUT, "name").alias("next"))
        out = step if out is None else out.unionByName(step)
        new = fresh.select(F.col("file").alias("target"), "name")
        all_ = all_.unionByName(new)
    return out


def names(files: DataFrame, declared: DataFrame) -> DataFrame:
    """file, name, home, symbol: the file and name of the declaration that each name of a file
    stands for, declared there or imported. What comes from no known file is left out."""
    last = ends(pointers(files, declared))
    start, stop = F.split("node", "\n"), F.split("end", "\n")
    far = last.select(start[0].alias("file"), start[1].alias("space"), start[2].alias("name"), stop[0].alias("home"), stop[1].alias("at"), stop[2].alias("symbol"))
    there = declared.select(F.col("file").alias("home"), F.col("name").alias("symbol")).distinct()
    imported = far.where((F.col("space") == LOCAL) & (F.col("at") == LOCAL)).join(there, ["home", "symbol"], "left_semi").select("file", "name", "home", "symbol")
    own = declared.select("file", "name", F.col("file").alias("home"), F.col("name").alias("symbol")).distinct()
    return own.unionByName(imported.join(own.select("file", "name"), ["file", "name"], "left_anti"))


def exported_names(files: DataFrame, declared: DataFrame) -> DataFrame:
    """file, name, home, symbol: what each file exports under which name, re-exports included."""
    last = ends(pointers(files, declared))
    start, stop = F.split("node", "\n"), F.split("end", "\n")
    rows = last.select(start[0].alias("file"), start[1].alias("space"), start[2].alias("name"), stop[0].alias("home"), stop[1].alias("at"), stop[2].alias("symbol"))
    return rows.where((F.col("space") == OUT) & (F.col("at") == LOCAL)).select("file", "name", "home", "symbol")


#: Names in the code parts of templates.
INSIDE = r"\$\{[^{}`]*\}"


def ambient(declared: DataFrame) -> DataFrame:
    """name, home, symbol of names that one file alone declares: what they stand for in files that neither declare nor import them."""
    return declared.groupBy("name").agg(F.min("file").alias("home"), F.max("file").alias("__last")).where("home = __last").select("name", "home", F.col("name").alias("symbol"))


def identified(rows: DataFrame, names_: DataFrame, around: DataFrame | None) -> DataFrame:
    """`rows` (file, name, ...) with home and symbol of what the name stands for; unknown names go."""
    if around is None:
        return rows.join(names_, ["file", "name"])
    far = around.select("name", F.col("home").alias("__home"), F.col("symbol").alias("__symbol"))
    rows = rows.join(names_, ["file", "name"], "left").join(far, "name", "left")
    return rows.withColumn("symbol", F.coalesce("symbol", "__symbol")).withColumn("home", F.coalesce("home", "__home")).drop("__home", "__symbol").where("home is not null")


def passed_on(words: DataFrame, exported: DataFrame) -> DataFrame:
    """The names in braces that a file exports from another one, as `references`. They are no
    names of the file itself: `exported` (see `exported_names`) tells what they stand for."""
    in_scope = Window.partitionBy("file", "scope").orderBy("ord")
    rows = nested(words).withColumn("before", F.lag("token").over(in_scope)).withColumn("after", F.lead("token").over(in_scope))
    braces = rows.where("token = '{' and before in ('export', 'type') and after = 'from'").select("file", F.col("ord").alias("scope"))
    inside = rows.join(braces, ["file", "scope"]).withColumn("item", F.sum(F.when(F.col("token") == ",", 1).otherwise(0)).over(in_scope)).where("token not in (',', 'type')")
    first = F.min_by(F.struct(F.col("line").cast("long").alias("line"), "pos", F.col("token").alias("name")), "ord")
    items_ = inside.groupBy("file", "scope", "item").agg(first.alias("r"), F.max_by("token", "ord").alias("as_name"))
    return items_.select("file", "as_name", "r.*").join(exported.select("file", F.col("name").alias("as_name"), "home", "symbol"), ["file", "as_name"]).select("file", "line", "pos", "name", "home", "symbol")


def references(files: DataFrame, names_: DataFrame, around: DataFrame | None = None, exported: DataFrame | None = None) -> DataFrame:
    """file, line, pos, name, home, symbol of every identifier that stands for a known
    declaration: by identity, not by its text. Members behind a point, keys before a colon at
    the begin of a member, and what comments and texts hold are none; `${}` in templates counts.
    """
    words = tokens(files)
    by_file = Window.partitionBy("file").orderBy("ord")
    words = words.withColumn("before", F.lag("token").over(by_file)).withColumn("after", F.lead("token").over(by_file))
    key = F.coalesce((F.col("after") == ":") & F.col("before").isin("{", ",", ";", "readonly"), F.lit(False))
    rows = words.where(F.col("token").rlike(rf"^{NAME}$") & ~F.coalesce(F.col("before").isin(".", "?."), F.lit(False)) & ~key).select("file", F.col("line").cast("long").alias("line"), "pos", F.col("token").alias("name"))
    quoted = words.where(F.col("token").startswith("`") & F.col("token").contains("${"))
    parts = quoted.select("file", "line", "pos", F.explode(F.regexp_extract_all("token", F.lit(INSIDE), F.lit(0))).alias("part"))
    inner = parts.select("file", F.col("line").cast("long").alias("line"), "pos", F.explode(F.regexp_extract_all("part", F.lit(rf"(?<![.\w$]){NAME}"), F.lit(0))).alias("name"))
    found = identified(rows.unionByName(inner), names_, around).select("file", "line", "pos", "name", "home", "symbol")
    if exported is None:
        return found
    more = passed_on(words, exported)
    return found.join(more.select("file", "pos"), ["file", "pos"], "left_anti").unionByName(more)


def qualified(home: Column, symbol: Column) -> Column:
    """A name that no other file's declaration shares."""
    return F.concat(symbol, F.lit("$"), F.lpad(F.lower(F.hex(F.crc32(home))), 8, "0"))


def shown(text: Column) -> Column:
    """A text with the marks of `qualified` taken away."""
    return F.regexp_replace(text, r"\$[0-9a-f]{8}\b", "")


def by_identity(rows: DataFrame, column: str, names_: DataFrame, around: DataFrame | None = None) -> DataFrame:
    """`rows` (file, ...) with the known names in a type text replaced by their qualified forms."""
    texts = rows.select("file", column).where(F.col(column).isNotNull()).distinct()
    words = texts.select("file", column, F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(NAME), F.lit(0)))).alias("name"))
    known = identified(words, names_, around).groupBy("file", column).agg(F.map_from_entries(F.collect_list(F.struct("name", qualified(F.col("home"), F.col("symbol"))))).alias("__known"))
    pieces = F.regexp_extract_all(column, F.lit(rf"{NAME}|[^A-Za-z_$]+|[\s\S]"), F.lit(0))
    text = F.array_join(F.transform(pieces, lambda x: F.coalesce(F.element_at("__known", x), x)), "")
    return rows.join(known, ["file", column], "left").withColumn(column, F.when(F.col("__known").isNull(), F.col(column)).otherwise(text)).drop("__known")
