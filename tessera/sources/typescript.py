"""Facts from TypeScript texts, as projections of their scopes (see `scopes`).

Types are known as far as their texts tell. A file whose brackets can't be
matched has no facts but the names of its types, with status `unsupported`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import split_outside
from tessera.operators import transform
from tessera.sources import scopes
from tessera.sources.scopes import NAME

DECLARATION = rf"^\s*(export\s+)?(default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(interface|type|class|enum|function|const|let|var)\*?\s+({NAME})"
KINDS = ("interface", "type", "class", "enum", "function", "const", "let", "var")
#: Folders in which no configuration is looked for.
IGNORED = ["node_modules", ".git", "dist", "build", ".next", ".nuxt", ".output", "coverage", ".turbo", ".cache"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Whole files under a folder: file, text; nothing from node_modules."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.ts").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return files.where(~F.col("file").contains("/node_modules/"))


def declarations(parsed: DataFrame) -> DataFrame:
    """file, line, name, kind, exported, is_default of what statements at the top declare."""
    rows = parsed.where((F.col("scope") == -1) & F.col("kind").isin(*KINDS))
    return rows.select("file", F.col("line").cast("long").alias("line"), "name", "kind", F.array_contains("modifiers", "export").alias("exported"), F.array_contains("modifiers", "default").alias("is_default"))


def parameters(parsed: DataFrame) -> DataFrame:
    """file, paren, params: the types of the parameters in each pair of parentheses, in order; empty where not stated."""
    one = parsed.where(F.col("kind").isin("member", "callable") & F.col("role").isNull()).select("file", F.col("scope").alias("paren"), F.struct("seg", shown(F.col("kind"), F.col("type")).alias("type")).alias("p"))
    return one.groupBy("file", "paren").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["type"]).alias("params"))


def shown(kind: Column, text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def with_parameters(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return rows.join(parameters(parsed), ["file", "paren"], "left").withColumn("params", F.coalesce("params", none))


def members(parsed: DataFrame) -> DataFrame:
    """file, type_name, ord, name, type, optional, readonly of the members of types at the top of a file.

    Methods have function types, accessors their value's; constructors' parameters with
    modifiers are members; static ones, constructors and index signatures are
    none. Of overloads the first counts.
    """
    bodies = parsed.where((F.col("scope") == -1) & F.col("body").isNotNull() & F.col("kind").isin("interface", "class", "type")).select("file", F.col("body").alias("scope"), F.col("name").alias("type_name"))
    inside = with_parameters(parsed.where(F.col("kind").isin("member", "method", "callable")).join(bodies, ["file", "scope"]), parsed)
    accessor = F.arrays_overlap("modifiers", F.array(F.lit("get"), F.lit("set")))
    function = F.concat(F.lit("("), F.array_join("params", ", "), F.lit(") => "), F.coalesce("type", F.lit("unknown")))
    text = F.when(accessor, F.coalesce(F.nullif("type", F.lit("void")), F.get("params", F.lit(0)))).when(F.col("kind").isin("method", "callable"), function).otherwise(F.coalesce("type", F.lit("unknown")))
    own = inside.where((F.col("name") != "constructor") & (F.col("name") != "[") & ~F.array_contains("modifiers", "static")).select("file", "type_name", "seg", "name", text.alias("type"), "optional", "modifiers")
    made = inside.where("name = 'constructor'").select("file", "type_name", F.col("paren").alias("scope"))
    fields = parsed.where(F.arrays_overlap("modifiers", F.array(*map(F.lit, ("public", "private", "protected", "readonly"))))).join(made, ["file", "scope"])
    rows = own.unionByName(fields.select("file", "type_name", "seg", "name", F.coalesce("type", F.lit("unknown")).alias("type"), "optional", "modifiers"))
    first = rows.groupBy("file", "type_name", "name").agg(F.min_by(F.struct("seg", "type", "optional", "modifiers"), "seg").alias("r"))
    return first.select("file", "type_name", F.col("r.seg").alias("ord"), "name", "r.type", "r.optional", F.array_contains("r.modifiers", "readonly").alias("readonly"))


def aliases(parsed: DataFrame) -> DataFrame:
    """file, name, type: the texts that type aliases at the top stand for, other than bodies."""
    return parsed.where("scope = -1 and kind = 'type' and body is null and type is not null").select("file", "name", "type")


def unsupported(files: DataFrame) -> DataFrame:
    """file, type_name, status of the types of files whose brackets can't be matched."""
    from tessera.operators.positions import lines

    bad = files.join(scopes.unbalanced(files), "file", "left_semi")
    rows = lines(bad).where(F.col("text").rlike(DECLARATION) & F.regexp_extract("text", DECLARATION, 3).isin("interface", "type", "class"))
    return rows.select("file", F.regexp_extract("text", DECLARATION, 4).alias("type_name"), F.lit("unsupported").alias("status"))


def callables(parsed: DataFrame) -> DataFrame:
    """Everything that can be called: file, callable, ord, name, kind, container, params (types), returns, stated, exported, deprecated, is_function.

    Nine kinds: functions, constants that are functions, methods of classes
    (static ones apart), constructors, methods and call signatures of types,
    methods of objects, and properties of a function type. Overloads of a
    function that has a body elsewhere are signatures of it (see `signatures`)
    and no callables of their own. A return that isn't stated is filled in from
    what the body hands on, if that can be told (`stated` is false then).
    """
    rows = every_callable(parsed)
    implemented = rows.where("kind = 'Function' and has_body").select("file", "name").distinct().withColumn("done", F.lit(True))
    rows = rows.join(implemented, ["file", "name"], "left").where("kind <> 'Function' or has_body or done is null").drop("done")
    filled = transform.filled_returns(rows.select("callable", "returns").groupBy("callable").agg(F.min("returns").alias("returns")), hands_on(rows, parsed))
    rows = rows.join(filled.select("callable", F.col("returns").alias("filled")), "callable", "left")
    return rows.select("file", "callable", "ord", "name", "kind", "container", "params", F.coalesce("returns", "filled").alias("returns"), F.col("returns").isNotNull().alias("stated"), "exported", "deprecated", "is_function")


def signatures(parsed: DataFrame) -> DataFrame:
    """The signatures of functions, methods and constructors with overloads, as `callables`; an implementation isn't one."""
    rows = every_callable(parsed)
    overloaded = rows.where("not has_body").select("callable").distinct()
    return rows.where("not has_body").join(overloaded, "callable", "left_semi").where("returns is not null").drop("has_body", "body", "hands_on")


def every_callable(parsed: DataFrame) -> DataFrame:
    rows = parsed.where(F.col("paren").isNotNull())
    static = F.array_contains("modifiers", "static")
    accessor = F.arrays_overlap("modifiers", F.array(F.lit("get"), F.lit("set")))
    method, role = F.col("kind") == "method", F.col("role")
    kind = (
        F.when(F.col("kind") == "function", "Function")
        .when(F.col("kind").isin("const", "let", "var"), "VariableCallable")
        .when(method & (role == "class") & (F.col("name") == "constructor"), "Constructor")
        .when(method & (role == "class") & ~accessor, F.when(static, "StaticMethod").otherwise("ClassMethod"))
        .when(method & (role == "type") & ~accessor, "InterfaceMethod")
        .when((F.col("kind") == "call") & (role == "type"), "TypeLiteralMethod")
        .when(method & (role == "object") & F.col("initial") & ~accessor, "ObjectMethod")
        .when((F.col("kind") == "callable") & (role == "object"), "ObjectMethod")
        .when((F.col("kind") == "callable") & (role == "type"), "CallableProperty")
    )
    rows = with_parameters(rows.withColumn("sort", kind).where("sort is not null"), parsed)
    inside = ~F.col("sort").isin("Function", "VariableCallable")
    container = F.when(inside, F.col("owner"))
    name = F.when(F.col("sort") == "TypeLiteralMethod", F.col("owner")).otherwise(F.col("name"))
    returns = F.when(F.col("sort") == "Constructor", F.col("owner")).otherwise(F.col("type"))
    return rows.select(
        "file", F.concat_ws("#", "file", F.concat_ws(".", container, F.when(F.col("sort") != "TypeLiteralMethod", F.col("name")))).alias("callable"), F.col("seg").cast("long").alias("ord"), name.alias("name"),
        F.col("sort").alias("kind"), container.alias("container"), "params", returns.alias("returns"), "exported", "deprecated", (F.col("sort") == "Function").alias("is_function"),
        (F.col("initial") & (F.col("body").isNotNull() | (F.col("kind") != "function"))).alias("has_body"), "body", "hands_on",
    )


def hands_on(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """callable, callee, type: what a callable without a stated return gives: all its
    returns, those in nested blocks included, hand on one call, or are of one type."""
    blocks = scopes.key("scope")
    inner = parsed.where("role = 'statements' and kind in ('method', 'other') and body is not null").select(scopes.key("body").alias("node"), blocks.alias("next"))
    given = parsed.where("kind = 'return'").select("file", blocks.alias("node"), "name")
    outer = given.join(scopes.ends(inner), "node", "left").select("file", F.coalesce("end", "node").alias("at"), "name")
    bodies = rows.where("returns is null and body is not null").select("callable", scopes.key("body").alias("at"))
    said = bodies.join(outer, "at").select("callable", "file", "name").union(rows.where("returns is null and hands_on is not null").select("callable", "file", F.col("hands_on").alias("name")))
    one = said.groupBy("callable", "file").agg(F.count_distinct("name").alias("n"), F.count_if(F.col("name").isNull()).alias("unknown"), F.min("name").alias("name")).where("n = 1 and unknown = 0")
    call = F.when(F.col("name").endswith("()"), F.concat_ws("#", "file", F.regexp_replace("name", r"\(\)$", "")))
    type_ = F.when(F.col("name").startswith(": "), F.substring("name", 3, 99)).when(F.col("name").startswith("new "), F.substring("name", 5, 999))
    return one.select("callable", call.alias("callee"), type_.alias("type"))


def edges(parsed: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """src, dst, context: from types to the declared types that their members, bases and signatures name."""
    declared = declarations(parsed).select(F.col("name").alias("dst")).distinct()
    called = (callables(parsed) if found is None else found).where("stated").withColumn("src", F.coalesce("container", "name"))
    parts = [
        members(parsed).select(F.col("type_name").alias("src"), F.col("type").alias("text"), F.lit("type").alias("context")),
        aliases(parsed).select(F.col("name").alias("src"), F.col("type").alias("text"), F.lit("type").alias("context")),
        bases(parsed).select(F.col("type_name").alias("src"), F.col("base").alias("text"), F.lit("extends").alias("context")),
        called.select("src", F.explode("params").alias("text"), F.lit("parameter").alias("context")),
        called.select("src", F.col("returns").alias("text"), F.lit("return").alias("context")),
    ]
    named = reduce(DataFrame.union, parts).select("src", F.explode(F.expr(f"regexp_extract_all(text, r'{NAME}', 0)")).alias("dst"), "context")
    return named.where("src <> dst").join(declared, "dst", "left_semi").select("src", "dst", "context").distinct()


def diagnostics(parsed: DataFrame) -> DataFrame:
    """file, ord, line, code, message of what the texts can tell: a name declared
    twice in a file, and a base that no file declares."""
    found = declarations(parsed)
    twice = found.where("kind not in ('function', 'interface')").groupBy("file", "name").agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n > 1")
    twice = twice.select("file", "line", F.lit(2300).cast("long").alias("code"), F.concat(F.lit("Duplicate identifier '"), "name", F.lit("'")).alias("message"))
    unknown = bases(parsed).join(found.select(F.col("name").alias("base")).distinct(), "base", "left_anti")
    at = found.select("file", F.col("name").alias("type_name"), "line")
    unknown = unknown.join(at, ["file", "type_name"]).select("file", "line", F.lit(2304).cast("long").alias("code"), F.concat(F.lit("Cannot find name '"), "base", F.lit("'")).alias("message"))
    return twice.union(unknown).withColumn("ord", F.col("line"))


def bases(parsed: DataFrame) -> DataFrame:
    """file, type_name, base: the types that an interface or class extends; arguments of any depth are left out."""
    rows = parsed.where((F.col("scope") == -1) & F.col("bases").isNotNull())
    rows = rows.select("file", F.col("name").alias("type_name"), F.explode(split_outside(F.col("bases"), ",")).alias("base"))
    return rows.select("file", "type_name", F.regexp_extract("base", rf"^\s*(?:{NAME}\.)*({NAME})\s*(?:<.*)?$", 1).alias("base")).where("base <> ''")


def packages(spark: SparkSession, path: str) -> DataFrame:
    """name and folder of each package under a folder: a folder with a tsconfig.json or a
    package.json, nested ones included, none in folders that are ignored. It is named by its
    package.json, or else by its path."""
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="{package,tsconfig}.json").select(F.col("_metadata.file_path").alias("file"), F.get_json_object("value", "$.name").alias("name"))
    found = found.select(F.regexp_replace("file", r"/[^/]+$", "/").alias("folder"), F.when(F.col("file").endswith("/package.json"), F.col("name")).alias("name"))
    inside = F.split(F.substring_index("folder", path.rstrip("/") + "/", -1), "/")
    found = found.where(~F.arrays_overlap(inside, F.array(*map(F.lit, IGNORED)))).groupBy("folder").agg(F.max("name").alias("name"))
    return found.select(F.coalesce("name", F.nullif(F.array_join(F.filter(inside, lambda x: x != ""), "/"), F.lit("")), F.lit("(root)")).alias("name"), "folder")
