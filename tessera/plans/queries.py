"""Registered queries over the tables provider, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import stats, text
from tessera.operators import assignable, catalog, compat, contract, diagnostics, graph, members, positions, revisions, transform
from tessera.operators.rounds import held
from tessera.protocol import COMMANDS, SINGLE
from tessera.sources import catalyst
from tessera.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Packages and symbols

PACKAGES = "(SELECT source AS package, count(*) AS n_files FROM documents GROUP BY source)"


@query(f"""
SELECT row_number() OVER (ORDER BY name <> '(root)', name) AS place, name, n_files
FROM (SELECT CASE WHEN package = 'src0' THEN '(root)' ELSE package END AS name, n_files FROM {PACKAGES})""")
def packages_list(t: Tables) -> DataFrame:
    return catalog.packages(t.files(), "src0")


@query(f"""
WITH p AS (SELECT package AS name, row_number() OVER (ORDER BY package) AS ord FROM {PACKAGES}),
s AS (SELECT '/' || name AS selector FROM p UNION SELECT substr(name, 4) FROM p UNION SELECT name FROM p UNION SELECT 'none')
SELECT selector, arg_min(name, CASE WHEN selector = name THEN 0 WHEN ltrim(selector, '/') = name THEN 1 ELSE 2 END * 1000 + ord) AS package
FROM s LEFT JOIN p ON selector = name OR ltrim(selector, '/') = name OR ends_with(name, selector) GROUP BY selector""")
def package_resolve(t: Tables) -> DataFrame:
    found = catalog.packages(t.files(), "").select("name", F.col("place").alias("ord"))
    forms = F.explode(F.array(F.concat(F.lit("/"), "name"), F.substring("name", 4, 100), F.col("name"), F.lit("none")))
    return catalog.resolve_package(found.select(forms.alias("selector")).distinct(), found)


@query("""
SELECT name, kind, file, ord, total, total > 100 AS truncated FROM (
  SELECT p_name AS name, p_type AS kind, p_brand AS file, p_partkey AS ord, count(*) OVER () AS total,
         row_number() OVER (ORDER BY p_name, p_partkey) AS n
  FROM part WHERE regexp_matches(p_name, 'E.*g', 'i') AND p_type = 'PROMO') WHERE n <= 100""")
def symbols_list(t: Tables) -> DataFrame:
    return catalog.list_symbols(t.symbols(), "E.*g", "PROMO", limit=100).select("name", "kind", "file", "ord", "total", "truncated")


@query("""
SELECT name, file, ord, is_index, total FROM (
  SELECT p_name AS name, p_brand AS file, p_partkey AS ord, p_brand = 'Brand#7' AS is_index, count(*) OVER () AS total,
         row_number() OVER (ORDER BY p_brand = 'Brand#7' DESC, p_name, p_partkey) AS n
  FROM part WHERE regexp_matches(p_brand, '#[127]', 'i')) WHERE n <= 40""")
def symbols_index_first(t: Tables) -> DataFrame:
    return catalog.list_symbols(t.symbols(), file="#[127]", limit=40, index_file="Brand#7").select("name", "file", "ord", "is_index", "total")


@query("SELECT p_name AS name, min(p_partkey) AS ord, arg_min(p_type, p_partkey) AS kind FROM part GROUP BY p_name")
def symbol_first_by_name(t: Tables) -> DataFrame:
    return catalog.first_rows(t.symbols(), ["name"], [F.col("ord")]).select("name", "ord", "kind")


@query("""
SELECT p_brand AS file, p_size, arg_max(p_name, p_partkey) AS name, max(p_partkey) AS ord FROM part GROUP BY p_brand, p_size""")
def merge_last_wins(t: Tables) -> DataFrame:
    return catalog.last_rows(t.symbols(), ["file", "p_size"], "ord").select("file", "p_size", "name", "ord")


@query("""
SELECT o_orderkey AS ord, o_orderpriority AS name FROM orders
WHERE regexp_matches(o_orderpriority, 'HIGH|URGENT', 'i') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey = 7)""")
def search_has_member(t: Tables) -> DataFrame:
    types = t.orders.select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("name"))
    own = t.members().select(F.col("type_id").alias("ord"), "member")
    return catalog.search(types, members=own, has=7, pattern="HIGH|URGENT", query="ignored", limit=None)


@query("""
SELECT ord, name FROM (SELECT c_custkey AS ord, c_name AS name, row_number() OVER (ORDER BY c_custkey) AS n FROM customer
WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_name = 'NATION_3')) WHERE n <= 25""")
def search_extends(t: Tables) -> DataFrame:
    types = t.customer.select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"))
    bases = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("ord"), F.col("n_name").alias("base"))
    return catalog.search(types, bases=bases, extends="NATION_3")


@query("""
WITH f AS (SELECT DISTINCT p_type AS package, p_brand AS file, p_name AS name, p_brand = 'Brand#1' AND p_type = 'PROMO' AS is_index, p_brand LIKE 'Brand#2%' AS is_src FROM part),
r AS (SELECT *, CASE WHEN is_index THEN 0 WHEN is_src THEN 1 ELSE 2 END AS rank FROM f),
b AS (SELECT package, min(rank) AS best FROM r GROUP BY package),
o AS (SELECT package, name, arg_min(file, rank || file) AS file FROM r JOIN b USING (package) WHERE best > 0 OR rank = 0 GROUP BY package, name)
SELECT package, file, string_agg(name, ',' ORDER BY name) AS names FROM o GROUP BY package, file""")
def import_synthesis(t: Tables) -> DataFrame:
    files = t.symbols().select(F.col("kind").alias("package"), "file", "name", ((F.col("file") == "Brand#1") & (F.col("kind") == "PROMO")).alias("is_index"), F.col("file").like("Brand#2%").alias("is_src")).distinct()
    return catalog.import_names(files)


# Members and types

MEMBERS = "(SELECT l_orderkey AS type_id, l_partkey AS member, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY l_orderkey, l_partkey)"


@query(f"""
SELECT o_orderkey AS type_id, o_orderpriority AS kind, coalesce(n, 0) AS n_members, CASE WHEN n BETWEEN 1 AND 5 THEN text ELSE '' END AS members
FROM orders LEFT JOIN (SELECT type_id, count(*) AS n, string_agg(member || ': ' || quantity, '; ' ORDER BY member || ': ' || quantity) AS text
                       FROM {MEMBERS} GROUP BY type_id) ON o_orderkey = type_id""")
def type_info(t: Tables) -> DataFrame:
    own = t.members().select("type_id", F.col("member").cast("string").alias("member"), F.col("quantity").cast("string").alias("member_type"))
    return members.type_info(t.orders.select(F.col("o_orderkey").alias("type_id"), F.col("o_orderpriority").alias("kind")), own, 5)


@query(f"SELECT * FROM (SELECT type_id, member, quantity, count(*) OVER (PARTITION BY type_id) AS n FROM {MEMBERS}) WHERE n <= 3")
def members_cap(t: Tables) -> DataFrame:
    return members.shown_members(t.members(), 3)


@query(f"SELECT * FROM (SELECT type_id, member, row_number() OVER (PARTITION BY type_id ORDER BY member) AS place FROM {MEMBERS}) WHERE place <= 2")
def members_first(t: Tables) -> DataFrame:
    return members.first_members(t.members().select("type_id", "member"), ["member"], 2).withColumn("place", F.col("place").cast("long"))


# Lines, positions, renaming

LINES = """(SELECT file, line, text, CAST(sum(length(raw) + 1) OVER (PARTITION BY file ORDER BY line) - length(raw) - 1 AS BIGINT) AS start FROM (
  SELECT doc_id AS file, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS raw, regexp_replace(unnest(parts), '\\r$', '') AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""


@query(f"SELECT file, line, start, text FROM {LINES}")
def file_lines(t: Tables) -> DataFrame:
    return positions.lines(t.files())


@query(f"""
SELECT o.file, o."offset", l.line, o."offset" - l.start + 1 AS col FROM (SELECT doc_id AS file, (doc_id * 37) % (length(text) + 1) AS "offset" FROM documents) o
JOIN {LINES} l ON o.file = l.file AND o."offset" >= l.start AND o."offset" <= l.start + length(l.text)""")
def position_to_line(t: Tables) -> DataFrame:
    offsets = t.files().select("file", ((F.col("file") * 37) % (F.length("text") + 1)).cast("long").alias("offset"))
    return positions.line_of(offsets, positions.lines(t.files()))


@query(f"""
WITH n AS (SELECT file, line AS node_id, start AS pos, start + length(text) AS e, [line] AS path FROM {LINES} UNION ALL
           SELECT file, 0, min(start), max(start + length(text)), [CAST(0 AS BIGINT)] FROM {LINES} GROUP BY file),
o AS (SELECT doc_id AS file, (doc_id * 53) % (length(text) + 1) AS "offset" FROM documents)
SELECT o.file, "offset", arg_max(node_id, node_id) AS node_id FROM o JOIN n ON o.file = n.file AND pos <= "offset" AND "offset" <= e GROUP BY o.file, "offset" """)
def node_at_position(t: Tables) -> DataFrame:
    rows = positions.lines(t.files())
    end = F.col("start") + F.length("text")
    leaves = rows.select("file", F.col("line").alias("node_id"), F.col("start").alias("pos"), end.alias("end"), F.array("line").alias("path"))
    roots = rows.groupBy("file").agg(F.lit(0).cast("long").alias("node_id"), F.min("start").alias("pos"), F.max(end).alias("end"), F.array(F.lit(0).cast("long")).alias("path"))
    offsets = t.files().select("file", ((F.col("file") * 53) % (F.length("text") + 1)).cast("long").alias("offset"))
    return positions.node_at(offsets, leaves.unionByName(roots))


@query("SELECT doc_id AS file, CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS BIGINT) AS units FROM documents")
def utf16_length(t: Tables) -> DataFrame:
    return t.files().select("file", text.utf16_length(F.col("text")).alias("units"))


@query("SELECT doc_id AS file, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text FROM documents")
def node_truncate(t: Tables) -> DataFrame:
    return t.files().select("file", text.truncated(F.col("text"), 100).alias("text"))


@query(f"""
SELECT file, line, trim(text) AS before, regexp_replace(trim(text), '\\bthe\\b', 'THE_ONE', 'g') AS after FROM {LINES} WHERE regexp_matches(text, '\\bthe\\b')""")
def rename_preview(t: Tables) -> DataFrame:
    return positions.rename_preview(positions.lines(t.files()), "the", "THE_ONE")


AFFECTED = "(SELECT DISTINCT doc_id AS file FROM documents WHERE source = 'src3')"


@query(f"""
SELECT file, line, text FROM (SELECT file, line, text, row_number() OVER (ORDER BY file, line) AS n FROM {LINES}
WHERE regexp_matches(text, '\\band\\b') AND file IN (SELECT file FROM {AFFECTED})) WHERE n <= 20""")
def rename_string_hits(t: Tables) -> DataFrame:
    affected = t.files().where(F.col("package") == "src3").select("file")
    return positions.text_hits(positions.lines(t.files()), affected, "and").select("file", "line", "text")


@query(f"""
WITH s AS (SELECT l.file, line, source = 'src0' AS is_declaration_file FROM {LINES} l JOIN documents d ON d.doc_id = l.file WHERE regexp_matches(l.text, '\\bthe\\b')),
a AS (SELECT count(*) AS n_sites, count(DISTINCT file) AS n_files, count(*) FILTER (is_declaration_file) AS n_errors FROM s),
n AS (SELECT count(*) AS n_notes FROM {LINES} WHERE regexp_matches(text, '\\band\\b') AND file IN (SELECT file FROM s))
SELECT n_sites, n_files, n_errors, n_notes, CASE WHEN n_errors = 0 THEN 'high' ELSE 'low' END AS confidence, n_errors = 0 AND n_notes = 0 AS safe FROM a, n""")
def rename_summary(t: Tables) -> DataFrame:
    rows = positions.lines(t.files())
    sites = rows.where(F.col("text").rlike(text.whole_word("the"))).join(t.files().select("file", "package"), "file")
    sites = sites.select("file", "line", (F.col("package") == "src0").alias("is_declaration_file"))
    notes = rows.where(F.col("text").rlike(text.whole_word("and"))).join(sites.select("file").distinct(), "file", "left_semi")
    return positions.rename_summary(sites, notes)


# Diagnostics

EVENTS = """(SELECT event_id AS ord, CASE WHEN user_id % 10 <> 0 THEN 'f' || (user_id % 7) END AS file, user_id % 13 AS line, CAST(floor(value) AS BIGINT) AS col,
  CAST(CASE event_type WHEN 'error' THEN 2322 WHEN 'view' THEN 2339 WHEN 'click' THEN 2741 ELSE 1005 END AS BIGINT) AS code,
  CASE event_type WHEN 'error' THEN 'Type ''t' || user_id || ''' is not assignable to type ''u''' WHEN 'view' THEN 'Property ''p' || user_id || ''' does not exist on type ''v''' ELSE 'other' END AS message
  FROM events)"""


@query(f"SELECT file, line, code, min(ord) AS place, arg_max(message, ord) AS message, arg_max(col, ord) AS col FROM {EVENTS} GROUP BY file, line, code")
def diagnostics_dedupe(t: Tables) -> DataFrame:
    rows = t.diagnostics()
    parts = [rows.where(F.col("code") == 1005), rows.where(F.col("code") == 2322), rows.where(~F.col("code").isin(1005, 2322))]
    return diagnostics.distinct(parts, ["file", "line", "code"])


@query(f"""
WITH d AS (SELECT file, line, code, min(ord) AS place FROM {EVENTS} GROUP BY file, line, code)
SELECT file, line, code, place, total, total > 10 AS truncated FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY place) AS n FROM d) WHERE n <= 10""")
def diagnostics_top10(t: Tables) -> DataFrame:
    rows = diagnostics.distinct([t.diagnostics()], ["file", "line", "code"]).select("file", "line", "code", "place")
    return diagnostics.first_with_total(rows, ["place"])


@query(f"SELECT file, line, col, code, ord FROM {EVENTS} ORDER BY coalesce(file, ''), line, col, code, ord")
def diagnostics_sorted(t: Tables) -> DataFrame:
    return t.diagnostics().orderBy(*diagnostics.IN_ORDER).select("file", "line", "col", "code", "ord")


@query(f"""
SELECT ord, coalesce(nullif(regexp_extract(message, 'Type ''([^'']+)'' is not assignable', 1), ''), nullif(regexp_extract(message, 'Argument of type ''([^'']+)''', 1), ''),
  nullif(regexp_extract(message, 'missing in type ''([^'']+)''', 1), ''), nullif(regexp_extract(message, 'on type ''([^'']+)''', 1), '')) AS type_name,
  coalesce(nullif(regexp_extract(message, 'Property ''([^'']+)''', 1), ''), nullif(regexp_extract(message, 'property ''([^'']+)''', 1), '')) AS property_name FROM {EVENTS}""")
def error_parts(t: Tables) -> DataFrame:
    return diagnostics.message_parts(t.diagnostics()).select("ord", "type_name", "property_name")


@query(f"""
SELECT CASE WHEN code IN (2322, 2345) THEN 'not assignable' WHEN code = 2339 THEN 'unknown property' WHEN code = 2741 THEN 'missing property' ELSE 'other' END AS template,
  count(*) AS n FROM {EVENTS} GROUP BY 1""")
def error_template(t: Tables) -> DataFrame:
    return t.diagnostics().groupBy(diagnostics.explanation(F.col("code")).alias("template")).agg(F.count("*").alias("n"))


# Compatibility: the lines of an order against those of the one before

PAIRS = '(SELECT o_orderkey - 1 AS "from", o_orderkey AS "to" FROM orders)'
KIND = "(SELECT l_orderkey AS type_id, l_linenumber AS name, max(l_returnflag || l_linestatus) AS type FROM lineitem GROUP BY l_orderkey, l_linenumber)"
LACK = f"""SELECT p."from", p."to", t.name FROM {PAIRS} p JOIN {KIND} t ON t.type_id = p."to"
WHERE NOT EXISTS (SELECT 1 FROM {KIND} s WHERE s.type_id = p."from" AND s.name = t.name)"""
DIFFER = f"""SELECT p."from", p."to", t.name, s.type AS from_type, t.type AS to_type FROM {PAIRS} p JOIN {KIND} t ON t.type_id = p."to"
JOIN {KIND} s ON s.type_id = p."from" AND s.name = t.name WHERE s.type <> t.type"""


def line_types(t: Tables) -> tuple[DataFrame, DataFrame]:
    kinds = t.lineitem.groupBy(F.col("l_orderkey").alias("type_id"), F.col("l_linenumber").alias("name")).agg(F.max(F.concat("l_returnflag", "l_linestatus")).alias("type"))
    return kinds, t.orders.select((F.col("o_orderkey") - 1).alias("from"), F.col("o_orderkey").alias("to"))


@query(LACK)
def compat_missing(t: Tables) -> DataFrame:
    kinds, pairs = line_types(t)
    return compat.missing(kinds, kinds, pairs)


@query(DIFFER)
def compat_mismatch(t: Tables) -> DataFrame:
    kinds, pairs = line_types(t)
    return compat.mismatched(kinds, kinds, pairs)


@query(f"""
WITH i AS (SELECT "from", "to", '0 missing ' || name AS issue FROM ({LACK}) UNION ALL SELECT "from", "to", '1 mismatch ' || name FROM ({DIFFER})),
g AS (SELECT "from", "to", count(*) AS n, string_agg(substr(issue, 3), '; ' ORDER BY issue) AS reason FROM i GROUP BY "from", "to")
SELECT p."from", p."to", n IS NULL AS compatible, coalesce(n, 0) AS n_issues, coalesce(reason, '') AS reason FROM {PAIRS} p LEFT JOIN g ON g."from" = p."from" AND g."to" = p."to" """)
def compat_reason(t: Tables) -> DataFrame:
    kinds, pairs = line_types(t)
    return compat.verdicts(kinds.withColumn("name", F.col("name").cast("string")), kinds.withColumn("name", F.col("name").cast("string")), pairs)


# References and graphs

EDGES = """(SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


@query("""
SELECT source AS file, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place
FROM documents WHERE regexp_matches(text, '\\bthe\\b')) WHERE place <= 10""")
def refs_incoming_cap(t: Tables) -> DataFrame:
    hits = t.files().where(F.col("text").rlike(text.whole_word("the"))).select(F.col("package").alias("file"), F.col("file").alias("doc_id"))
    return positions.capped(hits, "file", ["doc_id"], 10)


@query(f"SELECT DISTINCT src, dst FROM {EDGES} WHERE src <> dst AND dst NOT IN ('r0', 'n3', 'n4')")
def refs_outgoing(t: Tables) -> DataFrame:
    return graph.outgoing(t.edges(), ["r0", "n3", "n4"])


@query(f"""
SELECT CASE WHEN left(dst, 1) = 'r' THEN 'extends' WHEN left(src, 1) = 'o' THEN 'call' WHEN left(src, 1) = 's' THEN 'parameter' ELSE 'type' END AS context, count(*) AS n FROM {EDGES} GROUP BY 1""")
def ref_context(t: Tables) -> DataFrame:
    context = F.when(F.left("dst", F.lit(1)) == "r", "extends").when(F.left("src", F.lit(1)) == "o", "call").when(F.left("src", F.lit(1)) == "s", "parameter").otherwise("type")
    return t.edges().groupBy(context.alias("context")).agg(F.count("*").alias("n"))


WALK = f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {EDGES}),
w AS (SELECT 'o' || o_orderkey AS root, src, dst, CAST(1 AS BIGINT) AS depth FROM orders JOIN e ON src = 'o' || o_orderkey
      UNION ALL SELECT root, e.src, e.dst, depth + 1 FROM w JOIN e ON e.src = w.dst WHERE depth < 3)"""


@query(f"{WALK} SELECT root, src, dst, min(depth) AS depth FROM w GROUP BY root, src, dst")
def graph_bounded(t: Tables) -> DataFrame:
    roots = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("root"))
    return graph.neighbourhood(t.edges().distinct(), roots, 3)


@query(f"""{WALK}, l AS (SELECT DISTINCT root, '  ' || src || ' --> ' || dst AS line FROM w)
SELECT root, count(*) AS n_edges, 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS graph FROM l GROUP BY root""")
def graph_render(t: Tables) -> DataFrame:
    return graph.rendered(graph_bounded(t), rows=3 * t.orders.count())


# Transform search

CALLABLES = """(SELECT l_partkey AS callable, l_suppkey AS ord, p_name AS name, p_brand AS file, p_type AS param0, p_brand AS param1,
  CASE WHEN p_size % 3 = 0 THEN 'Promise<N' || s_nationkey || '>' ELSE 'N' || s_nationkey END AS returns,
  p_size % 2 = 0 AS exported, p_size % 5 = 0 AS deprecated, p_size % 7 = 0 AS is_function
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
MATCHES = f"""(SELECT callable, ord, name, file, how, status, CAST(100 + CASE WHEN exported THEN 8 ELSE 0 END - CASE WHEN deprecated THEN 15 ELSE 0 END
  + CASE WHEN is_function THEN 2 ELSE 0 END - CASE WHEN how = 'unwrapped' THEN 10 ELSE 0 END AS BIGINT) AS score FROM (
  SELECT *, CASE WHEN returns = 'N7' THEN 'exact' WHEN returns = 'Promise<N7>' THEN 'unwrapped' END AS how,
    CASE WHEN callable % 3 = 0 THEN 'verified' WHEN callable % 3 = 1 THEN 'assignable' ELSE 'unverified' END AS status FROM {CALLABLES}) WHERE how IS NOT NULL)"""
BEST = f"(SELECT * FROM {MATCHES} QUALIFY row_number() OVER (PARTITION BY callable ORDER BY score DESC, name, file, ord) = 1)"


def matched(t: Tables) -> DataFrame:
    rows = t.callables().withColumn("how", transform.gives(F.col("returns"), "N7")).where("how is not null")
    points = transform.score(F.lit(True), F.lit(True), F.col("exported"), F.col("deprecated"), F.col("is_function"), F.col("how") == "unwrapped")
    return with_status(rows.withColumn("score", points)).select("callable", "ord", "name", "file", "how", "score", "status")


def with_status(rows: DataFrame) -> DataFrame:
    third = F.col("callable") % 3
    return rows.withColumn("status", F.when(third == 0, "verified").when(third == 1, "assignable").otherwise("unverified"))


@query(f"SELECT callable, count(*) AS n_seeds, min(ord) AS ord, arg_min(returns, ord) AS returns FROM {CALLABLES} GROUP BY callable")
def callables_group(t: Tables) -> DataFrame:
    return transform.grouped(t.callables()).select("callable", "n_seeds", "ord", "returns")


@query(f"SELECT DISTINCT callable, name, CAST(0 AS INTEGER) AS place FROM {CALLABLES} WHERE param0 = 'SMALL'")
def transform_from(t: Tables) -> DataFrame:
    return t.callables().withColumn("place", transform.accepts(F.col("params"), "SMALL")).where("place is not null").select("callable", "name", "place").distinct()


@query(f"""
SELECT callable, ord, CAST(CASE WHEN param0 = 'Brand#3' THEN 0 ELSE 1 END AS INTEGER) AS place FROM {CALLABLES} WHERE param0 = 'Brand#3' OR param1 = 'Brand#3'""")
def transform_any_param(t: Tables) -> DataFrame:
    return t.callables().withColumn("place", transform.accepts(F.col("params"), "Brand#3", None)).where("place is not null").select("callable", "ord", "place")


@query(f"SELECT callable, ord, returns, CASE WHEN returns = 'N3' THEN 'exact' ELSE 'unwrapped' END AS how FROM {CALLABLES} WHERE returns IN ('N3', 'Promise<N3>')")
def transform_to_unwrap(t: Tables) -> DataFrame:
    return t.callables().withColumn("how", transform.gives(F.col("returns"), "N3")).where("how is not null").select("callable", "ord", "returns", "how")


@query(f"""SELECT callable, ord, score, CASE WHEN status = 'verified' AND how = 'exact' THEN 'high' WHEN how = 'exact' THEN 'medium' ELSE 'low' END AS confidence FROM {MATCHES}""")
def transform_score(t: Tables) -> DataFrame:
    exact = F.col("how") == "exact"
    return matched(t).select("callable", "ord", "score", transform.confidence(F.col("status"), exact, F.lit(True)).alias("confidence"))


@query(f"SELECT callable, ord, name, score FROM {BEST} ORDER BY score DESC, name, file, ord, callable LIMIT 25")
def transform_rank(t: Tables) -> DataFrame:
    return transform.best_of_each(matched(t)).orderBy(F.desc("score"), "name", "file", "ord", "callable").limit(25).select("callable", "ord", "name", "score")


@query(f"SELECT callable, score, row_number() OVER (ORDER BY score DESC, name, file, ord, callable) <= 15 AS to_verify FROM {BEST}")
def transform_overscan(t: Tables) -> DataFrame:
    return transform.verified_prefix(transform.best_of_each(matched(t)), 5).select("callable", "score", "to_verify")


@query(f"SELECT callable, score FROM (SELECT callable, score, row_number() OVER (ORDER BY score DESC, name, file, ord, callable) AS n FROM {BEST} WHERE status = 'verified') WHERE n <= 12")
def transform_trust_topk(t: Tables) -> DataFrame:
    ranked = transform.best_of_each(matched(t)).drop("status")
    return transform.trusted_top(ranked, with_status, 12).select("callable", "score")


@query(f"""SELECT count(*) FILTER (status = 'unverified') AS n_unverified, count(*) FILTER (status = 'assignable') AS n_assignable,
  count(*) FILTER (status = 'verified') AS n_verified, count(DISTINCT callable) AS n_callables FROM {MATCHES}""")
def transform_stats(t: Tables) -> DataFrame:
    return transform.status_counts(matched(t))


# Assignability: suppliers as types whose members lead to other suppliers

#: Members of the types; `next` makes circles of types.
PEERS = """(SELECT 's' || s_suppkey AS type_id, 'seg' AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'string' ELSE chr(39) || s_nationkey % 2 || chr(39) END AS type, false AS optional FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 'next', 's' || (s_suppkey * 7 % (SELECT count(*) FROM supplier)), false FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 'extra', 'number', s_suppkey % 8 = 0 FROM supplier WHERE s_suppkey % 4 = 0)"""
ASSIGNABLE = f"""m AS (SELECT * FROM {PEERS}),
d(a, b) AS (SELECT a, b FROM asked UNION SELECT x.type, y.type FROM d JOIN m x ON x.type_id = d.a JOIN m y ON y.type_id = d.b AND y.name = x.name WHERE x.type LIKE 's%' AND y.type LIKE 's%' AND x.type <> 'string' AND y.type <> 'string'),
wrong AS (SELECT DISTINCT d.a, d.b FROM d JOIN m y ON y.type_id = d.b LEFT JOIN m x ON x.type_id = d.a AND x.name = y.name
  WHERE d.a <> d.b AND ((x.name IS NULL AND NOT y.optional) OR (x.optional AND NOT y.optional) OR (y.name = 'seg' AND x.type <> y.type AND y.type <> 'string'))),
f(a, b) AS (SELECT a, b FROM wrong UNION SELECT d.a, d.b FROM f JOIN m x ON x.type = f.a AND x.name = 'next' JOIN m y ON y.type = f.b AND y.name = 'next' JOIN d ON d.a = x.type_id AND d.b = y.type_id WHERE d.a <> d.b)"""


def peers(t: Tables) -> DataFrame:
    n = t.supplier.count()
    key = F.col("s_suppkey")
    name = lambda k: F.concat(F.lit("s"), k.cast("string"))
    literal = F.concat(F.lit("'"), (F.col("s_nationkey") % 2).cast("string"), F.lit("'"))
    no = F.lit(False)
    parts = [
        t.supplier.select(name(key).alias("type_id"), F.lit("seg").alias("name"), F.when(key % 5 == 0, "string").otherwise(literal).alias("type"), no.alias("optional")),
        t.supplier.select(name(key), F.lit("next"), name(key * 7 % n), no),
        t.supplier.where(key % 4 == 0).select(name(key), F.lit("extra"), F.lit("number"), key % 8 == 0),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""WITH RECURSIVE asked AS (SELECT 's' || s_suppkey AS a, 's' || (s_suppkey * 3 % 11) AS b FROM supplier WHERE s_suppkey * 3 % 11 < (SELECT count(*) FROM supplier)), {ASSIGNABLE}
SELECT a, b, NOT EXISTS (SELECT 1 FROM f WHERE f.a = d.a AND f.b = d.b) AS ok FROM d""")
def assignable_pairs(t: Tables) -> DataFrame:
    members, n = peers(t), t.supplier.count()
    other = F.col("s_suppkey") * 3 % 11
    asked = t.supplier.where(other < n).select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("a"), F.concat(F.lit("s"), other.cast("string")).alias("b"))
    # the atoms of the members' types are no types of the table: the SQL leaves their pairs out
    return assignable.assignable(asked, members, members.select("type_id")).where(F.col("a").rlike("^s[0-9]") & F.col("b").rlike("^s[0-9]"))


@query(f"""WITH RECURSIVE asked AS (SELECT 's5' AS a, 's' || s_suppkey AS b FROM supplier), {ASSIGNABLE},
c AS (SELECT DISTINCT l_partkey AS callable, l_suppkey AS ord FROM lineitem)
SELECT callable, ord, CASE WHEN ord = 5 THEN 40 ELSE 24 END AS points FROM c
WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.a = 's5' AND f.b = 's' || ord)""")
def transform_assignable(t: Tables) -> DataFrame:
    members = peers(t)
    takes = t.lineitem.select(F.col("l_partkey").alias("callable"), F.col("l_suppkey").alias("ord")).distinct().withColumn("b", F.concat(F.lit("s"), F.col("ord")))
    asked = takes.select(F.lit("s5").alias("a"), "b").distinct()
    relation = assignable.assignable(asked, members, members.select("type_id"), whole=False)
    fits = assignable.related(takes.withColumn("a", F.lit("s5")), relation).where("ok")
    return fits.select("callable", "ord", F.when(F.col("a") == F.col("b"), 40).otherwise(24).alias("points"))


@query("""WITH RECURSIVE c AS (SELECT 'c' || s_suppkey AS callable, CASE WHEN s_suppkey % 9 = 0 THEN 'R' || s_nationkey END AS returns,
  CASE WHEN s_suppkey % 4 = 1 THEN 'c' || (s_suppkey + 4) WHEN s_suppkey % 9 <> 0 THEN 'c' || (s_suppkey * 7 % (SELECT count(*) FROM supplier)) END AS callee FROM supplier),
w AS (SELECT callable, callable AS at, 0 AS n FROM c UNION SELECT w.callable, c.callee, n + 1 FROM w JOIN c ON c.callable = w.at WHERE c.returns IS NULL AND c.callee IS NOT NULL AND n <= (SELECT count(*) FROM c))
SELECT c.callable, max(e.returns) AS returns FROM c JOIN w ON w.callable = c.callable LEFT JOIN c e ON e.callable = w.at GROUP BY c.callable""")
def return_filled(t: Tables) -> DataFrame:
    n, key = t.supplier.count(), F.col("s_suppkey")
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    callables = t.supplier.select(name(key).alias("callable"), F.when(key % 9 == 0, F.concat(F.lit("R"), F.col("s_nationkey"))).alias("returns"))
    callee = F.when(key % 4 == 1, name(key + 4)).when(key % 9 != 0, name(key * 7 % n))
    given = t.supplier.select(name(key).alias("callable"), callee.alias("callee"), F.lit(None).cast("string").alias("type")).where("callee is not null")
    return transform.filled_returns(callables, given).select("callable", "returns")


#: Nested intervals: an order is a file, its lines hold ten places each, pairs and fours of lines are around them.
SPANS = """(SELECT DISTINCT l_orderkey AS file, CAST(3000 + l_linenumber AS INTEGER) AS node_id, 10 * l_linenumber AS pos, 10 * l_linenumber + 9 AS "end", 'line' AS kind FROM lineitem
  UNION SELECT l_orderkey, CAST(2000 + l_linenumber // 2 AS INTEGER), 20 * (l_linenumber // 2), 20 * (l_linenumber // 2) + 19, CASE WHEN l_orderkey % 3 = 0 THEN 'pair' ELSE 'odd' END FROM lineitem
  UNION SELECT l_orderkey, CAST(1000 + l_linenumber // 4 AS INTEGER), 40 * (l_linenumber // 4), 40 * (l_linenumber // 4) + 39, 'four' FROM lineitem)"""


@query(f"""WITH s AS (SELECT * FROM {SPANS})
SELECT a.file, a.node_id, arg_min(b.node_id, b."end" - b.pos) AS ancestor FROM s a LEFT JOIN s b ON a.file = b.file AND b.pos <= a.pos AND a."end" <= b."end" AND b.node_id <> a.node_id AND b.kind IN ('pair', 'four')
GROUP BY a.file, a.node_id""")
def node_ancestor(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")

    def span(base: int, of: int, kind):
        at = F.floor(n / of).cast("int")
        return t.lineitem.select(F.col("l_orderkey").alias("file"), (base + at).alias("node_id"), (10 * of * at).alias("pos"), (10 * of * at + 10 * of - 1).alias("end"), kind.alias("kind"))

    pair = F.when(F.col("l_orderkey") % 3 == 0, "pair").otherwise("odd")
    nodes = held(span(3000, 1, F.lit("line")).union(span(2000, 2, pair)).union(span(1000, 4, F.lit("four"))).distinct())
    return positions.ancestor_of_kind(nodes, nodes, ["pair", "four"])


#: Pages' addresses as files; folders are addresses' beginnings that some pages share.
PAGE_FILES = "(SELECT DISTINCT regexp_replace(url, '^https?://', '') AS file FROM pages)"
PAGE_FOLDERS = f"(SELECT DISTINCT folder FROM (SELECT regexp_extract(file, '^[^/]*/') AS folder FROM {PAGE_FILES} UNION SELECT regexp_extract(file, '^[^/]*/[^/]*/') FROM {PAGE_FILES} WHERE length(file) % 2 = 0) WHERE folder <> '')"


@query(f"""SELECT file, arg_max(folder, length(folder)) AS folder FROM {PAGE_FILES} LEFT JOIN {PAGE_FOLDERS} ON starts_with(file, folder) GROUP BY file""")
def package_of_file(t: Tables) -> DataFrame:
    files = t.pages.select(F.regexp_replace("url", "^https?://", "").alias("file")).distinct()
    folders = files.select(F.regexp_extract("file", "^[^/]*/", 0).alias("folder")).union(files.where(F.length("file") % 2 == 0).select(F.regexp_extract("file", "^[^/]*/[^/]*/", 0)))
    return catalog.nearest_folder(files, folders.where("folder <> ''"))


# Contracts, batches, output, revisions

CHECKS = """SELECT count(*) = 0 AS direct, count(*) > 0 AS snippet, bool_and(value >= 0) AS diagnostics, bool_or(value > 300) AS transform FROM events"""


@query(f"""
SELECT *, coalesce(snippet, true) AND coalesce(diagnostics, true) AND coalesce(transform, true)
  AND ((direct IS NULL AND transform IS NULL) OR coalesce(direct, false) OR coalesce(transform, false))
  AND (coalesce(direct, false) OR coalesce(snippet, false) OR coalesce(diagnostics, false) OR coalesce(transform, false)) AS ok FROM ({CHECKS})""")
def contract_eval(t: Tables) -> DataFrame:
    n, value = F.count("*"), F.col("value")
    checks = [t.events.agg(c.alias("ok")) for c in (n == 0, n > 0, F.bool_and(value >= 0), F.bool_or(value > 300))]
    return contract.evaluated(*checks)


ITEMS = """(SELECT conv_id AS batch, turn AS idx, p_name IS NOT NULL AS ok, p_name AS data, CASE WHEN p_name IS NULL THEN 'not found: ' || key END AS error
  FROM (SELECT conv_id, turn, conv_id * 7 + turn AS key FROM conversations) LEFT JOIN part ON key = p_partkey)"""


def batch_items(t: Tables) -> DataFrame:
    payloads = t.conversations.select(F.col("conv_id").alias("batch"), F.col("turn").alias("idx"), (F.col("conv_id") * 7 + F.col("turn")).alias("key"))
    return contract.batch_results(payloads, t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("data")))


@query(f"SELECT * FROM {ITEMS}")
def batch_results(t: Tables) -> DataFrame:
    return batch_items(t)


@query(f"""SELECT batch, count(*) AS n, count(*) FILTER (ok) AS n_ok,
  CASE WHEN count(*) FILTER (ok) = count(*) THEN 'succeeded' WHEN count(*) FILTER (ok) = 0 THEN 'failed' ELSE 'partial_failure' END AS outcome FROM {ITEMS} GROUP BY batch""")
def batch_outcome(t: Tables) -> DataFrame:
    return contract.batch_outcome(batch_items(t))


@query("""SELECT doc_id AS file, strlen(text) AS size_bytes, CASE WHEN doc_id % 50 = 0 THEN 'artifact' WHEN doc_id % 3 <> 0 AND strlen(text) > 8000 THEN 'artifact' ELSE 'inline' END AS mode FROM documents""")
def artifact_policy(t: Tables) -> DataFrame:
    asked = F.when(F.col("file") % 50 == 0, "artifact").otherwise("auto")
    mode = contract.output_mode(asked, F.col("file") % 3 != 0, F.col("text"))
    return t.files().select("file", F.octet_length("text").cast("long").alias("size_bytes"), mode.alias("mode"))


@query("""
WITH e AS (SELECT user_id, event_id AS ord, event_type IN ('view', 'click') AS is_read FROM events),
n AS (SELECT *, coalesce(sum(CAST(is_read AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM e),
g AS (SELECT user_id, epoch, count(*) FILTER (NOT is_read) AS n_changes, bool_or(is_read) AS closed FROM n GROUP BY user_id, epoch)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch) - 1 AS refresh, n_changes FROM g WHERE n_changes > 0 AND closed""")
def dirty_coalesce(t: Tables) -> DataFrame:
    events = t.events.select("user_id", F.col("event_id").alias("ord"), F.col("event_type").isin("view", "click").alias("is_read"))
    return revisions.refreshes(events, "user_id")


@query("""
SELECT key, revision, value FROM (SELECT user_id AS key, max(event_id) AS revision, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t
FROM events WHERE event_id <= 700 GROUP BY user_id) WHERE t <> 'error'""")
def revision_as_of(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("revision"), "value", (F.col("event_type") == "error").alias("deleted"))
    return revisions.as_of(rows, "key", 700).select("key", "revision", "value")


@query("""SELECT event_type, count(value) AS n, round(min(value), 3) AS least, round(max(value), 3) AS most, round(avg(value), 3) AS mean,
  round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95 FROM events GROUP BY event_type""")
def bench_percentiles(t: Tables) -> DataFrame:
    return stats.timing_summary(t.events, "event_type", F.col("value"))


# What the analyser and the commands' table say: no SQL gives these rows


@query()
def eval_schema(t: Tables) -> DataFrame:
    names = ("part", "orders", "lineitem", "embeddings")
    return catalyst.catalog_members(t.spark, {n: getattr(t, n) for n in names})


@query()
def snippet_check(t: Tables) -> DataFrame:
    codes = ["SELECT 1", "SELECT a FROM", "SELECT\n  missing_column\nFROM VALUES (1) AS t(x)"]
    rows = [(i, *d) for i, c in enumerate(codes) for d in catalyst.check_snippet(t.spark, c)]
    return t.spark.createDataFrame(rows, f"snippet int, {catalyst.DIAGNOSTIC}")


@query()
def capabilities(t: Tables) -> DataFrame:
    rows = [(c, f, k.rstrip("?"), k.endswith("?"), c not in SINGLE) for c, fields in COMMANDS.items() for f, k in fields.items()]
    return t.spark.createDataFrame(rows, "command string, field string, kind string, optional boolean, batch boolean")


@query()
def doctor(t: Tables) -> DataFrame:
    names = ("part", "orders", "lineitem", "events", "documents")
    rows = [("spark", t.spark.version)] + [(f"table {n}", f"{len(getattr(t, n).columns)} columns") for n in names]
    return t.spark.createDataFrame(rows, "item string, value string")


# Inheritance, aliases, masked texts, overloads, types that are asked for


def type_members(t: Tables) -> DataFrame:
    """Members of regions, nations and customers as types; some customers name themselves."""
    region = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("type_id"), F.lit("name").alias("member"), F.col("r_name").alias("member_type"))
    nation = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("type_id"), F.explode(F.array(F.lit("name"), F.lit("code"))).alias("member"), F.col("n_name").alias("member_type"))
    customer = t.customer.where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("type_id"), F.lit("name").alias("member"), F.col("c_name").alias("member_type"))
    own = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("type_id"), F.lit("segment").alias("member"), F.col("c_mktsegment").alias("member_type"))
    return region.withColumn("member", F.lit("region")).union(nation).union(customer).union(own)


@query("""
WITH m AS (SELECT 'r' || r_regionkey AS type_id, 'region' AS member, r_name AS member_type FROM region
 UNION ALL SELECT 'n' || n_nationkey, unnest(['name', 'code']), n_name FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'name', c_name FROM customer WHERE c_custkey % 3 = 0
 UNION ALL SELECT 'c' || c_custkey, 'segment', c_mktsegment FROM customer),
b AS (SELECT 'n' || n_nationkey AS type_id, 'r' || n_regionkey AS base_id FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
a AS (SELECT type_id, type_id AS base_id, 0 AS depth FROM m UNION SELECT type_id, base_id, 1 FROM b
 UNION SELECT x.type_id, y.base_id, 2 FROM b x JOIN b y ON x.base_id = y.type_id)
SELECT a.type_id, member, arg_min(member_type, depth) AS member_type, CAST(min(depth) AS BIGINT) AS depth FROM a JOIN m ON m.type_id = base_id GROUP BY a.type_id, member""")
def members_inherited(t: Tables) -> DataFrame:
    edges = t.edges().where("src like 'c%' or src like 'n%'")
    return members.inherited(type_members(t), edges.select(F.col("src").alias("type_id"), F.col("dst").alias("base_id")))


@query(f"""
WITH a AS (SELECT p_partkey AS symbol, p_partkey // 2 AS target FROM part WHERE p_size % 2 = 0 AND p_partkey > 3),
d AS (SELECT member AS symbol, min(type_id) AS ord, arg_min('q' || quantity, type_id) AS name FROM {MEMBERS} WHERE quantity >= 10 GROUP BY member),
h AS (SELECT p_partkey AS export, coalesce(a.target, p_partkey) AS symbol FROM part LEFT JOIN a ON a.symbol = p_partkey),
s AS (SELECT export, coalesce(a.target, h.symbol) AS symbol FROM h LEFT JOIN a ON a.symbol = h.symbol)
SELECT export, s.symbol, ord, name FROM s LEFT JOIN d ON d.symbol = s.symbol""")
def alias_resolved(t: Tables) -> DataFrame:
    exports = t.part.select(F.col("p_partkey").alias("export"), F.col("p_partkey").alias("symbol"))
    aliases = t.part.where("p_size % 2 = 0 and p_partkey > 3").select(F.col("p_partkey").alias("symbol"), F.expr("p_partkey div 2").alias("target"))
    name = F.when(F.col("quantity") >= 10, F.concat(F.lit("q"), F.col("quantity").cast("string")))
    return catalog.resolve_aliases(exports, aliases, t.members().select(F.col("member").alias("symbol"), F.col("type_id").alias("ord"), name.alias("name")))


QUOTED = """(SELECT doc_id, replace(replace(text, ' the ', ' "the" the '), ' and ', ' /* the ' || chr(10) || ' and */ ') AS text FROM documents)"""
#: Patterns need what DuckDB's expressions lack; the documents have none, and no templates with code in them.
PIECES_SQL, QUIET_SQL = (x.replace("'", "''") for x in (f"{text.QUOTED}|{text.BETWEEN}", text.QUIET.replace("\"'", "\"'`")))


@query(f"""
WITH m AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{PIECES_SQL}'), lambda x: CASE WHEN regexp_matches(x, '{QUIET_SQL}') THEN regexp_replace(x, '[^\\n]', ' ', 'g') ELSE x END), '') AS text FROM {QUOTED}),
l AS (SELECT o.doc_id AS file, unnest(range(1, len(string_split(o.text, chr(10))) + 1)) AS line, regexp_replace(unnest(string_split(o.text, chr(10))), '\\r$', '') AS text, unnest(string_split(m.text, chr(10))) AS code
      FROM {QUOTED} o JOIN m USING (doc_id))
SELECT file, line, trim(text) AS before, regexp_replace(trim(text), '\\bthe\\b', 'THE_ONE', 'g') AS after FROM l WHERE regexp_matches(code, '\\bthe\\b')""")
def rename_masked(t: Tables) -> DataFrame:
    files = t.files().withColumn("text", F.replace(F.replace("text", F.lit(" the "), F.lit(' "the" the ')), F.lit(" and "), F.lit(" /* the \n and */ ")))
    return positions.rename_sites(files, "the", "THE_ONE")


@query("""
WITH c AS (SELECT DISTINCT l_partkey AS callable, l_suppkey AS ord, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT callable, count(*) AS n_seeds FROM c GROUP BY callable)
SELECT callable, n_seeds, name, ord FROM g JOIN c USING (callable)""")
def transform_overloads(t: Tables) -> DataFrame:
    seeds = t.callables().select("callable", "name", "ord")
    return transform.expanded(transform.grouped(seeds), seeds).select("callable", "n_seeds", "name", "ord")


@query("""
WITH q AS (SELECT ' ' || p_type || ' ' AS asked FROM part UNION SELECT p_brand FROM part UNION SELECT n_name FROM nation UNION SELECT 'nothing'),
a AS (SELECT p_type AS name, arg_min(p_name, p_partkey) AS type FROM part GROUP BY p_type),
s AS (SELECT p_brand AS name, arg_min(p_name, p_partkey) AS type FROM part GROUP BY p_brand),
c AS (SELECT n_name AS name, arg_max('N' || n_nationkey, n_nationkey) AS type FROM nation GROUP BY n_name)
SELECT asked, CASE WHEN a.type IS NOT NULL THEN 'annotation' WHEN s.type IS NOT NULL THEN 'alias' WHEN c.type IS NOT NULL THEN 'class' END AS how, coalesce(a.type, s.type, c.type) AS type
FROM q LEFT JOIN a ON a.name = trim(asked) LEFT JOIN s ON s.name = trim(asked) LEFT JOIN c ON c.name = trim(asked)""")
def transform_resolve_type(t: Tables) -> DataFrame:
    asked = t.part.select(F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("asked")).union(t.part.select("p_brand")).union(t.nation.select("n_name")).union(t.nation.limit(1).select(F.lit("nothing"))).distinct()
    named = lambda key: t.part.select(F.col(key).alias("name"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("type"))
    classes = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"), F.concat(F.lit("N"), "n_nationkey").alias("type"))
    return transform.resolve_types(asked, named("p_type"), named("p_brand"), classes)


@query("""
SELECT o_orderkey AS item, CASE WHEN n = 0 THEN '' WHEN p = s THEN p ELSE p || ',' || s END AS next_steps FROM (
  SELECT o_orderkey, 1 AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'inspect' ELSE 'search' END AS p, CASE WHEN o_orderkey % 3 = 0 THEN 'search' ELSE 'inspect' END AS s FROM orders)""")
def next_steps(t: Tables) -> DataFrame:
    first, second = F.when(F.col("o_orderkey") % 2 == 0, "inspect").otherwise("search"), F.when(F.col("o_orderkey") % 3 == 0, "search").otherwise("inspect")
    return t.orders.select(F.col("o_orderkey").alias("item"), F.array_join(text.ordered_set(F.array(first, F.lit(None).cast("string"), second, first)), ",").alias("next_steps"))


@query("""
SELECT event_id AS ord, array_to_string(CASE event_type WHEN 'error' THEN ['t' || user_id, 'u'] WHEN 'view' THEN ['v'] ELSE [] END, ',') AS types,
       CASE WHEN event_type = 'view' THEN 'p' || user_id ELSE '' END AS properties FROM events""")
def error_evidence(t: Tables) -> DataFrame:
    return diagnostics.message_evidence(t.diagnostics()).select("ord", F.array_join("types", ",").alias("types"), F.array_join("properties", ",").alias("properties"))
