"""Rules of the kernel on small tables."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text
from tessera.operators import assignable, catalog, compat, contract, graph, members, positions, revisions, rounds, transform
from tessera.protocol import Service, envelope, issues
from tessera.session import Workspace
from tessera.sources import catalyst, scopes, typescript
from tessera.sources.tables import Tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cap_is_a_cliff_in_one_place_and_a_cut_in_the_other(spark):
    t = spark.createDataFrame([(i, m) for i, n in enumerate((0, 1, 50, 51)) for m in range(n)], "type_id int, m int")
    assert rows(members.shown_members(t).groupBy("type_id").count()) == [(1, 1), (2, 50)]
    assert rows(members.first_members(t, ["m"]).groupBy("type_id").count()) == [(1, 1), (2, 50), (3, 50)]


def test_search_ignores_query_if_there_is_a_pattern(spark):
    t = spark.createDataFrame([(2, "User"), (1, "userInput"), (3, "Box")], "ord int, name string")
    assert [r.name for r in catalog.search(t, pattern="^USER", query="Box").collect()] == ["userInput", "User"]
    assert [r.name for r in catalog.search(t, query="Box").collect()] == ["Box"]


def test_limit_is_monotone(spark):
    t = spark.createDataFrame([(i, f"n{i % 3}", "k", "f") for i in range(9)], "ord int, name string, kind string, file string")
    found = [[r.ord for r in catalog.list_symbols(t, limit=n).collect()] for n in (1, 4, 20)]
    assert found[2][:4] == found[1] and found[1][:1] == found[0] and len(found[2]) == 9


def test_duplicates_keep_the_last_value_at_the_first_place(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z")], "ord int, key string, v string")
    from tessera.operators import diagnostics

    assert rows(diagnostics.distinct([t], ["key"])) == [("a", 1, "z"), ("b", 2, "y")]


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="aé\n😀 b", max_size=30), st.integers(0, 30))
def test_offsets_and_lines_agree(spark, s, k):
    k = min(k, len(s))
    files = spark.createDataFrame([("f", s)], "file string, text string")
    got = positions.line_of(spark.createDataFrame([("f", k)], "file string, offset int"), positions.lines(files)).first()
    assert (got.line, got.col) == (s[:k].count("\n") + 1, k - (s.rfind("\n", 0, k) + 1) + 1)


def test_utf16_columns(spark):
    got = spark.createDataFrame([("a😀b",), ("",)], "s string").select(text.utf16_length(F.col("s")).alias("n")).collect()
    assert [r.n for r in got] == [4, 0]


def test_innermost_node_takes_the_later_child_where_two_touch(spark):
    nodes = spark.createDataFrame([("f", 0, 0, 10, [0]), ("f", 1, 0, 5, [0, 0]), ("f", 2, 5, 10, [0, 1]), ("f", 3, 0, 5, [0, 0, 7])], "file string, node_id int, pos int, end int, path array<int>")
    at = spark.createDataFrame([("f", 5), ("f", 2)], "file string, offset int")
    assert rows(positions.node_at(at, nodes)) == [("f", 2, 3), ("f", 5, 2)]


def test_graph_ends_on_cycles_and_depth_is_monotone(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "root string")
    found = [{(r.src, r.dst) for r in graph.neighbourhood(edges, roots, d).collect()} for d in (0, 1, 2, 4, 9)]
    assert found[0] == set() and found[1] == {("a", "b")} and found[1] < found[2] < found[3] == found[4]
    assert ("e", "f") not in found[4]


def test_verdicts(spark):
    kinds = spark.createDataFrame([(1, "id", "string"), (1, "name", "string"), (2, "name", "string"), (3, "name", "int")], "type_id int, name string, type string")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (3, 2)], "from int, to int")
    assert rows(compat.verdicts(kinds, kinds, pairs)) == [(1, 2, True, 0, ""), (2, 1, False, 1, "missing id"), (3, 1, False, 2, "missing id; mismatch name"), (3, 2, False, 1, "mismatch name")]


def test_unwrapping_and_absent_sides(spark):
    t = spark.createDataFrame([("Promise<A>",), ("A",), ("any",), ("Promise< A >",)], "r string")
    assert [r[0] for r in t.select(transform.gives(F.col("r"), "A")).collect()] == ["unwrapped", "exact", None, "unwrapped"]
    assert [r[0] for r in t.select(transform.gives(F.col("r"), "A", unwrap=False)).collect()] == [None, "exact", None, None]
    yes, no = F.lit(True), F.lit(False)
    assert spark.range(1).select(transform.score(yes, yes, yes, no, yes, no), transform.score(no, yes, no, yes, no, yes)).first()[:] == (110, 59)


def test_trusted_search_verifies_no_more_than_it_needs(spark):
    ranked = spark.createDataFrame([(i, f"n{i:02}", "f", i, 100 - i) for i in range(30)], "callable int, name string, file string, ord int, score int")
    good = lambda df: df.withColumn("status", F.when(F.col("callable") % 2 == 0, "verified").otherwise("unverified"))
    for limit, want in ((5, [0, 2, 4, 6, 8]), (0, []), (99, list(range(0, 30, 2)))):
        assert [r.callable for r in transform.trusted_top(ranked, good, limit).collect()] == want == [r.callable for r in transform.trusted_first(ranked, good, limit).collect()]
    assert transform.score_floor(ranked, good, 5) == 91 and transform.score_floor(ranked, good, 16) is None
    none = lambda df: df.withColumn("status", F.lit("unverified"))
    assert transform.trusted_first(ranked, none, 3).collect() == [] and transform.trusted_first(ranked.where("false"), good, 3).collect() == []


def test_failed_transform_blocks_a_direct_fit(spark):
    row = lambda x: spark.createDataFrame([(x,)], "ok boolean")
    for checks, want in (((True, None, None, False), False), ((True, None, None, None), True), ((None, True, None, None), True), ((None,) * 4, False), ((False, True, True, None), False)):
        assert contract.evaluated(*map(row, checks)).first().ok is want


def test_revisions(spark):
    t = spark.createDataFrame([("a", 1, "x", False), ("a", 3, "y", False), ("b", 2, "z", False), ("b", 3, "", True)], "file string, revision int, text string, deleted boolean")
    assert [[r.text for r in revisions.as_of(t, "file", n).orderBy("file").collect()] for n in (1, 2, 3)] == [["x"], ["x", "z"], ["y"]]


def test_changes_before_a_read_make_one_refresh(spark):
    t = spark.createDataFrame([("g", i, c == "r") for i, c in enumerate("ccrrcrc")], "g string, ord int, is_read boolean")
    assert rows(revisions.refreshes(t, "g")) == [("g", 0, 2), ("g", 1, 1)]


def test_results_do_not_depend_on_partitions(spark):
    r = random.Random(1)
    seeds = [(r.randrange(5), i, r.choice("ab")) for i in range(40)]
    t = spark.createDataFrame(seeds, "callable int, ord int, name string")
    assert rows(transform.grouped(t.repartition(7))) == rows(transform.grouped(t.coalesce(1)))


def test_protocol():
    assert issues("info", {"symbol": " "}) == ["symbol: not valid"] and issues("info", {"symbol": "A", "package": None}) == ["package: not valid"]
    assert issues("transform-search", {}) and not issues("transform-search", {"to": "A"})
    service = Service({"info": lambda p: {"name": {"A": "A"}[p["symbol"]]}})
    batch = service.run("info", [{"symbol": "A"}, {"symbol": "B"}, {}])
    assert [x["ok"] for x in batch["items"]] == [True, False, False] and batch["outcome"] == "partial_failure"
    assert batch["items"][2]["error"]["issues"] == ["items[2].symbol: missing"]
    assert '"UNKNOWN_COMMAND"' in envelope(service.run("nope", {}))


def test_workspace(spark):
    opened = []
    w = Workspace(spark, lambda: opened.append(1) or {"t": spark.range(3)})
    assert w.table("t").count() == 3 and w.table("t").count() == 3 and len(opened) == 1
    w.mark_dirty()
    w.mark_dirty()
    assert w.table("t").count() == 3 and w.revision == 2 and len(opened) == 2
    w.close()
    w.close()
    try:
        w.table("t")
        raise AssertionError
    except RuntimeError as e:
        assert "CLOSED" in str(e)


def test_catalyst(spark):
    assert catalyst.check_snippet(spark, "SELECT 1") == []
    assert catalyst.check_snippet(spark, "SELECT 1 +\n  nope")[0][:2] == (2, 3)
    assert catalyst.eval_type("struct<a:int>")["result"] == "struct<a:int>" and catalyst.eval_type(" ")["error"]
    a, b = T.StructType.fromDDL("id int not null, x string not null"), T.StructType.fromDDL("id bigint not null")
    assert catalyst.assignable(a, b) and not catalyst.assignable(b, a)
    assert not catalyst.assignable(T.StructType.fromDDL("id int"), b)


SOURCE = """export interface Item extends Base {
  readonly id: string;
  note?: number
}
type Local = { a: string, b: { c: number } };
export default class Shelf extends Rack<Item> {
}
export async function load(id: string): Promise<Item> { return x; }
"""


def test_typescript(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.ts").write_text(SOURCE)
    files = typescript.read(spark, str(tmp_path))
    parsed = scopes.parsed(files)
    assert [r[2:] for r in rows(typescript.declarations(parsed).select("file", "line", "name", "kind", "exported", "is_default"))] == [
        ("Item", "interface", True, False), ("Local", "type", False, False), ("Shelf", "class", True, True), ("load", "function", True, False)
    ]
    assert [(r.type_name, r.name, r.type, r.optional, r.readonly) for r in typescript.members(parsed).orderBy("ord").collect()] == [
        ("Item", "id", "string", False, True), ("Item", "note", "number", True, False), ("Local", "a", "string", False, False), ("Local", "b", "{ c: number }", False, False)
    ]
    assert typescript.unsupported(files).collect() == []
    assert {(r.type_name, r.base) for r in typescript.bases(parsed).collect()} == {("Item", "Base"), ("Shelf", "Rack")}


def test_refresh_stream(spark, tmp_path):
    import json

    from tessera.streaming.refresh import event_counts, files_at, follow

    src, facts, cp = (str(tmp_path / x) for x in ("in", "facts", "cp"))
    (tmp_path / "in").mkdir()
    put = lambda name, *docs: (tmp_path / "in" / name).write_text("\n".join(json.dumps(d) for d in docs))
    put("1.json", {"file": "a", "text": "x", "deleted": False}, {"file": "b", "text": "y", "deleted": False})
    follow(spark, src, facts, cp).awaitTermination()
    put("2.json", {"file": "b", "text": "", "deleted": True})
    put("3.json", {"file": "c", "text": "z", "deleted": False})
    follow(spark, src, facts, cp).awaitTermination()
    assert [[r.file for r in files_at(spark, facts, n).orderBy("file").collect()] for n in (1, 2)] == [["a", "b"], ["a", "c"]]
    events = spark.createDataFrame([Row(ts=None, event_type="v")], "ts timestamp, event_type string")
    assert event_counts(events).count() == 0


def test_ancestors_are_looked_up_in_the_sizes_that_there_are(spark):
    nodes = spark.createDataFrame([(1, 1, 0, 9000, "big"), (1, 2, 10, 49, "small"), (1, 3, 20, 21, "leaf"), (1, 4, 100, 8000, "leaf"), (2, 1, 0, 5, "leaf")], "file long, node_id int, pos long, end long, kind string")
    got = {(r.file, r.node_id): r.ancestor for r in positions.ancestor_of_kind(nodes, nodes, ["big", "small"]).collect()}
    assert got == {(1, 1): None, (1, 2): 1, (1, 3): 2, (1, 4): 1, (2, 1): None}
    # two sizes for the short nodes, one for the long ones: each node looked into cells of all twelve sizes
    assert positions.look_ups(nodes, [6, 15]).count() == 3 * 2 + 2


def test_partitions_of_graphs_and_callables_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(rounds, "PART_ROWS", 10)
    edges = spark.range(200).select(F.concat(F.lit("o"), "id").alias("src"), F.concat(F.lit("c"), F.col("id") % 3).alias("dst"))
    found = graph.rendered(graph.neighbourhood(edges, edges.select(F.col("src").alias("root")), 2), rows=200)
    assert found.count() == 200 and found.rdd.getNumPartitions() == 21
    assert transform.grouped(Tables(spark, "/root/testdata/sf0.001").callables()).rdd.getNumPartitions() > 40


def fitting(asked, types):
    """The pairs that hold of all that `asked` leads to: the greatest fixpoint, in plain Python."""

    def needs(a, b):
        if a == b or b in ("any", "unknown") or a in ("any", "never"):
            return []
        if "|" in a or "|" in b:
            return [[(p, q) for q in b.split("|")] for p in a.split("|")]
        if a.endswith("[]") and b.endswith("[]"):
            return [[(a[:-2], b[:-2])]]
        if a[0] == "'" and b == "string":
            return []
        if a not in types or b not in types:
            return [[]]
        found = []
        for name, (t, optional) in types[b].items():
            own = types[a].get(name)
            bad = not optional if own is None else own[1] and not optional
            found.append([] if bad else [("never", "any")] if own is None else [(own[0], t)])
        return found

    all_, new = {}, set(asked)
    while new:
        all_ |= {p: needs(*p) for p in new}
        new = {z for p in new for r in all_[p] for z in r} - set(all_)
    holds = set(all_)
    while lost := {p for p in holds if any(not holds.intersection(r) for r in all_[p])}:
        holds -= lost
    return all_, holds


def relation(spark, asked, types):
    members = [(t, n, x, o) for t, ms in types.items() for n, (x, o) in ms.items()]
    tables = spark.createDataFrame(members, "type_id string, name string, type string, optional boolean"), spark.createDataFrame([(t,) for t in types], "type_id string")
    rows = assignable.assignable(spark.createDataFrame(asked, "a string, b string"), *tables).collect()
    assert len(rows) == len({(r.a, r.b) for r in rows})
    return {(r.a, r.b): r.ok for r in rows}


def test_assignable_against_a_plain_fixpoint(spark):
    """Members that lead to named types in one type and not in the other, arrays and unions of such, optional ones."""
    r, names = random.Random(3), [f"T{k}" for k in range(9)]
    kinds = lambda: r.choice((r.choice(names), r.choice(names), "string", "'x'", "any", r.choice(names) + "[]", "|".join(r.sample(names, 2))))
    types = {t: {n: (kinds(), r.random() < 0.2) for n in "pqr" if r.random() < 0.6} for t in names}
    asked = [(a, b) for a in names for b in names]
    all_, holds = fitting(asked, types)
    got = relation(spark, asked, types)
    assert got == {p: p in holds for p in all_} and 9 < sum(a != b for a, b in holds)


def test_assignable_decides_shapes_once(spark, monkeypatch):
    """What members that lead to no named type need is found for pairs of shapes, of which circles of types have few; each pair's needs were made before, 400 here."""
    made, of = [], assignable.requirements
    monkeypatch.setattr(assignable, "requirements", lambda pairs, *a: made.append(pairs.count()) or of(pairs, *a))
    monkeypatch.setattr(assignable, "STEPS", 1)
    # circles of the same shape hold; a chain of lists ends in another shape, nineteen steps from its begin
    types = {f"A{k}": {"seg": ("'x'", False), "next": (f"A{(k + 1) % 20}", False)} for k in range(20)}
    types |= {f"B{k}": {"seg": ("string", False), "next": (f"B{(k + 1) % 20}", False)} for k in range(20)}
    types |= {f"C{k}": {"seg": ("string" if k < 19 else "number", False), "next": (f"C{min(k + 1, 19)}", False)} for k in range(20)}
    asked = [(f"A{k}", f"{c}0") for k in range(20) for c in "BC"]
    all_, holds = fitting(asked, types)
    got = relation(spark, asked, types)
    assert got == {p: p in holds for p in all_} and sum(got[f"A{k}", "B0"] for k in range(20)) == 20 and not got["A0", "C0"]
    assert sum(made) < 20 < 400 < len(got)
