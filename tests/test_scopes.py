"""Scopes, callables, identity, assignability and snippets of source texts."""

import pytest
from pyspark.sql import functions as F

from tessera import service
from tessera.functions.text import masked
from tessera.operators import assignable, catalog, positions, transform
from tessera.operators.pointers import ends
from tessera.sources import modules, scopes, snippets, typescript

TEXT = '''import { A as B, type C } from "./x";
/** @deprecated old */
export function conv(u: User, m: Map<string, number> = new Map()): Promise<Dto> {
  const inner = { a: 1, go(x: number): string { return "("; } };
  return inner;
}
  export const arrow = async (a: User): Promise<Dto> => ({ id: a.id }), second = 3
export abstract class Shop<T extends { x: 1 }> extends Base<A<B<C<D<E>>>>> implements I {
  readonly name: string
  private items: { id: string; tags?: string[] }[] = []
  static make(n: number): Shop { return new Shop(n); }
  constructor(private readonly n: number) { super(); if (n > 1) { n = /["{]/.exec(`a${n}`) } }
  get size(): number { return 1 }
  async find(id: string): Promise<{ a: string }> {
    return x
  }
}
export interface Repo extends Shop, Other {
  find(id: string): User | undefined;
  (x: string): number
  make: (u: User) => Dto
  nested: { deep: { deeper(): void } }
  kind?: 'a' | 'b',
}
type Conv = (a: User) => Dto;
export default function over(a: string): string;
export const table = { toDto: (u: User): Dto => null, n: { g: function (a: A): B { call(1); return 1 } } };
enum Color { Red, Green = 2 }
export function pick(a: string): string
export function pick(a: number): number
export function pick(a: any): any { return a }
function given() { return arrow() }
const passed = () => given()
const text = () => "x"
function circle() { return round() }
function round() { if (1) { return circle() } return circle() }
function two() { if (1) { return 1 } return "x" }
'''


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame([("f.ts", TEXT), ("bad.ts", "class X { a(: ]\ninterface Y {}"), ("e.ts", ""), ("n.ts", None)], "file string, text string")
    return scopes.parsed(files).cache(), files


def test_members_of_bodies_of_any_depth(parsed):
    rows, files = parsed
    got = {(r.type_name, r.name): (r.type, r.optional, r.readonly) for r in typescript.members(rows).collect()}
    assert got == {
        ("Shop", "name"): ("string", False, True), ("Shop", "items"): ("{ id: string; tags?: string[] }[]", False, False), ("Shop", "n"): ("number", False, True),
        ("Shop", "size"): ("number", False, False), ("Shop", "find"): ("(string) => Promise<{ a: string }>", False, False),
        ("Repo", "find"): ("(string) => User | undefined", False, False), ("Repo", "make"): ("(User) => Dto", False, False),
        ("Repo", "nested"): ("{ deep: { deeper(): void } }", False, False), ("Repo", "kind"): ("'a' | 'b'", True, False),
    }
    assert {(r.type_name, r.base) for r in typescript.bases(rows).collect()} == {("Shop", "Base"), ("Repo", "Shop"), ("Repo", "Other")}
    names = [(r.name, r.kind, r.line, r.exported) for r in typescript.declarations(rows).orderBy("line", "name").collect()]
    assert names[:6] == [("conv", "function", 3, True), ("arrow", "const", 7, True), ("second", "const", 7, True), ("Shop", "class", 8, True), ("Repo", "interface", 18, True), ("Conv", "type", 25, False)]
    assert {(r.file, r.type_name) for r in typescript.unsupported(files).collect()} == {("bad.ts", "X"), ("bad.ts", "Y")}
    assert [(r.name, r.type) for r in typescript.aliases(rows).collect()] == [("Conv", "(a: User) => Dto")]


def test_nine_kinds_of_callables(parsed):
    rows, _ = parsed
    found = typescript.callables(rows).orderBy("ord").collect()
    got = [(r.name, r.kind, r.container, r.params, r.returns) for r in found if r.stated]
    assert got == [
        ("conv", "Function", None, ["User", "Map<string, number>"], "Promise<Dto>"), ("go", "ObjectMethod", "inner", ["number"], "string"), ("arrow", "VariableCallable", None, ["User"], "Promise<Dto>"),
        ("make", "StaticMethod", "Shop", ["number"], "Shop"), ("constructor", "Constructor", "Shop", ["number"], "Shop"), ("find", "ClassMethod", "Shop", ["string"], "Promise<{ a: string }>"),
        ("find", "InterfaceMethod", "Repo", ["string"], "User | undefined"), ("Repo", "TypeLiteralMethod", "Repo", ["string"], "number"), ("make", "CallableProperty", "Repo", ["User"], "Dto"),
        ("deeper", "InterfaceMethod", "deep", [], "void"), ("over", "Function", None, ["string"], "string"), ("toDto", "ObjectMethod", "table", ["User"], "Dto"), ("g", "ObjectMethod", "n", ["A"], "B"),
        ("pick", "Function", None, ["any"], "any"),
    ]
    assert [r.name for r in found if r.deprecated] == ["conv"]
    assert [(r.name, r.params, r.returns) for r in typescript.signatures(rows).where("name = 'pick'").orderBy("ord").collect()] == [("pick", ["string"], "string"), ("pick", ["number"], "number")]
    # returns that nothing states: what is handed on, at the end of the chain, or none
    filled = {r.name: r.returns for r in found if not r.stated}
    assert filled == {"given": "Promise<Dto>", "passed": "Promise<Dto>", "text": "string", "circle": None, "round": None, "two": None}


def test_chains_and_circles(spark):
    n = 100
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(n)] + [("a", "b"), ("b", "c"), ("c", "b"), ("x", "x"), ("y", "a")]
    got = {r.node: r.end for r in ends(spark.createDataFrame(pairs, "node string, next string")).collect()}
    assert got == {f"n{i}": f"n{n}" for i in range(n)} and ends(spark.createDataFrame([], "node string, next string")).collect() == []
    made = spark.createDataFrame([("f", None), ("g", None), ("h", "X"), ("i", None)], "callable string, returns string")
    given = spark.createDataFrame([("f", "g", None), ("g", "h", None), ("i", "lost", None)], "callable string, callee string, type string")
    assert {tuple(r) for r in transform.filled_returns(made, given).collect()} == {("f", "X", "handed on"), ("g", "X", "handed on"), ("h", "X", "stated"), ("i", None, "end unknown")}


FILES = [
    ("r/a.ts", "export interface Item { id: string }\nexport default class Shelf { one: Item }\ninterface Local {}\nexport { Local as Named }"),
    ("r/b.ts", "export interface Item { id: number; next?: Item }\nexport const fn = () => `x ${fn} Item`; // Item"),
    ("r/lib/index.ts", "export * from '../a';\nexport { Item as BItem } from '../b.js'"),
    ("r/lib/more.ts", "export * from '.'"),
    ("r/lib/deep.ts", "export * from './more'; export { BItem as Far } from '.'"),
    ("r/use.ts", "import Shelf, { Item } from './a';\nimport { Far, Named } from './lib/deep'\n// import { X } from './b'\nlet x: Far | Item; x.Item; const o = { Item: 1 }; type T = `${Far}`"),
    ("r/cyc1.ts", "export { Q } from './cyc2'"),
    ("r/cyc2.ts", "export { Q } from './cyc1'"),
]


def test_names_through_barrels(spark):
    files = spark.createDataFrame(FILES, "file string, text string").cache()
    parsed = scopes.parsed(files).cache()
    declared = typescript.declarations(parsed).cache()
    names = modules.names(files, declared).cache()
    used = {r.name: (r.home, r.symbol) for r in names.where("file = 'r/use.ts'").collect()}
    assert {k: used[k] for k in ("Shelf", "Item", "Far", "Named")} == {"Shelf": ("r/a.ts", "Shelf"), "Item": ("r/a.ts", "Item"), "Far": ("r/b.ts", "Item"), "Named": ("r/a.ts", "Local")} and "X" not in used
    out = {(r.name, r.home, r.symbol) for r in modules.exported_names(files, declared).where("file = 'r/lib/deep.ts'").collect()}
    assert out == {("Far", "r/b.ts", "Item"), ("BItem", "r/b.ts", "Item"), ("Item", "r/a.ts", "Item"), ("Named", "r/a.ts", "Local")}
    refs = modules.references(files, names)
    sites = lambda home: {(r.file, r.line) for r in refs.where((F.col("home") == home) & (F.col("symbol") == "Item")).collect()}
    # the key, the member behind a point, texts and comments are none; the name in a template is
    assert sites("r/a.ts") == {("r/a.ts", 1), ("r/a.ts", 2), ("r/use.ts", 1), ("r/use.ts", 4)} and sites("r/b.ts") == {("r/b.ts", 1), ("r/use.ts", 2), ("r/use.ts", 4)}
    assert refs.where("file = 'r/use.ts' and line = 4 and home = 'r/b.ts'").count() == 2
    texts = {r.type for r in modules.by_identity(typescript.members(parsed), "type", names).collect()}
    assert len([t for t in texts if t.startswith("Item$")]) == 2 and all(modules.NAME for t in texts)


MEMBERS = [
    ("Item", "id", "string", False), ("Item", "next", "Item", True), ("Card", "id", "string", False), ("Card", "next", "Card", True), ("Bad", "id", "number", False),
    ("Loop", "next", "Loop2", False), ("Loop2", "next", "Loop", False), ("Opt", "id", "string", True), ("W", "id", "string|number", False),
]
CASES = [
    ("Item", "Card", 1), ("Card", "Item", 1), ("Bad", "Item", 0), ("Loop", "Loop2", 1), ("Loop", "Item", 0), ("Opt", "Item", 0), ("Item", "Opt", 1), ("Item", "W", 1), ("W", "Item", 0), ("'a'", "string", 1),
    ("string", "'a'|'b'", 0), ("'a' | 'b'", "'b'|'a'|'c'", 1), ("Item[]", "Card[]", 1), ("Array<Item>", "readonly Card[]", 1), ("Bad[]", "Item[]", 0), ("(Item|Bad)[]", "(Item | Bad)[]", 1),
    ("[string, number]", "(string|number)[]", 1), ("Promise<Item>", "Promise<Card>", 1), ("Promise<Bad>", "Promise<Item>", 0), ("Al", "Item", 1), ("Item", "Al", 1), ("Al", "Bad", 0), ("Item", "Empty", 1),
    ("Empty", "Item", 0), ("any", "Item", 1), ("Item", "unknown", 1), ("{ id: string; x: 1 }", "Opt", 1), ("Fn", "(x: Card, y: string) => Item", 1), ("(a: Item) => Bad", "Fn", 0), ("() => Card", "Fn", 1),
    ("(a: Bad) => Card", "Fn", 0), ("() => string", "() => void", 1), ("string", "number", 0), ("(a:string)=>string", "(a:'x')=>string|number", 1), ("true", "boolean", 1), ("string[]", "string", 0),
]


def test_assignable_texts(spark):
    members = spark.createDataFrame(MEMBERS, "type_id string, name string, type string, optional boolean")
    types = members.select("type_id").union(spark.createDataFrame([("Empty",)], "type_id string"))
    aliases = spark.createDataFrame([("Al", "Item | Card"), ("Fn", "(a: Item, b?: string) => Card")], "type_id string, type string")
    asked = spark.createDataFrame([c[:2] for c in CASES] + [(None, "Item")], "a string, b string")
    relation = assignable.assignable(asked, members, types, aliases).cache()
    got = {(r.a, r.b): r.ok for r in assignable.related(asked, relation).collect()}
    assert [(a, b, int(got[a, b])) for a, b, _ in CASES] == CASES and got[None, "Item"] is None
    assert assignable.assignable(asked.where("false"), members, types).count() == 0


def test_assignable_over_long_circles_and_chains(spark, monkeypatch):
    """Types whose members lead far take rounds by the logarithm of the way; it was a table or more for each step."""
    n, written = 40, []
    # two circles of unlike lengths that agree, and a chain whose last type lacks what the circle has
    rows = [(f"{c}{i}", "next", f"{c}{(i + 1) % k}", False) for c, k in (("A", n), ("B", n - 1)) for i in range(k)]
    rows += [(f"C{i}", "next", f"C{i + 1}", False) for i in range(n)] + [("C40", "other", "string", False)]
    members = spark.createDataFrame(rows, "type_id string, name string, type string, optional boolean")
    asked = spark.createDataFrame([("A0", "B0"), ("C0", "A0"), ("A0", "C0"), ("C0", "C1")], "a string, b string")
    hold = assignable.held
    monkeypatch.setattr(assignable, "held", lambda df: written.append(1) or hold(df))
    got = {(r.a, r.b): r.ok for r in assignable.assignable(asked, members, members.select("type_id")).collect()}
    assert got["A0", "B0"] and not got["C0", "A0"] and not got["A0", "C0"] and not got["C0", "C1"]
    assert len([p for p in got if p[0][0] == "A" and p[1][0] == "B"]) == n * (n - 1) and not got["C7", "A7"] and len(written) < n * 3
    few = assignable.assignable(asked, members, members.select("type_id"), whole=False)
    assert {(r.a, r.b): r.ok for r in few.collect()} == {k: got[k] for k in [("A0", "B0"), ("C0", "A0"), ("A0", "C0"), ("C0", "C1")]}


def test_masked_templates_and_patterns(spark):
    text = "a = `x ${Name} y`; b = /[\"'`]/g; c = 'Name' // Name\nd = e / f / 'g'; /* Name */ Name"
    got = spark.createDataFrame([(text,)], "t string").select(masked(F.col("t")).alias("m")).first().m
    assert len(got) == len(text) and got.count("Name") == 2 and "${Name}" in got and got.endswith("Name") and "e / f /" in got and "`" not in got


def test_ancestors_and_nearest_folders(spark):
    nodes = spark.createDataFrame([("f", 0, 0, 100, "file"), ("f", 1, 0, 50, "ref"), ("f", 2, 0, 50, "ref"), ("f", 3, 10, 20, "name"), ("f", 4, 60, 70, "name"), ("g", 5, 10, 20, "name"), ("f", 6, 5, 9000, "ref")], "file string, node_id int, pos int, end int, kind string")
    got = {r.node_id: r.ancestor for r in positions.ancestor_of_kind(nodes, nodes, ["ref"]).collect()}
    assert got == {0: None, 1: None, 2: 1, 3: 2, 4: 6, 5: None, 6: None}
    files = spark.createDataFrame([("/w/a/b/x.ts",), ("/w/a/x.ts",), ("/w/ab/x.ts",), ("/x.ts",)], "file string")
    folders = spark.createDataFrame([("/w/",), ("/w/a/",), ("/w/a/b/",), ("/w/a/",)], "folder string")
    assert {tuple(r) for r in catalog.nearest_folder(files, folders).collect()} == {("/w/a/b/x.ts", "/w/a/b/"), ("/w/a/x.ts", "/w/a/"), ("/w/ab/x.ts", "/w/"), ("/x.ts", None)}


def test_names_in_the_order_of_readers(spark):
    rows = spark.createDataFrame([(n, "k", "f", i) for i, n in enumerate(("Zebra", "apple", "Éclair", "banana", "Apple", "eagle"))], "name string, kind string, file string, ord int")
    assert [r.name for r in catalog.list_symbols(rows, collation="UNICODE").collect()] == ["apple", "Apple", "banana", "eagle", "Éclair", "Zebra"]
    assert [r.name for r in catalog.list_symbols(rows).collect()] == ["Apple", "Zebra", "apple", "banana", "eagle", "Éclair"]


SNIPPETS = [
    ("s1", "import D, { A as B, type C } from 'x'; import * as N from 'y'\nconst { a, b: c, d = 1 } = o, e = 2; let [f, g] = [1, 2]\nfunction h() { const inner = 1 }\nclass I {} interface J {} enum K {} type L = 1"),
    ("s2", "const x = Item.of(Card); x.Shelf; function f(y: Shelf): Used { return y }\nconst Used = 1"),
    ("s3", ""),
]


def test_bound_names_and_imports_of_snippets(spark):
    rows = spark.createDataFrame(SNIPPETS, "file string, text string")
    got = {}
    for r in snippets.bound_names(rows).collect():
        got.setdefault(r.file, set()).add(r.name)
    assert got == {"s1": set("D B C N a c d e f g h I J K L".split()), "s2": {"x", "f", "Used"}}
    exports = spark.createDataFrame([("p", "p/index.ts", n, True, False) for n in ("Item", "Card", "Used")] + [("q", "q/src/s.ts", "Shelf", False, True)], "package string, file string, name string, is_index boolean, is_src boolean")
    assert {tuple(r) for r in snippets.needed_imports(rows, exports).collect()} == {("s2", "p/index.ts", "Card,Item"), ("s2", "q/src/s.ts", "Shelf")}


def test_service_tells_equal_names_apart(spark, tmp_path):
    (tmp_path / "a.ts").write_text("export interface Item { id: string }\nexport interface Big extends Item { size: number }\nexport class Box { put(i: Item): Big { return x } static of(s: string): Box { return x } }\n")
    (tmp_path / "b.ts").write_text("export interface Item { code: number }\nexport const keep = (i: Item): Item => i\n")
    (tmp_path / "use.ts").write_text("import { Item as Thing } from './index'\nexport function make(t: Thing): Thing { return t }\nexport const made = (t: Thing) => make(t)\n")
    (tmp_path / "index.ts").write_text("export * from './a'\nexport { Item as Code } from './b'\n")
    (tmp_path / "pkg/node_modules").mkdir(parents=True)
    (tmp_path / "pkg/tsconfig.json").write_text("{}")
    (tmp_path / "pkg/node_modules/tsconfig.json").write_text("{}")
    project = service.Project(spark, str(tmp_path))
    call = project.handlers()
    assert [m["name"] for m in call["info"]({"symbol": "Item@b.ts"})["properties"]] == ["code"] and [m["name"] for m in call["info"]({"symbol": "Big"})["properties"]] == ["size", "id"]
    assert [m["name"] for m in call["info"]({"symbol": "Code"})["properties"]] == ["code"]
    lines = lambda name: {(r["file"].rsplit("/", 1)[1], r["line"]) for r in call["related"]({"symbol": name})["incoming"]}
    assert lines("Item@a.ts") == {("a.ts", 2), ("a.ts", 3), ("use.ts", 2), ("use.ts", 3)} and lines("Item@b.ts") == {("b.ts", 2), ("index.ts", 2)}
    sites = call["refactor-preview"]({"action": "rename", "symbol": "Item@b.ts", "to": "Code"})["changes"]
    assert {(c["file"].rsplit("/", 1)[1], c["line"]) for c in sites} == {("b.ts", 1), ("b.ts", 2), ("index.ts", 2)}
    found = call["transform-search"]({"from": "Item", "to": "Big"})["matches"]
    assert [(m["name"], m["kind"], m["container"], m["how"]) for m in found] == [("put", "ClassMethod", "Box", "exact")]
    assert {m["name"] for m in call["transform-search"]({"from": "Big"})["matches"]} == {"put", "make", "made"}
    assert call["compatible"]({"from": "Big", "to": "Item"})["compatible"] and not call["compatible"]({"from": "Item@b.ts", "to": "Item@a.ts"})["compatible"]
    assert [p["name"] for p in call["packages"]({})] == ["(root)", "pkg"]
    assert call["at-position"]({"file": "use.ts", "line": 2, "column": 26})["text"] == "Thing"
    # one file more, and another text for one: the base stays as it is, and so does the other overlay
    more, other = project.with_file("c.ts", "export interface New extends Big { x: 1 }\n"), project.with_file("a.ts", "export interface Item { id: boolean }\n")
    assert [m["name"] for m in more.handlers()["info"]({"symbol": "New"})["properties"]] == ["x", "size", "id"]
    assert [m["type"] for m in other.handlers()["info"]({"symbol": "Item@a.ts"})["properties"]] == ["boolean"]
    for p in (project, other):
        with pytest.raises(service.NotFound):
            p.handlers()["info"]({"symbol": "New"})
    assert [m["type"] for m in call["info"]({"symbol": "Item@a.ts"})["properties"]] == ["string"]
