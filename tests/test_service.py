"""Every command over a small tree of source files."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import service
from tessera.operators.compat import text_fits
from tessera.protocol import COMMANDS

SHOP = """export interface Item {
  readonly id: string;
  name: string;
  note?: number
}
export interface Card { id: string; name: string }
export interface Wide { id: string; size: number }
interface Hidden { a: string }
export class Shelf extends Item {
}
export class Lost extends Nowhere {
}
export type Deep = { a: { b: string } };
/** @deprecated use toCard */
export function oldCard(item: Item): Card { return x; }
export function toCard(item: Item, n: number): Card { return x; }
export async function load(id: string): Promise<Item> { return x; }
export const show = (card: Card): string => "Item";
// an Item in a comment
"""


@pytest.fixture(scope="module")
def ask(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "shop.ts").write_text(SHOP)
    (root / "node_modules").mkdir()
    (root / "node_modules/x.ts").write_text("export interface Foreign { a: string }")
    answers = service.service(spark, str(root))
    return lambda command, **payload: answers.run(command, payload)


def test_catalog_commands(ask):
    found = ask("symbols", pattern="card", limit=2)["data"]
    assert [s["name"] for s in found["symbols"]] == ["Card", "oldCard"] and (found["total"], found["truncated"]) == (3, True)
    assert [s["name"] for s in ask("symbols", kind="interface")["data"]["symbols"]] == ["Card", "Item", "Wide"]
    info = ask("info", symbol="Item")["data"]
    assert [(m["name"], m["optional"], m["readonly"]) for m in info["properties"]] == [("id", False, True), ("name", False, False), ("note", True, False)]
    assert ask("info", symbol="Item.note")["data"]["properties"][0]["type"] == "number"
    assert not ask("info", symbol="Foreign")["ok"] and [(m["name"], m["type"]) for m in ask("info", symbol="Deep")["data"]["properties"]] == [("a", "{ b: string }")]
    assert ask("expand", symbol="Card")["data"]["expanded"] == "{ id: string; name: string }"
    assert ask("expand", symbol="toCard")["data"]["expanded"] == "(Item, number) => Card"
    assert [s["name"] for s in ask("search", query=".", hasProperty="name")["data"]] == ["Item", "Card", "Shelf"]
    assert [s["name"] for s in ask("search", query=".", extends="Item")["data"]] == ["Shelf"]
    assert "Hidden" not in str(ask("file", file="shop.ts")["data"]) and "Hidden" in str(ask("file", file="shop.ts", includePrivate=True)["data"])
    assert not ask("file", file="none.ts")["ok"] and ask("packages")["data"][0]["name"] == "(root)"


def test_positions_and_types(ask):
    found = ask("at-position", file="shop.ts", line=9, column=30)["data"]
    assert (found["text"], found["kind"]) == ("Item", "interface")
    assert not ask("at-position", file="shop.ts", line=900, column=1)["ok"]
    assert ask("eval", expression="array<int>")["data"]["result"] == "array<int>"
    assert ask("explain", expression="nonsense<")["data"]["steps"][0]["result"].startswith("Error: ")
    assert ask("check-snippet", code="SELECT 1")["data"]["valid"] and not ask("check-snippet", code="SELECT (")["data"]["valid"]


def test_compatibility(ask, spark):
    assert ask("compatible", **{"from": "Item", "to": "Card"})["data"]["compatible"]
    assert ask("compatible", **{"from": "Card", "to": "Wide"})["data"]["reason"] == "Property 'size' is missing in type 'Card' but required in type 'Wide' (expected: number)"
    assert ask("compatible", **{"from": "Card", "to": "Deep"})["data"]["issues"][0]["expectedType"] == "{ b: string }"
    assert not ask("compatible", **{"from": "Card", "to": "None"})["data"]["compatible"]
    table = [
        ("'a'", "string", True), ("string", "'a' | 'b'", False), ("'a'|'b'|'c'", "'a'|'b'", False), ("'a'", "'b' | 'a'", True), ("string[]", "(string|number)[]", True),
        ("(string|number)[]", "string[]", False), ("Array<string>", "string[]", True), ("readonly string[]", "string[]", True), ("1", "number", True), ("string", "number", False),
        ("string", "unknown", True), ("string[]", "string", False),
    ]
    got = spark.createDataFrame([t[:2] for t in table], "a string, b string").select("a", "b", text_fits(F.col("a"), F.col("b")).alias("fits")).collect()
    assert [tuple(r) for r in got] == table


def test_diagnostics(ask):
    found = ask("diagnostics")["data"]
    assert [(d["line"], d["code"]) for d in found] == [(11, 2304)]
    assert ask("diagnostics", explain=True)["data"]["total"] == 1
    why = ask("why-error", message="Property 'p' does not exist on type 'v'", code=2339)["data"]
    assert (why["type_name"], why["property_name"], why["explanation"]) == ("v", "p", "unknown property")
    assert ask("why-error", file="shop.ts", line=11)["data"]["code"] == 2304 and not ask("why-error", code=1)["ok"]


def test_references(ask):
    found = ask("related", symbol="Item")["data"]
    # lines 18 and 19 have the word in a string and in a comment only
    assert {r["line"] for r in found["incoming"]} == {9, 15, 16, 17} and found["outgoing"] == []
    assert {(e["dst"], e["context"]) for e in ask("related", symbol="toCard")["data"]["outgoing"]} == {("Item", "parameter"), ("Card", "return")}
    graph = ask("graph", symbol="toCard", depth=1)["data"]
    assert graph["nodes"][0] == "toCard" and set(graph["nodes"]) == {"toCard", "Item", "Card"} and "toCard --> Card" in graph["rendered"]
    assert ask("graph", symbol="toCard", format="dot")["data"]["rendered"].startswith("digraph")
    plan = ask("refactor-preview", symbol="Item", to="Thing")["data"]
    assert plan["n_files"] == 1 and {c["line"] for c in plan["changes"]} == {1, 9, 15, 16, 17} and {n["line"] for n in plan["notes"]} == {18, 19}
    assert plan["confidence"] == "high" and not plan["safe"]


def test_transforms_and_contracts(ask):
    found = ask("transform-search", **{"from": "Item", "to": "Card"})["data"]
    assert [(m["name"], m["score"]) for m in found["matches"]] == [("toCard", 110), ("oldCard", 95)] and found["stats"]["n_assignable"] == 2
    # a Card has all that an Item needs
    found = ask("transform-search", to="Item")["data"]["matches"]
    assert [(m["name"], m["how"], m["score"]) for m in found] == [("load", "unwrapped", 100), ("toCard", "assignable", 94), ("oldCard", "assignable", 79)]
    assert [m["name"] for m in ask("transform-search", to="Item", unwrapReturn=False)["data"]["matches"]] == ["toCard", "oldCard"]
    assert ask("transform-search", to="Card", verifiedOnly=True)["data"]["matches"] == [] and not ask("transform-search")["ok"]
    good = ask("verify-contract", **{"from": "Item", "to": "Card", "snippet": "SELECT 1"})["data"]
    assert good["ok"] and good["direct"] and good["snippet"] and good["transform"] and "toCard" in good["transforms"]
    assert not ask("verify-contract", snippet="SELECT (")["data"]["ok"]
    half = ask("verify-contract", **{"from": "Item", "snippet": "SELECT 1"})["data"]
    assert half["ok"] and half["gaps"]


def test_every_command_is_answered(ask):
    assert set(service.describe()) == set(COMMANDS) and ask("doctor")["data"]["files"] == 1


def test_answers_as_files(tmp_path):
    got = service.saved({"ok": True, "command": "info", "data": "é"}, str(tmp_path / "out"))
    raw = open(got["artifact"], "rb").read()
    assert json.loads(raw)["data"] == "é" and got["size_bytes"] == len(raw) - 1
    assert service.payload_of('{"a": 1}') == {"a": 1} and service.payload_of(None) == {}


def test_inherited_members_packages_and_masked_sites(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one/package.json").write_text('{"name": "@shop/one"}')
    (tmp_path / "one/a.ts").write_text("export interface Base { id: string; name: string }\nexport interface Other<T> { size: number }\nexport interface Both extends Base, Other<Base> { name: number }\n")
    (tmp_path / "b.ts").write_text("export interface Flat { id: string; size: number }\n// a Base in a comment\nconst x = 'Base';\nfunction f(b: Base): string { return ''; }\n")
    answers = service.service(spark, str(tmp_path))
    ask = lambda command, **payload: answers.run(command, payload)
    assert [(m["name"], m["type"]) for m in ask("info", symbol="Both")["data"]["properties"]] == [("name", "number"), ("id", "string"), ("size", "number")]
    assert ask("compatible", **{"from": "Both", "to": "Flat"})["data"]["compatible"]
    found = ask("refactor-preview", symbol="Base", to="Root")["data"]
    assert [(c["file"].split("/")[-1], c["line"]) for c in found["changes"]] == [("b.ts", 4), ("a.ts", 1), ("a.ts", 3)] and found["n_notes"] == 2
    assert [p["name"] for p in ask("packages")["data"]] == ["(root)", "@shop/one"]
    assert {s["name"] for s in ask("symbols", package="@shop/one")["data"]["symbols"]} == {"Base", "Other", "Both"}
    assert {s["name"] for s in ask("symbols")["data"]["symbols"]} == {"Base", "Other", "Both", "Flat"}
    assert not ask("symbols", package="none")["ok"]
    assert len(ask("related", symbol="Base")["data"]["incoming"]) == 2
