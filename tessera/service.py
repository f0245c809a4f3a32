"""All commands over a tree of source files: payloads in, what JSON can hold out.

Facts come from `sources.typescript` and `sources.modules`, questions go to
`operators`. A command plans some Spark jobs. What it collects is bounded by
its limit where it has one; `related`, `graph`, `diagnostics` without `explain`
and `file` answer whole, so that their answers grow with what one symbol, file
or tree has.
"""

from __future__ import annotations

import argparse
import datetime
import json
import os
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import WRAPPERS, matches, spaceless, truncated, unwrapped
from tessera.operators import assignable, catalog, contract, graph, members, positions, transform
from tessera.operators import diagnostics as messages
from tessera.operators.rounds import held
from tessera.protocol import COMMANDS, SINGLE, Service, envelope
from tessera.session import Workspace
from tessera.sources import catalyst, modules, scopes, typescript

ROOT = "(root)"
#: The order in which names are listed: as readers sort, small letters before large ones.
LOCALE = "UNICODE"
SYMBOLS, SEARCHED, TRANSFORMS, EVIDENCE = 100, 25, 25, 10
SITES, NOTES, SHOWN = 100, 20, 100
#: The comment at a line's end, or that the line is part of; the strings in a line.
COMMENT = r"//.*$|^\s*\*.*$"
QUOTED = r"""\"[^\"]*\"|'[^']*'|`[^`]*`"""


class NotFound(LookupError):
    """A symbol, file or position that the facts don't have."""


def plain(row: Row) -> dict[str, Any]:
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None}


def listed(df: DataFrame) -> list[dict[str, Any]]:
    return [plain(r) for r in df.collect()]


class Facts:
    """The tables of one revision of a project, each made when it is asked for.

    Tables that others are made of are held (see `rounds.held`), so that plans
    stay small. Names are told apart by the file that declares them.
    """

    def __init__(self, project: Project):
        self.project = project

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def of(self, name: str) -> DataFrame:
        return self.project.workspace.table(name)

    def files(self) -> DataFrame:
        files = typescript.read(self.project.spark, self.project.root)
        for path, text in self.project.overlay.items():
            # the one file is taken out and put in again; whatever is made of the others stays
            files = files.where(~F.col("file").endswith(path)).unionByName(self.project.spark.createDataFrame([(self.project.overlay_path(path), text)], files.schema))
        return files

    def lines(self) -> DataFrame:
        return positions.lines(self.of("files"))

    def parsed(self) -> DataFrame:
        base = self.project.base
        if base is None:
            return held(scopes.parsed(self.of("files")))
        ends_ = F.lit(False)
        for path in self.project.overlay:
            ends_ = ends_ | F.col("file").endswith(path)
        return held(base.workspace.table("parsed").where(~ends_).unionByName(scopes.parsed(self.of("files").where(ends_))))

    def declared(self) -> DataFrame:
        return held(typescript.declarations(self.of("parsed")))

    def symbols(self) -> DataFrame:
        # the ordinal of a declaration: by file and line
        return self.of("declared").withColumn("ord", F.struct("file", "line")).withColumn("package", F.lit(ROOT))

    def names(self) -> DataFrame:
        return held(modules.names(self.of("files"), self.of("declared")))

    def ambient(self) -> DataFrame:
        return held(modules.ambient(self.of("declared")))

    def references(self) -> DataFrame:
        return held(modules.references(self.of("files"), self.of("names"), self.of("ambient"), self.of("exported")))

    def exported(self) -> DataFrame:
        return held(modules.exported_names(self.of("files"), self.of("declared")))

    def by_identity(self, rows: DataFrame, column: str) -> DataFrame:
        return modules.by_identity(rows, column, self.of("names"), self.of("ambient"))

    def members(self) -> DataFrame:
        rows = self.by_identity(typescript.members(self.of("parsed")), "type")
        return held(rows.withColumn("type_id", modules.qualified(F.col("file"), F.col("type_name"))))

    def bases(self) -> DataFrame:
        rows = typescript.bases(self.of("parsed")).withColumn("base_id", F.col("base"))
        return held(self.by_identity(rows, "base_id").withColumn("type_id", modules.qualified(F.col("file"), F.col("type_name"))))

    def types(self) -> DataFrame:
        """type_id of all object types."""
        rows = self.of("parsed").where("scope = -1 and body is not null and kind in ('interface', 'class', 'type')")
        return rows.select(modules.qualified(F.col("file"), F.col("name")).alias("type_id")).distinct()

    def shapes(self) -> DataFrame:
        """The members of all types with those they inherit."""
        rows = self.of("members").select("type_id", F.col("name").alias("member"), "ord", "type", "optional", "readonly")
        found = members.inherited(rows, self.of("bases").select("type_id", "base_id"))
        return held(found.select("type_id", F.col("member").alias("name"), "type", "optional"))

    def texts(self) -> DataFrame:
        """file, text, by_identity of the types that parameters and returns are stated with."""
        both = [t.select("file", F.explode(F.concat("params", F.array("returns"))).alias("text")) for t in (self.of("callables"), self.of("signatures"))]
        rows = both[0].union(both[1]).where("text is not null and text <> ''").distinct()
        return held(self.by_identity(rows.withColumn("by_identity", F.col("text")), "by_identity"))

    def aliases(self) -> DataFrame:
        rows = self.by_identity(typescript.aliases(self.of("parsed")), "type")
        return held(rows.withColumn("type_id", modules.qualified(F.col("file"), F.col("name"))))

    def unsupported(self) -> DataFrame:
        return typescript.unsupported(self.of("files"))

    def callables(self) -> DataFrame:
        return held(typescript.callables(self.of("parsed")))

    def signatures(self) -> DataFrame:
        return held(typescript.signatures(self.of("parsed")).withColumn("stated", F.lit(True)))

    def edges(self) -> DataFrame:
        return held(typescript.edges(self.of("parsed"), self.of("callables")))

    def diagnostics(self) -> DataFrame:
        return typescript.diagnostics(self.of("parsed"))


class Project:
    """The handlers of all commands for the files under `root`."""

    def __init__(self, spark: SparkSession, root: str, base: Project | None = None, overlay: dict[str, str] | None = None):
        self.spark, self.root, self.folder = spark, root, None
        self.base, self.overlay = base, overlay or {}
        self.workspace = Workspace(spark, self.facts)

    def facts(self) -> Facts:
        return Facts(self)

    def with_file(self, path: str, text: str) -> Project:
        """This project as it is now, with one file more or with another text for a file that
        it has. Neither sees the other's changes; only that file's facts are made again."""
        self.workspace.table("parsed")
        return Project(self.spark, self.root, self, {path: text})

    def overlay_path(self, path: str) -> str:
        found = typescript.read(self.spark, self.root).where(F.col("file").endswith(path)).select("file").orderBy("file").limit(1).collect()
        return found[0]["file"] if found else f"{self.root.rstrip('/')}/{path}"

    def table(self, name: str) -> DataFrame:
        """A table of facts, of the package that the payload names if it names one."""
        found = self.workspace.table(name)
        return found.where(F.col("file").startswith(self.folder)) if self.folder and "file" in found.columns else found

    def handlers(self) -> dict[str, Any]:
        def scoped(name: str):
            def run(p: dict) -> Any:
                self.folder = self.folder_of(p["package"]) if "package" in p else None
                return getattr(self, name)(p)

            return run

        return {c: scoped(c.replace("-", "_")) for c in COMMANDS}

    def folder_of(self, package: str) -> str | None:
        """The folder of a package that is named by its name or the end of it; none for the root."""
        if package in (ROOT, self.root):
            return None
        found = typescript.packages(self.spark, self.root).where(F.col("name").endswith(package)).orderBy(F.col("name") != package, "name", "folder").limit(1).collect()
        if not found:
            raise NotFound(f"no package {package}")
        return found[0]["folder"]

    # Catalog

    def packages(self, p: dict) -> Any:
        found = typescript.packages(self.spark, self.root).where(F.col("name") != ROOT)
        return [{"name": ROOT, "path": self.root}, *listed(found.select("name", F.col("folder").alias("path")).orderBy(F.collate("name", LOCALE), "path"))]

    def package_of(self, file: str) -> str | None:
        """The folder of the deepest package that holds a file."""
        files = self.workspace.table("files").where(F.col("file").endswith(file)).select("file").orderBy("file").limit(1)
        found = catalog.nearest_folder(files, typescript.packages(self.spark, self.root)).collect()
        if not found:
            raise NotFound(f"no file {file}")
        return found[0]["folder"]

    def symbols(self, p: dict) -> Any:
        limit = p.get("limit", SYMBOLS)
        found = catalog.list_symbols(self.exported_symbols(), p.get("pattern"), p.get("kind", "all"), p.get("file"), limit, None, LOCALE)
        rows = listed(found.select("name", "kind", "file", "line", "total", "truncated"))
        total = rows[0]["total"] if rows else 0
        return {"symbols": [{k: r[k] for k in ("name", "kind", "file", "line")} for r in rows], "total": total, "truncated": total > limit}

    def exported_symbols(self) -> DataFrame:
        """Symbols that some file exports, each once: under the name and in the place of its declaration, whatever re-exports call it."""
        far = self.workspace.table("exported").select(F.col("home").alias("file"), F.col("symbol").alias("name")).distinct()
        return self.table("symbols").join(far, ["file", "name"], "left_semi").withColumn("exported", F.lit(True))

    def symbol(self, name: str) -> dict[str, Any]:
        """The first symbol of that name: one that is declared, else one that a file exports
        under it; a dotted name is looked up by its first part, and `name@file` names its file."""
        first, _, file = name.partition("@")
        first = first.split(".")[0]
        rows = self.table("symbols")
        if file:
            rows = rows.where(F.col("file").endswith(file))
        found = rows.where(F.col("name") == first).orderBy(F.desc("exported"), "ord").limit(1).collect()
        if not found:
            far = self.workspace.table("exported").where(F.col("name") == first).select(F.col("home").alias("file"), F.col("symbol").alias("name")).distinct()
            found = rows.join(far, ["file", "name"], "left_semi").orderBy("ord").limit(1).collect()
        if not found:
            raise NotFound(f"no symbol {name}")
        return plain(found[0])

    def id_of(self, s: dict[str, Any]) -> str:
        return self.spark.range(1).select(modules.qualified(F.lit(s["file"]), F.lit(s["name"])).alias("id")).first()["id"]

    def members_of(self, file: str, name: str) -> list[dict[str, Any]]:
        """Members of a type with those it inherits, its own first."""
        one = self.spark.createDataFrame([(self.id_of({"file": file, "name": name}),)], "type_id string")
        every = self.workspace.table("members").select("type_id", F.col("name").alias("member"), "ord", "type", "optional", "readonly")
        found = members.inherited(every, self.workspace.table("bases").select("type_id", "base_id"), one)
        return listed(members.shown_members(found).orderBy("depth", "ord", "member").select(F.col("member").alias("name"), modules.shown(F.col("type")).alias("type"), "optional", "readonly"))

    def info(self, p: dict) -> Any:
        s = self.symbol(p["symbol"])
        own = self.members_of(s["file"], s["name"])
        if "." in p["symbol"].partition("@")[0]:
            own = [m for m in own if m["name"] == p["symbol"].partition("@")[0].split(".", 1)[1]]
            if not own:
                raise NotFound(f"no member {p['symbol']}")
        of_it = (F.col("file") == s["file"]) & (F.col("name") == s["name"]) & F.col("kind").isin("Function", "VariableCallable")
        signatures = self.table("signatures").where(of_it)
        signatures = (self.table("callables").where(of_it) if signatures.isEmpty() else signatures).orderBy("ord")
        text = F.concat(F.lit("("), F.array_join("params", ", "), F.lit(") => "), F.coalesce("returns", F.lit("unknown"))).alias("text")
        status = self.table("unsupported").where((F.col("file") == s["file"]) & (F.col("type_name") == s["name"])).limit(1).count()
        return {
            "name": s["name"], "kind": s["kind"], "file": s["file"], "line": s["line"], "exported": s["exported"], "properties": own,
            "signatures": [r["text"] for r in signatures.select(text).collect()], "status": "unsupported" if status else "ok",
        }

    def expand(self, p: dict) -> Any:
        found = self.info(p)
        body = "; ".join(f"{'readonly ' if m['readonly'] else ''}{m['name']}{'?' if m['optional'] else ''}: {m['type']}" for m in found["properties"])
        text = " & ".join(found["signatures"]) or (f"{{ {body} }}" if body else "{}")
        return {"original": text, "expanded": text, "status": found["status"]}

    def search(self, p: dict) -> Any:
        types = self.table("symbols").where(F.col("kind").isin("interface", "type", "class"))
        ids = types.select(modules.qualified(F.col("file"), F.col("name")).alias("type_id"), F.col("ord").alias("at"))
        own = self.workspace.table("shapes").join(ids, "type_id").select(F.col("at").alias("ord"), F.col("name").alias("member"))
        bases = self.table("bases").join(types.select("file", F.col("name").alias("type_name"), "ord"), ["file", "type_name"]).select("ord", "base")
        found = catalog.search(types, own, p.get("hasProperty"), bases, p.get("extends"), p.get("pattern"), p["query"], p.get("limit", SEARCHED))
        return listed(found.select("name", "kind", "file", "line"))

    def file(self, p: dict) -> Any:
        rows = self.table("symbols").where(F.col("file").endswith(p["file"]))
        if not rows.limit(1).count():
            raise NotFound(f"no file {p['file']}")
        if "symbol" in p:
            rows = rows.where(matches(F.col("name"), p["symbol"]))
        if not p.get("includePrivate", False):
            rows = rows.where("exported")
        once = catalog.last_rows(rows.select("file", "line", "name", "kind", "exported", "is_default"), ["file", "line"], "name")
        return listed(once.orderBy(F.desc("exported"), "name", "file", "line"))

    def at_position(self, p: dict) -> Any:
        line = self.table("lines").where(F.col("file").endswith(p["file"]) & (F.col("line") == p["line"])).orderBy("file").limit(1).collect()
        # columns are UTF-16 units: the word is found by the units before it
        units = line[0]["text"].encode("utf-16-le") if line else b""
        if not line or p["column"] - 1 > len(units) // 2:
            raise NotFound("no such position")
        at = len(units[: 2 * (p["column"] - 1)].decode("utf-16-le", "ignore"))
        nodes = line_nodes(self.spark, line[0]["file"], line[0]["text"])
        one = self.spark.createDataFrame([(line[0]["file"], at)], "file string, offset int")
        words = nodes.where("kind = 'word'")
        word = positions.node_at(one, words).join(words, ["file", "node_id"])
        # the name of a reference stands for the whole reference
        whole = positions.ancestor_of_kind(nodes, word, ["reference"]).join(nodes.select("file", F.col("node_id").alias("ancestor"), F.col("pos").alias("begin"), F.col("word").alias("whole")), ["file", "ancestor"], "left")
        found = word.join(whole.drop("ancestor"), ["file", "node_id"], "left").select(truncated(F.when(F.col("begin") == F.col("pos"), F.col("whole")).otherwise(F.col("word")), SHOWN).alias("text"), "word").collect()
        text = found[0]["text"] if found else line[0]["text"][:SHOWN]
        try:
            kind = self.symbol(found[0]["word"] if found else text)["kind"]
        except NotFound:
            kind = "text"
        return {"file": line[0]["file"], "line": p["line"], "column": p["column"], "text": text, "kind": kind}

    # Types

    def eval(self, p: dict) -> Any:
        return {k: v for k, v in catalyst.eval_type(p["expression"]).items() if v is not None}

    def explain(self, p: dict) -> Any:
        found = self.eval(p)
        return {"steps": [{"step": 1, "expression": p["expression"], "result": found.get("result") or f"Error: {found['error']}"}]}

    def check_snippet(self, p: dict) -> Any:
        found = catalyst.check_snippet(self.spark, p["code"])
        return {"valid": not found, "diagnostics": [dict(zip(("line", "column", "code", "message"), d, strict=True)) for d in found]}

    def compatible(self, p: dict) -> Any:
        try:
            a, b = self.symbol(p["from"]), self.symbol(p["to"])
        except NotFound as e:
            return {"compatible": False, "issues": [{"kind": "other", "message": str(e)}], "reason": str(e)}
        for s in (a, b):
            if self.table("unsupported").where((F.col("file") == s["file"]) & (F.col("type_name") == s["name"])).limit(1).count():
                return {"compatible": False, "status": "unsupported", "issues": [], "reason": f"{s['name']} is beyond the supported subset"}
        left, right = self.type_text(a), self.type_text(b)
        ids = [self.id_of(s) for s in (a, b)]
        shapes = self.workspace.table("shapes")
        own, need = (shapes.where(F.col("type_id") == i) for i in ids)
        both = own.select("name", F.col("type").alias("a")).join(need.select("name", F.col("type").alias("b")), "name")
        asked = self.spark.createDataFrame([(left, right)], "a string, b string").unionByName(both.select("a", "b"))
        relation = held(self.assignable(asked))
        if assignable.related(asked.limit(1), relation).first()["ok"]:
            return {"compatible": True, "issues": [], "reason": ""}
        lack = need.where("not optional").join(own, "name", "left_anti").orderBy("name").select("name", modules.shown(F.col("type")).alias("type")).collect()
        differ = assignable.related(both, relation).where("not ok").orderBy("name").select("name", *(modules.shown(F.col(c)).alias(c) for c in "ab")).collect()
        issues = [{"kind": "missing_property", "property": r["name"], "expectedType": r["type"], "message": f"Property '{r['name']}' is missing in type '{a['name']}' but required in type '{b['name']}' (expected: {r['type']})"} for r in lack]
        issues += [{"kind": "type_mismatch", "property": r["name"], "actualType": r["a"], "expectedType": r["b"], "message": f"Property '{r['name']}' has incompatible types: '{r['a']}' is not assignable to '{r['b']}'"} for r in differ]
        issues = issues or [{"kind": "other", "message": f"Type '{a['name']}' is not assignable to type '{b['name']}'"}]
        return {"compatible": False, "issues": issues, "reason": "; ".join(i["message"] for i in issues)}

    def type_text(self, s: dict[str, Any]) -> str:
        """What a symbol's type is called where types are compared: functions by their first signature, the rest by name."""
        if s["kind"] in ("function", "const", "let", "var"):
            one = self.workspace.table("callables").where((F.col("file") == s["file"]) & (F.col("name") == s["name"]) & F.col("container").isNull()).where("returns is not null").orderBy("ord").limit(1)
            text = one.select("file", F.concat(F.lit("("), F.array_join(F.transform("params", lambda p, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), p)), ","), F.lit(")=>"), "returns").alias("text"))
            found = self.facts().by_identity(text, "text").collect()
            if found:
                return found[0]["text"]
        return self.id_of(s)

    def assignable(self, asked: DataFrame) -> DataFrame:
        return assignable.assignable(asked, self.workspace.table("shapes"), self.workspace.table("types"), self.workspace.table("aliases").select("type_id", "type"))

    # Diagnostics

    def diagnostics(self, p: dict) -> Any:
        rows = messages.distinct([self.table("diagnostics")], ["file", "line", "code", "message"]).select("file", "line", "code", "message")
        order = ["file", "line", "code", "message"]
        if not p.get("explain", False):
            return listed(rows.orderBy(*order))
        first = listed(messages.first_with_total(self.explained(rows), order))
        total = first[0]["total"] if first else 0
        return {"diagnostics": [{k: v for k, v in d.items() if k not in ("total", "truncated")} for d in first], "total": total, "truncated": total > 10}

    def explained(self, rows: DataFrame) -> DataFrame:
        return messages.message_evidence(messages.message_parts(rows)).withColumn("explanation", messages.explanation(F.col("code")))

    def why_error(self, p: dict) -> Any:
        rows = self.table("diagnostics").select("file", "line", "code", "message")
        if "message" in p:
            rows = self.spark.createDataFrame([(p.get("file"), p.get("line"), p.get("code"), p["message"])], "file string, line long, code long, message string")
        else:
            for k in ("file", "line", "code"):
                if k in p:
                    rows = rows.where(F.col(k).endswith(p[k]) if k == "file" else F.col(k) == p[k])
        one = self.explained(rows.orderBy("file", "line", "code").limit(1)).collect()
        if not one:
            raise NotFound("no such diagnostic")
        return plain(one[0])

    # References

    def related(self, p: dict) -> Any:
        s = self.symbol(p["symbol"])
        sites = self.sites_of(s).where("not imported")
        sites = sites.where(~((F.col("file") == s["file"]) & (F.col("line") == s["line"]))).select("file", "line").distinct()
        incoming = positions.capped(self.table("lines").join(sites, ["file", "line"], "left_semi"), "file", ["line"], SITES)
        # the symbol that holds a site is the last declared before it
        holds = self.workspace.table("declared").select("file", F.col("name").alias("containing"), F.col("line").alias("at"))
        around = incoming.select("file", "line").join(holds, "file").where("at <= line").groupBy("file", "line").agg(F.max_by("containing", "at").alias("containing"))
        outgoing = self.table("edges").where(F.col("src") == s["name"])
        shown = incoming.join(around, ["file", "line"], "left").orderBy("file", "line").select("file", "line", F.trim("text").alias("text"), "containing")
        return {"symbol": s["name"], "incoming": listed(shown), "outgoing": listed(outgoing.orderBy("dst", "context").select("dst", "context"))}

    def sites_of(self, s: dict[str, Any]) -> DataFrame:
        """file, line, pos, name, imported of all identifiers that stand for a symbol."""
        rows = self.table("references").where((F.col("home") == s["file"]) & (F.col("symbol") == s["name"]))
        imports = self.workspace.table("lines").where(F.col("text").rlike(r"^\s*import\b")).select("file", "line", F.lit(True).alias("imported"))
        return rows.select("file", "line", "pos", "name").join(imports, ["file", "line"], "left").withColumn("imported", F.col("imported").isNotNull())

    def graph(self, p: dict) -> Any:
        name = self.symbol(p["symbol"])["name"]
        root = self.spark.createDataFrame([(name,)], "root string")
        around = graph.neighbourhood(self.table("edges").select("src", "dst").distinct(), root, p.get("depth", 2))
        text = graph.rendered(around, p.get("format", "mermaid")).collect()
        rows = around.select("src", "dst", "depth").orderBy("depth", "src", "dst").collect()
        nodes = list(dict.fromkeys([name, *(n for r in rows for n in (r["src"], r["dst"]))]))
        return {"nodes": nodes, "edges": [plain(r) for r in rows], "rendered": text[0]["graph"] if text else ""}

    def refactor_preview(self, p: dict) -> Any:
        s = self.symbol(p["symbol"])
        name, rows = s["name"], self.table("lines")
        # an alias that another name is imported or exported under stays
        hits = self.sites_of(s).where(F.col("name") == name).select("file", "line").distinct()
        hits = positions.rename_preview(rows.join(hits, ["file", "line"], "left_semi"), name, p["to"])
        sites = hits.select("file", "line", F.col("file").endswith(".d.ts").alias("is_declaration_file"))
        quoted = F.array_join(F.regexp_extract_all("text", F.lit(QUOTED), F.lit(0)), " ")
        prose = rows.select("file", "line", F.concat_ws(" ", F.regexp_extract("text", COMMENT, 0), quoted).alias("text"))
        notes = positions.text_hits(prose, sites, name, None)
        total = positions.rename_summary(sites, notes).first()
        return plain(total) | {"changes": listed(hits.orderBy("file", "line").limit(SITES)), "notes": listed(notes.orderBy("file", "line").limit(NOTES))}

    # Transforms and contracts

    def wanted(self, text: str) -> str:
        """The type that a text asks for, by identity: a type that is stated somewhere, else an alias, else a class or interface of that name."""
        rows = self.workspace.table("texts")
        named = self.workspace.table("symbols")
        kinds = {"alias": named.where("kind = 'type'"), "class": named.where("kind in ('class', 'interface')")}
        ids = {k: v.select("name", "ord", modules.qualified(F.col("file"), F.col("name")).alias("type")) for k, v in kinds.items()}
        asked = self.spark.createDataFrame([(text,)], "asked string")
        found = transform.resolve_types(asked, rows.select(F.col("text").alias("name"), F.struct("file", F.lit(0).cast("long").alias("line")).alias("ord"), F.col("by_identity").alias("type")), ids["alias"], ids["class"]).first()
        if found["type"] is None:
            raise NotFound(f"no type {text}")
        return found["type"]

    def matches_of(self, p: dict) -> DataFrame:
        """One row for each signature of a callable that takes and gives what is asked for."""
        seeds, every = self.table("callables"), self.table("signatures")
        # several declarations make a callable's signatures count, each on its own
        counted = transform.grouped(seeds).drop("n_seeds").join(every.groupBy("callable").agg((F.count("*") + 1).alias("n_seeds")), "callable", "left")
        groups = counted.select("callable", F.coalesce("n_seeds", F.lit(1)).alias("n_seeds"), *(c for c in counted.columns if c not in ("callable", "n_seeds")))
        rows, yes = transform.expanded(groups, every.select(*seeds.columns)).where("returns is not null"), F.lit(True)
        if p.get("exportedOnly", True):
            rows = rows.where("exported")
        erased = p.get("allowTypeErasure", False)
        asked = {k: self.wanted(p[k]) for k in ("from", "to") if k in p}
        unwrap = p.get("unwrapReturn", True)
        texts = self.workspace.table("texts").select("text", "by_identity", "file")
        of = F.map_from_entries(F.collect_list(F.struct("text", "by_identity")))
        rows = rows.join(texts.groupBy("file").agg(of.alias("__of")), "file", "left")
        said = lambda t: F.coalesce(F.element_at("__of", t), t)
        rows = rows.withColumn("__params", F.transform("params", lambda t: F.struct(t.alias("text"), said(t).alias("type")))).withColumn("__gives", said(F.col("returns"))).drop("__of")
        pairs = self.spark.createDataFrame([], "a string, b string")
        if "from" in asked:
            pairs = pairs.union(rows.select(F.lit(asked["from"]).alias("a"), F.explode("__params.type").alias("b")))
        if "to" in asked:
            bare = F.array(F.col("__gives"), unwrapped(F.col("__gives"))) if unwrap else F.array("__gives")
            pairs = pairs.union(rows.select(F.explode(bare).alias("a"), F.lit(asked["to"]).alias("b")))
        pairs = held(pairs.distinct())
        fits = held(assignable.related(pairs, self.assignable(pairs)).where("ok").select("a", "b"))
        rows = rows.withColumn("__row", F.monotonically_increasing_id())
        rows = held(rows)
        place, near, how = F.lit(0), yes, F.lit("exact")
        if "from" in asked:
            at = p.get("paramPosition", 0)
            given = rows.select("__row", F.posexplode("__params").alias("place", "param")).where(yes if at == "any" else F.col("place") == at)
            given = given.where(yes if erased else ~F.col("param.text").isin(transform.ERASED))
            took = given.join(fits.where(F.col("a") == asked["from"]).select(F.col("b").alias("__b")), F.col("param.type") == F.col("__b")).groupBy("__row").agg(F.min(F.struct("place", spaceless(F.col("param.text")).eqNullSafe(spaceless(F.lit(p["from"]))).alias("near"))).alias("m"))
            rows = rows.join(took, "__row")
            place, near = F.col("m.place"), F.col("m.near")
        if "to" in asked:
            gives = fits.where(F.col("b") == asked["to"]).select(F.col("a").alias("__a"), yes.alias("__fits"))
            rows = rows.join(gives, F.col("__gives") == F.col("__a"), "left").drop("__a")
            rows = rows.join(gives.select(F.col("__a").alias("__w"), F.col("__fits").alias("__inner")), unwrapped(F.col("__gives")) == F.col("__w"), "left").drop("__w")
            same = lambda t: spaceless(t) == spaceless(F.lit(p["to"]))
            open_ = F.col("returns").isin(transform.ERASED)
            how = F.when(~open_ & F.col("__fits"), F.when(same(F.col("returns")), "exact").otherwise("assignable"))
            if unwrap:
                how = F.coalesce(how, F.when(~open_ & F.col("__inner"), F.lit("unwrapped")))
            if erased:
                how = F.coalesce(how, F.when(open_, "erased"))
        rows = rows.withColumn("place", place).withColumn("near", near).withColumn("how", how).where("place is not null and how is not null")
        points = transform.score(F.col("near"), ~F.col("how").isin("erased", "assignable"), F.col("exported"), F.col("deprecated"), F.col("is_function"), F.col("how") == "unwrapped")
        full = F.lit("from" in p and "to" in p)
        status = F.when(full & (F.col("how") != "erased"), "assignable").otherwise("unverified")
        return rows.withColumn("score", points).withColumn("status", status).withColumn("confidence", transform.confidence(status, (F.col("how") == "exact") & F.col("near"), full))

    def transform_search(self, p: dict) -> Any:
        rows, limit = self.matches_of(p), p.get("limit", TRANSFORMS)
        least = "verified" if p.get("verifiedOnly", False) else p.get("minVerificationStatus", "unverified")
        found = transform.trusted_top(transform.best_of_each(rows.where(F.col("status").isin(list(transform.TRUST[transform.TRUST.index(least) :])))), lambda df: df, limit, least)
        found = found.select("name", "kind", "container", "file", "params", "returns", "how", "score", "status", "confidence")
        return {"matches": listed(found), "stats": plain(transform.status_counts(transform.best_of_each(rows)).first())}

    def verify_contract(self, p: dict) -> Any:
        sides = {k: p[k] for k in ("from", "to") if k in p}
        both = len(sides) == 2
        fits = self.compatible(sides)["compatible"] if both else None
        snippet = self.check_snippet({"code": p["snippet"]})["valid"] if "snippet" in p else None
        clean = not self.diagnostics({}) if p.get("includeDiagnostics", False) else None
        names = [m["name"] for m in self.transform_search(sides | {"limit": p.get("transformLimit", EVIDENCE)})["matches"]] if both and p.get("includeTransformEvidence", True) else []
        found = (any(n == p.get("symbol", n) for n in names) if names or "symbol" in p else None) if both else None
        checks = [self.spark.createDataFrame([(x,)], "ok boolean") for x in (fits, snippet, clean, found)]
        gaps = ["from and to are needed together"] if len(sides) == 1 else []
        return plain(contract.evaluated(*checks).first()) | {"transforms": names, "gaps": gaps}

    def doctor(self, p: dict) -> Any:
        return {"spark": self.spark.version, "root": self.root, "revision": self.workspace.revision, "files": self.table("files").count(), "wrappers": list(WRAPPERS)}


def line_nodes(spark: SparkSession, file: str, text: str) -> DataFrame:
    """The words of a line and the references with arguments that begin at one of them: file, node_id, pos, end, path, kind, word."""
    line = spark.createDataFrame([(file, text)], "file string, text string")
    rows = scopes.tokens(line)
    order = positions.Window.partitionBy("file").orderBy("ord")
    opens = (F.col("token") == "<") & (F.lag("end").over(order) == F.col("pos"))
    rows = rows.withColumn("step", F.when(opens, 1).when(F.col("token") == ">", -1).otherwise(0))
    rows = rows.withColumn("depth", F.sum("step").over(order) - F.when(F.col("step") == 1, 1).otherwise(0))
    pairs = rows.where("step <> 0").withColumn("closed", F.lead(F.struct("step", "end")).over(positions.Window.partitionBy("file", "depth").orderBy("ord")))
    opened = pairs.where("step = 1 and closed.step = -1").select("file", (F.col("ord") - 1).alias("ord"), F.col("closed.end").alias("over"))
    words = rows.where(F.col("token").rlike(r"^[\w$#'\"`]"))
    node = lambda df, kind, end, id_: df.select("file", id_.alias("node_id"), "pos", end.alias("end"), F.array(id_).alias("path"), F.lit(kind).alias("kind"))
    wide = words.join(opened, ["file", "ord"])
    both = node(words, "word", F.col("end"), 2 * F.col("ord") + 1).union(node(wide, "reference", F.col("over"), 2 * F.col("ord")))
    return both.withColumn("word", F.substring(F.lit(text), F.col("pos") + 1, F.col("end") - F.col("pos")))


def service(spark: SparkSession, root: str) -> Service:
    return Service(Project(spark, root).handlers())


def describe() -> dict[str, Any]:
    """All commands with the fields they take, and whether they can come in batches."""
    return {c: {"fields": {f: {"kind": k.rstrip("?"), "optional": k.endswith("?")} for f, k in fields.items()}, "batch": c not in SINGLE} for c, fields in COMMANDS.items()}


def saved(answer: dict, folder: str) -> dict:
    """Writes an answer as a file that only its owner can read; tells where it is and its size."""
    text = json.dumps(answer, indent=2, ensure_ascii=False, sort_keys=True)
    name = f"{answer['command']}-{datetime.datetime.now(datetime.UTC).strftime('%Y-%m-%dT%H-%M-%S-%f')}.json"
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding="utf-8") as f:
        f.write(text + "\n")
    return {"ok": answer["ok"], "command": answer["command"], "artifact": str(path), "size_bytes": len(text.encode())}


def payload_of(given: str | None) -> Any:
    """A payload from the command line: JSON, `@file`, `-` for standard input, or none."""
    if not given:
        return {}
    if given == "-":
        given = sys.stdin.read()
    elif given.startswith("@"):
        given = Path(given[1:]).read_text(encoding="utf-8")
    return json.loads(given)


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="tessera", description="Questions about a tree of source files")
    args.add_argument("command", choices=[*COMMANDS, "capabilities"])
    args.add_argument("payload", nargs="?")
    args.add_argument("--root", default=".")
    args.add_argument("--output", choices=("inline", "artifact", "auto"), default="inline")
    args.add_argument("--artifact-dir", default="artifacts")
    given = args.parse_args(argv)
    if given.command == "capabilities":
        print(json.dumps(describe(), sort_keys=True))
        return 0
    try:
        payload = payload_of(given.payload)
    except (ValueError, OSError) as e:
        print(envelope({"ok": False, "command": given.command, "error": {"code": "INVALID_INPUT", "message": str(e)}}), file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    answer = service(spark, payload.get("root", given.root) if isinstance(payload, dict) else given.root).run(given.command, payload)
    large = len(envelope(answer).encode()) > contract.INLINE_BYTES
    if answer["ok"] and (given.output == "artifact" or (given.output == "auto" and large)):
        answer = saved(answer, given.artifact_dir)
    print(envelope(answer), file=sys.stdout if answer["ok"] else sys.stderr)
    return 0 if answer["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
