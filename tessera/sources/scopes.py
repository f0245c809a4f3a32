"""The structure of TypeScript texts: tokens, brackets, scopes and what is declared in them.

Tokens are rows. The depth of brackets is a running sum over a file's tokens;
a bracket's partner is the next bracket of its depth, and the scope of a token
is the last bracket opened one level up. Separators cut the tokens of a scope
into segments, each a statement, a member, a parameter or a property. Only the
head of one segment is read by a Python helper. All of it is linear in a file,
apart from sorting its tokens, and files don't meet in any task but by chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.pointers import ends

NAME = r"[A-Za-z_$][\w$]*"
#: Comments, texts in quotes, patterns behind what no value can end, names, numbers, and single signs.
TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`]*\})*`"
    r"|(?<=[(,=:\[!&|?{};])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|#?[A-Za-z_$][\w$]*|\d[\w.]*|=>|\.\.\.|\?\.|\S"
)
#: Signs that a line may begin or end with without ending a statement there.
GOES_ON_BEFORE = [":", "|", "&", "=>", "=", "+", "-", "*", "?", ",", ".", "<", "extends", "implements", "keyof", "typeof", "async", "export", "default", "declare", "static", "readonly", "public", "private", "protected", "abstract", "new", "return", "&&", "||"]
GOES_ON_AFTER = ["|", "&", "=>", "?", ":", ".", "?.", "=", "+", "*", "extends", "implements", "{", ")", "]", "}", ">", ",", ";"]
#: Words that go on behind braces; any other begins a statement or member.
GOES_ON_BRACES = ["else", "while", "catch", "finally", "from", "as", "satisfies", "extends", "implements", "is", "in", "of", "instanceof"]
MODIFIERS = frozenset("export default declare abstract async static public private protected readonly override accessor get set".split())
TYPES_BEFORE = frozenset([":", "|", "&", "=>", "<", "=", ",", "?", "extends", "keyof"])


def tokens(files: DataFrame) -> DataFrame:
    """file, ord, pos, end, token, line, first (of its line), deprecated (said by a comment right before it)."""
    schema = "file string, ord int, pos int, end int, token string, line int, first boolean, deprecated boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, line, at, first, old = [], 1, 0, True, False
                for m in TOKEN.finditer(text or ""):
                    n = text.count("\n", at, m.start())
                    line, at, first = line + n, m.start(), first or n > 0
                    if m["comment"]:
                        old = old or bool(re.search(r"@deprecated\b", m[0])) and m[0].startswith("/**")
                        continue
                    word = m[0].lstrip()
                    rows.append((file, len(rows), m.end() - len(word), m.end(), word, line, first, old))
                    first = old = False
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), *[pa.int32()] * 3, pa.string(), pa.int32(), pa.bool_(), pa.bool_()), strict=True)], [x.split()[0] for x in schema.split(", ")])

    return files.select("file", "text").mapInArrow(run, schema)


def opens(token: Column) -> Column:
    return token.isin("(", "[", "{")


def closes(token: Column) -> Column:
    return token.isin(")", "]", "}")


def nested(tokens: DataFrame) -> DataFrame:
    """`tokens` with depth (of what it is in, from 0), scope (ord of the bracket
    it is in, -1 at the top), close (a bracket's partner's ord) and close_end;
    closing brackets go. Files whose brackets don't match are left out (see `unbalanced`)."""
    by_file = Window.partitionBy("file").orderBy("ord")
    step = F.when(opens(F.col("token")), 1).when(closes(F.col("token")), -1).otherwise(0)
    rows = tokens.withColumn("after", F.sum(step).over(by_file).cast("int"))
    rows = rows.withColumn("depth", F.when(opens(F.col("token")), F.col("after") - 1).otherwise(F.col("after")))
    # a bracket and its partner are neighbours among the brackets of their depth
    by_depth = Window.partitionBy("file", "depth", opens(F.col("token")) | closes(F.col("token"))).orderBy("ord")
    rows = rows.withColumn("partner", F.lead(F.struct("ord", "end", "token")).over(by_depth))
    pair = F.concat("token", F.coalesce("partner.token", F.lit("")))
    rows = rows.withColumn("wrong", (opens(F.col("token")) & ~pair.isin("()", "[]", "{}")) | (F.col("after") < 0))
    rows = rows.withColumn("bad", F.max("wrong").over(Window.partitionBy("file"))).where("not bad and not token in (')', ']', '}')")
    # openers of a depth, and what is one level deeper, in one order
    marks = F.array(F.struct(F.col("depth").alias("level"), F.lit(False).alias("opener")), F.struct((F.col("depth") + 1).alias("level"), F.lit(True).alias("opener")))
    both = rows.withColumn("m", F.explode(F.when(opens(F.col("token")), marks).otherwise(F.slice(marks, 1, 1)))).select("*", "m.*")
    last = Window.partitionBy("file", "level").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("scope", F.coalesce(F.last(F.when(F.col("opener"), F.col("ord")), True).over(last), F.lit(-1))).where("not opener")
    opener = opens(F.col("token"))
    return both.select("file", "ord", "pos", F.when(opener, F.col("partner.end")).otherwise(F.col("end")).alias("end"), "token", "line", "first", "deprecated", "scope", F.when(opener, F.col("partner.ord")).alias("close"))


def unbalanced(files: DataFrame) -> DataFrame:
    """file of each text whose brackets can't be matched."""
    all_ = tokens(files)
    return all_.select("file").distinct().join(nested(all_).select("file").distinct(), "file", "left_anti")


def segments(files: DataFrame) -> DataFrame:
    """The heads of all segments (see `head`): file, scope, seg, line, deprecated and what is read of each.

    A segment ends at `;`, at a `,` outside of angle brackets, behind a body,
    and where a line ends unless a sign tells that it goes on.
    """
    rows = nested(tokens(files))
    in_scope = Window.partitionBy("file", "scope").orderBy("ord")
    before, before_close = F.lag("token").over(in_scope), F.lag("close").over(in_scope)
    goes_on = before.isin(GOES_ON_BEFORE) | F.col("token").isin(GOES_ON_AFTER) & ~((F.col("token") == "{") & before.isin(";", ","))
    breaks = before.isin(";") | (F.col("first") & ~goes_on) | ((before == "{") & F.col("first") & ~F.col("token").isin(GOES_ON_AFTER) & before_close.isNotNull())
    breaks = breaks | ((before == "{") & F.col("token").rlike("^[A-Za-z_$#@]") & ~F.col("token").isin(GOES_ON_BRACES))
    rows = rows.withColumn("hard", F.sum(F.when(F.coalesce(breaks, F.lit(False)), 1).otherwise(0)).over(in_scope))
    angle = F.when((F.col("token") == "<") & (F.lag("end").over(in_scope) == F.col("pos")), 1).when(F.col("token") == ">", -1).otherwise(0)
    in_hard = Window.partitionBy("file", "scope", "hard").orderBy("ord")
    rows = rows.withColumn("angle", F.sum(angle).over(in_hard))
    comma = (F.lag("token").over(in_hard) == ",") & (F.lag("angle").over(in_hard) <= 0) & ~F.max(F.col("token").isin("interface", "class")).over(in_hard)
    rows = rows.withColumn("soft", F.sum(F.when(F.coalesce(comma, F.lit(False)), 1).otherwise(0)).over(in_hard))
    grouped = rows.groupBy("file", "scope", "hard", "soft").agg(
        F.min("ord").alias("seg"), F.min_by("line", "ord").alias("line"), F.max("deprecated").alias("deprecated"), F.array_sort(F.collect_list(F.struct("ord", "token", "pos", "end"))).alias("tokens")
    )
    # the declarators behind the first of a statement have neither its keyword nor its modifiers
    lead = F.transform(F.slice(F.first("tokens").over(Window.partitionBy("file", "scope", "hard").orderBy("soft")), 1, 3), lambda x: x["token"])
    goes_on = (F.col("soft") > 0) & F.arrays_overlap(lead, F.array(*map(F.lit, ("const", "let", "var"))))
    grouped = grouped.select("file", "scope", "seg", "line", "deprecated", "tokens", goes_on.alias("goes_on"), F.array_contains(lead, "export").alias("with_export"))
    return grouped.mapInArrow(heads, HEAD)


HEAD = (
    "file string, scope int, seg int, line int, deprecated boolean, kind string, name string, name_ord int, modifiers array<string>, optional boolean, "
    "paren int, type_from int, type_to int, body int, claims array<struct<scope:int,role:string>>, bases_from int, bases_to int, initial boolean, hands_on string"
)
#: Kinds of heads: declarations, and forms of members, properties and parameters.
DECLARED = ("interface", "class", "enum", "type", "function", "const", "let", "var", "namespace")


def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in re.split(r", (?=\w+ )", HEAD)]
    for b in batches:
        out = []
        for row in b.to_pylist():
            found = head([(t["token"], t["pos"], t["end"], t["ord"]) for t in row["tokens"] if t["token"] not in (";", ",") or t is not row["tokens"][-1]], row["goes_on"])
            if found and row["goes_on"] and row["with_export"]:
                found["modifiers"] = ["export"]
            if found:
                out.append({k: row[k] for k in ("file", "scope", "seg", "line", "deprecated")} | found)
        if out:
            kinds = dict.fromkeys(names, pa.int32()) | {"file": pa.string(), "kind": pa.string(), "name": pa.string(), "hands_on": pa.string(), "deprecated": pa.bool_(), "optional": pa.bool_(), "initial": pa.bool_(), "modifiers": pa.list_(pa.string())}
            kinds["claims"] = pa.list_(pa.struct([("scope", pa.int32()), ("role", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], kinds[n]) for n in names], names)


def past_angles(t: list[tuple], i: int) -> int:
    """The place behind type parameters that begin at place i, if any do."""
    if i < len(t) and t[i][0] == "<":
        depth = 0
        while i < len(t):
            depth += {"<": 1, ">": -1}.get(t[i][0], 0)
            i += 1
            if not depth:
                break
    return i


def type_end(t: list[tuple], i: int, stops: tuple[str, ...]) -> int:
    """The place behind a type that begins at place i: a stop, or braces that don't continue it."""
    begin = i
    while i < len(t) and t[i][0] not in stops:
        if t[i][0] == "{" and i > begin and t[i - 1][0] not in TYPES_BEFORE:
            break
        i += 1
    return i


def signature(t: list[tuple], i: int, out: dict, arrow: bool) -> bool:
    """Reads type parameters, parameters and a return from place i; in types and arrows the return is behind `=>`."""
    i = past_angles(t, i)
    if i >= len(t) or t[i][0] != "(":
        return False
    if arrow:
        j = i + 1
        if j < len(t) and t[j][0] == ":":  # an arrow's stated return
            stop = type_end(t, j + 1, ("=>",))
            if stop < len(t) and t[stop][0] == "=>":
                out.update(paren=t[i][3], type_from=t[j + 1][1], type_to=t[stop - 1][2], type=t[j + 1 : stop], after=stop + 1)
                return True
            return False
        if j < len(t) and t[j][0] == "=>":
            out.update(paren=t[i][3], after=j + 1)
            return True
        return False
    out["paren"], i = t[i][3], i + 1
    if i < len(t) and t[i][0] == ":":
        stop = type_end(t, i + 1, ("=", ";"))
        if stop > i + 1:
            out.update(type_from=t[i + 1][1], type_to=t[stop - 1][2], type=t[i + 1 : stop])
        i = stop
    if i < len(t) and t[i][0] == "{":
        out.update(body=t[i][3], has_body=True)
    return True


def value(t: list[tuple], i: int, out: dict) -> bool:
    """Reads a function or an arrow that begins at place i."""
    if i < len(t) and t[i][0] == "async":
        i += 1
    if i < len(t) and t[i][0] == "function":
        i += 1
        while i < len(t) and t[i][0] not in ("(", "<"):
            i += 1
        return signature(t, i, out, False)
    found = signature(t, i, out, True)
    if found and out["after"] < len(t) and t[out["after"]][0] == "{":
        out["body"] = t[out["after"]][3]
    return found


def handed(t: list[tuple]) -> str | None:
    """What an expression hands on, if it is no more than a call (`name()`), a new
    object (`new Name`) or a literal (`: string`)."""
    words = [x[0] for x in t if x[0] != ";"]
    if words[:1] == ["await"]:
        return None
    if len(words) == 1 and (words[0][0] in "\"'`" or words[0] in ("true", "false") or re.fullmatch(r"\d[\d.]*", words[0])):
        return ": string" if words[0][0] in "\"'`" else ": boolean" if words[0] in ("true", "false") else ": number"
    if len(words) == 2 and words[1] == "(" and re.fullmatch(NAME, words[0]):
        return f"{words[0]}()"
    if len(words) == 3 and words[0] == "new" and words[2] == "(" and re.fullmatch(NAME, words[1]):
        return f"new {words[1]}"
    return None


def claims(t: list[tuple], role: str) -> list[dict]:
    return [{"scope": x[3], "role": role} for x in t if x[0] == "{"]


def head(t: list[tuple], goes_on: bool = False) -> dict | None:
    """What a segment declares: its kind and name, where its type, parameters and body are.

    `claims` tells of the braces at its level what they hold: the members of a
    class or type, a value, statements, or (`same`) whatever the segment is in.
    """
    i, modifiers = 0, []
    while i < len(t) and t[i][0] == "@":  # decorators
        i += 3 if i + 2 < len(t) and t[i + 2][0] == "(" else 2
    while i + 1 < len(t) and t[i][0] in MODIFIERS and t[i + 1][0] not in (":", "?", "(", "=", ",", ";", "!"):
        modifiers.append(t[i][0])
        i += 1
    if i >= len(t):
        return None
    word, out = t[i][0], {"modifiers": modifiers, "optional": False, "initial": False, "claims": []}
    follows = t[i + 1][0] if i + 1 < len(t) else ""
    named = re.fullmatch(NAME, follows) is not None
    if word == "const" and follows == "enum":
        i, word, named = i + 1, "enum", i + 2 < len(t)
    if word in ("interface", "class", "enum", "namespace", "module") and named:
        braces = [k for k in range(i + 2, len(t)) if t[k][0] == "{" and t[k - 1][0] not in TYPES_BEFORE]
        stop = braces[0] if braces else len(t)
        out.update(kind="namespace" if word == "module" else word, name=t[i + 1][0], name_ord=t[i + 1][3], body=t[stop][3] if braces else None)
        if braces:
            out["claims"].append({"scope": t[stop][3], "role": {"interface": "type", "class": "class", "enum": "enum"}.get(word, "statements")})
        begin = past_angles(t, i + 2)
        at = next((k for k in range(begin, stop) if t[k][0] == "extends"), None)
        if at is not None:
            until = next((k for k in range(at, stop) if t[k][0] == "implements"), stop)
            out.update(bases_from=t[at + 1][1], bases_to=t[until - 1][2])
        return out
    if word == "type" and named:
        eq = next((k for k in range(past_angles(t, i + 2), len(t)) if t[k][0] == "="), len(t))
        own = t[eq + 1 :]
        out.update(kind="type", name=t[i + 1][0], name_ord=t[i + 1][3], claims=claims(own, "type"), body=own[0][3] if len(own) == 1 and own[0][0] == "{" else None)
        if own:
            out.update(type_from=own[0][1], type_to=own[-1][2])
            extra: dict = {}
            if own[0][0] in ("(", "<") and signature(own, 0, extra, True):
                out["paren"] = extra["paren"]
        return out
    if word == "function":
        i += 2 if follows == "*" else 1
        if i < len(t) and re.fullmatch(NAME, t[i][0]):
            out.update(kind="function", name=t[i][0], name_ord=t[i][3])
            if signature(t, i + 1, out, False):
                out["claims"] = claims(out.pop("type", []), "type") + ([{"scope": out["body"], "role": "statements"}] if out.pop("has_body", False) else [])
                out["initial"] = "body" in out
                return out
        return None
    if word in ("const", "let", "var") and follows or goes_on:
        i += 0 if goes_on else 1
        if t[i][0] in ("{", "["):  # names bound by a pattern
            return {**out, "kind": "pattern", "claims": [{"scope": t[i][3], "role": "pattern"}, *claims(t[i + 1 :], "object")]}
        if not re.fullmatch(NAME, t[i][0]):
            return None
        out.update(kind=word if not goes_on else "const", name=t[i][0], name_ord=t[i][3])
        eq = next((k for k in range(i + 1, len(t)) if t[k][0] == "="), len(t))
        if i + 1 < eq and t[i + 1][0] == ":":
            out["claims"] += claims(t[i + 2 : eq], "type")
        if eq + 1 < len(t):
            out["initial"] = True
            extra = {}
            if value(t, eq + 1, extra):
                out["claims"] += claims(extra.pop("type", []), "type") + ([{"scope": extra["body"], "role": "statements"}] if "body" in extra else [])
                out.update({k: v for k, v in extra.items() if k in ("paren", "type_from", "type_to", "body")})
                if "body" not in extra and "after" in extra:
                    out["hands_on"] = handed(t[extra["after"] :])
            else:
                out["claims"] += claims(t[eq + 1 :], "object")
        return out
    out["name_ord"] = t[i][3]
    if word == "new" and follows in ("(", "<") or word in ("(", "<"):  # call and construct signatures
        out.update(kind="construct" if word == "new" else "call", name=word if word == "new" else "")
        if not signature(t, i + (word == "new"), out, False):
            return None
        out["claims"] = claims(out.pop("type", []), "type")
        return out
    while word in ("...", "*") and i + 1 < len(t):
        i += 1
        word = t[i][0]
    if not re.fullmatch(rf"#?{NAME}|\d[\w.]*|[\"'].*[\"']|\[|\{{", word):
        return None
    if word == "return":
        return {**out, "kind": "return", "name": handed(t[i + 1 :]), "claims": claims(t[i:], "object")}
    if word == "{" and len(t) > i + 1 and t[i + 1][0] not in (":", "="):
        return {**out, "kind": "other", "claims": claims(t[i:], "object")}
    out.update(kind="member", name=word.strip("\"'"), name_ord=t[i][3])
    i += 1
    if i < len(t) and t[i][0] in ("?", "!"):
        out["optional"] = t[i][0] == "?"
        i += 1
    if i < len(t) and t[i][0] in ("(", "<"):
        out["kind"] = "method"
        if not signature(t, i, out, False):
            return None
        out["claims"] = claims(out.pop("type", []), "type") + ([{"scope": out["body"], "role": "statements"}] if out.get("has_body") else [])
        out["initial"] = out.pop("has_body", False)
        return out
    eq = next((k for k in range(i, len(t)) if t[k][0] == "="), len(t))
    if i < eq and t[i][0] == ":" and i + 1 < eq:
        out.update(type_from=t[i + 1][1], type_to=t[eq - 1][2], claims=claims(t[i + 1 : eq], "same"))
        extra = {}
        at = i + 2 if t[i + 1][0] == "new" else i + 1
        if value(t[:eq], at, extra):  # a function type, or a function as a property's value
            out["paren"], out["kind"] = extra["paren"], "callable"
            first = extra["after"] if "after" in extra and "type_from" not in extra else None
            if "type_from" in extra:
                out.update(type_from=extra["type_from"], type_to=extra["type_to"], initial=True)
            elif first is not None and first < eq and t[at][0] != "async":
                out.update(type_from=t[first][1], type_to=t[eq - 1][2])
            else:
                out.update(type_from=None, type_to=None)
            if "body" in extra:
                out["claims"] = [{**c, "role": "body" if c["scope"] == extra["body"] else c["role"]} for c in out["claims"]]
                out["initial"] = out["initial"] or t[at][0] in ("function", "async")
    if eq < len(t):
        out["claims"] += claims(t[eq + 1 :], "object")
        out["initial"] = True
    return out


def roles(segments: DataFrame) -> DataFrame:
    """file, scope, role, owner, owner_kind, owner_seg, in_scope: what each pair of
    braces holds, and the segment that it belongs to."""
    owner = [F.col(c).alias(f"owner_{c}") for c in ("kind", "seg")]
    claimed = segments.select("file", F.col("scope").alias("in_scope"), F.col("name").alias("owner"), *owner, F.explode("claims").alias("c")).select("file", "c.scope", "c.role", "owner", "owner_kind", "owner_seg", "in_scope")
    # braces that hold what their surroundings hold: up to the first that don't
    inherits = F.col("role").isin("same", "body")
    up = claimed.where(inherits).select(key("scope").alias("node"), key("in_scope").alias("next"))
    known = claimed.where(~inherits).select(key("scope").alias("end"), F.col("role").alias("found"))
    rows = claimed.withColumn("id", key("scope")).join(ends(up).withColumnRenamed("node", "id"), "id", "left").join(known, "end", "left")
    value = F.col("found") == "object"
    role = F.when(~inherits, F.col("role")).when(F.col("role") == "body", F.when(value, "statements").otherwise("type")).otherwise(F.when(value, "object").otherwise("type"))
    return rows.select("file", "scope", role.alias("role"), "owner", "owner_kind", "owner_seg", "in_scope")


def key(scope: str) -> Column:
    return F.concat_ws(":", "file", F.col(scope).cast("string"))


def parsed(files: DataFrame) -> DataFrame:
    """All segments with the texts of their types and bases, the role and owner of
    what they are in, and whether the statement at the top that holds them is exported.

    file, scope, seg, line, deprecated, kind, name, name_ord, modifiers,
    optional, paren, body, initial, hands_on, type, bases, role, owner,
    owner_kind, owner_seg, exported.
    """
    heads = segments(files).persist()
    about = roles(heads).drop("in_scope")
    slice_ = lambda a, b: F.when(F.col(a).isNotNull(), F.trim(F.regexp_replace(F.expr(f"substring(text, {a} + 1, {b} - {a})"), r"\s+", " ")))
    rows = heads.join(about, ["file", "scope"], "left").join(files.select("file", "text"), "file")
    top = Window.partitionBy("file").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    exported = F.last(F.when(F.col("scope") == -1, F.array_contains("modifiers", "export")), True).over(top)
    rows = rows.withColumn("role", F.when(F.col("scope") == -1, "statements").otherwise(F.col("role")))
    return rows.select(
        "file", "scope", "seg", "line", "deprecated", "kind", "name", "name_ord", "modifiers", "optional", "paren", "body", "initial", "hands_on",
        slice_("type_from", "type_to").alias("type"), slice_("bases_from", "bases_to").alias("bases"), "role", "owner", "owner_kind", "owner_seg", exported.alias("exported"),
    )
