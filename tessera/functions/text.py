"""Text and position functions, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type constructors whose argument is what a caller gets in the end.
WRAPPERS = ("Promise", "PromiseLike", "Effect", "Observable", "Task")


def matches(text: Column, pattern: str) -> Column:
    """Whether `pattern` occurs in the text, whatever the case."""
    re.compile(pattern)  # a pattern that can't be compiled fails here, and not in a job
    return text.rlike(f"(?iu){pattern}")


def whole_word(name: str) -> str:
    return rf"\b{re.escape(name)}\b"


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def group_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_of(text: Column, *patterns: str) -> Column:
    """The first group of the first pattern that occurs."""
    return F.coalesce(*[group_or_null(text, p) for p in patterns])


def unwrapped(type_text: Column) -> Column:
    """The argument of a wrapper around the whole type, or the type itself."""
    return F.coalesce(group_or_null(type_text, rf"^(?:{'|'.join(WRAPPERS)})<(.*)>$"), type_text)


def spaceless(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def node_id(name: Column) -> Column:
    """A name with all but letters, digits and underscores replaced, for graph languages."""
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


#: Pieces of a source text: comments, strings and templates, patterns behind what no value can end, and what is between them.
QUOTED = r"""//[^\n]*|/\*[\s\S]*?\*/|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\\$]*(?:(?:\\[\s\S]|\$\{[^{}`]*\}|\$)[^`\\$]*)*`"""
PATTERN = r"""(?<=[(,=:\[!&|?{};][ \t]{0,9})/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"""
BETWEEN = r"""[^"'`/]+|[\s\S]"""
PIECES = f"{QUOTED}|{PATTERN}|{BETWEEN}"
QUIET = r"""^(?://|/\*|/[^\n]+/$|["'][\s\S])"""


def blanks(text: Column) -> Column:
    return F.regexp_replace(text, "[^\n]", " ")


def masked(text: Column) -> Column:
    """A source text with blanks for the characters of comments, strings and patterns; lines and
    places stay. Of templates, what is in `${}` stays, if it has no braces of its own."""
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    parts = lambda x: F.regexp_extract_all(x, F.lit(r"\$\{[^{}`]*\}|\\[\s\S]|[^$\\]+|[\s\S]"), F.lit(0))
    template = lambda x: F.array_join(F.transform(parts(x), lambda y: F.when(y.startswith("${"), y).otherwise(blanks(y))), "")
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(QUIET), blanks(x)).when(x.startswith("`"), template(x)).otherwise(x)), "")


def split_outside(text: Column, signs: str) -> Column:
    """The parts of a text between any of the signs, outside of brackets of all kinds; `=>` closes none."""
    depth = lambda c: F.when(F.lit("([{<").contains(c), 1).when(F.lit(")]}>").contains(c), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("parts"))

    def step(a: Column, c: Column) -> Column:
        cut = (a["depth"] == 0) & F.lit(signs).contains(c)
        last, rest = F.element_at(a["parts"], -1), F.slice(a["parts"], F.lit(1), F.size(a["parts"]) - 1)
        return F.struct((a["depth"] + depth(c)).alias("depth"), F.when(cut, F.concat(a["parts"], F.array(F.lit("")))).otherwise(F.concat(rest, F.array(F.concat(last, c)))).alias("parts"))

    parts = F.aggregate(F.filter(F.split(F.regexp_replace(text, "=>", "\u21d2"), ""), lambda c: c != ""), start, step)["parts"]
    return F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "\u21d2", "=>")))


def ordered_set(values: Column) -> Column:
    """The values of an array, each once, in the order in which they come first; nulls go."""
    return F.array_distinct(F.array_compact(values))
