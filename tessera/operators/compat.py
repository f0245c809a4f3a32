"""Whether one type can stand in for another, and why not.

Members have type_id, name and the text of their type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import spaceless


def text_fits(source: Column, target: Column) -> Column:
    """Whether a type's text fits another's, as far as texts can tell: every member
    of the one union is a member of the other, or a literal of one. Arrays fit
    as their elements do. Anything else doesn't fit, and isn't guessed."""

    def bare(t: Column) -> Column:
        t = F.regexp_replace(spaceless(t), "^readonly", "")
        return F.regexp_replace(t, r"^(?:Readonly)?Array<(.*)>$|^\((.*)\)\[\]$|^([^|]*)\[\]$", "$1$2$3[]")

    def element(t: Column) -> Column:
        return F.regexp_replace(t, r"\[\]$", "")

    def parts(t: Column) -> Column:
        return F.filter(F.split(element(t), r"\|"), lambda x: x != "")

    def general(x: Column) -> Column:
        literal = F.when(x.rlike("^['\"`]"), "string").when(x.rlike(r"^-?[0-9]"), "number").when(x.isin("true", "false"), "boolean")
        return F.coalesce(literal, x)

    a, b = bare(source), bare(target)
    wide = parts(b)
    each = F.forall(parts(a), lambda x: F.array_contains(wide, x) | F.array_contains(wide, general(x)))
    return b.isin("any", "unknown") | (a == b) | ((a.endswith("[]") == b.endswith("[]")) & each)


def missing(source: DataFrame, target: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members that the target needs and the source lacks, for pairs (from, to)."""
    need = pairs.join(target.withColumnRenamed("type_id", "to"), "to")
    have = source.withColumnRenamed("type_id", "from").select("from", "name")
    return need.join(have, ["from", "name"], "left_anti").select("from", "to", "name")


def mismatched(source: DataFrame, target: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members of the same name whose types differ, for pairs (from, to)."""
    a = source.select(F.col("type_id").alias("from"), "name", F.col("type").alias("from_type"))
    b = target.select(F.col("type_id").alias("to"), "name", F.col("type").alias("to_type"))
    return pairs.join(a, "from").join(b, ["to", "name"]).where("from_type <> to_type").select("from", "to", "name", "from_type", "to_type")


def verdicts(source: DataFrame, target: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair whether it is compatible, how many issues there are, and a text of them:
    first what is missing, then what doesn't match."""
    lack = missing(source, target, pairs).select("from", "to", F.concat(F.lit("0 missing "), "name").alias("issue"))
    differ = mismatched(source, target, pairs).select("from", "to", F.concat(F.lit("1 mismatch "), "name").alias("issue"))
    texts = F.transform(F.array_sort(F.collect_list("issue")), lambda x: F.substring(x, F.lit(3), F.length(x)))
    found = lack.union(differ).groupBy("from", "to").agg(F.count("*").alias("n_issues"), F.array_join(texts, "; ").alias("reason"))
    n = F.coalesce("n_issues", F.lit(0))
    return pairs.join(found, ["from", "to"], "left").select("from", "to", (n == 0).alias("compatible"), n.alias("n_issues"), F.coalesce("reason", F.lit("")).alias("reason"))
