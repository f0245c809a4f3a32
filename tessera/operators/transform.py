"""Search for functions that turn one type into another.

callables: callable, name, params (types in order), returns, exported,
deprecated, kind, ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import spaceless, unwrapped
from tessera.operators.pointers import ends

#: Degrees of trust, least first, and types that match nothing.
TRUST = ("unverified", "assignable", "verified")
ERASED = ["any", "unknown"]


def grouped(seeds: DataFrame) -> DataFrame:
    """One row for each callable: its first seed, and how many there are."""
    rest = [c for c in seeds.columns if c != "callable"]
    return seeds.groupBy("callable").agg(F.min_by(F.struct(*rest), "ord").alias("r"), F.count("*").alias("n_seeds")).select("callable", "n_seeds", "r.*")


def expanded(groups: DataFrame, signatures: DataFrame) -> DataFrame:
    """`groups` (see `grouped`) with one row for each signature of a callable that
    has several seeds; a callable with one seed, or without signatures, keeps it."""
    own = [c for c in groups.columns if c not in ("callable", "n_seeds")]
    more = signatures.select("callable", F.struct(*own).alias("__signature"))
    rows = groups.withColumn("__of", F.when(F.col("n_seeds") > 1, F.col("callable"))).join(more.withColumnRenamed("callable", "__of"), "__of", "left")
    return rows.select("callable", "n_seeds", F.coalesce("__signature", F.struct(*own)).alias("r")).select("callable", "n_seeds", "r.*")


def resolve_types(asked: DataFrame, annotations: DataFrame, aliases: DataFrame, classes: DataFrame) -> DataFrame:
    """What each text that is asked for means: asked, how, type.

    A text that an annotation has, blanks at its ends aside, is its type; else
    the first alias of that name; else the last class or interface of it; else
    how and type are null. The three tables have name, ord and type.
    """
    rows = asked.select("asked", F.trim("asked").alias("name"))
    for how, table, pick in (("annotation", annotations, F.min_by), ("alias", aliases, F.min_by), ("class", classes, F.max_by)):
        rows = rows.join(table.groupBy("name").agg(pick("type", "ord").alias(how)), "name", "left")
    kinds = ("annotation", "alias", "class")
    how = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in kinds])
    return rows.select("asked", how.alias("how"), F.coalesce(*kinds).alias("type"))


def filled_returns(callables: DataFrame, given: DataFrame) -> DataFrame:
    """callable, returns, how: returns that aren't stated, from what the callable hands on.

    callables: callable, returns (null if not stated). given: callable, and
    either callee, a callable whose result it hands on, or type. A chain of
    callees is followed to its end; one that ends nowhere, in a callable that
    tells nothing, or in a circle leaves the return null, and how says so.
    """
    own = callables.select("callable", "returns").join(given.select("callable", "callee", "type"), "callable", "left")
    own = own.select("callable", F.coalesce("returns", "type").alias("own"), "callee", F.when(F.col("returns").isNotNull(), "stated").when(F.col("type").isNotNull(), "own value").alias("how"))
    last = ends(own.where("own is null and callee is not null").select(F.col("callable").alias("node"), F.col("callee").alias("next")))
    there = own.select(F.col("callable").alias("end"), F.col("own").alias("far"))
    rows = own.join(last.withColumnRenamed("node", "callable"), "callable", "left").join(there, "end", "left")
    nothing = F.when(F.col("callee").isNull(), "nothing handed on").when(F.col("end").isNull(), "circle").otherwise("end unknown")
    how = F.coalesce("how", F.when(F.col("far").isNotNull(), "handed on"), nothing)
    return rows.select("callable", F.coalesce("own", "far").alias("returns"), how.alias("how"))


def accepts(params: Column, wanted: str, position: int | None = 0) -> Column:
    """The place, from 0, of the first parameter of the type, or null; any place if `position` is None."""
    if position is not None:
        return F.when(F.get(params, F.lit(position)) == wanted, F.lit(position))
    at = F.array_position(params, F.lit(wanted))
    return F.when(at > 0, (at - 1).cast("int"))


def gives(returns: Column, wanted: str, unwrap: bool = True) -> Column:
    """How the return type meets the wanted one: exact, unwrapped, or null; erased types never do."""
    exact = F.when(spaceless(returns) == spaceless(F.lit(wanted)), "exact")
    inner = F.when(spaceless(unwrapped(returns)) == spaceless(F.lit(wanted)), "unwrapped")
    how = F.coalesce(exact, inner) if unwrap else exact
    return F.when(~returns.isin(ERASED), how)


def score(from_exact: Column, to_exact: Column, exported: Column, deprecated: Column, is_function: Column, was_unwrapped: Column) -> Column:
    """Points of a match; a side that isn't asked for counts as exact."""

    def points(c: Column, yes: int, no: int = 0) -> Column:
        return F.when(c, yes).otherwise(no)

    sides = points(from_exact, 40, 24) + points(to_exact, 40, 24) + 20
    return (sides + points(exported, 8) + points(deprecated, -15) + points(is_function, 2) + points(was_unwrapped, -10)).cast("long")


def confidence(status: Column, exact: Column, full: Column) -> Column:
    return F.when((status == "verified") & exact, "high").when(full & exact, "medium").otherwise("low")


RANK = ["name", "file", "ord"]


def best_of_each(matches: DataFrame) -> DataFrame:
    """The first match of each callable by score, name, file and place."""
    order = Window.partitionBy("callable").orderBy(F.desc("score"), *RANK)
    return matches.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def top(matches: DataFrame, limit: int = 25) -> DataFrame:
    return best_of_each(matches).orderBy(F.desc("score"), *RANK).limit(limit)


def verified_prefix(ranked: DataFrame, limit: int, extra: int = 10) -> DataFrame:
    """All ranked callables; the first `limit + extra` are marked to be verified."""
    first = ranked.orderBy(F.desc("score"), *RANK).limit(limit + extra).withColumn("to_verify", F.lit(True))
    rest = ranked.join(first.select("callable"), "callable", "left_anti").withColumn("to_verify", F.lit(False))
    return first.unionByName(rest)


#: Cells that the range of scores is cut into, at most, to find the least score that is needed.
SCORES = 256


def trusted_top(ranked: DataFrame, verify, limit: int, least: str = "verified") -> DataFrame:
    """The first `limit` callables in rank order whose status is at least `least`.

    `verify` takes a DataFrame of candidates and adds their status; a filter
    by trust then lies in the plan before the limit, and no candidate that
    fails leaves Spark. Where verifying is dear, `score_floor` first finds the
    score beyond which enough candidates pass.
    """
    trusted = verify(ranked).where(F.col("status").isin(list(TRUST[TRUST.index(least) :])))
    return trusted.orderBy(F.desc("score"), *RANK).limit(limit)


def score_floor(ranked: DataFrame, verify, limit: int, least: str = "verified") -> int | None:
    """The greatest score with at least `limit` trusted callables at or above it; null if there are fewer.

    Candidates are counted by score in one pass. From the top, the scores that
    hold at least twice as many candidates as are lacking are verified and
    counted, where what comes back is one number, until enough pass. Scores
    are few, so that the counts are too: 85 points and their deductions.
    """
    counts = ranked.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).limit(SCORES).collect()
    passed, at = 0, 0
    while passed < limit and at < len(counts):
        begin, some = at, 0
        while at < len(counts) and some < 2 * (limit - passed):
            some += counts[at]["n"]
            at += 1
        rows = ranked.where(F.col("score").between(counts[at - 1]["score"], counts[begin]["score"]))
        passed += verify(rows).where(F.col("status").isin(list(TRUST[TRUST.index(least) :]))).count()
    return counts[at - 1]["score"] if passed >= limit and at else None


def trusted_first(ranked: DataFrame, verify, limit: int, least: str = "verified") -> DataFrame:
    """`trusted_top` of the candidates that can still be among the first."""
    floor = score_floor(ranked, verify, limit, least)
    return trusted_top(ranked if floor is None else ranked.where(F.col("score") >= floor), verify, limit, least)


def status_counts(rows: DataFrame) -> DataFrame:
    """How many rows have each status, none left out, and how many callables there are: one row."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in TRUST]
    return rows.agg(*counts, F.countDistinct("callable").alias("n_callables"))
