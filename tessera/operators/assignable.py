"""Which types can stand in for which, as a relation between type texts.

A pair of types makes requirements, each met by any one of its alternatives,
which are pairs again. Pairs are unfolded from those asked for until no new
ones come. The relation is the greatest fixpoint: every pair is taken to hold,
and pairs fall when a requirement of theirs has no alternative left. So types
that refer to each other end well, and each round looks only at what has just
fallen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import spaceless, split_outside
from tessera.operators.pointers import ends
from tessera.operators.rounds import held

ALT = "array<struct<x:string,y:string>>"
#: What fits everything or takes everything.
TAKES_ALL, FITS_ALL = ("any", "unknown"), ("any", "never")


def plain(text: Column) -> Column:
    """A type text without blanks, `readonly` and parentheses around the whole."""
    t = F.regexp_replace(spaceless(F.regexp_replace(text, r"^\s*readonly\s+", "")), r"^\|", "")
    return F.when(t.rlike(r"^\([^()]*\)$"), F.regexp_replace(t, r"^\((.*)\)$", "$1")).otherwise(t)


def element(t: Column) -> Column:
    """The text of an array's elements, or null."""
    named = F.regexp_extract(t, r"^(?:Readonly)?Array<(.*)>$", 1)
    short = F.when(t.endswith("[]"), F.regexp_replace(t, r"\[\]$", ""))
    return F.coalesce(F.nullif(named, F.lit("")), short)


def general(t: Column) -> Column:
    return F.when(t.rlike("^['\"`]"), "string").when(t.rlike(r"^-?[0-9]"), "number").when(t.isin("true", "false"), "boolean")


def inline(t: Column) -> Column:
    """The members that an object type's text states, or null if it is none."""
    parts = F.filter(split_outside(F.regexp_extract(t, r"^\{(.*)\}$", 1), ";,"), lambda p: p.rlike(r"^(?:readonly\s*)?[\w$]+\??:"))
    members = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(?:readonly\s*)?([\w$]+)", 1).alias("name"), F.regexp_extract(p, r"^[^:]*:(.*)$", 1).alias("type"), p.rlike(r"^[^:]*\?:").alias("optional")))
    return F.when(t.rlike(r"^\{.*\}$"), members)


def shapes(members: DataFrame, types: DataFrame) -> DataFrame:
    """type_id and its members as one array, for every type of `types` (type_id)."""
    own = members.groupBy("type_id").agg(F.collect_list(F.struct("name", "type", "optional")).alias("members"))
    none = F.array().cast("array<struct<name:string,type:string,optional:boolean>>")
    return types.select("type_id").distinct().join(own, "type_id", "left").select("type_id", F.coalesce("members", none).alias("members"))


def one(x: Column, y: Column) -> Column:
    return F.array(F.struct(x.alias("x"), y.alias("y")))


def requirements(pairs: DataFrame, shapes_: DataFrame, aliases: DataFrame) -> DataFrame:
    """a, b, req, alts: what each pair needs; a requirement without alternatives can't be met, a pair without requirements holds."""
    rows = pairs
    for c in "ab":
        rows = rows.join(shapes_.select(F.col("type_id").alias(c), F.col("members").alias(f"m_{c}")).hint("merge"), c, "left")
        rows = rows.join(aliases.select(F.col("type_id").alias(c), plain(F.col("type")).alias(f"alias_{c}")).hint("merge"), c, "left")
    a, b = F.col("a"), F.col("b")
    rows = rows.select("a", "b", "alias_a", "alias_b", *(F.coalesce(f"m_{c}", inline(F.col(c))).alias(f"m_{c}") for c in "ab"))
    rows = rows.select("*", *(split_outside(F.col(c), "|").alias(f"parts_{c}") for c in "ab"), *(element(F.col(c)).alias(f"of_{c}") for c in "ab"))
    rows = rows.select("*", *(F.regexp_extract(c, r"^([\w$.]+)<.*>$", 1).alias(f"head_{c}") for c in "ab"), *(split_outside(F.regexp_extract(c, r"^[\w$.]+<(.*)>$", 1), ",").alias(f"args_{c}") for c in "ab"))
    req = lambda name, alts: F.struct(name.cast("string").alias("req"), alts.cast(ALT).alias("alts"))
    never = F.array(req(F.lit("never"), F.array()))
    unions = F.transform("parts_a", lambda p: req(p, F.transform("parts_b", lambda q: F.struct(p.alias("x"), q.alias("y")))))
    tuples = F.transform(split_outside(F.regexp_extract("a", r"^\[(.*)\]$", 1), ","), lambda p: req(p, one(p, F.col("of_b"))))
    generic = F.transform(F.arrays_zip("args_a", "args_b"), lambda z: req(F.concat_ws(" ", z["args_a"], z["args_b"]), one(z["args_a"], z["args_b"])))

    def member(m: Column) -> Column:
        own = F.element_at(F.filter("m_a", lambda x: x["name"] == m["name"]), 1)
        has = F.exists("m_a", lambda x: x["name"] == m["name"])
        wrong = (~has & ~m["optional"]) | (has & own["optional"] & ~m["optional"])
        return req(m["name"], F.when(wrong, F.array().cast(ALT)).when(has, one(own["type"], m["type"])).otherwise(one(F.lit("never"), F.lit("any"))))

    function = r"^\((.*?)\)=>(.*)$"
    both_functions = a.rlike(function) & b.rlike(function)
    result = lambda t: F.regexp_extract(t, r"^\(.*?\)=>(.*)$", 1)
    given = lambda t: F.transform(F.filter(split_outside(F.regexp_extract(t, r"^\((.*?)\)=>", 1), ","), lambda p: p != ""), lambda p: F.regexp_replace(p, r"^(?:\.\.\.)?[\w$]+\??:", ""))
    fewer = F.size(given(a)) <= F.size(given(b))
    # parameters are met the other way round; what gives nothing takes any result
    calls = F.concat(
        F.array(req(F.lit("=>"), F.when(result(b) == "void", one(F.lit("never"), F.lit("any"))).otherwise(one(result(a), result(b))))),
        F.transform(F.slice(given(b), F.lit(1), F.size(given(a))), lambda q, i: req(i, one(q, F.get(given(a), i)))),
    )
    needs = (
        F.when((a == b) | b.isin(*TAKES_ALL) | a.isin(*FITS_ALL), F.array().cast(f"array<struct<req:string,alts:{ALT}>>"))
        .when(F.col("alias_a").isNotNull(), F.array(req(F.lit("alias"), one(F.col("alias_a"), b))))
        .when(F.col("alias_b").isNotNull(), F.array(req(F.lit("alias"), one(a, F.col("alias_b")))))
        .when(both_functions, F.when(fewer, calls).otherwise(never))
        .when((F.size("parts_a") > 1) | (F.size("parts_b") > 1), unions)
        .when(F.col("of_a").isNotNull() & F.col("of_b").isNotNull(), F.array(req(F.lit("[]"), one(F.col("of_a"), F.col("of_b")))))
        .when(a.rlike(r"^\[.*\]$") & F.col("of_b").isNotNull(), tuples)
        .when(general(a) == b, F.array().cast(f"array<struct<req:string,alts:{ALT}>>"))
        .when(F.col("m_a").isNotNull() & F.col("m_b").isNotNull(), F.transform("m_b", member))
        .when((F.col("head_a") != "") & (F.col("head_a") == F.col("head_b")) & (F.size("args_a") == F.size("args_b")), generic)
        .otherwise(never)
    )
    alts = F.transform(F.col("r.alts"), lambda z: F.struct(plain(z["x"]).alias("x"), plain(z["y"]).alias("y")))
    return rows.select("a", "b", F.explode(needs).alias("r")).select("a", "b", "r.req", alts.alias("alts"))


#: What names a shape begins with, and the type of its members that lead to named object types; in no type's text.
MARK = "\0"
#: Rows up to which a side of a join is broadcast.
FEW = 20_000
#: Rounds in which pairs of named object types fall step by step; the rest falls by pointer jumping.
STEPS = 24
#: Paths of doubled length are kept while they are no more than so many times the members.
PATHS = 4


def without(rows: DataFrame, others: DataFrame) -> DataFrame:
    return rows.join(others.hint("merge"), ["a", "b"], "left_anti")


def kinds(table: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Named object types as a shape, which many share, and the members that lead to other named object types.

    t, kind, refs of each type, and kind, shape of each shape: its members by
    name, where one that leads to a named object type has the type MARK. Names
    alone, so that a pair of two of them needs what their shapes do and what
    their references do, and nothing else; types that have a member twice are
    left to the rounds.
    """
    named = table.where(F.col("type_id").rlike(r"^[A-Za-z_$][\w$]*$") & ~F.col("type_id").isin(*TAKES_ALL, *FITS_ALL, "true", "false"))
    named = named.where(F.size("members") == F.size(F.array_distinct(F.transform("members", lambda m: m["name"])))).join(aliases.select("type_id"), "type_id", "left_anti")
    rows = named.select(F.col("type_id").alias("t"), F.explode_outer("members").alias("m")).select("t", F.col("m.name").alias("word"), plain(F.col("m.type")).alias("to"), F.col("m.optional").alias("optional"))
    rows = rows.join(named.select(F.col("type_id").alias("to"), F.lit(True).alias("ref")).hint("merge"), "to", "left")
    shape = F.when(F.col("word").isNotNull(), F.struct(F.col("word").alias("name"), F.when(F.col("ref"), MARK).otherwise(F.col("to")).alias("type"), "optional"))
    rows = held(rows.groupBy("t").agg(F.sort_array(F.collect_list(shape)).alias("shape"), F.collect_list(F.when(F.col("ref"), F.struct("word", "to", "optional"))).alias("refs")))
    found = held(rows.select("shape").distinct().select("shape", F.concat(F.lit(MARK), F.monotonically_increasing_id().cast("string")).alias("kind")))
    return held(rows.join(found.hint("merge"), "shape").select("t", "kind", "refs")), found


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """`rows`, which are held, without those of `seen`; a few rows don't make many of `seen` move."""
    return without(rows, seen.join(F.broadcast(rows), ["a", "b"], "left_semi") if rows.count() <= FEW else seen)


def reached(pairs: DataFrame, paths: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """`pairs` and those that members of named object types (`paths`: t, word, to, optional) lead to, and whether all are there but those of optional members.

    Paths of members are joined with themselves, so that each round reaches
    twice as far: a circle of n types takes log2(n) rounds. Where a type has
    many such members, paths become many; then the rounds of `assignable` go on
    from `most` paths. What a pair of one type twice leads to is such a pair,
    and none is asked for.
    """
    seen = pairs
    while True:
        ahead = seen.where("a <> b").join(paths.where("not optional").select(F.col("t").alias("a"), "word", F.col("to").alias("x")).hint("merge"), "a")
        ahead = ahead.join(paths.select(F.col("t").alias("b"), "word", F.col("to").alias("y")).hint("merge"), ["b", "word"])
        new = held(without(ahead.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), seen))
        if new.isEmpty():
            return seen, True
        seen = seen.unionByName(new)
        paths = held(longer(paths))
        if paths.count() > most:
            return seen, False


def longer(paths: DataFrame) -> DataFrame:
    """Each two paths that follow on each other as one; its word tells both words, and it is optional if either is."""
    ahead = paths.select(F.col("t").alias("to"), F.col("word").alias("then"), F.col("to").alias("far"), F.col("optional").alias("also"))
    word = F.md5(F.concat(F.md5("word"), F.md5("then"))).alias("word")
    return paths.join(ahead.hint("merge"), "to").select("t", word, F.col("far").alias("to"), (F.col("optional") | F.col("also")).alias("optional"))


def paired(pairs: DataFrame, types: DataFrame) -> DataFrame:
    """`pairs` with kind_a, kind_b (null unless both are different named object types) and next: the pairs x, y that their references need."""
    rows = pairs
    for c in "ab":
        rows = rows.join(types.select(F.col("t").alias(c), F.col("kind").alias(f"kind_{c}"), F.col("refs").alias(f"refs_{c}")).hint("merge"), c, "left")
    simple = (F.col("a") != F.col("b")) & F.col("kind_a").isNotNull() & F.col("kind_b").isNotNull()

    def needed(m: Column) -> Column:
        own = F.filter("refs_a", lambda x: (x["word"] == m["word"]) & (~x["optional"] | m["optional"]))
        return F.transform(own, lambda x: F.struct(m["word"].alias("word"), x["to"].alias("x"), m["to"].alias("y"), x["optional"].alias("optional")))

    next_ = F.flatten(F.transform("refs_b", needed))
    return rows.select("a", "b", *(F.when(simple, F.col(c)).alias(c) for c in ("kind_a", "kind_b")), F.when(simple, next_).alias("next"))


def mixed(pairs: DataFrame, shapes_: DataFrame) -> DataFrame:
    """The pairs kind_a, kind_b of shapes where a member leads to a named object type in one and not in the other."""
    rows = pairs
    for c in "ab":
        rows = rows.join(shapes_.select(F.col("kind").alias(f"kind_{c}"), F.col("shape").alias(f"shape_{c}")).hint("merge"), f"kind_{c}")
    leads = lambda m: m["type"].eqNullSafe(F.lit(MARK))
    differ = F.exists("shape_b", lambda m: F.exists("shape_a", lambda x: (x["name"] == m["name"]) & (leads(x) != leads(m))))
    return rows.where(differ).select("kind_a", "kind_b")


def unfolded(asked: DataFrame, table: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """All pairs that `asked` leads to: those with what they need, and those of named object types.

    Of the latter (see `paired`) each needs the pair of its shapes, which is
    unfolded like any other, and the pairs of its references, so that what
    members without references need is found once for each pair of shapes.
    """
    types, shapes_ = kinds(table, aliases)
    members = held(types.select("t", F.explode("refs").alias("m")).select("t", "m.*"))
    table = table.unionByName(shapes_.select(F.col("kind").alias("type_id"), F.col("shape").alias("members")))
    new, seen, needs, bulk, most = asked, asked.limit(0), None, None, PATHS * members.count()
    while not new.isEmpty():
        complete = True
        if not new.join(types.select(F.col("t").alias("a")).hint("merge"), "a", "left_semi").isEmpty():
            new, complete = reached(new, members, most)
            if bulk is not None:
                new = unseen(held(new), seen.unionByName(bulk.select("a", "b")))
        rows = held(paired(new, types))
        pairs = held(rows.where("kind_a is not null").select("kind_a", "kind_b").distinct())
        other = held(mixed(pairs, shapes_))
        if not other.isEmpty():
            rows = rows.join(other.withColumn("mixed", F.lit(True)).hint("merge"), ["kind_a", "kind_b"], "left")
            rows = held(rows.select("a", "b", *(F.when(F.col("mixed").isNull(), F.col(c)).alias(c) for c in ("kind_a", "kind_b", "next"))))
            pairs = pairs.join(other.hint("merge"), ["kind_a", "kind_b"], "left_anti")
        single = rows.where("kind_a is null").select("a", "b").unionByName(held(without(pairs.toDF("a", "b"), seen)))
        found = held(requirements(single, table, aliases))
        needs, seen = found if needs is None else needs.unionByName(found), seen.unionByName(single)
        some = rows.where("kind_a is not null")
        bulk = some if bulk is None else bulk.unionByName(some)
        ahead = some.select(F.explode("next").alias("z")).select("z.x", "z.y", "z.optional").where(F.lit(not complete) | F.expr("optional or x = y"))
        next_ = found.select(F.explode("alts").alias("z")).select(F.col("z.x").alias("a"), F.col("z.y").alias("b")).unionByName(ahead.select(F.col("x").alias("a"), F.col("y").alias("b")))
        new = held(unseen(held(next_.distinct()), seen.unionByName(bulk.select("a", "b"))))
    return seen, needs, bulk


def open_needs(needs: DataFrame, fallen: DataFrame, sure: DataFrame) -> DataFrame:
    """a, b, req, alts: requirements that no pair of `sure` meets, with the alternatives that aren't in `fallen`."""
    known = fallen.withColumn("sure", F.lit(False)).unionByName(sure.withColumn("sure", F.lit(True))).toDF("x", "y", "sure")
    rows = needs.select("a", "b", "req", F.explode("alts").alias("z")).select("a", "b", "req", F.col("z.x").alias("x"), F.col("z.y").alias("y"))
    rows = rows.join(known.hint("merge"), ["x", "y"], "left")
    left = rows.groupBy("a", "b", "req").agg(F.max(F.coalesce("sure", F.lit(False))).alias("met"), F.collect_list(F.when(F.col("sure").isNull(), F.struct("x", "y"))).alias("alts"))
    return left.where("not met").drop("met")


def falling(seen: DataFrame, needs: DataFrame) -> DataFrame:
    """The pairs (a, b) that don't hold.

    What pairs without requirements and pairs that can't be met decide goes
    first. A pair that then hangs on one other alone falls with the end of its
    chain, which pointer jumping finds, and holds if that is a circle. Only
    pairs that hang on several take rounds.
    """
    fallen = held(needs.where(F.size("alts") == 0).select("a", "b").distinct())
    open_ = held(open_needs(needs, fallen, without(seen, needs.select("a", "b"))))
    fallen = held(fallen.unionByName(open_.where(F.size("alts") == 0).select("a", "b")).distinct())
    open_ = held(without(open_.where(F.size("alts") > 0), fallen))
    one_way = open_.groupBy("a", "b").agg(F.sum(F.size("alts")).alias("n"), F.any_value("alts").alias("alts")).where("n = 1")
    chain = held(one_way.select(F.struct("a", "b").alias("node"), F.struct(F.col("alts")[0]["x"].alias("a"), F.col("alts")[0]["y"].alias("b")).alias("next")))
    far = held(ends(chain))

    def with_chains(pairs: DataFrame) -> DataFrame:
        return pairs.unionByName(far.join(pairs.select(F.struct("a", "b").alias("end")).hint("merge"), "end").select("node.*"))

    several = without(open_, chain.select("node.*"))
    rows = held(several.select("a", "b", "req", F.explode("alts").alias("z")).select("a", "b", "req", F.col("z.x").alias("x"), F.col("z.y").alias("y")))
    fallen = new = held(with_chains(fallen).distinct())
    while not rows.isEmpty() and not new.isEmpty():
        hit = without(rows.join(new.toDF("x", "y").hint("merge"), ["x", "y"]).select("a", "b", "req").distinct(), fallen)
        left = rows.join(hit.hint("merge"), ["a", "b", "req"]).join(fallen.toDF("x", "y").withColumn("gone", F.lit(True)).hint("merge"), ["x", "y"], "left")
        lost = left.groupBy("a", "b", "req").agg(F.count_if(F.col("gone").isNull()).alias("n")).where("n = 0")
        new = held(without(with_chains(held(lost.select("a", "b").distinct())).distinct(), fallen))
        fallen = held(fallen.unionByName(new))
    return fallen


def assignable(asked: DataFrame, members: DataFrame, types: DataFrame, aliases: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """a, b, ok for all pairs that `asked` (a, b: type texts) leads to, `asked` included,
    or, if not `whole`, for `asked` alone: what falls by its own members is then not unfolded.

    members: type_id, name, type, optional, of object types with those they
    inherit. types: type_id of all object types, those without members
    included. aliases: type_id, type. Any other text is a type of its own, or
    is read as far as its form tells: unions, arrays, tuples, literals, object
    and function types, and one generic with other arguments.

    Types are told apart by their ids. Null texts make no pair.
    """
    spark = asked.sparkSession
    table = held(shapes(members, types))
    aliases = aliases if aliases is not None else spark.createDataFrame([], "type_id string, type string")
    asked = held(asked.select(plain(F.col("a")).alias("a"), plain(F.col("b")).alias("b")).where("a is not null and b is not null").distinct())
    if whole:
        return verdicts(*unfolded(asked, table, aliases))
    first = held(requirements(asked, table, aliases))
    pairs = held(first.select(F.explode("alts").alias("z")).select(F.col("z.x").alias("a"), F.col("z.y").alias("b")).distinct())
    unmet = held(requirements(pairs, table, aliases).where(F.size("alts") == 0).select("a", "b").distinct())
    lost = open_needs(first, unmet, unmet.limit(0)).where(F.size("alts") == 0).select("a", "b")
    lost = held(lost.unionByName(first.where(F.size("alts") == 0).select("a", "b")).distinct())
    rest = held(without(asked, lost))
    return lost.withColumn("ok", F.lit(False)).unionByName(verdicts(*unfolded(rest, table, aliases)).join(rest.hint("merge"), ["a", "b"], "left_semi"))


def verdicts(seen: DataFrame, needs: DataFrame | None, bulk: DataFrame | None) -> DataFrame:
    """a, b, ok of all pairs that were unfolded.

    Where no other pair hangs on pairs of named object types, pairs of shapes
    are decided first, and what is left of the latter falls by references.
    """
    if needs is None:
        return seen.withColumn("ok", F.lit(True))
    asked = held(needs.select(F.explode("alts").alias("z")).select(F.col("z.x").alias("a"), F.col("z.y").alias("b")).distinct())
    own = bulk.select("a", "b")
    if own.join(F.broadcast(asked) if asked.count() <= FEW else asked.hint("merge"), ["a", "b"], "left_semi").isEmpty():
        fell = held(falling(seen, needs))
        shapes_ = fell.where(F.col("a").startswith(MARK)).toDF("kind_a", "kind_b")
        shapes_ = F.broadcast(shapes_) if shapes_.count() <= FEW else shapes_.hint("merge")
        ok = standing(held(bulk.join(shapes_, ["kind_a", "kind_b"], "left_anti").select("a", "b", "next")))
        rest = own.join(ok.withColumn("ok", F.lit(True)).hint("merge"), ["a", "b"], "left").select("a", "b", F.coalesce("ok", F.lit(False)).alias("ok"))
    else:
        one_ = lambda x, y: F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).cast(ALT)
        more = bulk.select("a", "b", F.lit(MARK).alias("req"), one_("kind_a", "kind_b").alias("alts"))
        steps = bulk.select("a", "b", F.explode("next").alias("z")).select("a", "b", F.col("z.word").alias("req"), one_("z.x", "z.y").alias("alts"))
        seen, rest = seen.unionByName(own), None
        fell = held(falling(seen, needs.unionByName(more).unionByName(steps)))
    seen = seen.where(~F.col("a").startswith(MARK))
    found = seen.join(fell.withColumn("gone", F.lit(True)).hint("merge"), ["a", "b"], "left").select("a", "b", F.col("gone").isNull().alias("ok"))
    return found if rest is None else found.unionByName(rest)


def standing(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of `pairs` (a, b, next) that lead to such pairs alone; a pair of one type twice always holds.

    Most pairs fall within a few steps, which rounds take from the pairs that
    have just fallen. What is left after STEPS rounds, with chains of any
    length, falls by pointer jumping (see `falling`).
    """
    steps = held(pairs.select("a", "b", F.explode("next").alias("z")).select("a", "b", F.col("z.word").alias("req"), "z.x", "z.y").where("x <> y"))
    left = pairs.select("a", "b")
    lost = held(steps.join(left.toDF("x", "y").hint("merge"), ["x", "y"], "left_anti").select("a", "b").distinct())
    some = None  # pairs that fell in rounds of a few, and are still in `left` and `steps`
    for _ in range(STEPS):
        fell = lost.count()
        if not fell:
            break
        if fell <= FEW:
            some = lost if some is None else some.unionByName(lost)
            lost = steps.join(F.broadcast(lost.toDF("x", "y")), ["x", "y"], "left_semi").select("a", "b").distinct()
            lost = held(lost.join(some.hint("merge"), ["a", "b"], "left_anti"))
        else:
            left, steps = held(without(left, lost)), held(without(steps, lost))
            lost = held(steps.join(lost.toDF("x", "y").hint("merge"), ["x", "y"], "left_semi").select("a", "b").distinct())
    if some is not None:
        left, steps = held(without(left, some)), held(without(steps, some))
    if lost.isEmpty():
        return left
    gone = lost.select(F.col("a"), F.col("b"), F.lit("").alias("req"), F.array().cast(ALT).alias("alts"))
    alts = F.array(F.struct("x", "y")).cast(ALT).alias("alts")
    return without(left, falling(left, held(steps.select("a", "b", "req", alts).unionByName(gone))))


def related(asked: DataFrame, relation: DataFrame) -> DataFrame:
    """`asked` (a, b and other columns) with ok, from a relation that was made of its pairs."""
    rows = asked.select("*", plain(F.col("a")).alias("__a"), plain(F.col("b")).alias("__b"))
    return rows.join(relation.toDF("__a", "__b", "ok").hint("merge"), ["__a", "__b"], "left").drop("__a", "__b")
