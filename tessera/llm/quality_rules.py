"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
a al als an and are as at auch auf aus avec be bei by con con da das dass de del dem den der des die du ein eine einem einen einer el elle en
er es est esta et for from für has have he il in is ist it la las le les lo los mit nicht no not of on ou par para pas por pour que qui
se sein sich sie sind son su sur the this that to un una und une von was were with y zu
""".split()


@dataclass(frozen=True)
class Rule:
    """A text fails the rule if scale * top is above (or below) bound * base.

    `top` and `base` name metrics. Both sides are whole numbers, so no rule
    depends on how a ratio is rounded; a base of 0 fails no upper bound.
    """

    name: str
    top: str
    base: str
    side: str
    bound: int
    scale: int = 100


#: The production table. Bounds are per cent of the base.
RULES = (
    Rule("short words", "word_chars", "n_words", "below", 200),
    Rule("long words", "word_chars", "n_words", "above", 2000),
    Rule("symbols", "n_symbols", "n_words", "above", 10),
    Rule("capitals", "n_capitals", "n_letters", "above", 40),
    Rule("stop words", "n_stop_words", "n_words", "below", 5),
    Rule("repeated lines", "n_dup_lines", "n_lines", "above", 50),
)

#: A text fails the base rules with fewer words than the first, or with a
#: greater percentage of its words in repeated windows than the second.
MIN_WORDS, MOST_REPEATED = 50, 50


def let(value: Column, body) -> Column:
    """body(value), with `value` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, no empty strings among them."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


#: Low bits of a packed window that hold its place in the text.
PLACE_BITS = 24


def repeated_words(ws: Column) -> Column:
    """Words in 3-word windows that occur at least twice in the list.

    A window is packed into a long, 40 bits of hash above its place, and the
    longs are sorted; windows next to one another with the same hash are
    compared word by word. If all such neighbours are alike, they are the
    repeated windows. Else two windows share a hash, and the windows are sorted
    by their words.
    """
    mask = (1 << PLACE_BITS) - 1

    def with_next(w: Column, i: Column) -> tuple[Column, Column, Column]:
        return w, F.get(ws, i + 1), F.get(ws, i + 2)

    def windows(of) -> Column:
        return F.sort_array(F.slice(F.transform(ws, of), F.lit(1), F.size(ws) - 2))

    def count(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    def packed(w: Column, i: Column) -> Column:
        return F.xxhash64(*with_next(w, i)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))

    def neighbours(s: Column) -> Column:
        def of(x: Column, k: Column) -> Column:
            y = F.get(s, k + 1)
            pair = F.array(x.bitwiseAND(F.lit(mask)).cast("int"), y.bitwiseAND(F.lit(mask)).cast("int"))
            return F.when(F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0, pair)

        return F.filter(F.transform(s, of), lambda p: p.isNotNull())

    def equal(p: Column) -> Column:
        i, j = p[0], p[1]
        return (F.get(ws, i) == F.get(ws, j)) & (F.get(ws, i + 1) == F.get(ws, j + 1)) & (F.get(ws, i + 2) == F.get(ws, j + 2))

    def by_words(s: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

        hits = F.transform(s, lambda x, k: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"]))
        return count(F.filter(hits, lambda i: i.isNotNull()))

    def spelled(w: Column, i: Column) -> Column:
        return F.struct(*[x.alias(n) for x, n in zip(with_next(w, i), "abc", strict=True)], i.alias("i"))

    slow = let(windows(spelled), by_words)
    pairs = let(windows(packed), neighbours)
    quick = let(pairs, lambda ps: F.when(F.forall(ps, equal), count(F.flatten(ps))).otherwise(slow))
    return F.when(F.size(ws) < 4, 0).when(F.size(ws) > mask, slow).otherwise(quick)


def metrics(text: Column) -> dict[str, Column]:
    """The numbers that rules may name, as expressions over a text column.

    `words` and `lines`, which several share, are given as columns of their
    own by `measure`.
    """
    ws, lines, text = F.col("__words"), F.col("__lines"), F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(ws),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(ws),
        "n_letters": F.length(F.regexp_replace(text, r"\P{L}+", "")),
        "n_capitals": F.length(F.regexp_replace(text, r"\P{Lu}+", "")),
        "n_stop_words": F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS))),
    }


def failed(rule: Rule) -> Column:
    top, base = rule.scale * F.col(rule.top), rule.bound * F.col(rule.base)
    return top > base if rule.side == "above" else top < base


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics and verdicts of every text: a projection without user functions,
    joins or shuffles, so that it runs inside the scan at any size.

    Words are runs without ASCII white space, lines what \\n separates and
    that have a word. `failed` lists the names of the rules that a text fails;
    a text is kept if it fails neither a base rule nor one of the table.

    Defined results: a null text has no words, and so fails the base rules;
    repeated rows are judged alike; an empty table gives no rows; columns of
    `docs` besides doc_id and text are not read.

    Returns doc_id, the metrics, base_failed, failed, kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", text.alias("__text"), words(text).alias("__words"), lines.alias("__lines"))
    numbers = [v.cast("long").alias(k) for k, v in metrics(F.col("__text")).items()]
    rows = rows.select("doc_id", *numbers)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    names = F.array_compact(F.array(*[F.when(failed(r), F.lit(r.name)) for r in rules]))
    rows = rows.withColumn("base_failed", base).withColumn("failed", names)
    # The last term is always true. It isn't deterministic to the planner, which
    # would else push a filter on the verdict below the projections, and there
    # spell out the words of a text once for each of their uses.
    always = F.monotonically_increasing_id() >= 0
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0) & always)


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` that `measure` keeps, with the same columns."""
    verdict = measure(docs.select(F.struct("*").alias("doc_id"), "text"), rules)
    return verdict.where("kept").select("doc_id.*")
