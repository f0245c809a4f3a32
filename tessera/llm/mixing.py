"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, attach, bucket_count, cut, leading, prefix_sums

#: Words of a block, slots of an output shard, and how often a text may repeat.
BLOCK_WORDS = 128
SHARD_BLOCKS = 4096
MOST_EPOCHS = 3
#: Slots that one row unfolds to, so that many tasks unfold a hot source.
SLOT_RUN = 2048
#: Cells that the line of all slots is cut into to find the source of a draw.
CELLS = 1024
#: Rounds of an index permutation, and times that one is repeated (see `permuted`).
ROUNDS, WALKS = 4, 16


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """Words to take from each source: src, source_size, target.

    Sources in code point order, null last, get the weights in turn and share
    all words by them. A target stops at `most` times its source's size, and
    the excess is shared by weight among the others: with the sources in order
    of cap / weight, the first whose cap is not below the level of those not
    yet capped sets the level of all that follow.
    """
    whole, by_name = Window.partitionBy(), Window.orderBy("src")
    below = Window.orderBy("limit", "src").rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
    s = s.withColumn("limit", most * F.col("source_size") / F.col("weight"))
    words = F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(below), F.lit(0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    s = s.withColumn("words_left", words).withColumn("weight_left", weight)
    free = F.col("limit") >= F.col("words_left") / F.col("weight_left")
    first = F.min(F.when(free, F.struct("limit", "src", "words_left", "weight_left"))).over(whole)
    s = s.withColumn("first", first)
    cap = (most * F.col("source_size")).cast("double")
    share = F.col("weight") * F.col("first.words_left") / F.col("first.weight_left")
    return s.select("src", "source_size", F.least(cap, share).alias("target"))


def shard_counts(sources: DataFrame, total: int, shard_blocks: int, seed: int) -> DataFrame:
    """Slots of each source in each output shard: src, shard, n, a multinomial draw for each shard.

    `sources` (materialised) has src and slots, which sum to `total`. Slots lie
    on a line, those of a source together, and every slot of the output draws a
    place on it. Cells of the line lead to the sources that lie in them.
    """
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = F.sum("slots").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    line = sources.select("src", "slots", end.alias("end")).select("src", (F.col("end") - F.col("slots")).alias("begin"), "end")
    cell = lambda place: F.expr(f"{place} * {CELLS}L div {total}L")
    line = line.withColumn("last", F.col("end") - 1).select("*", F.explode(F.sequence(cell("begin"), cell("last"))).alias("cell"))
    drawn = sources.sparkSession.range(0, total, 1, tasks).select(F.expr(f"id div {shard_blocks}L").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("place"))
    drawn = attach(drawn.withColumn("cell", cell("place")), cut(line.drop("last")), "cell").where("place >= begin and place < end")
    return drawn.groupBy("src", "shard").agg(F.count("*").alias("n"))


def permuted(x: Column, n: Column, seed: Column) -> Column:
    """The place of x among n under a pseudorandom permutation of 0 to n - 1.

    Numbers are laid out in a grid of a x b places, a the root of n rounded up.
    Each round adds a hash of the column to the row and a hash of the row to the
    column. Fewer than a places of the grid are beyond n; what comes to one is
    permuted again. WALKS times are enough up to n = WALKS^2, and beyond fail
    with a chance below n^(-WALKS / 2); then the place is x itself.
    """
    a = F.ceil(F.sqrt(F.greatest(n, F.lit(1)))).cast("long")

    def walked(a: Column) -> Column:
        return let(F.ceil(n / a).cast("long"), lambda b: F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(x, a, b), lambda y, _: F.when(y < n, y).otherwise(once(y, a, b))))

    def once(y: Column, a: Column, b: Column) -> Column:
        def round_(at: Column, k: Column) -> Column:
            row = F.pmod(at["row"] + F.xxhash64(seed, k, at["column"]) % a, a)
            return let(row, lambda r: F.struct(r.alias("row"), F.pmod(at["column"] + F.xxhash64(seed, k + 1, r) % b, b).alias("column")))

        start = F.struct(F.floor(y / b).cast("long").alias("row"), (y % b).alias("column"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 2), F.lit(2)), start, round_, lambda at: at["row"] * b + at["column"])

    return let(let(a, walked), lambda y: F.when(y < n, y).otherwise(x))


def let(value: Column, body) -> Column:
    """body(value), with `value` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def schedule(sources: DataFrame, block: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 11) -> DataFrame:
    """The mix: one row for each slot of the output: shard, src, slot, epoch, block, words.

    `sources` has src, source_size and target. Output shards have `shard_blocks`
    slots, and each draws its counts of the sources from a multinomial
    distribution (see `shard_counts`). A source's slots are numbered through its
    shards. They stop where the target is reached; what the draws leave short of
    it goes to closing shards. So the draws decide in which shard a slot lies,
    and the words of each source meet the target to the word.

    A source's blocks repeat epoch by epoch. Within an epoch, slots run through
    the whole blocks by an index permutation of the source and epoch, then
    through the shorter last block. The last epoch ends, if need be within a
    block, where the target is reached.
    """
    s = sources.where("source_size > 0").withColumn("want", F.least(F.round("target").cast("long"), MOST_EPOCHS * F.col("source_size")))
    s = s.withColumn("full", F.expr(f"source_size div {block}L")).withColumn("tail", F.expr(f"source_size % {block}L"))
    s = s.withColumn("blocks", F.expr("full + if(tail > 0, 1, 0)"))
    s = s.withColumn("epochs", F.expr("want div source_size")).withColumn("rest", F.expr("want % source_size"))
    s = cut(s.withColumn("slots", F.expr(f"epochs * blocks + (rest + {block - 1}) div {block}L")).where("slots > 0"))
    total = s.agg(F.sum("slots")).first()[0] or 0
    shards = -(-total // shard_blocks)
    counts = cut(shard_counts(s, max(total, 1), shard_blocks, seed))
    run = max(256, int(shards**0.5))
    placed = prefix_sums(counts.withColumn("b", F.expr(f"shard div {run}L")), ["src"], "b", [F.col("shard")], F.col("n"), "begin")
    drawn = placed.select("src", "shard", "begin", (F.col("begin") + F.col("n")).alias("end"))
    short = s.join(counts.groupBy("src").agg(F.sum("n").alias("n")), "src", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < slots")
    short = short.select("src", "slots", "n", F.explode(F.expr(f"sequence(0L, (slots - n - 1) div {SLOT_RUN}L)")).alias("run"))
    short = short.select("src", F.expr(f"{shards}L + run * {SLOT_RUN}L div {shard_blocks}L").alias("shard"), F.expr(f"n + run * {SLOT_RUN}L").alias("begin"), F.expr(f"least(slots, n + (run + 1) * {SLOT_RUN}L)").alias("end"))
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = drawn.unionByName(short).repartition(tasks, "src", "begin")  # a set number, which adaptive execution doesn't lower
    runs = attach(runs, s.drop("source_size", "target"), "src").where("begin < slots")
    slots = runs.select("*", F.explode(F.expr("sequence(begin, least(end, slots) - 1)")).alias("slot"))
    slots = slots.withColumn("epoch", F.expr("slot div blocks")).withColumn("j", F.expr("slot % blocks"))
    inner = F.col("j") < F.col("full")
    index = F.when(inner, permuted(F.col("j"), F.col("full"), F.xxhash64(F.lit(seed), "src", "epoch"))).otherwise(F.col("full"))
    length = F.when(inner, F.lit(block).cast("long")).otherwise(F.col("tail"))
    words = F.when(F.col("epoch") < F.col("epochs"), length).otherwise(F.least(length, F.col("rest") - F.col("j") * block))
    return slots.select("shard", "src", "slot", "epoch", index.alias("block"), words.alias("words"))


def row_key() -> Column:
    """Hexadecimal digits that name a document's row; equal rows have equal ones."""
    null = F.lit("?")
    parts = [F.coalesce(F.col("doc_id").cast("string"), null), F.coalesce(F.concat(F.lit("s"), F.col("source")), null), F.coalesce(F.concat(F.lit("t"), F.col("text")), null)]
    return F.md5(F.concat_ws(":", *parts))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 11) -> DataFrame:
    """How many words of each document the mix takes, and in which of its shards.

    The words of a source, its documents in hashed order, are packed end to end
    into blocks of `block` words; a document may span blocks and share them.
    The slots of `schedule` are joined to the documents' spans by source and
    block index, and the words they take are summed for each document.

    Places within a source come from distributed prefix sums, slots are
    unfolded in runs, and the join's keys are single blocks: a hot source is
    spread over all tasks. Texts are neither shuffled nor sorted.

    Defined results: a null source is a source of its own, last in order; a
    null or blank text has size 0 and nothing is taken of it; repeated rows are
    counted apart; a table without words has targets 0; an empty table gives no
    rows; columns besides doc_id, source and text are not read.

    Returns row_key, doc_id, source, size, source_size, target, taken, and the
    first and last output shard with words of it (null if none are taken).
    """
    rows = docs.select(
        "doc_id",
        "source",
        # "~" sorts behind every "s...": null is last
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~")).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_key().alias("row_key"),
    )
    rows = cut(rows)
    sources = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_source"))
    sources = cut(targets(cut(sources)).join(sources.drop("source_size"), "src"))
    rows = attach(rows, sources, "src")
    rows = rows.withColumn("b", F.floor(leading(F.col("row_key")) * bucket_count(F.col("n_source")) / F.lit(2.0**32)))
    placed = prefix_sums(rows, ["src"], "b", [F.col("row_key")], F.col("size"), "start").drop("b", "n_source")
    placed = cut(placed.withColumn("row", F.monotonically_increasing_id()))

    last = F.expr(f"(start + size - 1) div {block}L")
    spans = placed.where("size > 0").select("row", "src", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}L"), last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block) - F.col("block") * block
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("block") * block
    spans = spans.select("row", "src", "block", begin.alias("begin"), end.alias("end"))
    slots = schedule(sources.drop("n_source"), block, shard_blocks, seed).select("src", "block", "words", "shard")
    part = F.least(F.col("end"), F.col("words")) - F.col("begin")
    # the planner takes unfolded rows for few: without the hint it would broadcast them
    took = spans.join(slots.hint("merge"), ["src", "block"]).select("row", "shard", part.alias("part")).where("part > 0")
    took = took.groupBy("row").agg(F.sum("part").alias("part"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    out = placed.join(took.hint("merge"), "row", "left")
    return out.select("row_key", "doc_id", "source", "size", "source_size", "target", F.coalesce("part", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")


#: Parts of a document that fractions are counted in.
UNIT = 1 << 30


def whole_copies(rows: DataFrame) -> DataFrame:
    """Rows of `mix` with their number of whole copies, so that sources keep their words: 0 to 3.

    With a source's rows by size, then in hashed order, a row gets the whole
    epochs taken of it, and one more where the running sum of the fractions
    passes a half. As sizes rise along that order, the words of a source's
    copies differ from the words taken by the size of its largest document at
    most. Buckets of the running sum are runs of a size; a source has no more
    sizes than the root of twice its words.
    """
    rows = rows.where("size > 0").select("row_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("~")).alias("src"), "size", "taken")
    rows = cut(rows)
    alike = cut(rows.groupBy("src", "size").agg(F.count("*").alias("n_alike")))
    rows = rows.join(alike.hint("merge"), ["src", "size"])
    run = F.floor(leading(F.col("row_key")) * bucket_count(F.col("n_alike")) / F.lit(2.0**32))
    rows = rows.withColumn("b", F.col("size") * F.lit(1 << 31) + run).withColumn("part", F.expr(f"(taken % size) * {UNIT}L div size"))
    placed = prefix_sums(rows, ["src"], "b", [F.col("size"), F.col("row_key")], F.col("part"), "before")
    more = F.expr(f"(before + part + {UNIT // 2}L) div {UNIT}L - (before + {UNIT // 2}L) div {UNIT}L")
    return placed.select("row_key", "src", "size", "taken", (F.expr("taken div size") + more).cast("int").alias("copies"))


def repeated(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """`docs` with rows repeated by the copies of their key (row_key, copies).

    Rows of one key are equal, so it doesn't matter which of them gets a
    remainder. Texts are shuffled once, by key.
    """
    plan = copies.groupBy(F.col("row_key").alias("__row_key")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0")
    nth = F.row_number().over(Window.partitionBy("__row_key").orderBy("__row_key"))
    kept = docs.withColumn("__row_key", row_key()).join(plan, "__row_key").withColumn("__nth", nth)
    own = F.expr("__copies div __rows + if(__nth <= __copies % __rows, 1, 0)")
    kept = kept.withColumn("__own", own.cast("int")).where("__own > 0")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__own"))).alias("__copy")).drop("__copy")


def documents_by_targets(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """`docs` as the mix has them, with the same columns: rows are repeated or
    left out whole, so that each source comes to the words that the mix takes of
    it, give or take its largest document (see `whole_copies`)."""
    return repeated(docs, whole_copies(mix(docs, weights, block, seed=seed)))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """`docs` with each row repeated as often as the mix takes its words, rounded
    on its own to whole documents with halves up; rows that come to less than
    half are left out. Sources may miss their targets: see `documents_by_targets`.
    """
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    return repeated(docs, mix(docs, weights, block, seed=seed).where("size > 0").select("row_key", copies.alias("copies")))
