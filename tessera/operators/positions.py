"""Lines, positions and renaming in source texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions.text import masked, whole_word


#: Files whose lines are made together, and characters of a cell of a file.
TOGETHER, CELL = 64, 4096


def lines(files: DataFrame) -> DataFrame:
    """Lines of all files: file, line (from 1), start (offset of the first character), text.

    Every task splits its own files in time linear in their length; nothing is shuffled.
    """
    schema = T.StructType([files.schema["file"], *T.StructType.fromDDL("line long, start long, text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), TOGETHER):
                part = b.slice(k, TOGETHER)
                split = [(t.as_py() or "").split("\n") for t in part.column(1)]
                counts = np.array([len(x) for x in split])
                sizes = [np.fromiter(map(len, x), np.int64, len(x)) + 1 for x in split]
                starts = np.concatenate([np.cumsum(x) - x for x in sizes])
                texts = pa.array([x.removesuffix("\r") for xs in split for x in xs], pa.string())
                numbers = np.concatenate([np.arange(1, n + 1) for n in counts])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(part)), counts))), pa.array(numbers), pa.array(starts), texts], schema.names)

    return files.select("file", "text").where("text is not null").mapInArrow(run, schema)


def line_of(offsets: DataFrame, lines: DataFrame) -> DataFrame:
    """Line and column, from 1, of offsets in files: an interval join by cells of a file.

    A line is in the cells that it reaches into, an offset in its own, so that
    an offset meets the lines of one cell and not those of the file.
    """
    ends = lines.select("file", "line", "start", (F.col("start") + F.length("text")).alias("end"))
    ends = ends.select("*", F.explode(F.sequence(F.expr(f"start div {CELL}L"), F.expr(f"end div {CELL}L"))).alias("__cell"))
    found = offsets.withColumn("__cell", F.expr(f"offset div {CELL}L")).join(ends, ["file", "__cell"]).where("offset >= start and offset <= end")
    return found.select(*offsets.columns, "line", (F.col("offset") - F.col("start") + 1).cast("long").alias("col"))


#: The sizes of cells for nodes, as powers of two.
LEVELS = range(6, 42, 3)


def level_of(length: Column) -> Column:
    """The least size of cells that holds a length; it never falls as lengths rise."""
    level = F.lit(LEVELS[-1])
    for k in reversed(LEVELS):
        level = F.when(length < (1 << k), F.lit(k)).otherwise(level)
    return level


def in_cells(nodes: DataFrame) -> DataFrame:
    """Nodes with the cells that they reach into, two at most, of the least size that holds their length."""
    level = level_of(F.col("end") - F.col("pos"))
    at = lambda place: F.call_function("shiftright", F.col(place), F.col("__level"))
    return nodes.withColumn("__level", level).select("*", F.explode(F.sequence(at("pos"), at("end"))).alias("__cell"))


def look_ups(asked: DataFrame, sizes: list[int]) -> DataFrame:
    """file, node_id, pos, end and the cells of those sizes, none less than its own, that each node begins in."""
    own = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda k: k >= level_of(F.col("end") - F.col("pos")))
    return asked.select("file", "node_id", "pos", "end", F.explode(own).alias("__level")).withColumn("__cell", F.call_function("shiftright", F.col("pos"), F.col("__level")))


def ancestor_of_kind(nodes: DataFrame, asked: DataFrame, kinds: list[str]) -> DataFrame:
    """The innermost node of one of the kinds that holds each asked node and isn't the node itself.

    nodes: file, node_id, pos, end (both included), kind. asked: file, node_id,
    pos, end. Returns file, node_id, ancestor; null where no node of the kinds
    is around. Of nodes with one extent, the one of the least node_id is outer.
    Nodes nest or are apart, so that what holds a node's begin and reaches as
    far as its end holds it; they meet in the cells of the begin alone. What
    holds a node is no shorter, so that a node looks into cells of its own size
    and more, and of those only into sizes that nodes of the kinds have.
    """
    sizes = sorted(r[0] for r in nodes.where(F.col("kind").isin(kinds)).select(level_of(F.col("end") - F.col("pos"))).distinct().collect())
    outer = in_cells(nodes.where(F.col("kind").isin(kinds))).select("file", F.col("node_id").alias("ancestor"), F.col("pos").alias("__pos"), F.col("end").alias("__end"), "__level", "__cell")
    looks = look_ups(asked, sizes)
    same = (F.col("__pos") == F.col("pos")) & (F.col("__end") == F.col("end"))
    met = looks.join(outer, ["file", "__level", "__cell"]).where("__pos <= pos and end <= __end").where(~same | (F.col("ancestor") < F.col("node_id")))
    inner = met.groupBy("file", "node_id").agg(F.max_by("ancestor", F.struct(F.col("__pos") - F.col("__end"), "ancestor")).alias("ancestor"))
    return asked.select("file", "node_id").join(inner, ["file", "node_id"], "left")


def node_at(offsets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The innermost node at each offset: file, offset, node_id.

    nodes: file, node_id, pos, end (both included) and path, the ordinals of
    its ancestors and itself. Where two children touch, the later one wins, at
    every level: the greatest path in the order of arrays.

    A node is in the cells it reaches into, two at most, of the least size that
    holds its length. An offset looks into one cell of each size.
    """
    held, at = in_cells(nodes), lambda place: F.call_function("shiftright", F.col(place), F.col("__level"))
    asked = offsets.select("file", "offset", F.explode(F.array(*map(F.lit, LEVELS))).alias("__level")).withColumn("__cell", at("offset"))
    found = asked.join(held, ["file", "__level", "__cell"]).where("pos <= offset and offset <= end")
    return found.groupBy("file", "offset").agg(F.max_by("node_id", "path").alias("node_id"))


def code_lines(files: DataFrame) -> DataFrame:
    """`lines` with blanks in place of comments and strings."""
    return lines(files.withColumn("text", masked(F.col("text"))))


def rename_sites(files: DataFrame, old: str, new: str) -> DataFrame:
    """`rename_preview` of the lines that have `old` outside of comments and strings."""
    code = code_lines(files).where(F.col("text").rlike(whole_word(old))).select("file", "line")
    return rename_preview(lines(files).join(code, ["file", "line"], "left_semi"), old, new)


def rename_preview(lines: DataFrame, old: str, new: str, limit: int | None = None) -> DataFrame:
    """Lines with the word `old`, before and after renaming, in order of file and line."""
    word = whole_word(old)
    hits = lines.where(F.col("text").rlike(word))
    after = F.regexp_replace(F.trim("text"), word, new.replace("$", r"\$"))
    out = hits.select("file", "line", F.trim("text").alias("before"), after.alias("after"))
    return out if limit is None else out.orderBy("file", "line").limit(limit)


def text_hits(texts: DataFrame, affected: DataFrame, old: str, most: int | None = 20) -> DataFrame:
    """Strings and comments of affected files that have the word: at most `most` in order, or all."""
    hits = texts.join(affected.select("file").distinct(), "file", "left_semi").where(F.col("text").rlike(whole_word(old)))
    return hits if most is None else hits.orderBy("file", "line").limit(most)


def rename_summary(sites: DataFrame, notes: DataFrame) -> DataFrame:
    """Totals over all sites and notes, and what they say: one row.

    sites: file, line, is_declaration_file.
    """
    errors = F.count_if("is_declaration_file")
    s = sites.agg(F.count("*").alias("n_sites"), F.countDistinct("file").alias("n_files"), errors.alias("n_errors"))
    n = notes.agg(F.count("*").alias("n_notes"))
    high = F.when(F.col("n_errors") == 0, "high").otherwise("low")
    return s.crossJoin(n).select("*", high.alias("confidence"), ((F.col("n_errors") == 0) & (F.col("n_notes") == 0)).alias("safe"))


def capped(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= most)
