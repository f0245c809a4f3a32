"""Facts about Spark's own schemas and SQL texts; Spark's analyser answers, nothing is run."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DIAGNOSTIC = "line int, col int, code string, message string"
MEMBER = "path string, name string, type string, optional boolean, ord int"


def line_and_column(text: str, offset: int) -> tuple[int, int]:
    """From 1; columns in UTF-16 units."""
    before = text[:offset]
    begin = before.rfind("\n") + 1
    return before.count("\n") + 1, len(before[begin:].encode("utf-16-le")) // 2 + 1


def check_snippet(spark: SparkSession, code: str) -> list[tuple[int, int, str, str]]:
    """Line, column, code and message of what is wrong with a SQL text; empty if it is valid."""
    try:
        spark.sql(code).schema  # noqa: B018  analysis only
    except (ParseException, AnalysisException) as e:
        context = [c for c in e.getQueryContext() or [] if c.startIndex() >= 0]
        line, col = line_and_column(code, context[0].startIndex()) if context else (1, 1)
        return [(line, col, e.getCondition() or "UNKNOWN", str(e).split("\n")[0])]
    return []


def eval_type(expression: str) -> dict[str, str | None]:
    """The type that a DDL expression means, short and expanded, or an error."""
    if not expression.strip():
        return {"result": None, "expanded": None, "error": "empty expression"}
    try:
        kind = T.DataType.fromDDL(expression.strip())
    except PySparkException as e:
        return {"result": None, "expanded": None, "error": str(e).split("\n")[0]}
    return {"result": kind.simpleString(), "expanded": kind.json(), "error": None}


def members(kind: T.DataType, path: str = "") -> Iterator[tuple[str, str, str, bool, int]]:
    """All fields of a type, those of nested types after their own: path, name, type, optional, ord."""
    if isinstance(kind, T.ArrayType):
        yield from members(kind.elementType, f"{path}[]")
    elif isinstance(kind, T.MapType):
        yield from members(kind.valueType, f"{path}{{}}")
    elif isinstance(kind, T.StructType):
        for i, f in enumerate(kind.fields):
            own = f"{path}.{f.name}" if path else f.name
            yield own, f.name, f.dataType.simpleString(), f.nullable, i
            yield from members(f.dataType, own)


#: The numeric types in the order in which each fits into the next.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def assignable(source: T.DataType, target: T.DataType) -> bool:
    """Whether values of one type can stand in for the other: structs by their fields,
    where the source may have more, and numbers if none can lose its size."""
    if isinstance(target, T.StructType):
        if not isinstance(source, T.StructType):
            return False
        own = {f.name: f for f in source.fields}
        return all(
            (f.nullable if f.name not in own else assignable(own[f.name].dataType, f.dataType) and (f.nullable or not own[f.name].nullable)) for f in target.fields
        )
    if isinstance(target, T.ArrayType):
        return isinstance(source, T.ArrayType) and assignable(source.elementType, target.elementType) and (target.containsNull or not source.containsNull)
    if isinstance(target, T.MapType):
        return isinstance(source, T.MapType) and assignable(source.keyType, target.keyType) and assignable(source.valueType, target.valueType)
    a, b = source.simpleString(), target.simpleString()
    return a == b or (a in NUMBERS and b in NUMBERS and NUMBERS.index(a) <= NUMBERS.index(b))


def catalog_members(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Members of the schemas of tables: type_id and the columns of `members`."""
    rows = [(name, *m) for name, df in sorted(tables.items()) for m in members(df.schema)]
    return spark.createDataFrame(rows, f"type_id string, {MEMBER}")
