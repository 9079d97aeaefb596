"""Column types of delimited text, found from all of its rows.

One aggregate counts, per column, the values that are present and those that read as a truth value, as a whole number and as a number; counts
from tasks add up, so the narrowest type that fits all rows is found without a sample. The text is then read once more with that schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Texts that stand for a missing value, beside the empty one.
MISSING = ("?", "NA", "N/A", "NaN", "nan", "null", "NULL", "None")
_WHOLE = r"^[+-]?[0-9]{1,19}$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: From narrow to wide; a column without values takes the last.
KINDS = ("boolean", "bigint", "double", "string")


def _value(column: str, missing: Sequence[str]) -> Column:
    """A trimmed text, or null where it stands for a missing value."""
    text = F.trim(F.col(column))
    return F.when((text != "") & ~text.isin(*missing), text)


def _tests(value: Column) -> dict[str, Column]:
    return {
        "boolean": F.lower(value).isin("true", "false"),
        "bigint": value.rlike(_WHOLE) & value.try_cast("bigint").isNotNull(),
        "double": value.rlike(_NUMBER),
    }


def _kinds(row: Row, columns: Sequence[str]) -> list[str]:
    fits = [[k for k in KINDS[:-1] if row[f"{c}|n"] and row[f"{c}|{k}"] == row[f"{c}|n"]] for c in columns]
    return [f[0] if f else KINDS[-1] for f in fits]


def _counts(columns: Sequence[str], missing: Sequence[str]) -> list[Column]:
    out = []
    for c in columns:
        value = _value(c, missing)
        out += [F.count(value).alias(f"{c}|n"), *[F.count_if(test).alias(f"{c}|{k}") for k, test in _tests(value).items()]]
    return out


def infer(
    spark: SparkSession, path: str, sep: str = ",", header: bool | None = None, missing: Sequence[str] = MISSING, comment: str | None = None
) -> tuple[list[tuple[str, str]], bool]:
    """(name, type) of each column, and whether files begin with names.

    With ``header`` None the first line counts as names if they differ from each other, none is missing or a number, and some column is narrower than text without them.
    """
    reader = spark.read.option("header", False).option("sep", sep)
    text = (reader.option("comment", comment) if comment else reader).csv(path)
    first = text.head(1)
    columns = text.columns
    if not first:
        return [], False
    names = [v.strip() if v is not None else "" for v in first[0]]
    # every file may begin with the names
    is_first = F.lit(True)
    for c, v in zip(columns, first[0], strict=True):
        is_first = is_first & F.col(c).eqNullSafe(F.lit(v))
    body = _kinds(text.where(~is_first).agg(*_counts(columns, missing)).first(), columns)
    if header is None:
        alone = spark.createDataFrame([tuple(names)], ", ".join(f"{c} string" for c in columns)).agg(*_counts(columns, missing)).first()
        named = len(set(names)) == len(names) and all(alone[f"{c}|n"] and not alone[f"{c}|double"] for c in columns)
        header = named and any(k != KINDS[-1] for k in body)
    if header:
        return list(zip(names, body, strict=True)), True
    whole = _kinds(text.agg(*_counts(columns, missing)).first(), columns)
    return list(zip(columns, whole, strict=True)), False


def read_inferred(
    spark: SparkSession, path: str, sep: str = ",", header: bool | None = None, missing: Sequence[str] = MISSING, comment: str | None = None
) -> DataFrame:
    """Delimited text as a table of the narrowest types that hold all rows; missing texts are null."""
    found, named = infer(spark, path, sep, header, missing, comment)
    reader = spark.read.option("header", named).option("sep", sep).schema(", ".join(f"`{n}` string" for n, _ in found))
    rows = (reader.option("comment", comment) if comment else reader).csv(path)
    return rows.select(*[_value(f"`{n}`", missing).cast(k).alias(n) for n, k in found])
