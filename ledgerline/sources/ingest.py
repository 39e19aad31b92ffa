"""Text records of outside origin: parsed against a schema, with bad rows kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def _with_bad(schema: str) -> str:
    return f"{schema}, {BAD} string"


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV files by schema (no inference); what doesn't parse is in _corrupt_record."""
    return spark.read.schema(_with_bad(schema)).csv(path, header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by schema; what doesn't parse is in _corrupt_record."""
    return spark.read.schema(_with_bad(schema)).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD)


def csv_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """`lines` with the fields of a CSV line each beside it, and the line itself where it doesn't parse."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    return lines.withColumn("_row", F.from_csv(column, _with_bad(schema), options)).select("*", "_row.*").drop("_row")


def json_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """As csv_lines, for JSON objects."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    return lines.withColumn("_row", F.from_json(column, _with_bad(schema), options)).select("*", "_row.*").drop("_row")


def split_bad(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed, and those that didn't."""
    return rows.where(F.col(BAD).isNull()).drop(BAD), rows.where(F.col(BAD).isNotNull())


def required(rows: DataFrame, *columns: str) -> Column:
    """Whether a row lacks one of the columns that it has to have."""
    lacks = F.lit(False)
    for c in columns:
        lacks = lacks | F.col(c).isNull()
        if isinstance(rows.schema[c].dataType, T.StringType):
            lacks = lacks | (F.trim(c) == "")
    return lacks
