"""Writing results: Parquet, JSON lines, CSV with fixed columns, Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as text: nested values as JSON, null as empty; columns that *df* lacks are empty."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def cell(c: str):
        if c not in types:
            return F.lit("").alias(c)
        value = F.to_json(F.col(f"`{c}`")) if isinstance(types[c], (ArrayType, MapType, StructType)) else F.col(f"`{c}`").cast("string")
        return F.coalesce(value, F.lit("")).alias(c)

    return df.select(*[cell(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    flat(df, columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, spread: int = 16) -> None:
    """Write a table; rows of a partition value are spread over at most *spread* tasks by their content first, so that a hot
    value has several files and a task doesn't write to all values."""
    if partition_by:
        salt = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]), F.lit(spread))
        df = df.repartition(*[F.col(f"`{c}`") for c in partition_by], salt)
        df.write.mode("overwrite").partitionBy(*partition_by).option("maxRecordsPerFile", 5_000_000).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """Append rows to a ledger. Readers take the last row of a key (see operators.features.last_rows)."""
    df.write.mode("append").parquet(path)


def markdown_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row of a Markdown table for each row: pipes escaped, line breaks as blanks (``line``)."""
    cells = [F.regexp_replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", " ") for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
