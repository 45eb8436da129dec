"""Text sources: JSON lines, lossy bytes, and reports in sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a line; lines that aren't objects of the schema are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines, letters of all scripts as they are, nulls left out."""
    rows.write.json(path)


def lossy_text(raw: Column) -> Column:
    """Bytes as text, what isn't UTF-8 replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def strict_text(raw: Column) -> Column:
    """Bytes as text, null where they aren't UTF-8."""
    return F.try_validate_utf8(raw.cast("string"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(number, body) of the '### Sample N' sections of Markdown reports, each file read whole."""
    text = spark.read.text(path, wholetext=True)
    parts = F.regexp_extract_all("value", F.lit(r"(?sm)^### Sample (\d+.*?)(?=^### Sample |\z)"), F.lit(1))
    part = text.select(F.explode(parts).alias("p"))
    return part.select(F.regexp_extract("p", r"^(\d+)", 1).cast("int").alias("number"), F.regexp_replace("p", r"^\d+[^\n]*\n?|\s+$", "").alias("body"))
