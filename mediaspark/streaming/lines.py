"""Lines of JSON arrays of names, classified as a batch or as a stream: one JSON array of results a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.functions import patterns as P
from mediaspark.operators.safety import judge_text


def by_name(name: Column) -> Column:
    """What the pattern rules say of a name without files, as a struct; fallback where they say nothing."""
    out = None
    for medium, high, low in (("video", P.VIDEO_HIGH, P.VIDEO_MEDIUM), ("audio", P.AUDIO_HIGH, P.AUDIO_MEDIUM), ("software", P.SOFTWARE_HIGH, None), ("book", P.BOOK_HIGH, P.BOOK_MEDIUM)):
        for pattern, confidence in ((high, "high"), (low, "medium")):
            if pattern is not None:
                one = F.struct(F.lit(medium).alias("medium"), F.lit(confidence).alias("confidence"), F.lit("patterns").alias("source"))
                out = F.when(name.rlike(pattern), one) if out is None else out.when(name.rlike(pattern), one)
    return out.otherwise(F.struct(F.lit("other").alias("medium"), F.lit("low").alias("confidence"), F.lit("fallback").alias("source")))


def classify_lines(lines: DataFrame) -> DataFrame:
    """lines (value) -> results, a JSON array in the order of the names; lines that aren't arrays of strings go. Stateless, so it runs on streams in append mode."""
    names = F.from_json("value", "array<string>")
    rows = lines.select(names.alias("names")).filter(F.col("names").isNotNull())
    result = F.transform("names", lambda n: F.struct(n.alias("name"), by_name(n).alias("result"), judge_text(n).alias("nsfw")))
    flat = F.transform(result, lambda r: F.struct(r["name"].alias("name"), r["result"]["medium"].alias("medium"), r["result"]["confidence"].alias("confidence"), r["result"]["source"].alias("source"), r["nsfw"].alias("nsfw")))
    return rows.select(F.to_json(flat).alias("results"))
