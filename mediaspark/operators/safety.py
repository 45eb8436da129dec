"""The content-safety cascade: keywords, then patterns, over a record's name and file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.functions import patterns as P
from mediaspark.operators.model import softmax


def tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def has_keyword(text: Column) -> Column:
    """Whether a whole word of the text is on the list; a listed word with a hyphen is never one token."""
    return F.coalesce(F.arrays_overlap(tokens(text), F.array(*map(F.lit, P.UNSAFE_WORDS))), F.lit(False))


def has_pattern(text: Column) -> Column:
    out = F.lit(False)
    for p in P.UNSAFE_PATTERNS:
        out = out | text.rlike(p)
    return F.coalesce(out, F.lit(False))


#: (name, score, test of a text, whether it is a model). A stage is sure of a record if its test holds for the name or for a file name.
SafetyStage = tuple[str, float, Callable[[Column], Column], bool]


def heuristics() -> list[SafetyStage]:
    return [("keywords", 0.95, has_keyword, False), ("patterns", 0.90, has_pattern, False)]


def model_stage(logits: Callable[[Column], Column], score: float = 0.9) -> SafetyStage:
    """A stage of a model that makes logits of a text."""
    return "ml", score, lambda text: from_logits(logits(text))["nsfw"], True


def has_model_stage(stages: list[SafetyStage]) -> bool:
    return any(is_model for *_, is_model in stages)


def from_logits(logits: Column) -> Column:
    """struct(nsfw, confidence) of a model's logits: of two the second must be more probable, the winner's probability counts; one is a probability, unsafe above a half; none is safe with a half."""
    p = softmax(logits)
    first, second, one = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(logits, F.lit(0)).cast("double")
    nsfw = F.when(F.size(logits) >= 2, second > first).when(F.size(logits) == 1, one > 0.5).otherwise(False)
    sure = F.when(F.size(logits) >= 2, F.greatest(first, second)).when(F.size(logits) == 1, F.greatest(one, 1 - one)).otherwise(0.5)
    return F.struct(nsfw.alias("nsfw"), sure.alias("confidence"))


def judge(content: DataFrame, files: DataFrame, stages: list[SafetyStage] | None = None) -> DataFrame:
    """content_id, nsfw, confidence and source: those of the first stage that is sure, by default keywords 0.95 and patterns 0.90; else safe with 0.5, as the model stage says without a model."""
    stages = heuristics() if stages is None else stages
    marks = files.groupBy("content_id").agg(F.lit(1).alias("_"), *[F.max(test(F.col("filename"))).alias(f"_{k}") for k, (_, _, test, _) in enumerate(stages)])
    rows = content.join(marks, "content_id", "left")
    confidence, source, nsfw = F.lit(0.5), F.lit("ml"), F.lit(False)
    for k, (name, score, test, _) in reversed(list(enumerate(stages))):
        sure = F.coalesce(test(F.col("name")), F.lit(False)) | F.coalesce(F.col(f"_{k}"), F.lit(False))
        nsfw, confidence, source = sure | nsfw, F.when(sure, score).otherwise(confidence), F.when(sure, name).otherwise(source)
    return rows.select("content_id", nsfw.alias("nsfw"), confidence.alias("confidence"), source.alias("source"))


def judge_text(text: Column) -> Column:
    return has_keyword(text) | has_pattern(text)
