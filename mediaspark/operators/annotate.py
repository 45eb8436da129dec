"""A record's whole annotation: what it is, how sure that is, its metadata and whether it is safe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.functions import text as T
from mediaspark.operators import cascade, model, safety

#: Of a name and a kind (medium/subcategory) a struct of title, artist and year.
Extractor = Callable[[Column, Column], Column]


def rule_extractor(name: Column, kind: Column) -> Column:
    """Metadata by rules alone: albums and tracks as the album rules split them, else the name without its year."""
    from mediaspark.functions.albums import album

    audio, plain = album(name), T.split_year(T.clean_name(name))
    of = lambda a, v: F.when(kind.startswith("audio/"), a).otherwise(v)
    none = F.lit(None).cast("string")
    return F.struct(of(audio["title"], plain["rest"]).alias("title"), of(audio["artist"], none).alias("artist"), of(audio["year"], plain["year"]).alias("year"))


def annotate(content: DataFrame, files: DataFrame, stages: cascade.Cascade | None = None, classifier: model.Model | None = None,
             extractor: Extractor | None = None, safety_stages: list[safety.SafetyStage] | None = None, with_safety: bool = True) -> DataFrame:
    """content_id, name, medium, subcategory (audio and video), confidence, source, metadata (audio and video), nsfw, nsfw_confidence, nsfw_source.

    stages: the rules, by default the heuristics; classifier: judges what they leave open; extractor: makes the
    metadata, none without one. An empty title counts as missing.
    """
    rows = (stages or cascade.heuristics()).classify(cascade.profile(content, files))
    if classifier is not None:
        rows = rows.drop("medium", "confidence", "source").join(model.with_model(rows, classifier).select("content_id", "medium", "confidence", "source"), "content_id")
    rows = rows.withColumn("subcategory", cascade.subcategory(F.col("medium"))).withColumn("confidence", cascade.score(F.col("confidence"), cascade.CLI_SCORES))
    meta = F.lit(None).cast("struct<title:string,artist:string,year:int>")
    if extractor is not None:
        got = extractor(F.col("name"), F.concat_ws("/", "medium", "subcategory"))
        full = F.struct(F.when(got["title"] != "", got["title"]).alias("title"), got["artist"].alias("artist"), got["year"].alias("year"))
        meta = F.when(F.col("subcategory").isNotNull(), full)
    rows = rows.select("content_id", "name", "medium", "subcategory", "confidence", "source", meta.alias("metadata"))
    if not with_safety:
        return rows
    said = safety.judge(content, files, safety_stages).select("content_id", "nsfw", F.col("confidence").alias("nsfw_confidence"), F.col("source").alias("nsfw_source"))
    return rows.join(said, "content_id", "left")


def as_json(annotated: DataFrame) -> DataFrame:
    """content_id and json: one object a record, fields without a value left out."""
    fields = [c for c in annotated.columns if c not in ("content_id", "name")]
    return annotated.select("content_id", F.to_json(F.struct(*fields)).alias("json"))


def classify_directly(content: DataFrame, files: DataFrame, classifier: model.Model, text: Column | None = None) -> DataFrame:
    """content_id, medium, confidence and subcategory by the model alone, without rules before it."""
    rows = cascade.Cascade().classify(cascade.profile(content, files))
    told = model.with_model(rows, classifier, text=text).select("content_id", "medium", "confidence")
    return rows.drop("medium", "confidence", "source").join(told, "content_id").select("content_id", "medium", "confidence", cascade.subcategory(F.col("medium")).alias("subcategory"))
