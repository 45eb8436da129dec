"""The first-match cascade: which medium a content record is.

A content record is a row of `content` (content_id, name); its files are rows of `files` (content_id, path,
filename, size). The files are folded into one row a record by a single aggregation that combines before its
shuffle; every rule is then a column over that row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.functions import patterns as P
from mediaspark.functions.files import category, directory, extension

#: A stage: its name and what it says of a row of profile(); null passes on to the next stage.
Stage = tuple[str, Callable[[], Column]]
RESULT = "struct<medium:string,confidence:string,source:string>"
LIBRARY_SCORES = {"high": 0.95, "medium": 0.7, "low": 0.3}
CLI_SCORES = {"high": 0.95, "medium": 0.75, "low": 0.50}


def result(medium: str, confidence: str, source: str) -> Column:
    return F.struct(F.lit(medium).alias("medium"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))


def profile(content: DataFrame, files: DataFrame) -> DataFrame:
    """content with one row a record: bytes of each category, hints, and the structure of its media files."""
    f = files.withColumn("_ext", extension(F.col("filename"))).withColumn("_cat", category(F.col("_ext")))
    size = lambda k: F.sum(F.when(F.col("_cat") == k, F.col("size")).otherwise(0)).alias(f"{k}_size")
    hint = lambda name, own: F.max(F.col("_ext").isin(own)).alias(f"has_{name}")
    video, audio = F.col("_ext").isin(P.MEDIA_VIDEO), F.col("_ext").isin(P.MEDIA_AUDIO)
    episode = F.col("filename").rlike(P.EPISODE) | F.col("path").rlike(P.EPISODE)
    one = f.groupBy("content_id").agg(
        F.count("*").alias("n_files"), F.sum("size").alias("total_size"), *[size(k) for k in ("video", "audio", "book", "software", "archive", "other")],
        hint("video", P.VIDEO), hint("audio", P.HINT_AUDIO), hint("book", P.BOOK), hint("software", P.HINT_SOFTWARE), hint("archive", P.HINT_ARCHIVE),
        F.count_if(video).alias("video_files"), F.count_if(audio).alias("audio_files"),
        F.min(F.when(video, directory(F.col("path")))).alias("_v0"), F.max(F.when(video, directory(F.col("path")))).alias("_v1"),
        F.min(F.when(audio, directory(F.col("path")))).alias("_a0"), F.max(F.when(audio, directory(F.col("path")))).alias("_a1"),
        F.coalesce(F.max(F.when(video, episode)), F.lit(False)).alias("has_episode"))
    rows = content.join(one, "content_id", "left")
    zeros = ["n_files", "total_size", "video_files", "audio_files", *[f"{k}_size" for k in ("video", "audio", "book", "software", "archive", "other")]]
    flags = ["has_video", "has_audio", "has_book", "has_software", "has_archive", "has_episode"]
    return rows.fillna(0, zeros).fillna(False, flags).select(
        "content_id", "name", *zeros, *flags, (F.col("_v0") == F.col("_v1")).alias("video_one_dir"), (F.col("_a0") == F.col("_a1")).alias("audio_one_dir"))


def extension_stage(threshold: float = 0.9) -> Stage:
    """A medium with that share of the bytes of known media; tested as video, audio, book, software. The threshold is held to 0.5 .. 1."""
    limit = min(1.0, max(0.5, threshold))

    def classify() -> Column:
        names = ("video", "audio", "book", "software")
        known = sum((F.col(f"{k}_size") for k in names[1:]), F.col("video_size"))
        out = None
        for k in names:
            ok = (F.col(f"{k}_size") > 0) & (F.col(f"{k}_size") / F.when(known > 0, known).otherwise(F.col("total_size")) >= limit)
            out = F.when(ok, result(k, "high", "extensions")) if out is None else out.when(ok, result(k, "high", "extensions"))
        return F.when(F.col("total_size") > 0, out)

    return "extensions", classify


def _pattern(medium: str, gate: Column | None, high: str, medium_pattern: str, supported: Column) -> Column:
    name = F.col("name")
    found = F.when(name.rlike(high), result(medium, "high", "patterns")).when(name.rlike(medium_pattern) & supported, result(medium, "medium", "patterns"))
    return found if gate is None else F.when(~gate, found)


def pattern_stage() -> Stage:
    def classify() -> Column:
        v, a, b, s, z = (F.col(f"has_{k}") for k in ("video", "audio", "book", "software", "archive"))
        return F.coalesce(
            _pattern("video", a & ~v, P.VIDEO_HIGH, P.VIDEO_MEDIUM, v | ~(a | b | s)),
            _pattern("audio", v & ~a, P.AUDIO_HIGH, P.AUDIO_MEDIUM, a | ~(v | b | s)),
            _pattern("software", (v | a) & ~s, P.SOFTWARE_HIGH, P.SOFTWARE_MEDIUM, s | z),
            _pattern("book", None, P.BOOK_HIGH, P.BOOK_MEDIUM, b | ~(v | a | s)))

    return "patterns", classify


class Cascade:
    """Stages in order; the first that is sure of a record decides, else it is other, low, fallback."""

    def __init__(self, stages: list[Stage] | None = None):
        self.stages = list(stages or [])

    def add_stage(self, stage: Stage) -> "Cascade":
        return Cascade([*self.stages, stage])

    @property
    def stage_count(self) -> int:
        return len(self.stages)

    def classify(self, profiles: DataFrame) -> DataFrame:
        """profiles with medium, confidence and source."""
        found = F.coalesce(*[classify() for _, classify in self.stages], result("other", "low", "fallback"))
        return profiles.withColumn("_r", found).select("*", "_r.medium", "_r.confidence", "_r.source").drop("_r")


def heuristics() -> Cascade:
    return Cascade([extension_stage(), pattern_stage()])


def subcategory(medium: Column) -> Column:
    """What the media files' number and directories make of audio and video."""

    def of(files: str, one_dir: str, single: Column | str, one: str, many: str) -> Column:
        single = F.lit(single) if isinstance(single, str) else single
        return F.when(F.col(files) == 0, "other").when(F.col(files) == 1, single).when(F.col(one_dir), one).otherwise(many)

    video = of("video_files", "video_one_dir", F.when(F.col("has_episode"), "episode").otherwise("movie"), "season", "series")
    audio = of("audio_files", "audio_one_dir", "track", "album", "collection")
    return F.when(medium == "video", video).when(medium == "audio", audio)


def score(confidence: Column, scores: dict[str, float]) -> Column:
    out = None
    for k, v in scores.items():
        out = F.when(confidence == k, v) if out is None else out.when(confidence == k, v)
    return out


def ranked_files(files: DataFrame, n: int = 3) -> DataFrame:
    """The n largest files of each record, by size, then path and filename."""
    from pyspark.sql import Window

    w = Window.partitionBy("content_id").orderBy(F.desc("size"), "path", "filename")
    return files.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
