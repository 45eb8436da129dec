"""The release-name parser: one column each of a release name."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaspark.functions import patterns as P
from mediaspark.functions.files import nullif_empty


def lookup(table: dict, key: Column) -> Column:
    """The table's value of a key, or null."""
    return F.element_at(F.create_map(*map(F.lit, chain(*table.items()))), key)


def _first(name: Column, pattern: str, group: int = 1) -> Column:
    return nullif_empty(F.regexp_extract(name, pattern, group))


def resolution(name: Column) -> Column:
    return lookup(P.RESOLUTIONS, F.upper(_first(name, P.RESOLUTION)))


def video_codec(name: Column) -> Column:
    return lookup(P.VIDEO_CODECS, F.replace(F.upper(_first(name, P.VIDEO_CODEC)), F.lit("."), F.lit("")))


def audio_codec(name: Column) -> Column:
    found = F.upper(_first(name, P.AUDIO_CODEC))
    return F.when(found.startswith("DTS-HD"), "DtsHd").otherwise(lookup(P.AUDIO_CODECS, found))


def bitrate(name: Column) -> Column:
    return _first(name, P.BITRATE).cast("int")


def vbr(name: Column) -> Column:
    return F.upper(_first(name, P.VBR))


def quality(name: Column) -> Column:
    return lookup(P.QUALITIES, F.replace(F.upper(_first(name, P.QUALITY)), F.lit("-"), F.lit("")))


def quality_rank(name: Column) -> Column:
    return lookup(P.QUALITY_RANKS, quality(name))


def container(name: Column) -> Column:
    return F.upper(_first(name, P.CONTAINER))


def season(name: Column) -> Column:
    return F.coalesce(_first(name, P.SEASON_EPISODE), _first(name, P.SEASON)).cast("int")


def episode(name: Column) -> Column:
    return _first(name, P.SEASON_EPISODE, 2).cast("int")


def _languages(name: Column, pattern: str) -> Column:
    """The languages of all matches, in order, each once."""
    codes = F.regexp_extract_all(name, F.lit(pattern), F.lit(1))
    known = F.transform(codes, lambda c: lookup(P.LANGUAGES, F.upper(c)))
    return F.array_distinct(F.filter(known, lambda x: x.isNotNull()))


def original_with_subtitles(name: Column) -> Column:
    return F.contains(F.upper(name), F.lit("VOSTFR"))


def audio_languages(name: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(original_with_subtitles(name), none).otherwise(_languages(name, P.LANGUAGE))


def subtitle_languages(name: Column) -> Column:
    return F.when(original_with_subtitles(name), F.array(F.lit("French"))).otherwise(_languages(name, P.SUBTITLE_LANGUAGE))


def hardcoded(name: Column) -> Column:
    return name.rlike(P.HARDCODED)


def forced(name: Column) -> Column:
    return name.rlike(P.FORCED)


def parsed(name: Column) -> Column:
    """All fields of a release name as a struct."""
    language = F.struct(audio_languages(name).alias("audio"), subtitle_languages(name).alias("subtitles"), hardcoded(name).alias("hardcoded_subs"), forced(name).alias("forced"))
    return F.struct(
        resolution(name).alias("resolution"), video_codec(name).alias("video_codec"), audio_codec(name).alias("audio_codec"), quality(name).alias("quality_tier"),
        container(name).alias("container"), season(name).alias("season"), episode(name).alias("episode"), language.alias("language"),
        bitrate(name).alias("audio_bitrate_kbps"), vbr(name).alias("audio_vbr_quality"))
