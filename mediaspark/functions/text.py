"""Normalisers and small parsers of names, answers and model outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaspark.functions import patterns as P
from mediaspark.functions.files import nullif_empty


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed a single time a row however often use reads it; columns that are built on columns double otherwise."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normal_title(c: Column) -> Column:
    """Lower case, no leading article, punctuation as spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), r"^(the|a|an)\s+", ""), r"[^\w\s]", " "))


def normal_album(c: Column) -> Column:
    """Lower case without edition notes and punctuation."""
    out = F.lower(c)
    for note in ("deluxe", "remastered", "expanded"):
        for a, b in ("()", "[]"):
            out = F.replace(out, F.lit(f"{a}{note}{b}"), F.lit(""))
    return squeeze(F.regexp_replace(out, r"[^\w\s]", " "))


def normal_value(c: Column) -> Column:
    """Lower case, dots and underscores as spaces; null is empty."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(F.coalesce(c.cast("string"), F.lit("")))), r"[._]+", " "), r"\s+", " ")


def normal_pair(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(c), r"[^\w\s]", ""))


def clean_name(c: Column) -> Column:
    """Without site tags and one media or archive extension at the end."""
    return strip(F.regexp_replace(F.regexp_replace(c, P.SITE_TAGS, ""), P.MEDIA_END, ""))


def year_in_name(c: Column) -> Column:
    return nullif_empty(F.regexp_extract(c, P.YEAR_IN_NAME, 1)).cast("int")


def split_year(c: Column) -> Column:
    """struct(year, rest): the first year 1900..2030 in round brackets, else in square ones, else between separators, and the text without it."""

    def found(c: Column) -> Column:
        forms = []
        for pattern in P.YEAR_FORMS:
            year = nullif_empty(F.regexp_extract(c, pattern, 2)).cast("int")
            rest = strip(F.concat(F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 3)))
            forms.append(once(year, lambda y: F.when(y.between(1900, 2030), F.struct(y.alias("year"), rest.alias("rest")))))
        return F.coalesce(*forms, F.struct(F.lit(None).cast("int").alias("year"), c.alias("rest")))

    return once(c, found)


def video_subtype(name: Column) -> Column:
    n = F.lower(name)
    out = F.when(n.rlike(r"s\d{1,2}e\d{1,2}") | n.rlike(r"\d{1,2}x\d{1,2}"), "video/episode")
    out = out.when(n.rlike(r"s\d{1,2}\s*-\s*s?\d{1,2}") | n.rlike(r"season\s*\d+\s*-\s*\d+"), "video/series")
    out = out.when(n.rlike(r"s\d{1,2}\.?complete") | n.rlike(r"season\s*\d+") | n.rlike(r"\.s\d{1,2}\."), "video/season")
    return out.otherwise("video/series")


def target_text(subtype: Column, title: Column, artist: Column, year: Column) -> Column:
    """The text that an extractor should answer; null where an artist is missing. A year of 0 and an empty artist count as missing."""
    has_year, has_artist = year.isNotNull() & (year != 0), artist.isNotNull() & (artist != "")
    bar, y = F.lit(" | "), year.cast("string")
    movie = F.when(has_year, F.concat(title, bar, y)).otherwise(title)
    audio = F.when(~has_artist, None).when(has_year, F.concat(title, bar, artist, bar, y)).otherwise(F.concat(title, bar, artist))
    return (F.when(subtype == "video/movie", movie).when(subtype.isin("video/episode", "video/season", "video/series"), title)
            .when(subtype.isin("audio/album", "audio/track"), audio))


def prompt(kind: Column, name: Column) -> Column:
    return F.concat(F.lit("<|im_start|>user\n<|extract|>["), kind, F.lit("] "), name, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def field_count(kind: Column) -> Column:
    """Fields of an answer for each kind of content; 3 for unknown kinds."""
    return (F.when(kind.isin("video/episode", "video/season", "video/series"), 1).when(kind.isin("video/movie", "video/other"), 2).otherwise(3))


def parse_answer(answer: Column, fields: Column, name: Column) -> Column:
    """struct(title, artist, year): the first fields between bars; a year must be four digits that the name holds."""
    parts = F.transform(F.slice(F.split(answer, r"\|"), 1, 3), strip)
    part = lambda k: F.when(fields > k, F.get(parts, F.lit(k)))
    said = F.when(fields == 2, part(1)).when(fields == 3, part(2))
    year = F.when(said.rlike(r"^[0-9]{4}$") & F.contains(name, said), said.cast("int"))
    return F.struct(F.coalesce(part(0), F.lit("")).alias("title"), F.when(fields == 3, part(1)).alias("artist"), year.alias("year"))


def label(answer: Column, classes: list[str], aliases: list[tuple[str, str]]) -> Column:
    """The class that a free answer stands for: itself, else the first alias in it, else the first class in it, else null."""
    a = strip(F.lower(answer))
    out = F.when(a.isin(classes), a)
    for key, value in [*aliases, *((c, c) for c in classes)]:
        out = out.when(F.contains(a, F.lit(key)), value)
    return out


def six_to_five(old: Column) -> Column:
    """A label of the older classes in the newer ones; null where it says nothing of the medium."""
    from mediaspark.functions.release import lookup

    o = strip(F.lower(old))
    return F.coalesce(lookup(P.SIX_TO_FIVE, o), F.when(o.isin(P.CLASSES5), o))


def video_metadata(name: Column) -> Column:
    """struct(type, title, year) of a name with a mark of video and none that speaks against it; else null."""
    year = nullif_empty(F.regexp_extract(name, r"\b(19[5-9]\d|20[0-2]\d)\b", 1))
    clean = F.regexp_replace(F.regexp_replace(name, r"\[.*?\]", " "), r"\(.*?\)", " ")
    clean = F.regexp_replace(clean, r"(?i)[.\s](1080p|720p|2160p|4k|bluray|bdrip|webrip|web-dl|hdtv|dvdrip|x264|x265|hevc).*$", "")
    cut = F.when(year.isNotNull(), F.regexp_replace(clean, F.concat(F.lit(r"[.\s]"), year, F.lit(r"[.\s]?.*$")), F.lit(""))).otherwise(clean)
    title = squeeze(F.regexp_replace(cut, r"[._]", " "))
    kind = F.when(name.rlike(r"(?i)s\d{1,2}e\d{1,2}|season|\d{1,2}x\d{1,2}"), "tv").otherwise("movie")
    ok = name.rlike(P.EXTRACTOR_VIDEO_MARKS) & ~name.rlike(P.SKIP) & (F.length(title) >= 2)
    return F.when(ok, F.struct(kind.alias("type"), title.alias("title"), year.cast("int").alias("year")))


def audio_metadata(name: Column) -> Column:
    """struct(artist, title, year) of a name with a mark of audio, split at its first ' - '; else null."""
    year = nullif_empty(F.regexp_extract(name, r"\b(19[5-9]\d|20[0-2]\d)\b", 1))
    clean = F.regexp_replace(F.regexp_replace(name, r"\[.*?\]", " "), r"\(.*?\)", " ")
    clean = F.regexp_replace(clean, r"(?i)[.\s](flac|mp3|320|aac|lossless|cd\s*rip|web).*$", "")
    clean = squeeze(F.regexp_replace(clean, r"[._]", " "))
    parts = F.split(clean, " - ", 2)
    artist, album = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    album = F.when(year.isNotNull(), F.trim(F.regexp_replace(album, F.concat(F.lit(r"\b"), year, F.lit(r"\b")), F.lit("")))).otherwise(album)
    ok = name.rlike(P.AUDIO_MARKS) & ~name.rlike(P.SKIP) & (F.length(artist) > 1) & (F.length(album) > 1)
    return F.when(ok, F.struct(artist.alias("artist"), album.alias("title"), year.cast("int").alias("year")))


def split_artist(n: Column, year: Column) -> Column:
    """struct(artist, title, year) of a text that is split at its first dash."""
    artist, title = (strip(nullif_empty(F.regexp_extract(n, P.ARTIST_TITLE, k))) for k in (1, 2))
    for pattern in P.TITLE_ENDS:
        title = F.regexp_replace(title, pattern, "")
    return F.struct(artist.alias("artist"), title.alias("title"), year.alias("year"))


def album_parts(name: Column) -> Column:
    """struct(artist, title, year) of an album's name by the basic rules: clean, take the year, drop formats, sources and groups, split at the first dash."""

    def parts(taken: Column) -> Column:
        n = taken["rest"]
        for pattern in P.ALBUM_NOISE:
            n = F.regexp_replace(n, pattern, "")
        return once(squeeze(n), lambda n: split_artist(n, taken["year"]))

    return once(split_year(clean_name(name)), parts)


def truncate_answer(answer: Column, fields: Column, name: Column) -> Column:
    """The first fields of an answer joined again, without years that the name doesn't hold."""
    parts = F.transform(F.slice(F.split(answer, r"\|"), F.lit(1), fields), strip)
    return F.array_join(F.filter(parts, lambda p: ~p.rlike(r"^[0-9]{4}$") | F.contains(name, p)), " | ")


def json_answer(answer: Column) -> Column:
    """The first JSON object that an answer holds, as text: the whole of it without its thoughts, a fenced block, or braces without nesting; else null."""
    clean = strip(F.regexp_replace(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""), r"(?s)<reasoning>.*?</reasoning>", ""))
    fenced = F.regexp_extract(clean, r"(?s)```(?:json)?\s*(\{[^`]*\})\s*```", 1)
    tries = [clean, fenced, F.regexp_extract(clean, r"(?s)(\{[^{}]*\})", 1), F.regexp_extract(answer, r"(?s)(\{[^{}]*\})", 1)]
    return F.coalesce(*[F.when(F.try_parse_json(t).isNotNull() & (t != ""), t) for t in tries])


def name_variants(name: Column) -> Column:
    """The distinct variants of an artist's name that differ from it: case, article, punctuation, and and &."""
    low = F.lower(name)
    forms = [F.upper(name), low, F.initcap(name), F.when(low.startswith("the "), F.substring(name, 5, 1 << 20)).otherwise(F.concat(F.lit("The "), name)),
             F.regexp_replace(name, r"['\-.]", ""), F.replace(name, F.lit("&"), F.lit("and")), F.when(F.contains(low, F.lit(" and ")), F.regexp_replace(name, r"(?i)\band\b", "&"))]
    return F.array_sort(F.array_distinct(F.filter(F.array(*forms), lambda v: v.isNotNull() & (v != name))))


def label_json(kind: Column, title: Column, artist: Column, year: Column) -> Column:
    """The label of a match as JSON; years of 0 and empty artists are left out, other kinds are null."""
    y, a = F.when(year != 0, year).alias("year"), F.when(artist != "", artist).alias("artist")
    movie = F.to_json(F.struct(F.lit("video/movie").alias("type"), title.alias("title"), y))
    series = F.to_json(F.struct(F.lit("video/series").alias("type"), title.alias("series_title"), y))
    album = F.to_json(F.struct(F.lit("audio/album").alias("type"), title.alias("album_name"), a, y))
    return F.when(kind == "movie", movie).when(kind == "tv", series).when(kind == "album", album)
