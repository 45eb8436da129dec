"""Columns over file names and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaspark.functions import patterns as P


def nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def extension(filename: Column) -> Column:
    """Lower-cased text after the last dot of the last path component; empty without one or with a leading dot only."""
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"(?s)^.+\.([^.]*)$", 1))


def category(ext: Column) -> Column:
    out = F.when(ext.isin(P.VIDEO), "video").when(ext.isin(P.AUDIO), "audio").when(ext.isin(P.BOOK), "book")
    return out.when(ext.isin(P.SOFTWARE), "software").when(ext.isin(P.ARCHIVE), "archive").otherwise("other")


def human_size(size: Column) -> Column:
    """Bytes with one decimal, rounded half-even, in steps of 1024 up to PB."""
    value, out = size.cast("double"), None
    for unit in ("B", "KB", "MB", "GB", "TB"):
        shown = F.concat(F.bround(value, 1).cast("string"), F.lit(unit))
        out = F.when(value < 1024, shown) if out is None else out.when(value < 1024, shown)
        value = value / 1024
    return out.otherwise(F.concat(F.bround(value, 1).cast("string"), F.lit("PB")))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def archive_stem(name: Column) -> Column:
    """The name without the first of .tar.gz, .tar.xz, .tgz, .txz and .tar that it ends with."""
    return F.regexp_replace(name, r"\.(tar\.gz|tar\.xz|tgz|txz|tar)$", "")


def loader(path: Column) -> Column:
    """Which reader a path goes to by its extension, case-sensitive; anything else is a text."""
    return (F.when(path.rlike(r"\.torrent$"), "torrent").when(path.rlike(r"\.(zip|cbz|epub|jar|apk)$"), "zip")
            .when(path.rlike(r"\.(tar|tgz|txz)$|\.tar\.(gz|xz)$"), "tar").otherwise("text"))
