"""Artist, title and year of an album's name, in the versions of its rules.

A version is a list of steps: what is taken off before the year is looked for, the forms of the year, and what is
taken off after it. The rest is split at its first dash. Version 5 knows one more form, which names the title first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaspark.functions import patterns as P
from mediaspark.functions import text as T
from mediaspark.functions.files import nullif_empty

LATEST = 5

# Patterns and word lists of the versions.
EMOJI = "[⭐️🎵🎶🔥💿📀😎]+"
EMOJI_5 = "[⭐️🎵🎶🔥💿📀😎♪]+"
SITE = r"(?i)^\s*\[[^\]]*(?:\.com|\.org|\.net|\.info|torrents?)[^\]]*\]\s*"
GENRE = r"(?i)^\s*\([^)]*(?:R&B|Soul|Hip[- ]?Hop|Rap|Pop|Rock|Jazz|Blues|Metal|Punk|Electronic)\s*[^)]*\)\s*"
ORDINAL = r"(?i)\s*\d+(?:st|nd|rd|th)\s+(?:solo\s+)?album\s*"
CATALOGUE = r"(?i)\{[^}]*(?:Records|Label|Republic|Capitol|\d{10,})[^}]*\}"
#: (pattern, least year, most): a full date, a catalogue number, a genre.
YEAR_MORE = [
    (r"\[(\d{4})[.\-]\d{2}[.\-]\d{2}\]", 0, 9999),
    (r"\[(\d{4})\s*[-–]\s*\d+\]", 1900, 2030),
    (r"(?i)\((\d{4})\s+(?:(?:Pop|Rock|Hip\s*Hop|Rap|Jazz|Blues|Country|Metal|Punk|R&B|Soul|Electronic|Dance|Classical|Indie|Alternative|Folk)[A-Za-z\s]*)\)", 1900, 2030),
]
EDITIONS = [r"00XO\s+Edition", r"Exclusive\s+\d+\s+Track\s+[A-Za-z\s]+", r"Target\s+Exclusive", r"Store\s+Exclusive", r"Dolby\s+Atmos(?:\s+Edition)?", r"with\s+[^)]+", r"by\s+\w+"]
GROUPS = """EICHBAUM MyDad Sc4r3cr0w PMEDIA MiRCrew GloDLS HANNIBAL SilverRG NimitMak Michi80 PERFECT ETRG JLM FLAC WEB ETTV CD MT TBS RNS MIXFIEND EAC FNT MFA HHI CR HB C4
MOD ESC P2P VAG MARR FLAWL3SS TX OMA XRIP BPM ENRiCH 401 sn3hdj3 Hunter FTD DGN ePHEMERiD JUST ENRAGED CDS 2CD ADVANCE RETAIL CLEAN REMASTER ALAC INT SHADOW TOBLERONE FAF IDN CREW""".split()
_GROUP = r"(?i)[\-_]\s*(?:" + "|".join(GROUPS) + r")$"
FORMATS_3 = [
    r"\[.*?\]",
    r"(?i)\((?:FLAC|MP3|AAC|OGG|WAV|320|256|192|V0|24[\-_]?(?:44|48|96|192)|16[\-_]?44).*?\)",
    r"(?i)\(Explicit\)",
    r"(?i)\((?:Big\s*Papi|ETTV|PMEDIA)\)",
    r"(?i)\s+(?:NimitMak|SilverRG|Big\s*Papi)\s*(?:NimitMak|SilverRG|Big\s*Papi)*\s*$",
    r"(?i)(?:FLAC|MP3|AAC|WEB|CD|VINYL|LP|CD-?RIP|WEB-?DL|WEB-?FLAC)\b",
    r"(?i)@?\b(?:320|256|192|V0)\s*(?:kbps|cbr|vbr)?\b",
    r"\b(?:24|16)[\-_]?(?:44|48|96|192)\b",
    r"(?i)\b(?:24Bit|16Bit|16BITS|24BITS)[-_]?\d*k?Hz?\b",
    r"(?i)\b\d+\.?\d*\s*k?Hz\b",
    r"(?i)\bHi-?Res\b",
]
BEATS = r"(?i)\s+Beats\s*$"
ENDS_3 = [
    r"(?i)[-_](?:WEB|CD|VINYL|LP)[-_]?(?:[A-Z]{2,3})?[-_]?(?:FLAC|MP3)?$",
    r"(?i)[-_](?:ES|US|UK|DE|FR|JP|KR)$",
    r"(?i)[-_](?:FLAC|WEB|CD|MP3|AAC|ADVANCE|RETAIL|2CD)[A-Z0-9]{2,8}$",
    r"(?i)[-_]2?CD[A-Z]{2,6}$",
    r"[-_](?:ES|US|UK|DE|FR|JP|KR|EN|IT|NL|PT|PL|RU|SE|NO|DK|FI)[A-Z0-9]{2,8}$",
    r"[-_\s]+(?:MFSL|Capitol\s+SO)[A-Z0-9\-]+$",
    r"\s+SO-\d+$",
    r"\s+[A-Z0-9]+-\d{1,3}$",
    r"[-_]\d{4}$",
    r"\s*[\-_]+\s*$",
    r"^\s*[\-_]+\s*",
]
TITLE_FIRST = r"(?i)^\s*\[(\d{4})\]\s*(.+?)\s*[-–—]\s*(.+?)\s*[-–—]?\s*(?:\d+\s*(?:mb|gb)\s*)?@\s*\d+"
ARTIST_ENDS_5 = [r"\s*[-–—]\s*$", r"(?i)\s*\d+\s*(?:mb|gb|kb)\b.*$"]
# End of the fixed values.

_EDITION = r"(?i)\((?:" + "|".join(EDITIONS) + r")\)"


def _after(beats: bool) -> list[tuple[str, str]]:
    taken = [*FORMATS_3, *([BEATS] if beats else []), _EDITION]
    return [*((p, "") for p in taken), (r"[-_]{2,}", "-"), *[(_GROUP, "")] * 3, *((p, "") for p in ENDS_3)]


_PLAIN = [(p, "") for p in P.ALBUM_NOISE]
#: For each version: (pattern, replacement) before the year, further forms of the year, (pattern, replacement) after it.
STEPS = {
    1: ([], [], _PLAIN),
    2: ([(EMOJI, "")], YEAR_MORE, _PLAIN),
    3: ([(EMOJI, ""), (CATALOGUE, "")], YEAR_MORE, _after(False)),
    4: ([(EMOJI, ""), (SITE, ""), (GENRE, ""), (ORDINAL, " "), (CATALOGUE, "")], YEAR_MORE, _after(True)),
}


def _replaced(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def around(pattern: str) -> str:
    """The pattern of a whole text with what stands before and after the first match as groups 1 and 3."""
    flag = "(?is)" if pattern.startswith("(?i)") else "(?s)"
    return f"{flag}^(.*?){pattern.removeprefix('(?i)')}(.*)$"


def _year(c: Column, forms: list) -> Column:
    """struct(year, rest): the first of the further forms whose year is within its bounds, else a plain year."""

    def taken(c: Column) -> Column:
        found = []
        for pattern, least, most in forms:
            year = nullif_empty(F.regexp_extract(c, around(pattern), 2)).cast("int")
            rest = F.concat(F.regexp_extract(c, around(pattern), 1), F.regexp_extract(c, around(pattern), 3))
            found.append(T.once(year, lambda y: F.when(y.between(least, most), F.struct(y.alias("year"), rest.alias("rest")))))
        return F.coalesce(*found, T.split_year(c))

    return T.once(c, taken)


def _title_first(clean: Column) -> Column:
    """What version 5 makes of a name that begins with a year in brackets and ends with a size and a rate; null for others."""

    def parts(clean: Column) -> Column:
        part = lambda k: F.regexp_extract(clean, TITLE_FIRST, k)
        artist = T.strip(_replaced(T.strip(part(3)), [(p, "") for p in ARTIST_ENDS_5]))
        return F.struct(artist.alias("artist"), T.strip(part(2)).alias("title"), nullif_empty(part(1)).cast("int").alias("year"))

    ok = lambda p: F.when(p["year"].between(1900, 2030) & (p["title"] != "") & (F.length(p["artist"]) > 1), p)
    return T.once(clean, lambda c: F.when(c.rlike(TITLE_FIRST), T.once(parts(c), ok)))


def _steps(clean: Column, version: int) -> Column:
    """struct(artist, title, year) of a clean name by a version that is a list of steps."""
    before, years, after = STEPS.get(version, STEPS[1])
    split = lambda taken: T.once(T.squeeze(_replaced(taken["rest"], after)), lambda n: T.split_artist(n, taken["year"]))
    return T.once(_year(_replaced(clean, before), years), split)


def album(name: Column, version: int = LATEST) -> Column:
    """struct(artist, title, year) by the rules of a version; an unknown version is the first."""
    if version != LATEST:
        return _steps(T.clean_name(name), version)
    return T.once(T.clean_name(name), lambda c: F.coalesce(_title_first(F.regexp_replace(c, EMOJI_5, "")), _steps(c, LATEST - 1)))


def albums(name: Column, versions: list[int]) -> Column:
    """array<struct(version, artist, title, year)> by each of those versions, in that order; what two of them share is made once."""
    known = lambda v: v if v in STEPS or v == LATEST else 1
    plain = sorted({LATEST - 1 if known(v) == LATEST else known(v) for v in versions})

    def every(clean: Column) -> Column:
        def numbered(made: Column) -> Column:
            one = lambda v: F.coalesce(_title_first(F.regexp_replace(clean, EMOJI_5, "")), one(LATEST - 1)) if v == LATEST else F.get(made, F.lit(plain.index(v)))
            return F.array(*[T.once(one(known(v)), lambda p: F.struct(F.lit(v).alias("version"), p["artist"].alias("artist"), p["title"].alias("title"), p["year"].alias("year"))) for v in versions])

        return T.once(F.array(*[_steps(clean, v) for v in plain]), numbered)

    return T.once(T.clean_name(name), every)
