"""Views over the driver's tables that look like content records; one text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CONTENT = """SELECT o_orderkey AS content_id, CASE o_orderkey % 20
    WHEN 0 THEN concat('Movie.Name.', cast(1950 + o_orderkey % 75 AS string), '.1080p.BluRay.x264-GRP')
    WHEN 1 THEN concat('Show.Name.S0', cast(1 + o_orderkey % 9 AS string), 'E1', cast(o_orderkey % 7 AS string), '.720p.WEB-DL.DD5.1.H.264')
    WHEN 2 THEN concat('Artist Name - Album Title (', cast(1960 + o_orderkey % 60 AS string), ') [FLAC]')
    WHEN 3 THEN 'SomeApp v2.5.1 x64 Portable'
    WHEN 4 THEN 'Author Name - Book Title (EPUB)'
    WHEN 5 THEN 'Movie.Name.2024.4K.HDR.WEB-DL.MULTI.HC'
    WHEN 6 THEN 'Artist Name - Discography'
    WHEN 7 THEN 'Show.Name.S03.Complete.720p'
    WHEN 8 THEN 'Movie.Name.2020.2160p.Remux.AVC.TrueHD.7.1.mkv'
    WHEN 9 THEN 'Movie.Name.2024.1080p.VOSTFR.FORCED'
    WHEN 10 THEN 'Movie.Name.2024.SUB.ENG.ITA.HDTV'
    WHEN 11 THEN 'SomeApp 2.5.1 Win'
    WHEN 12 THEN 'ISBN Guide by Springer'
    WHEN 13 THEN 'Ghost Stories MP3'
    WHEN 14 THEN concat('Clip 1920x1080 no ', cast(o_orderkey AS string))
    WHEN 15 THEN concat('Studio Set UTF-', cast(1000 + o_orderkey % 900 AS string))
    WHEN 16 THEN 'Some.XXX.Content'
    WHEN 17 THEN 'Artist - Album 2011 320kbps V0'
    WHEN 18 THEN 'Trailer sample cam'
    ELSE concat('random text ', cast(o_orderkey AS string)) END AS name
FROM orders"""

FILES = """SELECT content_id, concat(dir, filename) AS path, filename, size FROM (
  SELECT l_orderkey AS content_id,
    CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'CD1/' ELSE 'CD2/' END AS dir,
    concat(CASE l_partkey % 5 WHEN 0 THEN 'S01E02 ' WHEN 1 THEN '2x03 ' ELSE 'item ' END, cast(l_partkey AS string), '_', cast(l_suppkey AS string), '.',
      CASE WHEN l_linenumber = 7 THEN 'nfo' ELSE CASE (l_orderkey % 9)
          WHEN 0 THEN 'mkv' WHEN 1 THEN 'mp3' WHEN 2 THEN 'epub' WHEN 3 THEN 'EXE' WHEN 4 THEN 'zip' WHEN 5 THEN 'txt' WHEN 6 THEN 'iso'
          ELSE CASE l_suppkey % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'flac' WHEN 2 THEN 'pdf' ELSE 'webm' END END END) AS filename,
    CASE WHEN l_orderkey % 45 = 9 THEN cast(0 AS bigint) ELSE cast(l_quantity AS bigint) * 1000003 END AS size
  FROM lineitem) t"""


def _label(key: str) -> str:
    return f"CASE {key} WHEN 0 THEN 'music' WHEN 1 THEN 'video' WHEN 2 THEN 'software' WHEN 3 THEN 'book' WHEN 4 THEN 'porn' WHEN 5 THEN 'other' WHEN 6 THEN '?(x)' END"


def _new(key: str) -> str:
    return f"CASE {key} WHEN 0 THEN 'audio' WHEN 1 THEN 'video' WHEN 2 THEN 'software' WHEN 3 THEN 'book' WHEN 4 THEN 'other' WHEN 5 THEN 'ERR(x)' END"


#: Labels of four voters in six classes and of four in five.
VOTES = f"""SELECT o_orderkey AS id, {_label('o_orderkey % 6')} AS a, {_label('(o_orderkey * 7 + o_custkey % 2) % 6')} AS b,
  {_label('(o_orderkey * 7 + o_custkey % 3) % 8')} AS c, {_label('(o_orderkey + o_custkey % 5) % 8')} AS big,
  {_new('o_orderkey % 5')} AS n1, {_new('(o_orderkey + o_custkey % 2) % 6')} AS n2, {_new('(o_orderkey + o_custkey % 3) % 7')} AS n3, {_new('o_custkey % 7')} AS n4
FROM orders"""

#: Free answers of a labelling model.
ANSWERS = """SELECT o_orderkey AS id, CASE o_orderkey % 12 WHEN 0 THEN 'Video' WHEN 1 THEN ' It is a movie. ' WHEN 2 THEN 'happy' WHEN 3 THEN 'Audiobook'
  WHEN 4 THEN 'the TV Show' WHEN 5 THEN 'hentai manga' WHEN 6 THEN 'no idea' WHEN 7 THEN 'Category: music' WHEN 8 THEN 'PDF document' WHEN 9 THEN 'nsfw'
  WHEN 10 THEN '' ELSE 'other stuff' END AS answer FROM orders"""

#: Known titles, and names that hold them.
TITLES = """SELECT p_partkey AS gt_id, CASE p_partkey % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'tv' ELSE 'album' END AS type, concat('num', cast(p_partkey AS string), ' ', p_name) AS title,
  CASE WHEN p_partkey % 3 = 2 THEN replace(p_brand, '#', ' ') END AS artist, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE cast(1990 + p_partkey % 30 AS int) END AS year FROM part"""
NAMES = """SELECT l_orderkey * 100000 + l_partkey AS name_id, min(concat(CASE WHEN l_linenumber % 4 = 0 THEN 'The ' ELSE '' END, 'num', cast(p_partkey AS string), ' ', p_name, ' ', cast(1990 + (l_partkey % 30 + CASE WHEN l_suppkey % 7 = 0 THEN 1 WHEN l_suppkey % 7 = 1 THEN 5 ELSE 0 END) AS string),
  CASE l_suppkey % 4 WHEN 0 THEN ' 1080p BluRay' WHEN 1 THEN ' FLAC' WHEN 2 THEN ' trailer' ELSE '' END, ' ', p_brand)) AS name, max(cast(l_quantity AS bigint)) * 60000000 AS size
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey * 100000 + l_partkey"""

#: Names of albums in the forms that the versions of the album rules tell apart.
RELEASES = """SELECT o_orderkey AS id, CASE o_orderkey % 18
    WHEN 0 THEN concat('[2024.11.22] Some Artist - Album ', cast(o_orderkey % 97 AS string), ' [FLAC]')
    WHEN 1 THEN concat('Some Artist - Album ', cast(o_orderkey % 97 AS string), ' Night [2024 - 602475686767]')
    WHEN 2 THEN 'Some Artist - Title (2024 Hip Hop Rap) MP3 320 kbps'
    WHEN 3 THEN 'Artist - GNX-EICHBAUM'
    WHEN 4 THEN concat('Artist - Title {XO Republic Records, 0602475872252} (', cast(1960 + o_orderkey % 60 AS string), ')')
    WHEN 5 THEN 'Artist - Title (with Isolated Vocals) 24Bit-96kHz Hi-Res'
    WHEN 6 THEN concat('[ OxTorrent.com ] Artist - Title ', cast(1990 + o_orderkey % 30 AS string), ' WEB')
    WHEN 7 THEN '(R&B Soul) Artist - 1st solo album Name 320 kbps'
    WHEN 8 THEN concat('[', cast(1980 + o_orderkey % 40 AS string), '] Meteora - Linkin Park - 91mb @ 320kbs')
    WHEN 9 THEN concat('Artist-Title-2CD-FLAC-', cast(1990 + o_orderkey % 30 AS string), '-JLM')
    WHEN 10 THEN 'Artist - Title-ESOMA'
    WHEN 11 THEN 'Artist - Title SO-11601'
    WHEN 12 THEN 'Artist - Title (by emi) Beats'
    WHEN 13 THEN concat('🎵 Artist - Title (', cast(1960 + o_orderkey % 60 AS string), ') [FLAC] 🔥')
    WHEN 14 THEN concat('Artist Name - Album ', cast(o_orderkey AS string), ' (', cast(1960 + o_orderkey % 60 AS string), ') [FLAC].zip')
    WHEN 15 THEN 'Artist - Title 8P-45'
    WHEN 16 THEN '[1850] Title - Artist - 91mb @ 320kbs'
    ELSE 'no dash here V0' END AS name
FROM orders"""

VIEWS = {"releases": RELEASES, "content": CONTENT, "files": FILES, "votes": VOTES, "answers": ANSWERS, "titles": TITLES, "names": NAMES}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's rows; its tables are inlined as reads of sf_dir, so that no session-wide name is set."""
    import re

    sql = re.sub(r"\b(FROM|JOIN) (orders|lineitem|part)\b", lambda m: f"{m[1]} {{{m[2]}}}", VIEWS[name].replace("{", "{{").replace("}", "}}"))
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "part") if f"{{{t}}}" in sql}
    return spark.sql(sql, **tables)


def with_views(sql: str, *names: str) -> str:
    """The oracle's text of a query over views."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + (" " if not sql.lstrip().upper().startswith("WITH ") else ", ") + (sql if not sql.lstrip().upper().startswith("WITH ") else sql.lstrip()[5:])
