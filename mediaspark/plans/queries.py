"""The registered queries of the library's operators, each with its SQL for the oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaspark.functions import files as fs
from mediaspark.functions import patterns as P
from mediaspark.functions import release
from mediaspark.functions import text as T
from mediaspark.operators import cascade, matching, metrics, safety, voting
from mediaspark.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query and its oracle's SQL over those views."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- SQL pieces for the oracle ------------------------------------------------------------------

def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(map(_s, values)) + ")"


def _list(values) -> str:
    return "[" + ", ".join(map(_s, values)) + "]"


def _case(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_s(k)} THEN {_s(v) if isinstance(v, str) else v}" for k, v in table.items()) + " END"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_s(pattern)})"


def _get(column: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({column}, {_s(pattern)}, {group}), '')"


_EXT = r"lower(regexp_extract(regexp_extract(filename, '([^/]*)$', 1), '(?s)^.+\.([^.]*)$', 1))"
_CAT = f"CASE WHEN ext IN {_in(P.VIDEO)} THEN 'video' WHEN ext IN {_in(P.AUDIO)} THEN 'audio' WHEN ext IN {_in(P.BOOK)} THEN 'book' WHEN ext IN {_in(P.SOFTWARE)} THEN 'software' WHEN ext IN {_in(P.ARCHIVE)} THEN 'archive' ELSE 'other' END"
_SIZES = ", ".join(f"coalesce(sum(size) FILTER (cat = '{k}'), 0)::BIGINT AS {k}_size" for k in ("video", "audio", "book", "software", "archive", "other"))
_DIR = r"regexp_extract(path, '(?s)^(.*)/[^/]*$', 1)"
_F = f"f1 AS (SELECT *, {_EXT} AS ext FROM files), f2 AS (SELECT *, {_CAT} AS cat FROM f1)"
_PROFILE = f"""{_F}, g AS (SELECT content_id, count(*) AS n_files, sum(size)::BIGINT AS total_size, {_SIZES},
  bool_or(ext IN {_in(P.VIDEO)}) AS has_video, bool_or(ext IN {_in(P.HINT_AUDIO)}) AS has_audio, bool_or(ext IN {_in(P.BOOK)}) AS has_book,
  bool_or(ext IN {_in(P.HINT_SOFTWARE)}) AS has_software, bool_or(ext IN {_in(P.HINT_ARCHIVE)}) AS has_archive,
  count(*) FILTER (ext IN {_in(P.MEDIA_VIDEO)}) AS video_files, count(*) FILTER (ext IN {_in(P.MEDIA_AUDIO)}) AS audio_files,
  count(DISTINCT {_DIR}) FILTER (ext IN {_in(P.MEDIA_VIDEO)}) AS video_dirs, count(DISTINCT {_DIR}) FILTER (ext IN {_in(P.MEDIA_AUDIO)}) AS audio_dirs,
  coalesce(bool_or({_has('filename', P.EPISODE)} OR {_has('path', P.EPISODE)}) FILTER (ext IN {_in(P.MEDIA_VIDEO)}), false) AS has_episode
  FROM f2 GROUP BY content_id),
p AS (SELECT c.content_id, c.name, coalesce(n_files, 0) AS n_files, coalesce(total_size, 0) AS total_size,
  {', '.join(f'coalesce({k}_size, 0) AS {k}_size' for k in ('video', 'audio', 'book', 'software', 'archive', 'other'))},
  {', '.join(f'coalesce(has_{k}, false) AS {k[0] if k != "archive" else "z"}' for k in ('video', 'audio', 'book', 'software', 'archive'))},
  coalesce(video_files, 0) AS video_files, coalesce(audio_files, 0) AS audio_files, coalesce(video_dirs, 0) AS video_dirs, coalesce(audio_dirs, 0) AS audio_dirs,
  coalesce(has_episode, false) AS has_episode FROM content c LEFT JOIN g USING (content_id))"""
_KNOWN = "(video_size + audio_size + book_size + software_size)"
_EXTSTAGE = "CASE WHEN total_size = 0 THEN NULL " + " ".join(f"WHEN {k}_size > 0 AND {k}_size::DOUBLE / (CASE WHEN {_KNOWN} > 0 THEN {_KNOWN} ELSE total_size END) >= 0.9 THEN '{k}'" for k in ("video", "audio", "book", "software")) + " END"


def _rule(medium: str, gate: str, high: str, mid: str, support: str) -> str:
    return f"CASE WHEN {gate} THEN NULL WHEN {_has('name', high)} THEN '{medium}:high' WHEN {_has('name', mid)} AND ({support}) THEN '{medium}:medium' END"


_PATSTAGE = "coalesce(" + ", ".join([
    _rule("video", "a AND NOT v", P.VIDEO_HIGH, P.VIDEO_MEDIUM, "v OR NOT (a OR b OR s)"), _rule("audio", "v AND NOT a", P.AUDIO_HIGH, P.AUDIO_MEDIUM, "a OR NOT (v OR b OR s)"),
    _rule("software", "(v OR a) AND NOT s", P.SOFTWARE_HIGH, P.SOFTWARE_MEDIUM, "s OR z"), _rule("book", "false", P.BOOK_HIGH, P.BOOK_MEDIUM, "b OR NOT (v OR a OR s)")]) + ")"
_CLASSIFIED = f"""{_PROFILE}, q AS (SELECT *, {_EXTSTAGE} AS e, {_PATSTAGE} AS t FROM p),
r AS (SELECT *, coalesce(e, split_part(t, ':', 1), 'other') AS medium, CASE WHEN e IS NOT NULL THEN 'high' WHEN t IS NOT NULL THEN split_part(t, ':', 2) ELSE 'low' END AS confidence,
  CASE WHEN e IS NOT NULL THEN 'extensions' WHEN t IS NOT NULL THEN 'patterns' ELSE 'fallback' END AS source FROM q),
k AS (SELECT *, CASE medium WHEN 'video' THEN CASE WHEN video_files = 0 THEN 'other' WHEN video_files = 1 THEN CASE WHEN has_episode THEN 'episode' ELSE 'movie' END WHEN video_dirs = 1 THEN 'season' ELSE 'series' END
  WHEN 'audio' THEN CASE WHEN audio_files = 0 THEN 'other' WHEN audio_files = 1 THEN 'track' WHEN audio_dirs = 1 THEN 'album' ELSE 'collection' END END AS subcategory FROM r)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cascade.heuristics().classify(cascade.profile(view(spark, sf_dir, "content"), view(spark, sf_dir, "files")))
    return rows.withColumn("subcategory", cascade.subcategory(F.col("medium")))


# -- the cascade --------------------------------------------------------------------------------

@query(f"WITH {_CLASSIFIED} SELECT medium, subcategory, confidence, source, count(*) AS n, sum(total_size)::BIGINT AS bytes FROM k GROUP BY ALL", "content", "files")
def c1_cascade_summary(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("medium", "subcategory", "confidence", "source").agg(F.count("*").alias("n"), F.sum("total_size").alias("bytes"))


@query(f"WITH {_CLASSIFIED} SELECT content_id, medium, subcategory, confidence, source FROM k", "content", "files")
def c1_cascade(spark, sf_dir):
    return classified(spark, sf_dir).select("content_id", "medium", "subcategory", "confidence", "source")


@query(f"WITH {_F} SELECT ext, cat AS category, count(*) AS n, sum(size)::BIGINT AS bytes FROM f2 GROUP BY ALL", "files")
def c4_extension_categories(spark, sf_dir):
    rows = view(spark, sf_dir, "files").withColumn("ext", fs.extension(F.col("filename"))).withColumn("category", fs.category(F.col("ext")))
    return rows.groupBy("ext", "category").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {_PROFILE} SELECT content_id, n_files, total_size, video_size, audio_size, book_size, software_size, archive_size, other_size, v AS has_video, a AS has_audio, b AS has_book, s AS has_software, z AS has_archive FROM p", "content", "files")
def c6_size_profile_and_hints(spark, sf_dir):
    rows = cascade.profile(view(spark, sf_dir, "content"), view(spark, sf_dir, "files"))
    return rows.select("content_id", "n_files", "total_size", *[f"{k}_size" for k in ("video", "audio", "book", "software", "archive", "other")], *[f"has_{k}" for k in ("video", "audio", "book", "software", "archive")])


@query(f"WITH {_PROFILE} SELECT content_id, {_EXTSTAGE} AS medium FROM p", "content", "files")
def c7_extension_stage(spark, sf_dir):
    rows = cascade.profile(view(spark, sf_dir, "content"), view(spark, sf_dir, "files"))
    return rows.select("content_id", cascade.extension_stage()[1]()["medium"].alias("medium"))


@query(f"WITH {_PROFILE}, q AS (SELECT content_id, {_PATSTAGE} AS t FROM p) SELECT content_id, split_part(t, ':', 1) AS medium, split_part(t, ':', 2) AS confidence FROM q WHERE t IS NOT NULL", "content", "files")
def c11_pattern_stage(spark, sf_dir):
    rows = cascade.profile(view(spark, sf_dir, "content"), view(spark, sf_dir, "files"))
    return rows.withColumn("r", cascade.pattern_stage()[1]()).filter("r IS NOT NULL").select("content_id", "r.medium", "r.confidence")


_HUMAN = "CASE WHEN s0 < 1024 THEN printf('%.1fB', s0) WHEN s0 / 1024 < 1024 THEN printf('%.1fKB', s0 / 1024) WHEN s0 / 1048576 < 1024 THEN printf('%.1fMB', s0 / 1048576) WHEN s0 / 1073741824 < 1024 THEN printf('%.1fGB', s0 / 1073741824) ELSE printf('%.1fTB', s0 / 1099511627776) END"


@query(f"""WITH h AS (SELECT content_id, filename, row_number() OVER (PARTITION BY content_id ORDER BY size DESC, path, filename) AS k, size::DOUBLE AS s0 FROM files),
t AS (SELECT content_id, string_agg(filename || ' (' || {_HUMAN} || ')', chr(10) ORDER BY k) AS top FROM h WHERE k <= 3 GROUP BY content_id)
SELECT c.content_id, c.name || coalesce(chr(10) || t.top, '') AS text FROM content c LEFT JOIN t USING (content_id)""", "content", "files")
def c17_model_text(spark, sf_dir):
    top = cascade.ranked_files(view(spark, sf_dir, "files")).withColumn("line", F.concat("filename", F.lit(" ("), fs.human_size(F.col("size")), F.lit(")")))
    lines = top.groupBy("content_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("top"))
    rows = view(spark, sf_dir, "content").join(lines, "content_id", "left")
    return rows.select("content_id", F.concat_ws("\n", "name", "top").alias("text"))


@query(f"WITH {_CLASSIFIED} SELECT content_id, CASE confidence WHEN 'high' THEN 0.95::DOUBLE WHEN 'medium' THEN 0.7 ELSE 0.3 END AS library_score, CASE confidence WHEN 'high' THEN 0.95::DOUBLE WHEN 'medium' THEN 0.75 ELSE 0.5 END AS cli_score FROM k", "content", "files")
def c25_confidence_scores(spark, sf_dir):
    c = F.col("confidence")
    return classified(spark, sf_dir).select("content_id", cascade.score(c, cascade.LIBRARY_SCORES).alias("library_score"), cascade.score(c, cascade.CLI_SCORES).alias("cli_score"))


# -- content safety -----------------------------------------------------------------------------

_WORDY = lambda c: rf"list_has_any(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), {_list(P.UNSAFE_WORDS)})"
_MATCHY = lambda c: "(" + " OR ".join(_has(c, p) for p in P.UNSAFE_PATTERNS) + ")"


@query(f"""WITH m AS (SELECT content_id, bool_or({_WORDY('filename')}) AS k, bool_or({_MATCHY('filename')}) AS p FROM files GROUP BY content_id),
j AS (SELECT c.content_id, {_WORDY('c.name')} OR coalesce(k, false) AS k, {_MATCHY('c.name')} OR coalesce(p, false) AS p FROM content c LEFT JOIN m USING (content_id))
SELECT content_id, k OR p AS nsfw, CASE WHEN k THEN 0.95::DOUBLE WHEN p THEN 0.9 ELSE 0.5 END AS confidence, CASE WHEN k THEN 'keywords' WHEN p THEN 'patterns' ELSE 'ml' END AS source FROM j""", "content", "files")
def n1_safety_cascade(spark, sf_dir):
    return safety.judge(view(spark, sf_dir, "content"), view(spark, sf_dir, "files"))


@query(f"SELECT l.toxic, {_WORDY('d.text')} OR {_MATCHY('d.text')} AS flagged, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def n2_safety_of_documents(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", safety.judge_text(F.col("text")).alias("flagged")).join(_table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("toxic", "flagged").agg(F.count("*").alias("n"))


# -- release names ------------------------------------------------------------------------------

_UP = lambda p, g=1: f"upper({_get('name', p, g)})"
_LANGS = lambda p: f"list_filter(list_transform(regexp_extract_all(name, {_s(p)}, 1), lambda c: {_case('upper(c)', P.LANGUAGES)}), lambda x: x IS NOT NULL)"
#: DuckDB's list_distinct keeps no order: the first place of each value does.
_DISTINCT = lambda e: f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


@query(f"""SELECT content_id, {_case(_UP(P.RESOLUTION), P.RESOLUTIONS)} AS resolution, {_case(f"replace({_UP(P.VIDEO_CODEC)}, '.', '')", P.VIDEO_CODECS)} AS video_codec,
CASE WHEN starts_with({_UP(P.AUDIO_CODEC)}, 'DTS-HD') THEN 'DtsHd' ELSE {_case(_UP(P.AUDIO_CODEC), P.AUDIO_CODECS)} END AS audio_codec,
{_get('name', P.BITRATE)}::INT AS bitrate, {_UP(P.VBR)} AS vbr, {_case(f"replace({_UP(P.QUALITY)}, '-', '')", P.QUALITIES)} AS quality,
{_case(_case(f"replace({_UP(P.QUALITY)}, '-', '')", P.QUALITIES), P.QUALITY_RANKS)} AS quality_rank, {_UP(P.CONTAINER)} AS container,
coalesce({_get('name', P.SEASON_EPISODE)}, {_get('name', P.SEASON)})::INT AS season, {_get('name', P.SEASON_EPISODE, 2)}::INT AS episode, {_has('name', P.HARDCODED)} AS hardcoded, {_has('name', P.FORCED)} AS forced FROM content""", "content")
def p13_release_fields(spark, sf_dir):
    n = F.col("name")
    fields = {k: getattr(release, k)(n) for k in ("resolution", "video_codec", "audio_codec", "bitrate", "vbr", "quality", "quality_rank", "container", "season", "episode", "hardcoded", "forced")}
    return view(spark, sf_dir, "content").select("content_id", *[c.alias(k) for k, c in fields.items()])


@query(f"""SELECT content_id, CASE WHEN contains(upper(name), 'VOSTFR') THEN '' ELSE array_to_string({_DISTINCT(_LANGS(P.LANGUAGE))}, ',') END AS audio,
CASE WHEN contains(upper(name), 'VOSTFR') THEN 'French' ELSE array_to_string({_DISTINCT(_LANGS(P.SUBTITLE_LANGUAGE))}, ',') END AS subtitles FROM content""", "content")
def p9_languages(spark, sf_dir):
    n = F.col("name")
    return view(spark, sf_dir, "content").select("content_id", F.array_join(release.audio_languages(n), ",").alias("audio"), F.array_join(release.subtitle_languages(n), ",").alias("subtitles"))


# -- names and answers --------------------------------------------------------------------------

_STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_SQUEEZE = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
_TITLE = lambda c: _SQUEEZE(rf"regexp_replace(regexp_replace(lower({c}), '^(the|a|an)\s+', ''), '[^\w\s]', ' ', 'g')")


def _label_sql(classes: list[str], aliases: list) -> str:
    a = _STRIP("lower(answer)")
    return f"CASE WHEN {a} IN {_in(classes)} THEN {a} " + " ".join(f"WHEN contains({a}, {_s(k)}) THEN {_s(v)}" for k, v in [*aliases, *((c, c) for c in classes)]) + " END"


@query(f"SELECT id, {_label_sql(P.CLASSES6, P.ALIASES6)} AS six, {_label_sql(P.CLASSES5, P.ALIASES5)} AS five FROM answers", "answers")
def m21_answer_labels(spark, sf_dir):
    a = F.col("answer")
    return view(spark, sf_dir, "answers").select("id", T.label(a, P.CLASSES6, P.ALIASES6).alias("six"), T.label(a, P.CLASSES5, P.ALIASES5).alias("five"))


@query(f"SELECT id, CASE a WHEN 'music' THEN 'audio' WHEN 'porn' THEN NULL WHEN '?(x)' THEN NULL ELSE a END AS medium FROM votes", "votes")
def m22_label_remap(spark, sf_dir):
    return view(spark, sf_dir, "votes").select("id", T.six_to_five(F.col("a")).alias("medium"))


@query(f"SELECT content_id, {_TITLE('name')} AS title, {_get('name', P.YEAR_IN_NAME)}::INT AS year, " + r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '^\s+|\s+$', '', 'g'), '[._]+', ' ', 'g'), '\s+', ' ', 'g')) AS value,
regexp_replace(regexp_replace(lower(name), '[^\w\s]', '', 'g'), '^\s+|\s+$', '', 'g') AS pair FROM content""", "content")
def m13_normal_names(spark, sf_dir):
    n = F.col("name")
    return view(spark, sf_dir, "content").select("content_id", T.normal_title(n).alias("title"), T.year_in_name(n).alias("year"), F.trim(T.normal_value(n)).alias("value"), T.normal_pair(n).alias("pair"))


_YEARS = list(zip([r"\((\d{4})\)", r"\[(\d{4})\]", r"(?:^|[\s\-_.])(\d{4})(?:[\s\-_.\[]|$)"], P.YEAR_FORMS))


@query("SELECT content_id, CASE " + " ".join(f"WHEN try_cast({_get('name', p)} AS INT) BETWEEN 1900 AND 2030 THEN try_cast({_get('name', p)} AS INT)" for p, _ in _YEARS) + " END AS year, CASE "
       + " ".join(f"WHEN try_cast({_get('name', p)} AS INT) BETWEEN 1900 AND 2030 THEN {_STRIP(f'regexp_extract(name, {_s(w)}, 1) || regexp_extract(name, {_s(w)}, 3)')}" for p, w in _YEARS) + " ELSE name END AS rest FROM content", "content")
def m8_split_year(spark, sf_dir):
    return view(spark, sf_dir, "content").select("content_id", T.split_year(F.col("name")).alias("y")).select("content_id", "y.year", "y.rest")


@query(r"""WITH n AS (SELECT content_id, lower(name) AS n FROM content) SELECT content_id, CASE WHEN regexp_matches(n, 's\d{1,2}e\d{1,2}') OR regexp_matches(n, '\d{1,2}x\d{1,2}') THEN 'video/episode'
WHEN regexp_matches(n, 's\d{1,2}\s*-\s*s?\d{1,2}') OR regexp_matches(n, 'season\s*\d+\s*-\s*\d+') THEN 'video/series'
WHEN regexp_matches(n, 's\d{1,2}\.?complete') OR regexp_matches(n, 'season\s*\d+') OR regexp_matches(n, '\.s\d{1,2}\.') THEN 'video/season' ELSE 'video/series' END AS subtype FROM n""", "content")
def m18_video_subtype(spark, sf_dir):
    return view(spark, sf_dir, "content").select("content_id", T.video_subtype(F.col("name")).alias("subtype"))


@query("""SELECT gt_id, CASE type WHEN 'movie' THEN title || coalesce(' | ' || year, '') WHEN 'tv' THEN title ELSE title || ' | ' || artist || coalesce(' | ' || year, '') END AS target FROM titles""", "titles")
def m19_target_text(spark, sf_dir):
    kind = F.when(F.col("type") == "movie", "video/movie").when(F.col("type") == "tv", "video/series").otherwise("audio/album")
    return view(spark, sf_dir, "titles").select("gt_id", T.target_text(kind, F.col("title"), F.col("artist"), F.col("year")).alias("target"))


@query(f"""SELECT content_id, trim(split_part(name || ' | X | 2024', '|', 1)) AS title, 'X' AS artist, CASE WHEN contains(name, '2024') THEN 2024 END AS year FROM content""", "content")
def m3_parse_answer(spark, sf_dir):
    said = T.parse_answer(F.concat("name", F.lit(" | X | 2024")), T.field_count(F.lit("audio/album")), F.col("name"))
    return view(spark, sf_dir, "content").select("content_id", said.alias("p")).select("content_id", "p.title", "p.artist", "p.year")


# -- votes --------------------------------------------------------------------------------------

_OK6 = lambda c: f"coalesce({c} IN {_in(P.CLASSES6)}, false)"


@query(f"""WITH v AS (SELECT *, {_OK6('a')} AND {_OK6('b')} AND {_OK6('c')} AS small FROM votes), l AS (SELECT id, unnest([a, b, c, big]) AS x FROM v WHERE small AND {_OK6('big')} AND NOT (a = b AND b = c)),
n AS (SELECT id, x, count(*) AS n FROM l GROUP BY id, x), w AS (SELECT id, max(n) AS m, count(*) FILTER (n = 2) AS twos, arg_max(x, n) AS top FROM n GROUP BY id)
SELECT v.id, CASE WHEN small AND a = b AND b = c THEN a END AS consensus, CASE WHEN small AND a = b AND b = c THEN a WHEN m >= 3 OR (m = 2 AND twos = 1) THEN top END AS majority FROM v LEFT JOIN w USING (id)""", "votes")
def a6_four_voters(spark, sf_dir):
    consensus, majority = voting.four_voters(*map(F.col, ("a", "b", "c", "big")), P.CLASSES6)
    return view(spark, sf_dir, "votes").select("id", consensus.alias("consensus"), majority.alias("majority"))


_SIX = lambda c: f"CASE {c} WHEN 'music' THEN 'audio' WHEN 'porn' THEN NULL ELSE {c} END"


@query(f"""WITH l AS (SELECT id, unnest([{_SIX('a')}, {_SIX('b')}, {_SIX('c')}, {_SIX('big')}, n1, n2, n3, n4]) AS x, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS k FROM votes),
n AS (SELECT id, x, count(*) AS n, min(k) AS k FROM l WHERE x IN {_in(P.CLASSES5)} GROUP BY id, x), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, k) AS o FROM n)
SELECT v.id, CASE WHEN r.n >= 3 THEN r.x END AS medium FROM votes v LEFT JOIN r ON v.id = r.id AND r.o = 1""", "votes")
def a7_quorum(spark, sf_dir):
    labels = [T.six_to_five(F.col(c)) for c in ("a", "b", "c", "big")] + [F.col(f"n{k}") for k in range(1, 5)]
    return view(spark, sf_dir, "votes").select("id", voting.quorum(labels, P.CLASSES5).alias("medium"))


@query(f"""SELECT id % 2 AS shard, count(*) AS n FROM votes WHERE {_OK6('a')} AND {_OK6('b')} AND {_OK6('c')} AND big IS NULL AND NOT (a = b AND b = c) GROUP BY 1""", "votes")
def a8_disagreements_by_shard(spark, sf_dir):
    rows = view(spark, sf_dir, "votes").filter(voting.disagree(*map(F.col, ("a", "b", "c", "big")), P.CLASSES6))
    return rows.groupBy((F.col("id") % 2).alias("shard")).agg(F.count("*").alias("n"))


@query(f"""WITH l AS (SELECT id, unnest(['a', 'b', 'c', 'big']) AS "column", unnest([a, b, c, big]) AS value FROM votes) SELECT "column", value, count(*) AS n FROM l WHERE value IS NOT NULL AND value NOT IN {_in(P.CLASSES6)} GROUP BY ALL""", "votes")
def f14_invalid_labels(spark, sf_dir):
    found = voting.invalid_labels(P.CLASSES6, **{c: F.col(c) for c in ("a", "b", "c", "big")})
    return view(spark, sf_dir, "votes").select(F.explode(found).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


@query("""SELECT id, CASE WHEN a IS NOT DISTINCT FROM b THEN 'agreed' WHEN a IS NOT DISTINCT FROM c THEN 'tiebreaker_first' WHEN b IS NOT DISTINCT FROM c THEN 'tiebreaker_second' ELSE 'no_consensus' END AS status,
CASE WHEN a IS NOT DISTINCT FROM b THEN 'high' WHEN a IS NOT DISTINCT FROM c OR b IS NOT DISTINCT FROM c THEN 'medium' ELSE 'low' END AS confidence,
CASE WHEN a IS DISTINCT FROM b AND a IS DISTINCT FROM c AND b IS NOT DISTINCT FROM c THEN b ELSE a END AS value FROM votes""", "votes")
def a9_tiebreak(spark, sf_dir):
    status, confidence, value = voting.tiebreak(F.col("a"), F.col("b"), F.col("c"))
    return view(spark, sf_dir, "votes").select("id", status.alias("status"), confidence.alias("confidence"), value.alias("value"))


@query("SELECT a AS label, count(*) AS n, count(*) FILTER (big IS NULL) AS open, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent, count(DISTINCT b) AS others, max(id) AS last_id FROM votes GROUP BY a", "votes")
def a2_label_counts(spark, sf_dir):
    rows = view(spark, sf_dir, "votes").groupBy(F.col("a").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("big").isNull()).alias("open"), F.countDistinct("b").alias("others"), F.max("id").alias("last_id"))
    return rows.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


# -- matching -----------------------------------------------------------------------------------

_CAND = r"""w AS (SELECT *, string_split(trim(regexp_replace(title, '\s+', ' ', 'g')), ' ') AS ws, string_split(trim(regexp_replace(coalesce(artist, ''), '\s+', ' ', 'g')), ' ') AS aw FROM titles),
q AS (SELECT *, list_transform(list_concat(CASE WHEN len(ws) <= 3 THEN list_filter(ws, lambda x: length(x) > 2) ELSE list_filter(ws, lambda x: length(x) > 3)[1:4] END,
  CASE WHEN year IS NOT NULL AND year <> 0 THEN [year::VARCHAR] ELSE [] END, CASE WHEN type = 'album' AND coalesce(artist, '') <> '' THEN list_filter(aw, lambda x: length(x) > 2)[1:2] ELSE [] END), lambda x: lower(x)) AS wanted
  FROM w WHERE length(title) >= 3 AND NOT regexp_matches(title, '^[0-9]+$')),
h AS (SELECT *, regexp_split_to_array(lower(name), '[^0-9a-z]+') AS have FROM names),
k AS (SELECT *, list_sort(list_transform(wanted, lambda x: lpad(length(x)::VARCHAR, 4, '0') || x))[-1][5:] AS token FROM q),
e AS (SELECT name_id, unnest(list_distinct(have)) AS token FROM h),
t AS (SELECT gt_id, type, title, artist, year, h.name_id, name, size FROM k JOIN e USING (token) JOIN h ON h.name_id = e.name_id WHERE list_has_all(have, wanted))"""


def _titles(spark, sf_dir) -> DataFrame:
    rows = view(spark, sf_dir, "titles")
    return rows.withColumn("wanted", matching.query_tokens(F.col("title"), F.col("year"), F.col("type"), F.col("artist")))


@query(f"WITH {_CAND} SELECT gt_id, count(*) AS n, min(name_id) AS first_id FROM t GROUP BY gt_id", "titles", "names")
def s12_token_candidates(spark, sf_dir):
    rows = matching.candidates(_titles(spark, sf_dir).select("gt_id", "wanted"), view(spark, sf_dir, "names").select("name_id", "name"))
    return rows.groupBy("gt_id").agg(F.count("*").alias("n"), F.min("name_id").alias("first_id"))


_INSIDE = lambda c: f"CASE WHEN contains({_TITLE('name')}, {_TITLE(c)}) THEN 1.0::DOUBLE ELSE len(list_filter(string_split({_TITLE(c)}, ' '), lambda x: len(list_filter(regexp_split_to_array(lower(name), '[.\\-_\\s\\[\\]()]+'), lambda p: contains(p, x))) > 0))::DOUBLE / len(string_split({_TITLE(c)}, ' ')) END"
_RANGE = "CASE type WHEN 'movie' THEN size BETWEEN 400000000 AND 80000000000 WHEN 'tv' THEN size BETWEEN 100000000 AND 200000000000 ELSE size BETWEEN 30000000 AND 3000000000 END"
_SCORED = f"""{_CAND}, u AS (SELECT *, {_INSIDE('title')} AS ts, {_INSIDE("coalesce(artist, '')")} AS ars, {_has('name', P.AUDIO_MARKS)} AS au, {_has('name', P.VIDEO_MARKS)} AS vi, {_get('name', P.YEAR_IN_NAME)}::INT AS ny FROM t),
x AS (SELECT *, ts * 10 + CASE WHEN year = ny THEN 5 WHEN abs(ny - year) = 1 THEN 2 ELSE 0 END + CASE WHEN type = 'album' AND artist IS NOT NULL AND ars > 0.7 THEN ars * 5 ELSE 0 END
  + CASE WHEN type = 'movie' AND size BETWEEN 700000000 AND 4000000000 THEN 2 WHEN type = 'movie' AND size BETWEEN 4000000001 AND 15000000000 THEN 1 WHEN type = 'album' AND size BETWEEN 50000000 AND 500000000 THEN 2 ELSE 0 END
  + CASE WHEN (type = 'album' AND au) OR (type <> 'album' AND vi) THEN 3 ELSE 0 END AS score FROM u
  WHERE NOT {_has('name', P.NEGATIVE)} AND {_RANGE} AND NOT (type = 'album' AND vi AND NOT au) AND NOT (type <> 'album' AND au AND NOT vi) AND ts > 0.7 AND NOT coalesce(abs(ny - year) > 1, false)),
y AS (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY score DESC, name, name_id) AS rank FROM x WHERE score >= 8)"""


def _matches(spark, sf_dir) -> DataFrame:
    return matching.best_matches(matching.scored(_titles(spark, sf_dir), view(spark, sf_dir, "names").withColumn("size", F.col("size").cast("long"))))


@query(f"WITH {_SCORED} SELECT gt_id, name_id, round(score, 6)::DOUBLE AS score, rank FROM y WHERE rank <= 10", "titles", "names")
def j5_best_matches(spark, sf_dir):
    return _matches(spark, sf_dir).select("gt_id", "name_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SCORED} SELECT ti.type, count(DISTINCT ti.gt_id) AS titles, count(y.name_id) AS matches FROM titles ti LEFT JOIN y ON ti.gt_id = y.gt_id AND y.rank <= 10 GROUP BY ti.type", "titles", "names")
def j7_match_summary(spark, sf_dir):
    rows = view(spark, sf_dir, "titles").select("gt_id", "type").join(_matches(spark, sf_dir).select("gt_id", "name_id"), "gt_id", "left")
    return rows.groupBy("type").agg(F.countDistinct("gt_id").alias("titles"), F.count("name_id").alias("matches"))


@query(f"""WITH {_SCORED}, z AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY type, title, score DESC, gt_id, name_id) AS o FROM y WHERE rank <= 10 AND score >= 10) SELECT name, gt_id, type FROM z WHERE o = 1""", "titles", "names")
def a10_export_once(spark, sf_dir):
    w = Window.partitionBy("name").orderBy("type", "title", F.desc("score"), "gt_id", "name_id")
    rows = _matches(spark, sf_dir).filter("score >= 10").withColumn("o", F.row_number().over(w))
    return rows.filter("o = 1").select("name", "gt_id", "type")


# -- evaluation and sampling --------------------------------------------------------------------

@query(f"""WITH {_CLASSIFIED}, e2 AS (SELECT coalesce(e, 'none') AS truth, coalesce(split_part(t, ':', 1), 'none') AS predicted FROM r), c AS (SELECT truth, predicted, count(*) AS n FROM e2 GROUP BY ALL),
l AS (SELECT truth AS label FROM c UNION SELECT predicted FROM c), f AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE truth = label), 0) AS sup, coalesce((SELECT sum(n) FROM c WHERE predicted = label), 0) AS said, coalesce((SELECT sum(n) FROM c WHERE truth = label AND predicted = label), 0) AS hit FROM l)
SELECT label, sup::BIGINT AS support, round(CASE WHEN said > 0 THEN hit::DOUBLE / said ELSE 0 END, 6) AS "precision", round(CASE WHEN sup > 0 THEN hit::DOUBLE / sup ELSE 0 END, 6) AS recall, round(CASE WHEN sup + said > 0 THEN 2.0::DOUBLE * hit / (sup + said) ELSE 0 END, 6) AS f1 FROM f""", "content", "files")
def a19_stage_report(spark, sf_dir):
    rows = cascade.profile(view(spark, sf_dir, "content"), view(spark, sf_dir, "files"))
    named = rows.select(F.coalesce(cascade.extension_stage()[1]()["medium"], F.lit("none")).alias("truth"), F.coalesce(cascade.pattern_stage()[1]()["medium"], F.lit("none")).alias("predicted"))
    out = metrics.per_class(metrics.confusion(named, "truth", "predicted"))
    return out.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT lang, count(*) AS n, round(sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)), 6) AS weight FROM documents GROUP BY lang")
def a18_class_weights(spark, sf_dir):
    return metrics.class_weights(_table(spark, sf_dir, "documents"), "lang").withColumn("weight", F.round("weight", 6))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat(doc_id::VARCHAR, '42')), doc_id) AS k FROM documents) WHERE k <= 20")
def a15_sample_per_class(spark, sf_dir):
    return metrics.sample_per_class(_table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 20).select("lang", "doc_id")


@query("SELECT CASE WHEN ('0x' || substr(md5(concat(doc_id::VARCHAR, '42')), 1, 6))::BIGINT % 10 < 1 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM documents GROUP BY 1")
def a16_train_test_split(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy(metrics.split(F.col("doc_id")).alias("part")).agg(F.count("*").alias("n"))


# -- sources ------------------------------------------------------------------------------------

@query(r"""SELECT page_id, regexp_replace(url, '\.(tar\.gz|tar\.xz|tgz|txz|tar)$', '') AS stem, CASE WHEN regexp_matches(url, '\.torrent$') THEN 'torrent' WHEN regexp_matches(url, '\.(zip|cbz|epub|jar|apk)$') THEN 'zip'
WHEN regexp_matches(url, '\.(tar|tgz|txz)$|\.tar\.(gz|xz)$') THEN 'tar' ELSE 'text' END AS loader FROM (SELECT page_id, url || CASE page_id % 7 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '.zip' WHEN 2 THEN '.torrent' WHEN 3 THEN '.TAR' WHEN 4 THEN '.txz' ELSE '' END AS url FROM pages)""")
def s7_loader_routing(spark, sf_dir):
    ends = F.expr("CASE page_id % 7 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '.zip' WHEN 2 THEN '.torrent' WHEN 3 THEN '.TAR' WHEN 4 THEN '.txz' ELSE '' END")
    rows = _table(spark, sf_dir, "pages").select("page_id", F.concat("url", ends).alias("url"))
    return rows.select("page_id", fs.archive_stem(F.col("url")).alias("stem"), fs.loader(F.col("url")).alias("loader"))


# -- metadata of names --------------------------------------------------------------------------

def _replaced(expression: str, patterns: list[str], by: str = "") -> str:
    for p in patterns:
        expression = f"regexp_replace({expression}, {_s(p)}, {_s(by)}, 'g')"
    return expression


_CLEANED = _STRIP(_replaced("name", [P.SITE_TAGS, P.MEDIA_END]))
_TAKEN = ("CASE " + " ".join(f"WHEN try_cast({_get('cn', p)} AS INT) BETWEEN 1900 AND 2030 THEN try_cast({_get('cn', p)} AS INT)" for p, _ in _YEARS) + " END",
          "CASE " + " ".join(f"WHEN try_cast({_get('cn', p)} AS INT) BETWEEN 1900 AND 2030 THEN {_STRIP(f'regexp_extract(cn, {_s(w)}, 1) || regexp_extract(cn, {_s(w)}, 3)')}" for p, w in _YEARS) + " ELSE cn END")


@query(f"""WITH c1 AS (SELECT content_id, {_CLEANED} AS cn FROM content), c2 AS (SELECT content_id, {_TAKEN[0]} AS year, {_TAKEN[1]} AS rest FROM c1),
c3 AS (SELECT content_id, year, {_SQUEEZE(_replaced('rest', P.ALBUM_NOISE))} AS n FROM c2)
SELECT content_id, {_STRIP(_get('n', P.ARTIST_TITLE, 1))} AS artist, {_replaced(_STRIP(_get('n', P.ARTIST_TITLE, 2)), P.TITLE_ENDS)} AS title, year FROM c3""", "content")
def m9_album_parts(spark, sf_dir):
    return view(spark, sf_dir, "content").select("content_id", T.album_parts(F.col("name")).alias("p")).select("content_id", "p.artist", "p.title", "p.year")


_Y29 = _get("name", r"\b(19[5-9]\d|20[0-2]\d)\b")
_BARE = _replaced("name", [r"\[.*?\]", r"\(.*?\)"], " ")
_VCUT = _replaced(_BARE, [r"(?i)[.\s](1080p|720p|2160p|4k|bluray|bdrip|webrip|web-dl|hdtv|dvdrip|x264|x265|hevc).*$"])
_VTITLE = _SQUEEZE(_replaced(f"CASE WHEN {_Y29} IS NOT NULL THEN regexp_replace({_VCUT}, '[.\\s]' || {_Y29} || '[.\\s]?.*$', '') ELSE {_VCUT} END", ["[._]"], " "))


@query(f"""SELECT content_id, CASE WHEN {_has('name', r'(?i)s\d{1,2}e\d{1,2}|season|\d{1,2}x\d{1,2}')} THEN 'tv' ELSE 'movie' END AS type, {_VTITLE} AS title, {_Y29}::INT AS year
FROM content WHERE {_has('name', P.EXTRACTOR_VIDEO_MARKS)} AND NOT {_has('name', P.SKIP)} AND length({_VTITLE}) >= 2""", "content")
def m6_video_metadata(spark, sf_dir):
    rows = view(spark, sf_dir, "content").select("content_id", T.video_metadata(F.col("name")).alias("p")).filter("p IS NOT NULL")
    return rows.select("content_id", "p.type", "p.title", "p.year")


_ACLEAN = _SQUEEZE(_replaced(_replaced(_BARE, [r"(?i)[.\s](flac|mp3|320|aac|lossless|cd\s*rip|web).*$"]), ["[._]"], " "))


@query(f"""WITH c AS (SELECT content_id, {_Y29} AS y, {_ACLEAN} AS n FROM content WHERE {_has('name', P.AUDIO_MARKS)} AND NOT {_has('name', P.SKIP)}),
s AS (SELECT content_id, y, trim(split_part(n, ' - ', 1)) AS artist, trim(substr(n, strpos(n, ' - ') + 3)) AS album FROM c WHERE contains(n, ' - ')),
t AS (SELECT content_id, artist, CASE WHEN y IS NOT NULL THEN trim(regexp_replace(album, '\\b' || y || '\\b', '', 'g')) ELSE album END AS title, y::INT AS year FROM s)
SELECT content_id, artist, title, year FROM t WHERE length(artist) > 1 AND length(title) > 1""", "content")
def m7_audio_metadata(spark, sf_dir):
    rows = view(spark, sf_dir, "content").select("content_id", T.audio_metadata(F.col("name")).alias("p")).filter("p IS NOT NULL")
    return rows.select("content_id", "p.artist", "p.title", "p.year")


@query(f"""SELECT content_id, array_to_string(list_filter(list_transform(string_split(name || ' | 1999 | 2024 | more', '|')[1:3], lambda x: trim(x)), lambda x: NOT regexp_matches(x, '^[0-9]{{4}}$') OR contains(name, x)), ' | ') AS answer FROM content""", "content")
def m5_truncated_answer(spark, sf_dir):
    return view(spark, sf_dir, "content").select("content_id", T.truncate_answer(F.concat("name", F.lit(" | 1999 | 2024 | more")), F.lit(3), F.col("name")).alias("answer"))


@query("""SELECT content_id, CASE WHEN content_id % 5 <> 3 THEN '{"title":"' || name || '","id":' || content_id || '}' END AS json FROM content""", "content")
def m20_json_answers(spark, sf_dir):
    told = F.concat(F.lit('{"title":"'), F.col("name"), F.lit('","id":'), F.col("content_id").cast("string"), F.lit("}"))
    forms = [told, F.concat(F.lit("<think>hm {x}</think> ```json\n"), told, F.lit("\n``` ok")), F.concat(F.lit("The answer is "), told, F.lit(", I think")), F.concat(F.lit("no {json} here: "), "name"), F.concat(F.lit("<reasoning>long</reasoning>"), told)]
    answer = F.element_at(F.array(*forms), (F.col("content_id") % 5 + 1).cast("int"))
    return view(spark, sf_dir, "content").select("content_id", T.json_answer(answer).alias("json"))


@query("""WITH p AS (SELECT DISTINCT title AS name FROM titles), v AS (SELECT name, unnest([upper(name), lower(name), array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' '), 'The ' || name]) AS variant FROM p)
SELECT DISTINCT name, variant FROM v WHERE variant <> name""", "titles")
def m27_name_variants(spark, sf_dir):
    rows = view(spark, sf_dir, "titles").select(F.col("title").alias("name")).distinct()
    return rows.select("name", F.explode(T.name_variants(F.col("name"))).alias("variant"))


@query(f"""WITH e AS (SELECT content_id, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(?s)^.+\\.([^.]*)$', 1)) AS x, size FROM files),
g AS (SELECT content_id, count(*) AS n, sum(size) AS total, count(*) FILTER (x IN {_in(P.RULE_AUDIO)}) AS a, count(*) FILTER (x IN {_in(P.RULE_VIDEO)}) AS v, count(*) FILTER (x IN {_in(P.RULE_SOFTWARE)}) AS s,
  count(*) FILTER (x IN {_in(P.RULE_BOOK)}) AS b, count(*) FILTER (x IN ('jpg', 'jpeg')) AS j, count(*) FILTER (x = 'iso') AS iso, count(*) FILTER (x = 'pdf') AS pdf, coalesce(sum(size) FILTER (x IN {_in(P.RULE_VIDEO)}), 0) AS vs FROM e GROUP BY content_id)
SELECT content_id, CASE WHEN {_has('name', P.RULE_ADULT)} AND (v > 0 OR j > 0) THEN 'porn' WHEN a::DOUBLE / n > 0.5 AND a >= 3 AND v = 0 THEN 'music'
  WHEN v > 0 AND vs > total * 0.7::DOUBLE AND ({_has('name', P.RULE_MOVIE)} OR (v <= 3 AND vs > 524288000)) THEN 'movie' WHEN s > 0 AND ({_has('name', P.RULE_APP)} OR iso > 0) THEN 'software'
  WHEN b > 0 AND (b::DOUBLE / n > 0.5 OR (b >= 3 AND contains(lower(name), 'ebook')) OR (b = 1 AND pdf = 1 AND total < 104857600)) THEN 'book'
  WHEN a::DOUBLE / n > 0.3 AND a >= 3 THEN 'music' WHEN v > 0 AND v::DOUBLE / n > 0.3 THEN 'movie' ELSE 'other' END AS label FROM content JOIN g USING (content_id)""", "content", "files")
def m25_rule_labels(spark, sf_dir):
    from mediaspark.operators import rule_labels

    return rule_labels.label(view(spark, sf_dir, "content"), view(spark, sf_dir, "files"))


@query("""SELECT gt_id, CASE type WHEN 'movie' THEN '{"type":"video/movie","title":"' || title || '"' || coalesce(',"year":' || year, '') || '}' WHEN 'tv' THEN '{"type":"video/series","series_title":"' || title || '"' || coalesce(',"year":' || year, '') || '}'
ELSE '{"type":"audio/album","album_name":"' || title || '"' || coalesce(',"artist":"' || artist || '"', '') || coalesce(',"year":' || year, '') || '}' END AS label FROM titles""", "titles")
def a11_label_json(spark, sf_dir):
    return view(spark, sf_dir, "titles").select("gt_id", T.label_json(F.col("type"), F.col("title"), F.col("artist"), F.col("year")).alias("label"))


# -- tables -------------------------------------------------------------------------------------

@query(f"""SELECT CASE WHEN {_has('name', P.NEGATIVE)} THEN 'negative' WHEN {_has('name', P.SKIP)} THEN 'skip' WHEN {_has('name', P.AUDIO_MARKS)} AND {_has('name', P.VIDEO_MARKS)} THEN 'both' WHEN {_has('name', P.AUDIO_MARKS)} THEN 'audio'
WHEN {_has('name', P.VIDEO_MARKS)} THEN 'video' ELSE 'none' END AS marks, count(*) AS n, count(*) FILTER (size BETWEEN 400000000 AND 80000000000) AS movie_sizes, count(*) FILTER (size BETWEEN 30000000 AND 3000000000) AS album_sizes FROM names GROUP BY 1""", "names")
def f2_name_filters(spark, sf_dir):
    n = F.col("name")
    kind = (F.when(n.rlike(P.NEGATIVE), "negative").when(n.rlike(P.SKIP), "skip").when(n.rlike(P.AUDIO_MARKS) & n.rlike(P.VIDEO_MARKS), "both")
            .when(n.rlike(P.AUDIO_MARKS), "audio").when(n.rlike(P.VIDEO_MARKS), "video").otherwise("none"))
    fits = lambda k: F.count_if(F.col("size").between(*P.SIZE_RANGES[k])).alias(f"{k}_sizes")
    return view(spark, sf_dir, "names").groupBy(kind.alias("marks")).agg(F.count("*").alias("n"), fits("movie"), fits("album"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name >= substr('small widget', 1, 15) AND p_name < concat(substr('small widget', 1, 15), 'zzz')")
def f10_prefix_range(spark, sf_dir):
    prefix = "small widget"[:15]
    return _table(spark, sf_dir, "part").filter((F.col("p_name") >= prefix) & (F.col("p_name") < prefix + "zzz")).select("p_partkey", "p_name")


@query("SELECT content_id, count(*) AS tracks FROM files WHERE lower(path) LIKE '%.mp3' OR lower(path) LIKE '%.flac' GROUP BY content_id HAVING count(*) >= 3", "files")
def f12_music_records(spark, sf_dir):
    path = F.lower("path")
    rows = view(spark, sf_dir, "files").filter(path.endswith(".mp3") | path.endswith(".flac")).groupBy("content_id").agg(F.count("*").alias("tracks"))
    return rows.filter("tracks >= 3")


@query("""WITH old AS (SELECT doc_id AS k, 'old' AS v FROM documents WHERE doc_id % 3 = 0), new AS (SELECT doc_id - doc_id % 2 AS k, source AS v, doc_id AS o FROM documents),
f AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY o) AS r FROM new WHERE k NOT IN (SELECT k FROM old)) SELECT k, v FROM old UNION ALL SELECT k, v FROM f WHERE r = 1""")
def k3_insert_or_ignore(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("k"), F.lit("old").alias("v"), F.lit(0).cast("long").alias("o"))
    new = docs.select((F.col("doc_id") - F.col("doc_id") % 2).alias("k"), F.col("source").alias("v"), F.col("doc_id").alias("o"))
    return matching.insert_or_ignore(old, new, ["k"], ["o"]).select("k", "v")


@query("SELECT d.doc_id, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def k4_update_by_id(spark, sf_dir):
    new = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("_new"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("toxic")).join(new, "doc_id", "left").select("doc_id", F.coalesce("_new", "toxic").alias("toxic"))


@query("""WITH al AS (SELECT DISTINCT p_name AS canonical_name, p_brand AS alias FROM part), n AS (SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT lower(p_brand) FROM part),
f AS (SELECT n.name, al.alias AS other FROM n JOIN al ON lower(n.name) = lower(al.canonical_name)),
b AS (SELECT n.name, min(al.canonical_name) AS other FROM n JOIN al ON lower(n.name) = lower(al.alias) WHERE n.name NOT IN (SELECT name FROM f) GROUP BY n.name)
SELECT name, name AS other FROM n UNION SELECT * FROM f UNION SELECT * FROM b""")
def j10_aliases(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    known = part.select(F.col("p_name").alias("canonical_name"), F.col("p_brand").alias("alias")).distinct()
    names = part.select(F.upper("p_name").alias("name")).union(part.select(F.lower("p_brand"))).distinct()
    return matching.aliases_of(names, known)


@query("""SELECT o.o_orderkey AS album_id, c.c_name AS artist, n.n_name AS album FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE NOT (o.o_orderstatus = 'F')""")
def j8_bridge_join(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").filter("NOT (o_orderstatus = 'F')").select("o_orderkey", "o_custkey")
    customer, nation = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("o_orderkey").alias("album_id"), F.col("c_name").alias("artist"), F.col("n_name").alias("album"))


@query()
def j1_sequence_ratio(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return part.select("p_partkey", F.round(matching.sequence_ratio(T.normal_title(F.col("p_name")), F.lower("p_brand")), 6).alias("ratio"))


@query()
def s9_json_lines(spark, sf_dir):
    from mediaspark.streaming.lines import classify_lines

    lines = view(spark, sf_dir, "content").groupBy((F.col("content_id") % 100).alias("k")).agg(F.to_json(F.sort_array(F.collect_list("name"))).alias("value"))
    return classify_lines(lines)


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 50 OFFSET 25")
def a13_limit_offset(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("source", "doc_id").offset(25).limit(50)


@query("""SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, count(*) - lag(count(*)) OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) AS change FROM events GROUP BY 1, 2""")
def a21_rate_between_polls(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    return rows.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("hour")))


@query("""WITH e AS (SELECT vec_id, embedding AS x FROM embeddings), m AS (SELECT vec_id, list_transform(x, lambda v: exp(v::DOUBLE - list_max(x)::DOUBLE)) AS y FROM e)
SELECT vec_id, round(list_max(y) / list_sum(y), 5) AS top FROM m""")
def c20_softmax(spark, sf_dir):
    from mediaspark.operators.model import softmax

    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_max(softmax(F.col("embedding"))), 5).alias("top"))


@query()
def c16_model_stage(spark, sf_dir):
    from mediaspark.operators.model import keyword_model, with_model

    return with_model(classified(spark, sf_dir), keyword_model).select("content_id", "medium", "confidence", "source")


# -- catalogue and pairs ------------------------------------------------------------------------

@query()
def j9_catalogue_match(spark, sf_dir):
    from mediaspark.operators import catalog

    part = _table(spark, sf_dir, "part")
    year = (1990 + F.col("p_partkey") % 30).cast("int")
    artist = F.concat("p_brand", F.lit(" band "), F.floor(F.col("p_partkey") / 4).cast("string"))
    album = F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_name")
    known = part.select(F.col("p_partkey").alias("album_id"), artist.alias("artist"), F.concat(album, F.when(F.col("p_size") % 3 == 0, " (deluxe)").otherwise("")).alias("album"), year.alias("year"))
    wanted = part.select(F.col("p_partkey").alias("q_id"), artist.alias("q_artist"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("The "), album)).otherwise(album).alias("q_album"), year.alias("q_year"))
    return catalog.best_of_catalogue(wanted, known).select("q_id", "album_id", F.round("score", 6).alias("score"), "strategy")


#: The sequence ratios of all pairs of labels, for the oracle.
_VALUES = [*P.CLASSES5, "ERR(x)"]
_RATIOS = "CASE " + " ".join(f"WHEN n1 = {_s(x)} AND n2 = {_s(y)} THEN {SequenceMatcher(None, x.lower(), y.lower()).ratio()!r}" for x in _VALUES for y in _VALUES) + " END"


@query("""WITH v AS (SELECT id, a, b, n1, n2, CASE WHEN a IS NULL AND b IS NULL THEN 1.0 WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE CASE WHEN n1 IS NOT DISTINCT FROM n2 THEN 1.0 WHEN n1 IS NULL OR n2 IS NULL THEN 0.0 ELSE """ + _RATIOS + """ END END AS m FROM votes)
SELECT id, CASE WHEN a IS NULL AND b IS NULL THEN 'both_null' WHEN a IS NULL THEN 'model1_failed' WHEN b IS NULL THEN 'model2_failed' WHEN m >= 0.7 THEN 'agree' ELSE 'disagree' END AS status, round(m::DOUBLE, 6) AS agreement FROM v""", "votes")
def j14_extraction_agreement(spark, sf_dir):
    from mediaspark.operators import catalog

    same = catalog.field_similarity(F.col("n1"), F.col("n2"), matching.sequence_ratio(T.normal_value(F.col("n1")), T.normal_value(F.col("n2"))))
    status, mean = catalog.agreement([same], F.col("a"), F.col("b"))
    return view(spark, sf_dir, "votes").select("id", status.alias("status"), F.round(mean, 6).alias("agreement"))


@query()
def a17_training_pairs(spark, sf_dir):
    from mediaspark.operators import catalog

    return catalog.training_pairs(_table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query("""SELECT type, count(*) AS n, round(avg(CASE WHEN gt_id % 5 < 2 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS exact,
round(avg(CASE WHEN gt_id % 5 < 2 THEN 1.0 WHEN gt_id % 5 = 2 AND 2.0 * length(title) / (2 * length(title) + 1) >= 0.9 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS fuzzy FROM titles GROUP BY type""", "titles")
def a20_accuracy(spark, sf_dir):
    title = F.col("title")
    said = F.expr("CASE gt_id % 5 WHEN 0 THEN title WHEN 1 THEN concat(' ', upper(title)) WHEN 2 THEN concat(title, 'x') ELSE 'nothing' END")
    rows = view(spark, sf_dir, "titles").select("type", title, said.alias("said"))
    return metrics.accuracy(rows, "said", "title", "type").select("type", "n", F.round("exact", 6).alias("exact"), F.round("fuzzy", 6).alias("fuzzy"))


@query(r"""SELECT name_id, regexp_replace(replace(lower(trim(name)), '_', ' '), '\s+', ' ', 'g') AS folded FROM names""", "names")
def m12_folded_names(spark, sf_dir):
    from mediaspark.operators import catalog

    return view(spark, sf_dir, "names").select("name_id", catalog.folded(F.col("name")).alias("folded"))


from mediaspark.plans import more as _more  # noqa: E402, F401  it registers its queries
