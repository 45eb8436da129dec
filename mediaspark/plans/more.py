"""Further registered queries: versions of the album rules, annotation, texts and tables made of records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediaspark.functions import albums
from mediaspark.functions import patterns as P
from mediaspark.operators import annotate, cascade, matching, metrics, model, records, safety, voting
from mediaspark.plans.fixtures import view
from mediaspark.plans.queries import _CLASSIFIED, _CLEANED, _HUMAN, _SQUEEZE, _STRIP, _YEARS, ORACLE, _get, _has, _in, _list, _replaced, _s, _table, query

# -- albums -------------------------------------------------------------------------------------


def _by(expression: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        expression = _replaced(expression, [pattern], by)
    return expression


def _album_sql(version: int) -> str:
    """(id, artist, title, year) of releases by one version below the latest."""
    before, more, after = albums.STEPS[version]
    year, rest = [], []
    for pattern, least, most in more:
        told = f"try_cast({_get('cn', albums.around(pattern), 2)} AS INT)"
        year.append(f"WHEN {told} BETWEEN {least} AND {most} THEN {told}")
        rest.append(f"WHEN {told} BETWEEN {least} AND {most} THEN " + " || ".join(f"regexp_extract(cn, {_s(albums.around(pattern))}, {k})" for k in (1, 3)))
    for pattern, whole in _YEARS:
        told = f"try_cast({_get('cn', pattern)} AS INT)"
        year.append(f"WHEN {told} BETWEEN 1900 AND 2030 THEN {told}")
        rest.append(f"WHEN {told} BETWEEN 1900 AND 2030 THEN " + _STRIP(f"regexp_extract(cn, {_s(whole)}, 1) || regexp_extract(cn, {_s(whole)}, 3)"))
    return f"""SELECT id, {_STRIP(_get('n', P.ARTIST_TITLE, 1))} AS artist, {_replaced(_STRIP(_get('n', P.ARTIST_TITLE, 2)), P.TITLE_ENDS)} AS title, year FROM (
      SELECT id, year, {_SQUEEZE(_by('rest', after))} AS n FROM (
        SELECT id, CASE {' '.join(year)} END AS year, CASE {' '.join(rest)} ELSE cn END AS rest FROM (
          SELECT id, {_by(_CLEANED, before)} AS cn FROM releases)))"""


_PART = lambda k: f"regexp_extract(cn, {_s(albums.TITLE_FIRST)}, {k})"
_LAST = _STRIP(_replaced(_STRIP(_PART(3)), albums.ARTIST_ENDS_5))
_ALBUM5 = f"""SELECT o.id, CASE WHEN f THEN t.artist ELSE o.artist END AS artist, CASE WHEN f THEN t.title ELSE o.title END AS title, CASE WHEN f THEN t.year ELSE o.year END AS year FROM ({_album_sql(4)}) o
  JOIN (SELECT id, try_cast(nullif({_PART(1)}, '') AS INT) AS year, {_STRIP(_PART(2))} AS title, {_LAST} AS artist,
    coalesce(try_cast(nullif({_PART(1)}, '') AS INT) BETWEEN 1900 AND 2030 AND {_STRIP(_PART(2))} <> '' AND length({_LAST}) > 1, false) AS f
    FROM (SELECT id, {_replaced(_CLEANED, [albums.EMOJI_5])} AS cn FROM releases)) t ON o.id = t.id"""
_ALBUM = {k: _album_sql(k) for k in albums.STEPS} | {5: _ALBUM5}


def _album(spark, sf_dir, version: int):
    return view(spark, sf_dir, "releases").select("id", albums.album(F.col("name"), version).alias("p")).select("id", "p.artist", "p.title", "p.year")


@query(_ALBUM[1], "releases")
def m9_album_v1(spark, sf_dir):
    return _album(spark, sf_dir, 1)


@query(_ALBUM[2], "releases")
def m9_album_v2(spark, sf_dir):
    return _album(spark, sf_dir, 2)


@query(_ALBUM[3], "releases")
def m9_album_v3(spark, sf_dir):
    return _album(spark, sf_dir, 3)


@query(_ALBUM[4], "releases")
def m9_album_v4(spark, sf_dir):
    return _album(spark, sf_dir, 4)


@query(_ALBUM[5], "releases")
def m9_album_v5(spark, sf_dir):
    return _album(spark, sf_dir, 5)


@query("SELECT version, count(artist) AS artists, count(year) AS years, count(DISTINCT title) AS titles FROM ("
       + " UNION ALL ".join(f"SELECT {k} AS version, artist, title, year FROM ({_ALBUM.get(k, _ALBUM[1])})" for k in range(1, 7)) + ") GROUP BY version", "releases")
def m10_album_versions(spark, sf_dir):
    every = F.explode(albums.albums(F.col("name"), [*range(1, 7)]))  # the sixth is unknown
    rows = view(spark, sf_dir, "releases").select(every.alias("p")).select("p.*")
    return rows.groupBy("version").agg(F.count("artist").alias("artists"), F.count("year").alias("years"), F.countDistinct("title").alias("titles"))


# -- annotation ---------------------------------------------------------------------------------

@query(f"""SELECT k.content_id, k.medium, k.subcategory, CASE k.confidence WHEN 'high' THEN 0.95::DOUBLE WHEN 'medium' THEN 0.75 ELSE 0.5 END AS confidence, k.source, n.nsfw, n.confidence AS nsfw_confidence, n.source AS nsfw_source
FROM ({ORACLE['c1_cascade']}) k JOIN ({ORACLE['n1_safety_cascade']}) n ON k.content_id = n.content_id""")
def c26_annotate(spark, sf_dir):
    return annotate.annotate(view(spark, sf_dir, "content"), view(spark, sf_dir, "files")).drop("name", "metadata")


@query(f"""SELECT k.content_id, '{{"medium":"' || k.medium || '"' || coalesce(',"subcategory":"' || k.subcategory || '"', '') || ',"confidence":' || CASE k.confidence WHEN 'high' THEN '0.95' WHEN 'medium' THEN '0.75' ELSE '0.5' END || ',"source":"' || k.source || '"}}' AS json
FROM ({ORACLE['c1_cascade']}) k""")
def c26_annotation_json(spark, sf_dir):
    return annotate.as_json(annotate.annotate(view(spark, sf_dir, "content"), view(spark, sf_dir, "files"), with_safety=False))


@query()
def c21_direct_classify(spark, sf_dir):
    return annotate.classify_directly(view(spark, sf_dir, "content"), view(spark, sf_dir, "files"), model.keyword_model)


@query("""WITH l AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)
SELECT vec_id, b > a AS nsfw, round(1 / (1 + exp(-abs(a - b))), 5) AS confidence FROM l""")
def n4_safety_logits(spark, sf_dir):
    said = safety.from_logits(F.slice("embedding", 1, 2))  # the model has two logits
    return _table(spark, sf_dir, "embeddings").select("vec_id", said.alias("s")).select("vec_id", "s.nsfw", F.round("s.confidence", 5).alias("confidence"))


@query(f"""WITH m AS (SELECT content_id, max(filename LIKE 'S01%') AS k FROM files GROUP BY content_id)
SELECT content_id, coalesce(k, false) OR contains(c.name, 'XXX') AS nsfw, CASE WHEN coalesce(k, false) THEN 0.8::DOUBLE WHEN contains(c.name, 'XXX') THEN 0.7 ELSE 0.5 END AS confidence,
CASE WHEN coalesce(k, false) THEN 'first' WHEN contains(c.name, 'XXX') THEN 'second' ELSE 'ml' END AS source FROM content c LEFT JOIN m USING (content_id)""", "content", "files")
def n5_safety_plugins(spark, sf_dir):
    stages = [("first", 0.8, lambda t: t.startswith("S01"), False), ("second", 0.7, lambda t: F.contains(t, F.lit("XXX")), False)]
    return safety.judge(view(spark, sf_dir, "content"), view(spark, sf_dir, "files"), stages)


# -- texts and tables of records ----------------------------------------------------------------

@query(f"""WITH h AS (SELECT content_id, regexp_extract(path, '([^/]*)$', 1) AS base, path, filename, row_number() OVER (PARTITION BY content_id ORDER BY size DESC, path, filename) AS k, size::DOUBLE AS s0 FROM files),
t AS (SELECT content_id, string_agg('  ' || base || ' (' || {_HUMAN} || ')', chr(10) ORDER BY k) AS top FROM h WHERE k <= 3 GROUP BY content_id)
SELECT content_id, {_s(records.PROMPT_HEAD)} || c.name || {_s(records.PROMPT_FILES)} || coalesce(t.top, '') || {_s(records.PROMPT_END)} AS prompt FROM content c LEFT JOIN t USING (content_id)""", "content", "files")
def m23_prompts(spark, sf_dir):
    return records.prompts(view(spark, sf_dir, "content"), view(spark, sf_dir, "files"))


@query("""WITH h AS (SELECT content_id, path, row_number() OVER (PARTITION BY content_id ORDER BY path) AS k FROM files),
t AS (SELECT content_id, string_agg(path, ' | ' ORDER BY k) AS top FROM h WHERE k <= 3 GROUP BY content_id)
SELECT content_id, c.name || coalesce(' | ' || t.top, '') AS text FROM content c LEFT JOIN t USING (content_id)""", "content", "files")
def m24_training_texts(spark, sf_dir):
    return records.training_texts(view(spark, sf_dir, "content"), view(spark, sf_dir, "files"))


@query(r"""SELECT content_id, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(?s)^.+\.([^.]*)$', 1)) AS ext, count(*) AS n, sum(size)::BIGINT AS bytes FROM files GROUP BY 1, 2 HAVING ext <> ''""", "files")
def m26_extension_counts(spark, sf_dir):
    return records.extension_counts(view(spark, sf_dir, "files"))


@query("SELECT content_id, string_agg(path, chr(10) ORDER BY path) AS tree FROM files GROUP BY content_id", "files")
def m26_file_tree(spark, sf_dir):
    return records.file_tree(view(spark, sf_dir, "files"))


@query("SELECT DISTINCT d.doc_id, d.source FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s11_point_lookup(spark, sf_dir):
    ids = _table(spark, sf_dir, "labels").filter("toxic = 1")
    return records.by_id(_table(spark, sf_dir, "documents").select("doc_id", "source"), ids, "doc_id")


@query("SELECT CASE WHEN a IS NOT NULL AND a = b THEN 'done' ELSE 'todo' END AS queue, count(*) AS n, sum(id)::BIGINT AS ids FROM votes GROUP BY 1", "votes")
def k5_move_done(spark, sf_dir):
    rows = view(spark, sf_dir, "votes").select("id", "a", "b")
    todo, done = records.move(rows, rows.limit(0), F.col("a") == F.col("b"))
    both = todo.withColumn("queue", F.lit("todo")).unionByName(done.withColumn("queue", F.lit("done")))
    return both.groupBy("queue").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("""WITH c AS (SELECT source, coalesce(lang, 'none') AS lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT source, '## ' || source || chr(10) || chr(10) || '| label | n | share |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' | ' || printf('%.1f', 100.0 * n / t) || '% |', chr(10) ORDER BY n DESC, lang) AS section
FROM (SELECT *, sum(n) OVER (PARTITION BY source) AS t FROM c) GROUP BY source""")
def k6_report(spark, sf_dir):
    counts = _table(spark, sf_dir, "documents").groupBy("source", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"))
    return records.report(counts, "source", "lang", "n")


@query("""WITH a AS (SELECT p_name AS name, list(DISTINCT p_brand) AS al FROM part GROUP BY p_name), e AS (SELECT name, name AS alias FROM a UNION SELECT name, unnest(al) FROM a),
w AS (SELECT lower(trim(p_brand)) AS k FROM part WHERE p_retailprice > 1500 UNION SELECT lower(p_name) FROM part WHERE p_partkey % 50 = 0)
SELECT name AS canonical_name, alias FROM e WHERE name IN (SELECT name FROM e JOIN w ON lower(trim(alias)) = k)""")
def j11_flat_aliases(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    artists = part.groupBy(F.col("p_name").alias("name")).agg(F.collect_set("p_brand").alias("aliases"))
    wanted = part.filter("p_retailprice > 1500").select(F.concat(F.lit(" "), F.upper("p_brand")).alias("name")).union(part.filter("p_partkey % 50 = 0").select("p_name"))
    return records.flat_aliases(artists, wanted)


@query("SELECT gt_id, CASE WHEN coalesce(artist, '') <> '' AND title <> '' THEN 'spotify:' || artist[1:50] || ':' || title[1:50] END AS key FROM titles", "titles")
def j16_external_key(spark, sf_dir):
    return view(spark, sf_dir, "titles").select("gt_id", records.external_key("spotify", F.col("artist"), F.col("title")).alias("key"))


@query("""SELECT count(*) FILTER (n1 IS NOT NULL AND n2 IS NOT NULL AND n3 IS NULL AND a IS NULL) AS third, count(*) FILTER (n1 IS NOT NULL AND n2 IS NOT NULL AND n3 IS NOT NULL AND n4 IS NULL AND c IS NULL) AS big FROM votes""", "votes")
def a8_next_tiers(spark, sf_dir):
    c = F.col
    third, big = voting.next_voter([c("n1"), c("n2")], c("n3"), c("a")), voting.next_voter([c("n1"), c("n2"), c("n3")], c("n4"), c("c"))
    return view(spark, sf_dir, "votes").agg(F.count_if(third).alias("third"), F.count_if(big).alias("big"))


@query(f"""WITH l AS (SELECT unnest(['a', 'b', 'c', 'big']) AS "column", unnest([a, b, c, big]) AS value FROM votes)
SELECT "column", count(*) AS n, string_agg(DISTINCT value, ',' ORDER BY value) AS kinds FROM l WHERE value IS NOT NULL AND value NOT IN {_in(P.CLASSES6)} GROUP BY 1""", "votes")
def a22_invalid_kinds(spark, sf_dir):
    found = voting.invalid_labels(P.CLASSES6, **{c: F.col(c) for c in ("a", "b", "c", "big")})
    rows = view(spark, sf_dir, "votes").select(F.explode(found).alias("p"))
    return rows.groupBy("p.column").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("p.value")), ",").alias("kinds"))


@query("""WITH v AS (SELECT coalesce(n1, 'none') AS t, coalesce(n2, 'none') AS p FROM votes), l AS (SELECT t AS x FROM v UNION SELECT p FROM v),
f AS (SELECT x, (SELECT count(*) FROM v WHERE t = x) AS sup, (SELECT count(*) FROM v WHERE p = x) AS said, (SELECT count(*) FROM v WHERE t = x AND p = x) AS hit FROM l),
g AS (SELECT sup, CASE WHEN sup + said > 0 THEN 2.0::DOUBLE * hit / (sup + said) ELSE 0 END AS f1 FROM f)
SELECT round((SELECT avg(CASE WHEN t = p THEN 1.0::DOUBLE ELSE 0 END) FROM v), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * sup) / sum(sup), 6) AS weighted_f1 FROM g""", "votes")
def a19_overall(spark, sf_dir):
    rows = view(spark, sf_dir, "votes").select(F.coalesce("n1", F.lit("none")).alias("t"), F.coalesce("n2", F.lit("none")).alias("p"))
    out = metrics.overall(metrics.confusion(rows, "t", "p"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query(f"SELECT count(*) FILTER ({_has('name', P.SKIP)}) AS wide, count(*) FILTER ({_has('name', P.SKIP_FEW)}) AS narrow, count(*) FILTER ({_has('name', P.VIDEO_MARKS)}) AS matcher, count(*) FILTER ({_has('name', P.EXTRACTOR_VIDEO_MARKS)}) AS extractor FROM names", "names")
def f3_pattern_lists(spark, sf_dir):
    n = F.col("name")
    return view(spark, sf_dir, "names").agg(*[F.count_if(n.rlike(p)).alias(k) for k, p in (("wide", P.SKIP), ("narrow", P.SKIP_FEW), ("matcher", P.VIDEO_MARKS), ("extractor", P.EXTRACTOR_VIDEO_MARKS))])


@query(f"""WITH x AS (SELECT a.artist IS NOT DISTINCT FROM b.artist AND a.title IS NOT DISTINCT FROM b.title AND a.year IS NOT DISTINCT FROM b.year AS same FROM ({_ALBUM[4]}) a JOIN ({_ALBUM5}) b ON a.id = b.id)
SELECT count(*) AS total, count(*) FILTER (same) AS passed FROM x""", "releases")
def a23_regression(spark, sf_dir):
    old, new = _album(spark, sf_dir, 4), _album(spark, sf_dir, 5).toDF("id", "artist5", "title5", "year5")
    summary, _ = records.regression(old.join(new, "id"), ["artist5", "title5", "year5"], ["artist", "title", "year"])
    return summary


@query("""WITH r AS (SELECT event_type, count(*) AS n, (extract(epoch FROM max(ts)) - extract(epoch FROM min(ts)))::BIGINT AS elapsed FROM events GROUP BY 1)
SELECT event_type, n, elapsed, CASE WHEN elapsed > 0 THEN round(n::DOUBLE / elapsed, 6) END AS rate, CASE WHEN elapsed > 0 THEN round((1000000 - n) * (elapsed::DOUBLE / n), 1) END AS eta FROM r""")
def a21_rate_and_eta(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("_b"), F.min("ts").alias("_a"))
    rows = rows.select("event_type", "n", metrics.seconds_between(F.col("_a"), F.col("_b")).alias("elapsed"))
    rate, eta = metrics.progress(F.col("n"), F.lit(1_000_000), F.col("elapsed"))
    near = lambda c, k: F.round(c * k) / k  # noqa: E731  (the SQL rounds the double times k; F.round its decimal text, which differs at ties)
    return rows.select("event_type", "n", "elapsed", near(rate, 1e6).alias("rate"), near(eta, 10.0).alias("eta"))
