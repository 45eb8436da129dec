"""Cases of single rules."""

import pytest
from pyspark.sql import functions as F

from mediaspark.functions import files as fs
from mediaspark.functions import patterns as P
from mediaspark.functions import release
from mediaspark.functions import text as T
from mediaspark.operators import cascade, matching, safety, voting


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


def classify(spark, name, files=()):
    content = spark.createDataFrame([(1, name)], "content_id long, name string")
    rows = [(1, path, path.rsplit("/", 1)[-1], size) for path, size in files]
    found = cascade.heuristics().classify(cascade.profile(content, spark.createDataFrame(rows, "content_id long, path string, filename string, size long")))
    r = found.withColumn("sub", cascade.subcategory(F.col("medium"))).first()
    return r["medium"], r["confidence"], r["source"], r["sub"]


@pytest.mark.parametrize("name, files, want", [
    ("x", [("a.mkv", 10**9), ("a.srt", 50_000)], ("video", "high", "extensions", "movie")),
    ("x", [("CD1/a.MP3", 10**7), ("CD1/b.mp3", 10**7), ("c.jpg", 10**5)], ("audio", "high", "extensions", "album")),
    ("x", [("1/a.flac", 5), ("2/b.flac", 5)], ("audio", "high", "extensions", "collection")),
    ("x", [("S01E02.mkv", 5)], ("video", "high", "extensions", "episode")),
    ("some words", [("a.mkv", 5 * 10**8), ("b.mp3", 4 * 10**8)], ("other", "low", "fallback", None)),
    ("x", [("disk.iso", 4 * 10**9)], ("other", "low", "fallback", None)),
    ("Movie.2024.1080p.BluRay.x264-GROUP", [], ("video", "high", "patterns", "other")),
    ("Some.Movie.720p", [], ("video", "medium", "patterns", "other")),
    ("SomeApp v2.5.1 x64 Portable", [], ("software", "high", "patterns", None)),
    ("Ghost Stories MP3", [], ("audio", "high", "patterns", "other")),
    ("random file name", [], ("other", "low", "fallback", None)),
])
def test_cascade(spark, name, files, want):
    assert classify(spark, name, files) == want


def test_cascade_is_pluggable(spark):
    stage = ("mine", lambda: F.when(F.col("name") == "q", cascade.result("book", "low", "mine")))
    c = cascade.Cascade().add_stage(stage)
    assert c.stage_count == 1
    rows = spark.createDataFrame([(1, "q"), (2, "z")], "content_id long, name string")
    assert {r["content_id"]: r["source"] for r in c.classify(rows).collect()} == {1: "mine", 2: "fallback"}


@pytest.mark.parametrize("name, want", [("a.tar.gz", "gz"), (".hidden", ""), ("x/Y.MKV", "mkv"), ("plain", ""), ("a.b/c", "")])
def test_extension(spark, name, want):
    assert one(spark, fs.extension(F.col("a")), a=name) == want


@pytest.mark.parametrize("n, want", [(100, "100.0B"), (1024, "1.0KB"), (1280, "1.2KB"), (1 << 20, "1.0MB"), (1 << 30, "1.0GB")])
def test_human_size(spark, n, want):
    assert one(spark, fs.human_size(F.col("a")), a=n) == want


def test_release_names(spark):
    r = one(spark, release.parsed(F.col("a")), a="Breaking.Show.S05E16.720p.WEB-DL.DD5.1.H.264")
    assert (r["resolution"], r["quality_tier"], r["audio_codec"], r["video_codec"], r["season"], r["episode"]) == ("720p", "WebDL", "AC3", "H264", 5, 16)
    r = one(spark, release.parsed(F.col("a")), a="Movie.2024.1080p.VOSTFR.BluRay.x264-GROUP")
    assert r["language"]["subtitles"] == ["French"] and r["language"]["audio"] == []
    r = one(spark, release.parsed(F.col("a")), a="Movie.2024.1080p.ENG.ITA.BluRay.x264")
    assert r["language"]["audio"] == ["English", "Italian"]
    assert one(spark, release.parsed(F.col("a")), a=None)["resolution"] is None


@pytest.mark.parametrize("text, want", [("Some.XXX.Content", True), ("Analysis of data", False), ("Tool UTF-1234", True), ("Editor.2024.v25.1", False)])
def test_safety(spark, text, want):
    assert one(spark, safety.judge_text(F.col("a")), a=text) is want


@pytest.mark.parametrize("answer, six, five", [("happy", "software", "software"), ("Audiobook", "book", "audio"), (" VIDEO ", "video", "video"), ("none", None, None), ("porn", "porn", "video")])
def test_labels(spark, answer, six, five):
    assert one(spark, T.label(F.col("a"), P.CLASSES6, P.ALIASES6), a=answer) == six
    assert one(spark, T.label(F.col("a"), P.CLASSES5, P.ALIASES5), a=answer) == five


@pytest.mark.parametrize("votes, want", [
    (("music", "music", "music", None), ("music", "music")), (("music", "music", "video", "music"), (None, "music")), (("music", "music", "video", "video"), (None, None)),
    (("music", "music", "video", "book"), (None, "music")), (("music", "other", "video", "book"), (None, None)), (("music", "?", "video", "music"), (None, None)), (("music", "music", "video", None), (None, None))])
def test_four_voters(spark, votes, want):
    c, m = voting.four_voters(*map(F.col, "abcd"), P.CLASSES6)
    r = spark.createDataFrame([votes], "a string, b string, c string, d string").select(c.alias("c"), m.alias("m")).first()
    assert tuple(r) == want


@pytest.mark.parametrize("votes, want", [(["audio"] * 3 + ["video"] * 3, "audio"), (["video", "audio"] * 4, "video"), (["video", "audio", "book"] * 2, None), ([None] * 6, None)])
def test_quorum(spark, votes, want):
    cols = [F.lit(v).cast("string") for v in votes]
    assert one(spark, voting.quorum(cols, P.CLASSES5)) == want


def test_sequence_ratio(spark):
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "a")], "a string, b string")
    assert [r[0] for r in rows.select(matching.sequence_ratio("a", "b")).collect()] == [0.25, 0.5, 0.0]


def test_insert_or_ignore(spark):
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b")], "k long, v string")
    assert sorted(map(tuple, matching.insert_or_ignore(old, new, ["k"], ["v"]).collect())) == [(1, "a"), (2, "b")]


def test_aliases(spark):
    known = spark.createDataFrame([("AC/DC", "Acca Dacca"), ("Prince", "The Artist")], "canonical_name string, alias string")
    names = spark.createDataFrame([("ac/dc",), ("the artist",), ("nobody",)], "name string")
    assert sorted(map(tuple, matching.aliases_of(names, known).collect())) == [("ac/dc", "Acca Dacca"), ("ac/dc", "ac/dc"), ("nobody", "nobody"), ("the artist", "Prince"), ("the artist", "the artist")]


def test_year_guard(spark):
    p = one(spark, T.parse_answer(F.col("a"), F.lit(2), F.col("n")), a="The Matrix | 1999 | x", n="the.matrix.1999")
    assert tuple(p) == ("The Matrix", None, 1999)
    assert one(spark, T.parse_answer(F.col("a"), F.lit(2), F.col("n")), a="Bad | 2023", n="bad")["year"] is None
