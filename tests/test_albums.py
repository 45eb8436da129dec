"""The album rules, the matcher's similarity, annotation, records and the command line on small cases."""

import io
import json
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from mediaspark.__main__ import main
from mediaspark.functions import albums
from mediaspark.operators import annotate, matching, model, records, safety

CASES = [
    ("Artist - Title (1999) [FLAC]", 1, ("Artist", "Title", 1999)),
    ("[2024.11.22] Artist - Title", 1, ("Artist", "Title", None)),
    ("[2024.11.22] Artist - Title", 2, ("Artist", "Title", 2024)),
    ("Artist - Title (2024 Pop)", 3, ("Artist", "Title", 2024)),
    ("SZA - SOS", 2, (None, None, None)),
    ("SZA - SOS", 3, ("SZA", "SOS", None)),
    ("[ OxTorrent.com ] Artist - Title 2019 WEB", 4, ("Artist", "Title", 2019)),
    ("[2003] Meteora - Linkin Park - 91mb @ 320kbs", 5, ("Linkin Park", "Meteora", 2003)),
    ("[2003] Meteora - Linkin Park - 91mb @ 320kbs", 9, None),
]
FILES = "content_id long, path string, filename string, size long"


def test_versions_of_the_album_rules(spark):
    for name, version, want in CASES:
        got = spark.createDataFrame([(name,)], "name string").select(albums.album(F.col("name"), version).alias("p"), albums.album(F.col("name"), 1).alias("one")).first()
        assert tuple(got["p"]) == (want or tuple(got["one"])), name


def test_title_similarity_is_the_larger_of_two(spark):
    """Against a plain version: the share of contained words, and the sequence ratio to the name's beginning."""
    titles = ["the great escape from nowhere", "great escapes", "abc", "one two three four five", "Film!"]
    names = ["The.Great.Escape.1963.1080p", "great escape from now here", "a b c", "one two three four", "films of today", "", "The Great Escape from Nowhere FLAC"]
    rows = spark.createDataFrame([(t, n) for t in titles for n in names], "title string, name string")
    norm, words = matching.T.normal_title, matching.pieces
    rows = rows.select("title", "name", norm(F.col("title")).alias("_title"), norm(F.col("name")).alias("_normal"), words(F.col("name")).alias("_pieces"))
    rows = rows.withColumn("_title_share", matching.contained_words(F.col("_title"), F.col("_normal"), F.col("_pieces"))).drop("_pieces")
    for r in matching.with_similarity(rows, "_title").collect():
        title, name = r["_title"], r["_normal"]
        parts = re.split(r"[.\-_\s\[\]()]+", r["name"].lower())
        share = sum(any(w in p for p in parts) for w in title.split()) / len(title.split())
        want = 1.0 if title in name else max(share, SequenceMatcher(None, title, name[:2 * len(title)]).ratio())
        assert abs(r["_title_alike"] - want) < 1e-9, r


def test_candidates_of_frequent_words(spark):
    """Titles whose words are all frequent are found by two of them, and every name that holds all is a candidate."""
    words = ["red", "blue", "green", "old", "new"]
    names = [(k, " ".join(w for i, w in enumerate(words) if k >> i & 1) + f" x{k}") for k in range(32)]
    titles = [(k, [words[a], words[b]]) for k, (a, b) in enumerate([(0, 1), (2, 4), (3, 4)])] + [(9, ["red"]), (10, ["x7", "red"]), (11, ["absent"])]
    got = matching.candidates(spark.createDataFrame(titles, "gt_id long, wanted array<string>"), spark.createDataFrame(names, "name_id long, name string"), frequent=4)
    want = sorted((t, n) for t, w in titles for n, name in names if set(w) <= set(name.split()))
    assert sorted((r["gt_id"], r["name_id"]) for r in got.collect()) == want


def test_annotation(spark):
    content = spark.createDataFrame([(1, "Artist - Album (1999) [FLAC]"), (2, "Movie.2020.1080p.BluRay.x264"), (3, "no idea"), (4, "Some XXX video")], "content_id long, name string")
    files = spark.createDataFrame([(1, "a/1.flac", "1.flac", 10), (1, "a/2.flac", "2.flac", 10), (2, "m.mkv", "m.mkv", 10**9)], FILES)
    got = {r["content_id"]: json.loads(r["json"]) for r in annotate.as_json(annotate.annotate(content, files, extractor=annotate.rule_extractor)).collect()}
    assert got[1] == {"medium": "audio", "subcategory": "album", "confidence": 0.95, "source": got[1]["source"], "metadata": {"title": "Album", "artist": "Artist", "year": 1999}, "nsfw": False, "nsfw_confidence": 0.5, "nsfw_source": "ml"}
    assert got[2]["subcategory"] == "movie" and got[3]["medium"] == "other" and "metadata" not in got[3] and got[4]["nsfw"]
    direct = {r["content_id"]: r["medium"] for r in annotate.classify_directly(content, files, model.keyword_model).collect()}
    assert set(direct) == {1, 2, 3, 4}


def test_safety_logits(spark):
    cases = [([0.0, 2.0], True, 0.880797), ([2.0, 0.0], False, 0.880797), ([1.0, 1.0], False, 0.5), ([0.7], True, 0.7), ([0.2], False, 0.8), ([], False, 0.5)]
    for logits, nsfw, sure in cases:
        got = spark.createDataFrame([(logits,)], "x array<double>").select(safety.from_logits(F.col("x")).alias("s")).first()["s"]
        assert (got["nsfw"], round(got["confidence"], 6)) == (nsfw, sure)
    assert not safety.has_model_stage(safety.heuristics()) and safety.has_model_stage([safety.model_stage(lambda t: F.array(F.lit(0.0), F.lit(1.0)))])


def test_validation(spark):
    wanted = [(1, "movie", "Some Film", None, 2000), (2, "movie", "Some Film", None, 2000), (3, "album", "Title", "Artist", None), (4, "tv", "Show", None, None)]
    results = [(1, 1, "Other", None, 2000), (1, 2, "Some Film", None, 2001), (2, 1, "Some Film", None, 1990), (3, 1, "Title", "Nobody", None), (3, 2, "Title", "Artists", None), (4, 6, "Show", None, None)]
    got = records.validated(spark.createDataFrame(wanted, "id long, kind string, title string, artist string, year int"), spark.createDataFrame(results, "id long, place int, title string, artist string, year int"))
    assert sorted((r["id"], r["place"]) for r in got.collect()) == [(1, 2), (3, 2)]


def test_command_line(spark, tmp_path):
    def run(args, text=""):
        out = io.StringIO()
        code = main(args, io.StringIO(text), out, spark)
        return code, [json.loads(x) for x in out.getvalue().splitlines()]

    folder = tmp_path / "Artist - Album (1999)"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.mp3").write_bytes(b"x" * 100)
    code, got = run([str(folder)])
    assert code == 0 and got[0]["medium"] == "audio" and got[0]["subcategory"] == "album" and got[0]["metadata"]["artist"] == "Artist"
    assert run(["Movie.2020.1080p.BluRay.x264-GRP"])[1][0]["medium"] == "video"
    assert run(["--detect-nsfw"], " Some XXX video \n")[1][0]["nsfw"] is True
    assert run([], "  ") == (1, [])
    assert [[x["medium"] for x in line] for line in run(["-i"], '["Movie.2020.1080p.BluRay.x264", "?"]\nbroken\n')[1]] == [["video", "other"]]


def test_album_rules_are_computed_once(spark):
    """The plan holds each pattern a few times, not once for every way to reach it, and all versions at once are what each says alone."""
    rows = spark.createDataFrame([(c[0],) for c in CASES] + [(None,), ("",), ("[2003] - @ 320",), ("♪ [1999] A - B - 9mb @ 128kbs",)], "name string")
    name = F.col("name")
    for version in range(1, 6):
        one = rows.select(albums.album(name, version).alias("p")).select("p.artist", "p.title", "p.year")
        assert one._jdf.queryExecution().optimizedPlan().toString().count("regexp_") < 150, version
    every = rows.select("name", F.explode(albums.albums(name, [*range(1, 7)])).alias("p")).select("name", "p.*")
    got = {(r["name"], r["version"]): tuple(r)[2:] for r in every.collect()}
    for version in range(1, 7):
        for r in rows.select("name", albums.album(name, version).alias("p")).collect():
            assert got[r["name"], version] == (tuple(r["p"]) if r["p"] else (None,) * 3), (r["name"], version)


def test_candidates_of_repeated_titles(spark):
    """Rows that share a gt_id are titles of their own, equal ones included; a name without tokens or null is none's candidate."""
    names = spark.createDataFrame([(1, "red blue"), (2, "Red green"), (3, "--"), (4, None), (None, "red green blue")], "name_id long, name string")
    titles = [(1, ["red", "blue"], "a"), (1, ["red", "green"], "b"), (1, ["red", "green"], "b"), (2, ["green", "re"], "c"), (3, None, "d")]
    for frequent in (0, 1, 9):
        rows = matching.candidates(spark.createDataFrame([t[:2] for t in titles], "gt_id long, wanted array<string>"), names, frequent)
        assert sorted((r["gt_id"], r["name_id"]) for r in rows.collect()) == [(1, 1), (1, 2), (1, 2)]
    rows = matching.candidates(spark.createDataFrame(titles[:2], "gt_id long, wanted array<string>, title string"), names)
    assert sorted((r["title"], r["name_id"], r["name"]) for r in rows.collect()) == [("a", 1, "red blue"), ("b", 2, "Red green")]
