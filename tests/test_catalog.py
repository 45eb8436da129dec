from difflib import SequenceMatcher

from pyspark.sql import functions as F

from mediaspark.operators import catalog, model
from mediaspark.sources import records


def test_folding(spark):
    rows = spark.createDataFrame([("  Rodríguez_Ünï – AC-DC  x",), (None,)], "s string")
    assert [r[0] for r in rows.select(catalog.folded("s")).collect()] == ["rodriguez uni - ac/dc x", None]


def test_catalogue(spark):
    known = spark.createDataFrame([(1, "Miles Davis", "Kind of Blue", 1959), (2, "Miles Davis", "Kind of Blue (deluxe)", 1959), (3, "Other Band", "Kind of Blue", 1999), (4, "Nina Simone", "Pastel Bluess", 1965)], "album_id long, artist string, album string, year int")
    wanted = spark.createDataFrame([(1, "Miles Davis", "Kind of Blue", 1959), (2, "Nina Simone", "Pastel Blues", 1965), (3, "Nobody", "Nothing", None)], "q_id long, q_artist string, q_album string, q_year int")
    got = {r["q_id"]: (r["album_id"], r["strategy"], round(r["score"], 4)) for r in catalog.best_of_catalogue(wanted, known).collect()}
    ratio = SequenceMatcher(None, "pastel blues", "pastel bluess").ratio()
    assert got == {1: (1, 1, 1.1), 2: (4, 3, round(ratio * 0.6 + 0.5, 4))}


def test_training_pairs(spark):
    names = spark.createDataFrame([(f"The Name & Co {k}",) for k in range(600)], "name string")
    rows = catalog.training_pairs(names).collect()
    assert {r["same"] for r in rows} == {True, False} and all(r["a"] != r["b"] for r in rows)
    assert ("The Name & Co 5", "Name & Co 5", True) in {tuple(r) for r in rows}


def test_argmax_takes_the_last(spark):
    row = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0],)], "z array<double>").select(model.argmax(F.col("z")), model.softmax(F.col("z"))).first()
    assert row[0] == 2 and abs(sum(row[1]) - 1) < 1e-9


def test_model_sees_only_what_no_rule_decides(spark):
    rows = spark.createDataFrame([(1, "a clip", "other", "low", "fallback"), (2, "clip", "audio", "high", "patterns"), (3, "zzz", "other", "low", "fallback")], "content_id long, name string, medium string, confidence string, source string")
    got = {r["content_id"]: tuple(r)[1:] for r in model.with_model(rows, model.keyword_model, least=0.6).collect()}
    assert got == {1: ("video", "medium", "ml"), 2: ("audio", "high", "patterns"), 3: ("other", "low", "fallback")}


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "é"}\nnot json\n{"a": 2}\n')
    rows = records.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string")
    assert sorted((r["a"], r["b"]) for r in rows.collect()) == [(1, "é"), (2, None)]
    raw = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff!"),)], "r binary")
    assert [tuple(r) for r in raw.select(records.lossy_text(F.col("r")), records.strict_text(F.col("r"))).collect()] == [("ok", "ok"), ("�!", None)]
    (tmp_path / "r.md").write_text("# Report\n\n### Sample 1\nfirst\nbody\n### Sample 12 extra\nsecond\n")
    assert [tuple(r) for r in records.read_sections(spark, str(tmp_path / "r.md")).collect()] == [(1, "first\nbody"), (12, "second")]


def test_catalogue_is_not_broadcast(spark):
    """Tables of unknown rows go to no driver: small as they look, all joins of the search are planned as merge joins."""
    known = spark.createDataFrame([(1, "Miles Davis", "Kind of Blue", 1959)], "album_id long, artist string, album string, year int")
    wanted = spark.createDataFrame([(1, "Miles Davis", "Kind of Blue", 1959)], "q_id long, q_artist string, q_album string, q_year int")
    plan = catalog.best_of_catalogue(wanted.limit(1), known.limit(1))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
