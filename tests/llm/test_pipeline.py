"""The pipeline against stages in plain Python."""

import corpus_pipeline
from mediaspark.llm import packing


def test_stages_keep_what_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    kept = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        kept = function(spark, kept, sf_dir)
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name == "language ID":
            assert ids == {i for i, t in texts.items() if any(map(str.isalpha, t or ""))}
            before = ids
        if name == "exact dedup":
            last = {}
            for i in sorted(before):
                last[texts[i]] = i
            assert ids == set(last.values())
        if name == "benchmark decontamination":
            items = {r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
            assert not [i for i in ids if any(t in texts[i] for t in items)]
    last = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == ids
    enc = packing.Encoder(packing.default_tokenizer())
    assert last.agg({"length": "sum"}).first()[0] == sum(len(enc.direct(texts[i])) + 1 for i in ids)


def test_copies_go_by_row(spark):
    """Rows without a doc_id, and with one that repeats, lose only the copies among them."""
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(None, "a copy", 0), (1, "a copy", 1), (None, "unique", 2), (5, "first text", 3), (5, "a second", 4), (9, "first text", 5), (None, "twice", 6), (None, "twice", 7), (3, "same row", 8), (3, "same row", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["text"], r["doc_id"] or 0) for r in kept.collect()) == [("a copy", 1), ("a second", 5), ("first text", 9), ("same row", 3), ("twice", 0), ("unique", 0)]
    near = [(None, long + " x", 0), (4, long + " y", 1), (4, "other words here", 2), (None, "more words", 3), (2, long, 4)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(near, "doc_id long, text string, n long"), "")
    assert sorted(r["n"] for r in kept.collect()) == [2, 3, 4] and kept.columns == docs.columns


def test_documents_without_labels_stay(spark):
    rows = [(1, "some words", None), (2, "日本", None), (3, "12 !", None), (4, None, None), (5, "", None)]
    kept = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_odd_tables_pass_through_all_stages(spark, tmp_path):
    """Nulls, repeated rows, ties, empty and long texts, columns that operators use themselves; then an empty table."""
    rows = [(1, "a b c d e f g", None), (1, "a b c d e f g", None), (None, None, None), (None, "x", "de"), (2, "", "en"), (3, "\x00 é\n\n \t", "fr"), (4, "word " * 2000, "en"),
            (5, "z" * 20_000, "en"), (6, "b c d e f g h i", "en"), (6, "other words", "en"), (8, "Other words", "en")]
    extra = ", kept boolean, score double, lang_pred string, doc long, _row long"
    spark.createDataFrame([(1, "a b c d e f g"), (None, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([r + (None,) * 5 for r in rows], "doc_id long, text string, lang string" + extra).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {None, 3, 4, 5, 6} and len({(r["doc_id"], r["ids_crc32"]) for r in out if r["doc_id"] == 6}) == 2
    spark.createDataFrame([], "doc_id long, text string, lang string" + extra).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_copies_go(spark, sf_dir):
    """Of documents that are linked by five-word shingles the smallest doc_id stays, against all pairs."""
    from test_operators import components_by_brute_force

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, _ = components_by_brute_force(texts, 5, 80)
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, root in want.items() if i == root}
