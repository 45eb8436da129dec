"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

A test item is contained in a document if at least NUM / DEN of its distinct WIDTH-word shingles occur there.
Items are partitioned by the number of their shingles (powers of two). The MinHash sketch of an item is its m
smallest shingle hashes, where m is one more than the shingles that the largest item of the partition may
miss: a document that contains the item has at least one of them, so the search loses nothing however long
the document is. Documents are probed with all their shingle hashes; each candidate pair is then verified on
the texts, shingle by shingle.

Words are runs of letters and digits of the lower-cased text. An item with fewer words than WIDTH is one
shingle of all its words; an item without words is contained in nothing.

Probes, candidates and items are broadcast only up to a counted size, and joined by shuffles beyond it.

Defined results: null text counts as empty; rows that share a doc_id are judged each by its text and dropped
together; repeated items give one pair an item_id; a null doc_id or item_id is a value like others; of ties all
are told; a very long text is searched whole; empty tables give empty results. Columns other than doc_id, text and item_id, text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import stage

WIDTH, NUM, DEN = 5, 8, 10
#: Rows, and characters of items, that are broadcast at most.
BROADCAST_ROWS, BROADCAST_CHARS = 500_000, 8 << 20


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def _gram_hashes(hashes: str, width: int) -> Column:
    """Hashes of the runs of so many words; hashes holds the hashes of the words."""
    at = F.sequence(F.lit(0), F.size(hashes) - width)
    grams = F.transform(at, lambda i: _hash([F.get(F.col(hashes), i + j) for j in range(width)]))
    return F.when(F.size(hashes) >= width, grams).otherwise(F.array().cast("array<bigint>"))


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, width, shingles (distinct texts), n, sketch."""
    rows = benchmark.select(F.col("item_id").alias("item_id"), _words("text").alias("_w")).filter(F.size("_w") > 0)
    rows = rows.withColumn("width", F.least(F.lit(WIDTH), F.size("_w")))
    grams = F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("width") + 1), lambda i: F.array_join(F.slice("_w", i, F.col("width")), " "))
    rows = rows.select("item_id", "width", F.array_distinct(grams).alias("shingles")).withColumn("n", F.size("shingles").cast("long"))
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1  # of the partition
    miss = F.floor(largest * (DEN - NUM) / DEN).cast("int")
    hashes = F.transform("shingles", lambda s: F.aggregate(F.transform(F.split(s, " "), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"), lambda acc, h: F.concat(acc, F.array(h))))
    by_width = None
    for width in range(1, WIDTH + 1):
        one = F.transform(hashes, lambda h: _hash([F.get(h, F.lit(j)) for j in range(width)]))
        by_width = F.when(F.col("width") == width, one) if by_width is None else by_width.when(F.col("width") == width, one)
    return rows.withColumn("sketch", F.slice(F.array_sort(by_width), 1, miss + 1)).distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found of each item that a document contains."""
    index, _ = stage(items(benchmark), "items")
    probes = index.select("item_id", "width", F.explode("sketch").alias("hash"))
    size = index.agg(F.coalesce(F.sum(F.size("sketch")), F.lit(0)).alias("probes"), F.coalesce(F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda a, s: a + F.length(s))), F.lit(0)).alias("chars"), F.sort_array(F.collect_set("width")).alias("widths")).first()
    hashed = docs.select("doc_id", F.transform(_words("text"), lambda w: F.xxhash64(w)).alias("_h"))
    grams = None
    for width in size["widths"]:  # WIDTH values at most
        one = hashed.select("doc_id", F.lit(width).alias("width"), F.explode(_gram_hashes("_h", width)).alias("hash"))
        grams = one if grams is None else grams.unionByName(one)
    if grams is None:
        kinds = dict(docs.dtypes) | {"item_id": dict(benchmark.dtypes)["item_id"]}
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_shingles long, n_found long")
    pairs = grams.join(_small(probes, size["probes"]), ["width", "hash"]).select("doc_id", "item_id").distinct()
    pairs, _ = stage(pairs, "candidates")
    # The words of a candidate document are found once, and written, whatever number of items and shingles they are compared with.
    own = pairs.select(F.col("doc_id").alias("_own")).distinct()
    line = F.concat(F.lit(" "), F.array_join(_words("text"), " "), F.lit(" "))
    lines = docs.select(F.col("doc_id").alias("_doc"), "text").join(_small(own, own.count()), F.col("_doc").eqNullSafe(F.col("_own")), "left_semi").select("_doc", line.alias("_line"))
    lines, _ = stage(lines, "candidate_lines")
    found = lines.join(_small(pairs, pairs.count()), F.col("_doc").eqNullSafe(F.col("doc_id")))
    full = index.select(F.col("item_id").alias("_item"), "shingles", "n")
    full = F.broadcast(full) if size["chars"] <= BROADCAST_CHARS else full
    found = found.join(full, F.col("item_id").eqNullSafe(F.col("_item")))
    here = F.filter("shingles", lambda s: F.contains(F.col("_line"), F.concat(F.lit(" "), s, F.lit(" "))))
    found = found.select("doc_id", "item_id", F.col("n").alias("n_shingles"), F.size(here).cast("long").alias("n_found"))
    return found.filter(F.col("n_found") * DEN >= F.col("n_shingles") * NUM).distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    hit, _ = stage(contained(docs, benchmark).select(F.col("doc_id").alias("_doc")).distinct(), "contaminated")
    return docs.join(_small(hit, hit.count()), docs["doc_id"].eqNullSafe(hit["_doc"]), "left_anti")


#: DuckDB SQL for contained().
SQL = r"""
    WITH d AS (SELECT DISTINCT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS line FROM documents),
    b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
    s AS (SELECT DISTINCT item_id, list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS shingles FROM b WHERE len(w) > 0),
    c AS (SELECT doc_id, item_id, len(shingles)::BIGINT AS n_shingles, len(list_filter(shingles, lambda x: contains(line, ' ' || x || ' ')))::BIGINT AS n_found FROM d, s)
    SELECT DISTINCT doc_id, item_id, n_shingles, n_found FROM c WHERE n_found * 10 >= n_shingles * 8"""
