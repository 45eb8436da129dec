"""Exact dedup by content-defined chunk recipes.

A text is cut where the hash of an 8-byte window has CUT_BITS leading zeros, so equal passages are cut alike.
Chunks get 128-bit identifiers; one pass moves each distinct chunk of a task once and verifies that an
identifier stands for one byte string. Documents are then compared by their ordered identifier lists alone,
16 bytes a chunk, so that long texts move no second time; equal lists of verified identifiers are equal texts.

Defined results: null text counts as empty; the empty text has an empty recipe and forms a group like any
other; rows that repeat a doc_id and a text all carry the same decision; a null doc_id is kept only if its
group has no other; of ties the largest doc_id stays; a very long text is cut into as many chunks, and its list is
as much longer; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import hot_join, slices, stage, text_buffer, tidy

#: A cut every 2 ** CUT_BITS bytes on average, and after LONGEST bytes without one.
CUT_BITS, LONGEST = 11, 1 << 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def cuts(data: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """For each text the ends of its chunks, counted in data."""
    n = len(data)
    found = np.zeros(0, np.int64)
    if n >= 8:
        window = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)) * _FACTOR
        window ^= window >> np.uint64(29)
        window *= _FACTOR
        found = np.flatnonzero(window >> np.uint64(64 - CUT_BITS) == 0) + 8
    lo, hi = np.searchsorted(found, off[:-1] + 8, "left"), np.searchsorted(found, off[1:], "left")
    out = []
    for a, b, i, j in zip(off[:-1].tolist(), off[1:].tolist(), lo.tolist(), hi.tolist()):
        ends, at = [], a
        for end in [*found[i:j].tolist(), b] if b > a else []:
            while end - at > LONGEST:
                at += LONGEST
                ends.append(at)
            ends.append(end)
            at = end
        out.append(ends)
    return out


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], bytes]]:
    for part in slices(batch, "text"):
        data, off = text_buffer(part.column(part.schema.get_field_index("text")))
        raw = data.tobytes()
        for a, b, ends in zip(off[:-1].tolist(), off[1:].tolist(), cuts(data, off)):
            yield [raw[i:j] for i, j in zip([a, *ends], ends)], raw[a:b]


def _identifier(strong: bool):
    return (lambda x: hashlib.sha256(x).digest()) if strong else (lambda x: xxhash.xxh3_128_digest(x))


def chunks(docs: DataFrame, strong: bool = False) -> DataFrame:
    """(id, chunk) for each chunk, once for each Arrow batch."""
    name = _identifier(strong)

    @tidy
    def run(batches):
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            for parts, _ in _pieces(batch):
                for x in parts:
                    seen.setdefault(name(x), x) == x or _clash(x)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], ["id", "chunk"])

    return docs.select("text").mapInArrow(run, "id binary, chunk binary")


def _clash(chunk: bytes) -> None:
    raise ValueError(f"two chunks of one batch share an identifier; one has {len(chunk)} bytes")


def verified(docs: DataFrame, strong: bool = False) -> bool:
    """Whether each identifier stands for one byte string in the whole corpus."""
    one = chunks(docs, strong).groupBy("id").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
    return one.filter(F.col("a") != F.col("b")).isEmpty()


def recipes(docs: DataFrame, strong: bool = False) -> DataFrame:
    """(doc_id, recipe, text_sha256): the joined identifiers of each document's chunks in order."""
    name, schema = _identifier(strong), pa.schema([("doc_id", pa.int64()), ("recipe", pa.binary()), ("text_sha256", pa.string())])

    @tidy
    def run(batches):
        for batch in batches:
            got = [(b"".join(map(name, parts)), hashlib.sha256(text).hexdigest()) for parts, text in _pieces(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x[0] for x in got], pa.binary()), pa.array([x[1] for x in got], pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, recipe binary, text_sha256 string")


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    strong = not verified(docs)
    if strong and not verified(docs, True):
        raise ValueError("two chunks share a SHA-256")
    rows, _ = stage(recipes(docs, strong).select("doc_id", "text_sha256", F.col("recipe").alias("_group")), "recipes")
    sizes = rows.groupBy("_group").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = hot_join(rows, sizes, "_group", "group_size", rows.count())
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of docs for each text, with all its columns: one that has the largest doc_id, if any has one."""
    decided, _ = stage(groups(docs).groupBy("doc_id", "text_sha256", "kept").agg(F.count("*").alias("n")), "decided")
    # A doc_id may have several texts, so a row is named by both; what equals another row in both stays once.
    gone, tied = (decided.filter(c).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text")) for c in ("NOT kept", "kept AND n > 1"))
    own = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    same = own["doc_id"].eqNullSafe(F.col("_id")) & (own["_sha"] == F.col("_text"))
    left = own.join(gone, same, "left_anti")
    if not tied.isEmpty():
        same = left["doc_id"].eqNullSafe(F.col("_id")) & (left["_sha"] == F.col("_text"))
        left = left.join(tied, same, "left_anti").unionByName(left.join(tied, same, "left_semi").dropDuplicates(["doc_id", "_sha"]))
    return left.drop("_sha")
