"""What the corpus operators share: stage tables, hot-key joins, and byte-level word handling.

Word handling works on whole Arrow batches: texts are one byte buffer with offsets, words are found and
hashed with numpy, and nothing is kept between batches, so memory follows the slice size, not the corpus.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Bytes of text that the numpy steps hold at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch that Spark sends to a worker, or one row.
BATCH_BYTES = 16 << 20
#: A key with more than 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000


# -- stage tables -------------------------------------------------------------------------------

def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where it is unset and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return path or "/tmp/checkpoints"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, survives lost executors.

    The shuffle files of the write are let go at its end; the table goes when the application ends,
    or earlier by drop().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {key: spark.conf.get(key) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    p = _path(spark, path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = _path(spark, path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# -- hot keys -----------------------------------------------------------------------------------

def hot_join(big: DataFrame, small: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """big left join small on key, where small has one row a key and `count`, the rows that big has of it.

    Keys with more than total / HOT_SHARE rows, fewer than HOT_SHARE by count, are broadcast; their rows
    of big then take part in the shuffled join under keys of their own and spread over all tasks. So do rows
    without a key, which match nothing.
    """
    rest = [c for c in small.columns if c != key]
    hot = small.filter(F.col(count) > max(1, total // HOT_SHARE)).select(
        F.col(key).alias("_hot_key"), F.struct(*rest).alias("_hot"))
    rows = big.join(F.broadcast(hot), big[key] == F.col("_hot_key"), "left")
    rows = rows.withColumn("_cold_key", F.when(F.col("_hot").isNull(), F.col(key)))
    spread = F.col("_hot").isNotNull() | F.col(key).isNull()
    rows = rows.withColumn("_slot", F.when(spread, F.monotonically_increasing_id()).otherwise(F.xxhash64(key)))
    cold = small.select(F.col(key).alias("_key"), F.struct(*rest).alias("_cold"), F.xxhash64(key).alias("_at"))
    joined = rows.join(cold, (rows["_cold_key"] == cold["_key"]) & (rows["_slot"] == cold["_at"]), "left")
    got = F.coalesce("_hot", "_cold")
    return joined.select(*[big[c] for c in big.columns], *[got[c].alias(c) for c in rest])


def with_fields(df: DataFrame, **kinds: str) -> StructType:
    """The schema of df and further fields."""
    out = StructType(list(df.schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, DataType.fromDDL(kind))
    return out


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of a value as text, modulo n."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def distinct_ids(docs: DataFrame) -> bool:
    """Whether each row of docs has a doc_id of its own."""
    return docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty()


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, each) of docs (doc_id, text) whose doc_ids are missing or repeat: rows is a _key of each row, each has one row of
    every _key (doc, doc_id, text, n_equal), where doc numbers them by (doc_id, a hash of the row), those without a doc_id first."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit("")))
    rows = docs.withColumn("_key", F.sha2(name, 256))
    each = rows.groupBy("_key").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.count("*").alias("n_equal"))
    each = each.orderBy(F.col("doc_id").asc_nulls_first(), "_key").withColumn("doc", F.monotonically_increasing_id())
    return rows.select("_key"), stage(each, "numbered")[0]


# -- workers ------------------------------------------------------------------------------------

def tidy(run: Callable) -> Callable:
    """run for mapInArrow, which gives the memory that it no longer uses back to the machine at its end.

    Spark keeps a worker for the next task, of whatever stage, and what its allocators hold counts against the executor.
    """

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return tidied


# -- Arrow text ---------------------------------------------------------------------------------

def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets (n + 1) into them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most that many bytes of text, or one row."""
    _, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


# -- words --------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE
#: Letters, digits and the bytes of other scripts.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_factors: dict[int, np.ndarray] = {}


def factors(n: int, seed: int) -> np.ndarray:
    """At least n odd 64-bit factors, the same prefix for every n."""
    have = _factors.get(seed)
    if have is None or len(have) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        have = _factors[seed] = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, size, np.uint64) | np.uint64(1)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(by)
    h ^= h >> np.uint64(31)
    return h


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words; a word never crosses a document's end."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    own = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = own[:-1]
    starts = np.flatnonzero(own & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = own[1:]
    ends = np.flatnonzero(own & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, first: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes (of its first so many bytes, if given)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    base, stop = starts[0], ends[-1]
    s, part = starts - base, data[base:stop]
    lens = ends - starts
    gaps = np.diff(np.append(s, len(part)))
    pos = np.arange(len(part)) - np.repeat(s, gaps)
    most = np.repeat(np.minimum(lens, first) if first else lens, gaps)
    live = pos < most
    r = factors(int(lens.max()), seed)
    value = part.astype(np.uint64)
    value += np.uint64(1)
    value *= r[np.where(live, pos, 0)]
    value *= live
    h = np.add.reduceat(value, s)
    h += np.minimum(lens, first or lens).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h)


def gram_hashes(h: np.ndarray, k: int, seed: int = 2) -> np.ndarray:
    """Hashes of the k-grams that start at each of the first len(h) - k + 1 words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    r = factors(k, seed)
    out = h[:n] * r[0]
    for j in range(1, k):
        out += h[j:n + j] * r[j]
    return mix(out)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each text (A-Z lower-cased): values sorted by document, offsets, words.

    With fewer than k words the whole sequence is one shingle; without words there is none.
    """
    data, off = text_buffer(texts)
    data = LOWER[data]
    starts, ends, doc = words(data, off)
    n = len(off) - 1
    count = np.bincount(doc, minlength=n).astype(np.int64)
    h = word_hashes(data, starts, ends)
    grams = gram_hashes(h, k)
    inside = doc[:len(grams)] == doc[k - 1:] if len(grams) else np.zeros(0, bool)
    values, owner = grams[inside], doc[:len(grams)][inside]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])[short]
        extra = np.array([mix(np.array([np.sum(h[f:f + c] * factors(k, 2)[:c]) + np.uint64(c)], np.uint64))[0]
                          for f, c in zip(first, count[short])], np.uint64)
        values, owner = np.concatenate([values, extra]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(n + 1)), count
