"""MinHash near-dedup with an LSH forest.

Texts become sets of hashed word shingles. Equal sets are one class and are settled by grouping. Each class gets
VALUES minhash values, of which the trees of the forest are made, and a bitmap of BITS bits: the parity of the
shingles that fall on each bit. Two sets that differ in d shingles have bitmaps that differ in at most d bits, so a
pair whose bitmaps differ in more than the limit allows is no link, with certainty. What is left are candidates;
links are confirmed on the full sets.

1. A tree is the order of all classes by LEVELS of the values. In FIRST_TREES trees neighbours with a common prefix
   are candidates, so that a group of n copies is mostly one component after at most FIRST_TREES * n confirmations.
2. A region is all rows that share a prefix of LEAST levels in a tree. How deep a region must agree follows from how
   crowded it is: in those of at most CROWD rows every pair of different components is compared. Rows of larger ones
   go down to the whole LEVELS, in DEEP_TREES trees, and every pair of these regions is compared, in blocks of at
   most two slices of SLICE rows. Each row names its NEAR best candidates, in all trees, which are confirmed; rows
   that had as many as they may name are walked again from where they stopped, until every pair of a region is in
   one component or was a candidate.

Only regions with more than one component are walked, no group is ever gathered beyond a block, and only pairs of
different components are compared. A link of similarity 0.85 shares no prefix of LEAST levels in any of TREES trees
with probability (1 - 0.85 ** 2) ** 16, about 1e-9, and no 6 levels in any of 48 deep trees with about as much;
at 0.8 it is 1e-7 and 5e-7.

Defined results: a text without words (or null) has no shingles and is linked with nothing; with fewer words than a
shingle the whole sequence is one; rows that repeat a doc_id are linked each by its own text, and each tells the
component of its text; a null doc_id is never the name of a component that has another; of ties the smallest doc_id
is the name; a very long text is a slice of its own; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import distinct_ids, drop, factors, hot_join, shared_dir, shingle_sets, slices, stage, tidy, with_fields
from mediaspark.llm.graph import components

VALUES, LEVELS, LEAST, BITS = 192, 6, 2, 2048
#: Trees whose regions of LEAST levels are walked, and those for crowded rows; the first are prefixes of the deep ones.
TREES, DEEP_TREES = 16, 48
#: Deep trees that are walked at once.
AT_ONCE = 24
#: Trees of the first pass; candidates a row names in the first walk, and at most in later ones.
FIRST_TREES, NEAR, MOST = 3, 3, 512
#: Rows of a region beyond which it is crowded; rows of a crowded region that are compared with as many others in one block.
CROWD, SLICE = 4096, 1024
#: Regions (16 bytes each) that are broadcast at most.
BROADCAST_REGIONS = 1_000_000
#: Pairs that are compared at once.
PAIRS = 1 << 15
#: A text of more pairs than this is sent to its pairs, if all such texts have at most so many bytes.
HOT_PAIRS, HOT_BYTES = 128, 32 << 20
#: Rounds after a walk that confirm one candidate a component; then all that are left. So are all where they are at most EASY times as many.
ROUNDS, EASY = 1, 4


@dataclass(frozen=True)
class Limit:
    """Sets of k-word shingles are linked if den * intersection >= num * union."""

    k: int = 5
    num: int = 80
    den: int = 100

    def far(self, n):
        """How many shingles two linked sets of n shingles together may differ in at most."""
        return n * (self.den - self.num) // (self.den + self.num)


def deep_trees() -> list[list[int]]:
    """The values of each tree: disjoint ones as long as they last, then others drawn from all."""
    own = [list(range(LEVELS * t, LEVELS * (t + 1))) for t in range(min(DEEP_TREES, VALUES // LEVELS))]
    rng = np.random.default_rng(31)
    return own + [sorted(rng.choice(VALUES, LEVELS, replace=False).tolist()) for _ in range(DEEP_TREES - len(own))]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_id (null without shingles), minhash (VALUES numbers of 16 bits) and bits."""
    a, b = factors(VALUES, 21), factors(VALUES, 22)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("minhash", pa.binary()), ("bits", pa.binary())])

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, off, _ = shingle_sets(part.column(1), k)
                size = np.diff(off)
                full = np.flatnonzero(size)
                low = np.zeros((part.num_rows, VALUES), np.uint16)
                if len(full):
                    at = off[:-1][full]
                    for j in range(VALUES):
                        v = values * a[j]
                        v += b[j]
                        v >>= np.uint64(32)
                        low[full, j] = np.minimum.reduceat(v, at).astype(np.uint16)
                bit = (values >> np.uint64(53)).astype(np.int64) + np.repeat(np.arange(part.num_rows) * BITS, size)
                odd = (np.bincount(bit, minlength=part.num_rows * BITS) & 1).astype(np.uint8).reshape(-1, BITS)
                name = [xxhash.xxh3_128_digest(values[i:j].tobytes()) if j > i else None for i, j in zip(off, off[1:])]
                kept = ([x.tobytes() if n else None for x, n in zip(rows, size)] for rows in (low, np.packbits(odd, axis=1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), pa.array(name, pa.binary()), *[pa.array(x, pa.binary()) for x in kept]], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, minhash binary, bits binary")


def _bitmaps(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _differ(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)


def neighbours(classes: DataFrame, trees: int, limit: Limit) -> DataFrame:
    """(a, b, far): pairs of classes (id, n, minhash, bits) next to each other in a tree that may be linked, and how far apart they are."""
    paths = F.array(*[F.substring("minhash", 2 * LEVELS * t + 1, 2 * LEVELS) for t in range(trees)])
    rows = classes.select("id", "n", "bits", F.posexplode(paths).alias("tree", "path"))
    rows = rows.repartitionByRange("tree", "path", "id").sortWithinPartitions("tree", "path", "id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("far", pa.int64())])

    @tidy
    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            path = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(-1, LEVELS)
            now = [*(batch.column(k).to_numpy() for k in range(3)), path, _bitmaps(batch.column(4))]
            if last is not None:
                now = [np.concatenate([x, y]) for x, y in zip(last, now)]
            ids, n, tree, path, bits = now
            i = np.flatnonzero((tree[1:] == tree[:-1]) & (path[1:, :LEAST] == path[:-1, :LEAST]).all(1))
            a, b, far, _ = _candidates(ids, n, bits, i, i + 1, limit)
            last = [x[-1:] for x in now]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, far)], schema=schema)

    return rows.select("id", "n", "tree", "path", "bits").mapInArrow(run, "a long, b long, far long").distinct()


def _candidates(ids, n, bits, i, j, limit: Limit) -> tuple[np.ndarray, ...]:
    """Of pairs of rows those that may be linked: the smaller id, the larger, how far apart they are in thousandths of their shingles, and their indexes in (i, j)."""
    both = n[i] + n[j]
    ok = np.flatnonzero(limit.den * np.minimum(n[i], n[j]) >= limit.num * np.maximum(n[i], n[j]))
    apart = _differ(bits, i[ok], j[ok])
    fits = apart <= limit.far(both[ok])
    ok, apart = ok[fits], apart[fits]
    x, y = ids[i[ok]], ids[j[ok]]
    return np.minimum(x, y), np.maximum(x, y), 1000 * apart // both[ok], ok


def _keys(trees: list[list[int]], levels: int) -> Column:
    """The region of a row in each tree."""
    prefix = lambda values: [F.substring("minhash", 2 * v + 1, 2) for v in values[:levels]]
    return F.array(*[F.xxhash64(F.lit(t), *prefix(values)) for t, values in enumerate(trees)])


def regions(rows: DataFrame, trees: list[list[int]], levels: int) -> DataFrame:
    """(id, key, size): the regions of more than one component that each of rows (id, root, minhash) is in, and how many rows they have."""
    own = rows.select("id", "root", F.explode(_keys(trees, levels)).alias("key"))
    mixed = own.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("key", "size")
    mixed, _ = stage(mixed, "regions")
    if mixed.count() <= BROADCAST_REGIONS:  # as a rule: most regions are of one row, or of one component
        found = own.select("id", "key").join(F.broadcast(mixed), "key")
    else:
        found = hot_join(own.select("id", "key"), mixed, "key", "size", len(trees) * rows.count()).filter("size IS NOT NULL")
    return stage(found.select("id", "key", "size"), "members")[0]


def walk(rows: DataFrame, members: DataFrame, most: int, limit: Limit) -> DataFrame:
    """(row, best): for each of rows (id, root, n, bits, mark, mark_id) its next candidates (far, other) in the regions of members (id, key, size), best first, `most` at most.

    Candidates come by rising distance, then by id; (mark, mark_id) is the last that a row has named. A pair that
    either end has named is not a candidate again.
    """
    # A region of several slices has a block for each pair of slices (lo, hi).
    cut = F.ceil(F.col("size") / SLICE).cast("int")
    blocks = members.withColumn("own", F.pmod(F.xxhash64("id"), cut).cast("int")).withColumn("_t", F.explode(F.sequence(F.lit(0), cut - 1)))
    blocks = blocks.select("id", "key", "own", F.least("own", "_t").alias("lo"), F.greatest("own", "_t").alias("hi"))
    rows = blocks.join(rows, "id").select("key", "lo", "hi", "root", "own", "id", "n", "mark", "mark_id", "bits")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "root")
    schema = pa.schema([("row", pa.int64()), ("other", pa.int64()), ("far", pa.int64())])

    def pairs(block):
        key, lo, hi, root, own, ids, n, mark, mark_id, bits = block
        count = len(key)
        new = np.ones(count, bool)
        new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        end = np.append(np.flatnonzero(new)[1:], count)[np.cumsum(new) - 1]
        new[1:] |= root[1:] != root[:-1]
        after = np.append(np.flatnonzero(new)[1:], count)[np.cumsum(new) - 1]  # a row's partners come after all rows of its root
        partners = end - after
        done = np.concatenate([[0], np.cumsum(partners)])
        found, held = [], 0
        for at in range(0, int(done[-1]), PAIRS):
            k = np.arange(at, min(at + PAIRS, int(done[-1])))
            i = np.searchsorted(done, k, "right") - 1
            j = after[i] + k - done[i]
            apart = (lo[i] == hi[i]) | (own[i] != own[j])
            i, j = i[apart], j[apart]
            _, _, far, ok = _candidates(ids, n, bits, i, j, limit)
            i, j = i[ok], j[ok]
            ok = (far > mark[i]) | (far == mark[i]) & (ids[j] > mark_id[i])
            ok &= (far > mark[j]) | (far == mark[j]) & (ids[i] > mark_id[j])
            x, y, far = ids[i[ok]], ids[j[ok]], far[ok]
            if len(x):
                found.append((np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([far, far])))
                held += 2 * len(x)
            if held > 1 << 20 and len(found) > 1:
                found = [_best(*map(np.concatenate, zip(*found)), most)]
                held = len(found[0][0]) // 2
        got = _best(*map(np.concatenate, zip(*found)), most) if found else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in got], schema=schema)

    @tidy
    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(9)]
            now.append(_bitmaps(batch.column(9)))
            if held and all(x[0] == y[-1] == y[0] == x[-1] for x, y in zip(now[:3], held[-1][:3])):
                held.append(now)  # all of one block, which goes on
                continue
            now = [np.concatenate(c) for c in zip(*held, now)]
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            cut = int(np.flatnonzero(last)[0])
            if cut:
                yield pairs([c[:cut] for c in now])
            held = [[c[cut:] for c in now]]
        if held:
            yield pairs([np.concatenate(c) for c in zip(*held)])

    named = rows.mapInArrow(run, "row long, other long, far long")
    best = F.array_sort(F.collect_set(F.struct("far", "other")))
    return named.groupBy("row").agg(F.slice(best, 1, most).alias("best"))


def _best(row: np.ndarray, other: np.ndarray, far: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the `most` first different others, by rising distance, then by other."""
    order = np.lexsort((other, far, row))
    row, other, far = row[order], other[order], far[order]
    once = np.ones(len(row), bool)  # a pair may meet in several trees
    once[1:] = (row[1:] != row[:-1]) | (other[1:] != other[:-1])
    row, other, far = row[once], other[once], far[once]
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    first = np.flatnonzero(new)
    ok = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < most
    return row[ok], other[ok], far[ok]


def packed_texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """(id, packed): all texts, compressed, in a table bucketed by id, and its name.

    The one movement of the texts: what joins this table on id later moves only its own rows.
    """

    @tidy
    def run(batches):
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tool.compress((t.as_py() or "").encode()) for t in part.column(1)], pa.binary())], ["id", "packed"])

    spark = docs.sparkSession
    name, buckets = f"packed_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, packed binary")
    rows.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").option("path", f"{shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name), name


def _with_text(pairs: DataFrame, texts: DataFrame, c: str) -> DataFrame:
    """pairs with the packed text of column c, as _c. A text of very many pairs is broadcast, so that its pairs stay spread."""
    own = texts.select(F.col("id").alias(c), F.col("packed").alias(f"_{c}"))
    many, _ = stage(pairs.groupBy(c).count().filter(F.col("count") > HOT_PAIRS).select(F.col(c).alias("_hot")), "hot")
    if not many.isEmpty():
        hot, _ = stage(own.join(many, own[c] == many["_hot"], "left_semi"), "hot_texts")
        if hot.agg(F.sum(F.length(f"_{c}"))).first()[0] <= HOT_BYTES:
            few = pairs.join(many, pairs[c] == many["_hot"], "left_anti")
            return pairs.join(F.broadcast(hot), c).unionByName(few.join(own.hint("merge"), c))
    return pairs.join(own.hint("merge"), c)


def confirm(pairs: DataFrame, texts: DataFrame, limit: Limit) -> DataFrame:
    """pairs (a, b, ...) with linked: whether the full shingle sets are alike enough."""
    rows = _with_text(_with_text(pairs, texts, "a"), texts, "b").select(*pairs.columns, "_a", "_b")
    k, num, den, n, names = limit.k, limit.num, limit.den, len(pairs.columns), [*pairs.columns, "linked"]
    at = [pairs.columns.index(c) for c in "ab"]

    @tidy
    def run(batches):
        tool = zstandard.ZstdDecompressor()
        last: list[tuple] = [(None, None), (None, None)]  # the sets of the row before

        def shingles(side: int, name: int, packed) -> np.ndarray:
            if last[side][0] != name:
                last[side] = (name, shingle_sets(pa.array([tool.decompress(packed.as_py())], pa.binary()), k)[0])
            return last[side][1]

        for batch in batches:
            linked = []
            for a, b, x, y in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), batch.column(n), batch.column(n + 1)):
                one, two = shingles(0, a, x), shingles(1, b, y)
                both = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(both > 0 and den * both >= num * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(linked, pa.bool_())], names)

    return rows.mapInArrow(run, with_fields(pairs, linked="boolean"))


def _rooted(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """pairs with the roots of both ends (ra, rb), without those of one root."""
    for c in "ab":
        if roots is None:
            pairs = pairs.withColumn(f"r{c}", F.col(c))
        else:
            pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias("_r")), c, "left").withColumn(f"r{c}", F.coalesce("_r", c)).drop("_r")
    return pairs.filter("ra <> rb")


def _settle(pairs: DataFrame, texts: DataFrame, limit: Limit, roots: DataFrame | None, rounds: int) -> DataFrame | None:
    """roots (node, root) after confirming pairs (a, b, far), nearest first."""
    spark = texts.sparkSession
    left, path = stage(pairs, "candidates")
    if left.isEmpty():
        return roots
    for k in range(rounds + 1):
        open_, open_at = stage(_rooted(left, roots), "open")
        if open_.isEmpty():
            drop(spark, open_at)
            break
        chosen = open_
        if k < rounds:
            ends = open_.select(F.explode(F.array("ra", "rb")).alias("_end"), F.struct("far", "a", "b", "ra", "rb").alias("_p"))
            best, _ = stage(ends.groupBy("_end").agg(F.min("_p").alias("_p")).select("_p.a", "_p.b", "_p.ra", "_p.rb").distinct(), "best")
            if open_.count() > EASY * best.count():
                chosen = best
        tried, tried_at = stage(confirm(chosen.select("a", "b", "ra", "rb"), texts, limit), "tried")
        hooks = components(tried.filter("linked").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        if roots is None:
            roots = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            roots = roots.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")).unionByName(hooks)
        roots, _ = stage(roots, "roots")
        if chosen is open_:
            drop(spark, open_at, tried_at)
            break
        rest, rest_at = stage(open_.select("a", "b", "far").join(tried.select("a", "b"), ["a", "b"], "left_anti"), "candidates")
        drop(spark, path, open_at, tried_at)
        left, path = rest, rest_at
    drop(spark, path)
    return roots


def _with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("id"))
    return rows.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _walk_all(plain: DataFrame, members: DataFrame, texts: DataFrame, limit: Limit, roots: DataFrame | None) -> DataFrame | None:
    """roots after every pair of the regions of members is in one component or was a candidate."""
    marks, most = members.select("id").distinct().withColumns({"mark": F.lit(-1).cast("long"), "mark_id": F.lit(0).cast("long")}), NEAR
    while True:
        open_ = _with_roots(plain.select("id", "n", "bits").join(marks, "id"), roots)
        own = members.join(marks.select("id"), "id", "left_semi")
        named, _ = stage(walk(open_, own, most, limit), "named")
        pairs = named.select("row", F.explode("best").alias("_c")).select(F.least("row", "_c.other").alias("a"), F.greatest("row", "_c.other").alias("b"), F.col("_c.far").alias("far")).distinct()
        roots = _settle(pairs, texts, limit, roots, ROUNDS)
        # Rows that may name further candidates; a pair of which one end has named all it has is settled.
        last = F.element_at("best", -1)
        marks, _ = stage(named.filter(F.size("best") == most).select(F.col("row").alias("id"), last["far"].alias("mark"), last["other"].alias("mark_id")), "open_rows")
        if marks.isEmpty():
            return roots
        most = min(4 * most, MOST)


def _linked(docs: DataFrame, limit: Limit) -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id, text) whose doc_ids are distinct and not null."""
    spark = docs.sparkSession
    rows, _ = stage(signatures(docs, limit.k), "signatures")
    classes = rows.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("n_rows"), F.min("n_shingles").alias("n"), F.min("minhash").alias("minhash"), F.min("bits").alias("bits"))
    classes, _ = stage(classes, "classes")
    plain, trees = classes.select("id", "n", "minhash", "bits"), deep_trees()
    texts, table = packed_texts(docs)
    try:
        roots = _settle(neighbours(plain, FIRST_TREES, limit), texts, limit, None, 0)
        shallow = regions(_with_roots(plain, roots), trees[:TREES], LEAST)
        crowd, _ = stage(shallow.filter(F.col("size") > CROWD).select("id").distinct(), "crowd")
        roots = _walk_all(plain, shallow.filter(F.col("size") <= CROWD), texts, limit, roots)
        if not crowd.isEmpty():
            crowded, _ = stage(plain.join(crowd, "id", "left_semi"), "crowded")
            for k in range(0, DEEP_TREES, AT_ONCE):
                roots = _walk_all(crowded, regions(_with_roots(crowded, roots), trees[k:k + AT_ONCE], LEVELS), texts, limit, roots)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        drop(spark, f"{shared_dir(spark).rstrip('/')}/{table}")
    named = _with_roots(classes.select("set_id", "id", "n_rows"), roots).select("set_id", F.col("root").alias("_root"), "n_rows")
    out = hot_join(rows.select("doc_id", "n_shingles", "set_id"), named, "set_id", "n_rows", rows.count())
    return out.select("doc_id", "n_shingles", F.coalesce("_root", "doc_id").alias("component_id"))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row (_row), by doc_id, those without one last."""
    rows = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.sha2("text", 256)).withColumn("_row", F.monotonically_increasing_id())
    return stage(rows, "numbered")[0]


def link(docs: DataFrame, limit: Limit = Limit()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of its component), kept (it is that document)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if distinct_ids(docs):
        out = _linked(docs, limit)
    else:
        rows = _numbered(docs)
        found = _linked(rows.select(F.col("_row").alias("doc_id"), "text"), limit).select(F.col("doc_id").alias("_row"), "n_shingles", F.col("component_id").alias("_first"))
        name = rows.select(F.col("_row").alias("_first"), F.col("doc_id").alias("component_id"))
        sizes = found.groupBy("_first").count().join(name, "_first")
        found = hot_join(found, sizes, "_first", "count", rows.count()).drop("count")
        out = rows.select("_row", "doc_id").join(found, "_row").select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, limit: Limit = Limit()) -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns: the smallest doc_id, rows without one last.

    Where a doc_id is missing or repeats, rows are numbered in that order and linked by their numbers.
    """
    if distinct_ids(docs):
        gone, _ = stage(link(docs, limit).filter(~F.col("kept")).select("doc_id"), "near_copies")
        return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
    rows = _numbered(docs)
    gone, _ = stage(link(rows.select(F.col("_row").alias("doc_id"), "text"), limit).filter(~F.col("kept")).select(F.col("doc_id").alias("_row")), "near_copies")
    return rows.join(gone, "_row", "left_anti").drop("_row")
