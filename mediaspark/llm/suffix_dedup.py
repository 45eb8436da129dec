"""Repeated passages by sparse suffix arrays.

Found are the stretches of a document's words that are covered by windows of LENGTH words which occur elsewhere,
in another document or at another place of the same one. Suffixes are kept only at anchors: of every window the
place of the smallest hash of a run of WIDTH words, so equal windows keep equal suffixes, about one in twenty
places.

1. A suffix is represented by the hashes of its first KEY words; all suffixes are sorted by a range partition over
   (suffix, document, place), which splits suffixes that a third of the corpus shares. Neighbours that agree on
   WIDTH words are a run; a suffix that is alone goes.
2. The members of a run of at most MOST suffixes are all compared with each other: their words are extended to the
   left and to the right as far as a window around the anchor can reach, and count if LENGTH words agree.
3. In a longer run, and in one that a partition's end cuts, the words after the anchor don't tell which members
   agree before it. There the suffixes that begin at the windows themselves are retained: every window with such an
   anchor is sorted by the 128-bit hash of its LENGTH words, and neighbours that agree are repeats. This loses nothing
   and costs one row a window, never a pair of members.
4. What was found is merged into stretches, document by document.

Texts of one word sequence are a group: one stands for all and is compared; the others are reported as whole
repeats of it.

Defined results: null text has no words, and texts of fewer than LENGTH words have no rows; a passage may repeat
within a document (also overlapping itself); rows that share a doc_id, or have none, are documents of their own, but
rows equal in doc_id and text count as one; a null doc_id is reported as null; of equal candidates for the other place
the smallest is told; a very long text is a slice of its own, and its suffixes are as many rows; an empty table gives
an empty table. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import distinct_ids, drop, gram_hashes, hot_join, numbered, slices, stage, tidy
from mediaspark.llm.passages import Words

LENGTH, WIDTH, KEY, MOST = 50, 10, 16, 4
WINDOW = LENGTH


def window_anchors(h: np.ndarray, low: np.ndarray, ok: np.ndarray, reach: int) -> np.ndarray:
    """For each window the place of its anchor, the first with the window's smallest hash; -1 where not ok."""
    place = np.full(len(low), -1)
    open_ = ok.copy()
    for j in range(reach):
        if not open_.any():
            break
        i = np.flatnonzero(open_)
        hit = i[h[i + j] == low[i]]
        place[hit] = hit + j
        open_[hit] = False
    return place


def anchor_places(h: np.ndarray, low: np.ndarray, ok: np.ndarray, reach: int) -> np.ndarray:
    """Places that are the anchor of a window."""
    place = window_anchors(h, low, ok, reach)
    return np.unique(place[place >= 0])


def suffixes(docs: DataFrame) -> DataFrame:
    """doc, n_words, sequence, places and suffixes (KEY hashes of 4 bytes each, joined) of the anchors."""
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("sequence", pa.binary()), ("places", pa.list_(pa.int32())), ("keys", pa.binary())])

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1))
                h, low = w.anchors(WIDTH, WINDOW)
                at = anchor_places(h, low, w.inside(WINDOW), WINDOW - WIDTH + 1)
                own = w.doc[at]
                short = (w.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                index = at[:, None] + np.arange(KEY)
                ends = w.first[own + 1]
                key = np.where(index < ends[:, None], short[np.minimum(index, max(len(short) - 1, 0))] if len(short) else 0, 0).astype(">u4")
                cut = np.searchsorted(own, np.arange(w.n + 1))
                raw = key.tobytes()
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(w.first)), pa.array([xxhash.xxh3_128_digest(w.hash[a:b].tobytes()) for a, b in zip(w.first, w.first[1:])], pa.binary()),
                    pa.array([(at[i:j] - w.first[d]).astype(np.int32) for d, (i, j) in enumerate(zip(cut, cut[1:]))], pa.list_(pa.int32())),
                    pa.array([raw[4 * KEY * i:4 * KEY * j] for i, j in zip(cut, cut[1:])], pa.binary())], schema=schema)

    return docs.select("doc", "text").mapInArrow(run, "doc long, n_words long, sequence binary, places array<int>, keys binary")


def runs(first: DataFrame) -> DataFrame:
    """(doc, places, run): the anchors that agree with a neighbour on WIDTH words. run is a number for each run of at most MOST, -1 for the others."""
    at = F.posexplode("places").alias("_k", "place")
    rows = first.select("doc", "keys", at).select("doc", "place", F.substring("keys", F.col("_k") * (4 * KEY) + 1, F.lit(4 * KEY)).alias("key"))
    rows = rows.repartitionByRange("key", "doc", "place").sortWithinPartitions("key", "doc", "place")
    schema = pa.schema([("doc", pa.int64()), ("place", pa.int32()), ("run", pa.int64())])

    @tidy
    def run(batches):
        number = TaskContext.get().partitionId() << 40
        doc, place, key = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, WIDTH), ">u4")  # the last run so far
        whole = False  # whether its beginning is in this partition

        def told(doc, place, run):
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place, pa.int32()), pa.array(run)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u4").reshape(-1, KEY)[:, :WIDTH]
            doc, place, key = np.concatenate([doc, batch.column(0).to_numpy()]), np.concatenate([place, batch.column(1).to_numpy()]), np.concatenate([key, more])
            start = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1])
            size = np.diff(np.append(start, len(doc)))
            name = number + np.arange(len(start))
            number += len(start)
            take, small = size > 1, size <= MOST
            if not whole:
                take[0], small[0] = True, False
            if len(start) == 1 and size[0] > MOST:  # one run so far, too long to wait for its end
                whole = False
            if whole or len(start) > 1:
                take[-1] = False
                own = np.repeat(take, size)
                yield told(doc[own], place[own], np.repeat(np.where(small, name, -1), size)[own])
                whole, last = True, start[-1]
                doc, place, key = doc[last:], place[last:], key[last:]
            else:
                yield told(doc, place, np.full(len(doc), -1))
                doc, place, key = doc[:0], place[:0], key[-1:][:0]
        yield told(doc, place, np.full(len(doc), -1))

    found = rows.select("doc", "place", "key").mapInArrow(run, "doc long, place int, run long")
    return found.groupBy("doc").agg(F.collect_set(F.struct("place", "run")).alias("_at")).select("doc", F.col("_at.place").alias("places"), F.col("_at.run").alias("runs"))


def surroundings(docs: DataFrame, at: DataFrame) -> DataFrame:
    """(h1, h2, doc, start, words): for an anchor of a short run its run (h1), the place of the first word around it, how many words there are before the anchor (h2) and the words; else the windows of the anchor with their hashes, and no words."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])
    reach = WINDOW - WIDTH

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                w = Words(part.column(1))
                raw, n, doc = w.data.tobytes(), len(w.doc), part.column(0).to_numpy()
                lists = [part.column(k) for k in (2, 3)]
                size = lists[0].value_lengths().to_numpy().astype(np.int64)
                own = np.repeat(np.arange(w.n), size)
                anchor, name = w.first[own] + lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy()
                few = name >= 0
                x, d = anchor[few], own[few]
                lo, hi = np.maximum(w.first[d], x - reach), np.minimum(w.first[d + 1], x + WINDOW)
                words = [raw[i:j] for i, j in zip(w.starts[lo].tolist(), w.ends[hi - 1].tolist())] if len(x) else []
                yield pa.RecordBatch.from_arrays([pa.array(name[few]), pa.array((x - lo).astype(np.int64)), pa.array(doc[d]), pa.array((lo - w.first[d]).astype(np.int32)), pa.array(words, pa.binary())], schema=schema)
                some = np.zeros(n, bool)
                some[anchor[~few]] = True
                if some.any():
                    place = window_anchors(*w.anchors(WIDTH, WINDOW), w.inside(WINDOW), reach + 1)
                    start = np.flatnonzero(place >= 0)
                    start = start[some[place[start]]]
                    d = w.doc[start]
                    one, two = (gram_hashes(w.hash, LENGTH, seed)[start].view(np.int64) for seed in (61, 62))
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(doc[d]), pa.array((start - w.first[d]).astype(np.int32)), pa.nulls(len(start), pa.binary())], schema=schema)

    rows = docs.join(at, "doc").select("doc", "text", "places", "runs")
    return rows.mapInArrow(run, "h1 long, h2 long, doc long, start int, words binary")


_FOUND = "doc long, start int, n_words int, other long, other_start int"
_FOUND_ARROW = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("other", pa.int64()), ("other_start", pa.int32())])


def _found(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND_ARROW)], schema=_FOUND_ARROW)


def agreement(x: list, y: list) -> int:
    """How many elements at the beginning of both are equal."""
    n = min(len(x), len(y))
    return n if x[:n] == y[:n] else next(k for k in range(n) if x[k] != y[k])


def extended(rows: DataFrame) -> DataFrame:
    """What the members of each short run share around their anchors, from both sides."""

    @tidy
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for group in batch.column(0):
                members = []
                for m in group.as_py():
                    words = m["words"].split()
                    members.append((m["doc"], m["start"] + m["h2"], words[:m["h2"]][::-1], words[m["h2"]:]))
                for k, (a, p, before, after) in enumerate(members):
                    for b, q, before2, after2 in members[k + 1:]:
                        left, right = agreement(before, before2), agreement(after, after2)
                        if left + right >= LENGTH:
                            out += [(a, p - left, left + right, b, q - left), (b, q - left, left + right, a, p - left)]
            yield _found(list(zip(*out)) or [[]] * 5)

    groups = rows.groupBy("h1").agg(F.collect_list(F.struct("doc", "start", "h2", "words")).alias("_m")).filter(F.size("_m") > 1)
    return groups.select("_m").mapInArrow(run, _FOUND)


def equal_windows(rows: DataFrame) -> DataFrame:
    """Windows that a neighbour in the order of their hashes equals, with that neighbour."""
    spark = rows.sparkSession
    rows = rows.select("h1", "h2", "doc", "start").repartitionByRange("h1", "h2", "doc", "start").sortWithinPartitions("h1", "h2", "doc", "start")

    @tidy
    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy() for k in range(4)]
            if last is None:
                yield ends([c[:1] for c in now], 0, part)
            else:
                now = [np.concatenate([x, y]) for x, y in zip(last, now)]
            h1, h2, doc, start = now
            same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            i = np.flatnonzero(same)
            first = i[~np.concatenate([[False], same])[i]]  # of a kind; the others name the one before them
            mine, other = np.concatenate([first, i + 1]), np.concatenate([first + 1, i])
            yield marks([doc[mine], start[mine], np.full(len(mine), LENGTH, np.int32), doc[other], start[other]])
            last = [c[-1:] for c in now]
        if last is not None:
            yield ends(last, 1, part)

    names = [*_FOUND_ARROW.names, "h1", "h2", "end", "part"]

    def marks(columns):
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(columns, _FOUND_ARROW)], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], names)

    def ends(columns, end, part):
        h1, h2, doc, start = columns
        none = [pa.nulls(1, f.type) for f in (_FOUND_ARROW.field(k) for k in (2, 3, 4))]
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start, pa.int32()), *none, pa.array(h1), pa.array(h2), pa.array([end], pa.int32()), pa.array([part], pa.int32())], names)

    found, _ = stage(rows.mapInArrow(run, _FOUND + ", h1 long, h2 long, end int, part int"), "equal_windows")
    line = sorted((r["part"], r["end"], r["h1"], r["h2"], r["doc"], r["start"]) for r in found.filter("part IS NOT NULL").collect())  # two rows a partition
    more = []
    for x, y in zip(line, line[1:]):
        if x[0] != y[0] and x[2:4] == y[2:4]:
            more += [(x[4], x[5], LENGTH, y[4], y[5]), (y[4], y[5], LENGTH, x[4], x[5])]
    return found.filter("part IS NULL").select(*_FOUND_ARROW.names).unionByName(spark.createDataFrame(more, _FOUND))


def stretches(found: DataFrame) -> DataFrame:
    """found merged, document by document: overlapping and touching stretches are one, which names the other place of its first words."""

    @tidy
    def run(batches):
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            flat = batch.column(1).flatten()
            start, n, other, place = (flat.field(k).to_numpy() for k in range(4))
            own = np.repeat(np.arange(batch.num_rows), size)
            order = np.lexsort((place, other, start, own))
            own, start, end, other, place = own[order], start[order].astype(np.int64), (start + n)[order].astype(np.int64), other[order], place[order]
            far = int(end.max(initial=0)) + 2  # documents one after another, so that none touches the next
            reach = np.maximum.accumulate(end + own * far)
            new = np.ones(len(own), bool)
            new[1:] = start[1:] + own[1:] * far > reach[:-1]
            at = np.flatnonzero(new)
            stop = reach[np.append(at[1:], len(own)) - 1] - own[at] * far if len(at) else at
            yield _found([batch.column(0).to_numpy()[own[at]], start[at], stop - start[at], other[at], place[at]])

    lists = found.groupBy("doc").agg(F.collect_list(F.struct("start", "n_words", "other", "other_start")).alias("_f"))
    return lists.mapInArrow(run, _FOUND)


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start and n_words (in words) of each stretch that is covered by repeated windows, and other_id, other_start: a place where its first window occurs again. Documents without one have no row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if distinct_ids(docs):
        found = _passages(docs.select(F.col("doc_id").alias("doc"), "text")).withColumnsRenamed({"doc": "doc_id", "other": "other_id"})
    else:
        _, each = numbered(docs)
        found, _ = stage(_passages(each.select("doc", "text")), "passages")
        total = found.count()
        for c in ("doc", "other"):
            names = found.groupBy(c).count().join(each.select(F.col("doc").alias(c), F.col("doc_id").alias(f"{c}_id")), c)
            found = hot_join(found, names, c, "count", total).drop("count")
    return found.select("doc_id", "start", "n_words", "other_id", "other_start")


def _passages(docs: DataFrame) -> DataFrame:
    """doc, start, n_words, other, other_start of docs (doc, text), whose docs are distinct."""
    rows, rows_at = stage(suffixes(docs), "suffixes")
    groups = rows.groupBy("sequence").agg(F.min("doc").alias("first"), F.count("*").alias("n_rows"))
    known, _ = stage(hot_join(rows.select("doc", "n_words", "sequence"), groups, "sequence", "n_rows", rows.count()).select("doc", "n_words", "first"), "grouped")
    copies = known.filter((F.col("doc") != F.col("first")) & (F.col("n_words") >= LENGTH))
    leaders = rows.join(known.filter(F.col("doc") != F.col("first")).select("doc"), "doc", "left_anti")
    at, at_at = stage(runs(leaders), "runs")
    drop(docs.sparkSession, rows_at)
    around, around_at = stage(surroundings(docs, at), "surroundings")
    drop(docs.sparkSession, at_at)
    windows = equal_windows(around.filter("words IS NULL"))
    zero = F.lit(0)
    led = copies.groupBy("first", F.col("n_words").cast("int").alias("n_words")).agg(F.min("doc").alias("other"))
    led = led.select(F.col("first").alias("doc"), zero.alias("start"), "n_words", "other", zero.alias("other_start"))
    found, _ = stage(stretches(extended(around.filter("words IS NOT NULL")).unionByName(windows).unionByName(led)), "stretches")
    drop(docs.sparkSession, around_at)
    whole = copies.select("doc", zero.alias("start"), F.col("n_words").cast("int").alias("n_words"), F.col("first").alias("other"), zero.alias("other_start"))
    place = lambda c: F.col(c).cast("long").alias(c)
    return found.unionByName(whole).select("doc", place("start"), place("n_words"), "other", place("other_start"))
