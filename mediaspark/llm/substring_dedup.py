"""Substring dedup with repeated-phrase automata.

A word is removed if a window of WINDOW words that covers it occurs earlier: in a smaller doc_id, or before it
in the same document.

1. Texts of one word sequence are a group; all but the first are removed whole (if they have a window), and
   only the first goes on.
2. Each window's anchor, a phrase of WIDTH words chosen by content, is sorted over the corpus; phrases that
   recur in another text or within one are confirmed by their neighbours in the order.
3. Of each confirmed phrase a document tells one place where it stands. The phrases of each shard of documents (a
   slice of bounded bytes) are compiled from those places into an Aho-Corasick automaton over word numbers, and the
   shard's documents are streamed through it; its hits alone locate the occurrences. A document is in one shard, and
   a phrase in each shard that has it, so no automaton holds more phrases than its shard's documents have and a
   phrase of a third of the corpus is one phrase a shard. A document without a confirmed phrase has none to locate.
4. The windows around located phrases are compared exactly (128 bits of the word sequence), again as
   neighbours in a sorted order; every one but the first of its kind is marked. A range-partitioned sort by
   (window, document, place) splits any hot window over many tasks.
5. The marked words are cut out.

Defined results: null text has no words; texts shorter than a window keep all; rows that share a doc_id are
documents of their own, ordered by a hash of their texts, and equal rows get equal results; a null doc_id comes before
all others; of equal windows the first by (doc_id, start) stays; a very long text is a slice of its own; an empty table gives an empty
table. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import distinct_ids, drop, gram_hashes, hot_join, numbered, slices, stage, tidy
from mediaspark.llm.passages import Words, sliding_min

WINDOW, WIDTH = 20, 8


def _kept(w: Words, doc: int, keep: np.ndarray | None, raw: bytes) -> str:
    a, b = w.first[doc], w.first[doc + 1]
    own = np.arange(a, b) if keep is None else np.arange(a, b)[keep]
    return hashlib.sha256(b" ".join([raw[i:j] for i, j in zip(w.starts[own].tolist(), w.ends[own].tolist())])).hexdigest()


def profiles(docs: DataFrame) -> DataFrame:
    """doc, n_words, whole_sha256, sequence (an identifier of the word sequence), anchors (distinct), places (one of each), twice (whether the text has it again)."""
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("whole_sha256", pa.string()), ("sequence", pa.binary()), ("anchors", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("twice", pa.list_(pa.bool_()))])

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1))
                raw = w.data.tobytes()
                h, low = w.anchors(WIDTH, WINDOW)
                rows = []
                for d in range(w.n):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    anchors, places, again = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, bool)
                    if b - a >= WINDOW:
                        anchors = np.unique(low[a:b - WINDOW + 1])
                        grams = h[a:b - WIDTH + 1]
                        order = np.argsort(grams, kind="stable")
                        own = grams[order]
                        begin = np.searchsorted(own, anchors, "left")
                        places, again = order[begin].astype(np.int32), np.searchsorted(own, anchors, "right") - begin > 1
                    rows.append((b - a, _kept(w, d, None, raw), xxhash.xxh3_128_digest(w.hash[a:b].tobytes()), anchors.view(np.int64), places, again))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(6)]], schema=schema)

    return docs.select("doc", "text").mapInArrow(run, "doc long, n_words long, whole_sha256 string, sequence binary, anchors array<long>, places array<int>, twice array<boolean>")


def recurring(first: DataFrame) -> DataFrame:
    """(doc, places): for each text one place of each anchor that another text has, or that it has again.

    Neighbours in the order by (anchor, doc) tell; the first and the last anchor of a partition count as
    recurring, as their neighbours may be elsewhere.
    """
    at = F.explode(F.arrays_zip("anchors", "places", "twice")).alias("_at")
    every = first.select("doc", at).select("doc", F.col("_at.anchors").alias("anchor"), F.col("_at.places").alias("place"), F.col("_at.twice").alias("twice"))
    # What a text has again stands next to itself in the order.
    rows = every.select("doc", "place", F.explode(F.when(F.col("twice"), F.array("anchor", "anchor")).otherwise(F.array("anchor"))).alias("anchor"))
    rows = rows.repartitionByRange("anchor", "doc").sortWithinPartitions("anchor", "doc")

    def emit(doc, place):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place, pa.int32())], ["doc", "place"])

    @tidy
    def run(batches):
        hold = None  # the rows of the last anchor so far
        head = True
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, anchor, place = (batch.column(k).to_numpy() for k in range(3))
            if hold is not None:
                doc, anchor, place = (np.concatenate([x, y]) for x, y in zip(hold, (doc, anchor, place)))
            change = np.flatnonzero(np.diff(anchor)) + 1
            last = int(change[-1]) if len(change) else 0
            if last == 0:
                # One anchor so far: two rows settle it, and all but one can go.
                if len(doc) > 1:
                    yield emit(doc[:-1], place[:-1])
                    hold, head = (doc[-1:], anchor[-1:], place[-1:]), True
                else:
                    hold = (doc, anchor, place)
                continue
            start = np.concatenate([[0], change[:-1]])
            size = np.diff(np.append(start, last))
            take = size > 1
            take[0] |= head
            own = np.repeat(take, size)
            yield emit(doc[:last][own], place[:last][own])
            hold, head = (doc[last:], anchor[last:], place[last:]), False
        if hold is not None:
            yield emit(hold[0], hold[2])

    return rows.select("doc", "anchor", "place").mapInArrow(run, "doc long, place int").groupBy("doc").agg(F.collect_set("place").alias("places"))


def locate(w: Words, places: np.ndarray) -> np.ndarray:
    """Whether one of the phrases that stand at places begins at each word, found by streaming all texts through an automaton."""
    hit = np.zeros(len(w.hash), bool)
    if not len(places):
        return hit
    _, code = np.unique(w.hash, return_inverse=True)
    code = (code + 1).astype(np.uint32)
    code[code >= 0xD800] += 0x800
    line = code.tobytes().decode("utf-32-le")
    auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for phrase in {line[p:p + WIDTH] for p in places.tolist()}:
        auto.add_word(phrase)
    auto.make_automaton()
    for d in range(w.n):
        a, b = int(w.first[d]), int(w.first[d + 1])
        if b - a >= WINDOW:
            found = [end for end, _ in auto.iter(line, a, b)]
            hit[np.array(found, np.int64) - (WIDTH - 1)] = True
    return hit


def candidate_windows(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(h1, h2, doc, start) of the windows whose anchor is a located phrase."""
    rows = docs.join(phrases, "doc").select("doc", "text", "places")

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1))
                h, low = w.anchors(WIDTH, WINDOW)
                own = np.repeat(np.arange(w.n), part.column(2).value_lengths().to_numpy().astype(np.int64))
                at = w.first[own] + part.column(2).flatten().to_numpy()
                hit = locate(w, at)
                near = sliding_min(np.where(hit[:len(h)], h, np.uint64(0xFFFFFFFFFFFFFFFF)), WINDOW - WIDTH + 1)
                at = np.flatnonzero(w.inside(WINDOW) & (near == low))
                one, two = gram_hashes(w.hash, WINDOW, 61), gram_hashes(w.hash, WINDOW, 62)
                own = w.doc[at]
                ids = part.column(0).to_numpy()[own] if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), pa.array(ids), pa.array((at - w.first[own]).astype(np.int64))], ["h1", "h2", "doc", "start"])

    return rows.mapInArrow(run, "h1 long, h2 long, doc long, start long")


def repeats(windows: DataFrame) -> DataFrame:
    """(doc, start) of every window that is not the first of its kind in the order of (doc, start)."""
    spark = windows.sparkSession
    rows = windows.repartitionByRange("h1", "h2", "doc", "start").sortWithinPartitions("h1", "h2", "doc", "start")

    @tidy
    def run(batches):
        part, last, began = TaskContext.get().partitionId(), None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, start = (batch.column(k).to_numpy() for k in range(4))
            prev = last if last is not None else (h1[0], h2[0], doc[0], start[0])
            p1, p2, pd, ps = (np.concatenate([[p], x[:-1]]) for p, x in zip(prev, (h1, h2, doc, start)))
            same = (h1 == p1) & (h2 == p2)
            twin = same & (doc == pd) & (start == ps)
            mark = same & ~twin
            last = (h1[-1], h2[-1], doc[-1], start[-1])
            n = int(mark.sum())
            kind = np.zeros(n, np.int32)
            out = [doc[mark], start[mark], h1[mark], h2[mark], kind]
            if not began:
                out = [np.concatenate([[v], x]) for v, x in zip((doc[0], start[0], h1[0], h2[0], 1), out)]
                began = True
            yield _marks(out, part)
        if last is not None:
            yield _marks([np.array([v]) for v in (last[2], last[3], last[0], last[1], 2)], part)

    marks, path = stage(rows.mapInArrow(run, "doc long, start long, h1 long, h2 long, kind int, part int"), "marks")
    ends = marks.filter("kind > 0").collect()  # two rows a partition
    heads = sorted((r["part"], r) for r in ends if r["kind"] == 1)
    tails = {r["part"]: r for r in ends if r["kind"] == 2}
    more, before = [], None
    for part, r in heads:
        if before is not None and (before["h1"], before["h2"]) == (r["h1"], r["h2"]) and (before["doc"], before["start"]) != (r["doc"], r["start"]):
            more.append((r["doc"], r["start"]))
        before = tails[part]
    return marks.filter("kind = 0").select("doc", "start").unionByName(spark.createDataFrame(more, "doc long, start long"))


def _marks(columns: list[np.ndarray], part: int) -> pa.RecordBatch:
    kinds = (pa.int64(),) * 4 + (pa.int32(),)
    return pa.RecordBatch.from_arrays([*[pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], pa.array(np.full(len(columns[0]), part, np.int32))], ["doc", "start", "h1", "h2", "kind", "part"])


def cut(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc, n_removed, kept_sha256, kept) of the documents with marked windows (doc, starts)."""
    rows = docs.join(marked, "doc").select("doc", "text", "starts")

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1))
                raw = w.data.tobytes()
                removed, sha = [], []
                for d in range(w.n):
                    n = int(w.first[d + 1] - w.first[d])
                    starts = part.column(2)[d].values.to_numpy()
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, starts[starts + WINDOW <= n], 1)
                    np.add.at(step, starts[starts + WINDOW <= n] + WINDOW, -1)
                    keep = np.cumsum(step)[:n] == 0
                    removed.append(n - int(keep.sum()))
                    sha.append(_kept(w, d, keep, raw))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc", "n_removed", "cut_sha256"])

    return rows.mapInArrow(run, "doc long, n_removed long, cut_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if distinct_ids(docs):
        return _deduped(docs.select(F.col("doc_id").alias("doc"), "text")).withColumnRenamed("doc", "doc_id")
    rows, each = numbered(docs)
    out, _ = stage(_deduped(each.select("doc", "text")).join(each.select("_key", "doc", "doc_id", "n_equal"), "doc"), "deduped")
    return hot_join(rows, out, "_key", "n_equal", rows.count()).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _deduped(docs: DataFrame) -> DataFrame:
    """doc, n_words, n_removed, kept_sha256 of docs (doc, text), whose docs are distinct."""
    spark = docs.sparkSession
    rows, rows_at = stage(profiles(docs), "profiles")
    groups = rows.groupBy("sequence").agg(F.min("doc").alias("first"), F.count("*").alias("n_rows"))
    known, known_at = stage(hot_join(rows, groups, "sequence", "n_rows", rows.count()), "grouped")
    drop(spark, rows_at)
    copy = (F.col("doc") > F.col("first")) & (F.col("n_words") >= WINDOW)
    phrases, phrases_at = stage(recurring(known.filter(~copy)), "phrases")
    windows, windows_at = stage(candidate_windows(docs, phrases), "windows")
    drop(spark, phrases_at)
    marked, _ = stage(repeats(windows).groupBy("doc").agg(F.collect_list("start").alias("starts")), "marked")
    drop(spark, windows_at)
    done, _ = stage(cut(docs, marked), "cut")
    out = known.join(done, "doc", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(none)).otherwise(F.coalesce("cut_sha256", "whole_sha256")).alias("kept_sha256"))
