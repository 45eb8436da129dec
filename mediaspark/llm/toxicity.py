"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (a run of letters and digits, A-Z lower-cased) is the sum of two hashed embeddings: its own and that of
its first PREFIX bytes, so that unseen forms of a known stem are recognised. Filters of the WIDTHS slide over
the words of the whole text, each filter's maximum over the text goes through a logistic unit.

The network learns from a bounded sample of labelled rows: at most MOST documents of each label, chosen by a
hash, and of each at most WORDS words in a row, which begin at a hashed place. A quarter of the sample is left out of the fit; on it the scores are calibrated, and a threshold is set
for each language. Languages are told from the words themselves (naive Bayes over the hashed words); the
threshold of the told language is mapped to CUT, so that score >= CUT is the decision in every language.

Defined results: null or empty text, and text without words, scores 0; where
no labelled row can be learned from, every score is 0. Rows that repeat each get their score. Of several
labels for a doc_id the largest counts. A very long text is scored whole, by the maximum over all its words; of
tied languages the first by name is told; an empty table gives an empty table. Other columns pass through, but for columns named score and
predicted, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import ALNUM, LOWER, crc_mod, slices, text_buffer, tidy, with_fields, word_hashes, words

#: Hash buckets, embedding size, filter widths and filters of each, bytes of a prefix.
BUCKETS, DEPTH, WIDTHS, FILTERS, PREFIX = 1 << 15, 12, (1, 2, 3), 12, 5
WIDEST = max(WIDTHS)
#: Documents of each label to learn from at most, words of each, and passes over them.
MOST, WORDS, EPOCHS = 3000, 4096, 8
#: Texts of an update; a small sample is passed over until there were so many updates.
BATCH, UPDATES = 24, 600
#: Words left out in a pass, and where the sums of squared gradients of the embeddings begin.
DROP, START = 0.3, 1e-3
CUT = 0.3


@dataclass
class Model:
    embed: np.ndarray  # 2 * BUCKETS x DEPTH
    taps: np.ndarray  # WIDEST * DEPTH x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float  # of the calibration
    shift: float
    languages: list[str]
    told: np.ndarray  # BUCKETS x languages, log probabilities
    thresholds: np.ndarray


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and of prefixes, and word offsets by text."""
    data, off = text_buffer(texts)
    data = LOWER[data]
    starts, ends, doc = words(data, off, ALNUM)
    whole = (word_hashes(data, starts, ends, 3) >> np.uint64(40)) % np.uint64(BUCKETS)
    stem = (word_hashes(data, starts, ends, 4, PREFIX) >> np.uint64(40)) % np.uint64(BUCKETS)
    return whole.astype(np.int32), stem.astype(np.int32) + BUCKETS, np.searchsorted(doc, np.arange(len(off)))


def _mask() -> np.ndarray:
    return np.repeat(np.concatenate([np.repeat((np.arange(WIDEST) < w)[:, None], FILTERS, 1) for w in WIDTHS], 1), DEPTH, 0).astype(np.float32)


def _rows(whole: np.ndarray, stem: np.ndarray, off: np.ndarray, embed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts with WIDEST - 1 empty places after each text: windows, first window of each text, word of each place (-1: none)."""
    lens = np.diff(off)
    first = off[:-1] + np.arange(len(lens)) * (WIDEST - 1)
    place = np.full(off[-1] + len(lens) * (WIDEST - 1) + WIDEST, -1)
    place[np.arange(off[-1]) + np.repeat(np.arange(len(lens)) * (WIDEST - 1), lens)] = np.arange(off[-1])
    x = np.zeros((len(place), DEPTH), np.float32)
    full = place >= 0
    x[full] = embed[whole[place[full]]] + embed[stem[place[full]]]
    s = x.strides
    view = np.lib.stride_tricks.as_strided(x.reshape(-1), (len(place) - WIDEST + 1, WIDEST * DEPTH), (s[0], s[1]))
    return np.ascontiguousarray(view), first, place


def _top(z: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest value of each filter over each text; the first window of an empty text is all zeros."""
    return np.maximum.reduceat(z, first, 0)


def raw_scores(model: Model, whole: np.ndarray, stem: np.ndarray, off: np.ndarray) -> np.ndarray:
    if len(off) < 2:
        return np.zeros(0)
    rows, first, _ = _rows(whole, stem, off, model.embed)
    hidden = np.maximum(_top(rows @ model.taps, first) + model.bias, 0)
    return hidden @ model.out + model.out_bias


def language(model: Model, whole: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The language of each text by its words, as a number."""
    total = np.concatenate([np.zeros((1, len(model.languages))), np.cumsum(model.told[whole], 0, dtype=np.float64)])
    return (total[off[1:]] - total[off[:-1]]).argmax(1) if len(model.languages) else np.zeros(len(off) - 1, int)


def scores(model: Model, whole: np.ndarray, stem: np.ndarray, off: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(-np.clip(model.slope * raw_scores(model, whole, stem, off) + model.shift, -30, 30)))
    t = model.thresholds[language(model, whole, off)]
    return np.where(np.diff(off) > 0, np.where(p < t, CUT * p / t, CUT + (1 - CUT) * (p - t) / (1 - t)), 0.0)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str | None], epochs: int = EPOCHS, seed: int = 11) -> Model | None:
    """docs: (word buckets, prefix buckets) of each text."""
    if not len(docs):
        return None
    rng, mask, n = np.random.default_rng(seed), _mask(), len(WIDTHS) * FILTERS
    embed = rng.normal(0, 0.1, (2 * BUCKETS, DEPTH)).astype(np.float32)
    taps = (rng.normal(0, 0.3, (WIDEST * DEPTH, n)) * mask).astype(np.float32)
    bias, out, out_bias = np.zeros(n, np.float32), rng.normal(0, 0.1, n).astype(np.float32), np.float32(0)
    held = rng.random(len(docs)) < 0.25
    if held.all() or not (labels[~held].any() and (labels[~held] == 0).any()):
        held[:] = False
    par = [embed, taps, bias, out, np.array([out_bias])]
    # So large a start that a word seen once moves little: what many texts share is learned first.
    acc = [np.full_like(p, START if k == 0 else 1e-6) for k, p in enumerate(par)]
    own = np.flatnonzero(~held)
    for _ in range(max(epochs, -(-UPDATES * BATCH // max(1, len(own))))):
        for batch in np.array_split(rng.permutation(own), max(1, len(own) // BATCH)):
            part = []
            for i in batch:  # a third of the words is left out, anew each time
                keep = rng.random(len(docs[i][0])) >= DROP
                part.append((docs[i][0][keep], docs[i][1][keep]))
            off = np.concatenate([[0], np.cumsum([len(a) for a, _ in part])]).astype(np.int64)
            whole, stem = (np.concatenate([x[k] for x in part]) if off[-1] else np.zeros(0, np.int32) for k in (0, 1))
            rows, first, place = _rows(whole, stem, off, par[0])
            z = rows @ par[1]
            top = _top(z, first)
            # The first window that reaches the maximum.
            owner = np.repeat(np.arange(len(part)), np.diff(np.append(first, len(z))))
            hit_row, hit_filter = np.nonzero(z == top[owner])
            where = np.zeros(top.shape, np.int64)
            where[owner[hit_row][::-1], hit_filter[::-1]] = hit_row[::-1]
            act = top + par[2]
            hidden = np.maximum(act, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ par[3] + par[4][0], -30, 30)))
            g = (p - labels[batch]) / len(batch)
            back = (g[:, None] * par[3]) * (act > 0)
            hit = rows[where]  # texts x filters x taps
            grads = [None, np.einsum("bnk,bn->kn", hit, back, optimize=True) * mask + 1e-5 * par[1], back.sum(0), hidden.T @ g, np.array([g.sum()])]
            flow = (back[:, :, None] * par[1].T[None]).reshape(-1, WIDEST, DEPTH)
            word = place[where.reshape(-1)[:, None] + np.arange(WIDEST)].ravel()
            flow = flow.reshape(-1, DEPTH)[word >= 0]
            word = word[word >= 0]
            index = np.concatenate([whole[word], stem[word]])
            touched, inverse = np.unique(index, return_inverse=True)
            twice = np.concatenate([flow, flow])
            change = np.stack([np.bincount(inverse, twice[:, d], len(touched)) for d in range(DEPTH)], 1).astype(np.float32)
            acc[0][touched] += change**2
            par[0][touched] -= 0.08 * change / np.sqrt(acc[0][touched])
            for j in range(1, 5):
                acc[j] += grads[j] ** 2
                par[j] -= (0.05 * grads[j] / np.sqrt(acc[j])).astype(par[j].dtype)
    names = sorted({x for x in langs if x is not None})
    told = np.ones((BUCKETS, max(1, len(names))))
    for (whole, _), lang in zip(docs, langs):
        if lang is not None:
            told[:, names.index(lang)] += np.bincount(np.unique(whole), minlength=BUCKETS)
    told = np.log(told / told.sum(0)).astype(np.float32)
    model = Model(par[0], par[1], par[2], par[3], float(par[4][0]), 1.0, 0.0, names, told, np.full(max(1, len(names)), 0.5))
    _calibrate(model, docs, labels, np.flatnonzero(held) if held.any() else own)
    return model


def _calibrate(model: Model, docs: list, labels: np.ndarray, own: np.ndarray) -> None:
    """Slope and shift by logistic regression on rows that the fit didn't see; for each language the threshold of best F1."""
    off = np.concatenate([[0], np.cumsum([len(docs[i][0]) for i in own])]).astype(np.int64)
    whole, stem = (np.concatenate([docs[i][k] for i in own]) if off[-1] else np.zeros(0, np.int32) for k in (0, 1))
    raw, y = raw_scores(model, whole, stem, off), labels[own].astype(float)
    x = np.stack([raw, np.ones_like(raw)], 1)
    w, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * (w - prior)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
        w = np.clip(w, [0.05, -20], [20, 20])
    model.slope, model.shift = map(float, w)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    lang = language(model, whole, off)
    for k in range(len(model.thresholds)):
        mine = lang == k
        if y[mine].sum() >= 5 and (1 - y[mine]).sum() >= 5:
            tries = np.linspace(0.05, 0.95, 91)
            hits = np.array([((p[mine] >= t) & (y[mine] > 0)).sum() for t in tries])
            f1 = 2 * hits / np.array([(p[mine] >= t).sum() + y[mine].sum() for t in tries])
            model.thresholds[k] = float(np.median(tries[f1 >= f1.max() - 1e-9]))


def sample(docs: DataFrame, labels: DataFrame, usable: Column, most: int = MOST) -> tuple[list, np.ndarray, list]:
    """Features, labels and languages of a bounded number of labelled documents."""
    marks = labels.filter(F.col("toxic").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).filter(F.col("_toxic").isin(0, 1))
    counts = {r["_toxic"]: r["count"] for r in marks.groupBy("_toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20))
    share = F.lit(0.0)
    for k, c in counts.items():
        share = F.when(F.col("_toxic") == k, F.lit(min(1.0, 1.5 * most / c))).otherwise(share)
    some = marks.withColumn("_draw", draw).filter(F.col("_draw") < share * (1 << 20))
    top = None
    for k in counts:  # at most two
        one = some.filter(F.col("_toxic") == k).orderBy("_draw", "doc_id").limit(most)
        top = one if top is None else top.unionByName(one)
    if top is None:
        return [], np.zeros(0), []
    chosen = docs.sparkSession.createDataFrame(top.collect(), top.schema)  # 2 * most rows at most
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").join(F.broadcast(chosen), "doc_id")

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                whole, stem, off = features(part.column(part.schema.get_field_index("text")))
                begin = [i + int(whole[i]) * 40503 % (j - i - WORDS + 1) if j - i > WORDS else i for i, j in zip(off.tolist(), off[1:].tolist())]
                lists = [pa.array([x[i:min(i + WORDS, j)] for i, j in zip(begin, off[1:].tolist())], pa.list_(pa.int32())) for x in (whole, stem)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *lists], ["doc_id", "lang", "_toxic", "whole", "stem"])

    kinds = dict(rows.dtypes)
    got = rows.select("doc_id", "text", "lang", "_toxic").mapInArrow(run, f"doc_id {kinds['doc_id']}, lang string, _toxic {kinds['_toxic']}, whole array<int>, stem array<int>").toArrow()
    order = np.lexsort((got.column("whole").combine_chunks().value_lengths().to_numpy(), got.column("doc_id").to_numpy()))
    lists = [got.column(c).take(pa.array(order)).combine_chunks() for c in ("whole", "stem")]
    whole, stem = (np.asarray(x.flatten()) for x in lists)
    ends = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())])
    docs_ = [(whole[i:j], stem[i:j]) for i, j in zip(ends, ends[1:])]
    return docs_, got.column("_toxic").to_numpy()[order], [got.column("lang")[int(i)].as_py() for i in order]


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model | None:
    """The network learned from those rows of labels (doc_id, toxic) that are usable: by default crc32(doc_id) mod 4 is not 2."""
    return fit(*sample(docs, labels, crc_mod(F.col("doc_id"), 4) != 2 if usable is None else usable))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score and predicted."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, "score", "predicted"]

    @tidy
    def run(batches):
        net = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                s = np.zeros(part.num_rows) if net is None else scores(net, *features(part.column(part.schema.get_field_index("text"))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], names)

    return docs.mapInArrow(run, with_fields(docs, score="double", predicted="int"))
