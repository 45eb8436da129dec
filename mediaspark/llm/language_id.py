"""Language identification by a byte convolutional network, trained in numpy.

A text is a run of windows of WINDOW bytes, STRIDE apart, so that every filter position of the whole text is
seen once. Bytes are embedded, filters of the WIDTHS slide over them, each filter's maximum over the window
goes through a softmax, and the windows' probabilities are averaged by their bytes.

The network learns from a bounded sample: at most PER_LANGUAGE documents of each of the LANGUAGES most frequent
languages, chosen by a hash of text and doc_id (so that a much copied text counts as often as it occurs), EXCERPTS
excerpts of each. Nothing but the text's bytes is an input of a prediction.

Defined results: null text, and text without a letter, is `und` with score 0; where no labelled row can be
learned from, every text is `und`. Of tied languages the first by name is told; a very long text is windowed
whole. An empty table gives an empty table. Rows that repeat each get their prediction. Other columns pass through,
but for columns named lang_pred and score, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaspark.llm.common import LOWER, crc_mod, slices, text_buffer, tidy, with_fields

#: Window length in bytes, filter widths and filters of each width, embedding size.
WINDOW, WIDTHS, FILTERS, DEPTH = 256, (3, 4, 5), 16, 8
WIDEST = max(WIDTHS)
STRIDE = WINDOW - WIDEST + 1
#: Languages that are learned at most, the most frequent ones.
LANGUAGES = 1000
#: Documents a language to learn from at most, excerpts of each, and passes over them.
PER_LANGUAGE, EXCERPTS, EPOCHS = 600, 3, 6
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CODE = LOWER.copy()
_CODE[48:58] = 48


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray  # 256 x DEPTH
    taps: np.ndarray  # WIDEST * DEPTH x filters
    bias: np.ndarray
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray


def _mask() -> np.ndarray:
    """Narrow filters have no weight beyond their width."""
    return np.repeat(np.concatenate([np.repeat((np.arange(WIDEST) < w)[:, None], FILTERS, 1) for w in WIDTHS], 1), DEPTH, 0).astype(np.float32)


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (windows x WINDOW, 0 beyond the text), the text of each window and its bytes that are new to it."""
    lens = np.diff(off)
    each = -(-lens // STRIDE)
    doc = np.repeat(np.arange(len(lens)), each)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    start, stop = off[:-1][doc] + nth * STRIDE, off[1:][doc]
    at = start[:, None] + np.arange(WINDOW)
    codes = np.where(at < stop[:, None], _CODE[data[np.minimum(at, max(len(data) - 1, 0))]] if len(data) else 0, 0).astype(np.uint8)
    return codes, doc, np.minimum(STRIDE, stop - start)


def _patches(embed: np.ndarray, codes: np.ndarray) -> np.ndarray:
    x = embed[codes].reshape(len(codes), WINDOW * DEPTH)
    s = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(codes), STRIDE, WIDEST * DEPTH), (s[0], DEPTH * s[1], s[1]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def window_probabilities(model: Model, codes: np.ndarray, batch: int = 256) -> np.ndarray:
    found = []
    for i in range(0, len(codes), batch):
        part = codes[i:i + batch]
        p = np.ascontiguousarray(_patches(model.embed, part)).reshape(-1, WIDEST * DEPTH)
        top = (p @ model.taps).reshape(len(part), STRIDE, -1).max(1)
        found.append(_softmax(np.maximum(top + model.bias, 0) @ model.out + model.out_bias))
    return np.concatenate(found) if found else np.zeros((0, len(model.languages)), np.float32)


def fit(texts: list[bytes], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model | None:
    """Adam on windows cut from the texts, each at a length drawn anew so that short texts are learned too."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng, mask, n = np.random.default_rng(seed), _mask(), len(WIDTHS) * FILTERS
    par = [rng.normal(0, 0.3, (256, DEPTH)), rng.normal(0, 0.3, (WIDEST * DEPTH, n)) * mask, np.zeros(n), rng.normal(0, 0.2, (n, len(languages))), np.zeros(len(languages))]
    par = [p.astype(np.float32) for p in par]
    m, v, step = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    y = np.searchsorted(languages, labels)
    per = np.maximum(1, np.bincount(y, minlength=len(languages)))
    weight = (len(y) / (len(languages) * per))[y].astype(np.float32)
    for _ in range(epochs if len(languages) > 1 else 0):
        codes = np.zeros((len(texts), WINDOW), np.uint8)
        for k, t in enumerate(texts):
            long = len(t) if rng.random() < 0.5 else int(rng.integers(min(8, len(t)), len(t) + 1)) if t else 0
            at = int(rng.integers(0, len(t) - min(long, WINDOW) + 1))
            raw = np.frombuffer(t, np.uint8)[at:at + min(long, WINDOW)]
            codes[k, :len(raw)] = _CODE[raw]
        order = rng.permutation(len(texts))
        for i in range(0, len(order), 64):
            own = order[i:i + 64]
            part = codes[own]
            p = np.ascontiguousarray(_patches(par[0], part))
            z = (p.reshape(-1, WIDEST * DEPTH) @ par[1]).reshape(len(own), STRIDE, n)
            where = z.argmax(1)
            top = np.take_along_axis(z, where[:, None], 1)[:, 0] + par[2]
            hidden = np.maximum(top, 0)
            g = _softmax(hidden @ par[3] + par[4])
            g[np.arange(len(own)), y[own]] -= 1
            g *= weight[own][:, None] / len(own)
            back = (g @ par[3].T) * (top > 0)
            hit = p[np.arange(len(own))[:, None], where]  # own x n x taps
            grads = [None, np.einsum("bnk,bn->kn", hit, back, optimize=True) * mask, back.sum(0), hidden.T @ g, g.sum(0)]
            flow = (back[:, :, None] * par[1].T[None]).reshape(len(own), n, WIDEST, DEPTH)
            byte = part[np.arange(len(own))[:, None, None], where[:, :, None] + np.arange(WIDEST)].ravel()
            flat = flow.reshape(-1, DEPTH)
            grads[0] = np.stack([np.bincount(byte, flat[:, d], 256) for d in range(DEPTH)], 1)
            step += 1
            for j, gr in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * gr
                v[j] = 0.999 * v[j] + 0.001 * gr * gr
                par[j] = (par[j] - 0.004 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return Model(languages, *par)


def sample(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> tuple[list[bytes], list[str]]:
    """Excerpts and languages of a bounded number of documents, taken from all over the table."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & (F.length("text") > 0))
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(3.0 * per_language) / F.count("*")).alias("_share"))
    share = docs.sparkSession.createDataFrame(share.orderBy("_share", "lang").limit(LANGUAGES).collect(), share.schema)
    draw = F.xxhash64(F.lit("sample"), "text", "doc_id")
    some = rows.join(F.broadcast(share), "lang").filter(F.pmod(draw, F.lit(1 << 20)) < F.col("_share") * (1 << 20))
    at = [1 + F.pmod(F.xxhash64(F.lit(k), "text", "doc_id"), F.greatest(F.lit(1), F.length("text") - WINDOW)).cast("int") for k in range(EXCERPTS)]
    some = some.select("lang", draw.alias("_draw"), F.array(*[F.substring("text", a, F.lit(WINDOW)) for a in at]).alias("_cut"))
    top = some.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_draw"))).filter(F.col("_n") <= per_language)
    got = sorted((r["lang"], r["_draw"], r["_cut"]) for r in top.select("lang", "_draw", "_cut").collect())
    return [c.encode() for _, _, cut in got for c in cut], [lang for lang, _, cut in got for _ in cut]


def train(docs: DataFrame, usable: Column | None = None) -> Model | None:
    """The network learned from those rows of docs (doc_id, text, lang) that are usable: by default crc32(doc_id) mod 5 is not 0."""
    return fit(*sample(docs, crc_mod(F.col("doc_id"), 5) != 0 if usable is None else usable))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, "lang_pred", "score"]

    @tidy
    def run(batches):
        net = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                lang, score = label(part.column(part.schema.get_field_index("text")), net)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names)

    return docs.mapInArrow(run, with_fields(docs, lang_pred="string", score="double"))


def label(texts: pa.Array, net: Model | None) -> tuple[list[str], np.ndarray]:
    data, off = text_buffer(texts)
    n = len(texts)
    letters = np.add.reduceat(np.append(_LETTER[data], False), np.minimum(off[:-1], len(data))) * (np.diff(off) > 0) if n else np.zeros(0)
    written = np.array([bool(c) or b > a and any(map(str.isalpha, texts[i].as_py())) for i, (c, a, b) in enumerate(zip(letters, off, off[1:]))], bool)
    if net is None or not len(data):
        return [UNKNOWN] * n, np.zeros(n)
    codes, doc, size = windows(data, off)
    p = window_probabilities(net, codes)
    mean = np.stack([np.bincount(doc, p[:, k] * size, n) for k in range(p.shape[1])], 1)
    mean /= np.maximum(mean.sum(1, keepdims=True), 1e-30)
    best = mean.argmax(1)
    return [net.languages[b] if w else UNKNOWN for b, w in zip(best, written)], np.where(written, np.clip(mean[np.arange(n), best], 0, 1), 0)
