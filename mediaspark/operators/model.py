"""The model stage: a pluggable classifier for the records that no rule decides.

No weights come with the library. A model is a function from a series of texts to a frame of label and score;
onnx_model makes one of a user's ONNX file and tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("video", "audio", "book", "software", "other")
Model = Callable[[pd.Series], pd.DataFrame]


def softmax(logits: Column) -> Column:
    """Shares of an array of logits, the largest taken off first."""
    shifted = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Place (from 0) of the largest value, the last among equals."""
    return (F.size(values) - F.array_position(F.reverse(values), F.array_max(values))).cast("int")


def confidence(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.7, "medium").otherwise("low")


def with_model(classified: DataFrame, model: Model, least: float = 0.0, text: Column | None = None) -> DataFrame:
    """classified records, those of the fallback judged by the model.

    Only they pass through Python: a Python column would be computed for every row whatever a condition says,
    so the undecided are split off and put back by a union. Scores below least leave the fallback.
    """
    decided = classified.filter("source <> 'fallback'").select("content_id", "medium", "confidence", "source")
    open_ = classified.filter("source = 'fallback'").select("content_id", (F.col("name") if text is None else text).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = model(frame["text"])
            yield pd.DataFrame({"content_id": frame["content_id"].values, "label": said["label"].values, "score": said["score"].values})

    told = open_.mapInPandas(run, "content_id long, label string, score double")
    sure = F.col("score") >= least
    medium = F.when(~sure, "other").when(F.col("label").isin(*LABELS), F.col("label")).otherwise("other")
    return decided.unionByName(told.select("content_id", medium.alias("medium"), F.when(sure, confidence(F.col("score"))).otherwise("low").alias("confidence"), F.when(sure, "ml").otherwise("fallback").alias("source")))


def keyword_model(texts: pd.Series) -> pd.DataFrame:
    """A deterministic stand-in: a few words for each medium, and no confidence without one."""
    words = {"video": "clip|movie|show", "audio": "song|artist", "book": "book|author", "software": "app|setup"}
    label, score = pd.Series("other", texts.index), pd.Series(0.5, texts.index)
    for k, pattern in words.items():
        hit = texts.fillna("").str.contains(pattern, case=False, regex=True) & (score == 0.5)
        label, score = label.mask(hit, k), score.mask(hit, 0.75)
    return pd.DataFrame({"label": label, "score": score})


def onnx_model(path: str, tokenizer_path: str, labels: tuple[str, ...] = LABELS, length: int = 128) -> Model:
    """A model of an ONNX file (input_ids, attention_mask -> logits) on the executors, loaded once a worker."""
    state: dict = {}

    def run(texts: pd.Series) -> pd.DataFrame:
        import numpy as np

        if not state:
            import onnxruntime
            from tokenizers import Tokenizer

            state["tokenizer"] = Tokenizer.from_file(tokenizer_path)
            state["tokenizer"].enable_truncation(length)
            state["tokenizer"].enable_padding()
            state["session"] = onnxruntime.InferenceSession(path)
        enc = state["tokenizer"].encode_batch(texts.fillna("").tolist())
        feed = {"input_ids": np.array([e.ids for e in enc], np.int64), "attention_mask": np.array([e.attention_mask for e in enc], np.int64)}
        z = state["session"].run(None, feed)[0].astype(float)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.shape[1] - 1 - p[:, ::-1].argmax(1)
        return pd.DataFrame({"label": [labels[k] for k in best], "score": p[np.arange(len(p)), best]})

    return run
