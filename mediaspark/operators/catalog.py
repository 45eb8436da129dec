"""Matching against a catalogue of albums and artists, and comparison of extractions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mediaspark.functions import text as T
from mediaspark.operators.matching import sequence_ratio

ACCEPT_EARLY, ACCEPT, LEAST_ARTIST, LEAST_ALBUM, PREFIX = 0.85, 0.7, 0.5, 0.6, 15


@F.pandas_udf(StringType())
def folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lower case, underscores as spaces, letters without accents, one kind of dash, single spaces; ac-dc as ac/dc."""
    import re

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        s = unicodedata.normalize("NFD", s.lower().strip().replace("_", " "))
        s = "".join(c for c in s if unicodedata.category(c) != "Mn")
        s = re.sub(r"\bac-dc\b", "ac/dc", s).replace("–", "-").replace("—", "-")
        return re.sub(r"\s+", " ", s)

    for t in texts:
        yield t.map(one, na_action="ignore")


def _scored(pairs: DataFrame, strategy: int) -> DataFrame:
    """pairs of wanted (q_artist, q_album, q_year) and catalogue (artist, album, year) with their score, those that the strategy's limits let through."""
    rows = pairs.withColumn("_al", sequence_ratio(T.normal_album(F.col("q_album")), T.normal_album(F.col("album"))))
    rows = rows.withColumn("_ar", sequence_ratio(T.normal_album(F.col("q_artist")), T.normal_album(F.col("artist"))))
    rows = rows.filter((F.col("_ar") > LEAST_ARTIST) & (F.lit(strategy == 1) | (F.col("_al") > LEAST_ALBUM)))
    year = F.when(F.col("q_year") == F.col("year"), 0.1).otherwise(0.0)
    return rows.withColumn("score", F.col("_al") * 0.6 + F.col("_ar") * 0.4 + year).withColumn("strategy", F.lit(strategy)).drop("_al", "_ar")


def best_of_catalogue(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The best album of the catalogue (album_id, artist, album, year) for each wanted one (q_id, q_artist, q_album, q_year), if it scores above ACCEPT.

    Tried in turn: the same album name; names that begin alike; the same artist. A score of ACCEPT_EARLY ends
    the search, so later strategies see only those that are still open. Each is an equi-join; the second on the
    first PREFIX characters. All are merge joins: the size of a compressed table says little of its rows, and broadcasts
    of such tables go through the driver.
    """
    w = wanted.withColumn("_p", F.substring("q_album", 1, PREFIX))
    c = catalogue.withColumn("_p", F.substring("album", 1, PREFIX))
    best, open_ = None, w
    for k, on in enumerate((F.col("q_album") == F.col("album"), None, F.col("q_artist") == F.col("artist")), 1):
        pairs = open_.join(c.hint("merge"), "_p") if on is None else open_.drop("_p").join(catalogue.hint("merge"), on)
        found = _scored(pairs.drop("_p"), k)
        best = found if best is None else best.unionByName(found)
        sure = found.filter(F.col("score") >= ACCEPT_EARLY).select("q_id").distinct()
        open_ = open_.join(sure.hint("merge"), "q_id", "left_anti")
    first = Window.partitionBy("q_id").orderBy(F.desc("score"), "strategy", "album_id")
    return best.withColumn("_n", F.row_number().over(first)).filter((F.col("_n") == 1) & (F.col("score") > ACCEPT)).drop("_n")


def titles_match(said: Column, ratio: Column, expected: Column, least: float = 0.8) -> Column:
    """Equal, one inside the other, or alike enough; never for empty titles. ratio: sequence_ratio of the two."""
    some = (said != "") & (expected != "")
    return F.coalesce(some & (F.contains(said, expected) | F.contains(expected, said) | (ratio >= least)), F.lit(False))


def field_similarity(a: Column, b: Column, ratio: Column, exact: bool = False) -> Column:
    """1 for equal normal values, 0 where one is missing or an exact field differs, else their ratio."""
    x, y = T.normal_value(a), T.normal_value(b)
    return F.when(x == y, F.lit(1.0)).when((x == "") | (y == "") | F.lit(exact), F.lit(0.0)).otherwise(ratio)


def agreement(similarities: list[Column], first: Column, second: Column, least: float = 0.7) -> tuple[Column, Column]:
    """(status, agreement) of two extractions from the similarities of their fields; null extractions have failed."""
    mean = sum(similarities[1:], similarities[0]) / len(similarities)
    one, two = first.isNull(), second.isNull()
    status = F.when(one & two, "both_null").when(one, "model1_failed").when(two, "model2_failed").when(mean >= least, "agree").otherwise("disagree")
    return status, F.when(one & two, 1.0).when(one | two, 0.0).otherwise(mean)


def accepted(year: Column, expected_year: Column, artist_ratio: Column, title_ratio: Column, least: float = 0.7) -> Column:
    """Whether an extraction is what was expected: the year, if one is, and artist and title alike enough."""
    return F.coalesce((expected_year.isNull() | (year == expected_year)) & (artist_ratio >= least) & (title_ratio >= least), F.lit(False))


def training_pairs(names: DataFrame, seed: str = "42") -> DataFrame:
    """(a, b, same) of distinct names: each with its variants as positives, and as negative with the next name in a drawn order whose normal form differs.

    The order is by md5, and the neighbour is found within buckets of the draw, so no sort meets in one task.
    """
    rows = names.select("name").distinct()
    positives = rows.select(F.col("name").alias("a"), F.explode(T.name_variants(F.col("name"))).alias("b")).withColumn("same", F.lit(True))
    drawn = rows.withColumn("_d", F.md5(F.concat("name", F.lit(seed)))).withColumn("_k", F.substring("_d", 1, 2))
    nxt = F.lead("name").over(Window.partitionBy("_k").orderBy("_d"))
    negatives = drawn.select(F.col("name").alias("a"), nxt.alias("b")).filter(F.col("b").isNotNull() & (T.normal_pair(F.col("a")) != T.normal_pair(F.col("b")))).withColumn("same", F.lit(False))
    return positives.unionByName(negatives)
