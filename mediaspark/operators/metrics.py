"""Evaluation of predictions, class weights, and deterministic sampling and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(cells: DataFrame) -> DataFrame:
    """label, support, precision, recall and f1 from the cells of a confusion table; 0 where undefined."""
    ends = cells.select(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"))
    ends = ends.unionByName(cells.select(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")))
    one = ends.groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("said").alias("said"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return one.select("label", "support", safe(F.col("hit"), F.col("said")).alias("precision"), safe(F.col("hit"), F.col("support")).alias("recall"), safe(2 * F.col("hit"), F.col("support") + F.col("said")).alias("f1"))


def overall(cells: DataFrame) -> DataFrame:
    """accuracy, macro_f1 and weighted_f1 in one row."""
    f1 = per_class(cells).agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    hit = cells.agg((F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return hit.crossJoin(f1)  # one row each


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """label, n and total / (classes * n)."""
    one = rows.groupBy(label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    return one.select(label, "n", (F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n"))).alias("weight"))


def draw(key: Column, seed: str) -> Column:
    """A text that orders rows at random, the same on every engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def sample_per_class(rows: DataFrame, label: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """At most n rows of each class, by draw."""
    w = Window.partitionBy(label).orderBy(draw(F.col(key), seed), key)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def split(key: Column, seed: str = "42", tenths: int = 1) -> Column:
    """'test' for so many tenths of the keys, else 'train', by the first hexadecimal digits of the draw."""
    bucket = F.conv(F.substring(draw(key, seed), 1, 6), 16, 10).cast("long") % 10
    return F.when(bucket < tenths, "test").otherwise("train")


def accuracy(rows: DataFrame, said: str, expected: str, by: str, least: float = 0.9) -> DataFrame:
    """For each value of by: n, the share of answers that equal what was expected (case and outer spaces aside), and the share that do or are alike by `least`."""
    from mediaspark.operators.matching import sequence_ratio

    a, b = (F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in (said, expected))
    rows = rows.select(by, (a == b).alias("_same"), sequence_ratio(F.when(a != b, a), b).alias("_ratio"))
    alike = F.col("_same") | F.coalesce(F.col("_ratio") >= least, F.lit(False))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col("_same").cast("double")).alias("exact"), F.avg(alike.cast("double")).alias("fuzzy"))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from one time without zone to another, to the nearest (halves to even), whatever the session's time zone.

    Both are taken as doubles of seconds since 1970 and subtracted then, as SQL's extract(epoch) does it."""
    since = lambda t: (t - F.expr("timestamp_ntz'1970-01-01'")).cast("interval second").cast("decimal(20,6)")
    epoch = lambda t: (since(t.cast("timestamp_ntz")) * 1_000_000).cast("long").cast("double") / 1e6
    return F.rint(epoch(end) - epoch(start)).cast("long")


def progress(done: Column, all_: Column, seconds: Column) -> tuple[Column, Column]:
    """(rows a second, seconds that are left at this rate); null before any time or row."""
    some = (seconds > 0) & (done > 0)
    return F.when(some, done / seconds), F.when(some, (all_ - done) * (seconds / done))
