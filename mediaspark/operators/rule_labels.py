"""The six-class rule labeler over names and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.functions import patterns as P
from mediaspark.functions.files import extension


def label(content: DataFrame, files: DataFrame) -> DataFrame:
    """content_id and label of the records with files: porn, music, movie, software, book or other, by the first rule that holds."""
    f = files.withColumn("_e", extension(F.col("path")))
    count = lambda own, name: F.count_if(F.col("_e").isin(own)).alias(name)
    one = f.groupBy("content_id").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), count(P.RULE_AUDIO, "a"), count(P.RULE_VIDEO, "v"), count(P.RULE_SOFTWARE, "s"), count(P.RULE_BOOK, "b"),
        count(["jpg", "jpeg"], "j"), count(["iso"], "iso"), count(["pdf"], "pdf"), F.sum(F.when(F.col("_e").isin(P.RULE_VIDEO), F.col("size")).otherwise(0)).alias("vs"))
    rows = content.join(one, "content_id")
    n, total, a, v, s, b, vs, name = (F.col(c) for c in ("n", "total", "a", "v", "s", "b", "vs", "name"))
    main = vs > total * 0.7
    book = (b / n > 0.5) | (b >= 3) & F.contains(F.lower(name), F.lit("ebook")) | (b == 1) & (F.col("pdf") == 1) & (total < 100 * 1024 * 1024)
    out = (F.when(name.rlike(P.RULE_ADULT) & ((v > 0) | (F.col("j") > 0)), "porn")
           .when((a / n > 0.5) & (a >= 3) & (v == 0), "music")
           .when((v > 0) & main & (name.rlike(P.RULE_MOVIE) | (v <= 3) & (vs > 500 * 1024 * 1024)), "movie")
           .when((s > 0) & (name.rlike(P.RULE_APP) | (F.col("iso") > 0)), "software")
           .when((b > 0) & book, "book")
           .when((a / n > 0.3) & (a >= 3), "music")
           .when((v > 0) & (v / n > 0.3), "movie")
           .otherwise("other"))
    return rows.select("content_id", out.alias("label"))
