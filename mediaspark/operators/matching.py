"""Matching of known titles with release names: blocking by tokens, scoring by rules, the best of each title."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from mediaspark.functions import patterns as P
from mediaspark.functions import text as T
from mediaspark.functions.files import nullif_empty

#: Names with a token beyond which a title is looked up by two tokens.
FREQUENT = 1000


def tokens(c: Column) -> Column:
    """The distinct tokens of the full-text index: lower-cased runs of letters and digits."""
    return F.array_distinct(F.array_remove(F.split(F.lower(c), r"[^0-9a-z]+"), ""))


def query_tokens(title: Column, year: Column, kind: Column, artist: Column) -> Column:
    """The tokens that a name must hold for a title; null for titles that are too short or only digits."""
    none = F.array().cast("array<string>")

    def parts(words: Column) -> Column:
        return F.when(F.size(words) <= 3, F.filter(words, lambda w: F.length(w) > 2)).otherwise(F.slice(F.filter(words, lambda w: F.length(w) > 3), 1, 4))

    years = F.when(year.isNotNull() & (year != 0), F.array(year.cast("string"))).otherwise(none)
    artists = F.when((kind == "album") & (F.coalesce(artist, F.lit("")) != ""), F.slice(F.filter(F.split(T.squeeze(artist), " "), lambda w: F.length(w) > 2), 1, 2)).otherwise(none)
    made = T.once(T.once(F.split(T.squeeze(title), " "), parts), lambda p: F.when(F.size(p) > 0, F.array_distinct(F.transform(F.concat(p, years, artists), F.lower))))
    return F.when((F.length(title) >= 3) & ~title.rlike(r"^[0-9]+$"), made)


def candidates(titles: DataFrame, names: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """titles (gt_id, ..., wanted) joined with names (name_id, name, ...) that hold all wanted tokens.

    The join is on the rarest wanted token. Where even that is in more than `frequent` names, it is on the two rarest,
    so a word that many names have is a join key only for a title that wants nothing else. A pair is made once; the rest of
    the tokens is a filter on the pair. Tokens are counted where the names lie, and those of more than `frequent` names, of
    which there are few, are told apart there too: only for the others is a name shuffled.
    """
    names = names.filter("name_id IS NOT NULL")  # for all branches, so that they read one shuffle of the names
    index = names.withColumn("token", F.explode_outer(tokens(F.col("name")))).filter("token IS NOT NULL")  # an inner explode is planned with a filter that splits the name again
    frequency = index.groupBy("token").agg(F.count("*").alias("n"))
    each = titles.select("gt_id", "wanted", F.explode_outer("wanted").alias("token")).hint("merge").join(frequency, "token")
    rarest = each.groupBy("gt_id", "wanted").agg(F.array_sort(F.collect_set(F.struct("n", "token"))).alias("_r"), F.count("*").alias("_rows"))
    first, second = (F.get("_r", F.lit(k)) for k in (0, 1))
    single = (first["n"] <= frequent) | (F.size("_r") == 1)
    probe = rarest.filter(F.size("_r") == F.size("wanted")).select("gt_id", "wanted", (F.col("_rows") / F.size("_r")).cast("int").alias("_copies"), single.alias("_single"), first["token"].alias("token"), second["token"].alias("_other"))
    alone, two = probe.filter("_single").drop("_single", "_other"), probe.filter("NOT _single").drop("_single")
    often = frequency.filter(F.col("n") > frequent).select("token").join(alone.select("token").distinct().hint("merge"), "token", "left_anti")
    one = index.join(F.broadcast(often), "token", "left_anti").join(alone.hint("merge"), "token").drop("token")
    of_two = two.select(F.explode(F.array("token", "_other")).alias("token")).distinct()
    held = index.select("name_id", "token").join(F.broadcast(of_two), "token", "left_semi").groupBy("name_id").agg(F.array_sort(F.collect_set("token")).alias("_t"))
    both = F.flatten(F.transform("_t", lambda x: F.transform(F.filter("_t", lambda y: y > x), lambda y: F.concat_ws(" ", x, y))))
    pair = F.concat_ws(" ", F.least("token", "_other"), F.greatest("token", "_other"))
    by_two = two.withColumn("token", pair).drop("_other").join(held.select("name_id", F.explode(both).alias("token")), "token").drop("token").join(names, "name_id")
    near = F.forall("wanted", lambda t: F.contains(F.lower("name"), t))  # cheap, and few pairs are left to be split
    found = one.unionByName(by_two).filter(near & (F.size(F.array_intersect("wanted", tokens(F.col("name")))) == F.size("wanted")))
    if set(titles.columns) == {"gt_id", "wanted"}:
        return found.withColumn("_copies", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies")
    return found.drop("_copies").join(titles.hint("merge"), ["gt_id", "wanted"])


@F.pandas_udf(DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the matched characters over all, by longest matching blocks; not symmetric. Null counts as empty."""
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def pieces(name: Column) -> Column:
    return F.split(F.lower(name), r"[.\-_\s\[\]()]+")


def contained_words(title: Column, normal_name: Column, name_pieces: Column) -> Column:
    """Share of a normal title's words that are part of a piece of the name; 1 if the whole title is in the normal name."""
    words = F.filter(F.split(title, " "), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: F.exists(name_pieces, lambda p: F.contains(p, w))))
    return F.when(F.contains(normal_name, title), F.lit(1.0)).when(F.size(words) == 0, F.lit(0.0)).otherwise(hits / F.size(words))


def with_similarity(rows: DataFrame, *titles: str) -> DataFrame:
    """rows with <title>_alike: the share of contained words (<title>_share), or the sequence ratio of the title to the beginning of the name (_normal), twice as long as the title, if that is more.

    The ratio is made only of pairs whose title isn't contained whole.
    """
    schema = StructType(list(rows.schema.fields))
    for t in titles:
        schema = schema.add(f"{t}_alike", DoubleType())

    def run(batches):
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            out = []
            for t in titles:
                share = column(f"{t}_share").to_pylist()
                for k, x in enumerate(share):
                    if x is not None and x < 1:
                        title = column(t)[k].as_py()
                        share[k] = max(x, SequenceMatcher(None, title, column("_normal")[k].as_py()[:2 * len(title)]).ratio())
                out.append(pa.array(share, pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], schema.names)

    return rows.mapInArrow(run, schema)


def size_fits(kind: Column, size: Column) -> Column:
    out = None
    for k, (lo, hi) in P.SIZE_RANGES.items():
        out = F.when(kind == k, size.between(lo, hi)) if out is None else out.when(kind == k, size.between(lo, hi))
    return out.otherwise(True)


def prepared(pairs: DataFrame) -> DataFrame:
    """pairs (title, type, artist, name, ...) with all that the score reads of the name or the title alone."""
    n = F.col("name")
    rows = pairs.select("*", T.normal_title(n).alias("_normal"), pieces(n).alias("_pieces"), n.rlike(P.AUDIO_MARKS).alias("_audio"), n.rlike(P.VIDEO_MARKS).alias("_video"), T.year_in_name(n).alias("_told"))
    return rows.select("*", T.normal_title(F.col("title")).alias("_title"), T.normal_title(F.when(F.col("type") == "album", nullif_empty(F.col("artist")))).alias("_artist"))


def scored(titles: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of titles (gt_id, type, title, artist, year, wanted) and names with their score; those that the rules reject are left out."""
    rows = prepared(candidates(titles.select("gt_id", "type", "title", "artist", "year", "wanted"), names.select("name_id", "name", "size").filter(~F.col("name").rlike(P.NEGATIVE))))
    kind, size, off = F.col("type"), F.col("size"), F.abs(F.col("_told") - F.col("year"))
    known = F.coalesce((F.col("year") != 0) & F.col("_told").isNotNull(), F.lit(False))
    against = ~size_fits(kind, size) | (kind == "album") & F.col("_video") & ~F.col("_audio") | kind.isin("movie", "tv") & F.col("_audio") & ~F.col("_video") | known & (off > 1)
    rows = rows.filter(~against)
    for c in ("_title", "_artist"):
        rows = rows.withColumn(f"{c}_share", contained_words(F.col(c), F.col("_normal"), F.col("_pieces")))
    rows = rows.select("gt_id", "type", "title", "year", "name_id", "name", "size", "_normal", "_audio", "_video", "_told", "_title", "_artist", "_title_share", "_artist_share")
    rows = with_similarity(rows, "_title", "_artist").filter("_title_alike > 0.7")
    artist = F.when(F.col("_artist_alike") > 0.7, F.col("_artist_alike") * 5).otherwise(0.0)
    bulk = F.when((kind == "movie") & size.between(700_000_000, 4_000_000_000), 2).when((kind == "movie") & size.between(4_000_000_001, 15_000_000_000), 1)
    bulk = bulk.when((kind == "album") & size.between(50_000_000, 500_000_000), 2).otherwise(0)
    marked = F.when((kind == "album") & F.col("_audio") | kind.isin("movie", "tv") & F.col("_video"), 3).otherwise(0)
    years = F.when(known & (off == 0), 5).when(known & (off == 1), 2).otherwise(0)
    score = F.col("_title_alike") * 10 + years + artist + bulk + marked
    return rows.select("gt_id", "type", "title", "name_id", "name", "size", score.alias("score"))


def best_matches(scored: DataFrame, least: float = 8, most: int = 10) -> DataFrame:
    """The most best names of each title with at least that score; equal scores by name and id."""
    w = Window.partitionBy("gt_id").orderBy(F.desc("score"), "name", "name_id")
    return scored.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """existing and those rows of new whose key is in neither; of new rows of one key the first in order."""
    fresh = new.join(existing.select(*keys), keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy(*order)
    return existing.unionByName(fresh.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n"))


def aliases_of(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (name) with every name it goes by: the aliases of a canonical name, else the first canonical name of an alias, else itself; without regard to case."""
    own = names.select("name", F.lower("name").alias("_k")).distinct()
    a = aliases.select("canonical_name", "alias", F.lower("canonical_name").alias("_c"), F.lower("alias").alias("_a"))
    forward = own.join(a, own["_k"] == a["_c"]).select("name", F.col("alias").alias("other"))
    first = a.groupBy("_a").agg(F.min("canonical_name").alias("canonical_name"))
    backward = own.join(forward.select("name"), "name", "left_anti").join(first, F.col("_k") == F.col("_a")).select("name", F.col("canonical_name").alias("other"))
    return own.select("name", F.col("name").alias("other")).unionByName(forward).unionByName(backward).distinct()
