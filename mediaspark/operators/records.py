"""Texts and tables that are made of records and their files: prompts, training texts, extension counts, queues, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.functions import files as fs
from mediaspark.operators import cascade

# The wording of the labelling prompt; fixed values.
PROMPT_HEAD = """Classify this torrent. Reply with exactly one word: music, video, software, book, porn, or other

Note: "video" includes movies, TV shows, anime, documentaries. "book" includes comics/manga.

Torrent: """
PROMPT_FILES, PROMPT_END = "\nTop files:\n", "\n\nCategory:"


def _joined(rows: DataFrame, line: Column, order: str, by: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return rows.groupBy("content_id").agg(F.array_join(F.transform(pairs, lambda x: x["line"]), by).alias("_lines"))


def prompts(content: DataFrame, files: DataFrame) -> DataFrame:
    """content_id and prompt: the record's name and its three largest files, for a labelling model."""
    line = F.concat(F.lit("  "), fs.basename(F.col("path")), F.lit(" ("), fs.human_size(F.col("size")), F.lit(")"))
    top = _joined(cascade.ranked_files(files), line, "rank", "\n")
    rows = content.join(top, "content_id", "left")
    return rows.select("content_id", F.concat(F.lit(PROMPT_HEAD), "name", F.lit(PROMPT_FILES), F.coalesce("_lines", F.lit("")), F.lit(PROMPT_END)).alias("prompt"))


def training_texts(content: DataFrame, files: DataFrame, order: str = "path") -> DataFrame:
    """content_id and text: the name and the paths of the first three files (not the largest) between bars."""
    first = F.slice(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("path").alias("p")))), 1, 3)
    lists = files.groupBy("content_id").agg(F.array_join(F.transform(first, lambda x: x["p"]), " | ").alias("_lines"))
    return content.join(lists, "content_id", "left").select("content_id", F.concat_ws(" | ", "name", "_lines").alias("text"))


def extension_counts(files: DataFrame) -> DataFrame:
    """content_id, ext, n and bytes for each extension; files without one are left out."""
    rows = files.select("content_id", fs.extension(F.col("path")).alias("ext"), "size").filter(F.col("ext").isNotNull() & (F.col("ext") != ""))
    return rows.groupBy("content_id", "ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def file_tree(files: DataFrame) -> DataFrame:
    """content_id and tree: its paths in order, one a line."""
    return files.groupBy("content_id").agg(F.array_join(F.sort_array(F.collect_list("path")), "\n").alias("tree"))


def by_id(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is one of ids: many point look-ups as one join."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def move(todo: DataFrame, done: DataFrame, finished: Column) -> tuple[DataFrame, DataFrame]:
    """(todo, done) after the rows of todo that are finished went over; a condition of null is not finished."""
    gone = F.coalesce(finished, F.lit(False))
    return todo.filter(~gone), done.unionByName(todo.filter(gone))


def external_key(source: str, artist: Column, album: Column, most: int = 50) -> Column:
    """A key of a source for records that have none: the beginnings of artist and album; null where one is missing or empty."""
    key = F.concat(F.lit(f"{source}:"), F.substring(artist, 1, most), F.lit(":"), F.substring(album, 1, most))
    return F.when((artist != "") & (album != ""), key)


def flat_aliases(artists: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of artists (name, aliases) those whose name or an alias is wanted (name): (canonical_name, alias) pairs, the name itself among them."""
    every = F.array_distinct(F.concat(F.array("name"), F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != "")))
    pairs = artists.filter("name IS NOT NULL").select(F.col("name").alias("canonical_name"), F.explode(every).alias("alias"))
    keys = wanted.select(F.trim(F.lower("name")).alias("_key")).distinct()
    found = pairs.join(keys, F.trim(F.lower("alias")) == F.col("_key"), "left_semi").select("canonical_name").distinct()
    return pairs.join(found, "canonical_name", "left_semi").distinct()


def validated(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """wanted (id, kind, title, artist, year) with the first of its results (id, place, title, artist, year) that fits.

    Of the five first results a movie needs a title ratio over 0.8 and a year at most one off (a missing one fits),
    a series the title ratio, an album ratios over 0.7 of title and artist.
    """
    from mediaspark.functions.text import normal_title
    from mediaspark.operators.matching import sequence_ratio

    top = results.filter("place <= 5").select("id", "place", *[F.col(c).alias(f"found_{c}") for c in ("title", "artist", "year")])
    ratio = lambda c: F.coalesce(sequence_ratio(F.lower(F.col(c)), F.lower(F.col(f"found_{c}"))), F.lit(0.0))
    rows = wanted.join(top, "id").withColumn("_t", ratio("title")).withColumn("_a", ratio("artist"))
    near = F.col("year").isNull() | F.col("found_year").isNull() | (F.abs(F.col("year") - F.col("found_year")) <= 1)
    fits = F.when(F.col("kind") == "movie", (F.col("_t") > 0.8) & near).when(F.col("kind") == "tv", F.col("_t") > 0.8).otherwise((F.col("_t") > 0.7) & (F.col("_a") > 0.7))
    first = rows.filter(fits).groupBy("id").agg(F.min(F.struct("place", "found_title", "found_artist", "found_year")).alias("_f"))
    return wanted.join(first, "id").select(*wanted.columns, "_f.place", "_f.found_title", "_f.found_artist", "_f.found_year")


def regression(cases: DataFrame, said: list[str], expected: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row of total and passed, the failed cases) of cases with what was said and what was expected."""
    same = F.lit(True)
    for s, e in zip(said, expected):
        same = same & F.col(s).eqNullSafe(F.col(e))
    rows = cases.withColumn("_same", same)
    return rows.agg(F.count("*").alias("total"), F.count_if("_same").alias("passed")), rows.filter(~F.col("_same")).drop("_same")


def report(counts: DataFrame, group: str, label: str, n: str) -> DataFrame:
    """Sections of a Markdown report, one row a group: its labels with their numbers and shares, most frequent first."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("o"), F.col(label).alias("l"))))
    sums = counts.groupBy(group).agg(F.sum(n).alias("_all"), rows.alias("_rows"))
    line = lambda r: F.concat(F.lit("| "), r["l"], F.lit(" | "), (-r["o"]).cast("string"), F.lit(" | "), F.format_number(-100.0 * r["o"] / F.col("_all"), 1), F.lit("% |"))
    body = F.array_join(F.transform("_rows", line), "\n")
    return sums.select(group, F.concat(F.lit("## "), group, F.lit("\n\n| label | n | share |\n|---|---|---|\n"), body).alias("section"))
