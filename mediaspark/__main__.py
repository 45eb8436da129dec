"""The command line: python -m mediaspark [--detect-nsfw] [-i] <path or text>; without arguments the text is read from stdin.

A path that exists is loaded (folder, torrent, zip, tar, lines of names), anything else is one name. Each record is one line
of JSON. With -i every line of stdin is a JSON array of names, answered by a JSON array of results.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = "usage: python -m mediaspark [-i] [--detect-nsfw] <path|text>"


def records(spark: SparkSession, given: str) -> DataFrame:
    """content_id, name and files of a path that exists, else of a text."""
    from mediaspark.sources import archives

    at = spark._jvm.org.apache.hadoop.fs.Path(given) if not any(c in given for c in "\n\r") else None
    try:
        there = at is not None and at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    except Exception:  # not a path: a scheme that no file system knows, or letters that none allows
        there = False
    rows = archives.load(spark, given) if there else archives.from_text(spark.createDataFrame([(given,)], "value string"), "value")
    return rows.select(F.monotonically_increasing_id().alias("content_id"), "name", "files")


def main(args: Sequence[str], stdin: TextIO, stdout: TextIO, spark: SparkSession | None = None) -> int:
    from mediaspark.operators.annotate import annotate, as_json, rule_extractor
    from mediaspark.sources.archives import exploded
    from mediaspark.streaming.lines import classify_lines

    flags, given = [a for a in args if a.startswith("-")], " ".join(a for a in args if not a.startswith("-"))
    batch = "-i" in flags
    if not batch:
        given = given or stdin.read().strip()
        if not given:
            print(USAGE, file=sys.stderr)
            return 1
    spark = spark or SparkSession.builder.appName("mediaspark").getOrCreate()
    if batch:
        out = classify_lines(spark.createDataFrame([(x.strip(),) for x in stdin if x.strip()], "value string")).select("results")
    else:
        content, files = exploded(records(spark, given))
        out = as_json(annotate(content, files, extractor=rule_extractor, with_safety="--detect-nsfw" in flags)).select("json")
    for row in out.toLocalIterator():
        print(row[0], file=stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], sys.stdin, sys.stdout))
