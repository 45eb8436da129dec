"""Content records from torrents, zip and tar archives and folders.

Archives are read by Spark's binaryFile source, so they may lie in any store it knows, and listed on the
executors; a folder is listed by the same source with its contents pruned away.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.functions.files import archive_stem, loader

RECORD = "name string, files array<struct<path:string,filename:string,size:bigint>>, error string"


def bdecode(data: bytes, at: int = 0):
    """(value, next place) of the bencoded value at a place; byte strings stay bytes."""
    kind = data[at:at + 1]
    if kind == b"i":
        end = data.index(b"e", at)
        return int(data[at + 1:end]), end + 1
    if kind in (b"l", b"d"):
        items, at = [], at + 1
        while data[at:at + 1] != b"e":
            value, at = bdecode(data, at)
            items.append(value)
        return (items if kind == b"l" else dict(zip(items[::2], items[1::2]))), at + 1
    colon = data.index(b":", at)
    end = colon + 1 + int(data[at:colon])
    if end > len(data):
        raise ValueError("the torrent is cut off")
    return data[colon + 1:end], end


def _entry(path: str, size: int) -> dict:
    return {"path": path, "filename": PurePosixPath(path).name or path, "size": size}


def list_torrent(data: bytes, name: str) -> tuple[str, list[dict]]:
    """Its own name and files; a single file is called as the torrent is."""
    info = bdecode(data)[0][b"info"]
    own = info[b"name"].decode(errors="replace")
    if b"files" not in info:
        return own, [{"path": own, "filename": own, "size": info[b"length"]}]
    return own, [_entry("/".join(p.decode(errors="replace") for p in f[b"path"]), f[b"length"]) for f in info[b"files"]]


def list_zip(data: bytes, name: str) -> tuple[str, list[dict]]:
    """Files with their uncompressed sizes, under the archive's stem."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return PurePosixPath(name).stem, [_entry(i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]


def list_tar(data: bytes, name: str) -> tuple[str, list[dict]]:
    """Regular files; the compression goes by the suffix."""
    mode = "r:gz" if name.endswith((".tar.gz", ".tgz")) else "r:xz" if name.endswith((".tar.xz", ".txz")) else "r:"
    with tarfile.open(fileobj=io.BytesIO(data), mode=mode) as t:
        return name, [_entry(m.name, m.size) for m in t if m.isreg()]


LISTERS = {"torrent": list_torrent, "zip": list_zip, "tar": list_tar}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One record (name, files) of each torrent, zip or tar at path; error says why a file could not be read."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    raw = raw.select(name.alias("name"), loader(name).alias("loader"), "content").filter("loader <> 'text'")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, kind, data in zip(frame["name"], frame["loader"], frame["content"]):
                try:
                    out.append((*LISTERS[kind](bytes(data), name), None))
                except Exception as e:  # a broken archive is a row with its error, not the end of the job
                    out.append((name, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["name", "files", "error"])

    listed = raw.mapInPandas(run, RECORD)
    return listed.withColumn("name", archive_stem(F.col("name")))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """One record of all regular files below a folder, with paths relative to it; contents are not read."""
    root = path.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    relative = F.regexp_replace("path", "^.*" + _quoted(PurePosixPath(root).name) + "/", "")
    entry = F.struct(relative.alias("path"), F.element_at(F.split(relative, "/"), -1).alias("filename"), F.col("length").alias("size"))
    return rows.groupBy(F.lit(PurePosixPath(root).name).alias("name")).agg(F.sort_array(F.collect_list(entry)).alias("files"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The records of a path: a folder, else the reader of its extension, else a text that holds a name a line."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return read_folder(spark, path)
    kind = spark.range(1).select(loader(F.lit(path))).first()[0]
    return read_archives(spark, path) if kind != "text" else from_text(spark.read.text(path), "value")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def from_text(rows: DataFrame, column: str) -> DataFrame:
    """Records of names alone: no files, not null."""
    return rows.select(F.col(column).alias("name"), F.array().cast("array<struct<path:string,filename:string,size:bigint>>").alias("files"))


def exploded(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(content, files) of records with a content_id."""
    files = records.select("content_id", F.explode("files").alias("f")).select("content_id", "f.path", "f.filename", "f.size")
    return records.select("content_id", "name"), files
