import io
import json
import tarfile
import zipfile

from mediaspark.sources import archives
from mediaspark.streaming.lines import classify_lines


def bencode(v):
    if isinstance(v, int):
        return b"i%de" % v
    if isinstance(v, bytes):
        return b"%d:%s" % (len(v), v)
    if isinstance(v, list):
        return b"l" + b"".join(map(bencode, v)) + b"e"
    return b"d" + b"".join(bencode(k) + bencode(v[k]) for k in sorted(v)) + b"e"


def test_archives(spark, tmp_path):
    many = {b"info": {b"name": b"Album", b"files": [{b"length": 5, b"path": [b"CD1", b"a.mp3"]}, {b"length": 7, b"path": [b"b.mp3"]}]}}
    (tmp_path / "many.torrent").write_bytes(bencode(many))
    (tmp_path / "one.torrent").write_bytes(bencode({b"info": {b"name": b"film.mkv", b"length": 9}}))
    (tmp_path / "broken.torrent").write_bytes(b"d4:info")
    with zipfile.ZipFile(tmp_path / "book.cbz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("dir/", "")
        z.writestr("dir/p1.jpg", "x" * 1000)
    for name, mode in (("t.tar", "w"), ("u.tar.gz", "w:gz"), ("v.txz", "w:xz")):
        with tarfile.open(tmp_path / name, mode) as t:
            info = tarfile.TarInfo("x/y.txt")
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "note.txt").write_text("no archive")
    got = {r["name"]: ([tuple(f) for f in r["files"]], r["error"] is None) for r in archives.read_archives(spark, str(tmp_path)).collect()}
    tar = ([("x/y.txt", "y.txt", 3)], True)
    assert got == {"Album": ([("CD1/a.mp3", "a.mp3", 5), ("b.mp3", "b.mp3", 7)], True), "film.mkv": ([("film.mkv", "film.mkv", 9)], True), "broken.torrent": ([], False),
                   "book": ([("dir/p1.jpg", "p1.jpg", 1000)], True), "t": tar, "u": tar, "v": tar}


def test_folder(spark, tmp_path):
    root = tmp_path / "My Show"
    (root / "S01").mkdir(parents=True)
    (root / "S01" / "e1.mkv").write_bytes(b"12345")
    (root / "info.nfo").write_bytes(b"1")
    r = archives.read_folder(spark, str(root)).collect()
    assert [(x["name"], [tuple(f) for f in x["files"]]) for x in r] == [("My Show", [("S01/e1.mkv", "e1.mkv", 5), ("info.nfo", "info.nfo", 1)])]


LINES = ['["Movie.2024.1080p.BluRay.x264", "random"]', "not json", "[]", '["Some.XXX.Thing"]']


def test_lines_as_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(LINES))
    batch = [json.loads(r[0]) for r in classify_lines(spark.read.text(str(tmp_path / "in"))).collect()]
    assert [[x["medium"] for x in line] for line in batch] == [["video", "other"], [], ["other"]]
    assert batch[2][0]["nsfw"] is True
    query = classify_lines(spark.readStream.text(str(tmp_path / "in"))).writeStream.format("memory").queryName("lines_out").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(json.dumps(json.loads(r[0])) for r in spark.sql("SELECT * FROM lines_out").collect()) == sorted(map(json.dumps, batch))
