"""Folders of many small files are listed and read by tasks, with the rows that Spark's own readers give."""

import gzip

import pytest
from pyspark.sql import functions as F

from vocalith.sources import folders, scans


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    """Folders in three levels, with odd names and texts, files without bytes, and files and folders that Spark passes over."""
    root = tmp_path_factory.mktemp("tree")
    texts = {"plain": b"a\nb\n", "open": b"a\nb", "dos": b"a\r\n\r\nb\r\n", "mac": b"a\rb\r", "none": b"", "blank": b"\n", "bom": b"\xef\xbb\xbfword\nx\n", "broken": b"a\xff\nb\n", "long": b"".join(b"line %d\n" % k * (1 + (k % 5 == 0)) + b"\n" * (k % 7 == 0) for k in range(400)), "wide": b"x" * 900 + b"\n" + b"y" * 900}
    for k in range(120):
        folder = root / ("left" if k % 2 else "right") / f"uid=é {k}%41[1]"
        folder.mkdir(parents=True)
        name = list(texts)[k % len(texts)]
        (folder / f"{name}.txt").write_bytes(texts[name])
    (root / "top.txt").write_bytes(b"top\n")
    (root / "_SUCCESS").write_bytes(b"no\n")
    (root / "left" / ".hidden").write_bytes(b"no\n")
    (root / "_gone").mkdir()
    (root / "_gone" / "x.txt").write_bytes(b"no\n")
    (root / "right" / "b.csv").write_bytes(b"123")
    return root


def spark_lines(spark, path):
    rows = scans.below(spark, str(path)).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "").alias("file"), "value")
    return sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("block", [100, folders.BLOCK])
def test_lines_are_those_of_the_text_reader(spark, tree, block):
    got = folders.lines_below(spark, str(tree), block)
    assert all(f.endswith(".parquet") for f in got.inputFiles())
    rows = got.withColumn("file", F.regexp_replace("file", "^file:/*", "")).collect()
    assert sorted((r.file, r.value) for r in rows) == spark_lines(spark, tree)
    by = {}
    for r in sorted(rows, key=lambda r: (r.file, r.place)):
        by.setdefault(r.file, []).append(r)
    for lines in by.values():
        assert [r.place for r in lines] == list(range(len(lines)))
        assert [r.before for r in lines] == [sum(x.value != "" for x in lines[:k]) for k in range(len(lines))]
    assert [r.value for r in next(v for k, v in by.items() if k.endswith("wide.txt"))] == ["x" * 900, "y" * 900]


def test_index_is_that_of_the_binary_reader(spark, tree):
    for glob in ("*", "*.txt", "b.c?v"):
        want = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(str(tree)).select("path", "length")
        got = scans.scan_file_index(spark, str(tree), glob)
        assert sorted(map(tuple, got.select("path", "length").collect())) == sorted(map(tuple, want.collect()))
        assert all(f.endswith(".parquet") for f in got.inputFiles())  # the driver knows the listings, not the files


def test_what_only_spark_can_read(spark, tmp_path):
    """Patterns, single files and packed files go by Spark's readers."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("word,start,end\nx,0.0,0.5\n")
    assert folders.files_below(spark, f"{tmp_path}/in/*.csv") is None and folders.files_below(spark, f"{tmp_path}/in/a.csv") is None
    assert folders.files_below(spark, f"{tmp_path}/in", "{a,b}.csv") is None and folders.files_below(spark, "nosuch://there/in") is None
    (tmp_path / "in" / "b.csv.gz").write_bytes(gzip.compress(b"word,start,end\ny,0.5,0.7\n"))
    assert folders.lines_below(spark, f"{tmp_path}/in") is None
    assert sorted((r.word_id, r.word) for r in scans.scan_words(spark, f"{tmp_path}/in").collect()) == [(0, "x"), (0, "y")]
    (tmp_path / "empty").mkdir()
    assert scans.scan_file_index(spark, f"{tmp_path}/empty").collect() == []
