"""Folders of very many small files, listed and read by tasks through Arrow's file systems: Spark's own readers have the driver hold every file's name and a task for some 30 of them."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.operators.ordering import carried_scan
from vocalith.sources.storage import shared_path

#: Rows of a batch that a task hands on.
ROWS = 10_000
#: A file is read in blocks of at most so many bytes, whole lines each.
BLOCK = 16 << 20
#: Fixed value: endings of files that Spark's text reader unpacks.
PACKED = r"(?i)\.(gz|bz2|lz4|zst|snappy|deflate|xz)$"


def opened(path: str) -> tuple[fs.FileSystem, str, str] | None:
    """(file system, root, what goes before paths) of a folder that Arrow can list; None for others, and for single files and patterns."""
    if re.search(r"[*?\[{\\,]", path):
        return None
    try:
        files, root = fs.FileSystem.from_uri(path)
        if files.get_file_info(root).type != fs.FileType.Directory:
            return None
    except (pa.ArrowException, ValueError, OSError):
        return None
    return files, root, "file:" if isinstance(files, fs.LocalFileSystem) else path[: path.index("://") + 3]


def _entries(files: fs.FileSystem, folder: str) -> Iterator[tuple[str, str, int | None]]:
    """(path, name, length; None for a folder) of what Spark's readers see in a folder."""
    hidden = lambda n: n.startswith(".") or (n.startswith("_") and "=" not in n) or n.endswith("._COPYING_")
    if isinstance(files, fs.LocalFileSystem):  # entries come one by one, of a folder of any size
        with os.scandir(folder) as found:
            for e in found:
                if not hidden(e.name):
                    yield e.path, e.name, None if e.is_dir() else e.stat().st_size
    else:
        for i in files.get_file_info(fs.FileSelector(folder)):
            if not hidden(i.base_name):
                yield i.path, i.base_name, None if i.type == fs.FileType.Directory else i.size


def files_below(spark: SparkSession, path: str, glob: str = "*") -> DataFrame | None:
    """(path, length) of the files below a folder whose names fit a pattern of * and ?; None where only Spark can list it.

    Levels are listed one after another until there are folders for all tasks, which then go down to the end. Listings are written; of folders only the number comes to the driver.
    """
    place = opened(path)
    if place is None or re.search(r"[\[{\\]", glob):
        return None
    _, root, _ = place
    fits = re.compile(fnmatch.translate(glob))

    def listing(deep: bool):
        def listed(batches):
            files, _ = fs.FileSystem.from_uri(path)
            paths, lengths = [], []
            for batch in batches:
                for folder in batch.column("path").to_pylist():
                    waiting = [folder]
                    while waiting:
                        for at, name, length in _entries(files, waiting.pop()):
                            if length is None and deep:
                                waiting.append(at)
                            elif length is None or fits.match(name):
                                paths.append(at)
                                lengths.append(length)
                            if len(paths) == ROWS:
                                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["path", "length"])
                                paths, lengths = [], []
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["path", "length"])

        return listed

    stored, schema = shared_path(spark, "listing"), "path string, length long"
    tasks = 4 * spark.sparkContext.defaultParallelism
    level, k = spark.range(1).select(F.lit(root).alias("path")), 0
    while True:
        level.mapInArrow(listing(False), schema).write.parquet(f"{stored}/level={k}")
        level = spark.read.schema(schema).parquet(f"{stored}/level={k}").where("length IS NULL").select("path")
        n, k = level.count(), k + 1
        level = level.repartition(min(n, tasks) or 1)
        if n == 0:
            break
        if n >= tasks:
            level.mapInArrow(listing(True), schema).write.parquet(f"{stored}/level={k}")
            break
    return spark.read.schema(schema).parquet(*[f"{stored}/level={i}" for i in range(k + (n > 0))]).where("length IS NOT NULL")


def _url(path: str) -> str:
    return re.sub(r'[\x00-\x20\x7f"#%<>?\[\\\]^`{|}]', lambda m: f"%{ord(m[0]):02X}", path)


def _lines(f: pa.NativeFile, start: int, stop: int) -> list[str]:
    """The lines that begin in [start, stop). Lines end like those of Spark's text reader; blocks are parted at line feeds."""
    f.seek(max(start - 1, 0))
    data = f.read(stop - max(start - 1, 0))
    if start:
        data = data[cut + 1 :] if (cut := data.find(b"\n")) >= 0 else b""
    elif data.startswith(b"\xef\xbb\xbf"):
        data = data[3:]
    parts = [data]
    while parts[-1] and not parts[-1].endswith(b"\n"):
        more = f.read(1 << 20)
        cut = more.find(b"\n")
        parts.append(more if cut < 0 else more[: cut + 1])
    lines = re.split("\r\n|\n|\r", b"".join(parts).decode("utf-8", "replace"))
    return lines if lines[-1] else lines[:-1]


def lines_below(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame | None:
    """(file, place, before, value) of the lines of the text files below a folder, see `scans.numbered_lines`; None where only Spark can read it.

    A task numbers the lines of a block. Files of one block are done then; what earlier blocks of longer files hold is carried over.
    """
    files = files_below(spark, path)
    if files is None or not files.where(F.col("path").rlike(PACKED)).isEmpty():
        return None
    _, _, prefix = opened(path)
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long")))
    tasks = 16 * spark.sparkContext.defaultParallelism
    blocks = files.where("length > 0").select("path", "length", start.alias("start")).repartition(tasks, "path", "start")
    names = ["file", "block", "blocks", "place", "before", "value"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def read(batches):
        files, _ = fs.FileSystem.from_uri(path)
        columns = [[] for _ in names]
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
        for batch in batches:
            for at, length, start in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start"))):
                with files.open_input_file(at) as f:
                    lines = _lines(f, start, min(length, start + block))
                name, before = ("file://" if prefix == "file:" else prefix) + _url(at), 0
                for place, line in enumerate(lines):
                    for c, v in zip(columns, (name, start // block, -(-length // block), place, before, line)):
                        c.append(v)
                    before += line != ""
                    if len(columns[0]) == ROWS:
                        yield rows()
                        columns = [[] for _ in names]
        yield rows()

    stored = shared_path(spark, "lines")
    schema = "file string, block long, blocks long, place long, before long, value string"
    blocks.mapInArrow(read, schema).write.parquet(stored)
    lines = spark.read.schema(schema).parquet(stored)
    long = carried_scan(lines.where("blocks > 1").drop("before").withColumnRenamed("place", "at"), ["file"], "block", [F.col("at")], {"place": ("count", F.lit(1)), "before": ("sum", (F.col("value") != "").cast("int"))})
    kept = ["file", "place", "before", "value"]
    return lines.where("blocks = 1").select(kept).unionByName(long.select(kept))
