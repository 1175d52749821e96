"""Running values of long keys, spread over tasks, against windows of one task; word files read in blocks."""

import random

import pytest
from pyspark.sql import functions as F
from test_files import S

from vocalith.operators import intervals as I
from vocalith.operators import journal as J
from vocalith.operators import transcripts as R
from vocalith.operators.ordering import spread_scan


def rows_of(df, *cols):
    return sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))


@pytest.fixture(scope="module")
def hot(spark):
    """A recording with most rows, some short ones, and rows without a recording."""
    rng = random.Random(3)
    uids = [1] * 3000 + [2] * 40 + [3] + [None] * 60
    rows, at = [], {}
    for u in uids:
        k = at[u] = at.get(u, -1) + 1
        start = k * 100 + rng.randrange(50) if rng.random() > 0.05 else None
        rows.append((u, k, rng.choice(["a", "bb", "", "ccc"]), start, None if start is None or rng.random() < 0.05 else start + rng.randrange(90), rng.choice([0.1, 0.5, 0.9, None, float("nan")]), rng.random() < 0.8, rng.choice(["x", "x", "y", "_", None])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "uid long, word_id int, word string, start_ms long, end_ms long, metric double, eligible boolean, label string").repartition(6).cache()


def test_the_long_key_is_spread(spark, hot, monkeypatch):
    parts = hot.repartitionByRange(8, "uid", "word_id").where("uid = 1").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 3 and max(r["count"] for r in parts) < 1500


@pytest.mark.parametrize("job,cols", [(R.char_offsets, ("char_start", "char_end")), (R.pause_gaps, ("gap_ms",))])
def test_words(hot, job, cols):
    assert rows_of(job(hot, spread=True), "uid", "word_id", *cols) == rows_of(job(hot), "uid", "word_id", *cols)


def test_journal(hot):
    log = hot.withColumnsRenamed({"uid": "run", "word_id": "step"})
    cols = "run", "step", "previous_best", "saved", "reason"
    assert rows_of(J.running_best(log, spread=True), *cols) == rows_of(J.running_best(log), *cols)


def test_runs_of_labels(hot):
    args = "uid", "word_id", "label", "metric", "_"
    cols = "uid", "label", "start", "end"
    assert rows_of(I.collapse_runs(hot.where("uid IS NOT NULL"), *args, spread=True), *cols) == rows_of(I.collapse_runs(hot.where("uid IS NOT NULL"), *args), *cols)


def test_kinds(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, None), (1, 2, 3)], "k int, o int, x int")
    out = spread_scan(df, ["k"], [F.col("o")], {"n": ("count", F.lit(1)), "s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("x"))})
    assert [tuple(r) for r in out.select("n", "s", "m", "l").orderBy("o").collect()] == [(0, 0, None, None), (1, 5, 5, 5), (2, 5, 5, 5)]
    with pytest.raises(ValueError, match="unknown"):
        spread_scan(df, ["k"], [F.col("o")], {"n": ("first", F.col("x"))})


def test_word_files_in_blocks(spark, tmp_path):
    """A file of many blocks gives the ids of its rows; blank lines have none; a file without header or rows fails."""
    lines = [f"w{k},{k}.0,{k}.5,0.5" + ("\n" if k % 50 == 7 else "") for k in range(4000)]
    (tmp_path / "long.csv").write_text("word,start,end,probability\r\n" + "\n".join(lines))
    (tmp_path / "short.csv").write_text("word,start,end\nhello,0.0,0.5\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted((r.uid, r.word_id, r.word) for r in S.scan_words(spark, f"{tmp_path}/*.csv").collect())
        blocks = spark.read.text(f"{tmp_path}/long.csv").select("_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert blocks > 10 and got == [("long", k, f"w{k}") for k in range(4000)] + [("short", 0, "hello")]
    for text in ("word,start,end\n", "token,start\n", "\nword,start,end\na,1,2\n"):
        (tmp_path / "odd.csv").write_text(text)
        with pytest.raises(Exception, match="bad word file odd"):
            S.scan_words(spark, f"{tmp_path}/odd.csv").collect()
