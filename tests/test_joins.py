"""Joins of rows that are made from texts, intervals or frames are shuffled: a planner that goes by the size of the file would broadcast all of them."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from vocalith.operators import transcripts as R
from vocalith.plans.registry import all_queries
from vocalith.sources import scans as S
from vocalith.sources import sinks as K

#: Fixed value: the queries whose plans are looked at; the tables are so small here that each was broadcast.
DERIVED = ["unit_sync", "positional_join", "paired_mask", "shuffle_within", "audit_records"]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_path_score_has_no_join(spark, sf_dir):
    """Frames are counted where their scores are added up; they are made by recording and not moved again."""
    text = plan(all_queries()["path_score"](spark, sf_dir))
    assert "Join" not in text


def test_frames_are_not_broadcast(spark, sf_dir):
    text = plan(all_queries()["frames_in_interval"](spark, sf_dir))
    assert "SortMergeJoin" in text


def test_minimum_frames_by_word(spark):
    """Equal neighbours within words, a delimiter within a word, and a recording without units."""
    w = spark.createDataFrame([(1, 0, "aab"), (1, 1, "b|"), (1, 2, "-"), (1, 3, "cc"), (2, 0, "||"), (3, 0, "-")], "uid long, word_id int, word string")
    form = F.regexp_replace("word", "-", "")
    by_word = sorted(map(tuple, R.minimum_frames_of(w, form).collect()))
    assert by_word == sorted(map(tuple, R.minimum_frames(R.ctc_units(w, form)).collect())) == [(1, 9, 12), (2, 2, 3)]
    text = plan(all_queries()["minimum_frames"](spark, "/root/testdata/sf0.001"))
    assert text.count("Generate posexplode") == 1


def test_folders_are_written_by_tasks(spark, tmp_path):
    """As many folders as rows: the rows are dealt to all cores, whatever the number of shuffle partitions, and read back by one listing of the root."""
    rows = spark.range(64).select(F.col("id").alias("uid"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    K.write_text_per_record(rows, f"{tmp_path}/texts")
    assert len(list((tmp_path / "texts").glob("*/*.txt"))) == 64 and (tmp_path / "texts" / "_SUCCESS").exists()
    assert not list((tmp_path / "texts").glob("*/.*"))  # no checksum files, and nothing left under a name for the time being
    with pytest.raises(ValueError):
        K.write_text_per_record(rows, f"{tmp_path}/texts")
    recordings = rows.select(F.col("uid").cast("string").alias("uid"), F.lit("train").alias("partition"))
    got = {r.uid: (r.text, r.problem) for r in S.scan_text_files(spark, f"{tmp_path}/texts", recordings, uid_pattern=r"uid=([^/]*)/").collect()}
    assert got == {str(k): (f"text {k}", None) for k in range(64)}


def test_folders_are_those_of_the_writer(spark, tmp_path):
    """Odd values of the key, lines of one key together, and an empty table."""
    rows = spark.createDataFrame([("a/b:c", "x"), ("a/b:c", "y"), (None, "z"), ("", "w"), ("100% é[1]", None), ("k=v", "two\nlines")], "uid string, text string")
    K.write_text_per_record(rows, f"file://{tmp_path}/ours")
    rows.repartition("uid").write.partitionBy("uid").text(f"{tmp_path}/theirs")
    read = lambda name: {p.name: sorted("".join(f.read_text() for f in p.glob("*.txt")).split("\n")) for p in (tmp_path / name).iterdir() if p.is_dir()}
    assert read("ours") == read("theirs")
    K.write_text_per_record(rows.limit(0), f"{tmp_path}/none")
    assert [p.name for p in (tmp_path / "none").iterdir()] == ["_SUCCESS"]


@pytest.mark.parametrize("name", DERIVED)
def test_derived_rows_are_not_broadcast(spark, sf_dir, name):
    text = plan(all_queries()[name](spark, sf_dir))
    assert "SortMergeJoin" in text and "Broadcast" not in text
