"""Hash trees of content, and batches that resume."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from vocalith.operators import packages as P
from vocalith.operators.stages import Batch
from vocalith.plans.reports import encode_words
from vocalith.sources import manifests as M


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def contents(spark):
    return spark.range(500).select(F.col("id").alias("k"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("t")).repartition(5)


CHANGED = [(7, "changed"), (11, "missing"), (1000, "unexpected")]


def changed(df):
    extra = df.sparkSession.createDataFrame([(1000, "new")], "k long, t string")
    return df.where("k <> 11").withColumn("t", F.when(F.col("k") == 7, "other").otherwise(F.col("t"))).unionByName(extra)


def test_trees_find_what_differs(spark, contents, tmp_path):
    now, then = f"{tmp_path}/now", f"{tmp_path}/then"
    M.write_manifest(contents, then, "k", "t")
    M.write_manifest(changed(contents), now, "k", "t")
    assert rows_of(M.compare_manifests(spark, now, then, "k")) == CHANGED
    assert rows_of(M.verify_content(changed(contents), then, "k", "t")) == CHANGED
    assert rows_of(M.compare_manifests(spark, then, then, "k")) == [] == rows_of(M.verify_content(contents.repartition(2), then, "k", "t"))
    tree = M.read_tree(spark, then)
    assert tree.where("level = 0").first().n == 500 and tree.where("level = 2").count() <= 256


def test_equal_ranges_are_not_read(spark, contents, tmp_path):
    """Files of leaves without a change are broken on purpose."""
    then = f"{tmp_path}/then"
    M.write_manifest(contents, then, "k", "t")
    touched = {r[0] for r in spark.createDataFrame([(7,), (11,), (1000,)], "k long").select(M.leaf_of(F.col("k"))).collect()}
    broken = 0
    for f in glob.glob(f"{then}/rows/leaf=*/*.parquet"):
        if f.split("leaf=")[1].split("/")[0] not in touched:
            os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
            with open(f, "wb") as out:
                out.write(b"not a table")
            broken += 1
    assert broken > 200
    assert rows_of(M.verify_content(changed(contents), then, "k", "t")) == CHANGED
    new = spark.createDataFrame([(7, "other"), (7, "other"), (11, "text 11"), (1000, "new")], "k long, t string")
    assert rows_of(M.publish_against(new, then, "k", "t")) == [(7, "conflict"), (1000, "insert")]


def test_null_and_empty_contents(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "")], "k long, t string")
    M.write_manifest(df, f"{tmp_path}/m", "k", "t")
    assert rows_of(M.verify_content(df, f"{tmp_path}/m", "k", "t")) == []
    assert rows_of(M.verify_content(df.withColumn("t", F.coalesce("t", F.lit(""))), f"{tmp_path}/m", "k", "t")) == [(1, "changed")]
    assert rows_of(M.verify_content(df.where("1 = 0"), f"{tmp_path}/m", "k", "t")) == [(1, "missing"), (2, "missing")]


# --- batches


@pytest.fixture
def records(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "uid long, source string")


def doubled(calls, problem=None):
    def build(pending):
        calls.append(sorted(r.uid for r in pending.collect()))
        out = pending.select("uid", F.explode(F.array(F.lit(0), F.lit(1))).alias("word_id"), F.concat("source", F.lit("!")).alias("value"))
        return out.withColumn("problem", F.when(F.col("uid") == problem, "bad").cast("string")) if problem else out

    return build


def test_an_interrupted_attempt_stays_and_success_is_reused(spark, records, tmp_path):
    root = str(tmp_path / "batch")

    def fail(pending):
        pending.write.parquet(f"{root}/frames/rows/attempt=partial")
        raise RuntimeError("interrupted")

    with pytest.raises(RuntimeError, match="interrupted"):
        Batch(spark, root).run("frames", records, fail)
    import shutil

    shutil.move(f"{root}/frames/rows/attempt=partial", f"{tmp_path}/seen")  # it was left for inspection
    calls = []
    for k in range(2):
        batch = Batch(spark, root)
        assert batch.run("frames", records, doubled(calls)).count() == 6
        assert (batch.reused["frames"], batch.built["frames"]) == ((0, 3), (3, 0))[k]
    assert calls == [[1, 2, 3]]
    # a changed source is built anew, the others are reused; the old rows stay
    batch = Batch(spark, root)
    out = batch.run("frames", records.withColumn("source", F.when(F.col("uid") == 2, "x").otherwise(F.col("source"))), doubled(calls))
    assert rows_of(out.where("word_id = 0").select("uid", "value")) == [(1, "a!"), (2, "x!"), (3, "c!")]
    assert calls == [[1, 2, 3], [2]] and batch.manifest("frames").count() == 4
    # and so are all of them under other settings
    Batch(spark, root).run("frames", records, doubled(calls), {"width": 2})
    assert calls[-1] == [1, 2, 3]


def test_a_modified_stage_is_refused(spark, records, tmp_path):
    root = str(tmp_path / "batch")
    Batch(spark, root).run("ctc", records, doubled([]))
    folder = glob.glob(f"{root}/ctc/rows/attempt=*")[0]
    rows = spark.createDataFrame(spark.read.parquet(folder).withColumn("value", F.when(F.col("uid") == 3, "forged").otherwise(F.col("value"))).collect(), "uid long, word_id int, value string, problem string")
    rows.write.mode("overwrite").parquet(folder)
    with pytest.raises(ValueError, match="ctc was modified: recording 3"):
        Batch(spark, root).run("ctc", records, doubled([]))


def test_a_failed_record_is_reported_and_never_ready(spark, records, tmp_path):
    batch = Batch(spark, str(tmp_path / "batch"))
    calls = []
    batch.run("frames", records, doubled(calls, problem=2))
    batch.run("package", records, doubled(calls), after=("frames",))
    assert calls == [[1, 2, 3], [1, 3]]
    assert rows_of(batch.failed) == [("frames", 2, "bad")]
    assert tuple(batch.readiness(records, "package").first()) == (3, 2, 1, 0, False)
    # the next batch tries it again
    again = Batch(spark, str(tmp_path / "batch"))
    again.run("frames", records, doubled(calls))
    again.run("package", records, doubled(calls), after=("frames",))
    assert calls[2:] == [[2], [2]] and tuple(again.readiness(records, "package").first()) == (3, 3, 0, 0, True)


def test_a_record_without_rows_fails(spark, records, tmp_path):
    batch = Batch(spark, str(tmp_path / "batch"))
    batch.run("frames", records, lambda p: p.where("uid <> 1").select("uid", F.lit(1).alias("x")))
    assert rows_of(batch.failed) == [("frames", 1, "no rows")]


def sides(spark, uid=1, audio=((1.0,), (2.0,), (0.0,)), valid=(True, True, False), text=((5.0,), (6.0,), (7.0,)), text_valid=(True, True, True), ids=(0, 1, 2), paired=None):
    a = spark.createDataFrame([(uid, i, list(v), ok) for i, (v, ok) in enumerate(zip(audio, valid))], "uid long, word_id int, vec array<double>, valid boolean")
    rows = [(uid, i, list(v), ok) + ((p,) if paired else ()) for i, v, ok, p in zip(ids, text, text_valid, paired or (None,) * 3)]
    return a, spark.createDataFrame(rows, "uid long, word_id int, vec array<double>, valid boolean" + (", paired boolean" if paired else ""))


def test_packages(spark):
    rows = P.package_rows(*sides(spark, paired=(True, True, False)))
    assert rows_of(rows.select("word_id", "valid", "status", "problem")) == [(0, True, "paired", None), (1, True, "paired", None), (2, False, "no_interval", None)]
    row = P.package_summary(rows).first()
    assert (row.words, row.paired, row.no_interval, row.no_text_tokens, row.problem) == (3, 2, 1, 0, None)
    other = P.package_summary(P.package_rows(*sides(spark, text=((5.0,), (6.5,), (7.0,))))).first()
    assert other.audio_hash == row.audio_hash and other.text_hash != row.text_hash


@pytest.mark.parametrize(
    "change,problem",
    [
        ({"ids": (1, 0, 3)}, "word ids"), ({"text": ((5.0,), (float("nan"),), (7.0,))}, "text vectors"), ({"audio": ((float("inf"),), (2.0,), (0.0,))}, "audio vectors"),
        ({"audio": ((1.0,), (2.0,), (3.0,))}, "placeholder"), ({"paired": (True, True, True)}, "paired mask"), ({"valid": (False,) * 3, "audio": ((0.0,),) * 3}, "no valid pair"),
    ],
)
def test_bad_packages(spark, change, problem):
    assert {r.problem for r in P.package_rows(*sides(spark, **change)).collect()} == {problem}


def test_text_is_encoded_anew_on_stored_audio(spark, records, tmp_path):
    """Only text and package run again; changed acoustic rows are refused, other acoustic settings are built anew."""
    words = records.select("uid", F.explode(F.array(F.lit(0), F.lit(1))).alias("word_id"))
    ran = []

    def side(name, value):
        def of(some):
            ran.append(name)
            return some.select("uid", "word_id", F.array(F.lit(value)).alias("vec"), F.lit(True).alias("valid"))

        return of

    def go(text, audio=1.0):
        ran.clear()
        batch = Batch(spark, str(tmp_path / "batch"))
        rows = encode_words(batch, records, words, side("audio", audio), side("text", text), {"audio": {"model": audio}, "text": {"model": text}})
        return batch, rows_of(rows.select("uid", "word_id", F.col("audio")[0], F.col("text")[0])), list(ran)

    batch, rows, stages = go(2.0)
    assert stages == ["audio", "text"] and rows[0] == (1, 0, 1.0, 2.0) and batch.readiness(records, "package").first().ready
    assert go(2.0)[2] == []
    batch, rows, stages = go(3.0)
    assert stages == ["text"] and {r[2:] for r in rows} == {(1.0, 3.0)} and batch.reused["audio"] == 3
    assert go(3.0, 4.0)[2] == ["audio"]
    folder = min(glob.glob(f"{tmp_path}/batch/audio/rows/attempt=*"), key=os.path.getmtime)
    spark.createDataFrame(spark.read.parquet(folder).withColumn("vec", F.array(F.lit(9.0))).collect(), "uid long, word_id int, vec array<double>, valid boolean, problem string").write.mode("overwrite").parquet(folder)
    with pytest.raises(ValueError, match="audio was modified"):
        go(5.0)


def test_contents_are_not_sorted(spark):
    """Contents are added up by hash, in longs."""
    import io
    from contextlib import redirect_stdout

    from vocalith.operators.stages import recording_contents

    rows = spark.range(100).selectExpr("id % 7 AS uid", "id AS word_id", "array(id / 3) AS vec", "cast(NULL AS string) AS problem")
    text = io.StringIO()
    with redirect_stdout(text):
        recording_contents(rows).explain()
    assert "HashAggregate" in text.getvalue() and "decimal(38,0)" not in text.getvalue() and "Sort" not in text.getvalue()


def test_digests_of_large_numbers(spark):
    """The halves of the sums come together as the whole numbers do."""
    import hashlib

    lines = [f"line {k}" for k in range(300)] * 3
    word = lambda at: sum(int(hashlib.md5(x.encode()).hexdigest()[at : at + 15], 16) for x in lines)
    want = hashlib.sha256(f"{len(lines)}:{word(0)}:{word(15)}".encode()).hexdigest()
    assert spark.createDataFrame([(x,) for x in lines], "x string").agg(M.multiset_digest(F.col("x"))).first()[0] == want


def test_a_package_is_joined_once(spark):
    """A recording's problem comes by a window over the joined rows; they are not joined a second time."""
    import io
    from contextlib import redirect_stdout

    text = io.StringIO()
    with redirect_stdout(text):
        P.package_rows(*sides(spark)).explain()
    assert text.getvalue().count("Join") == 1 and "Window" in text.getvalue()
