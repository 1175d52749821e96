"""Scans and sinks on small files."""

import pytest
from pyspark.sql import functions as F

from vocalith.operators.ordering import global_index
from vocalith.sources import scans as S
from vocalith.sources import sinks as K


def test_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿,NHC ID HSP,dx_pilar\nf.wav,7,x\n")
    r = S.scan_labels(spark, str(tmp_path / "a.csv")).first()
    assert tuple(r) == ("f.wav", "7", "x")
    (tmp_path / "b.csv").write_text("ID,Dx\nf,x\n")
    with pytest.raises(ValueError):
        S.scan_labels(spark, str(tmp_path / "b.csv"))


def test_strict_labels(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("a.wav\tx\nb.wav\tz\nc.wav\tx\n")
    index = spark.createDataFrame([("a.wav",), ("b.wav",)], "path string")
    got = {r.path: (r.label, r.problem) for r in S.scan_labels_strict(spark, str(tmp_path / "l.tsv"), {"x": 0}, index).collect()}
    assert got == {"a.wav": (0, None), "b.wav": (None, "unknown class"), "c.wav": (0, "missing path")}


def test_words(spark, tmp_path):
    (tmp_path / "r1.csv").write_text("word,start,end,probability\nhello,0.0,0.5,0.9\nworld,0.6,1.0,\n")
    got = [tuple(r) for r in S.scan_words(spark, str(tmp_path / "r1.csv")).orderBy("word_id").collect()]
    assert got == [("r1", 0, "hello", 0.0, 0.5, 0.9), ("r1", 1, "world", 0.6, 1.0, None)]
    (tmp_path / "bad.csv").write_text("token,start,end\na,1,2\n")
    with pytest.raises(Exception, match="bad word file"):
        S.scan_words(spark, str(tmp_path / "bad.csv")).collect()


def test_file_index(spark, tmp_path):
    for d, n in (("x", "a.wav"), ("y", "a.wav"), ("y", "b.wav")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / n).write_bytes(b"123")
    got = {(r.folder, r.stem): (r.length, r.duplicate) for r in S.scan_file_index(spark, str(tmp_path), "*.wav").collect()}
    assert got == {("x", "a"): (3, True), ("y", "a"): (3, True), ("y", "b"): (3, False)}


def test_run_results(spark, tmp_path):
    (tmp_path / "t1").mkdir()
    (tmp_path / "t1" / "fold.json").write_text('{"trial": 1, "fold": 2,\n "training_macro_f1": 0.9, "metrics": {"macro_f1": 0.5, "accuracy": 0.6}, "predictions": [{"uid": 1, "label": 0, "prediction": 1}]}')
    assert tuple(S.scan_run_results(spark, str(tmp_path)).first()) == (1, 2, 0.9, 0.5, 0.6, 1)


def test_text_tables(spark, tmp_path):
    """Transcripts with line ends and quotes, splits with every fault, segments, noise lists and features."""
    (tmp_path / "t.csv").write_text('uid,transcription,transcription_pause\na,"two\nlines, ""quoted""",x\nb,one,y\nb,other,z\nc,,w\n')
    assert {r.uid: (r.text, r.problem) for r in S.scan_transcripts(spark, str(tmp_path / "t.csv")).collect()} == {"a": ('two\nlines, "quoted"', None), "b": (None, "several rows"), "c": (None, "empty")}
    assert {r.uid: r.text for r in S.scan_transcripts(spark, str(tmp_path / "t.csv"), pauses=True).collect()} == {"a": "x", "b": None, "c": "w"}
    (tmp_path / "s.csv").write_text("split,fold,uid\ntrain,0,a\ntrain,0,a\ntrain,1,\ntrain,7,b\ntest,1,c\n")
    got = {(r.split, r.fold, r.uid): r.problem for r in S.scan_splits(spark, str(tmp_path / "s.csv"), 3).collect()}
    assert got == {("train", 0, "a"): "duplicate", ("train", 1, None): "blank", ("train", 7, "b"): "fold", ("test", 1, "c"): None, (None, 2, None): "missing fold"}
    (tmp_path / "g.csv").write_text("uid,speaker,begin,end\n1,INV,500,1250\n1,PAR,0,400\n")
    assert [tuple(r) for r in S.scan_segments(spark, str(tmp_path / "g.csv")).collect()] == [(1, 0.5, 1.25)]
    (tmp_path / "n.tsv").write_text("a.wav\tmusic\n")
    (tmp_path / "r.tsv").write_text("b.wav\n")
    assert {tuple(r) for r in S.scan_noise_lists(spark, str(tmp_path / "n.tsv"), str(tmp_path / "r.tsv")).collect()} == {("a.wav", "music"), ("b.wav", "rir")}


def test_text_files(spark, tmp_path):
    for n, t in (("a", "one line"), ("b", ""), ("c", "x\ny\n"), ("d", "secret")):
        (tmp_path / f"{n}.txt").write_text(t)
    rec = spark.createDataFrame([(u, "test" if u == "d" else "train") for u in "abcde"], "uid string, partition string")
    got = {r.uid: (r.text, r.problem) for r in S.scan_text_files(spark, f"{tmp_path}/*.txt", rec).collect()}
    assert got == {"a": ("one line", None), "b": ("...", None), "c": (None, "several lines"), "d": ("...", None), "e": ("...", None)}


def test_write_once_refuses(spark, tmp_path):
    df = spark.range(3)
    K.write_once(df, f"{tmp_path}/x")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        K.write_once(df, f"{tmp_path}/x")


def test_versions(spark, tmp_path):
    K.write_atomic(spark.range(3), f"{tmp_path}/v")
    K.write_atomic(spark.range(5), f"{tmp_path}/v")
    assert K.read_current(spark, f"{tmp_path}/v").count() == 5
    assert K.write_atomic(spark.range(2), f"{tmp_path}/v") == 3 and K.read_current(spark, f"{tmp_path}/v").count() == 2


def test_publishing_twice_is_no_conflict(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string")
    inserts, conflicts = K.publish_once(a, a, "k", "t")
    assert inserts.count() == conflicts.count() == 0
    inserts, conflicts = K.publish_once(a, a.where("k = 1").withColumn("t", F.lit("z")), "k", "t")
    assert [r.k for r in inserts.collect()] == [2] and [r.k for r in conflicts.collect()] == [1]


def test_resuming(spark):
    a = K.with_signature(spark.createDataFrame([(1, "x"), (2, "y")], "uid int, t string"), "uid", "t")
    done = a.where("uid = 1").select(F.lit("pool").alias("stage"), "uid", "signature")
    assert [r.uid for r in K.resume_pending(a, done, "pool").collect()] == [2]
    assert K.resume_pending(a, done, "package").count() == 2


@pytest.mark.parametrize("parts", [1, 5])
def test_global_index(spark, parts):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k")).repartition(parts)
    rows = global_index(df, "k").orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(500)) and [r.k for r in rows] == sorted(r.k for r in rows)


def test_leaderboard_parts_and_winner(spark, tmp_path):
    """Parts follow each other by rank; without its manifest, or with other rows, a ranking is refused; the baseline may win if it was run alike."""
    import shutil

    from pyspark.sql import functions as F

    from vocalith.operators.trials import rank_trials, winner_parameters
    from vocalith.sources import sinks

    n = 5000
    summary = spark.range(n).select(F.col("id").alias("trial"), F.lit(5).alias("n_folds"), F.lit(True).alias("complete"), ((F.col("id") * 7919) % n / float(n)).alias("mean"), F.lit(0.1).alias("sd"))
    settings = summary.select(F.col("trial").cast("string").alias("trial"), F.create_map(F.lit("heads"), F.col("trial").cast("string")).alias("parameters")).unionByName(spark.createDataFrame([("baseline", {"heads": "1", "seed": "9"})], "trial string, parameters map<string,string>"))
    base = lambda x: spark.createDataFrame([(x,)], "mean double")
    for mean, matched, winner, parameters in ((0.5, True, None, None), (2.0, True, "baseline", {"seed": "9", "heads": "1"}), (2.0, False, None, None)):
        row = winner_parameters(summary, base(mean), settings, {"seed": "1234"}, matched).first()
        best = str(summary.orderBy(F.desc("mean")).first().trial)
        assert row.winner == (winner or best) and row.parameters == (parameters or {"seed": "1234", "heads": best})
    assert winner_parameters(summary.withColumn("complete", F.col("trial") > 0), base(0.5), settings, {}).count() == 0
    path = str(tmp_path / "board")
    ranked = rank_trials(summary)
    sinks.write_leaderboard(ranked, path, winner_parameters(summary, base(0.5), settings, {}))
    got = sinks.read_leaderboard(spark, path, "trial bigint, rank int, mean double")
    assert sorted(r.rank for r in got.collect()) == list(range(1, n + 1))
    parts = sorted(spark.read.json(f"{path}/manifest").where("format = 'csv'").collect(), key=lambda r: r.part)
    assert all(a.last < b.first for a, b in zip(parts, parts[1:])) and sum(r.rows for r in parts) == n
    spark.createDataFrame([(1, 1, 0.0)], "trial long, rank int, mean double").write.mode("append").json(f"{path}/leaderboard_json")
    with pytest.raises(ValueError, match="parts"):
        sinks.read_leaderboard(spark, path, "trial bigint, rank int, mean double")
    shutil.rmtree(f"{path}/manifest")
    with pytest.raises(Exception, match="manifest"):
        sinks.read_leaderboard(spark, path, "trial bigint, rank int, mean double")
