"""Worked examples of single operators."""

import hashlib
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vocalith.functions import text as T
from vocalith.functions import timing as M
from vocalith.functions.sql_names import register_all
from vocalith.operators import cohort as C
from vocalith.operators import fitting
from vocalith.operators import generate as G
from vocalith.operators import intervals as I
from vocalith.operators import journal as J
from vocalith.operators import metrics as S
from vocalith.operators import sequential as Q
from vocalith.operators import transcripts as R
from vocalith.operators import trials as TR
from vocalith.operators import vectors as V


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def words(spark, texts, uid="r"):
    return spark.createDataFrame([(uid, i, t) for i, t in enumerate(texts)], "uid string, word_id int, word string")


LETTERS = [*"abcdefghijklmnopqrstuvwxyz", "á", "ñ", "ü"]


def test_units_of_words(spark):
    """Case, marks on their own, and a word of punctuation alone."""
    w = words(spark, ["(MAÑANA)", "razo\u0301n", "-,-", "vergu\u0308enza;"])
    formed = w.withColumn("form", T.ctc_form("word"))
    assert [r.form for r in formed.orderBy("word_id").collect()] == ["mañana", "razón", "", "vergüenza"]
    u = rows(R.ctc_units(formed, F.col("form")), "target_index")
    assert "".join(t for _, _, t, _ in u) == "mañana|razón|vergüenza"
    assert {o for *_, o in u} == {-1, 0, 1, 3}


@pytest.mark.parametrize("word,bad", [("ab7", "7"), ("x=y", "="), ("año\u2192", "\u2192"), ("un\tlado", "space"), ("bø", "ø"), ("güera", None), ("abα", "α")])
def test_unsupported(spark, word, bad):
    assert one(spark, T.unsupported_chars(F.lit(word), LETTERS)) == bad


def test_a_vocabulary_of_more_than_letters(spark):
    """What is no letter stays unsupported, though the vocabulary has it."""
    assert one(spark, T.unsupported_chars(F.lit("a9"), [*LETTERS, "9"])) == "9"


def test_skip_unsupported(spark):
    w = words(spark, ["luz", "4x", "so\u0301lo", "_", "ü", "b\u0424c"])
    s = R.skip_unsupported(w, [*LETTERS, "ó"])
    assert [(r.word_id, r.reason) for r in s.where("reason IS NOT NULL").orderBy("word_id").collect()] == [(1, "4"), (5, "\u0444")]
    u = rows(R.ctc_units(s, F.col("form")), "target_index")
    assert [o for *_, o in u] == [0, 0, 0, -1, 2, 2, 2, 2, -1, 4]


def test_word_windows(spark):
    spans = spark.createDataFrame([("r", 0, 1, 2), ("r", 0, 3, 4), ("r", 2, 7, 8)], "uid string, word_id int, start_frame int, end_frame int")
    counts = spark.createDataFrame([("r", 9)], "uid string, frame_count int")
    w = words(spark, ["¡AA!", "...", "ñ"])
    assert [(r.start_frame, r.end_frame, r.status) for r in I.word_windows(spans, w, counts).orderBy("word_id").collect()] == [(1, 4, "aligned"), (None, None, "no_ctc_units"), (7, 8, "aligned")]
    for margin, want in ((2, [(0, 6), (None, None), (5, 9)]), (100, [(0, 9), (None, None), (0, 9)])):
        assert [(r.exp_start_frame, r.exp_end_frame) for r in I.word_windows(spans, w, counts, margin).orderBy("word_id").collect()] == want


def test_collapse_runs(spark):
    path = spark.createDataFrame([("r", i, v, -0.25) for i, v in enumerate([2, 2, 9, 2, 5, 5, 5, 9, 9, 7])], "uid string, frame int, label int, score double")
    got = rows(I.collapse_runs(path, "uid", "frame", "label", "score", 9).select("start", "end", "label"), "start")
    assert got == [(0, 2, 2), (3, 4, 2), (4, 7, 5), (9, 10, 7)]


def test_boundary_delta(spark):
    rows_ = [("r", 0, 0, 500, 100, 600), ("r", 1, 600, 700, None, None), ("r", 2, 1000, 1400, 700, 1400)]
    d = spark.createDataFrame(rows_, "uid string, word_id int, start_ms int, end_ms int, other_start int, other_end int")
    s = I.disagreement_summary(I.boundary_delta(d)).first()
    assert (s.compared, s.without_interval, s.flagged_ids, s.mean_start) == (2, 1, [2], 0.2)
    assert I.boundary_delta(d, 300).where("flagged").count() == 0
    assert I.boundary_delta(d, 0).where("flagged").count() == 2
    none = I.disagreement_summary(I.boundary_delta(d.where("word_id = 1"))).first()
    assert (none.compared, none.mean_start, none.flagged_ids) == (0, None, [])


def test_frame_mapping(spark):
    """Frames 30 ms apart on grids of 150 ms and 60 ms, with centres 10 ms after a frame's start; 24, 5 and 12 frames."""
    fine, wide, pair = M.Grid(30.0, 20.0, 10.0, 24), M.Grid(150.0, 20.0, 10.0, 5), M.Grid(60.0, 20.0, 10.0, 12)
    # frame 2 covers 60..80 ms: between the centres at 10 and 160; its middle, 70, is nearer to the first
    assert tuple(one(spark, M.map_frame_window(2, 3, fine, wide))) == (0, 1, "nearest_center_fallback")
    # frames 9 and 10 cover 270..320 ms, in which the centre at 310 lies
    assert tuple(one(spark, M.map_frame_window(9, 11, fine, wide))) == (2, 3, "frame_centers_in_interval")
    # frames 6 to 9 cover 180..290 ms: centres at 190 and 250
    assert tuple(one(spark, M.map_frame_window(6, 10, fine, pair))) == (3, 5, "frame_centers_in_interval")
    assert tuple(one(spark, M.map_frame_window(6, 10, fine, fine))) == (6, 10, "identical_grid")
    assert one(spark, M.map_frame_window(23, 25, fine, wide)) is None


def test_frame_timing(spark):
    assert tuple(one(spark, M.frame_timing([10, 3, 3, 3, 3, 2, 2], [5, 2, 2, 2, 2, 2, 2], 640_000))) == (320, 400, 1999)


def test_interval_pool(spark):
    frames = spark.createDataFrame([("r", i, [2.0 * i, 2.0 * i + 1]) for i in range(20)], "uid string, frame long, vec array<double>")
    w = spark.createDataFrame([("r", 0, 100, 300), ("r", 1, None, None), ("r", 2, 500, 700)], "uid string, word_id int, start_ms int, end_ms int")
    grid = M.Grid(100.0, 100.0, 50.0, 20)
    got = rows(I.interval_mean_pool(w, frames, grid, 2), "word_id")
    assert [(r[1], r[2], r[4]) for r in got] == [(0, [3.0, 4.0], True), (1, [0.0, 0.0], False), (2, [11.0, 12.0], True)]
    empty = w.withColumn("end_ms", F.col("start_ms"))
    assert not any(r[4] for r in rows(I.interval_mean_pool(empty, frames, grid, 2, "inclusive")))


def test_apply_per_recording_in_batches(spark):
    """Recordings that end in a batch, go over several, or have null keys and values come whole and with the same types as one by one."""
    big = 2**53 + 1
    data = [("a", i, big) for i in range(25)] + [("b", 0, None)] + [(None, i, big) for i in range(3)] + [(f"r{i}", i, big + i) for i in range(30)] + [("z", i, None if i == 13 else i) for i in range(20)]
    df = spark.createDataFrame(data, "uid string, n int, v long").repartition(3)

    def summed(frame):
        return pd.DataFrame({"uid": frame["uid"].iloc[:1], "rows": [len(frame)], "v": [frame["v"].max()], "kind": [str(frame["v"].dtype)]})

    name, schema = "spark.sql.execution.arrow.maxRecordsPerBatch", "uid string, rows long, v long, kind string"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "8")
        made = fitting.apply_per_recording(df, summed, schema)
        got = sorted(map(str, made.collect()))
    finally:
        spark.conf.set(name, before)
    assert got == sorted(map(str, df.groupBy("uid").applyInPandas(summed, schema).collect()))
    assert "InPandas" not in made._jdf.queryExecution().executedPlan().toString()
    assert fitting.apply_per_recording(df.where("false"), summed, schema).count() == 0
    arrays = df.withColumn("v", F.array("v"))
    assert fitting.apply_per_recording(arrays, lambda f: f[["uid"]], "uid string").count() == df.count()


def test_punctuation_gap(spark):
    t = spark.createDataFrame([("r", 0, "Hello", 0, 100), ("r", 1, ",", None, None), ("r", 2, "world", 200, 400), ("r", 3, ".", None, None)], "uid string, word_id int, word string, start_ms int, end_ms int")
    got = rows(R.punctuation_gap(t, F.col("word").rlike("[a-z]"), F.lit(500)), "word_id")
    assert [r[2:] for r in got] == [(0, 100), (100, 200), (200, 400), (400, 500)]


def test_match_words(spark):
    t = spark.createDataFrame([("r", "Hello , world.")], "uid string, text string")
    assert [r[1:] for r in rows(Q.match_words(t, words(spark, ["hello", "world"])), "word_id")] == [(0, 1, True, False), (1, 9, False, False)]
    got = rows(Q.match_words(t, words(spark, ["world", "moon"])), "word_id")
    assert got[0][4] and got[1][2] == 0


def test_word_chunks(spark):
    w = words(spark, ["aaaa", "bbb", "cccc", "d", "eeeeeeeeee"]).withColumn("cost", F.length("word"))
    assert [r[2] for r in rows(Q.word_chunks(w, "cost", 8), "word_id")] == [0, 0, 1, 1, None]


def test_pause_rules(spark):
    assert [one(spark, T.pause_symbol(F.lit(g))) for g in (0.4, 0.5, 0.99, 1.0, 1.5, 1.6)] == ["", ",", ",", ".", ".", "..."]
    assert [one(spark, T.pause_symbol_v0(F.lit(g))) for g in (0.5, 0.6, 1.0, 1.1, 2.0, 2.1)] == ["", ",", ",", ".", ".", "..."]


def test_nfc(spark):
    texts = ["abc", "é", None, "ñ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.x for r in df.select("i", T.nfc("t").alias("x")).orderBy("i").collect()] == [t and unicodedata.normalize("NFC", t) for t in texts]


def preds(spark, truth, guess, groups=None):
    data = [(i, (groups or list(range(len(truth))))[i], t, p, i % 2) for i, (t, p) in enumerate(zip(truth, guess))]
    return spark.createDataFrame(data, "uid int, group_id int, label int, prediction int, fold int")


def test_macro_f1_and_accuracy(spark):
    p = preds(spark, [0, 0, 1, 1], [1, 1, 1, 1])
    assert S.macro_f1(p, 2).first()[0] == round(1 / 3, 6)
    assert S.accuracy(p).first()[0] == 0.5
    assert S.macro_f1(p.unionByName(preds(spark, [-1], [0])), 2).first()[0] == round(1 / 3, 6)


def macro(pairs, classes):
    scores = []
    for c in range(classes):
        n = sum(t == c for t, _ in pairs) + sum(p == c for _, p in pairs)
        scores.append(2 * sum(t == p == c for t, p in pairs) / n if n else 0)
    return sum(scores) / classes


def test_bootstrap_is_a_direct_computation(spark):
    truth, guess = [0, 0, 1, 2], [0, 1, 1, 1]
    p = preds(spark, truth, guess, [1, 1, 2, 2])
    units = S.resampling_units(p, 3, "uid")
    drawn = {}
    for r in S.bootstrap_draws(units, 20).collect():
        drawn.setdefault(r.replicate, []).append(r["index"])
    for r in S.group_replicates(units, 3, 20).collect():
        assert len(drawn[r.replicate]) == 4
        assert abs(r.macro_f1 - macro([(truth[i], guess[i]) for i in drawn[r.replicate]], 3)) < 1e-12
    assert S.bootstrap_ci(p, 3, 20, group="group_id").first().units == 2


def test_md5_of_many_numbers():
    for prefix, first, last in ((b"b:0:", 0, 10), (b"b:9999:", 90, 1200), (b"seed:17:", 1_000_000, 1_000_300), (b"", 5, 6)):
        want = [[int(hashlib.md5(prefix + str(j).encode()).hexdigest()[8 * k : 8 * k + 8], 16) for j in range(first, last)] for k in range(4)]
        assert S.md5_words(prefix, first, last).tolist() == want


def test_bootstrap_counts_without_a_shuffle(spark):
    """A replicate's draws are counted where they are made, with the same counts as over a shuffle."""
    for n in (0, 1, 7, 4099, 50_001):
        units = spark.range(n).withColumnRenamed("id", "index")
        got = S.bootstrap_counts(units, 3)
        want = S.bootstrap_counts(units, 3, limit=0)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_ensemble_mean(spark):
    data = [("a", m, 1, [0.51, 0.49] if m < 3 else [0.01, 0.99]) for m in range(5)] + [("b", m, 0, [0.9, 0.1]) for m in range(5)]
    p = spark.createDataFrame(data, "uid string, model int, label int, proba array<double>")
    assert [(r.uid, r.proba, r.prediction) for r in S.ensemble_mean(p, 2).orderBy("uid").collect()] == [("a", [0.31, 0.69], 1), ("b", [0.9, 0.1], 0)]
    assert S.ensemble_join(p.where("NOT (uid = 'a' AND model = 1)"), 5).where("problem = 'rows'").count() == 1


def test_cv_summary(spark):
    s = TR.trial_summary(spark.createDataFrame([(1, 0, 0.6), (1, 1, 0.8), (2, 0, 0.5)], "trial int, fold int, score double"), 2)
    got = {r.trial: (r.mean, r.sd, r.complete) for r in s.collect()}
    assert got == {1: (0.7, 0.141421, True), 2: (0.5, None, False)}


def test_cohort(spark):
    df = spark.createDataFrame([("a.wav", "1", "x"), (" a2.wav ", "1", "x"), ("b.wav", "2", "skip"), ("c.wav", "3", "y"), ("nan", "4", "x"), ("d.wav", None, "x")], "filename string, patient_id string, diagnosis string")
    assert [r.filename for r in C.cohort_filter(df, ["x", "y", "skip"], ["skip"]).orderBy("filename").collect()] == ["a.wav", "a2.wav", "c.wav"]
    assert [r.weight for r in C.class_weights(df.limit(4).where("diagnosis <> 'skip'").where("filename <> ' a2.wav '"), ["x", "y"]).orderBy("diagnosis").collect()] == [2.0, 2.0]
    assert C.conflict_groups(df, "patient_id", "filename").count() == 1


@pytest.mark.parametrize("parts", [1, 8])
def test_folds_do_not_depend_on_partitions(spark, parts):
    df = spark.createDataFrame([(i, f"p{i}", "abc"[i % 3]) for i in range(15)], "uid int, patient_id string, diagnosis string").repartition(parts)
    f = C.assign_folds(df, 5, 1234)
    assert [r[1] for r in f.groupBy("fold").count().orderBy("fold").collect()] == [3] * 5
    held = C.select_split(df, f, 0, "validation").count(), C.select_split(df, f, 0, "train").count()
    assert held == (3, 12)
    got = tuple(r.fold for r in f.orderBy("uid").collect())
    assert got == test_folds_do_not_depend_on_partitions.__dict__.setdefault("seen", got)


def test_running_best(spark):
    j = spark.createDataFrame([(1, 100, 0.8, True), (1, 200, 0.8, True), (1, 300, 0.7, True), (1, 400, 0.95, False), (1, 500, 0.9, True)], "run int, step int, metric double, eligible boolean")
    assert [r.saved for r in J.running_best(j).orderBy("step").collect()] == [True, False, False, False, True]
    assert rows(J.selected_checkpoint(j)) == [(1, 500, 0.9)]
    assert rows(J.patience(j, 3)) == [(1, 400)]
    stored = J.running_best(j).withColumn("stored_best", F.col("previous_best")).withColumn("stored_saved", F.col("saved")).select("run", "step", "metric", "eligible", "stored_best", "stored_saved")
    assert J.audit_journal(stored, J.selected_checkpoint(j), 100).count() == 0
    assert J.audit_journal(stored.withColumn("stored_saved", F.lit(True)), J.selected_checkpoint(j), 100).count() == 3


def test_baseline(spark):
    s = spark.createDataFrame([(1, 5, 0.9, 0.1, True), (2, 5, 0.7, 0.1, True)], "trial int, n_folds int, mean double, sd double, complete boolean")
    base = lambda m: spark.createDataFrame([(m,)], "mean double")
    assert TR.best_trial(s, base(0.8)).first().winner == "1"
    assert TR.best_trial(s, base(0.95)).first().winner == "baseline"
    assert TR.best_trial(s, base(0.95), matched=False).first().winner == "1"
    assert TR.best_trial(s.withColumn("complete", F.lit(False)), base(0.1)).count() == 0


def test_grid(spark):
    g = C.trial_grid(spark, {"a": [1, 2, 3], "b": [1, 2, 3], "c": ["x", "y", "z"]})
    assert g.select("trial_id").distinct().count() == 27
    assert [r.trial_index for r in g.orderBy("trial_index").collect()] == list(range(27))


def test_segments_and_crops(spark):
    df = spark.createDataFrame([("a", 13999), ("b", 14000), ("c", 28000)], "uid string, duration_ms long")
    assert rows(G.sliding_segments(df, 14000, 7000).select("uid", "start_ms"), "uid", "start_ms") == [("a", None), ("b", 0), ("c", 0), ("c", 7000), ("c", 14000)]
    assert rows(df.select("uid", G.crop_starts(F.col("duration_ms"), 14000, 3, "train")), "uid") == [("a", [0]), ("b", [0]), ("c", [0, 7000, 14000])]


def test_vectors(spark):
    assert one(spark, V.thresholded_argmax(F.array(F.lit(-0.1), F.lit(-2.5)), [-0.05, -9.0])) == 1
    assert one(spark, V.argmax_class(F.array(F.lit(0.5), F.lit(0.5)))) == 0
    assert one(spark, V.pad_or_crop(F.array(*[F.lit(float(i)).cast("float") for i in range(3)]), 5, "repetition_pad")) == [0, 1, 2, 0, 1]
    df = spark.createDataFrame([("r", 0, [1.0, 2.0], True), ("r", 1, [5.0, 6.0], False), ("s", 0, [1.0, 1.0], False)], "uid string, pos int, vec array<float>, valid boolean")
    assert rows(V.masked_mean_pool(df, 2), "uid") == [("r", [1.0, 2.0]), ("s", [0.0, 0.0])]
    assert rows(V.attention_pool(df, [1.0, 0.0]), "uid") == [("r", [1.0, 2.0]), ("s", [0.0, 0.0])]
    assert [r.was_nonzero for r in V.zero_invalid(df).orderBy("uid", "pos").collect()] == [False, True, True]


def test_exclusion(spark):
    w = spark.createDataFrame([("r", i, s, e) for i, (s, e) in enumerate([(0, 100), (100, 200), (200, 300), (500, 600), (1600, 1700)])], "uid string, word_id int, start_ms int, end_ms int")
    seg = spark.createDataFrame([("r", 200, 550), ("r", 1500, 1550)], "uid string, begin_ms int, stop_ms int")
    assert [r.word_id for r in I.exclude_overlaps(w, seg).orderBy("word_id").collect()] == [0, 4]


def test_corruption(spark):
    w = words(spark, [f"w{i}" for i in range(10)])
    vocabulary = spark.createDataFrame([(0, "w1"), (1, "x"), (2, "y")], "index long, entry string")
    c = R.corrupt_words(w, 30, 1, vocabulary)
    ops = [r.op for r in c.where("op <> 'keep'").select("word_id", "op").distinct().collect()]
    assert sorted(ops) == ["insert", "substitute"] and c.count() == 10
    assert R.corrupt_words(w, 30, 1, vocabulary.orderBy(F.desc("index"))).exceptAll(c).count() == 0


def test_overlap_owners(spark):
    ws = spark.createDataFrame([("r", 0, 0, 5), ("r", 1, 6, 200)], "uid string, word_id int, start long, end long")
    ts = spark.createDataFrame([("r", 0, 0, 3), ("r", 1, 4, 7), ("r", 2, 60, 190), ("r", 3, 5, 6)], "uid string, token_id int, start long, end long")
    assert [r[2:] for r in rows(I.token_word_overlap(ts, ws), "token_id")] == [(0, 1), (None, 2), (1, 1), (None, 0)]


def test_sql_names(spark):
    names = register_all(spark)
    assert {"nfc", "word_packer", "pause_symbol"} <= set(names)
    assert spark.sql("SELECT pause_symbol(0.7D) AS x").first().x == ","
    assert [tuple(r) for r in spark.sql("SELECT * FROM word_packer(array(4, 3, 4, 11), 8)").collect()] == [(0, 0), (1, 0), (2, 1), (3, None)]
