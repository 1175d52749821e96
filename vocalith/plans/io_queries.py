"""Queries for scans, sinks, hashes, staged reports and streams. Files that a scan reads are written from the given tables first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from vocalith.functions import hashing as H
from vocalith.functions import text as T
from vocalith.functions.sql_names import register_all
from vocalith.operators import cohort as C
from vocalith.operators import intervals as I
from vocalith.operators import packages as P
from vocalith.operators import transcripts as R
from vocalith.operators import vectors as V
from vocalith.operators.metrics import exact_sum, rounded
from vocalith.operators.stages import Batch
from vocalith.plans import fixtures as X
from vocalith.plans.registry import query
from vocalith.plans.reports import encode_words
from vocalith.sources import manifests as M
from vocalith.sources import scans as S
from vocalith.sources import sinks as K
from vocalith.sources.storage import few_listing_tasks, shared_path
from vocalith.streaming import jobs as J

# --- scans of tables


@query("scan_labels", "SELECT c_name AS filename, c_custkey::VARCHAR AS patient_id, c_mktsegment AS diagnosis FROM customer")
def _(spark, d):
    raw = X.load(spark, d, "customer").select(F.col("c_name"), F.col("c_custkey").alias("Patient"), F.col("c_mktsegment").alias("DX_PILAR"))
    path = shared_path(spark, "labels")
    raw.write.csv(path, header=True)
    return S.scan_labels(spark, path)


@query("scan_labels_strict", "SELECT o_orderkey || '.wav' AS path, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS label, CASE WHEN o_orderstatus = 'P' THEN 'unknown class' WHEN o_orderkey % 20 = 0 THEN 'missing path' END AS problem FROM orders")
def _(spark, d):
    o = X.load(spark, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("path"), "o_orderstatus", "o_orderkey")
    path = shared_path(spark, "strict")
    o.select("path", "o_orderstatus").write.csv(path, sep="\t")
    return S.scan_labels_strict(spark, path, {"F": 0, "O": 1}, o.where("o_orderkey % 20 <> 0"))


@query("scan_partitions", "SELECT CASE o_orderstatus WHEN 'P' THEN 'null_value' WHEN 'F' THEN 'train' ELSE 'test' END AS partition, 'rec ' || o_orderkey AS filename FROM orders")
def _(spark, d):
    o = X.load(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", " Train").when(F.col("o_orderstatus") == "O", "TEST ").alias("p"), F.concat(F.lit(" rec "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("f"))
    path = shared_path(spark, "partitions")
    o.write.csv(path, sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return S.scan_partitions(spark, path)


@query("scan_consensus", "SELECT lower(c_name) AS filename, lower(c_mktsegment) AS diagnosis, c_nationkey::VARCHAR AS rater FROM customer")
def _(spark, d):
    path = shared_path(spark, "consensus")
    X.load(spark, d, "customer").select(F.col("c_name").alias("FileName"), F.col("c_mktsegment").alias("Consensus"), F.col("c_nationkey").alias("Rater"), "c_acctbal").write.csv(path, header=True)
    return S.scan_consensus(spark, path, {"filename": "filename", "consensus": "diagnosis", "rater": "rater"})


@query("scan_words", X.sql("words", "SELECT 'u' || uid AS uid, (row_number() OVER (PARTITION BY uid ORDER BY word_id) - 1)::INTEGER AS word_id, regexp_replace(word, '[\",\\\\]', '', 'g') AS word, start_ms / 1000.0::DOUBLE AS start, end_ms / 1000.0::DOUBLE AS end, prob AS probability FROM words WHERE regexp_replace(word, '[\",\\\\]', '', 'g') <> ''"))
def _(spark, d):
    """All words, written as one CSV for each recording and read again."""
    w = X.words(spark, d).withColumn("word", F.regexp_replace("word", r'[",\\]', "")).where("word <> ''")
    line = F.concat_ws(",", "word", (F.col("start_ms") / 1000.0).cast("string"), (F.col("end_ms") / 1000.0).cast("string"), F.col("prob").cast("string"))
    files = w.groupBy("uid").agg(F.concat(F.lit("word,start,end,probability\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_id", line.alias("line")))), lambda x: x["line"]), "\n")).alias("value"))
    path = shared_path(spark, "wordfiles")
    K.write_text_per_record(files.select(F.concat(F.lit("u"), F.col("uid").cast("string")).alias("uid"), F.col("value").alias("text")), path)
    return S.scan_words(spark, path, r"uid=([^/]*)/")


@query("scan_transcripts", "SELECT uid, CASE WHEN problem IS NULL THEN t END AS text, problem FROM (SELECT conv_id AS uid, any_value(text) AS t, CASE WHEN count(*) > 1 THEN 'several rows' END AS problem FROM (SELECT conv_id || CASE WHEN turn > 1 THEN '-' || turn ELSE '' END AS conv_id, text FROM conversations) GROUP BY 1)")
def _(spark, d):
    """Turns as transcripts in a CSV; a conversation's first two share a uid, which is a problem."""
    uid = F.concat(F.col("conv_id").cast("string"), F.when(F.col("turn") > 1, F.concat(F.lit("-"), F.col("turn").cast("string"))).otherwise(""))
    path = shared_path(spark, "transcripts")
    X.load(spark, d, "conversations").select(uid.alias("uid"), F.col("text").alias("transcription"), F.upper("text").alias("transcription_pause")).write.options(**S.TEXT_CSV).csv(path)
    return S.scan_transcripts(spark, path)


@query("scan_file_index", """WITH f AS (SELECT 'main' AS part, p_partkey, octet_length(encode(p_name)) + 1 AS n FROM part UNION ALL SELECT 'more', p_partkey, octet_length(encode(p_type)) + 1 FROM part WHERE p_partkey % 10 = 0)
  SELECT part, p_partkey::VARCHAR AS stem, 'p_partkey=' || p_partkey AS folder, n::BIGINT AS length, count(*) OVER (PARTITION BY p_partkey) > 1 AS duplicate FROM f""")
def _(spark, d):
    """A text file for each part, and a second one under the same stem for every tenth."""
    path = shared_path(spark, "files")
    p = X.load(spark, d, "part")
    K.write_folders(p.select("p_partkey", F.col("p_name").alias("value")), f"{path}/main", "p_partkey")
    K.write_folders(p.where("p_partkey % 10 = 0").select("p_partkey", F.col("p_type").alias("value")), f"{path}/more", "p_partkey")
    files = S.scan_file_index(spark, path, "*.txt", stem=r"p_partkey=([^/]*)/")
    return files.select(F.regexp_extract("path", "/(main|more)/", 1).alias("part"), "stem", "folder", "length", "duplicate")


@query("scan_splits", X.sql("cohort", "SELECT 'train' AS split, fold, uid, NULL::VARCHAR AS problem FROM (SELECT uid::VARCHAR AS uid, (patient_id % 5)::INTEGER AS fold FROM cohort) WHERE fold < 4 UNION ALL SELECT 'train', fold, uid, 'fold' FROM (SELECT uid::VARCHAR AS uid, (patient_id % 5)::INTEGER AS fold FROM cohort) WHERE fold = 4"))
def _(spark, d):
    path = shared_path(spark, "splits")
    X.cohort(spark, d).select(F.lit("train").alias("split"), (F.col("patient_id") % 5).cast("int").alias("fold"), "uid").write.csv(path, header=True)
    return S.scan_splits(spark, path, 4)


@query("scan_run_results", X.sql("runs", "SELECT trial, fold, train_score AS training_macro_f1, score AS macro_f1, score * 2 AS accuracy, (trial % 3)::INTEGER AS n_predictions FROM runs"))
def _(spark, d):
    """Result documents as JSON arrays, one file for each of 50 shares of the trials."""
    p = F.array_repeat(F.struct(F.col("trial").alias("uid"), F.lit(0).alias("label"), F.lit(1).alias("prediction")), (F.col("trial") % 3).cast("int"))
    doc = F.struct("trial", "fold", F.col("train_score").alias("training_macro_f1"), F.struct(F.col("score").alias("macro_f1"), (F.col("score") * 2).alias("accuracy")).alias("metrics"), p.alias("predictions"))
    files = X.runs(spark, d).groupBy((F.col("trial") % 50).alias("uid")).agg(F.to_json(F.collect_list(doc)).alias("text"))
    path = shared_path(spark, "results")
    K.write_text_per_record(files, path)
    return S.scan_run_results(spark, path)


@query("scan_journal", "SELECT event_id AS completed_steps, value AS validation_macro_f1, (props ->> '$.k')::BIGINT AS k FROM events")
def _(spark, d):
    """`events` as a decision log in JSON lines, read again."""
    path = shared_path(spark, "journal")
    X.load(spark, d, "events").select(F.col("event_id").alias("completed_steps"), F.col("value").alias("validation_macro_f1"), F.get_json_object("props", "$.k").cast("long").alias("k")).write.json(path)
    return S.scan_journal(spark, path, "completed_steps BIGINT, validation_macro_f1 DOUBLE, k BIGINT")


@query("scan_predictions", X.sql("model_preds", "SELECT uid, label, model AS fold, proba FROM model_preds"))
def _(spark, d):
    path = shared_path(spark, "predictions")
    p = X.model_preds(spark, d).select("uid", "label", *[F.col("proba")[i].alias(f"probability_{i}") for i in range(3)], F.col("model").alias("fold"))
    p.write.partitionBy("fold").csv(path, header=True)
    return S.scan_predictions(spark, [f"{path}/fold={k}" for k in range(5)])


@query("scan_segments", "SELECT conv_id * 1000 + turn AS uid, conv_id * 10 / 1000.0::DOUBLE AS begin, (conv_id * 10 + 1500) / 1000.0::DOUBLE AS stop FROM conversations WHERE role = 'system'")
def _(spark, d):
    path = shared_path(spark, "segments")
    X.load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), F.col("role").alias("speaker"), (F.col("conv_id") * 10).alias("begin"), (F.col("conv_id") * 10 + 1500).alias("end")).write.csv(path, header=True)
    return S.scan_segments(spark, path, "system")


@query("scan_noise_lists", "SELECT p_name AS path, p_type AS type FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_name, 'rir' FROM part WHERE p_partkey % 4 = 0")
def _(spark, d):
    p, path = X.load(spark, d, "part").withColumn("path", F.col("p_name")), shared_path(spark, "noise")
    K.write_path_list(p.where("p_partkey % 4 <> 0"), f"{path}/noises", "p_type")
    K.write_path_list(p.where("p_partkey % 4 = 0"), f"{path}/rirs")
    return S.scan_noise_lists(spark, f"{path}/noises", f"{path}/rirs")


@query("scan_text_files", "SELECT s_suppkey::VARCHAR AS uid, CASE WHEN s_suppkey % 4 = 0 THEN 'test' ELSE 'train' END AS partition, CASE WHEN s_suppkey % 4 = 0 THEN '...' ELSE s_name END AS text, NULL::VARCHAR AS problem FROM supplier")
def _(spark, d):
    """Supplier names as transcript files."""
    path = shared_path(spark, "texts")
    s = X.load(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("uid"), F.col("s_name").alias("text"))
    K.write_text_per_record(s, path)
    recordings = s.select("uid", F.when(F.col("uid").cast("long") % 4 == 0, "test").otherwise("train").alias("partition"))
    return S.scan_text_files(spark, path, recordings, uid_pattern=r"uid=([^/]*)/")


# --- sinks


@query("resume_pending", "SELECT o_orderkey AS uid FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def _(spark, d):
    """A fifth is not in the manifest, and a seventh has another signature there."""
    o = X.load(spark, d, "orders").withColumn("uid", F.col("o_orderkey"))
    now = K.with_signature(o, "o_orderstatus", "o_totalprice")
    old = K.with_signature(o.where("o_orderkey % 5 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("o_totalprice"))), "o_orderstatus", "o_totalprice")
    return K.resume_pending(now, old.select(F.lit("windows").alias("stage"), "uid", "signature"), "windows").select("uid")


@query("publish_once", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'insert' ELSE 'conflict' END AS outcome FROM documents WHERE doc_id % 3 = 0 OR doc_id % 11 = 1")
def _(spark, d):
    """Against a stored manifest of what is published."""
    new = X.load(spark, d, "documents").select("doc_id", "text")
    path = shared_path(spark, "published")
    M.write_manifest(new.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), path, "doc_id", "text")
    return M.publish_against(new, path, "doc_id", "text")


@query("verify_manifest", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 9 = 1 THEN 'unexpected' ELSE 'changed' END AS status FROM documents WHERE doc_id % 9 < 3")
def _(spark, d):
    """Against a stored manifest, by its hash tree."""
    docs = X.load(spark, d, "documents").select("doc_id", "text")
    path = shared_path(spark, "manifest")
    M.write_manifest(docs.where("doc_id % 9 <> 1").withColumn("text", F.when(F.col("doc_id") % 9 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), path, "doc_id", "text")
    return M.verify_content(docs.where("doc_id % 9 <> 0"), path, "doc_id", "text")


@query("write_partition_labels", "SELECT o_orderkey AS uid, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation' ELSE 'test' END AS partition, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS label FROM orders")
def _(spark, d):
    """All partitions, written and read again; the test one has no labels."""
    o = X.load(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("uid"), F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "validation").otherwise("test").alias("partition"), F.col("o_orderpriority").alias("label"))
    path = shared_path(spark, "tsv")
    K.write_partition_labels(rows, path)
    labelled = spark.read.csv(f"{path}/labelled", sep="\t", header=True, schema="uid BIGINT, label STRING, partition STRING")
    hidden = spark.read.csv(f"{path}/partition=test", sep="\t", header=True, schema="uid BIGINT")
    return labelled.select("uid", "partition", "label").unionByName(hidden.select("uid", F.lit("test").alias("partition"), F.lit(None).cast("string").alias("label")))


@query("write_once", "SELECT f AS form, c_custkey, c_mktsegment FROM customer, (VALUES ('csv'), ('json')) v(f)")
def _(spark, d):
    """In both forms."""
    path, c, schema = shared_path(spark, "once"), X.load(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey BIGINT, c_mktsegment STRING"
    K.write_once(c, f"{path}/json")
    K.write_once(c, f"{path}/csv", "csv")
    read = {"json": spark.read.schema(schema).json(f"{path}/json"), "csv": spark.read.csv(f"{path}/csv", header=True, schema=schema)}
    return read["json"].select(F.lit("json").alias("form"), "*").unionByName(read["csv"].select(F.lit("csv").alias("form"), "*"))


@query("write_atomic", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def _(spark, d):
    """Two versions; the second is what readers see."""
    path, c = shared_path(spark, "atomic"), X.load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    K.write_atomic(c, path)
    K.write_atomic(c.where("c_custkey % 2 = 0"), path)
    return K.read_current(spark, path)


@query("write_path_list", "SELECT p_name || chr(9) || p_type AS value FROM part")
def _(spark, d):
    path = shared_path(spark, "paths")
    K.write_path_list(X.load(spark, d, "part").select(F.col("p_name").alias("path"), "p_type"), path, "p_type")
    return spark.read.text(path)


@query("write_text_per_record", "SELECT s_suppkey, s_name AS text FROM supplier")
def _(spark, d):
    path = shared_path(spark, "records")
    K.write_text_per_record(X.load(spark, d, "supplier").select(F.col("s_suppkey").alias("uid"), F.col("s_name").alias("text")), path)
    with few_listing_tasks(spark):
        rows = spark.read.schema("value STRING, uid BIGINT").text(path)
    return rows.select(F.col("uid").alias("s_suppkey"), F.col("value").alias("text"))


@query("write_leaderboard", X.sql("runs", "SELECT trial, rank, mean, CASE WHEN rank = 1 AND whole THEN 'dropout=0.' || trial % 3 || ', folds=5, heads=' || trial % 4 END AS parameters FROM (SELECT trial, row_number() OVER (ORDER BY mean DESC, sd ASC NULLS LAST, trial)::INTEGER AS rank, mean, bool_and(n = 5) OVER () AS whole FROM (SELECT trial, count(*) AS n, " + X.mean_sql("score") + " AS mean, round(stddev_samp(score), 6) AS sd FROM runs GROUP BY trial))"))
def _(spark, d):
    """The ranking of all trials against a baseline of mean 0, written and read again, with the settings of the winner."""
    from vocalith.operators.trials import rank_trials, trial_summary, winner_parameters

    path = shared_path(spark, "leaderboard")
    summary = X.stored(trial_summary(X.runs(spark, d)), "summary")
    settings = summary.select(F.col("trial").cast("string").alias("trial"), F.create_map(F.lit("heads"), (F.col("trial") % 4).cast("string"), F.lit("dropout"), F.concat(F.lit("0."), (F.col("trial") % 3).cast("string"))).alias("parameters"))
    winner = winner_parameters(summary, spark.range(1).select(F.lit(0.0).alias("mean")), settings, {"folds": "5"})
    K.write_leaderboard(rank_trials(summary), path, winner)
    best = spark.read.schema("winner STRING, parameters MAP<STRING, STRING>").json(f"{path}/winner")
    text = F.array_join(F.array_sort(F.transform(F.map_entries("parameters"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ", ")
    rows = K.read_leaderboard(spark, path, "trial BIGINT, rank INT, mean DOUBLE")
    return rows.join(best.select(F.col("winner").cast("bigint").alias("trial"), text.alias("parameters")), "trial", "left")


# --- hashes and names


@query("stable_seed", "SELECT c_custkey, ('0x' || substr(sha256('1234:' || c_custkey), 1, 15))::BIGINT AS seed FROM customer")
def _(spark, d):
    return X.load(spark, d, "customer").select("c_custkey", H.stable_seed("c_custkey", 1234).alias("seed"))


@query("cache_key", "SELECT page_id, sha256(url || '|16000|14|base|en|' || page_id) AS key FROM pages")
def _(spark, d):
    return X.load(spark, d, "pages").select("page_id", H.cache_key("url", 16000, 14, "base", "en", "page_id").alias("key"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(spark, d):
    return X.load(spark, d, "documents").select("doc_id", H.content_hash("text").alias("hash"))


@query("run_name", "SELECT doc_id, CASE WHEN length(n) <= 60 THEN n ELSE substr(n, 1, 47) || '-' || substr(sha256(n), 1, 12) END AS name FROM (SELECT doc_id, doc_id || '-' || source || '-' || substr(text, 1, doc_id % 80) AS n FROM documents)")
def _(spark, d):
    return X.load(spark, d, "documents").select("doc_id", H.run_name("doc_id", "source", F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 80).cast("int")), max_len=60).alias("name"))


@query("absolute_times", X.sql("words", "SELECT uid, word_id, word, (start_ms + 5000 * (uid % 4)) / 1000.0::DOUBLE AS start, (end_ms + 5000 * (uid % 4)) / 1000.0::DOUBLE AS end, prob AS confidence FROM words"))
def _(spark, d):
    """Nested segments of words with times relative to a window, made flat and absolute."""
    from vocalith.operators.nested import absolute_times

    w = X.words(spark, d)
    item = F.struct("word_id", "word", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), F.col("prob").alias("probability"))
    nested = w.groupBy("uid", (F.col("word_id") % 3).alias("s")).agg(F.collect_list(item).alias("words")).groupBy("uid").agg(F.collect_list("words").alias("segments"))
    return absolute_times(nested.withColumn("window_start", (5 * (F.col("uid") % 4)).cast("double"))).withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@query("register_all", X.sql("words", r"SELECT uid, word_id, regexp_replace(nfc_normalize(lower(trim(word))), '\p{P}', '', 'g') AS form, CASE WHEN prob > 0.75 THEN ',' ELSE '' END AS mark FROM words"))
def _(spark, d):
    """The functions by their SQL names."""
    register_all(spark)
    X.words(spark, d).createOrReplaceTempView("vocalith_words")
    return spark.sql("SELECT uid, word_id, ctc_form(word) AS form, pause_symbol(CASE WHEN prob > 0.75D THEN 0.6D ELSE 0.1D END) AS mark FROM vocalith_words")


@query("score_partitions", "SELECT vec_id, round(embedding[1]::DOUBLE + embedding[2]::DOUBLE, 6) AS score FROM embeddings")
def _(spark, d):
    from vocalith.operators.fitting import score_partitions

    def load():
        return lambda f: f[["vec_id"]].assign(score=[round(float(e[0]) + float(e[1]), 6) for e in f["embedding"]])

    return score_partitions(X.load(spark, d, "embeddings").select("vec_id", "embedding"), load, "vec_id BIGINT, score DOUBLE")


@query("apply_per_recording", X.sql("words", "SELECT uid, word_id, sum(end_ms - start_ms) OVER (PARTITION BY uid ORDER BY word_id)::BIGINT AS spoken_ms FROM words"))
def _(spark, d):
    """A user's function of one recording: the time spoken so far."""
    from vocalith.operators.fitting import apply_per_recording

    def spoken(frame):
        frame = frame.sort_values("word_id")
        return pd.DataFrame({"uid": frame["uid"], "word_id": frame["word_id"], "spoken_ms": (frame["end_ms"] - frame["start_ms"]).cumsum()})

    return apply_per_recording(X.words(spark, d).select("uid", "word_id", "start_ms", "end_ms"), spoken, "uid BIGINT, word_id INT, spoken_ms BIGINT")


# --- reports


@query("partition_labels", "SELECT o_orderkey, o_orderstatus AS partition, CASE WHEN n > 3 THEN 'many' WHEN n > 0 THEN 'few' END AS label, CASE WHEN n IS NULL THEN 'left_only' ELSE 'both' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey WHERE n > 3 OR o_orderstatus = 'P'")
def _(spark, d):
    """Partitions with labels of the class 'many', and the whole test partition."""
    o = X.load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("partition"))
    labels = X.load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.count("*") > 3, "many").otherwise("few").alias("label"))
    return C.partition_filter(C.partition_label_join(o, labels, "o_orderkey"), ["many"], "label", "partition", "P")


@query("null_transcript_report", "SELECT source, filled, n, round(100.0 * n / sum(n) OVER (PARTITION BY source), 6)::DOUBLE AS percent FROM (SELECT source, doc_id % 4 <> 0 AS filled, count(*) AS n FROM documents GROUP BY 1, 2)")
def _(spark, d):
    docs = X.load(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 4 == 0, "...").otherwise(F.col("text")))
    return C.value_counts(docs.withColumn("filled", F.col("text") != "..."), "filled", ["source"])


def _audio(spark, d, w):
    from vocalith.plans.frame_queries import pooled

    return pooled(spark, d, w)


def _text(w, keep):
    vec = F.array(F.length("word").cast("double"), F.col("prob"))
    return w.select("uid", "word_id", F.when(keep, vec).otherwise(F.array(F.lit(0.0), F.lit(0.0))).alias("vec"), keep.alias("valid"))


def _summary(rows):
    total = rounded(exact_sum(F.when(F.col("valid"), F.col("audio")[0] + F.col("text")[0]), 6), F.lit(1000), 3)
    return P.package_summary(rows, [F.sum("n_frames").alias("frames"), total.alias("checksum")])


def _digest_sql(line: str) -> str:
    return f"sha256(concat_ws(':', count(*), sum(('0x' || substr(md5({line}), 1, 15))::BIGINT::HUGEINT), sum(('0x' || substr(md5({line}), 16, 15))::BIGINT::HUGEINT)))"


def _package_sql(test: str, more: str = "") -> str:
    from vocalith.plans.frame_queries import _CTC_MAPPED, _pool_sql

    a = "w.word_id || ':' || (n IS NOT NULL) || ':' || round(coalesce(v0, 0) * 1000)::BIGINT || '_' || round(coalesce(v1, 0) * 1000)::BIGINT"
    t = f"w.word_id || ':' || ({test}) || ':' || CASE WHEN {test} THEN (1000 * length(word))::BIGINT ELSE 0 END || '_' || CASE WHEN {test} THEN round(prob * 1000)::BIGINT ELSE 0 END"
    return X.sql("grid ctc_words", f"""SELECT w.uid, count(*) AS words, count(n) AS audio_valid, count_if({test}) AS text_valid, count_if(n IS NOT NULL AND {test}) AS paired, count_if(n IS NULL AND {test}) AS no_interval, count_if(n IS NOT NULL AND NOT ({test})) AS no_text_tokens, count_if(n IS NULL AND NOT ({test})) AS neither,
      {_digest_sql(a)} AS audio_hash, {_digest_sql(t)} AS text_hash, CASE WHEN count_if(n IS NOT NULL AND {test}) = 0 THEN 'no valid pair' END AS problem, coalesce(sum(n), 0)::BIGINT AS frames, {X.sum_sql(f'(CASE WHEN n IS NOT NULL AND {test} THEN v0 + length(word) END)', 6, 3)} AS checksum{more}
      FROM words w LEFT JOIN means m ON w.uid = m.uid AND w.word_id = m.word_id GROUP BY w.uid""", _CTC_MAPPED + ", " + _pool_sql("SELECT * FROM mapped"))


@query("package_words", _package_sql("prob >= 0.2"))
def _(spark, d):
    w = X.stored(X.words(spark, d), "words")
    return _summary(P.package_rows(X.stored(_audio(spark, d, w), "audio"), _text(w, F.col("prob") >= 0.2)))


def _records(w):
    """A record for each recording, with a hash of its words as its source."""
    return w.groupBy("uid").agg(M.multiset_digest(F.concat_ws(":", "word_id", "word", "start_ms", "end_ms", "prob")).alias("words_hash"))


@query("reencode_text", _package_sql("prob >= 0.4", ", (SELECT count(DISTINCT uid) FROM words) AS audio_reused"))
def _(spark, d):
    """A batch, then another one that differs in its text settings: its acoustic rows are those of the first, as its manifest says; text rows and packages are new."""
    w, root = X.stored(X.words(spark, d), "words"), shared_path(spark, "batch")
    records = X.stored(_records(w), "records")
    audio_of = lambda words: _audio(spark, d, words)
    for least in (0.2, 0.4):
        batch = Batch(spark, root)
        rows = encode_words(batch, records, w, audio_of, lambda words: _text(words, F.col("prob") >= least), {"audio": {"policy": "centres"}, "text": {"least": least}}, keep_failed=True)  # noqa: B023
    return _summary(rows).withColumn("audio_reused", F.lit(batch.reused["audio"]).cast("long"))


@query("cohort_pipeline", X.sql("ctc_words", r"""SELECT count(DISTINCT uid) AS recordings, count(*) AS words, count_if(c.start_ms IS NULL) AS unaligned, count_if(length(regexp_replace(lower(trim(w.word)), '\p{P}', '', 'g')) = 0) AS silent, count_if(greatest(abs(c.start_ms - w.start_ms), abs(c.end_ms - w.end_ms)) / 1000.0::DOUBLE > 0.2 + 1e-9) AS flagged, count_if(c.start_ms IS NOT NULL AND prob >= 0.2) AS paired,
  (SELECT count(*) FROM per WHERE n > 0) AS completed, (SELECT count(*) FROM per WHERE n = 0) AS failed, (SELECT count(*) FROM per WHERE n > 0 AND uid % 3 <> 0) AS reused, (SELECT bool_and(n > 0) FROM per) AS ready FROM words w JOIN ctc_words c USING (uid, word_id)""", "per AS (SELECT uid, count_if(c.start_ms IS NOT NULL AND prob >= 0.2) AS n FROM words w JOIN ctc_words c USING (uid, word_id) GROUP BY uid)"))
def _(spark, d):
    """Compare, pool, encode and package in stages: at first for two thirds of the recordings, then for all, of which the first are reused; the final counts and the readiness."""
    w, root = X.stored(X.words(spark, d), "words"), shared_path(spark, "cohort")
    records = X.stored(_records(w), "records")
    settings = {"compare": {"threshold_ms": 200}, "audio": {"policy": "centres"}, "text": {"least": 0.2}}
    for some in (records.where("uid % 3 <> 0"), records):
        batch = Batch(spark, root)
        only = lambda words, pending: words.join(pending.select("uid"), "uid", "left_semi")
        compared = batch.run("compare", some, lambda p: I.boundary_delta(R.positional_join(only(w, p), X.ctc_words(spark, d, only(w, p)))), settings["compare"])
        package = encode_words(batch, some, w, lambda words: _audio(spark, d, words), lambda words: _text(words, F.col("prob") >= 0.2), settings, after=("compare",))
    counts = compared.agg(F.count_distinct("uid").alias("recordings"), F.count("*").alias("words"), F.count_if(F.col("start_delta").isNull()).alias("unaligned"), F.count_if(F.length(T.ctc_form("word", normalise=False)) == 0).alias("silent"), F.count_if("flagged").alias("flagged"))
    gate = batch.readiness(records, "package").select("completed", "failed", "ready")
    return counts.crossJoin(package.agg(F.count_if("valid").alias("paired"))).crossJoin(gate).withColumn("reused", F.lit(batch.reused["package"]).cast("long"))


# --- streams: each query runs the job over all events


def _windows(spark, d, job):
    path = shared_path(spark, "windows")
    J.run_complete(job(J.read_events(spark, f"{d}/events.parquet")), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


_AGG = "count(*) AS n, round(sum(value), 6) AS total, max(value) AS high"


@query("stream_sliding", f"SELECT user_id, s AS start, s + INTERVAL 14 SECOND AS \"end\", {_AGG} FROM (SELECT user_id, value, unnest([time_bucket(INTERVAL 7 SECOND, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 7 SECOND, ts, TIMESTAMP '1970-01-01') - INTERVAL 7 SECOND]) AS s FROM events) GROUP BY ALL")
def _(spark, d):
    return _windows(spark, d, J.stream_sliding)


@query("stream_tumbling", f"SELECT event_type, date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", {_AGG} FROM events GROUP BY ALL")
def _(spark, d):
    return _windows(spark, d, J.stream_tumbling)


@query("stream_sessions", f"SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", {_AGG} FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s")
def _(spark, d):
    return _windows(spark, d, J.stream_sessions)


PATIENCE = 5


def _in_steps(df, by, path, run, steps=3):
    """Rows of df arrive in so many steps by the column `by`; after each the job goes on from its checkpoint."""
    ends = df.agg(F.min(by).cast("double").alias("lo"), F.max(by).cast("double").alias("hi")).first()
    step = F.least(F.lit(steps - 1), F.floor((F.col(by).cast("double") - ends.lo) * steps / ((ends.hi - ends.lo) or 1.0)))
    for k in range(steps):
        df.where(step == k).write.mode("append").parquet(f"{path}/in")
        run()


@query("stream_running_best", f"""WITH seen AS (SELECT user_id, event_id, ts, value, max(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, event_type <> 'error' AS eligible FROM events),
  decided AS (SELECT *, eligible AND value IS NOT NULL AND (best IS NULL OR value > best) AS saved FROM seen),
  islands AS (SELECT *, sum(saved::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM decided),
  waits AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY place) - CASE WHEN island = 0 THEN 0 ELSE 1 END AS waited FROM islands),
  stops AS (SELECT user_id, min(place) FILTER (waited >= {PATIENCE}) AS stop FROM waits GROUP BY 1)
  SELECT user_id AS run, event_id, value AS metric, saved AND place <= coalesce(stop, place) AS saved, (CASE WHEN place <= coalesce(stop, place) THEN waited ELSE {PATIENCE} END)::INTEGER AS waited, coalesce(place >= stop, false) AS stopped FROM waits JOIN stops USING (user_id)""")
def _(spark, d):
    """Events arrive in three steps of time, and the job starts anew for each."""
    path = shared_path(spark, "decisions")
    job = lambda: J.run_to_end(J.stream_running_best(J.read_events(spark, f"{path}/in"), patience=PATIENCE), f"{path}/out", f"{path}/checkpoint")
    _in_steps(X.load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", path, job)
    return spark.read.parquet(f"{path}/out").drop("closed")


@query("stream_dedup", "SELECT event_id, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    """Every event arrives twice."""
    path = shared_path(spark, "twice")
    e = X.load(spark, d, "events")
    e.unionByName(e).write.parquet(f"{path}/in")
    J.run_to_end(J.stream_dedup(J.read_events(spark, f"{path}/in"), watermark="400 days"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").groupBy("event_id").agg(F.count("*").alias("n"))


@query("stream_label_join", "SELECT event_id, user_id, c_mktsegment AS diagnosis FROM events LEFT JOIN customer ON user_id = c_custkey")
def _(spark, d):
    labels, path = X.load(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("diagnosis")), shared_path(spark, "labelled")
    J.run_to_end(J.stream_label_join(J.read_events(spark, f"{d}/events.parquet"), labels, "user_id", "c_custkey").select("event_id", "user_id", "diagnosis"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


@query("stream_quarantine", "SELECT event_id, coalesce(value < max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM events")
def _(spark, d):
    """The job over all events, in three steps of their ids, with `value` as the time that must not go back."""
    path = shared_path(spark, "quarantine")
    job = lambda: J.stream_quarantine(J.read_events(spark, f"{path}/in"), f"{path}/good", f"{path}/bad", f"{path}/checkpoint", value="value").awaitTermination()
    _in_steps(X.load(spark, d, "events"), "event_id", path, job)
    read = lambda name, late: spark.read.parquet(f"{path}/{name}").select("event_id", F.lit(late).alias("late"))
    return read("good", False).unionByName(read("bad", True))


@query("stream_publish_once", "SELECT doc_id, sha256(coalesce(text, '')) AS hash, 'published' AS outcome FROM documents UNION ALL SELECT doc_id, sha256(coalesce(text, '') || '!'), 'conflict' FROM documents WHERE doc_id % 7 = 0")
def _(spark, d):
    """All documents, then all of them again, every seventh with another text."""
    path = shared_path(spark, "published")
    docs = X.load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for sent in (docs, docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))):
        sent.write.mode("append").parquet(f"{path}/in")
        J.stream_publish_once(spark.readStream.schema(docs.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/conflicts", f"{path}/checkpoint").awaitTermination()
    read = lambda name, outcome: spark.read.schema(docs.schema).parquet(f"{path}/{name}").select("doc_id", F.sha2("text", 256).alias("hash"), F.lit(outcome).alias("outcome"))
    return read("out", "published").unionByName(read("conflicts", "conflict"))


@query("vec_mean", X.sql("vecs", "SELECT uid, list(v ORDER BY i) AS vec FROM (SELECT uid, i, " + X.mean_sql("x") + " AS v FROM (SELECT uid, unnest(range(1, 65)) AS i, unnest(vec)::DOUBLE AS x FROM vecs) GROUP BY 1, 2) GROUP BY uid"))
def _(spark, d):
    return V.recording_summary_vector(X.vecs(spark, d), 64).select("uid", "vec")
