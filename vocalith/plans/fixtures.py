"""Tables derived from the given ones, in Spark and, word for word, in SQL.

`h(key)`, the first 8 hex digits of md5, takes the place of random draws, so that results do not depend on partitioning. Times are
integer milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalith.functions.hashing import draw
from vocalith.operators.metrics import exact_mean
from vocalith.sources.storage import shared_path, sound_unions


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sound_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, *cols: str) -> Column:
    return F.concat_ws(":", F.lit(prefix), *[F.col(c).cast("string") for c in cols])


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, role, word_id, word, start_ms, end_ms, char_start, prob: timestamped transcripts made of `conversations`."""
    tokens = F.filter(F.split("text", "[ \\t\\r\\n]+"), lambda x: x != "")
    base = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), "role", F.posexplode(tokens).alias("word_id", "word"))
    ends = F.col("word").rlike("[.,]$")
    base = base.withColumn("gap", F.when(ends, draw(key("gap", "uid", "word_id"), 2000)).otherwise(draw(key("gap", "uid", "word_id"), 200)))
    line = W.partitionBy("uid").orderBy("word_id").rowsBetween(W.unboundedPreceding, -1)
    before = lambda e: F.coalesce(F.sum(e).over(line), F.lit(0)).cast("long")
    length = F.length("word").cast("long")
    out = base.withColumn("start_ms", before(60 * length + F.col("gap"))).withColumn("char_start", before(length + 1))
    return out.select("uid", "role", "word_id", "word", "start_ms", (F.col("start_ms") + 60 * length).alias("end_ms"), "char_start", (draw(key("p", "uid", "word_id"), 1001) / 1000.0).alias("prob"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, for queries that use it several times."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ctc_words(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """uid, word_id, word, start_ms, end_ms: a second alignment of the same words; a tenth have no interval."""
    w = words(spark, sf_dir) if of is None else of
    shift = lambda p: draw(key(p, "uid", "word_id"), 401) - 200
    start = F.greatest(F.lit(0).cast("long"), F.col("start_ms") + shift("s"))
    end = F.greatest(start + 20, F.col("end_ms") + shift("e"))
    there = draw(key("u", "uid", "word_id"), 10) != 0
    return w.select("uid", "word_id", "word", F.when(there, start).alias("start_ms"), F.when(there, end).alias("end_ms"))


def segments(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """uid, begin_ms, stop_ms: intervals of the excluded speaker."""
    w = words(spark, sf_dir) if of is None else of
    heads = w.select("uid").distinct().where(draw(key("seg", "uid"), 3) == 0).select("uid", F.lit(0).cast("long").alias("begin_ms"), F.lit(1500).cast("long").alias("stop_ms"))
    return w.where("role = 'system'").select("uid", F.col("start_ms").alias("begin_ms"), F.col("end_ms").alias("stop_ms")).unionByName(heads)


def grid(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, blocks: bool = False) -> DataFrame:
    """uid, frame, centre_ms, f0, f1, score: acoustic frames of 20 ms. blocks: with their `block` of 64, by which they are dealt to 16 tasks a core at least before they are made, so that joins on (uid, block) need not move them."""
    w = words(spark, sf_dir) if of is None else of
    last = w.groupBy("uid").agg(F.floor(F.max("end_ms") / 20).alias("last"))
    if blocks:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
        parts = last.select("uid", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("last", 6))).alias("block")).repartition(tasks, "uid", "block")
        frames = parts.select("uid", "block", F.explode(F.sequence(64 * F.col("block"), F.least("last", 64 * F.col("block") + 63))).alias("frame"))
    else:
        frames = last.select("uid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("frame"))
    return frames.select("uid", *(["block"] if blocks else []), "frame", (20 * F.col("frame") + 12.5).cast("double").alias("centre_ms"), (F.col("frame") % 17).cast("double").alias("f0"), ((7 * F.col("frame") + F.col("uid")) % 23).cast("double").alias("f1"), (-(draw(key("f", "uid", "frame"), 1000) / 1000.0)).alias("score"))


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, pos, vec_id, vec, label, valid: per-position features, ten a recording."""
    return load(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("uid"), (F.col("vec_id") % 10).alias("pos"), "vec_id", F.col("embedding").alias("vec"), "label", (draw(key("v", "vec_id"), 5) != 0).alias("valid"))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, patient_id, diagnosis, duration_ms: one labelled recording for each order."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("diagnosis"))
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("patient_id"), F.floor("o_totalprice").alias("duration_ms"))
    return o.join(c, "patient_id").select("uid", "patient_id", "diagnosis", "duration_ms")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, group_id, label, prediction, fold: one prediction for each order, a quarter of them wrong."""
    o = load(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    base = o.select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("group_id"), label.alias("label"))
    return base.select("uid", "group_id", "label", F.when(draw(key("pred", "uid"), 4) == 0, (F.col("label") + 1) % 3).otherwise(F.col("label")).alias("prediction"), draw(key("fold", "uid"), 5).cast("int").alias("fold"))


def model_preds(spark: SparkSession, sf_dir: str, models: int = 5) -> DataFrame:
    """uid, model, label, proba: three class probabilities for each order and model."""
    base = preds(spark, sf_dir).select("uid", "label", F.explode(F.sequence(F.lit(0), F.lit(models - 1))).alias("model"))
    raw = F.array(*[(1 + draw(key(f"q{c}", "uid", "model"), 1000)).cast("double") for c in range(3)])
    return base.withColumn("raw", raw).select("uid", "model", "label", F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0.0), lambda a, b: a + b)).alias("proba"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial, fold, score, train_score: sweep results."""
    e = load(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("trial"), (F.col("event_id") % 5).cast("int").alias("fold")).agg(exact_mean(F.col("value")).alias("score"), F.max("value").alias("train_score"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, step, metric, eligible: a decision log for each user, in the order of time."""
    line = W.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("run"), (F.row_number().over(line).cast("long") * 100).alias("step"), F.col("value").alias("metric"), (F.col("event_type") != "error").alias("eligible"))


def _h(expression: str) -> str:
    return f"(('0x' || substr(md5({expression}), 1, 8))::BIGINT)"


def mean_sql(x: str, digits: int = 6) -> str:
    """The exact mean of values to 12 digits, rounded once, half away from zero."""
    total, parts = f"sum(round({x} * 1e12)::HUGEINT)", f"(count({x}) * {10 ** (12 - digits)})::HUGEINT"
    return f"(CASE WHEN count({x}) > 0 THEN sign({total}) * ((2 * abs({total}) + {parts}) // (2 * {parts})) / 1e{digits} END)::DOUBLE"


def ratio_sql(total: str, parts: str, digits: int = 6) -> str:
    """total / parts, whole numbers, rounded once, half away from zero; null if there are no parts."""
    total, parts = f"({total})::HUGEINT", f"({parts})::HUGEINT"
    return f"(CASE WHEN {parts} > 0 THEN sign({total}) * ((2 * abs({total}) + {parts}) // (2 * {parts})) / 1e{digits} END)::DOUBLE"


def sum_sql(x: str, digits: int, out: int) -> str:
    """The exact sum of values to `digits`, rounded once to `out`."""
    total, parts = f"sum(round({x} * 1e{digits})::HUGEINT)", 10 ** (digits - out)
    return f"(sign({total}) * ((2 * abs({total}) + {parts}) // {2 * parts}) / 1e{out})::DOUBLE"


#: The same tables as SQL, by name; each may use those before it.
_SQL = {
    "words": f"""words AS (SELECT uid, role, word_id, word, start_ms, start_ms + 60 * length(word) AS end_ms, char_start, {_h("'p:' || uid || ':' || word_id")} % 1001 / 1000.0::DOUBLE AS prob FROM (
  SELECT uid, role, word_id, word, coalesce(sum(60 * length(word) + gap) OVER w, 0)::BIGINT AS start_ms, coalesce(sum(length(word) + 1) OVER w, 0)::BIGINT AS char_start FROM (
    SELECT uid, role, word_id, word, {_h("'gap:' || uid || ':' || word_id")} % (CASE WHEN regexp_matches(word, '[.,]$') THEN 2000 ELSE 200 END) AS gap FROM (
      SELECT uid, role, unnest(l) AS word, (unnest(range(len(l))))::INTEGER AS word_id FROM (
        SELECT conv_id * 1000 + turn AS uid, role, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS l FROM conversations)))
  WINDOW w AS (PARTITION BY uid ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))""",
    "ctc_words": f"""ctc_words AS (SELECT uid, word_id, word, CASE WHEN u <> 0 THEN s END AS start_ms, CASE WHEN u <> 0 THEN greatest(s + 20, e) END AS end_ms FROM (
  SELECT uid, word_id, word, greatest(0, start_ms + {_h("'s:' || uid || ':' || word_id")} % 401 - 200) AS s, end_ms + {_h("'e:' || uid || ':' || word_id")} % 401 - 200 AS e, {_h("'u:' || uid || ':' || word_id")} % 10 AS u FROM words))""",
    "segments": f"""segments AS (SELECT uid, start_ms AS begin_ms, end_ms AS stop_ms FROM words WHERE role = 'system' UNION ALL SELECT uid, 0, 1500 FROM (SELECT DISTINCT uid FROM words) WHERE {_h("'seg:' || uid")} % 3 = 0)""",
    "grid": f"""grid AS (SELECT uid, frame, 20 * frame + 12.5::DOUBLE AS centre_ms, (frame % 17)::DOUBLE AS f0, ((7 * frame + uid) % 23)::DOUBLE AS f1, -({_h("'f:' || uid || ':' || frame")} % 1000 / 1000.0::DOUBLE) AS score FROM (
  SELECT uid, unnest(range(0, (max(end_ms) // 20 + 1)::BIGINT)) AS frame FROM words GROUP BY uid))""",
    "vecs": f"""vecs AS (SELECT vec_id // 10 AS uid, vec_id % 10 AS pos, vec_id, embedding AS vec, label, {_h("'v:' || vec_id")} % 5 <> 0 AS valid FROM embeddings)""",
    "cohort": "cohort AS (SELECT o_orderkey AS uid, o_custkey AS patient_id, c_mktsegment AS diagnosis, floor(o_totalprice)::BIGINT AS duration_ms FROM orders JOIN customer ON o_custkey = c_custkey)",
    "preds": f"""preds AS (SELECT uid, group_id, label, CASE WHEN {_h("'pred:' || uid")} % 4 = 0 THEN (label + 1) % 3 ELSE label END AS prediction, ({_h("'fold:' || uid")} % 5)::INTEGER AS fold FROM (
  SELECT o_orderkey AS uid, o_custkey AS group_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label FROM orders))""",
    "model_preds": "model_preds AS (SELECT uid, model, label, [a / (a + b + c), b / (a + b + c), c / (a + b + c)] AS proba FROM (SELECT uid, model, label, " + ", ".join(f"""(1 + {_h(f"'q{c}:' || uid || ':' || model")} % 1000)::DOUBLE AS {'abc'[c]}""" for c in range(3)) + " FROM preds, (SELECT unnest(range(5))::INTEGER AS model)))",
    "runs": f"runs AS (SELECT user_id AS trial, (event_id % 5)::INTEGER AS fold, {mean_sql('value')} AS score, max(value) AS train_score FROM events GROUP BY 1, 2)",
    "journal": "journal AS (SELECT user_id AS run, 100 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS metric, event_type <> 'error' AS eligible FROM events)",
}
_NEEDS = {"ctc_words": ["words"], "segments": ["words"], "grid": ["words"], "model_preds": ["preds"]}


def sql(tables: str, body: str, more: str = "") -> str:
    """`body` with the named derived tables (and further CTEs) before it."""
    names: list[str] = []
    for t in tables.split():
        names += [x for x in [*_NEEDS.get(t, []), t] if x not in names]
    ctes = [_SQL[n] for n in names] + ([more] if more else [])
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


def h_sql(expression: str) -> str:
    return _h(expression)
