"""Queries for grids, intervals and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalith.functions import timing as M
from vocalith.functions.text import ctc_form
from vocalith.operators import intervals as I
from vocalith.operators import transcripts as R
from vocalith.operators import vectors as V
from vocalith.plans import fixtures as X
from vocalith.plans.registry import query
from vocalith.plans.transcript_queries import _UNITS
from vocalith.sources.scans import scan_features
from vocalith.sources.storage import shared_path, shuffled

#: Kernels and strides of the stacked convolutions; the status words of the queries below are fixed too.
KERNELS, STRIDES = [10, 3, 3, 3, 3, 2, 2], [5, 2, 2, 2, 2, 2, 2]
DIM = 64


def _frames_sql(x: str) -> str:
    for k, s in zip(KERNELS, STRIDES):
        x = f"greatest(0, floor(({x} - {k}) / {s}.0) + 1)"
    return f"({x})::BIGINT"


@query("frame_timing", f"SELECT o_orderkey, 320 AS hop, 400 AS receptive_field, {_frames_sql('floor(o_totalprice)')} AS frame_count FROM orders")
def _(spark, d):
    return X.load(spark, d, "orders").select("o_orderkey", M.frame_timing(KERNELS, STRIDES, F.floor("o_totalprice")).alias("t")).select("o_orderkey", "t.*")


#: The frame grid of recordings in ms: 20 ms apart, 25 ms wide, the first centre at 12.5 ms.
def _grid(count="frame_count") -> M.Grid:
    return M.Grid(20.0, 25.0, 12.5, F.col(count))


def _frame_counts(w):
    return w.groupBy("uid").agg((F.floor(F.max("end_ms") / 20) + 1).alias("frame_count"))


def _counted(w):
    """words with their recording's frame_count."""
    return w.join(_frame_counts(w), "uid")


_COUNTS = "counts AS (SELECT uid, (max(end_ms) // 20 + 1)::BIGINT AS frame_count FROM words GROUP BY uid)"


def _bounds(s: str, e: str) -> str:
    b = lambda t: f"greatest(0, least(frame_count, ceil(({t} - 12.5::DOUBLE) / 20 - 1e-9)::BIGINT))"
    return f"{b(s)} AS f, {b(e)} AS l, greatest(0, least(frame_count - 1, floor((({s} + {e}) / 2.0::DOUBLE - 12.5) / 20 + 0.5)::BIGINT)) AS near"


_MAPPED = "mapped AS (SELECT uid, word_id, CASE WHEN f < l THEN f ELSE near END AS first, CASE WHEN f < l THEN l ELSE near + 1 END AS last, CASE WHEN f < l THEN 'frame_centers_in_interval' ELSE 'nearest_center_fallback' END AS method FROM (SELECT uid, word_id, {b} FROM {t} JOIN counts USING (uid) WHERE start_ms IS NOT NULL))"


@query("frame_interval", X.sql("grid", "SELECT uid, frame, 20.0::DOUBLE * frame AS start_ms, 20.0::DOUBLE * frame + 25 AS end_ms FROM grid"))
def _(spark, d):
    s, e = M.frame_interval(F.col("frame"), _grid())
    return X.grid(spark, d).select("uid", "frame", s.alias("start_ms"), e.alias("end_ms"))


@query("time_to_frame", X.sql("words", f"SELECT uid, word_id, CASE WHEN end_ms <= 30000 THEN greatest(0, least(frame_count - 1, floor((end_ms - 12.5::DOUBLE) / 20 + 0.5)::BIGINT)) END AS frame FROM words JOIN counts USING (uid)", _COUNTS))
def _(spark, d):
    return _counted(X.words(spark, d)).select("uid", "word_id", M.time_to_frame(F.col("end_ms"), _grid(), F.lit(30000)).alias("frame"))


@query("nearest_frame", X.sql("words", "SELECT uid, word_id, greatest(0, least(frame_count - 1, floor(((start_ms + start_ms + 5) / 2.0::DOUBLE - 12.5) / 20 + 0.5)::BIGINT)) AS frame FROM words JOIN counts USING (uid)", _COUNTS))
def _(spark, d):
    mid = (F.col("start_ms") + F.col("start_ms") + 5) / 2
    return _counted(X.words(spark, d)).select("uid", "word_id", M.nearest_frame(mid, _grid()).alias("frame"))


@query("map_frame_window", X.sql("words", """SELECT uid, word_id, CASE WHEN f < l THEN f ELSE near END AS first, CASE WHEN f < l THEN l ELSE near + 1 END AS last, CASE WHEN f < l THEN 'frame_centers_in_interval' ELSE 'nearest_center_fallback' END AS method FROM (
  SELECT uid, word_id, greatest(0, least(m, ceil((b - 30.0::DOUBLE) / 60 - 1e-9)::BIGINT)) AS f, greatest(0, least(m, ceil((e - 30.0::DOUBLE) / 60 - 1e-9)::BIGINT)) AS l, greatest(0, least(m - 1, floor(((b + e) / 2.0::DOUBLE - 30) / 60 + 0.5)::BIGINT)) AS near FROM (
    SELECT uid, word_id, frame_count // 3 + 1 AS m, 20.0::DOUBLE * s AS b, 20.0::DOUBLE * s + 25 AS e FROM (SELECT uid, word_id, start_ms // 20 AS s, frame_count FROM words JOIN counts USING (uid)) WHERE s < frame_count))""", _COUNTS))
def _(spark, d):
    w = _counted(X.words(spark, d)).withColumn("s", F.floor(F.col("start_ms") / 20)).withColumn("m", F.floor(F.col("frame_count") / 3) + 1)
    m = M.map_frame_window(F.col("s"), F.col("s") + 1, _grid(), M.Grid(60.0, 60.0, 30.0, F.col("m")))
    return w.select("uid", "word_id", m.alias("w")).where("w IS NOT NULL").select("uid", "word_id", "w.*")


@query("expand_context", X.sql("words", "SELECT uid, word_id, greatest(0, start_ms - 250) AS s, least(frame_count * 20, end_ms + 250) AS e FROM words JOIN counts USING (uid)", _COUNTS))
def _(spark, d):
    s, e = M.expand_context(F.col("start_ms"), F.col("end_ms"), F.col("frame_count") * 20, 250)
    return _counted(X.words(spark, d)).select("uid", "word_id", s.alias("s"), e.alias("e"))


@query("token_word_overlap", X.sql("words", """SELECT t.uid, t.token_id, CASE WHEN count(w.word_id) = 1 THEN min(w.word_id) END AS word_id, count(w.word_id) AS owners FROM (
  SELECT uid, unnest(range(n // 5 + 1)) AS token_id FROM (SELECT uid, max(char_start + length(word)) AS n FROM words GROUP BY uid)) t
  LEFT JOIN words w ON t.uid = w.uid AND 5 * t.token_id < w.char_start + length(w.word) AND w.char_start < 5 * t.token_id + 5 GROUP BY ALL"""))
def _(spark, d):
    """Tokens of five characters against the words they overlap."""
    w = R.char_offsets(X.words(spark, d))
    spans = w.select("uid", "word_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"))
    n = w.groupBy("uid").agg(F.max("char_end").alias("n"))
    tokens = n.select("uid", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 5))).alias("token_id")).select("uid", "token_id", (5 * F.col("token_id")).alias("start"), (5 * F.col("token_id") + 5).alias("end"))
    return I.token_word_overlap(tokens, spans)


@query("frames_in_interval", X.sql("grid", "SELECT m.uid, m.word_id, method, count(*) AS n, min(frame) AS first, max(frame) AS last, sum(f0) AS f0 FROM mapped m JOIN grid g ON m.uid = g.uid AND frame >= first AND frame < last GROUP BY ALL", _COUNTS + ", " + _MAPPED.format(b=_bounds("start_ms", "end_ms"), t="words")))
def _(spark, d):
    w = X.stored(X.words(spark, d), "words")
    counted = w.join(shuffled(_frame_counts(w)), "uid").select("uid", "word_id", "start_ms", "end_ms", "frame_count")
    hits = I.frames_in_interval(counted, X.grid(spark, d, w, blocks=True), _grid())
    return hits.groupBy("uid", "word_id", "method").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.sum("f0").alias("f0"))


@query("exclude_overlaps", X.sql("segments", "SELECT uid, word_id, word FROM words w WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.uid = w.uid AND w.end_ms >= begin_ms AND w.start_ms < stop_ms)"))
def _(spark, d):
    w = X.words(spark, d)
    return I.exclude_overlaps(w, X.segments(spark, d, w)).select("uid", "word_id", "word")


def compared(spark, d):
    w = X.stored(X.words(spark, d), "words")
    return I.boundary_delta(R.positional_join(w, X.ctc_words(spark, d, w)))


_CMP = "cmp AS (SELECT w.uid, w.word_id, w.word, c.start_ms IS NOT NULL AS there, round(abs(c.start_ms - w.start_ms) / 1000.0::DOUBLE, 6) AS start_delta, round(abs(c.end_ms - w.end_ms) / 1000.0::DOUBLE, 6) AS end_delta, round((c.start_ms - w.start_ms) / 1000.0::DOUBLE, 6) AS signed_start, round((c.end_ms - w.end_ms) / 1000.0::DOUBLE, 6) AS signed_end, CASE WHEN c.start_ms IS NOT NULL THEN greatest(abs(c.start_ms - w.start_ms), abs(c.end_ms - w.end_ms)) / 1000.0::DOUBLE > 0.2 + 1e-9 END AS flagged FROM words w JOIN ctc_words c ON w.uid = c.uid AND w.word_id = c.word_id)"


@query("boundary_delta", X.sql("ctc_words", "SELECT uid, word_id, start_delta, end_delta, signed_start, signed_end, flagged FROM cmp", _CMP))
def _(spark, d):
    return compared(spark, d).select("uid", "word_id", "start_delta", "end_delta", "signed_start", "signed_end", "flagged")


_SUMMARY = f"SELECT uid, count(start_delta) AS compared, count_if(start_delta IS NULL) AS without_interval, count_if(flagged) AS n_flagged, coalesce(list(word_id ORDER BY word_id) FILTER (flagged), []) AS flagged_ids, {X.mean_sql('start_delta')} AS mean_start, round(median(start_delta), 6) AS median_start, max(start_delta) AS max_start, {X.mean_sql('end_delta')} AS mean_end, round(median(end_delta), 6) AS median_end, max(end_delta) AS max_end FROM cmp GROUP BY uid"


@query("disagreement_summary", X.sql("ctc_words", _SUMMARY, _CMP))
def _(spark, d):
    return I.disagreement_summary(compared(spark, d))


@query("largest_discrepancies", X.sql("ctc_words", "SELECT uid, word_id, word, greatest(start_delta, end_delta) AS worst FROM cmp WHERE start_delta IS NOT NULL ORDER BY worst DESC, uid, word_id LIMIT 25", _CMP))
def _(spark, d):
    return I.largest_discrepancies(compared(spark, d), 25).select("uid", "word_id", "word", "worst")


@query("alignment_report", X.sql("ctc_words", "SELECT s.*, l.word_id AS worst_word, l.worst FROM (" + _SUMMARY + ") s LEFT JOIN (SELECT uid, word_id, greatest(start_delta, end_delta) AS worst FROM cmp WHERE start_delta IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uid ORDER BY worst DESC, word_id) = 1) l USING (uid)", _CMP))
def _(spark, d):
    """The summary of every recording, with its worst word."""
    c = compared(spark, d)
    worst = c.where("start_delta IS NOT NULL").groupBy("uid").agg(F.max(F.struct(F.greatest("start_delta", "end_delta").alias("worst"), (-F.col("word_id")).alias("k"))).alias("m"))
    return I.disagreement_summary(c).join(worst, "uid", "left").select("*", (-F.col("m.k")).alias("worst_word"), F.col("m.worst").alias("worst")).drop("m")


_WINDOWS = _UNITS + """, spans AS (SELECT uid, word_id, 2 * target_index AS s, 2 * target_index + 2 AS e FROM units WHERE owner >= 0), frames AS (SELECT uid, (2 * max(target_index) + 2)::BIGINT AS n FROM units GROUP BY uid),
ww AS (SELECT w.uid, w.word_id, CASE WHEN s IS NULL THEN 'no_ctc_units' ELSE 'aligned' END AS status, s AS start_frame, e AS end_frame, CASE WHEN s IS NOT NULL THEN greatest(0, s - 4) END AS exp_start_frame, CASE WHEN s IS NOT NULL THEN least(n, e + 4) END AS exp_end_frame, coalesce(units, 0) AS units
  FROM words w JOIN frames USING (uid) LEFT JOIN (SELECT uid, word_id, min(s) AS s, max(e) AS e, count(*) AS units FROM spans GROUP BY 1, 2) x ON w.uid = x.uid AND w.word_id = x.word_id)"""


def windows(spark, d):
    """Two frames to a unit, four of context."""
    w = X.words(spark, d)
    u = R.ctc_units(w, ctc_form("word", normalise=False))
    spans = u.where("owner >= 0").select("uid", F.col("owner").alias("word_id"), (2 * F.col("target_index")).alias("start_frame"), (2 * F.col("target_index") + 2).alias("end_frame"))
    return I.word_windows(spans, w, u.groupBy("uid").agg((2 * F.max("target_index") + 2).alias("frame_count")), 4)


@query("word_windows", X.sql("words", "SELECT * FROM ww", _WINDOWS))
def _(spark, d):
    return windows(spark, d)


@query("windows_monotonic", X.sql("words", "SELECT uid, count_if(a < x OR b < y) AS violations FROM (SELECT uid, CASE WHEN word_id % 40 = 39 THEN 0 ELSE exp_start_frame END AS a, exp_end_frame AS b, max(CASE WHEN word_id % 40 = 39 THEN 0 ELSE exp_start_frame END) OVER w AS x, max(exp_end_frame) OVER w AS y FROM ww WINDOW w AS (PARTITION BY uid ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY uid", _WINDOWS))
def _(spark, d):
    """With a planted fault: every 40th window begins at 0."""
    w = windows(spark, d).withColumn("exp_start_frame", F.when(F.col("word_id") % 40 == 39, F.lit(0)).otherwise(F.col("exp_start_frame")))
    return I.windows_monotonic(w)


@query("collapse_runs", "SELECT user_id, label, start::INTEGER AS start, stop::INTEGER AS \"end\", mean_score FROM (SELECT user_id, any_value(event_type) AS label, min(p) AS start, max(p) + 1 AS stop, round(avg(value), 6) AS mean_score FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM (SELECT user_id, event_id, event_type, value, row_number() OVER w - 1 AS p, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))) WHERE event_type <> 'view' GROUP BY user_id, r)")
def _(spark, d):
    return I.collapse_runs(X.load(spark, d, "events"), "user_id", "event_id", "event_type", "value", "view")


@query("path_score", X.sql("grid", "SELECT uid, round(sum(score), 6) AS total, round(sum(score) / count(*), 6) AS mean_log, round(exp(avg(score)), 6) AS confidence FROM grid GROUP BY uid"))
def _(spark, d):
    return I.path_score(X.grid(spark, d))


def _pool_sql(select: str, value: str = "{}") -> str:
    v = ", ".join(f"round(avg({value.format(f'f{i}')}), 6) AS v{i}" for i in (0, 1))
    return f"pool AS ({select}), means AS (SELECT p.uid, p.word_id, {v}, count(*) AS n FROM pool p JOIN grid g ON g.uid = p.uid AND frame >= first AND frame < last GROUP BY ALL)"


_POOLED = "SELECT w.uid, w.word_id, [coalesce(v0, 0), coalesce(v1, 0)] AS vec, coalesce(n, 0) AS n_frames, n IS NOT NULL AS valid FROM {t} w LEFT JOIN means m ON w.uid = m.uid AND w.word_id = m.word_id"


def pooled(spark, d, w, policy="centres", context=0.0):
    """Means of the frames of a stored table of words over the words' second intervals."""
    t = X.stored(X.ctc_words(spark, d, w).join(_frame_counts(w), "uid").select("uid", "word_id", "start_ms", "end_ms", "frame_count"), "windows")
    frames = X.grid(spark, d, w, blocks=True).select("uid", "block", "frame", F.array("f0", "f1").alias("vec"))
    return I.interval_mean_pool(t, frames, _grid(), 2, policy, context, F.col("frame_count") * 20.0)


def _pooled(spark, d, policy, context=0.0):
    return pooled(spark, d, X.stored(X.words(spark, d), "words"), policy, context)


_CTC_MAPPED = _COUNTS + ", " + _MAPPED.format(b=_bounds("start_ms", "end_ms"), t="ctc_words")


@query("interval_mean_pool", X.sql("grid ctc_words", _POOLED.format(t="ctc_words"), _CTC_MAPPED + ", " + _pool_sql("SELECT * FROM mapped")))
def _(spark, d):
    return _pooled(spark, d, "centres")


@query("interval_mean_pool_context", X.sql("grid ctc_words", _POOLED.format(t="ctc_words"), _COUNTS + ", wide AS (SELECT uid, word_id, greatest(0, start_ms - 100.0::DOUBLE) AS start_ms, least(frame_count * 20.0::DOUBLE, end_ms + 100.0) AS end_ms FROM ctc_words JOIN counts USING (uid) WHERE start_ms IS NOT NULL), " + _MAPPED.format(b=_bounds("start_ms", "end_ms"), t="wide") + ", " + _pool_sql("SELECT * FROM mapped")))
def _(spark, d):
    return _pooled(spark, d, "centres", 100.0)


_INCLUSIVE = "SELECT uid, word_id, start_ms // 20 AS first, least(frame_count, end_ms // 20 + 1) AS last FROM ctc_words JOIN counts USING (uid) WHERE start_ms < end_ms"


@query("interval_mean_pool_inclusive", X.sql("grid ctc_words", _POOLED.format(t="ctc_words"), _COUNTS + ", " + _pool_sql(_INCLUSIVE)))
def _(spark, d):
    return _pooled(spark, d, "inclusive")


@query("interval_mean_pool_short", X.sql("grid ctc_words", _POOLED.format(t="ctc_words"), _COUNTS + ", " + _pool_sql(f"SELECT uid, word_id, CASE WHEN last - first < 3 THEN greatest(0, first - 2) ELSE first END AS first, CASE WHEN last - first < 3 THEN least(frame_count, last + 2) ELSE last END AS last FROM ({_INCLUSIVE}) JOIN counts USING (uid)", "least(1000, greatest(-1000, {}))")))
def _(spark, d):
    return _pooled(spark, d, "short_expand")


# --- vectors

_L = f"(SELECT list(x ORDER BY i) FROM (SELECT i, {{}} AS x FROM (SELECT unnest(range(1, {DIM} + 1)) AS i)))"


def _long(where: str = "true", extra: str = "") -> str:
    return f"long AS (SELECT uid, pos, vec_id, valid, unnest(range(1, {DIM} + 1)) AS i, unnest(vec)::DOUBLE AS x{extra} FROM vecs WHERE {where})"


def _wrap(inner: str, keys: str = "uid") -> str:
    """Elementwise values (keys, i, v) back into arrays."""
    return f"SELECT {keys}, list(v ORDER BY i) AS vec FROM ({inner}) GROUP BY {keys}"


@query("zero_invalid", X.sql("vecs", "SELECT vec_id, CASE WHEN valid THEN vec[1:4] ELSE [0, 0, 0, 0]::FLOAT[] END AS head, NOT valid AND len(list_filter(vec, lambda x: x <> 0)) > 0 AS was_nonzero FROM vecs"))
def _(spark, d):
    return V.zero_invalid(X.vecs(spark, d)).select("vec_id", F.slice("vec", 1, 4).alias("head"), "was_nonzero")


@query("scan_features", X.sql("vecs", "SELECT uid, count(*) AS rows, min(len(vec))::INTEGER AS width_min, max(len(vec))::INTEGER AS width_max, count_if(len(list_filter(vec, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite, CASE WHEN min(len(vec)) <> max(len(vec)) THEN 'width' END AS problem FROM (SELECT uid, CASE WHEN vec_id % 100 = 7 THEN vec[1:63] ELSE vec END AS vec FROM vecs) GROUP BY uid"))
def _(spark, d):
    """With a planted fault: every 100th vector is one value short."""
    path = shared_path(spark, "features")
    X.vecs(spark, d).withColumn("vec", F.when(F.col("vec_id") % 100 == 7, F.slice("vec", 1, 63)).otherwise(F.col("vec"))).write.parquet(path)
    return scan_features(spark, path)[1]


@query("masked_mean_pool", X.sql("vecs", _wrap(f"SELECT uid, i, {X.ratio_sql('coalesce(sum(CASE WHEN valid THEN round(x * 1e12)::HUGEINT END), 0)', 'greatest(count_if(valid), 1) * 1000000')} AS v FROM long GROUP BY 1, 2"), _long()))
def _(spark, d):
    return V.masked_mean_pool(X.vecs(spark, d), DIM)


@query("subword_mean_pool", X.sql("vecs", f"SELECT a.uid, a.word_id, vec, subwords, unknowns FROM ({_wrap('SELECT uid, pos // 3 AS word_id, i, ' + X.mean_sql('x') + ' AS v FROM long GROUP BY 1, 2, 3', 'uid, word_id')}) a JOIN (SELECT uid, pos // 3 AS word_id, count(*) AS subwords, count_if(NOT valid) AS unknowns FROM vecs WHERE pos < 9 GROUP BY 1, 2) b ON a.uid = b.uid AND a.word_id = b.word_id", _long("pos < 9")))
def _(spark, d):
    """Three subwords to a word; the last position is a special token."""
    v = X.vecs(spark, d).withColumn("word_id", F.when(F.col("pos") < 9, F.floor(F.col("pos") / 3))).withColumn("unknown", ~F.col("valid"))
    return V.subword_mean_pool(v, DIM)


@query("recording_summary_vector", X.sql("vecs", f"SELECT uid, 0 AS pos, vec FROM ({_wrap('SELECT uid, i, ' + X.mean_sql('x') + ' AS v FROM long GROUP BY 1, 2')})", _long()))
def _(spark, d):
    return V.recording_summary_vector(X.vecs(spark, d), DIM)


_QUERY = [round(0.1 * ((i * 7) % 11) - 0.5, 6) for i in range(DIM)]


_SHARE = "sum(w * round(x * 1e12)::HUGEINT)", "sum(w) * 1000000"


@query("attention_pool", X.sql("vecs", _wrap(f"SELECT uid, i, coalesce({X.ratio_sql(*_SHARE)}, 0) AS v FROM (SELECT l.uid, l.i, l.x, CASE WHEN l.valid THEN round(exp(s - max(CASE WHEN l.valid THEN s END) OVER (PARTITION BY l.uid)) * 1e12)::HUGEINT ELSE 0 END AS w FROM long l JOIN scores USING (vec_id)) GROUP BY 1, 2"), _long() + f", q AS (SELECT unnest({_QUERY}::DOUBLE[]) AS q, unnest(range(1, {DIM} + 1)) AS i), scores AS (SELECT vec_id, sum(round(x * q * 1e12)::HUGEINT) / 1e12 AS s FROM long JOIN q USING (i) GROUP BY 1)"))
def _(spark, d):
    return V.attention_pool(X.vecs(spark, d), _QUERY)


@query("layer_mix", X.sql("vecs", _wrap(f"SELECT uid, pos, i, {X.ratio_sql('sum(round((CASE WHEN valid THEN a ELSE b END) * 1e12)::HUGEINT * round(x * 1e12)::HUGEINT)', '1000000000000000000')} AS v FROM (SELECT uid // 2 AS uid, pos, uid % 2 = 0 AS valid, i, x, exp(-0.5::DOUBLE) / (exp(-0.5::DOUBLE) + 1) AS a, 1 / (exp(-0.5::DOUBLE) + 1) AS b FROM long) GROUP BY 1, 2, 3", "uid, pos"), _long()))
def _(spark, d):
    """Two recordings' vectors stand for two layers."""
    v = X.vecs(spark, d).withColumn("layer", F.col("uid") % 2).withColumn("uid", F.floor(F.col("uid") / 2))
    return V.layer_mix(v, [0.5, 1.0], DIM)


#: Products count to 12 digits, halves up: the sum is in units of 1e-24, and 1e32 of them are added, so that the division rounds down.
_PAIRS = "pairs AS (SELECT uid, pos, other, (n + 500000000000 + 100000000000000000000000000000000::HUGEINT) // 1000000000000 - 100000000000000000000::HUGEINT AS s FROM (SELECT a.uid, a.pos, b.pos AS other, sum(round(a.x * 1e12)::HUGEINT * round(b.x * 1e12)::HUGEINT) AS n FROM long a JOIN long b ON a.uid = b.uid AND a.i = b.i GROUP BY 1, 2, 3)), tops AS (SELECT uid, pos, max(s) AS m FROM pairs GROUP BY 1, 2)"


@query("self_attention", X.sql("vecs", _wrap(f"SELECT uid, pos, i, {X.ratio_sql(*_SHARE)} AS v FROM (SELECT p.uid, p.pos, l.i, l.x, round(exp((p.s - m) / 1e12) * 1e12)::HUGEINT AS w FROM pairs p JOIN tops t ON p.uid = t.uid AND p.pos = t.pos JOIN long l ON l.uid = p.uid AND l.pos = p.other) GROUP BY 1, 2, 3", "uid, pos"), _long() + ", " + _PAIRS))
def _(spark, d):
    return V.self_attention(X.vecs(spark, d), DIM)


def _scores(spark, d):
    return X.vecs(spark, d).select("vec_id", F.transform(F.slice("vec", 1, 4), lambda x: x.cast("double") * 8).alias("s"))


_S4 = "s AS (SELECT vec_id, [vec[1]::DOUBLE * 8, vec[2]::DOUBLE * 8, vec[3]::DOUBLE * 8, vec[4]::DOUBLE * 8] AS s FROM vecs), z AS (SELECT vec_id, s, list_max(s) + ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) AS z FROM s)"


@query("softmax", X.sql("vecs", "SELECT vec_id, list_transform(s, lambda x: round(exp(x - z), 6)) AS p, list_transform(s, lambda x: round(x - z, 6)) AS logp FROM z", _S4))
def _(spark, d):
    return _scores(spark, d).select("vec_id", V.rounded(V.softmax(F.col("s"))).alias("p"), V.rounded(V.log_softmax(F.col("s"))).alias("logp"))


@query("thresholded_argmax", X.sql("vecs", "SELECT vec_id, (CASE WHEN m - z >= -0.9::DOUBLE THEN list_position(s, m) ELSE list_position(s, list_sort(s, 'DESC')[2]) END - 1)::INTEGER AS class FROM (SELECT *, list_max(s) AS m FROM z)", _S4))
def _(spark, d):
    return _scores(spark, d).select("vec_id", V.thresholded_argmax(V.log_softmax(F.col("s")), [-0.9] * 4).alias("class"))


@query("argmax_class", X.sql("vecs", "SELECT vec_id, (list_position(s, list_max(s)) - 1)::INTEGER AS class FROM s", _S4))
def _(spark, d):
    return _scores(spark, d).select("vec_id", V.argmax_class(F.col("s")).alias("class"))


@query("logsumexp_check", X.sql("vecs", "SELECT vec_id, vec_id % 10 <> 3 AS normalised FROM vecs", _S4))
def _(spark, d):
    """With a planted fault: every tenth row is shifted by 0.01."""
    logp = F.transform(V.log_softmax(F.col("s")), lambda x: x + F.when(F.col("vec_id") % 10 == 3, 0.01).otherwise(0.0))
    return _scores(spark, d).select("vec_id", V.normalised(logp).alias("normalised"))


@query("position_encoding", X.sql("words", "SELECT uid, word_id, [round(sin(word_id::DOUBLE), 6), round(cos(word_id::DOUBLE), 6), round(sin(word_id * exp(-ln(10000.0::DOUBLE) * 0.5)), 6), round(cos(word_id * exp(-ln(10000.0::DOUBLE) * 0.5)), 6)] AS code FROM words"))
def _(spark, d):
    return X.words(spark, d).select("uid", "word_id", V.rounded(V.position_encoding("word_id", 4)).alias("code"))


@query("pad_or_crop", "SELECT vec_id, list_concat(embedding[1:n], list_transform(range(70 - least(n, 70)), lambda x: 0::FLOAT))[1:70] AS padded, list_transform(range(70), lambda k: embedding[(k % n + 1)::INTEGER]) AS repeated FROM (SELECT vec_id, embedding, (vec_id % 50 + 1)::BIGINT AS n FROM embeddings)")
def _(spark, d):
    v = X.load(spark, d, "embeddings").withColumn("v", F.slice("embedding", 1, (F.col("vec_id") % 50 + 1).cast("int")))
    return v.select("vec_id", V.pad_or_crop(F.col("v"), 70).alias("padded"), V.pad_or_crop(F.col("v"), 70, "repetition_pad").alias("repeated"))
