"""Queries for the transcript operators and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalith.functions import text as T
from vocalith.functions.sql_names import register_all
from vocalith.operators import sequential as Q
from vocalith.operators import transcripts as R
from vocalith.plans import fixtures as X
from vocalith.plans.registry import query

#: Every seventh word with its accents written as marks of their own, which NFC puts together.
_APART = "apart AS (SELECT * REPLACE (CASE WHEN word_id % 7 = 3 THEN replace(replace(word, 'é', 'e' || chr(769)), 'ä', 'a' || chr(776)) ELSE word END AS word) FROM words)"
LETTERS = [*"abcdefghijklmnopqrstuvwxyz", "ä", "ö", "ü", "ß", "é", "è", "ê", "ç", "à", "ñ", "í", "ó", "á", "ú"]
FEW = [*"abcdefghiklmnoprstuvw", "é", "è", "ñ"]
_FEW = "'[" + "".join(FEW) + "]'"
_FORM = r"regexp_replace(nfc_normalize(lower(trim(word))), '\p{P}', '', 'g')"
#: The first character of the form that FEW does not have.
_BAD = f"nullif(substr(regexp_replace({_FORM}, {_FEW}, '', 'g'), 1, 1), '')"


def _apart(w):
    marks = F.replace(F.replace(F.col("word"), F.lit("é"), F.lit("e\u0301")), F.lit("ä"), F.lit("a\u0308"))
    return w.withColumn("word", F.when(F.col("word_id") % 7 == 3, marks).otherwise(F.col("word")))


@query("char_offsets", X.sql("words", "SELECT uid, word_id, char_start, char_start + length(word) AS char_end FROM words"))
def _(spark, d):
    return R.char_offsets(X.words(spark, d).drop("char_start")).select("uid", "word_id", "char_start", "char_end")


@query("valid_interval", X.sql("words", "SELECT uid, word_id, start_ms >= 0 AND start_ms <= end_ms AND prob BETWEEN 0 AND 1 AND end_ms / 1000.0 <= (SELECT 20000 / 1000.0) + 0.05 AS valid FROM words"))
def _(spark, d):
    return R.valid_interval(X.words(spark, d).withColumn("duration", F.lit(20000)), "duration").select("uid", "word_id", "valid")


@query("audit_records", X.sql("words", f"""SELECT uid, word_id, 'unsupported character' AS problem FROM apart WHERE {_BAD} IS NOT NULL
  UNION ALL SELECT uid, word_id, 'bad time' FROM words WHERE end_ms - start_ms >= 600 UNION ALL SELECT uid, word_id, 'bad probability' FROM words WHERE prob > 0.99
  UNION ALL SELECT conv_id * 1000 + turn + 500, NULL, 'missing words' FROM conversations WHERE turn = 0
  UNION ALL SELECT uid, NULL, 'no alignable word' FROM apart GROUP BY uid HAVING max(length({_FORM})) = 0""", _APART))
def _(spark, d):
    """With planted faults: long words get a bad interval, high probabilities go over 1, and some recordings have no words."""
    w = _apart(X.words(spark, d))
    w = w.withColumn("end_ms", F.when(F.col("end_ms") - F.col("start_ms") >= 600, F.col("start_ms") - 1).otherwise(F.col("end_ms"))).withColumn("prob", F.when(F.col("prob") > 0.99, 1.5).otherwise(F.col("prob")))
    c = X.load(spark, d, "conversations")
    uid = F.col("conv_id") * 1000 + F.col("turn")
    recordings = w.select("uid").distinct().unionByName(c.where("turn = 0").select((uid + 500).alias("uid")))
    return R.audit_records(w, recordings, FEW)


@query("monotonic_starts", "SELECT user_id, coalesce(bool_or(b), false) AS backwards FROM (SELECT user_id, value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) GROUP BY 1")
def _(spark, d):
    return R.monotonic_starts(X.load(spark, d, "events"), "user_id", "event_id", "value")


@query("prefix_limit", X.sql("words", "SELECT uid, word_id, word FROM words WHERE word_id < 10"))
def _(spark, d):
    return R.prefix_limit(X.words(spark, d), 10).select("uid", "word_id", "word")


@query("paired_mask", X.sql("ctc_words", "SELECT uid, word_id, prob >= 0.2 AS valid_0, start_ms IS NOT NULL AS valid_1, prob >= 0.2 AND c.start_ms IS NOT NULL AS valid FROM words JOIN (SELECT uid, word_id, start_ms FROM ctc_words) c USING (uid, word_id)".replace("start_ms IS NOT NULL AS valid_1", "c.start_ms IS NOT NULL AS valid_1")))
def _(spark, d):
    w = X.words(spark, d)
    return R.paired_mask(w.select("uid", "word_id", (F.col("prob") >= 0.2).alias("valid")), X.ctc_words(spark, d, w).select("uid", "word_id", F.col("start_ms").isNotNull().alias("valid")))


@query("token_masks", X.sql("words", "SELECT uid, word_id, prob > 0.1 AS text_valid, word_id = 0 OR (prob > 0.1 AND length(word) > 1) AS audio_valid FROM words"))
def _(spark, d):
    w = R.char_offsets(X.words(spark, d)).withColumn("char_end", F.when(F.length("word") > 1, F.col("char_end")).otherwise(F.col("char_start")))
    return R.token_masks(w.withColumn("attention", F.col("prob") > 0.1)).select("uid", "word_id", "text_valid", "audio_valid")


@query("positional_join", X.sql("ctc_words", "SELECT w.uid, w.word_id, w.start_ms, c.start_ms AS other_start, c.end_ms AS other_end, w.word_id % 50 = 49 AS mismatch FROM words w JOIN ctc_words c ON w.uid = c.uid AND w.word_id = c.word_id"))
def _(spark, d):
    w = X.words(spark, d)
    other = X.ctc_words(spark, d, w).withColumn("word", F.when(F.col("word_id") % 50 == 49, F.concat("word", F.lit("?"))).otherwise(F.col("word")))
    return R.positional_join(w, other).select("uid", "word_id", "start_ms", "other_start", "other_end", "mismatch")


@query("pause_gaps", X.sql("words", "SELECT uid, word_id, greatest(0, coalesce(start_ms - lag(end_ms) OVER (PARTITION BY uid ORDER BY word_id), 0)) AS gap_ms FROM words"))
def _(spark, d):
    return R.pause_gaps(X.words(spark, d)).select("uid", "word_id", "gap_ms")


@query("temporal_features", X.sql("ctc_words", """SELECT uid, word_id, CASE WHEN s IS NOT NULL THEN round(ln(1 + (e - s) / 1000.0::DOUBLE), 6) END AS log_duration, CASE WHEN s IS NOT NULL THEN round(ln(1 + g / 1000.0::DOUBLE), 6) END AS log_gap,
  CASE WHEN s IS NOT NULL THEN round(ln(1 + n / greatest((b - a) / 1000.0::DOUBLE, 0.02)), 6) END AS log_rate FROM (
  SELECT uid, word_id, start_ms AS s, end_ms AS e, greatest(0, coalesce(start_ms - lag(end_ms) OVER o, 0)) AS g, count(start_ms) OVER w AS n, min(start_ms) OVER w AS a, max(end_ms) OVER w AS b FROM ctc_words
  WINDOW o AS (PARTITION BY uid ORDER BY word_id), w AS (PARTITION BY uid ORDER BY word_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""))
def _(spark, d):
    return R.temporal_features(X.ctc_words(spark, d))


_GAP = "gaps AS (SELECT uid, word_id, word, start_ms, end_ms, lag(end_ms) OVER (PARTITION BY uid ORDER BY word_id) AS e FROM words)"


@query("transcript_with_pauses", X.sql("words", "SELECT uid, string_agg(CASE WHEN g > 1.5 THEN '... ' WHEN g >= 1 THEN '. ' WHEN g >= 0.5 THEN ', ' ELSE '' END || word, ' ' ORDER BY word_id) AS text FROM (SELECT *, greatest(0, coalesce(start_ms - e, 0)) / 1000.0::DOUBLE AS g FROM gaps) GROUP BY uid", _GAP))
def _(spark, d):
    return R.transcript_with_pauses(X.words(spark, d))


@query("transcript_with_pauses_v0", X.sql("words", "SELECT uid, string_agg(word || CASE WHEN e > 0 AND g > 2 THEN ' ...' WHEN e > 0 AND g > 1 THEN ' .' WHEN e > 0 AND g > 0.5 THEN ' ,' ELSE '' END, ' ' ORDER BY word_id) AS text FROM (SELECT *, (start_ms - e) / 1000.0::DOUBLE AS g FROM gaps) GROUP BY uid", _GAP))
def _(spark, d):
    return R.transcript_with_pauses_v0(X.words(spark, d))


@query("pause_symbol", X.sql("words", "SELECT uid, word_id, CASE WHEN g > 1.5 THEN '...' WHEN g >= 1 THEN '.' WHEN g >= 0.5 THEN ',' ELSE '' END AS symbol FROM (SELECT *, greatest(0, coalesce(start_ms - e, 0)) / 1000.0::DOUBLE AS g FROM gaps)", _GAP))
def _(spark, d):
    return R.pause_gaps(X.words(spark, d)).select("uid", "word_id", T.pause_symbol(F.col("gap_ms") / 1000.0).alias("symbol"))


@query("punctuation_gap", X.sql("words", """SELECT uid, word_id, CASE WHEN lex THEN start_ms ELSE b END AS gap_start, CASE WHEN lex THEN end_ms ELSE greatest(b, coalesce(s, last)) END AS gap_end FROM (
  SELECT *, coalesce(last_value(CASE WHEN lex THEN end_ms END IGNORE NULLS) OVER (PARTITION BY uid ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
    first_value(CASE WHEN lex THEN start_ms END IGNORE NULLS) OVER (PARTITION BY uid ORDER BY word_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS s, max(end_ms) OVER (PARTITION BY uid) AS last
  FROM (SELECT *, NOT regexp_matches(word, '[.,]$') AS lex FROM words))"""))
def _(spark, d):
    from pyspark.sql.window import Window as W

    w = X.words(spark, d)
    return R.punctuation_gap(w, ~F.col("word").rlike("[.,]$"), F.max("end_ms").over(W.partitionBy("uid")))


# --- text functions


@query("nfc", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def _(spark, d):
    return X.load(spark, d, "documents").select("doc_id", T.nfc("text").alias("text"))


@query("clean_text", r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{M}\p{N}_\s.,!?''" + '"' + r"¿¡·’\-]', '', 'g') AS text FROM documents")
def _(spark, d):
    return X.load(spark, d, "documents").select("doc_id", T.clean_text("text").alias("text"))


@query("ctc_form", X.sql("words", rf"SELECT uid, word_id, regexp_replace(nfc_normalize(lower(trim(word))), '\p{{P}}', '', 'g') AS form FROM words"))
def _(spark, d):
    return X.words(spark, d).select("uid", "word_id", T.ctc_form("word").alias("form"))


@query("unsupported_chars", X.sql("words", f"SELECT uid, word_id, {_BAD} AS bad FROM apart", _APART))
def _(spark, d):
    return _apart(X.words(spark, d)).select("uid", "word_id", T.unsupported_chars(T.ctc_form("word"), FEW).alias("bad"))


@query("skip_unsupported", X.sql("words", f"SELECT uid, word_id, word, CASE WHEN {_BAD} IS NULL THEN {_FORM} ELSE '' END AS form, {_BAD} AS reason FROM apart", _APART))
def _(spark, d):
    return R.skip_unsupported(_apart(X.words(spark, d)), FEW).select("uid", "word_id", "word", "form", "reason")


_UNITS = f"""forms AS (SELECT uid, word_id, {_FORM} AS form FROM words WHERE {_FORM} <> ''),
placed AS (SELECT uid, word_id, CASE WHEN row_number() OVER w = 1 THEN form ELSE '|' || form END AS piece, row_number() OVER w = 1 AS first FROM forms WINDOW w AS (PARTITION BY uid ORDER BY word_id)),
units AS (SELECT uid, (base + k)::BIGINT AS target_index, piece[k + 1] AS token, CASE WHEN NOT first AND k = 0 THEN -1 ELSE word_id END AS owner, word_id FROM (
  SELECT *, unnest(range(length(piece))) AS k FROM (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY uid ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM placed)))"""


def _units(spark, d, w=None):
    return R.ctc_units(X.words(spark, d) if w is None else w, T.ctc_form("word"))


@query("ctc_units", X.sql("words", "SELECT uid, target_index, token, owner::INTEGER AS owner FROM units", _UNITS))
def _(spark, d):
    return _units(spark, d)


@query("minimum_frames", X.sql("words", "SELECT uid, count(*) AS targets, (count(*) + count_if(same))::BIGINT AS frames FROM (SELECT uid, token = lag(token) OVER (PARTITION BY uid ORDER BY target_index) AS same FROM units) GROUP BY uid", _UNITS))
def _(spark, d):
    return R.minimum_frames_of(X.words(spark, d), T.ctc_form("word"))


@query("unit_sync", X.sql("words", "SELECT uid, target_index, owner::INTEGER AS owner, 2 * target_index AS start_frame, target_index % 97 <> 5 AS agrees FROM units", _UNITS))
def _(spark, d):
    u = _units(spark, d)
    spans = u.select("uid", "target_index", F.when(F.col("target_index") % 97 == 5, "?").otherwise(F.col("token")).alias("token"), (2 * F.col("target_index")).alias("start_frame"))
    return R.unit_sync(u, spans).select("uid", "target_index", "owner", "start_frame", "agrees")


@query("vocab_alias", "SELECT segment, string_agg(k, ',' ORDER BY k) AS a FROM (SELECT DISTINCT c_mktsegment AS segment, CASE WHEN length(k) = 1 THEN lower(k) ELSE k END AS k FROM (SELECT c_mktsegment, unnest([upper(substr(c_name, (1 + c_custkey % 9)::INTEGER, 1)), substr(c_name, 1, 4)]) AS k FROM customer)) GROUP BY segment")
def _(spark, d):
    """One vocabulary a market segment, of the letters in its customers' names (upper case) and their first four characters."""
    c = X.load(spark, d, "customer")
    entry = F.explode(F.array(F.upper(F.substring(F.col("c_name"), (1 + F.col("c_custkey") % 9).cast("int"), F.lit(1))), F.substring("c_name", 1, 4)))
    keys = c.select(F.col("c_mktsegment").alias("segment"), entry.alias("k")).distinct().groupBy("segment").agg(F.map_from_arrays(F.collect_list("k"), F.collect_list(F.lit(0))).alias("vocabulary"))
    return keys.where(F.size(T.vocab_collisions(F.col("vocabulary"))) == 0).select("segment", F.array_join(F.array_sort(F.map_keys(T.vocab_alias(F.col("vocabulary")))), ",").alias("a"))


@query("lexical_words", r"SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS lexical FROM conversations")
def _(spark, d):
    return X.load(spark, d, "conversations").select("conv_id", "turn", T.lexical_words("text").alias("lexical"))


_LEXICAL = r"""lexical AS (SELECT uid, text, l, len(l) AS n FROM (SELECT conv_id * 1000 + turn AS uid, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS l FROM conversations)),
found AS (SELECT uid, -1 AS word_id, 1 AS cursor, 0 AS pos, false AS recased, false AS skipped FROM lexical WHERE n > 0 UNION ALL
  SELECT uid, word_id, CASE WHEN pos > 0 THEN pos + length(word) ELSE cursor END, pos, pos > 0 AND substr(text, pos, length(word)) <> word, pos > 0 AND regexp_matches(substr(text, cursor, pos - cursor), '[\p{L}\p{N}]') FROM (
    SELECT uid, word_id, text, word, cursor, CASE WHEN p > 0 THEN p + cursor - 1 ELSE 0 END AS pos FROM (
      SELECT f.uid, f.word_id + 1 AS word_id, text, l[f.word_id + 2] AS word, cursor, instr(substr(lower(text), cursor), lower(l[f.word_id + 2])) AS p FROM found f JOIN lexical x ON f.uid = x.uid WHERE f.word_id + 1 < n)))"""


@query("match_words", f"WITH RECURSIVE {_LEXICAL} SELECT uid, word_id, pos::INTEGER AS \"at\", recased, skipped FROM found WHERE word_id >= 0")
def _(spark, d):
    """Every lexical word of a turn against the turn's text."""
    t = X.load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), "text")
    w = t.select("uid", F.posexplode(T.lexical_words("text")).alias("word_id", "word"))
    return Q.match_words(t, w)


_PACKED = """costs AS (SELECT uid, word_id, length(word) AS c FROM words),
packed AS (SELECT DISTINCT uid, -1 AS word_id, 0 AS last, 0::BIGINT AS used, NULL::INTEGER AS chunk FROM words UNION ALL
  SELECT c.uid, c.word_id, CASE WHEN c > 64 OR used + c <= 64 THEN last ELSE last + 1 END, CASE WHEN c > 64 THEN used WHEN used + c <= 64 THEN used + c ELSE c END, CASE WHEN c > 64 THEN NULL WHEN used + c <= 64 THEN last ELSE last + 1 END
  FROM packed p JOIN costs c ON p.uid = c.uid AND c.word_id = p.word_id + 1)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("word_chunks", _recursive(X.sql("words", "SELECT uid, word_id, chunk FROM packed WHERE word_id >= 0", _PACKED)))
def _(spark, d):
    w = X.words(spark, d).withColumn("cost", F.length("word"))
    return Q.word_chunks(w, "cost", 64)


@query("word_packer", _recursive(X.sql("words", "SELECT uid, word_id AS position, chunk FROM packed WHERE word_id >= 0", _PACKED)))
def _(spark, d):
    """The packing as a table function, called from SQL."""
    register_all(spark)
    X.words(spark, d).createOrReplaceTempView("vocalith_words")
    costs = "SELECT uid, transform(array_sort(collect_list(struct(word_id, length(word) AS c))), x -> x.c) AS costs FROM vocalith_words GROUP BY uid"
    return spark.sql(f"SELECT uid, position, chunk FROM ({costs}) w, LATERAL word_packer(w.costs, 64)")


@query("word_matcher", f"WITH RECURSIVE {_LEXICAL} SELECT uid, word_id AS position, pos::INTEGER AS \"at\", recased, skipped FROM found WHERE word_id >= 0")
def _(spark, d):
    """The matching as a table function, called from SQL."""
    register_all(spark)
    t = X.load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), "text", T.lexical_words("text").alias("lexical"))
    t.createOrReplaceTempView("vocalith_texts")
    return spark.sql("SELECT uid, position, at, recased, skipped FROM vocalith_texts t, LATERAL word_matcher(t.text, t.lexical)")


@query("format_number", "SELECT event_id, CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END AS text FROM (SELECT event_id, round(value * 2) / 2 AS v FROM events)")
def _(spark, d):
    return X.load(spark, d, "events").select("event_id", T.format_number(F.floor(F.col("value") * 2 + 0.5) / 2.0).alias("text"))


@query("txt_name", "SELECT page_id, regexp_replace(url || '.wav', '\\.wav$', '.txt') AS name FROM pages")
def _(spark, d):
    return X.load(spark, d, "pages").select("page_id", T.txt_name(F.concat("url", F.lit(".wav"))).alias("name"))


@query("uid_from_path", "SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') AS uid, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(?i)\\.(html|wav)$', '') AS uid_known FROM pages")
def _(spark, d):
    return X.load(spark, d, "pages").select("page_id", T.uid_from_path("url").alias("uid"), T.uid_from_path("url", ["html", "wav"]).alias("uid_known"))


@query("classify_path", "SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'speech' WHEN contains(url, '/de/') THEN 'noise' WHEN contains(url, '/fr/') THEN 'music' END AS kind FROM pages")
def _(spark, d):
    return X.load(spark, d, "pages").select("page_id", T.classify_path("url", [("/en/", "speech"), ("/de/", "noise"), ("/fr/", "music")]).alias("kind"))


@query("report_line", X.sql("ctc_words", "SELECT w.uid, w.word_id, rpad(substr(w.word, 1, 16), 16, ' ') || printf('%9.3f', w.start_ms / 1000.0::DOUBLE) || printf('%9.3f', w.end_ms / 1000.0::DOUBLE) || CASE WHEN c.start_ms IS NULL THEN '        -' ELSE printf('%9.3f', c.start_ms / 1000.0::DOUBLE) END || CASE WHEN c.end_ms IS NULL THEN '        -' ELSE printf('%9.3f', c.end_ms / 1000.0::DOUBLE) END AS line FROM words w JOIN ctc_words c ON w.uid = c.uid AND w.word_id = c.word_id"))
def _(spark, d):
    w = X.words(spark, d)
    j = R.positional_join(w, X.ctc_words(spark, d, w))
    seconds = lambda c: F.col(c) / 1000.0
    return j.select("uid", "word_id", T.report_line("word", seconds("start_ms"), seconds("end_ms"), seconds("other_start"), seconds("other_end")).alias("line"))


# --- chunks, corruption


@query("token_chunks", X.sql("words", "SELECT uid, word_id, (word_id // 14)::INTEGER AS chunk, (word_id % 14 + 1)::INTEGER AS slot FROM words"))
def _(spark, d):
    return R.token_chunks(X.words(spark, d), 16).select("uid", "word_id", "chunk", "slot")


_H = X.h_sql
_CORRUPT = f"""vocab AS (SELECT (row_number() OVER (ORDER BY s) - 1)::BIGINT AS i, s AS entry FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)), nv AS (SELECT count(*) AS v FROM vocab),
ranked AS (SELECT uid, word_id, word, row_number() OVER (PARTITION BY uid ORDER BY md5('site:7:' || uid || ':' || word_id), word_id) - 1 AS r, count(*) OVER (PARTITION BY uid) AS n FROM words),
drawn AS (SELECT *, CASE WHEN r < floor(n * 20 / 100.0 + 0.5) THEN ['substitute', 'delete', 'insert'][(r % 3 + 1)::INTEGER] ELSE 'keep' END AS op, {_H("'word:7:' || uid || ':' || word_id")} % v AS i FROM ranked, nv),
named AS (SELECT d.*, CASE WHEN a.entry = d.word THEN b.entry ELSE a.entry END AS new FROM drawn d JOIN vocab a ON d.i = a.i JOIN vocab b ON (d.i + 1) % (SELECT v FROM nv) = b.i),
corrupted AS (SELECT uid, word_id, op, 0 AS place, CASE WHEN op = 'substitute' THEN new ELSE word END AS word, n FROM named WHERE op <> 'delete' UNION ALL SELECT uid, word_id, op, 1, new, n FROM named WHERE op = 'insert')"""


def _corrupted(spark, d, w):
    from pyspark.sql.window import Window as W

    # the vocabulary is the distinct segments of customers: a handful of rows
    entries = X.load(spark, d, "customer").select(F.col("c_mktsegment").alias("entry")).distinct()
    vocabulary = entries.select((F.row_number().over(W.orderBy("entry")) - 1).cast("long").alias("index"), "entry")
    return R.corrupt_words(w, 20, 7, vocabulary)


@query("corrupt_words", X.sql("words", "SELECT uid, word_id, op, place, word FROM corrupted", _CORRUPT))
def _(spark, d):
    return _corrupted(spark, d, X.words(spark, d))


@query("insert_slots", X.sql("words", "SELECT uid, word_id, place, word, CASE WHEN place = 1 THEN n + count(CASE WHEN place = 1 THEN 1 END) OVER (PARTITION BY uid ORDER BY word_id, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 ELSE word_id END AS slot, CASE WHEN place = 1 THEN round(avg(CASE WHEN place = 0 THEN prob END) OVER (PARTITION BY uid), 6) ELSE round(prob, 6) END AS confidence FROM (SELECT c.*, w.prob FROM corrupted c JOIN words w USING (uid, word_id))", _CORRUPT))
def _(spark, d):
    w = X.words(spark, d)
    n = w.groupBy("uid").agg(F.count("*").alias("n_words"))
    return R.insert_slots(_corrupted(spark, d, w).join(w.select("uid", "word_id", "prob"), ["uid", "word_id"]).join(n, "uid")).select("uid", "word_id", "place", "word", "slot", "confidence")


@query("shuffle_within", X.sql("words", "SELECT a.uid, a.word_id, b.word FROM (SELECT uid, word_id, row_number() OVER (PARTITION BY uid ORDER BY word_id) AS k FROM words WHERE prob > 0.2) a JOIN (SELECT uid, word, row_number() OVER (PARTITION BY uid ORDER BY md5('5:' || uid || ':' || word_id), word_id) AS k FROM words WHERE prob > 0.2) b ON a.uid = b.uid AND a.k = b.k"))
def _(spark, d):
    return R.shuffle_within(X.words(spark, d), 5, valid=F.col("prob") > 0.2)


@query("diagnostic_variants", "SELECT conv_id * 1000 + turn AS uid, r AS rate, s AS seed FROM conversations, (VALUES (0), (10), (20)) a(r), (VALUES (1), (2), (3)) b(s) WHERE NOT (r = 10 AND conv_id % 2 = 0)")
def _(spark, d):
    c = X.load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("uid"), "conv_id")
    done = c.where("conv_id % 2 = 0").select("uid", F.explode(F.array(*[F.struct(F.lit(10).alias("rate"), F.lit(s).alias("seed")) for s in (1, 2, 3)])).alias("p")).select("uid", "p.*")
    return R.diagnostic_variants(c, [0, 10, 20], [1, 2, 3], done)
