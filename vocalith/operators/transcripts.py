"""Timestamped transcripts: offsets, units, pauses, audits, corruption and chunks. Words are keyed by (uid, word_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalith.functions import text as T
from vocalith.functions.hashing import draw
from vocalith.operators.ordering import spread_scan
from vocalith.sources.storage import shuffled


def by_word():
    """A recording's words in order."""
    return W.partitionBy("uid").orderBy("word_id")


def earlier():
    return by_word().rowsBetween(W.unboundedPreceding, -1)


def char_offsets(words: DataFrame, spread: bool = False) -> DataFrame:
    """char_start, char_end of each word in the joined text. spread: for recordings of any length, by `spread_scan`."""
    n = F.length("word").cast("long")
    if spread:
        return spread_scan(words, ["uid"], [F.col("word_id")], {"char_start": ("sum", n + 1)}).withColumn("char_end", F.col("char_start") + n)
    start = F.coalesce(F.sum(n + 1).over(earlier()), F.lit(0)).cast("long")
    return words.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + n)


# --- validity


def valid_interval(df: DataFrame, duration: str | None = None, scale: float = 0.001) -> DataFrame:
    """valid: 0 <= start <= end (and end <= duration + 0.05 s, if given), prob in [0, 1]; null where there is no interval."""
    s, e = F.col("start_ms") * scale, F.col("end_ms") * scale
    ok = (s >= 0) & (s <= e) & F.coalesce(F.col("prob").between(0, 1), F.lit(True))
    return df.withColumn("valid", ok & (e <= F.col(duration) * scale + 0.05) if duration else ok)


def audit_records(words: DataFrame, recordings: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(uid, word_id, problem): one row for each problem; nothing is changed."""
    form = T.ctc_form("word")
    bad = T.unsupported_chars(form, vocabulary)
    checks = F.array_compact(F.array(
        F.when(F.trim("word") == "", "empty word"), F.when(bad.isNotNull(), "unsupported character"),
        F.when(~((F.col("start_ms") >= 0) & (F.col("start_ms") <= F.col("end_ms"))), "bad time"), F.when(~F.col("prob").between(0, 1), "bad probability"),
    ))
    per_word = words.select("uid", "word_id", F.explode(checks).alias("problem"))
    none = F.lit(None).cast("int").alias("word_id")
    missing = recordings.join(shuffled(words.select("uid")), "uid", "left_anti").select("uid", none, F.lit("missing words").alias("problem"))
    silent = words.groupBy("uid").agg(F.max(F.length(form)).alias("n")).where("n = 0").select("uid", none, F.lit("no alignable word").alias("problem"))
    return reduce(DataFrame.unionByName, [per_word, missing, silent])


def monotonic_starts(rows: DataFrame, uid: str, order: str, start: str) -> DataFrame:
    """(uid, backwards): whether a start lies before the one before it."""
    back = F.col(start) < F.lag(start).over(W.partitionBy(uid).orderBy(order))
    return rows.withColumn("__b", back).groupBy(uid).agg(F.coalesce(F.bool_or("__b"), F.lit(False)).alias("backwards"))


def prefix_limit(df: DataFrame, n: int, pos: str = "word_id") -> DataFrame:
    return df if n == 0 else df.where(F.col(pos) < n)


# --- pauses


def pause_gaps(words: DataFrame, spread: bool = False) -> DataFrame:
    """gap_ms to the word before, not below 0; 0 for the first. spread: for recordings of any length, by `spread_scan`."""
    if spread:
        ended = F.coalesce("end_ms", F.lit(-1).cast("long"))  # a word before without a time is not passed over
        before = spread_scan(words, ["uid"], [F.col("word_id")], {"__before": ("last", ended)})
        gap = F.col("start_ms") - F.when(F.col("__before") >= 0, F.col("__before"))
        return before.withColumn("gap_ms", F.greatest(F.lit(0).cast("long"), F.coalesce(gap, F.lit(0)))).drop("__before")
    return words.withColumn("gap_ms", F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("start_ms") - F.lag("end_ms").over(by_word()), F.lit(0))))


def temporal_features(words: DataFrame) -> DataFrame:
    """log_duration, log_gap, log_rate: log1p of seconds, of the gap, and of words a second among two valid neighbours on each side."""
    near = by_word().rowsBetween(-2, 2)
    valid = F.col("start_ms").isNotNull()
    count = F.count(F.when(valid, 1)).over(near)
    span = (F.max("end_ms").over(near) - F.min("start_ms").over(near)) / 1000.0
    with_gap = pause_gaps(words)
    value = lambda e: F.when(valid, F.round(F.log1p(e), 6))
    return with_gap.select("uid", "word_id", value((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("log_duration"), value(F.col("gap_ms") / 1000.0).alias("log_gap"), value(count / F.greatest(span, F.lit(0.02))).alias("log_rate"))


def _joined(parts: DataFrame, piece: Column) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("word_id", piece.alias("piece")))), lambda x: x["piece"])
    return parts.groupBy("uid").agg(F.array_join(F.filter(listed, lambda p: p != ""), " ").alias("text"))


def transcript_with_pauses(words: DataFrame, pauses: bool = True) -> DataFrame:
    """(uid, text): words joined by blanks, with the pause's symbol before the next word."""
    symbol = T.pause_symbol(F.col("gap_ms") / 1000.0) if pauses else F.lit("")
    gaps = pause_gaps(words).withColumn("mark", symbol)
    return _joined(gaps, F.when(F.col("mark") == "", F.col("word")).otherwise(F.concat("mark", F.lit(" "), "word")))


def transcript_with_pauses_v0(words: DataFrame) -> DataFrame:
    """The older form: the symbol stands after the later word, and only where the earlier word ends after 0."""
    gaps = words.withColumn("__e", F.lag("end_ms").over(by_word()))
    mark = F.when(F.col("__e") > 0, T.pause_symbol_v0((F.col("start_ms") - F.col("__e")) / 1000.0)).otherwise("")
    return _joined(gaps.withColumn("mark", mark), F.when(F.col("mark") == "", F.col("word")).otherwise(F.concat("word", F.lit(" "), "mark")))


def punctuation_gap(tokens: DataFrame, lexical: Column, end_of_recording: Column) -> DataFrame:
    """Tokens that are not lexical lie between the end of the lexical word before and the start of the one after (0 and the recording's
    end at the edges), with the end not before the start."""
    after = by_word().rowsBetween(1, W.unboundedFollowing)
    marked = tokens.withColumn("__lex", lexical)
    begin = F.coalesce(F.last(F.when(F.col("__lex"), F.col("end_ms")), ignorenulls=True).over(earlier()), F.lit(0))
    stop = F.coalesce(F.first(F.when(F.col("__lex"), F.col("start_ms")), ignorenulls=True).over(after), end_of_recording)
    return marked.select("uid", "word_id", F.when(F.col("__lex"), F.col("start_ms")).otherwise(begin).cast("long").alias("gap_start"), F.when(F.col("__lex"), F.col("end_ms")).otherwise(F.greatest(begin, stop)).cast("long").alias("gap_end"))


# --- units


def skip_unsupported(words: DataFrame, vocabulary: list[str]) -> DataFrame:
    """form: the CTC form, emptied (id and text stay) where a character is not in the vocabulary; reason says which."""
    marked = words.withColumn("form", T.ctc_form("word")).withColumn("reason", T.unsupported_chars("form", vocabulary))
    return marked.withColumn("form", F.when(F.col("reason").isNull(), F.col("form")).otherwise(""))


def ctc_units(words: DataFrame, form: Column, delimiter: str = "|") -> DataFrame:
    """(uid, target_index, token, owner): characters with their word's id; a delimiter (owner -1) between words that have any."""
    placed = _placed_forms(words, form, delimiter)
    units = placed.select("uid", "word_id", "first", "base", F.posexplode("chars").alias("k", "token"))
    return units.select("uid", (F.col("base") + F.col("k")).cast("long").alias("target_index"), "token", F.when(~F.col("first") & (F.col("k") == 0), -1).otherwise(F.col("word_id")).alias("owner"))


def _placed_forms(words: DataFrame, form: Column, delimiter: str) -> DataFrame:
    """(uid, word_id, form, first, base, chars): a word's units, the delimiter before it among them, and the number of units before."""
    forms = words.select("uid", "word_id", form.alias("form")).where("form <> ''")
    first = F.row_number().over(W.partitionBy("uid").orderBy("word_id")) == 1
    size = F.length("form") + F.when(first, 0).otherwise(1)
    placed = forms.withColumn("first", first).withColumn("size", size).withColumn("base", F.coalesce(F.sum("size").over(earlier()), F.lit(0)))
    chars = F.when(F.col("first"), T.characters(F.col("form"))).otherwise(F.concat(F.array(F.lit(delimiter)), T.characters(F.col("form"))))
    return placed.withColumn("chars", chars)


def minimum_frames_of(words: DataFrame, form: Column, delimiter: str = "|") -> DataFrame:
    """`minimum_frames` of the units of words, which are counted word by word: no row stands for a unit, and units are not sorted."""
    placed = _placed_forms(words, form, delimiter)
    chars = F.col("chars")
    before = F.lag(F.element_at("chars", -1)).over(by_word())
    inside = F.size(F.filter(F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: a == b), lambda x: x))
    same = inside + F.coalesce((before == chars[0]).cast("int"), F.lit(0))
    counted = placed.select("uid", F.size(chars).alias("n"), same.alias("same"))
    return counted.groupBy("uid").agg(F.sum("n").alias("targets"), (F.sum("n") + F.sum("same")).alias("frames"))


def minimum_frames(units: DataFrame) -> DataFrame:
    """(uid, targets, frames): a frame for each target and one more between equal neighbours."""
    same = (F.col("token") == F.lag("token").over(W.partitionBy("uid").orderBy("target_index"))).cast("int")
    return units.withColumn("__same", same).groupBy("uid").agg(F.count("*").alias("targets"), (F.count("*") + F.coalesce(F.sum("__same"), F.lit(0))).alias("frames"))


def unit_sync(units: DataFrame, spans: DataFrame) -> DataFrame:
    """Units with their spans by target_index; `agrees` says whether the tokens are equal."""
    right = spans.withColumnRenamed("token", "span_token")
    return units.join(shuffled(right), ["uid", "target_index"]).withColumn("agrees", F.col("token") == F.col("span_token"))


# --- masks and pairs


def token_masks(tokens: DataFrame) -> DataFrame:
    """text_valid = attended; audio_valid = attended with an offset that is not empty; position 0 is always valid for audio."""
    text = F.col("attention")
    return tokens.withColumn("text_valid", text).withColumn("audio_valid", (F.col("word_id") == 0) | (text & (F.col("char_end") > F.col("char_start"))))


def paired_mask(left: DataFrame, right: DataFrame, *more: DataFrame) -> DataFrame:
    """(uid, word_id, valid_0, valid_1, …, valid): valid in all sources; every row of the first stays."""
    out = left.select("uid", "word_id", F.col("valid").alias("valid_0"))
    for k, df in enumerate([right, *more], 1):
        out = out.join(shuffled(df.select("uid", "word_id", F.col("valid").alias(f"valid_{k}"))), ["uid", "word_id"], "left").fillna(False, [f"valid_{k}"])
    return out.withColumn("valid", reduce(lambda a, b: a & b, [F.col(f"valid_{k}") for k in range(2 + len(more))]))


def positional_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both tables at the same place; mismatch: their words differ."""
    right = b.select("uid", "word_id", F.col("word").alias("other_word"), F.col("start_ms").alias("other_start"), F.col("end_ms").alias("other_end"))
    return a.join(shuffled(right), ["uid", "word_id"]).withColumn("mismatch", ~F.col("word").eqNullSafe(F.col("other_word")))


# --- chunks and corruption


def token_chunks(tokens: DataFrame, size: int, specials: int = 2, pos: str = "word_id") -> DataFrame:
    """chunk, slot: consecutive chunks of size - specials tokens; slots begin after the prefix."""
    room = size - specials
    return tokens.withColumn("chunk", F.floor(F.col(pos) / room).cast("int")).withColumn("slot", (F.col(pos) % room + 1).cast("int"))


def corrupt_words(words: DataFrame, rate: int, seed: int, vocabulary: DataFrame) -> DataFrame:
    """(uid, word_id, op, place, word): round-half-up(N * rate / 100) sites a recording, in the order of a hash, cycle through substitute, delete
    and insert. vocabulary(index, entry) has at least two entries; a replacement is the drawn one, or the next if that is the word itself.
    """
    k = lambda p: F.concat_ws(":", F.lit(p), F.lit(str(seed)), F.col("uid").cast("string"), F.col("word_id").cast("string"))
    by_hash = W.partitionBy("uid").orderBy(F.md5(k("site")), "word_id")
    ranked = words.select("uid", "word_id", "word").withColumn("__r", F.row_number().over(by_hash) - 1).withColumn("__n", F.count("*").over(W.partitionBy("uid")))
    sites = F.floor(F.col("__n") * rate / 100.0 + 0.5)
    n = vocabulary.agg(F.count("*").alias("__v"))
    marked = ranked.withColumn("op", F.when(F.col("__r") < sites, F.element_at(F.array(F.lit("substitute"), F.lit("delete"), F.lit("insert")), (F.col("__r") % 3 + 1).cast("int"))).otherwise("keep")).crossJoin(F.broadcast(n))
    drawn = marked.withColumn("__i", draw(k("word"), F.col("__v"))).withColumn("__j", (F.col("__i") + 1) % F.col("__v"))
    one = vocabulary.select(F.col("index").alias("__i"), F.col("entry").alias("__e1"))
    two = vocabulary.select(F.col("index").alias("__j"), F.col("entry").alias("__e2"))
    named = drawn.join(one, "__i").join(two, "__j").withColumn("__new", F.when(F.col("__e1") == F.col("word"), F.col("__e2")).otherwise(F.col("__e1")))
    keep = F.struct(F.lit(0).alias("place"), F.when(F.col("op") == "substitute", F.col("__new")).otherwise(F.col("word")).alias("out"))
    insert = F.struct(F.lit(1).alias("place"), F.col("__new").alias("out"))
    made = F.when(F.col("op") == "delete", F.array().cast("array<struct<place:int,out:string>>")).when(F.col("op") == "insert", F.array(keep, insert)).otherwise(F.array(keep))
    return named.select("uid", "word_id", "op", F.explode(made).alias("m")).select("uid", "word_id", "op", "m.place", F.col("m.out").alias("word"))


def shuffle_within(words: DataFrame, seed: int, value: str = "word", valid: Column | None = None) -> DataFrame:
    """(uid, word_id, value): the values of a recording's valid places, permuted by a hash."""
    rows = words if valid is None else words.where(valid)
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("uid").cast("string"), F.col("word_id").cast("string")))
    places = rows.select("uid", "word_id", F.row_number().over(by_word()).alias("__k"))
    values = rows.select("uid", F.col(value), F.row_number().over(W.partitionBy("uid").orderBy(hashed, "word_id")).alias("__k"))
    return places.join(shuffled(values), ["uid", "__k"]).select("uid", "word_id", value)


def insert_slots(corrupted: DataFrame) -> DataFrame:
    """slot: kept items keep their word's; inserted ones come after the recording's last, in order. confidence: a recording's mean where
    an item has none of its own (columns: uid, word_id, place, prob, n_words)."""
    new = F.col("place") == 1
    order = W.partitionBy("uid").orderBy("word_id", "place").rowsBetween(W.unboundedPreceding, 0)
    slot = F.when(new, F.col("n_words") + F.count(F.when(new, 1)).over(order) - 1).otherwise(F.col("word_id"))
    mean = F.round(F.avg(F.when(~new, F.col("prob"))).over(W.partitionBy("uid")), 6)
    return corrupted.withColumn("slot", slot.cast("long")).withColumn("confidence", F.when(new, mean).otherwise(F.round("prob", 6)))


def diagnostic_variants(records: DataFrame, rates: list[int], seeds: list[int], done: DataFrame) -> DataFrame:
    """(uid, rate, seed): all combinations that are not done."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.lit(s).alias("seed")) for r in rates for s in seeds]))
    return records.select("uid", pairs.alias("p")).select("uid", "p.*").join(done, ["uid", "rate", "seed"], "left_anti")
