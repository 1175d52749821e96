"""Interval joins and windows over frames, characters and time.

Range joins are rewritten: frames by blocks of 64 of them, tokens and words by buckets of the axis, excluded intervals by a sweep. Of frames there are far more than of words; they go by the words of their block
one after another, and are neither sorted nor, if they come by blocks (`with_blocks`), shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocalith.functions.timing import Grid, expand_context, map_interval
from vocalith.operators.exact import exact_mean, rounded
from vocalith.operators.ordering import spread_scan
from vocalith.sources.storage import sound_unions


def token_word_overlap(tokens: DataFrame, words: DataFrame, bucket: int = 64) -> DataFrame:
    """tokens(uid, token_id, start, end), words(uid, word_id, start, end) -> (uid, token_id, word_id, owners): the word whose span the token's
    overlaps; null with the number of owners where that is not one."""
    spread = lambda df: df.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    a = spread(tokens.where("start < end"))
    b = spread(words.where("start < end")).select("uid", "word_id", F.col("start").alias("s"), F.col("end").alias("e"), "__b")
    # spans that share several buckets meet in the first one of both
    hit = a.join(b, ["uid", "__b"]).where((F.col("start") < F.col("e")) & (F.col("s") < F.col("end")) & (F.col("__b") == F.floor(F.greatest("start", "s") / bucket)))
    owners = hit.groupBy("uid", "token_id").agg(F.count("*").alias("n"), F.min("word_id").alias("w"))
    joined = tokens.join(owners, ["uid", "token_id"], "left").withColumn("owners", F.coalesce("n", F.lit(0)).cast("long"))
    return joined.select("uid", "token_id", F.when(F.col("owners") == 1, F.col("w")).alias("word_id"), "owners")


def frames_in_interval(windows: DataFrame, frames: DataFrame, grid: Grid, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """One row for each (word, frame) with the frame's centre in the word's interval, or the nearest frame if there is none (method says which).

    windows carry `frame_count` if the grid's count is that column. A word has a row for each block that it touches, and a block's frames go by its words one after another.
    """
    mapped = windows.withColumn("__m", map_interval(F.col(start), F.col(end), grid)).where("__m IS NOT NULL")
    spread = mapped.withColumn("block", F.explode(F.sequence(F.shiftright("__m.first", 6), F.shiftright(F.col("__m.last") - 1, 6)))).withColumn("method", F.col("__m.method"))
    hits = with_blocks(frames).join(spread.hint("shuffle_hash"), ["uid", "block"]).where("frame >= __m.first AND frame < __m.last")
    return hits.select("uid", "frame", *[c for c in windows.columns if c != "uid"], "method", *[c for c in frames.columns if c not in ("uid", "frame", "block")])


def with_blocks(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """frames with `block`, their 64 neighbours on the axis. Frames that are made by block, and dealt by (uid, block), carry it and are not moved again."""
    return frames if "block" in frames.columns else frames.withColumn("block", F.shiftright(F.col(frame).cast("long"), 6))


def exclude_overlaps(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Words that touch no excluded interval: excluded are those with end >= begin and start < stop. A word without a time touches none.

    A sweep instead of a join: intervals that begin no later than a word ends come before it in the order of (begin or end), and it touches one of them if the greatest stop among them is
    beyond its start. One window for a recording; words and intervals never form pairs.
    """
    sound_unions(words.sparkSession)
    names = {c: f"__{i}" for i, c in enumerate(words.columns)}
    timed = (F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()).alias("__timed")
    at = F.col("end_ms").cast("double").alias("__at")
    rows = words.select(F.col("uid").alias("__uid"), at, F.lit(1).alias("__word"), F.lit(None).cast("double").alias("__stop"), F.struct(*[F.col(c).alias(n) for c, n in names.items()]).alias("__row"), timed)
    spans = segments.where("begin_ms IS NOT NULL AND stop_ms IS NOT NULL").select(F.col("uid").alias("__uid"), F.col("begin_ms").cast("double").alias("__at"), F.lit(0).alias("__word"), F.col("stop_ms").cast("double").alias("__stop"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.lit(False).alias("__timed"))
    line = W.partitionBy("__uid").orderBy("__at", "__word").rowsBetween(W.unboundedPreceding, 0)
    swept = rows.unionByName(spans).withColumn("__reach", F.max("__stop").over(line)).where("__word = 1")
    start = F.col("__row")[names["start_ms"]]
    touched = F.col("__timed") & F.col("__uid").isNotNull() & F.coalesce(F.col("__reach") > start, F.lit(False))
    return swept.where(~touched).select(*[F.col("__row")[n].alias(c) for c, n in names.items()])


def boundary_delta(pairs: DataFrame, threshold_ms: float = 200.0) -> DataFrame:
    """Absolute and signed differences of starts and ends in seconds, and a flag above the threshold; null where an interval is missing."""
    ds, de = (F.col("other_start") - F.col("start_ms")) / 1000.0, (F.col("other_end") - F.col("end_ms")) / 1000.0
    flag = F.greatest(F.abs(ds), F.abs(de)) > threshold_ms / 1000.0 + 1e-9
    there = F.col("start_ms").isNotNull() & F.col("other_start").isNotNull()
    value = lambda e: F.when(there, F.round(e, 6))
    return pairs.withColumns({"start_delta": value(F.abs(ds)), "end_delta": value(F.abs(de)), "signed_start": value(ds), "signed_end": value(de), "flagged": F.when(there, flag)})


def disagreement_summary(compared: DataFrame, by: str = "uid") -> DataFrame:
    """Counts, flagged word ids, and mean, median and largest differences; null where nothing could be compared. Means are exact and rounded once, so no order of summing changes them."""
    r = lambda e: F.round(e, 6)
    return compared.groupBy(by).agg(
        F.count("start_delta").alias("compared"), F.count_if(F.col("start_delta").isNull()).alias("without_interval"), F.count_if("flagged").alias("n_flagged"),
        F.array_sort(F.collect_list(F.when(F.col("flagged"), F.col("word_id")))).alias("flagged_ids"),
        exact_mean(F.col("start_delta")).alias("mean_start"), r(F.median("start_delta")).alias("median_start"), F.max("start_delta").alias("max_start"),
        exact_mean(F.col("end_delta")).alias("mean_end"), r(F.median("end_delta")).alias("median_end"), F.max("end_delta").alias("max_end"),
    )


def largest_discrepancies(compared: DataFrame, k: int) -> DataFrame:
    """The k words with the largest boundary difference (ties by uid and word_id)."""
    worst = F.greatest("start_delta", "end_delta")
    return compared.where("start_delta IS NOT NULL").withColumn("worst", worst).orderBy(F.desc("worst"), "uid", "word_id").limit(k)


def word_windows(spans: DataFrame, words: DataFrame, counts: DataFrame, context: int = 0) -> DataFrame:
    """spans(uid, word_id, start_frame, end_frame) of units -> one row a word: least start, largest end, units, and both with context; words
    without units keep a row with nulls. counts(uid, frame_count)."""
    made = spans.groupBy("uid", "word_id").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.count("*").alias("units"))
    out = words.select("uid", "word_id").join(made, ["uid", "word_id"], "left").join(counts, "uid")
    s, e = expand_context(F.col("start_frame"), F.col("end_frame"), F.col("frame_count"), context)
    there = F.col("start_frame").isNotNull()
    return out.select("uid", "word_id", F.when(there, "aligned").otherwise("no_ctc_units").alias("status"), "start_frame", "end_frame", F.when(there, s).alias("exp_start_frame"), F.when(there, e).alias("exp_end_frame"), F.coalesce("units", F.lit(0)).cast("long").alias("units"))


def windows_monotonic(windows: DataFrame, start: str = "exp_start_frame", end: str = "exp_end_frame") -> DataFrame:
    """(uid, violations): aligned windows that begin or end before an earlier one's largest."""
    before = W.partitionBy("uid").orderBy("word_id").rowsBetween(W.unboundedPreceding, -1)
    back = (F.col(start) < F.max(start).over(before)) | (F.col(end) < F.max(end).over(before))
    return windows.withColumn("__b", back).groupBy("uid").agg(F.count_if("__b").alias("violations"))


def collapse_runs(path: DataFrame, uid: str, order: str, label: str, score: str, blank: str | int, spread: bool = False) -> DataFrame:
    """Maximal runs of equal labels without the blank: (uid, label, start, end, mean_score), by places in the order, end exclusive. spread: for recordings of any length, by `spread_scan`."""
    if spread:
        held = F.struct(F.col(label).alias("l"))  # a null label is one too
        place = spread_scan(path, [uid], [F.col(order)], {"__p": ("count", F.lit(1)), "__b": ("last", held)})
        change = ((F.col("__p") == 0) | ~F.col("__b.l").eqNullSafe(F.col(label))).cast("int")
        marked = spread_scan(place.withColumn("__c", change).drop("__b"), [uid], [F.col(order)], {"__r": ("sum", F.col("__c"))}).withColumn("__r", F.col("__r") + F.col("__c"))
        runs = marked.where(F.col(label) != blank)
    else:
        line = W.partitionBy(uid).orderBy(order)
        place = path.withColumn("__p", F.row_number().over(line) - 1)
        change = (~F.col(label).eqNullSafe(F.lag(label).over(line)) | (F.col("__p") == 0)).cast("int")
        run = F.sum("__c").over(line.rowsBetween(W.unboundedPreceding, 0))
        runs = place.withColumn("__c", change).withColumn("__r", run).where(F.col(label) != blank)
    return runs.groupBy(uid, "__r").agg(F.first(label).alias("label"), F.min("__p").alias("start"), (F.max("__p") + 1).alias("end"), F.round(F.avg(score), 6).alias("mean_score")).drop("__r")


def path_score(frames: DataFrame, units: Column | None = None, score: str = "score") -> DataFrame:
    """(uid, total, mean_log, confidence): sum and mean of log scores; units is the number of units that they are shared by, that of the frames if None."""
    return frames.groupBy("uid").agg(F.round(F.sum(score), 6).alias("total"), F.round(F.sum(score) / (F.count("*") if units is None else F.max(units)), 6).alias("mean_log"), F.round(F.exp(F.avg(score)), 6).alias("confidence"))


def interval_mean_pool(windows: DataFrame, frames: DataFrame, grid: Grid, dim: int, policy: str = "centres", context_ms: float = 0.0, duration: Column | None = None) -> DataFrame:
    """(uid, word_id, vec, n_frames, valid): elementwise means of frames(uid, frame, vec) over intervals; invalid words keep a row with zeros.

    centres: frames with centres in the interval, else the nearest. inclusive: frames first..last that the interval touches, none for
    an empty one. short_expand: as inclusive, under 3 frames take 2 more on each side, values clipped to 1000. context_ms widens intervals first.
    """
    sound_unions(windows.sparkSession)
    s, e = F.col("start_ms"), F.col("end_ms")
    if context_ms:
        s, e = expand_context(s, e, duration, context_ms)
    n = F.col("frame_count") if "frame_count" in windows.columns else F.lit(grid.count)
    if policy == "centres":
        m = map_interval(s, e, grid)
        first, last = m["first"], m["last"]
    else:
        first, last = F.floor(s / grid.stride), F.least(n.cast("long"), F.floor(e / grid.stride) + 1)
        if policy == "short_expand":
            short = last - first < 3
            first, last = F.when(short, F.greatest(F.lit(0).cast("long"), first - 2)).otherwise(first), F.when(short, F.least(n.cast("long"), last + 2)).otherwise(last)
        ok = s < e
        first, last = F.when(ok, first), F.when(ok, last)
    placed = windows.select("uid", "word_id", *[c for c in ("start_ms", "end_ms", "frame_count") if c in windows.columns]).withColumn("__f", first).withColumn("__l", last)
    value = (lambda c: F.least(F.lit(1000.0), F.greatest(F.lit(-1000.0), c))) if policy == "short_expand" else (lambda c: c)
    # values count in units of 1e-9, as whole numbers: sums are exact up to 9e9
    # a mean is the difference of two prefix sums, and no word is spread over its frames. Between two ends of words only the sum of the frames counts: a block's ends are 64 bits, so a frame's stretch is the number of
    # bits up to it, and stretches, not frames, meet the ends of words in one window by recording
    names = [f"__v{i}" for i in range(dim)]
    whole = lambda c: F.rint(c * 1e9).cast("long")
    zero = F.lit(0).cast("long")
    no_word = F.lit(None).cast(dict(windows.dtypes)["word_id"])
    ends = F.explode(F.array(*[F.struct(F.col(c).cast("long").alias("__at"), F.lit(k).alias("__sign")) for c, k in (("__f", -1), ("__l", 1))]))
    edges = placed.where("__f < __l").select("uid", "word_id", ends.alias("e")).select("uid", "e.__at", "word_id", "e.__sign", zero.alias("__one"), *[zero.alias(n) for n in names])
    bits = edges.groupBy("uid", F.shiftright("__at", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__at & 63 AS INT))")).alias("__bits"))
    rows = with_blocks(frames.where("frame IS NOT NULL")).select("uid", "block", F.col("frame").cast("long").alias("__at"), *[whole(value(F.col("vec")[i])).alias(n) for i, n in enumerate(names)])
    stretch = F.expr("coalesce(bit_count(__bits & shiftrightunsigned(-1L, 63 - cast(__at & 63 AS INT))), 0)")
    summed = rows.join(bits.hint("shuffle_hash"), ["uid", "block"], "left").groupBy("uid", "block", stretch.alias("__k")).agg(F.min("__at").alias("__at"), F.count("*").alias("__one"), *[F.sum(n).alias(n) for n in names])
    stretches = summed.select("uid", "__at", no_word.alias("word_id"), F.lit(0).alias("__sign"), "__one", *names)
    before = W.partitionBy("uid").orderBy("__at", "__one").rowsBetween(W.unboundedPreceding, 0)
    summed = stretches.unionByName(edges).withColumns({n: F.sum(n).over(before) for n in ["__one", *names]}).where("__sign <> 0")
    means = summed.groupBy("uid", "word_id").agg(F.sum(F.col("__one") * F.col("__sign")).alias("n_frames"), *[F.sum(F.col(n) * F.col("__sign")).alias(n) for n in names]).where("n_frames > 0")
    means = means.select("uid", "word_id", "n_frames", F.array(*[rounded(F.coalesce(n, zero).cast("decimal(20,0)"), F.col("n_frames").cast("decimal(20,0)") * 1000, 6) for n in names]).alias("vec"))
    zeros = F.array(*[F.lit(0.0)] * dim)
    return windows.select("uid", "word_id").join(means, ["uid", "word_id"], "left").select("uid", "word_id", F.coalesce("vec", zeros).alias("vec"), F.coalesce("n_frames", F.lit(0)).cast("long").alias("n_frames"), F.col("vec").isNotNull().alias("valid"))
