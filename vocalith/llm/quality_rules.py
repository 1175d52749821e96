"""Quality rules by distribution divergence.

Every text is reduced to two histograms: classes of its characters, and its common words. Summed over
the corpus by language they are the language references (integer sums, so reruns agree). A document goes if its
Jensen-Shannon distance to its language's reference is above a bound, provided it is long enough for the histogram to mean anything;
or if it fails the base rules (too short, too repetitive).

Defined results: a null or blank text has no words and fails the base rules; a null language is a language of its own;
a language without a list of common words
is judged by character classes alone, unless it has `MIN_REFERENCE_WORDS` of the listed words and the text `MIN_TEXT_WORDS`; repeated rows give repeated rows; an empty table gives no rows;
other columns, whatever their names, are not read, and `keep_good` carries them along.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm.common import fresh, materialize, small_batches, table

#: The most common short words of each language.
COMMON_WORDS = {
    "en": "the and of to in is that with for was on as it are this from by at an be".split(),
    "de": "der die das und in zu den mit ist von nicht auf ein eine für sich dem im auch es".split(),
    "fr": "le la les de des du et un une que qui dans pour pas sur avec est en au elle".split(),
    "es": "el la los las de del y que en un una por con no para se su es al como".split(),
}
WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
SYMBOLS = "#*$%&|<>"
#: lower, upper, digit, blank, sentence marks, the symbols above, other ASCII; beyond ASCII: letters with their marks, all else
N_CLASSES = 9
MIN_WORDS = 20
REPEAT_WINDOW = 8
#: (least words, largest distance) of either histogram: short texts stray further from any reference.
CLASS_BOUNDS = [(100, 0.25)]
WORD_BOUNDS = [(100, 0.70), (200, 0.50)]
#: A language without a list of its own is judged by common words only where its reference and the text have so many of them.
MIN_REFERENCE_WORDS, MIN_TEXT_WORDS = 1000, 20


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """The class of every code point."""
    out = np.array([7 if unicodedata.category(chr(c))[0] in "LM" else 8 for c in range(0x110000)], np.uint8)
    out[:128] = 6
    for k, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r", ".,;:!?'\"-()", SYMBOLS]):
        out[list(chars.encode())] = k
    return out


_WORD_INDEX = {w.encode(): i for i, w in enumerate(WORDS)}


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words in windows that are found twice or more. Sorted window hashes rule most texts out; windows that may repeat are then compared."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64)
    mixed = np.zeros(n, np.uint64)
    for j in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n] + np.uint64(1)
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    maybe = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    windows = np.lib.stride_tricks.sliding_window_view(codes, window)[maybe]
    _, inverse, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    starts = maybe[count[inverse.reshape(-1)] > 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_features(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    classes = np.bincount(_class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=N_CLASSES)
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    common = [0] * len(WORDS)
    for w, c in Counter(words).items():
        i = _WORD_INDEX.get(w.lower().strip(b".,;:!?'\"-()"))
        if i is not None:
            common[i] += c
    return (len(words), len(text) - int(classes[3]), int(classes[5]), dup, repeated_words(words), classes.tolist(), common)


FEATURES = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,classes:array<long>,common:array<long>>"


def _features(texts: pa.Array) -> pa.Array:
    cols = list(zip(*map(text_features, texts.to_pylist()))) or [[]] * 7
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"])


def features(text: Column) -> Column:
    # not copied into the filters on its fields, which would run it again
    return F.arrow_udf(_features, FEATURES).asNondeterministic()(text)


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def _js(counts: pa.Array, references: pa.Array) -> pa.Array:
    out = np.full(len(counts), np.nan)
    both = np.flatnonzero(counts.is_valid().to_numpy(False) & references.is_valid().to_numpy(False))
    if len(both):
        p, q = (x.take(pa.array(both)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(both), -1) for x in (counts, references))
        n, m = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
        some = ((n > 0) & (m > 0))[:, 0]
        p, q = p[some] / n[some], q[some] / m[some]
        mean = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            total = sum(np.where(x > 0, x * np.log2(x / mean), 0.0).sum(1) for x in (p, q)) / 2
        out[both[some]] = np.sqrt(np.maximum(total, 0.0))
    return pa.array(out, mask=np.isnan(out))


def js_distance(counts: Column, reference: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two count arrays; null if either is null or all zero."""
    return F.arrow_udf(_js, "double")(counts, reference)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def language_references(featured: DataFrame, lang: str, f: str) -> DataFrame:
    """reference_lang, ref_classes, ref_common: sums over all documents that pass the base rules."""
    sums = [F.sum(F.col(f)["classes"][i]).alias(f"c{i}") for i in range(N_CLASSES)] + [F.sum(F.col(f)["common"][i]).alias(f"w{i}") for i in range(len(WORDS))]
    by = featured.where(~base_failed(F.col(f))).groupBy(F.col(lang).alias("reference_lang")).agg(*sums)
    return by.select("reference_lang", F.array(*[f"c{i}" for i in range(N_CLASSES)]).alias("ref_classes"), F.array(*[f"w{i}" for i in range(len(WORDS))]).alias("ref_common"))


def judged(featured: DataFrame, references: DataFrame, lang: str, f: str, out: str) -> DataFrame:
    """featured with a struct column `out`: class_distance, word_distance, base_failed, kept."""
    s = F.col(f)
    key, classes, common = (fresh(featured, stem) for stem in ("reference_lang", "ref_classes", "ref_common"))
    joined = featured.join(references.toDF(key, classes, common), F.col(lang).eqNullSafe(F.col(key)), "left")
    class_d = js_distance(s["classes"], F.col(classes))
    # a text with none of the words that its language is known by is as far as can be
    word_d = F.coalesce(js_distance(s["common"], F.col(common)), F.when(_total(F.col(common)) > 0, F.lit(1.0)))
    listed = F.coalesce(F.col(lang).isin(*COMMON_WORDS), F.lit(False))
    by_words = listed | ((_total(F.col(common)) >= MIN_REFERENCE_WORDS) & (_total(s["common"]) >= MIN_TEXT_WORDS))
    far = F.lit(False)
    for d, bounds, applies in ((class_d, CLASS_BOUNDS, F.lit(True)), (word_d, WORD_BOUNDS, F.coalesce(by_words, F.lit(False)))):
        for words, most in bounds:
            far = far | (applies & (s["n_words"] >= words) & F.coalesce(d > most, F.lit(False)))
    verdict = F.struct(class_d.alias("class_distance"), word_d.alias("word_distance"), base_failed(s).alias("base_failed"), (~base_failed(s) & ~far).alias("kept"))
    return joined.withColumn(out, verdict)


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df that the rules keep; same columns. The histograms are taken twice (for the references, then for the rows) rather than moving texts."""
    small_batches(df.sparkSession)
    f, out = fresh(df, "features__"), fresh(df, "verdict__")
    refs = materialize(language_references(df.select(lang_col, features(F.col(text_col)).alias(f)), lang_col, f), "references")
    return judged(df.withColumn(f, features(F.col(text_col))), refs, lang_col, f, out).where(F.col(out)["kept"]).select(*df.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", features(F.col("text")).alias("f"))
    docs = materialize(docs, "features")
    out = judged(docs, language_references(docs, "lang", "f"), "lang", "f", "v")
    return out.select("doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words", "v.base_failed", "v.kept", F.round("v.class_distance", 6).alias("class_distance"), F.round("v.word_distance", 6).alias("word_distance"))


_SPACE = r"[\x20\x09-\x0D]"
#: The classes 0 to 5 as patterns of the characters that are left out; class 6 is what is left of ASCII.
_CLASS_SQL = ["[^a-z]", "[^A-Z]", "[^0-9]", r"[^\x20\x09-\x0D]", r"""[^.,;:!?''"()\-]""", r"[^#*$%&|<>]"]


def _distance_sql(histogram: str) -> str:
    return f"""SELECT r, sqrt(greatest(0, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END))) AS distance FROM (
  SELECT h.r, h.n / sum(h.n) OVER (PARTITION BY h.r)::DOUBLE AS p, f.n / sum(f.n) OVER (PARTITION BY h.r)::DOUBLE AS q, sum(h.n) OVER (PARTITION BY h.r) AS a, sum(f.n) OVER (PARTITION BY h.r) AS b
  FROM {histogram} h JOIN {histogram}_ref f ON h.lang IS NOT DISTINCT FROM f.lang AND h.k = f.k) WHERE a > 0 AND b > 0 GROUP BY r"""


_ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS w FROM d),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
x AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM s WHERE len(w) >= 8)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM x) WHERE c > 1) GROUP BY r),
base AS (SELECT s.r, doc_id, lang, w, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(w) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(w) AS base_failed FROM s LEFT JOIN lines ON s.r = lines.r LEFT JOIN rep ON s.r = rep.r),
ascii AS (SELECT r, lang, base_failed, length(t) AS chars, length(regexp_replace(t, '[\x00-\x7F]|[^\p{{L}}\p{{M}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) AS seven, [{", ".join(f"length(regexp_replace(t, '{c}', '', 'g'))" for c in _CLASS_SQL)}] AS c FROM base),
ch AS (SELECT r, lang, base_failed, unnest(range(9)) AS k, unnest(list_concat(c, [seven - list_sum(c)::BIGINT, letters, chars - seven - letters])) AS n FROM ascii),
ch_ref AS (SELECT lang, k, sum(n) AS n FROM ch WHERE NOT base_failed GROUP BY ALL),
vocabulary AS (SELECT unnest({WORDS}) AS k),
found AS (SELECT r, trim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?''"-()') AS k FROM (SELECT r, unnest(w) AS x FROM base)),
counted AS (SELECT r, k, count(*) AS n FROM found JOIN vocabulary USING (k) GROUP BY ALL),
wd AS (SELECT b.r, b.lang, b.base_failed, v.k, coalesce(n, 0) AS n FROM base b CROSS JOIN vocabulary v LEFT JOIN counted c ON b.r = c.r AND v.k = c.k),
wd_ref AS (SELECT lang, k, sum(n) AS n FROM wd WHERE NOT base_failed GROUP BY ALL),
cd AS ({_distance_sql("ch")}), wdist AS ({_distance_sql("wd")}),
known AS (SELECT lang, sum(n) AS n FROM wd_ref GROUP BY lang),
own AS (SELECT r, sum(n) AS n FROM wd GROUP BY r),
v AS (SELECT base.*, cd.distance AS c, coalesce(wdist.distance, CASE WHEN known.n > 0 THEN 1.0::DOUBLE END) AS x,
  coalesce(base.lang IN {tuple(COMMON_WORDS)}, false) OR coalesce(known.n >= {MIN_REFERENCE_WORDS} AND own.n >= {MIN_TEXT_WORDS}, false) AS by_words
  FROM base LEFT JOIN cd ON base.r = cd.r LEFT JOIN wdist ON base.r = wdist.r LEFT JOIN own ON base.r = own.r LEFT JOIN known ON known.lang IS NOT DISTINCT FROM base.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(c, 6) AS class_distance, round(x, 6) AS word_distance,
  NOT base_failed AND NOT (n_words >= 100 AND coalesce(c > 0.25, false)) AND NOT (by_words AND n_words >= 100 AND coalesce(x > 0.70, false)) AND NOT (by_words AND n_words >= 200 AND coalesce(x > 0.50, false)) AS kept FROM v
"""
QUERIES = {"op6_quality_rules": (op6_quality_rules, _ORACLE)}
