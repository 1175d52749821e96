"""Names under which the scalar functions can be called from SQL, and table functions for sequential work."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from vocalith.functions.text import KEPT_MARKS, nfc_udf
from vocalith.operators.sequential import Matcher, Packer

#: SQL functions: signature and body. They are expanded into the plan, so nothing runs in Python but NFC, where `nfc` is called on text beyond ASCII.
SQL_FUNCTIONS = {
    "clean_text(word STRING)": r"regexp_replace(word, '[^\\p{L}\\p{M}\\p{N}_\\s" + KEPT_MARKS.replace("-", r"\\-").replace("'", r"\'") + "]', '')",
    "ctc_form(word STRING)": r"regexp_replace(CASE WHEN word RLIKE '^\\p{ASCII}*$' THEN lower(trim(word)) ELSE nfc(lower(trim(word))) END, '\\p{P}', '')",
    "pause_symbol(gap DOUBLE)": "CASE WHEN gap > 1.5D THEN '...' WHEN gap >= 1D THEN '.' WHEN gap >= 0.5D THEN ',' ELSE '' END",
    "lexical_words(text STRING)": r"filter(split(text, '\\s+'), x -> x RLIKE '[\\p{L}\\p{N}]')",
    "hash32(key STRING)": "CAST(conv(substring(md5(key), 1, 8), 16, 10) AS BIGINT)",
    "stable_seed(uid STRING, seed BIGINT)": "CAST(conv(substring(sha2(concat_ws(':', CAST(seed AS STRING), uid), 256), 1, 15), 16, 10) AS BIGINT)",
    "content_hash(content STRING)": "sha2(content, 256)",
    "cache_key(path STRING, rate INT, win INT, model STRING, lang STRING, start BIGINT)": "sha2(concat_ws('|', path, CAST(rate AS STRING), CAST(win AS STRING), model, lang, CAST(start AS STRING)), 256)",
    "run_name(name STRING)": "CASE WHEN name IS NULL THEN '' WHEN length(name) <= 128 THEN name ELSE concat(substring(name, 1, 115), '-', substring(sha2(name, 256), 1, 12)) END",
    "uid_from_path(path STRING)": r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '')",
    "format_number_text(x DOUBLE)": "CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS STRING) ELSE CAST(x AS STRING) END",
    "txt_name(path STRING)": r"regexp_replace(path, '\\.wav$', '.txt')",
    "argmax_class(scores ARRAY<DOUBLE>)": "CAST(array_position(scores, array_max(scores)) - 1 AS INT)",
    "softmax(scores ARRAY<DOUBLE>)": "transform(scores, x -> exp(x - array_max(scores)) / aggregate(scores, 0D, (a, y) -> a + exp(y - array_max(scores))))",
    "log_softmax(scores ARRAY<DOUBLE>)": "transform(scores, x -> x - array_max(scores) - ln(aggregate(scores, 0D, (a, y) -> a + exp(y - array_max(scores)))))",
    "logsumexp(scores ARRAY<DOUBLE>)": "array_max(scores) + ln(aggregate(scores, 0D, (a, y) -> a + exp(y - array_max(scores))))",
    "expand_start(start_ms DOUBLE, margin DOUBLE)": "greatest(0D, start_ms - margin)",
    "expand_end(end_ms DOUBLE, duration DOUBLE, margin DOUBLE)": "least(duration, end_ms + margin)",
    "boundary_flag(start_delta DOUBLE, end_delta DOUBLE, threshold DOUBLE)": "greatest(abs(start_delta), abs(end_delta)) > threshold + 1e-9D",
    "position_encoding(pos BIGINT, dim INT)": "transform(sequence(0, dim - 1), i -> CASE WHEN i % 2 = 0 THEN sin(pos * exp(-ln(10000D) * (i - i % 2) / dim)) ELSE cos(pos * exp(-ln(10000D) * (i - i % 2) / dim)) END)",
    "pause_symbol_v0(gap DOUBLE)": "CASE WHEN gap > 2D THEN '...' WHEN gap > 1D THEN '.' WHEN gap > 0.5D THEN ',' ELSE '' END",
    "report_line(word STRING, start_s DOUBLE, end_s DOUBLE, other_start DOUBLE, other_end DOUBLE)": "concat(rpad(substring(word, 1, 16), 16, ' '), " + ", ".join(f"CASE WHEN {c} IS NULL THEN '        -' ELSE format_string('%9.3f', {c}) END" for c in ("start_s", "end_s", "other_start", "other_end")) + ")",
    "pad_or_crop(v ARRAY<DOUBLE>, n INT)": "slice(concat(v, array_repeat(0D, n)), 1, n)",
}


def word_packer():
    """UDTF word_packer(costs, capacity) -> (position, chunk): greedy packing of one ordered array."""

    @udtf(returnType="position int, chunk int")
    class WordPacker:
        def eval(self, costs: list, capacity: int):
            packer = Packer(capacity)
            for i, c in enumerate(costs or []):
                yield i, packer.place(c)

    return WordPacker


def word_matcher():
    """UDTF word_matcher(text, words) -> (position, at, recased, skipped): the places of one ordered array of words in a text."""

    @udtf(returnType="position int, at int, recased boolean, skipped boolean")
    class WordMatcher:
        def eval(self, text: str, words: list):
            matcher = Matcher(text or "")
            for i, w in enumerate(words or []):
                yield i, *matcher.find(w)

    return WordMatcher


def register_all(spark: SparkSession) -> list[str]:
    """Registers everything for this session; returns the names."""
    names = []
    spark.udf.register("nfc", nfc_udf())
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        names.append(signature.split("(")[0])
    spark.udtf.register("word_packer", word_packer())
    spark.udtf.register("word_matcher", word_matcher())
    return [*names, "nfc", "word_packer", "word_matcher"]
