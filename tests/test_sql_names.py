"""SQL functions give what the Column builders give."""

import pytest
from pyspark.sql import functions as F

from vocalith.functions import hashing as H
from vocalith.functions import text as T
from vocalith.functions.sql_names import SQL_FUNCTIONS, register_all
from vocalith.operators import vectors as V

NUMBERS = [None, 0.0, 0.5, 0.75, 1.0, 1.5, 1.75, 2.0, 2.25, 14.0, 7.5]
WORDS = [None, "", " ¡NIÑO! ", "está", "a-b'c’d", "x☃€", "12 €", "dos  palabras ...", "pingüino.", "a/b/c.wav", "c.tar.gz", "x" * 200]
SCORES = [[1.0, 3.0, 3.0], [0.0], [-5.0, 2.0, 700.0]]
def cases():
    return {
        "word": {
            "clean_text(word)": T.clean_text("word"), "ctc_form(word)": T.ctc_form("word"), "lexical_words(word)": T.lexical_words("word"), "hash32(word)": H.hash32(F.col("word")), "stable_seed(word, 1234)": H.stable_seed("word", 1234),
            "content_hash(word)": H.content_hash("word"), "cache_key(word, 16000, 14, 'base', 'en', 7)": H.cache_key("word", 16000, 14, "base", "en", F.lit(7).cast("long")), "run_name(word)": H.run_name("word"), "uid_from_path(word)": T.uid_from_path("word"), "txt_name(word)": T.txt_name("word"),
            "report_line(word, 1.5D, NULL, 2D, 12345.6789D)": T.report_line("word", F.lit(1.5), F.lit(None).cast("double"), F.lit(2.0), F.lit(12345.6789)),
        },
        "x": {"pause_symbol(x)": T.pause_symbol("x"), "pause_symbol_v0(x)": T.pause_symbol_v0("x"), "format_number_text(x)": T.format_number("x")},
        "v": {
            "argmax_class(v)": V.argmax_class(F.col("v")), "softmax(v)": V.softmax(F.col("v")), "log_softmax(v)": V.log_softmax(F.col("v")), "position_encoding(size(v), 6)": V.position_encoding(F.size("v"), 6),
            "pad_or_crop(v, 2)": V.pad_or_crop(F.col("v"), 2), "logsumexp(v)": F.array_max("v") - F.array_max(V.log_softmax(F.col("v"))),
        },
    }


@pytest.mark.parametrize("kind", ["word", "x", "v"])
def test_functions(spark, kind):
    names = register_all(spark)
    rows = {"word": (WORDS, "word string"), "x": (NUMBERS, "x double"), "v": (SCORES, "v array<double>")}[kind]
    df = spark.createDataFrame([(x,) for x in rows[0]], rows[1])
    for sql, column in cases()[kind].items():
        assert sql.split("(")[0] in names
        got, want = ([r[0] for r in df.select(c).collect()] for c in (F.expr(sql), column))
        flat = lambda x: [pytest.approx(y, abs=1e-9) if isinstance(y, float) else y for y in x] if isinstance(x, list) else pytest.approx(x, abs=1e-9) if isinstance(x, float) else x
        assert got == [flat(x) for x in want], sql


def test_the_rest(spark):
    register_all(spark)
    row = spark.sql("SELECT expand_start(1D, 2D) a, expand_end(9D, 10D, 2D) b, boundary_flag(0.2D, 0.1D, 0.2D) c, boundary_flag(0.21D, 0.1D, 0.2D) d, nfc('é') e").first()
    assert tuple(row) == (0.0, 10.0, False, True, "é")
    assert len(SQL_FUNCTIONS) >= 22
