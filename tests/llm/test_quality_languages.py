"""Languages without a list of common words are judged by character classes."""

import random

from vocalith.llm import quality_rules


def test_a_stray_word_does_not_reject_a_language(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abdegiklmnoprstu") for _ in range(rng.randrange(4, 9))) for _ in range(260))
    rows = [(k, text() + (" de" if k % 10 == 0 else " in in" if k % 10 == 1 else ""), lang) for lang in ("fi", None) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert quality_rules.keep_good(df).count() == len(rows)


def test_a_listed_language_still_needs_its_words(spark):
    rng = random.Random(4)
    words = quality_rules.COMMON_WORDS["en"]
    english = [(k, " ".join(w for _ in range(130) for w in (rng.choice(words), "".join(rng.choice("abdegiklmnoprstu") for _ in range(5)))), "en") for k in range(40)]
    other = (99, " ".join("".join(rng.choice("abdegiklmnoprstu") for _ in range(5)) for _ in range(260)), "en")
    df = spark.createDataFrame([*english, other], "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality_rules.keep_good(df).collect()} == set(range(40))


def test_classes_of_characters():
    text = "Año, 12 #́ Ж中 — 😀"
    *_, classes, _ = quality_rules.text_features(text)
    assert classes == [1, 1, 2, 5, 1, 1, 0, 4, 2]  # ñ, the combining mark, Ж and 中 are letters; the dash and the face are not
    assert quality_rules.text_features(None)[5] == [0] * quality_rules.N_CLASSES
