"""The SQL of op6 and op8 on planted rows that tell old and new rules apart: if operator and SQL drift, these differ."""

import random

import duckdb
import pytest
from compare import duck_rows, spark_rows

from vocalith.llm import quality_rules, url_filters

URLS = [
    "http://casino.net", "http://casino.net:8080", "http://x.org/porn/1", "http://blog.org/wp-login.php", "http://a.xxx?x=1", "http://a.xxx:8080/", "http://A.XXX:8080#top", "http://x.org/a/b/porn", "http://x.org//porn",
    "http://blog.org", "http://blog.org:80", "http://x.org/a-porn", "http://x.org/?porn", "http://xxx.org/", "http://[::1]/a", "http://[::1]:80/porn", "http://com", "http://a.com/porn", "http://www.example.com/en/x", "http://EXAMPLE.com/en/x", "http://s.net/es/", "http://s.net/fr/1", "http://s.net:80/fr/1",
    None, "", "no scheme", "://", "http://", "http://spam", "http://x.org/spam", "http://pills:pw@x.org/", "http://x.org:12a/", "http://" + "a" * 30_000 + ".xxx/", "http://x.org/" + "b/" * 30_000 + "porn", "http://casino.net",
]


def sql_rows(name, frame, sql):
    con = duckdb.connect()
    con.register(name, frame.toArrow())
    return duck_rows(con, sql)


def test_urls(spark):
    df = spark.createDataFrame([(k if k else None, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    assert spark_rows(url_filters.judge_urls(df)) == sql_rows("pages", df, url_filters._ORACLE)
    assert url_filters.judge_urls(df.where("1 = 0")).count() == 0


@pytest.fixture
def unlisted(spark):
    """Texts of listed and unlisted languages with some, few or none of the listed words."""
    rng = random.Random(9)
    strange = lambda n: ["".join(rng.choice("abdegiklmnoprstu") for _ in range(rng.randrange(4, 9))) for _ in range(n)]
    listed = quality_rules.COMMON_WORDS["de"]
    rows = []
    for k in range(60):
        lang = [None, "fi", "it", "de", "en"][k % 5]
        words = strange(rng.choice([30, 120, 260]))
        share = {"it": 0.3, "de": 0.4, None: 0.1 if k > 30 else 0}.get(lang, 0.01)
        words = [rng.choice(listed) if rng.random() < share else w for w in words]
        rows.append((k, " ".join(words), lang))
    rows += [(100, None, None), (101, "", "fi"), (102, "ä " * 300, "fi"), (103, "#" * 500, "it"), (104, "\n".join(["one two"] * 30), "de"), (104, "\n".join(["one two"] * 30), "de")]
    return spark.createDataFrame([(*r, True, 1) for r in rows], "doc_id long, text string, lang string, kept boolean, f int")


def test_quality(spark, unlisted, tmp_path):
    unlisted.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = spark_rows(quality_rules.op6_quality_rules(spark, str(tmp_path)))
    assert got == sql_rows("documents", unlisted, quality_rules._ORACLE)
    kept = got[0].index("kept")
    assert {r[kept] for r in got[1]} == {True, False}
