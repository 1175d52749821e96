"""The method's own globs on first path segments, urls without a path, and ports."""

from vocalith.llm import url_filters


def test_plain_cases_are_blocked(spark):
    bad = ["http://blog.org/wp-login.php", "http://x.org/porn/1", "http://x.org/a/b/wp-login", "http://casino.net", "http://a.xxx?x=1", "http://a.xxx:8080/", "http://A.XXX:8080#top"]
    good = ["http://blog.org", "http://blog.org:80", "http://x.org/a-porn", "http://x.org/?porn", "http://xxx.org/", "http://[::1]/a"]
    df = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df).collect()}
    assert [got[k][3] for k in range(len(bad + good))] == ["block"] * len(bad) + ["allow"] * len(good)
    assert got[5][:3] == ("a.xxx:8080", "/", None) and got[3][:3] == ("casino.net", "", None)
