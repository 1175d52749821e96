"""ARC to WARC: both versions' header lines, declared lengths, duplicates, awkward pages."""

import hashlib
from collections import Counter

import pytest

from vocalith.llm import archives as A
from vocalith.llm import warc_convert as wc
from vocalith.llm.common import shared_path

PARAGRAPH = "<p>é</p>" * 300
PAGES = [
    (1, "http://a b/ü", PARAGRAPH),
    (2, None, PARAGRAPH),
    (2, None, PARAGRAPH),
    (None, "u", PARAGRAPH),
    (3, "u", "s" * 1000),
    (4, "v", "s" * 1000),
    (5, "v", "s" * 999),
    (6, "w", "s" * 999),
    (7, "q", None),
    (8, "q", ""),
    (9, "z", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 40),
    (10, "z\n", "http://x 0.0.0.0 2000 text/html 5\n" * 60),
    (None, None, None),
    (-3, "n", "HTTP/1.0 200\r\n\r\n" * 100),
    (11, "big", "\n\r\n" + "y" * 300_000),
    (12, "big", "\n\r\n" + "y" * 300_000),
]


def expected(pages):
    """The contract, one page at a time."""
    out, groups = [], {}
    for i, _, html in pages:
        payload = (html or "").encode()
        groups.setdefault(payload, []).append(i)
    for payload, ids in groups.items():
        digest = hashlib.sha1(payload).hexdigest()
        if len(payload) < 1000:
            out += [(i, len(payload), digest, "response", None) for i in ids]
            continue
        known = sorted((i for i in ids if i is not None), reverse=True) + [None] * ids.count(None)
        out += [(known[0], len(payload), digest, "response", None), *((i, len(payload), digest, "revisit", known[0]) for i in known[1:])]
    return Counter(out)


def through(spark, df, most=wc.ARCHIVE_BYTES):
    arcs, warcs = shared_path(spark, "arc"), shared_path(spark, "warc")
    wc.write_arcs(df, arcs, most=most)
    wc.convert_archives(spark, arcs, warcs, most=most)
    return arcs, warcs, Counter(tuple(r) for r in wc.read_archives(spark, warcs).collect())


@pytest.mark.parametrize("most", [200, 5000, wc.ARCHIVE_BYTES])
def test_pages_of_every_kind(spark, most):
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, place long").repartition(3)
    assert through(spark, df, most)[2] == expected(PAGES)


def test_given_pages_and_an_empty_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert Counter(tuple(r) for r in wc.op11_warc(spark, sf_dir).collect()) == expected([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert not through(spark, pages.where("1 = 0"))[2]


def test_many_copies_over_many_files(spark):
    pages = [(k, f"http://x/{k}", PARAGRAPH if k % 3 else f"{PARAGRAPH}{k}") for k in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    arcs, warcs, got = through(spark, df, 20_000)
    assert got == expected(pages)
    # both versions were written, and files keep their bound
    raws = [A.unpacked(r.content) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(arcs).collect()]
    assert {r.split(b"\n")[1].split(b" ")[0] for r in raws} == {b"1", b"2"}
    assert max(map(len, raws)) <= 20_001


def test_files_stand_by_themselves(spark):
    """Every record of the WARC files: its fields, digests and the record it refers to, read from the files alone."""
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    _, warcs, _ = through(spark, df)
    found = [x for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(warcs).collect() for x in A.read_warc(r.content)]
    responses = {n["warc-record-id"]: n for n, _ in found if n["warc-type"] == "response"}
    assert len({n["warc-record-id"] for n, _ in found}) == len(found)
    for named, block in found:
        assert A.hex_of_label(named["warc-block-digest"]) == hashlib.sha1(block).hexdigest()
        if named["warc-type"] == "revisit":
            first = responses[named["warc-refers-to"]]
            assert first["warc-payload-digest"] == named["warc-payload-digest"] and first["warc-target-uri"] == named["warc-refers-to-target-uri"]
            assert named["warc-profile"] == A.REVISIT_PROFILE and block.startswith(b"HTTP/1.1 200") and block.endswith(b"\r\n\r\n")
    assert "2000-01-01T00:00:09Z" in {n["warc-date"] for n in responses.values()}


def test_versions_of_header_lines():
    block = b"HTTP/1.0 200 OK\nServer: old\n\n<html>\n\n</html>"
    one = A.arc_version_block("1", "x.arc", "19970101000000") + A.arc_record("1", "x.arc", 0, "http://a/b c", "199701020304", block) + A.arc_record("1", "x.arc", 0, "dns:a", "19970102030405", b"20000101 1.2.3.4\n")
    first, second = A.read_arc(one)
    assert (first.uri, first.date, first.kind, first.payload) == ("http://a/b%20c", "1997-01-02T03:04:00Z", "response", b"<html>\n\n</html>")
    assert (second.uri, second.kind, second.head, second.date) == ("dns:a", "resource", b"", "1997-01-02T03:04:05Z")
    two = A.arc_version_block("2", "y.arc", "19990101000000") + A.arc_record("2", "y.arc", 77, "http://a/", "19990102030405", block)
    assert [(r.uri, r.payload) for r in A.read_arc(two)] == [("http://a/", b"<html>\n\n</html>")]
    # the block's own list of fields decides, also in another order
    said = b"1 0 someone\nURL Archive-date IP-address Content-type Archive-length\n\n"
    odd = b"filedesc://z 19970101000000 0.0.0.0 text/plain %d\n" % len(said) + said + b"\nhttp://q/ 19980101000000 9.8.7.6 text/html 5\nabcde\n"
    assert [(r.date, r.address, r.payload) for r in A.read_arc(odd)] == [("1998-01-01T00:00:00Z", "9.8.7.6", b"abcde")]
    # a block that the file ends in
    cut = list(A.read_arc(one[:-10]))
    assert [r.named for r in cut] == [{}, {"WARC-Truncated": "length"}] and cut[1].payload == b"20000101"
    for bad in (b"not an archive\n", A.arc_version_block("1", "x", "19970101000000") + b"\nno header line\n"):
        with pytest.raises(ValueError):
            list(A.read_arc(bad))
    assert list(A.read_arc(b"")) == []
