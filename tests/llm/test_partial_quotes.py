"""Quotes of parts of a message: some of its lines or paragraphs, and messages that interleave quotes and replies."""

from vocalith.llm import quote_links


def test_partial_and_interleaved_quotes(spark):
    conversations = [
        ["one\ntwo\nthree", "> one\n> two\nok", "> TWO\n> three\nok", "> one\n> three\nno"],
        ["p one\nmore\n\np two\n\np three", "> p two\n>\n> p three\nok", "> p one\n> more\n>\n> p three\nok", "> p three\n>\n> p one\n> more\nno"],
        ["q", "a1\na2\n> q\nb1\nb2", "> a1\n> a2\nok", "> b1 b2\nok", "> later one\n> a2", "later one\na2"],
        ["x\ny\nz", "x\ny\nw", "> x\n> y"],
    ]
    rows = [(c, t, "user", text) for c, texts in enumerate(conversations) for t, text in enumerate(texts)] + [(None, 0, "user", "k\nl\nm"), (None, 1, "user", "> l\n> m")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.parent_turn for r in quote_links.link_quotes(df).collect()}
    assert len(got) == len(rows)
    assert [got[0, t] for t in range(4)] == [None, 0, 0, None]
    assert [got[1, t] for t in range(4)] == [None, 0, 0, None]
    assert [got[2, t] for t in range(6)] == [None, 0, 1, 1, None, None]
    assert [got[3, t] for t in range(3)] == [None, None, 1]
    assert got[None, 1] == 0


def test_repeated_turns_keep_their_layouts(spark):
    df = spark.createDataFrame([(1, 0, "user", "a b\nc\nd"), (1, 1, "user", "> a\n> b c"), (1, 1, "user", "> a b\n> c")], "conv_id long, turn long, role string, text string")
    assert sorted(r.n_linked for r in quote_links.link_quotes(df).where("turn = 1").collect()) == [1, 1]
