"""Quote links against every passage compared with every earlier message."""

import random

import pytest
from brute import reply_links

from vocalith.llm import quote_links


def thread(seed):
    """Messages that quote whole messages, runs of lines, single lines, several paragraphs, and quotes of quotes; some shared lines, some quotes of nothing."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ja no maybe Thanks report draft figure table week plan north south".split())
    messages, conv = [], rng.choice([1, 2, None])
    for turn in range(14):
        lines = []
        for _ in range(rng.randrange(4)):
            if messages and rng.random() < 0.8:
                source = rng.choice(messages)[2].split("\n")
                a = rng.randrange(len(source))
                part = source[a : a + rng.randrange(1, 5)]
                part = [x.upper() if rng.random() < 0.2 else "  " + x if rng.random() < 0.1 else x for x in part]
                lines += ["> " + x for x in part] if rng.random() < 0.8 else [">" + x for x in part]
            if rng.random() < 0.15:
                lines += ["> never said", ">> by " + word()]
            lines += [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))]
            lines += [""] if rng.random() < 0.3 else []
        messages.append((conv, turn, "\n".join(lines)))
    return messages


@pytest.mark.parametrize("seed", range(3))
def test_links_and_order(spark, seed):
    messages = [m for k in range(8) for m in [(c if c is None else c + 10 * k, t, x) for c, t, x in thread(100 * seed + k)] if m[0] is not None or k == 0]
    messages += [(900, 0, None), (900, 1, ""), (900, 2, "> "), (901, 0, "long " * 20000 + "\nlast line"), (901, 1, "> last line\nyes"), (902, None, "> last line")]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in messages], "conv_id long, turn int, role string, text string").repartition(5)
    rows = quote_links.reply_ordered(quote_links.link_quotes(df)).collect()
    want = reply_links(messages)
    assert {(r.conv_id, r.turn): (r.thread_turn, r.parent_turn, r.reply_path, r.n_linked) for r in rows} == want
    assert any(n > 1 for *_, n in want.values()) and any(len(p) > 2 for _, _, p, _ in want.values())
    for conv in {c for c, _, _ in messages}:
        paths = [r.reply_path for r in rows if r.conv_id == conv and r.turn is not None]
        assert paths == sorted(paths)


def test_repeated_rows_share_their_place(spark):
    rows = [(1, 0, "a", "one line\nand another"), (1, 1, "b", "> one line\nyes"), (1, 1, "b", "> one line\nyes"), (1, 2, "c", "> yes\nno")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = sorted((r.turn, r.parent_turn, r.reply_path) for r in quote_links.link_quotes(df).collect() if r.turn)
    assert got == [(1, 0, [0, 1]), (1, 0, [0, 1]), (2, 1, [0, 1, 2])]


def test_a_common_line_makes_no_pairs(spark):
    """Every message says Thanks and quotes it: each links to the one before."""
    df = spark.createDataFrame([(None, t, "u", "> Thanks\nThanks" if t else "Thanks") for t in range(400)], "conv_id long, turn int, role string, text string")
    assert {(r.turn, r.parent_turn) for r in quote_links.link_quotes(df).collect()} == {(t, t - 1 if t else None) for t in range(400)}
