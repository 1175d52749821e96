"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed one after another into multiword Shift-And masks. A pattern of m
characters takes m + 1 bits (bit i: "i characters matched"); a wildcard after i characters is
a self-loop on bit i. One pass over the bytes of a canonical URL moves all patterns at once, and
numpy moves all URLs of an Arrow batch at once.

The rules read the host and path as they are; the method's own globs read the host without its port, and an empty path as ``/``.

Defined results: null urls and urls without ``://`` have empty host and path, fit no rule and are
blocked; urls of any length are read whole; repeated rows give repeated rows; an empty table gives no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vocalith.llm.common import table

#: Fixed values: (verdict, host, path); the longest rule that fits wins.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Where no rule fits, a url that one of these fits is blocked. `*` stays within the host, `**` crosses `/`.
BLOCK_GLOBS = ["*spam*/**", "*casino*/**", "*pills*/**", "*.xxx/**", "*/porn**", "*/**/porn**", "*/wp-login**", "*/**/wp-login**"]


def rule_glob(host: str, path: str) -> str:
    """Over ``.host/path``: the host itself and its subdomains, any path that starts with this one."""
    return f"*.{host}{path}**"


@dataclass
class ShiftAnd:
    step: np.ndarray  # [256, words]: bits that a byte may enter from the bit below
    loop: np.ndarray  # [256, words]: bits that a byte may stay in
    start: np.ndarray
    accept: list[tuple[int, int]]  # word and bit of each pattern's last state


def compile_globs(globs: list[str]) -> ShiftAnd:
    states = [len(g.replace("*", "").encode()) + 1 for g in globs]
    words = (sum(states) + 63) // 64 or 1
    step, loop, start = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64)
    accept, first = [], 0
    not_slash = np.arange(256) != ord("/")

    def bit(i: int) -> tuple[int, np.uint64]:
        return i // 64, np.uint64(1 << (i % 64))

    for glob, n in zip(globs, states):
        raw, at, k = glob.encode(), first, 0
        w, b = bit(at)
        start[w] |= b
        while k < len(raw):
            if raw[k] == ord("*"):
                deep = raw[k : k + 2] == b"**"
                w, b = bit(at)
                loop[np.ones(256, bool) if deep else not_slash, w] |= b
                k += 2 if deep else 1
            else:
                at += 1
                w, b = bit(at)
                step[raw[k], w] |= b
                k += 1
        accept.append((at // 64, at % 64))
        first += n
    return ShiftAnd(step, loop, start, accept)


def run_automaton(auto: ShiftAnd, subjects: list[bytes]) -> np.ndarray:
    """[subjects, patterns] booleans. Rows are ordered by length, so that row i is done once its bytes are."""
    n = len(subjects)
    lengths = np.fromiter(map(len, subjects), np.int64, n)
    order = np.argsort(-lengths, kind="stable")
    flat = np.frombuffer(b"".join(subjects), np.uint8)
    begin = (np.cumsum(lengths) - lengths)[order]
    left = lengths[order]
    state = np.tile(auto.start, (n, 1))
    for j in range(int(left[0]) if n else 0):
        live = int(np.searchsorted(-left, -j, side="left"))  # rows longer than j
        byte, d = flat[begin[:live] + j], state[:live]
        up = d << np.uint64(1)
        up[:, 1:] |= d[:, :-1] >> np.uint64(63)
        state[:live] = (up & auto.step[byte]) | (d & auto.loop[byte])
    found = np.empty((n, len(auto.accept)), bool)
    for p, (w, b) in enumerate(auto.accept):
        found[order, p] = (state[:, w] >> np.uint64(b)) & np.uint64(1)
    return found


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def split_url(url: str | None) -> tuple[str, str]:
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:cut].encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    tail = rest[cut:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host, tail[:end]


def bare_host(host: str) -> str:
    """The host without its port."""
    name, sep, port = host.rpartition(":")
    return name if sep and not port.strip("0123456789") else host


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """One row per input row: id, host, path, rule and verdict. No shuffle; reads two columns."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    names = [host + path for _, host, path in ranked]
    auto = compile_globs([rule_glob(h, p) for _, h, p in ranked])
    blocked = compile_globs(list(block_globs))

    def judge(batches):
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            fits = run_automaton(auto, [f".{h}{p}".encode("utf-8", "surrogatepass") if h or p else b"" for h, p in parts])
            bad = run_automaton(blocked, [f".{bare_host(h)}{p or '/'}".encode("utf-8", "surrogatepass") if h or p else b"" for h, p in parts]).any(axis=1)
            best = np.where(fits.any(axis=1), fits.argmax(axis=1), -1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([None if i < 0 else names[i] for i in best], pa.string()),
                    pa.array([ranked[i][0] if i >= 0 else "block" if b or not (h or p) else "allow" for i, b, (h, p) in zip(best, bad, parts)], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, url_col).mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


_ORACLE = r"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare, CASE
  WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL OR (host = '' AND path = '') THEN 'block'
  WHEN contains(bare, 'spam') OR contains(bare, 'casino') OR contains(bare, 'pills') OR ends_with('.' || bare, '.xxx') THEN 'block'
  WHEN contains(path, '/porn') OR contains(path, '/wp-login') THEN 'block'
  ELSE 'allow' END AS verdict FROM fit
"""
QUERIES = {"op8_url_filters": (op8_url_filters, _ORACLE)}
