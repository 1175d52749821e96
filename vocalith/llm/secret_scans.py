"""Secret scans with corpus-wide ownership frequency.

Every text is scanned once for candidates. The hash of each candidate value is counted over the whole
corpus by distinct repositories and owners: a value that many owners hold is a widely copied example,
one that few owners hold is live-looking. Base spans (assignments, access keys, hex runs) always stay; the
method adds provider-shaped and high-entropy values, where they are live-looking.

Defined results: a null text is empty; repeated rows each get their own verdict; null repositories and
owners count as one of their own; an empty table gives no rows; other columns of the input, whatever their names, are not read, and `redact_secrets` carries them along.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm.common import fresh, materialize, small_batches, table

#: The base patterns. `assign` is ASCII-only in its letter case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # runs are taken whole, so a run of 24+ is what a match of [0-9a-f]+ of 24+ is
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "provider", "entropy")
PROVIDER = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})")
DENSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{28,}")
PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0000|1234567", re.IGNORECASE)


def bits_per_char(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) in code points, by start and then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Further candidates that touch no base span."""
    out, taken = [], [(s, e) for s, e, _, _ in base]
    found = [(m.start(), m.end(), 3, m[0]) for m in PROVIDER.finditer(text)] if any(x in text for x in ("gh", "sk-", "xox", "AIza", "eyJ")) else []
    for m in DENSE.finditer(text):
        v = m[0]
        if any("0" <= c <= "9" for c in v) and v.lower() != v and v.upper() != v and bits_per_char(v) >= 4.0:
            found.append((m.start(), m.end(), 4, v))
    for s, e, k, v in sorted(found):
        if not PLACEHOLDER.search(v) and all(e <= a or b <= s for a, b in taken):
            out.append((s, e, k, v))
            taken.append((s, e))
    return out


def _scan(batches):
    at = TaskContext.get().partitionId() << 40
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.string())]))
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            every = base + added_spans(text or "", base)
            rows.append([{"start": s, "end": e, "kind": k, "value": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32]} for s, e, k, v in every])
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(at, at + n), pa.int64()), batch.column(0), batch.column(2), batch.column(3), pa.array(rows, kind)], names=["row", "id", "repository", "owner", "found"])
        at += n


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, max_owners: int = 2) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    The candidates, not the texts, are written to the shared folder, so that the texts are scanned once.
    Counting owners pre-aggregates by (value, owner, repository) before the shuffle by value.
    """
    spark = df.sparkSession
    small_batches(spark)
    repository = F.lit(None) if repository is None else repository
    owner = F.lit(None) if owner is None else owner
    kind = dict(df.dtypes)[id_col]
    cut = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))
    found = materialize(cut.mapInArrow(_scan, f"row long, id {kind}, repository string, owner string, found array<struct<start:int,end:int,kind:int,value:string>>"), "secrets")
    each = found.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("c")).select("row", "repository", "owner", "c.*")
    owners = each.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count_distinct(F.coalesce("owner", F.lit("\0"))).alias("n_owners"), F.count("one").alias("n_repositories"))
    word = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    text = F.concat_ws(":", word, F.col("start").cast("string"), F.col("end").cast("string"))
    judged = each.join(owners, "value").withColumn("live", F.col("n_owners") <= max_owners).where((F.col("kind") <= 2) | F.col("live"))
    span = F.struct("start", "kind", text.alias("span"), "end")
    kept = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(span)).alias("all"),
        F.count_if(F.col("kind") == 0).alias("a"), F.count_if(F.col("kind") == 1).alias("k"), F.count_if(F.col("kind") == 2).alias("h"),
        F.count_if(F.col("live")).alias("live"), F.count_if(~F.col("live")).alias("copied"),
    )
    joined = found.select("row", "id").join(kept, "row", "left")
    base = F.concat_ws(",", F.transform(F.filter("all", lambda s: s["kind"] <= 2), lambda s: s["span"]))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select(
        F.col("id").alias(id_col), zero("a").alias("n_assign"), zero("k").alias("n_access"), zero("h").alias("n_hex"),
        F.sha2(F.coalesce(base, F.lit("")), 256).alias("base_sha256"),
        F.coalesce(F.concat_ws(",", F.transform("all", lambda s: s["span"])), F.lit("")).alias("spans"),
        zero("live").alias("n_live"), zero("copied").alias("n_example"),
    )


def redact_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, **scan) -> DataFrame:
    """df with every span of `scan_secrets` replaced by ``[SECRET]``; same rows and columns.

    Spans depend on the text and the corpus alone, so texts find theirs by hash: ids may be null, shared or of any type, and equal texts are redacted alike.
    """
    small_batches(df.sparkSession)
    key, spans, other = (fresh(df, stem) for stem in ("text_key__", "spans__", "other_key__"))
    narrow = df.select(F.xxhash64(F.col(text_col)).alias(key), F.col(text_col).alias("text"), (F.lit(None) if repository is None else repository).cast("string").alias("repository"), (F.lit(None) if owner is None else owner).cast("string").alias("owner"))
    found = scan_secrets(narrow, key, "text", F.col("repository"), F.col("owner"), **scan).where("spans <> ''")
    found = found.groupBy(F.col(key).alias(other)).agg(F.min("spans").alias(spans))

    @F.arrow_udf("string")
    def redact(text: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for t, spans_of in zip(text.to_pylist(), wanted.to_pylist()):
            if t is not None and spans_of:
                end, piece = 0, []
                for a, b in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in spans_of.split(","))):
                    if b <= end:
                        continue
                    piece += [t[end:a], "[SECRET]"] if a >= end else []
                    end = b
                t = "".join(piece) + t[end:]
            out.append(t)
        return pa.array(out, pa.string())

    joined = df.withColumn(key, F.xxhash64(F.col(text_col))).join(found, F.col(key) == F.col(other), "left")
    return joined.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(redact(F.col(text_col), F.col(spans)))).select(*df.columns)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


QUERIES = {"op1_secret_scans": (op1_secret_scans, None)}
