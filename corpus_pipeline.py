"""From `documents` to a training mix in five stages, each of which works on what its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; docs is their input, written as Parquet and read again. All but the last
return the columns of `documents`. The last returns them with size, taken (words the mix takes of the document, repeats
counted) and virtual_finish, in the order of the mix; documents of which nothing is taken go.

Defined results: a null or blank text fails the quality rules and goes. Of similar texts the row of the least id stays (null ids last, then the least text hash), so ids
that are null or shared never merge unlike texts; rows alike in all columns are one. Rows of equal texts get the same verdicts and redactions. A null language, source or
owner is one of its own. An empty table stays empty. Further columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm.common import materialize, table
from vocalith.llm.decontamination import drop_contaminated
from vocalith.llm.quality_rules import keep_good
from vocalith.llm.secret_scans import redact_secrets
from vocalith.llm.simhash import drop_near_copies
from vocalith.llm.source_mix import apply_mix


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact_secrets(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mix),
]
#: SQL can't express the stages (automata, fingerprints, shuffles by hash); tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
