"""From raw documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and
returns a DataFrame; all but the last return the columns of ``documents``, others
are ignored.  ``run`` writes each stage's result as Parquet in the shared folder and
reads it back for the next one, so a later stage never repeats an earlier one.
An empty table gives an empty one at every stage.
"""

from __future__ import annotations

import os
import sys
import warnings
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadence.llm import bpe, langid, line_dedup, mixing, simhash  # noqa: E402
from cadence.llm.common import stored, table  # noqa: E402
from cadence.llm.registry import query  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (null, empty and letterless texts) or
    between two of them; ``lang`` becomes the one found.  Null ids and repeated
    rows stay."""
    learnt = langid.fit(docs)
    kept = [c for c in COLUMNS if c not in ("doc_id", "lang")]
    found = langid.predict(docs, learnt, keep=tuple(kept))
    return found.filter(~langid.rejected(F.col("lang_pred"), F.col("score"))).withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later repeats of runs of lines; documents that lose all lines go.  Null
    ids come first in order; rows that repeat id and text lose the same lines."""
    found = line_dedup.line_dedup(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(line_dedup.WORD)
    return found.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group, with all rows that
    repeat it; null texts count as empty, and of null ids alone all stay."""
    groups = simhash.near_dedup(docs)
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(*COLUMNS)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop or repeat documents so that the domains meet their target shares, and
    warn if their classes allow the nearest totals only.  Null ids go with the copies
    of their row; null texts have no tokens."""
    domains = mixing.fit(mixing.quality_domains(table(spark, sf_dir, "labels")), docs)
    mixed = mixing.mix(docs, domains, mixing.QUALITY_WEIGHTS)
    if mixed.filter("NOT on_target").head(1):
        warnings.warn(f"the targets {mixing.QUALITY_WEIGHTS} are not met by any rates of these documents", stacklevel=2)
    copies = mixed.groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    joined = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of them and of what they decode to."""
    data = bpe.read_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_texts(docs, data, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", cut_lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mix_domains),
    ("byte_bpe", encode),
]

#: compression sizes, XXH64 and BPE merges have no SQL form; tests/llm holds run() against brute force
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return stored(STAGES[-1][1](spark, docs, sf_dir))
