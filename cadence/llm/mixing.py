"""Mixing sources to target weights with soft domain membership.

A classifier fitted on a labelled table gives every document a posterior over
the domains.  Documents then get nonnegative rates, so that the expected tokens
of each domain, the sum of rate x tokens x posterior, match the target totals:

    minimise  1/2 sum_d (s_d - t_d)^2 / u_d  +  penalty/2 sum_i w_i (r_i - 1)^2,  r >= 0

with w_i the document's share of all tokens, s_d = sum_i w_i r_i p_id, t the target
weights and u_d = max(t_d, 0.01), so that small targets count for what they are of all.  It is solved by projected gradient steps of Barzilai-Borwein
length.  A rate follows from its posterior and the steps so far, a short list of
numbers; so an iteration is one pass over the posteriors that returns the sums,
nothing per document is kept between passes, and a lost executor costs a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import cut, ship_by_value, stored
from cadence.llm.sampling import sample_rows

FEATURES = 1 << 14
PENALTY, ITERATIONS = 1e-4, 100
#: by how much of itself a domain's expected total may miss its target; of a target of none, by how much of all
MISS, NONE = 0.005, 1e-6
#: the least weight of a domain's miss
LEAST = 0.01


#: target shares of the tokens for the domains of the labels table
QUALITY_WEIGHTS = {"good": 0.80, "poor": 0.10, "toxic": 0.10}


def quality_domains(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``domain`` of the labels table: toxic, else poor or good by
    quality; null without either label."""
    return labels.select("doc_id", F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' WHEN quality = 1 THEN 'good' END").alias("domain"))


def tokens(text: Column) -> Column:
    """Words and signs of a text, in lower case; none of a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0)), F.array().cast("array<string>"))


def _features(rows: DataFrame, text_col: str) -> DataFrame:
    rows = rows.withColumn("_tokens", tokens(F.col(text_col)))
    rows = HashingTF(numFeatures=FEATURES, inputCol="_tokens", outputCol="_tf").transform(rows)
    return Normalizer(p=1.0, inputCol="_tf", outputCol="_features").transform(rows)


@dataclass
class Domains:
    names: list
    shares: list[float]  # of the labelled rows
    model: object | None  # None: no two domains to tell apart


def fit(labels: DataFrame, docs: DataFrame, domain_col: str = "domain", id_col: str = "doc_id", text_col: str = "text", *,
        per_domain: int = 3000, chars: int = 8000) -> Domains:
    """Softmax regression on hashed tokens, from at most ``per_domain`` labelled
    rows of each domain and ``chars`` characters of each, in slices spread over it.

    Only labels of documents with a text count, towards the shares too; a domain
    without any is not learnt.  If that holds for all, the shares of all labels stay.
    """
    there = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"))
    known = stored(labels.select(id_col, domain_col).join(there, F.col(id_col) == F.col("_id"), "left_semi"))
    sample, counts = sample_rows(known, docs, domain_col, id_col, text_col, per_label=per_domain, chars=chars)
    if sample is None:
        sample, counts = sample_rows(labels, docs, domain_col, id_col, text_col, per_label=per_domain, chars=chars)
    drawn = {}
    if sample is not None:
        sample = cut(sample)
        drawn = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(drawn or counts)
    total = sum(counts[n] for n in names)
    shares = [counts[n] / total for n in names]
    if len(drawn) < 2:
        return Domains(names, shares, None)
    # the sample takes the same number of each domain; weights give the table's shares back
    number, weight = F.lit(0.0), F.lit(0.0)
    for i, n in enumerate(names):
        number = F.when(F.col("label") == n, float(i)).otherwise(number)
        weight = F.when(F.col("label") == n, counts[n] / drawn[n]).otherwise(weight)
    rows = _features(sample, "text").select("_features", number.alias("_label"), weight.alias("_weight"))
    model = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", family="multinomial",
                               maxIter=60, regParam=0.05).fit(rows)
    return Domains(names, shares, model)


def memberships(docs: DataFrame, domains: Domains, id_col: str, text_col: str) -> DataFrame:
    """id, n_tokens and posterior (in the order of ``names``) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    if domains.model is None:
        shares = F.array(*[F.lit(float(x)) for x in domains.shares or [1.0]])
        return rows.select("id", F.size(tokens(F.col("_text"))).cast("long").alias("n_tokens"), shares.alias("posterior"))
    found = domains.model.setProbabilityCol("_p").transform(_features(rows, "_text"))
    return found.select("id", F.size("_tokens").cast("long").alias("n_tokens"), vector_to_array("_p").alias("posterior"))


def rates_after(p: np.ndarray, steps: list[tuple[float, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rates of the rows of ``p`` after the steps (length, gradient in domain
    space), and before the last one."""
    r = before = np.ones(len(p))
    for length, y in steps:
        before, r = r, np.maximum(0.0, r - length * (p @ y + PENALTY * (r - 1.0)))
    return r, before


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.float64)
    return n, b.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def solve(members: DataFrame, target: np.ndarray) -> tuple[list[tuple[float, np.ndarray]], np.ndarray, bool]:
    """The steps that lead to the rates, the expected shares they give, and
    whether these meet the targets."""
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return [], target, True
    steps: list[tuple[float, np.ndarray]] = []

    def sums() -> tuple[np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros(len(target) + 1)
            for b in batches:
                n, p = _columns(b)
                r, before = rates_after(p, steps)
                acc += np.concatenate(((n * r) @ p, [(n * (r - before) ** 2).sum()]))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in acc], names=[f"x{i}" for i in range(len(acc))])

        names = [f"x{i}" for i in range(len(target) + 1)]
        row = members.select("n_tokens", "posterior").mapInArrow(run, ", ".join(f"{x} double" for x in names)).agg(*[F.sum(x) for x in names]).first()
        found = np.array([x or 0.0 for x in row]) / total
        return found[:-1], float(found[-1])

    share, _ = sums()
    length = 1.0
    scale = np.maximum(target, LEAST)
    allowed = MISS * np.where(target > NONE, target, 1.0)
    while not (met := bool((np.abs(share - target) <= allowed).all())) and len(steps) < ITERATIONS:
        steps.append((length, (share - target) / scale))
        new, moved = sums()
        delta, share = new - share, new
        if moved < 1e-12:  # targets out of reach: the nearest totals are found
            break
        length = moved / (float((delta * delta / scale).sum()) + PENALTY * moved)
    return steps, share, met


RATED = "id {id}, n_tokens long, posterior array<double>, rate double"


def mix(docs: DataFrame, domains: Domains, weights: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``posterior``, ``rate``, ``copies``
    (the rate rounded up or down by a hash of the id, so that its mean is the
    rate), ``on_target`` (whether the totals meet the targets).

    ``weights`` are the domains' target shares of the tokens, scaled to one over
    the domains learnt; a domain learnt but without a weight keeps its labelled
    share, and weights that are all 0 count as equal.  Null texts have no tokens and the empty text's posterior.  Without
    tokens, or with a single domain, all rates are 1.  Rows that repeat an id
    get the same copies if their texts are equal.  Other columns are ignored.
    """
    target = np.array([float(weights.get(n, s)) for n, s in zip(domains.names, domains.shares)] or [1.0])
    target = target if target.sum() > 0 else np.ones(len(target))
    target = np.maximum(target / target.sum(), 1e-9)
    members = stored(memberships(docs, domains, id_col, text_col))
    steps, _, met = solve(members, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rates = rates_after(_columns(b)[1], steps)[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates, pa.float64())], names=[*b.schema.names, "rate"])

    rated = members.mapInArrow(run, RATED.format(id=members.schema["id"].dataType.simpleString()))
    chance = F.pmod(F.xxhash64("id", F.lit(0x9E37)), F.lit(1 << 30)) / float(1 << 30)
    return rated.select(F.col("id").alias(id_col), "n_tokens", "posterior", "rate",
                        F.floor(F.col("rate") + chance).cast("int").alias("copies"), F.lit(met).alias("on_target"))


ship_by_value(__name__)
