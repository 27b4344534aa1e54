"""Toxicity: the subword-bag classifier over the words that speak most for it.

A few words make a text toxic, so the bag that is averaged is not the text but the
window of neighbouring words with the largest mean score: a long text is judged
like a short one, and all of it is read.  ``window=0`` averages the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm import subword
from cadence.llm.common import stored
from cadence.llm.sampling import labelled_sample


def fit(labels: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *,
        per_label: int = 2000, chars: int = 20_000, window: int = 4, epochs: int = 10) -> subword.Model:
    """Learn from at most ``per_label`` labelled rows of each label (0, 1) and
    ``chars`` characters of each, in slices spread over the text; labels other than
    0 and 1, and those without a text, are ignored."""
    there = docs.filter(F.col(text_col).isNotNull()).select(id_col)
    rows = stored(labels.filter(F.col(label_col).isin(0, 1)).join(there, id_col, "left_semi"))
    sample, counts = labelled_sample(rows, docs, label_col, id_col, text_col, per_label=per_label, chars=chars)
    return subword.train(sample, counts, window=window, epochs=epochs)


def score(docs: DataFrame, model: subword.Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``score`` (probability of label 1), ``predicted``.

    A null text counts as empty, scored by the bias.  If only one label was
    learnt, every score is 0 or 1 with it; if none, 0.  Null ids and repeated
    rows stay; other columns are ignored.
    """
    found = subword.posteriors(docs, model, text_col, keep=(id_col,))
    p = F.lit(0.0)
    if 1 in model.classes:
        p = F.element_at("posterior", model.classes.index(1) + 1)
    return found.select(id_col, p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))
