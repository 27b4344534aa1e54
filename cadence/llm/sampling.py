"""A bounded, repeatable sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crc32_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (the folds of the held-out rows)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def spread(text: Column, chars: int, parts: int = 8) -> Column:
    """A text of up to ``chars`` characters whole, of a longer one so many in
    ``parts`` slices at equal distances from its start to its end, as lines."""
    parts = max(2, min(parts, chars))
    size = max(1, chars // parts)
    at = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.floor(i * (F.length(text) - size) / (parts - 1)).cast("int") + 1)
    return F.when(F.length(text) > chars, F.array_join(F.transform(at, lambda i: F.substr(text, i, F.lit(size))), "\n")).otherwise(text)


def sample_rows(labels: DataFrame, texts: DataFrame, label_col: str, id_col: str, text_col: str, *, per_label: int,
                chars: int) -> tuple[DataFrame | None, dict]:
    """``label``, ``k``, ``text`` of up to ``per_label`` rows of each label (None
    if there are none), and the number of ``labels`` rows of each label.

    Ids are taken in the order of their hash, so a sample does not depend on
    how the tables are dealt out; then their texts are fetched.  ``chars``
    bounds what is learnt from one text, in slices spread over it.  Rows with a null label, id or text
    teach nothing; of rows that repeat an id and label one is taken.  Size of
    the sample, and of the broadcast ids: labels x per_label rows.
    """
    rows = labels.select(F.col(label_col).alias("label"), F.col(id_col).alias("id")).filter("label IS NOT NULL AND id IS NOT NULL")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None, {}
    # far fewer rows than all are worth sorting; the rank below sets the bound
    shares = [(F.col("label") == label) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, 4 * per_label / n) * (1 << 20)) + 64)
              for label, n in counts.items()]
    near = rows.filter(reduce(lambda a, b: a | b, shares)).distinct()
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    picked = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_label)
    found = (texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
             .join(F.broadcast(picked), "id").groupBy("label", "k").agg(F.min(spread(F.col("text"), chars)).alias("text")))
    return found, counts


def labelled_sample(*args, **options) -> tuple[list[tuple], dict]:
    """The same as (label, text) on the driver, and the counts."""
    found, counts = sample_rows(*args, **options)
    rows = found.collect() if found else []
    return [(r["label"], r["text"]) for r in sorted(rows, key=lambda r: (str(r["label"]), r["k"]))], counts
