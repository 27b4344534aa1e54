"""SimHash near-dedup through a segment-popcount embedding.

A fingerprint's 64 bits fall into 32 segments of two.  The vector of the
segments' bit counts is an embedding in which Manhattan distance is a lower
bound of Hamming distance.  Written in unary (a count of 0, 1, 2 as bits 00, 01,
11) the vector is again a 64-bit number, ``u``, and the Manhattan distance of
two vectors is the bit count of the xor of their numbers.

Of three differences, one half of the segments sees one at most.  So the grid
has one cell per value of either half of the vector, and two fingerprints within
reach share a cell or lie in neighbouring ones along one axis: a row goes to its
own cells, and to those one step down on each axis, for a join on the cell.
Candidates within Manhattan distance 3 are then verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import cut, ship_by_value, stored
from cadence.llm.components import components

SEED, CHUNK = 42, 1 << 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, as an unsigned number."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join, ones, n = xxhash.xxh64_intdigest, b" ".join, np.zeros(64, np.int64), len(words) - shingle + 1
    for lo in range(0, n, CHUNK):
        part = words[lo:lo + CHUNK + shingle - 1]
        hashes = np.array([digest(join(s), SEED) for s in zip(*(part[k:] for k in range(shingle)))], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, fp (a signed long of the 64 bits) of every row; a null text is empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py() or "", shingle) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps.view(np.int64), pa.int64())], names=["id", "fp"])

    return rows.mapInArrow(run, "id long, fp long")


def unary(fp: Column) -> Column:
    """The segments' bit counts, in unary, as one number."""
    odd = F.lit(0x5555555555555555)
    upper = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(odd), 1).bitwiseOR(fp.bitwiseOR(upper).bitwiseAND(odd))


def cells(u: Column) -> tuple[Column, Column]:
    """The cell of either half of the vector: the half's bits, and one bit that
    tells the halves apart."""
    return u.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(u, 32).bitwiseOR(F.lit(1 << 32))


def one_step_down(cell: Column) -> Column:
    """The neighbours of a cell with one count less."""
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    on = lambda b: cell.bitwiseAND(bit(b)) != 0
    removable = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: on(b) & ((b % 2 == 1) | ~on(b + 1)))
    return F.transform(removable, lambda b: cell.bitwiseXOR(bit(b)))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints (column ``fp``) that lead
    to the same components as all pairs of up to ``bits`` (at most 3) differing
    bits do.

    First, the fingerprints of a cell that are within reach of its smallest one
    are linked to it alone.  Then the grid join runs between different components
    of those links only, so a dense cell of near copies yields no pairs within.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the grid covers up to 3 differing bits")
    rows = prints.select("fp", unary(F.col("fp")).alias("u"))
    own = rows.select("fp", F.explode(F.array(*cells(F.col("u")))).alias("cell"))
    first = own.groupBy("cell").agg(F.min("fp").alias("centre"))
    stars = own.join(first, "cell").filter((F.col("fp") != F.col("centre")) & (distance(F.col("fp"), F.col("centre")) <= bits))
    stars = cut(stars.select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct())
    roots = components(stars, "a", "b").select(F.col("node").alias("fp"), "root")
    rows = rows.join(roots, "fp", "left").select("fp", "u", F.coalesce("root", "fp").alias("root"))
    low, high = cells(F.col("u"))
    down = F.flatten(F.array(one_step_down(low), F.transform(one_step_down(F.shiftrightunsigned(F.col("u"), 32)), lambda c: c.bitwiseOR(F.lit(1 << 32)))))
    a = rows.select("fp", "u", "root", F.explode(F.array(low, high)).alias("cell")).alias("a")
    b = rows.select("fp", "u", "root", F.explode(F.concat(
        F.transform(F.array(low, high), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("beside"))),
        F.transform(down, lambda c: F.struct(c.alias("cell"), F.lit(True).alias("beside"))))).alias("at"))
    b = b.select("fp", "u", "root", "at.cell", "at.beside").alias("b")
    near = ((F.col("a.cell") == F.col("b.cell")) & (F.col("a.root") != F.col("b.root"))
            & (F.col("b.beside") | (F.col("a.fp") < F.col("b.fp")))
            & (distance(F.col("a.u"), F.col("b.u")) <= bits) & (distance(F.col("a.fp"), F.col("b.fp")) <= bits))
    return stars.unionByName(a.join(b, near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct())


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hexadecimal digits),
    ``component_id`` (the smallest id reachable over links of up to ``bits``
    differing bits, its own included).

    Null texts are empty; texts without a word have fingerprint zero, linked
    like any other.  A null id is never the smallest of others; a component of
    null ids alone has a null ``component_id``.  Repeated rows stay.  Other
    columns are ignored, an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle))
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(prints, bits), "a", "b")
    of = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = cut(of)
    named = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


ship_by_value(__name__)
