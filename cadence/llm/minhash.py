"""MinHash near-dedup with circulant signatures.

Two permutations of the universe (32-bit shingle numbers) make all coordinates:
``sigma`` shuffles a shingle once, and coordinate k is the least
``pi(sigma(x) - k)``, that is, under ``pi`` shifted circularly by k.  The
coordinates are banded; sets that share a band's value are candidates, and a
candidate pair is a link only if the Jaccard similarity of the full sets says so.

With bands of ``ROWS`` coordinates a pair at similarity s shares none of
``BANDS`` bands with probability (1 - s ** ROWS) ** BANDS: 7e-9 at 0.85.

Equal sets collapse to one before banding.  In a band's bucket every set is first
compared with the bucket's smallest one only; what those links connect needs no
more comparison, so a bucket of near copies yields a row per copy.  Then sets of
one bucket that are still apart, and of sizes that could reach the threshold, are
compared with each other inside the join, on halves of their hashes, and what it
hands on is confirmed on the full sets.  What stays quadratic is that comparison,
of sets in one bucket that no link connects.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import cut, ship_by_value, stored
from cadence.llm.components import components

BANDS, ROWS = 32, 5
#: shingles whose coordinates are computed at a time
STRETCH = 1 << 14
#: odd multipliers that weigh the coordinates of a band, and one for its place
WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
BAND = np.uint64(0xE7037ED1A0B428DB)


def shingles(text: str, size: int = 3) -> set[bytes]:
    """The distinct word shingles, ASCII letters lowered; of fewer words, all as
    one; none without a word."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(size)))))


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def sigma(hashes: np.ndarray) -> np.ndarray:
    return _permute((hashes >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)


def pi(x: np.ndarray) -> np.ndarray:
    return _permute(x, 0x21F0AAAD, 0xD35A2D97)


def signatures(hashes: np.ndarray, starts: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """One row of coordinates per set; the sets' hashes lie one after the other,
    each set's from its place in ``starts``."""
    shuffled = sigma(hashes)
    out = np.empty((len(starts), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(pi(shuffled - np.uint32(k)), starts)
    return out


def band_values(signature: np.ndarray) -> np.ndarray:
    """One number per band of each row, the band's own place among them mixed in."""
    parts = signature.reshape(len(signature), -1, ROWS).astype(np.uint64)
    total = (parts * WEIGHTS).sum(2, dtype=np.uint64) + np.arange(parts.shape[1], dtype=np.uint64) * BAND
    total ^= total >> np.uint64(32)
    total *= WEIGHTS[0]
    return (total ^ (total >> np.uint64(29))).view(np.int64)


def hashed_set(text: str, size: int) -> np.ndarray:
    return np.unique(np.array([xxhash.xxh3_64_intdigest(s) for s in shingles(text, size)], np.uint64))


def _banded(sets: list[np.ndarray]) -> list[list[int]]:
    """The band values of each set (none of an empty one)."""
    out: list[list[int]] = [[] for _ in sets]
    todo = [i for i, s in enumerate(sets) if len(s)]
    while todo:
        some, size = [], 0
        while todo and size < STRETCH:
            some.append(todo.pop())
            size += len(sets[some[-1]])
        starts = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
        values = band_values(signatures(np.concatenate([sets[i] for i in some]), starts))
        for i, bands in zip(some, values.tolist()):
            out[i] = bands
    return out


SIGNED = "id long, node binary, n long, bands array<long>, members array<long>"


def signed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, ``node`` (128-bit digest of the set; null if empty), ``n`` (its size),
    ``bands`` and ``members`` (the shingles' 64-bit hashes)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 256):
                b = whole.slice(lo, 256)
                sets = [hashed_set(t.as_py() or "", size) for t in b.column("text")]
                nodes = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(nodes, pa.binary()), pa.array(map(len, sets), pa.int64()),
                     pa.array(_banded(sets), pa.list_(pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                    names=["id", "node", "n", "bands", "members"])

    return rows.mapInArrow(run, SIGNED)


def _reach(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _linked(n: Column, m: Column, shared: Column, percent: int) -> Column:
    return 100 * shared >= percent * (n + m - shared)


def _sets(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """``tag``, ``bands`` and ``members`` of the rows with these tags.  A set is named
    by one row that has it, so no key repeats.  The tags are written out: their size
    is known when the join is planned, and rows are not shuffled if it is small."""
    return stored(rows.select("tag", "bands", "members").join(stored(tags.distinct()), "tag", "left_semi"))


def _confirmed(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets reach the threshold."""
    full = _sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("tag")))
    side = lambda c: full.select(F.col("tag").alias(c), F.col("members").alias(f"set_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(_linked(F.size("set_a"), F.size("set_b"), F.size(F.array_intersect("set_a", "set_b")), percent)).select("a", "b")


def links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``: links between distinct sets that connect what all pairs at or
    over the threshold do.  ``sets`` has the ``tag`` of one row of each; ``rows``
    has ``tag``, ``n``, ``bands`` and ``members``."""
    banded = rows.select("tag", "n", "bands").join(sets.select("tag"), "tag", "left_semi")
    banded = stored(banded.select("tag", "n", F.explode("bands").alias("value")))
    first = banded.groupBy("value").agg(F.min(F.struct("tag", "n")).alias("first"), F.max("tag").alias("last"))
    first = stored(first.filter(F.col("first.tag") != F.col("last")).select("value", "first"))
    shared = stored(banded.join(first, "value"))
    apart = (F.col("tag") != F.col("first.tag")) & _reach(F.col("n"), F.col("first.n"), percent)
    stars = stored(shared.filter(apart).select(F.col("first.tag").alias("a"), F.col("tag").alias("b")).distinct())
    found = stored(_confirmed(stars, rows, percent))
    roots = components(found, "a", "b").select(F.col("node").alias("tag"), "root")
    shared = shared.select("tag", "n", "value").join(roots, "tag", "left").withColumn("root", F.coalesce("root", "tag"))
    # only buckets with members still apart go on
    mixed = shared.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("value")
    shared = stored(shared.join(mixed, "value", "left_semi"))
    # half of each hash is enough to tell almost all pairs that are too different
    halves = _sets(rows, shared.select("tag")).select("tag", "bands", F.array_distinct(
        F.transform("members", lambda x: F.shiftright(x, 32).cast("int"))).alias("halves"))
    compared = shared.join(halves, "tag")
    a, b = compared.alias("a"), compared.alias("b")
    both = lambda c: F.array_intersect(f"a.{c}", f"b.{c}")
    near = ((F.col("a.value") == F.col("b.value")) & (F.col("a.tag") < F.col("b.tag")) & (F.col("a.root") != F.col("b.root"))
            & _reach(F.col("a.n"), F.col("b.n"), percent)
            # a pair is compared in the least of the buckets that it shares
            & (F.array_min(both("bands")) == F.col("a.value"))
            # members that share their halves count as shared with the other set: no link is lost
            & _linked(F.col("a.n"), F.col("b.n"), F.size(both("halves")) + F.col("a.n") - F.size("a.halves"), percent))
    pairs = stored(a.join(b, near).select(F.col("a.tag").alias("a"), F.col("b.tag").alias("b")))
    return found.unionByName(_confirmed(pairs, rows, percent))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 3, percent: int = 85) -> DataFrame:
    """One row per input row: id, ``n_shingles`` (size of its set of word
    shingles), ``component_id`` (the smallest id reachable over links of at least
    ``percent`` hundredths of Jaccard similarity, its own included), ``kept``
    (whether that is its own id).

    Null and empty texts and texts without a word have an empty set and are linked
    with nothing.  A null id is never the smallest of others; a component of null
    ids alone has a null ``component_id`` and keeps its rows, as rows that repeat
    an id are kept or dropped alike.  Other columns are ignored, an empty table
    gives no rows.
    """
    rows = stored(signed(docs, id_col, text_col, size).withColumn("tag", F.monotonically_increasing_id()))
    sets = stored(rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min("tag").alias("tag")))
    roots = components(links(rows, sets, percent), "a", "b").select(F.col("node").alias("tag"), "root")
    of = cut(sets.join(roots, "tag", "left").select("node", "least", F.coalesce("root", "tag").alias("root")))
    named = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    out = rows.select("id", "node", "n").join(named, "node", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      component.eqNullSafe(F.col("id")).alias("kept"))


ship_by_value(__name__)
