"""Approximate nearest neighbours by collision counting.

Vectors are scaled to length one and projected on ``PROJECTIONS`` random lines; a
block of them keeps, per line, its rows sorted by projection.  A query takes a
window around its own projection on each line, and windows grow together with
the radius (virtual rehashing: the arrays stay as they are).  A vector that lies
in at least ``threshold`` of the windows is verified by its exact cosine.  At
radius R the threshold is set so that a vector at distance R is verified nine
times in ten or more, nearer ones more surely; the search ends when as many
verified vectors as asked for lie within R, at the latest when all are verified.

Spark deals the distinct vectors into blocks and the queries into chunks, both of
bounded size, brings every chunk to every block and merges the blocks' best.  A
vector that many rows share is searched once; of its rows the smallest ids
suffice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import ship_by_value, stored

PROJECTIONS, SEED = 96, 11
#: radii at which windows stop to count, on vectors of length one; after the last one, everything is verified
RADII = (0.1, 0.2, 0.4, 0.6, 0.8, 0.9, 0.97, 1.03, 1.08, 1.13, 1.18, 1.24, 1.3)
BLOCK, CHUNK, STEP = 8192, 1 << 16, 256


def threshold(projections: int = PROJECTIONS, z: float = 1.3) -> int:
    """Windows that a vector at the radius falls into, less z deviations: a
    window reaches one radius to either side, so one holds it with p = 0.683."""
    p = math.erf(1 / math.sqrt(2))
    return max(1, math.floor(projections * p - z * math.sqrt(projections * p * (1 - p))))


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float64)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.lines = np.random.default_rng(SEED).normal(size=(vectors.shape[1], PROJECTIONS))
        p = (self.vectors / self.norms[:, None]) @ self.lines
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(p, self.order.T, 0).T.copy()

    def cosines(self, q: np.ndarray, norm: float, rows: np.ndarray) -> np.ndarray:
        return (self.vectors[rows] * q).sum(1) / (self.norms[rows] * norm)

    def windows(self, queries: np.ndarray) -> np.ndarray:
        """First and last place + 1 on every line, for every query and radius:
        (queries, radii, 2, lines)."""
        at = (queries / np.sqrt((queries * queries).sum(1))[:, None]) @ self.lines
        radii = np.array(RADII)
        out = np.empty((len(queries), len(RADII), 2, PROJECTIONS), np.int32)
        for i, s in enumerate(self.sorted):
            out[:, :, 0, i] = np.searchsorted(s, at[:, i, None] - radii, "left")
            out[:, :, 1, i] = np.searchsorted(s, at[:, i, None] + radii, "right")
        return out

    def search(self, queries: np.ndarray, enough) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the verified rows and their cosines.  ``enough(rows)``
        tells whether so many rows suffice."""
        for lo in range(0, len(queries), STEP):
            part = queries[lo:lo + STEP].astype(np.float64)
            for q, w in zip(part, self.windows(part)):
                yield self._search(q, w, enough)

    def _search(self, q: np.ndarray, windows: np.ndarray, enough) -> tuple[np.ndarray, np.ndarray]:
        n, need, norm = len(self.vectors), threshold(), math.sqrt((q * q).sum())
        counts, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        rows, cos = np.zeros(0, np.int64), np.zeros(0)
        inner = None
        for radius, (a, b) in zip(RADII, windows.tolist()):
            if inner is None:
                grown = [o[i:j] for o, i, j in zip(self.order, a, b)]
            else:
                grown = [o[i:j] for o, i, j in zip(self.order, a, inner[0])] + [o[i:j] for o, i, j in zip(self.order, inner[1], b)]
            counts += np.bincount(np.concatenate(grown), minlength=n)
            inner = (a, b)
            new = np.nonzero((counts >= need) & ~seen)[0]
            if len(new):
                seen[new] = True
                rows, cos = np.concatenate((rows, new)), np.concatenate((cos, self.cosines(q, norm, new)))
            # distance within the radius, as a cosine
            if len(rows) and enough(rows[cos >= 1 - radius * radius / 2]):
                return rows, cos
        new = np.nonzero(~seen)[0]
        return np.concatenate((rows, new)), np.concatenate((cos, self.cosines(q, norm, new)))


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: of each query row the
    ``k`` nearest rows found by cosine, ties to the smaller id.

    All rows are candidates but those with the query's own id.  Rows with a null
    id, or a vector that is null, zero or holds null or non-finite components,
    take no part, and vectors are compared with those of their own length.  A
    row that repeats an id and vector counts once.  With fewer than ``k``
    candidates all are given; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), is_query.alias("q"))
    rows = stored(rows.filter(F.col("id").isNotNull()).filter(usable(F.col("v"))).groupBy("id", "v").agg(F.max("q").alias("q")))
    first = Window.partitionBy("v").orderBy("id")
    # k + 1 ids of a vector are enough, one of them may be the query's own
    held = (rows.select("id", "v").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
            .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = rows.filter("q").groupBy("v").agg(F.min("id").alias("qid"))
    held = stored(held)
    blocks, chunks = -(-held.count() // BLOCK), -(-asked.count() // CHUNK)
    part = lambda n, x: F.pmod(F.xxhash64(x), F.lit(max(1, n))).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    data = held.select(F.size("v").alias("dim"), part(blocks, "v").alias("block"), spread(chunks).alias("chunk"), "ids", "v")
    # the hash of the id, not of the vector, so that a chunk's queries are spread alike over the blocks
    wanted = asked.select(F.size("v").alias("dim"), spread(blocks).alias("block"), part(chunks, "qid").alias("chunk"), "qid", "v")

    def search(key, d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(d) and len(q):
            index, ids = Index(np.stack(d["v"].to_numpy())), d["ids"].to_numpy()
            copies = np.array([len(x) for x in ids])
            for qid, (found, cos) in zip(q["qid"], index.search(np.stack(q["v"].to_numpy()), lambda r: copies[r].sum() > k)):
                # only the best k + 1 vectors of the block, and those equal to the last, can be among the k + 1 best rows
                if len(found) > k + 1:
                    keep = cos >= np.partition(cos, -(k + 1))[-(k + 1)]
                    found, cos = found[keep], cos[keep]
                best = sorted((-c, int(i)) for r, c in zip(found, cos) for i in ids[r])[:k + 1]
                out += [(int(qid), i, -c) for c, i in best]
        return pd.DataFrame(out, columns=["qid", "vec_id", "score"]).astype({"qid": "int64", "vec_id": "int64", "score": "float64"})

    grid = ["dim", "block", "chunk"]
    found = data.groupBy(*grid).cogroup(wanted.groupBy(*grid)).applyInPandas(search, "qid long, vec_id long, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("r") <= k + 1).drop("r")
    queries = rows.filter("q").select(F.col("id").alias("query_id"), "v").join(asked, "v").select("query_id", "qid")
    own = queries.join(found, "qid").filter("vec_id <> query_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ship_by_value(__name__)
