"""Exact dedup by content hash, with the bytes compared inside each group.

Built from DataFrame functions alone.  Texts are grouped by a 128-bit hash and
their length, and no text is shuffled for that.  Only the texts of groups of two
or more are then looked at again: each group gathers the distinct ones, which the
map-side combine reduces to one per task unless hashes collide, so Spark compares
the bytes.  The rows under a collided hash are matched by their texts.

The rows of these groups are found by a 32-bit code of (hash, length).  A code takes
4 bytes a group, so Spark sends them to the rows up to some two million groups, and no
other text is shuffled; beyond its broadcast threshold each text is shuffled once.  A
row that shares its code with such a group by chance is looked at too, which changes
nothing: its own group has one text.

A group may hold any share of the rows: it is combined before each shuffle, and
the rows are joined back to its one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest",
                normalise: Callable[[Column], Column] = lambda c: c,
                content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per input row: id, ``keep_id`` (the id that stays in its group
    of equal normalised texts), ``group_size``, ``kept``, ``text_sha256``.

    ``keep``: "smallest" or "largest" id of the group.  A null text counts as
    empty.  Null ids never win over others; a group with null ids alone has a
    null ``keep_id`` and keeps its rows.  Rows that repeat an id within a group
    are the same document: each counts in ``group_size`` and each is kept if
    that id is.  Other columns are ignored, an empty table gives no rows.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    agg = (best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rows = docs.select(F.col(id_col).alias("id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    hashed = rows.select("id", "t", content_hash(F.col("t")).alias("h"), F.octet_length("t").alias("size"))
    sha = F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")
    groups = stored(hashed.groupBy("h", "size").agg(*agg))
    # written out, the codes' size is known when the join is planned
    code = F.hash("h", "size").alias("code")
    several = stored(groups.filter("group_size > 1").select(code))
    again = hashed.select("*", code).join(several, "code", "left_semi")
    collided = stored(again.groupBy("h", "size").agg(F.collect_set("t").alias("texts")).filter(F.size("texts") > 1).select("h", "size"))
    joined = hashed.select("id", "h", "size", sha).join(groups, ["h", "size"])
    if not collided.isEmpty():
        shared = hashed.join(collided, ["h", "size"], "left_semi")
        by_bytes = shared.groupBy("h", "size", "t").agg(*agg)
        joined = (joined.join(collided, ["h", "size"], "left_anti").select("id", "text_sha256", "keep_id", "group_size")
                  .unionByName(shared.join(by_bytes, ["h", "size", "t"]).select("id", sha, "keep_id", "group_size")))
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size",
                         F.col("keep_id").eqNullSafe(F.col("id")).alias("kept"), "text_sha256")
