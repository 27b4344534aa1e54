"""Nearest neighbours and sharding against brute force, and their edge cases."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import ann, sharding

VECTORS = "vec_id long, embedding array<float>, label int"


def query():
    return F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))


def brute(rows, k=5):
    """vec_id -> the k best (id, cosine), ties to the smaller id."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    u = np.sqrt((x * x).sum(1))
    out = {}
    for q in sorted(set(i for i in ids if i % 50 == 0)):
        i = int(np.nonzero(ids == q)[0][0])
        s = (x * x[i]).sum(1) / (u * u[i])
        out[q] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def recall(found, want):
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want)
    return np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("block", [8192, 300])
def test_recall_on_random_and_clustered_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "CHUNK", 11)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 64))
    x = np.concatenate([rng.normal(size=(600, 64)), centres[rng.integers(0, 20, 600)] + 0.1 * rng.normal(size=(600, 64))]) * rng.uniform(0.1, 9, (1200, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    found = ann.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), query()).collect()
    want = brute(rows)
    assert recall(found, want) >= 0.9
    by = dict(rows)
    for r in found:
        a, b = np.array(by[r.query_id]), np.array(by[r.vec_id])
        assert math.isclose(r.score, float(a @ b / math.sqrt((a @ a) * (b @ b))), rel_tol=1e-12)


def test_exact_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=16).tolist()
    rows = [(i, hot if i % 3 else rng.normal(size=16).tolist()) for i in range(400)]
    found = ann.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), query()).collect()
    hot_ids = [i for i, v in rows if v is hot]
    for q in (50, 100, 200):  # copies of the hot vector
        if q in hot_ids:
            assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == [i for i in hot_ids if i != q][:5]


def test_vector_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [2.0, 0.0]), (6, [2.0, 0.0]), (None, [1.0, 0.0]),
            (7, [1.0, 1.0]), (50, [0.0, 1.0, 0.0]), (100, [0.0, 0.0]), (150, None), (8, []), (200, [-1.0, 0.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    for c in ("id", "v", "q", "rank", "score", "block"):
        df = df.withColumn(c, F.lit("clash"))
    got = ann.nearest(df, query())
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in got.collect())
    assert found == [(0, 1, 6, 1.0), (0, 2, 7, 0.707107), (0, 3, 7, 0.0), (0, 4, 200, -1.0),
                     (200, 1, 7, 0.0), (200, 2, 7, -0.707107), (200, 3, 0, -1.0), (200, 4, 6, -1.0)]
    assert ann.nearest(spark.createDataFrame([], VECTORS), query()).count() == 0
    assert ann.nearest(spark.createDataFrame([(1, [1.0], 0)], VECTORS), query()).count() == 0


# ---- sharding

def place(spark, rows, shards, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("_n", F.lit(1))
    return sharding.shard_rows(df.repartition(5), F.col("doc_id"), ["doc_id", "text"], shards, **options)


def walk(keys, shards, vnodes, slack):
    """The rule on a plain list: residents in ring order, then the overflow."""
    nodes = sharding.ring(shards, vnodes)
    caps = sharding.capacities(len(keys), shards, slack)
    load, over, out = [0] * shards, [], {}
    for cell, pos, key in sorted(keys):
        k = next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0)
        if load[nodes[k][1]] < caps[nodes[k][1]]:
            out[key] = (nodes[k][1], load[nodes[k][1]])
            load[nodes[k][1]] += 1
        else:
            over.append((k, key))
    for k, key in over:
        while load[nodes[k][1]] >= caps[nodes[k][1]]:
            k = (k + 1) % len(nodes)
        out[key] = (nodes[k][1], load[nodes[k][1]])
        load[nodes[k][1]] += 1
    return out


@pytest.mark.parametrize("shards,slack", [(16, 0.0), (5, 0.0), (7, 0.1), (1, 0.0)])
def test_sharding_against_the_rule(spark, shards, slack):
    rows = [(i * 7919, f"t{i}") for i in range(1013)]
    got = {r.doc_id: (r.shard, r.slot) for r in place(spark, rows, shards, vnodes=8, slack=slack).collect()}
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("doc_id").alias("pos"))
    keys = [(r.pos % sharding.RING_CELLS, r.pos, r.doc_id) for r in df.collect()]
    assert got == walk(keys, shards, 8, slack)


def test_sharding_laws(spark):
    rows = [(i, "x") for i in range(999)]
    got = place(spark, rows, 16).collect()
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
    sizes = [len(x) for x in per.values()]
    assert set(per) == set(range(16)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in per.values())
    # a new shard takes about its share, and few others move
    loose = {n: {r.doc_id: r.shard for r in place(spark, rows, n, slack=0.25).collect()} for n in (16, 17)}
    moved = sum(loose[16][i] != loose[17][i] for i in loose[16])
    assert moved < 0.3 * len(rows)


def test_sharding_cases(spark):
    rows = [(None, None), (None, None), (1, ""), (1, ""), (2, "x" * 200_000), (3, None)]
    got = place(spark, rows, 4)
    assert got.columns == ["doc_id", "text", "_n", "shard", "slot"] and got.count() == 6
    counts = [r[1] for r in got.groupBy("shard").count().collect()]
    assert sorted(counts) == [1, 1, 2, 2]
    assert place(spark, [], 4).count() == 0


def test_overfull_ring_is_an_error():
    with pytest.raises(ValueError):
        sharding.plan_cells({5: 9}, [(1, 0), (9, 1)], [4, 4])


def test_query_columns_follow_the_text(spark, tmp_path):
    from cadence.llm.queries import op9_sharding
    rows = [(i, t) for i, t in enumerate([None, "", "é" * 3, "a\nb", "long " * 50_000])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in op9_sharding(spark, str(tmp_path)).collect():
        data = (rows[r.doc_id][1] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
