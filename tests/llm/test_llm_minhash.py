"""MinHash near-dedup against exact Jaccard similarity of all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from cadence.llm import minhash, queries, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


def brute(rows, size=3, percent=85):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if all_ and 100 * both >= percent * all_:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = []
    for k, (i, _) in enumerate(rows):
        known = [rows[m][0] for m in range(len(rows)) if find(m) == find(k) and rows[m][0] is not None]
        least = min(known, default=None)
        out.append((i, len(sets[k]), least, i == least))
    return sorted(out, key=repr)


def found(spark, rows, extra=(), **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    got = minhash.near_dedup(df, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
    return words


def test_near_copies_against_brute_force(spark):
    """Chains of edits around the threshold, boilerplate that many share, short texts."""
    rng = random.Random(7)
    rows = []
    for g in range(6):
        base = [f"g{g}x{i}" for i in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.randrange(2, 25)):
            rows.append((rng.randrange(10 ** 6), " ".join(base)))
            base = edited(rng, base, rng.randrange(0, 4))
    passage = " ".join(f"p{i}" for i in range(80))
    rows += [(2_000_000 + i, f"{passage} own{i} words{i} of{i} text{i} " + " ".join(f"o{i}_{k}" for k in range(rng.choice([5, 9, 12, 40])))) for i in range(30)]
    rows += [(3_000_000 + i, "one two") for i in range(3)] + [(3_000_010, "one two three"), (3_000_011, "ONE  two\tthree\n")]
    assert found(spark, rows) == brute(rows)


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a B"), (6, "a b c"), (6, "a b c"), (None, "A B C"), (None, "only nulls here"), (None, "only nulls HERE"),
            (7, "Ä b c"), (8, "ä b c"), (9, long), (10, long + " end"), (11, "a b c a b c a b c")]
    assert found(spark, rows, ("tag", "n", "bands", "node", "members", "id", "value")) == brute(rows)
    assert found(spark, []) == []


def test_other_sizes_and_thresholds(spark):
    rng = random.Random(1)
    base = [f"x{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(4)))) for i in range(25)]
    for size, percent in ((1, 95), (5, 90)):
        assert found(spark, rows, size=size, percent=percent) == brute(rows, size, percent)


def test_the_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op13_minhash_near_dedup"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_two_permutations_make_all_coordinates():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    for f in (minhash.pi, lambda v: minhash.sigma(v.astype(np.uint64) << np.uint64(32))):
        assert len(np.unique(f(x))) == len(x)  # one to one
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    sig = minhash.signatures(hashes, np.array([0, 200]))
    shuffled = minhash.sigma(hashes)
    for k in (0, 1, 77, 159):
        assert sig[0, k] == min(minhash.pi(shuffled[:200] - np.uint32(k))) and sig[1, k] == min(minhash.pi(shuffled[200:] - np.uint32(k)))


def test_coordinates_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    shares = []
    for _ in range(60):
        h = rng.integers(0, 1 << 63, 230, dtype=np.uint64)
        a, b = h[:200], h[30:]  # similarity 170 / 230
        sig = minhash.signatures(np.concatenate([a, b]), np.array([0, 200]))
        shares.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(shares) - 170 / 230) < 0.02


def test_exact_copies_are_banded_once(spark):
    """A group of exact copies of any size is one row of the joins."""
    rows = [(i, "the same text in all of these rows") for i in range(500)] + [(900, "another text that stands alone here")]
    assert found(spark, rows) == brute(rows)
