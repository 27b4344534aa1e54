"""The Merkle manifest against trees built in one go, and its persistent blocks."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadence.llm import merkle, queries  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r, plus=0):
    n = None if r[4] is None else r[4] + plus
    values = [None if v is None else str(v) for v in (r[0], r[3], r[2], n, r[1])]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, at):
    """(sibling or "", whether it is on the left) from a leaf to the top."""
    out = []
    for level in tree[:-1]:
        other = at ^ 1
        out.append((level[other] if other < len(level) else "", bool(at & 1)))
        at //= 2
    return out


def climb(value, steps):
    for other, left in steps:
        value = sha(other + value if left else value + other)
    return value


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = levels([leaf_of(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, r in enumerate(groups[g]):
            steps = way(trees[g], at) + way(top, k)
            chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = climb(leaf_of(r, int(chosen)), steps)
            out.append((r[0], leaf_of(r), trees[g][-1][0], top[-1][0], sha("".join(x for x, _ in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def found(spark, rows, extra=()):
    df = spark.createDataFrame(rows, DOCS)
    for c in extra:
        df = df.withColumn(c, F.lit("clash"))

    def leaf(n):
        return merkle.row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))

    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return merkle.manifest(df.repartition(3), leaf(F.col("n_chars")), F.when(chosen, leaf(F.col("n_chars") + 1)))


def rows_of(sizes, rng):
    out, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            k += rng.randrange(1, 4)
            out.append((k, rng.choice([None, "", "text é", "long " * 50]) and f"text {k} é", lang, rng.choice(["a", None]), rng.choice([None, 0, 7, 123])))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("bits,sizes", [
    (2, {"en": 70, "de": 16, "fr": 17, "es": 1, None: 5, "é": 4, "Z": 3}), (1, {"en": 21}), (3, {None: 8}), (10, {"en": 9, "de": 2}),
    (2, {f"l{i}": 1 for i in range(11)})])
def test_manifest_against_whole_trees(spark, monkeypatch, bits, sizes):
    """Blocks of 2 to 8 nodes: several levels of blocks, partial ones, lone nodes."""
    monkeypatch.setattr(merkle, "LEVELS", bits)
    monkeypatch.setattr(merkle, "BLOCK", 1 << bits)
    rows = rows_of(sizes, random.Random(bits))
    got = found(spark, rows)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.columns == [*columns, "copied"]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == brute(rows)


def test_cases(spark):
    rows = [(1, None, None, None, None), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1), (5, "a", "en", "s", 1), (5, "a", "en", "s", 1), (5, "b", "en", "s", 1),
            (7, "w " * 200_000, "de", "s", 400_000), (-3, "", "", "", 0), (22, "t", "en", None, None)]
    got = found(spark, rows, ("grp", "pos", "value", "tie", "id", "leaf", "n", "tampered"))
    assert sorted((tuple(r)[:7] for r in got.collect()), key=repr) == brute(rows)
    assert found(spark, []).count() == 0
    one = found(spark, [(4, "only", "en", "s", 4)]).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("") and one.verified


@given(st.integers(1, 40), st.data())
def test_versions_share_all_but_ancestors(n, data):
    height = (n - 1).bit_length()
    leaves = [sha(str(i)) for i in range(n)]
    tree = merkle.PersistentTree(leaves, height)
    first, before = tree.first_version, list(tree.nodes)
    version, state = first, list(leaves)
    for _ in range(3):
        at = data.draw(st.integers(0, n - 1))
        size = len(tree.nodes)
        version = tree.changed(version, at, sha(f"new{at}{size}"))
        state[at] = sha(f"new{at}{size}")
        assert len(tree.nodes) - size == height + 1  # the leaf and its ancestors
        assert tree.top(version) == levels(state)[-1][0]
        for k in range(n):
            steps = [(p[1:], p[:1] == "<") for p in tree.path(version, k)]
            assert climb(state[k], steps) == tree.top(version) == merkle.fold(state[k], tree.path(version, k))
    # older versions stay as they were
    assert tree.nodes[:len(before)] == before and tree.top(first) == levels(leaves)[-1][0]


def test_positions_follow_the_order_across_partitions(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("grp"), (F.col("id") * 7919 % 3000).alias("x"))
    got = merkle.ranked(df, "grp", ["x"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.grp, []).append(r)
    assert len(got) == 3000
    for of in by.values():
        of.sort(key=lambda r: r.x)
        assert [r.pos for r in of] == list(range(len(of))) and {r.n for r in of} == {len(of)}
