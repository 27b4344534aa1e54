"""Exact, line and SimHash dedup against brute force, and their edge cases."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from cadence.llm import components, exact_dedup, line_dedup, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=()):
    """Documents of (id, text), with columns that clash with results."""
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    return df


LONG = "word " * 60_000


def test_exact_dedup_cases(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, "ä"), (4, "Ä"), (5, None), (6, ""), (7, LONG), (8, LONG), (2, "AB"), (None, "ab"), (None, "only null")]
    df = docs(spark, rows, ("keep_id", "kept", "h", "t", "id", "group_size"))
    got = exact_dedup.exact_dedup(df, keep="largest", normalise=exact_dedup.ascii_lower)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    found = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=str)
    assert found == sorted([(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (None, 2, 4, False), (3, 3, 1, True), (4, 4, 1, True),
                            (5, 6, 2, False), (6, 6, 2, True), (7, 8, 2, False), (8, 8, 2, True), (None, None, 1, True)], key=str)
    sha = {r.doc_id: r.text_sha256 for r in got.collect()}
    assert sha[1] == hashlib.sha256(b"ab").hexdigest() and sha[4] == hashlib.sha256("Ä".encode()).hexdigest()


def test_exact_dedup_smallest_and_empty(spark):
    got = exact_dedup.exact_dedup(docs(spark, [(3, "x"), (9, "x")]))
    assert {r.keep_id for r in got.collect()} == {3}
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_compares_bytes_under_colliding_hashes(spark):
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "bb", "longer", "aa"])]
    got = exact_dedup.exact_dedup(docs(spark, rows), content_hash=lambda t: F.length(t).cast("string"))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == [
        (0, 0, 3), (1, 1, 2), (2, 0, 3), (3, 3, 1), (4, 1, 2), (5, 5, 1), (6, 0, 3)]


def test_exact_dedup_sends_codes_of_groups_to_the_rows(spark, monkeypatch):
    """Twenty bytes a group would exceed the threshold, and all texts be shuffled."""
    plans, stored = [], exact_dedup.stored
    monkeypatch.setattr(exact_dedup, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        df = spark.range(0, 12_000, 1, 3).selectExpr("id AS doc_id", "CASE WHEN id < 10000 THEN concat('text ', id % 5000) ELSE concat('own ', id) END AS text")
        found = exact_dedup.exact_dedup(df).groupBy("group_size", "kept").count().collect()
        assert {(r[0], r[1]): r[2] for r in found} == {(2, True): 5000, (2, False): 5000, (1, True): 2000}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    collisions = [p for p in plans if "collect_set" in p]
    assert len(collisions) == 1 and "BroadcastHashJoin" in collisions[0] and "SortMergeJoin" not in collisions[0]


def test_exact_dedup_of_groups_that_share_a_code(spark):
    texts = spark.range(400_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("t"))
    coded = texts.select("t", F.hash(exact_dedup.md5_128(F.col("t")), F.octet_length("t")).alias("code"))
    a, b = coded.groupBy("code").agg(F.min("t"), F.max("t"), F.count("t").alias("n")).where("n > 1").first()[1:3]
    got = exact_dedup.exact_dedup(docs(spark, [(1, a), (2, a), (3, b), (4, b + "x"), (5, b + "x")]))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 2), (5, 4, 2)]


def brute_lines(rows, k, words):
    """The rule itself: a line goes if any stretch over it that counts occurs earlier."""
    seqs = {i: [(n, x) for n, x in enumerate((t or "").split("\n")) if x.split()] for i, t in rows}
    gone, met = {i: set() for i in seqs}, set()
    for i in sorted(seqs):
        lines = [x for _, x in seqs[i]]
        for s in range(len(lines)):
            new = [tuple(lines[s:e]) for e in range(s + 1, len(lines) + 1) if e - s >= k or sum(len(x.split()) for x in lines[s:e]) >= words]
            for x in new:
                if x in met:
                    gone[i].update(seqs[i][j][0] for j in range(s, s + len(x)))
            met.update(new)
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in rows}


@pytest.mark.parametrize("k,words", [(1, 50), (2, 4), (3, 50), (3, 6), (4, 9)])
def test_line_dedup_against_brute_force(spark, k, words):
    rng = random.Random(k)
    rows = [(i, "\n".join(rng.choice(["a", "b b", "c c c", "d d d d d", "", "  ", "x%d" % rng.randrange(9)]) for _ in range(rng.randrange(12))))
            for i in range(60)] + [(97, None), (98, ""), (99, "\n\n")]
    got = line_dedup.line_dedup(docs(spark, rows).repartition(5), min_lines=k, min_words=words).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows, k, words)
    assert all(r.n_removed == (r.text is not None and (r.n_lines - len(r.text.split("\n")) if r.text or r.n_removed < r.n_lines else r.n_lines)) for r in got if r.text)


def test_whole_runs_reach_short_last_lines(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(25)) for c in "ab")
    rows = [(i, f"x{i}\n{a}\n{b}\nlast of them\ny{i}") for i in (1, 2, 3)] + [(4, "z\nlast of them")]
    got = line_dedup.line_dedup(docs(spark, rows)).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == {1: (rows[0][1], 0), 2: ("x2\ny2", 3), 3: ("x3\ny3", 3), 4: (rows[3][1], 0)}


def test_line_dedup_cases(spark):
    one = "\n".join(f"line {i} of a long passage" for i in range(300))
    rows = [(5, one), (2, one), (None, "p\nq\nr"), (7, "p\nq\nr\nnew"), (8, "same\nsame\nsame\nsame"), (9, "u\nv\nw"), (9, "u\nv\nw"), (4, None), (3, "")]
    df = docs(spark, rows, ("n_removed", "runs", "h", "th", "at", "_x"))
    got = line_dedup.line_dedup(df)
    assert got.columns == [c for c in df.columns if c != "n_removed"] + ["n_lines", "n_removed"]
    by = sorted(((r.doc_id, r.text, r.n_removed) for r in got.collect()), key=str)
    assert by == sorted([(2, one, 0), (5, "", 300), (None, "p\nq\nr", 0), (7, "new", 3), (8, "same", 3), (9, "u\nv\nw", 0), (9, "u\nv\nw", 0),
                         (4, None, 0), (3, "", 0)], key=str)
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def test_single_long_line_is_a_run(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    got = line_dedup.line_dedup(docs(spark, [(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd"), (3, "short\nx"), (4, "short\ny")]))
    assert {r.doc_id: r.text for r in got.collect()} == {1: f"a\n{passage}\nb", 2: "c\nd", 3: "short\nx", 4: "short\ny"}


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_the_definition(spark):
    texts = ["", " \t\n", "One", "one TWO", "a b c", "a b c d e " * 40, "É é Straße\x0bx\x0cy z", None, "x y z w"]
    got = simhash.fingerprints(docs(spark, list(enumerate(texts))), "doc_id", "text", 3)
    assert {r.id: r.fp % (1 << 64) for r in got.collect()} == {i: brute_print(t) for i, t in enumerate(texts)}
    assert simhash.fingerprint("a b c d " * 20_000) == brute_print("a b c d " * 20_000)
    # the hash is Spark's own, too
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", seed=42)


def test_unary_embedding_is_a_lower_bound(spark):
    rng = random.Random(3)
    pairs = [(a := rng.getrandbits(64), a ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6)))) for _ in range(300)]
    df = spark.createDataFrame([(a - (1 << 64) * (a >> 63), b % (1 << 64) - (1 << 64) * (b % (1 << 64) >> 63)) for a, b in pairs], "a long, b long")
    count = lambda x: [bin(x >> 2 * i & 3).count("1") for i in range(32)]
    for r in df.select("a", "b", simhash.distance(simhash.unary(F.col("a")), simhash.unary(F.col("b"))).alias("d"), simhash.distance(F.col("a"), F.col("b")).alias("h")).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert r.d == sum(abs(x - y) for x, y in zip(count(a), count(b))) <= r.h == bin(a ^ b).count("1")


def brute_components(prints, bits=3):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ps = list(root)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if bin(a ^ b).count("1") <= bits:
                root[find(a)] = find(b)
    groups = {}
    for p in ps:
        groups.setdefault(find(p), set()).add(p)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_links_against_brute_force(spark, bits):
    rng = random.Random(bits)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):  # dense clusters, chains and strays
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
    signed = [(p - (1 << 64) * (p >> 63),) for p in prints]
    df = spark.createDataFrame(signed, "fp long")
    links = simhash.links(df, bits)
    assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= bits for r in links.collect())
    found = components.components(links, "a", "b").collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node % (1 << 64))
    assert {frozenset(g) for g in groups.values()} == {g for g in brute_components(prints, bits) if len(g) > 1}
    assert all(r.root % (1 << 64) in groups[r.root] and r.root <= r.node for r in found)


def test_simhash_cases(spark):
    base = [f"w{i}" for i in range(400)]
    near = base[:-1] + ["changed"]
    rows = [(4, " ".join(base)), (9, " ".join(near)), (2, " ".join(base).upper()), (5, None), (6, ""), (7, " \n"), (8, "other words here"), (None, "null id text"),
            (1, LONG), (3, LONG), (3, LONG)]
    df = docs(spark, rows, ("fp", "id", "component_id", "cell", "u"))
    got = simhash.near_dedup(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    found = sorted(((r.doc_id, r.component_id) for r in got.collect()), key=str)
    assert found == sorted([(4, 2), (9, 2), (2, 2), (5, 5), (6, 5), (7, 5), (8, 8), (None, None), (1, 1), (3, 1), (3, 1)], key=str)
    assert {r.fingerprint for r in got.collect() if r.doc_id in (5, 6, 7)} == {"0" * 16}
    assert simhash.near_dedup(docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 200).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    got = components.components(chain.union(spark.createDataFrame([(500, 500), (901, 900)], "a long, b long")), "a", "b").collect()
    assert sorted((r.node, r.root) for r in got) == [(i, 0) for i in range(200)] + [(900, 900), (901, 900)]
