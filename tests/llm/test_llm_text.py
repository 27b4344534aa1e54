"""Language ID, toxicity, mixing, BPE and chat formatting."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadence.llm import bpe, chat, langid, mixing, queries, registry, sampling, subword, toxicity  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"
DATA = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
VOCABULARY = bpe.Vocabulary(bpe.parse_ranks(DATA))
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})


def single(data):
    """BPE of one piece; the library takes no empty one."""
    return ORACLE._encode_single_piece(data) if data else []


def docs(spark, rows, extra=()):
    df = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], DOCS)
    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    return df


EDGES = [(1, None, None), (2, "", "en"), (3, "12 34 !!", None), (4, "the cat " * 40_000, "en"), (None, "the dog", "en"), (6, "der Hund", "de"), (6, "der Hund", "de")]


# ---- BPE

@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=60))
def test_prefix_encoding_equals_bpe(data):
    assert bpe.PrefixEncoding(VOCABULARY, data).ids() == single(data)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abehinorst ABCt'é中😀 \n09<|", max_size=40), st.text(alphabet="abehinorst é", max_size=10), st.data())
def test_appends_and_edits_are_exact(text, new, data):
    raw = text.encode()
    cut = data.draw(st.integers(0, len(raw)))
    e = bpe.PrefixEncoding(VOCABULARY, raw[:cut])
    assert e.append(raw[cut:]).ids() == single(raw)
    a = data.draw(st.integers(0, len(raw)))
    b = data.draw(st.integers(a, len(raw)))
    assert e.edit(a, b, new.encode()).ids() == single(raw[:a] + new.encode() + raw[b:])


def test_an_edit_is_encoded_near_its_place(monkeypatch):
    """Bytes encoded for an edit do not grow with the piece, wherever it is."""
    rng, done, append = random.Random(3), [], bpe.PrefixEncoding.append
    monkeypatch.setattr(bpe.PrefixEncoding, "append", lambda self, more: done.append(len(more)) or append(self, more))
    data = "".join(rng.choice(["re", "ou", "nt", "tion", "a", "the", "q", "é"]) for _ in range(20_000)).encode()
    e = bpe.PrefixEncoding(VOCABULARY, data)
    for at in (0, 5_000, len(data) - 40):
        done.clear()
        raw = e.data[:at] + b"xyz" + e.data[at + 2:]
        assert e.edit(at, at + 2, b"xyz").ids() == single(raw) and e.data == raw
        assert sum(done) < 20 * VOCABULARY.longest


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é中😀 \n\t09<|'s", max_size=40), st.lists(st.tuples(st.text(alphabet="ab '\n 9", max_size=6), st.floats(0, 1), st.floats(0, 1)), max_size=4))
def test_text_edits_are_exact(text, edits):
    e = bpe.TextEncoding(bpe.Encoder(VOCABULARY, public_tokenizers.PATTERN), text)
    for new, x, y in edits:
        a, b = sorted((int(x * len(text)), int(y * len(text))))
        text = text[:a] + new + text[b:]
        assert e.edit(a, b, new).ids() == ORACLE.encode_ordinary(text)
        fresh = bpe.TextEncoding(e.encoder, text)
        assert e.text == text and e.matches == fresh.matches
    assert e.append(" more'").ids() == ORACLE.encode_ordinary(text + " more'")


def test_text_edits_reuse_matches(monkeypatch):
    e = bpe.TextEncoding(bpe.Encoder(VOCABULARY, public_tokenizers.PATTERN), "some words here " * 5000)
    met, piece = [], bpe.Encoder.piece
    monkeypatch.setattr(bpe.Encoder, "piece", lambda self, p: met.append(p) or piece(self, p))
    assert e.edit(400, 404, "X y").ids() == ORACLE.encode_ordinary(e.text) and len(met) < 10


def test_long_pieces_stay_linear():
    data = b"ab" * 30_000
    assert bpe.PrefixEncoding(VOCABULARY, data).ids() == single(data)


def test_encode_texts_equals_the_library(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    rows = table.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in bpe.encode_texts(table, DATA, public_tokenizers.PATTERN).collect()}
    for r in rows:
        ids = ORACLE.encode_ordinary(r.text)
        packed = np.array(ids, "<u4").tobytes()
        g = got[r.doc_id]
        assert (g.n_tokens, bytes(g.ids), g.ids_sha256) == (len(ids), packed, hashlib.sha256(packed).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_encode_cases(spark):
    df = docs(spark, EDGES + [(8, "<|endoftext|> x", None)], ("ids", "id", "n_tokens"))
    got = bpe.encode_texts(df, DATA, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = sorted((str(i), len(ORACLE.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in EDGES + [(8, "<|endoftext|> x")])
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in got.collect()) == want
    assert bpe.encode_texts(docs(spark, []), DATA, public_tokenizers.PATTERN).count() == 0


def test_caches_may_run_over(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    monkeypatch.setattr(bpe, "CACHE_BORDERS", 5)
    enc = bpe.Encoder(bpe.Vocabulary(VOCABULARY.ranks), public_tokenizers.PATTERN)
    text = " ".join("".join(random.Random(i).choices("abcdest", k=9)) for i in range(80))
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == ORACLE.encode_ordinary(text)


def test_vocabulary_must_hold_all_bytes():
    with pytest.raises(ValueError):
        bpe.Vocabulary(bpe.parse_ranks(base64.b64encode(b"a") + b" 0\n"))


# ---- chat

TURNS = "conv_id long, turn int, role string, text string"
NASTY = st.text(alphabet="<|im_start>end\\n\n a\\", max_size=30)


@given(NASTY, NASTY)
def test_a_turn_reads_back(role, text):
    t = chat.Template()
    segs = chat.segments(role, text, t)
    whole = "".join(s for s, _ in segs)
    assert chat.read_turn(whole, t) == (role, text)
    assert t.control not in segs[1][0] and whole.count(t.open) == whole.count(t.close) == 1


def digest(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@given(st.lists(st.tuples(NASTY, NASTY), max_size=5), st.data())
def test_a_conversation_reads_back_in_pieces(turns, data):
    """From the whole formatted text, whatever pieces it comes in."""
    t = chat.Template()
    whole = "".join(s for role, text in turns for s, _ in chat.segments(role, text, t))
    cuts = sorted(data.draw(st.lists(st.integers(0, len(whole)), max_size=6)))
    reader, got = chat.Reader(t), []
    for a, b in zip([0, *cuts], [*cuts, len(whole)]):
        got += reader.feed(whole[a:b])
    reader.done()
    assert got == turns
    if turns:
        short = chat.Reader(t)
        list(short.feed(whole[:-1]))
        with pytest.raises(ValueError):
            short.done()


def test_conversations_read_back(spark):
    rows = [(1, 0, "system", "s", ), (1, 1, "user", "<|im_end|>"), (1, 2, "assistant", "\\<|im_start|>"), (2, 1, "assistant", None), (2, 0, "user", ""),
            (3, 0, "assistant", "early"), (4, 0, "user", "a"), (4, 1, "user", "twice"), (5, 0, None, "no role"), (6, 0, "user", "x" * 300_000),
            (6, 1, "assistant", "y" * 300_000), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, 0, "user", "no id"), (8, None, "user", "no turn")]
    df = spark.createDataFrame(rows, TURNS).withColumn("segments", F.lit(1)).withColumn("valid_order", F.lit(1)).repartition(4)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    convs = {}
    for c, n, r, t in sorted(rows, key=lambda x: (str(x[0]), x[1] or 0)):
        convs.setdefault(c, []).append((r, t))
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == {c: digest(t) for c, t in convs.items()}
    assert {c for c, r in got.items() if not r.valid_order} == {3, 4, 5, 7}
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], TURNS))).count() == 0


def test_segments_and_long_conversations_over_batches(spark):
    n = 25_000  # several Arrow batches
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                               F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    formatted = chat.format_turns(df)
    r = chat.read_back(formatted).collect()
    assert len(r) == 1 and r[0].n_turns == n and r[0].valid_order
    assert r[0].turns_sha256 == digest([("user" if i % 2 == 0 else "assistant", str(i)) for i in range(n)])[1]
    first = formatted.filter("turn_no = 1").first()
    assert [(s.text, s.loss) for s in first.segments] == [("<|im_start|>assistant\n", False), ("1", True), ("<|im_end|>\n", False)]


# ---- language ID

def test_language_of_held_out_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    learnt = langid.fit(table.filter(sampling.crc32_mod("doc_id", 3) != 1))
    held = table.filter(sampling.crc32_mod("doc_id", 3) == 1)
    got = {r.doc_id: r for r in langid.predict(held, learnt).collect()}
    truth = {r.doc_id: r.lang for r in held.collect()}
    assert sum(got[i].lang_pred == lang for i, lang in truth.items()) / len(truth) > 0.95
    assert sum(r.score >= langid.MARGIN for r in got.values()) / len(got) > 0.97
    assert set(truth) == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 == 1}


def test_language_cases(spark):
    rows = EDGES + [(7, None, "fr"), (8, "la maison est grande et la mer est bleue", "fr"), (9, "a house", None)]
    df = docs(spark, rows, ("score", "lang_pred", "id", "k0"))
    learnt = langid.fit(df)
    assert set(learnt) == {"en", "de", "fr"}
    got = langid.predict(df, learnt, keep=("source",))
    assert got.columns == ["source", "doc_id", "lang_pred", "score"] and got.count() == len(rows)
    for r in got.collect():
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "und")
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 7))
    assert langid.predict(docs(spark, []), learnt).count() == 0
    assert {r.lang_pred for r in langid.predict(df, langid.fit(docs(spark, []))).collect()} == {"und"}
    one = langid.fit(docs(spark, [(1, "the cat sat on the mat", "en")]))
    assert langid.predict(df, one).filter("doc_id = 9").first().score == 1.0


def test_narrow_margins_are_rejected(spark):
    df = spark.createDataFrame([("en", 0.2), ("en", 0.0001), ("und", 0.5)], "p string, s double")
    assert [r[0] for r in df.select(langid.rejected(F.col("p"), F.col("s"))).collect()] == [False, True, True]


# ---- samples and toxicity

def test_samples_are_bounded_and_repeatable(spark):
    df = spark.range(5000).select((F.col("id") % 2500).alias("doc_id"), (F.col("id") % 2500 % 3).alias("y"), F.concat(F.lit("t"), F.col("id") % 2500).alias("text"))
    a, counts = sampling.labelled_sample(df, df, "y", "doc_id", "text", per_label=40, chars=3)
    b, _ = sampling.labelled_sample(df.repartition(7), df.repartition(3), "y", "doc_id", "text", per_label=40, chars=3)
    assert a == b and sum(counts.values()) == 5000
    assert {y: sum(1 for x, _ in a if x == y) for y in (0, 1, 2)} == {0: 40, 1: 40, 2: 40} and all(len(t.replace("\n", "")) <= 3 for _, t in a)
    assert sampling.labelled_sample(df.limit(0), df, "y", "doc_id", "text", per_label=4, chars=3) == ([], {})


def test_slices_are_spread_over_long_texts(spark):
    rows = [(1, "short"), (2, "x" * 100), (3, "a" * 40 + "b" * 20 + "c" * 40), (4, ""), (5, None), (6, "0123456789" * 1000)]
    got = {r[0]: r[1] for r in docs(spark, [(i, t, "en") for i, t in rows]).select("doc_id", sampling.spread(F.col("text"), 40)).collect()}
    assert got[1] == "short" and got[4] == "" and got[5] is None
    assert got[3] == "\n".join(["aaaaa"] * 3 + [(rows[2][1])[i * 95 // 7:][:5] for i in range(3, 8)])
    assert len(got[6].split("\n")) == 8 and got[6].startswith("01234") and got[6].endswith("56789")


def test_language_against_a_plain_loop(spark):
    """Dictionaries and predictions with nothing but zstandard, on the given table."""
    import regex
    import zstandard
    table = spark.read.parquet(f"{SF}/documents.parquet")
    learnt = langid.fit(table.filter(sampling.crc32_mod("doc_id", 3) != 1))
    order = sorted(learnt, key=lambda lang: (-learnt[lang][1], lang))
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(table, learnt).collect()}
    for r in table.collect():
        letters = " ".join(regex.findall(r"\p{L}+", (r.text or "").lower())).encode()
        if not letters:
            assert found[r.doc_id] == ("und", 0.0)
            continue
        sizes = []
        for lang in order:
            d = zstandard.ZstdCompressionDict(learnt[lang][0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=12, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(letters[i:i + 1500])) for i in range(0, len(letters), 1500)))
        ranked = sorted(sizes)
        lang, score = found[r.doc_id]
        # a dictionary may be used attached or copied, which moves a size by a few bytes
        assert abs(sizes[order.index(lang)] - ranked[0]) <= 0.02 * ranked[0] + 4
        assert score == pytest.approx((ranked[1] - ranked[0]) / ranked[1], abs=0.03)


def test_texts_without_a_letter_are_undetermined(spark):
    learnt = langid.fit(docs(spark, [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr")]))
    df = docs(spark, [(1, "½ ² ³ 12 ٣ ::", "en"), (2, "x²", "en"), (3, "ª", "en")])
    assert {r.doc_id: r.lang_pred == "und" for r in langid.predict(df, learnt).collect()} == {1: True, 2: False, 3: False}


def test_held_out_of_a_null_id_is_false(spark, tmp_path):
    docs(spark, [(None, "the cat", "en"), (1, "the mat", "en")]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op2_language_id", "op10_toxicity"):
        got = {r.doc_id: r.held_out for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got[None] is False and got[1] in (True, False)


def toxic_table(spark, n=600):
    rng = random.Random(5)
    stems = ["grumbl", "slimor", "bozart"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abdeilmnorstu", k=rng.randrange(2, 9))) for _ in range(rng.randrange(5, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["ed", "er", "ish", "al", "o"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_finds_unseen_forms(spark):
    table, labels = toxic_table(spark)
    model = toxicity.fit(labels.filter("doc_id < 480"), table)
    extra = docs(spark, [(9001, "abdel minor " * 30 + "grumblified" + " torsu nabel" * 3000, "en"), (9002, "abdel minor torsu " * 3000, "en")])
    got = {r.doc_id: r for r in toxicity.score(table.filter("doc_id >= 480").union(extra), model).collect()}
    held = [i for i in got if i < 9000]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.9
    assert got[9001].score > got[9002].score


def test_toxicity_cases(spark):
    table, labels = toxic_table(spark, 60)
    model = toxicity.fit(labels.union(spark.createDataFrame([(1, None), (None, 1), (2, 7), (1, 1)], "doc_id long, toxic int")), table)
    df = docs(spark, EDGES, ("score", "predicted", "posterior", "k0", "n_tokens"))
    got = toxicity.score(df, model)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == len(EDGES)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.collect())
    for fewer, want in ((labels.limit(0), {0.0}), (labels.filter("toxic = 0"), {0.0}), (labels.filter("toxic = 1"), {1.0})):
        assert {r.score for r in toxicity.score(df, toxicity.fit(fewer, table)).collect()} == want
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_words_of_any_length_are_read_whole(spark):
    for n in (1, 13, 14, 15, 16, 17, 26, 27, 28, 39, 40, 41, 52, 53, 20_000):
        word = "".join(chr(0x4E00 + i % 5000) for i in range(n))
        marked = f"<{word}>"
        assert {marked[i:i + k] for k in (3, 4, 5) for i in range(len(marked) - k + 1)} <= {g for p in subword.pieces([word]) for g in subword.ngrams(p)}
        assert (subword.pieces(["a", word, "b"]) == ["a", word, "b"]) == (n <= subword.PIECE - 2)
    assert subword.pieces([]) == []
    table, labels = toxic_table(spark)
    model = toxicity.fit(labels, table)
    clean = "abdelminortorsunabel" * 1000
    texts = {i: clean[:at] + "grumblishslimoredbozarter" + clean[at:] for i, at in enumerate((60, 5003, 19_990))} | {9: clean}
    got = {r.doc_id: r for r in toxicity.score(docs(spark, [(i, t, "zh") for i, t in texts.items()]), model).collect()}
    assert all(got[i].score > got[9].score and got[i].predicted == 1 for i in (0, 1, 2)) and got[9].predicted == 0
    assert subword.Scorer(model).posterior("one " + clean)[0] == 2  # words, not pieces


def test_scores_against_a_dense_forward_pass(spark):
    """n-gram counts times weights in numpy, every window tried, on the given table."""
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(labels.filter(sampling.crc32_mod("doc_id", 5) != 0), table)
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    for r in table.limit(60).collect():
        words = subword.pieces(re.findall(r"[^\W_]+", (r.text or "").lower()))
        speaks = np.zeros(len(words))
        for i, w in enumerate(words):
            marked = w[1:] if w.startswith(" ") else f"<{w}>"
            grams = [marked] + [marked[a:a + n] for n in (3, 4, 5) for a in range(len(marked) - n + 1)]
            count = np.zeros(subword.BUCKETS)
            for g in grams:
                count[zlib.crc32(g.encode()) % subword.BUCKETS] += 1
            speaks[i] = count @ model.weights[:, 0].astype(float) / len(grams)
        best = max((speaks[i:i + 4].mean() for i in range(max(1, len(words) - 3))), default=0.0) if len(words) else 0.0
        logit = model.bias[1] - model.bias[0] + best
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_best_window_is_the_largest_mean():
    rng = np.random.default_rng(0)
    for n in (1, 4, 5, 30):
        x = rng.normal(size=n)
        a, b = subword.best_window(x, 4)
        assert b - a == min(4, n) and np.isclose(x[a:b].mean(), max(x[i:i + min(4, n)].mean() for i in range(max(1, n - 3))))


# ---- mixing

def domain_table(spark):
    rng = random.Random(2)
    words = {"a": "alpha beta gamma", "b": "red green blue", "c": "one two three"}
    rows, labels = [], []
    for i in range(300):
        d = "aaaabbc"[i % 7]
        rows.append((i, " ".join(rng.choice((words[d] + " so it is").split()) for _ in range(rng.randrange(5, 60))), "en"))
        labels.append((i, d if i % 3 else None))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string")


def test_mixing_meets_the_targets(spark):
    table, labels = domain_table(spark)
    domains = mixing.fit(labels, table)
    got = mixing.mix(table, domains, {"a": 2, "b": 2, "c": 1}).collect()
    n, p, r = np.array([x.n_tokens for x in got], float), np.array([x.posterior for x in got]), np.array([x.rate for x in got])
    assert all(x.on_target for x in got) and (r >= 0).all()
    assert np.allclose((n * r) @ p / n.sum(), [0.4, 0.4, 0.2], rtol=mixing.MISS * 1.01)
    assert p.argmax(1).tolist().count(0) > 120
    assert all(x.copies in (int(x.rate), int(x.rate) + 1) for x in got)
    assert abs(sum(x.copies for x in got) - r.sum()) < 40


def test_labels_without_a_document_take_no_places(spark):
    table, labels = domain_table(spark)
    some = table.filter("doc_id >= 240").withColumn("text", F.when(F.col("doc_id") != 250, F.col("text")))
    kept = labels.filter("doc_id >= 240 AND doc_id <> 250")
    few, whole = mixing.fit(labels, some, per_domain=5), mixing.fit(kept, some, per_domain=5)
    assert few.model is not None and (few.names, few.shares) == (["a", "b", "c"], whole.shares)
    no_c = table.filter("doc_id % 7 <> 6")
    rest = mixing.fit(labels, no_c)
    assert rest.names == ["a", "b"] and rest.model is not None and abs(sum(rest.shares) - 1) < 1e-9
    got = mixing.mix(no_c, rest, {"a": 1, "b": 1, "c": 1}).collect()
    assert all(x.on_target and len(x.posterior) == 2 for x in got) and len({tuple(x.posterior) for x in got}) > 100


def test_solver_against_dense_projected_gradient(spark):
    rng = np.random.default_rng(4)
    p, n = rng.dirichlet([0.3, 0.3, 0.3], 400), rng.integers(0, 90, 400)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, posterior array<double>").repartition(3)
    target = np.array([0.6, 0.3, 0.1])
    steps, share, met = mixing.solve(members, target)
    w, r = n / n.sum(), np.ones(400)
    for _ in range(20_000):  # plain steps of the safe length
        r = np.maximum(0, r - 0.1 * (p @ (((w * r) @ p - target) / target) + mixing.PENALTY * (r - 1)))
    found = mixing.rates_after(p, steps)[0]
    objective = lambda x: 0.5 * ((((w * x) @ p - target) ** 2) / target).sum() + 0.5 * mixing.PENALTY * (w * (x - 1) ** 2).sum()
    assert met and np.allclose((w * found) @ p, share) and objective(found) < objective(r) + 5e-5


def test_mixing_cases(spark):
    table, labels = domain_table(spark)
    domains = mixing.fit(labels, table)
    df = docs(spark, EDGES, ("rate", "copies", "posterior", "_tokens", "_text", "_p", "features", "id"))
    got = mixing.mix(df, domains, {"a": 1})
    assert got.columns == ["doc_id", "n_tokens", "posterior", "rate", "copies", "on_target"] and got.count() == len(EDGES)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].n_tokens == by[2].n_tokens == 0 and by[3].n_tokens == 3 and by[4].n_tokens == 80_000
    assert mixing.mix(docs(spark, []), domains, {}).count() == 0
    for few in (labels.limit(0), labels.filter("domain = 'a'")):
        assert {r.rate for r in mixing.mix(df, mixing.fit(few, table), {"a": 1, "b": 1}).collect()} == {1.0}
    no_text = mixing.fit(labels, table.withColumn("text", F.lit(None).cast("string")))
    assert no_text.model is None and len(no_text.names) == 3


def test_mixing_with_a_weight_of_none(spark):
    """A target of none is met when what is left of the domain is a small share of all."""
    table, labels = domain_table(spark)
    sharp = spark.createDataFrame([(i, 10, [1.0, 0.0] if i % 5 else [0.0, 1.0]) for i in range(100)], "id long, n_tokens long, posterior array<double>")
    steps, share, met = mixing.solve(sharp, np.maximum([1.0, 0.0], 1e-9))
    assert met and share[1] <= mixing.MISS
    domains = mixing.fit(labels, table)
    got = mixing.mix(table, domains, {"a": 0.5, "b": 0.5, "c": 0})
    n, p, r = (np.array([x[c] for x in got.collect()]) for c in ("n_tokens", "posterior", "rate"))
    share = (n * r) @ p / n.sum()
    assert {x.on_target for x in got.collect()} == {bool(share[2] <= mixing.MISS and np.allclose(share[:2], 0.5, rtol=mixing.MISS))}
    assert mixing.mix(table, domains, {"a": 0, "b": 0, "c": 0}).first().on_target is not None
