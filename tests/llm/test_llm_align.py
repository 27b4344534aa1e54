"""Cross-tokenizer alignment against whole texts encoded in one go."""

import hashlib
import random
from array import array
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.llm import align

JSON = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
PAIR = align.Pair(JSON, MODEL)


def whole_tokens(text):
    """(a, b) as (id, end) of the whole text, or None."""
    if not text:
        return None
    a = tokenizers.Tokenizer.from_str(JSON)
    a.encode_special_tokens = True
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = sentencepiece.SentencePieceProcessor(model_proto=MODEL).encode(text)
    out = []
    for ids, of in ((ids_a, PAIR.bytes_a), (ids_b, PAIR.bytes_b)):
        if b"".join(of[i] for i in ids) != (" " + text).encode():
            return None
        end, ends = 0, []
        for i in ids:
            end += len(of[i])
            ends.append((i, end))
        out.append(ends)
    return out


def brute(rows):
    """The contract, from whole texts and all token pairs."""
    linked, count = [], Counter()
    for i, text in rows:
        tokens = whole_tokens(text)
        if tokens is None:
            linked.append((i, None, None, None))
            continue
        spans = [[(t, e - len(of[t]), e) for t, e in x] for x, of in zip(tokens, (PAIR.bytes_a, PAIR.bytes_b))]
        pairs, j0 = [], 0
        for t, s, e in spans[0]:
            while j0 < len(spans[1]) and spans[1][j0][2] <= s:
                j0 += 1
            for u, s2, e2 in spans[1][j0:]:
                if s2 >= e:
                    break
                pairs.append((t, u))
        count.update(pairs)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        cut = [[[], []] for _ in ends]
        for side in (0, 1):
            g = 0
            for t, _, e in spans[side]:
                while ends[g] < e:
                    g += 1
                cut[g][side].append(str(t))
        linked.append((i, spans, pairs, ";".join(",".join(x) + "|" + ",".join(y) for x, y in cut)))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted([(i, 0, 0, 0, 0, 0, 0, "") if pairs is None else
                   (i, len(spans[0]), len(spans[1]), text.count(";") + 1, len(pairs), sum(count[p] == top[p[1]] for p in pairs),
                    sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()) for i, spans, pairs, text in linked], key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found(spark, rows, **columns):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("row", "block", "seg", "n_a", "kind"):
        df = df.withColumn(c, df["text"])
    return sorted((tuple(r) for r in align.align(df, JSON, MODEL).select(*COLUMNS).collect()), key=repr)


def text(rng, n, sep=" "):
    syllables = ["re", "ou", "nt", "tion", "é", "ç", "qu", "the", "lan", "ß", "漢", "字", "12", "7", ".", ",", "'s", "\U0001F600"]
    return sep.join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(n))


CASES = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "  two  spaces \n and\n\nlines \t tabs "), (6, "▁ is not given back"), (7, "<|endoftext|> </s> <unk> <0x41>"),
         (8, "same text"), (8, "same text"), (None, "no id"), (9, "\x1c\x85 odd　space​ ᠎."), (10, "trailing   "), (11, "\n"), (12, "汉字没有空格" * 20)]


def test_cases(spark):
    assert found(spark, CASES) == brute(CASES)
    assert found(spark, []) == []


def test_long_texts_in_ranges(spark, monkeypatch):
    """Short ranges: texts of many ranges, three levels of the tree, borders inside
    words, characters and words longer than what is cut."""
    for name, value in (("RANGE", 40), ("LONGEST", 16), ("BLOCK", 300), ("BATCH", 100), ("FAN", 3)):
        monkeypatch.setattr(align, name, value)
    rng = random.Random(4)
    rows = [(i, text(rng, rng.randint(1, 90))) for i in range(40)] + [(50, text(rng, 300, "")), (51, text(rng, 200, "\n")), (52, text(rng, 100) + " ▁ " + text(rng, 9))]
    rows += [(53, rows[3][1]), (None, rows[4][1] * 3), *CASES]
    assert found(spark, rows) == brute(rows)


words = st.text(st.sampled_from("ab é漢1.'\n\t ▁s\U0001F600"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(words.filter(bool))
def test_words_stand_alone(t):
    parts = PAIR.words.findall(" " + t)
    assert "".join(parts) == " " + t and PAIR.split(t) == parts
    tokens = PAIR.tokens(parts)
    whole = whole_tokens(t)
    assert (None in tokens) == (whole is None)
    if whole:
        for side in (0, 1):
            assert [i for w in tokens for i, _ in w[side]] == [i for i, _ in whole[side]]


@settings(max_examples=60, deadline=None)
@given(st.lists(words.filter(bool), min_size=1, max_size=8))
def test_words_closed_together_equal_words_alone(texts):
    some = [w for t in texts for w in PAIR.split(t)]
    alone = [found and align.close(*found, PAIR.size_a[found[0]].tolist(), PAIR.size_b[found[1]].tolist()) for found in PAIR.ids(some)]
    assert PAIR.closed_words(some) == alone


@given(st.lists(st.integers(1, 3), min_size=1, max_size=12), st.data())
def test_closed_groups_against_all_pairs(sizes, data):
    """Groups and links of two ways to cut the same bytes."""
    total = sum(sizes)
    inner = data.draw(st.sets(st.integers(1, total - 1))) if total > 1 else set()
    ends = sorted(inner | {total})
    other = [e - s for s, e in zip([0, *ends], ends)]
    a, b = list(range(len(sizes))), list(range(100, 100 + len(other)))
    shown, packed = align.close(a, b, sizes, other)
    numbers = array("q", packed).tolist()
    spans = [[(sum(x[:k]), sum(x[:k + 1])) for k in range(len(x))] for x in (sizes, other)]
    want = [i << 32 | j for i, (s, e) in zip(a, spans[0]) for j, (s2, e2) in zip(b, spans[1]) if s < e2 and s2 < e]
    assert sorted(numbers[3:]) == sorted(want)
    common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    cut = [[",".join(str(i) for i, (_, e) in zip(ids, of) if lo < e <= hi) for ids, of in ((a, spans[0]), (b, spans[1]))] for lo, hi in zip([0, *common], common)]
    assert shown == ";".join("|".join(x) for x in cut) and numbers[:3] == [len(a), len(b), len(common)]


@given(st.data())
def test_composition_is_associative(data):
    def fragment(seg):
        tokens = st.lists(st.tuples(st.integers(0, 9), st.integers(1, 3)), max_size=3)
        cut = data.draw(st.booleans())
        return {"pa": data.draw(tokens), "pb": data.draw(tokens), "closes": seg if cut else None,
                "sa": data.draw(tokens) if cut else [], "sb": data.draw(tokens) if cut else []}

    x, y, z = map(fragment, range(3))
    xy, s1 = align.compose(x, y)
    left, s2 = align.compose(xy, z)
    yz, s3 = align.compose(y, z)
    right, s4 = align.compose(x, yz)
    assert left == right
    assert sorted(map(repr, filter(None, (s1, s2)))) == sorted(map(repr, filter(None, (s3, s4))))


@pytest.mark.parametrize("size", [40, 1000])
def test_ranges_cover_every_byte_once(monkeypatch, size):
    monkeypatch.setattr(align, "RANGE", size)
    monkeypatch.setattr(align, "LONGEST", 16)
    rng = random.Random(1)
    for t in (text(rng, 400), text(rng, 300, ""), "a " * 500):
        padded = " " + t
        out = [part.encode()[lo:hi] for part, lo, hi in align.ranges(padded, PAIR.words)]
        assert b"".join(out) == padded.encode()
