"""Subword-bag text classifier: n-gram embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its hashed character n-grams and of
itself, so a misspelling or an inflection unseen in training shares most of its
vector with the word it comes from.  The bag is the mean over the words of a
text, or (``window``) of the ``window`` neighbouring words that speak most for
the last class, so that a few words tell in a text of any length.  A word counts
as its overlapping pieces of up to ``PIECE`` characters, each a word of its own to
the bag and the window; most words have one.  Embeddings and softmax are trained
jointly in numpy (sparse Adagrad on small batches).

The model is linear in the bag, so scoring needs one number per word and class;
workers keep those of the words they have met.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import ship_by_value, worker_cache

BUCKETS = 1 << 16
CACHE_WORDS = 500_000
#: characters of a piece (of a word with its two marks), and of them those shared with the next one: every n-gram lies in a piece
PIECE, SHARED = 16, 4
TOKENS = {"words": re.compile(r"[^\W_]+"), "words and signs": re.compile(r"\w+|[^\w\s]+")}


def pieces(words: list[str]) -> list[str]:
    """The pieces of the words.  The only piece of a word is the word; one of several
    starts with a space, which no word holds, and has the marks of the word's two
    ends only."""
    if max(map(len, words), default=0) <= PIECE - 2:
        return words
    return list(chain.from_iterable(
        [w] if len(w) <= PIECE - 2 else [f" {m[i:i + PIECE]}" for m in (f"<{w}>",) for i in range(0, len(m) - SHARED, PIECE - SHARED)] for w in words))


def ngrams(word: str) -> list[str]:
    """A word or piece itself and its character 3- to 5-grams."""
    w = word[1:] if word[:1] == " " else f"<{word}>"
    return [w, *(w[i:i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1))]


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "replace")) % BUCKETS


def best_window(scores: np.ndarray, window: int) -> tuple[int, int]:
    """The ``window`` neighbours with the largest mean score."""
    if len(scores) <= window:
        return 0, len(scores)
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    a = int(np.argmax(sums[window:] - sums[:-window]))
    return a, a + window


@dataclass
class Model:
    classes: list
    weights: np.ndarray  # (BUCKETS, classes - 1): what a bucket adds to a class's logit, the first class's being 0
    bias: np.ndarray
    window: int = 0
    tokens: str = "words"
    tag: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    """A model and what it says of the words met so far."""

    def __init__(self, model: Model):
        self.model, self.find = model, TOKENS[model.tokens].findall
        self.columns = [c.tolist() for c in model.weights.T.astype(np.float64)]
        self.met: dict[str, tuple] = {}
        self.grams: dict[str, int] = {}

    def word(self, word: str) -> tuple:
        known, grams = self.grams, ngrams(word)
        if len(known) > CACHE_WORDS:
            known.clear()
        at = []
        for g in grams:
            i = known.get(g)
            if i is None:
                i = known[g] = bucket(g)
            at.append(i)
        v = tuple([sum([c[i] for i in at]) / len(at) for c in self.columns])
        if len(self.met) >= CACHE_WORDS:
            self.met.clear()
        self.met[word] = v
        return v

    def posterior(self, text: str) -> tuple[int, list[float]]:
        """Number of words, and one probability per class."""
        get, word = self.met.get, self.word
        words = self.find(text.lower())
        rows = [get(w) or word(w) for w in pieces(words)]
        logits = self.model.bias.astype(np.float64)
        if rows and self.columns:
            x = np.fromiter(chain.from_iterable(rows), np.float64, len(rows) * len(self.columns)).reshape(len(rows), -1)
            if self.model.window:
                a, b = best_window(_for_last(x), self.model.window)
                x = x[a:b]
            logits = logits + np.concatenate(([0.0], x.mean(0)))
        e = np.exp(logits - logits.max())
        return len(words), (e / e.sum()).tolist()


def _for_last(x: np.ndarray) -> np.ndarray:
    """How far each word speaks for the last class against the mean of the
    others, the first being 0."""
    return x[:, -1] - x[:, :-1].sum(1) / x.shape[1]


def train(sample: list[tuple], counts: dict, *, window: int = 0, tokens: str = "words", dims: int = 8,
          epochs: int = 6, steps: int = 1000, rate: float = 0.3, seed: int = 7) -> Model:
    """Fit on (label, text) rows; ``counts`` are the labels' row counts, by
    which the posteriors follow the table's and not the sample's shares.

    A small sample is gone through more often and in smaller batches, for about
    ``steps`` steps at least.  Without rows of two classes the posterior is the share of each class.
    """
    classes = sorted(counts)
    total = sum(counts.values())
    drawn = {c: sum(1 for label, _ in sample if label == c) for c in classes}
    if min(drawn.values(), default=0) == 0 or len(classes) < 2:
        shares = np.array([counts[c] / total for c in classes] or [1.0])
        return Model(classes, np.zeros((BUCKETS, max(0, len(classes) - 1)), np.float32), np.log(np.maximum(shares, 1e-9)), window, tokens)
    ids: dict[str, int] = {}
    docs = [(classes.index(label), np.array([ids.setdefault(w, len(ids)) for w in pieces(TOKENS[tokens].findall(text.lower()))], np.int32))
            for label, text in sample]
    grams = [np.array([bucket(g) for g in ngrams(w)], np.int32) for w in ids]
    sizes = np.array([len(g) for g in grams], np.int64)
    flat, starts = (np.concatenate(grams) if grams else np.zeros(0, np.int32)), np.concatenate(([0], np.cumsum(sizes)))[:-1]
    batch = min(32, max(4, len(docs) // 64))
    epochs = max(epochs, -(-steps * batch // len(docs)))
    rng = np.random.default_rng(seed)
    E = rng.uniform(-0.5, 0.5, (BUCKETS, dims)).astype(np.float32)
    W, b = rng.normal(0, 0.5, (dims, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32)
    GE, GW, Gb = np.full((BUCKETS, dims), 1e-6, np.float32), np.full_like(W, 1e-6), np.full_like(b, 1e-6)

    def buckets(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = sizes[words]
        at = np.repeat(starts[words] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
        return flat[at], n

    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            some = [docs[i] for i in order[lo:lo + batch]]
            some = [(y, x) for y, x in some if len(x)]
            if not some:
                continue
            if window and epoch:  # the first pass learns from whole texts
                words, place = np.unique(np.concatenate([x for _, x in some]), return_inverse=True)
                where, n = buckets(words)
                logit = np.add.reduceat((E @ (W[:, 1:] - W[:, :1]))[where], np.concatenate(([0], np.cumsum(n)))[:-1]) / n[:, None]
                told, at, cut = _for_last(logit)[place], 0, []
                for y, x in some:
                    i, j = best_window(told[at:at + len(x)], window)
                    cut.append((y, x[i:j]))
                    at += len(x)
                some = cut
            words, place = np.unique(np.concatenate([x for _, x in some]), return_inverse=True)
            where, n = buckets(words)
            V = np.add.reduceat(E[where], np.concatenate(([0], np.cumsum(n)))[:-1]) / n[:, None]
            lens = np.array([len(x) for _, x in some])
            ends = np.concatenate(([0], np.cumsum(lens)))[:-1]
            bags = np.add.reduceat(V[place], ends) / lens[:, None]
            z = bags @ W + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), [y for y, _ in some]] -= 1
            p /= len(some)
            dW, db, dbag = bags.T @ p, p.sum(0), (p @ W.T) / lens[:, None]
            per_word, dV = np.repeat(dbag, lens, axis=0), np.zeros_like(V)
            for k in range(dims):
                dV[:, k] = np.bincount(place, per_word[:, k], len(words))
            rows, inverse = np.unique(where, return_inverse=True)
            each, dE = np.repeat(dV / n[:, None], n, axis=0), np.zeros((len(rows), dims), np.float32)
            for k in range(dims):
                dE[:, k] = np.bincount(inverse, each[:, k], len(rows))
            GE[rows] += dE * dE
            E[rows] -= rate * dE / np.sqrt(GE[rows])
            GW += dW * dW
            W -= rate * dW / np.sqrt(GW)
            Gb += db * db
            b -= rate * db / np.sqrt(Gb)
    prior = np.array([math.log(counts[c] / total) - math.log(drawn[c] / len(sample)) for c in classes])
    return Model(classes, (E @ (W[:, 1:] - W[:, :1])).astype(np.float32), b + prior, window, tokens)


def posteriors(docs: DataFrame, model: Model, text_col: str, *, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of every row, ``n_tokens`` (words of the whole text)
    and ``posterior`` (one number per class, in the order of ``classes``).

    A null text counts as empty, whose posterior is the bias alone.
    """
    # plain values: a broadcast is pickled by reference, and workers need not have this package
    shared = docs.sparkSession.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    passed = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in passed), "n_tokens long", "posterior array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, model = worker_cache("subword"), Model(*shared.value)
        if model.tag not in made:
            made.clear()
            made[model.tag] = Scorer(model)
        score = made[model.tag].posterior
        for b in batches:
            scored = [score(t.as_py() or "") for t in b.column("text")]
            ns, found = [n for n, _ in scored], [p for _, p in scored]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), pa.array(ns, pa.int64()), pa.array(found, pa.list_(pa.float64()))],
                                             names=[*passed, "n_tokens", "posterior"])

    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(passed, keep)))


ship_by_value(__name__)
