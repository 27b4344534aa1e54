"""Alignment of two tokenizers' tokens as an associative fragment monoid.

A fragment is what a byte range of a text says of the alignment: the tokens that
end in it, up to the first byte where tokens of both end (the open prefix), the
groups closed between such common ends, and the tokens after the last one (the
open suffix).  Two neighbouring fragments make one: the left suffix and the right
prefix close a group, the seam.  This is associative, so the fragments of a long
text may be made by different tasks and composed by a tree, ``FAN`` at a time.

Both tokenizers work word by word (a word being what neither tokenizer merges
across the borders of), so a worker keeps each word's closed fragment, and a
byte range is the product of its words, the two cut by its ends being taken
token by token.  A word over ``LONGEST`` bytes is not cut: the range ends after it.

Counts of id pairs over all texts are made and looked up by blocks of text: a
block's distinct pairs are rows of their own, and its texts refer to words and
the words to pairs, so that no row per text and pair is shuffled.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import cut, ship_by_value, stored, worker_cache

RANGE, LONGEST, BLOCK, FAN = 1 << 16, 1 << 12, 1 << 23, 16
#: characters of text whose new words are encoded at a time, and closed fragments of words that a worker keeps
BATCH, CACHE_WORDS = 1 << 19, 300_000
#: a word starts with spaces and ends before spaces that come between two other characters
WORDS = re.compile(r" +\s*\S*(?:(?! +\S)\s+\S*)*")
#: without it, every space of a text is the start of a word
RUN_OF_SPACE = re.compile(r"\s | \s|^\s|\s\Z")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable
    ones for themselves, the others in order from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Pair:
    """The two tokenizers: tokens of words as (id, number of bytes)."""

    def __init__(self, byte_level: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(byte_level)
        before = spec.get("pre_tokenizer") or {}
        self.a = tokenizers.Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        alphabet = byte_alphabet()
        self.bytes_a = {i: bytes(alphabet[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if set(t) <= alphabet.keys()}
        self.bytes_a |= {i: b"" for i in range(max(self.bytes_a) + 1) if i not in self.bytes_a}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = list(map(piece_bytes, names))
        self.size_a, self.size_b = (np.array([len(x[i]) for i in range(len(x))], np.int64) for x in (self.bytes_a, self.bytes_b))
        # each id as text before "," and before what ends its side of a group
        self.shown_a, self.shown_b = ([[f"{i}{end}" for i in range(len(x))] for end in ends] for x, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))
        # words stand alone only if no token holds a space after another character
        split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not any("▁" in n.lstrip("▁") for n in names)
        self.words = WORDS if split else re.compile(r"(?s).+")

    def split(self, text: str) -> list[str]:
        """The words of a text, the first with the space put before it."""
        if self.words is WORDS and not RUN_OF_SPACE.search(text):
            return [" " + w for w in text.split(" ")]
        return self.words.findall(" " + text)

    def closed_words(self, words: list[str]) -> list[tuple[str, bytes] | None]:
        """The closed fragment of each word, as ``close`` makes it, or None if a
        tokenizer does not give the word back.  All words are laid end to end: the
        ends of words are common ends, so no group or link goes beyond one."""
        if not words:
            return []
        ids = [[x.ids for x in self.a.encode_batch(words, add_special_tokens=False)], self.b.encode([w[1:] for w in words], num_threads=1)]
        counts = [np.fromiter(map(len, x), np.int64, len(words)) for x in ids]
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in zip(ids, counts))
        raw = [w.encode() for w in words]
        edges = np.cumsum(list(map(len, raw)))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        good = all(n.all() and np.array_equal(ends[np.cumsum(n) - 1], edges) and b"".join(map(of.__getitem__, t.tolist())) == b"".join(raw)
                   for n, ends, of, t in zip(counts, (ends_a, ends_b), (self.bytes_a, self.bytes_b), (a, b)))
        if not good:
            kept = [w for w, found in zip(words, self.ids(words)) if found]
            found = dict(zip(kept, self.closed_words(kept))) if len(kept) < len(words) else {w: self.close_one(w) for w in words}
            return [found.get(w) for w in words]
        first, last = np.searchsorted(ends_b, ends_a - self.size_a[a], "right"), np.searchsorted(ends_b, ends_a, "left")
        n = last - first + 1
        other = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs = np.repeat(a, n) << 32 | b[other]
        ended_a, ended_b = ends_b[last] == ends_a, ends_a[np.searchsorted(ends_a, ends_b, "left")] == ends_b
        word = np.repeat(np.arange(len(words)), counts[0])
        n_links, n_groups = (np.bincount(word, x, len(words)).astype(np.int64) for x in (n, ended_a))
        heads = np.cumsum(3 + n_links) - 3 - n_links
        packed = np.empty(int((3 + n_links).sum()), np.int64)
        linked = np.ones(len(packed), bool)
        for k, x in enumerate((*counts, n_groups)):
            packed[heads + k], linked[heads + k] = x, False
        packed[linked] = pairs
        order = np.argsort(np.concatenate((2 * (np.cumsum(ended_a) - ended_a), 2 * (np.cumsum(ended_b) - ended_b) + 1)), kind="stable")
        shown = [of[end][i] for of, t, ended in ((self.shown_a, a, ended_a), (self.shown_b, b, ended_b)) for i, end in zip(t.tolist(), ended.tolist())]
        shown = [shown[i] for i in order.tolist()]
        stops, packed, heads = np.cumsum(counts[0] + counts[1]).tolist(), packed.tobytes(), [*(8 * heads).tolist(), 8 * len(packed)]
        return [("".join(shown[i:j])[:-1], packed[x:y]) for i, j, x, y in zip([0, *stops], stops, heads, heads[1:])]

    def close_one(self, word: str) -> tuple[str, bytes]:
        a, b = next(self.ids([word]))
        return close(a, b, self.size_a[a].tolist(), self.size_b[b].tolist())

    def ids(self, words: list[str]) -> Iterator[tuple | None]:
        """For each word (with its space) the ids of both, or None if the joined
        bytes of one differ from the word."""
        a, b = self.bytes_a, self.bytes_b
        ids_b = self.b.encode([w[1:] for w in words], num_threads=1)
        for w, x, y in zip(words, self.a.encode_batch(words, add_special_tokens=False), ids_b):
            x = x.ids
            yield (x, y) if b"".join([a[i] for i in x]) == b"".join([b[i] for i in y]) == w.encode() else None

    def tokens(self, words: list[str]) -> list[tuple | None]:
        """The same as (id, number of bytes)."""
        return [found and tuple([(i, len(of[i])) for i in ids] for ids, of in zip(found, (self.bytes_a, self.bytes_b))) for found in self.ids(words)]


def close(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> tuple[str, bytes]:
    """The closed fragment of tokens that start and end at a common border: its
    groups as a string, and packed integers: its numbers of tokens and groups, and
    its links as pairs of ids."""
    pairs, shown, i, j, at_i, at_j, end_a, end_b = [], [], -1, -1, 0, 0, 0, 0
    while i + 1 < len(a) or j + 1 < len(b):
        # the token of the side that is behind; of both at a common end
        back_a, back_b = end_a <= end_b, end_b <= end_a
        if back_a and back_b and i >= 0:
            shown.append(",".join(map(str, a[at_i:i + 1])) + "|" + ",".join(map(str, b[at_j:j + 1])))
            at_i, at_j = i + 1, j + 1
        if back_a:
            i += 1
            end_a += size_a[i]
        if back_b:
            j += 1
            end_b += size_b[j]
        pairs.append(a[i] << 32 | b[j])
    if a:
        shown.append(",".join(map(str, a[at_i:])) + "|" + ",".join(map(str, b[at_j:])))
    return ";".join(shown), array("q", [len(a), len(b), len(shown), *pairs]).tobytes()


def closed(groups: Iterable[tuple]) -> tuple[str, bytes]:
    """Of neighbouring groups, as tokens of both."""
    a, b = ([t for g in groups for t in g[side]] for side in (0, 1))
    return close([i for i, _ in a], [i for i, _ in b], [n for _, n in a], [n for _, n in b])


def compose(left: dict, right: dict) -> tuple[dict, tuple | None]:
    """The fragment of two neighbouring ones and the seam that closes, if any.  A
    fragment has ``pa`` and ``pb`` (the open prefix), ``closes`` (the range where it
    closes, None if the fragment has no common end), ``sa`` and ``sb``."""
    if left["closes"] is None:
        return right | {"pa": left["pa"] + right["pa"], "pb": left["pb"] + right["pb"]}, None
    open_a, open_b = left["sa"] + right["pa"], left["sb"] + right["pb"]
    if right["closes"] is None:
        return left | {"sa": open_a, "sb": open_b}, None
    return left | {"sa": right["sa"], "sb": right["sb"]}, (open_a, open_b)


def ranges(padded: str, words: re.Pattern) -> Iterator[tuple[str, int, int]]:
    """The byte ranges of a text: the words they touch, and the range's first byte
    and end, counted from there."""
    part, start, lo, at, border = [], 0, 0, 0, RANGE
    for found in words.finditer(padded):
        word = found.group()
        size = len(word.encode())
        end = at + size
        part.append(word)
        if end >= border:
            if end == border or size > LONGEST:
                yield "".join(part), lo, end - start
                part, start, lo, border = [], end, 0, (end // RANGE + 1) * RANGE
            else:
                yield "".join(part), lo, border - start
                part, start, lo, border = [word], at, border - at, border + RANGE
        at = end
    if part:
        yield "".join(part), lo, at - start


def owned(tokens: list[tuple], at: int, lo: int, hi: int) -> list[tuple]:
    """Tokens of a word at ``at`` that end after ``lo`` and up to ``hi``."""
    out, end = [], at
    for t in tokens:
        end += t[1]
        if lo < end <= hi:
            out.append((*t, end))
    return out


def cut_word(tokens: tuple, at: int, lo: int, hi: int, opens: bool) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Of a word at ``at`` cut by a range: the tokens of both up to the first
    common end if the range ``opens`` with this word (a list of one pair, or none),
    the groups closed after it, the tokens after the last common end (likewise)."""
    a, b = (owned(x, at, lo, hi) for x in tokens)
    bounds = sorted({t[2] for t in a} & {t[2] for t in b})
    between = lambda low, high: tuple([t[:2] for t in x if low < t[2] <= high] for x in (a, b))
    if not opens:
        bounds = [max(at, lo), *bounds]
    elif not bounds:
        return [between(lo, hi)], [], []
    prefix = [between(lo, bounds[0])] if opens else []
    return prefix, [between(x, y) for x, y in zip(bounds, bounds[1:])], [between(bounds[-1], hi)]


class Block:
    """Texts whose words and pairs are numbered together."""

    def __init__(self, number: int, row: int | None = None):
        self.number, self.row, self.size = number, row, 0
        self.known: dict = {}  # word -> its place among the block's
        self.closed: list[tuple[str, bytes]] = []
        self.rows: list[dict] = []
        self.used: list[np.ndarray] = []

    def place(self, closed: tuple[str, bytes], word: str | None = None) -> int:
        if word is not None:
            self.known[word] = len(self.closed)
        self.closed.append(closed)
        return len(self.closed) - 1

    def add(self, places: list[int], row: dict, text: bool) -> None:
        """A text made of the fragments at ``places``; its groups are hashed, or
        written out if ``text``."""
        of = self.closed
        shown = ";".join(filter(None, [of[i][0] for i in places]))
        row |= {"text": shown} if text else {"groups_sha256": hashlib.sha256(shown.encode()).hexdigest() if shown else ""}
        self.rows.append(row)
        self.used.append(np.array(places, np.int32))

    def batches(self) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(packed) >> 3 for _, packed in self.closed], np.int64)
        every = np.frombuffer(b"".join([packed for _, packed in self.closed]), np.int64)
        heads = np.concatenate(([0], np.cumsum(sizes)))[:-1, None].astype(np.int64) + np.arange(3)
        sizes -= 3
        numbers = np.column_stack((every[heads].reshape(-1, 3), sizes))
        total = np.zeros(len(self.closed), np.int64)
        for row, places in zip(self.rows, self.used):
            some, times = np.unique(places, return_counts=True)
            total[some] += times
            n = (numbers[some] * times[:, None]).sum(0)
            for name, x, more in zip(("n_a", "n_b", "n_groups", "n_links"), n.tolist(), row.pop("open", (0, 0, 0, 0))):
                row[name] = x + more
            row |= {"kind": "text", "block": self.number, "uses": some.astype("<u4").tobytes() + times.astype("<u4").tobytes()}
        pairs, at = np.unique(np.delete(every, heads.ravel()), return_inverse=True)
        n = np.bincount(at, np.repeat(total, sizes), len(pairs)).astype(np.int64)
        packed = np.concatenate(([len(sizes)], sizes, at)).astype("<u4").tobytes()
        self.rows.append({"kind": "words", "block": self.number, "uses": packed})
        for r in self.rows:
            r |= {c: flat(r[c]) for c in ("pa", "pb", "sa", "sb") if c in r}
        for lo in range(0, len(self.rows), 1 << 10):
            yield pa.RecordBatch.from_pylist(self.rows[lo:lo + (1 << 10)], SCHEMA)
        for lo in range(0, len(pairs), 1 << 16):
            some = slice(lo, lo + (1 << 16))
            size = len(pairs[some])
            told = {"kind": ["pair"] * size, "block": [self.number] * size, "row": [self.row] * size, "p": np.arange(lo, lo + size),
                    "a": pairs[some] >> 32, "b": pairs[some] & 0xFFFFFFFF, "n": n[some]}
            yield pa.RecordBatch.from_arrays([pa.array(told[f.name], f.type) if f.name in told else pa.nulls(size, f.type) for f in SCHEMA], schema=SCHEMA)


SCHEMA = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("seg", pa.int64()), ("ok", pa.bool_()),
                    *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("text", pa.string()),
                    ("uses", pa.binary()), *((c, pa.list_(pa.int32())) for c in ("pa", "pb", "sa", "sb")), ("closes", pa.int64()),
                    ("p", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
TABLE = ("kind string, block long, id long, row long, seg long, ok boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "text string, uses binary, pa array<int>, pb array<int>, sa array<int>, sb array<int>, closes long, p int, a int, b int, n long")


def flat(tokens: list[tuple]) -> list[int]:
    return [x for t in tokens for x in t]


def unflat(numbers: list[int]) -> list[tuple]:
    return [*zip(numbers[::2], numbers[1::2])]


class Aligner:
    """A worker's tokenizers and the words it has met."""

    def __init__(self, byte_level: str, pieces: bytes):
        self.pair, self.met = Pair(byte_level, pieces), {}

    def learn(self, words: set[str]) -> None:
        """Meet these words; all of them are known afterwards."""
        new = [w for w in words if w not in self.met]
        if len(self.met) + len(new) > CACHE_WORDS:
            self.met.clear()
            new = [*words]
        for lo in range(0, len(new), 1 << 14):
            some = new[lo:lo + (1 << 14)]
            self.met.update(zip(some, self.pair.closed_words(some)))

    def places(self, block: Block, words: list[str]) -> list[int] | None:
        """The places in the block of words that were met; None if a word has no tokens."""
        known = block.known
        missing = set(words).difference(known)
        if not all([self.met[w] for w in missing]):
            return None
        for w in missing:
            block.place(self.met[w], w)
        return [known[w] for w in words]

    def whole(self, block: Block, row: dict, words: list[str]) -> None:
        """A text that is one range."""
        places = self.places(block, words) if words else None
        block.add(places or [], row | {"ok": places is not None}, False)

    def part(self, block: Block, row: dict, words: list[str], lo: int, hi: int) -> None:
        """A byte range of a longer text, with the words that it touches."""
        ends = np.cumsum([len(w.encode()) for w in words]).tolist()
        # the first group of a range is open, unless the text starts with it
        opens, last = row["seg"] > 0, ends[-1] > hi
        self.learn(set(words))
        places, tokens = self.places(block, words[opens:len(words) - last]), self.pair.tokens([words[0], words[-1]])
        fragment = {"pa": [], "pb": [], "sa": [], "sb": [], "closes": row["seg"], "ok": places is not None and None not in tokens}
        if fragment["ok"]:
            prefix, suffix = [], []
            if opens:
                prefix, inside, suffix = cut_word(tokens[0], 0, lo, hi, True)
                places = [block.place(closed(inside)), *places]
                fragment["closes"] = row["seg"] if suffix else None
            if last and not (opens and len(words) == 1):
                _, inside, suffix = cut_word(tokens[1], ends[-1] - len(words[-1].encode()), lo, hi, False)
                places = [*places, block.place(closed(inside))]
            for names, tokens in ((("pa", "pb"), prefix), (("sa", "sb"), suffix)):
                fragment |= zip(names, tokens[0] if tokens else ([], []))
            row["open"] = (len(fragment["pa"]) + len(fragment["sa"]), len(fragment["pb"]) + len(fragment["sb"]), 0, 0)
        block.add(places if fragment["ok"] else [], row | fragment, True)


def aligned(texts: DataFrame, byte_level: str, pieces: bytes) -> DataFrame:
    """``TABLE``: rows of texts and parts of texts, of blocks' words and pairs."""
    shared = texts.sparkSession.sparkContext.broadcast((byte_level, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = worker_cache("align")
        key = hashlib.sha256(shared.value[0].encode() + shared.value[1]).hexdigest()
        if key not in made:
            made[key] = Aligner(*shared.value)
        aligner, number = made[key], TaskContext.get().partitionId() << 32

        block, waiting, size = Block(number), [], 0

        def add_waiting() -> None:
            aligner.learn({w for _, words in waiting for w in words})
            for part, words in waiting:
                aligner.whole(block, part, words)
            waiting.clear()

        gc.disable()  # the words met are many objects, and no cycle is made
        try:
            for batch in batches:
                for id_, row, seg, text, lo, hi in zip(*(batch.column(c) for c in ("id", "row", "seg", "text", "lo", "hi"))):
                    text, part = text.as_py(), {"id": id_.as_py(), "row": row.as_py(), "seg": seg.as_py()}
                    if part["row"] is None:
                        waiting.append((part, aligner.pair.split(text) if text else []))
                        size += len(text or "") + 64
                        if size >= BATCH:
                            add_waiting()
                            block.size, size = block.size + size, 0
                            if block.size >= BLOCK:
                                yield from block.batches()
                                number += 1
                                block = Block(number)
                    else:  # a block of its own, as the whole text may turn out to have no tokens
                        number += 1
                        own = Block(number, part["row"])
                        aligner.part(own, part, aligner.pair.words.findall(text), lo.as_py(), hi.as_py())
                        yield from own.batches()
            add_waiting()
            yield from block.batches()
        finally:
            gc.enable()

    return texts.mapInArrow(run, TABLE)


def dealt(docs: DataFrame, id_col: str, text_col: str, byte_level: str, pieces: bytes) -> DataFrame:
    """Texts as they are, null ``row``, and the ranges of longer ones: ``row`` (a
    number of the text), ``seg``, ``text``, ``lo``, ``hi``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    long = F.coalesce(F.octet_length("text") >= RANGE, F.lit(False))
    nothing = F.lit(None).cast("long")
    whole = rows.filter(~long).select("id", nothing.alias("row"), F.lit(0).cast("long").alias("seg"), "text", nothing.alias("lo"), nothing.alias("hi"))
    words = Pair(byte_level, pieces).words
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("seg", pa.int64()), ("text", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text, row in zip(*(batch.column(c) for c in ("id", "text", "row"))):
                for seg, (part, lo, hi) in enumerate(ranges(" " + text.as_py(), words)):
                    rows = [{"id": id_.as_py(), "row": row.as_py(), "seg": seg, "text": part, "lo": lo, "hi": hi}]
                    yield pa.RecordBatch.from_pylist(rows, schema)

    parts = rows.filter(long).mapInArrow(run, "id long, row long, seg long, text string, lo long, hi long")
    return whole.unionByName(stored(parts.repartition("row", "seg")))


SEAM = "kind string, row long, seg long, pa array<int>, pb array<int>, sa array<int>, sb array<int>, closes long, n_links long, text string, pairs array<long>"


def composed(parts: DataFrame) -> DataFrame:
    """The seams (``row``, ``seg`` of the range that closes it, ``n_links``,
    ``text``, ``pairs``) of texts in several ranges, by a tree of compositions."""
    def level(key: tuple, table: pa.Table) -> pa.Table:
        row, seg = key[0].as_py(), key[1].as_py()
        found, whole = [], None
        for f in table.sort_by("seg").to_pylist():
            f |= {c: unflat(f[c]) for c in ("pa", "pb", "sa", "sb")}
            if whole is None:
                whole = f
                continue
            closes = f["closes"]
            whole, seam = compose(whole, f)
            if seam:
                found.append((closes, closed([seam])))
        rows = [{"kind": "seam", "row": row, "seg": at, "n_links": len(packed) // 8 - 3, "text": text, "pairs": array("q", packed)[3:].tolist()}
                for at, (text, packed) in found]
        rows.append({c: flat(whole[c]) for c in ("pa", "pb", "sa", "sb")} | {"kind": "part", "row": row, "seg": seg, "closes": whole["closes"]})
        types = {"kind": pa.string(), "text": pa.string(), "pairs": pa.list_(pa.int64())} | {c: pa.list_(pa.int32()) for c in ("pa", "pb", "sa", "sb")}
        return pa.Table.from_pylist(rows, pa.schema([(c.split()[0], types.get(c.split()[0], pa.int64())) for c in SEAM.split(", ")]))

    seams = []
    parts = parts.select("row", "seg", "pa", "pb", "sa", "sb", "closes")
    while True:
        upper = parts.withColumn("above", F.floor(F.col("seg") / FAN)).groupBy("row", "above").applyInArrow(level, SEAM)
        upper = stored(upper)
        seams.append(upper.filter("kind = 'seam'").select("row", "seg", "n_links", "text", "pairs"))
        parts = upper.filter("kind = 'part'").select("row", "seg", "pa", "pb", "sa", "sb", "closes")
        if not parts.agg(F.max("seg")).first()[0]:
            break
    out = seams[0]
    for s in seams[1:]:
        out = out.unionByName(s)
    return out


def hashed(pieces: DataFrame) -> DataFrame:
    """``row`` and ``groups_sha256`` from the texts' group strings in order; a text
    is read as a stream, and one piece of it is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state, any_ = None, None, False
        told = lambda: pa.RecordBatch.from_pylist([{"row": row, "groups_sha256": state.hexdigest()}])
        for batch in batches:
            for r, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                if state is None or r != row:
                    if state is not None:
                        yield told()
                    row, state, any_ = r, hashlib.sha256(), False
                if text.as_py():
                    state.update((";" if any_ else "").encode() + text.as_py().encode())
                    any_ = True
        if state is not None:
            yield told()

    ordered = pieces.repartition("row").sortWithinPartitions("row", "seg", "turn").select("row", "text")
    return ordered.mapInArrow(run, "row long, groups_sha256 string")


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
COUNTED = "id long, row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def counted(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts' rows with ``n_best`` and ``count_sum``; ``texts`` has rows of texts
    and words, ``pairs`` has ``block``, ``p``, ``c`` (the pair's count) and ``best``."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        words = next(np.frombuffer(r["uses"], "<u4").astype(np.int64) for r in rows if r["kind"] == "words")
        sizes, at = words[1:words[0] + 1], words[words[0] + 1:]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        # pairs of texts without tokens are not counted and stay at 0
        values = np.zeros((2, int(at.max(initial=-1)) + 1), np.int64)
        values[:, right["p"].to_numpy()] = right["best"].cast(pa.int64()).to_numpy(), right["c"].to_numpy()
        sums = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(values[:, at], axis=1)), axis=1)
        per_word = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
        out = []
        for r in rows:
            if r["kind"] == "text":
                uses = np.frombuffer(r["uses"], "<u4").reshape(2, -1)
                best, total = (per_word[:, uses[0]] * uses[1].astype(np.int64)).sum(1).tolist()
                out.append({c: r.get(c) for c in ("id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")} | {"n_best": best, "count_sum": total})
        return pa.Table.from_pylist(out, pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in COUNTED.split(", ")]))

    left = texts.select("kind", "block", "id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "uses")
    right = pairs.select(F.col("block").alias("of"), "p", "c", "best")
    return left.groupBy("block").cogroup(right.groupBy("of")).applyInArrow(run, COUNTED)


def align(docs: DataFrame, byte_level: str, pieces: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_a``, ``n_b`` (tokens), ``n_groups``,
    ``n_links`` (token pairs that overlap), ``n_best`` (links whose id pair has the
    highest count of its b id over all texts), ``count_sum`` (of the links' counts),
    ``groups_sha256``.

    ``byte_level`` is the JSON of a byte-level tokenizer, ``pieces`` a sentencepiece
    model.  Null and empty texts, and texts that one of the two does not give back
    byte for byte, have no tokens: zeros and an empty digest, and add to no count.
    Null ids and repeated rows stay; other columns are ignored.
    """
    table = stored(aligned(dealt(docs, id_col, text_col, byte_level, pieces), byte_level, pieces))
    parts = table.filter("kind = 'text' AND row IS NOT NULL")
    bad = parts.filter("NOT ok").select("row").distinct()
    seams = composed(parts.join(bad, "row", "left_anti"))
    seam_pairs = stored(seams.select("row", F.explode("pairs").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("n")))
    seam_pairs = seam_pairs.select("row", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "n")
    pairs = table.filter("kind = 'pair'").select("block", "row", "p", "a", "b", "n").join(bad, "row", "left_anti")
    counts = cut(pairs.select("a", "b", "n").unionByName(seam_pairs.select("a", "b", "n")).groupBy("a", "b").agg(F.sum("n").alias("c")))
    # a row per id of b
    top = counts.groupBy("b").agg(F.max("c").alias("top"))
    counts = counts.join(top, "b").select("a", "b", "c", (F.col("c") == F.col("top")).alias("best"))
    found = stored(counted(table.filter("kind <> 'pair'"), pairs.join(counts, ["a", "b"])))
    short = found.filter("row IS NULL").select("id", *NUMBERS, "groups_sha256")
    # texts in several ranges: their parts and seams summed up
    across = seam_pairs.join(counts, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("c")).alias("count_sum"))
    seam_sums = seams.groupBy("row").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_links").alias("n_links"))
    zero = F.lit(0).cast("long")
    sums = found.filter("row IS NOT NULL").select("id", "row", *NUMBERS)
    sums = sums.unionByName(seam_sums.join(across, "row").select(
        F.lit(None).cast("long").alias("id"), "row", zero.alias("n_a"), zero.alias("n_b"), "n_groups", "n_links", "n_best", "count_sum"))
    sums = sums.groupBy("row").agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in NUMBERS])
    texts = parts.select("row", "seg", F.lit(1).alias("turn"), "text").unionByName(seams.select("row", "seg", F.lit(0).alias("turn"), "text"))
    failed = bad.withColumn("failed", F.lit(True))
    long = sums.join(hashed(texts), "row").join(failed, "row", "left")
    long = long.select("id", *[F.when(F.col("failed"), 0).otherwise(F.col(c)).alias(c) for c in NUMBERS],
                       F.when(F.col("failed"), "").otherwise(F.col("groups_sha256")).alias("groups_sha256"))
    return short.unionByName(long).withColumnRenamed("id", id_col)


ship_by_value(__name__)
