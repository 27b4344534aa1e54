"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a byte string has one BPE encoding, and its last token decides
the rest: the encoding of ``b[:i]`` is that of ``b[:i - len(t)]`` followed by
``t``.  So an encoding is stored as the last token of each prefix.  Token ``t``
is the last one of ``b[:i]`` iff its bytes end there and BPE leaves the border
between it and the last token of ``b[:i - len(t)]`` alone.  Appending bytes
never changes what is stored for the prefixes before them, so appends are exact,
and an edit recomputes from its own place on until the stored tokens agree again.

Whether BPE leaves a border alone is read off the two tokens' merge histories:
the pieces that touch the border grow in order of rank, and a merge across it
must not come up before the piece on its side is used up.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.common import ship_by_value, worker_cache

NEVER = 1 << 40
#: encoded pieces and checked borders a worker keeps; beyond it, it starts afresh
CACHE_PIECES, CACHE_BORDERS = 400_000, 500_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file of lines "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Vocabulary:
    """Tokens of byte-level BPE ranks, with their merge histories on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.borders: dict[int, dict[int, bool]] = defaultdict(dict)  # by the token on the left, then on the right
        self.checked = 0
        self._spines: dict[bytes, tuple] = {}
        for b in range(256):
            if bytes([b]) not in ranks:
                raise ValueError("the vocabulary lacks single bytes")

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two pieces whose merge makes this token."""
        parts, own = [token[i:i + 1] for i in range(len(token))], self.ranks[token]
        while len(parts) > 2:
            r, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if r >= own:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def spines(self, token: bytes) -> tuple[list, list]:
        """(piece, rank of the merge that uses it up) of the pieces at the
        token's left end and at its right end, smallest first."""
        if token not in self._spines:
            sides = []
            for end in (0, -1):
                chain, piece = [(token, NEVER)], token
                while len(piece) > 1 and (halves := self._halves(piece)):
                    used = self.ranks[piece]
                    piece = halves[end]
                    chain.append((piece, used))
                sides.append(chain[::-1])
            self._spines[token] = tuple(sides)
        return self._spines[token]

    def check_border(self, a: int, b: int) -> bool:
        """Whether BPE of two tokens' bytes, one after the other, is the two;
        remembered in ``borders``."""
        if self.checked >= CACHE_BORDERS:
            self.borders.clear()
            self.checked = 0
        self.checked += 1
        known = self.borders[a][b] = self._border_holds(self.bytes[a], self.bytes[b])
        return known

    def _border_holds(self, a: bytes, b: bytes) -> bool:
        left, right = self.spines(a)[1], self.spines(b)[0]
        i = j = 0
        while True:
            (x, x_used), (y, y_used) = left[i], right[j]
            across = self.ranks.get(x + y, NEVER)
            # of equal ranks the leftmost merge comes first
            if across < x_used and across <= y_used and across < NEVER:
                return False
            if x_used == y_used == NEVER:
                return True
            if x_used <= y_used:
                i += 1
            else:
                j += 1


class PrefixEncoding:
    """Encoding of one byte string that can be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[int] = []  # the last token of each prefix
        self.append(data)

    def append(self, more: bytes) -> PrefixEncoding:
        start, self.data = len(self.data), self.data + more
        v, data, last = self.vocabulary, self.data, self.last
        rank, longest, borders, check = v.ranks.get, v.longest, v.borders, v.check_border
        for end in range(start + 1, len(data) + 1):
            for at in range(max(0, end - longest), end):
                token = rank(data[at:end])
                if token is None:
                    continue
                if at:
                    holds = borders[last[at - 1]].get(token)
                    if holds is None:
                        holds = check(last[at - 1], token)
                    if not holds:
                        continue
                last.append(token)
                break
        return self

    def edit(self, start: int, stop: int, new: bytes) -> PrefixEncoding:
        """Replace bytes ``start`` to ``stop``.  Prefixes up to ``start`` stay.  After
        the new bytes, what is stored depends on the bytes and the last tokens of as
        many prefixes as the longest token is long: once these agree with the old
        ones, so do all after them, and the old ones are taken over."""
        old, last, shift = self.data, self.last, len(new) - (stop - start)
        same, self.data, self.last = 0, old[:start], last[:start]
        longest, tail = self.vocabulary.longest, old[stop:]
        self.append(new)
        for lo in range(0, len(tail), longest):
            self.append(tail[lo:lo + longest])
            for end in range(len(self.data) - len(tail[lo:lo + longest]) + 1, len(self.data) + 1):
                same = same + 1 if self.last[end - 1] == last[end - 1 - shift] else 0
                if same >= longest:
                    self.data, self.last = old[:start] + new + tail, self.last[:end] + last[end - shift:]
                    return self
        return self

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.bytes[token])
        return out[::-1]


class TextEncoding:
    """Encoding of one text that can be edited: the pattern's matches and each
    one's ids.  An edit splits again from the match before it until matches start
    at the same places as before, and encodes those that are new."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.matches = [(m.start(), m.end(), encoder.piece(m.group())) for m in encoder.pattern.finditer(text)]

    def edit(self, start: int, stop: int, new: str) -> TextEncoding:
        """Replace characters ``start`` to ``stop``."""
        old, shift = self.matches, len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        # a match may look one character ahead, so the last one that ends before the edit is made anew
        kept = max(0, bisect_left(old, start, key=lambda m: m[1]) - 1)
        self.matches = old[:kept]
        for m in self.encoder.pattern.finditer(self.text, self.matches[-1][1] if kept else 0):
            before = m.start() - shift
            i = bisect_left(old, before, key=lambda x: x[0])
            if m.start() >= start + len(new) and i < len(old) and old[i][0] == before:
                self.matches += [(a + shift, b + shift, ids) for a, b, ids in old[i:]]
                break
            self.matches.append((m.start(), m.end(), self.encoder.piece(m.group())))
        return self

    def append(self, more: str) -> TextEncoding:
        return self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(ids for _, _, ids in self.matches), "<u4").tolist()


class Encoder:
    """Encodes whole texts, each match of the pattern separately."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern, self.pieces = vocabulary, regex.compile(pattern), {}

    def piece(self, piece: str) -> bytes:
        """Ids of one match, of those met lately without a search."""
        return self.pieces.get(piece) or self._piece(piece)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        rank = self.vocabulary.ranks.get(data)
        # a token of its own, BPE of it being itself, needs no search
        ids = [rank] if rank is not None else PrefixEncoding(self.vocabulary, data).ids()
        packed = np.array(ids, "<u4").tobytes()
        if len(self.pieces) >= CACHE_PIECES:
            self.pieces.clear()
        if len(data) <= 64:
            self.pieces[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, piece = self.pieces.get, self._piece
        return b"".join([get(p) or piece(p) for p in self.pattern.findall(text)])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encoder(data: bytes, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary file's content, made once."""
    made = worker_cache("bpe")
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in made:
        made[key] = Encoder(Vocabulary(parse_ranks(data)), pattern)
    return made[key]


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """The vocabulary file's content (a file of the tokenizer package, of fixed
    size), to be broadcast, so that executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


ENCODED = "id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", *,
                 with_ids: bool = True) -> DataFrame:
    """One row per input row: id, ``ids`` (little-endian unsigned 32-bit; null
    without ``with_ids``), ``n_tokens``, digests of the ids and of the bytes
    decoded from them.

    A null text counts as empty, which has no tokens.  Null ids and repeated
    rows stay as they are; other columns are ignored.  Control strings in a text
    are ordinary text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for b in batches:
            texts = b.column("text")
            ids, ns, shas, decoded = [], [], [], []
            for t in texts:
                packed = enc.encode(t.as_py() or "")
                ids.append(packed if with_ids else None)
                ns.append(len(packed) // 4)
                shas.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(enc.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(ids, pa.binary()), pa.array(ns, pa.int64()), pa.array(shas, pa.string()),
                 pa.array(decoded, pa.string())], names=["id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ENCODED).withColumnRenamed("id", id_col)


ship_by_value(__name__)
