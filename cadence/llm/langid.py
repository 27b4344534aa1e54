"""Language ID by compression.

Each language has a raw-content zstandard dictionary cut from labelled texts.
A text is encoded with every language's dictionary and gets the language under
which it is smallest; a text whose two smallest sizes are too close is rejected.

Texts are reduced to lower-case words.  A long text is encoded in chunks, so
that it leans on the dictionary throughout and not on its own past; the sizes
of all chunks count.  Dictionaries hold only lines that occur once in the sample:
passages that travel between languages say nothing about one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import ship_by_value, worker_cache
from cadence.llm.sampling import labelled_sample

UNDETERMINED = "und"
LEVEL, CHUNK = 12, 1500
#: the share of the second smallest size that the smallest must save; on folds of labelled rows it rejects what is
#: written in two languages and random letters, and 2 to 4 of 1 000 other documents
MARGIN = 0.01
LETTERS = regex.compile(r"\p{L}+")


def plain(text: str) -> bytes:
    return " ".join(LETTERS.findall(text.lower())).encode("utf-8", "replace")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
        per_lang: int = 256, chars: int = 4000, dictionary: int = 32 << 10) -> dict[str, tuple[bytes, int]]:
    """Language -> (dictionary, number of labelled rows), from at most ``per_lang``
    rows with a text of each and ``chars`` characters of each row, in slices spread
    over it.  Every row has the same share of the dictionary: a stretch of its
    lines, from a place that their hash tells."""
    there = docs.filter(F.col(text_col).isNotNull())
    sample, counts = labelled_sample(there, there, lang_col, id_col, text_col, per_label=per_lang, chars=chars)
    seen: Counter = Counter()
    texts: dict[str, list] = {lang: [] for lang in counts}
    for lang, text in sample:
        lines = [plain(x) for x in text.split("\n")]
        texts[lang].append(lines)
        seen.update(set(lines))

    def content(rows: list) -> bytes:
        own = [x for x in (b" ".join(x for x in lines if seen[x] == 1) for lines in rows) if x]
        share = max(1, dictionary // max(1, len(own)) - 1)
        starts = [zlib.crc32(x) % max(1, len(x) - share + 1) for x in own]
        return b" ".join(x[at:at + share] for x, at in zip(own, starts))

    return {lang: (content(rows), counts[lang]) for lang, rows in texts.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, tuple[bytes, int]]):
        self.languages = []
        # ties go to the language with more labelled rows, then by name
        for lang, (content, n) in sorted(dictionaries.items(), key=lambda x: (-x[1][1], x[0])):
            # zstandard takes no dictionary under 8 bytes
            d = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.languages.append((lang, zstandard.ZstdCompressor(write_content_size=False, write_checksum=False, write_dict_id=False, dict_data=d)))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin: the share of the second smallest size that the
        smallest one saves (1 if only one language is known)."""
        words = plain(text or "")
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        chunks = [words[i:i + CHUNK] for i in range(0, len(words), CHUNK)]
        sizes = [sum(len(c.compress(x)) for x in chunks) for _, c in self.languages]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=None)
        return self.languages[best][0], 1.0 if second is None else (second - sizes[best]) / second


def rejected(lang_pred: Column, score: Column, min_margin: float = MARGIN) -> Column:
    """No language, or two languages that compress the text almost alike."""
    return (lang_pred == UNDETERMINED) | (score < min_margin)


PREDICTED = "id long, lang_pred string, score double"


def predict(docs: DataFrame, dictionaries: dict[str, tuple[bytes, int]], id_col: str = "doc_id",
            text_col: str = "text", *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score`` (the margin), after the
    columns named in ``keep``.

    Null texts and texts without a letter are ``und`` with score 0, as is all if
    no language was learnt.  Whole texts are read; null ids and repeated rows
    stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    kept = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
                       F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    passed = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{c} {kept.schema[c].dataType.simpleString()}" for c in passed), PREDICTED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, d = worker_cache("langid"), shared.value
        key = hashlib.sha256(repr(sorted(d.items())).encode()).digest()
        if key not in made:
            made.clear()
            made[key] = Classifier(d)
        for b in batches:
            found = [made[key].predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in passed), b.column("id"), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())], names=[*passed, "id", "lang_pred", "score"])

    return kept.mapInArrow(run, schema).withColumnsRenamed({"id": id_col} | dict(zip(passed, keep)))


ship_by_value(__name__)
