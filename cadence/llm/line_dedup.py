"""Line dedup by winnowing over line hashes.

A repeated run counts from ``min_lines`` lines or ``min_words`` words on.  A line
goes if it lies in a run that counts and occurs earlier, by document and line:
whatever the run, all of its lines go, and the earliest place of each stays.

For each line of a text, its window is the shortest stretch from there that
counts; the smallest line hash of a window is selected as a fingerprint.  A run
that counts holds a whole window, and equal windows select the same line, so two
places of a run share a fingerprint.  The fingerprints' positions are joined, and
only around those that occur at two places or more are stretches looked at.

From such a position a match is extended both ways: on, by the windows over it,
and back, by the shortest stretches that end at a line, count without it and so
hold a window.  Together they cover every line of a run that counts: if neither
the run's lines from there on count nor those up to there do, the window of the
run's first line covers it.  Each stretch is looked up by its whole content, and
of equal ones the first place is the only one that stays.

DataFrame functions alone.  The texts' lines are kept as hashes and counts of
words; the joins keep one place of each content, however often it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    """The lines with a word: two independent hashes and number of words."""
    split = F.transform(F.split(text, "\n"), lambda x: F.struct(
        F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    return F.filter(split, lambda x: x["words"] > 0)


def _size(ahead: Column, min_words: int) -> Column:
    """Lines and words of ``ahead`` up to the line that reaches ``min_words``."""
    return F.aggregate(ahead, F.struct(F.lit(0).alias("n"), F.lit(0).alias("words")),
                       lambda a, x: F.when(a["words"] >= min_words, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["words"] + x["words"]).alias("words"))))


def _window(start: Column, min_lines: int, min_words: int) -> Column:
    """The window of a line: its number of lines ``n`` and the place ``at`` of the
    smallest hash in it; null if the text ends before."""
    ahead = F.slice("lines", start + 1, min_lines)
    least = lambda n: F.array_min(F.transform(F.slice("lines", start + 1, n), lambda x, i: F.struct(x["h"], (start + i).alias("at"))))["at"]
    return F.transform(F.array(_size(ahead, min_words)), lambda s: F.when(
        (s["n"] == min_lines) | (s["words"] >= min_words), F.struct(s["n"].alias("n"), least(s["n"]).alias("at"))))[0]


def _behind(end: Column, min_lines: int, min_words: int) -> Column:
    """Of the shortest stretch that counts and ends at a line: its start and number
    of lines; null if it does not count without that line (it is then the window of
    its first line)."""
    behind = F.slice("lines", F.greatest(end + 2 - min_lines, F.lit(1)), F.least(end + 1, F.lit(min_lines)))
    return F.transform(F.array(_size(F.reverse(behind), min_words)), lambda s: F.when(
        s["words"] - F.get("lines", end)["words"] >= min_words, F.struct((end + 1 - s["n"]).alias("start"), s["n"].alias("n"))))[0]


def line_table(docs: DataFrame, id_col: str, text_col: str, min_lines: int, min_words: int) -> DataFrame:
    """``id``, ``th`` (hash of the text), ``lines`` and each line's ``windows``."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), _lines(F.col(text_col)).alias("lines"))
    starts = F.sequence(F.lit(0), F.size("lines") - 1)
    return rows.filter(F.size("lines") > 0).withColumn("windows", F.transform(starts, lambda s: _window(s, min_lines, min_words)))


def fingerprints(rows: DataFrame) -> DataFrame:
    """``fp``, ``id``, ``th``, ``at``: the selected lines, each once."""
    chosen = F.array_distinct(F.transform(F.filter("windows", lambda w: w.isNotNull()), lambda w: w["at"]))
    at = rows.select("id", "th", "lines", F.explode(chosen).alias("at"))
    return at.select(F.get("lines", F.col("at"))["h"].alias("fp"), "id", "th", "at")


def stretches(rows: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """``id``, ``th``, ``start``, ``n`` and the content's hashes ``c1`` and ``c2`` of
    the stretches through the positions ``found``, both ways."""
    on = F.transform("windows", lambda w, s: F.when(F.array_contains("found", w["at"]), F.struct(s.alias("start"), w["n"].alias("n"))))
    ends = F.sequence(F.lit(0), F.size("lines") - 1)
    back = F.transform(F.transform(ends, lambda e: _behind(e, min_lines, min_words)), lambda b: F.when(
        F.array_contains("found", F.get("windows", b["start"])["at"]), b))
    every = F.filter(F.concat(on, back), lambda x: x.isNotNull())
    one = rows.select("id", "th", "lines", F.explode(every).alias("x"))
    part = F.slice("lines", F.col("x.start") + 1, F.col("x.n"))
    return one.select("id", "th", "x.start", "x.n", F.xxhash64(F.transform(part, lambda x: x["h"])).alias("c1"),
                      F.xxhash64(F.lit(1), F.transform(part, lambda x: x["g"])).alias("c2"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """``id``, ``th`` and the stretches (``runs``: start, n) of it that occur earlier."""
    rows = stored(line_table(docs, id_col, text_col, min_lines, min_words))
    prints = fingerprints(rows)
    place = F.struct("id", "th", "at")
    # each side of a join on its own exchange: a hot line or stretch is then split by AQE's skew join
    repeated = stored(prints.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("fp"))
    found = prints.join(repeated, "fp", "left_semi").groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("at").alias("found"))
    around = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    w = stored(stretches(around, min_lines, min_words))
    place = F.struct("id", "th", "start")
    first = w.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = stored(first.filter("first <> last").select("c1", "c2", "first"))
    later = w.join(first, ["c1", "c2"]).filter(place != F.col("first"))
    return later.groupBy("id", "th").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """``docs`` with the later repeated runs cut from ``text_col``, and the
    columns ``n_lines`` and ``n_removed`` (replaced if there).

    Lines without a word are no part of a run: they are neither matched nor
    removed.  A text that loses all lines becomes empty; null and empty texts
    stay.  A run repeated within one text is cut there too.  Null ids come first
    in order; rows that repeat both id and text are one document and lose the
    same lines.  An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed")
    runs = repeated_runs(docs, id_col, text_col, min_lines=min_lines, min_words=min_words)
    runs = runs.select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("runs").alias("_runs"))
    joined = docs.join(runs, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_th")), "left")
    # marks of the lines that go, as starts of covered stretches, spread over the lines with a word
    split = F.split(text_col, "\n")
    full = F.filter(F.transform(split, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
    gone = F.array_distinct(F.flatten(F.transform("_runs", lambda r: F.slice(F.col("_full"), r["start"] + 1, r["n"]))))
    kept = F.array_join(F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("_gone"))),
                                    lambda i: F.get("_split", i)), "\n")
    out = joined.withColumns({"_split": split, "_full": F.when(F.col("_runs").isNotNull(), full)}).withColumn("_gone", gone)
    return out.withColumns({
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size("_split")),
        "n_removed": F.when(F.col("_runs").isNull(), 0).otherwise(F.size("_gone")),
        text_col: F.when(F.col("_runs").isNull(), F.col(text_col)).otherwise(kept)}).select(*docs.columns, "n_lines", "n_removed")
