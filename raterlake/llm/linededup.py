"""Deletes runs of lines that an earlier document, or an earlier part of the same one, already holds: winnowing over line hashes.

Of every ``window`` neighbouring line hashes the smallest is selected (the last among equals), so any two places that share a run of so many
lines have selected the same line of it: that is the guarantee. A selected line is one row, a fingerprint with its position and the
hashes of the lines around it; a line that is least in several windows is selected once. Positions are joined by fingerprint, those
that stand at one position only go, and the matches of the others are extended to both sides by the neighbouring hashes as far as the windows
that selected the line reach. Each such window keeps its first position, by document and line; at later ones the lines
of the match are deleted. Overlapping matches are one run.

So a line goes exactly when it lies in ``window`` neighbouring lines that equal ``window`` neighbouring lines earlier
in the order of (id, row, line). Lines are compared without case, with white space collapsed and trimmed; lines without
a word are no part of the order: they neither match nor end a run, and stay in the text.

Defined results: a null text counts as empty and stays null, a null id comes first; of rows with equal ids the order is
that of their text's hash, and rows that are equal in both are one document, treated alike. Texts of fewer lines are
returned unchanged. Copies of a window in thousands of documents meet as one smallest place (a partial aggregate),
never as pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlake.llm.shared import dealt, stored

_SPACE = r"[\x20\x09-\x0D]+"
_MADE = ("n_lines", "n_removed", "runs")


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def line_hashes(text: Column) -> Column:
    """Hash of each line that has a word, in order."""
    lines = F.filter(F.split(text, "\n"), _has_word)
    return F.transform(lines, lambda x: F.xxhash64(F.lower(F.trim(F.regexp_replace(x, _SPACE, " ")))))


def _fingerprints(hashes: Column, window: int) -> Column:
    """For each selected line: its place, its hash (print), those of the window - 1 lines before and after it (null beyond the text), and
    how many lines before it the windows begin that selected it."""
    n = F.size(hashes)

    def least(i: Column) -> Column:
        # Place of the smallest of the window that begins at i: of equal ones the last.
        return _let(F.slice(hashes, i + 1, window), lambda w: _let(F.array_min(w), lambda m: i + window - F.array_position(F.reverse(w), m).cast("int")))

    def of(minima: Column) -> Column:
        # minima[i]: the place that the window beginning at i selects.
        def one(at: Column) -> Column:
            reach = F.filter(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: F.coalesce(F.get(minima, at - k) == at, F.lit(False)))
            around = F.transform(F.sequence(F.lit(1 - window), F.lit(window - 1)), lambda k: F.get(hashes, at + k))
            return F.struct(at.alias("at"), F.get(hashes, at).alias("print"), around.alias("around"), reach.alias("reach"))

        return F.transform(F.array_distinct(minima), one)

    return F.when(n >= window, _let(F.transform(F.sequence(F.lit(0), n - window), least), of))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """_id, _row, at, print, around, reach: the selected lines of every text, once for equal rows."""
    t = F.coalesce(F.col(text), F.lit(""))
    each = _let(line_hashes(t), lambda h: _fingerprints(h, window))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(t).alias("_row"), F.explode(each).alias("_x"))
    return rows.select("_id", "_row", "_x.*").distinct()


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """_id, _row, at: each window of lines (by its first) that occurs at an earlier place."""
    # Both tables are read several times, and the lines are hashed once.
    selected = stored(fingerprints(docs, id_col, text, window))
    counts = selected.groupBy("print").agg(F.count("*").alias("_n")).filter("_n > 1")
    # A line may stand in a third of all documents: its positions are dealt by themselves, so copies of one text part too.
    place = F.xxhash64("_id", "_row", "at")
    rows, counts = dealt(selected, counts, ["print"], "_n", place)
    joined = rows.join(counts.select("print", "_salt"), ["print", "_salt"])
    # Extended matches: the lines from k before the fingerprint on.
    reached = joined.select("_id", "_row", "at", "print", "around", F.explode("reach").alias("k"))
    run = F.xxhash64(F.slice("around", F.lit(window) - F.col("k"), window))
    matches = stored(reached.select("_id", "_row", "print", "k", (F.col("at") - F.col("k")).alias("at"), run.alias("run")))
    # Equal matches have one first place.
    first = matches.groupBy("print", "k", "run").agg(F.min(F.struct("_id", "_row", "at")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    rows, first = dealt(matches, first, ["print", "k", "run"], "_n", place)
    later = rows.join(first, ["print", "k", "run", "_salt"]).filter(F.struct("_id", "_row", "at") != F.col("_first"))
    return later.select("_id", "_row", "at")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """The rows of docs with the later repeated runs cut out of the text, and n_lines, n_removed (lines with a word before,
    and those removed; long) and runs, an array of "first:last" among those lines. Clashing columns of docs are dropped."""
    gone = repeated_windows(docs, id_col, text, window).groupBy("_id", "_row").agg(F.sort_array(F.collect_set("at")).alias("_at"))
    gone = gone.withColumnRenamed("_id", "_gone_id").withColumnRenamed("_row", "_gone_row")
    rows = docs.drop(*_MADE, "_gone_id", "_gone_row", "_at", "_row", "_out").withColumn("_row", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    t = F.coalesce(F.col(text), F.lit(""))

    def cut(at: Column) -> Column:
        # Windows begin a run when the one before doesn't reach them.
        starts = F.filter(at, lambda x, i: (i == 0) | (x > F.get(at, i - 1) + window))
        ends = F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1) > x + window, F.lit(True)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), (b + window - 1).alias("b")))

    def apply(runs: Column) -> Column:
        def left(lines: Column) -> Column:
            every = F.sequence(F.lit(0), F.size(lines) - 1)
            worded = F.filter(every, lambda i: _has_word(F.get(lines, i)))
            gone = _let(worded, lambda w: F.flatten(F.transform(runs, lambda r: F.slice(w, r["a"] + 1, r["b"] - r["a"] + 1))))
            return _let(gone, lambda g: F.struct(F.array_join(F.transform(F.array_except(every, g), lambda i: F.get(lines, i)), "\n").alias("text"), F.size(g).cast("long").alias("gone")))

        return _let(_let(F.split(t, "\n"), left), lambda s: F.struct(s["text"].alias("text"), s["gone"].alias("gone"), F.transform(runs, lambda r: F.concat_ws(":", r["a"], r["b"])).alias("runs")))

    joined = rows.join(gone, rows[id_col].eqNullSafe(gone["_gone_id"]) & (rows["_row"] == gone["_gone_row"]), "left")
    out = joined.withColumn("_out", F.when(F.col("_at").isNotNull(), _let(cut(F.col("_at")), apply)))
    return (
        out.withColumn("n_lines", F.size(F.filter(F.split(t, "\n"), _has_word)).cast("long"))
        .withColumn("n_removed", F.coalesce("_out.gone", F.lit(0).cast("long")))
        .withColumn("runs", F.coalesce("_out.runs", F.array().cast("array<string>")))
        .withColumn(text, F.coalesce("_out.text", F.col(text)))
        .drop("_out", "_at", "_row", "_gone_id", "_gone_row")
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """The documents after the cut, with the columns of docs; those left without a word go, and n_chars fits the new text."""
    safe = docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in _MADE})
    out = dedup_lines(safe, id_col, text, window).filter((F.col("n_removed") == 0) | _has_word(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"_own_{c}").alias(c) if c in _MADE else F.col(c) for c in docs.columns))
