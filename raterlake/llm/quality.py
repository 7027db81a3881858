"""Quality rules from the frequency of lines across documents, in DataFrame functions only.

Lines are normalised (lower case, white space collapsed, ends trimmed) and hashed. For each host, the
distinct documents that hold a line are counted; lines in more than a share of them are removed (and in more
than ``FEW``, as fewer are no evidence), and a document is rejected when the lines left hold too small a part of its words.

Defined results: a null text counts as empty, a null host as the empty host. Rows with the same host and
text count as one document, so exact copies don't make their own lines frequent; each row still gets its
own result. Lines without a word are never counted or removed. A document without words isn't depleted
(the base rules judge it). Every line is counted over all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SALTS = 16
#: Documents that a frequent line must exceed on a host of any size.
FEW = 5


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def let(value: Column, then) -> Column:
    """then(value), with the value computed once.

    The body of a lambda function is evaluated expression by expression. In generated code, so many array functions in one
    row make a method too large for the JVM to compile, which then runs some fifty times slower.
    """
    return F.transform(F.array(value), then)[0]


def _covered_words(hashes: Column) -> Column:
    """Words in the three-word windows whose hash occurs twice; hashes: of the windows in order."""

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    def neighbours(windows: Column) -> Column:
        same = lambda x, j: F.coalesce(x["h"] == F.get(windows, j)["h"], F.lit(False))
        return F.transform(F.filter(windows, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])

    places = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def of_twice(twice: Column) -> Column:
        few = F.transform(F.filter(places, lambda x: F.array_contains(twice, x["h"])), lambda x: x["i"])
        # With many repeated windows, equal ones are found as neighbours of a sorted list instead.
        many = let(F.sort_array(places), neighbours)
        return F.when(F.size(twice) == 0, F.lit(0)).when(F.size(twice) <= 64, covered(few)).otherwise(covered(many))

    doubles = let(F.sort_array(hashes), lambda x: F.array_distinct(F.filter(x, lambda h, i: F.coalesce(h == F.get(x, i + 1), F.lit(False)))))
    return let(doubles, of_twice)


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) to each row."""
    t = F.coalesce(F.col(text), F.lit(""))

    def of_words(w: Column) -> Column:
        first = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        hashes = F.transform(first, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
            let(hashes, _covered_words).cast("long").alias("n_repeat_words"),
        )

    words = let(word_list(t), of_words)
    doubled = let(F.filter(F.split(t, "\n"), _has_word), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return docs.withColumn("_x", words).select(
        *docs.columns,
        "_x.n_words",
        "_x.word_chars",
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        doubled.cast("long").alias("n_dup_lines"),
        "_x.n_repeat_words",
    )


def _distinct_lines(text: Column) -> Column:
    """Hash and words of each distinct normalised line that has a word."""
    lines = F.filter(F.split(text, "\n"), _has_word)
    return let(F.transform(lines, normal_line), lambda x: F.transform(F.array_distinct(x), lambda y: F.struct(F.xxhash64(y).alias("line"), F.size(word_list(y)).cast("long").alias("n"))))


def frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", min_docs: int = FEW, host_share: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Lines over the limit (_host, _line, n_docs), and each document's distinct lines (_host, _line, _n, _doc, _salt).

    The limit of a host is the larger of ``min_docs`` and ``host_share`` of its distinct documents.
    """
    h, t = F.coalesce(F.col(host), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    # Both uses group by the same columns, so that Spark makes this exchange once.
    lines = (
        docs.select(h.alias("_host"), F.xxhash64(h, t).alias("_doc"), F.explode(_distinct_lines(t)).alias("_x"))
        .select("_host", F.col("_x.line").alias("_line"), F.col("_x.n").alias("_n"), "_doc", F.col("_doc").bitwiseAND(SALTS - 1).alias("_salt"))
        .distinct()
    )
    hosts = docs.select(h.alias("_host"), F.xxhash64(h, t).alias("_doc")).distinct().groupBy("_host").agg(F.count("*").alias("_docs"))
    counts = lines.groupBy("_host", "_line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    return counts.join(hosts, "_host").filter(F.col("n_docs") > F.col("_docs") * host_share).select("_host", "_line", "n_docs"), lines


def line_verdicts(docs: DataFrame, host: str = "source", text: str = "text", min_docs: int = FEW, host_share: float = 0.05) -> DataFrame:
    """Per distinct document that loses lines: _doc, _removed (their hashes), _removed_words (each line counts once)."""
    over, lines = frequent_lines(docs, host, text, min_docs, host_share)
    # A line may stand in a third of all documents: its rows are dealt over salts.
    salted = over.select("_host", "_line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("_salt"))
    hits = lines.join(salted, ["_host", "_line", "_salt"])
    return hits.groupBy("_doc").agg(F.collect_list("_line").alias("_removed"), F.sum("_n").alias("_removed_words"))


MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "removed_words", "depleted", "kept", "removed")


def _judged(docs: DataFrame, host: str, text: str, min_docs: int, host_share: float, max_removed: float) -> DataFrame:
    rows = docs.drop(*MADE, "_doc", "_all", "_x", "_removed", "_removed_words")
    h, t = F.coalesce(F.col(host), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    all_words = let(_distinct_lines(t), lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, y: n + y["n"]))
    stats = base_stats(rows.withColumn("_doc", F.xxhash64(h, t)).withColumn("_all", all_words), text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        stats.withColumn("base_failed", failed)
        .join(line_verdicts(docs, host, text, min_docs, host_share), "_doc", "left")
        .withColumn("removed", F.coalesce("_removed", F.array().cast("array<bigint>")))
        .withColumn("n_removed_lines", F.size("removed").cast("long"))
        .withColumn("removed_words", F.coalesce("_removed_words", F.lit(0)).cast("long"))
        .withColumn("depleted", F.col("removed_words") > F.col("_all") * max_removed)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .drop("_doc", "_all", "_removed", "_removed_words")
    )


def judge(docs: DataFrame, host: str = "source", text: str = "text", min_docs: int = FEW, host_share: float = 0.05, max_removed: float = 0.5) -> DataFrame:
    """Statistics and verdict of each row: the columns of docs without the text, and those in MADE.

    A document is depleted when the lines over the limit hold more than ``max_removed`` of the words of its distinct
    lines. Columns of docs that clash with MADE are dropped.
    """
    return _judged(docs, host, text, min_docs, host_share, max_removed).drop(text)


def clean(docs: DataFrame, host: str = "source", text: str = "text", min_docs: int = FEW, host_share: float = 0.05, max_removed: float = 0.5) -> DataFrame:
    """The documents that the rules keep, without the lines over the limit; the columns of docs, n_chars for the new text."""
    safe = docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in MADE})
    kept = _judged(safe, host, text, min_docs, host_share, max_removed).filter("kept")
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: ~(_has_word(x) & F.array_contains("removed", line_hash(x))))
    cut = F.col("n_removed_lines") > 0
    out = kept.withColumn(text, F.when(cut, F.array_join(lines, "\n")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"_own_{c}").alias(c) if c in MADE else F.col(c) for c in docs.columns))
