"""Documents drawn by how much likelier their hashed n-grams are in a target than in the whole corpus.

A feature is a run of 1 to ``max_n`` words, joined by one space, and falls into the bucket crc32 % buckets. A bucket's gain is
floor(1000 ln ((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) for s of S features of the corpus and t of T of the target; a document's
weight is the sum over its features, and its score the weight plus Gumbel noise of its id, so that the highest scores are a draw
without replacement by exp(weight / 1000).

CRCs form an algebra: crc(AB) is crc(A) times the matrix over GF(2) that moves it by len(B) bytes, plus (xor) crc(B). So each distinct word of a
block of texts is hashed once; CRCs of longer runs come from those of its words by matrices of powers of two, kept as tables by byte, and no
text of an n-gram is ever made.

Two scans count (partial counts by task, at most ``buckets`` rows each) and one weighs. The ``buckets`` gains are the only thing that the driver holds;
their number is a parameter. Ranks come from a range partitioning by score and id: places within a partition plus
the sizes of those before, so no task sorts more than its range.

Defined results: a null text counts as empty (no feature, weight 0); rows are kept whatever their id, and a null id counts as an empty one in the
noise; equal rows are each drawn or not, in any order among themselves; an empty target or corpus gives gains from the smoothing alone. Columns
of the input that clash with made ones aren't kept.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterlake.llm import text, words
from raterlake.llm.shared import stored

#: The polynomial of crc32, bits reversed.
POLYNOMIAL = 0xEDB88320
#: Bytes of texts worked on at a time.
BLOCK = 1 << 22
_powers: list[np.ndarray] = []


def _apply(matrix: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), as its products with each value of each byte (4 x 256), times CRCs."""
    return matrix[0][crcs & 255] ^ matrix[1][crcs >> 8 & 255] ^ matrix[2][crcs >> 16 & 255] ^ matrix[3][crcs >> 24]


def _power(k: int) -> np.ndarray:
    """The matrix that moves a CRC by 2^k bytes."""
    if not _powers:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = step >> 1 ^ np.uint32(POLYNOMIAL) * (step & 1)
        # A zero byte drops the lowest byte, whose table entry is added.
        _powers.append(np.stack([step, *(np.arange(256, dtype=np.uint32) << 8 * (b - 1) for b in (1, 2, 3))]).astype(np.uint32))
    while len(_powers) <= k:
        _powers.append(np.stack([_apply(_powers[-1], row) for row in _powers[-1]]))
    return _powers[k]


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved by so many bytes each: crc(AB) = shifted(crc(A), len(B)) ^ crc(B)."""
    out = crcs.astype(np.uint32, copy=True)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        some = np.flatnonzero(lengths >> k & 1)
        if len(some):
            out[some] = _apply(_power(k), out[some])
    return out


def ngram_crcs(coded: words.Coded, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: crc32 of the run of n words from each word, and whether the run ends within its text."""
    distinct = np.fromiter((zlib.crc32(w) for w in coded.distinct.to_pylist()), np.uint32, len(coded.distinct))
    crcs, n_words = distinct[coded.codes], len(coded.codes)
    yield crcs, np.ones(n_words, bool)
    if max_n == 1:
        return
    size = np.diff(np.frombuffer(coded.distinct.buffers()[1], np.int64)[: len(coded.distinct) + 1]) if len(coded.distinct) else np.zeros(0, np.int64)
    spaced = shifted(np.full(len(distinct), zlib.crc32(b" "), np.uint32), size) ^ distinct
    sizes, added = (size + 1)[coded.codes], spaced[coded.codes]
    left = np.repeat(coded.first[1:], np.diff(coded.first)) - np.arange(n_words)
    for n in range(2, max_n + 1):
        ahead = np.minimum(np.arange(n_words) + n - 1, max(n_words - 1, 0))
        crcs = shifted(crcs, sizes[ahead]) ^ added[ahead]
        yield crcs, left >= n


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, words.Coded]]:
    for batch in batches:
        texts = text.plain(batch.column(column))
        for a, b in text.blocks(texts, BLOCK):
            yield batch.slice(a, b - a), words.coded(texts.slice(a, b - a), words.LETTERS, lower=True)


def _counts(batches: Iterator[pa.RecordBatch], column: str, max_n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for _, coded in _blocks(batches, column):
        for crcs, whole in ngram_crcs(coded, max_n):
            total += np.bincount(crcs[whole] % np.uint32(buckets), minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])


def _weights(batches: Iterator[pa.RecordBatch], column: str, keep: list[str], max_n: int, gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, coded in _blocks(batches, column):
        n_features, weight = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
        for crcs, whole in ngram_crcs(coded, max_n):
            gain = np.where(whole, gains[crcs % np.uint32(len(gains))], 0)
            for out, values in ((n_features, whole), (weight, gain)):
                sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
                out += sums[coded.first[1:]] - sums[coded.first[:-1]]
        made = [pa.array(x, pa.int64()) for x in (np.diff(coded.first), n_features, weight)]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], [*keep, "n_words", "n_features", "weight"])


def bucket_counts(docs: DataFrame, column: str = "text", max_n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    rows = docs.select(column).mapInArrow(lambda batches: _counts(batches, column, max_n, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    one = lambda s, t: math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
    return np.array([one(float(s), float(t)) for s, t in zip(source, target, strict=True)], np.int64)


def weigh(docs: DataFrame, target: DataFrame, keep: list[str], column: str = "text", max_n: int = 2, buckets: int = 10_000) -> DataFrame:
    """The columns in keep with n_words, n_features and weight of each row."""
    gains = gains_of(bucket_counts(docs, column, max_n, buckets), bucket_counts(target, column, max_n, buckets))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    return docs.select(*dict.fromkeys([*keep, column])).mapInArrow(lambda batches: _weights(batches, column, keep, max_n, gains), schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, max_n: int = 2, buckets: int = 10_000, seed: int = 2024, id_column: str = "doc_id", column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all but the text by default) with n_words, n_features, weight, score and rank: 1, 2, ... of the percent % of rows with min_words
    words or more that have the highest scores (smaller ids first among equals), null of the others."""
    made = {"n_words", "n_features", "weight", "score", "rank", "_at"}
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in made and c != column]
    keep = keep if id_column in keep else [id_column, *keep]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = stored(weigh(docs, target, keep, column, max_n, buckets).withColumn("score", F.col("weight") + noise))
    order = [F.desc("score"), F.asc(id_column)]
    enough = F.col("n_words") >= min_words
    # monotonically_increasing_id is the partition's number, shifted by 33 bits, plus the row's place in it.
    ranged = stored(scored.filter(enough).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, before, offsets = F.shiftright("_at", 33), 0, []
    for row in sorted(ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((row.part, before))
        before += row.n
    drawn = percent * before // 100
    sizes = docs.sparkSession.createDataFrame(offsets, "_part int, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    ranked = ranged.join(F.broadcast(sizes), part.cast("int") == F.col("_part")).withColumn("rank", F.when(rank <= drawn, rank)).drop("_at", "_part", "_before")
    return ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))
