"""Finds benchmark items in documents by CGK embedding and bit-sampling LSH, with exact verification by edit distance.

The random walk of Chakraborty, Goldenberg and Koucky copies the word it stands on and moves on or stays by a random bit
of that word and step; two texts at a small edit distance then agree in most steps, so edit distance becomes Hamming
distance. Bit-sampling repeats: each of some repetitions samples a few steps of one of some walks, and a window whose
sample equals an item's is a candidate.

A walk over a whole item-sized window loses its way at the first edits: with a fifth of the words edited, 32 samples of four steps
find 0.6 to 0.8 of items of 20 words and 0.06 to 0.5 of 100 words. So windows of items of ``SHORT`` words or more are walked in
pieces of ``STEPS`` steps, from each offset of the item and from every second word of a document: an edited item keeps several
unedited pieces. Shorter items have no room for that; for each of their sizes, windows of exactly that size begin at every word, and are
sampled more often with fewer steps. Tests measure the recall for 5 to 100 words. Candidates are verified exactly: the
least edit distance in words between the item and any part of the text around the window (Myers' bit-parallel search) may be
at most ``1 - similarity`` of the item's words.

Words are compared without case and ASCII punctuation. Defined results: null or empty texts match nothing, items without
a word are ignored, ids have any type and may be null, rows that share a doc_id are searched one by one and each gives its own rows. Items go out in blocks of bounded
size (BLOCK_WORDS), so what is broadcast doesn't grow with the benchmark; texts are searched whole, in place, without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterlake.llm import text as words_of

#: Steps of a walk, walks, repetitions, sampled steps, and words between windows: of items of SHORT words or more, and of shorter ones.
SHORT = 12
STEPS = 12
LONG_PLAN, SHORT_PLAN = (2, 8, 4, 2), (6, 36, 2, 1)
#: Words of the items that one pass over the documents looks for.
BLOCK_WORDS = 200_000
#: Bytes of text whose words are found at a time: they take many times as much.
TEXT = 1 << 18

_KEEP = np.ones(256, bool)
_KEEP[[b for b in range(33, 127) if not chr(b).isalnum()]] = False
_random = np.random.default_rng(71)
_SALT = _random.integers(1, 2**63, (SHORT_PLAN[0], STEPS), dtype=np.uint64)
_FACTOR = _random.integers(1, 2**62, LONG_PLAN[2], dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sampled_steps(size: int) -> list[np.ndarray]:
    """The steps that each repetition samples, for items of so many words (0: of SHORT or more): fixed choices."""
    _, repeats, sample, _ = SHORT_PLAN if size else LONG_PLAN
    random = np.random.default_rng([71, size])
    # A walk over a short window stands at its end after about twice as many steps as it has words.
    steps = max(sample, min(STEPS, 2 * size - 1)) if size else STEPS
    return [np.sort(random.choice(steps, sample, replace=False)) for _ in range(repeats)]


def word_hashes(column: pa.Array) -> words_of.Words:
    return words_of.words(column, lower=True, keep=_KEEP)


def embed(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, walk: int) -> np.ndarray:
    """STEPS x windows: the walk from each start; past a window's end it copies zeros."""
    padded = np.concatenate((hashes, np.zeros(1, np.uint64)))
    bits = words_of.mix(padded ^ _SALT[walk, 0])
    at, out = starts.copy(), np.empty((STEPS, len(starts)), np.uint64)
    for step in range(STEPS):
        here = np.where(at < ends, at, len(hashes))
        out[step] = padded[here]
        at = at + ((bits[here] >> np.uint64(step * 5)) & np.uint64(1)).astype(at.dtype)
    return out


def sample_keys(embedded: np.ndarray, steps: np.ndarray, repeat: int) -> np.ndarray:
    total = np.full(embedded.shape[1], np.uint64(repeat + 1))
    for k, place in enumerate(steps):
        total += embedded[place] * _FACTOR[k]
    return words_of.mix(total)


class Table:
    """Keys of some items of one size (0: of SHORT words or more) in order, with their item and offset."""

    def __init__(self, items: dict[int, np.ndarray], size: int):
        self.size, self.steps = size, sampled_steps(size)
        self.walks, self.repeats, _, self.stride = SHORT_PLAN if size else LONG_PLAN
        keys, places = [], []
        for n, own in items.items():
            starts = np.arange(len(own), dtype=np.int64)
            # An offset too near the end would sample padding only; a short item is one window.
            starts = starts[:1] if size else starts[: len(own) - STEPS // 2 + 1]
            different = len(np.unique(own))
            for walk in range(self.walks):
                e = embed(own, starts, np.full(len(starts), len(own)), walk)
                for r in range(walk, self.repeats, self.walks):
                    # Samples of one or two words are no evidence, as common words make them everywhere, if the item has more.
                    sampled = np.sort(e[self.steps[r]], axis=0)
                    told = (sampled[1:] != sampled[:-1]).sum(0) >= min(1 if size else 2, different - 1)
                    keys.append(sample_keys(e, self.steps[r], r)[told])
                    places.append(np.stack((np.full(told.sum(), n), starts[told])))
        self.keys, self.places = np.concatenate(keys), np.concatenate(places, 1)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.places = self.keys[order], self.places[:, order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys & np.uint64(0xFFFFF)] = True

    def candidates(self, w: words_of.Words) -> Iterator[np.ndarray]:
        """Rows of text, item, and where the item's first word would stand in the text."""
        texts = len(w.first) - 1
        sizes = -(-np.diff(w.first) // self.stride)
        text_of = np.repeat(np.arange(texts), sizes)
        starts = w.first[:-1][text_of] + self.stride * (np.arange(len(text_of)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        ends = w.first[1:][text_of]
        if self.size:
            ends = np.minimum(ends, starts + self.size)
        for walk in range(self.walks):
            embedded = embed(w.hash, starts, ends, walk)
            for r in range(walk, self.repeats, self.walks):
                keys = sample_keys(embedded, self.steps[r], r)
                hit = np.flatnonzero(self.maybe[keys & np.uint64(0xFFFFF)])
                lo, hi = (np.searchsorted(self.keys, keys[hit], side) for side in ("left", "right"))
                n = hi - lo
                of = np.repeat(np.arange(len(hit)), n)
                item, offset = self.places[:, np.repeat(lo, n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]
                window = hit[of]
                yield np.unique(np.stack((text_of[window], item, starts[window] - w.first[text_of[window]] - offset), 1), axis=0)


class Index:
    """LSH tables of some items, by size."""

    def __init__(self, ids: list, texts: list[str], similarity: float):
        w = word_hashes(pa.array(texts, pa.large_string()))
        self.ids, self.words, self.most = [], [], []
        by_size: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
        for k, item in enumerate(ids):
            own = w.hash[w.of(k)]
            if not len(own):
                continue
            by_size[len(own) if len(own) < SHORT else 0][len(self.ids)] = own
            self.ids.append(item)
            self.words.append(own.tolist())
            self.most.append(int((1 - similarity) * len(own) + 1e-9))
        self.tables = [Table(items, size) for size, items in sorted(by_size.items())]
        self.masks = [_masks(x) for x in self.words]
        self.back_masks = [_masks(x[::-1]) for x in self.words]

    def candidates(self, w: words_of.Words) -> np.ndarray:
        """Rows of text, item, and where the item's first word would stand in the text; in order, without repeats."""
        found = [x for table in self.tables for x in table.candidates(w)]
        return np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0)

    def matches(self, w: words_of.Words) -> Iterator[tuple[int, int, int, int, int]]:
        """Text, item id, first word, last word (exclusive), distance: the best place of each item that each text holds."""
        rows = self.candidates(w)
        if not len(rows):
            return
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
        for group in np.split(rows, cuts):
            text, k, places = int(group[0, 0]), int(group[0, 1]), group[:, 2].tolist()
            hashes = w.hash[w.of(text)]
            size, most, masks, best = len(self.words[k]), self.most[k], self.masks[k], None
            at = 0
            while at < len(places):
                # Overlapping places are searched together.
                lo, hi = places[at] - most - 1, places[at] + size + most + 1
                while at + 1 < len(places) and places[at + 1] - most - 1 <= hi:
                    at += 1
                    hi = places[at] + size + most + 1
                at += 1
                lo, hi = max(0, lo), min(len(hashes), hi)
                part = hashes[lo:hi].tolist()
                # The words that no edit touches are all there.
                if sum(x in masks for x in part) < size - most:
                    continue
                distance, end = search(masks, size, part)
                if distance <= most and (best is None or distance < best[2]):
                    back, length = search(self.back_masks[k], size, part[:end][::-1])
                    best = (lo + end - length, lo + end, distance)
            if best:
                yield text, self.ids[k], *best


def _masks(pattern: list[int]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for k, x in enumerate(pattern):
        out[x] |= 1 << k
    return dict(out)


def search(masks: dict[int, int], size: int, text: list[int]) -> tuple[int, int]:
    """The least edit distance between the pattern and any part of the text, and the first place where such a part ends."""
    every, last = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best, end = every, 0, size, size, 0
    for k, x in enumerate(text):
        eq = masks.get(x, 0)
        xv = eq | minus
        xh = ((((eq & plus) + plus) ^ plus) | eq) & every
        ph = minus | (every & ~(xh | plus))
        mh = plus & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = (ph << 1) & every
        mh = (mh << 1) & every
        plus = mh | (every & ~(xv | ph))
        minus = ph & xv
        if score < best:
            best, end = score, k + 1
    return best, end


def _search_batches(batches: Iterator[pa.RecordBatch], index, id_col: str, text: str, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    look = index.value
    for batch in batches:
        column, ids = words_of.plain(batch.column(text)), batch.column(id_col)
        rows: list[tuple] = []
        for a, b in words_of.blocks(column, TEXT):
            rows += [(a + m[0], *m[1:]) for m in look.matches(word_hashes(column.slice(a, b - a)))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type), *(pa.array(c, pa.int64()) for c in cols[2:])],
            [id_col, "item_id", "start", "end", "distance"],
        )


def _indexes(items: DataFrame, item_col: str, item_text: str, similarity: float) -> Iterator:
    """Broadcast indexes of the items, each of about BLOCK_WORDS words."""
    items = items.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull())
    n_words = items.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    blocks = -(-n_words // BLOCK_WORDS) or 1
    for k in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        yield items.sparkSession.sparkContext.broadcast(Index([r.i for r in some], [r.t for r in some], similarity))


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row for each document and item that it holds: id_col, item_id, start and end (words), distance."""
    item_type = items.select(item_col).limit(0).toArrow().schema.field(0).type
    schema = T.StructType([docs.schema[id_col], T.StructField("item_id", items.schema[item_col].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "end", "distance"))])
    out = None
    for index in _indexes(items, item_col, item_text, similarity):
        found = docs.select(id_col, text).mapInArrow(lambda b, index=index: _search_batches(b, index, id_col, text, item_type), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _keep_batches(batches: Iterator[pa.RecordBatch], index, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = words_of.plain(batch.column(text))
        keep = np.ones(batch.num_rows, bool)
        for a, b in words_of.blocks(column, TEXT):
            for text_of, *_ in index.value.matches(word_hashes(column.slice(a, b - a))):
                keep[a + text_of] = False
        yield batch.filter(pa.array(keep))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of docs whose text holds no item, with the columns of docs."""
    for index in _indexes(items, item_col, item_text, similarity):
        docs = docs.mapInArrow(lambda b, index=index: _keep_batches(b, index, text), docs.schema)
    return docs
