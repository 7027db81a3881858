"""License scans: MinHash bands over overlapping windows of the text retrieve templates, shingle containment verifies.

Words are compared without case and ASCII punctuation; a template's set is its five-word shingles (the whole sequence if it has
fewer words). All templates stand in one table of MinHash bands, ``BANDS`` of ``ROWS`` values each. Windows of a few sizes (powers of
``STEP``, each template belongs to the next one above its own) overlap over the text; those that hold too few shingles of any template to
reach the containment are left out, which loses none, and the bands of the others look templates up in the table. A window that
holds 0.8 of a template's shingles and is at most ``STEP`` times as long has a Jaccard similarity s of 0.55 or more with it, and is
retrieved with 1 - (1 - s**ROWS)**BANDS: at least 0.997, and there are several such windows.

Verification is exact: of all windows of the template's own size that begin at one of its shingles (others hold no more of it), the
one that holds the largest share of its shingles, at least ``containment``, is the match (the first, among equals).

Templates are fixed and few, so the table goes along with the code. Rows are independent: no shuffle. Defined results: null or
empty texts match nothing; each template gives at most one row for a row of docs; where a template lies over another of at least half its
size that fits better, it isn't given (so a long licence stays beside the short notice in it); templates without a word are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from raterlake.llm import text as words_of
from raterlake.llm.decontam import word_hashes
from raterlake.llm.license_texts import TEMPLATES

BANDS, ROWS, SHINGLE, STEP = 16, 2, 5, 1.25
_SEEDS = np.random.default_rng(8).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def _bands(shingles: np.ndarray, windows: dict[int, np.ndarray]) -> np.ndarray:
    """Keys of all bands of windows: places where they begin, by size; windows are cut at the text's end."""
    widest, n = max(windows), len(shingles)
    keys = {size: np.arange(BANDS, dtype=np.uint64)[:, None] + np.zeros(len(starts), np.uint64) for size, starts in windows.items()}
    for k, seed in enumerate(_SEEDS):
        # Minima of 1, 2, 4, ... neighbours; those of a window are the two that cover it.
        least, span = np.concatenate((words_of.mix(shingles ^ seed), np.full(widest, ~np.uint64(0)))), 1
        for size, starts in sorted(windows.items()):
            while span * 2 <= size:
                least[:-span] = np.minimum(least[:-span], least[span:])
                span *= 2
            keys[size][k // ROWS] = words_of.mix(keys[size][k // ROWS] ^ np.minimum(least[starts], least[np.minimum(starts + size - span, n + widest - 1)]))
    return np.concatenate([x.ravel() for x in keys.values()])


def window_size(n: int) -> int:
    """The least of 1, 2, 3, ... grown by STEP that is n or more."""
    size = 1
    while size < n:
        size = max(size + 1, int(size * STEP))
    return size


class Templates:
    """The templates' shingles, and one table of their bands."""

    def __init__(self, texts: dict[str, str], containment: float):
        w = word_hashes(pa.array(list(texts.values()), pa.large_string()))
        self.names, self.sets, self.sizes, self.kinds = [], [], [], []
        bands = []
        for k, name in enumerate(texts):
            own = w.hash[w.of(k)]
            if not len(own):
                continue
            kind = min(SHINGLE, len(own))
            shingles = words_of.runs(own, kind)
            self.names.append(name)
            self.sets.append(np.unique(shingles))
            self.sizes.append(len(shingles))
            self.kinds.append(kind)
            bands.append(_bands(shingles, {len(shingles): np.zeros(1, np.int64)}))
        keys = np.concatenate([*bands, np.zeros(0, np.uint64)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.of = keys[order], np.repeat(np.arange(len(bands)), BANDS)[order]
        #: The shingles that each template needs.
        self.least = [int(np.ceil(containment * len(x) - 1e-9)) for x in self.sets]
        self.known = {kind: np.unique(np.concatenate([x for x, y in zip(self.sets, self.kinds, strict=True) if y == kind])) for kind in set(self.kinds)}
        self.windows: dict[int, dict[int, int]] = {kind: {} for kind in self.known}
        for size, kind, least in zip(self.sizes, self.kinds, self.least, strict=True):
            of = self.windows[kind]
            of[window_size(size)] = min(least, of.get(window_size(size), least))
        self.maybe = {}
        for kind, values in self.known.items():
            self.maybe[kind] = np.zeros(1 << 16, bool)
            self.maybe[kind][values & np.uint64(0xFFFF)] = True

    def scan(self, w: words_of.Words) -> Iterator[tuple[int, str, int, int, float]]:
        """Text, name, first word, last word (exclusive), containment."""
        by_text: dict[int, list[tuple[int, int, int, float]]] = {}
        for kind, known in self.known.items():
            shingles = words_of.runs(w.hash, kind)
            hit = np.flatnonzero(self.maybe[kind][shingles & np.uint64(0xFFFF)])
            hit = hit[np.isin(shingles[hit], known)]
            text = np.searchsorted(w.first, hit, "right") - 1
            whole = hit + kind <= w.first[text + 1]
            hit, text = hit[whole], text[whole]
            cuts = np.flatnonzero(np.diff(text)) + 1
            for hits in np.split(hit, cuts) if len(hit) else []:
                k = int(np.searchsorted(w.first, hits[0], "right")) - 1
                lo = int(w.first[k])
                own = shingles[lo : int(w.first[k + 1]) - kind + 1]
                for t in self.retrieved(own, hits - lo, kind):
                    if match := self.best(own, hits - lo, t):
                        by_text.setdefault(k, []).append((t, match[0], match[0] + min(self.sizes[t], len(own) - match[0]) + kind - 1, match[1]))
        for k, found in sorted(by_text.items()):
            for t, a, b, share in sorted(found):
                if not any(a < y and x < b and other > share and 2 * self.sizes[u] >= self.sizes[t] for u, x, y, other in found):
                    yield k, self.names[t], a, b, share

    def retrieved(self, shingles: np.ndarray, hits: np.ndarray, kind: int) -> list[int]:
        """Templates of which some window that begins at a hit shares a band."""
        windows = {size: hits[np.searchsorted(hits, hits + size) - np.arange(len(hits)) >= least] for size, least in self.windows[kind].items()}
        windows = {size: starts for size, starts in windows.items() if len(starts)}
        if not windows:
            return []
        first = min(int(x[0]) for x in windows.values())
        last = max(int(x[-1]) + size for size, x in windows.items())
        keys = np.unique(_bands(shingles[first:last], {size: starts - first for size, starts in windows.items()}))
        lo, hi = (np.searchsorted(self.keys, keys, side) for side in ("left", "right"))
        found = {t for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True) for t in self.of[a:b].tolist()}
        return sorted(t for t in found if self.kinds[t] == kind)

    def best(self, shingles: np.ndarray, hits: np.ndarray, t: int) -> tuple[int, float] | None:
        """Start and share of the window of the template's size that holds most of its shingles, if enough."""
        own, size = self.sets[t], self.sizes[t]
        mine = hits[np.isin(shingles[hits], own)]
        values = shingles[mine].tolist()
        # The number of different values between the starts, moved on from one to the next.
        held: dict[int, int] = {}
        stop, most, at = 0, 0, -1
        for k, start in enumerate(mine.tolist()):
            while stop < len(mine) and mine[stop] < start + size:
                held[values[stop]] = held.get(values[stop], 0) + 1
                stop += 1
            if len(held) > most:
                most, at = len(held), start
            if held[values[k]] == 1:
                del held[values[k]]
            else:
                held[values[k]] -= 1
        return (at, most / len(own)) if most >= self.least[t] else None


_made: dict[tuple, Templates] = {}


def _scan(batches: Iterator[pa.RecordBatch], texts: dict[str, str], id_col: str, text: str, containment: float) -> Iterator[pa.RecordBatch]:
    key = (containment, *texts.items())
    templates = _made[key] = _made.get(key) or Templates(texts, containment)
    for batch in batches:
        column, rows = words_of.plain(batch.column(text)), []
        for a, b in words_of.blocks(column):
            rows += [(a + k, *x) for k, *x in templates.scan(word_hashes(column.slice(a, b - a)))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
        arrays = [pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(id_col).take(arrays[0]), *arrays[1:]], [id_col, "license", "start", "end", "containment"])


def find_licenses(docs: DataFrame, texts: dict[str, str] | None = None, id_col: str = "doc_id", text: str = "text", containment: float = 0.8) -> DataFrame:
    """One row for each row of docs and template that its text holds: id_col, license, start and end (words), containment."""
    texts = TEMPLATES if texts is None else texts
    schema = T.StructType([docs.schema[id_col], T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("containment", T.DoubleType())])
    return docs.select(id_col, text).mapInArrow(lambda b: _scan(b, texts, id_col, text, containment), schema)
