"""Byte-level BPE encoding and decoding with the vocabulary file of a public tokenizer.

A text is split at the special tokens, then into pieces (an optional space with letters, digits or other characters; white
space). For a piece, a contiguous array holds the boundaries of its parts and, beside each, the rank of merging the part
with its right neighbour. The array is scanned for the smallest rank, that boundary is deleted, and only the ranks of
the two neighbours are looked up again, until no neighbours merge. Pieces are short, so the scan is cheap, and a bounded
cache keeps the ids of pieces seen before.

Rows are independent: no shuffle, and a lost task is simply run again. Defined results: a null text counts as empty (no
ids, empty decoded text); texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces kept by each Python worker.
CACHE = 600_000
_NONE = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _classes() -> tuple[str, str]:
    """Character classes of letters and of numbers as ranges for ``re``, which has none by category."""
    out = []
    for kind in "LN":
        ranges: list[list[int]] = []
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == kind:
                if ranges and ranges[-1][1] == c - 1:
                    ranges[-1][1] = c
                else:
                    ranges.append([c, c])
        out.append("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges))
    return out[0], out[1]


class Encoder:
    """Encodes and decodes with the vocabulary and merges of a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.id_of = {raw(t): i for t, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        # Of each pair of ids (the left one shifted by 20 bits) the rank of its merge, shifted likewise, with the merged id.
        self.rank = {self.id_of[raw(a)] << 20 | self.id_of[raw(b)]: k << 20 | self.id_of[raw(a + b)] for k, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (1 + max([*self.id_of.values(), *self.special.values()]))
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        letter, number = _classes()
        space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.pieces = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        self.at_space = re.compile(rf" (?=[^{space}])").split
        self.wide = re.compile(rf" (?:[{space}]|\Z)").search
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        get, ids = self.rank.get, [self.byte_ids[b] for b in piece]
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            k = ranks.index(least)
            ids[k] = new = least & 0xFFFFF
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get(new << 20 | ids[k + 1], _NONE)
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | new, _NONE)
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for a piece of any length: equal ranks are merged from the left, with a heap in place of the scan."""
        rank, ids = self.rank, [self.byte_ids[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], k, p) for k, p in enumerate(a << 20 | b for a, b in zip(ids, ids[1:])) if p in rank]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            least, k, pair = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n or ids[k] << 20 | ids[j] != pair:
                continue
            ids[k], ids[j] = least & 0xFFFFF, -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (ids[a] << 20 | ids[b]) in rank:
                    heapq.heappush(heap, (rank[ids[a] << 20 | ids[b]], a, ids[a] << 20 | ids[b]))
        return [i for i in ids if i >= 0]

    def _put(self, part: str, ids: bytes) -> bytes:
        if len(part) <= 48:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[part] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        return self._put(piece, np.array(self.merge(raw) if len(raw) <= 200 else self._merge_long(raw), "<u4").tobytes())

    def _part(self, part: str) -> bytes:
        pieces = self.pieces(part)
        if len(pieces) == 1:
            return self._piece(part)
        ids = b"".join([self.cache.get(x) or self._piece(x) for x in pieces])
        return ids if "\n" in part else self._put(part, ids)

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        # A space before other than white space always begins a piece, so the text falls apart there.
        first, *parts = self.at_space(text) if self.wide(text) else text.split(" ")
        get, part_ids = self.cache.get, self._part
        return part_ids(first) + b"".join([get(x) or part_ids(x) for x in [" " + x for x in parts]])

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit integers; special tokens in the text become their id."""
        if self.split_special and any(s in text for s in self.special):
            raw = b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x) for x in self.split_special(text) if x)
        else:
            raw = self._plain(text) if text else b""
        return np.frombuffer(raw, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _rows(batches: Iterator[pa.RecordBatch], path: str, text: str, keep: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            counts, id_sums, text_sums, lists, texts = [], [], [], [], []
            for value in part.column(text):
                ids = coder.encode(value.as_py() or "")
                back = coder.decode(ids)
                counts.append(len(ids))
                id_sums.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sums.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    lists.append(ids.astype(np.int32))
                    texts.append(back)
            columns = [part.column(c) for c in keep] + [pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)


def tokenize(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """For each row: the columns in keep (all but the text by default), n_tokens, ids_sha256, decoded_sha256, and with_ids
    also ids and decoded. path: the vocabulary file, at the same place on every executor. Clashing columns aren't kept."""
    made = {"n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"}
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in made and c != text]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    return docs.select(*keep, text).mapInArrow(lambda batches: _rows(batches, path, text, keep, with_ids), schema)
