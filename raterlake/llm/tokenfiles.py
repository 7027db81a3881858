"""Token ids in compressed files that readers open at the documents they want.

A file is a series of independent zstandard frames and ends with a seek table, in the public seekable format of zstandard: a skippable frame with the
compressed size, the size and a checksum (the low 32 bits of XXH64 of the content) of each frame, then the number of frames and a magic number. The last
frame before it, skippable too, holds what each frame begins and ends with (ids of documents, counts), so a reader needs the end of a file and the
frames of its documents only. A frame holds whole documents: their number, ids, nulls among the ids, numbers of tokens, then the tokens (all little-endian).

Rows are range-partitioned by id and each task writes one file under a name of its own, frame by frame. What a file holds is a row of the index table, which
Spark commits: files of tasks that were lost or ran twice aren't in it and are never read. The folder must be one that executors share, by any path that
Arrow's file systems open.

Defined results: a null text counts as empty (the end token alone); null ids come first and are kept; rows of equal ids stand in the order of the
texts' hashes; an empty table makes an index without rows. A document over FRAME tokens is a frame by itself.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterlake.llm import text, words

#: Tokens of a frame, unless its last document holds more.
FRAME = 1 << 18
#: Bytes of texts encoded at a time, and distinct words whose ids a worker remembers.
BLOCK, CACHE = 1 << 22, 1 << 20
#: Words encoded at once.
LINE = 1000
#: Tokens that a task of the reader has to do with.
TASK = 16 * FRAME
#: Ids that one call of the reader looks up: they go to all tasks.
LOOKUPS = 100_000

# Fixed values of the seekable format.
_SKIPPABLE, _SEEK_TABLE, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_CHECKSUMS = 0x80

#: An entry of the documents' index: documents, tokens, first and last id, nulls among the ids.
_ENTRY = np.dtype([("docs", "<u8"), ("tokens", "<u8"), ("first", "<i8"), ("last", "<i8"), ("nulls", "<u8")])

#: Kinds of bytes between which a word-by-word tokenizer cuts: ASCII digits, letters, and what can't join a letter or digit. Apostrophes (of
#: contractions), signs that a combining mark may change and those of special tokens aren't among the last.
_KINDS = np.zeros(256, np.uint8)
_KINDS[48:58] = 1
_KINDS[65:91] = _KINDS[97:123] = 2
_KINDS[np.frombuffer(b"!\"#$%&()*+,-./:;?@[]^_`{}", np.uint8)] = 3

INDEX = "shard int, file string, docs long, tokens long, frames long, bytes long"


class Coder:
    """Ids of texts by the tokenizers library. by_word: the tokenizer drops white space, reads digits one by one and letters apart from other
    signs, and none of these in the light of another, so that each distinct run is encoded once."""

    def __init__(self, path: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab() if by_word and suffix else {}
        self.ends_word = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Adds the ids of words to the cache."""
        plain = [w for w in new if w.isalpha()]
        # Words of ASCII letters are single pieces, so they can be encoded many at once and told apart by the ids that end a word.
        lines = [b" ".join(plain[k : k + LINE]).decode() for k in range(0, len(plain), LINE)]
        ids = np.array([i for part in self._lists(lines) for i in part], "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1 if self.ends_word.any() else ids[:0]
        if len(ends) == len(plain):
            raw = ids.tobytes()
            for w, a, b in zip(plain, [0, *ends.tolist()], ends.tolist(), strict=False):
                self.cache[w] = raw[4 * a : 4 * b]
            new = [w for w in new if not w.isalpha()]
        for w, ids in zip(new, self._lists([w.decode() for w in new]), strict=True):
            self.cache[w] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (large strings without nulls) one after another, and how many each text has."""
        if not self.by_word:
            lists = self._lists(texts.to_pylist())
            return np.array([i for ids in lists for i in ids], "<u4"), np.array([len(x) for x in lists], np.int64)
        coded = words.coded(texts, words.NO_SPACE, kinds=_KINDS)
        distinct = coded.distinct.to_pylist()
        if len(self.cache) > CACHE:
            self.cache.clear()
        self._learn([w for w in distinct if w not in self.cache])
        found = [self.cache[w] for w in distinct]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        per_word = size[coded.codes]
        ids = flat[words.ragged(start[coded.codes], per_word)]
        ends = np.concatenate(([0], np.cumsum(per_word)))[coded.first]
        return ids, np.diff(ends)


_coders: dict[tuple[str, bool], Coder] = {}


def coder(path: str, by_word: bool) -> Coder:
    """One per Python worker and file."""
    if (path, by_word) not in _coders:
        _coders[path, by_word] = Coder(path, by_word)
    return _coders[path, by_word]


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a folder and its path there."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


class FrameWriter:
    """Writes frames to a stream and keeps what the tables at the end say of them."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.compress = stream, zstandard.ZstdCompressor(level=level).compress
        self.seek: list[tuple[int, int, int]] = []
        self.entries: list[tuple[int, int, int, int, int]] = []

    def add(self, ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> None:
        """One frame of whole documents."""
        content = b"".join([struct.pack("<Q", len(ids)), ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), sizes.astype("<u8").tobytes(), tokens.astype("<u4").tobytes()])
        packed = self.compress(content)
        self.stream.write(packed)
        self.seek.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        known = ids[~nulls]
        self.entries.append((len(ids), len(tokens), int(known.min(initial=2**63 - 1)), int(known.max(initial=-(2**63))), int(nulls.sum())))

    def close(self) -> tuple[int, int, int, int]:
        """Documents, tokens, frames and bytes of the file."""
        index = np.array(self.entries, _ENTRY).tobytes()
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(index)) + index)
        rows = [*self.seek, (8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = b"".join(struct.pack("<III", *row) for row in rows) + struct.pack("<IBI", len(rows), _CHECKSUMS, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SEEK_TABLE, len(table)) + table)
        return sum(e[0] for e in self.entries), sum(e[1] for e in self.entries), len(self.entries), sum(r[0] for r in rows) + 8 + len(table)


def read_index(file) -> tuple[np.ndarray, np.ndarray]:
    """Of a seekable file: offset, compressed size, size and checksum of each frame of documents (rows of four), and the documents' index."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE or not flags & _CHECKSUMS:
        raise ValueError("not a seekable file with checksums")
    file.seek(size - 9 - 12 * n)
    table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
    offsets = np.cumsum(table[:, 0]) - table[:, 0]
    file.seek(int(offsets[-1]))
    kind, length = struct.unpack("<II", file.read(8))
    if kind != _SKIPPABLE:
        raise ValueError("the index of documents is missing")
    entries = np.frombuffer(file.read(length), _ENTRY)
    return np.column_stack([offsets, table])[:-1], entries


def read_frame(file, offset: int, packed: int, size: int, checksum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, nulls, numbers of tokens and tokens of the documents of one frame; raises ValueError if the frame isn't what was written."""
    file.seek(offset)
    content = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=size)
    if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
        raise ValueError(f"the frame at byte {offset} is damaged")
    (n,) = struct.unpack_from("<Q", content)
    ids = np.frombuffer(content, "<i8", n, 8)
    nulls = np.frombuffer(content, np.uint8, n, 8 + 8 * n).astype(bool)
    sizes = np.frombuffer(content, "<u8", n, 8 + 9 * n).astype(np.int64)
    return ids, nulls, sizes, np.frombuffer(content, "<u4", int(sizes.sum()), 8 + 17 * n)


def _with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end token after each document."""
    return np.insert(ids, np.cumsum(sizes), end).astype("<u4"), sizes + 1


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, by_word: bool, end: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    code, shard = coder(path, by_word), TaskContext.get().partitionId()
    name, stream, writer = f"part-{shard:06d}-{uuid.uuid4().hex}.zst", None, None
    held: deque[tuple[np.ndarray, ...]] = deque()
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        writer.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        waiting = 0

    for batch in batches:
        if not batch.num_rows:
            continue
        if writer is None:
            system, base = file_system(folder)
            system.create_dir(base, recursive=True)
            stream = system.open_output_stream(f"{base}/{name}", compression=None)
            writer = FrameWriter(stream)
        ids = batch.column("_id")
        nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        texts = text.plain(batch.column("_text"))
        for a, b in text.blocks(texts, BLOCK):
            tokens, sizes = _with_end(*code.encode(texts.slice(a, b - a)), end)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            at = 0
            while at < b - a:
                # As many documents as fill the frame, and one at least.
                to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + FRAME - waiting, "right")) - 1), b - a)
                if waiting and waiting + ends[to] - ends[at] > FRAME:
                    flush()
                    continue
                held.append((ids[a + at : a + to], nulls[a + at : a + to], sizes[at:to], tokens[ends[at] : ends[to]]))
                waiting += int(ends[to] - ends[at])
                at = to
                if waiting >= FRAME:
                    flush()
    if writer is None:
        return
    if held:
        flush()
    docs, tokens, frames, size = writer.close()
    stream.close()
    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "docs": [docs], "tokens": [tokens], "frames": [frames], "bytes": [size]})


def write_tokens(docs: DataFrame, folder: str, path: str, end: int, by_word: bool = False, id_column: str = "doc_id", column: str = "text") -> None:
    """Writes the ids of each text, and ``end`` after them, to files in folder, in the order of the ids (integers), with the index table in folder/index."""
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(column).alias("_text"))
    order = [F.asc("_id"), F.xxhash64("_text").asc()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(lambda batches: _write(batches, folder, path, by_word, end), INDEX).write.parquet(f"{folder}/index")


FRAMES = "file string, frame int, offset long, packed long, size long, checksum long, before long, docs long, tokens long, first long, last long, nulls long"


def _frames(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, base = file_system(folder)
    for batch in batches:
        for row in batch.to_pylist():
            with system.open_input_file(f"{base}/{row['file']}") as file:
                places, entries = read_index(file)
            tokens = entries["tokens"].astype(np.int64)
            columns = [pa.array([row["file"]] * len(entries), pa.string()), pa.array(range(len(entries)), pa.int32()), *map(pa.array, places.T.copy())]
            columns += [pa.array(np.cumsum(tokens) - tokens + row["before"])] + [pa.array(entries[c].astype(np.int64)) for c in ("docs", "tokens", "first", "last", "nulls")]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FRAMES.split(", ")])


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """The frames of all files: where they stand, what they hold, and how many tokens stand before them in all files."""
    # A row for each file, so as many as tasks that wrote.
    files, before = spark.read.parquet(f"{folder}/index").orderBy("shard").collect(), 0
    rows = []
    for file in files:
        rows.append((file.file, before))
        before += file.tokens
    listed = spark.createDataFrame(rows, "file string, before long").repartition(max(len(rows), 1), "file")
    return listed.mapInArrow(lambda batches: _frames(batches, folder), FRAMES)


def _total(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/index").agg(F.sum("tokens")).first()[0] or 0


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    system, base = file_system(folder)
    for batch in batches:
        for row in batch.to_pylist():
            with system.open_input_file(f"{base}/{row['file']}") as file:
                ids, nulls, sizes, tokens = read_frame(file, row["offset"], row["packed"], row["size"], row["checksum"])
            ends = np.cumsum(sizes)
            sums = [zlib.crc32(tokens[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            columns = [pa.array(ids, mask=nulls), pa.array(ends - sizes + row["before"]), pa.array(sizes), pa.array(sums, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], ends))), pa.array(tokens.astype(np.int64))).cast(pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def read_tokens(spark: SparkSession, folder: str, ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 and with_ids the ids of every document, or of those in ids
    (LOOKUPS at most), of which only the frames that may hold one are read."""
    found = frames(spark, folder)
    if ids is not None:
        if len(ids) > LOOKUPS:
            raise ValueError(f"over {LOOKUPS} ids at once: read all documents and join")
        wanted = spark.createDataFrame([(i,) for i in ids], "_wanted long")
        found = found.join(F.broadcast(wanted), F.col("_wanted").between(F.col("first"), F.col("last")), "left_semi")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    # A row is small and its frame large, so their number, not the rows' bytes, says over how many tasks they are dealt.
    tasks = max(spark.sparkContext.defaultParallelism, _total(spark, folder) // TASK)
    out = found.repartition(tasks, "file", "frame").mapInArrow(lambda batches: _read(batches, folder, with_ids), T._parse_datatype_string(schema))
    return out if ids is None else out.join(F.broadcast(wanted), F.col("doc_id") == F.col("_wanted"), "left_semi")
