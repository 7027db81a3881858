"""Importance resampling, vector codes and token files against brute force, the tokenizers library and odd rows."""

import collections
import hashlib
import math
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from raterlake.llm import importance, tokenfiles, vectorcodes, words
from raterlake.llm.queries import WORD_VOCABULARY, op13_token_files
from raterlake.llm.shared import shared_folder
from tests.compare import SF

DOCS = "doc_id long, text string, lang string, weight string, rank string, _id long, code string"
PROSE = " ".join(f"word{k % 30}" for k in range(80))
TEXTS = [None, "", " \t\n.", PROSE, PROSE, PROSE.upper() + " tail", "a b", "x " * 30_000, "é世 ABC é世 abc", "q" * 100_000, "don't <|endoftext|> 12ⅷ\x00z", "one two three " * 9]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    data = [(k, t, None, "x", "y", 7, "z") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*data, data[3], (None, PROSE, None, None, None, None, None), (-4, "seven", "", "", "", 0, "")], DOCS)


def features(text, n):
    found = _WORD.findall((text or "").translate(_LOWER))
    return len(found), [" ".join(found[i : i + k]) for k in range(1, n + 1) for i in range(len(found) - k + 1)]


def drawn(docs, target, n, percent, least, buckets):
    """Brute force: sorted (doc_id, n_features, weight, score, rank), for docs as (doc_id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in docs for f in features(t, n)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x, n)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        n_words, made = features(text, n)
        weight = sum(gain(bucket(f)) for f in made)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(made), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n_words])
    enough = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize(("n", "percent", "buckets"), [(1, 10, 10_000), (3, 60, 50), (2, 100, 7)])
def test_draw_as_brute_force(spark, odd, n, percent, buckets):
    target = spark.createDataFrame([(1, "word1 WORD2 word3"), (2, None), (None, "abc é世 abc")], "item_id long, text string")
    out = importance.resample(odd, target, percent=percent, max_n=n, buckets=buckets)
    assert out.columns == ["doc_id", "lang", "_id", "code", "n_words", "n_features", "weight", "score", "rank"]
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()), key=str)
    assert got == drawn([(r.doc_id, r.text) for r in odd.collect()], [r.text for r in target.collect()], n, percent, 20, buckets)


def test_draw_of_the_whole_table(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    out = importance.resample(docs.repartition(7), target, max_n=2, keep=["doc_id"]).collect()
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out), key=str)
    assert got == drawn([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], 2, 10, 20, 10_000)
    assert any(r["rank"] == 1 for r in out)


def test_draw_of_empty_tables(spark, odd):
    assert importance.resample(odd.limit(0), odd).collect() == []
    got = importance.resample(odd, odd.limit(0), percent=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, 1 + sum(r.n_words >= 20 for r in got)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé世09 .A", max_size=40), min_size=1, max_size=6), st.integers(1, 4))
def test_crcs_of_runs(texts, n):
    coded = words.coded(pa.array(texts, pa.large_string()), words.LETTERS, lower=True)
    whole = [_WORD.findall(t.translate(_LOWER)) for t in texts]
    for k, (crcs, inside) in enumerate(importance.ngram_crcs(coded, n), 1):
        got = [crcs[a:b][inside[a:b]].tolist() for a, b in zip(coded.first, coded.first[1:], strict=False)]
        assert got == [[zlib.crc32(" ".join(w[i : i + k]).encode()) for i in range(len(w) - k + 1)] for w in whole]


def test_crcs_moved_far():
    lengths = np.array([0, 1, 5, 300, 70_000])
    got = importance.shifted(np.full(5, zlib.crc32(b"begin"), np.uint32), lengths) ^ [zlib.crc32(b"z" * n) for n in lengths]
    assert got.tolist() == [zlib.crc32(b"begin" + b"z" * n) for n in lengths]


# Vector codes.


def codes_of(rows, parts, entries, rounds):
    """Brute force over (id, vector of integers, label): {id and vector: (code, error, label_error, sha256)}."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in rows[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            held = collections.defaultdict(list)
            for _, v, _ in rows:
                held[near(cut(v, p), books[p])].append(cut(v, p))
            for k, m in held.items():
                books[p][k] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    sums, out = collections.Counter(), []
    for i, v, label in rows:
        k = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][k[p]]) for p in range(parts))
        sums[label] += error
        out.append((i, "".join(f"{x:02x}" for x in k), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], sha) for i, c, e, label in out), key=str)


NAN, INF = math.nan, math.inf
VECTORS = [(0, [0.5, -0.25, 1.0, 2.0], "a"), (1, [0.5, -0.25, 1.0, 2.0], None), (2, None, "a"), (3, [0.1, None, 0.2, 0.3], "a"), (4, [NAN, 0.0, 0.0, 0.0], "b"), (5, [-INF, 0.0, 0.0, 0.0], "b"), (6, [], "b"), (7, [1.0, 2.0], "b"), (8, [3e6, 0.0, 0.0, 0.0], "a"), (9, [-0.001, 0.001, 9.0, -9.0], "b"), (None, [1.5, 1.25, -1.0, 0.0], None), (9, [2.0, 2.0, 2.0, 2.0], "a"), (12, [1e5, -1e5, 0.0, 1e5], "c")]


@pytest.mark.parametrize(("entries", "rounds"), [(3, 2), (64, 1), (2, 5), (1, 0)])
def test_codes_of_odd_vectors(spark, entries, rounds):
    df = spark.createDataFrame([(*r, "kept", 5) for r in VECTORS], "vec_id long, embedding array<float>, label string, code string, extra int")
    out = vectorcodes.encode_vectors(df.repartition(3), parts=2, entries=entries, rounds=rounds)
    assert out.columns == ["vec_id", "label", "extra", "code", "error", "label_error", "codebooks_sha256"]
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in VECTORS if v and len(v) == 4 and all(x is not None and math.isfinite(x) and abs(x) < 2**20 for x in v)]
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out.collect()), key=str) == codes_of(good, 2, entries, rounds)


def test_codes_of_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<double>, label int")
    assert vectorcodes.encode_vectors(df).collect() == [] and vectorcodes.encode_vectors(df.limit(0)).collect() == []


def test_only_moved_parts_pass_on_sums():
    rng = np.random.default_rng(1)
    v = rng.integers(-500, 500, (200, 8))
    batch = pa.RecordBatch.from_pydict({"vec_id": list(range(200)), "_v": v.tolist()})
    books = v[:5].reshape(5, 2, 4).transpose(1, 0, 2).astype(np.int64)
    first, change = list(vectorcodes._round(iter([batch]), books, ["vec_id"]))
    sums = np.zeros((2, 5, 5), np.int64)
    for r in change.to_pylist():
        sums[r["part"], r["entry"], r["place"]] += r["change"]
    state = first.select(["vec_id", "_v", "_codes"])
    # The same codebooks again: nothing moves, so nothing is passed on.
    assert [b.num_rows for b in vectorcodes._round(iter([state]), books, ["vec_id"])] == [200]
    books = books + 40
    again, change = list(vectorcodes._round(iter([state]), books, ["vec_id"]))
    for r in change.to_pylist():
        sums[r["part"], r["entry"], r["place"]] += r["change"]
    codes = np.stack([np.frombuffer(x, np.uint16) for x in again.column("_codes").to_pylist()])
    for p in range(2):
        for k in range(5):
            mine = v.reshape(200, 2, 4)[codes[:, p] == k, p]
            assert sums[p, k].tolist() == [len(mine), *mine.sum(0).tolist()]
    moved = (codes != np.stack([np.frombuffer(x, np.uint16) for x in state.column("_codes").to_pylist()])).sum()
    assert 0 < moved < 400


# Token files.


def files_of(docs, end=1):
    """Brute force: [(doc_id, start, n_tokens, crc32)] in the order of the files, for docs as (doc_id, text) in that order."""
    library, at, out = Tokenizer.from_file(WORD_VOCABULARY), 0, []
    for i, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def as_rows(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4()}"


def test_files_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert as_rows(op13_token_files(spark, SF)) == files_of([(r.doc_id, r.text) for r in docs])


@pytest.mark.parametrize("frame", [1 << 18, 40])
def test_files_of_odd_rows(spark, odd, folder, monkeypatch, frame):
    monkeypatch.setattr(tokenfiles, "FRAME", frame)
    tokenfiles.write_tokens(odd.repartition(5), folder, WORD_VOCABULARY, 1, by_word=True)
    docs = sorted([(r.doc_id, r.text) for r in odd.collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    assert as_rows(tokenfiles.read_tokens(spark, folder)) == files_of(docs)
    ids = {r.doc_id: r.ids for r in tokenfiles.read_tokens(spark, folder, ids=[0, 6, -4, 99]).collect()}
    library = Tokenizer.from_file(WORD_VOCABULARY)
    assert ids == {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in ((0, ""), (6, "a b"), (-4, "seven"))}


def test_whole_texts_in_place_of_words(spark, odd, folder):
    tokenfiles.write_tokens(odd, folder, WORD_VOCABULARY, 1, by_word=False)
    docs = sorted([(r.doc_id, r.text) for r in odd.collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    assert as_rows(tokenfiles.read_tokens(spark, folder)) == files_of(docs)


def test_lookups_read_few_frames(spark, folder, monkeypatch):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat(concat('word ', id, ' '), 20) as text")
    tokenfiles.write_tokens(docs.repartition(4), folder, WORD_VOCABULARY, 1, by_word=True)
    path = tokenfiles.file_system(folder)[1]
    files = [f for f in tokenfiles.pafs.LocalFileSystem().get_file_info(tokenfiles.pafs.FileSelector(path)) if f.path.endswith(".zst")]
    with tokenfiles.pafs.LocalFileSystem().open_input_file(files[0].path) as file:
        places, entries = tokenfiles.read_index(file)
        got = [tokenfiles.read_frame(file, *p) for p in places.tolist()]
    assert [len(g[0]) for g in got] == entries["docs"].tolist() and [len(g[3]) for g in got] == entries["tokens"].tolist()
    assert [(g[0].min(), g[0].max()) for g in got] == list(zip(entries["first"], entries["last"], strict=True))
    assert sum(r.docs for r in spark.read.parquet(f"{folder}/index").collect()) == 2000


def test_damaged_and_orphaned_files(spark, folder):
    docs = spark.range(50).selectExpr("id as doc_id", "'some words' as text")
    tokenfiles.write_tokens(docs.repartition(2), folder, WORD_VOCABULARY, 1, by_word=True)
    system, path = tokenfiles.file_system(folder)
    name = spark.read.parquet(f"{folder}/index").first().file
    # A task that ran twice leaves a file that the index doesn't name.
    with open(f"{path}/{name}", "rb") as f:
        raw = f.read()
    with open(f"{path}/part-000000-again.zst", "wb") as f:
        f.write(raw)
    assert tokenfiles.read_tokens(spark, folder).count() == 50
    damaged = bytearray(raw)
    damaged[20] ^= 1
    with open(f"{path}/again", "wb") as f:
        f.write(damaged)
    with system.open_input_file(f"{path}/again") as file:
        places, _ = tokenfiles.read_index(file)
        with pytest.raises(Exception, match="damaged|[Dd]ecompress|corrupt|data"):
            tokenfiles.read_frame(file, *places[0].tolist())


def test_files_of_no_rows(spark, odd, folder):
    tokenfiles.write_tokens(odd.limit(0), folder, WORD_VOCABULARY, 1, by_word=True)
    assert tokenfiles.read_tokens(spark, folder).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_word_by_word_as_whole_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    whole = [Tokenizer.from_file(WORD_VOCABULARY).encode(t, add_special_tokens=False).ids for t in texts] if len(texts) < 2 else None
    coder = tokenfiles.coder(WORD_VOCABULARY, True)
    ids, sizes = coder.encode(pa.array(texts, pa.large_string()))
    want = whole or [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
