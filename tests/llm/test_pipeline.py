"""The pipeline against a brute-force version of all its stages, on texts made for each stage, and its stages on odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import tokenizers

import corpus_pipeline
from raterlake.llm.queries import VOCABULARY

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _fixture(seed=11):
    rng = np.random.default_rng(seed)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    lines = lambda n, k=9: [" ".join(words(k)) for _ in range(n)]
    boiler = " ".join(words(8))
    items = [(k, " ".join(words(24))) for k in range(4)]
    docs, run = [], lines(4)
    for k in range(60):
        body = lines(12)
        if k % 4 == 0:
            body.insert(3, boiler.upper() if k % 8 else f"  {boiler} ")
        if k % 9 == 1:
            body[5:5] = run[: 3 + k % 2]
        docs.append((k, "\n".join(body), f"host{k % 3}"))
    docs += [(100, "too short", "host0"), (101, None, "host1"), (102, "", None), (103, "again and again " * 40, "host2")]
    # Near copies, a chain of them, and exact copies.
    # Their lines are broken elsewhere, else line dedup would take them.
    for a, b, width in ((200, 2, 7), (201, 200, 11), (202, 6, 8)):
        base = WORD.findall(next(t for k, t, _ in docs if k == b))
        base[int(rng.integers(0, len(base)))] = "edited"
        docs.append((a, "\n".join(" ".join(base[i : i + width]) for i in range(0, len(base), width)), "host1"))
    docs.append((203, docs[7][1], "host1"))
    # Items of the benchmark, whole, edited within the limit, and edited too much.
    for k, edits in ((0, 0), (1, 4), (2, 9), (3, 3)):
        item = items[k][1].split()
        for place in rng.choice(24, edits, replace=False):
            item[place] = f"edit{place}"
        docs.append((300 + k, "\n".join([*lines(6), " ".join(item), *lines(6)]), "host2"))
    return docs, items


def _norm(line):
    return " ".join(WORD.findall(line)).lower()


def _quality(docs):
    size, held = Counter(), Counter()
    for host, text in {(h or "", t or "") for _, t, h in docs}:
        size[host] += 1
        held.update((host, x) for x in {_norm(y) for y in text.split("\n")} - {""})
    over = {k for k, n in held.items() if n > 5 and n > 0.05 * size[k[0]]}
    for k, text, host in docs:
        ws, each = WORD.findall(text or ""), {_norm(y): len(WORD.findall(y)) for y in (text or "").split("\n") if WORD.search(y)}
        triples = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        twice = {x for x, n in Counter(triples).items() if n > 1}
        repeated = len({i + j for i, x in enumerate(triples) if x in twice for j in range(3)})
        gone = {x for x in each if (host or "", x) in over}
        if len(ws) < 50 or 100 * repeated > 50 * len(ws) or sum(each[x] for x in gone) > 0.5 * sum(each.values()):
            continue
        yield k, "\n".join(x for x in text.split("\n") if _norm(x) not in gone) if gone else text, host


def _line_dedup(docs):
    seen, out = set(), []
    for k, text, host in sorted(docs):
        lines = text.split("\n")
        worded = [i for i, x in enumerate(lines) if WORD.search(x)]
        runs = [tuple(_norm(lines[i]) for i in worded[a : a + 3]) for a in range(len(worded) - 2)]
        gone = set()
        for a, x in enumerate(runs):
            if x in seen:
                gone.update(worded[a : a + 3])
            seen.add(x)
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or WORD.search(left):
            out.append((k, left, host))
    return out


def _near_duplicates(docs):
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := WORD.findall(t.lower())) else set() for k, t, _ in docs}
    root = {k: k for k in sets}
    find = lambda k: k if root[k] == k else find(root[k])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [d for d in docs if find(d[0]) == d[0]]


def _holds(text, item):
    """Whether some part of the text is within a fifth of the item's words in edits: the plain dynamic program."""
    bare = lambda t: [re.sub(r"[!-/:-@\[-`{-~]", "", w).lower() for w in WORD.findall(t)]
    row = [0] * (len(bare(text)) + 1)
    want, have = bare(item), bare(text)
    for i, x in enumerate(want):
        new = [i + 1]
        for j, y in enumerate(have):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row) <= int(0.2 * len(want) + 1e-9)


def _brute(docs, items):
    docs = _near_duplicates(_line_dedup(list(_quality(docs))))
    return [d for d in docs if not any(_holds(d[1], t) for _, t in items)]


def test_run_against_brute_force(spark, tmp_path):
    docs, items = _fixture()
    folder = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = _brute(docs, items)
    assert {2, 6} <= {k for k, *_ in kept} and not {100, 101, 103, 200, 201, 202, 203, 300, 301, 303} & {k for k, *_ in kept} and 302 in {k for k, *_ in kept}
    lib = tokenizers.Tokenizer.from_file(VOCABULARY)
    lib.no_truncation(), lib.no_padding()
    want = {}
    for k, text, _ in kept:
        ids = lib.encode(text, add_special_tokens=False).ids
        want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()} == want


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, tmp_path, name, stage):
    """Null ids, texts and sources, empty texts, repeated rows, and columns with the names that stages make."""
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, "an item of five words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    prose = " ".join(f"w{k}" for k in range(80))
    data = [(None, prose, "s", 1, "x"), (1, None, None, None, None), (2, "", "s", 0, "y"), (3, prose, None, 5, None), (3, prose, None, 5, None), (4, "here is an item of five words " + prose, "s", 2, "z")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long, removed string")
    out = stage(spark, docs, folder)
    kept = out.collect()
    assert stage(spark, docs.limit(0), folder).collect() == []
    if name != "tokens":
        assert out.columns == docs.columns
    sizes = {"quality_rules": 4, "line_dedup": 6, "near_duplicates": 3, "decontamination": 5, "tokens": 6}
    assert len(kept) == sizes[name]
