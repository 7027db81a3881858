"""The methods of the operators against brute force: compact windows, recall of searches, trees of templates, the field, linear scans."""

import itertools
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from raterlake.llm import decontam, licenses, linededup, passages, pii, secrets, urlfilter
from raterlake.llm import text as words_of
from raterlake.llm.shared import dealt, whole_groups


def _edited(rng, words, n, kind):
    words = list(words)
    for _ in range(n):
        i = int(rng.integers(0, len(words)))
        if kind == "sub":
            words[i] = f"e{rng.integers(0, 10**6)}"
        elif kind == "ins":
            words.insert(i, f"e{rng.integers(0, 10**6)}")
        else:
            words.pop(i)
    return words


def test_compact_windows_against_the_tree():
    rng = np.random.default_rng(0)

    def tree(values, first, width):
        for k in range(len(first) - 1):
            stack = [(first[k], first[k + 1] - 1)]
            while stack:
                lo, hi = stack.pop()
                if hi - lo + 1 >= width:
                    c = lo + int(values[lo : hi + 1].argmin())
                    yield lo, c, hi
                    stack += [(lo, c - 1), (c + 1, hi)]

    for t in range(200):
        n = int(rng.integers(0, 300))
        first = np.concatenate(([0], np.sort(rng.integers(0, n + 1, int(rng.integers(0, 6)))), [n]))
        values = rng.integers(0, 2**63, n, dtype=np.uint64) if t % 2 else rng.integers(0, 20, n).astype(np.uint64) << np.uint64(58)
        width = int(rng.integers(1, 50))
        got = zip(*(x.tolist() for x in passages.compact_windows(values, first, width)), strict=True)
        assert sorted(got) == sorted(tree(values, first, width))


def test_whole_groups_are_not_cut():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.sort(rng.integers(0, 5, int(rng.integers(0, 40))))
        parts = np.split(a, np.sort(rng.integers(0, len(a) + 1, 4)))
        out = [x.column("a").to_pylist() for x in whole_groups(iter([pa.RecordBatch.from_arrays([pa.array(p)], ["a"]) for p in parts]), ["a"])]
        assert sum(out, []) == a.tolist() and all(set(p).isdisjoint(q) for p, q in itertools.combinations(out, 2))


def test_dealt_joins_lose_nothing(spark):
    rows = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(20_000)], "key long, x long")
    counts = rows.groupBy("key").count().withColumnRenamed("count", "n")
    left, right = dealt(rows, counts, ["key"], "n", rows["x"])
    assert left.join(right, ["key", "_salt"]).count() == 20_000
    assert left.filter("key = 1").select("_salt").distinct().count() > 1


def test_passages_of_partial_copies(spark):
    """Two documents share 160 words, and 25 others hold 55 of them each: all are found, with edits in half of the groups."""
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1_000_000, n)]
    docs, whole, parts = [], [], []
    for g in range(8):
        passage = words(160)
        for k in range(2):
            own = _edited(rng, passage, 4, "sub") if g % 2 and k else passage
            whole.append(100 * g + k)
            docs.append((whole[-1], " ".join(words(50) + own + words(50))))
        for k in range(25):
            at = int(rng.integers(0, 105))
            parts.append(100 * g + 2 + k)
            docs.append((parts[-1], " ".join(words(50) + passage[at : at + 55] + words(50))))
    docs.append((9999, " ".join(words(400))))
    found = passages.shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert 9999 not in {r.doc_id for r in found} and all(r.doc_id // 100 == r.other_id // 100 for r in found)
    # A part may be reported with another part that shares at least 50 words of it.
    assert sum(any(r.doc_id == k and r.start < 60 and r.end - r.start >= 50 for r in found) for k in parts) >= 0.99 * len(parts)
    # Unedited copies are found whole; of edited ones (0.77 alike as a whole) a part that is 0.8 alike.
    for k in whole:
        own = [r for r in found if r.doc_id == k and r.other_id == k ^ 1]
        assert any((r.start, r.end) == (50, 210) for r in own) if k // 100 % 2 == 0 else any(r.end - r.start >= 80 for r in own)


@pytest.mark.parametrize("n", [1, 2, 5, 6, 10, 12, 20, 40, 100])
def test_decontamination_recall_by_length(n):
    """Items of each length with as many edits as allowed, against the whole edit search of every text."""
    rng = np.random.default_rng(n)
    items = [[f"t{x}" for x in rng.integers(0, 3000, n)] for _ in range(40)]
    index = decontam.Index(list(range(40)), [" ".join(x) for x in items], 0.8)
    for kind in ("sub", "ins", "del"):
        texts = [" ".join([f"u{x}" for x in rng.integers(0, 3000, 37)] + _edited(rng, x, int(0.2 * n), kind) + [f"u{x}" for x in rng.integers(0, 3000, 30)]) for x in items]
        w = decontam.word_hashes(pa.array(texts, pa.large_string()))
        truth = {(t, i) for t in range(40) for i in range(40) if decontam.search(index.masks[i], n, w.hash[w.of(t)].tolist())[0] <= index.most[i]}
        found = {(t, i) for t, i, *_ in index.matches(w)}
        assert found <= truth and len(found) >= 0.9 * len(truth)


def test_decontamination_of_few_words_and_other_ids(spark):
    items = spark.createDataFrame([("a", "yes no " * 10), (None, "na " * 8), ("c", "")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "well yes no " * 1 + "yes no " * 10), (2, "na " * 9), (3, "yes maybe")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_items(docs, items).collect()} == {(1, "a"), (2, None)}


def test_licenses_against_every_window():
    """Templates between other words, with edits: those that some window holds are retrieved, and the best window is the exact one."""
    rng = np.random.default_rng(1)
    templates = licenses.Templates(licenses.TEMPLATES, 0.8)
    missed = total = 0
    for _ in range(6):
        texts = []
        for t in licenses.TEMPLATES.values():
            w = t.split()
            for _ in range(int(rng.integers(0, 2 + len(w) // 25)) if len(w) > 8 else 0):
                w = _edited(rng, w, 1, ("sub", "ins", "del")[int(rng.integers(0, 3))])
            texts.append(" ".join([f"u{x}" for x in rng.integers(0, 99, 20)] + w + [f"v{x}" for x in rng.integers(0, 99, 20)]))
        words = decontam.word_hashes(pa.array(texts, pa.large_string()))
        for k in range(len(texts)):
            own = words.hash[words.of(k)]
            for t, size in enumerate(templates.sizes):
                shingles, wanted = words_of.runs(own, templates.kinds[t]), set(templates.sets[t].tolist())
                best = max(len(wanted & set(shingles[s : s + size].tolist())) / len(wanted) for s in range(len(shingles)))
                if best < 0.8:
                    continue
                hits = np.flatnonzero(np.isin(shingles, templates.known[templates.kinds[t]]))
                total += 1
                missed += t not in templates.retrieved(shingles, hits, templates.kinds[t])
                assert abs(templates.best(shingles, hits, t)[1] - best) < 1e-9
    assert total > 100 and missed <= 0.01 * total


def test_a_long_license_stays_beside_the_notice_in_it(spark):
    text = licenses.TEMPLATES["Apache-2.0"].replace("may obtain", "may get")
    found = licenses.find_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {r.license for r in found} >= {"Apache-2.0"}


def _templates(urls, max_children=10, min_share=0.1):
    """The tree in plain Python: (host, path) -> template."""
    n = Counter((h, p) for h, p, _ in urls)
    rest = {k: (k[1].split("/")[1:], "") for k in n}
    out, level = {}, 0
    while rest:
        out |= {k: t for k, (s, t) in rest.items() if len(s) <= level}
        there = {k: x for k, x in rest.items() if len(x[0]) > level}
        nodes, open_ = defaultdict(Counter), Counter()
        for k, (s, t) in there.items():
            nodes[k[0], t][s[level]] += n[k]
            open_[k[0], t] += 1
        rest = {}
        for k, (s, t) in there.items():
            parent = nodes[k[0], t]
            if open_[k[0], t] == 1:
                rest[k] = (s[: level + 1], t + "/" + "/".join(s[level:]))
            else:
                literal = len(parent) <= max_children or parent[s[level]] >= min_share * sum(parent.values())
                rest[k] = (s, f"{t}/{s[level] if literal else '*'}")
        level += 1
    return out


def _rejected(urls, of, weight=10.0, reject=0.7):
    branches = {}
    for h, p, bad in urls:
        b = branches.setdefault((h, of[h, p]), [0, set(), 0, 0])
        b[0] += 1
        b[1].add(p)
        b[2] += bad is not None
        b[3] += bool(bad)
    shape = lambda t: "/".join(x if x in ("*", "") else "?" for x in t.split("/"))
    shares = defaultdict(lambda: [0, 0, 0, 0])
    for (h, t), b in branches.items():
        for i, x in enumerate((len(b[1]), b[0], b[3], b[2])):
            shares[h, shape(t)][i] += x
    close = lambda x, p, n: abs(x - p) <= 3 * math.sqrt(p * (1 - p) / n) + 1 / n
    group = {}
    for (h, t), b in branches.items():
        paths, n, bad, labelled = shares[h, shape(t)]
        near = close(len(b[1]) / b[0], paths / n, b[0]) and (not b[2] or close(b[3] / b[2], bad / labelled, b[2]))
        group[h, t] = (h, shape(t)) if near else (h, "=" + t)
    sums = defaultdict(lambda: [0, 0, 0])
    for k, b in branches.items():
        for i, x in enumerate((b[0], b[2], b[3])):
            sums[group[k]][i] += x
    overall = sum(b[3] for b in branches.values()) / max(sum(b[2] for b in branches.values()), 1)
    return {k for k, g in group.items() if 2 * sums[g][1] >= sums[g][0] and (sums[g][2] + weight * overall) / (sums[g][1] + weight) >= reject}


def test_url_tree_against_plain_python(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(1500):
        host, kind = f"h{rng.integers(0, 3)}.org", ("shop", "user", "a/b/c/good", "a/b/c/bad", "news")[int(rng.integers(0, 5))]
        path = f"/{kind}/{rng.integers(0, 60)}" + ("/x" if k % 7 == 0 else "")
        bad = None if rng.random() < 0.2 else kind.endswith("bad") or rng.random() < 0.05
        rows.append((k, f"http://{host}{path}", bad))
    rows += [(2000, None, None), (2001, "no scheme", True)]
    table = spark.createDataFrame(rows, "page_id long, url string, label boolean")
    got = {r.page_id: r for r in urlfilter.judge_urls(table, [], labels="label").collect()}
    split = lambda u: ("", "") if not u or "://" not in u else (u[7:].split("/")[0], u[7 + len(u[7:].split("/")[0]) :])
    urls = [(*split(u), bad) for _, u, bad in rows]
    of = _templates(urls)
    bad = _rejected(urls, of)
    assert any(t.startswith("/a/b/c/bad") for _, t in bad) and not any("good" in t for _, t in bad)
    for (k, _, _), (h, p, _) in zip(rows, urls, strict=True):
        assert (got[k].host, got[k].path, got[k].template) == (h, p, of[h, p])
        assert got[k].verdict == ("block" if (h, of[h, p]) in bad else "allow")


def test_beliefs_of_a_chain_are_exact():
    rng = np.random.default_rng(4)
    nodes, couplings = rng.normal(size=(4, 5)), (0.7, 1.3)
    chain, skip = [(0, 1), (1, 2)], [(2, 3)]
    exact = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        p = math.exp(sum(nodes[k, v] for k, v in enumerate(y)) + sum(c * (y[a] == y[b]) for edges, c in ((chain, 0.7), (skip, 1.3)) for a, b in edges))
        for k, v in enumerate(y):
            exact[k, v] += p
    assert np.abs(pii.infer(nodes, chain, skip, couplings) - exact / exact.sum(1, keepdims=True)).max() < 1e-2


def test_repeats_in_other_forms_are_added(spark):
    plain = [f"call +1 (663) 555-{k:04d} or mail u{k}@x.org from 10.0.0.{k % 250}, card 4111 1111 1111 1111, order {k} of 12.5" for k in range(60)]
    more = ["+1 (663) 555-6869 again (663) 555-6869 and 6635556869 or 555-6869. not 5556870", "4111 1111 1111 1111 or 4111.1111.1111.1111."]
    found = {r.k: r.spans for r in pii.find_pii(spark.createDataFrame(list(enumerate([*plain, *more])), "k long, text string")).collect()}
    got = [{(s.split(":")[0], more[k - 60][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in found[k].split(",")} for k in (60, 61)]
    assert got[0] == {("phone", x) for x in ("+1 (663) 555-6869", "(663) 555-6869", "6635556869", "555-6869")}
    assert got[1] == {("card", "4111 1111 1111 1111"), ("card", "4111.1111.1111.1111")}
    assert all(found[k].count(":") == 8 for k in range(60))


def test_scans_are_linear_on_long_runs():
    long = ["1" * 1_000_000, "a" * 1_000_000 + "@b.c", "@" * 300_000, "a@" * 300_000, "1." * 300_000 + " a@b.c", "+" + "1 " * 300_000]
    began = time.time()
    for t in long:
        pii.base_spans(t)
    for t in ["eyJ" * 300_000, "password" * 100_000, "-----BEGIN " * 100_000, "token " + " " * 500_000]:
        for kind, *_ in secrets.RULES:
            secrets.rule_spans(kind, t)
    assert time.time() - began < 30


def test_all_secret_rules_against_their_expressions():
    rng = np.random.default_rng(5)
    parts = ["ghp_" + "a1" * 18, "xoxb-1234567890ab", "AIza" + "b" * 35, "sk_live_" + "c" * 16, "eyJ" + "d" * 12 + ".eyJ" + "e" * 12 + "." + "f" * 12, "-----BEGIN RSA PRIVATE KEY-----", "eyJ", ".", " ", "token=abcdefgh1", "AKIA" + "Q" * 16, "0a" * 20, "words"]
    texts = ["".join(parts[i] + " " * int(rng.integers(0, 2)) for i in rng.integers(0, len(parts), 12)) for _ in range(300)]
    scanned = secrets.scan_block(words_of.plain(pa.array(texts)))
    for t, found in zip(texts, scanned, strict=True):
        want = [(kind, *m.span()) for kind, e, group, least in secrets.RULES for m in re.finditer(e, t) if len(m[group]) >= least]
        assert sorted(found) == sorted(want)


def test_winnowing_selects_fewer_lines_than_windows(spark):
    text = "\n".join(f"line {k} of many" for k in range(300))
    docs = spark.createDataFrame([(k, text + f"\nown {k}") for k in range(3)], "doc_id long, text string")
    assert linededup.fingerprints(docs).count() < 0.8 * 3 * 299
    out = {r.doc_id: (r.n_removed, r.runs) for r in linededup.dedup_lines(docs).collect()}
    assert out == {0: (0, []), 1: (300, ["0:299"]), 2: (300, ["0:299"])}
