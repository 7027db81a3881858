"""Cases of the review: places where an operator once did less than the whole job."""

from collections import Counter

import numpy as np

from raterlake.llm import passages, quality
from raterlake.llm.queries import SQL
from tests.compare import duck, rows


def _small_hosts():
    """Hosts of 20, 60 and 4 documents: a line in 8 of the first, in 4 and in 2 of the second, and in all of the third."""
    line = "subscribe to our letter and read more of it every single week"
    prose = lambda k, n: "\n".join(" ".join(f"w{k}x{i}x{j}" for j in range(10)) for i in range(n))
    docs = [(k, "a", prose(k, 6) + f"\n {line.upper()} " * (k < 8)) for k in range(20)]
    docs += [(100 + k, "b", prose(100 + k, 6) + f"\n{line} b" * (k < 4) + f"\n{line} c" * (k < 2)) for k in range(60)]
    docs += [(200 + k, "c", prose(200 + k, 6) + f"\n{line}") for k in range(4)]
    # Of these, the frequent lines are more than half of the words.
    long = [f"{line} {'and so on ' * 20}{k}" for k in range(4)]
    return docs + [(300 + k, "a", "\n".join([*long, prose(300 + k, 2)])) for k in range(8)]


def test_quality_rules_remove_lines_on_small_hosts(spark):
    docs = _small_hosts()
    held, size = Counter((h, x) for _, h, t in docs for x in {" ".join(y.lower().split()) for y in t.split("\n")}), Counter(h for _, h, _ in docs)
    over = {k for k, n in held.items() if n > quality.FEW and n > 0.05 * size[k[0]]}
    assert len(over) == 5
    want, left = {}, {}
    for k, h, t in docs:
        lines = {" ".join(y.lower().split()) for y in t.split("\n")}
        gone = {x for x in lines if (h, x) in over}
        want[k] = (len(gone), sum(len(x.split()) for x in gone))
        left[k] = "\n".join(x for x in t.split("\n") if " ".join(x.lower().split()) not in gone)
    table = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in quality.judge(table).collect()}
    assert {k: (r.n_removed_lines, r.removed_words) for k, r in got.items()} == want
    assert {k for k, r in got.items() if r.depleted} == set(range(300, 308))
    assert all(r.text == left[r.doc_id] for r in quality.clean(table).collect())
    con = duck()
    con.register("docs", table.toPandas())
    con.execute("CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM docs")
    sql = con.execute(SQL["op3_quality_rules"].replace("n > 100", f"n > {quality.FEW}")).df()
    assert rows(quality.judge(table).select(*sql.columns).toPandas()) == rows(sql)


def _longest(one, two):
    """Start (in one) and words of the longest run of words that both hold."""
    best, row = (0, 0), [0] * (len(two) + 1)
    for i, x in enumerate(one):
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(two)]
        n = max(row)
        best = max(best, (n, i + 1 - n))
    return best[1], best[0]


def test_passages_beside_frequent_lines(spark):
    """Pairs share 60 words, 40 of which are a line of hundreds of texts; families share an edited passage that holds the line too."""
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1_000_000, n)]
    line = words(40)
    texts = {k: words(60) + line + words(60) for k in range(300)}
    pairs = []
    for k in range(40):
        before = k % 21
        passage = words(before) + line + words(20 - before)
        pairs.append((1000 + 2 * k, 1001 + 2 * k))
        for one in pairs[-1]:
            texts[one] = words(60) + passage + words(60)
    families = []
    for k in range(6):
        passage = words(60) + line + words(60)
        families.append([2000 + 10 * k + j for j in range(5)])
        for one in families[-1]:
            edited = list(passage)
            edited[int(rng.integers(0, 60))] = "edited"
            texts[one] = words(40) + edited + words(40)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    found = passages.shared_passages(docs).collect()
    brute = {(a, b): _longest(texts[a], texts[b]) for x, y in pairs for a, b in ((x, y), (y, x))}
    got = {(r.doc_id, r.other_id): (r.start, r.end - r.start) for r in found}
    assert all(n >= 60 for _, n in brute.values())
    assert {k for k, v in brute.items() if got.get(k) != v} == set()
    assert {r.doc_id for r in found} == {k for x in (*pairs, *families) for k in x}
    for family in families:
        assert all(any(r.doc_id == k and r.other_id in family and r.end - r.start >= 90 for r in found) for k in family)
