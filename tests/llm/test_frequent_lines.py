"""The verdict by frequent lines where it acts: on the given tables by SQL, and on planted hosts by counting in plain Python."""

import collections
import re

import duckdb

from raterlake.llm import quality
from raterlake.llm.queries import QUERIES, SQL
from tests.compare import duck, rows

LARGER = "/root/testdata/sf0.01"


def test_lines_go_on_the_given_tables(spark):
    got = QUERIES["op3_quality_rules"](spark, LARGER).toPandas()
    assert rows(got) == rows(duck(LARGER).execute(SQL["op3_quality_rules"]).df())
    assert (got.n_removed_lines > 0).sum() > 50


def planted():
    """A host of notices, whose documents hold little else; one that repeats a line in 5 of its 20 documents, which is no evidence; and one whose copies are one document."""
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    notice = "\n".join(f"this notice number {j} stands on every page of the host " + words(j, 12) for j in range(4))
    out = [(k, "thin.example", f"{notice}\nown {words(k, 40)}") for k in range(30)]
    out += [(100 + k, "thin.example", f"{notice.upper()}\nlonger {words(100 + k, 120)}") for k in range(30)]
    out += [(200 + k, "few.example", ("a line in five documents here\n" if k < 5 else "") + words(200 + k, 60)) for k in range(20)]
    out += [(300 + k, "copies.example", "same line again\n" + words(300, 60)) for k in range(40)]
    return out


def brute(docs):
    """doc_id: (lines removed, their words, kept) by plain counting."""
    norm = lambda line: re.sub(r"[ \t-\r]+", " ", line).strip(" ").lower()
    held, every = collections.defaultdict(set), collections.defaultdict(set)
    for _, host, text in docs:
        every[host].add(text)
        for line in text.split("\n"):
            held[host, norm(line)].add(text)
    out = {}
    for i, host, text in docs:
        lines = {norm(x) for x in text.split("\n") if x.strip()}
        over = {x for x in lines if len(held[host, x]) > 5 and len(held[host, x]) > 0.05 * len(every[host])}
        gone, whole = sum(len(x.split()) for x in over), sum(len(x.split()) for x in lines)
        out[i] = (len(over), gone, gone <= 0.5 * whole)
    return out


def test_a_depleted_host(spark):
    docs = planted()
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = {r.doc_id: (r.n_removed_lines, r.removed_words, r.kept) for r in quality.judge(df).collect()}
    want = brute(docs)
    assert got == want
    assert not any(want[k][2] for k in range(30)) and all(want[100 + k] == (4, 92, True) for k in range(30))
    assert all(want[k] == (0, 0, True) for k in [*range(200, 220), *range(300, 340)])
    con = duckdb.connect()
    con.register("frame", df.toPandas())
    con.execute("CREATE VIEW documents AS SELECT * FROM frame")
    by_sql = con.execute(SQL["op3_quality_rules"]).df()
    assert {r.doc_id: (r.n_removed_lines, r.removed_words, r.kept) for r in by_sql.itertuples()} == want
    assert {r.doc_id for r in quality.clean(df).collect()} == {i for i, x in want.items() if x[2]}
