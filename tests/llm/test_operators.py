"""The operators of raterlake.llm against SQL, brute force, libraries and odd rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from raterlake.llm import bpe, decontam, jaccard, licenses, linededup, passages, pii, quality, secrets, urlfilter
from raterlake.llm.queries import QUERIES, SQL, URL_RULES, VOCABULARY
from tests.compare import SF, duck, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, _text string, component_id long"
PROSE = " ".join(f"word{k}" for k in range(80))
TEXTS = [None, "", " \t\n", PROSE, PROSE, PROSE + " tail", "a b", "x " * 30_000, "line one here\nline two here\nline three here\n" * 2, "mail a@b.com 10.0.0.1 +49 151 2345 6789", "q" * 100_000, "é世 password = hunter22xyz"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns that clash with made ones."""
    data = [(k, t, None, "s" if k % 2 else None, None, 1, "x", "y", 7) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*data, data[3], (None, PROSE, None, None, None, None, None, None, None)], SCHEMA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck().execute(SQL[name]).df())


OPERATORS = {
    "pii": lambda d, s: pii.find_pii(d),
    "line dedup": lambda d, s: linededup.dedup_lines(d),
    "line dedup, clean": lambda d, s: linededup.clean(d),
    "quality": lambda d, s: quality.judge(d),
    "quality, clean": lambda d, s: quality.clean(d),
    "bpe": lambda d, s: bpe.tokenize(d, VOCABULARY),
    "secrets": lambda d, s: secrets.find_secrets(d),
    "jaccard": lambda d, s: jaccard.link_components(d),
    "jaccard, keep one": lambda d, s: jaccard.keep_one(d),
    "passages": lambda d, s: passages.shared_passages(d),
    "licenses": lambda d, s: licenses.find_licenses(d),
    "urls": lambda d, s: urlfilter.judge_urls(d.withColumn("url", F.concat(F.lit("http://A.com/"), "text")), URL_RULES),
    "decontamination": lambda d, s: decontam.find_items(d, s.createDataFrame([(1, "some words of an item"), (2, None), (None, "x")], "item_id long, text string")),
}
A_ROW_EACH = {"pii", "line dedup", "quality", "bpe", "secrets", "jaccard", "urls"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, odd, name):
    found = OPERATORS[name](odd, spark).collect()
    if name in A_ROW_EACH:
        assert len(found) == odd.count()
    assert OPERATORS[name](odd.limit(0), spark).collect() == []


def test_jaccard_of_odd_rows(odd):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.link_components(odd).collect()}
    assert got[0, 0] == 0 and got[1, 0] == 1 and got[4, 76] == 3 and got[5, 77] == 3 and got[None, 76] == 3


def _spans(pattern, text, kind, good, flags=0):
    return [(kind, *m.span()) for m in re.finditer(pattern, text, flags) if good(m)]


def test_pii_base_and_copies(spark):
    docs = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in [*docs, *map(lambda x: x or "", TEXTS)]:
        want = _spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t, "email", lambda m: True) if len(t) < 50_000 else []
        want += _spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t, "ip", lambda m: max(map(int, m[0].split("."))) <= 255)
        want += _spans(r"[0-9]([\x20-]?[0-9])+", t, "card", lambda m: 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d))
        want += _spans(r"\+[0-9][\x20().0-9-]+[0-9]", t, "phone", lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
        assert sorted(pii.base_spans(t)) == sorted(want)


def test_secrets_against_plain_regexes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for t, r in zip([x.text or "" for x in docs.collect()], secrets.find_secrets(docs.select("doc_id", "text", F.lit(1).alias("k"))).collect(), strict=True):
        want = _spans(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, "assign", lambda m: len(m[2]) >= 8, re.I | re.A)
        want += _spans(r"AKIA[A-Z0-9]+", t, "access", lambda m: len(m[0]) >= 16) + _spans(r"[0-9a-f]+", t, "hex", lambda m: len(m[0]) >= 32)
        order = {k: i for i, k in enumerate(secrets.KINDS)}
        assert r.base_spans == ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(want, key=lambda s: (s[1], order[s[0]])))


def test_bpe_against_the_library(spark, odd):
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(VOCABULARY)
    lib.no_truncation(), lib.no_padding()
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    for r in bpe.tokenize(docs.withColumn("body", F.col("text")), VOCABULARY).collect():
        ids = lib.encode(r.body or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)


def test_count_vectors_bound_the_overlap():
    rng = np.random.default_rng(1)
    for n in (3, 100, 5_000):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        other = np.unique(np.concatenate((base[: n // 2], rng.integers(0, 2**63, n, dtype=np.uint64))))
        p, q = (jaccard.numbers(jaccard.packed(jaccard.fine_point(x))) for x in (base, other))
        groups = min(len(p), len(q))
        assert np.minimum(jaccard.fold(p, groups), jaccard.fold(q, groups)).sum() >= len(np.intersect1d(base, other))
    assert (jaccard.numbers(jaccard.packed(np.array([1, 70_000]))) == [1, 70_000]).all()


def test_decontamination_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    items = [(k, " ".join(f"t{x}" for x in rng.integers(0, 5_000, 40))) for k in range(40)]
    docs = []
    for k, text in items:
        words = text.split()
        for place in rng.choice(40, 7, replace=False):
            words[place] = "changed"
        docs.append((k, " ".join(f"u{x}" for x in rng.integers(0, 5_000, 60)) + " " + " ".join(words)))
    docs.append((99, " ".join(f"v{x}" for x in range(200))))
    found = decontam.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.doc_id == r.item_id and r.distance <= 8 for r in found)
    assert len(found) >= 36


def test_passages_finds_a_planted_one(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 100_000, n))
    shared = words(80)
    docs = [(k, f"{words(100)} {shared} {words(100)}") for k in range(3)] + [(9, words(300))]
    found = passages.shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {0, 1, 2}
    assert all(r.start <= 105 and r.end >= 175 for r in found)


def test_licenses(spark):
    docs = spark.createDataFrame([(1, "before " + licenses.TEMPLATES["MIT"] + " after"), (2, "no licence at all in here")], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in licenses.find_licenses(docs).collect()] == [(1, "MIT")]


def test_url_rules(spark):
    urls = ["https://WWW.Example.com/en/a?x", "http://m.example.com/en/", "http://a.com/x", "ftp://b.net/fr/q#z", None, "nothing", "http://c.org"]
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), URL_RULES).collect()}
    assert got[urls[0]] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[urls[1]] == ("m.example.com", "/en/", "example.com/en/", "block")
    assert got[urls[2]][2:] == ("com/", "allow") and got[urls[3]][2:] == ("net/fr/", "block")
    assert got[None] == ("", "", None, "allow") and got["nothing"] == ("", "", None, "allow") and got[urls[6]][:2] == ("c.org", "")


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    kept = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert 0 < len(kept) < docs.count()
