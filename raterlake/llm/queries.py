"""One query per operator of this subpackage, over whole tables, and the SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlake.llm import bpe, decontam, importance, jaccard, licenses, linededup, passages, pii, quality, secrets, tokenfiles, urlfilter, vectorcodes
from raterlake.llm.shared import shared_folder

#: The tokenizer's vocabulary.
VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))
#: The vocabulary of op13, whose tokenizer drops white space.
WORD_VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, runs (comma-joined first:last of the removed lines), text_sha256 of the text left."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("runs", ",").alias("runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics, and the verdict by frequent lines with the limits of the pipeline."""
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "removed_words")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), VOCABULARY, keep=["doc_id"], with_ids=False)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, end (words), other_id, other_start, other_end: each passage that a document shares with another."""
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, start, end, containment: each template that a document holds."""
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "template")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, end, distance: each benchmark item that a document holds."""
    return decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, and rank of the documents drawn for the benchmark's distribution of words."""
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20, max_n=1, buckets=10_000, keep=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectorcodes.encode_vectors(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, from the files read back."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4()}"
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), folder, WORD_VOCABULARY, end=1, by_word=True)
    return tokenfiles.read_tokens(spark, folder, with_ids=False)


#: Fixed rules of op9.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe": op4_bpe,
    "op5_secret_scan": op5_secret_scan,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_passages": op7_passages,
    "op8_license_scan": op8_license_scan,
    "op9_url_filter": op9_url_filter,
    "op10_decontamination": op10_decontamination,
    "op11_importance": op11_importance,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_files": op13_token_files,
}

_LINES = """
lines AS (
  SELECT doc_id, source, text, line, place, trim(lower(regexp_replace(line, '[ \\t-\\r]+', ' ', 'g')), ' ') AS norm
  FROM (SELECT doc_id, source, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents)
  WHERE regexp_matches(line, '[^ \\t-\\r]'))"""

SQL: dict[str, str] = {
    "op2_line_dedup": f"""
WITH {_LINES},
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS n FROM lines),
windows AS (
  SELECT doc_id, n, norm || chr(10) || lead(norm, 1) OVER w || chr(10) || lead(norm, 2) OVER w AS run
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
ranked AS (SELECT doc_id, n, row_number() OVER (PARTITION BY run ORDER BY doc_id, n) AS k FROM windows WHERE run IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, n + unnest([0, 1, 2]) AS n FROM ranked WHERE k > 1),
edges AS (
  SELECT doc_id, n, CASE WHEN lag(n) OVER w = n - 1 THEN 0 ELSE 1 END AS begins FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
grouped AS (SELECT doc_id, n, sum(begins) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM edges),
runs AS (
  SELECT doc_id, string_agg(r, ',' ORDER BY a) AS runs
  FROM (SELECT doc_id, min(n) AS a, min(n) || ':' || max(n) AS r FROM grouped GROUP BY doc_id, g) GROUP BY doc_id),
every AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.place) AS text
  FROM every e LEFT JOIN placed p ON p.doc_id = e.doc_id AND p.place = e.place LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.n = p.n
  WHERE g.n IS NULL GROUP BY e.doc_id),
counts AS (SELECT doc_id, count(*) AS n_lines FROM placed GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(runs, '') AS runs,
       sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN removed USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept k USING (doc_id)
""",
    "op3_quality_rules": f"""
WITH {_LINES},
w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM pos),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM twice) GROUP BY doc_id),
doubled AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
distinct_lines AS (
  SELECT DISTINCT doc_id, coalesce(source, '') AS host, text, norm,
         len(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS words FROM lines),
hosts AS (SELECT coalesce(source, '') AS host, count(DISTINCT coalesce(text, '')) AS docs FROM documents GROUP BY 1),
freq AS (SELECT host, norm, count(DISTINCT text) AS n FROM distinct_lines GROUP BY host, norm),
over_limit AS (SELECT host, norm FROM freq JOIN hosts USING (host) WHERE n > 5 AND n > 0.05 * docs),
line_sums AS (
  SELECT d.doc_id, sum(words) AS all_words, count(o.norm) AS n_removed_lines,
         coalesce(sum(words) FILTER (o.norm IS NOT NULL), 0) AS removed_words
  FROM distinct_lines d LEFT JOIN over_limit o ON o.host = d.host AND o.norm = d.norm GROUP BY d.doc_id),
stats AS (
  SELECT d.doc_id, len(ws) AS n_words, coalesce(len(array_to_string(ws, '')), 0) AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols, coalesce(b.n, 0) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, coalesce(n_removed_lines, 0) AS n_removed_lines,
         coalesce(removed_words, 0) AS removed_words, coalesce(all_words, 0) AS all_words
  FROM documents d JOIN w USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN doubled b USING (doc_id) LEFT JOIN line_sums USING (doc_id))
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (removed_words > 0.5 * all_words) AS kept,
       n_removed_lines, CAST(removed_words AS BIGINT) AS removed_words
FROM stats
""",
    "op6_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
""",
    "op11_importance": r"""
WITH RECURSIVE steps AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (SELECT true AS corpus, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
ws AS (
  SELECT corpus, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM texts),
counted AS (SELECT corpus, id, w, count(*) AS n FROM (SELECT corpus, id, unnest(ws) AS w FROM ws) GROUP BY ALL),
hashed AS (
  SELECT w, xor(list_reduce(list_transform(range(1, strlen(w) + 1), lambda i: CAST('0x' || substr(hex(w), 2 * i - 1, 2) AS BIGINT)),
                            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM counted), crc),
features AS (SELECT corpus, id, bucket, sum(n) AS n FROM counted JOIN hashed USING (w) GROUP BY ALL),
tallies AS (
  SELECT bucket, coalesce(sum(n) FILTER (corpus), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT corpus), 0)::DOUBLE AS t FROM features GROUP BY bucket),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM tallies),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM tallies, sums),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE corpus GROUP BY id),
scored AS (
  SELECT ws.id AS doc_id, len(ws.ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || ws.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM ws LEFT JOIN weights USING (id) WHERE ws.corpus),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranks USING (doc_id)
""",
    "op12_vector_codes": """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[4 * p + 1:4 * p + 4] AS v FROM kept, range(16) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
a1 AS (
  SELECT vec_id, label, p, v, min(row(d, k)) AS best FROM (
    SELECT vec_id, label, parts.p, parts.v, b.k, list_sum(list_transform(list_zip(parts.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts JOIN b0 b USING (p)) GROUP BY ALL),
b1 AS (
  SELECT b.p, b.k, coalesce(m.v, b.v) AS v FROM b0 b LEFT JOIN (
    SELECT p, best[2] AS k, [floor(sum(v[1]) / count(*)), floor(sum(v[2]) / count(*)), floor(sum(v[3]) / count(*)), floor(sum(v[4]) / count(*))]::BIGINT[] AS v
    FROM a1 GROUP BY ALL) m ON m.p = b.p AND m.k = b.k),
a2 AS (
  SELECT vec_id, label, p, v, min(row(d, k)) AS best FROM (
    SELECT vec_id, label, parts.p, parts.v, b.k, list_sum(list_transform(list_zip(parts.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts JOIN b1 b USING (p)) GROUP BY ALL),
b2 AS (
  SELECT b.p, b.k, coalesce(m.v, b.v) AS v FROM b1 b LEFT JOIN (
    SELECT p, best[2] AS k, [floor(sum(v[1]) / count(*)), floor(sum(v[2]) / count(*)), floor(sum(v[3]) / count(*)), floor(sum(v[4]) / count(*))]::BIGINT[] AS v
    FROM a2 GROUP BY ALL) m ON m.p = b.p AND m.k = b.k),
a3 AS (
  SELECT vec_id, label, p, v, min(row(d, k)) AS best FROM (
    SELECT vec_id, label, parts.p, parts.v, b.k, list_sum(list_transform(list_zip(parts.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts JOIN b2 b USING (p)) GROUP BY ALL),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a3 GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, books
""",
}
