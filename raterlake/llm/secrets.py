"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived, after Cox's code search: the fixed strings
that any match must hold give their trigrams (all of one string, one of several strings). A segment of documents, a block
of a partition, is indexed by the trigrams that queries use; postings are intersected and united, and the rule's
expression runs only over the candidates. Rules without mandatory trigrams scan every text. Segments never leave their
task, so there is no shuffle and memory is bounded by the block.

The three base rules (assign, access, hex) always keep their spans; the further RULES add spans of their own kinds. All
trigrams are of ASCII letters in lower case. Defined results: a null text counts as empty; whole texts are scanned; equal rows
get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from raterlake.llm import spans as span_of
from raterlake.llm import text as words_of

_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)

#: Fixed patterns: kind, expression, the group that has a least length, and that length. The first three are the base.
RULES: list[tuple[str, str, int, int]] = [
    ("assign", "(" + "|".join([*map(_ANY_CASE, ("password", "passwd", "secret", "token")), _ANY_CASE("api") + "_?" + _ANY_CASE("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 40),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
]
BASE = ("assign", "access", "hex")
KINDS = [r[0] for r in RULES]
#: What is run: a long run of hex digits is the same as any run that is long enough.
_RUN = {kind: re.compile(r"[0-9a-f]{32,}" if kind == "hex" else expression) for kind, expression, _, _ in RULES}

MOST_STRINGS = 64
Query = tuple


def _and(a: Query, b: Query) -> Query:
    return b if a == ("all",) else a if b == ("all",) or a == b else ("and", a, b)


def _or(a: Query, b: Query) -> Query:
    return ("all",) if ("all",) in (a, b) else a if a == b else ("or", a, b)


def _of_strings(strings: set[str]) -> Query:
    """One of the strings is there: all trigrams of it."""
    if not strings or min(map(len, strings)) < 3:
        return ("all",)
    one = lambda s: reduce(_and, [("has", s[k : k + 3]) for k in range(len(s) - 2)])
    return reduce(_or, [one(s) for s in sorted(strings)])


def _chars(items: list) -> set[str] | None:
    """The characters of a small class in lower case; None for a large or negated one."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 and all(c.isascii() for c in out) else None


def _walk(parsed) -> tuple[set[str] | None, Query]:
    """The strings that an expression matches, if few, and the query of every match otherwise."""
    exact: set[str] | None = {""}
    query: Query = ("all",)
    pure = True  # all so far are fixed strings
    for kind, value in parsed:
        strings, inner = None, ("all",)
        if kind is op.LITERAL and value < 128:
            strings = {chr(value).lower()}
        elif kind is op.IN:
            strings = _chars(value)
        elif kind is op.SUBPATTERN:
            strings, inner = _walk(value[3])
        elif kind is op.BRANCH:
            each = [_walk(x) for x in value[1]]
            if all(s is not None for s, _ in each):
                strings = set().union(*(s for s, _ in each))
            else:
                inner = reduce(_or, [q if s is None else _of_strings(s) for s, q in each])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, body = value
            some, inside = _walk(body)
            if some is not None and high == 1:
                strings = some | ({""} if low == 0 else set())
            elif low:
                inner = inside if some is None else _of_strings(some)
        joined = {a + b for a in exact for b in strings} if strings is not None else None
        if joined is not None and len(joined) <= MOST_STRINGS:
            exact = joined
        else:
            query = _and(query, _and(_of_strings(exact), inner if strings is None else ("all",)))
            exact, pure = (strings if strings is not None else {""}), False
    return (exact, query) if pure else (None, _and(query, _of_strings(exact)))


@lru_cache
def trigram_query(expression: str) -> Query:
    """Nested ("and", a, b), ("or", a, b), ("has", trigram) or ("all",): true of every text with a match."""
    strings, query = _walk(_parser.parse(expression))
    return _of_strings(strings) if strings is not None else query


def trigrams(query: Query) -> set[str]:
    return {query[1]} if query[0] == "has" else set().union(*(trigrams(x) for x in query[1:])) if query[0] != "all" else set()


class Segment:
    """Postings of the wanted trigrams in a block of texts."""

    _tables: dict[tuple[str, ...], np.ndarray] = {}

    def __init__(self, column: pa.Array, wanted: list[str]):
        self.n = len(column)
        data, offsets = words_of.utf8(column)
        self.postings = {t: np.zeros(0, np.int64) for t in wanted}
        if len(data) < 3:
            return
        key = tuple(wanted)
        if key not in self._tables:
            table = np.zeros(1 << 24, np.uint8)
            for k, t in enumerate(wanted):
                table[ord(t[0]) << 16 | ord(t[1]) << 8 | ord(t[2])] = k + 1
            self._tables[key] = table
        low = words_of._LOWER[data].astype(np.uint32)
        code = self._tables[key][low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]]
        places = np.flatnonzero(code)
        text = np.searchsorted(offsets, places, "right") - 1
        whole = places + 3 <= offsets[text + 1]
        both = np.unique(code[places[whole]].astype(np.int64) * self.n + text[whole])
        for k, t in enumerate(wanted):
            self.postings[t] = both[np.searchsorted(both, (k + 1) * self.n) : np.searchsorted(both, (k + 2) * self.n)] - (k + 1) * self.n

    def find(self, query: Query) -> np.ndarray:
        """Numbers of the texts for which the query is true."""
        if query[0] == "all":
            return np.arange(self.n)
        if query[0] == "has":
            return self.postings[query[1]]
        a, b = self.find(query[1]), self.find(query[2])
        return np.intersect1d(a, b, assume_unique=True) if query[0] == "and" else np.union1d(a, b)


_HEAD, _REST = re.compile(r"eyJ[A-Za-z0-9_-]*+"), re.compile(r"\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+")


def _jwt_spans(text: str) -> list[span_of.Span]:
    """What the jwt rule matches, without a new scan of a run from each eyJ in it: if the first one in a run doesn't match, none does."""
    out, at = [], 0
    while head := _HEAD.search(text, at):
        at = head.end()
        rest = _REST.match(text, at) if at - head.start() >= 13 else None
        if rest:
            at = rest.end()
            out.append(("jwt", head.start(), at))
    return out


def rule_spans(kind: str, text: str) -> list[span_of.Span]:
    """Spans of one rule in one text; matches that are too short are dropped."""
    if kind == "jwt":
        return _jwt_spans(text)
    _, _, group, least = RULES[KINDS.index(kind)]
    return [(kind, *m.span()) for m in _RUN[kind].finditer(text) if len(m[group]) >= least]


def scan_block(column: pa.Array) -> list[list[span_of.Span]]:
    """Spans of all rules in each text of a large string array without nulls."""
    queries = {kind: trigram_query(expression) for kind, expression, _, _ in RULES}
    wanted = sorted(set().union(*(trigrams(q) for q in queries.values())))
    segment = Segment(column, wanted)
    out: list[list[span_of.Span]] = [[] for _ in range(len(column))]
    for kind, query in queries.items():
        for k in segment.find(query).tolist():
            out[k] += rule_spans(kind, column[k].as_py())
    return out


def _scan(batches: Iterator[pa.RecordBatch], text: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = words_of.plain(batch.column(text))
        found: list[list[span_of.Span]] = []
        for a, b in words_of.blocks(column):
            found += scan_block(column.slice(a, b - a))
        base = [[s for s in x if s[0] in BASE] for x in found]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in keep),
                *(pa.array([sum(s[0] == kind for s in x) for x in base], pa.int64()) for kind in BASE),
                pa.array([span_of.joined(x, KINDS) for x in base], pa.string()),
                pa.array([span_of.joined(x, KINDS) for x in found], pa.string()),
            ],
            [*keep, *(f"n_{k}" for k in BASE), "base_spans", "spans"],
        )


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For each row: the columns in keep (all but the text by default), n_assign, n_access, n_hex, base_spans and spans
    (kind:start:end in code points, comma-joined). Clashing columns aren't kept."""
    made = {"n_assign", "n_access", "n_hex", "base_spans", "spans", text}
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in made]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f"n_{k}", T.LongType()) for k in BASE])
    schema = schema.add("base_spans", T.StringType()).add("spans", T.StringType())
    return docs.select(*keep, text).mapInArrow(lambda b: _scan(b, text, keep), schema)
