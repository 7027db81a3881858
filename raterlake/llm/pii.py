"""Personal data with a skip-chain conditional random field.

Nodes are the candidates of a document: tokens that hold a digit or an ``@``, where neighbouring tokens of digits and phone marks make one
node, as the base patterns see them. Labels are other, email, ip, card and phone. A node's potential comes from features of its shape, a linear
chain joins neighbouring nodes, and skip edges join each node with the first and the last earlier node of the same key (its letters and
digits, all its digits, or the last ten or seven of them), so repeated or similar tokens share potentials however far apart they are. Loopy
sum-product message passing runs over chain and skip edges until beliefs settle, and gives one labelling per document in which
copies of an entity agree: a number that the base patterns miss at one place, because of how it is written or what stands beside
it, is found there if they find it elsewhere in the document.

The field is trained with the base patterns' labels by pseudo-likelihood: each node's label given its features and its neighbours'
labels, once with and once without the features, so that the couplings of chain and skip edges learn how far neighbours agree by themselves.
Training reads counts of (features, neighbours' labels, label) over all documents (``count_patterns``); all parts of a pattern are
capped, so their number has a bound that doesn't grow with the corpus. Base spans always stay; nodes that the field gives a
label and no base span touches are added as spans of that kind.

Defined results: a null text counts as empty; whole texts are searched; equal rows get equal results; without any labelled node in
the corpus no spans are added. Work per document is n log n in its characters: no pattern scans a run of characters again
from each of its places, and a node has at most eight skip edges to earlier ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterlake.llm import spans as span_of
from raterlake.llm import text as words_of

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["other", *KINDS]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits can only begin a match at its first digit, as later ones would need the same after them.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_BLANKS = " \t\n\v\f\r"
_NUMBER = re.compile(r"[+(]{0,2}[0-9][0-9()-]*(?:\.[0-9()-]+){0,2}")
_GAP = re.compile(r"[\x20().-]{1,3}")

#: Added to the potential of the label that the base patterns give.
KNOWN = 8.0
#: What the couplings of chain and skip edges are before training.
COUPLINGS = (0.5, 4.0)
ROUNDS = 12
#: Nodes further apart than so many characters aren't neighbours of the chain.
REACH = 2
#: Neighbours of one label that a pattern counts, and the digits of a node of several tokens.
MOST, MOST_DIGITS = 2, 19


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[span_of.Span]:
    """Leftmost matches of local part, @ and domain: from each @ as far back as its local part goes."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        domain = _DOMAIN.match(text, at + 1) if a < at else None
        if domain:
            out.append(("email", a, domain.end()))
        end = domain.end() if domain else at + 1
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[span_of.Span]:
    """Leftmost non-overlapping matches of each kind; those that fail a test are dropped."""
    out = _emails(text)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Tokens that hold a digit or @, without the punctuation around them."""
    out, end = [], 0
    while m := _MARK.search(text, end):
        a = m.start()
        while a > end and text[a - 1] not in _BLANKS:
            a -= 1
        stop = _SPACE.search(text, m.end())
        end = b = stop.start() if stop else len(text)
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def nodes_of(text: str) -> list[tuple[int, int]]:
    """The tokens, with neighbouring ones of digits and phone marks as one node."""
    out: list[tuple[int, int]] = []
    digits = 0
    for a, b in tokens(text):
        number = b - a <= 40 and _NUMBER.fullmatch(text, a, b) is not None
        n = sum(c.isdigit() for c in text[a:b]) if number else MOST_DIGITS + 1
        if out and digits + n <= MOST_DIGITS and a - out[-1][1] <= 3 and _GAP.fullmatch(text, out[-1][1], a):
            out[-1] = (out[-1][0], b)
            digits += n
        else:
            out.append((a, b))
            digits = n
    return out


def features(token: str) -> list[str]:
    """A bounded set of feature values."""
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    marks = "".join(c for c in "@.-+(_%" if c in token)
    return [
        f"digits={min(digits, 20)}",
        f"letters={min(letters, 3)}",
        f"marks={marks}",
        f"dots={min(token.count('.'), 4)}",
        f"shape={'d' if digits == len(token) else 'a' if not digits else 'm'}{'@' * (token.count('@') == 1)}{'+' * token.startswith('+')}",
        f"luhn={14 <= digits <= 19 and not letters and luhn(''.join(c for c in token if c.isdigit() and c.isascii()) or '1')}",
    ]


def keys(token: str) -> list[str]:
    """What nodes are compared by: letters and digits without case; digits alone, if there are six or more, and their last ten and seven."""
    plain = "".join(c for c in token.lower() if c.isalnum() or c == "@")
    digits = "".join(c for c in token if c.isdigit())
    out = ["=" + plain] if len(plain) >= 4 else []
    return out + ["#" + digits] * (len(digits) >= 6) + [f"{k}:{digits[-k:]}" for k in (10, 7) if len(digits) >= k]


def edges_of(nodes: list[tuple[int, int]], words: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The chain's edges, and the skip edges."""
    chain = [(k - 1, k) for k in range(1, len(nodes)) if nodes[k][0] - nodes[k - 1][1] <= REACH]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    skip = []
    for k, word in enumerate(words):
        for key in keys(word):
            if key in last:
                skip += [(j, k) for j in {first[key], last[key]}]
            first.setdefault(key, k)
            last[key] = k
    return chain, skip


def labels_of(nodes: list[tuple[int, int]], spans: list[span_of.Span]) -> list[int]:
    """The label of each node by the spans that cover it; an earlier kind goes first. Spans of a kind don't overlap, nor do nodes."""
    out = [0] * len(nodes)
    for kind in reversed(KINDS):
        k = 0
        for _, a, b in sorted(s for s in spans if s[0] == kind):
            while k < len(nodes) and nodes[k][1] <= a:
                k += 1
            j = k
            while j < len(nodes) and nodes[j][0] < b:
                out[j] = LABELS.index(kind)
                j += 1
    return out


def infer(nodes: np.ndarray, chain: list[tuple[int, int]], skip: list[tuple[int, int]], couplings: tuple[float, float]) -> np.ndarray:
    """Beliefs of all labels at each node by loopy sum-product. nodes: log potentials, nodes x labels; couplings: of chain and skip edges."""
    edges = np.array([*chain, *skip], np.int64).reshape(-1, 2)
    if len(edges):
        # Several edges between two nodes are one with their couplings' sum, as messages would go round in them.
        edges, of = np.unique(edges, axis=0, return_inverse=True)
        weight = np.bincount(of.ravel(), np.repeat(couplings, (len(chain), len(skip))))
    else:
        top = nodes - nodes.max(1, keepdims=True)
        p = np.exp(top)
        return p / p.sum(1, keepdims=True)
    source, target = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
    weight, back = np.concatenate((weight, weight)), np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
    # An edge favours equal labels: exp(weight) against 1.
    gain = (np.exp(weight) - 1)[:, None]
    messages = np.zeros((len(source), nodes.shape[1]))
    for _ in range(ROUNDS):
        total = nodes.copy()
        np.add.at(total, target, messages)
        out = total[source] - messages[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(out.sum(1, keepdims=True) + gain * out)
        new -= new.max(1, keepdims=True)
        moved = np.abs(new - messages).max()
        messages = 0.5 * messages + 0.5 * new
        if moved < 1e-3:
            break
    total = nodes.copy()
    np.add.at(total, target, messages)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@dataclass
class Field:
    """Weights of the features by label, the labels' own, and the couplings of chain and skip edges."""

    weights: dict[str, np.ndarray]
    prior: np.ndarray
    couplings: tuple[float, float]


def added_spans(text: str, base: list[span_of.Span], field: Field | None) -> list[span_of.Span]:
    """Spans that the field adds to the base ones."""
    if field is None or not base:
        return []
    nodes = nodes_of(text)
    words = [text[a:b] for a, b in nodes]
    chain, skip = edges_of(nodes, words)
    if not skip:
        return []
    known = labels_of(nodes, base)
    potentials = np.stack([sum((field.weights[f] for f in features(w) if f in field.weights), field.prior) for w in words])
    for k, label in enumerate(known):
        if label:
            potentials[k, label] += KNOWN
    linked = {k for edge in skip for k in edge}
    best = infer(potentials, chain, skip, field.couplings)
    # Only agreement within the document adds a span; a base span keeps its place.
    return [(LABELS[int(best[k].argmax())], *nodes[k]) for k in sorted(linked) if not known[k] and best[k].argmax() and best[k].max() > 0.5]


def _neighbours(n: int, edges: list[tuple[int, int]], labels: list[int]) -> list[str]:
    """For each node how many neighbours have each label, up to MOST, as digits."""
    out = np.zeros((n, len(LABELS)), np.int64)
    for x, y in edges:
        out[x, labels[y]] += 1
        out[y, labels[x]] += 1
    return ["".join(map(str, row)) for row in np.minimum(out, MOST).tolist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, int], int] = {}
    for batch in batches:
        for value in batch.column(0):
            text = value.as_py() or ""
            nodes = nodes_of(text)
            if not nodes:
                continue
            words = [text[a:b] for a, b in nodes]
            labels = labels_of(nodes, base_spans(text))
            near = [_neighbours(len(nodes), edges, labels) for edges in edges_of(nodes, words)]
            for word, label, chain, skip in zip(words, labels, *near, strict=True):
                pattern = " ".join((*features(word), chain, skip))
                counts[pattern, label] = counts.get((pattern, label), 0) + 1
    rows = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["pattern", "label", "n"])


def count_patterns(docs: DataFrame, text: str = "text") -> dict[tuple[str, int], int]:
    """How often each pattern (features, chain and skip neighbours by label) has each label, over all documents. Each part of a pattern has
    a few values, so the rows are bounded whatever the number of documents."""
    rows = docs.select(text).mapInArrow(_count, "pattern string, label int, n bigint").groupBy("pattern", "label").agg(F.sum("n").alias("n")).collect()
    return {(r["pattern"], r["label"]): r["n"] for r in sorted(rows)}


def fit(counts: dict[tuple[str, int], int], steps: int = 400, rate: float = 0.1, ridge: float = 1e-4, pull: float = 0.05) -> Field | None:
    """The field that makes the labels likely given features and neighbours (pseudo-likelihood), each pattern with and without its
    features; None without a labelled node. Couplings are pulled to COUPLINGS, so that they stand where a corpus has few repeats."""
    if not any(label for _, label in counts):
        return None
    patterns = [p.split(" ") for p, _ in counts]
    names = sorted({f for p in patterns for f in p[:-2]})
    place = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(patterns), len(names)))
    for k, p in enumerate(patterns):
        x[k, [place[f] for f in p[:-2]]] = 1
    near = np.array([[[int(d) for d in part] for part in p[-2:]] for p in patterns], float)
    y, n = np.array([label for _, label in counts]), np.array(list(counts.values()), float)
    # Labels count alike, as nearly all nodes have none.
    share = n / np.maximum(np.bincount(y, n, len(LABELS)), 1)[y]
    share /= share.sum()
    views = [(x, share / 2), (np.zeros_like(x), share / 2)]
    theta = [np.zeros((len(names), len(LABELS))), np.zeros(len(LABELS)), np.array(COUPLINGS)]
    first, second = ([np.zeros_like(t) for t in theta] for _ in range(2))
    for step in range(1, steps + 1):
        slopes = [-ridge * theta[0], -ridge * theta[1], -pull * (theta[2] - COUPLINGS)]
        for own, w in views:
            z = own @ theta[0] + theta[1] + np.tensordot(theta[2], near, (0, 1))
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            miss = -p * w[:, None]
            miss[np.arange(len(y)), y] += w
            slopes[0] += own.T @ miss
            slopes[1] += miss.sum(0)
            slopes[2] += np.einsum("nl,nel->e", miss, near)
        for k, g in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            theta[k] = theta[k] + rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
        theta[2] = np.maximum(theta[2], 0)
    return Field({f: theta[0][k] for f, k in place.items()}, theta[1], (float(theta[2][0]), float(theta[2][1])))


def _find(batches: Iterator[pa.RecordBatch], field: Field | None, text: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = words_of.plain(batch.column(text))
        base, more = [], []
        for value in column:
            t = value.as_py()
            base.append(base_spans(t))
            more.append(added_spans(t, base[-1], field))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in keep),
                *(pa.array([sum(s[0] == kind for s in x) for x in base], pa.int64()) for kind in KINDS),
                pa.array([span_of.joined(x, KINDS) for x in base], pa.string()),
                pa.array([span_of.joined(x + y, KINDS) for x, y in zip(base, more, strict=True)], pa.string()),
            ],
            [*keep, *(f"n_{k}" for k in KINDS), "base_spans", "spans"],
        )


def find_pii(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For each row: the columns in keep (all but the text by default), n_email, n_ip, n_card, n_phone, base_spans and spans
    (kind:start:end in code points, comma-joined). Clashing columns aren't kept."""
    made = {*(f"n_{k}" for k in KINDS), "base_spans", "spans", text}
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in made]
    field = docs.sparkSession.sparkContext.broadcast(fit(count_patterns(docs, text)))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS])
    schema = schema.add("base_spans", T.StringType()).add("spans", T.StringType())
    return docs.select(*keep, text).mapInArrow(lambda b: _find(b, field.value, text, keep), schema)
