"""Expressions on arrays: vectors, sequences and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = 1e-9) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(epsilon))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column, epsilon: float = 1e-7) -> Column:
    return F.sqrt(F.greatest(squared_distance(a, b), F.lit(epsilon)))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))


def windows(a: Column, width: int, step: int = 1) -> Column:
    """All runs of so many neighbours."""
    starts = F.when(F.size(a) >= width, F.sequence(F.lit(1), F.size(a) - width + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i, width))


def ngrams(tokens: Column, n: int) -> Column:
    return F.transform(windows(tokens, n), lambda x: F.array_join(x, " "))


def without_positions(a: Column, positions: Column) -> Column:
    return F.filter(a, lambda x, i: ~F.array_contains(positions, i))


def names_of_bits(bits: Column, names: Column) -> Column:
    """Names whose bit is set."""
    return F.transform(F.filter(F.arrays_zip(bits.alias("bit"), names.alias("name")), lambda x: x["bit"] == 1), lambda x: x["name"])


def map_size(m: Column) -> Column:
    """Members of a map of arrays."""
    return F.aggregate(F.map_values(m), F.lit(0), lambda s, x: s + F.size(x))


def sorted_entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; 0 where one is constant."""
    n = F.size(a).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    top = n * dot(a, b) - total(a) * total(b)
    bottom = F.sqrt(n * dot(a, a) - F.pow(total(a), 2)) * F.sqrt(n * dot(b, b) - F.pow(total(b), 2))
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def key_of(a: Column) -> Column:
    """One key of several parts."""
    return F.array_join(a, "_")


def quoted(a: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(a, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), sep)


def longest_common_substring(a: Column, b: Column) -> Column:
    """The longest run of characters that both strings hold, the one that ends first in a among equals; empty if there is none, null if a string is null.

    A row of the usual table, the length of the common run that ends at each character of b, goes through a's characters in an aggregate.
    """
    row = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))
    start = F.struct(row.alias("row"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        # Place 0 stands before b.
        new = F.transform(s["row"], lambda _, j: F.when((j > 0) & (b.substr(j, F.lit(1)) == c), F.get(s["row"], j - 1) + 1).otherwise(0))
        at = s["at"] + 1

        def longest(row: Column) -> Column:
            best = F.array_max(row)
            return F.struct(row.alias("row"), at.alias("at"), F.greatest(best, s["n"]).alias("n"), F.when(best > s["n"], at).otherwise(s["end"]).alias("end"))

        # Through an array of one, so that the new row is computed once.
        return F.transform(F.array(new), longest)[0]

    characters = F.transform(F.filter(F.sequence(F.lit(0), F.length(a)), lambda i: i > 0), lambda i: a.substr(i, F.lit(1)))
    found = F.transform(F.array(F.aggregate(characters, start, step)), lambda s: a.substr(s["end"] - s["n"] + 1, s["n"]))
    return F.when(a.isNotNull() & b.isNotNull(), found[0])


def combinations(a: Column, r: int) -> Column:
    """All choices of r entries, in the order of places; one empty choice for r = 0."""
    places = F.filter(F.sequence(F.lit(0), F.size(a)), lambda i: i > 0)
    chosen = F.array(F.array().cast("array<int>"))
    for _ in range(r):
        after = lambda c: F.filter(places, lambda i: i > F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), c), -1), F.lit(0)))
        chosen = F.flatten(F.transform(chosen, lambda c: F.transform(after(c), lambda i: F.concat(c, F.array(i)))))
    return F.transform(chosen, lambda c: F.transform(c, lambda i: F.element_at(a, i)))


def nested_entries(m: Column) -> Column:
    """Entries (outer, inner, value) of a map of maps, by both keys."""
    inner = lambda k, v: F.transform(F.map_entries(v), lambda e: F.struct(k.alias("outer"), e["key"].alias("inner"), e["value"].alias("value")))
    return F.array_sort(F.flatten(F.transform(F.map_entries(m), lambda e: inner(e["key"], e["value"]))))
