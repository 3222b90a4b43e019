"""Substrings, q-grams, deletion signatures and DNA expressions over string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Substrings are cut from pieces of this many starts: a substring of a long string is found by walking from its begin.
PIECE = 512


def kmers(s: Column, k: int) -> Column:
    """All substrings of length ``k`` in order; none for shorter strings."""
    starts = F.length(s) - k + 1
    pieces = F.transform(F.sequence(F.lit(0), F.greatest((F.ceil(starts / PIECE) - 1).cast("int"), F.lit(0))), lambda j: F.substring(s, j * PIECE + 1, F.lit(PIECE + k - 1)))
    of_piece = lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - k + 1), lambda i: F.substring(p, i, F.lit(k)))
    return F.when(starts > 0, F.flatten(F.transform(pieces, of_piece))).otherwise(F.array().cast("array<string>"))


def grams(s: Column, q: int) -> Column:
    """All substrings of length ``q`` in order; a shorter string is its own single gram."""
    return F.when(F.length(s) >= q, kmers(s, q)).otherwise(F.array(s))


def deletions(s: Column) -> Column:
    """The string itself and all strings with one character removed."""
    one = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    return F.array_distinct(F.concat(F.array(s), F.when(F.length(s) > 0, one).otherwise(F.array().cast("array<string>"))))


def _cut(length: Column, parts: int, i: int) -> tuple[Column, Column]:
    """Begin (from 0) and length of the ``i``-th of ``parts`` pieces of a word of that length."""
    begin, end = (F.floor(length * k / parts).cast("int") for k in (i, i + 1))
    return begin, end - begin


def pieces(s: Column, distance: int) -> Column:
    """(length, number, text) of the ``distance`` + 1 pieces of a word."""
    n = F.length(s)
    cut = [(i, *_cut(n, distance + 1, i)) for i in range(distance + 1)]
    return F.array(*[F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(s, at + 1, size).alias("piece")) for i, at, size in cut])


def piece_probes(s: Column, distance: int) -> Column:
    """The ``pieces`` that words within ``distance`` edits may share with this one: substrings at most as many places away."""
    shifts = F.sequence(F.lit(-distance), F.lit(distance))

    def probes(n: Column, i: int) -> Column:
        at, size = _cut(n, distance + 1, i)
        inside = F.filter(shifts, lambda d: (at + d >= 0) & (at + d + size <= F.length(s)))
        return F.transform(inside, lambda d: F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(s, at + d + 1, size).alias("piece")))

    lengths = F.sequence(F.greatest(F.length(s) - distance, F.lit(0)), F.length(s) + distance)
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.concat(*[probes(n, i) for i in range(distance + 1)]))))


def as_dna(s: Column) -> Column:
    """Letters mapped to ACGT by their place in the alphabet modulo 4, everything else dropped."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_replace(F.lower(s), "[^a-z]", ""), letters, "".join("ACGT"[i % 4] for i in range(26)))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def canonical(s: Column) -> Column:
    return F.least(s, reverse_complement(s))


def dna_code(s: Column) -> Column:
    """Two bits for each base, the first base highest (at most 31 bases)."""
    return F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("bigint")


def mismatches(a: Column, b: Column) -> Column:
    """The number of places at which two strings of equal length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
