"""Expressions over DNA and protein strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, bases in the order T, C, A, G.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def reverse_complement(s: Column) -> Column:
    """Complement of A, C, G, T in either case, reversed; other characters stay."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def translate(s: Column) -> Column:
    """Protein of an upper-cased sequence; trailing bases of no codon are cut, unknown codons are X."""
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    up = F.upper(s)
    codons = F.transform(F.regexp_extract_all(up, F.lit("(?s).{3}"), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X")))
    return F.when(s.isNull(), None).otherwise(F.array_join(codons, ""))


def gc_fraction(s: Column) -> Column:
    """G and C among A, C, G, T; 0 without any of these."""
    up = F.upper(s)
    gc, all_ = F.length(F.regexp_replace(up, "[^GC]", "")), F.length(F.regexp_replace(up, "[^ACGT]", ""))
    return F.when(s.isNull(), None).when(all_ == 0, 0.0).otherwise(gc.cast("double") / F.nullif(all_, F.lit(0)))


def gc_of_length(s: Column) -> Column:
    """G and C among all characters; 0 for an empty sequence."""
    return F.when(s.isNull(), None).when(F.length(s) == 0, 0.0).otherwise(F.length(F.regexp_replace(F.upper(s), "[^GC]", "")).cast("double") / F.nullif(F.length(s), F.lit(0)))


def base_count(s: Column, base: str) -> Column:
    return F.length(F.regexp_replace(F.upper(s), f"[^{base}]", ""))


def same_protein(a: Column, b: Column) -> Column:
    """Equal but for trailing stops and the first residue."""
    bare = [F.regexp_replace(x, r"\*+$", "") for x in (a, b)]
    return F.expr("true") & (F.length(bare[0]) == F.length(bare[1])) & (F.substring(bare[0], 2, 1 << 30) == F.substring(bare[1], 2, 1 << 30))


def coding_sequence(contig: Column, start: Column, end: Column, strand: Column, protein: Column) -> Column:
    """(sequence, strand, verified): the coding sequence between 1-based inclusive coordinates, in either order.

    A trailing part of a codon is cut. The strand is the one whose translation is the given protein; if neither is, the
    asserted strand stands."""
    low, size = F.least(start, end).cast("int"), (F.abs(end - start) + 1).cast("int")
    cut = F.substring(contig, low, size)
    trimmed = lambda x: F.substring(x, F.lit(1), (F.length(x) - F.length(x) % 3).cast("int"))
    plus, minus = trimmed(cut), trimmed(reverse_complement(cut))
    on_plus, on_minus = F.coalesce(same_protein(translate(plus), protein), F.lit(False)), F.coalesce(same_protein(translate(minus), protein), F.lit(False))
    chosen = F.when(on_plus & on_minus, strand).when(on_plus, "+").when(on_minus, "-").otherwise(strand)
    return F.struct(F.when(chosen == "-", minus).otherwise(plus).alias("sequence"), chosen.alias("strand"), (on_plus | on_minus).alias("verified"))


def accession(s: Column) -> Column:
    """The assembly accession in a text, or null."""
    return F.nullif(F.regexp_extract(s, r"GC[AF]_\d+\.\d+", 0), F.lit(""))


def off_alphabet(s: Column, letters: str, share: float = 0.1) -> Column:
    """Whether more than `share` of the characters that aren't white space are outside the alphabet."""
    bare = F.regexp_replace(F.upper(s), r"\s", "")
    return F.length(F.regexp_replace(bare, f"[{letters}]", "")) > share * F.length(bare)
