"""Column functions on sequence text. Positions are 0-based, ranges half-open; gap is '-', unknown nucleotide 'N'."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 15 nucleotide codes and the gap, and their complements in the same order.
CODES, COMPLEMENTS = "ACGTYRWSKMDVHBN-", "TGCARYWSMKHBDVN-"
#: Which nucleotides each code stands for.
READINGS = {
    "A": "A", "C": "C", "G": "G", "T": "T", "Y": "CT", "R": "AG", "W": "AT", "S": "CG", "K": "GT", "M": "AC",
    "D": "AGT", "V": "ACG", "H": "ACT", "B": "CGT", "N": "ACGT",
}
#: Fixed value: the standard genetic code, codons in the order T, C, A, G at each place.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon_table() -> dict[str, str]:
    """Codon to amino acid; a codon with ambiguous codes is in it if all its readings agree."""
    plain = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), STANDARD_CODE, strict=True)}
    out = {"---": "-"}
    for codon in product(READINGS, repeat=3):
        found = {plain["".join(r)] for r in product(*(READINGS[c] for c in codon))}
        if len(found) == 1:
            out["".join(codon)] = found.pop()
    return out


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


def letters(seq: Column) -> Column:
    """Array of single letters; empty for an empty sequence."""
    return F.filter(F.split(seq, ""), lambda x: x != "")


def gap_counts(seq: Column) -> Column:
    """struct(leading, internal, trailing, total). All-gap sequences have only leading gaps. A sequence of one letter
    counts no gap, and internal gaps are those between the ends' gaps without the last letter."""
    n = F.length(seq)
    lead = F.length(F.regexp_extract(seq, "^-*", 0))
    trail = F.when(lead == n, 0).otherwise(n - F.length(F.rtrim(seq, F.lit("-"))))
    gaps = n - F.length(F.replace(seq, F.lit("-"), F.lit("")))
    internal = F.when(lead == n, 0).otherwise(gaps - lead - trail)
    zero = F.lit(0)
    short = n <= 1
    return F.struct(
        F.when(short, zero).otherwise(lead).alias("leading"),
        F.when(short, zero).otherwise(internal).alias("internal"),
        F.when(short, zero).otherwise(trail).alias("trailing"),
        F.when(short, zero).otherwise(gaps).alias("total"),
    )


def translate_codons(seq: Column, stop_at_first: bool = False) -> Column:
    """Peptide of a coding sequence: one letter a whole codon, gap for '---', X where the codon can't be read."""
    table = codon_table()
    code = F.expr("array(" + ",".join(f"'{table.get(a + b + c, 'X')}'" for a, b, c in product(CODES, repeat=3)) + ")")  # by number, not searched; one call
    at = lambda c, k: F.instr(F.lit(CODES), F.substr(c, F.lit(k), F.lit(1)))
    place = lambda c: (at(c, 1) - 1) * 256 + (at(c, 2) - 1) * 16 + at(c, 3)
    read = lambda c: F.when(c.rlike(f"[^{CODES}]"), "X").otherwise(F.element_at(code, place(c)))
    n = F.floor(F.length(seq) / 3).cast("int")
    codons = F.regexp_extract_all(seq, F.lit("(.{3})"), F.lit(1))
    peptide = F.when(n == 0, "").otherwise(F.array_join(F.transform(codons, read), ""))
    return F.regexp_extract(peptide, r"^[^*]*\*?", 0) if stop_at_first else peptide
