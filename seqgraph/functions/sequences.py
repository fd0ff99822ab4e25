"""Column functions on nucleotide sequences and alignment scores. All are built-in expressions."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC codes, their complements, and the bases each stands for as bits A=1 C=2 G=4 T=8.
CODES = "ACGTUNRYKMSWBVDH"
COMPLEMENTS = "TGCAANYRMKSWVBHD"
BASES = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "K": 12, "M": 3, "S": 6, "W": 9, "B": 14, "V": 7, "D": 13, "H": 11, "N": 15}
NUCLEOTIDES = "^[ACGTNRYKMSWBVDHacgtnrykmswbvdh]+$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complement(seq: Column | str) -> Column:
    """IUPAC complement in upper case; U is read as T."""
    return F.translate(F.upper(_col(seq)), CODES, COMPLEMENTS)


def revcomp(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def iupac_mask(base: Column | str) -> Column:
    """Bits of the bases that a code stands for; 0 for anything else."""
    known = F.create_map(*(F.lit(x) for pair in BASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.upper(_col(base))), F.lit(0))


def iupac_match(a: Column | str, b: Column | str) -> Column:
    """Whether two codes share a base; a gap matches nothing."""
    return iupac_mask(a).bitwiseAND(iupac_mask(b)) != 0


def is_nucleotides(seq: Column | str) -> Column:
    return F.coalesce(F.rlike(_col(seq), F.lit(NUCLEOTIDES)), F.lit(False))


def hpc_collapse(seq: Column | str) -> Column:
    """Each run of one letter as a single letter."""
    return F.regexp_replace(_col(seq), r"(.)\1+", "$1")


def kmer_code(kmer: Column | str) -> Column:
    """Two bits a base, first base highest, for up to 31 bases of ACGT."""
    return F.conv(F.translate(_col(kmer), "ACGT", "0123"), 4, 10).cast("long")


def wrap_add(a: Column, b: Column) -> Column:
    """Sum modulo 2**64 without overflow under ANSI rules, by 32-bit halves."""
    low = F.lit(0xFFFFFFFF)
    s = a.bitwiseAND(low) + b.bitwiseAND(low)
    high = (F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(s, 32)).bitwiseAND(low)
    return F.shiftleft(high, 32).bitwiseOR(s.bitwiseAND(low))


def mix_hash(code: Column | str) -> Column:
    """Invertible 64-bit mix of a k-mer code, as a signed long."""
    x = _col(code)
    # fixed values: the shifts of this hash
    x = wrap_add(F.bitwise_not(x), F.shiftleft(x, 21))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 24))
    x = wrap_add(wrap_add(x, F.shiftleft(x, 3)), F.shiftleft(x, 8))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 14))
    x = wrap_add(wrap_add(x, F.shiftleft(x, 2)), F.shiftleft(x, 4))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 28))
    return wrap_add(x, F.shiftleft(x, 31))


def unsigned_order(h: Column | str) -> Column:
    """A long whose signed order is the unsigned order of ``h``."""
    return _col(h).bitwiseXOR(F.lit(-(2**63)))


def longest_overlap(left: Column | str, right: Column | str, most: int = 1000) -> Column:
    """Length of the longest suffix of ``left`` that is a prefix of ``right``, up to ``most``."""
    a, b = _col(left), _col(right)
    top = F.least(F.length(a), F.length(b), F.lit(most))
    sizes = F.when(top > 0, F.sequence(top, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.try_element_at(F.filter(sizes, lambda i: F.right(a, i) == F.left(b, i)), F.lit(1)), F.lit(0))


def error_cost(identity: float = 0.66) -> int:
    """Cost of an edit in hundredths of a matching base."""
    return int(100 * (identity / (1 - identity) + 1))


def x_score(span: Column | str, edits: Column | str, identity: float = 0.66) -> Column:
    return (100 * _col(span) - error_cost(identity) * _col(edits)) / F.lit(100.0)


def identity(matches: Column, mismatches: Column, deletions: Column, insertions: Column) -> Column:
    return matches / (matches + mismatches + deletions + insertions)


@lru_cache
def karlin_altschul(min_identity: float = 0.66) -> tuple[float, float]:
    """Lambda and K for +1 matches and mismatches that make ``min_identity`` score 0, both equally likely."""
    miss = -min_identity / (1 - min_identity)
    value = lambda x: (math.exp(x) + math.exp(x * miss)) / 2 - 1
    low, high = 1e-9, 0.7
    while high - low > 1e-16:
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    lam = (low + high) / 2
    series = sum(math.comb(k, j) / 2**k * min(1.0, math.exp(lam * (j + (k - j) * miss))) / k for k in range(1, 10) for j in range(k + 1))
    slope = (math.exp(lam) + miss * math.exp(lam * miss)) / 2
    return lam, math.exp(-2 * series) / (lam * slope) * lam / (1 - math.exp(-lam))


def e_value(database: Column, query: Column, span: Column, edits: Column, min_identity: float = 0.66) -> Column:
    """Expected chance alignments of this score or better."""
    lam, k = karlin_altschul(min_identity)
    miss = -min_identity / (1 - min_identity)
    return F.lit(k) * database * query * F.exp(-lam * (span + edits * (miss - 1)))


def trim_name(name: Column | str) -> Column:
    """A read's name up to the first white space."""
    return F.regexp_extract(_col(name), r"^[^ \t\r\n]*", 0)
