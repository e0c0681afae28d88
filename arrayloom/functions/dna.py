"""Column functions on DNA text. Everything stays in the JVM; nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases that each IUPAC letter allows. Fixed values.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
BASES = "ACGT"


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding, the same in Spark and in the SQL that results are checked with."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b, rounded; 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(rounded(a / b, digits))


def normalize_dna(sequence: Column) -> Column:
    return F.upper(F.regexp_replace(sequence, r"\s", ""))


def reverse_complement(sequence: Column) -> Column:
    """Upper-case reverse complement; letters other than A, C, G, T and N stay as they are."""
    return F.upper(F.reverse(F.translate(sequence, "ACGTNacgtn", "TGCANtgcan")))


def sequence_hash(sequence: Column) -> Column:
    """SHA-256 of the upper-case sequence without white space and non-ASCII characters."""
    return F.sha2(F.regexp_replace(normalize_dna(sequence), r"[^\x00-\x7F]", ""), 256)


def count_of(sequence: Column, letters: str) -> Column:
    return F.length(sequence) - F.length(F.translate(sequence, letters, ""))


def plain_bases(sequence: Column) -> Column:
    """A, C, G and T of the sequence in upper case."""
    return F.regexp_replace(F.upper(sequence), "[^ACGT]", "")


def gc_fraction(sequence: Column) -> Column:
    """G and C over all letters, ambiguous ones included; 0 for an empty sequence."""
    return F.when(F.length(sequence) == 0, 0.0).otherwise(count_of(F.upper(sequence), "GC") / F.length(sequence))


def gc_percent(sequence: Column) -> Column:
    """G and C over A, C, G and T only, in percent."""
    s = plain_bases(sequence)
    return F.when(F.length(s) == 0, 0.0).otherwise(rounded(count_of(s, "GC") / F.length(s) * 100, 6))


def at_percent(sequence: Column) -> Column:
    s = plain_bases(sequence)
    return F.when(F.length(s) == 0, 0.0).otherwise(rounded(count_of(s, "AT") / F.length(s) * 100, 6))


def gc_skew(sequence: Column) -> Column:
    s = F.upper(sequence)
    g, c = count_of(s, "G"), count_of(s, "C")
    return ratio(g - c, g + c)


def low_complexity(sequence: Column) -> Column:
    """Whether one base makes up more than four fifths, or G and C less than a fifth or more than four fifths."""
    n = F.length(sequence)
    dominant = F.greatest(*[count_of(sequence, b) for b in BASES]) / n
    gc = count_of(sequence, "GC") / n
    return ~((dominant <= 0.8) & (gc >= 0.2) & (gc <= 0.8))


def positions_alike(a: Column, b: Column) -> Column:
    """How many positions of two texts agree, counted over the shorter one."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), n), lambda i: a.substr(i, F.lit(1)) == b.substr(i, F.lit(1)))
    return F.when(n > 0, F.size(same)).otherwise(0)


def global_identity(a: Column, b: Column) -> Column:
    """Agreeing positions over the longer length, without alignment; 0 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(positions_alike(a, b) / longest)


def with_structure(df: DataFrame, column: str, longest: int = 12) -> DataFrame:
    """df with self_identity, inverted_stem and hairpin_score of a sequence column's plain bases.

    self_identity: positions that agree with the reverse complement, as a share.
    inverted_stem: the largest number of bases at the beginning, up to longest,
    that are the reverse complement of as many at the end; 0 below two.
    hairpin_score: stem over the root of the length plus self_identity, 0 below
    eight bases. Null is read as empty. Steps are columns, computed once each.
    """
    columns = df.columns
    steps = df.withColumn("_s", plain_bases(F.coalesce(column, F.lit("")))).withColumn("_rc", reverse_complement(F.col("_s")))
    s, rc, n = F.col("_s"), F.col("_rc"), F.length("_s")
    same = F.filter(F.zip_with(F.split("_s", ""), F.split("_rc", ""), lambda a, b: a == b), lambda x: x)
    fits = F.filter(F.sequence(F.lit(2), F.lit(longest)), lambda k: (k * 2 <= n) & (F.left(s, k) == F.left(rc, k)))
    steps = steps.withColumn("self_identity", F.when(n == 0, 0.0).otherwise(rounded(F.size(same) / n, 6))).withColumn("inverted_stem", F.coalesce(F.array_max(fits), F.lit(0)))
    hairpin = F.when(n < 8, 0.0).otherwise(rounded(F.col("inverted_stem") / F.sqrt(n) + F.col("self_identity"), 6))
    return steps.withColumn("hairpin_score", hairpin).select(*columns, "self_identity", "inverted_stem", "hairpin_score")


def extract_accession(*texts: Column) -> Column:
    """The first accession in the texts: parts between bars first, then words; '' where there is none."""
    shape = r"^(?:[A-Z]{1,2}_\d{5,9}(?:\.\d+)?|[A-Z]{1,4}\d{5,9}(?:\.\d+)?)$"
    found = []
    for text in texts:
        for cut in (r"\|", r"\s+"):
            parts = F.transform(F.split(F.trim(text), cut), lambda p: F.regexp_replace(F.trim(p), r"^[,;()\[\]]+|[,;()\[\]]+$", ""))
            hits = F.filter(parts, lambda p: p.rlike(shape))
            if cut == r"\|":
                found.append(F.when(F.contains(text, F.lit("|")), F.get(hits, F.lit(0))))
            else:
                found.append(F.get(hits, F.lit(0)))
    return F.coalesce(*found, F.lit(""))


def kmers(sequence: Column, k: int) -> Column:
    """All overlapping k-mers of the sequence's plain bases, as an array; empty if it is shorter."""
    s = plain_bases(sequence)
    last = F.length(s) - k + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: s.substr(i, F.lit(k))))
