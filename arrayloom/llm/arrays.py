"""How array records are read: genome, repeat, lineage, subtype, and what counts as the same repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.functions.labels import subtype as subtype
from arrayloom.runtime import table

MAX_EDITS = 2


def genome_key(genome_id: Column) -> Column:
    """Two letters and eight digits, upper case, whatever is written around them; null where there are none."""
    at = r"(?:^|[^A-Za-z0-9])([A-Za-z]{2})[_\- ]?(\d{8})(?!\d)"
    key = F.concat(F.upper(F.regexp_extract(genome_id, at, 1)), F.regexp_extract(genome_id, at, 2))
    return F.when(key != "", key)


def bases(repeat: Column) -> Column:
    """The repeat in upper case without blanks and hyphens, U read as T; null where nothing is left."""
    read = F.translate(F.upper(F.regexp_replace(repeat, r"[\s\-]", "")), "U", "T")
    return F.when(read != "", read)


def other_strand(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTN", "TGCAN"))


def same_bases(a: Column, b: Column, edits: int = MAX_EDITS) -> Column:
    """At most so many single-base edits apart on one of the two strands."""
    close = F.abs(F.length(a) - F.length(b)) <= edits
    return close & ((F.levenshtein(a, b, edits) >= 0) | (F.levenshtein(other_strand(a), b, edits) >= 0))


def ranks(taxonomy: Column) -> Column:
    """The lineage's ranks in lower case without prefixes and blanks; empty ranks keep their place."""
    return F.transform(F.split(taxonomy, "[;|,>]"), lambda r: F.trim(F.regexp_replace(F.lower(F.trim(r)), r"^[a-z]__", "")))


def rank(taxonomy: Column, n: int) -> Column:
    """The n-th rank, from 1; null where the lineage stops before it or leaves it empty."""
    parts = ranks(taxonomy)
    value = F.when(F.size(parts) >= n, F.element_at(parts, n))
    return F.when(value != "", value)


def array_records(spark, folder: str) -> DataFrame:
    return table(spark, folder, "cctyper_validation_repeats_cas_types")
