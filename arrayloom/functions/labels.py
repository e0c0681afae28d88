"""Readings of names, labels and numbers that are written in several ways. All are JVM-side column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column | str) -> Column:
    """The value as trimmed text; null is empty."""
    return F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))


def subtype(cas_subtype: Column) -> Column:
    """A subtype as roman numeral, hyphen and letter, however it is written; null for anything else."""
    read = F.regexp_replace(F.upper(F.trim(cas_subtype)), "[–—]", "-")
    read = F.regexp_replace(read, r"^(?:CAS-|TYPE )\s*", "")
    at = r"^(III|II|IV|VI|I|V)-?([A-Z])$"
    value = F.concat(F.regexp_extract(read, at, 1), F.lit("-"), F.regexp_extract(read, at, 2))
    return F.when(value != "-", value)


def truthy(value: Column) -> Column:
    """Whether a cell says yes; null and anything else say no."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def safe_name(value: Column) -> Column:
    """A text as file name: runs of other characters become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def link_id(prefix: str, *parts: Column) -> Column:
    """A lower-case identifier of a prefix and parts: letters and digits joined by single underscores."""
    plain = F.regexp_replace(F.lower(F.concat_ws("_", F.lit(prefix), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), "[^a-z0-9]+", "_")
    return F.regexp_replace(plain, "^_+|_+$", "")


def strain_key(strain: Column) -> Column:
    """What makes two writings of a strain the same: its letters and digits in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(strain.cast("string"), F.lit(""))), "[^a-z0-9]+", "")


def reported_strain(report: Column) -> Column:
    """The strain that an assembly report's comment names; empty where it names none."""
    return F.trim(F.regexp_extract(F.coalesce(report, F.lit("")), r"(?m)^# Infraspecific name:\s+strain=(.+)$", 1))


def assembly_level(status: Column) -> Column:
    """complete_genome, chromosome, scaffold, contig or unknown."""
    said = F.lower(F.coalesce(status, F.lit("")))
    return F.when(F.contains(said, F.lit("complete")), "complete_genome").when(F.contains(said, F.lit("chromosome")), "chromosome").when(
        F.contains(said, F.lit("scaffold")), "scaffold"
    ).when(F.contains(said, F.lit("contig")), "contig").otherwise("unknown")


def genus(organism: Column, taxonomy: Column) -> Column:
    """First word of the organism, else the last part of the lineage, else unknown."""
    first = F.regexp_extract(text(organism), r"^(\S+)", 1)
    last = F.trim(F.element_at(F.split(text(taxonomy), ";"), -1))
    return F.when(first != "", first).when(last != "", last).otherwise("unknown")


def species(organism: Column, taxonomy: Column) -> Column:
    """First two words of the organism, else what genus gives."""
    two = F.regexp_extract(text(organism), r"^(\S+)\s+(\S+)", 1)
    second = F.regexp_extract(text(organism), r"^(\S+)\s+(\S+)", 2)
    return F.when(second != "", F.concat_ws(" ", two, second)).otherwise(genus(organism, taxonomy))


def without_footnote(value: Column) -> Column:
    """A cell without the letter a to d of a footnote behind its last digit."""
    return F.regexp_replace(value, r"(?<=\d)[a-d]$", "")


def general_number(value: Column, digits: int = 8) -> Column:
    """A number in so many significant digits without trailing zeros, with an exponent below -4 or from digits on; nan for none."""
    # one step at a time over a one-element array, so that each part of the text is computed once
    shown = F.array(F.format_string(f"%.{digits - 1}e", value))
    cut = F.transform(shown, lambda t: F.struct(F.regexp_extract(t, r"^(-?)", 1).alias("sign"), F.regexp_replace(F.regexp_extract(t, r"^-?([\d.]+)e", 1), r"\.", "").alias("all"), F.regexp_extract(t, r"e([+-]\d+)$", 1).try_cast("int").alias("power")))
    read = F.transform(cut, lambda x: F.struct(x["sign"].alias("sign"), F.regexp_replace(x["all"], "0+$", "").alias("figures"), x["all"].alias("all"), x["power"].alias("power")))

    def rest(text: Column) -> Column:
        return F.when(text != "", F.concat(F.lit("."), text)).otherwise("")

    def plain(x: Column) -> Column:
        large = F.concat(x["all"].substr(F.lit(1), x["power"] + 1), rest(x["figures"].substr(x["power"] + 2, F.lit(digits))))
        return F.when(x["power"] >= 0, large).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -x["power"] - 1), x["figures"]))

    def short(x: Column) -> Column:
        sign = F.when(x["power"] < 0, "-").otherwise("+")
        return F.concat(F.left(x["figures"], F.lit(1)), rest(F.substring(x["figures"], 2, digits)), F.lit("e"), sign, F.lpad(F.abs(x["power"]).cast("string"), F.greatest(F.length(F.abs(x["power"]).cast("string")), F.lit(2)), F.lit("0")))

    text = F.transform(read, lambda x: F.concat(x["sign"], F.when((x["power"] < -4) | (x["power"] >= digits), short(x)).otherwise(plain(x))))
    return F.when(F.isnan(value), "nan").when(value == 0, "0").when(value.isNotNull(), text[0])


#: Which names of features make up a category, in the order in which they are tried. Fixed values.
CATEGORIES = (
    ("whole-repeat k-mer", r"^kmer_"),
    ("terminal k-mer", r"^terminal_kmer_"),
    ("terminal composition", r"^repeat_(start|end)_"),
    ("array statistics", r"^(spacer_count|mean_spacer_length|repeat_count|array_length_estimate|spacer_repeat_length_ratio)$"),
    ("repeat structure", r"^(repeat_self_rc_identity|repeat_longest_inverted_stem|repeat_hairpin_score)$"),
    ("repeat composition", r"^repeat_"),
)


def feature_category(name: Column) -> Column:
    out = F.lit("other")
    for category, pattern in reversed(CATEGORIES):
        out = F.when(name.rlike(pattern), category).otherwise(out)
    return out
