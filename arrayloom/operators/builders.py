"""Training and feature tables put together from other tools' output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.functions import dna
from arrayloom.operators import intervals, training

COLUMNS = [
    "source", "genome_id", "organism", "taxonomy", "assembly_level", "contig_id", "array_start", "array_end", "repeat_sequence", "repeat_length", "spacer_count", "mean_spacer_length",
    "cas_type", "cas_subtype", "label_source", "label_confidence", "pam_rule",
]


MAX_PROFILES = 1_000


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def first_label(cell: Column) -> Column:
    """The first of several labels parted by ; or |."""
    return F.trim(F.regexp_extract(F.trim(F.coalesce(cell, F.lit(""))), r"^([^;|]*)", 1))


def from_caller(calls: DataFrame, manifest: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Training rows from array calls beside Cas operons.

    calls: genome_id, Contig, Start, End, Consensus_repeat, N_repeats,
    Spacer_len_avg, Trusted, Subtype or Prediction, Subtype_probability, all as
    strings; manifest: genome_id, organism, taxonomy, assembly_level. Rows with
    unusable repeats or undecided labels are left out.
    """
    has = set(calls.columns)
    label = F.coalesce(F.nullif(first_label(F.col("Subtype")), F.lit("")), first_label(F.col("Prediction"))) if {"Subtype", "Prediction"} <= has else first_label(F.col("Subtype" if "Subtype" in has else "Prediction"))
    repeat = F.upper(_text("Consensus_repeat"))
    number = lambda c: F.expr(f"cast(try_cast({c} as double) as bigint)") if c in has else F.lit(None).cast("bigint")
    real = lambda c: F.expr(f"try_cast({c} as double)") if c in has else F.lit(None).cast("double")
    sure = real("Subtype_probability")
    trusted = F.lower(_text("Trusted")) == "true" if "Trusted" in has else F.lit(False)
    high = (trusted & (sure.isNull() | (sure >= 0.8))) | F.coalesce(sure >= 0.9, F.lit(False))
    catalog = F.create_map(*[F.lit(x) for kv in (rules or {"": ""}).items() for x in kv])
    rows = calls.withColumns({"_label": label, "_repeat": repeat}).filter(training.is_usable(F.col("_repeat"), 1, 100_000) & ~training.is_ambiguous(F.col("_label")))
    joined = rows.join(manifest.select("genome_id", "organism", "taxonomy", "assembly_level"), "genome_id", "left")
    return joined.select(
        F.lit("cctyper").alias("source"), "genome_id", _text("organism").alias("organism"), _text("taxonomy").alias("taxonomy"), _text("assembly_level").alias("assembly_level"), _text("Contig").alias("contig_id"),
        number("Start").alias("array_start"), number("End").alias("array_end"), F.col("_repeat").alias("repeat_sequence"), F.length("_repeat").alias("repeat_length"),
        F.greatest(F.lit(0), F.coalesce(number("N_repeats"), F.lit(0)) - 1).alias("spacer_count"), F.coalesce(real("Spacer_len_avg"), F.lit(0.0)).alias("mean_spacer_length"),
        training.cas_type(F.col("_label")).alias("cas_type"), F.col("_label").alias("cas_subtype"), F.lit("nearby_cas_operon").alias("label_source"), F.when(high, "high").otherwise("medium").alias("label_confidence"),
        F.coalesce(catalog[F.col("_label")], F.lit("")).alias("pam_rule"),
    )


def from_spacers(rows: DataFrame, most: int) -> DataFrame:
    """Training rows from a spacer-level table whose subtype agrees with one found near by.

    rows: spacers, repeats, accessionnrs, subtype, subtypesinproximity, genus,
    phylum, PAM. One row per accession, repeat and subtype with two spacers or more.
    """
    known = r"^CAS-?TYPE(III|II|IV|VI|I|V)-?([A-Z])"
    sub = F.concat(F.regexp_extract(F.upper(_text("subtype")), known, 1), F.lit("-"), F.regexp_extract(F.upper(_text("subtype")), known, 2))
    near = F.transform(F.split(F.regexp_replace(_text("subtypesinproximity"), ";", "_"), "_"), lambda x: F.trim(x))
    read = rows.select(
        F.when(sub != "-", sub).alias("cas_subtype"), F.upper(_text("repeats")).alias("repeat_sequence"), _text("accessionnrs").alias("genome_id"), _text("genus").alias("genus"), _text("phylum").alias("phylum"), _text("PAM").alias("pam_rule"),
        F.col("spacers"), F.length("spacers").alias("n"), F.array_contains(near, _text("subtype")).alias("agrees"),
    )
    kept = read.filter(training.is_usable(F.col("repeat_sequence")) & F.col("cas_subtype").isNotNull() & F.col("agrees"))
    one = training.collapse_spacers(kept, ["genome_id", "repeat_sequence", "cas_subtype", "genus", "phylum", "pam_rule"], "spacers", "n")
    order = Window.partitionBy("cas_subtype").orderBy(F.desc("spacer_count"), "genome_id", "repeat_sequence")
    return one.withColumn("_no", F.row_number().over(order)).filter((F.col("_no") <= most) | F.lit(most <= 0)).drop("_no").withColumn("cas_type", training.cas_type(F.col("cas_subtype")))


def from_loci(loci: DataFrame, links: DataFrame, regions: DataFrame, sequences: DataFrame, strains: DataFrame, clusters: DataFrame, least_evidence: int = 3, reach: int = 20_000) -> DataFrame:
    """Training rows from a database of loci: repeat from its region, spacers from linked regions of category 3, label from the nearest Cas cluster.

    loci: id, sequence, drconsensus, start, length, evidencelevel; links:
    crisprlocus, region, length; regions: id, category, sequence; sequences: id,
    strain; strains: id, refseq, genbank, assembly_status; clusters: id,
    sequence, class, start, length. Loci without usable repeat or near cluster
    are left out.
    """
    stats = links.join(regions.filter("cast(category as int) = 3").select(F.col("id").alias("region")), "region").groupBy(F.col("crisprlocus").alias("locus")).agg(
        F.count("*").alias("spacer_count"), F.avg(F.col("length").cast("double")).alias("mean")
    )
    placed = loci.filter(F.col("evidencelevel").cast("int") >= least_evidence).select(
        F.col("id").alias("locus"), F.col("sequence").alias("contig"), "drconsensus", F.col("start").cast("bigint").alias("start"), (F.col("start").cast("bigint") + F.col("length").cast("bigint")).alias("end")
    )
    repeats = regions.select(F.col("id").alias("drconsensus"), F.upper(F.trim("sequence")).alias("repeat_sequence")).filter(training.is_usable(F.col("repeat_sequence")))
    kind = F.regexp_extract(F.upper(F.trim("class")), r"^CAS-TYPE([^-]+-[^-]+)$", 1)
    cas = clusters.select(
        F.col("id").cast("bigint").alias("id"), F.col("sequence").alias("contig"), kind.alias("cas_subtype"), F.col("start").cast("bigint").alias("start"), (F.col("start").cast("bigint") + F.col("length").cast("bigint")).alias("end")
    ).filter("cas_subtype <> ''")
    near = intervals.nearest(placed.join(repeats, "drconsensus"), cas, "contig", "locus", "id", reach).select("a.*", F.col("b.cas_subtype").alias("cas_subtype"), "distance")
    home = sequences.select(F.col("id").alias("contig"), "strain").join(strains.select(F.col("id").alias("strain"), "refseq", "genbank", "assembly_status"), "strain", "left")
    joined = near.join(home, "contig", "left").join(stats, "locus", "left")
    name = F.coalesce(F.nullif(_text("refseq"), F.lit("")), F.nullif(_text("genbank"), F.lit("")), F.col("contig").cast("string"))
    return joined.select(
        "locus", name.alias("genome_id"), _text("assembly_status").alias("assembly_level"), F.col("contig").alias("contig_id"), F.col("start").alias("array_start"), F.col("end").alias("array_end"), "repeat_sequence",
        F.length("repeat_sequence").alias("repeat_length"), F.coalesce("spacer_count", F.lit(0)).alias("spacer_count"), F.coalesce(dna.rounded(F.col("mean"), 6), F.lit(0.0)).alias("mean_spacer_length"),
        training.cas_type(F.col("cas_subtype")).alias("cas_type"), "cas_subtype", "distance",
    )


def best_links(links: DataFrame, keys: list[str], order: str, statuses: tuple[str, ...]) -> DataFrame:
    """One link per keys: that of the first status in the list, of equal ones the first by order. Links without path don't count."""
    rank = F.array_position(F.array(*[F.lit(s) for s in statuses]), F.col("linkage_status"))
    usable = links.filter((rank > 0) & (F.trim(F.coalesce("local_path", F.lit(""))) != ""))
    first = Window.partitionBy(*keys).orderBy(rank, order)
    return usable.withColumn("_no", F.row_number().over(first)).filter("_no = 1").drop("_no")


def genome_kmers(records: DataFrame, key: str, k: int) -> DataFrame:
    """(key, bases, gc_percent, shares): size, composition and k-mer shares of all records of a key, as a map."""
    per = records.select(key, dna.plain_bases(F.col("sequence")).alias("s"))
    sizes = per.groupBy(key).agg(F.sum(F.length("s")).alias("bases"), F.sum(dna.count_of(F.col("s"), "GC")).alias("gc"))
    each = per.select(key, F.explode(dna.kmers(F.col("s"), k)).alias("kmer")).groupBy(key, "kmer").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    shares = each.withColumn("share", dna.rounded(F.col("n") / total, 8)).groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kmer", "share")))).alias("shares"))
    return sizes.join(shares, key, "left").select(key, "bases", dna.ratio(F.col("gc") * 100, F.col("bases")).alias("gc_percent"), "shares")


def fragmented(records: DataFrame, most: int = 1000, ambiguous: float = 0.05, short: int = 500) -> DataFrame:
    """(source_file, warning): files with many records, many ambiguous bases, or mostly short records."""
    s = F.upper("sequence")
    per = records.groupBy("source_file").agg(
        F.count("*").alias("n"), F.sum(F.length(s)).alias("bp"), F.sum(F.length(s) - F.length(dna.plain_bases(s))).alias("odd"), F.count_if(F.length(s) < short).alias("small")
    )
    checks = F.array_compact(
        F.array(
            F.when(F.col("n") >= most, "many records"), F.when((F.col("bp") > 0) & (F.col("odd") / F.col("bp") >= ambiguous), "ambiguous bases"), F.when(F.col("small") / F.col("n") >= 0.5, "mostly short records")
        )
    )
    return per.select("source_file", F.explode(checks).alias("warning"))


def matching_profiles(records: DataFrame, text: str, profiles: DataFrame) -> DataFrame:
    """records with the one profile whose every group has a term in the text; records of none or several profiles are left out.

    profiles: profile, groups (array of arrays of terms). All of them stand
    beside each record in one row, so their number is checked; repeated records
    are decided each on its own.
    """
    given = profiles.select("profile", "groups").limit(MAX_PROFILES + 1).collect()
    if len(given) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    said = F.lower(F.coalesce(F.col(text), F.lit("")))
    fits = [F.when(reduce(Column.__and__, [reduce(Column.__or__, [F.contains(said, F.lit(t.lower())) for t in g], F.lit(False)) for g in r["groups"]], F.lit(True)), F.lit(r["profile"])) for r in given]
    found = F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>")
    return records.withColumn("_fits", found).filter(F.size("_fits") == 1).withColumn("profile", F.col("_fits")[0]).drop("_fits")


def first_accepted(candidates: DataFrame, key: str, order: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """candidates with decision: the first rule that holds, else promoted for the first one of its key, already_promoted for later ones."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        reason = F.when(holds, name).otherwise(reason)
    judged = candidates.withColumn("_reason", reason)
    first = F.row_number().over(Window.partitionBy(key, F.col("_reason").isNull()).orderBy(order))
    return judged.withColumn("_no", first).withColumn("decision", F.coalesce("_reason", F.when(F.col("_no") == 1, "promoted").otherwise("already_promoted"))).drop("_reason", "_no")
