"""Tables that people read: summaries of files, runs and hits, audits of a database, importances and errors of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.functions.dna import ratio, reverse_complement, rounded, sequence_hash
from arrayloom.functions.labels import feature_category, text, truthy
from arrayloom.operators import curation, metrics

#: Thresholds that are always tried. Fixed values.
THRESHOLDS = (1.0, 10.0, 25.0, 40.0, 50.0, 60.0, 75.0)
#: Stages of a run and what is said of them. Fixed values.
STAGES = ("FASTA parsing", "CRISPR array detection", "Spacer-phage matching", "Cas type classifier", "PAM analysis", "CRISPR targeting evidence scoring")


def file_summary(files: DataFrame, records: DataFrame) -> DataFrame:
    """Per file (file_name, bytes): size in MB, records and bases read from it, and whether there were any."""
    per = records.groupBy(F.col("source_file").alias("file_name")).agg(F.count("*").alias("n"), F.sum(F.length("sequence")).alias("bp"))
    status = F.when(F.col("n") > 0, "parsed").otherwise("no FASTA records found")
    return files.join(per, "file_name", "left").select(
        "file_name", rounded(F.col("bytes") / 1e6, 3).alias("size_mb"), F.coalesce("n", F.lit(0)).alias("parsed_records"), F.coalesce("bp", F.lit(0)).alias("total_bp"), status.alias("status")
    )


def run_summary(bacteria: DataFrame, phages: DataFrame) -> DataFrame:
    """(side, files, sequences) of both inputs of a run."""
    one = lambda df, side: df.agg(F.countDistinct("source_file").alias("files"), F.count("*").alias("sequences")).select(F.lit(side).alias("side"), "files", "sequences")
    return one(bacteria, "bacteria").unionByName(one(phages, "phages"))


def stage_table(done: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows) of the stages whose result is given, in the order of a run; stages without one have null."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(i).alias("stage_no"), F.lit(s).alias("stage"), "rows") for i, s in enumerate(STAGES) if (df := done.get(s)) is not None]
    spark = next(iter(done.values())).sparkSession
    every = spark.range(len(STAGES)).select(F.col("id").cast("int").alias("stage_no"), F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.col("id") + 1).cast("int")).alias("stage"))
    return every.join(reduce(DataFrame.unionByName, parts).drop("stage"), "stage_no", "left").select("stage_no", "stage", "rows")


def hit_table(hits: DataFrame) -> DataFrame:
    """hits with identity and coverage in percent, as they are shown and saved."""
    return hits.withColumns({f"{c}_percent": rounded(F.col(c) * 100, 2) for c in ("identity", "coverage")}).drop("identity", "coverage")


def saved_hits(table: DataFrame) -> DataFrame:
    """Hits from a saved all-string table: percents become fractions, numbers numbers; empty and unreadable places 0, empty optional numbers null."""
    number = lambda c: F.nanvl(text(c).try_cast("double"), F.lit(None).cast("double"))
    whole = ("start", "end", "mismatches", "alignment_length", "spacer_length")
    optional = ("pam_offset_from_protospacer", "seed_mismatches")
    read = {c: F.coalesce(number(c).cast("bigint"), F.lit(0)) for c in whole if c in table.columns}
    read |= {c: number(c).cast("bigint") for c in optional if c in table.columns}
    read |= {"cas_subtype_confidence": number("cas_subtype_confidence")} if "cas_subtype_confidence" in table.columns else {}
    read |= {c: F.coalesce(number(f"{c}_percent"), F.lit(0.0)) / 100 for c in ("identity", "coverage") if f"{c}_percent" in table.columns}
    read |= {c: F.coalesce(F.col(c), F.lit("")) for c in table.columns if c not in read and not c.endswith("_percent")}
    return table.select(*[c.alias(n) for n, c in read.items()])


def marker_line(a: Column, b: Column) -> Column:
    """A line of | where two texts agree and . where they don't, with blanks for what the longer one has more."""
    x, y = F.upper(F.coalesce(a, F.lit(""))), F.upper(F.coalesce(b, F.lit("")))
    n = F.least(F.length(x), F.length(y))
    marks = F.zip_with(F.split(F.left(x, n), ""), F.split(F.left(y, n), ""), lambda p, q: F.when(p == q, "|").otherwise("."))
    return F.rpad(F.when(n > 0, F.array_join(marks, "")).otherwise(""), F.greatest(F.length(x), F.length(y)), F.lit(" "))


def hit_context(upstream: Column, found: Column, downstream: Column) -> Column:
    """The place on the reference with what was found in brackets."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(empty(upstream), F.lit("["), empty(found), F.lit("]"), empty(downstream))


def shown_protospacer(aligned: Column, protospacer: Column, strand: Column) -> Column:
    """What an alignment shows below the spacer: the aligned text, else the protospacer, turned for the minus strand."""
    return F.when(F.coalesce(aligned, F.lit("")) != "", aligned).when(strand == "-", reverse_complement(protospacer)).otherwise(protospacer)


def feature_input(arrays: DataFrame) -> DataFrame:
    """Detected arrays as rows that features are made from; their labels are empty."""
    return arrays.select(
        "array_id", "genome_id", "contig_id", F.col("repeat_consensus").alias("repeat_sequence"), "repeat_length", F.size("spacers").alias("spacer_count"), "mean_spacer_length", F.lit("").alias("cas_type"), F.lit("").alias("cas_subtype")
    )


def training_rows(arrays: DataFrame, manifest: DataFrame) -> DataFrame:
    """Arrays of curated genomes as training rows; labels and names come from the manifest, a blank source is curated_minced.

    The manifest has genome_id, cas_type, cas_subtype, label_source and
    label_confidence; source, organism, taxonomy, assembly_level and pam_rule
    may be missing and are then empty.
    """
    has = set(manifest.columns)
    cell = lambda c: F.coalesce(F.col(c), F.lit("")) if c in has else F.lit("")
    source = F.trim(cell("source"))
    labels = manifest.select(
        "genome_id", F.when(source == "", "curated_minced").otherwise(source).alias("source"), *[cell(c).alias(c) for c in ("organism", "taxonomy", "assembly_level", "cas_type", "cas_subtype", "label_source", "label_confidence", "pam_rule")]
    )
    return arrays.join(labels, "genome_id").select(
        "source", "genome_id", "organism", "taxonomy", "assembly_level", "contig_id", F.col("start").alias("array_start"), F.col("end").alias("array_end"), F.col("repeat_consensus").alias("repeat_sequence"),
        "repeat_length", F.size("spacers").alias("spacer_count"), "mean_spacer_length", "cas_type", "cas_subtype", "label_source", "label_confidence", "pam_rule",
    )


def deduplicated(records: DataFrame, order: str) -> DataFrame:
    """Of records with equal sequence (by hash) the first one in order."""
    hashed = records.withColumn("sequence_hash", sequence_hash(F.col("sequence")))
    first = hashed.groupBy("sequence_hash").agg(F.min(order).alias(order))
    return hashed.join(first, ["sequence_hash", order], "left_semi")


def accession_conflicts(records: DataFrame, order: str) -> DataFrame:
    """Accessions with several sequences: records, different sequences, and file:id:start of the hash of each record in order."""
    named = records.filter("accession <> ''").withColumn("h", sequence_hash(F.col("sequence")))
    shown = F.concat_ws(":", "source_file", "record_id", F.left("h", F.lit(12)))
    per = named.groupBy("accession").agg(F.count("*").alias("record_count"), F.countDistinct("h").alias("distinct_sequence_hashes"), F.sort_array(F.collect_list(F.struct(order, shown.alias("s")))).alias("all"))
    return per.filter("distinct_sequence_hashes > 1").select("accession", "record_count", "distinct_sequence_hashes", F.array_join(F.transform("all", lambda x: x["s"]), "; ").alias("records"))


def coverage_summary(coverage: DataFrame, flags: list[str]) -> DataFrame:
    """Rows and set flags overall, per source and per tier, in one pass: (scope, name, rows, one column per flag)."""
    per = coverage.groupingSets([(), ("source_key",), ("dataset_tier",)], "source_key", "dataset_tier").agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(f)).alias(f) for f in flags], F.grouping_id("source_key", "dataset_tier").alias("_g")
    )
    scope = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "source").otherwise("tier")
    return per.select(scope.alias("scope"), F.coalesce(F.when(F.col("_g") == 1, F.col("source_key")).when(F.col("_g") == 2, F.col("dataset_tier")), F.lit("")).alias("name"), "rows", *flags)


def _issues(rows: DataFrame, severity: str, check: str, row: Column, detail: Column | str) -> DataFrame:
    told = F.lit(detail) if isinstance(detail, str) else detail
    return rows.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.coalesce(row.cast("string"), F.lit("")).alias("row_id"), told.alias("detail"))


def audit_interactions(table: DataFrame) -> DataFrame:
    """Classes that don't follow from their value, labels that don't follow from their class, curated rows without notes."""
    value, cls, label = text("eop_value").try_cast("double"), text("eop_class"), text("susceptibility_label")
    implied = F.transform(F.array(F.struct(text("eop_relation").alias("r"), value.alias("v"))), lambda e: curation.efficiency_class(e["r"], e["v"]))[0]
    expected = curation.susceptibility(cls)
    return reduce(
        DataFrame.unionByName,
        [
            _issues(table.filter(value.isNotNull() & (cls != implied)), "error", "eop_class_consistency", F.col("interaction_id"), F.concat(F.lit("value implies "), implied, F.lit(", found "), cls)),
            _issues(table.filter((expected != "unknown") & ~label.isin("nonhost") & (label != expected)), "warning", "susceptibility_label_consistency", F.col("interaction_id"), F.concat(cls, F.lit(" maps to "), expected, F.lit(", found "), label)),
            _issues(table.filter((text("curation_status") == "curated") & (text("notes") == "")), "warning", "curation_notes", F.col("interaction_id"), "curated row has no notes"),
        ],
    )


def audit_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Available links without a path or to a path that isn't among files (path), and targets with several exact links."""
    usable = links.filter(F.col("linkage_status").isin("exact", "strain_alias", "reference_proxy") & (text("sequence_status") == "available"))
    path = text("local_path")
    gone = usable.filter(path != "").join(files.select(F.col("path").alias("_p")).distinct(), path == F.col("_p"), "left_anti")
    keys = ["entity_type", "source_key", "display_name", "strain_or_isolate"]
    exact = links.filter(F.col("linkage_status").isin("exact", "strain_alias") & (text("accession") != ""))
    return reduce(
        DataFrame.unionByName,
        [
            _issues(usable.filter(path == ""), "error", "linkage_local_path", F.col("linkage_id"), "available link has no path"),
            _issues(gone, "error", "linkage_local_path", F.col("linkage_id"), F.concat(F.lit("no such file: "), path)),
            _issues(curation.repeated(exact, keys), "warning", "duplicate_exact_linkage_target", F.col("linkage_id"), "several exact links have this target"),
        ],
    )


def audit_downloads(downloads: DataFrame, counted: DataFrame) -> DataFrame:
    """Accessions with several rows, rows whose file isn't among counted (path, record_count, total_bp), and counts that differ from the file's."""
    repeated = curation.repeated(downloads.withColumn("_a", text("accession")), ["_a"])
    found = counted.select(F.col("path").alias("_p"), F.col("record_count").alias("_n"), F.col("total_bp").alias("_bp"))
    joined = downloads.join(found, text("local_path") == F.col("_p"), "left")
    known = joined.filter("_p is not null")
    told = lambda own, real: F.concat(F.lit(f"{own}="), F.col(own).cast("string"), F.lit(" but the file has "), F.col(real).cast("string"))
    return reduce(
        DataFrame.unionByName,
        [
            _issues(repeated, "warning", "duplicate_downloaded_accession", F.col("accession"), "accession has several rows"),
            _issues(joined.filter("_p is null"), "error", "downloaded_record_path", F.col("accession"), F.concat(F.lit("no such file: "), text("local_path"))),
            _issues(known.filter("record_count <> _n"), "error", "downloaded_record_count", F.col("accession"), told("record_count", "_n")),
            _issues(known.filter("total_bp <> _bp"), "error", "downloaded_record_bp", F.col("accession"), told("total_bp", "_bp")),
        ],
    )


def first_issues(issues: DataFrame, most: int = 20) -> DataFrame:
    """The first rows of each check by row id, at most so many."""
    order = Window.partitionBy("check").orderBy("row_id", "detail")
    return issues.withColumn("_no", F.row_number().over(order)).filter(F.col("_no") <= most).drop("_no")


def _missing(have: DataFrame, want: DataFrame, key: str, check: str, detail: str, most: int) -> DataFrame:
    """The first keys of want, by name, that have lacks."""
    return _issues(want.select(key).distinct().join(have.select(key).distinct(), key, "left_anti").orderBy(F.col(key).cast("string")).limit(most), "error", check, F.col(key), detail)


def audit_coverage(interactions: DataFrame, coverage: DataFrame, features: DataFrame, key: str = "interaction_id", most: int = 20) -> DataFrame:
    """Interactions and coverage that lack one another, another number of rows, repeated feature rows, and ready pairs and features that lack one another."""
    sizes = interactions.agg(F.count("*").alias("i")).crossJoin(coverage.agg(F.count("*").alias("c"))).filter("i <> c")
    ready = coverage.filter(truthy(F.col("pair_hybrid_ready")))
    return reduce(
        DataFrame.unionByName,
        [
            _issues(sizes, "error", "coverage_row_count", F.lit("coverage"), F.format_string("%d rows of coverage for %d interactions", "c", "i")),
            _missing(coverage, interactions, key, "coverage_missing_interaction", "missing from coverage", most),
            _missing(interactions, coverage, key, "coverage_extra_interaction", "not an interaction", most),
            _issues(curation.repeated(features.select(key), [key]), "error", "duplicate_feature_interaction", F.col(key), "feature row is repeated"),
            _missing(features, ready, key, "features_missing_hybrid_ready_row", "ready pair has no features", most),
            _missing(ready, features, key, "features_extra_row", "features of a pair that is not ready", most),
        ],
    )


def audit_promotions(links: DataFrame, assemblies: DataFrame) -> DataFrame:
    """Promoted assemblies without link, links to assemblies that weren't promoted, and such links whose notes lack the evidence."""
    promoted = assemblies.filter("review_status = 'promoted_exact_assembly'").select(F.col("assembly_accession").alias("accession")).distinct()
    linked = links.filter(F.col("linkage_id").startswith("host_assembly_") & (F.col("linkage_status") == "exact"))
    return reduce(
        DataFrame.unionByName,
        [
            _issues(promoted.join(linked, "accession", "left_anti"), "error", "promoted_assembly_missing_linkage", F.col("accession"), "promoted candidate is not linked"),
            _issues(linked.select("accession").distinct().join(promoted, "accession", "left_anti"), "error", "linked_assembly_missing_candidate", F.col("accession"), "link lacks a promoted candidate"),
            _issues(linked.filter(~F.contains(F.coalesce("notes", F.lit("")), F.lit("full genome representation"))), "warning", "promoted_assembly_evidence", F.col("linkage_id"), "notes lack the full genome"),
        ],
    )


def evaluation_issues(table: DataFrame, label: str) -> DataFrame:
    """(issue) why a table can't be evaluated: no rows, fewer than two labels, fewer than four rows."""
    per = table.agg(F.count("*").alias("n"), F.countDistinct(label).alias("k"))
    found = F.when(F.col("n") == 0, F.array(F.lit("no rows"))).otherwise(F.array_compact(F.array(F.when(F.col("k") < 2, F.lit("fewer than two labels")), F.when(F.col("n") < 4, F.lit("fewer than four rows")))))
    return per.select(F.explode(found).alias("issue"))


def split_issues(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """(issue) why a split can't be used: an empty side, one label in training, labels that only the test has."""
    sizes = train.agg(F.count("*").alias("a"), F.countDistinct(label).alias("k")).crossJoin(test.agg(F.count("*").alias("b")))
    found = F.array_compact(F.array(F.when((F.col("a") == 0) | (F.col("b") == 0), F.lit("a side has no rows")), F.when(F.col("k") < 2, F.lit("training has fewer than two labels"))))
    unseen = test.select(label).distinct().join(train.select(label).distinct(), label, "left_anti").filter(F.col(label).isNotNull())
    return sizes.select(F.explode(found).alias("issue")).unionByName(unseen.select(F.concat(F.lit("training lacks label "), F.col(label)).alias("issue")))


def score_thresholds(scores: DataFrame) -> DataFrame:
    """(threshold): the fixed ones and every different positive score to six digits."""
    own = scores.filter("score > 0").select(rounded(F.col("score"), 6).alias("threshold"))
    fixed = scores.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("threshold"))
    return own.unionByName(fixed).distinct()


def sweep(scores: DataFrame) -> DataFrame:
    """metrics of (positive, score) at every threshold of score_thresholds: rows are counted per score, then summed from above.

    The window runs over different scores, of which scores to six digits have a bounded number.
    """
    per = scores.groupBy(rounded(F.col("score"), 6).alias("score")).agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    every = per.join(score_thresholds(scores).withColumnRenamed("threshold", "score").withColumn("asked", F.lit(True)), "score", "full").fillna(0, ["p", "n"])
    above = Window.orderBy(F.desc("score"))
    everything = Window.partitionBy()
    sums = every.select("score", "asked", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"), F.sum("p").over(everything).alias("all_p"), F.sum("n").over(everything).alias("all_n")).filter("asked")
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("all_p") - tp, F.col("all_n") - fp
    f1 = lambda a, b, c: F.when(2 * a + b + c == 0, 0.0).otherwise(2 * a / (2 * a + b + c))
    return sums.select(F.col("score").alias("threshold"), "tp", "fp", fn.alias("fn"), tn.alias("tn"), ratio(tp + tn, F.col("all_p") + F.col("all_n")).alias("accuracy"), rounded((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2, 6).alias("macro_f1"))


def best_thresholds(swept: DataFrame, k: int = 10) -> DataFrame:
    return swept.orderBy(F.desc("macro_f1"), F.desc("accuracy"), "threshold").limit(k)


def category_importance(built_in: DataFrame, permuted: DataFrame) -> DataFrame:
    """(category, built_in, permutation): importances (feature, importance) summed per category of features, 0 where one side has none."""
    side = lambda df, name: df.groupBy(feature_category(F.col("feature")).alias("category")).agg(F.sum("importance").alias(name))
    return side(built_in, "built_in").join(side(permuted, "permutation"), "category", "full").fillna(0.0)


def top_features(importances: DataFrame, most: int, wanted: list[str]) -> DataFrame:
    """The most important features, and those wanted that aren't among them."""
    top = importances.orderBy(F.desc("importance"), "feature").limit(most)
    return top.unionByName(importances.filter(F.col("feature").isin(wanted)).join(top.select("feature"), "feature", "left_anti").select(*top.columns))


def group_summary(rows: DataFrame, groups: dict[str, Column], measures: list[str]) -> DataFrame:
    """(group, feature, row_count, mean, median) of measures in the rows of each predicate; an empty group has zeros."""
    spark = rows.sparkSession
    tagged = rows.select(F.explode(F.array_compact(F.array(*[F.when(p, F.lit(g)) for g, p in groups.items()]))).alias("group"), F.explode(F.array(*[F.struct(F.lit(m).alias("feature"), F.col(m).cast("double").alias("value")) for m in measures])).alias("x"))
    per = tagged.groupBy("group", "x.feature").agg(F.count("*").alias("row_count"), F.avg("x.value").alias("mean"), F.median("x.value").alias("median"))
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in groups])).alias("group")).select("group", F.explode(F.array(*[F.lit(m) for m in measures])).alias("feature"))
    joined = grid.join(per, ["group", "feature"], "left").fillna(0, ["row_count"]).fillna(0.0, ["mean", "median"])
    return joined.select("group", "feature", "row_count", rounded(F.col("mean"), 6).alias("mean"), rounded(F.col("median"), 6).alias("median"))


def averaged_auc(scores: DataFrame) -> DataFrame:
    """(average, auc): micro over all labels' rows together, macro as the mean over the labels that have both kinds of rows."""
    micro = metrics.one_versus_rest_auc(scores.withColumn("label", F.lit("all"))).select(F.lit("micro").alias("average"), "auc")
    return micro.unionByName(metrics.one_versus_rest_auc(scores).agg(F.avg("auc").alias("auc")).select(F.lit("macro").alias("average"), "auc"))


def score_pivot(rows: DataFrame, row: str, column: str, values: list[str], score: str) -> DataFrame:
    """Scores with columns as values, each column scaled to 0 to 1; missing scores are 0, as is a column whose scores are all one."""
    wide = rows.groupBy(row).pivot(column, values).agg(F.max(score)).fillna(0.0)
    ends = wide.agg(*[F.min(F.col(f"`{v}`")).alias(f"_low_{v}") for v in values], *[F.max(F.col(f"`{v}`")).alias(f"_high_{v}") for v in values])
    low, high = (lambda v: F.col(f"`_low_{v}`")), (lambda v: F.col(f"`_high_{v}`"))
    return wide.crossJoin(F.broadcast(ends)).select(row, *[F.when(high(v) == low(v), 0.0).otherwise(rounded((F.col(f"`{v}`") - low(v)) / (high(v) - low(v)), 6)).alias(v) for v in values])


def described(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, count, mean, std, min, q25, q50, q75, max, nonzero) of number columns; nulls don't count."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("x")).filter("x.v is not null")
    q = [F.percentile("x.v", p).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    per = each.groupBy("x.feature").agg(F.count("*").alias("count"), F.avg("x.v").alias("mean"), F.stddev_samp("x.v").alias("std"), F.min("x.v").alias("min"), *q, F.max("x.v").alias("max"), F.count_if(F.col("x.v") != 0).alias("nonzero"))
    return per.withColumns({c: rounded(F.col(c), 6) for c in ("mean", "std", "q25", "q50", "q75")})


def stratified(rows: DataFrame, label: str, row: str, most: int, seed: int = 7) -> DataFrame:
    """At most so many rows of each label, those that come first by a digest."""
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), F.col(row)), row)
    return rows.withColumn("_no", F.row_number().over(order)).filter(F.col("_no") <= most).drop("_no")


def legacy_score(unique_spacers: Column) -> Column:
    """A stand-in for the score of runs that saved only their unique spacers."""
    return F.when(unique_spacers >= 3, 75.0).when(unique_spacers == 2, 55.0).when(unique_spacers == 1, 35.0).otherwise(0.0)


def looks_complete(title: Column, length: Column) -> Column:
    """Whether a sequence record's title and length are those of a complete genome and of no assembly in parts."""
    said = F.lower(F.coalesce(title, F.lit("")))
    has = lambda words: reduce(Column.__or__, [F.contains(said, F.lit(w)) for w in words])
    # fixed values
    parts = ("shotgun", "project", "mag:", "tpa_asm", "assembly", "scaffold")
    whole = ("complete genome", "complete sequence", "chromosome, complete")
    return F.coalesce(length, F.lit(0)).between(100_000, 10_000_000) & ~has(parts) & has(whole)


def longest_records(records: DataFrame, least: int, most: int | None, order: str) -> DataFrame:
    """Records of at least so many bases, the longest first; at most so many, of equal length those first in order."""
    long = records.filter(F.length("sequence") >= least).orderBy(F.desc(F.length("sequence")), order)
    return long if most is None else long.limit(most)


def refuse_fragmented(records: DataFrame, most: int = 5000) -> None:
    """An error if a file has so many records that array detection would look at fragments only."""
    over = records.groupBy("source_file").agg(F.count("*").alias("n")).filter(F.col("n") >= most).orderBy("source_file").limit(20).collect()
    if over:
        raise ValueError("too many records for detection: " + ", ".join(f"{r.source_file} ({r.n})" for r in over))
