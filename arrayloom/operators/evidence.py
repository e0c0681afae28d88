"""From annotated hits to scored pairs of bacterium and phage. Scores sum up evidence; they are no resistance calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.functions.dna import rounded
from arrayloom.operators.pam import CURATED_RULES, seed_side, with_evaluation
from arrayloom.operators.matching import seed_mismatches

#: Names of the evidence levels, from their least score down. Fixed values.
LEVELS = ((75.0, "strong candidate CRISPR targeting evidence"), (50.0, "moderate candidate CRISPR targeting evidence"))
WEAK, NONE = "weak candidate CRISPR targeting evidence", "no spacer-match evidence"
MIN_CONFIDENCE = 0.9


def annotate(hits: DataFrame, predictions: DataFrame, default_rule: str = "", bacterium_rules: DataFrame | None = None) -> DataFrame:
    """hits (with flanks, spacer and array_id) with predicted subtype, PAM rule, its evaluation and the seed's mismatches.

    predictions: array_id, cas_subtype, confidence, and optionally override_rule;
    bacterium_rules: bacterium, rule. A rule comes from the array's override
    first, then from the bacterium's, then from the curated catalog if the
    prediction is sure enough, then from the default; rule_source says which.
    """
    override = F.col("override_rule") if "override_rule" in predictions.columns else F.lit(None).cast("string")
    dims = predictions.select("array_id", "cas_subtype", "confidence", F.nullif(F.trim(override), F.lit("")).alias("override"))
    hits = hits.withColumn("own_rule", F.lit(None).cast("string"))
    if bacterium_rules is not None:
        own = bacterium_rules.groupBy("bacterium").agg(F.min(F.nullif(F.trim("rule"), F.lit(""))).alias("own_rule"))
        hits = hits.drop("own_rule").join(own, "bacterium", "left")
    return _evaluated(_with_rule(hits.join(dims, "array_id", "left"), default_rule))


def _with_rule(rows: DataFrame, default_rule: str = "") -> DataFrame:
    """rows (override, own_rule, cas_subtype, confidence) with pam_rule and pam_rule_source."""
    catalog = F.create_map(*[F.lit(x) for pair in CURATED_RULES.items() for x in pair])
    curated = F.when(F.col("confidence") >= MIN_CONFIDENCE, catalog[F.col("cas_subtype")])
    fallback = F.lit(default_rule or None).cast("string")
    source = (
        F.when(F.col("override").isNotNull(), "array_override")
        .when(F.col("own_rule").isNotNull(), "bacterium_override")
        .when(curated.isNotNull(), "curated_subtype_catalog")
        .when(fallback.isNotNull(), "manual_default")
        .when(F.col("cas_subtype").isNull(), "not_available")
        .when(F.col("confidence") < MIN_CONFIDENCE, "subtype_confidence_below_threshold")
        .otherwise("no_curated_rule")
    )
    return rows.withColumn("pam_rule", F.coalesce("override", "own_rule", curated, fallback)).withColumn("pam_rule_source", source).drop("override", "own_rule")


def _evaluated(ruled: DataFrame) -> DataFrame:
    """ruled (pam_rule, flanks, spacer, protospacer) with the rule's evaluation and the seed's mismatches."""
    judged = with_evaluation(ruled, F.col("pam_rule"), "flank_5p", "flank_3p", "genomic_upstream", "genomic_downstream")
    seeded = judged.withColumn("seed", seed_mismatches(F.col("spacer"), F.col("protospacer"), F.coalesce(seed_side(F.col("pam_rule")), F.lit(""))))
    return seeded.select(
        *[c for c in seeded.columns if c not in ("pam", "seed")],
        "pam.pam_sequence", "pam.pam_match", F.col("pam.support").alias("pam_support_level"), F.col("pam.score").alias("pam_compatibility_score"), F.col("pam.offset").alias("pam_offset"),
        F.col("seed.region").alias("seed_region"), F.col("seed.length").alias("seed_length"), F.col("seed.mismatches").alias("seed_mismatches"), F.col("seed.positions").alias("seed_mismatch_positions"),
    )


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _spacers(n: Column) -> Column:
    return F.least(F.lit(35.0), F.log2(n + 1) * 18.0)


def _sure(confidence: Column) -> Column:
    return F.when(confidence.isNull(), 0.0).otherwise(_clamp(confidence * 10.0, 0.0, 10.0))


def _seed(best: Column, supported: Column) -> Column:
    return F.when(~supported | best.isNull(), 0.0).when(best == 0, 10.0).when(best <= 2, 5.0).otherwise(-5.0)


def targeting_score(n: Column, identity: Column, coverage: Column, supported: Column, evaluated: Column, seed: Column, confidence: Column) -> Column:
    """0 to 100: number of spacers, identity, PAM support, seed, subtype confidence; capped at 39 if evaluated PAMs are all unsupported."""
    pam = F.when(supported > 0, 20.0).when(evaluated > 0, -25.0).otherwise(0.0)
    raw = _spacers(n) + _clamp(identity * coverage * 25.0, 0.0, 25.0) + pam + _seed(seed, supported > 0) + _sure(confidence)
    cap = F.when((supported == 0) & (evaluated > 0), 39.0).otherwise(100.0)
    return rounded(F.least(cap, F.greatest(F.lit(0.0), raw)), 2)


def weighted_score(n: Column, identity: Column, coverage: Column, best: Column, mean: Column, seed: Column, confidence: Column) -> Column:
    """The same with PAM compatibility as a number from 0 to 1."""
    pam = F.coalesce(rounded(20.0 * best + 10.0 * mean - 15.0, 6), F.lit(0.0))
    raw = _spacers(n) + _clamp(identity * coverage * 25.0, 0.0, 25.0) + pam + _seed(seed, F.coalesce(best >= 1.0, F.lit(False))) + _sure(confidence)
    cap = F.when(best.isNull() | (best >= 1.0), 100.0).when(best >= 0.75, 70.0).when(best >= 0.5, 55.0).otherwise(39.0)
    return rounded(F.least(cap, F.greatest(F.lit(0.0), raw)), 2)


def level(score: Column) -> Column:
    out = F.when(score > 0, WEAK).otherwise(NONE)
    for least, name in reversed(LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def pair_evidence(hits: DataFrame) -> DataFrame:
    """One row per bacterium and phage that have hits, with counts, bests, scores and level."""
    counted = hits.groupBy("bacterium", "phage").agg(
        F.count("*").alias("spacer_hits"),
        F.countDistinct("spacer_id").alias("unique_matching_spacers"),
        F.max("identity").alias("_identity"),
        F.max("coverage").alias("_coverage"),
        F.count_if(F.col("pam_match")).alias("pam_supported_hits"),
        F.count("pam_match").alias("pam_evaluated_hits"),
        F.max("pam_compatibility_score").alias("_best"),
        # whole millionths, so that the mean does not depend on the order of hits
        (F.sum(F.rint(F.col("pam_compatibility_score") * 1e6).cast("bigint")) / (F.count("pam_compatibility_score") * 1e6)).alias("_mean"),
        F.count("seed_mismatches").alias("seed_evaluated_hits"),
        F.min("seed_mismatches").alias("best_seed_mismatches"),
        F.max("confidence").alias("_confidence"),
        F.bool_or(F.col("pam_support_level") == "insufficient_flank").alias("_short"),
        F.bool_or(F.col("pam_support_level") == "invalid_rule").alias("_invalid"),
    )
    return _scored(counted)


def pair_evidence_of_texts(places: DataFrame, spacers: DataFrame, default_rule: str = "") -> DataFrame:
    """pair_evidence without a row per hit: places of texts are judged once per rule and counted for all spacers that have the text.

    places: own (a spacer's text in upper case), phage, protospacer and flanks;
    spacers: spacer_id (of one row each), own, bacterium, cas_subtype and
    confidence. Hits are exact, their identity and coverage 1.
    """
    null = F.lit(None).cast("string")
    ruled = _with_rule(spacers.withColumns({"override": null, "own_rule": null}), default_rule)
    key = ["own", "rule"]
    groups = ruled.groupBy("own", F.coalesce("pam_rule", F.lit("")).alias("rule"), "bacterium").agg(F.count("*").alias("_n"), F.max("confidence").alias("_sure"))
    judged = _evaluated(places.join(groups.select(*key).distinct(), "own").withColumns({"pam_rule": F.nullif("rule", F.lit("")), "spacer": F.col("own")}))
    per_text = judged.groupBy(*key, "phage").agg(
        F.count("*").alias("_hits"),
        F.count_if(F.col("pam_match")).alias("_supported"),
        F.count("pam_match").alias("_judged"),
        F.max("pam_compatibility_score").alias("_top"),
        F.sum(F.rint(F.col("pam_compatibility_score") * 1e6).cast("bigint")).alias("_sum"),
        F.count("pam_compatibility_score").alias("_scores"),
        F.count("seed_mismatches").alias("_seeds"),
        F.min("seed_mismatches").alias("_seed"),
        F.bool_or(F.col("pam_support_level") == "insufficient_flank").alias("_short"),
        F.bool_or(F.col("pam_support_level") == "invalid_rule").alias("_invalid"),
    )
    n = F.col("_n")
    counted = per_text.join(groups, key).groupBy("bacterium", "phage").agg(
        F.sum(n * F.col("_hits")).alias("spacer_hits"),
        F.sum(n).alias("unique_matching_spacers"),
        F.lit(1.0).alias("_identity"),
        F.lit(1.0).alias("_coverage"),
        F.sum(n * F.col("_supported")).alias("pam_supported_hits"),
        F.sum(n * F.col("_judged")).alias("pam_evaluated_hits"),
        F.max("_top").alias("_best"),
        (F.sum(n * F.col("_sum")) / F.nullif(F.sum(n * F.col("_scores")) * 1e6, F.lit(0.0))).alias("_mean"),
        F.sum(n * F.col("_seeds")).alias("seed_evaluated_hits"),
        F.min("_seed").alias("best_seed_mismatches"),
        F.max("_sure").alias("_confidence"),
        F.bool_or("_short").alias("_short"),
        F.bool_or("_invalid").alias("_invalid"),
    )
    return _scored(counted)


def _scored(counted: DataFrame) -> DataFrame:
    """Pairs with their scores and level, from counts and bests."""
    n, i, c, s, v = (F.col(x) for x in ("unique_matching_spacers", "_identity", "_coverage", "pam_supported_hits", "pam_evaluated_hits"))
    support = F.when(s > 0, "compatible").when(v > 0, "not_supported").when(F.col("_short"), "insufficient_flank").when(F.col("_invalid"), "invalid_rule").otherwise("not_evaluated")
    score = targeting_score(n, i, c, s, v, F.col("best_seed_mismatches"), F.col("_confidence"))
    return counted.select(
        "bacterium", "phage", score.alias("crispr_targeting_score"),
        weighted_score(n, i, c, F.col("_best"), F.col("_mean"), F.col("best_seed_mismatches"), F.col("_confidence")).alias("experimental_pam_weighted_score"),
        "spacer_hits", "unique_matching_spacers", rounded(i * 100, 2).alias("best_identity_percent"), rounded(c * 100, 2).alias("best_coverage_percent"),
        "pam_supported_hits", "pam_evaluated_hits", support.alias("pam_support_level"), rounded(F.col("_best"), 6).alias("best_pam_compatibility_score"),
        rounded(F.col("_mean"), 6).alias("mean_pam_compatibility_score"), "seed_evaluated_hits", "best_seed_mismatches", level(score).alias("current_evidence_level"),
    )


def evidence_matrix(hits: DataFrame, bacteria: DataFrame, phages: DataFrame) -> DataFrame:
    """pair_evidence for every bacterium and phage file; pairs without hits have counts and scores of 0.

    The result is a full grid by definition; use pair_evidence for the pairs
    with hits alone.
    """
    grid = bacteria.select("bacterium").distinct().crossJoin(phages.select("phage").distinct())
    full = grid.join(pair_evidence(hits), ["bacterium", "phage"], "left")
    counts = ["spacer_hits", "unique_matching_spacers", "pam_supported_hits", "pam_evaluated_hits", "seed_evaluated_hits"]
    scores = ["crispr_targeting_score", "experimental_pam_weighted_score", "best_identity_percent", "best_coverage_percent"]
    return full.fillna(0, counts).fillna(0.0, scores).fillna({"pam_support_level": "not_applicable", "current_evidence_level": NONE})


def heatmap(matrix: DataFrame, phages: list[str]) -> DataFrame:
    """Unique spacers with phages as columns, 0 where there are none."""
    return matrix.groupBy("bacterium").pivot("phage", phages).agg(F.first("unique_matching_spacers")).fillna(0)


def top_pairs(matrix: DataFrame, k: int = 10) -> DataFrame:
    order = [F.desc("crispr_targeting_score"), F.desc("unique_matching_spacers"), F.desc("spacer_hits"), "bacterium", "phage"]
    return matrix.filter("unique_matching_spacers > 0").orderBy(*order).limit(k)


def subtype_support(hits: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Per array: for which subtypes' rules its hits' flanks speak, and whether that agrees with the predicted subtype.

    hits need hit_no, an order of hits, by which the first prediction is taken.
    """
    rules = rules or CURATED_RULES
    counts = _rule_counts(hits, "array_id", rules)
    first = hits.groupBy("array_id").agg(
        F.min_by("cas_subtype", F.when(F.coalesce("cas_subtype", F.lit("")) != "", F.col("hit_no"))).alias("predicted"),
        F.min_by("confidence", F.when(F.col("confidence").isNotNull(), F.col("hit_no"))).alias("confidence"),
    )
    return _agreement(first.join(counts, "array_id"), rules)


def subtype_support_of_texts(places: DataFrame, spacers: DataFrame, predictions: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """subtype_support without a row per hit: places of texts (own, flanks) are judged once and summed for the arrays of spacers (array_id, own).

    predictions: array_id (of one row each), cas_subtype, confidence.
    """
    rules = rules or CURATED_RULES
    per_text = _rule_counts(places, "own", rules)
    counts = spacers.select("array_id", "own").join(per_text, "own").groupBy("array_id").agg(*[F.sum(c).alias(c) for c in per_text.columns if c != "own"])
    said = predictions.select("array_id", F.nullif("cas_subtype", F.lit("")).alias("predicted"), "confidence")
    return _agreement(counts.join(said, "array_id", "left"), rules)


def _rule_counts(hits: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Per key: spacer_hit_count, and for each of the rules in order the number of hits (_0, _1, ...) whose flanks fit it."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(v).alias("rule")) for i, v in enumerate(rules.values())])).alias("r")
    tried = hits.select(key, "flank_5p", "flank_3p", "genomic_upstream", "genomic_downstream", each)
    judged = with_evaluation(tried, F.col("r.rule"), "flank_5p", "flank_3p", "genomic_upstream", "genomic_downstream")
    fits = [F.count_if((F.col("r.no") == i) & F.col("pam.pam_match")).alias(f"_{i}") for i in range(len(rules))]
    return judged.groupBy(key).agg(F.count_if(F.col("r.no") == 0).alias("spacer_hit_count"), *fits)


def _agreement(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rows (array_id, predicted, confidence and the counts of _rule_counts) with what they say of the prediction."""
    all_of = F.array(*[F.struct((-F.col(f"_{i}")).alias("minus"), F.lit(k).alias("subtype"), F.col(f"_{i}").alias("n")) for i, k in enumerate(rules)])
    joined = rows.withColumn("all", F.sort_array(F.filter(all_of, lambda x: x["n"] > 0))).withColumn("own", F.get(F.filter("all", lambda x: x["subtype"] == F.col("predicted")), F.lit(0))["n"])
    top, top_n, own = F.get("all", F.lit(0))["subtype"], F.coalesce(F.get("all", F.lit(0))["n"], F.lit(0)), F.coalesce("own", F.lit(0))
    agreement = (
        F.when(top.isNull(), "no_pam_subtype_support")
        .when(F.col("predicted").isNull(), "no_repeat_subtype_prediction")
        .when(own <= 0, "repeat_prediction_not_pam_supported")
        .when(F.col("predicted") == top, "agrees_top_subtype")
        .when(own == top_n, "agrees_tied_subtype")
        .otherwise("conflicts_with_top_subtype")
    )
    return joined.select(
        "array_id", "spacer_hit_count", F.coalesce("predicted", F.lit("")).alias("repeat_predicted_cas_subtype"), F.col("confidence").alias("repeat_prediction_confidence"),
        F.coalesce(top, F.lit("")).alias("top_pam_supported_subtype"), top_n.alias("top_pam_support_count"), own.alias("repeat_predicted_subtype_pam_support_count"),
        F.array_join(F.transform("all", lambda x: x["subtype"]), ";").alias("pam_supported_subtypes"), agreement.alias("repeat_pam_subtype_agreement"),
    )


def targeting_features(hits: DataFrame) -> DataFrame:
    """Per pair: counts and bests of bounded-mismatch hits and the graded interference score."""
    seed, mm, ident = F.col("edge_mismatches"), F.col("mismatches"), F.col("identity")
    out = hits.groupBy("bacterium", "phage").agg(
        F.count("*").alias("fuzzy_spacer_candidate_count"),
        F.countDistinct("spacer_id").alias("fuzzy_unique_spacers"),
        F.countDistinct("phage_contig").alias("fuzzy_targeted_phage_contig_count"),
        F.max(ident).alias("best_fuzzy_spacer_identity"),
        F.min(mm).alias("best_fuzzy_spacer_mismatches"),
        F.min(seed).alias("best_fuzzy_seed_edge_mismatches"),
        F.min_by("distal_mismatches", F.struct(seed, mm, (-ident).alias("i"), F.col("distal_mismatches").alias("d"))).alias("best_fuzzy_distal_mismatches"),
        F.count_if(seed == 0).alias("fuzzy_seed_perfect_hit_count"),
        F.count_if(mm <= 2).alias("fuzzy_near_perfect_hit_count"),
        F.count_if((ident >= 0.9) & (seed == 0) & (mm <= 3)).alias("fuzzy_high_confidence_hit_count"),
    )
    best_seed = F.col("best_fuzzy_seed_edge_mismatches")
    score = (
        F.col("best_fuzzy_spacer_identity") * 35.0
        + F.when(best_seed == 0, 25.0).otherwise(F.greatest(F.lit(0.0), 15.0 - best_seed * 5.0))
        + F.greatest(F.lit(0.0), 20.0 - F.col("best_fuzzy_spacer_mismatches") * 4.0)
        + F.least(F.lit(20.0), F.log2(F.col("fuzzy_unique_spacers") + 1) * 10.0)
    )
    return out.withColumn("graded_crispr_interference_score", rounded(_clamp(score, 0.0, 100.0), 2))
