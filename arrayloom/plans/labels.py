"""Queries over the curation tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.operators import builders, curation, training
from arrayloom.runtime import table

ALLOWED = {
    "label_status": ("validated", "candidate", "challenge", "exclude_until_verified", "needs_literature_review"),
    "curation_confidence": ("high", "medium", "low", "exclude"),
}
REQUIRED = ["pair_id", "bacterium", "strain", "phage", "source_keys"]


def label_issues(spark: SparkSession, folder: str) -> DataFrame:
    return training.value_issues(table(spark, folder, "benchmark_labels"), "label_id", "pair_id", REQUIRED, ALLOWED)


def label_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark_labels").groupBy("label_status", "benchmark_split").agg(F.count("*").alias("n"))


def label_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return curation.repeated(table(spark, folder, "benchmark_labels").select("label_id", "pair_id", "label_version"), ["pair_id", "label_version"])


def label_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Labels beside the proof-of-concept pairs as evidence, scored by a rule from their id."""
    evidence = table(spark, folder, "proof_of_concept_pairs").select(
        F.col("poc_id").alias("evidence_id"), F.col("local_bacterium_file").alias("bacterium"), F.col("local_phage_file").alias("phage"), (F.col("poc_id") * 37 % 1010 / 10.0).alias("score")
    )
    return curation.evaluate_labels(table(spark, folder, "benchmark_labels"), evidence, "label_id").select(
        "label_id", "pair_id", "label_status", "expected_sabr_behavior", "evidence_id", "score", "run_match_status", "score_expectation_result"
    )


def label_evaluation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return curation.label_summary(label_evaluation(spark, folder))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of the registry's names: strain * for every tenth record, status by a rule from the id."""
    rid = F.col("record_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("exact", "strain_alias", "reference_proxy", "not_found")]), (rid % 4 + 1).cast("int"))
    bact = F.col("record_type") == "bacterium"
    name = F.when(bact, F.split_part("name", F.lit(" str. "), F.lit(1))).otherwise(F.regexp_replace("name", "^phage ", ""))
    strain = F.when(rid % 10 == 0, "*").when(bact, F.split_part("name", F.lit(" str. "), F.lit(2))).otherwise(name)
    return table(spark, folder, "downloaded_records").select(F.col("record_type").alias("entity_type"), name.alias("display_name"), strain.alias("strain_or_isolate"), status.alias("linkage_status"), "accession")


def link_coverage(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "proof_of_concept_pairs").select("poc_id", "bacterium", "strain", "phage", F.lit("bacterium").alias("b"), F.lit("phage").alias("p"))
    links = _links(spark, folder)
    exact = ("exact", "strain_alias")
    keys = {"b": "entity_type", "bacterium": "display_name"}
    rows = curation.linked(pairs, links, keys, ("strain", "strain_or_isolate"), exact, "host_exact")
    rows = curation.linked(rows, links, keys, ("strain", "strain_or_isolate"), (*exact, "reference_proxy"), "host_proxy")
    rows = curation.linked(rows, links, {"p": "entity_type", "phage": "display_name"}, ("phage", "strain_or_isolate"), exact, "phage_linked")
    e, h, p = F.col("host_exact"), F.col("host_proxy"), F.col("phage_linked")
    return rows.select("poc_id", "host_exact", "host_proxy", "phage_linked", curation.tier(e & p, h & p, h, p).alias("dataset_tier"))


def link_best(spark: SparkSession, folder: str) -> DataFrame:
    """The best registry record of each name: by status, then by id."""
    rid = F.col("record_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("exact", "strain_alias", "reference_proxy", "not_found")]), (rid % 4 + 1).cast("int"))
    links = table(spark, folder, "downloaded_records").withColumn("linkage_status", status)
    return builders.best_links(links, ["record_type", "name"], "record_id", ("exact", "strain_alias", "reference_proxy")).select("record_type", "name", "record_id", "linkage_status", "local_path")


def link_coverage_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts for all pairs and per tier, in one pass."""
    rows = link_coverage(spark, folder)
    return rows.rollup("dataset_tier").agg(F.count("*").alias("pairs"), F.count_if("host_exact").alias("hosts_exact"), F.count_if("phage_linked").alias("phages_linked")).withColumn("dataset_tier", F.coalesce("dataset_tier", F.lit("all")))


def efficiency_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Efficiency texts of many shapes, made from order lines, and how they are read."""
    v = F.col("l_discount").cast("string")
    n = F.col("l_linenumber")
    raw = (
        F.when(n == 1, v).when(n == 2, F.concat(F.lit("<"), v)).when(n == 3, F.concat(F.lit("≤ "), v)).when(n == 4, F.concat(v, F.lit("±0.02"))).when(n == 5, F.concat(v, F.lit(" - 0.5"))).when(n == 6, F.lit("n/a")).otherwise(F.concat(F.lit(">= 5e-"), F.col("l_partkey").cast("string")))
    )
    read = table(spark, folder, "lineitem").select("l_orderkey", n.alias("l_linenumber"), curation.parse_efficiency(raw).alias("e"))
    cls = curation.efficiency_class(F.col("e.relation"), F.col("e.value"))
    return read.select("l_orderkey", "l_linenumber", "e.relation", cls.alias("efficiency_class"), curation.susceptibility(cls).alias("susceptibility"))


def accession_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Accessions that labels and registry share, and those only one of them has."""
    cited = table(spark, folder, "benchmark_labels").select(F.explode(F.split("bacterial_accession", "[;,|]")).alias("a"))
    cited = cited.select(F.upper(F.regexp_replace("a", "[\\s\"']", "")).alias("accession")).filter("accession <> ''").distinct()
    known = table(spark, folder, "downloaded_records").select(F.upper(F.regexp_replace("accession", "[\\s\"']", "")).alias("accession")).filter("accession <> ''").distinct()
    parts = (("both", cited.intersect(known)), ("labels_only", cited.join(known, "accession", "left_anti")), ("registry_only", known.exceptAll(cited)))
    tagged = [df.select(F.lit(tag).alias("found_in"), "accession") for tag, df in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def registry_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per record type: records, distinct files, bases, and records that are fragmented or withdrawn."""
    return table(spark, folder, "downloaded_records").groupBy("record_type").agg(
        F.count("*").alias("records"), F.countDistinct("local_path").alias("files"), F.coalesce(F.sum("total_bp"), F.lit(0)).alias("total_bp"), F.count_if(F.col("record_count") >= 40).alias("fragmented"), F.count("withdrawn_at").alias("withdrawn")
    )


QUERIES = {f.__name__: f for f in (label_issues, label_value_counts, label_repeats, label_evaluation, label_evaluation_summary, link_coverage, link_best, link_coverage_summary, efficiency_classes, accession_sets, registry_files)}

_B = "benchmark_labels"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_ISSUES = ["CASE WHEN trim(coalesce(pair_id, '')) = '' THEN 'pair_id is empty' END", "CASE WHEN trim(coalesce(pair_id, '')) <> '' AND again > 1 THEN 'pair_id is repeated' END"]
_ISSUES += [f"CASE WHEN trim(coalesce({c}, '')) = '' THEN '{c} is empty' END" for c in REQUIRED[1:]]
_ISSUES += [f"CASE WHEN trim(coalesce({c}, '')) NOT IN {_in(v)} THEN '{c} is not allowed: ' || trim(coalesce({c}, '')) END" for c, v in ALLOWED.items()]

_EVAL = f"""ev AS (SELECT poc_id AS evidence_id, poc_id * 37 % 1010 / 10 AS score, regexp_extract(trim(local_bacterium_file), '[^/]*$') AS b, regexp_extract(trim(local_phage_file), '[^/]*$') AS p FROM proof_of_concept_pairs),
  lb AS (SELECT label_id, regexp_extract(trim(unnest(string_split(coalesce(local_bacterium_file, ''), ';'))), '[^/]*$') AS b FROM {_B}), lp AS (SELECT label_id, regexp_extract(trim(unnest(string_split(coalesce(local_phage_file, ''), ';'))), '[^/]*$') AS p FROM {_B}),
  met AS (SELECT DISTINCT label_id, evidence_id, score FROM lb JOIN lp USING (label_id) JOIN ev USING (b, p) WHERE b <> '' AND p <> ''),
  evald AS (SELECT l.label_id, pair_id, label_status, expected_sabr_behavior, evidence_id, CAST(score AS DOUBLE) AS score, CASE WHEN evidence_id IS NULL THEN 'missing_from_run' ELSE 'matched' END AS run_match_status,
    CASE WHEN score IS NULL THEN 'not_evaluated' WHEN expected_sabr_behavior = 'do_not_score' THEN 'excluded' WHEN expected_sabr_behavior = 'high_score_expected' THEN CASE WHEN score < 70 THEN 'below_expected' ELSE 'meets_expectation' END
      WHEN expected_sabr_behavior = 'moderate_score_expected' THEN CASE WHEN score < 35 THEN 'below_expected' WHEN score > 85 THEN 'above_expected' ELSE 'meets_expectation' END
      WHEN expected_sabr_behavior = 'low_score_expected' THEN CASE WHEN score > 40 THEN 'above_expected' ELSE 'meets_expectation' END WHEN expected_sabr_behavior = 'no_score_expected' THEN CASE WHEN score > 0 THEN 'above_expected' ELSE 'meets_expectation' END
      ELSE 'not_evaluated' END AS score_expectation_result FROM {_B} l LEFT JOIN met ON l.label_id = met.label_id)"""

_COVER = """names AS (SELECT *, CASE WHEN record_type = 'bacterium' THEN split_part(name, ' str. ', 1) ELSE regexp_replace(name, '^phage ', '') END AS dn FROM downloaded_records),
  links AS (SELECT record_type, dn, CASE WHEN record_id % 10 = 0 THEN '*' WHEN record_type = 'bacterium' THEN split_part(name, ' str. ', 2) ELSE dn END AS st, record_id % 4 AS k, trim(coalesce(accession, '')) <> '' AS has FROM names),
  per AS (SELECT record_type, dn, st, coalesce(bool_or(k <= 1 AND has), false) AS ex, coalesce(bool_or(k <= 2 AND has), false) AS px FROM links GROUP BY ALL),
  cov AS (SELECT poc_id, coalesce(b.ex, bs.ex, false) AS host_exact, coalesce(b.px, bs.px, false) AS host_proxy, coalesce(p.ex, ps.ex, false) AS phage_linked FROM proof_of_concept_pairs x
    LEFT JOIN per b ON b.record_type = 'bacterium' AND b.dn = x.bacterium AND b.st = x.strain AND b.st <> '*' LEFT JOIN per bs ON bs.record_type = 'bacterium' AND bs.dn = x.bacterium AND bs.st = '*'
    LEFT JOIN per p ON p.record_type = 'phage' AND p.dn = x.phage AND p.st = x.phage AND p.st <> '*' LEFT JOIN per ps ON ps.record_type = 'phage' AND ps.dn = x.phage AND ps.st = '*'),
  tiers AS (SELECT *, CASE WHEN host_exact AND phage_linked THEN 'tier1_exact_pair' WHEN host_proxy AND phage_linked THEN 'tier2_proxy_host_exact_phage' WHEN phage_linked THEN 'tier3_phage_only' WHEN host_proxy THEN 'tier4_host_only_or_proxy' ELSE 'tier5_phenotype_only' END AS dataset_tier FROM cov)"""

_CLASS = "CASE WHEN v IS NULL THEN 'not_reported' WHEN v = 0 OR (l_linenumber IN (2, 3) AND v <= 0.001) THEN 'none' WHEN v < 0.001 THEN 'trace' WHEN v < 0.1 THEN 'low' WHEN v < 0.5 THEN 'medium' ELSE 'high' END"

ORACLE = {
    "label_issues": f"SELECT label_id, issue FROM (SELECT label_id, unnest([{', '.join(_ISSUES)}]) AS issue FROM (SELECT *, row_number() OVER (PARTITION BY trim(coalesce(pair_id, '')) ORDER BY label_id) AS again FROM {_B})) WHERE issue IS NOT NULL",
    "label_value_counts": f"SELECT label_status, benchmark_split, count(*) AS n FROM {_B} GROUP BY ALL",
    "label_repeats": f"SELECT label_id, pair_id, label_version, count(*) OVER (PARTITION BY pair_id, label_version) AS copies FROM {_B} QUALIFY copies > 1",
    "label_evaluation": f"WITH {_EVAL} SELECT * FROM evald",
    "label_evaluation_summary": f"WITH {_EVAL} SELECT label_status, expected_sabr_behavior, count(pair_id) AS rows, count(*) FILTER (run_match_status = 'matched') AS matched_rows, coalesce(round_even(avg(score) * 1000.0, 0) / 1000.0, 0) AS mean_score FROM evald GROUP BY ALL",
    "link_coverage": f"WITH {_COVER} SELECT * FROM tiers",
    "link_best": """SELECT record_type, name, record_id, ['exact', 'strain_alias', 'reference_proxy', 'not_found'][record_id % 4 + 1] AS linkage_status, local_path FROM downloaded_records
      WHERE record_id % 4 < 3 AND trim(coalesce(local_path, '')) <> '' QUALIFY row_number() OVER (PARTITION BY record_type, name ORDER BY record_id % 4, record_id) = 1""",
    "link_coverage_summary": f"WITH {_COVER} SELECT coalesce(dataset_tier, 'all') AS dataset_tier, count(*) AS pairs, count(*) FILTER (host_exact) AS hosts_exact, count(*) FILTER (phage_linked) AS phages_linked FROM tiers GROUP BY ROLLUP (dataset_tier)",
    "efficiency_classes": f"""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 4 THEN CAST(l_discount AS DOUBLE) WHEN l_linenumber >= 7 THEN CAST('5e-' || l_partkey AS DOUBLE) END AS v FROM lineitem), y AS (SELECT *, {_CLASS} AS c FROM x)
      SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '=' WHEN 2 THEN '<' WHEN 3 THEN '<=' WHEN 4 THEN '=' WHEN 5 THEN 'range' WHEN 6 THEN 'not_reported' ELSE '>=' END AS relation, c AS efficiency_class,
        CASE WHEN c IN ('high', 'medium') THEN 'susceptible' WHEN c = 'low' THEN 'reduced_susceptibility' WHEN c IN ('trace', 'none') THEN 'resistant' ELSE 'unknown' END AS susceptibility FROM y""",
    "accession_sets": f"""WITH c AS (SELECT DISTINCT upper(regexp_replace(unnest(string_split_regex(bacterial_accession, '[;,|]')), '[\\s"'']', '', 'g')) AS accession FROM {_B}), k AS (SELECT DISTINCT upper(regexp_replace(accession, '[\\s"'']', '', 'g')) AS accession FROM downloaded_records WHERE accession IS NOT NULL)
      SELECT CASE WHEN c.accession IS NULL THEN 'registry_only' WHEN k.accession IS NULL THEN 'labels_only' ELSE 'both' END AS found_in, coalesce(c.accession, k.accession) AS accession FROM (SELECT * FROM c WHERE accession <> '') c FULL JOIN (SELECT * FROM k WHERE accession <> '') k ON c.accession = k.accession""",
    "registry_files": "SELECT record_type, count(*) AS records, count(DISTINCT local_path) AS files, CAST(coalesce(sum(total_bp), 0) AS BIGINT) AS total_bp, count(*) FILTER (record_count >= 40) AS fragmented, count(withdrawn_at) AS withdrawn FROM downloaded_records GROUP BY 1",
}
