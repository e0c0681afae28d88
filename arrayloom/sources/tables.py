"""Tables in text files: all-string TSV, manifests, aligner output, array reports, SQL dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def strings(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table with a header whose columns are all strings; missing values are empty strings."""
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    return df.fillna("")


def manifest(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A comma- or (.tsv, .tab) tab-separated table that must have the required columns."""
    df = strings(spark, path, "\t" if path.endswith((".tsv", ".tab")) else ",")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


TRAINING = (
    "source string, genome_id string, organism string, taxonomy string, assembly_level string, contig_id string, array_start bigint, array_end bigint, repeat_sequence string, repeat_length int, spacer_count int, "
    "mean_spacer_length double, cas_type string, cas_subtype string, label_source string, label_confidence string, pam_rule string"
)


def training_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of labelled repeats in its types; rows that don't pass the checks are an error that names the first ones."""
    from arrayloom.operators.training import repeat_issues

    rows = typed(spark, path, TRAINING).withColumn("row_id", F.monotonically_increasing_id())
    found = repeat_issues(rows).orderBy("row_id").limit(10).collect()
    if found:
        raise ValueError("; ".join(f"row {r.row_id}: {r.issue}" for r in found))
    return rows.drop("row_id")


def caller_tables(spark: SparkSession, manifest: DataFrame, root: str, name: str = "CRISPR_Cas.tab", fallback: str = "crisprs_all.tab") -> DataFrame:
    """The array calls of every genome of a manifest (genome_id, and cas_subtype for the fallback), all strings, with genome_id and found_in.

    Each genome has a folder below root. Where it lacks the first table the
    second is read, whose arrays take the genome's expected subtype; a genome
    with neither is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tab").load(root)
    known = files.select("path", F.element_at(F.split("path", "/"), -2).alias("genome_id"), F.element_at(F.split("path", "/"), -1).alias("file")).filter(F.col("file").isin(name, fallback))
    best = manifest.join(known.groupBy("genome_id").agg(F.min_by(F.struct("path", "file"), (F.col("file") != name).cast("int")).alias("f")), "genome_id", "left")
    gone = [r[0] for r in best.filter("f is null").select("genome_id").orderBy("genome_id").limit(20).collect()]
    if gone:
        raise FileNotFoundError("no calls for " + ", ".join(gone))
    parts = []
    for file, found_in in ((name, "near_cas"), (fallback, "all_arrays")):
        mine = best.filter(F.col("f.file") == file)
        paths = [r[0] for r in mine.select("f.path").collect()]  # one path per genome of the manifest
        if paths:
            rows = strings(spark, paths).withColumn("_path", F.col("_metadata.file_path"))
            keyed = rows.join(mine.select(F.element_at(F.split("f.path", "/"), -2).alias("_g"), *[c for c in mine.columns if c in ("genome_id", "cas_subtype")]), F.element_at(F.split("_path", "/"), -2) == F.col("_g")).drop("_g", "_path")
            if found_in == "all_arrays" and "cas_subtype" in keyed.columns:
                keyed = keyed.drop("Subtype").withColumnRenamed("cas_subtype", "Subtype")
            parts.append(keyed.drop("cas_subtype").withColumn("found_in", F.lit(found_in)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


ALIGNED = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart bigint, send bigint, evalue double, bitscore double, x string, y string"


def alignments(spark: SparkSession, path: str, spacers: DataFrame, min_identity: float = 0.9, min_coverage: float = 0.95) -> DataFrame:
    """Tabular aligner output with 13 or 14 columns as hits on spacers (spacer_id, spacer), filtered by identity and coverage."""
    rows = spark.read.schema(ALIGNED).option("sep", "\t").option("comment", "#").csv(path)
    joined = rows.join(spacers.select(F.col("spacer_id").alias("qseqid"), F.length("spacer").alias("n")), "qseqid")
    identity, coverage = F.col("pident") / 100, F.col("length") / F.col("n")
    minus = F.col("sstart") > F.col("send")
    return joined.withColumn("identity", identity).withColumn("coverage", coverage).filter((F.col("identity") >= min_identity) & (F.col("coverage") >= min_coverage)).select(
        F.col("qseqid").alias("spacer_id"), F.col("sseqid").alias("phage_contig"), F.when(minus, "-").otherwise("+").alias("strand"), F.least("sstart", "send").alias("start"), F.greatest("sstart", "send").alias("end"),
        "identity", "coverage", "mismatch", "evalue", "bitscore", F.when(F.col("y").isNotNull(), F.col("x")).alias("aligned_spacer"), F.coalesce("y", "x").alias("aligned_protospacer"),
    )


def array_report(spark: SparkSession, path: str) -> DataFrame:
    """(contig_id, array_no, start, end, repeat, spacers) of array reports: Sequence 'x' ..., CRISPR n Range: a - b, rows of position, repeat and spacer."""
    files = spark.read.text(path, wholetext=True)
    parts = files.select(F.explode(F.expr(r"split(value, '(?m)^Sequence ')")).alias("s")).filter(F.col("s").startswith("'"))
    arrays = parts.select(F.regexp_extract("s", "^'([^']*)'", 1).alias("contig_id"), F.explode(F.expr(r"split(s, '(?m)^CRISPR ')")).alias("a")).filter(F.col("a").rlike(r"^\d+\s+Range:"))
    lines = F.filter(F.split("a", "\n"), lambda x: x.rlike(r"^\d+\s+[ACGTNacgtn]+"))
    repeats = F.transform(lines, lambda x: F.regexp_extract(x, r"^\d+\s+([A-Za-z]+)", 1))
    spacers = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^\d+\s+[A-Za-z]+\s+([A-Za-z]+)", 1)), lambda x: x != "")
    counted = arrays.select("contig_id", "a", repeats.alias("repeats"), spacers.alias("spacers"))
    often = F.array_max(F.transform("repeats", lambda r: F.struct(F.size(F.filter("repeats", lambda x: x == r)).alias("n"), r.alias("r"))))
    return counted.select(
        "contig_id", F.regexp_extract("a", r"^(\d+)", 1).cast("int").alias("array_no"), F.regexp_extract("a", r"Range:\s*(\d+)", 1).cast("bigint").alias("start"), F.regexp_extract("a", r"Range:\s*\d+\s*-\s*(\d+)", 1).cast("bigint").alias("end"),
        often["r"].alias("repeat"), "spacers",
    )


def sql_dump(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of one table's COPY block in a plain SQL dump, as strings; \\N becomes the empty string.

    The dump is read by lines, so a block of any size is read by many tasks:
    only the places where blocks begin and end, which are few, are collected,
    and a line belongs to the table if it lies between. An unknown table or a
    row with another number of columns is an error.
    """
    # the text reader numbers nothing, so a line's place is its partition and its number within it
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    edges = rows.filter(F.col("value").startswith("COPY ") | (F.col("value") == "\\.")).orderBy("at").collect()
    starts = [i for i, r in enumerate(edges) if r["value"].startswith(f"COPY public.{table} (")]
    if not starts:
        raise ValueError(f"no COPY block for {table}")
    first = edges[starts[0]]
    last = edges[starts[0] + 1]["at"] if starts[0] + 1 < len(edges) else (1 << 63) - 1
    columns = [c.strip().strip('"') for c in first["value"].split("(", 1)[1].split(")", 1)[0].split(",")]
    lines = rows.filter((F.col("at") > first["at"]) & (F.col("at") < last) & (F.col("value") != "")).select(F.col("value").alias("line"))
    cells = lines.select(F.split("line", "\t").alias("c"))
    checked = cells.select(F.when(F.size("c") == len(columns), F.col("c")).otherwise(F.raise_error(F.lit(f"{table}: a row has another number of columns than {len(columns)}"))).alias("c"))
    read = [F.regexp_replace(F.when(F.col("c")[i] == "\\N", "").otherwise(F.col("c")[i]), r"\\n", "").alias(name) for i, name in enumerate(columns)]
    return checked.select(*read)


def filled_down(rows: DataFrame, column: str, order: str, group: list[str]) -> DataFrame:
    """Section headers carried down: nulls take the last value before them in the order of their group."""
    from pyspark.sql import Window

    return rows.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(*group).orderBy(order)))
