"""Sequence files as DataFrames: FASTA, FASTA in ZIP, GenBank. Records are cut by the text reader itself, so large files are split."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _header(record):
    return F.regexp_replace(F.split_part(record, F.lit("\n"), F.lit(1)), r"\r$", "")


def _body(record):
    return F.upper(F.regexp_replace(F.regexp_replace(record, r"^[^\n]*", ""), r"\s", ""))


def fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, record_id, description, sequence) of FASTA files, gzipped ones too.

    The id is the first word after '>', the sequence is upper case. Text before
    the first '>' and empty files give no records. Bytes that are not UTF-8 are
    replaced.
    """
    rows = spark.read.option("lineSep", "\n>").text(paths).select(F.col("_metadata.file_name").alias("source_file"), "value")
    # only a file's first record still has its own '>'; a later one begins right after the separator
    starts = rows.withColumn("first", F.regexp_extract("value", r"^\s*>", 0) != "").withColumn("value", F.regexp_replace("value", r"^\s*>", ""))
    named = starts.filter(F.trim("value") != "").withColumn("head", _header(F.col("value")))
    return named.select("source_file", F.split_part(F.trim("head"), F.lit(" "), F.lit(1)).alias("record_id"), F.trim("head").alias("description"), _body(F.col("value")).alias("sequence"))


def fasta_in_order(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same with record_no, the record's place in its file from 0; reads each file as a whole, so for files that fit a task."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), "value")
    records = files.select("source_file", F.posexplode(F.filter(F.split("value", r"(?m)^>"), lambda r: F.trim(r) != "")).alias("record_no", "value"))
    head = F.trim(_header(F.col("value")))
    return records.select("source_file", "record_no", F.split_part(head, F.lit(" "), F.lit(1)).alias("record_id"), head.alias("description"), _body(F.col("value")).alias("sequence"))


def fasta_any(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """fasta_in_order for files that may be gzipped without saying so in their name: told by their first two bytes.

    Each file is read as a whole by one task, so this is for files that fit one.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip
        import io

        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                name = path.rsplit("/", 1)[-1]
                rows = [(name, no, *record) for no, record in enumerate(_records(io.TextIOWrapper(io.BytesIO(data), "utf-8", "replace")))]
                yield pd.DataFrame(rows, columns=["source_file", "record_no", "record_id", "sequence"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(read, "source_file string, record_no bigint, record_id string, sequence string")


def genome_records(spark: SparkSession, path: str, genome_id: str) -> DataFrame:
    """The records of one genome's file, with the genome's id as source_file; a file without records is an error."""
    records = fasta(spark, path).withColumn("source_file", F.lit(genome_id))
    if records.isEmpty():
        raise ValueError(f"no records in {path}")
    return records


#: Endings of sequence files. Fixed values.
ENDINGS = (".fasta", ".fa", ".fna", ".fasta.gz", ".fa.gz", ".fna.gz")


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, group, bytes) of the sequence files below a folder; group is the first folder below it, un_grouped for files in the folder itself. Files without bytes are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))
    known = files.filter(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + ")$"))
    base = folder.removeprefix("file://").rstrip("/") + "/"
    parts = F.split(F.regexp_replace("path", rf"^.*?\Q{base}\E", ""), "/")
    return known.select("path", F.element_at(parts, -1).alias("name"), F.when(F.size(parts) > 1, parts[0]).otherwise("un_grouped").alias("group"), "bytes").orderBy("path")


def fasta_in_zip(spark: SparkSession, path: str, member: str, only_usable: bool = False, max_records: int | None = None) -> DataFrame:
    """(record_no, record_id, sequence) of one FASTA member of ZIP files; an error names the members if it is missing.

    only_usable keeps repeats of 23 to 47 known bases or N. Reading of a file ends with the
    first kept record that is the max_records-th or a later one read.
    """

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import re
        import zipfile

        for files in batches:
            for content in files["content"]:
                archive = zipfile.ZipFile(io.BytesIO(content))
                if member not in archive.namelist():
                    raise ValueError(f"{member} is not among {archive.namelist()}")
                with archive.open(member) as f:
                    rows = []
                    for no, record in enumerate(_records(io.TextIOWrapper(f, "utf-8", "replace"))):
                        if only_usable and not re.fullmatch("[ACGTN]{23,47}", record[1]):
                            continue
                        rows.append((no, *record))
                        if max_records is not None and no + 1 >= max_records:
                            break
                        if len(rows) == 5000:
                            yield pd.DataFrame(rows, columns=["record_no", "record_id", "sequence"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["record_no", "record_id", "sequence"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "record_no bigint, record_id string, sequence string")


def _records(lines) -> Iterator[tuple[str, str]]:
    head, parts = None, []
    for line in lines:
        if line.startswith(">"):
            if head is not None:
                yield head, "".join(parts).upper()
            head, parts = (line[1:].split() or [""])[0], []
        elif head is not None:
            parts.append("".join(line.split()))
    if head is not None:
        yield head, "".join(parts).upper()


QUALIFIERS = ("product", "gene", "note", "function")


def genbank_features(spark: SparkSession, paths: str | list[str], kind: str = "CDS") -> DataFrame:
    """(source_file, accession, feature_no, text): the features of a kind, with their product, gene, note and function in lower case."""
    records = spark.read.option("lineSep", "\n//").text(paths).select(F.col("_metadata.file_name").alias("source_file"), "value")
    table = F.regexp_extract("value", r"(?s)\nFEATURES[^\n]*\n(.*?)(?:\nORIGIN|\nCONTIG|$)", 1)
    named = records.select("source_file", F.regexp_extract("value", r"(?m)^(?:ACCESSION|LOCUS)\s+(\S+)", 1).alias("accession"), table.alias("features"))
    blocks = F.filter(F.split("features", r"(?m)^ {5}(?=\S)"), lambda b: b.startswith(kind))
    each = named.filter("features <> ''").select("source_file", "accession", F.posexplode(blocks).alias("feature_no", "block"))
    values = F.expr(f"""regexp_extract_all(block, '/(?:{"|".join(QUALIFIERS)})="([^"]*)"', 1)""")
    return each.select("source_file", "accession", "feature_no", F.lower(F.regexp_replace(F.array_join(values, " "), r"\s+", " ")).alias("text"))


def keyword_counts(features: DataFrame, key: str, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per key: features, and how many of them contain any keyword of each group as a substring."""

    def any_of(words: tuple[str, ...]):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.col("text"), F.lit(w))
        return hit

    return features.groupBy(key).agg(F.count("*").alias("features"), *[F.count_if(any_of(words)).alias(f"{name}_count") for name, words in groups.items()])
