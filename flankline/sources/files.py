"""Readers of sequence, feature, taxonomy and hit files. All read through Spark, so any file system will do."""

from __future__ import annotations

import sqlite3
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flankline.functions.scalars import attributes, first_filled, list_cell
from flankline.sources.formats import BrokenInput, MissingInput

GFF = "seqid string, source string, type string, start string, end string, score string, strand string, phase string, attributes string"
DIAMOND = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qcovhsp double, scovhsp double"


def given(spark: SparkSession, path: str) -> str:
    """``path``, if there is something at it that is not empty."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if not found:
        raise MissingInput(f"missing input: {path}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not any(fs.getContentSummary(s.getPath()).getLength() for s in found):
        raise BrokenInput(f"empty input: {path}")
    return path


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, description, sequence); records are cut at ``>`` at a line's start, so large files split between tasks.
    Gzip files are read by the codec. The description includes the accession; an empty record is an error."""
    records = spark.read.option("lineSep", "\n>").text(given(spark, path)).where(F.trim("value") != "")
    body = F.regexp_replace("value", "^>", "")
    head = F.trim(F.substring_index(body, "\n", 1))
    sequence = F.when(F.instr(body, "\n") > 0, F.regexp_replace(F.substr(body, F.instr(body, "\n") + 1), r"\s", "")).otherwise("")
    checked = F.when(sequence == "", F.raise_error(F.concat(F.lit("empty FASTA record: "), head)).cast("string")).otherwise(sequence)
    return records.select(F.regexp_extract(head, r"^(\S+)", 1).alias("accession"), head.alias("description"), checked.alias("sequence"))


def write_fasta(rows: DataFrame, path: str, accession: str, sequence: str, wrap: int | None = None) -> None:
    """One file for each task; ``*`` is stripped, empty sequences are skipped."""
    plain = F.replace(F.col(sequence), F.lit("*"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(plain, f"(.{{{wrap}}})", "$1\n"), "\n$", "") if wrap else plain
    rows.where(plain != "").select(F.concat(F.lit(">"), accession, F.lit("\n"), text).alias("value")).write.text(path)


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 rows with typed columns and an attribute map. The first line must be the version; nine fields a row."""
    first = spark.read.text(given(spark, path)).first()
    if first is None or first[0].strip() != "##gff-version 3":
        raise ValueError(f"{path} does not start with ##gff-version 3")
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    cells = F.split("value", "\t")
    fine = F.when(F.size(cells) != 9, F.raise_error(F.concat(F.lit("not nine fields: "), F.col("value"))).cast("array<string>")).otherwise(cells)
    names = [f.split()[0] for f in GFF.split(", ")]
    rows = lines.select(fine.alias("c")).select(*(F.col("c")[k].alias(n) for k, n in enumerate(names)))
    dot = lambda c: F.nullif(F.col(c), F.lit("."))
    return rows.select("seqid", "source", "type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), dot("score").cast("double").alias("score"), "strand", dot("phase").cast("int").alias("phase"), attributes(F.col("attributes")).alias("attributes"))


def proteins_of(fasta: DataFrame) -> DataFrame:
    return fasta.select(F.col("accession").alias("protein_accession"), "description", "sequence", F.length("sequence").alias("length_aa"))


def features_of(gff: DataFrame) -> DataFrame:
    def pick(*keys: str):
        return first_filled(*(F.try_element_at("attributes", F.lit(k)) for k in keys))

    return gff.select(
        pick("ID").alias("feature_id"),
        "seqid",
        F.col("type").alias("feature_type"),
        F.col("start").alias("start_nt"),
        F.col("end").alias("end_nt"),
        "strand",
        pick("locus_tag", "Name").alias("locus_tag"),
        pick("protein_id", "protein_accession").alias("protein_accession"),
        pick("gene", "gene_synonym").alias("gene"),
        pick("product", "Name").alias("product"),
    )


def read_taxdump(spark: SparkSession, nodes: str, names: str) -> DataFrame:
    """(taxon_id, parent_id, rank, name) from nodes and names dumps; scientific names only."""

    def cells(path: str) -> DataFrame:
        return spark.read.text(given(spark, path)).select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("c"))

    n = cells(nodes).select(F.col("c")[0].cast("long").alias("taxon_id"), F.col("c")[1].cast("long").alias("parent_id"), F.col("c")[2].alias("rank"))
    m = cells(names).where(F.trim(F.col("c")[3]) == "scientific name").select(F.col("c")[0].cast("long").alias("taxon_id"), F.col("c")[1].alias("name"))
    return n.join(m, "taxon_id", "left")


def read_diamond(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(given(spark, path), sep="\t", schema=DIAMOND, mode="FAILFAST")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="cluster_id string, sequence_id string").withColumn("is_representative", F.col("cluster_id") == F.col("sequence_id"))


def read_benchmark(spark: SparkSession, path: str, lists: Sequence[str] = (), flags: Sequence[str] = ()) -> DataFrame:
    """Curated rows; missing text is empty, list cells are parted by ``|``, flags are true, 1 or yes."""
    rows = spark.read.csv(path, header=True)
    out = []
    for c in rows.columns:
        if c in lists:
            out.append(list_cell(F.col(c)).alias(c))
        elif c in flags:
            out.append(F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("true", "1", "yes").alias(c))
        else:
            out.append(F.coalesce(c, F.lit("")).alias(c))
    return rows.select(*out)


def write_benchmark(rows: DataFrame, path: str) -> None:
    rows.select(*(F.array_join(f.name, "|").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in rows.schema.fields)).coalesce(1).write.csv(path, header=True)


def read_plddt(spark: SparkSession, path: str) -> DataFrame:
    """(chain, residue_number, insertion, residue, plddt) of the first atom of each residue in a PDB file."""
    lines = spark.read.text(given(spark, path)).withColumn("no", F.monotonically_increasing_id()).where(F.startswith("value", F.lit("ATOM")))
    at = lambda a, n: F.trim(F.substring("value", a, n))
    atoms = lines.select("no", F.coalesce(F.nullif(at(22, 1), F.lit("")), F.lit("_")).alias("chain"), at(23, 4).cast("int").alias("residue_number"), at(27, 1).alias("insertion"), at(18, 3).alias("residue"), at(61, 6).cast("double").alias("plddt"))
    return atoms.groupBy("chain", "residue_number", "insertion").agg(F.min_by("residue", "no").alias("residue"), F.min_by("plddt", "no").alias("plddt"))


def read_pae(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, pae), 1-based, from a predicted-aligned-error matrix: bare, in an object, or in a list of one object."""
    text = spark.read.text(given(spark, path), wholetext=True)
    matrix = F.coalesce(
        F.from_json(F.get_json_object("value", "$.predicted_aligned_error"), "array<array<double>>"),
        F.from_json(F.get_json_object("value", "$.pae"), "array<array<double>>"),
        F.from_json(F.get_json_object("value", "$[0].predicted_aligned_error"), "array<array<double>>"),
        F.from_json("value", "array<array<double>>"),
    )
    rows = text.select(F.posexplode(matrix).alias("i", "row"))
    return rows.select("i", F.posexplode("row").alias("j", "pae")).select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "pae")


def read_pwm(spark: SparkSession, path: str) -> list[dict[str, float]]:
    """Rows of a position weight matrix, normalised; a motif has some dozens of rows."""
    out = []
    for r in spark.read.csv(path, header=True, inferSchema=True).orderBy("position").collect():
        row = {b: float(r[b]) for b in "ACGT"}
        total = sum(row.values())
        if total <= 0:
            raise ValueError(f"no mass at position {r['position']}")
        out.append({b: v / total for b, v in row.items()})
    return out


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, columns: Sequence[str], parts: int = 8) -> DataFrame:
    """A table of a local SQLite file, cut by rowid between tasks. The file must be at ``path`` on every machine."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        known = {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}
        if missing := [c for c in columns if c not in known]:
            raise ValueError(f"{table} lacks {missing}")
        low, high = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{table}"').fetchone()
    step = max(1, -(-(high - low + 1) // parts))
    ranges = [(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]
    names = ", ".join(f'"{c}"' for c in columns)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                for a, b in pdf.itertuples(index=False, name=None):
                    yield pd.read_sql_query(f'SELECT {names} FROM "{table}" WHERE rowid >= ? AND rowid < ?', db, params=(a, b))

    return spark.createDataFrame(ranges or [(0, 0)], "a long, b long").repartition(max(1, len(ranges))).mapInPandas(run, schema)


def json_list(column: str) -> F.col:
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))
