"""Neighbourhood exports in SQLite: tables ``neighborhoods`` and ``genes`` to loci and genes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flankline.operators.neighborhoods import operon_integrity, operons
from flankline.sources.files import json_list, read_sqlite

NEIGHBORHOODS = "locus_key string, cluster_id int, anchor_accession string, anchor_family string, organism string, taxon_id long, contig_id string, window_size int, is_boundary_truncated int, marker_genes_present_json string, accessory_genes_present_json string"
GENES = "locus_key string, gene_accession string, gene_order int, start_nt long, stop_nt long, strand string, product_description string, pfam_ids_json string, pfam_descriptions_json string, interpro_ids_json string, interpro_descriptions_json string, functional_class string, regulator_class string, sensory_domains_json string, is_regulator_candidate int"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def read_efi(spark: SparkSession, path: str, analytes: Sequence[str], clusters: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(loci, genes), every locus once for each analyte. ``clusters`` None keeps all, an empty list none. Each locus must
    have exactly one anchor gene."""
    if not analytes:
        raise ValueError("at least one analyte is needed")
    loci = read_sqlite(spark, path, "neighborhoods", NEIGHBORHOODS, _columns(NEIGHBORHOODS))
    genes = read_sqlite(spark, path, "genes", GENES, _columns(GENES))
    if clusters is not None:
        loci = loci.where(F.col("cluster_id").isin(*clusters) if clusters else F.lit(False))
    each = spark.createDataFrame([(a,) for a in analytes], "analyte string")
    loci = loci.crossJoin(F.broadcast(each)).withColumn("locus_id", F.concat_ws("_", "analyte", F.col("cluster_id").cast("string"), "anchor_accession"))
    rows = genes.join(loci.select("locus_key", "locus_id", "anchor_accession"), "locus_key").withColumn("is_anchor", F.col("gene_accession") == F.col("anchor_accession"))
    anchor = rows.where("is_anchor").groupBy("locus_id").agg(F.count("*").alias("n"), F.first("gene_order").alias("o"), F.first("start_nt").alias("s"))
    rows = rows.join(anchor, "locus_id", "left")
    order = F.when(F.coalesce("n", F.lit(0)) == 1, F.col("o")).otherwise(F.raise_error(F.concat(F.lit("not exactly one anchor gene in "), "locus_key")).cast("int"))
    lists = {c: json_list(f"{c}_json") for c in ("pfam_ids", "pfam_descriptions", "interpro_ids", "interpro_descriptions", "sensory_domains")}
    out = rows.select(
        "locus_id",
        "gene_accession",
        (F.col("gene_order") - order).cast("int").alias("relative_index"),
        (F.col("start_nt") - F.col("s")).alias("relative_start"),
        (F.col("stop_nt") - F.col("s")).alias("relative_stop"),
        "strand",
        "product_description",
        *(lists[c].alias(c) for c in ("pfam_ids", "pfam_descriptions", "interpro_ids", "interpro_descriptions")),
        "functional_class",
        "regulator_class",
        lists["sensory_domains"].alias("sensory_domains"),
        "is_anchor",
        (F.col("is_regulator_candidate") != 0).alias("is_regulator_candidate"),
    )
    integrity = operon_integrity(operons(out, "locus_id", "relative_start", "relative_stop", "strand", "is_anchor", ["gene_accession"]), "locus_id")
    loci = loci.join(integrity, "locus_id", "left").select(
        "locus_id",
        "analyte",
        *(c for c in _columns(NEIGHBORHOODS) if not c.endswith("_json") and c not in ("locus_key", "is_boundary_truncated")),
        (F.col("is_boundary_truncated") != 0).alias("is_boundary_truncated"),
        json_list("marker_genes_present_json").alias("marker_genes_present"),
        json_list("accessory_genes_present_json").alias("accessory_genes_present"),
        F.lit(0.0).alias("taxonomic_context_score"),
        F.coalesce("operon_integrity_score", F.lit(0.0)).alias("operon_integrity_score"),
        F.lit("efi_sqlite").alias("provenance_source"),
    )
    return loci, out
