"""The discovery run stage by stage over a folder of tables: each stage reads what stands there, and publishes its tables into
it, whole or not at all."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flankline import schemas
from flankline.operators import annotate, evaluate, lineage, scoring, stats
from flankline.plans import discovery


def _read(spark: SparkSession, run: str, *names: str) -> list[DataFrame]:
    return [schemas.checked_columns(spark.read.parquet(f"{run}/{name}"), name) for name in names]


def annotate_genes(spark: SparkSession, run: str, domains: DataFrame) -> None:
    """genes with domain lists (gene_accession, position, pfam_id, pfam_description, interpro_id, interpro_description)."""
    (genes,) = _read(spark, run, "genes")
    discovery.write({"genes": discovery.annotated(genes, domains)}, run)


def assign_roles(spark: SparkSession, run: str, config: Mapping) -> None:
    """genes with regulator classes and roles; sensor_regulator_pairs."""
    loci, genes = _read(spark, run, "loci", "genes")
    discovery.write({"genes": discovery.with_roles(genes, config)}, run)
    (genes,) = _read(spark, run, "genes")
    discovery.write({"sensor_regulator_pairs": annotate.sensor_regulator_pairs(genes, loci, config["sensory_domains"], config["paired_evidence"])}, run)


def score(spark: SparkSession, run: str, config: Mapping, known: DataFrame | None = None, taxonomy: DataFrame | None = None, with_enrichment: bool = False) -> None:
    """loci with scores, after their taxonomy and context where given; candidates, with the enrichment that stands there if asked."""
    loci, genes = _read(spark, run, "loci", "genes")
    if taxonomy is not None:
        loci = lineage.fill_taxonomy(loci, taxonomy, "organism", [c for c in taxonomy.columns if c != "organism"])
    if known is not None:
        loci = annotate.taxonomic_context(loci.drop("taxonomic_context_score"), known, [["analyte", "organism"]])
    weights = config["scoring"]
    discovery.write({"loci": scoring.score_loci(loci, weights["locus_score_weights"], weights["confidence_thresholds"])}, run)
    (loci,) = _read(spark, run, "loci")
    tested = _read(spark, run, "enrichment")[0] if with_enrichment else None
    candidates = discovery.scored_candidates(loci, genes, config, tested)
    discovery.write({"candidates": stats.score_bands(candidates, "candidate_score")}, run)


def enrich(spark: SparkSession, run: str, case: str, control: str) -> None:
    """enrichment of one analyte against another, and its robustness to deduplication."""
    loci, genes = _read(spark, run, "loci", "genes")
    tables = {"enrichment": discovery.enrichment_table(discovery.enriched(genes, loci, case, control), case, control), "enrichment_robustness": discovery.robustness_table(genes, loci, case, control)}
    discovery.write(tables, run)


def archetypes(spark: SparkSession, run: str, config: Mapping) -> None:
    """archetypes; candidates with their archetype, conservation, profile and final score."""
    loci, candidates = _read(spark, run, "loci", "candidates")
    listed, scored = discovery.archetyped(loci, candidates.drop("archetype_conservation_score", "taxonomic_breadth_score"), config["scoring"])
    discovery.write({"archetypes": listed}, run)
    discovery.write({"candidates": stats.score_bands(scored, "candidate_score")}, run)


def evaluate_benchmark(spark: SparkSession, run: str, benchmark: DataFrame, hits: DataFrame) -> None:
    """benchmark_recovery and benchmark_summary of curated rows (the columns of schema ``benchmark``) against anchor hits and the
    candidates of the run."""
    (candidates,) = _read(spark, run, "candidates")
    truth = benchmark.withColumns({"is_negative_control": F.col("analyte") == "negative_control", "verified_pmid": F.col("verify_pmid") if "verify_pmid" in benchmark.columns else F.lit(False)})
    said = hits.select("analyte", F.concat_ws(" ", *(c for c in ("protein_accession", "locus_tag", "gene", "product", "dataset_name") if c in hits.columns)).alias("said"))
    found = evaluate.recovery(truth, said, "benchmark_id", ["uniprot_accession", "protein_name"], "said", [("analyte", "analyte")], "is_negative_control")
    score = "regulation_logit_score" if "regulation_logit_score" in candidates.columns else "candidate_score"
    ranked = evaluate.ranks(candidates, score, ["candidate_id"])
    told = evaluate.first_candidates(found.select("benchmark_id", "analyte", "sensing_evidence_class", "is_negative_control", "verified_pmid", "protein_name", "organism", "hit"), ranked, "benchmark_id", "protein_name")
    told.write.mode("overwrite").parquet(f"{run}/benchmark_recovery")
    rows = spark.read.parquet(f"{run}/benchmark_recovery")
    positive, direct, verified = ~F.col("is_negative_control"), F.col("sensing_evidence_class") == "direct", F.col("verified_pmid")
    summary = evaluate.summary(rows, positive, F.col("hit"), F.col("rank"), more={"direct_recall": direct, "verified_recall": verified})
    counts = {"positive_recall": positive, "negative_fpr": ~positive, "direct_recall": positive & direct, "verified_recall": positive & verified, **{f"top_{k}_recall": positive & F.col("rank").isNotNull() for k in (1, 5, 10)}}
    evaluate.metric_rows(summary, counts, rows).write.mode("overwrite").parquet(f"{run}/benchmark_summary")
