"""The discovery run as one plan: features and hits to loci, genes, enrichment, candidates and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flankline import schemas
from flankline.functions import scalars as S
from flankline.operators import anchors, annotate, evaluate, lineage, neighborhoods, scoring, stats
from flankline.session import checkpoint_folder

EMPTY = "array<string>"


def locus_id_of_hit() -> Column:
    family, name = S.safe_identifier(F.col("anchor_family")), F.coalesce(F.nullif(F.col("protein_accession"), F.lit("")), F.col("locus_tag"))
    return F.concat_ws("__", F.lower("analyte"), "dataset_name", family, name)


def gene_name(columns: Sequence[str]) -> Column:
    """A gene's accession, or what stands in for it: the feature's id, then the locus tag; empty values count as absent."""
    names = [c for c in ("protein_accession", "feature_id", "locus_tag") if c in columns]
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in names), F.lit(""))


def genes_of(genes: DataFrame, loci: DataFrame, analyte: str) -> DataFrame:
    """The genes in loci of an analyte."""
    return genes.join(loci.where(F.col("analyte") == analyte).select("locus_id"), "locus_id", "left_semi")


def extract(features: DataFrame, hits: DataFrame, window: int = 10, contigs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(loci, genes) around anchor hits.

    ``features``: dataset_name, seqid, feature_type, start_nt, end_nt, strand, protein_accession, locus_tag, gene, product.
    Only coding features with a protein are placed. Every hit must resolve to one of them. ``contigs`` (dataset_name, seqid) says
    which contigs are read at all.
    """
    if contigs is not None:
        features = features.join(contigs.select("dataset_name", "seqid"), ["dataset_name", "seqid"], "left_semi")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("protein_accession", "locus_tag", "gene", "product")}
    coding = features.where("feature_type = 'CDS' AND protein_accession IS NOT NULL").withColumns(blank)
    coding = coding.withColumn("gene_name", gene_name(coding.columns))
    placed = neighborhoods.ordinals(coding, ["dataset_name", "seqid"], ["start_nt", "end_nt", "protein_accession"])
    keyed = hits.withColumn("locus_id", locus_id_of_hit())
    found = anchors.resolve(
        keyed.select("locus_id", "analyte", "anchor_family", *(F.col(c) for c in ("dataset_name", "protein_accession", "locus_tag", "gene"))),
        placed,
        "locus_id",
        [("protein_accession", "protein_accession"), ("locus_tag", "locus_tag"), ("gene", "gene")],
        [("dataset_name", "dataset_name")],
        ["start_nt", "end_nt", "protein_accession"],
    )
    anchors.require_all(keyed, found, "locus_id")
    rows = neighborhoods.locus_rows(found.join(keyed.select("locus_id", "analyte", "anchor_family"), "locus_id"), "locus_id", window)
    loci = rows.select(
        "locus_id",
        "analyte",
        F.col("protein_accession").alias("anchor_accession"),
        "anchor_family",
        F.col("dataset_name").alias("organism"),
        F.col("seqid").alias("contig_id"),
        "window_size",
        "is_boundary_truncated",
        F.array("anchor_family").alias("marker_genes_present"),
        F.array().cast(EMPTY).alias("accessory_genes_present"),
        F.lit("low").alias("locus_confidence"),
    )
    genes = neighborhoods.neighborhoods(placed, found.select("locus_id", "dataset_name", "seqid", "ord", "last", "start_nt"), ["dataset_name", "seqid"], "gene_name", "start_nt", "end_nt", "locus_id", window)
    genes = genes.withColumn("strand", F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise("+")).withColumn("product_description", F.col("product"))
    genes = genes.withColumns({"functional_class": F.when(F.col("is_anchor"), "anchor").otherwise("unknown"), "regulator_class": F.lit("none")})
    genes = neighborhoods.operons(genes, "locus_id", "relative_start", "relative_stop", "strand", "is_anchor", ["gene_accession"])
    integrity = neighborhoods.operon_integrity(genes, "locus_id")
    return loci.join(integrity, "locus_id", "left").withColumn("operon_integrity_score", F.coalesce("operon_integrity_score", F.lit(0.0))), genes


def annotated(genes: DataFrame, domains: DataFrame) -> DataFrame:
    """Genes with their domain lists, to be classified."""
    lists = annotate.ordered_distinct(domains, ["gene_accession"], ["position"], ["pfam_id", "pfam_description", "interpro_id", "interpro_description"])
    lists = lists.toDF("gene_accession", "pfam_ids", "pfam_descriptions", "interpro_ids", "interpro_descriptions")
    genes = annotate.annotate_domains(genes.drop(*lists.columns[1:]), "gene_accession", lists)
    return genes.withColumns({"sensory_domains": F.array().cast(EMPTY), "functional_class": F.lit("unknown"), "is_regulator_candidate": F.lit(False), "regulator_class": F.lit("none")})


def with_roles(genes: DataFrame, config: Mapping) -> DataFrame:
    classified = annotate.classify_regulators(genes, config["regulator_families"])
    return annotate.assign_sensor_roles(classified, config["regulator_families"], config["sensory_domains"], config["paired_evidence"])


def feature_rows(genes: DataFrame, loci: DataFrame, analytes: Sequence[str]) -> DataFrame:
    """(locus_id, analyte, feature_type, feature_name) of the genes in loci of some analytes; a class or domain ``none`` is null."""
    sides = loci.where(F.col("analyte").isin(*analytes))
    kinds = F.concat(F.array(F.struct(F.lit("regulator_class").alias("t"), F.col("regulator_class").alias("n"))), F.transform("sensory_domains", lambda d: F.struct(F.lit("sensory_domain").alias("t"), d.alias("n"))))
    carried = [c for c in ("genus", "family", "locus_score") if c in loci.columns]
    rows = genes.drop("analyte", *carried).join(sides.select("locus_id", "analyte", *carried), "locus_id").select("locus_id", "analyte", *carried, F.explode_outer(kinds).alias("f"))
    return rows.select("locus_id", "analyte", *carried, F.col("f.t").alias("feature_type"), F.when(F.col("f.n") != "none", F.col("f.n")).alias("feature_name"))


def enriched(genes: DataFrame, loci: DataFrame, case: str, control: str) -> DataFrame:
    """Fisher's test of every feature: a, b, c, d, odds ratio, p, q."""
    rows = feature_rows(genes, loci, [case, control]).select("locus_id", "analyte", "feature_type", "feature_name")
    return stats.benjamini_hochberg(stats.fisher(stats.contingency(rows, ["feature_type", "feature_name"], "locus_id", F.col("analyte") == case)))


def enrichment_table(tested: DataFrame, case: str, control: str) -> DataFrame:
    counted = {"a": "n_case_with_feature", "b": "n_case_without_feature", "c": "n_control_with_feature", "d": "n_control_without_feature"}
    return tested.withColumnsRenamed(counted).withColumns({"analyte": F.lit(case), "case_definition": F.lit(case), "control_definition": F.lit(control)})


def robustness_table(genes: DataFrame, loci: DataFrame, case: str, control: str) -> DataFrame:
    """The stratified test of every feature under each deduplication policy."""
    rows = feature_rows(genes, loci.withColumns({r: lineage.taxonomy_value(r, loci.columns, "unknown") for r in ("genus", "family")}), [case, control])
    policies = {"none": None, "one_per_genus": "genus", "one_per_family": "family"}
    out = stats.robustness(rows, ["feature_type", "feature_name"], "locus_id", "analyte", case, policies, "locus_score", ["family"])
    return out.withColumn("analyte", F.lit(case)).drop("n_a", "n_b", "n_c", "n_d", "interpretation")


def scored_candidates(loci: DataFrame, genes: DataFrame, config: Mapping, tested: DataFrame | None) -> DataFrame:
    weights = config["scoring"]
    expected = {a["analyte"]: a.get("expected_sensory_chemistry") or [] for a in config["analytes"]}
    return scoring.score_candidates(loci, genes, weights["candidate_score_weights"], config["sensory_domains"], config["paired_evidence"], expected, tested, weights.get("enrichment", {}).get("score_cap", 3.0))


def archetyped(loci: DataFrame, candidates: DataFrame, weights: Mapping) -> tuple[DataFrame, DataFrame]:
    """(archetypes, candidates): architectures clustered and summed up; candidates with their archetype, conservation, profile and
    final score."""
    token = scoring.candidate_token(F.col("relative_index"), F.col("regulator_class"), F.col("sensory_domains"), F.col("distance_nt"))
    shapes = neighborhoods.architectures(candidates.withColumn("token", token), loci.select("locus_id", F.concat(F.lit("0:"), "anchor_family").alias("anchor_token")), "locus_id", ["relative_index", "gene_accession"], "token", "anchor_token")
    numbered = scoring.archetype_ids(shapes, "architecture", weights.get("archetype_threshold", 0.0))
    placed = loci.join(shapes.join(numbered, "architecture"), "locus_id")
    known_as = F.format_string("%s_arch_%04d", "analyte", "archetype_no")
    archetypes = scoring.archetype_summary(placed, candidates.select("locus_id", "regulator_class", "candidate_score"), ["analyte", "archetype_no", "architecture"], "locus_id", "locus_score", "organism", "regulator_class", "candidate_score")
    archetypes = archetypes.select(known_as.alias("archetype_id"), "analyte", F.lit("locus_neighborhood").alias("architecture_scope"), F.col("architecture").alias("architecture_string"), "n_loci", "n_taxa", F.col("representative").alias("representative_locus_id"), F.col("dominant_class").alias("dominant_regulator_class"), "mean_locus_score", "mean_candidate_score")
    out = scoring.with_archetypes(candidates.join(shapes, "locus_id"), archetypes)
    taxa = loci.select("locus_id", *(lineage.taxonomy_value(r, loci.columns, "").alias(r) for r in ("genus", "family", "phylum")))
    out = scoring.conservation(out, taxa, "locus_id", "architecture", "analyte", "relative_index", "regulator_class", "genus", "family", "phylum")
    out = stats.profile_scores(out, loci)
    return archetypes, scoring.candidate_score(out, weights["candidate_score_weights"])


def discover(features: DataFrame, hits: DataFrame, domains: DataFrame, taxonomy: DataFrame, known: DataFrame, config: Mapping, case: str, control: str, window: int = 10, benchmark: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a run. ``domains``: gene_accession, position, pfam_id, pfam_description, interpro_id,
    interpro_description; ``taxonomy``: organism and ranks; ``known``: analyte, organism. Case and control are analytes; ``benchmark``: benchmark_id, protein_name."""
    checkpoint_folder(features.sparkSession)
    hits = anchors.numbered(hits)
    loci, genes = extract(features, hits, window)
    numbers = hits.select(locus_id_of_hit().alias("locus_id"), "cluster_id").groupBy("locus_id").agg(F.min("cluster_id").alias("cluster_id"))
    loci = loci.join(taxonomy, "organism", "left").join(numbers, "locus_id", "left")
    loci = annotate.taxonomic_context(loci, known, [["analyte", "organism"]])
    genes = with_roles(annotated(genes, domains), config).checkpoint()  # every later table reads these; their rules are long
    weights = config["scoring"]
    loci = scoring.score_loci(loci, weights["locus_score_weights"], weights["confidence_thresholds"]).checkpoint()
    tested = enriched(genes, loci, case, control)
    candidates = scored_candidates(loci, genes, config, tested).checkpoint()
    pairs = annotate.sensor_regulator_pairs(genes, loci, config["sensory_domains"], config["paired_evidence"])
    archetypes, candidates = archetyped(loci, candidates, weights)
    candidates = candidates.checkpoint()  # bands, ranks and each written table read it
    out = {"loci": loci, "genes": genes, "enrichment": enrichment_table(tested, case, control), "archetypes": archetypes, "candidates": stats.score_bands(candidates, "candidate_score"), "sensor_regulator_pairs": pairs}
    if benchmark is not None:
        ranked = evaluate.ranks(candidates, "candidate_score", ["candidate_id"])
        out["benchmark_recovery"] = evaluate.first_candidates(benchmark, ranked, "benchmark_id", "protein_name").withColumn("hit", F.col("rank").isNotNull())
    return out


def write(tables: Mapping[str, DataFrame], folder: str, only: Sequence[str] | None = None) -> None:
    """Write tables into ``folder``; those with a schema in its columns and types, and only if every row keeps its rules."""
    for name, df in tables.items():
        if only is None or name in only:
            if name in schemas.TABLES:
                schemas.publish(schemas.conformed(df, name), name, f"{folder}/{name}")
            else:
                df.write.mode("overwrite").parquet(f"{folder}/{name}")
