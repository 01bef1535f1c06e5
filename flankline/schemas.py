"""Table schemas; validation by observing the rows while they are written.

:func:`publish` writes a table once, to a staging folder, and counts broken rules on the way (``DataFrame.observe``); only a clean table
gets its name. A bad row leaves nothing published, and what stood there before stays.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

A = "array<string>"
# fixed values: the tables' columns and types, which columns are optional or nullable, and what enumerated columns may hold
TABLES: dict[str, dict[str, str]] = {
    "anchor_hits": dict(dataset_name="string", analyte="string", anchor_family="string", protein_accession="string", locus_tag="string", gene="string", product="string", bitscore="double", e_value="double", identity="double", coverage="double", evidence_type="string"),
    "loci": dict(locus_id="string", analyte="string", anchor_accession="string", anchor_family="string", organism="string", taxon_id="bigint", cluster_id="int", contig_id="string", window_size="int", is_boundary_truncated="boolean", marker_genes_present=A, accessory_genes_present=A, locus_score="double", locus_confidence="string", taxonomic_context_score="double", operon_integrity_score="double", created_at="timestamp_ntz"),
    "genes": dict(locus_id="string", gene_accession="string", relative_index="int", relative_start="bigint", relative_stop="bigint", strand="string", product_description="string", pfam_ids=A, pfam_descriptions=A, interpro_ids=A, interpro_descriptions=A, functional_class="string", regulator_class="string", sensory_domains=A, is_anchor="boolean", is_regulator_candidate="boolean"),
    "sensor_regulator_pairs": dict(pair_id="string", analyte="string", locus_id="string", hk_gene_accession="string", rr_gene_accession="string", intergenic_distance_nt="bigint", co_strand="boolean", hk_sensor_domains=A, hk_sensory_chemistries=A, rr_dna_binding_domains=A, pair_score="double"),
    "candidates": dict(candidate_id="string", analyte="string", locus_id="string", gene_accession="string", organism="string", cluster_id="int", relative_index="int", distance_nt="bigint", position="string", strand="string", regulator_class="string", dna_binding_domains=A, sensory_domains=A, pfam_ids=A, interpro_ids=A, archetype_id="string", locus_score="double", regulator_domain_score="double", sensory_domain_score="double", proximity_score="double", archetype_conservation_score="double", enrichment_score="double", taxonomic_breadth_score="double", structural_plausibility_score="double", candidate_score="double", candidate_score_q="double", rationale="string"),
    "archetypes": dict(archetype_id="string", analyte="string", cluster_id="int", architecture_scope="string", architecture_string="string", n_loci="int", n_taxa="int", representative_locus_id="string", dominant_regulator_class="string", dominant_anchor_structure="string", mean_locus_score="double", mean_candidate_score="double"),
    "enrichment": dict(analyte="string", feature_type="string", feature_name="string", case_definition="string", control_definition="string", n_case_with_feature="bigint", n_case_without_feature="bigint", n_control_with_feature="bigint", n_control_without_feature="bigint", odds_ratio="double", p_value="double", q_value="double", interpretation="string"),
    "enrichment_robustness": dict(analyte="string", feature_type="string", feature_name="string", deduplication_policy="string", stratum_column="string", test="string", q_value="double", p_value="double", odds_ratio="double"),
    "benchmark": dict(benchmark_id="string", analyte="string", protein_name="string", uniprot_accession="string", organism="string", taxon_id="bigint", anchor_family="string", expected_regulator_class="string", expected_sensory_domains=A, sensing_evidence_class="string", pmid=A, notes="string"),
}
OPTIONAL: dict[str, dict[str, str]] = {
    "loci": dict(provenance_source="string", corpus_store_root="string", superkingdom="string", phylum="string", **{"class": "string"}, order="string", family="string", genus="string", species="string", conservation_across_taxa_score="double"),
    "genes": dict(sensor_role="string"),
    "candidates": dict(primary_sensory_chemistry="string", phylogenetic_profile_score="double", regulation_logit_score="double", score_band_low="double", score_band_high="double", score_band_model="string"),
    "benchmark": dict(first_publication="string", verify_pmid="boolean"),
}
NULLABLE = {
    "anchor_hits": {"bitscore", "e_value", "identity", "coverage"},
    "loci": {"provenance_source", "corpus_store_root", "superkingdom", "phylum", "class", "order", "family", "genus", "species", "conservation_across_taxa_score"},
    "candidates": {"archetype_id", "structural_plausibility_score", "candidate_score_q", "regulation_logit_score", "score_band_low", "score_band_high", "score_band_model"},
    "benchmark": {"anchor_family"},
}
VALUES = {
    "locus_confidence": ("high", "medium", "low", "control"),
    "strand": ("+", "-"),
    "position": ("upstream", "downstream", "internal"),
    "functional_class": ("anchor", "regulator", "metabolic", "transporter", "unknown"),
    "regulator_class": ("one_component", "two_component_rr", "two_component_hk", "sigma54_activator", "sigma", "anti_sigma", "antiterminator", "none"),
    "sensor_role": ("anchor", "regulator", "sensor", "both", "accessory", "none"),
    "evidence_type": ("term_scan", "hmmer", "profile_match", "seed_back_confirmed", "diamond_back_confirmed", "diamond"),
    "architecture_scope": ("locus_neighborhood",),
    "feature_type": ("regulator_family", "sensory_domain", "regulator_class", "archetype"),
    "deduplication_policy": ("none", "one_per_genus", "one_per_family"),
    "test": ("cmh", "fisher"),
    "sensing_evidence_class": ("direct", "indirect", "inferred", "none"),
}
DEFAULTS = {"locus_confidence": "low", "strand": "+", "position": "internal", "architecture_scope": "locus_neighborhood", "sensing_evidence_class": "none", "functional_class": "unknown", "regulator_class": "none", "sensor_role": "none"}
SHARES = ("p_value", "q_value", "candidate_score_q", "regulation_logit_score", "score_band_low", "score_band_high")
# end of fixed values


class SchemaError(ValueError):
    """A table does not have the columns, types or values that its schema demands."""


def violations(df: DataFrame, table: str) -> dict[str, Column]:
    """Row predicates that must hold nowhere."""
    present = [c for c in (*TABLES[table], *OPTIONAL.get(table, {})) if c in df.columns]
    out = {f"{c} is null": F.col(f"`{c}`").isNull() for c in present if c not in NULLABLE.get(table, set())}
    out |= {f"{c} has an unknown value": ~F.col(c).isin(*v) for c, v in VALUES.items() if c in present}
    out |= {f"{c} is no share": ~F.col(c).between(0.0, 1.0) for c in SHARES if c in present}
    if table == "genes":
        out["index 0 is not the anchor"] = (F.col("relative_index") == 0) & ~F.col("is_anchor")
    if table == "loci" and "provenance_source" in df.columns:
        refseq = F.col("provenance_source") == "refseq"
        out["refseq locus without taxon"] = refseq & (F.col("taxon_id") <= 0)
        ranks = [F.coalesce(F.col(f"`{c}`"), F.lit("")) == "" for c in ("phylum", "class", "order", "family", "genus") if c in df.columns]
        if ranks:
            out["refseq locus without lineage"] = refseq & reduce(lambda a, b: a | b, ranks)
    return out


def checked_columns(df: DataFrame, table: str) -> DataFrame:
    """``df`` itself, if its columns and types are those of the table; no row is read."""
    wanted, optional, have = TABLES[table], OPTIONAL.get(table, {}), dict(df.dtypes)
    if missing := [c for c in wanted if c not in have]:
        raise SchemaError(f"{table}: missing {missing}")
    if wrong := [f"{c}: {have[c]}" for c, t in (wanted | optional).items() if c in have and have[c] != t]:
        raise SchemaError(f"{table}: wrong types {wrong}")
    if extra := [c for c in have if c not in wanted and c not in optional]:
        raise SchemaError(f"{table}: unexpected {extra}")
    return df


def _counted(rules: dict[str, Column]) -> list[Column]:
    return [F.count_if(F.coalesce(r, F.lit(False))).alias(f"r{k}") for k, r in enumerate(rules.values())]


def _refused(table: str, rules: dict[str, Column], counts: dict) -> None:
    broken = {name: counts[f"r{k}"] for k, name in enumerate(rules) if counts[f"r{k}"]}
    if broken:
        raise SchemaError(f"{table}: {broken}")


def validate(df: DataFrame, table: str) -> DataFrame:
    """``df`` itself, if columns and types are exact and no row breaks a rule (one aggregate over the rows)."""
    rules = violations(checked_columns(df, table), table)
    _refused(table, rules, df.agg(*_counted(rules)).first().asDict())
    return df


def conformed(df: DataFrame, table: str) -> DataFrame:
    """The table's columns of ``df`` in its types; what is missing or null in a column that must be filled gets the column's default
    or else its type's empty value, columns that the table does not have go."""
    empty = {"string": F.lit(""), "bigint": F.lit(0), "int": F.lit(0), "double": F.lit(0.0), "boolean": F.lit(False), A: F.array(), "timestamp_ntz": F.localtimestamp()}

    def filled(c: str, kind: str) -> Column:
        have = F.col(f"`{c}`").cast(kind) if c in df.columns else F.lit(None).cast(kind)
        return (have if c in NULLABLE.get(table, set()) else F.coalesce(have, F.lit(DEFAULTS[c]) if c in DEFAULTS else empty[kind].cast(kind))).alias(c)

    optional = {c: t for c, t in OPTIONAL.get(table, {}).items() if c in df.columns}
    return df.select(*(filled(c, t) for c, t in (TABLES[table] | optional).items()))


def publish(df: DataFrame, table: str, path: str) -> None:
    """Write ``df`` to ``path`` if it is a valid ``table``: in one pass over its rows, and all or nothing."""
    rules = violations(checked_columns(df, table), table)
    seen = Observation(f"{table}-{uuid.uuid4().hex}")
    place, staging, old = (_path(df.sparkSession, path + suffix) for suffix in ("", f".staging-{uuid.uuid4().hex}", f".old-{uuid.uuid4().hex}"))
    fs = place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    try:
        df.observe(seen, *_counted(rules)).write.parquet(staging.toString())
        _refused(table, rules, seen.get)
        if fs.exists(place):
            fs.rename(place, old)
        fs.rename(staging, place)
    finally:
        for gone in (staging, old):
            fs.delete(gone, True)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A published table, its columns and rows checked again."""
    return validate(spark.read.parquet(path), table)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)
