"""Domain lists, regulator classes, sensor roles, sensor-regulator pairs, taxonomic context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flankline.functions import scalars as S


def ordered_distinct(rows: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """For each key the distinct values of each column in order of first appearance; nulls are dropped, columns are independent."""
    parts = []
    for v in values:
        listed = F.array_sort(F.collect_list(F.when(F.col(v).isNotNull(), F.struct(*order, F.col(v).alias("__v")))))
        parts.append(F.array_distinct(F.transform(listed, lambda x: x["__v"])).alias(v))
    return rows.groupBy(*key).agg(*parts)


def annotate_domains(genes: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """Left join of list tables; no match is an empty list. Returns genes with every list column filled."""
    for t in tables:
        genes = genes.join(t, key, "left")
        for f in t.schema.fields:
            if f.dataType.typeName() == "array":
                genes = genes.withColumn(f.name, F.coalesce(f.name, F.array().cast(f.dataType)))
    return genes


def unannotated(genes: DataFrame, locus: str = "locus_id") -> DataFrame:
    """How many genes of each locus have no domain at all."""
    return genes.groupBy(locus).agg(F.count_if((F.size("pfam_ids") <= 0) & (F.size("interpro_ids") <= 0)).alias("n_unannotated"))


def with_ordinal(rows: DataFrame, order: Sequence[str], into: str = "ordinal", group: Sequence[str] = ("locus_id",)) -> DataFrame:
    """An explicit place of each row in its group, so that results can be put back in order whatever was shuffled since."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once for each row. A filter on a plain column is pushed below it with a copy of its
    expression, and rule expressions are long; nothing is pushed below a generator."""
    made = rows.withColumn("__once", F.explode(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))
    kept = [c for c in rows.columns if c not in columns]
    return made.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"__once.{c}").alias(c) for c in columns))


def classify_regulators(genes: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    genes = once(genes, __by_domain=S.regulator_class(F.col("pfam_ids"), rules))
    by_domain = F.col("__by_domain")
    supported = (F.size("pfam_ids") > 0) | (F.size("interpro_ids") > 0)
    name = F.when((by_domain == "none") & supported, S.regulator_class_of_text(F.col("product_description"))).otherwise(by_domain)
    out = once(genes, regulator_class=name).drop("__by_domain").withColumn("is_regulator_candidate", F.col("regulator_class") != "none")
    kept = F.when(F.col("functional_class").isin("metabolic", "transporter", "unknown"), F.col("functional_class")).otherwise("unknown")
    return out.withColumn("functional_class", F.when(F.col("is_anchor"), "anchor").when(F.col("is_regulator_candidate"), "regulator").otherwise(kept))


def assign_sensor_roles(genes: DataFrame, families: Sequence[Mapping], catalog: Sequence[Mapping], rules: Sequence[Mapping], kingdom: str | None = None) -> DataFrame:
    """Add sensor_role and refine regulator_class. Without ``kingdom`` rules that ask for one do not fire."""
    pfams = F.col("pfam_ids")
    sensors = sorted({e["pfam_id"] for e in catalog if {x["pfam_id"]: x for x in catalog}[e["pfam_id"]]["role"] == "sensor"})
    terms = S.evidence_terms(F.col("sensory_domains"), F.col("pfam_descriptions"), F.col("interpro_descriptions"), F.array("product_description"))
    found = S.chemistries(pfams, catalog, rules, terms=terms, kingdom=F.col(kingdom) if kingdom else F.lit(""))
    evidence = (F.size(found) > 0) | F.arrays_overlap(pfams, S.strings(sensors))
    annotated = (F.size(pfams) > 0) | (F.size("interpro_ids") > 0) | (F.length(F.coalesce("product_description", F.lit(""))) > 0) | F.col("is_regulator_candidate")
    inferred = S.regulator_class(pfams, families)
    out = once(genes, __class=inferred, __evidence=evidence, __annotated=annotated)
    out = out.withColumn("__role", S.sensor_role(F.col("is_anchor"), F.col("__class"), F.col("__evidence"), F.col("__annotated")))
    rescued = (F.col("__class") == "none") & F.col("is_regulator_candidate")
    role = F.when(rescued & (F.col("__role") == "sensor"), "both").when(rescued & F.col("__role").isin("accessory", "none"), "regulator").otherwise(F.col("__role"))
    out = once(out, regulator_class=F.when(rescued, F.col("regulator_class")).otherwise(F.col("__class")), sensor_role=role)
    out = out.withColumn("is_regulator_candidate", F.col("sensor_role").isin("regulator", "both"))
    kind = F.when(F.col("sensor_role") == "anchor", "anchor").when(F.col("is_regulator_candidate"), "regulator").when(F.col("sensor_role") == "sensor", "unknown").otherwise(F.col("functional_class"))
    return out.withColumn("functional_class", kind).drop("__class", "__evidence", "__annotated", "__role")


def sensor_regulator_pairs(genes: DataFrame, loci: DataFrame, catalog: Sequence[Mapping], rules: Sequence[Mapping]) -> DataFrame:
    """Histidine kinases with response regulators of the same locus; a locus holds at most a window of genes."""

    def side(name: str, kind: str, roles: Sequence[str]) -> DataFrame:
        some = genes.where((F.col("regulator_class") == kind) & F.col("sensor_role").isin(*roles))
        return some.select("locus_id", *(F.col(c).alias(f"{name}_{c}") for c in ("gene_accession", "relative_start", "relative_stop", "strand", "pfam_ids")))

    pairs = side("hk", "two_component_hk", ("sensor", "both")).join(side("rr", "two_component_rr", ("regulator", "both")), "locus_id").join(loci.select("locus_id", "analyte"), "locus_id", "left")
    names = F.create_map(*(F.lit(x) for k, v in sorted({e["pfam_id"]: e["domain"] for e in catalog}.items()) for x in (k, v)))
    gap = S.intergenic_distance(*(F.col(c) for c in ("hk_relative_start", "hk_relative_stop", "rr_relative_start", "rr_relative_stop"))).cast("long")
    return pairs.select(
        F.concat_ws("::", "locus_id", "hk_gene_accession", "rr_gene_accession").alias("pair_id"),
        "locus_id",
        "analyte",
        "hk_gene_accession",
        "rr_gene_accession",
        gap.alias("intergenic_distance_nt"),
        (F.col("hk_strand") == F.col("rr_strand")).alias("co_strand"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform("hk_pfam_ids", lambda x: names[x])))).alias("hk_sensor_domains"),
        S.chemistries(F.col("hk_pfam_ids"), catalog, rules).alias("hk_sensory_chemistries"),
        S.only(F.col("rr_pfam_ids"), S.DNA_BINDING_ROLE).alias("rr_dna_binding_domains"),
        (F.lit(1.0) / (F.lit(1.0) + gap)).alias("pair_score"),
    )


def taxonomic_context(loci: DataFrame, known: DataFrame, keys: Sequence[Sequence[str]], into: str = "taxonomic_context_score") -> DataFrame:
    """1 if the locus matches a known organism by any of the key sets, else 0. Each key set is made distinct, so no fan-out."""
    flag = F.lit(False)
    for k, key in enumerate(keys):
        loci = loci.join(known.select(*key).where(" AND ".join(f"`{c}` IS NOT NULL" for c in key)).distinct().withColumn(f"__{k}", F.lit(True)), list(key), "left")
        flag = flag | F.coalesce(F.col(f"__{k}"), F.lit(False))
    return loci.withColumn(into, F.when(flag, 1.0).otherwise(0.0)).drop(*(f"__{k}" for k in range(len(keys))))
