"""Generated inputs of any size, made in parallel from row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scaling_features(spark: SparkSession, datasets: int = 3, genes: int = 32, every: int = 8) -> DataFrame:
    """Features of ``datasets`` genomes with ``genes`` coding genes each; every ``every``-th is an anchor (coxL, cydA in turn)."""
    n = F.col("id") % genes
    anchor = n % every == every // 2
    symbol = F.when(anchor & (n % (2 * every) == every // 2), "coxL").when(anchor, "cydA")
    name = F.format_string("scaling_dataset_%03d", F.floor(F.col("id") / genes))
    return spark.range(datasets * genes).select(
        name.alias("dataset_name"),
        F.concat(name, F.lit("_contig")).alias("seqid"),
        F.lit("CDS").alias("feature_type"),
        (n * 1000 + 1).alias("start_nt"),
        (n * 1000 + 900).alias("end_nt"),
        F.when(n % 11 == 10, "-").otherwise("+").alias("strand"),
        F.format_string("SP%09d", "id").alias("protein_accession"),
        F.format_string("LT%09d", "id").alias("locus_tag"),
        symbol.alias("gene"),
        F.coalesce(F.concat(symbol, F.lit(" subunit")), F.lit("hypothetical protein")).alias("product"),
    )


def synthetic_truth(spark: SparkSession, genomes: int = 40, positives: int = 8, noise: float = 0.0, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(loci, genes, truth): ``positives`` genomes carry a planted regulator beside the anchor, others a decoy at the rate
    ``noise``. The choice is by hash of seed and number, the same whatever the partitioning."""
    base = spark.range(genomes).withColumn("h", F.xxhash64(F.lit(seed), "id"))
    chosen = base.orderBy("h", "id").limit(positives).select("id", F.lit(True).alias("planted"))
    rows = base.join(F.broadcast(chosen), "id", "left").withColumn("planted", F.coalesce("planted", F.lit(False)))
    rows = rows.withColumn("analyte", F.when(F.col("planted"), "CO").otherwise("CN")).withColumn("locus_id", F.format_string("SYN_%03d", "id"))
    decoy = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1_000_000)) < int(noise * 1_000_000)
    rows = rows.withColumn("regulator", F.col("planted") | decoy)
    loci = rows.select("locus_id", "analyte", F.format_string("Synthetic bacterium %03d", "id").alias("organism"), F.floor(F.col("id") * 4 / genomes).cast("int").alias("cluster_id"))
    place = F.explode(F.array(*(F.struct(F.lit(i).alias("relative_index"), F.lit(kind).alias("kind")) for i, kind in ((-1, "SYNREG"), (0, "SYNANCHOR"), (1, "SYNNEXT")))))
    genes = rows.select("locus_id", "regulator", "id", place.alias("g")).select(
        "locus_id",
        F.format_string("%s_%03d", "g.kind", "id").alias("gene_accession"),
        "g.relative_index",
        (F.col("g.relative_index") == 0).alias("is_anchor"),
        ((F.col("g.relative_index") == -1) & F.col("regulator")).alias("is_regulator_candidate"),
    )
    truth = rows.where("planted").select("locus_id", F.format_string("SYNREG_%03d", "id").alias("gene_accession"))
    return loci, genes, truth
