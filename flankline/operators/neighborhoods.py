"""Ordered neighbourhoods around anchors, and what follows from order: operons, architectures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordinals(features: DataFrame, contig: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``ord`` (0-based place on the contig) and ``last`` (the largest place)."""
    by = Window.partitionBy(*contig)
    return features.withColumn("ord", F.row_number().over(by.orderBy(*order)) - 1).withColumn("last", F.count("*").over(by) - 1)


def neighborhoods(features: DataFrame, anchors: DataFrame, contig: Sequence[str], key: str, start: str, stop: str, locus: str = "locus_id", window: int = 10) -> DataFrame:
    """Genes within ``window`` places of each anchor.

    ``features`` carry ``ord`` and ``last``; ``anchors`` are rows of the same table with a locus id. Each anchor names the
    at most 2 * window + 1 places that it wants and meets the features by equality on (contig, place): a hash
    join that deals out by place, so a contig with many anchors does not become one task.
    """
    ids = list(contig)
    wanted = anchors.select(
        locus,
        *ids,
        F.col("ord").alias("anchor_ord"),
        F.col(start).alias("anchor_start"),
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("ord") - window).cast("int"), F.least(F.col("last"), F.col("ord") + window).cast("int"))).alias("ord"),
    )
    found = features.select(*ids, F.col("ord").cast("int").alias("ord"), *(c for c in features.columns if c not in {*ids, "ord", "last"}))
    return wanted.join(found, [*ids, "ord"]).select(
        locus,
        F.col(key).alias("gene_accession"),
        (F.col("ord") - F.col("anchor_ord")).cast("int").alias("relative_index"),
        (F.col(start) - F.col("anchor_start")).alias("relative_start"),
        (F.col(stop) - F.col("anchor_start")).alias("relative_stop"),
        (F.col("ord") == F.col("anchor_ord")).alias("is_anchor"),
        *(c for c in found.columns if c not in {*ids, "ord", key, start, stop}),
    )


def locus_rows(anchors: DataFrame, locus: str = "locus_id", window: int = 10) -> DataFrame:
    """Each anchor's window: how many genes, and whether it touches a contig end (also where a full window just fits)."""
    low, high = F.greatest(F.lit(0), F.col("ord") - window), F.least(F.col("last"), F.col("ord") + window)
    return anchors.withColumn("window_size", (high - low + 1).cast("int")).withColumn("is_boundary_truncated", (F.col("ord") - window <= 0) | (F.col("ord") + window >= F.col("last")))


def operons(genes: DataFrame, locus: str, start: str, stop: str, strand: str, is_anchor: str, tie: Sequence[str] = (), max_gap: int = 200) -> DataFrame:
    """Runs of one strand without a gap over ``max_gap``: ``operon_no`` from 1, ``operon_id``, ``in_anchor_operon``."""
    by = Window.partitionBy(locus).orderBy(start, stop, *tie)
    gap = F.greatest(F.lit(0), F.col(start) - F.lag(stop).over(by) - 1)
    opens = F.when(F.lag(strand).over(by).isNull() | (F.lag(strand).over(by) != F.col(strand)) | (gap > max_gap), 1).otherwise(0)
    numbered = genes.withColumn("__opens", opens).withColumn("operon_no", F.sum("__opens").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__opens")
    return numbered.withColumn("operon_id", F.format_string("%s:operon_%02d", F.col(locus).cast("string"), F.col("operon_no"))).withColumn(
        "in_anchor_operon", F.max(F.col(is_anchor)).over(Window.partitionBy(locus, "operon_no"))
    )


def operon_integrity(genes: DataFrame, locus: str) -> DataFrame:
    return genes.groupBy(locus).agg(F.avg(F.col("in_anchor_operon").cast("int")).alias("operon_integrity_score"))


def architectures(candidates: DataFrame, anchors: DataFrame, locus: str, order: Sequence[str], token: str, anchor_token: str) -> DataFrame:
    """One string for each locus: its candidates' tokens in order, the anchor's token last."""
    listed = candidates.groupBy(locus).agg(F.array_sort(F.collect_list(F.struct(*order, token))).alias("__list"))
    parts = F.concat(F.transform(F.coalesce("__list", F.array().cast(listed.schema["__list"].dataType)), lambda x: x[token]), F.array(anchor_token))
    return anchors.join(listed, locus, "left").select(locus, F.array_join(parts, ">").alias("architecture"))
