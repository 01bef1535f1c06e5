"""Text search, term scan, summaries and shards over catalogs of proteins and features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flankline.functions.scalars import safe_identifier
from flankline.operators import trigrams


def any_ilike(columns: Sequence[str], pattern: Column) -> Column:
    """One of the columns holds the pattern, case aside. ``%`` and ``_`` in it are wildcards; null columns do not match."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.ilike(F.col(c), pattern), F.lit(False)) for c in columns))


def search(rows: DataFrame, query: str, columns: Sequence[str], order: Sequence[Column], limit: int = 20, per: str | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows whose columns hold ``query``; the first ``limit`` by ``order``, overall or for each value of ``per``. With the trigram
    index of the columns only rows that have the query's rarest grams are compared; without it all are, in one scan."""
    if index is None:
        found = rows.where(any_ilike(columns, F.lit(f"%{query}%")))
    else:
        asked = rows.sparkSession.createDataFrame([(query,)], "__query string")
        found = trigrams.matches(rows, asked, "__query", columns, index).select(*rows.columns)
    if per is None:
        return found.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy(per).orderBy(*order))
    return found.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")


def term_scan(features: DataFrame, targets: DataFrame, columns: Sequence[str], required: str, keys: Sequence[str], proteins: DataFrame | None = None, accession: str = "protein_accession", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Features that hold a target's term, once for each of ``keys``, found by equality of grams and verified. ``proteins`` (with
    ``accession``) add their columns to the features first, by a left join; ``index`` is the trigram index of ``columns``."""
    if proteins is not None:
        more = [accession, *(c for c in proteins.columns if c not in features.columns)]
        features = features.join(proteins.select(*more), accession, "left")
    return trigrams.matches(features.where(F.col(required).isNotNull()), targets, "term", columns, index).dropDuplicates(list(keys))


def anchor_hits_of_scan(scan: DataFrame, dataset: str, accession: str, locus_tag: str, gene: str, product: str) -> DataFrame:
    none = F.lit(None).cast("double")
    return scan.select(
        F.col(dataset).alias("dataset_name"),
        "analyte",
        F.col("term").alias("anchor_family"),
        F.col(accession).alias("protein_accession"),
        F.col(locus_tag).alias("locus_tag"),
        F.col(gene).alias("gene"),
        F.col(product).alias("product"),
        *(none.alias(c) for c in ("bitscore", "e_value", "identity", "coverage")),
        F.lit("term_scan").alias("evidence_type"),
    ).dropDuplicates(["dataset_name", "analyte", "anchor_family", "protein_accession", "locus_tag"])


def summary(features: DataFrame, proteins: DataFrame, dataset: str, kind: str, coding: str, accession: str, length: str) -> DataFrame:
    """Counts for each dataset: coding rows, rows with a protein, mean protein length. Each table is aggregated before the
    join, so features and proteins of a dataset never multiply."""
    f = features.groupBy(dataset).agg(
        F.count("*").alias("n_features"),
        F.count_if(F.col(kind) == coding).alias("n_coding"),
        F.count(accession).alias("n_with_protein"),
    )
    p = proteins.groupBy(dataset).agg(F.count("*").alias("n_proteins"), F.avg(length).alias("mean_length"))
    return f.join(p, dataset, "full")


def counts(datasets: DataFrame, proteins: DataFrame, features: DataFrame, dataset: str = "dataset_name", accession: str = "protein_accession", feature: str = "feature_id") -> DataFrame:
    """(dataset, n_proteins, n_features) of every dataset: its different proteins and its features. Each table is counted by
    itself before the join, so one dataset's proteins and features never multiply."""
    p = proteins.groupBy(dataset).agg(F.count_distinct(accession).alias("n_proteins"))
    f = features.groupBy(dataset).agg(F.count(feature).alias("n_features"))
    out = datasets.select(dataset).distinct().join(p, dataset, "left").join(f, dataset, "left")
    return out.select(dataset, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_proteins", "n_features")))


def shards(datasets: DataFrame, name: str, group: str, by: str = "group", size: int = 1000, most: int | None = None) -> DataFrame:
    """(shard_id, shard_no, n_datasets, dataset_names, group): datasets by group, or in chunks of ``size`` by name.

    The table of datasets has one row for each genome, which is small beside what it describes.
    """
    rows = datasets.select(F.col(name).alias("__name"), F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("unknown")).alias("__group")).distinct()
    if by == "group":
        no = F.dense_rank().over(Window.orderBy("__group")) - 1
    else:
        no = F.floor((F.row_number().over(Window.orderBy("__group", "__name")) - 1) / size)
    out = (
        rows.withColumn("shard_no", no.cast("int"))
        .groupBy("shard_no")
        .agg(F.sort_array(F.collect_list("__name")).alias("dataset_names"), F.min("__group").alias("low"), F.max("__group").alias("high"))
        .withColumn("group", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("mixed"))
    )
    label = F.trim(F.lower(safe_identifier(F.col("group"), "-"))) if by == "group" else F.lit(None).cast("string")
    shard_id = F.concat_ws("-", F.lit("phylum" if by == "group" else "genomes"), F.lpad(F.col("shard_no").cast("string"), 4, "0"), label)
    out = out.select(shard_id.alias("shard_id"), "shard_no", F.size("dataset_names").alias("n_datasets"), "dataset_names", "group")
    return out.where(F.col("shard_no") < most) if most is not None else out


def pivot_metadata(rows: DataFrame, dataset: str, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """key/value rows as columns; unknown keys are dropped, absent ones empty."""
    return rows.groupBy(dataset).agg(*(F.coalesce(F.max(F.when(F.col("key") == prefix + k, F.col("value"))), F.lit("")).alias(k) for k in keys))
