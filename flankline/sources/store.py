"""The corpus store: proteins and features by phylum and dataset, and the table of datasets, each under a commit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flankline.sources import commits

PARTITIONS = ["phylum", "dataset_name"]
TAXONOMY: dict[str, str | int] = {"taxon_id": 0, "superkingdom": "", "phylum": "", "class": "", "order": "", "family": "", "genus": "", "species": ""}
SHARD_COLUMNS = ["shard_id", "shard_no", "n_datasets", "dataset_names", "group"]


def write_partitions(rows: DataFrame, root: str, table: str) -> int:
    """Put ``rows`` in place of just the partitions that occur in them, as one commit; all datasets of a load go in one job. Of two
    loads of one dataset the later one's rows stay, whole."""
    return commits.replace_partitions(rows, f"{root}/{table}", PARTITIONS)


def append(rows: DataFrame, root: str, table: str, mark: str | None = None) -> int | None:
    """Add ``rows``; a ``mark`` that has been committed before adds nothing."""
    return commits.append(rows, f"{root}/{table}", PARTITIONS, mark)


def compact(spark: SparkSession, root: str, table: str) -> int | None:
    """Bring the small files that ingest leaves together, partition by partition, while others go on appending."""
    return commits.compact(spark, f"{root}/{table}", PARTITIONS)


def upsert_datasets(spark: SparkSession, datasets: DataFrame, root: str, key: str = "dataset_name") -> int:
    """Replace the rows of the given datasets; columns that either side lacks become null. Upserts at the same time follow one
    another."""

    def merged(old: DataFrame | None) -> DataFrame:
        return datasets if old is None else old.join(datasets.select(key), key, "left_anti").unionByName(datasets, allowMissingColumns=True)

    return commits.rewrite(spark, f"{root}/datasets", merged, what="upsert")


def read_datasets(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    return commits.read(spark, f"{root}/datasets", version)


def read(spark: SparkSession, root: str, table: str, version: int | None = None, phylum: str | None = None, datasets: list[str] | None = None) -> DataFrame:
    """A table of the store as of a commit (the last one). ``phylum`` and ``datasets`` choose partitions by the log, so that only
    their files are listed; other filters are pushed into the files."""
    wanted = lambda p: (phylum is None or p[0] == phylum) and (datasets is None or p[1] in datasets)
    rows = commits.read(spark, f"{root}/{table}", version, wanted)
    if rows is None:
        raise FileNotFoundError(f"no {table} in the store at {root}")
    return rows


def write_shards(shards: DataFrame, path: str) -> None:
    """The shard manifest: one row for each shard, its datasets as a list."""
    shards.select(*SHARD_COLUMNS).write.mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    if missing := [c for c in SHARD_COLUMNS if c not in rows.columns]:
        raise ValueError(f"{path} is no shard manifest: missing {missing}")
    return rows.select(*SHARD_COLUMNS)


def dataset_taxonomy(spark: SparkSession, root: str, dataset: str) -> dict:
    """The row of one dataset in the table of datasets; nothing for an unknown one."""
    datasets = read_datasets(spark, root)
    row = None if datasets is None else datasets.where(F.col("dataset_name") == dataset).first()
    return row.asDict() if row else {}


def register_views(spark: SparkSession, root: str) -> None:
    for name in ("proteins", "features"):
        read(spark, root, name).createOrReplaceTempView(name)
    datasets = read_datasets(spark, root)
    if datasets is not None:
        datasets.createOrReplaceTempView("datasets")


def with_dataset(rows: DataFrame, dataset: str, taxonomy: dict[str, str | int]) -> DataFrame:
    """Literal dataset and taxonomy columns: unknown ranks are empty, an unknown taxon is 0, an empty phylum is ``unknown``; keys that are
    no part of a taxonomy are left out."""
    known = TAXONOMY | {k: v for k, v in taxonomy.items() if k in TAXONOMY and v is not None}
    known["phylum"] = known["phylum"] or "unknown"
    return rows.withColumns({"dataset_name": F.lit(dataset), "taxon_id": F.lit(int(known["taxon_id"])).cast("long"), **{k: F.lit(str(v)) for k, v in known.items() if k != "taxon_id"}})
