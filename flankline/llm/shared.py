"""Scratch tables in the cluster's shared folder, bounded samples and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_OWN: dict[str, str] = {}
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full address: that of ``spark.checkpoint.dir`` or else of
    ``setCheckpointDir``. Where neither is set, one machine (a local master) makes a temporary folder; a cluster fails, since
    executors would not see each other's files."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or _OWN.get(context.applicationId)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="flankline-")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/flankline/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`saved` that nothing needs any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _deleted(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever is put into the shared folder inside goes in the end: for work whose result is stored elsewhere by then.
    Without it a session's folders stay until :func:`cleared`."""
    mark = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[mark:]:
            _deleted(spark, path)
        del _MADE[mark:]


def cleared(spark: SparkSession) -> None:
    """Delete everything that this driver has put into the shared folder and not deleted yet."""
    for path in _MADE:
        _deleted(spark, path)
    _MADE.clear()


def clear_of(taken: Sequence[str], *names: str) -> list[str]:
    """``names``, lengthened where needed so that they clash with none of ``taken`` (case aside, as Spark compares them)."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while f"__{name}" in used:
            name += "_"
        out.append(f"__{name}")
        used.add(out[-1])
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column, modulus: int):
    """crc32 of the value written as text, modulo ``modulus``: the rule that sets held-out rows aside."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def some_rows(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows, the same ones whatever the partitioning: those with the least hash of ``key``."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(rows)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node on an edge, root being the least node that can be reached.

    Alternates large-star and small-star steps until the edge set stops changing; each step is a
    grouped minimum (combined before its shuffle) and a join that adaptive execution can split, so
    no component is ever gathered in one place. Each round is written to the shared folder. Self-loops
    and null ends are ignored; an empty input gives an empty result.
    """
    now = saved(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        then = saved(small, "edges")
        seen = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(now)
        now = then
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of i[k] and j[k]; ``label`` points at the least member and stays compressed."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (label != label[label]).any():
            label[:] = label[label]


def forest(linked: np.ndarray) -> np.ndarray:
    """Root (least position) of each row of a small symmetric boolean link matrix."""
    n = len(linked)
    root, free = np.arange(n), np.ones(n, bool)
    for start in range(n):
        if not free[start]:
            continue
        free[start], stack = False, [start]
        while stack:
            found = np.flatnonzero(linked[stack.pop()] & free)
            free[found], root[found] = False, start
            stack.extend(found.tolist())
    return root
