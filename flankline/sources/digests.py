"""Content digests of files of any size, and the manifest that names a run.

A file's digest is that of a tree: chunks of ``CHUNK`` bytes are hashed in tasks, and the hashes of a file's chunks, in order, are hashed
again. So the digest depends on the bytes alone, not on how the work was dealt. A folder's digest is over its files'
names and digests. Chunks are read by ``pyarrow.fs`` where it knows the address, and through Spark's ``binaryFile`` elsewhere; both
give the same digest.
"""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flankline.sources.formats import MissingInput, opened

CHUNK = 64 << 20


def listed(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """(name within ``path``, full address, bytes) of the file or of a folder's files, by Spark's file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        raise MissingInput(f"missing input: {path}")
    top, out, found = fs.makeQualified(place).toUri().getPath(), [], fs.listFiles(place, True)
    while found.hasNext():
        status = found.next()
        if not status.getPath().getName().endswith(".crc"):
            out.append((status.getPath().toUri().getPath()[len(top) + 1 :], status.getPath().toString(), status.getLen()))
    return sorted(out)


def chunk_digests(spark: SparkSession, path: str, chunk: int = CHUNK, through_spark: bool = False) -> DataFrame:
    """(name, start, digest) of every chunk; an empty file has one empty chunk."""
    files = listed(spark, path)
    address = path.partition("://")[0] if "://" in path else "file"
    if through_spark or address not in ("file", "s3", "gs", "gcs", "abfs"):
        read = spark.createDataFrame([(name, full) for name, full, _ in files], "name string, path string")
        contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", "length")
        plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        met = contents.withColumn("path", plain(F.col("path"))).join(read.withColumn("path", plain(F.col("path"))), "path")
        starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("length") - 1), F.lit(chunk).cast("long"))
        hashed = met.select("name", "content", F.explode(starts).alias("start")).select("name", "start", F.sha2(F.substring("content", F.col("start").cast("int") + 1, F.lit(chunk)), 256).alias("digest"))
        empty = [(name, 0, hashlib.sha256().hexdigest()) for name, _, size in files if not size]  # which Spark reads no row of
        return hashed.where("length(digest) > 0").unionByName(spark.createDataFrame(empty, hashed.schema)).dropDuplicates(["name", "start"])
    ranges = [(name, full, s, min(s + chunk, size)) for name, full, size in files for s in range(0, max(1, size), chunk)]

    def run(batches):
        for batch in batches:
            out = []
            for full, start, end in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                fs, place = opened(full)
                with fs.open_input_file(place) as f:
                    f.seek(start)
                    digest, left = hashlib.sha256(), end - start
                    while left and (piece := f.read(min(left, 1 << 20))):
                        digest.update(piece)
                        left -= len(piece)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.string())], names=["name", "start", "digest"])

    tasks = min(len(ranges), 8 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame(ranges, "name string, path string, start long, end long").repartition(tasks).mapInArrow(run, "name string, start long, digest string")


def file_digests(spark: SparkSession, path: str, chunk: int = CHUNK, through_spark: bool = False) -> DataFrame:
    """(name, digest) of every file."""
    chunks = chunk_digests(spark, path, chunk, through_spark).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("start", "digest"))).alias("c"))
    return chunks.select("name", F.sha2(F.array_join(F.transform("c", lambda x: x["digest"]), ""), 256).alias("digest"))


def digest(spark: SparkSession, path: str, chunk: int = CHUNK, through_spark: bool = False) -> str:
    """One digest of a file or folder: files' names and digests in order of names; of a folder one row for each file comes back."""
    rows = sorted(map(tuple, file_digests(spark, path, chunk, through_spark).collect()))
    return hashlib.sha256(json.dumps(rows).encode()).hexdigest()


def versions(spark: SparkSession) -> dict[str, str]:
    import numpy
    import pandas
    import pyspark

    return {"java": spark._jvm.System.getProperty("java.version"), "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pa.__version__, "python": platform.python_version(), "spark": pyspark.__version__}


def manifest(spark: SparkSession, config: Mapping, inputs: Mapping[str, str], command: str = "", seed: int = 0) -> dict:
    """What names a run: hashes of the configuration and the inputs, the command, the seed and the versions, and of all these."""
    body = {
        "command": command,
        "config_hash": hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest(),
        "input_hashes": {name: digest(spark, path) for name, path in sorted(inputs.items())},
        "seed": seed,
        "versions": versions(spark),
    }
    return body | {"run_hash": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}


def write_manifest(spark: SparkSession, body: Mapping, path: str) -> None:
    """The manifest as one JSON file, wherever Spark can write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    stream.write(bytearray(json.dumps(body, sort_keys=True, indent=2).encode()))
    stream.close()
