"""WARC archives: write pages as records, normalise whole-stream gzip files, read records by their index.

A *monolithic* archive is one gzip stream over all its records, which cannot be entered in the middle.
The normaliser inflates such a stream once from front to end, a piece at a time, writes every record as
a gzip member of its own and puts a sidecar index (one line for each record: offset, length, type, id)
beside the file. Any record can then be read by seeking.

Files are written by tasks through ``pyarrow.fs`` under a folder that driver and executors share, first
under another name and then moved, so a task that runs again leaves the same file.

Defined results: null html is an empty payload; payloads under ``min_bytes`` are always responses; of
equal larger payloads the least id is the response; null ids are written as empty and read back as null;
an empty table gives no record; further columns are ignored. Rows that repeat an id become records of
their own, and copies of a payload under the response's own id stay responses.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, new_path, saved, table

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 20
LEVEL = 1


def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(payload)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Cut inflated bytes into whole records by their Content-Length."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                if not held.startswith(b"WARC/"):
                    raise ValueError("not at the start of a WARC record")
                need = end + 8 + int(fields(bytes(held[:end]))["content-length"])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends inside a record")


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}


def inflated(file) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or many members, read once."""
    inflate = zlib.decompressobj(31)
    while data := file.read(PIECE):
        while data:
            yield inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            else:
                break


def deflated(data: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class Placed:
    """A file that appears under its name only when it is whole."""

    def __init__(self, path: str):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.file = self.fs.open_output_stream(self.temporary, compression=None)
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if kind:
            self.fs.delete_file(self.temporary)
        else:
            self.fs.move(self.temporary, self.path)


def typed(pages: DataFrame, id_col: str, payload: str, min_bytes: int) -> DataFrame:
    """Each page's id, payload and the id it revisits (null for responses). Only digests travel to find the repeats; those are
    saved first, so that their size is known when payloads meet them: a few are broadcast by Spark's own size check and
    no payload moves, many are met by one shuffle."""
    bytes_ = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    body = pages.select(F.col(id_col).alias("id"), bytes_.alias("payload"), F.sha2(bytes_, 256).alias("digest"))
    digests = body.where(F.length("payload") >= min_bytes).select("id", "digest")
    firsts = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    repeats = saved(digests.join(firsts, "digest").where("first IS NOT NULL AND (id IS NULL OR id > first)").distinct().withColumnsRenamed({"id": "of", "digest": "has"}), "repeats")
    return body.join(repeats, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("has")), "left").select("id", "payload", "first")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload: str = "html", min_bytes: int = 100) -> DataFrame:
    """Write monolithic archives, one for each task, and return (path, records)."""

    def run(batches):
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        squeeze, n = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        first = next(batches, None)
        if first is None:
            return
        with Placed(path) as out:
            while first is not None:
                for page, first_id, data in zip(column(first, "id"), column(first, "first"), column(first, "payload"), strict=True):
                    digest = hashlib.sha256(data).hexdigest()
                    name = "" if page is None else page
                    head = [
                        ("WARC-Type", "response" if first_id is None else "revisit"),
                        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}')}>"),
                        ("WARC-Date", "1970-01-01T00:00:00Z"),
                        ("WARC-Target-URI", f"page:{name}"),
                        ("WARC-Payload-Digest", f"sha256:{digest}"),
                        ("X-Payload-Length", str(len(data))),
                        ("Content-Type", "text/html; charset=utf-8"),
                    ]
                    if first_id is not None:
                        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", f"page:{first_id}")]
                        data = b""
                    out.write(squeeze.compress(record(head, data)))
                    n += 1
                first = next(batches, None)
            out.write(squeeze.flush())
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return saved(typed(pages, id_col, payload, min_bytes).mapInArrow(run, "path string, records long"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``archives`` (column path) with one member for each record and a sidecar index.
    Returns (path, index, records, bytes) of the new files."""

    def run(batches):
        for batch in batches:
            for path in column(batch, "path"):
                fs, inner = pafs.FileSystem.from_uri(path)
                target = f"{folder}/{path.rpartition('/')[2]}"
                offset, lines = 0, []
                with fs.open_input_stream(inner, compression=None) as file, Placed(target) as out:
                    for whole in records(inflated(file)):
                        head = fields(whole[: whole.index(b"\r\n\r\n")])
                        member = deflated(whole)
                        out.write(member)
                        lines.append(f"{offset}\t{len(member)}\t{head['warc-type']}\t{head.get('warc-target-uri', '')}\n")
                        offset += len(member)
                with Placed(f"{target}.idx") as out:
                    out.write("".join(lines).encode())
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([f"{target}.idx"]), pa.array([len(lines)], pa.int64()), pa.array([offset], pa.int64())], names=["path", "index", "records", "bytes"])

    return saved(_one_each(archives.select("path")).mapInArrow(run, "path string, index string, records long, bytes long"), "normalised")


def read_records(archives: DataFrame) -> DataFrame:
    """Every record of normalised ``archives`` (path, index), found through the index:
    uri, type, refers_to, payload, declared digest and length, offset."""
    names = ["uri", "type", "refers_to", "payload", "digest", "n", "path", "offset"]

    def run(batches):
        for batch in batches:
            for path, index in zip(column(batch, "path"), column(batch, "index"), strict=True):
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(pafs.FileSystem.from_uri(index)[1], compression=None) as file:
                    places = [line.split("\t") for line in file.read().decode().splitlines()]
                rows, size = [], 0
                with fs.open_input_file(inner) as file:
                    for offset, length, *_ in places:
                        file.seek(int(offset))
                        whole = zlib.decompress(file.read(int(length)), 31)
                        end = whole.index(b"\r\n\r\n")
                        head = fields(whole[:end])
                        payload = whole[end + 4 : end + 4 + int(head["content-length"])]
                        rows.append((head["warc-target-uri"], head["warc-type"], head.get("warc-refers-to-target-uri"), payload, head["warc-payload-digest"], int(head["x-payload-length"]), path, int(offset)))
                        size += len(payload)
                        if size > 8 * PIECE:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], schema=_SCHEMA)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    assert names == _SCHEMA.names
    return _one_each(archives.select("path", "index")).mapInArrow(run, "uri string, type string, refers_to string, payload binary, digest string, n long, path string, offset long")


_SCHEMA = pa.schema([("uri", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("digest", pa.string()), ("n", pa.int64()), ("path", pa.string()), ("offset", pa.int64())])


def _one_each(paths: DataFrame) -> DataFrame:
    """Deal whole archives out evenly: the table of paths is small, the files behind it are not."""
    return paths.repartition(max(1, min(paths.count(), 100_000)))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    back = read_records(normalise(archives, new_path(spark, "warc-members")))
    number = lambda c: F.expr(f"try_cast(substring({c}, 6) AS long)")
    response = F.col("type") == "response"
    digest = F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index("digest", ":", -1))
    broken = response & ((F.concat(F.lit("sha256:"), F.sha2("payload", 256)) != F.col("digest")) | (F.length("payload") != F.col("n")))
    return back.select(
        number("uri").alias("page_id"),
        F.when(broken, F.raise_error(F.concat(F.lit("damaged record "), F.col("uri"))).cast("long")).otherwise(F.col("n")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""
