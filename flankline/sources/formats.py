"""Spark data sources for sequence, feature, taxonomy and hit files: ``spark.read.format("fasta").load(path)`` and so on.

Each source plans its partitions: a file is cut into byte ranges of ``split`` bytes (64 MiB), and a range reads the records
that begin in it, going on beyond its end for the last one. Gzip files are one range each. Errors are defined: a missing path, an
empty file and, unless ``mode`` is ``permissive``, a broken record with its file and byte. A permissive read keeps broken records
as rows that are null but for ``_corrupt``. Equality filters on text columns are taken over where Spark hands them down
(``spark.sql.python.filterPushdown.enabled``).

Paths are read by ``pyarrow.fs``: local ones and its addresses (``s3://`` and others). The functions in :mod:`files` read through
Spark alone and suit any of its file systems.

Formats: ``fasta``, ``gff3``, ``taxdump_nodes``, ``taxdump_names``, ``diamond``.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

SPLIT = 64 << 20
PIECE = 1 << 20
GFF_VERSION = b"##gff-version 3"


class MissingInput(FileNotFoundError):
    """There is no file at the path."""


class BrokenInput(ValueError):
    """A file is empty or holds a record that does not fit its format."""


@dataclass
class Range(InputPartition):
    """The records of a file that begin within some bytes; ``end`` -1: all."""

    path: str
    start: int
    end: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str) -> list[pafs.FileInfo]:
    """The file at a path or the files in a folder, hidden ones aside."""
    fs, place = opened(path)
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.NotFound:
        raise MissingInput(f"missing input: {path}")
    if info.is_file:
        return [info]
    found = [f for f in fs.get_file_info(pafs.FileSelector(place, recursive=True)) if f.is_file and f.base_name[0] not in "._"]
    if not found:
        raise MissingInput(f"missing input: no file in {path}")
    return sorted(found, key=lambda f: f.path)


def records(stream, start: int, end: int, mark: bytes) -> Iterator[tuple[int, bytes]]:
    """(first byte, record) of the records that begin in [start, end). A record begins at the stream's first byte or after the first
    byte of ``mark``, a line feed."""
    at = max(0, start - 1)
    stream.seek(at)
    held, more = b"", True

    def fill() -> None:
        nonlocal held, more
        piece = stream.read(PIECE)
        held, more = held + piece, bool(piece)

    def next_mark(of: int) -> int:
        while True:
            found = held.find(mark, of)
            if found >= 0 or not more:
                return found
            of = max(of, len(held) - len(mark) + 1)
            fill()

    fill()
    if start:
        found = next_mark(0)
        if found < 0:
            return
        held, at = held[found + 1 :], at + found + 1
    while (end < 0 or at < end) and (held or more):
        found = next_mark(0)
        record = held if found < 0 else held[:found]
        if record or found >= 0:
            yield at, record
        if found < 0:
            return
        held, at = held[found + 1 :], at + found + 1


class RangeReader(DataSourceReader):
    def __init__(self, source: RangeSource):
        self.options, self.names, self.source = source.options, [f.split()[0] for f in source.columns.split(", ")], source
        self.strict = self.options.get("mode", "strict").lower() != "permissive"
        self.equal: list[tuple[int, str]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.names and isinstance(f.value, str):
                self.equal.append((self.names.index(f.attribute[0]), f.value))
            else:
                yield f

    def partitions(self):
        path, split = self.options.get("path"), int(self.options.get("split", SPLIT))
        if not path:
            raise MissingInput("missing input: no path")
        out = []
        for f in listed(path):
            if not f.size:
                raise BrokenInput(f"empty input: {f.path}")
            fs, _ = opened(path)
            name = f.path if "://" not in path else path.partition("://")[0] + "://" + f.path
            with fs.open_input_stream(f.path, compression="gzip" if f.path.endswith(".gz") else None) as head:
                self.source.check(f.path, head.read(4096))
            if f.path.endswith(".gz"):
                out.append(Range(name, 0, -1))
            else:
                out += [Range(name, s, min(s + split, f.size)) for s in range(0, f.size, split)]
        return out

    def read(self, partition: Range):
        fs, place = opened(partition.path)
        with fs.open_input_file(place) as raw:
            stream = gzip.GzipFile(fileobj=raw) if place.endswith(".gz") else raw
            for at, record in records(stream, partition.start, partition.end, self.source.mark):
                try:
                    row = self.source.parse(record)
                except (ValueError, IndexError) as e:
                    if self.strict:
                        raise BrokenInput(f"broken record in {partition.path} at byte {at}: {e}") from None
                    row = (*([None] * len(self.names)), record.decode("utf-8", "replace"))
                    if not self.equal:
                        yield row
                    continue
                if row is not None and all(row[k] == v for k, v in self.equal):
                    yield row if self.strict else (*row, None)


class RangeSource(DataSource):
    """A format: its columns, what its records begin after, what a file must begin with, and how a record is read (None: no row)."""

    columns = ""
    mark = b"\n"

    def schema(self) -> str:
        permissive = self.options.get("mode", "strict").lower() == "permissive"
        return self.columns + (", _corrupt string" if permissive else "")

    def reader(self, schema) -> RangeReader:
        return RangeReader(self)

    def check(self, path: str, head: bytes) -> None:
        """Raises for a file that begins wrongly."""

    def parse(self, record: bytes) -> tuple | None:
        raise NotImplementedError


class Fasta(RangeSource):
    """The description includes the accession; a record without letters is broken."""

    columns = "accession string, description string, sequence string"
    mark = b"\n>"

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def parse(self, record: bytes) -> tuple | None:
        if not record.strip():
            return None
        if record[:1] != b">":
            raise ValueError("no header")
        head, _, body = record[1:].partition(b"\n")
        description = head.decode().strip()
        sequence = b"".join(body.split()).decode()
        if not sequence:
            raise ValueError(f"empty record {description}")
        return (description.split(None, 1)[0] if description else "", description, sequence)


class Gff3(RangeSource):
    """Nine fields; ``.`` is null in score and phase; attributes are percent-decoded, of a repeated key the last value stays."""

    columns = "seqid string, source string, type string, start bigint, end bigint, score double, strand string, phase int, attributes map<string,string>"

    @classmethod
    def name(cls) -> str:
        return "gff3"

    def check(self, path: str, head: bytes) -> None:
        if head.split(b"\n", 1)[0].strip() != GFF_VERSION:
            raise BrokenInput(f"{path} does not start with {GFF_VERSION.decode()}")

    def parse(self, record: bytes) -> tuple | None:
        line = record.decode().rstrip("\r")
        if not line.strip() or line.startswith("#"):
            return None
        cells = line.split("\t")
        if len(cells) != 9:
            raise ValueError(f"{len(cells)} fields")
        pairs = [p.strip().partition("=") for p in cells[8].split(";") if p.strip()] if cells[8] != "." else []
        if lone := [k for k, mark, _ in pairs if not mark]:
            raise ValueError(f"attribute without value: {lone[0]}")
        score, phase = (None if cells[k] == "." else kind(cells[k]) for k, kind in ((5, float), (7, int)))
        return (*cells[:3], int(cells[3]), int(cells[4]), score, cells[6], phase, {unquote(k): unquote(v) for k, _, v in pairs})


def dump_cells(record: bytes) -> list[str] | None:
    line = record.decode().rstrip("\r")
    return line.removesuffix("\t|").split("\t|\t") if line.strip() else None


class TaxdumpNodes(RangeSource):
    columns = "taxon_id bigint, parent_id bigint, rank string"

    @classmethod
    def name(cls) -> str:
        return "taxdump_nodes"

    def parse(self, record: bytes) -> tuple | None:
        cells = dump_cells(record)
        return cells and (int(cells[0]), int(cells[1]), cells[2])


class TaxdumpNames(RangeSource):
    """Scientific names."""

    columns = "taxon_id bigint, name string"

    @classmethod
    def name(cls) -> str:
        return "taxdump_names"

    def parse(self, record: bytes) -> tuple | None:
        cells = dump_cells(record)
        return (int(cells[0]), cells[1]) if cells and cells[3].strip() == "scientific name" else None


class Diamond(RangeSource):
    """Hits in fourteen columns."""

    columns = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qcovhsp double, scovhsp double"

    @classmethod
    def name(cls) -> str:
        return "diamond"

    def parse(self, record: bytes) -> tuple | None:
        line = record.decode().rstrip("\r")
        if not line.strip():
            return None
        cells = line.split("\t")
        if len(cells) != 14:
            raise ValueError(f"{len(cells)} fields")
        return (*cells[:2], float(cells[2]), *map(int, cells[3:10]), *map(float, cells[10:]))


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (Fasta, Gff3, TaxdumpNodes, TaxdumpNames, Diamond):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
