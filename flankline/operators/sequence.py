"""Motif scans by tiles, alignment columns, residue maps.

A scan cuts each sequence into tiles that overlap by a window less one letter, so that every window lies in one tile
and a chromosome is many tasks. Sequences of one tile stay where they are read; longer ones are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flankline.functions.scalars import IUPAC, RESIDUES
from flankline.session import checkpoint_folder

#: Window starts of a tile.
TILE = 1 << 18
#: Matrix cells (choices of one byte) that a batch of residue maps may hold.
CELLS = 1 << 25
_COMPLEMENT = np.arange(256)
for _a, _b in zip(b"ACGTRYSWKMBDHVN", b"TGCAYRSWMKVHDBN", strict=True):
    _COMPLEMENT[_a] = _b
_COMPLEMENT_BYTES = bytes(_COMPLEMENT.tolist())


def letters(sequence: str) -> bytes:
    """One byte for each letter, a-z as A-Z; letters beyond U+00FF match nothing."""
    return sequence.encode("latin-1", "replace").upper()


def tiles(rows: DataFrame, key: Sequence[str], sequence: str, width: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Two tables (key, seq, total, first, piece): sequences of one tile, and the tiles of longer ones, dealt out. A piece has the
    letters of ``size`` window starts from ``first`` on (from 0) and the ``width`` - 1 letters after them; ``seq`` numbers
    the sequences. Null sequences and those shorter than a window have none."""

    def run(batches):
        for batch in batches:
            for k, text in enumerate(batch.column(len(key))):
                body = letters(text.as_py())
                starts = range(0, len(body) - width + 1, size)
                for s in range(0, len(starts), 16):
                    firsts = list(starts[s : s + 16])
                    same = pa.array([k] * len(firsts), pa.int64())
                    more = [pa.array([len(body)] * len(firsts), pa.int64()), pa.array(firsts, pa.int64()), pa.array([body[f : f + size + width - 1] for f in firsts], pa.binary())]
                    columns = [*(batch.column(c).take(same) for c in range(len(key))), batch.column(len(key) + 1).take(same), *more]
                    yield pa.RecordBatch.from_arrays(columns, names=[*key, "__seq", "__total", "__first", "__piece"])

    given = rows.where(F.length(sequence) >= width).select(*key, F.col(sequence).alias("__text"), F.monotonically_increasing_id().alias("__seq"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[: len(key)])
    cut, one = (given.where(c).mapInArrow(run, f"{kinds}__seq long, __total long, __first long, __piece binary") for c in (F.length("__text") > size + width - 1, F.length("__text") <= size + width - 1))
    return one, cut.repartition("__seq", "__first")


def scanned(pieces: DataFrame, key: Sequence[str], width: int, find: Callable[[bytes, str, int], tuple[np.ndarray, np.ndarray]], strands: Sequence[str] = ("+", "-")) -> DataFrame:
    """(key, strand, start, end, site, score) of what ``find`` (piece, strand, entry) gives in each piece: window starts in the
    piece and scores. Places on - are those of the reverse complement. Pieces may name a strand and an entry (``__strand``,
    ``__entry``)."""
    named = "__strand" in pieces.columns
    source = pieces.select(*key, "__total", "__first", "__piece", *(("__strand", "__entry") if named else ()))

    def run(batches):
        for batch in batches:
            n = len(key)
            for k in range(batch.num_rows):
                total, first = (batch.column(c)[k].as_py() for c in (n, n + 1))
                piece = batch.column(n + 2)[k].as_py()
                for strand in [batch.column(n + 3)[k].as_py()] if named else strands:
                    at, score = find(piece, strand, batch.column(n + 4)[k].as_py() if named else 0)
                    for s in range(0, len(at), 1 << 14):
                        some = at[s : s + (1 << 14)]
                        sites = [piece[p : p + width] for p in some.tolist()]
                        if strand == "-":
                            sites = [x[::-1].translate(_COMPLEMENT_BYTES) for x in sites]
                        start = some + first + 1 if strand == "+" else total - (some + first) - width + 1
                        same = pa.array([k] * len(some), pa.int64())
                        more = [pa.array([strand] * len(some), pa.string()), pa.array(start, pa.int32()), pa.array(start + width - 1, pa.int32()), pa.array([x.decode("latin-1") for x in sites], pa.string()), pa.array(score[s : s + (1 << 14)], pa.float64())]
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in range(n)), *more], names=[*key, "strand", "start", "end", "site", "score"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[: len(key)])
    return source.mapInArrow(run, f"{kinds}strand string, start int, end int, site string, score double")


def along(piece: bytes, strand: str, width: int, table: np.ndarray, start: np.ndarray, add) -> np.ndarray:
    """Fold ``table[k][letter k of the window]`` over all windows of a piece, in the order of the strand."""
    codes = np.frombuffer(piece, np.uint8)
    n = len(codes) - width + 1
    out = np.repeat(start, n)
    for k in range(width):
        out = add(out, table[k][codes[k : k + n]] if strand == "+" else table[k][_COMPLEMENT[codes[width - 1 - k : width - 1 - k + n]]])
    return out


def pwm_scan(rows: DataFrame, key: Sequence[str], sequence: str, pwm: Sequence[Mapping[str, float]], least: float, size: int = TILE) -> DataFrame:
    """(key, strand, start, end, site, score): windows of A, C, G, T whose summed log2(p / 0.25) is at least ``least``."""
    width = len(pwm)
    table = np.full((width, 256), np.nan)
    for k, p in enumerate(pwm):
        for b in "ACGT":
            table[k, ord(b)] = math.log2(max(p[b], 1e-6) / 0.25)

    def find(piece: bytes, strand: str, entry: int):
        score = along(piece, strand, width, table, np.zeros(1), np.add)
        at = np.flatnonzero(score >= least)
        return at, score[at]

    one, cut = tiles(rows, key, sequence, width, size)
    return scanned(one.unionByName(cut), key, width, find)


def iupac_table(motif: str) -> np.ndarray:
    plain = motif.upper().replace("-", "")
    if not plain or any(c not in IUPAC for c in plain):
        raise ValueError(f"not an IUPAC motif: {motif!r}")
    table = np.zeros((len(plain), 256), bool)
    for k, c in enumerate(plain):
        table[k, list(IUPAC[c].encode())] = True
    return table


def leftmost(places: np.ndarray, width: int, entry: int) -> tuple[list[int], int]:
    """Of sorted places, those that matches from left to right take without overlap from ``entry`` on; and where the last ends."""
    out, free = [], entry
    for p in places.tolist():
        if p >= free:
            out.append(p)
            free = p + width
    return out, free


def exits(places: np.ndarray, width: int, starts: int) -> list[int]:
    """For each entry 0 .. ``width`` - 1, the first letters of a tile that the match before it holds: how many of the next
    tile's the last match then holds. Chains of matches merge, so each place is walked through about once."""
    end_of: dict[int, int] = {}
    listed, out = places.tolist(), []
    for entry in range(width):
        at = int(np.searchsorted(places, entry))
        if at == len(listed):
            out.append(max(0, entry - starts))
            continue
        chain = []
        while at < len(listed) and at not in end_of:
            chain.append(at)
            at = int(np.searchsorted(places, listed[at] + width))
        end = end_of[at] if at < len(listed) else listed[chain[-1]] + width
        end_of.update(dict.fromkeys(chain, end))
        out.append(max(0, end - starts))
    return out


def iupac_scan(rows: DataFrame, key: Sequence[str], sequence: str, motif: str, size: int = TILE) -> DataFrame:
    """(key, strand, start, end, site, score): matches from left to right that do not overlap; the score is the length.

    Which matches of a tile count depends on how far the last match before it reaches into it, at most a window less one
    letter. Each tile says for all these entries where it lets go; the tiles of a sequence, some numbers each, are
    chained, and then every tile knows its entry."""
    table = iupac_table(motif)
    width = len(table)

    def places(piece: bytes, strand: str) -> np.ndarray:
        """Window starts that match, counted along the strand."""
        at = np.flatnonzero(along(piece, strand, width, table, np.ones(1, bool), np.logical_and))
        return at if strand == "+" else (len(piece) - width - at)[::-1]

    def find(piece: bytes, strand: str, entry: int):
        at = np.array(leftmost(places(piece, strand), width, entry)[0], np.int64)
        return (at if strand == "+" else len(piece) - width - at), np.full(len(at), float(width))

    def ends(batches):
        for batch in batches:
            out = [(seq, strand, first, exits(places(piece, strand), width, len(piece) - width + 1)) for seq, first, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for strand in "+-"]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["__seq", "__strand", "__first", "__exits"])

    one, cut = tiles(rows, key, sequence, width, size)
    checkpoint_folder(rows.sparkSession)
    cut = cut.checkpoint()
    told = cut.select("__seq", "__first", "__piece").mapInArrow(ends, "__seq long, __strand string, __first long, __exits array<int>")
    order = F.when(F.col("__strand") == "+", F.col("__first")).otherwise(-F.col("__first"))
    chains = told.groupBy("__seq", "__strand").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "__first", "__exits"))).alias("c"))
    none = F.struct(F.lit(0).alias("e"), F.array().cast("array<struct<__first:bigint,__entry:int>>").alias("l"))
    walk = F.aggregate("c", none, lambda acc, x: F.struct(F.get(x["__exits"], acc["e"]).alias("e"), F.array_append(acc["l"], F.struct(x["__first"].alias("__first"), acc["e"].alias("__entry"))).alias("l")))
    entries = chains.select("__seq", "__strand", F.explode(walk["l"]).alias("x")).select("__seq", "__strand", "x.__first", "x.__entry")
    return scanned(one, key, width, find).unionByName(scanned(cut.join(entries, ["__seq", "__first"]), key, width, find))


def column_conservation(alignment: DataFrame, sequence: str, group: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """For each alignment column the commonest residue (gaps aside, least letter on ties) and its share of non-gaps."""
    cells = alignment.select(*group, F.posexplode(F.split(F.col(sequence), "")).alias("place", "residue")).where("residue <> ''")
    counts = cells.groupBy(*group, "place", "residue").count()
    top = counts.where("residue <> '-'").groupBy(*group, "place").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("residue").alias("r"))).alias("b"), F.sum("count").alias("n_residues"))
    out = top.select(*group, (F.col("place") + 1).alias("column"), F.col("b.r").alias("residue"), (-F.col("b.n")).alias("n_residue"), "n_residues", (-F.col("b.n") / F.col("n_residues")).alias("conservation"))
    return out.withColumn("is_conserved", F.col("conservation") >= threshold)


def alignment_rows(a: np.ndarray, b: np.ndarray, match: int, mismatch: int, gap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows 1, 2, ... of the alignment matrices of several pairs (letters: pairs x places): scores, and where a cell is
    reached diagonally and, if not, from above. What is left is reached from the left: a row's scores are the running maximum of
    its other ways, each less the gaps to come."""
    gaps = gap * np.arange(b.shape[1] + 1)
    score = np.tile(gaps, (len(b), 1))
    for i in range(a.shape[1]):
        up = score + gap
        over = score[:, :-1] + np.where(a[:, i : i + 1] == b, match, mismatch)
        best = up.copy()
        np.maximum(best[:, 1:], over, out=best[:, 1:])
        score = np.maximum.accumulate(best - gaps, axis=1) + gaps
        diagonal = np.zeros(score.shape, bool)
        diagonal[:, 1:] = score[:, 1:] == over
        yield score, diagonal, score == up


def aligned_together(pairs: list[tuple[str, str]], match: int, mismatch: int, gap: int) -> list[list[tuple[int, int]]]:
    """The places that each pair aligns, all pairs at once, from matrices of one byte a cell. Shorter sequences are filled up on
    the right, where no way from their own end leads."""
    height, width = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a, b = np.zeros((len(pairs), height), np.int32), np.zeros((len(pairs), width), np.int32)
    for k, (x, y) in enumerate(pairs):
        a[k, : len(x)], b[k, : len(y)] = list(map(ord, x)), list(map(ord, y))
    ways = np.zeros((height, len(pairs), width + 1), np.uint8)
    for i, (_, diagonal, up) in enumerate(alignment_rows(a, b, match, mismatch, gap)):
        ways[i] = np.where(diagonal, 2, up)
    out = []
    for k, (x, y) in enumerate(pairs):
        i, j, steps = len(x), len(y), []
        own = ways[:, k]
        while i and j:
            way = own[i - 1, j]
            if way == 2:
                steps.append((i, j))
            i, j = i - (way > 0), j - (way != 1)
        out.append(steps[::-1])
    return out


def crossing(a: str, b: str, match: int, mismatch: int, gap: int) -> int:
    """The place of ``b`` at which the alignment passes the middle row of ``a``: each cell of the rows below carries that place along
    the way it is reached."""
    codes = [np.array(list(map(ord, x)), np.int32)[None] for x in (a, b)]
    middle = len(a) // 2
    at = np.arange(len(b) + 1)
    place = np.arange(len(b) + 1)
    for i, (_, diagonal, up) in enumerate(alignment_rows(*codes, match, mismatch, gap), 1):
        if i <= middle:
            continue
        given = np.where(up[0], at, -1)
        given[1:] = np.where(diagonal[0, 1:], at[:-1], given[1:])
        source = np.maximum.accumulate(np.where(diagonal[0] | up[0], place, 0))  # whoever is reached from the left has its left neighbour's
        at = given[source]
    return int(at[-1])


def align(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -2, cells: int = CELLS) -> list[tuple[int, int, int]]:
    """Global alignment: (column, place in a, place in b), 1-based, where neither has a gap. Ties: diagonal, up, left.

    A matrix of over ``cells`` cells is never held: the alignment is cut where it passes the middle row, and both halves are
    aligned by themselves. The way back from a cell looks at scores only, and those before the cut are the same, while those after
    it differ by what the cut's cell has; so the halves take the same ways as the whole."""
    found: list[tuple[int, int]] = []
    todo = [(a, b, 0, 0)]
    while todo:
        x, y, i, j = todo.pop()
        if len(x) * (len(y) + 1) <= max(cells, len(y) + 1) or len(x) < 2:
            if x and y:
                found += [(i + p, j + q) for p, q in aligned_together([(x, y)], match, mismatch, gap)[0]]
            continue
        middle = len(x) // 2
        cut = crossing(x, y, match, mismatch, gap)
        todo += [(x[middle:], y[cut:], i + middle, j + cut), (x[:middle], y[:cut], i, j)]
    return columns(found)


def columns(places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Aligned places with their alignment columns: each place not aligned before a pair is a column with a gap."""
    return [(p + q - k - 1, p, q) for k, (p, q) in enumerate(places)]


def residue_map(rows: DataFrame, key: Sequence[str], a: str, b: str, cells: int = CELLS) -> DataFrame:
    """Aligned residue pairs of two sequences of each row. Pairs of like length are aligned together, long ones in linear memory.
    A null sequence is empty and aligns with nothing."""

    def run(batches):
        for batch in batches:
            texts = [[t or "" for t in batch.column(len(key) + c).to_pylist()] for c in (0, 1)]
            group: list[int] = []

            def flushed(group: list[int], texts=texts):
                return zip(group, map(columns, aligned_together([(texts[0][k], texts[1][k]) for k in group], 2, -1, -2)), strict=True)

            out: list[tuple[int, list]] = []
            height = width = 0
            for k in sorted(range(batch.num_rows), key=lambda k: (len(texts[0][k]), len(texts[1][k]))):
                n, m = len(texts[0][k]), len(texts[1][k])
                if not n or not m:
                    continue
                if n * (m + 1) > cells:
                    out.append((k, align(texts[0][k], texts[1][k], cells=cells)))
                    continue
                if group and (len(group) + 1) * max(height, n) * (max(width, m) + 1) > cells:
                    out += flushed(group)
                    group, height, width = [], 0, 0
                group.append(k)
                height, width = max(height, n), max(width, m)
            if group:
                out += flushed(group)
            for k, places in out:
                for s in range(0, len(places), 1 << 14):
                    some = places[s : s + (1 << 14)]
                    same = pa.array([k] * len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in range(len(key))), *(pa.array(c, pa.int32()) for c in zip(*some, strict=True))], names=[*key, "alignment_index", "a_index", "b_index"])

    source = rows.select(*key, a, b)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[: len(key)])
    return source.mapInArrow(run, f"{kinds}alignment_index int, a_index int, b_index int")


def residue_letter(name) -> F.col:
    table = F.create_map(*(F.lit(x) for item in sorted(RESIDUES.items()) for x in item))
    return F.coalesce(table[F.upper(name)], F.lit("X"))
