"""Packing token pieces into sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits into one sequence. The linear program asks for
the fewest sequences whose configurations cover the length histogram; its dual puts a price on every
length such that no configuration is worth more than one sequence. It is solved by multiplicative
weights: a length's price is multiplied down as its demand is covered, so that lengths that lag become
dearer. A knapsack dynamic programme prices the configurations: its table says what every room is worth
at the current prices, the dearest configuration is read off it, and its worth of a whole sequence turns
the prices into a lower bound on any packing (the dual value). The table is made anew whenever a few
hundredths of what was left are covered. The solution is rounded down to whole, full sequences; those
that are not full are taken apart and their pieces packed by best fit on counts.

All of that works on the histogram, which has at most ``capacity`` rows however many documents there
are; pieces then look up their places by length and rank.

Defined results: a null or empty text is its closing token alone; repeated rows, repeated and null ids are packed
separately; a string of a special token becomes that token, as the vocabulary's own library has it; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import column, saved, table

CAPACITY = 2048
#: The power of the share still to be covered that a price is multiplied by.
RATE = 0.06
#: The table of the dynamic programme is renewed when this share of what was left has been covered.
RENEWED = 0.03
#: A configuration is used until it covers 1/4 of what is left of a length, or 1/64 of all of it.
STEP, LEAST_STEP = 4, 64


def tokenizer(vocabulary: str):
    """A function text -> ids for a byte-level BPE file of the ``tokenizers`` library, special tokens in the text
    included. The ranks in the file are given to ``tiktoken``, which yields the same ids several times faster; where
    it gives up on a text, or the file asks for more than it knows, the file's own library does the work."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    plain = lambda text: slow.encode(text, add_special_tokens=False).ids
    with open(vocabulary, encoding="utf-8") as file:
        spec = json.load(file)
    kinds = {x.get("type") for x in ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}])}
    added = spec.get("added_tokens", [])
    if kinds != {"ByteLevel"} or spec.get("normalizer") or any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return plain
    special = {x["content"]: x["id"] for x in added}
    # the printable stand-ins of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the split of byte-level BPE
    fast = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as e:  # a panic of the splitting engine on a very long run is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return plain(text)

    return encode


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document; only documents over ``capacity`` are cut."""

    def run(batches):
        encode = tokenizer(vocabulary)
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for k, body in enumerate(column(batch, "__text")):
                ids = np.array([*encode(body or ""), end_id], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for to, value in zip(rows, (k, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        to.append(value)
            ids_of = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_of, pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], names=[id_col, "piece", "start", "length", "ids_crc32"])

    source = docs.select(id_col, F.col(text).alias("__text"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


Config = tuple[int, ...]


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """best[c]: the highest price that pieces of total length at most c can have. ``lengths`` rise."""
    best = np.zeros(capacity + 1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for c in range(int(lengths[0]), capacity + 1):
        k = fits[c]
        best[c] = max(best[c - 1], (best[c - lengths[:k]] + prices[:k]).max())
    return best


@dataclass
class Solution:
    """Configurations (positions in the lengths, longest first) with their numbers of sequences, in the order in which they were
    found; the value of that solution; and the dual value, which no packing can be below."""

    uses: dict[Config, float]
    value: float
    bound: float


def dual_value(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 8) -> float:
    """A lower bound on any packing. Prices start as lengths; a length whose dearest configuration is worth less than a sequence
    is made dearer, by half of what it could be alone, and all prices are scaled to the dearest configuration of all."""
    price, bound = lengths / capacity, 0.0
    for _ in range(rounds):
        best = knapsack(lengths, price, capacity)
        bound = max(bound, float((counts * price).sum() / best[capacity]))
        price = price * np.sqrt(np.maximum(1, (best[capacity] - best[capacity - lengths]) / price))
    return bound


def solved(lengths: np.ndarray, counts: np.ndarray, capacity: int, rate: float = RATE, renewed: float = RENEWED) -> Solution:
    """The configuration linear program. ``lengths`` rise; every count is covered exactly."""
    counts = counts.astype(np.float64)
    size = lengths / capacity
    mass = todo = float((counts * size).sum())
    bound, renew_at = dual_value(lengths, counts, capacity), mass
    least = np.maximum(1, np.ceil(counts / LEAST_STEP))
    left, used = counts.copy(), np.zeros(len(lengths))
    uses: dict[Config, float] = defaultdict(float)
    while (left > 0).any():
        if todo <= renew_at:
            is_open = left > 0
            price = size * (left / counts * (mass / max(todo, 1e-9))) ** rate
            best = knapsack(lengths[is_open], price[is_open], capacity)
            bound = max(bound, float((counts * price).sum() / best[capacity]))
            renew_at, drawn = min(todo * (1 - renewed), todo - min(1, todo / 20)), mass / max(todo, 1e-9)
        # the dearest configuration: every piece is the one with the highest price together with the worth of the room behind it
        room, config = capacity, []
        used[:] = 0
        while k := int(np.searchsorted(lengths, room, side="right")):
            worth = price[:k] + best[room - lengths[:k]]
            worth[used[:k] + 1 > left[:k]] = -1
            i = k - 1 - int(worth[::-1].argmax())  # the longest on ties
            if worth[i] < 0:
                break
            config.append(i)
            used[i] += 1
            room -= int(lengths[i])
        kinds, times = np.unique(config, return_counts=True)
        step = np.minimum(np.maximum(least[kinds], left[kinds] / STEP), left[kinds])
        amount = max(1.0, float(np.floor((step / times).min())))
        uses[tuple(sorted(config, reverse=True))] += amount
        left[kinds] -= amount * times
        todo -= amount * (capacity - room) / capacity
        price[kinds] = size[kinds] * (left[kinds] / counts[kinds] * drawn) ** rate
    return Solution(uses, sum(uses.values()), bound)


def rounded(lengths: np.ndarray, counts: np.ndarray, solution: Solution, capacity: int) -> tuple[list[tuple[Config, int]], np.ndarray]:
    """The solution's full configurations in whole sequences, and the counts of what they leave."""
    left = counts.astype(np.int64).copy()
    out = []
    for config, n in solution.uses.items():
        kinds, times = np.unique(config, return_counts=True)
        whole = min(int(np.floor(n + 1e-9)), int((left[kinds] // times).min()))
        if whole and int((lengths[kinds] * times).sum()) == capacity:
            left[kinds] -= whole * times
            out.append((config, whole))
    return out, left


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """Best fit, longest first, on counts: bins of equal content are one entry under the room that is left in them."""
    left = counts.astype(np.int64).copy()
    rooms: dict[int, list[tuple[Config, int]]] = defaultdict(list)
    for i in np.argsort(-lengths, kind="stable"):
        if not left[i]:
            continue
        size_i = int(lengths[i])
        for room in sorted(r for r in rooms if r >= size_i):
            while left[i] and rooms.get(room):
                config, n = rooms[room].pop()
                each = min(room // size_i, max(1, int(left[i]) // n))
                used = min(n, int(left[i]) // each)
                if n > used:
                    rooms[room].append((config, n - used))
                rooms[room - each * size_i].append((config + (int(i),) * each, used))
                left[i] -= used * each
            if not rooms[room]:
                del rooms[room]
        each = capacity // size_i
        if left[i] >= each:
            rooms[capacity - each * size_i].append(((int(i),) * each, int(left[i]) // each))
        if left[i] % each:
            rooms[capacity - int(left[i] % each) * size_i].append(((int(i),) * int(left[i] % each), 1))
        left[i] = 0
    return [x for bins in rooms.values() for x in bins if x[1]]


def places(lengths: np.ndarray, packed: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: from rank ``first`` on, one to each sequence from ``sequence`` on, at ``offset``."""
    rows, cursor, sequence = [], np.zeros(len(lengths), np.int64), 0
    for config, n in packed:
        offset = 0
        for i in config:
            rows.append((int(lengths[i]), int(cursor[i]), sequence, offset))
            cursor[i] += n
            offset += int(lengths[i])
        sequence += n
    rows.sort()
    return {k: np.array(v, np.int64) for k, v in zip(("length", "first", "sequence", "offset"), zip(*rows, strict=True), strict=True)}


def planned(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    full, left = rounded(lengths, counts, solved(lengths, counts, capacity), capacity)
    return full + best_fit(lengths, left, capacity)


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a saved table of pieces with a row number ``__row``, which goes.

    A length is ranked in about as many slices as the root of its count, so that neither the slices of a length nor the
    pieces of a slice are many, whichever length is common and whatever ids repeat."""
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    names = [c for c in cut.columns if c != "__row"]
    if not histogram:
        return cut.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    where = places(np.array(sorted(histogram), np.int64), planned(histogram, capacity))
    many = cut.sparkSession.createDataFrame([(n, isqrt(c)) for n, c in sorted(histogram.items())], "length long, __many int")
    dealt = cut.join(F.broadcast(many), "length").withColumn("__slice", F.pmod(F.xxhash64("__row"), F.col("__many")))
    counts = dealt.groupBy("length", "__slice").count()
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__slice").orderBy("__row")) - 1)
    ranked = ranked.join(before.drop("count"), ["length", "__slice"]).select(*names, (F.col("__before") + F.col("__rank")).alias("__rank"))
    key = where["length"] << 40 | where["first"]

    def run(batches):
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            rank = get("__rank").astype(np.int64)
            at = np.searchsorted(key, get("length").astype(np.int64) << 40 | rank, side="right") - 1
            added = [pa.array(where["sequence"][at] + rank - where["first"][at]), pa.array(where["offset"][at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *added], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    return packed(saved(pieces(docs, vocabulary, id_col, text, capacity).withColumn("__row", F.monotonically_increasing_id()), "pieces"), capacity)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_vocabulary())
