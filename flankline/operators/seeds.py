"""Seeds against proteins, letter by letter from the start: a pigeonhole index for close matches, a bound for the best one.

Two sequences are compared ungapped from their first letters: identity is the share of equal letters over the shorter one,
coverage its share of the longer one; ``*`` is no letter.

:func:`close_matches` finds all pairs of an identity and coverage. A seed of n letters may differ from a protein in at most
``(1 - identity) n`` places, and they share at least the first ``coverage * n``. Cut into one segment more than it may have
differences there, a seed has a segment that stands unchanged at its place in each protein that it matches. So seeds
and proteins meet by equality of (cut, place, letters), where the cut is the band of lengths that a seed is in; a protein's
own length says which few bands can match it.

:func:`best_seeds` finds the best seed of each hit, however far it is. Seeds are dealt into blocks of bounded size that hits
meet by equality; in a block, counts of letters bound what a seed can reach, seeds are taken from the highest bound on, and
the search ends at the first whose bound is below the best found.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flankline.functions.scalars import length_coverage, position_identity

#: Lengths of a band grow by this factor at most.
BAND = 1.05
#: Letters of the seeds of a block.
BLOCK = 1 << 21


def letters_of(sequence: str) -> Column:
    return F.replace(F.col(sequence), F.lit("*"), F.lit(""))


def bands(longest: int) -> list[int]:
    """The first length of each band: 1, 2, 3 ... while lengths are few, then each by ``BAND`` more than the last."""
    out = [1]
    while out[-1] <= longest:
        out.append(max(out[-1] + 1, floor(out[-1] * BAND)))
    return out


def segments(least: int, most: int, identity: float, coverage: float) -> list[tuple[int, int]]:
    """(place from 1, letters) of the segments of seeds of ``least`` to ``most`` letters: one more than the differences that a match
    may have, over the letters that every match shares."""
    shared = max(1, ceil(coverage * least - 1e-9))
    allowed = floor((1 - identity) * most + 1e-9)
    parts = min(shared, allowed + 1)
    cuts = [shared * k // parts for k in range(parts + 1)]
    return [(a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def band_of(length: Column, firsts: Sequence[int]) -> Column:
    """The number of the band that a length is in, from 0; lengths beyond all seeds are in the last, which has none."""
    return F.size(F.filter(F.lit(list(firsts)), lambda f: f <= length)) - 1


def close_matches(proteins: DataFrame, seeds: DataFrame, sequence: str, seed: str, identity: float = 0.95, coverage: float = 0.95) -> DataFrame:
    """Rows of ``proteins`` joined with the ``seeds`` that they match, with ``identity`` and ``coverage``.

    An identity so low that all shared letters of a seed may differ is refused: no segment need be left then, and all of like
    length would match. Null and empty sequences match nothing. One number, the longest seed's length, comes to the driver.
    """
    if not 0 < coverage <= 1 or not 0 < identity <= 1:
        raise ValueError("identity and coverage are shares over 0")
    longest = seeds.agg(F.max(F.length(letters_of(seed)))).first()[0] or 0
    firsts = bands(longest)
    cuts = []
    for band, (least, after) in enumerate(zip(firsts, firsts[1:], strict=False)):
        if (1 - identity) * (after - 1) >= max(1, ceil(coverage * least - 1e-9)):
            raise ValueError(f"seeds of {least} letters may differ everywhere at identity {identity}")
        cuts.append((band, segments(least, after - 1, identity, coverage)))
    layout = seeds.sparkSession.createDataFrame(cuts, "__band int, __cut array<struct<place:int,size:int>>")

    def pieces(rows: DataFrame, text: str) -> DataFrame:
        piece = lambda c: F.struct("__band", c["place"].alias("place"), F.substr(F.col(text), c["place"], c["size"]).alias("letters"))
        return rows.join(layout, "__band").select("*", F.explode(F.transform("__cut", piece)).alias("__piece"))

    body, n = letters_of(sequence), F.length("__text")
    mine = proteins.select("*", body.alias("__text")).where("__text <> ''")
    low, high = F.greatest(F.lit(1), F.ceil(n * coverage - 1e-9).cast("int")), F.floor(n / coverage + 1e-9).cast("int")
    mine = mine.withColumn("__band", F.explode(F.sequence(band_of(low, firsts), band_of(high, firsts))))
    mine = pieces(mine, "__text").drop("__band", "__cut")
    own = seeds.select("*", letters_of(seed).alias("__seed")).where("__seed <> ''").withColumn("__band", band_of(F.length("__seed"), firsts))
    own = pieces(own, "__seed").drop("__band")
    # a pair that agrees on several segments counts at the first of them
    before = F.filter("__cut", lambda c: c["place"] < F.col("__piece.place"))
    first = ~F.exists(before, lambda c: F.substr(F.col("__text"), c["place"], c["size"]) == F.substr(F.col("__seed"), c["place"], c["size"]))
    pairs = mine.join(own, "__piece").where(first).drop("__piece", "__cut")
    pairs = pairs.withColumn("identity", position_identity(F.col("__text"), F.col("__seed"))).withColumn("coverage", length_coverage(F.col("__text"), F.col("__seed")))
    return pairs.where((F.col("identity") >= identity) & (F.col("coverage") >= coverage)).drop("__text", "__seed")


def like_lengths(proteins: DataFrame, seeds: DataFrame, sequence: str, seed: str, coverage: float, dealt: int = 1 << 12) -> DataFrame:
    """All pairs of ``proteins`` and ``seeds`` of a ``coverage``, with ``identity`` and ``coverage``: as many as the tables' product where lengths are alike.

    Pairs meet by equality of the seed's band of lengths and of a share of some ``dealt`` proteins, so that no band is one task; a
    task holds one share's rows of a band at a time. Null and empty sequences match nothing."""
    if not 0 < coverage <= 1:
        raise ValueError("coverage is a share over 0")
    firsts = bands(seeds.agg(F.max(F.length(letters_of(seed)))).first()[0] or 0)
    shares = int(proteins.count() // dealt + 1)
    n = F.length("__text")
    low, high = F.greatest(F.lit(1), F.ceil(n * coverage - 1e-9).cast("int")), F.floor(n / coverage + 1e-9).cast("int")
    mine = proteins.select("*", letters_of(sequence).alias("__text"), F.pmod(F.xxhash64(sequence), F.lit(shares)).cast("int").alias("__share")).where("__text <> ''")
    mine = mine.withColumn("__band", F.explode(F.sequence(band_of(low, firsts), band_of(high, firsts))))
    own = seeds.select("*", letters_of(seed).alias("__seed"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("__share")).where("__seed <> ''")
    own = own.withColumn("__band", band_of(F.length("__seed"), firsts))
    pairs = mine.join(own, ["__band", "__share"]).withColumn("coverage", length_coverage(F.col("__text"), F.col("__seed"))).where(F.col("coverage") >= coverage)
    return pairs.withColumn("identity", position_identity(F.col("__text"), F.col("__seed"))).drop("__text", "__seed", "__band", "__share")


def best_of_block(text: np.ndarray, counts: np.ndarray, bodies: list[np.ndarray], seed_counts: np.ndarray, lengths: np.ndarray, numbers: list[int]) -> tuple[float, float, int, int]:
    """(identity, coverage, -number, place) of the best seed of a block; seeds whose bound is below the best are not compared."""
    shorter = np.minimum(lengths, len(text))
    bound = np.minimum(np.minimum(seed_counts, counts).sum(axis=1), shorter) / shorter
    best = (-1.0, 0.0, 0, -1)
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] < best[0]:
            break
        n = int(shorter[k])
        same = int((text[:n] == bodies[k][:n]).sum())
        best = max(best, (same / n, n / max(len(text), len(bodies[k])), -numbers[k], k))
    return best


def best_seeds(hits: DataFrame, seeds: DataFrame, key: Sequence[str], sequence: str, seed: str, seed_family: str, seed_no: str, within: Sequence[str] = (), block: int = BLOCK, dealt: int = 1 << 16) -> DataFrame:
    """(key, best_family, identity, coverage): for each hit the best seed with the same values of ``within``, by identity, then
    coverage, then the least ``seed_no``. A hit without letters, or without a seed that shares any, has an empty family and zeros.

    ``key`` identifies hits. Seeds are dealt into blocks of some ``block`` letters, hits of a block into tasks of some
    ``dealt``; only the numbers of blocks and tasks are counted before."""
    whole = seeds.select(*within, letters_of(seed).alias("__body"), F.col(seed_family).alias("__family"), F.col(seed_no).cast("long").alias("__no")).where("__body <> ''")
    n_blocks = int(((whole.agg(F.sum(F.length("__body"))).first()[0] or 0) // block) + 1)
    n_salts = int(hits.count() // dealt + 1)
    none = [F.lit(None).cast(hits.schema[k].dataType).alias(f"__k{i}") for i, k in enumerate(key)]
    same = [F.col(c).alias(f"__w{i}") for i, c in enumerate(within)]
    group = [*(f"__w{i}" for i in range(len(within))), "__block", "__salt"]
    ids = [f"__k{i}" for i in range(len(key))]
    salts, blocks = F.sequence(F.lit(0), F.lit(n_salts - 1)), F.sequence(F.lit(0), F.lit(n_blocks - 1))
    own = whole.select(*same, F.pmod(F.xxhash64("__no", "__body"), F.lit(n_blocks)).cast("int").alias("__block"), F.explode(salts).alias("__salt"), F.lit(0).alias("__role"), *none, "__body", "__family", "__no")
    asked = hits.select(*same, *(F.col(k).alias(i) for i, k in zip(ids, key, strict=True)), letters_of(sequence).alias("__body")).where("__body <> ''")
    asked = asked.select(*same_names(within), F.explode(blocks).alias("__block"), F.pmod(F.xxhash64(*ids), F.lit(n_salts)).cast("int").alias("__salt"), F.lit(1).alias("__role"), *ids, "__body", F.lit(None).cast("string").alias("__family"), F.lit(None).cast("long").alias("__no"))
    met = own.unionByName(asked).repartition(*group).sortWithinPartitions(*group, "__role")

    def run(batches):
        at, bodies, families, numbers, packed = None, [], [], [], None
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            keys = list(zip(*(column(c).to_pylist() for c in group), strict=True))
            roles, texts, names, nos = (column(c).to_pylist() for c in ("__role", "__body", "__family", "__no"))
            rows, out = [], []
            for k, now in enumerate(keys):
                if now != at:
                    at, bodies, families, numbers, packed = now, [], [], [], None
                text = np.frombuffer(texts[k].encode("utf-32-le"), np.uint32)
                if roles[k] == 0:
                    bodies.append(text)
                    families.append(names[k])
                    numbers.append(nos[k])
                elif bodies:
                    if packed is None:
                        packed = np.stack([np.bincount(b & 63, minlength=64) for b in bodies]), np.array([len(b) for b in bodies])
                    i, c, no, place = best_of_block(text, np.bincount(text & 63, minlength=64), bodies, *packed, numbers)
                    rows.append(k)
                    out.append((i, c, no, families[place]))
            some = pa.array(rows, pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.float64(), pa.float64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*(column(i).take(some) for i in ids), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*ids, "i", "c", "n", "f"])

    fields = ", ".join(f"`{i}` {hits.schema[k].dataType.simpleString()}" for i, k in zip(ids, key, strict=True))
    found = met.mapInArrow(run, f"{fields}, i double, c double, n long, f string").groupBy(*ids).agg(F.max(F.struct("i", "c", "n", "f")).alias("b"))
    on = [F.col(k).eqNullSafe(F.col(i)) for i, k in zip(ids, key, strict=True)]
    told = hits.select(*key).join(found, on, "left")
    return told.select(*key, F.coalesce("b.f", F.lit("")).alias("best_family"), *(F.coalesce(F.col(f"b.{c}"), F.lit(0.0)).alias(name) for c, name in (("i", "identity"), ("c", "coverage"))))


def same_names(within: Sequence[str]) -> list[str]:
    return [f"__w{i}" for i in range(len(within))]
