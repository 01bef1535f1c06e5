"""Near-duplicate groups by SimHash and generalised pigeonhole search.

The 64 bits are dealt into partitions of correlated bits. Partition ``i`` has an own threshold
``t_i`` with ``sum(t_i) = limit - partitions + 1``; by the generalised pigeonhole principle two
fingerprints at most ``limit`` bits apart are within ``t_i`` in some partition. The number of
partitions and the thresholds come from a dynamic programme over estimated work. Rows are probed by
the bits of each partition and verified by all their bits.

:func:`simhash_groups` links fingerprints of three-word shingles at 3 bits. :func:`one_of_each_group` links documents
whose sets of five-word shingles are alike by 0.8 (Jaccard): fingerprints within 10 bits are candidates, and the
texts decide.

Defined results: a null, empty or blank text has fingerprint zero and links like any other (in
:func:`one_of_each_group` only with its like); fewer words than a shingle has make one shingle; repeated rows share
fingerprint and component; an empty table gives an empty result; further columns are ignored or passed on,
whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import clear_of, column, components, saved, table, unite

BITS = 64
#: Rows of one bucket that are compared together; larger buckets are cut into blocks of this size, which meet in pairs.
BLOCK = 2048
#: A plan may probe a partition with at most so many keys a fingerprint; plans of `limit` + 1 exact partitions always stay below.
MOST_KEYS = 1 << 14
#: Cost of comparing two fingerprints inside a bucket, in units of one shuffled row.
COMPARE_COST = 0.02
_LOW = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return np.empty(0, np.uint64)
    grams = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.array([xxhash.xxh64_intdigest(b" ".join(g), seed) for g in grams], np.uint64)


def shingle_set(text: str | None, shingle: int) -> set[tuple[bytes, ...]]:
    words = (text or "").encode().lower().split()
    return set(zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else {tuple(words)} - {()}


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes. Sums eight one-byte counters at a time, 255 rows deep."""
    if not len(hashes):
        return 0
    starts = np.arange(0, len(hashes), 255)
    out = 0
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _LOW, starts)
        counts = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > len(hashes)):
            out |= 1 << (8 * int(byte) + k)
    return out


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 3, seed: int = 42, into: str = "fp") -> DataFrame:
    """``keep`` columns and ``into`` (the fingerprint as a signed long) for every row of ``docs``."""
    (body,) = clear_of([*keep, into], "text")

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(shingle_hashes(t, shingle, seed)) for t in column(batch, body)], np.uint64)
            rest = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(values.view(np.int64))], names=[*keep, into])

    source = docs.select(*keep, F.col(text).alias(body))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, `{into}` long" if fields else f"`{into}` long")


def bit_counts(fps: DataFrame) -> tuple[np.ndarray, int]:
    """C[i, j]: in how many fingerprints bits i and j are both set; and the number of fingerprints."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = ((x[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            total, n = total + bits.T @ bits, n + len(x)
        i, j = np.triu_indices(BITS)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*i, BITS], pa.int32()), pa.array([*j, BITS], pa.int32()), pa.array([*total[i, j].astype(np.int64), n])], names=["i", "j", "n"])

    out, n = np.zeros((BITS, BITS)), 0
    for i, j, v in fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        if i == BITS:
            n = v
        else:
            out[i, j] = out[j, i] = v
    return out, n


def grouped_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Deal the bits into ``parts`` groups of nearly equal size, each grown from its most correlated pair."""
    p = counts.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((counts / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        rest = sorted(left)
        group = list(max(combinations(rest, 2), key=lambda ij: corr[ij]))[:size] if len(rest) > size else rest
        left -= set(group)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def allocation(counts: np.ndarray, n: int, limit: int) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of least estimated work; partitions with threshold -1 are left out.

    The work of a partition is the rows that it shuffles plus the pairs that meet in its buckets,
    from the chance that two fingerprints differ in at most so many of its bits. That takes the bits
    as independent; correlation only changes the cost, never the result.
    """
    p = counts.diagonal() / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(1, limit + 2):
        groups = grouped_bits(counts, n, parts)
        costs = []
        for bits in groups:
            chance = np.array([1.0])
            for b in bits:
                chance = np.convolve(chance, [1 - differ[b], differ[b]])
            probes = [sum(comb(len(bits), d) for d in range(t + 1)) for t in range(limit + 1)]
            rows = [max(n, 1) * k if k <= MOST_KEYS else float("inf") for k in probes]
            costs.append([0.0] + [rows[t] + COMPARE_COST * n * n / 2 * chance[: t + 1].sum() for t in range(limit + 1)])
        total = limit - parts + 1
        # least[s]: cost and thresholds of the groups so far when they sum to s; s may be negative
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            then: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in least.items():
                for t in range(-1, limit + 1):
                    if s + t not in then or c + cost[t + 1] < then[s + t][0]:
                        then[s + t] = (c + cost[t + 1], [*ts, t])
            least = then
        if total in least and least[total][0] < best[0]:
            best = (least[total][0], [(g, t) for g, t in zip(groups, least[total][1], strict=True) if t >= 0])
    return best[1]


def _keys(part: int, bits: list[int], threshold: int) -> list:
    """Arrays of (part, key, own): the fingerprint's own bits in a partition and those up to ``threshold`` flips away."""
    own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))

    def key(value, mine: bool):
        return F.struct(F.lit(part).alias("part"), value.alias("key"), F.lit(mine).alias("own"))

    out = [F.array(key(own, True))]
    for d in range(1, threshold + 1):
        flips = F.lit([_signed(sum(1 << b for b in some)) for some in combinations(bits, d)])
        asked = F.transform(flips, lambda x: key(own.bitwiseXOR(x), False))
        # one of two neighbours has the lesser key: it alone asks for the other
        out.append(F.filter(asked, lambda s: s["key"] > own))
    return out


def spanning(n: int, u: np.ndarray, v: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Positions of the pairs (u, v) that make a minimum spanning forest of ``n`` nodes: nearest pairs first."""
    label, out = np.arange(n), []
    for d in np.unique(distance):
        at = np.flatnonzero(distance == d)
        while len(at):
            a, b = label[u[at]], label[v[at]]
            at, a, b = at[a != b], a[a != b], b[a != b]
            if len(at):
                _, first = np.unique(np.maximum(a, b), return_index=True)  # each class joins one lesser class
                out.append(at[first])
                unite(label, u[at[first]], v[at[first]])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def links(rows: DataFrame, limit: int = 3, size_ratio: float = 0.0, between: str | None = None) -> DataFrame:
    """Edges (a, b) between nodes whose fingerprints are at most ``limit`` bits apart: of all such pairs, those of a minimum
    spanning forest in each block, so whatever is connected stays so. ``rows`` has one row for each node: node (long), fp and
    size; pairs whose sizes differ by more than ``size_ratio`` allows are no pairs. With ``between``, a column of longs, all pairs of nodes
    that differ in it are returned, and no others.

    A bucket's own rows meet all its rows, those that ask for the bucket included. Each side is cut into blocks.
    A pair that meets in several partitions counts in the first."""
    counts, n = bit_counts(rows)
    if n < 2:
        return rows.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    plan = allocation(counts, n, limit)
    keys = [k for part, (bits, threshold) in enumerate(plan) for k in _keys(part, bits, threshold)]
    carried = ["fp", "node", "size", *([between] if between else [])]
    probes = rows.select(*carried, F.explode(F.concat(*keys)).alias("k")).select(*carried, "k.part", "k.key", "k.own")
    sizes = probes.groupBy("part", "key").agg(F.count_if("own").alias("mine"), F.count("*").alias("all")).where("mine > 0 AND `all` > 1")
    sizes = sizes.select("part", "key", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("mine", "all")))
    salt = lambda many: F.pmod(F.xxhash64("node"), F.col(many)).cast("int")
    upto = lambda many: F.sequence(F.lit(0), F.col(many) - 1)
    place = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    as_mine = F.transform(upto("all"), lambda j: place(salt("mine"), j, 0))
    as_any = F.transform(upto("mine"), lambda i: F.struct(i.alias("i"), salt("all").alias("j"), F.when(F.col("own"), 1).otherwise(2).alias("role")))
    met = (
        probes.join(sizes, ["part", "key"])
        .select("part", "key", *carried, F.explode(F.when(F.col("own"), F.concat(as_mine, as_any)).otherwise(as_any)).alias("p"))
        .groupBy("part", "key", F.col("p.i"), F.col("p.j"))
        .agg(F.collect_list(F.struct("p.role", *carried)).alias("rows"))
        .where(F.size("rows") > 2)
        .select("part", "rows")
    )
    earlier = [(np.uint64(sum(1 << b for b in bits)), threshold) for bits, threshold in plan]

    def block(part: int, role: np.ndarray, fp: np.ndarray, node: np.ndarray, size: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        mine, other = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
        found = []
        step = max(1, (1 << 20) // max(1, len(other)))
        for s in range(0, len(mine), step):
            some = mine[s : s + step]
            differing = fp[some, None] ^ fp[None, other]
            u, v = np.nonzero(np.bitwise_count(differing) <= limit)
            bits, i, j = differing[u, v], some[u], other[v]
            good = (role[j] == 2) | (node[i] < node[j])  # two of the bucket's own meet twice
            good &= np.minimum(size[i], size[j]) >= size_ratio * np.maximum(size[i], size[j])
            if group is not None:
                good &= group[i] != group[j]
            for mask, threshold in earlier[:part]:
                good &= np.bitwise_count(bits & mask) > threshold
            if good.any():
                found.append((node[i[good]], node[j[good]], np.bitwise_count(bits[good])))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
        if group is not None:
            return a, b
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        take = spanning(len(names), at[: len(a)], at[len(a) :], d)
        return a[take], b[take]

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            role, fp, *rest = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("role", *carried))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends[:-1]])
            out = [block(p, role[s:e], fp[s:e].view(np.uint64), *(x[s:e] for x in rest)) for p, s, e in zip(batch.column(0).to_numpy(), starts, ends, strict=True)]
            a, b = (np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out, strict=True) if out else ((), ())))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def alike(edges: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The edges (a, b) whose texts (node, text) have sets of shingles of a Jaccard similarity of ``least`` or more. Only
    texts of nodes on edges travel."""
    ends = saved(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    wanted = texts.join(ends, "node", "left_semi")
    pairs = edges.join(wanted.select(F.col("node").alias("a"), F.col("text").alias("one")), "a").join(wanted.select(F.col("node").alias("b"), F.col("text").alias("two")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            held: tuple[str | None, set] = (None, set())
            for one, two in zip(column(batch, "one"), column(batch, "two"), strict=True):
                if held[0] != two:  # a node's edges mostly come one after another
                    held = (two, shingle_set(two, shingle))
                x, y = shingle_set(one, shingle), held[1]
                both = len(x & y)
                keep.append(both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for every document."""
    marked = saved(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), ["id"], into="fp"), "fingerprints")
    distinct = saved(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp", F.col("fp").alias("node"), F.lit(1).alias("size")), limit)).withColumnRenamed("node", "fp")
    labelled = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    out = marked.join(labelled.join(ids, "root").select("fp", "component_id"), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def described(docs: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """(id, row, text) with the fingerprint ``fp``, a digest of the set of shingles and its size."""

    def run(batches):
        for batch in batches:
            fps, digests, sizes = [], [], []
            for t in column(batch, "text"):
                hashes = shingle_hashes(t, shingle, seed)
                kinds = np.unique(hashes)
                fps.append(fingerprint(hashes))
                digests.append(xxhash.xxh3_128_digest(kinds.tobytes()))
                sizes.append(len(kinds))
            added = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *added], names=["id", "row", "text", "fp", "digest", "size"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, fp long, digest binary, size int")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = 10, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one row left of each group of near-duplicates: that with the least id, null ids last.

    Texts with equal sets of shingles are one node. The rows are written once with a row number, so that
    repeated rows and repeated ids are told apart. A forest of candidates comes first. A candidate that it left out is joined by
    others, which the texts may refuse: so where they refused some, all pairs between what is still apart are compared too.
    """
    kept, who = clear_of(docs.columns, "row", "held")
    held = saved(docs.select(F.struct(*docs.columns).alias(who), F.monotonically_increasing_id().alias(kept)), "held")
    marked = saved(described(held.select(F.col(f"{who}.`{id_col}`").alias("id"), F.col(kept).alias("row"), F.col(f"{who}.`{text}`").alias("text")), shingle).drop("text"), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    nodes = saved(marked.groupBy("fp", "digest").agg(F.min(order).alias("least"), F.first("size").alias("size")).select("fp", "size", "least", F.col("least.row").alias("node")), "nodes")
    candidates = saved(links(nodes.select("fp", "node", "size"), limit, least), "candidates")
    texts = held.select(F.col(kept).alias("node"), F.col(f"{who}.`{text}`").alias("text"))
    near = saved(alike(candidates, texts, shingle, least), "near")
    reached = components(candidates).withColumnRenamed("root", "reach")
    grouped = saved(reached.join(components(near), "node", "left").select("node", "reach", F.coalesce("root", "node").alias("group")), "grouped")
    torn = grouped.groupBy("reach").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("n")).where("low < high AND n > 2")
    apart = saved(nodes.select("fp", "node", "size").join(grouped.join(torn, "reach", "left_semi").select("node", "group"), "node"), "apart")
    others = saved(links(apart, limit, least, "group").join(candidates, ["a", "b"], "left_anti"), "others")
    roots = components(near.union(alike(others, texts, shingle, least)))
    labelled = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = labelled.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(kept))
    return held.join(firsts, kept, "left_semi").select(f"{who}.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
