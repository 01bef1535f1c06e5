"""Near-duplicate vectors: exact threshold pairs by dual traversal of cover trees.

Equal vectors of a label are one row first. The distinct vectors of a label are dealt into blocks around
a few pivots; two blocks meet only if their covering radii allow a pair within the threshold. Where two
blocks meet, a cover tree of each is built (nested levels, radii 2, 1, 1/2, ...) and both trees are
descended together: a pair of nodes is dropped when the distance of their centres exceeds both covering
radii plus the threshold distance, and taken as a whole when even its farthest members are linked.

Only sums of links for each vector and spanning edges leave a task, never the pairs themselves.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null label or id, link with nothing; vectors of different lengths do not link; rows that repeat a vector
(ids too) are linked copies; rows that repeat an id with another vector or label are vectors of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, components, saved, some_rows, table, unite
from .topk import whole

#: Vectors of a block, and most pivots that blocks are built around.
BLOCK, PIVOTS = 4096, 64
RADII = (2.0, 1.0, 0.5, 0.25, 0.125, 0.0625)
TILE = 1 << 20
_SAFE = 1e-9


@dataclass
class Level:
    """Nodes of one level: centre (a point), parent node on the level above, covering radius, weight of all members."""

    centre: np.ndarray
    parent: np.ndarray
    radius: np.ndarray
    weight: np.ndarray
    first: np.ndarray  # children of node i are order[first[i]:first[i + 1]] on the next level
    order: np.ndarray


class CoverTree:
    """Nested nets over unit vectors; the last level is the points themselves."""

    def __init__(self, x: np.ndarray, weight: np.ndarray):
        self.x, self.n = x, len(x)
        centres, assigned = np.zeros(1, np.int64), np.zeros(self.n, np.int64)
        nets = [(centres, assigned)]
        for radius in RADII[1:]:
            centres = self.net(centres, radius)
            nets.append((centres, self.nearest(centres)))
            if len(centres) == self.n:
                break
        nets.append((np.arange(self.n), np.arange(self.n)))
        # a node's parent is the centre that its own centre belongs to one level up
        parents = [np.zeros(1, np.int64)] + [nets[k - 1][1][nets[k][0]] for k in range(1, len(nets))]
        above = np.arange(self.n)
        self.levels: list[Level] = []
        self.member: list[np.ndarray] = []  # each point's node, from the last level up
        for k in range(len(nets) - 1, -1, -1):
            centre = nets[k][0]
            distance = np.sqrt(np.maximum(0, ((x - x[centre[above]]) ** 2).sum(axis=1)))
            covering = np.zeros(len(centre))
            np.maximum.at(covering, above, distance)
            below = self.levels[0] if self.levels else None
            order = np.argsort(below.parent, kind="stable") if below else np.empty(0, np.int64)
            first = np.searchsorted(below.parent[order], np.arange(len(centre) + 1)) if below else np.zeros(len(centre) + 1, np.int64)
            self.levels.insert(0, Level(centre, parents[k], covering, np.bincount(above, weight, len(centre)).astype(np.int64), first, order))
            self.member.insert(0, above)
            above = parents[k][above]

    def net(self, centres: np.ndarray, radius: float) -> np.ndarray:
        """The centres above and, point by point, whatever is farther than ``radius`` from all centres so far."""
        least = 1 - radius * radius / 2  # cosine at that distance
        rest = np.setdiff1d(np.arange(self.n), centres)
        found = [centres]
        for i in range(0, len(rest), 512):
            some = rest[i : i + 512]
            free = np.ones(len(some), bool)
            for known in found:
                free &= (self.x[some] @ self.x[known].T).max(axis=1) < least
            some = some[free]
            near = self.x[some] @ self.x[some].T >= least
            free = np.ones(len(some), bool)
            new = []
            for j in range(len(some)):
                if free[j]:
                    new.append(j)
                    free &= ~near[j]
            if new:
                found.append(some[new])
                if len(found) > 8:
                    found = [np.concatenate(found)]
        return np.concatenate(found)

    def nearest(self, centres: np.ndarray) -> np.ndarray:
        out = np.empty(self.n, np.int64)
        rest = np.setdiff1d(np.arange(self.n), centres)
        out[centres] = np.arange(len(centres))
        for i in range(0, len(rest), 512):
            out[rest[i : i + 512]] = (self.x[rest[i : i + 512]] @ self.x[centres].T).argmax(axis=1)
        return out

    def points(self, level: int, node: int) -> np.ndarray:
        return np.flatnonzero(self.member[level] == node)


def linked(a: CoverTree, b: CoverTree, same: bool, cosine: float, exact) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights linked to each point of a, to each of b, and classes over a's points followed by b's (over a's alone if
    ``same``). ``exact(i, j)`` says which of the given point pairs truly reach the threshold."""
    reach = np.sqrt(2 - 2 * cosine)
    sums_a, sums_b = np.zeros(a.n, np.int64), np.zeros(b.n, np.int64)
    label = np.arange(a.n if same else a.n + b.n)
    shift = 0 if same else a.n
    depth = max(len(a.levels), len(b.levels))
    level = lambda t, k: min(k, len(t.levels) - 1)
    weight_a, weight_b = a.levels[-1].weight, b.levels[-1].weight

    def take_all(k: int, i: int, j: int) -> None:
        """Every member of node i of a is linked with every member of node j of b."""
        p, q = a.points(level(a, k), i), b.points(level(b, k), j)
        if same and i == j:
            sums_a[p] += weight_a[p].sum() - weight_a[p]
            unite(label, p, np.full(len(p), p[0]))
            return
        sums_a[p] += weight_b[q].sum()
        (sums_a if same else sums_b)[q] += weight_a[p].sum()
        unite(label, p, np.full(len(p), q[0] + shift))
        unite(label, q + shift, np.full(len(q), p[0]))

    def judge(k: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of node pairs at distance d: take or leave what can be decided, return the rest."""
        la, lb = a.levels[level(a, k)], b.levels[level(b, k)]
        slack = la.radius[i] + lb.radius[j]
        keep = d <= slack + reach + _SAFE
        if same:
            keep &= i <= j
        i, j, d, slack = i[keep], j[keep], d[keep], slack[keep]
        if k == depth - 1:
            if same:
                other = i != j
                i, j = i[other], j[other]
            good = exact(i, j)
            i, j = i[good], j[good]
            np.add.at(sums_a, i, weight_b[j])
            np.add.at(sums_a if same else sums_b, j, weight_a[i])
            unite(label, i, j + shift)
            return i[:0], j[:0]
        within = np.where(same & (i == j), 2 * la.radius[i], d + slack) <= reach - _SAFE
        several = (la.weight[i] > 0) & (np.diff(la.first)[i] * np.diff(lb.first)[j] > 16)
        for p, q in zip(i[within & several], j[within & several], strict=True):
            take_all(k, int(p), int(q))
        left = ~(within & several)
        return i[left], j[left]

    def children(t: CoverTree, k: int, node: int) -> np.ndarray:
        if k + 1 > len(t.levels) - 1:
            return np.array([node])  # this tree has ended: its points stand still
        here = t.levels[k]
        return here.order[here.first[node] : here.first[node + 1]]

    i, j = judge(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.linalg.norm(a.x[a.levels[0].centre] - b.x[b.levels[0].centre], axis=1))
    for k in range(depth - 1):
        ends = [k + 1 > len(t.levels) - 1 for t in (a, b)]
        many_a = np.ones(len(i), np.int64) if ends[0] else np.diff(a.levels[k].first)[i]
        many_b = np.ones(len(j), np.int64) if ends[1] else np.diff(b.levels[k].first)[j]
        ca, cb = a.levels[level(a, k + 1)].centre, b.levels[level(b, k + 1)].centre
        next_i, next_j = [], []
        large = many_a * many_b > 20_000
        for p, q in zip(i[large], j[large], strict=True):  # many children on both sides: whole tiles of products
            ci, cj = children(a, k, int(p)), children(b, k, int(q))
            rows = max(1, TILE // len(cj))
            ra, rb = a.levels[level(a, k + 1)].radius, b.levels[level(b, k + 1)].radius
            for s in range(0, len(ci), rows):
                d = np.sqrt(np.maximum(0, 2 - 2 * (a.x[ca[ci[s : s + rows]]] @ b.x[cb[cj]].T)))
                u, v = np.nonzero(d <= ra[ci[s : s + rows], None] + rb[cj][None, :] + reach + 1e-7)
                if same and p == q:
                    u, v = u[ci[s + u] <= cj[v]], v[ci[s + u] <= cj[v]]
                got = judge(k + 1, *_sorted_pair(ci[s + u], cj[v], same), d[u, v])
                next_i.append(got[0])
                next_j.append(got[1])
        i, j, many_a, many_b = i[~large], j[~large], many_a[~large], many_b[~large]
        ends_at = np.cumsum(many_a * many_b)
        # consecutive slices: each ends where the next one starts
        cuts = np.unique(np.append(np.searchsorted(ends_at, np.arange(0, ends_at[-1], 200_000), side="left"), len(i))) if len(i) else np.empty(0, np.int64)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            pi, pj, ma, mb = i[s:e], j[s:e], many_a[s:e], many_b[s:e]
            size = ma * mb
            owner = np.repeat(np.arange(len(pi)), size)
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            u, v = inner // mb[owner], inner % mb[owner]
            ci = pi[owner] if ends[0] else a.levels[k].order[a.levels[k].first[pi[owner]] + u]
            cj = pj[owner] if ends[1] else b.levels[k].order[b.levels[k].first[pj[owner]] + v]
            if same:
                once = (pi[owner] != pj[owner]) | (ci <= cj)
                ci, cj = ci[once], cj[once]
            d = np.sqrt(np.maximum(0, ((a.x[ca[ci]] - b.x[cb[cj]]) ** 2).sum(axis=1)))
            got = judge(k + 1, *_sorted_pair(ci, cj, same), d)
            next_i.append(got[0])
            next_j.append(got[1])
        i = np.concatenate(next_i) if next_i else i[:0]
        j = np.concatenate(next_j) if next_j else j[:0]
    return sums_a, sums_b, label


def _sorted_pair(i: np.ndarray, j: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    return (np.minimum(i, j), np.maximum(i, j)) if same else (i, j)


def meet(here: pd.DataFrame, there: pd.DataFrame | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rep, links, root) of two blocks, or of one with itself; columns rep, m, v."""
    sides = [here] if there is None else [here, there]
    raw = [np.stack(s["v"].to_numpy()).astype(np.float64) for s in sides]
    norm = [np.linalg.norm(x, axis=1) for x in raw]
    trees = [CoverTree(x / n[:, None], s["m"].to_numpy()) for x, n, s in zip(raw, norm, sides, strict=True)]

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), bool)
        for s in range(0, len(i), 100_000):
            p, q = i[s : s + 100_000], j[s : s + 100_000]
            out[s : s + 100_000] = np.einsum("ij,ij->i", raw[0][p], raw[-1][q]) / (norm[0][p] * norm[-1][q]) >= cosine
        return out

    sums_a, sums_b, label = linked(trees[0], trees[-1], there is None, cosine, exact)
    reps = np.concatenate([s["rep"].to_numpy() for s in sides])
    sums = sums_a if there is None else np.concatenate([sums_a, sums_b])
    some = sums > 0
    return reps[some], sums[some], reps[label[some]]


def threshold_links(vectors: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """(rep, links, other): what each distinct vector gathers in one meeting of blocks, and an edge to one of its class there.
    ``vectors`` is a saved table of distinct vectors: label, dim, rep, m (copies), v."""
    pivots = np.array([r["v"] for r in some_rows(vectors.where(F.col("dim") == F.lit(_usual_dim(vectors))), "rep", PIVOTS, 11).select("v").collect()], float)
    pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True) if len(pivots) else pivots
    sizes = vectors.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    joined = vectors.join(sizes, ["label", "dim"])

    def assign(batches):
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("v"))
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            k = np.minimum(np.array(column(batch, "k")), len(pivots))
            cell, far = np.zeros(len(sizes), np.int32), np.full(len(sizes), 2.0)
            use = np.flatnonzero((k > 1) & (sizes == pivots.shape[-1])) if len(pivots) else []
            if len(use):
                starts = np.cumsum(sizes) - sizes
                x = v.flatten().to_numpy(zero_copy_only=False)[starts[use][:, None] + np.arange(pivots.shape[-1])].astype(np.float64)
                s = x / np.linalg.norm(x, axis=1, keepdims=True) @ pivots.T
                s[np.arange(len(pivots))[None, :] >= k[use][:, None]] = -2  # a label uses as many pivots as it needs blocks
                cell[use] = s.argmax(axis=1)
                far[use] = np.sqrt(np.maximum(0, 2 - 2 * s.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(cell), pa.array(far)], names=[*names, "cell", "far"])

    names = ["label", "dim", "rep", "m", "v"]
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    dealt = joined.mapInArrow(assign, ", ".join([*(f"{c} {kinds[c]}" for c in names), "cell int", "far double"]))
    cells = dealt.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    cells = cells.withColumn("parts", F.ceil(F.col("n") / (2 * block)).cast("int"))
    placed = dealt.join(cells.select("label", "dim", "cell", "parts"), ["label", "dim", "cell"])
    placed = saved(placed.withColumn("at", F.col("cell") * F.lit(1 << 20).cast("long") + F.pmod(F.xxhash64("rep"), F.col("parts"))).drop("far", "parts"), "placed")
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T)).ravel().tolist() if len(pivots) else [0.0]
    blocks = cells.select("label", "dim", "cell", "radius", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    blocks = blocks.withColumn("at", F.col("cell") * F.lit(1 << 20).cast("long") + F.col("part"))
    one, two = blocks.alias("one"), blocks.alias("two")
    distance = F.element_at(F.lit(apart), (F.col("one.cell") * max(1, len(pivots)) + F.col("two.cell") + 1).cast("int"))
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    pairs = one.join(two, (F.col("one.label") == F.col("two.label")) & (F.col("one.dim") == F.col("two.dim")) & (F.col("one.at") <= F.col("two.at")))
    pairs = pairs.where((F.col("one.cell") == F.col("two.cell")) | (distance <= F.col("one.radius") + F.col("two.radius") + reach))
    pairs = pairs.select("one.label", "one.dim", F.col("one.at").alias("a"), F.col("two.at").alias("b"))
    sides = pairs.select("label", "dim", "a", "b", F.col("a").alias("at"), F.lit(0).alias("side")).union(pairs.where("a != b").select("label", "dim", "a", "b", F.col("b").alias("at"), F.lit(1).alias("side")))
    work = placed.drop("cell").join(sides, ["label", "dim", "at"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        here, there = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(here) or (key[2] != key[3] and not len(there)):
            return pd.DataFrame({"rep": [], "links": [], "other": []})
        rep, links, other = meet(here, there if key[2] != key[3] else None, cosine)
        return pd.DataFrame({"rep": rep, "links": links, "other": other})

    return work.groupBy("label", "dim", "a", "b").applyInPandas(run, f"rep {kinds['rep']}, links long, other {kinds['rep']}")


def _usual_dim(vectors: DataFrame) -> int:
    first = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    return first["dim"] if first else 0


def vector_groups(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    every = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    fit = whole(every, "v", floats=True).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.exists("v", lambda x: x != 0.0))
    distinct = fit.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("m"))
    # an id may repeat with other vectors and labels: nodes are numbered here
    distinct = saved(distinct.select("label", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("rep"), "least", "m", "v"), "vectors")
    found = saved(threshold_links(distinct.drop("least"), cosine, block), "links")
    roots = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_rep = distinct.join(sums, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    per_rep = per_rep.select("label", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("root", "rep").alias("root"))
    ids = per_rep.groupBy("root").agg(F.min("least").alias("component"))
    linked_rows = fit.join(per_rep.join(ids, "root").select("label", "v", "n", "component"), ["label", "v"]).select("id", "n", "component")
    zero = F.lit(0).cast("long")
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    usable &= F.forall(F.col("v").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0)
    rest = every.where(~F.coalesce(usable, F.lit(False))).select("id", zero.alias("n"), F.col("id").alias("component"))
    return linked_rows.union(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (
  SELECT vec_id, label, w, sqrt(list_inner_product(w, w)) AS norm FROM v
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.w) = len(b.w)
  WHERE list_inner_product(a.w, b.w) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), k AS (
  SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""
