"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Candidates are dealt into blocks. In a block every dimension's postings are cut into segments of equal
quantised impact (the size of the component). For a query the segments of all dimensions are taken in
descending order of |query component| * segment impact, each adding to its members' scores. What a member
may still gain is bounded by Cauchy-Schwarz over what has not been processed of it and of the query.
Processing stops only when that bound proves that everything outside the remaining candidates is below the
k-th best score that is certain; those candidates are then scored exactly.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part; vectors of
other lengths than the query's take no part with it; repeated rows are separate candidates (a query leaves out
all rows of its own id); ties go to the smaller id; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved, table

#: Rows of a block of candidates, and bytes of the queries that share one build of its index.
BLOCK, QUERY_BYTES = 16_384, 1 << 25
#: Levels that the impacts of a dimension are quantised to.
LEVELS = 16
#: Segments that are processed between two attempts at the proof.
STRIDE = 96


class Index:
    """Segments of one block: for each (dimension, level) the rows whose component has that quantised size."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.n, self.width = x.shape
        size = np.abs(x)
        top = np.maximum(size.max(axis=0), 1)
        level = np.minimum(LEVELS - 1, (size * LEVELS / (top + 1)).astype(np.int64))
        dims = np.arange(self.width)
        key = (dims * LEVELS + level).T.ravel()  # rows of a dimension stand together
        order = np.argsort(key, kind="stable")
        self.rows = (order % self.n).astype(np.int64)
        self.values = x.T.ravel()[order]
        edges = np.searchsorted(key[order], np.arange(self.width * LEVELS + 1))
        self.start, self.end = edges[:-1], edges[1:]
        self.dim = np.repeat(dims, LEVELS)
        self.impact = ((np.tile(np.arange(LEVELS), self.width) + 1) * np.repeat(top + 1, LEVELS)) / LEVELS  # no member is larger
        self.norm2 = (x.astype(np.float64) ** 2).sum(axis=1)

    def search(self, q: np.ndarray, k: int, barred: np.ndarray) -> np.ndarray:
        """Rows that can be among the ``k`` best for ``q``; ``barred`` rows take no part."""
        order = np.argsort(-np.abs(q)[self.dim] * self.impact, kind="stable")
        order = order[self.end[order] > self.start[order]]
        score, left_x = np.zeros(self.n), self.norm2.copy()
        left_q = np.full(self.n, float((q.astype(np.float64) ** 2).sum()))
        open_rows = np.ones(self.n, bool)
        open_rows[barred] = False
        for i in range(0, len(order), STRIDE):
            some = order[i : i + STRIDE]
            lengths = self.end[some] - self.start[some]
            at = np.repeat(self.start[some] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            rows, values = self.rows[at], self.values[at].astype(np.float64)
            qs = np.repeat(q[self.dim[some]], lengths).astype(np.float64)
            score += np.bincount(rows, values * qs, self.n)
            left_x -= np.bincount(rows, values * values, self.n)
            left_q -= np.bincount(rows, qs * qs, self.n)
            slack = np.sqrt(np.maximum(left_x, 0) * np.maximum(left_q, 0)) * (1 + 1e-9) + 1e-3
            candidates = np.flatnonzero(open_rows)
            if len(candidates) <= k:
                return candidates
            low, high = score[candidates] - slack[candidates], score[candidates] + slack[candidates]
            certain = np.partition(low, len(low) - k)[len(low) - k]
            open_rows[candidates[high < certain]] = False
            if int(open_rows.sum()) <= max(4 * k, self.n // 256):
                break  # so few are left that scoring them exactly costs less than going on
        return np.flatnonzero(open_rows)


def whole(vectors: DataFrame, vector: str, floats: bool = False) -> DataFrame:
    """Rows that take part, the vector as an array of doubles; with ``floats`` an array of floats stays one."""
    v = F.col(vector).cast("array<double>")
    fit = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    same = floats and vectors.schema[vector].dataType.simpleString() == "array<float>"
    return vectors.where(fit) if same else vectors.where(fit).withColumn(vector, v)


def top_k(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector: str = "vec") -> DataFrame:
    """(query_id, rank, id, score) of integer vectors; a query's own id is left out."""
    rows, asked = (df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v")) for df in (candidates, queries))
    blocks = max(1, -(-rows.count() // BLOCK))
    shape = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    groups = max(1, -(-shape["n"] * 8 * (shape["width"] or 0) // QUERY_BYTES))
    # all queries meet all candidates, block by block: each side is repeated for the other's blocks, so groups of queries are as
    # large as a task's memory allows (65,536 queries of 64 components)
    left = rows.withColumn("b", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("g", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(_, here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        here_n, there_n = here["v"].map(len), there["v"].map(len)
        for width in there_n.unique():
            mine = here[here_n == width]
            if not len(mine):
                continue
            ids, x = mine["id"].to_numpy(), np.stack(mine["v"].to_numpy()).astype(np.int64)
            index = Index(x)
            for q_id, q in zip(there["id"][there_n == width], there["v"][there_n == width], strict=True):
                found = index.search(np.asarray(q, np.int64), k, np.flatnonzero(ids == q_id))
                score = x[found] @ np.asarray(q, np.int64)
                best = np.lexsort((ids[found], -score))[:k]
                out.append(pd.DataFrame({"query_id": q_id, "id": ids[found][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    kind = rows.schema["id"].dataType.simpleString()
    found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(run, f"query_id {kind}, id {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec")
    whole_numbers = saved(vectors.withColumn("vec", F.transform("vec", lambda x: F.floor(x * 1024.0))), "vectors")
    return top_k(whole_numbers.where("vec_id % 100 = 0"), whole_numbers, 10)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w::DOUBLE[], c.w::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
