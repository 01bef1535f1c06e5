"""Tree intervals, closure and lineages against plain walks; cycles."""

import random

import pytest
from pyspark.sql import functions as F

from flankline.operators import lineage


def forest(seed, n=120):
    rng = random.Random(seed)
    out = [(100, 100), (200, None), (300, 999)]  # a root is its own parent, has none, or one that is no node
    for k in range(n):
        out.append((1000 + rng.randrange(10**6) * 200 + k, rng.choice(out)[0] if rng.random() < 0.6 else out[-1][0]))
    return out


def walked(rows):
    known = {k for k, _ in rows}
    up = {k: p if p in known and p != k else None for k, p in rows}
    children = {}
    for k in sorted(up):
        children.setdefault(up[k], []).append(k)
    out, number = {}, 0

    def visit(k, depth):
        nonlocal number
        number += 1
        pre = number
        for c in children.get(k, []):
            visit(c, depth + 1)
        out[k] = (pre, number, depth)

    for root in children[None]:
        visit(root, 0)
    return up, out


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", range(2))
def test_intervals_by_walk(spark, many_ranges, seed):
    rows = forest(seed)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "taxon_id long, parent_id long").repartition(3)
    up, want = walked(rows)
    placed = lineage.intervals(df)
    assert {r.node: (r.pre, r.last, r.depth) for r in placed.collect()} == want
    inner = max(want, key=lambda k: (want[k][1] - want[k][0]) if want[k][2] else 0)
    assert {r.node for r in lineage.below(placed, inner).collect()} == {k for k, v in want.items() if want[inner][0] <= v[0] <= want[inner][1]}
    assert lineage.below(placed, -1).count() == 0
    closure = {(r.node, r.ancestor): r.distance for r in lineage.ancestor_closure(df).collect()}
    expected = {}
    for k in up:
        at, d = k, 0
        while at is not None:
            expected[k, at] = d
            at, d = up[at], d + 1
    assert closure == expected


@pytest.mark.parametrize("size", [4, 1 << 14])
def test_lineages_by_closure(spark, size):
    rows = forest(5)
    rng = random.Random(6)
    df = spark.createDataFrame([(k, p, rng.choice(["phylum", "genus", "no rank", None]), rng.choice([f"n{k % 17}", None])) for k, p in rows], "taxon_id long, parent_id long, rank string, name string")
    names = df.select(F.col("taxon_id").alias("node"), "rank", "name")
    want = lineage.lineage_pivot(lineage.ancestor_closure(df), names.withColumnRenamed("node", "ancestor"), ["phylum", "genus"])
    got = lineage.lineages(lineage.intervals(df), names, ["phylum", "genus"], size)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_few_rounds_and_small_guesses(spark, monkeypatch):
    """A flat tree takes rounds by its depth, not by its nodes, and no plan guesses a size beyond the files that it reads: guesses
    that are squared in each round had filled the driver. Names and nodes are merged, not sent to every task."""
    guesses = []
    real = lineage.saved
    monkeypatch.setattr(lineage, "saved", lambda df: guesses.append(real(df)) or guesses[-1])
    star = spark.range(1, 5000).selectExpr("id AS taxon_id", "1L AS parent_id", "'species' AS rank", "concat('n', id) AS name")
    placed = lineage.intervals(star)
    assert len(guesses) <= 14
    names = star.selectExpr("taxon_id AS node", "rank", "name")
    out = lineage.lineages(placed, names, ["species"])
    assert all(int(str(g._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 32 for g in guesses)
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
    assert placed.count() == out.count() == 4999


def test_a_long_chain_is_no_cycle(spark):
    chain = spark.range(300).selectExpr("id AS taxon_id", "id - 1 AS parent_id")
    deepest = lineage.depths(chain).orderBy(F.desc("depth")).first()
    assert (deepest.node, deepest.depth) == (299, 299)
    assert lineage.ancestor_closure(chain).count() == 300 * 301 // 2


@pytest.mark.parametrize("extra", [[(7, 8), (8, 7)], [(7, 8), (8, 9), (9, 7), (10, 9), (11, 10)]])
def test_cycles_are_found(spark, extra):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), *extra], "taxon_id long, parent_id long")
    for walk in (lineage.depths, lineage.intervals, lineage.ancestor_closure):
        with pytest.raises(ValueError, match="cycle"):
            walk(df)


def test_odd_trees(spark):
    none = spark.createDataFrame([], "taxon_id long, parent_id long")
    assert lineage.intervals(none).count() == 0 and lineage.ancestor_closure(none).count() == 0
    with pytest.raises(ValueError, match="twice"):
        lineage.intervals(spark.createDataFrame([(1, 1), (1, None)], "taxon_id long, parent_id long"))
    star = spark.range(1, 2000).selectExpr("id AS taxon_id", "1L AS parent_id")
    assert lineage.intervals(star).agg(F.max("pre"), F.max("depth"), F.max("last")).first() == (1999, 1, 1999)
