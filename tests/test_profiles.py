"""Profile scores by bitmaps against vectors of zeros and ones."""

import math
import random

import pytest

from flankline.operators import stats


def information(x, y):
    n = len(x)

    def entropy(*values):
        return -sum(v / n * math.log2(v / n) for v in values if v)

    cells = [sum(a == p and b == q for a, b in zip(x, y, strict=True)) for p in (0, 1) for q in (0, 1)]
    hx, hy = (entropy(sum(v), n - sum(v)) for v in (x, y))
    return max(0.0, min(1.0, (hx + hy - entropy(*cells)) / min(hx, hy))) if hx and hy else 0.0


def test_profiles_by_hand(spark, monkeypatch):
    monkeypatch.setattr(stats, "BITMAP_BITS", 4096 * 8)
    rng = random.Random(2)
    loci = [(rng.choice(["CO", "CN", None]), rng.choice([None, *(f"o{i}" for i in range(30))])) for _ in range(60)]
    candidates = [(k, rng.choice(["CO", "CN", "NO", None]), rng.choice("ab"), rng.choice([None, *(f"o{i}" for i in range(35))])) for k in range(200)]
    organisms = sorted({o for _, o in loci if o} | {c[3] for c in candidates if c[3]})
    want = {}
    for k, analyte, kind, _ in candidates:
        mark = [int((analyte, o) in loci) for o in organisms]
        have = [int(any(c[1:] == (analyte, kind, o) for c in candidates)) for o in organisms]
        want[k] = information(mark, have)
    df = spark.createDataFrame(candidates, "k int, analyte string, regulator_class string, organism string").repartition(3)
    out = stats.profile_scores(df, spark.createDataFrame(loci, "analyte string, organism string"))
    got = {r.k: r.phylogenetic_profile_score for r in out.collect()}
    assert got == pytest.approx(want) and any(v > 0 for v in want.values())
    assert stats.profile_scores(df.where("organism = 'o1'"), spark.createDataFrame([("CO", "o1")], "analyte string, organism string")).agg({"phylogenetic_profile_score": "max"}).first()[0] == 0


def test_buckets_that_are_over_full(spark, monkeypatch):
    """More organisms than a bucket holds go on in further ones, each with its own bit."""
    monkeypatch.setattr(stats, "BITMAP_BITS", 8)
    rows = stats.numbered_bits(spark.range(200).selectExpr("concat('o', id) as o"), "o", 20).collect()
    assert len({(r.bucket, r.bit) for r in rows}) == 200 and max(r.bit for r in rows) == 7


def test_candidates_are_computed_once(spark):
    """Scores come from a saved table: what made the candidates is not run again for each use of them."""
    rows = spark.createDataFrame([("a", "x", "o1"), ("a", "y", "o2")], "analyte string, regulator_class string, organism string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    made = rows.coalesce(1).mapInArrow(counted, rows.schema)
    assert stats.profile_scores(made, spark.createDataFrame([("a", "o1"), ("a", "o2"), ("b", "o3")], "analyte string, organism string")).count() == 2
    assert seen.value == 2
