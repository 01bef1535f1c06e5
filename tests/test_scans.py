"""Scans over ranges against plain loops; q values, ranks and curves of large single groups."""

import random

import pytest
from pyspark.sql import functions as F

from flankline.operators import evaluate, scans, stats


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables would be one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(k, rng.choice(["a", "b", None]) if k % 3 else "a", rng.choice([None, *range(30)]), rng.randrange(5)) for k in range(900)]
    return data, spark.createDataFrame(data, "k int, g string, o int, v long").repartition(5)


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sums(rows, inclusive):
    data, df = rows
    order = [F.desc_nulls_last("o"), F.col("k")]
    out = scans.running_sums(scans.ranged(df, ["g"], order), ["g"], order, {"s": F.col("v"), "n": F.lit(1)}, inclusive)
    assert out.select(scans.PART).distinct().count() > 1
    want = {}
    for g in ("a", "b", None):
        s = n = 0
        for k, _, _, v in sorted((r for r in data if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0])):
            want[k] = (s + v, n + 1) if inclusive else (s, n)
            s, n = s + v, n + 1
    assert {r.k: (r.s, r.n) for r in out.collect()} == want


def test_later_minimum(rows):
    data, df = rows
    out = scans.later_minimum(scans.ranged(df, [], ["k"]), [], ["k"], F.col("v") * 7 % 5 + F.col("k"), "m")
    values = [r[3] * 7 % 5 + r[0] for r in sorted(data)]
    assert [r.m for r in out.orderBy("k").collect()] == [min(values[i:]) for i in range(len(values))]


def step_up(ps):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, least = [0.0] * len(ps), 1.0
    for at in range(len(order) - 1, -1, -1):
        least = min(least, ps[order[at]] * len(ps) / (at + 1))
        out[order[at]] = least
    return out


def test_q_values(spark):
    rng = random.Random(2)
    ps = [rng.choice([0.0, 0.01, 0.01, 0.5, 1.0, rng.random() ** 3]) for _ in range(700)]
    df = spark.createDataFrame([(i, "r" if i < 600 else None, p) for i, p in enumerate(ps)], "i int, run string, p_value double").repartition(6)
    got = {r.i: (r.q_value, r.interpretation) for r in stats.benjamini_hochberg(df, run=["run"]).collect()}
    want = step_up(ps[:600]) + step_up(ps[600:])
    assert {i: q for i, (q, _) in got.items()} == pytest.approx(dict(enumerate(want)))
    assert all((q <= 0.05) == (label == "enriched") for q, label in got.values())
    one = stats.benjamini_hochberg(df.drop("run"))
    assert {r.i: r.q_value for r in one.collect()} == pytest.approx(dict(enumerate(step_up(ps))))
    assert stats.benjamini_hochberg(df.where("false")).count() == 0
    assert [r.q_value for r in stats.benjamini_hochberg(spark.createDataFrame([(None,), (0.2,)], "p_value double")).orderBy("p_value").collect()] == [None, 0.4]


def test_fisher_where_there_is_no_variance(spark):
    """Every stratum has one side only: the pooled test has no variance, the exact test on the totals is taken."""
    rows = [(f"l{i}", "s1", True, "x" if i < 3 else None) for i in range(4)] + [(f"m{i}", "s2", False, "x" if i < 1 else None) for i in range(5)]
    df = spark.createDataFrame(rows, "locus string, stratum string, case boolean, feature string")
    fallen = stats.stratified(df, ["feature"], "locus", F.col("case"), ["stratum"]).first()
    exact = stats.fisher(stats.contingency(df, ["feature"], "locus", F.col("case"))).first()
    assert (fallen.n_a, fallen.n_b, fallen.n_c, fallen.n_d) == (3, 1, 1, 4)
    assert fallen.statistic >= 0 and 0 < fallen.p_value <= 1
    assert exact.p_value == pytest.approx(0.206349, abs=1e-6)


def test_curves_of_one_group(spark):
    rng = random.Random(3)
    data = [(k, rng.randrange(40) / 7, rng.randrange(2)) for k in range(500)]
    df = spark.createDataFrame(data, "k int, s double, y int").repartition(4)
    wins = [1.0 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0.0 for a in data if a[2] for b in data if not b[2]]
    assert evaluate.auroc(df, "y", "s").first()[0] == pytest.approx(sum(wins) / len(wins))
    hits, total = 0, 0.0
    for rank, (_, _, y) in enumerate(sorted(data, key=lambda r: (-r[1], r[0])), 1):
        hits += y
        total += y * hits / rank
    assert evaluate.average_precision(df, "y", "s", ["k"], []).first()[0] == pytest.approx(total / hits)
    ranked = {r.k: r["rank"] for r in evaluate.ranks(df, "s", ["k"]).collect()}
    assert ranked == {k: i for i, (k, _, _) in enumerate(sorted(data, key=lambda r: (-r[1], r[0])), 1)}


def test_q_values_of_rows_that_are_computed_anew(spark):
    """p values that come out differently each time they are computed still have their q."""
    rows = spark.range(200, numPartitions=4).select("id", (F.rand() * 0.9).alias("p_value"))
    rows = rows.withColumn("p_value", F.col("p_value") + F.udf(lambda: __import__("random").random() * 1e-12, "double").asNondeterministic()())
    assert stats.benjamini_hochberg(rows).where("q_value IS NULL").count() == 0
