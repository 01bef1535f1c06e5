"""Seed matches by segments and best seeds by bounds against all pairs."""

import random

import pytest

from flankline.operators import anchors, seeds


def compared(a, b):
    a, b = (a or "").replace("*", ""), (b or "").replace("*", "")
    n = min(len(a), len(b))
    return (sum(x == y for x, y in zip(a, b, strict=False)) / n, n / max(len(a), len(b))) if n else (0.0, 0.0)


def mutated(rng, s, share):
    out = [rng.choice("ACDE") if rng.random() < share else c for c in s]
    return "".join(out)[: rng.randrange(max(1, int(len(s) * 0.9)), len(s) + 1)] + "".join(rng.choices("ACDE", k=rng.choice([0, 0, 1, 4])))


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(7)
    base = ["".join(rng.choices("ACDEFGHIKL", k=k)) for k in (1, 2, 5, 19, 20, 21, 39, 40, 60, 61, 150, 151, 400)]
    proteins = [None, "", "*", "A*C", *base, *(mutated(rng, s, share) for s in base for share in (0.01, 0.04, 0.08, 0.3) for _ in range(3))]
    return list(enumerate(proteins)), [(k, f"f{k % 5}", s) for k, s in enumerate(["", None, *base, *base[:3], *(mutated(rng, s, 0.05) for s in base)])]


@pytest.mark.parametrize("identity, coverage", [(0.95, 0.95), (0.9, 0.8), (1.0, 0.5), (0.7, 1.0)])
def test_close_matches(spark, sequences, identity, coverage):
    proteins, own = sequences
    p, s = spark.createDataFrame(proteins, "i int, q string").repartition(3), spark.createDataFrame(own, "j int, family string, seed string")
    got = sorted((r.i, r.j, r.identity, r.coverage) for r in seeds.close_matches(p, s, "q", "seed", identity, coverage).collect())
    every = ((i, j, *compared(q, t)) for i, q in proteins for j, _, t in own)
    assert got == sorted(x for x in every if x[2] >= identity and x[3] >= coverage)


def test_no_nested_loop(spark, sequences):
    proteins, own = sequences
    p, s = spark.createDataFrame(proteins, "i int, q string"), spark.createDataFrame(own, "j int, family string, seed string")
    plan = seeds.close_matches(p, s, "q", "seed")._jdf.queryExecution().executedPlan().toString()
    plan += seeds.best_seeds(p, s, ["i"], "q", "seed", "family", "j")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="differ everywhere"):
        seeds.close_matches(p, s, "q", "seed", 0.01, 0.5)


@pytest.mark.parametrize("block, dealt", [(1 << 21, 1 << 16), (50, 7)])
def test_best_seeds(spark, sequences, block, dealt):
    proteins, own = sequences
    p = spark.createDataFrame([(i, q, "xy"[i % 2]) for i, q in proteins], "i int, q string, a string").repartition(3)
    s = spark.createDataFrame([(j, f, t, a) for j, f, t in own for a in ("x", "y", "z") if (j + ord(a)) % 3], "j int, family string, seed string, a string")
    rows = [tuple(r) for r in s.collect()]
    want = {}
    for i, q in proteins:
        best = max(((*compared(q, t), -j, f) for j, f, t, a in rows if a == "xy"[i % 2] and (t or "").replace("*", "")), default=(0.0, 0.0, 0, ""))
        want[i] = (best[3], best[0], best[1]) if best[:2] > (0.0, 0.0) else ("", 0.0, 0.0)
    got = {r.i: (r.best_family, r.identity, r.coverage) for r in seeds.best_seeds(p, s, ["i"], "q", "seed", "family", "j", ["a"], block, dealt).collect()}
    assert got == want


def test_rescue_with_guard(spark):
    proteins = spark.createDataFrame([("d", "p1", "t", "coxL", None, "MKLVMKLVMKLVMKLVMKLV"), ("d", "p2", None, "other", "x", "MKLVMKLVMKLVMKLVMKLV"), ("d", "p3", "t", "COXL", "x", "MKLVMKLVMKLVMKLVMKAA")], "dataset_name string, protein_accession string, locus_tag string, gene string, product string, s string")
    own = spark.createDataFrame([("CO", "coxL", "MKLVMKLVMKLVMKLVMKL*V"), ("CO", "coxL", "MKLVMKLVMKLVMKLVMKLL")], "analyte string, anchor_family string, seed string")
    got = anchors.seed_rescue(proteins, own, "s", "seed", ["gene", "product"], {"coxL": ["coxl"]}).collect()
    assert [(r.protein_accession, r.identity, r.coverage, r.product, r.evidence_type) for r in got] == [("p1", 1.0, 1.0, "", "seed_back_confirmed")]


def test_all_pairs_of_like_length(spark):
    from flankline.operators import anchors

    texts = ["ACGT", "ACGA", "TTTTT", "ACGTACGTAC", "ACGTACGTA*", "GGGGGGGGG", "", None]
    p = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    s = spark.createDataFrame(list(enumerate(texts)), "j int, seed string")
    own = [(i, t.replace("*", "")) for i, t in enumerate(texts) if t]
    want = [(i, j, sum(a == b for a, b in zip(x, y)) / min(len(x), len(y))) for i, x in own for j, y in own if min(len(x), len(y)) >= 0.8 * max(len(x), len(y))]
    for got in (anchors.seed_matches(p, s, "q", "seed", 0.0, 0.8), seeds.like_lengths(p, s, "q", "seed", 0.8, dealt=2)):
        assert sorted((r.i, r.j, r.identity) for r in got.collect()) == sorted(want)
