"""Tiled scans against whole scans, alignments against the plain matrix."""

import math
import random
import re
import tracemalloc

import pytest

from flankline.functions.scalars import IUPAC
from flankline.operators import sequence


def reverse(s):
    return s[::-1].translate(str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"))


def sequences(seed, n=12):
    rng = random.Random(seed)
    fixed = [None, "", "AC", "acgtnacgt", "A" * 97, "ACGAC" * 30, "AC東GTACÿGT"]
    return [*fixed, *("".join(rng.choices(rng.choice(["ACGT", "AC", "ACGTN"]), k=rng.randrange(200))) for _ in range(n))]


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 18])
def test_iupac_tiles(spark, size):
    rows = list(enumerate(sequences(size)))
    df = spark.createDataFrame(rows, "id long, s string").repartition(3)
    for motif in ("AA", "AC-R", "NNNNN", "A"):
        pattern = re.compile("".join(f"[{IUPAC[c]}]" for c in motif.replace("-", "")))
        want = [(k, strand, m.start() + 1, m.end(), m[0], float(len(m[0]))) for k, s in rows for strand, x in (("+", (s or "").upper()), ("-", reverse((s or "").upper()))) for m in pattern.finditer(x)]
        assert found(sequence.iupac_scan(df, ["id"], "s", motif, size)) == sorted(want)


@pytest.mark.parametrize("size", [1, 5, 1 << 18])
def test_pwm_tiles(spark, size):
    pwm = [{"A": 0.7, "C": 0.1, "G": 0.1, "T": 0.1}, {"A": 0.0, "C": 0.5, "G": 0.25, "T": 0.25}, {"A": 0.25, "C": 0.25, "G": 0.25, "T": 0.25}]
    rows = list(enumerate(sequences(size)))
    want = []
    for k, s in rows:
        for strand, x in (("+", (s or "").upper()), ("-", reverse((s or "").upper()))):
            for i in range(len(x) - 2):
                site = x[i : i + 3]
                if set(site) <= set("ACGT"):
                    score = sum(math.log2(max(p[c], 1e-6) / 0.25) for p, c in zip(pwm, site, strict=True))
                    if score >= 1:
                        want.append((k, strand, i + 1, i + 3, site, score))
    assert found(sequence.pwm_scan(spark.createDataFrame(rows, "id long, s string"), ["id"], "s", pwm, 1, size)) == sorted(want)


def test_a_long_sequence_is_many_tasks(spark):
    rows = spark.range(1).selectExpr("null as id", "repeat('ACGTTGCA', 50000) as s")
    _, cut = sequence.tiles(rows.selectExpr("cast(id as long) id", "s"), ["id"], "s", 4, 1000)
    assert cut.count() == 400
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__seq" in plan
    hits = sequence.iupac_scan(rows.selectExpr("cast(id as long) id", "s"), ["id"], "s", "ACGT", 1000)
    assert hits.count() == 100_000  # a null key is a sequence of its own


def plain(a, b, match=2, mismatch=-1, gap=-2):
    """The whole matrix, cell by cell."""
    score = [[(i + j) * gap if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            score[i][j] = max(score[i - 1][j - 1] + (match if x == y else mismatch), score[i - 1][j] + gap, score[i][j - 1] + gap)
    out, i, j, steps = [], len(a), len(b), 0
    while i or j:
        steps += 1
        if i and j and score[i][j] == score[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            out.append((steps, i, j))
            i, j = i - 1, j - 1
        elif i and score[i][j] == score[i - 1][j] + gap:
            i -= 1
        else:
            j -= 1
    return [(steps - s + 1, x, y) for s, x, y in reversed(out)]


def test_alignments_in_any_memory():
    rng = random.Random(3)
    for _ in range(150):
        letters = rng.choice(["A", "AB", "ABCD東"])
        a, b = ("".join(rng.choices(letters, k=rng.randrange(25))) for _ in range(2))
        want = plain(a, b)
        for cells in (1, 20, 100, 1 << 20):
            assert sequence.align(a, b, cells=cells) == want


def test_residue_map_batches(spark):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choices("ABC", k=rng.randrange(30))), "".join(rng.choices("ABC", k=rng.randrange(30)))) for k in range(60)] + [(60, None, "AB"), (61, "", ""), (None, "AB", "AB")]
    want = sorted(((k, *x) for k, a, b in rows for x in plain(a or "", b or "")), key=str)
    df = spark.createDataFrame(rows, "id long, a string, b string").coalesce(1)
    for cells in (50, 1000, 1 << 20):
        assert sorted((tuple(r) for r in sequence.residue_map(df, ["id"], "a", "b", cells).collect()), key=str) == want


def test_long_alignment_in_bounded_memory():
    rng = random.Random(5)
    a = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=4000))
    b = "".join(c for c in a if rng.random() > 0.02)
    tracemalloc.start()
    places = sequence.align(a, b, cells=1 << 20)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6 and len(places) == len(b) and all(a[i - 1] == b[j - 1] for _, i, j in places)
