"""Substring search by the trigram index against the nested loop."""

import random

import pytest
from pyspark.sql import functions as F

from flankline.operators import catalog, evaluate, trigrams

TEXTS = [None, "", "a", "AB", "abc", "xabcx", "carbon monoxide dehydrogenase", "CARBON", "100% pure_x", "a\\b", "É et", "été", "a\nb", "\u0002", "東京都", "aaa", "ba", "ab" * 40]
TERMS = [None, "", "a", "B", "ab", "abc", "mono%ase", "mono_ide", "%", "_", "__", "é", "É", "bon", "0\\%", "\\\\", "京", "nowhere", "Carbon Monoxide", "aa%", "x%y%z", "\n"]


def like(text, term):
    return F.ilike(text, F.concat(F.lit("%"), term, F.lit("%")))


def sets(df):
    return sorted((r["i"], r["j"], r["term"]) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("abC %_", k=rng.randrange(12))) for _ in range(120)]
    terms = TERMS + ["".join(rng.choices("abc%_", k=rng.randrange(6))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, texts[-i - 1]) for i, t in enumerate(texts)], "i int, text string, other string")
    return rows, spark.createDataFrame(list(enumerate(terms)), "j int, term string")


@pytest.mark.parametrize("kept", [False, True])
def test_patterns(spark, tables, tmp_path, kept):
    rows, terms = tables
    columns = ["text", "other"]
    index = None
    if kept:
        trigrams.write_index(rows, columns, str(tmp_path))
        index = trigrams.read_index(spark, str(tmp_path))
    got = trigrams.matches(rows, terms, "term", columns, index)
    loop = rows.crossJoin(terms).where(F.coalesce(like(F.col("text"), F.col("term")), F.lit(False)) | F.coalesce(like(F.col("other"), F.col("term")), F.lit(False)))
    assert sets(got) == sets(loop)


@pytest.mark.parametrize("kept", [False, True])
def test_containment(spark, tables, tmp_path, kept):
    rows, terms = tables
    if kept:
        trigrams.write_index(rows, ["text"], str(tmp_path))
    got = trigrams.matches(rows, terms, "term", ["text"], trigrams.read_index(spark, str(tmp_path)) if kept else None, wildcards=False)
    loop = rows.crossJoin(terms.where("term <> ''")).where(F.contains(F.lower("text"), F.lower("term")))
    assert sets(got) == sets(loop)


def test_plans_have_no_nested_loop(spark, tables):
    rows, terms = tables
    terms = terms.where("length(replace(replace(term, '%', ''), '_', '')) >= 3 AND term NOT LIKE '%\\%\\%%'").where("term in ('abc', 'bon')")
    for wildcards in (True, False):
        plan = trigrams.matches(rows, terms, "term", ["text"], wildcards=wildcards)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner, " in plan and "Join Inner\n" not in plan


def test_small_files_are_not_sent_to_every_task(spark, tables, tmp_path):
    """Rows in a file of few bytes may be very many: only terms and what is found are sent to every task."""
    rows, terms = tables
    rows.write.parquet(str(tmp_path / "rows"))
    kept = spark.read.parquet(str(tmp_path / "rows"))
    found, _ = trigrams.candidates(trigrams.postings(kept, ["text"]), None, terms.where("term in ('abc', 'bon')").select("term").distinct())
    for df, keys in ((found, "[gram"), (trigrams.matches(kept, terms.where("term in ('abc', 'bon')"), "term", ["text"]), "[__term")):
        joins = [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and keys in line]
        assert len(joins) == 1 and "BroadcastHashJoin" in joins[0] and ("BuildLeft" if keys == "[gram" else "BuildRight") in joins[0]
    loop = trigrams.matches(kept, terms.where("term in ('B', '%')"), "term", ["text"])._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastNestedLoopJoin BuildRight" in loop  # terms that are compared with every row go to the rows


def test_search_by_index(spark, tables, tmp_path):
    rows, _ = tables
    trigrams.write_index(rows, ["text"], str(tmp_path))
    index = trigrams.read_index(spark, str(tmp_path))
    for query in ("ab", "mono%ase", "", "b c", "zzz"):
        for per in (None, "other"):
            a, b = (catalog.search(rows, query, ["text"], [F.col("text"), F.col("i")], 7, per, x) for x in (None, index))
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_scan_with_proteins(spark):
    features = spark.createDataFrame([("p1", "x", None), ("p2", "y", "kinase"), (None, "kinase", "kinase"), ("p3", "kinase two", "")], "protein_accession string, gene string, product string")
    proteins = spark.createDataFrame([("p1", "Sensor KINASE"), ("p1", "no"), ("p9", "kinase")], "protein_accession string, description string")
    targets = spark.createDataFrame([("CO", "kinase"), ("CN", "kin_se t")], "analyte string, term string")
    got = catalog.term_scan(features, targets, ["gene", "product", "description"], "protein_accession", ["analyte", "term", "protein_accession"], proteins)
    assert sorted((r.analyte, r.protein_accession) for r in got.collect()) == [("CN", "p3"), ("CO", "p1"), ("CO", "p2"), ("CO", "p3")]


def test_recovery_by_hand(spark):
    truth = spark.createDataFrame([(1, "cox", "CO", False), (2, "Q9", "CN", True), (3, None, "CO", False), (4, "zz", "CN", True), (5, "x", "CN", False)], "id int, name string, analyte string, neg boolean")
    hits = spark.createDataFrame([("has COXL", "CO"), ("q9 here", "CO"), ("x", "CO"), (None, "CN")], "hay string, kind string")
    got = {r.id: (r.recovered, r.hit) for r in evaluate.recovery(truth, hits, "id", ["name"], "hay", [("analyte", "kind")], "neg").collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, True), 5: (False, False)}
