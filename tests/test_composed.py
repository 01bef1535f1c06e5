"""Composed operators against brute force or hand-made values."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flankline import session
from flankline.operators import anchors, annotate, evaluate, lineage, scoring, stats
from flankline.plans import surrogate
from flankline.sources import store
from tests.conftest import same


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.7])
def test_archetype_leaders_by_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 10))
    texts = {">".join([*(f"{k:+d}:{rng.choice('ab')}" for k in (-2, -1, 1) if rng.random() < 0.8), "0:x"]) for _ in range(40)} | {"", "plain"}
    rows = spark.createDataFrame([(t,) for t in texts for _ in range(2)], "architecture string")
    got = {r.architecture: r.archetype_no for r in scoring.archetype_ids(rows, "architecture", threshold).collect()}
    assert got == scoring.archetype_ids_in_order(sorted(texts), threshold)


def test_strata_without_a_feature_count(spark):
    rng = random.Random(1)
    rows = [(f"l{k}", rng.random() < 0.4, f"s{k % 5}", f) for k in range(300) for f in {rng.choice("abc") + ("z" if k % 5 == 4 else "")}]
    df = spark.createDataFrame(rows, "locus string, is_case boolean, stratum string, feature string")
    counts = {}
    for _, case, stratum, _ in rows:
        counts.setdefault(stratum, [0, 0])[not case] += 1
    full = []
    for feature in {r[3] for r in rows}:
        for stratum, (n1, n0) in counts.items():
            a = sum(r[1] for r in rows if r[2] == stratum and r[3] == feature)
            c = sum(not r[1] for r in rows if r[2] == stratum and r[3] == feature)
            full.append((feature, stratum, a, n1 - a, c, n0 - c))
    want = {r.feature: r for r in stats.cmh(spark.createDataFrame(full, "feature string, stratum string, a long, b long, c long, d long"), ["feature"]).collect()}
    got = stats.stratified(df, ["feature"], "locus", F.col("is_case"), ["stratum"]).collect()
    assert {r.feature for r in got} == set(want)
    for r in got:
        w = want[r.feature]
        assert (r.statistic, r.odds_ratio, r.p_value) == pytest.approx((w.statistic, w.odds_ratio, w.p_value)) and (r.n_a, r.n_d) == (w.n_a, w.n_d)


def test_robustness(spark):
    rows = [(f"l{k}", "x" if k % 3 else "y", f"g{k % 7}", float(k), "f" if k % 2 else "h") for k in range(60)]
    df = spark.createDataFrame(rows, "locus string, side string, genus string, score double, feature string")
    out = stats.robustness(df, ["feature"], "locus", "side", "x", {"none": None, "one_per_genus": "genus"}, "score", ["genus"])
    got = {(r.deduplication_policy, r.feature): r for r in out.collect()}
    assert set(got) == {(p, f) for p in ("none", "one_per_genus") for f in "fh"} and all(r.test == "cmh" and 0 <= r.q_value <= 1 for r in got.values())
    assert got["one_per_genus", "f"].n_a + got["one_per_genus", "f"].n_b == 7
    plain = stats.enrichment(df, ["feature"], "locus", F.col("side") == "x", test="cmh").first()
    assert plain.test == "fisher"


def test_policies_by_brute_force_in_one_pass(spark):
    rng = random.Random(3)
    loci = [(None if k % 29 == 0 else f"l{k % 45}", rng.choice("xy"), rng.choice(["g1", "g2", "g3", None]), rng.choice(["f1", "f2"]), rng.choice([None, 1.0, 2.0])) for k in range(60)]
    rows = [(*locus, f) for locus in loci for f in rng.choices(["a", "b", None], k=3)]
    df = spark.createDataFrame(rows, "locus string, side string, genus string, family string, score double, feature string")
    policies = {"none": None, "one_per_genus": "genus", "one_per_family": "family"}
    want = [(*r, "none") for r in rows]
    for policy, at in (("one_per_genus", 2), ("one_per_family", 3)):
        best = {}
        for r in rows:
            place = (r[4] is None, -(r[4] or 0), r[0] is not None, r[0] or "")
            best[r[1], r[at]] = min(best.get((r[1], r[at]), (place, r[0])), (place, r[0]), key=lambda x: x[0])
        chosen = {x[1] for x in best.values()} - {None}
        want += [(*r, policy) for r in rows if r[0] in chosen]
    got = stats.under_policies(df, "locus", "side", policies, "score")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    only = stats.under_policies(df, "locus", "side", {"one_per_genus": "genus"}, "score")
    assert sorted(map(tuple, only.collect()), key=repr) == sorted((r for r in want if r[-1] == "one_per_genus"), key=repr)
    # read once for each thinned policy's loci and once for all policies' rows
    assert got._jdf.queryExecution().analyzed().toString().count("LogicalRDD") == 3


def test_a_task_of_enrichment_has_a_bounded_number_of_rows(spark, sf, duck, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 200, raising=False)
    per_task = [r["count"] for r in surrogate.enrichment_rows(spark, sf).groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) <= 200 < sum(per_task) / 4
    assert same(surrogate.robustness_counts(spark, sf), duck, surrogate.ORACLE_SQL["robustness_counts"])


def test_ranks_and_first_candidates(spark):
    rows = [(f"c{k}", f"GENE_{k % 50}_x", float((k * 37) % 101) if k % 9 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "candidate_id string, gene_accession string, candidate_score double")
    ranked = evaluate.ranks(df, "candidate_score", ["candidate_id"])
    got = [r.candidate_id for r in ranked.orderBy("rank").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))]
    truth = spark.createDataFrame([("b1", "GENE_7_"), ("b2", "nowhere"), ("b3", "")], "benchmark_id string, protein_name string")
    first = {r.benchmark_id: r for r in evaluate.first_candidates(truth, ranked, "benchmark_id", "protein_name").collect()}
    want = min((got.index(r[0]) + 1, r[0]) for r in rows if "GENE_7_" in r[1])
    assert (first["b1"]["rank"], first["b1"].candidate_id) == want and first["b2"]["rank"] is None and first["b3"]["rank"] is None
    one = spark.createDataFrame([(0.5, 0.1)], "recall double, fpr double")
    metrics = evaluate.metric_rows(one, {"recall": F.col("candidate_score") > 50}, df, {"fpr": "all rows"}).collect()
    assert [(m.metric, m.value, m.notes) for m in metrics] == [("recall", 0.5, ""), ("fpr", 0.1, "all rows")] and metrics[1].n == 500


def test_archetype_lookup(spark):
    cands = spark.createDataFrame([("c1", "CO", "a", None), ("c2", "NO", "a", None), ("c3", "NO", "b", "old")], "candidate_id string, analyte string, architecture string, archetype_id string")
    arch = spark.createDataFrame([("CO", "a", "A1"), ("", "a", "A0")], "analyte string, architecture_string string, archetype_id string")
    assert {r.candidate_id: r.archetype_id for r in scoring.with_archetypes(cands, arch).collect()} == {"c1": "A1", "c2": "A0", "c3": "old"}


def test_taxonomy_stand_ins(spark):
    rows = spark.createDataFrame([("", None, 7, " Homo sapiens", "CO"), ("G", "F", 8, "", "NO")], "genus string, family string, taxon_id long, organism string, analyte string")
    got = rows.select(*(lineage.taxonomy_value(r, rows.columns, "").alias(r) for r in ("genus", "family", "phylum"))).collect()
    assert [tuple(r) for r in got] == [("Homo", "7", "CO"), ("G", "F", "NO")]
    assert rows.select(lineage.taxonomy_value("phylum", rows.columns, "unknown").alias("p")).first().p == "unknown"


def test_hits(spark):
    hits = spark.createDataFrame([("q1", "P1", 1e-9, "fam"), ("q1", "P2", 1e-5, "fam"), ("q2", "P1", 1.0, "fam"), ("q3", "P9", 1e-9, "fam")], "query_id string, target_id string, e_value double, anchor_family string")
    meta = spark.createDataFrame([("P1", "d2", "fam protein"), ("P1", "d1", "other"), ("P2", "d1", "x")], "protein_accession string, dataset_name string, product string")
    assert anchors.hits_with_metadata(hits, meta).count() == 6
    found = anchors.rescued(hits, meta, [F.col("e_value"), F.col("target_id")], 1e-3).collect()
    assert [(r.query_id, r.protein_accession, r.dataset_name) for r in found] == [("q1", "P1", "d1")]
    assert anchors.rescued(hits, meta, [F.col("e_value")], 1e-3, ["product"]).count() == 0
    rows = spark.createDataFrame([("d2", "CO", "f", "p", ""), ("d1", "CO", "f", "q", ""), ("d1", "CN", "f", "q", "")], "dataset_name string, analyte string, anchor_family string, protein_accession string, locus_tag string")
    assert {(r.dataset_name, r.analyte): r.cluster_id for r in anchors.numbered(rows).collect()} == {("d1", "CN"): 1, ("d1", "CO"): 2, ("d2", "CO"): 3}
    assert anchors.detect("hmmer", profile=lambda: rows).count() == 3
    with pytest.raises(NotImplementedError):
        anchors.detect("diamond", profile=lambda: rows)
    genes = spark.createDataFrame([("L", ["a"], []), ("L", [], []), ("M", [], [])], "locus_id string, pfam_ids array<string>, interpro_ids array<string>")
    assert {r.locus_id: r.n_unannotated for r in annotate.unannotated(genes).collect()} == {"L": 1, "M": 1}


def test_shard_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("s-0", 0, 1, ["d"], "p")], "shard_id string, shard_no int, n_datasets int, dataset_names array<string>, `group` string")
    store.write_shards(rows, str(tmp_path / "s"))
    assert store.read_shards(spark, str(tmp_path / "s")).collect() == rows.collect()
    rows.drop("group").write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        store.read_shards(spark, str(tmp_path / "t"))


def test_figure_data(spark):
    from flankline.operators import reports

    candidates = spark.createDataFrame([("c1", 0.5, None), ("c2", 0.9, 0.2), ("c3", 0.9, 0.7)], "candidate_id string, candidate_score double, structural_plausibility_score double")
    loci = spark.createDataFrame([("CO", "l2", 2.0, "low"), ("CO", "l1", 1.0, None), ("CN", "l3", 9.0, "high")], "analyte string, locus_id string, locus_score double, locus_confidence string")
    archetypes = spark.createDataFrame([(f"a{k:02d}", "CO", k % 5) for k in range(20)], "archetype_id string, analyte string, n_loci int")
    enrichment = spark.createDataFrame([("CO", "x", 2.0, 0.1), ("CO", "y", 1.0, 1.0)], "analyte string, feature_name string, odds_ratio double, q_value double")
    recovery = spark.createDataFrame([("CO", True), ("CO", False)], "analyte string, hit boolean")
    data = reports.figure_data(recovery, loci, archetypes, enrichment, candidates)
    got = {name.split("_")[1]: [tuple(r) for r in df.collect()] for name, df in data.items()}
    assert got["1"] == [("CO", 1, 2, 50.0)]
    assert sorted((r.place, r.locus_id, r.locus_confidence) for r in data["figure_2_locus_landscape"].collect()) == [(0, "l3", "high"), (1, "l1", "low"), (2, "l2", "low")]
    assert got["3"][:2] == [("a04 (CO)", 4), ("a09 (CO)", 4)] and len(got["3"]) == 12
    assert got["4"] == [("CO x", 2.0, 0.1, 162.0), ("CO y", 1.0, 1.0, 30.0)]
    assert got["5"] == [("c2", 0.9), ("c3", 0.9), ("c1", 0.5)]
    assert got["6"] == [("c3", 0.7), ("c2", 0.2)]
    assert reports.structure_hypotheses(candidates.drop("structural_plausibility_score")).count() == 0


def test_contigs_and_stand_in_names(spark):
    from flankline.plans import discovery

    rows = [("d", "c1", "CDS", k * 10, k * 10 + 5, "+", "" if k == 2 else f"p{k}", f"t{k}", "", "x", "" if k == 1 else f"f{k}") for k in range(4)] + [("d", "c2", "CDS", 0, 5, "+", "p9", "t9", "", "x", "f9")]
    features = spark.createDataFrame(rows, "dataset_name string, seqid string, feature_type string, start_nt long, end_nt long, strand string, protein_accession string, locus_tag string, gene string, product string, feature_id string")
    hits = spark.createDataFrame([("CO", "cox", "d", "p1", "t1", "")], "analyte string, anchor_family string, dataset_name string, protein_accession string, locus_tag string, gene string")
    contigs = spark.createDataFrame([("d", "c1")], "dataset_name string, seqid string")
    loci, genes = discovery.extract(features, hits, 2, contigs)
    assert [r.gene_accession for r in genes.orderBy("relative_index").collect()] == ["p0", "p1", "f2", "p3"]
    assert discovery.genes_of(genes, loci, "CO").count() == 4 and discovery.genes_of(genes, loci, "CN").count() == 0
    with pytest.raises(ValueError):
        discovery.extract(features, hits, 2, contigs.where("seqid = 'c2'"))


def test_an_anchor_meets_one_feature_for_each_kind(spark):
    """However many features share an identifier, an anchor is joined with the first of them alone."""
    a = spark.createDataFrame([(i, "hot", "d") for i in range(50)] + [(99, "", "d"), (98, "cold", "e")], "k int, tag string, d string")
    f = spark.createDataFrame([(i, "hot", "d", 7 - i % 7) for i in range(60)] + [(70, "cold", "d", 1), (71, "cold", "e", None), (72, "cold", "e", 0)], "f int, tag string, d string, at int")
    out = anchors.resolve(a, f, "k", [("tag", "tag")], [("d", "d")], ["at", "f"])
    assert sorted((r.k, r.f) for r in out.collect()) == [*((i, 6) for i in range(50)), (98, 71)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]


def test_hits_with_metadata_are_written_by_target(spark):
    hits = spark.createDataFrame([(i, f"s{i * 7 % 5}") for i in range(200)], "q int, target_id string").coalesce(1)
    meta = spark.createDataFrame([(f"s{i % 4}", f"d{i}") for i in range(40)], "protein_accession string, dataset_name string")
    got = [r.protein_accession for r in anchors.hits_with_metadata(hits, F.broadcast(meta)).collect()]
    assert len(got) == 160 * 10 + 40 and got == sorted(got)


def test_enrichment_is_looked_up_in_the_row(spark):
    from flankline.operators import scoring

    known = spark.createDataFrame([("a", "x", 4.0, 0.01), ("a", "x", 8.0, 0.2), ("b", "y", 2.0, 0.5), ("a", None, 64.0, 0.0)], "feature_type string, feature_name string, odds_ratio double, q_value double")
    rows = spark.createDataFrame([(1, "x", ["y", "z"]), (2, None, []), (3, "q", ["y"])], "id int, c string, d array<string>")
    pair = lambda t, c: F.struct(F.lit(t).alias("feature_type"), c.alias("feature_name"))
    features = F.concat(F.array(pair("a", F.col("c"))), F.transform("d", lambda d: pair("b", d)))
    out = scoring.attach_enrichment(rows, "id", features, known, 3.0)
    got = {r.id: (r.enrichment_score, r.candidate_score_q) for r in out.collect()}
    assert got[1][1] == 0.01 and got[1][0] > got[3][0] == 0 and got[2] == (0.0, None) and got[3][1] == 0.5
    assert out._jdf.queryExecution().sparkPlan().toString().count("hashpartitioning") == 0 and "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    none = scoring.attach_enrichment(rows, "id", features, known.where("false"), 3.0)
    assert {(r.enrichment_score, r.candidate_score_q) for r in none.collect()} == {(0.0, None)}


def test_hits_of_few_targets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(anchors, "BLOCK", 20)
    monkeypatch.setattr(session, "ROWS_A_TASK", 5_000)
    monkeypatch.setattr(session, "ROWS_RETURNED", 5_000)
    rows = [(i, "hot") for i in range(500)] + [(i % 2, "warm") for i in range(60)] + [(7, None), (7, None), (8, "none"), *[(i, "lone") for i in range(30)]]
    sets = [("hot", f"d{i}") for i in range(250)] + [("warm", None), ("warm", "x"), ("warm", "x"), (None, "n"), ("unmet", "u"), ("", "e")]
    hits = spark.createDataFrame(rows, "q int, target_id string").coalesce(1)
    out = anchors.hits_with_metadata(hits, spark.createDataFrame(sets, "protein_accession string, dataset_name string").coalesce(1))
    assert out.columns == ["q", "target_id", "dataset_name", "protein_accession"]
    want = Counter((q, t, d, t) for q, t in rows for d in ([d for k, d in sets if k == t and t is not None] or [None]))
    parts = out.groupBy(F.spark_partition_id().alias("p"), *out.columns).count().collect()
    got = Counter()
    for r in parts:
        got[(r.q, r.target_id, r.dataset_name, r.protein_accession)] += r["count"]
    assert got == want
    tasks = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 15 and max(r["count"] for r in tasks) < 30_000


def test_hits_without_rows_or_metadata(spark):
    hits = spark.createDataFrame([(1, "a"), (2, None)], "q int, target_id string")
    meta = spark.createDataFrame([("a", "d")], "protein_accession string, dataset_name string")
    assert anchors.hits_with_metadata(hits.where("q > 5"), meta).count() == 0
    assert sorted(r.q for r in anchors.hits_with_metadata(hits, meta.where("dataset_name = 'x'")).collect()) == [1, 2]
