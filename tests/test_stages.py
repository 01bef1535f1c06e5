"""The run stage by stage, by command, against the run as one plan."""

import pytest
import yaml

from flankline import cli, config
from flankline.plans import discovery, stages
from tests.test_operators import LADDER, LOCUS_WEIGHTS, PAIRED, RULES, SENSORS, WEIGHTS


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    features = [(d, "c1", "CDS", k * 1000, k * 1000 + 900, "+", f"p{d}{k}", f"L{d}{k}", None, "Transcriptional regulator" if k == 3 else "protein") for d in ("d", "e") for k in range(9)]
    f = spark.createDataFrame(features, "dataset_name string, seqid string, feature_type string, start_nt long, end_nt long, strand string, protein_accession string, locus_tag string, gene string, product string")
    hits = spark.createDataFrame([("CO", "d", "coxL", "pd4", "Ld4", ""), ("CN", "e", "nit1", "pe4", "Le4", ""), ("CN", "d", "nit1", "", "Ld7", "")], "analyte string, dataset_name string, anchor_family string, protein_accession string, locus_tag string, gene string")
    domains = spark.createDataFrame([("pd3", 1, "PF00325", "d", None, None), ("pd3", 2, "PF00027", "e", None, None), ("pe3", 1, "PF00027", "e", None, None)], "gene_accession string, position int, pfam_id string, pfam_description string, interpro_id string, interpro_description string")
    taxonomy = spark.createDataFrame([("d", "Bacteria", "G1"), ("e", "Bacteria", "G2")], "organism string, superkingdom string, genus string")
    known = spark.createDataFrame([("CO", "d")], "analyte string, organism string")
    settings = {"analytes": [{"analyte": "CO"}], "scoring": {"locus_score_weights": LOCUS_WEIGHTS, "candidate_score_weights": WEIGHTS, "confidence_thresholds": LADDER}, "regulator_families": RULES, "sensory_domains": SENSORS, "paired_evidence": PAIRED}
    for name, df in (("domains", domains), ("taxonomy", taxonomy), ("known", known), ("hits", hits)):
        df.write.parquet(f"{folder}/{name}")
    return folder, f, hits, domains, taxonomy, known, settings


def test_stages_give_the_whole_run(spark, given, monkeypatch):
    folder, f, hits, domains, taxonomy, known, settings = given
    run = f"{folder}/out"
    monkeypatch.setattr(config, "load", lambda path: settings)
    loci, genes = discovery.extract(f, hits, 2)
    discovery.write({"loci": loci, "genes": genes}, run)
    command = lambda *words: cli.main([*words, "--run", run])
    command("annotate", "--domains", f"{folder}/domains")
    command("assign-roles", "--config", "c")
    command("score", "--config", "c", "--known", f"{folder}/known", "--taxonomy", f"{folder}/taxonomy")
    command("enrich", "--case", "CO", "--control", "CN")
    command("score", "--config", "c", "--with-enrichment")
    command("archetypes", "--config", "c")
    whole = discovery.discover(f, hits, domains, taxonomy, known, settings, "CO", "CN", 2)
    got = {r.candidate_id: r for r in spark.read.parquet(f"{run}/candidates").collect()}
    want = {r.candidate_id: r for r in whole["candidates"].collect()}
    assert got.keys() == want.keys() and len(want) == 2
    for k, r in want.items():
        assert (got[k].candidate_score, got[k].archetype_id, got[k].enrichment_score) == (pytest.approx(r.candidate_score), r.archetype_id, r.enrichment_score)
    key = lambda r: (r.feature_type, r.feature_name)
    assert {key(r): r.p_value for r in spark.read.parquet(f"{run}/enrichment").collect()} == {key(r): r.p_value for r in whole["enrichment"].collect()}
    robust = spark.read.parquet(f"{run}/enrichment_robustness").collect()
    assert {r.deduplication_policy for r in robust} == {"none", "one_per_genus", "one_per_family"}
    assert {r.archetype_id for r in spark.read.parquet(f"{run}/archetypes").collect()} == {r.archetype_id for r in whole["archetypes"].collect()}


def test_benchmark_by_command(spark, given):
    folder, _, hits, *_ = given
    run = f"{folder}/out"
    (folder / "b.csv").write_text("benchmark_id,analyte,protein_name,uniprot_accession,organism,taxon_id,anchor_family,expected_regulator_class,expected_sensory_domains,sensing_evidence_class,pmid,notes,verify_pmid\nb1,CO,pd3,,d,1,,one_component,,direct,1|2,,yes\nb2,negative_control,nothing,,d,1,,none,,none,,,\nb3,CO,pd4,,d,1,,none,,indirect,,,\n")
    cli.main(["evaluate-benchmark", "--run", run, "--benchmark", str(folder / "b.csv"), "--hits", f"{folder}/hits"])
    got = {r.benchmark_id: r for r in spark.read.parquet(f"{run}/benchmark_recovery").collect()}
    assert [(got[k].hit, got[k]["rank"] is not None) for k in ("b1", "b2", "b3")] == [(False, True), (True, False), (True, False)]
    metrics = {r.metric: (r.value, r.n) for r in spark.read.parquet(f"{run}/benchmark_summary").collect()}
    assert metrics["positive_recall"] == (0.5, 2) and metrics["direct_recall"] == (0.0, 1) and metrics["verified_recall"] == (0.0, 1)
    assert stages and not discovery.genes_of(spark.read.parquet(f"{run}/genes"), spark.read.parquet(f"{run}/loci"), "CO").isEmpty()
