"""Hand-computed values, file formats and edge cases of the operators."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flankline import config, schemas
from flankline.functions import numerics as N
from flankline.functions import scalars as S
from flankline.operators import anchors, annotate, catalog, evaluate, lineage, neighborhoods, scoring, sequence, stats
from flankline.plans import discovery
from flankline.sources import files, store
from flankline.streaming import ingest

WEIGHTS = {"locus": 1.0, "regulator_domain": 1.5, "sensory_domain": 2.0, "proximity": 1.0, "archetype_conservation": 1.5, "enrichment": 2.0}
LOCUS_WEIGHTS = {"anchor_marker": 3.0, "accessory_marker": 1.0, "operon_integrity": 1.5, "homology_confidence": 1.0, "taxonomic_context": 0.5, "neighborhood_completeness": 0.5}
LADDER = {"high": 6.0, "medium": 3.5, "low": 1.5}
RULES = [
    {"family": "CooA_like", "class": "one_component", "pfam_required": ["PF00027", "PF00325"], "pfam_optional": []},
    {"family": "NorR", "class": "sigma54_activator", "pfam_required": ["PF00158"], "pfam_optional": ["PF02954"]},
    {"family": "hk", "class": "two_component_hk", "pfam_required": ["PF00512"], "pfam_optional": ["PF02518"]},
    {"family": "rr", "class": "two_component_rr", "pfam_required": ["PF00072"], "pfam_optional": []},
]
SENSORS = [
    {"domain": "PAS", "pfam_id": "PF00989", "role": "sensor", "chemistry": "none"},
    {"domain": "GAF", "pfam_id": "PF01590", "role": "sensor", "chemistry": "cnmp"},
    {"domain": "CooA_heme", "pfam_id": "PF00027", "role": "sensor", "chemistry": "none"},
]
PAIRED = [
    {"if_pfam_all": ["PF01590"], "if_co_pfam_any": [], "if_motif_any": ["CXXCH"], "if_organism_kingdom": "Bacteria", "chemistry": "heme"},
]
GENE = "locus_id string, gene_accession string, relative_index int, relative_start long, relative_stop long, strand string, product_description string, pfam_ids array<string>, pfam_descriptions array<string>, interpro_ids array<string>, interpro_descriptions array<string>, functional_class string, regulator_class string, sensory_domains array<string>, is_anchor boolean, is_regulator_candidate boolean"


def gene(spark, *rows):
    full = []
    for k, r in enumerate(rows):
        base = dict(locus_id="L", gene_accession=f"G{k}", relative_index=k - 1, relative_start=(k - 1) * 1000, relative_stop=(k - 1) * 1000 + 800, strand="+", product_description="", pfam_ids=[], pfam_descriptions=[], interpro_ids=[], interpro_descriptions=[], functional_class="unknown", regulator_class="none", sensory_domains=[], is_anchor=k == 1, is_regulator_candidate=False)
        full.append(tuple((base | r).values()))
    return spark.createDataFrame(full, GENE)


def locus(spark, **over):
    base = dict(locus_id="L", analyte="CO", organism="o", cluster_id=1, anchor_family="coxL", anchor_accession="A", marker_genes_present=["coxL"], accessory_genes_present=["a", "b"], operon_integrity_score=1.0, taxonomic_context_score=0.0, is_boundary_truncated=False, superkingdom="Bacteria") | over
    return spark.createDataFrame([tuple(base.values())], "locus_id string, analyte string, organism string, cluster_id int, anchor_family string, anchor_accession string, marker_genes_present array<string>, accessory_genes_present array<string>, operon_integrity_score double, taxonomic_context_score double, is_boundary_truncated boolean, superkingdom string")


def test_locus_and_candidate_scores(spark):
    loci = scoring.score_loci(locus(spark), LOCUS_WEIGHTS, LADDER)
    row = loci.first()
    assert row.locus_score == pytest.approx(3 + 2 + 1.5 + 1 + 0 + 0.5) and row.locus_confidence == "high"
    short = scoring.score_loci(locus(spark, is_boundary_truncated=True), LOCUS_WEIGHTS, LADDER).first()
    assert row.locus_score - short.locus_score == pytest.approx(0.5)
    genes = gene(spark, dict(relative_index=-2, regulator_class="one_component", pfam_ids=["PF00325"], is_regulator_candidate=True))
    c = scoring.score_candidates(loci, genes, WEIGHTS, SENSORS, PAIRED, {"CO": ["heme"]}).first()
    assert c.candidate_score == pytest.approx(8 + 1.5 + 1 / 3)
    band = stats.score_bands(spark.createDataFrame([(c.candidate_score,)], "candidate_score double"), "candidate_score").first()
    assert band.regulation_logit_score == pytest.approx(0.871766, abs=1e-6)
    assert band.score_band_low < band.regulation_logit_score < band.score_band_high


def test_weights(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        S.weighted_sum({"nothing": 1.0}, {}, [])
    assert df.select(S.weighted_sum({"nothing": 0.0}, {}, []).alias("x")).first().x == 0


def test_enrichment_is_capped(spark):
    rows = spark.createDataFrame([(float("inf"), 0.01), (4.0, 0.01), (4.0, 0.2), (0.5, 0.01)], "o double, q double")
    assert [r.x for r in rows.select(S.enrichment_score(F.col("o"), F.col("q"), 3.0).alias("x")).collect()] == [3.0, 2.0, 0.0, 0.0]


def test_motif_gate(spark):
    loci = scoring.score_loci(locus(spark), LOCUS_WEIGHTS, LADDER)
    for motif, want in (([], (0.25, "cnmp")), (["cxxch"], (1.0, "heme"))):
        genes = gene(spark, dict(regulator_class="one_component", pfam_ids=["PF01590"], pfam_descriptions=motif, is_regulator_candidate=True))
        c = scoring.score_candidates(loci, genes, WEIGHTS, SENSORS, PAIRED, {"CO": ["heme"]}).first()
        assert (c.sensory_domain_score, c.primary_sensory_chemistry) == want


def test_classes_and_roles(spark):
    genes = gene(
        spark,
        dict(gene_accession="cooA", pfam_ids=["PF00027", "PF00325"]),
        dict(gene_accession="anchor"),
        dict(gene_accession="fixL", pfam_ids=["PF00512", "PF00989"]),
        dict(gene_accession="fixJ", pfam_ids=["PF00072"]),
        dict(gene_accession="text", product_description="Transcriptional regulator", interpro_ids=["I"]),
        dict(gene_accession="bare", product_description="Transcriptional regulator"),
        dict(gene_accession="none"),
    )
    classes = annotate.classify_regulators(genes, RULES)
    kinds = {r.gene_accession: (r.regulator_class, r.functional_class) for r in classes.collect()}
    assert kinds["text"] == ("one_component", "regulator") and kinds["bare"] == ("none", "unknown") and kinds["anchor"][1] == "anchor"
    roles = annotate.assign_sensor_roles(classes, RULES, SENSORS, PAIRED)
    got = {r.gene_accession: r.sensor_role for r in roles.collect()}
    assert got == {"cooA": "both", "anchor": "anchor", "fixL": "sensor", "fixJ": "regulator", "text": "regulator", "bare": "accessory", "none": "none"}
    pair = annotate.sensor_regulator_pairs(roles, spark.createDataFrame([("L", "CO")], "locus_id string, analyte string"), SENSORS, PAIRED).collect()
    assert [(p.pair_id, p.intergenic_distance_nt, p.co_strand, p.hk_sensor_domains) for p in pair] == [("L::fixL::fixJ", 200, True, ["PAS"])]
    assert pair[0].pair_score == pytest.approx(1 / 201)


def test_operon_integrity(spark):
    rows = spark.createDataFrame([("L", "a", 0, 100, "+", False), ("L", "b", 150, 300, "+", True), ("L", "c", 900, 1000, "+", False)], "l string, g string, s long, e long, strand string, anchor boolean")
    o = neighborhoods.operons(rows, "l", "s", "e", "strand", "anchor", ["g"])
    assert [r.operon_id for r in o.orderBy("g").collect()] == ["L:operon_01", "L:operon_01", "L:operon_02"]
    assert neighborhoods.operon_integrity(o, "l").first()[1] == pytest.approx(2 / 3)


def test_architecture_distance(spark):
    rows = spark.createDataFrame([("-1:a>+1:b>0:x", "-1:a>+1:c>0:x"), ("-1:a>+9:b", "-1:a>+9:c"), ("", ""), ("+1:a>+1:b", "+1:b")], "a string, b string")
    d = [r.d for r in rows.select(scoring.architecture_distance(scoring.parsed_architecture(F.col("a")), scoring.parsed_architecture(F.col("b"))).alias("d")).collect()]
    assert d[0] == pytest.approx(0.5 / 2) and d[1] < d[0] and d[2] == 0 and d[3] == 0


def test_archetypes_merge(spark):
    rows = spark.createDataFrame([("-1:a>0:x",), ("-1:b>0:x",), ("-9:a>0:x",)], "architecture string")
    assert {r.archetype_no for r in scoring.archetype_ids(rows, "architecture").collect()} == {1, 2, 3}
    assert {r.archetype_no for r in scoring.archetype_ids(rows, "architecture", 1.0).collect()} == {1}


def test_fisher_and_bh(spark):
    r = stats.fisher(spark.createDataFrame([(3, 1, 1, 3), (2, 0, 0, 2), (0, 0, 1, 3)], "a long, b long, c long, d long")).collect()
    assert r[0].odds_ratio == pytest.approx(9.0) and r[0].p_value == pytest.approx(0.4857, abs=1e-4)
    assert math.isinf(r[1].odds_ratio) and (r[2].odds_ratio, r[2].p_value) == (0.0, 1.0)
    q = stats.benjamini_hochberg(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.9,)], "p_value double"))
    assert sorted(round(x.q_value, 6) for x in q.collect()) == [0.04, 0.053333, 0.053333, 0.9]


def test_stratified_test_sees_confounding(spark):
    # each stratum is balanced, the sum is not
    rows = [("f", "s1", 18, 2, 9, 1), ("f", "s2", 1, 9, 2, 18)]
    counts = spark.createDataFrame(rows, "feature string, stratum string, a long, b long, c long, d long")
    c = stats.cmh(counts, ["feature"]).first()
    assert c.odds_ratio == pytest.approx(1.0) and c.p_value > 0.05
    assert N.fisher_p(19, 11, 11, 19) < 0.1


def test_numerics():
    assert N.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    for a, b in ((0.5, 0.5), (2, 30), (20, 4)):
        for q in (0.03, 0.5, 0.97):
            assert N.incomplete_beta(a, b, N.beta_quantile(q, a, b)) == pytest.approx(q, abs=1e-9)
    assert N.gamma_tail(0.5, 3.841458820694124 / 2) == pytest.approx(0.05)
    assert N.gamma_tail(2, 1) == pytest.approx(2 / math.e)


def test_mutual_information(spark):
    rows = spark.createDataFrame([(5, 0, 0, 5), (3, 3, 3, 3), (5, 5, 0, 0)], "a long, b long, c long, d long")
    mi = [r.m for r in rows.select(stats.normalized_mutual_information(*(F.col(x) for x in "abcd")).alias("m")).collect()]
    assert mi == pytest.approx([1.0, 0.0, 0.0])


def test_chi_square(spark):
    rows = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 20), ("b", "y", 10)], "r string, c string, n long")
    got = stats.chi_square(rows, "r", "c", "n").first()
    assert got.statistic == pytest.approx(5.4) and got.dof == 1 and got.p_value == pytest.approx(0.02014, abs=1e-4)
    assert stats.chi_square(rows.where("r = 'a'"), "r", "c", "n").first().p_value == 1.0


def test_lineage(spark):
    nodes = spark.createDataFrame([(1, 1, "no rank", "root"), (2, 1, "phylum", "P"), (3, 2, "genus", "G"), (4, 3, "species", "S"), (9, 77, "genus", "lone")], "taxon_id long, parent_id long, rank string, name string")
    closure = lineage.ancestor_closure(nodes)
    assert sorted((r.ancestor, r.distance) for r in closure.where("node = 4").collect()) == [(1, 3), (2, 2), (3, 1), (4, 0)]
    pivot = lineage.lineage_pivot(closure, nodes.select(F.col("taxon_id").alias("ancestor"), "rank", "name"), lineage.RANKS)
    assert lineage.lookup_lineage(pivot, "node", 4)["phylum"] == "P" and lineage.lookup_lineage(pivot, "node", 5) == {}
    with pytest.raises(ValueError):
        lineage.ancestor_closure(spark.createDataFrame([(1, 2), (2, 1)], "taxon_id long, parent_id long"))


def test_files(spark, tmp_path):
    (tmp_path / "a.faa").write_text(">p1 first protein\nMK\nLV\n>p2 second > one\nAAAA*\n")
    fasta = files.read_fasta(spark, str(tmp_path / "a.faa"))
    assert sorted(map(tuple, fasta.collect())) == [("p1", "p1 first protein", "MKLV"), ("p2", "p2 second > one", "AAAA*")]
    (tmp_path / "bad.faa").write_text(">p1\nMK\n>p2\n")
    with pytest.raises(PySparkException):
        files.read_fasta(spark, str(tmp_path / "bad.faa")).collect()
    files.write_fasta(fasta, str(tmp_path / "out"), "accession", "sequence", 2)
    assert sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "out")).select("accession", "sequence").collect())) == [("p1", "MKLV"), ("p2", "AAAA")]
    (tmp_path / "a.gff").write_text("##gff-version 3\n#c\nctg\tx\tCDS\t1\t90\t.\t+\t0\tID=f1;locus_tag=L%201;protein_id=p1;Note=a+b;Note=c\n")
    gff = files.read_gff3(spark, str(tmp_path / "a.gff"))
    row = gff.first()
    assert (row.start, row.score, row.phase, row.attributes["Note"], row.attributes["locus_tag"]) == (1, None, 0, "c", "L 1")
    f = files.features_of(gff).first()
    assert (f.feature_id, f.protein_accession, f.gene, f.product) == ("f1", "p1", None, None)
    (tmp_path / "b.gff").write_text("ctg\n")
    with pytest.raises(ValueError):
        files.read_gff3(spark, str(tmp_path / "b.gff"))
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tphylum\t|\n")
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tP\t|\t\t|\tscientific name\t|\n2\t|\tQ\t|\t\t|\tsynonym\t|\n")
    assert sorted(map(tuple, files.read_taxdump(spark, str(tmp_path / "nodes.dmp"), str(tmp_path / "names.dmp")).collect())) == [(1, 1, "no rank", "root"), (2, 1, "phylum", "P")]
    (tmp_path / "c.tsv").write_text("r\tr\nr\tm\n")
    assert {(r.sequence_id, r.is_representative) for r in files.read_clusters(spark, str(tmp_path / "c.tsv")).collect()} == {("r", True), ("m", False)}
    (tmp_path / "b.csv").write_text("id,tags,flag\nx,a| b |,yes\ny,[],\n")
    assert [tuple(r) for r in files.read_benchmark(spark, str(tmp_path / "b.csv"), ["tags"], ["flag"]).orderBy("id").collect()] == [("x", ["a", "b"], True), ("y", [], False)]
    for k, text in enumerate(('{"predicted_aligned_error": [[0, 1.5], [2, 0]]}', '[{"predicted_aligned_error": [[0, 1.5], [2, 0]]}]', "[[0, 1.5], [2, 0]]")):
        (tmp_path / f"{k}.json").write_text(text)
        assert {(r.i, r.j, r.pae) for r in files.read_pae(spark, str(tmp_path / f"{k}.json")).collect()} == {(1, 1, 0.0), (1, 2, 1.5), (2, 1, 2.0), (2, 2, 0.0)}
    (tmp_path / "x.pdb").write_text("ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00 90.50           N\nATOM      2  CA  ALA A   1      11.639   6.071  -5.147  1.00 80.50           C\n")
    assert [(r.chain, r.residue_number, r.residue, r.plddt) for r in files.read_plddt(spark, str(tmp_path / "x.pdb")).collect()] == [("A", 1, "ALA", 90.5)]


def test_sqlite(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE genes (id INTEGER, name TEXT, lists TEXT)")
        db.executemany("INSERT INTO genes VALUES (?, ?, ?)", [(k, f"g{k}", '["a","b"]' if k else None) for k in range(10)])
    rows = files.read_sqlite(spark, str(tmp_path / "x.db"), "genes", "id long, name string, lists string", ["id", "name", "lists"], 3)
    got = rows.select("id", "name", files.json_list("lists").alias("l")).orderBy("id").collect()
    assert len(got) == 10 and got[0].l == [] and got[9].l == ["a", "b"]
    with pytest.raises(ValueError):
        files.read_sqlite(spark, str(tmp_path / "x.db"), "genes", "no long", ["no"])


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([("p1", "x"), ("p2", "y")], "protein_accession string, sequence string")
    store.write_partitions(store.with_dataset(rows, "d1", {"phylum": "P"}), root, "proteins")
    store.write_partitions(store.with_dataset(rows, "d2", {"phylum": ""}), root, "proteins")
    store.write_partitions(store.with_dataset(rows.limit(1), "d1", {"phylum": "P"}), root, "proteins")
    got = store.read(spark, root, "proteins").groupBy("phylum", "dataset_name").count()
    assert {tuple(r) for r in got.collect()} == {("P", "d1", 1), ("unknown", "d2", 2)}
    store.upsert_datasets(spark, spark.createDataFrame([("d1", 1), ("d2", 2)], "dataset_name string, n int"), root)
    store.upsert_datasets(spark, spark.createDataFrame([("d1", "new")], "dataset_name string, note string"), root)
    assert {tuple(r) for r in store.read_datasets(spark, root).select("dataset_name", "n", "note").collect()} == {("d1", None, "new"), ("d2", 2, None)}
    store.write_partitions(store.with_dataset(rows, "d1", {"phylum": "P"}), root, "features")
    store.register_views(spark, root)
    assert spark.sql("SELECT count(*) FROM proteins WHERE dataset_name = 'd2'").first()[0] == 2


def test_stream_ingest(spark, tmp_path):
    source = str(tmp_path / "in")
    store.with_dataset(spark.createDataFrame([("p1",)], "protein_accession string"), "d1", {"phylum": "P"}).write.parquet(source)
    schema = "protein_accession string, dataset_name string, phylum string"
    for _ in range(2):
        ingest.ingest(spark, source, schema, str(tmp_path / "store"), "proteins", str(tmp_path / "check")).awaitTermination()
    assert store.read(spark, str(tmp_path / "store"), "proteins").count() == 1


def test_sequences(spark):
    rows = spark.createDataFrame([(1, "TTGTCAACGT"), (2, "acgt"), (3, None)], "id int, s string")
    got = {(r.id, r.strand, r.start, r.end, r.site) for r in sequence.iupac_scan(rows, ["id"], "s", "AC-GT").collect()}
    assert (1, "+", 7, 10, "ACGT") in got and (1, "-", 1, 4, "ACGT") in got and (2, "+", 1, 4, "ACGT") in got
    with pytest.raises(ValueError):
        sequence.iupac_table("TTGTCA-N6")
    assert sequence.align("ACGT", "AGT") == [(1, 1, 1), (3, 3, 2), (4, 4, 3)]
    msa = spark.createDataFrame([("AC-",), ("AG-",), ("A-T",)], "a string")
    assert [(r.column, r.residue, r.n_residue) for r in sequence.column_conservation(msa, "a").orderBy("column").collect()] == [(1, "A", 3), (2, "C", 1), (3, "T", 1)]
    pair = spark.createDataFrame([("MKLV*", "MKIV"), ("", "M")], "a string, b string")
    assert [tuple(r) for r in pair.select(S.position_identity(F.col("a"), F.col("b")), S.length_coverage(F.col("a"), F.col("b"))).collect()] == [(0.75, 1.0), (0.0, 0.0)]


def test_back_confirmation(spark):
    seeds = spark.createDataFrame([("coxL", "MKLVMKLVMK", 0), ("cooS", "MKLVMKLVAA", 1)], "seed_family string, seed string, no int")
    hits = spark.createDataFrame([(1, "coxL", "MKLVMKLVMK"), (2, "coxL", "MKLVMKLVAA")], "id int, family string, q string")
    got = anchors.back_confirmed(hits, seeds, ["id"], "q", "seed", "family", "seed_family", "no", 0.95, 0.95)
    assert [(r.id, r.best_family, r.evidence_type) for r in got.orderBy("id").collect()] == [(1, "coxL", "seed_back_confirmed"), (2, "cooS", "profile_match")]


def test_metrics_without_positives(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0)], "y int, s double")
    assert evaluate.auroc(rows, "y", "s").first().auroc is None
    got = evaluate.summary(rows, F.col("y") == 1, F.col("s") > 1, F.lit(None).cast("int")).first()
    assert got.positive_recall is None and got.negative_fpr == 0.5 and got.top_1_recall is None


def test_validation(spark):
    genes = gene(spark, {}, {}).withColumn("functional_class", F.lit("unknown"))
    assert schemas.validate(genes, "genes") is genes
    for broken in (genes.drop("strand"), genes.withColumn("more", F.lit(1)), genes.withColumn("relative_index", F.lit(0)), genes.withColumn("strand", F.lit("?")), genes.withColumn("relative_start", F.lit("x"))):
        with pytest.raises(schemas.SchemaError):
            schemas.validate(broken, "genes")


def test_config(tmp_path):
    (tmp_path / "analytes").mkdir()
    (tmp_path / "analytes/co.yaml").write_text("analyte: CO\nexpected_sensory_chemistry: [heme]\n")
    (tmp_path / "scoring.yaml").write_text("confidence_thresholds: {high: 6}\n")
    (tmp_path / "regulator_families.yaml").write_text("regulator_families: [{family: a, class: sigma, pfam_required: [PF1]}]\n")
    (tmp_path / "sensory_domains.yaml").write_text("sensory_domains: [{domain: d, pfam_id: p, role: sensor, chemistry: none}]\npaired_evidence: [{if_pfam_all: [p], rescore: {chemistry: heme}}]\n")
    got = config.load(str(tmp_path))
    assert got["paired_evidence"][0]["chemistry"] == "heme"
    config.dump(got, str(tmp_path / "resolved.yaml"))
    assert config.manifest(got, {})["run_hash"] == config.manifest(got, {})["run_hash"]
    (tmp_path / "head.yaml").write_text("analytes: [analytes/co.yaml]\nscoring: scoring.yaml\n")
    assert config.load(str(tmp_path / "head.yaml"))["scoring"] == got["scoring"]
    (tmp_path / "scoring.yaml").write_text("other: 1\n")
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path))


def test_discovery(spark):
    features = [("d", "c1", "CDS", k * 1000, k * 1000 + 900, "+", f"p{k}", f"L{k}", None, "Transcriptional regulator" if k == 3 else "protein") for k in range(9)]
    f = spark.createDataFrame(features, "dataset_name string, seqid string, feature_type string, start_nt long, end_nt long, strand string, protein_accession string, locus_tag string, gene string, product string")
    hits = spark.createDataFrame([("CO", "d", "coxL", "p4", "L4", ""), ("CN", "d", "nit1", "", "L7", "")], "analyte string, dataset_name string, anchor_family string, protein_accession string, locus_tag string, gene string")
    domains = spark.createDataFrame([("p3", 1, "PF00325", "d", None, None), ("p3", 2, "PF00027", "e", None, None)], "gene_accession string, position int, pfam_id string, pfam_description string, interpro_id string, interpro_description string")
    taxonomy = spark.createDataFrame([("d", "Bacteria")], "organism string, superkingdom string")
    known = spark.createDataFrame([("CO", "d")], "analyte string, organism string")
    settings = {"analytes": [{"analyte": "CO"}], "scoring": {"locus_score_weights": LOCUS_WEIGHTS, "candidate_score_weights": WEIGHTS, "confidence_thresholds": LADDER}, "regulator_families": RULES, "sensory_domains": SENSORS, "paired_evidence": PAIRED}
    out = discovery.discover(f, hits, domains, taxonomy, known, settings, "CO", "CN", 2)
    loci = {r.analyte: r for r in out["loci"].collect()}
    assert loci["CO"].window_size == 5 and not loci["CO"].is_boundary_truncated
    assert loci["CN"].window_size == 4 and loci["CN"].is_boundary_truncated
    assert (loci["CO"].taxonomic_context_score, loci["CN"].taxonomic_context_score) == (1.0, 0.0)
    best = out["candidates"].collect()
    assert [(c.gene_accession, c.relative_index, c.position) for c in best] == [("p3", -1, "upstream")]
    assert out["enrichment"].count() == 1
    with pytest.raises(ValueError):
        discovery.extract(f, hits.withColumn("locus_tag", F.lit("none")).withColumn("protein_accession", F.lit("none")))


def test_shards_and_scan(spark):
    d = spark.createDataFrame([(f"d{k}", "P" if k < 3 else "") for k in range(5)], "dataset_name string, phylum string")
    by = {r.shard_id: r.dataset_names for r in catalog.shards(d, "dataset_name", "phylum").collect()}
    assert by == {"phylum-0000-p": ["d0", "d1", "d2"], "phylum-0001-unknown": ["d3", "d4"]}
    assert [(r.shard_no, r.n_datasets, r.group) for r in catalog.shards(d, "dataset_name", "phylum", "count", 2).orderBy("shard_no").collect()] == [(0, 2, "P"), (1, 2, "mixed"), (2, 1, "unknown")]
    assert catalog.shards(d, "dataset_name", "phylum", "count", 2, most=1).count() == 1
    guarded = spark.createDataFrame([("coxL gene", True), ("cooS", False)], "p string, want boolean").select(anchors.guard(["p"], F.lit("coxL"), {"coxL": ["coxl", "carbon monoxide"]}).alias("g"), "want")
    assert all(r.g == r.want for r in guarded.collect())


def test_efi(spark, tmp_path):
    import sqlite3

    from flankline.sources import efi

    with sqlite3.connect(tmp_path / "e.db") as db:
        for name, schema in (("neighborhoods", efi.NEIGHBORHOODS), ("genes", efi.GENES)):
            db.execute(f"CREATE TABLE {name} ({', '.join(c.split()[0] for c in schema.split(', '))})")
        db.executemany("INSERT INTO neighborhoods VALUES (?,?,?,?,?,?,?,?,?,?,?)", [(f"k{c}", c, f"A{c}", "coxL", "o", 7, "ctg", 2, 0, '["coxL"]', None) for c in (1, 2)])
        for c in (1, 2):
            db.executemany("INSERT INTO genes VALUES (?,?,?,?,?,?,?,?,?,?,?,?,?,?,?)", [(f"k{c}", g, o, s, s + 100, "+", "p", '["PF1"]', None, None, None, "unknown", "none", None, 0) for g, o, s in ((f"R{c}", 3, 10), (f"A{c}", 4, 200))])
    loci, genes = efi.read_efi(spark, str(tmp_path / "e.db"), ["CO", "CN"], [1])
    assert {r.locus_id: r.operon_integrity_score for r in loci.collect()} == {"CO_1_A1": 1.0, "CN_1_A1": 1.0}
    assert {(r.locus_id, r.relative_index, r.relative_start) for r in genes.collect()} == {(f"{a}_1_A1", i, s) for a in ("CO", "CN") for i, s in ((-1, -190), (0, 0))}
    assert efi.read_efi(spark, str(tmp_path / "e.db"), ["CO"], [])[0].count() == 0
    assert efi.read_efi(spark, str(tmp_path / "e.db"), ["CO"])[0].count() == 2


def test_reports_and_generators(spark):
    from flankline.operators import reports
    from flankline.sources import generate

    loci, genes, truth = generate.synthetic_truth(spark, 40, 8)
    assert truth.join(genes.where("is_regulator_candidate"), ["locus_id", "gene_accession"]).count() == 8 == genes.where("is_regulator_candidate").count()
    features = generate.scaling_features(spark)
    hits = features.where("gene IS NOT NULL").select(F.when(F.col("gene") == "coxL", "CO").otherwise("CN").alias("analyte"), "dataset_name", F.col("gene").alias("anchor_family"), "protein_accession", "locus_tag", "gene")
    found, around = discovery.extract(features, hits, 4)
    assert 12 <= found.count() <= 32 and 80 <= around.count() <= 320
    shown = reports.display_architectures(
        spark.createDataFrame([("L", "coxL")], "locus_id string, anchor_family string"),
        gene(spark, dict(is_regulator_candidate=True, regulator_class="one_component", sensory_domains=["PAS", "GAF"]), {}, dict(functional_class=" ")),
    ).first()
    assert shown.architecture_string == "[-1:one_component:PAS-GAF][0:coxL][+1:unknown]"
    seeds = spark.createDataFrame([("a", "x coxS", "S"), ("b", "y GN=coxL z", "L")], "accession string, description string, sequence string").coalesce(1)
    assert [reports.seed_for_family(seeds, f) for f in ("coxL", "coxs", "none")] == ["L", "S", "S"]
    rec = spark.createDataFrame([("CO", True, False), ("CO", False, False), ("CO", True, True)], "analyte string, hit boolean, is_negative_control boolean")
    arch = spark.createDataFrame([("CO", f"arch_{k}", 10 - k) for k in range(8)], "analyte string, archetype_id string, n_loci int")
    text = reports.captions(scoring.score_loci(locus(spark), LOCUS_WEIGHTS, LADDER), arch, rec, ["CO"])
    assert text["recovery"] == "1 of 2 benchmark rows are recovered (50.0%)." and "86.5%" in text["archetypes"] and text["loci"].startswith("CO: 1 loci")


def test_command_line_from_manifest_to_neighbourhoods(spark, tmp_path, capsys):
    from flankline import cli, config

    for d in ("d1", "d2"):
        (tmp_path / f"{d}.faa").write_text("".join(f">{d}p{i} protein\nMKV\n" for i in range(5)))
        rows = [f"{d}c\tx\tCDS\t{100 * i + 1}\t{100 * i + 90}\t.\t+\t0\tID=f{i};locus_tag={d}t{i};protein_id={d}p{i};gene={'coxL' if i == 2 else f'g{i}'}" for i in range(5)]
        (tmp_path / f"{d}.gff").write_text("##gff-version 3\n" + "\n".join(rows) + "\n")
    (tmp_path / "m.yaml").write_text("catalogs:\n" + "".join(f"  - {{dataset_name: {d}, protein_faa: {d}.faa, gff: {d}.gff, taxonomy: {{phylum: P{d}}}}}\n" for d in ("d1", "d2")))
    (tmp_path / "t.yaml").write_text("targets:\n  - analyte: CO\n    terms: [coxL, nothing]\n")
    (tmp_path / "bad.yaml").write_text("targets:\n  - analyte: CO\n")
    assert config.scan_targets(str(tmp_path / "t.yaml")) == [("CO", "coxL"), ("CO", "nothing")]
    with pytest.raises(config.ConfigError):
        config.scan_targets(str(tmp_path / "bad.yaml"))
    with pytest.raises(config.ConfigError):
        config.catalog_manifest(str(tmp_path / "t.yaml"))
    root, hits, out = (str(tmp_path / x) for x in ("store", "hits", "out"))
    assert cli.main(["index-manifest", "--manifest", str(tmp_path / "m.yaml"), "--root", root]) == 0
    assert cli.main(["summary", "--root", root]) == 0 and "d2" in capsys.readouterr().out
    assert cli.main(["scan", "--root", root, "--targets", str(tmp_path / "t.yaml"), "--out", hits]) == 0
    assert {(r.dataset_name, r.locus_tag, r.anchor_family) for r in spark.read.parquet(hits).collect()} == {("d1", "d1t2", "coxL"), ("d2", "d2t2", "coxL")}
    assert cli.main(["extract", "--root", root, "--hits", hits, "--out", out, "--window", "1"]) == 0
    genes = spark.read.parquet(f"{out}/genes")
    assert sorted(r.relative_index for r in genes.collect()) == [-1, -1, 0, 0, 1, 1]
    assert cli.main(["simulate", "--out", str(tmp_path / "sim"), "--genomes", "6", "--positives", "2"]) == 0
    assert spark.read.parquet(str(tmp_path / "sim/truth")).count() == 2
    assert cli.main(["validate-config", "--config", str(tmp_path / "none.yaml")]) == 1


def test_captions_of_enrichment_ranking_and_structures(spark, tmp_path):
    from flankline import cli
    from flankline.operators import reports

    tested = spark.createDataFrame([("sensory_domain", "PAS", 3.25, 0.01, 0.02), ("sensory_domain", "GAF", None, 0.01, 0.02)], "feature_type string, feature_name string, odds_ratio double, p_value double, q_value double")
    assert "GAF (odds ratio not scored, q 0.02)" in reports.enrichment_caption(tested)
    assert reports.enrichment_caption(tested.where("false")) == "No feature was tested for enrichment."
    rows = spark.createDataFrame([("b", "o2", 0.9, 0.5), ("a", "o1", 0.9, None), ("c", "o3", None, 0.7)], "candidate_id string, organism string, regulation_logit_score double, structural_plausibility_score double")
    assert reports.ranking_caption(rows) == "2 candidates score high; the first is a of o1 (0.9)."
    assert reports.ranking_caption(rows.where("false")) == "There are no candidates."
    assert reports.structure_caption(rows) == "2 candidates have a structure score; the best is c (0.7)."
    assert reports.structure_caption(rows.drop("structural_plausibility_score")) == "No candidate has a structure score."
    made = {
        "loci": scoring.score_loci(locus(spark), LOCUS_WEIGHTS, LADDER),
        "archetypes": spark.createDataFrame([("CO_arch_0001", "CO", "locus_neighborhood", "[0:coxL]", 1, 1, "none")], "archetype_id string, analyte string, architecture_scope string, architecture_string string, n_loci long, n_taxa long, dominant_regulator_class string"),
        "enrichment": tested,
        "candidates": rows.withColumns({"analyte": F.lit("CO"), "candidate_score": F.col("regulation_logit_score")}),
    }
    discovery.write(made, str(tmp_path / "run"))
    assert cli.main(["report", "--run", str(tmp_path / "run"), "--out", str(tmp_path / "out")]) == 0
    shown = spark.read.csv(str(tmp_path / "out" / "captions"), header=True)
    assert {r.figure for r in shown.collect()} == {"archetypes", "enrichment", "loci", "ranking", "structures"}
    assert spark.read.csv(str(tmp_path / "out" / "top30_CO"), header=True).count() == 3
    assert spark.read.csv(str(tmp_path / "out" / "T5_archetype_catalog"), header=True).count() == 1
