"""Command line: index files into the store, search and scan it, extract neighbourhoods, check configurations."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flankline import config
from flankline.operators import anchors, catalog, evaluate, lineage, reports
from flankline.plans import discovery, stages
from flankline.session import local_session
from flankline.sources import files, generate, store

SEARCHED = ["protein_accession", "locus_tag", "gene", "product", "feature_id"]


def index_all(spark: SparkSession, entries: Sequence[dict], root: str) -> None:
    """All datasets of a manifest into the store: one write for proteins, one for features."""

    def together(read) -> DataFrame:
        tables = [store.with_dataset(read(e), e["dataset_name"], {"phylum": ""} | e["taxonomy"]) for e in entries]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

    store.write_partitions(together(lambda e: files.proteins_of(files.read_fasta(spark, e["protein_faa"]))), root, "proteins")
    store.write_partitions(together(lambda e: files.features_of(files.read_gff3(spark, e["gff"]))), root, "features")
    rows = [(e["dataset_name"], str(e["taxonomy"].get("phylum") or "")) for e in entries]
    store.upsert_datasets(spark, spark.createDataFrame(rows, "dataset_name string, phylum string"), root)


def scan(spark: SparkSession, root: str, targets: str) -> DataFrame:
    """Anchor hits of a term scan over the whole store."""
    terms = spark.createDataFrame(config.scan_targets(targets), "analyte string, term string")
    keys = ["dataset_name", "analyte", "term", "protein_accession", "locus_tag"]
    found = catalog.term_scan(store.read(spark, root, "features"), terms, SEARCHED[:4], "protein_accession", keys)
    return catalog.anchor_hits_of_scan(found, "dataset_name", "protein_accession", "locus_tag", "gene", "product")


def report(spark: SparkSession, run: str, out: str) -> None:
    """Tables of the top candidates of each analyte, of enrichment and archetypes, and the captions, from a run's folder."""
    loci, archetypes, enrichment, candidates = (spark.read.parquet(f"{run}/{t}") for t in ("loci", "archetypes", "enrichment", "candidates"))
    analytes = sorted(r.analyte for r in loci.select("analyte").distinct().collect())  # the configured ones, a handful
    for analyte in analytes:
        reports.write_csv(reports.table(reports.top_candidates(candidates, analyte), "T2_top30_co_candidates"), f"{out}/top30_{analyte}")
    reports.write_csv(reports.table(enrichment, "T4_regulator_family_enrichment"), f"{out}/T4_regulator_family_enrichment")
    reports.write_csv(reports.table(archetypes, "T5_archetype_catalog"), f"{out}/T5_archetype_catalog")
    none = spark.createDataFrame([], "analyte string, hit boolean")
    for name, rows in reports.figure_data(none, loci, archetypes, enrichment, candidates).items():
        if name != "figure_1_workflow_and_recovery":  # a run need not have a benchmark
            reports.write_csv(rows, f"{out}/{name}")
    texts = reports.captions(loci, archetypes, spark.createDataFrame([], "analyte string, hit boolean"), analytes, enrichment, candidates)
    texts = {figure: text for figure, text in texts.items() if figure != "recovery"}  # a run need not have a benchmark
    reports.write_captions(texts, spark, f"{out}/captions")


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="flankline")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="FASTA and GFF3 of one dataset into the store")
    for name in ("fasta", "gff", "dataset", "phylum", "root"):
        index.add_argument(f"--{name}", required=True)
    search = commands.add_parser("search", help="text search in the store's features")
    for name in ("root", "query"):
        search.add_argument(f"--{name}", required=True)
    search.add_argument("--limit", type=int, default=20)
    search.add_argument("--per-dataset", action="store_true")
    shards = commands.add_parser("shards", help="enumerate shards of the store's datasets")
    shards.add_argument("--root", required=True)
    shards.add_argument("--size", type=int)
    taxonomy = commands.add_parser("taxonomy", help="lineages from taxonomy dumps")
    for name in ("nodes", "names", "out"):
        taxonomy.add_argument(f"--{name}", required=True)
    manifest = commands.add_parser("index-manifest", help="all datasets of a manifest into the store")
    for name in ("manifest", "root"):
        manifest.add_argument(f"--{name}", required=True)
    scanned = commands.add_parser("scan", help="term scan over the store; writes anchor hits")
    for name in ("root", "targets", "out"):
        scanned.add_argument(f"--{name}", required=True)
    extract = commands.add_parser("extract", help="loci and genes around anchor hits")
    for name in ("root", "hits", "out"):
        extract.add_argument(f"--{name}", required=True)
    extract.add_argument("--window", type=int, default=10)
    discover = commands.add_parser("discover", help="the whole run: loci, genes, enrichment, archetypes, candidates")
    for name in ("root", "hits", "domains", "taxonomy", "known", "config", "case", "control", "out"):
        discover.add_argument(f"--{name}", required=True)
    discover.add_argument("--benchmark")
    discover.add_argument("--window", type=int, default=10)
    tables = commands.add_parser("report", help="report tables and captions of a run's folder")
    for name in ("run", "out"):
        tables.add_argument(f"--{name}", required=True)
    for name, more, text in (
        ("annotate", ("domains",), "genes of a run with their domains"),
        ("assign-roles", ("config",), "classes and roles of a run's genes; sensor-regulator pairs"),
        ("score", ("config",), "scores of a run's loci; its candidates"),
        ("enrich", ("case", "control"), "enrichment of one analyte against another, and its robustness"),
        ("archetypes", ("config",), "archetypes of a run; its candidates' final scores"),
        ("evaluate-benchmark", ("benchmark", "hits"), "recovery of curated rows and its metrics"),
    ):
        stage = commands.add_parser(name, help=text)
        for option in ("run", *more):
            stage.add_argument(f"--{option}", required=True)
        if name == "score":
            stage.add_argument("--known")
            stage.add_argument("--taxonomy")
            stage.add_argument("--with-enrichment", action="store_true")
    detect = commands.add_parser("detect-anchors", help="anchor hits of a term scan (smoke), or of a table of profile hits with metadata (profile)")
    for name in ("mode", "out"):
        detect.add_argument(f"--{name}", required=True)
    for name in ("root", "targets", "hits", "metadata"):
        detect.add_argument(f"--{name}")
    detect.add_argument("--evalue", type=float, default=1e-5)
    commands.add_parser("summary", help="counts for each dataset of the store").add_argument("--root", required=True)
    commands.add_parser("validate-config", help="read a configuration and name its faults").add_argument("--config", required=True)
    simulate = commands.add_parser("simulate", help="loci, genes and truth with planted regulators")
    simulate.add_argument("--out", required=True)
    simulate.add_argument("--genomes", type=int, default=40)
    simulate.add_argument("--positives", type=int, default=8)
    simulate.add_argument("--noise", type=float, default=0.0)
    args = parser.parse_args(argv)
    if args.command == "validate-config":
        try:
            print(", ".join(f"{k}: {len(v)}" for k, v in config.load(args.config).items()))
        except config.ConfigError as e:
            print(f"invalid: {e}")
            return 1
        return 0
    spark = local_session()
    if args.command == "index":
        tags = {"phylum": args.phylum}
        proteins = store.with_dataset(files.proteins_of(files.read_fasta(spark, args.fasta)), args.dataset, tags)
        features = store.with_dataset(files.features_of(files.read_gff3(spark, args.gff)), args.dataset, tags)
        store.write_partitions(proteins, args.root, "proteins")
        store.write_partitions(features, args.root, "features")
        store.upsert_datasets(spark, spark.createDataFrame([(args.dataset, args.phylum)], "dataset_name string, phylum string"), args.root)
    elif args.command == "search":
        rows = store.read(spark, args.root, "features")
        found = catalog.search(rows, args.query, SEARCHED, [F.asc_nulls_last("protein_accession"), F.asc_nulls_last("start_nt")], args.limit, "dataset_name" if args.per_dataset else None)
        print(evaluate.markdown(found))
    elif args.command == "shards":
        rows = store.read_datasets(spark, args.root)
        print(evaluate.markdown(catalog.shards(rows, "dataset_name", "phylum", "count" if args.size else "group", args.size or 1000)))
    elif args.command == "index-manifest":
        index_all(spark, config.catalog_manifest(args.manifest), args.root)
    elif args.command == "scan":
        scan(spark, args.root, args.targets).write.mode("overwrite").parquet(args.out)
    elif args.command == "extract":
        loci, genes = discovery.extract(store.read(spark, args.root, "features"), spark.read.parquet(args.hits), args.window)
        discovery.write({"loci": loci, "genes": genes}, args.out)
    elif args.command == "discover":
        domains, taxonomy, known = (spark.read.parquet(p) for p in (args.domains, args.taxonomy, args.known))
        benchmark = spark.read.parquet(args.benchmark) if args.benchmark else None
        run = discovery.discover(store.read(spark, args.root, "features"), spark.read.parquet(args.hits), domains, taxonomy, known, config.load(args.config), args.case, args.control, args.window, benchmark)
        discovery.write(run, args.out)
    elif args.command == "annotate":
        stages.annotate_genes(spark, args.run, spark.read.parquet(args.domains))
    elif args.command == "assign-roles":
        stages.assign_roles(spark, args.run, config.load(args.config))
    elif args.command == "score":
        known, taxonomy = (spark.read.parquet(p) if p else None for p in (args.known, args.taxonomy))
        stages.score(spark, args.run, config.load(args.config), known, taxonomy, args.with_enrichment)
    elif args.command == "enrich":
        stages.enrich(spark, args.run, args.case, args.control)
    elif args.command == "archetypes":
        stages.archetypes(spark, args.run, config.load(args.config))
    elif args.command == "evaluate-benchmark":
        rows = files.read_benchmark(spark, args.benchmark, ["expected_sensory_domains", "pmid"], ["verify_pmid"])
        stages.evaluate_benchmark(spark, args.run, rows, spark.read.parquet(args.hits))
    elif args.command == "detect-anchors":
        order = [F.desc("bitscore"), F.col("e_value"), F.col("query_id")]
        runs = {"smoke": lambda: scan(spark, args.root, args.targets), "profile": lambda: anchors.rescued(spark.read.parquet(args.hits), spark.read.parquet(args.metadata), order, args.evalue)}
        anchors.detect(args.mode, **runs).write.mode("overwrite").parquet(args.out)
    elif args.command == "report":
        report(spark, args.run, args.out)
    elif args.command == "summary":
        features, proteins = (store.read(spark, args.root, t) for t in ("features", "proteins"))
        print(evaluate.markdown(catalog.summary(features, proteins, "dataset_name", "feature_type", "CDS", "protein_accession", "length_aa")))
    elif args.command == "simulate":
        tables = dict(zip(("loci", "genes", "truth"), generate.synthetic_truth(spark, args.genomes, args.positives, args.noise), strict=True))
        discovery.write(tables, args.out)
    else:
        nodes = files.read_taxdump(spark, args.nodes, args.names)
        names = nodes.select(F.col("taxon_id").alias("ancestor"), "rank", "name")
        lineage.lineage_pivot(lineage.ancestor_closure(nodes), names, lineage.RANKS).write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
