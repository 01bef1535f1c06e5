"""Further queries over the driver's tables, each beside its SQL: metadata joins, shards, archetypes of candidates, benchmark
recovery, ordinals, lineage stand-ins, robustness of enrichment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flankline.operators import anchors, annotate, catalog, evaluate, lineage, reports, scoring, stats
from flankline.plans import surrogate as base
from flankline.plans.surrogate import r6, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


# ---------------------------------------------------------------- hits and their metadata

METADATA = "md AS (SELECT 's' || (s_suppkey % 40) AS acc, 'd' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS dataset_name, s_name AS product, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'g' || s_nationkey END AS gene FROM supplier)"


def metadata(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(
        F.format_string("s%d", F.col("s_suppkey") % 40).alias("protein_accession"),
        F.concat(F.lit("d"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("dataset_name"),
        F.col("s_name").alias("product"),
        F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.format_string("g%d", "s_nationkey")).alias("gene"),
    )


@query(f"WITH {METADATA} SELECT o_orderkey, 's' || (o_custkey % 60) AS protein_accession, dataset_name, product FROM orders LEFT JOIN md ON acc = 's' || (o_custkey % 60)")
def hit_metadata(spark, sf_dir):
    hits = read(spark, sf_dir, "orders").select("o_orderkey", F.format_string("s%d", F.col("o_custkey") % 60).alias("target_id"))
    return anchors.hits_with_metadata(hits, metadata(spark, sf_dir)).select("o_orderkey", "protein_accession", "dataset_name", "product")


HITS = "h AS (SELECT l_orderkey, 's' || (l_suppkey % 50) AS target, l_discount, l_extendedprice, l_quantity, l_linenumber, l_partkey, l_suppkey FROM lineitem)"
BEST = f"""{HITS}, b AS (SELECT * FROM h WHERE l_discount <= 0.05 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_discount, l_quantity DESC, l_linenumber, l_partkey, l_suppkey) = 1),
{METADATA}, one AS (SELECT * FROM md QUALIFY row_number() OVER (PARTITION BY acc ORDER BY dataset_name) = 1)"""


def hits(spark, sf_dir):
    order = [F.desc("l_extendedprice"), F.col("e_value"), F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.format_string("s%d", F.col("l_suppkey") % 50).alias("target_id"), F.col("l_discount").alias("e_value"), "l_extendedprice", "l_quantity", "l_linenumber", "l_partkey", "l_suppkey")
    return rows, order


@query(f"WITH {BEST} SELECT l_orderkey AS query_id, target AS protein_accession, dataset_name FROM b JOIN one ON acc = target")
def best_hit_metadata(spark, sf_dir):
    rows, order = hits(spark, sf_dir)
    best = anchors.best_hits(anchors.passing(rows, "e_value", 0.05), "query_id", order)
    return anchors.best_hits_with_metadata(best, metadata(spark, sf_dir)).select("query_id", "protein_accession", "dataset_name")


@query(f"""WITH {BEST}, f AS (SELECT *, 'CO' AS analyte, CASE WHEN l_orderkey % 2 = 0 THEN 'cox' ELSE 'supplier#0000000' END AS family FROM b JOIN one ON acc = target),
g AS (SELECT * FROM f WHERE CASE WHEN family = 'cox' THEN contains(lower(concat_ws(' ', gene, product)), 'g1') ELSE contains(lower(concat_ws(' ', gene, product)), family) END)
SELECT dataset_name, analyte, family AS anchor_family, target AS protein_accession, l_orderkey AS query_id FROM g
QUALIFY row_number() OVER (PARTITION BY dataset_name, analyte, family, target ORDER BY l_extendedprice DESC, l_discount, l_quantity DESC, l_linenumber, l_partkey, l_suppkey) = 1""")
def rescued_hits(spark, sf_dir):
    """Threshold, best hit, metadata, guard and one row for each key, composed."""
    rows, order = hits(spark, sf_dir)
    named = rows.withColumns({"analyte": F.lit("CO"), "anchor_family": F.when(F.col("query_id") % 2 == 0, "cox").otherwise("supplier#0000000")})
    out = anchors.rescued(named, metadata(spark, sf_dir), order, 0.05, ["gene", "product"], {"cox": ["g1"]})
    return out.select("dataset_name", "analyte", "anchor_family", "protein_accession", "query_id")


@query("""WITH p AS (SELECT 'd' || s_nationkey AS dataset_name, r_name AS phylum, s_suppkey % 30 AS acc, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT 'd' || c_nationkey AS dataset_name, r_name AS phylum, c_custkey % 30 AS acc, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 7 = 0)
SELECT p.dataset_name, p.acc AS protein_accession, s_name, c_name FROM p LEFT JOIN f ON p.dataset_name = f.dataset_name AND p.acc = f.acc AND f.phylum = 'ASIA' WHERE p.phylum = 'ASIA' AND p.dataset_name NOT IN ('d8')""")
def shard_proteins(spark, sf_dir):
    def placed(table, nation):
        rows = read(spark, sf_dir, table).join(read(spark, sf_dir, "nation"), F.col(nation) == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return rows.withColumns({"dataset_name": F.format_string("d%d", nation), "phylum": F.col("r_name")})

    proteins = placed("supplier", "s_nationkey").select("dataset_name", "phylum", (F.col("s_suppkey") % 30).alias("protein_accession"), "s_name")
    features = placed("customer", "c_nationkey").where("c_custkey % 7 = 0").select("dataset_name", "phylum", (F.col("c_custkey") % 30).alias("protein_accession"), "c_name")
    return anchors.shard_proteins(proteins, features, [f"d{k}" for k in range(25) if k != 8], "ASIA").select("dataset_name", "protein_accession", "s_name", "c_name")


@query("""WITH h AS (SELECT DISTINCT 'd' || c_nationkey AS dataset_name, c_mktsegment AS analyte, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'f' || (c_custkey % 4) END AS anchor_family, c_name AS protein_accession, 't' || c_nationkey AS locus_tag FROM customer)
SELECT *, CAST(row_number() OVER (ORDER BY dataset_name, analyte, anchor_family, protein_accession, locus_tag) AS INTEGER) AS cluster_id FROM h""")
def cluster_numbers(spark, sf_dir):
    family = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.format_string("f%d", F.col("c_custkey") % 4))
    rows = read(spark, sf_dir, "customer").select(F.format_string("d%d", "c_nationkey").alias("dataset_name"), F.col("c_mktsegment").alias("analyte"), family.alias("anchor_family"), F.col("c_name").alias("protein_accession"), F.format_string("t%d", "c_nationkey").alias("locus_tag"))
    return anchors.numbered(rows.distinct())


@query("""WITH p AS (SELECT p_brand AS dataset_name, count(DISTINCT p_name) AS n FROM part GROUP BY 1), f AS (SELECT 'Brand#' || (s_suppkey % 30) AS dataset_name, count(*) AS n FROM supplier GROUP BY 1)
SELECT d.dataset_name, coalesce(p.n, 0) AS n_proteins, coalesce(f.n, 0) AS n_features FROM (SELECT DISTINCT p_brand AS dataset_name FROM part UNION SELECT 'none') d LEFT JOIN p USING (dataset_name) LEFT JOIN f USING (dataset_name)""")
def catalog_counts(spark, sf_dir):
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    datasets = part.select(F.col("p_brand").alias("dataset_name")).union(part.limit(1).select(F.lit("none")))
    features = supplier.select(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string")).alias("dataset_name"), F.col("s_suppkey").alias("feature_id"))
    return catalog.counts(datasets, part.select(F.col("p_brand").alias("dataset_name"), F.col("p_name").alias("protein_accession")), features)


# ---------------------------------------------------------------- annotation and candidates


@query(f"WITH {base.GENE_SQL} SELECT l_orderkey AS locus_id, count(*) FILTER (len(pf) = 0 AND NOT supported) AS n_unannotated FROM ge GROUP BY 1")
def unannotated_genes(spark, sf_dir):
    return annotate.unannotated(base.line_genes(spark, sf_dir))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS INTEGER) AS ordinal FROM orders")
def ordinals(spark, sf_dir):
    return annotate.with_ordinal(read(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], group=["o_custkey"]).select("o_custkey", "o_orderkey", "ordinal")


@query("""WITH c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN ' ' ELSE n_name END AS genus, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name || ' x' END AS organism, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, coalesce(nullif(trim(genus), ''), nullif(split_part(trim(organism), ' ', 1), ''), 'unknown') AS genus, CAST(c_nationkey AS VARCHAR) AS family, nullif(c_mktsegment, '') AS phylum, 'unknown' AS other FROM c""")
def taxonomy_stand_ins(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    third = F.col("c_custkey") % 3
    c = c.select("c_custkey", F.col("c_mktsegment").alias("analyte"), F.when(third == 1, " ").when(third == 2, F.col("n_name")).alias("genus"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat("c_name", F.lit(" x"))).alias("organism"), F.col("c_nationkey").alias("taxon_id"))
    value = lambda rank, default: lineage.taxonomy_value(rank, c.columns, default).alias(rank)
    return c.select("c_custkey", value("genus", "unknown"), value("family", "unknown"), value("phylum", ""), lineage.taxonomy_value("order", c.columns, "unknown").alias("other"))


ARCHETYPES = """
k AS (SELECT o_orderkey, c_mktsegment AS analyte, o_orderpriority AS architecture, CASE WHEN o_orderkey % 2 = 0 THEN 'old' END AS old FROM orders JOIN customer ON o_custkey = c_custkey),
ar AS (SELECT DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS analyte, o_orderpriority AS architecture FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderpriority NOT LIKE '5%')"""


@query(f"""WITH {ARCHETYPES} SELECT o_orderkey, coalesce(CASE WHEN m.analyte IS NOT NULL THEN m.analyte || ':' || m.architecture END, CASE WHEN e.architecture IS NOT NULL THEN ':' || e.architecture END, old) AS archetype_id
FROM k LEFT JOIN ar m ON m.analyte = k.analyte AND m.architecture = k.architecture LEFT JOIN ar e ON e.analyte = '' AND e.architecture = k.architecture""")
def candidate_archetypes(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    candidates = o.select("o_orderkey", F.col("c_mktsegment").alias("analyte"), F.col("o_orderpriority").alias("architecture"), F.when(F.col("o_orderkey") % 2 == 0, "old").alias("archetype_id"))
    some = candidates.where("analyte IN ('BUILDING', 'MACHINERY') AND architecture NOT LIKE '5%'").select(F.when(F.col("analyte") == "BUILDING", "").otherwise(F.col("analyte")).alias("analyte"), F.col("architecture").alias("architecture_string")).distinct()
    return scoring.with_archetypes(candidates, some.withColumn("archetype_id", F.concat_ws(":", "analyte", "architecture_string"))).select("o_orderkey", "archetype_id")


@query(f"""WITH {base.CANDIDATES_SQL[: base.CANDIDATES_SQL.index(', cf AS (')]},
d AS (SELECT c_mktsegment AS analyte, rcls AS regulator_class, coalesce(nullif(CASE WHEN len(ch) = 0 THEN 'none' WHEN hits > 0 THEN hit_list[1] ELSE ch[1] END, 'none'), CASE WHEN l_quantity > 40 THEN 'GAF' END, 'none') AS chemistry FROM cs)
SELECT analyte, regulator_class, chemistry, count(*) AS n FROM d GROUP BY ALL""")
def family_chemistry(spark, sf_dir):
    return reports.family_chemistry(base.candidate_rows(spark, sf_dir))


# ---------------------------------------------------------------- benchmark


@query("""WITH r AS (SELECT c_name, 'k' || c_custkey AS candidate_id, c_acctbal AS candidate_score, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer),
t AS (SELECT n_nationkey AS benchmark_id, CASE WHEN n_nationkey % 6 = 0 THEN '' WHEN n_nationkey % 6 = 1 THEN NULL ELSE '0' || n_nationkey END AS protein_name FROM nation)
SELECT benchmark_id, protein_name, rank, candidate_id, candidate_score FROM t LEFT JOIN r ON protein_name <> '' AND contains(c_name, protein_name)
QUALIFY row_number() OVER (PARTITION BY benchmark_id ORDER BY rank) = 1""")
def benchmark_candidates(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_name").alias("gene_accession"), F.format_string("k%d", "c_custkey").alias("candidate_id"), F.col("c_acctbal").alias("candidate_score"), "c_custkey")
    ranked = evaluate.ranks(c, "candidate_score", ["c_custkey"])
    sixth = F.col("n_nationkey") % 6
    truth = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("benchmark_id"), F.when(sixth == 0, "").when(sixth > 1, F.format_string("0%d", "n_nationkey")).alias("protein_name"))
    return evaluate.first_candidates(truth, ranked, "benchmark_id", "protein_name").select("benchmark_id", "protein_name", "rank", "candidate_id", "candidate_score")


@query(f"""WITH {base.LABELLED}, r AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM l)
SELECT 'positive_recall' AS metric, round(avg((n_chars > 2000)::INT) FILTER (toxic = 1), 6) AS value, count(*) FILTER (toxic = 1) AS n, 'share' AS notes FROM r
UNION ALL SELECT 'negative_fpr', round(avg((n_chars <= 2000)::INT) FILTER (toxic = 0), 6), count(*) FILTER (toxic = 0), '' FROM r
UNION ALL SELECT 'top_1_recall', round(avg((rank <= 1)::INT) FILTER (toxic = 1), 6), count(*), '' FROM r
UNION ALL SELECT 'top_5_recall', round(avg((rank <= 5)::INT) FILTER (toxic = 1), 6), count(*), '' FROM r
UNION ALL SELECT 'top_10_recall', round(avg((rank <= 10)::INT) FILTER (toxic = 1), 6), count(*), '' FROM r""")
def benchmark_metrics(spark, sf_dir):
    rows = evaluate.ranks(base.labelled(spark, sf_dir), "n_chars", ["doc_id"])
    s = evaluate.summary(rows, F.col("toxic") == 1, F.col("n_chars") > 2000, F.col("rank"))
    out = evaluate.metric_rows(s, {"positive_recall": F.col("toxic") == 1, "negative_fpr": F.col("toxic") == 0}, rows, {"positive_recall": "share"})
    return out.withColumn("value", r6("value"))


# ---------------------------------------------------------------- robustness

ROBUST = f"""{base.ENRICHMENT_ROWS.replace('c_mktsegment, n_name', 'c_mktsegment, n_name, o_totalprice', 1)},
o AS (SELECT o_orderkey FROM (SELECT DISTINCT o_orderkey, o_totalprice, c_mktsegment, n_name FROM e) QUALIFY row_number() OVER (PARTITION BY c_mktsegment, n_name ORDER BY o_totalprice DESC, o_orderkey) = 1),
u AS (SELECT 'none' AS policy, * FROM e UNION ALL SELECT 'one_per_genus', e.* FROM e JOIN o USING (o_orderkey)),
t AS (SELECT policy, count(DISTINCT o_orderkey) FILTER (c_mktsegment = 'BUILDING') AS n1, count(DISTINCT o_orderkey) FILTER (c_mktsegment = 'MACHINERY') AS n0 FROM u GROUP BY 1),
k AS (SELECT policy, feature, count(DISTINCT o_orderkey) FILTER (c_mktsegment = 'BUILDING') AS a, count(DISTINCT o_orderkey) FILTER (c_mktsegment = 'MACHINERY') AS c FROM u GROUP BY ALL),
w AS (SELECT policy, feature, a, n1 - a AS b, c, n0 - c AS d FROM k JOIN t USING (policy))"""


@query(f"""WITH {ROBUST}, x AS (
  SELECT *, a + b AS r, c + d AS s, a + c AS m, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS i FROM w
), y AS (
  SELECT *, {base._LG.format('r', 'i')} + {base._LG.format('s', '(m - i)')} - {base._LG.format('(r + s)', 'm')} AS lp, {base._LG.format('r', 'a')} + {base._LG.format('s', '(m - a)')} - {base._LG.format('(r + s)', 'm')} AS here FROM x
), z AS (
  SELECT policy, feature, a, b, c, d, round(least(1.0, sum(exp(lp)) FILTER (lp <= here + 1e-7)), 9) AS p FROM y GROUP BY ALL
), q AS (
  SELECT *, p * count(*) OVER (PARTITION BY policy) / max(rk) OVER (PARTITION BY policy, p) AS adj FROM (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY p) AS rk FROM z)
)
SELECT policy AS deduplication_policy, feature, a AS n_a, c AS n_c, round(p, 6) AS p_value, round(least(1.0, min(adj) OVER (PARTITION BY policy ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM q""")
def robustness_tests(spark, sf_dir):
    """p and q of every feature under each deduplication policy."""
    rows = base.enrichment_rows(spark, sf_dir)
    out = stats.robustness(rows, ["feature"], "o_orderkey", "c_mktsegment", "BUILDING", {"none": None, "one_per_genus": "n_name"}, "o_totalprice", test="fisher")
    return out.select("deduplication_policy", "feature", "n_a", "n_c", r6("p_value").alias("p_value"), r6("q_value").alias("q_value"))


# ---------------------------------------------------------------- what figures show


@query(f"""WITH {base.LOCI_SQL} SELECT row_number() OVER (ORDER BY c_mktsegment, locus_score, o_orderkey) - 1 AS place, c_mktsegment AS analyte, o_orderkey AS locus_id, round(locus_score, 6) AS locus_score,
CASE WHEN locus_score >= 6 THEN 'high' WHEN locus_score >= 3.5 THEN 'medium' WHEN locus_score >= 1.5 THEN 'low' ELSE 'control' END AS locus_confidence FROM lo""")
def figure_landscape(spark, sf_dir):
    return reports.locus_landscape(base.scored_loci(spark, sf_dir)).withColumn("locus_score", r6("locus_score"))


@query(f"WITH {base.LOCI_SQL} SELECT c_nationkey || ' (' || c_mktsegment || ')' AS label, count(*) AS n_loci FROM lo GROUP BY c_nationkey, c_mktsegment ORDER BY n_loci DESC, CAST(c_nationkey AS VARCHAR), c_mktsegment LIMIT 12")
def figure_archetypes(spark, sf_dir):
    loci = base.scored_loci(spark, sf_dir).groupBy("analyte", F.col("cluster_id").cast("string").alias("archetype_id")).agg(F.count("*").alias("n_loci"))
    return reports.archetype_atlas(loci)


@query(f"SELECT candidate_id, candidate_score AS score FROM (WITH {base.CANDIDATES_SQL}) ORDER BY candidate_score DESC, candidate_id LIMIT 30")
def figure_ranking(spark, sf_dir):
    scored = base.candidate_rows(spark, sf_dir).select("candidate_id", r6("candidate_score").alias("candidate_score"))
    return reports.candidate_ranking(scored)
