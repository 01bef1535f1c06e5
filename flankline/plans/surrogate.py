"""The operators over the driver's tables, each beside the SQL that it must agree with.

Events stand for features on contigs (users), orders with their line items for loci with genes, customers, nations and
regions for organisms and a taxonomy, market segments for analytes, labels for benchmark truth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flankline.functions import scalars as S
from flankline.operators import anchors, annotate, catalog, evaluate, lineage, neighborhoods, scoring, sequence, stats
from flankline.session import tasks_for

WINDOW = 3
MAX_GAP = 20_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# ---------------------------------------------------------------- features on contigs


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    start = F.floor(micros("ts") / 1_000_000)
    rows = e.select("user_id", "event_id", "event_type", "value", start.alias("start_nt"), (start + F.floor("value")).alias("stop_nt"), F.when(F.col("event_type").isin("signup", "purchase"), "+").otherwise("-").alias("strand"), micros("ts").alias("us"))
    return neighborhoods.ordinals(rows, ["user_id"], ["us", "event_id"])


FEATURES = """
f AS (
  SELECT user_id, event_id, event_type, value, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS start_nt,
         CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) + CAST(floor(value) AS BIGINT) AS stop_nt,
         CASE WHEN event_type IN ('signup', 'purchase') THEN '+' ELSE '-' END AS strand,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS ord,
         count(*) OVER (PARTITION BY user_id) - 1 AS last
  FROM events
)"""
GENES = f"""
{FEATURES}, g AS (
  SELECT a.event_id AS locus_id, b.event_id AS gene_accession, CAST(b.ord - a.ord AS INTEGER) AS relative_index,
         b.start_nt - a.start_nt AS relative_start, b.stop_nt - a.start_nt AS relative_stop, b.ord = a.ord AS is_anchor,
         b.strand, b.event_type, b.value
  FROM f a JOIN f b ON a.user_id = b.user_id AND b.ord BETWEEN a.ord - {WINDOW} AND a.ord + {WINDOW}
  WHERE a.event_type = 'error'
)"""


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    a = f.where("event_type = 'error'").withColumn("locus_id", F.col("event_id"))
    return neighborhoods.neighborhoods(f.drop("us"), a, ["user_id"], "event_id", "start_nt", "stop_nt", "locus_id", WINDOW)


@query(f"WITH {GENES} SELECT locus_id, gene_accession, relative_index, relative_start, relative_stop, is_anchor FROM g")
def neighborhoods_(spark, sf_dir):
    return genes(spark, sf_dir).select("locus_id", "gene_accession", "relative_index", "relative_start", "relative_stop", "is_anchor")


for _d in (QUERIES, ORACLE_SQL):
    _d["neighborhoods"] = _d.pop("neighborhoods_")


@query(f"""WITH {FEATURES}
SELECT event_id AS locus_id, CAST(least(last, ord + {WINDOW}) - greatest(0, ord - {WINDOW}) + 1 AS INTEGER) AS window_size,
       ord - {WINDOW} <= 0 OR ord + {WINDOW} >= last AS is_boundary_truncated
FROM f WHERE event_type = 'error'""")
def locus_summary(spark, sf_dir):
    a = features(spark, sf_dir).where("event_type = 'error'").withColumn("locus_id", F.col("event_id"))
    return neighborhoods.locus_rows(a, "locus_id", WINDOW).select("locus_id", "window_size", "is_boundary_truncated")


OPERONS = f"""
{GENES}, o AS (
  SELECT *, CASE WHEN lag(strand) OVER w IS NULL OR lag(strand) OVER w <> strand
                   OR greatest(0, relative_start - lag(relative_stop) OVER w - 1) > {MAX_GAP} THEN 1 ELSE 0 END AS opens
  FROM g WINDOW w AS (PARTITION BY locus_id ORDER BY relative_start, relative_stop, gene_accession)
), p AS (
  SELECT *, sum(opens) OVER (PARTITION BY locus_id ORDER BY relative_start, relative_stop, gene_accession ROWS UNBOUNDED PRECEDING) AS no FROM o
), q AS (
  SELECT *, bool_or(is_anchor) OVER (PARTITION BY locus_id, no) AS in_anchor_operon FROM p
)"""


def operon_genes(spark, sf_dir):
    return neighborhoods.operons(genes(spark, sf_dir), "locus_id", "relative_start", "relative_stop", "strand", "is_anchor", ["gene_accession"], MAX_GAP)


@query(f"WITH {OPERONS} SELECT locus_id, gene_accession, format('{{}}:operon_{{:02d}}', locus_id, CAST(no AS INTEGER)) AS operon_id, in_anchor_operon FROM q")
def operons(spark, sf_dir):
    return operon_genes(spark, sf_dir).select("locus_id", "gene_accession", "operon_id", "in_anchor_operon")


@query(f"WITH {OPERONS} SELECT locus_id, round(avg(CAST(in_anchor_operon AS INTEGER)), 6) AS operon_integrity FROM q GROUP BY locus_id")
def operon_integrity(spark, sf_dir):
    return neighborhoods.operon_integrity(operon_genes(spark, sf_dir), "locus_id").select("locus_id", r6("operon_integrity_score").alias("operon_integrity"))


ARCHITECTURE = f"""
{GENES}, c AS (
  SELECT locus_id, relative_index, gene_accession,
         format('{{:+d}}:{{}}[{{}}]@{{}}', relative_index, event_type, CASE WHEN value >= 50 THEN 'high' ELSE 'none' END,
                CASE WHEN d <= 250 THEN 'near' WHEN d <= 1000 THEN 'mid' ELSE 'far' END) AS token
  FROM (SELECT *, least(abs(relative_start), abs(relative_stop)) AS d FROM g) WHERE NOT is_anchor AND abs(relative_index) <= 1
), x AS (
  SELECT l.locus_id, coalesce(string_agg(token, '>' ORDER BY relative_index, gene_accession) || '>', '') || '0:error' AS architecture
  FROM (SELECT DISTINCT locus_id FROM g) l LEFT JOIN c USING (locus_id) GROUP BY l.locus_id
)"""


def architecture_rows(spark, sf_dir):
    g = genes(spark, sf_dir)
    near = g.where("NOT is_anchor AND abs(relative_index) <= 1")
    token = scoring.candidate_token(F.col("relative_index"), F.col("event_type"), F.array(F.when(F.col("value") >= 50, "high").otherwise("")), S.distance_nt("relative_start", "relative_stop"))
    loci = g.where("is_anchor").select("locus_id", F.lit("0:error").alias("anchor_token"))
    return neighborhoods.architectures(near.withColumn("token", token), loci, "locus_id", ["relative_index", "gene_accession"], "token", "anchor_token")


@query(f"WITH {ARCHITECTURE} SELECT locus_id, architecture FROM x")
def architecture_strings(spark, sf_dir):
    return architecture_rows(spark, sf_dir)


@query(f"""WITH {ARCHITECTURE}, a AS (SELECT architecture, count(*) AS n_loci FROM x GROUP BY architecture)
SELECT format('arch_{{:04d}}', CAST(row_number() OVER (ORDER BY architecture) AS INTEGER)) AS archetype_id, architecture, n_loci FROM a""")
def archetypes(spark, sf_dir):
    loci = architecture_rows(spark, sf_dir)
    n = loci.groupBy("architecture").agg(F.count("*").alias("n_loci"))
    return n.join(scoring.archetype_ids(loci, "architecture"), "architecture").select(F.format_string("arch_%04d", "archetype_no").alias("archetype_id"), "architecture", "n_loci")


@query(f"""WITH RECURSIVE {ARCHITECTURE},
a AS MATERIALIZED (SELECT architecture, row_number() OVER (ORDER BY architecture) AS i, count(*) AS n FROM x GROUP BY architecture),
e AS (SELECT i, CAST(split_part(t, ':', 1) AS INTEGER) AS k, substr(t, instr(t, ':') + 1) AS v FROM (SELECT i, unnest(string_split(architecture, '>')) AS t FROM a)),
w AS (SELECT i, sum(1 / (1 + abs(k))) AS w FROM e GROUP BY i),
b AS (SELECT e.i, f.i AS j, sum(1 / (1 + abs(e.k))) AS common, sum(CASE WHEN e.v = f.v THEN 1 / (1 + abs(e.k)) ELSE 0 END) AS same FROM e JOIN e f ON e.k = f.k AND f.i < e.i GROUP BY ALL),
near AS MATERIALIZED (SELECT b.i, j FROM b JOIN w p ON p.i = b.i JOIN w q ON q.i = b.j WHERE 1 - same / (p.w + q.w - common) <= 0.4 + 1e-12),
s(i, leaders, follows) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT s.i + 1, CASE WHEN min(j) IS NULL THEN list_append(any_value(leaders), s.i + 1) ELSE any_value(leaders) END, min(j)
  FROM s LEFT JOIN near ON near.i = s.i + 1 AND list_contains(leaders, j) WHERE s.i < (SELECT count(*) FROM a) GROUP BY s.i),
cl AS (SELECT i, coalesce(follows, i) AS leader FROM s WHERE i > 0), m AS (SELECT leader, CAST(row_number() OVER (ORDER BY leader) AS INTEGER) AS archetype_no FROM (SELECT DISTINCT leader FROM cl))
SELECT archetype_no, CAST(sum(n) AS BIGINT) AS n_loci, min(architecture) AS leader FROM cl JOIN a USING (i) JOIN m USING (leader) GROUP BY archetype_no""")
def archetypes_threshold(spark, sf_dir):
    loci = architecture_rows(spark, sf_dir)
    return loci.join(scoring.archetype_ids(loci, "architecture", 0.4), "architecture").groupBy("archetype_no").agg(F.count("*").alias("n_loci"), F.min("architecture").alias("leader"))


@query(f"""
WITH {GENES}, l AS (SELECT locus_id, user_id, relative_index AS k, g.event_type AS v FROM g JOIN f ON f.event_id = locus_id),
a AS (SELECT user_id, min(locus_id) AS ref FROM l GROUP BY user_id),
r AS (SELECT l.user_id, k, v FROM l JOIN a ON l.locus_id = a.ref),
b AS (SELECT locus_id, k, r.v FROM (SELECT DISTINCT locus_id, user_id FROM l) JOIN r USING (user_id)),
u AS (SELECT coalesce(l.locus_id, b.locus_id) AS locus_id, coalesce(l.k, b.k) AS k, l.v AS v, b.v AS w FROM l FULL JOIN b ON l.locus_id = b.locus_id AND l.k = b.k)
SELECT locus_id, round(sum(CASE WHEN v IS DISTINCT FROM w THEN 1.0::DOUBLE / (1 + abs(k)) ELSE 0 END) / sum(1.0::DOUBLE / (1 + abs(k))), 6) AS distance FROM u GROUP BY locus_id
""")
def architecture_distance(spark, sf_dir):
    """Every locus against the first one of its contig."""
    users = read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("locus_id"), "user_id")
    token = F.format_string("%+d:%s", "relative_index", "event_type")
    listed = genes(spark, sf_dir).groupBy("locus_id").agg(F.array_sort(F.collect_list(F.struct("relative_index", token.alias("t")))).alias("l"))
    parsed = listed.join(users, "locus_id").select("locus_id", "user_id", scoring.parsed_architecture(F.array_join(F.transform("l", lambda x: x["t"]), ">")).alias("m"))
    first = parsed.groupBy("user_id").agg(F.min_by("m", "locus_id").alias("ref"))
    return parsed.join(first, "user_id").select("locus_id", r6(scoring.architecture_distance(F.col("m"), F.col("ref"))).alias("distance"))


# ---------------------------------------------------------------- catalogs

PART_COLUMNS = ["p_name", "p_brand", "p_type"]


@query("""SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE p_name ILIKE '%r%ng%' OR p_brand ILIKE '%r%ng%' OR p_type ILIKE '%r%ng%' ORDER BY p_name, p_partkey LIMIT 20""")
def catalog_search(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", *PART_COLUMNS)
    return catalog.search(p, "r%ng", PART_COLUMNS, [F.col("p_name"), F.col("p_partkey")], 20)


@query("""SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%r%' OR p_type ILIKE '%r%'
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 5""")
def corpus_search_per_catalog(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", *PART_COLUMNS, "p_retailprice")
    return catalog.search(p, "r", ["p_name", "p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 5, "p_brand").drop("p_retailprice")


TERMS = [("CO", "econ"), ("CO", "ring"), ("CN", "promo"), ("NO", "b_lt"), ("O2", "%large%")]
TERM_SQL = "t(analyte, term) AS (VALUES " + ", ".join(f"('{a}', '{t}')" for a, t in TERMS) + ")"


def scanned(spark, sf_dir):
    targets = spark.createDataFrame(TERMS, "analyte string, term string")
    return catalog.term_scan(read(spark, sf_dir, "part"), targets, ["p_name", "p_type"], "p_brand", ["analyte", "term", "p_brand", "p_partkey"])


@query(f"WITH {TERM_SQL} SELECT DISTINCT analyte, term, p_partkey, p_name, p_type FROM part JOIN t ON p_name ILIKE '%' || term || '%' OR p_type ILIKE '%' || term || '%' WHERE p_brand IS NOT NULL")
def term_scan(spark, sf_dir):
    return scanned(spark, sf_dir).select("analyte", "term", "p_partkey", "p_name", "p_type")


@query(f"""WITH {TERM_SQL} SELECT DISTINCT p_brand AS dataset_name, analyte, term AS anchor_family, CAST(p_partkey AS VARCHAR) AS protein_accession, p_name AS product, 'term_scan' AS evidence_type
FROM part JOIN t ON p_name ILIKE '%' || term || '%' OR p_type ILIKE '%' || term || '%'""")
def normalized_hits(spark, sf_dir):
    s = scanned(spark, sf_dir).withColumn("acc", F.col("p_partkey").cast("string"))
    return catalog.anchor_hits_of_scan(s, "p_brand", "acc", "p_type", "p_type", "p_name").select("dataset_name", "analyte", "anchor_family", "protein_accession", "product", "evidence_type")


@query("""WITH f AS (SELECT p_brand AS dataset, count(*) AS n_features, count(*) FILTER (p_type = 'ECONOMY') AS n_coding, count(p_name) AS n_with_protein FROM part GROUP BY 1),
p AS (SELECT 'Brand#' || (s_suppkey % 30) AS dataset, count(*) AS n_proteins, avg(s_acctbal) AS mean_length FROM supplier GROUP BY 1)
SELECT dataset, n_features, n_coding, n_with_protein, n_proteins, round(mean_length, 4) AS mean_length FROM f FULL JOIN p USING (dataset)""")
def catalog_summary(spark, sf_dir):
    f = read(spark, sf_dir, "part").withColumn("dataset", F.col("p_brand"))
    p = read(spark, sf_dir, "supplier").withColumn("dataset", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string")))
    return catalog.summary(f, p, "dataset", "p_type", "ECONOMY", "p_name", "s_acctbal").withColumn("mean_length", F.round("mean_length", 4))


@query("""
WITH a AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS tag FROM customer),
m AS (
  SELECT c_custkey, 0 AS match_rank, s_suppkey, s_name, s_acctbal FROM a JOIN supplier ON 'Supplier#' || substr(c_name, 10) = s_name
  UNION ALL
  SELECT c_custkey, 1, s_suppkey, s_name, s_acctbal FROM a JOIN supplier ON c_nationkey = s_nationkey AND tag <> '' AND tag = CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'HOUSEHOLD' END
)
SELECT c_custkey, match_rank, s_suppkey FROM m QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY match_rank, s_acctbal, s_suppkey) = 1
""")
def anchor_resolution(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    a = c.select("c_custkey", F.concat(F.lit("Supplier#"), F.expr("substring(c_name, 10)")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("tag"), F.col("c_nationkey").cast("string").alias("nation"))
    k = F.col("s_suppkey") % 3
    s = read(spark, sf_dir, "supplier").withColumn("tag", F.when(k == 0, "BUILDING").when(k == 1, "MACHINERY").otherwise("HOUSEHOLD")).withColumn("nation", F.col("s_nationkey").cast("string"))
    s = s.withColumn("pair", F.concat_ws("|", "tag", "nation"))
    a = a.withColumn("pair", F.when(F.col("tag") == "", "").otherwise(F.concat_ws("|", "tag", "nation")))
    return anchors.resolve(a, s, "c_custkey", [("name", "s_name"), ("pair", "pair")], [], ["s_acctbal", "s_suppkey"]).select("c_custkey", "match_rank", "s_suppkey")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem
WHERE l_discount <= 0.05 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_discount, l_quantity DESC, l_partkey, l_suppkey, l_linenumber) = 1""")
def best_hits(spark, sf_dir):
    hits = anchors.passing(read(spark, sf_dir, "lineitem"), "l_discount", 0.05)
    order = [F.desc("l_extendedprice"), F.col("l_discount"), F.desc("l_quantity"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")]
    return anchors.best_hits(hits, "l_orderkey", order).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@query("""SELECT c_mktsegment, c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer QUALIFY rank <= 30""")
def top_k_per_group(spark, sf_dir):
    return evaluate.top_k(read(spark, sf_dir, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 30).select("c_mktsegment", "c_custkey", "rank")


@query("""SELECT 'phylum-' || lpad(CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS VARCHAR), 4, '0') || '-' || lower(c_mktsegment) AS shard_id,
count(*) AS n_datasets, string_agg(c_name, ',' ORDER BY c_name) AS dataset_names FROM customer GROUP BY c_mktsegment""")
def shards(spark, sf_dir):
    s = catalog.shards(read(spark, sf_dir, "customer"), "c_name", "c_mktsegment")
    return s.select("shard_id", F.col("n_datasets").cast("long").alias("n_datasets"), F.array_join("dataset_names", ",").alias("dataset_names"))


@query("""WITH o AS (SELECT c_name, c_mktsegment, floor((row_number() OVER (ORDER BY c_mktsegment, c_name) - 1) / 100) AS no FROM customer)
SELECT 'genomes-' || lpad(CAST(CAST(no AS INTEGER) AS VARCHAR), 4, '0') AS shard_id, count(*) AS n_datasets, CASE WHEN min(c_mktsegment) = max(c_mktsegment) THEN min(c_mktsegment) ELSE 'mixed' END AS "group" FROM o GROUP BY no""")
def shards_by_count(spark, sf_dir):
    s = catalog.shards(read(spark, sf_dir, "customer"), "c_name", "c_mktsegment", "count", 100)
    return s.select("shard_id", F.col("n_datasets").cast("long").alias("n_datasets"), "group")


# ---------------------------------------------------------------- taxonomy

TREE = """
n(id, parent, rank, name) AS (
  SELECT 'root', 'root', 'superkingdom', 'life'
  UNION ALL SELECT 'r' || r_regionkey, 'root', 'phylum', r_name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'genus', n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'species', c_name FROM customer
), closure(node, ancestor, distance) AS (
  SELECT id, id, 0 FROM n
  UNION ALL SELECT c.node, p.parent, c.distance + 1 FROM closure c JOIN n p ON c.ancestor = p.id WHERE p.parent <> p.id
)"""


def tree(spark, sf_dir):
    def part(table, mark, key, parent, rank, name):
        return read(spark, sf_dir, table).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), parent.alias("parent"), F.lit(rank).alias("rank"), F.col(name).alias("name"))

    root = spark.createDataFrame([("root", "root", "superkingdom", "life")], "id string, parent string, rank string, name string")
    up = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    return root.union(part("region", "r", "r_regionkey", F.lit("root"), "phylum", "r_name")).union(part("nation", "n", "n_nationkey", up("r", "n_regionkey"), "genus", "n_name")).union(part("customer", "c", "c_custkey", up("n", "c_nationkey"), "species", "c_name"))


@query(f"WITH RECURSIVE {TREE} SELECT node, ancestor, CAST(distance AS INTEGER) AS distance FROM closure")
def lineage_closure(spark, sf_dir):
    return lineage.ancestor_closure(tree(spark, sf_dir), "id", "parent")


@query(f"""WITH RECURSIVE {TREE} SELECT node, max(name) FILTER (distance = 0) AS organism, max(name) FILTER (rank = 'superkingdom') AS superkingdom, max(name) FILTER (rank = 'phylum') AS phylum,
max(name) FILTER (rank = 'genus') AS genus, max(name) FILTER (rank = 'species') AS species FROM closure JOIN n ON ancestor = id GROUP BY node""")
def lineage_pivot(spark, sf_dir):
    t = tree(spark, sf_dir)
    names = t.select(F.col("id").alias("ancestor"), "rank", "name")
    return lineage.lineage_pivot(lineage.ancestor_closure(t, "id", "parent"), names, ["superkingdom", "phylum", "genus", "species"])


@query(f"""WITH RECURSIVE {TREE}, w(id, path, depth) AS (
  SELECT id, [id], 0 FROM n WHERE id = parent UNION ALL SELECT n.id, list_append(w.path, n.id), w.depth + 1 FROM w JOIN n ON n.parent = w.id AND n.id <> n.parent),
k AS (SELECT ancestor, count(*) AS below FROM closure GROUP BY ancestor)
SELECT id AS node, row_number() OVER (ORDER BY path) AS pre, row_number() OVER (ORDER BY path) + below - 1 AS last, CAST(depth AS BIGINT) AS depth FROM w JOIN k ON ancestor = id""")
def lineage_intervals(spark, sf_dir):
    return lineage.intervals(tree(spark, sf_dir), "id", "parent").select("node", "pre", "last", "depth")


@query(ORACLE_SQL["lineage_pivot"])
def lineage_by_intervals(spark, sf_dir):
    t = tree(spark, sf_dir)
    names = t.select(F.col("id").alias("node"), "rank", "name")
    return lineage.lineages(lineage.intervals(t, "id", "parent"), names, ["superkingdom", "phylum", "genus", "species"])


@query("""
WITH k AS (SELECT c_mktsegment AS segment, n_name AS organism, c_nationkey AS taxon FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500)
SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.segment = c.c_mktsegment AND k.organism = n_name)
  OR EXISTS (SELECT 1 FROM k WHERE k.segment = c.c_mktsegment AND k.taxon = c.c_nationkey + 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS taxonomic_context_score
FROM customer c JOIN nation ON c_nationkey = n_nationkey
""")
def taxonomic_context(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    loci = c.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("organism"), (F.col("c_nationkey") + 1).alias("taxon"))
    known = c.where("c_acctbal > 9500").select(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("organism"), F.col("c_nationkey").alias("taxon"))
    return annotate.taxonomic_context(loci, known, [["segment", "organism"], ["segment", "taxon"]]).select("c_custkey", "taxonomic_context_score")


@query("""SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def taxonomy_filled(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("k", F.col("c_custkey"))
    return lineage.fill_taxonomy(o, c, "k", ["c_mktsegment", "n_name"]).drop("k")


# ---------------------------------------------------------------- annotation: line items as genes, parts as domains

PF = ["PF00027", "PF00325", "PF00158", "PF00126", "PF00392", "PF00072", "PF00512", "PF04542", "PF01590", "PF07700", "PF00989", "PF02954"]
RULES = [
    {"family": "one", "class": "one_component", "pfam_required": ["PF00027", "PF00325"], "pfam_optional": []},
    {"family": "two", "class": "sigma54_activator", "pfam_required": ["PF00158"], "pfam_optional": ["PF02954"]},
    {"family": "three", "class": "one_component", "pfam_required": ["PF00027"], "pfam_optional": ["PF00325"]},
    {"family": "four", "class": "one_component", "pfam_required": ["PF00126"], "pfam_optional": []},
    {"family": "five", "class": "two_component_rr", "pfam_required": ["PF00072"], "pfam_optional": []},
    {"family": "six", "class": "two_component_hk", "pfam_required": ["PF00512"], "pfam_optional": ["PF02518"]},
]
SENSORS = [
    {"domain": "PAS", "pfam_id": "PF00989", "role": "sensor", "chemistry": "none"},
    {"domain": "GAF", "pfam_id": "PF01590", "role": "sensor", "chemistry": "cnmp"},
    {"domain": "HNOB", "pfam_id": "PF07700", "role": "sensor", "chemistry": "heme"},
]
PAIRED = [{"if_pfam_all": ["PF00989"], "if_co_pfam_any": ["PF00512", "PF00158"], "if_motif_any": [], "if_organism_kingdom": None, "chemistry": "flavin"}]
TEXTS = {"A": "Transcriptional regulator X", "N": "sensor histidine kinase", "R": "transport protein"}
GENE_SQL = f"""
z AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_discount, l_tax, l_shipdate,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS no
  FROM lineitem
), ge AS (
  SELECT l_orderkey, l_orderkey || '_' || no AS gene, no, l_returnflag, l_linestatus, l_quantity, l_partkey % 7 <> 0 AS supported,
         list_distinct(list_filter([{', '.join(f"CASE WHEN (l_partkey * {2 * k + 3} + l_suppkey * {k + 1}) % 7 = 0 THEN '{p}' END" for k, p in enumerate(PF))}], lambda x: x IS NOT NULL)) AS pf
  FROM z
)"""


def line_genes(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    no = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    pf = F.array_compact(F.array(*(F.when((F.col("l_partkey") * (2 * k + 3) + F.col("l_suppkey") * (k + 1)) % 7 == 0, p) for k, p in enumerate(PF))))
    texts = F.create_map(*(F.lit(x) for kv in TEXTS.items() for x in kv))
    empty = F.array().cast("array<string>")
    return l.withColumn("no", no).select(
        F.col("l_orderkey").alias("locus_id"),
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("no").cast("string")).alias("gene_accession"),
        (F.col("no") - 3).alias("relative_index"),
        ((F.col("no") - 3) * 900).cast("long").alias("relative_start"),
        ((F.col("no") - 3) * 900 + F.col("l_quantity") * 10).cast("long").alias("relative_stop"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        texts[F.col("l_returnflag")].alias("product_description"),
        pf.alias("pfam_ids"),
        empty.alias("pfam_descriptions"),
        F.when(F.col("l_partkey") % 7 != 0, F.array(F.lit("IPR1"))).otherwise(empty).alias("interpro_ids"),
        empty.alias("interpro_descriptions"),
        F.lit("metabolic").alias("functional_class"),
        F.lit("none").alias("regulator_class"),
        F.when(F.col("l_quantity") > 40, F.array(F.lit("GAF"))).otherwise(empty).alias("sensory_domains"),
        (F.col("no") == 3).alias("is_anchor"),
        F.lit(False).alias("is_regulator_candidate"),
    )


def _has(p: str) -> str:
    return f"list_contains(pf, '{p}')"


_CLASS = """
(SELECT c FROM (VALUES
   (CASE WHEN {rr} THEN 1.0 END, 10, 'two_component_rr'), (CASE WHEN {hk} THEN 1.0 END, 9, 'two_component_hk'), (CASE WHEN {si} THEN 1.0 END, 8, 'sigma'),
   (CASE WHEN {a} AND {b} THEN 2.0 END, 100, 'one_component'), (CASE WHEN {s54} THEN 2.0 + 0.5 * {o54}::INT END, 99, 'sigma54_activator'),
   (CASE WHEN {a} THEN 2.0 + 0.5 * {b}::INT END, 98, 'one_component'), (CASE WHEN {ly} THEN 2.0 END, 97, 'one_component'),
   (CASE WHEN {rr} THEN 2.0 END, 96, 'two_component_rr'), (CASE WHEN {hk} THEN 2.0 END, 95, 'two_component_hk')) v(s, p, c)
 WHERE s IS NOT NULL ORDER BY s DESC, p DESC LIMIT 1)""".format(rr=_has("PF00072"), hk=_has("PF00512"), si=_has("PF04542"), a=_has("PF00027"), b=_has("PF00325"), s54=_has("PF00158"), o54=_has("PF02954"), ly=_has("PF00126"))
CLASS_SQL = f"""
{GENE_SQL}, cl AS (SELECT *, coalesce({_CLASS}, 'none') AS dom FROM ge), cc AS (
  SELECT *, CASE WHEN dom = 'none' AND (len(pf) > 0 OR supported) THEN CASE l_returnflag WHEN 'A' THEN 'one_component' WHEN 'N' THEN 'two_component_hk' ELSE 'none' END ELSE dom END AS cls FROM cl
)"""


@query(f"""WITH {CLASS_SQL} SELECT gene AS gene_accession, cls AS regulator_class, cls <> 'none' AS is_regulator_candidate,
CASE WHEN no = 3 THEN 'anchor' WHEN cls <> 'none' THEN 'regulator' ELSE 'metabolic' END AS functional_class FROM cc""")
def regulator_class(spark, sf_dir):
    return annotate.classify_regulators(line_genes(spark, sf_dir), RULES).select("gene_accession", "regulator_class", "is_regulator_candidate", "functional_class")


ROLE_SQL = f"""
{CLASS_SQL}, ev AS (
  SELECT *, {_has('PF00989')} OR {_has('PF01590')} OR {_has('PF07700')} AS evid,
    list_sort(list_distinct(list_filter([CASE WHEN {_has('PF01590')} THEN 'cnmp' END, CASE WHEN {_has('PF07700')} THEN 'heme' END,
      CASE WHEN {_has('PF00989')} AND ({_has('PF00512')} OR {_has('PF00158')}) THEN 'flavin' END], lambda x: x IS NOT NULL))) AS chem
  FROM cc
), ro AS (
  SELECT *, CASE WHEN no = 3 THEN 'anchor' WHEN dom = 'two_component_hk' AND evid THEN 'sensor' WHEN evid AND dom <> 'none' THEN 'both' WHEN dom <> 'none' THEN 'regulator'
                 WHEN evid THEN 'sensor' ELSE 'accessory' END AS role0, dom = 'none' AND cls <> 'none' AS resc FROM ev
), rl AS (
  SELECT *, CASE WHEN resc AND role0 = 'sensor' THEN 'both' WHEN resc AND role0 IN ('accessory', 'none') THEN 'regulator' ELSE role0 END AS sensor_role,
         CASE WHEN resc THEN cls ELSE dom END AS rcls FROM ro
)"""


def role_genes(spark, sf_dir):
    return annotate.assign_sensor_roles(annotate.classify_regulators(line_genes(spark, sf_dir), RULES), RULES, SENSORS, PAIRED)


@query(f"WITH {ROLE_SQL} SELECT gene AS gene_accession, sensor_role, rcls AS regulator_class, sensor_role IN ('regulator', 'both') AS is_regulator_candidate FROM rl")
def sensor_roles(spark, sf_dir):
    return role_genes(spark, sf_dir).select("gene_accession", "sensor_role", "regulator_class", "is_regulator_candidate")


@query(f"""WITH {ROLE_SQL}, x AS (SELECT *, (no - 3) * 900 AS a, CAST((no - 3) * 900 + l_quantity * 10 AS BIGINT) AS b FROM rl), p AS (
  SELECT h.l_orderkey || '::' || h.gene || '::' || r.gene AS pair_id, c_mktsegment AS analyte, h.l_linestatus = r.l_linestatus AS co_strand, array_to_string(h.chem, '+') AS chemistries,
         CASE WHEN h.b <= r.a THEN r.a - h.b WHEN r.b <= h.a THEN h.a - r.b ELSE 0 END AS d
  FROM x h JOIN x r ON h.l_orderkey = r.l_orderkey AND h.rcls = 'two_component_hk' AND h.sensor_role IN ('sensor', 'both') AND r.rcls = 'two_component_rr' AND r.sensor_role IN ('regulator', 'both')
  LEFT JOIN orders ON o_orderkey = h.l_orderkey LEFT JOIN customer ON c_custkey = o_custkey)
SELECT pair_id, analyte, co_strand, chemistries, CAST(d AS BIGINT) AS intergenic_distance_nt, round(1.0::DOUBLE / (1 + d), 6) AS pair_score FROM p""")
def sensor_pairs(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("locus_id"), F.col("c_mktsegment").alias("analyte"))
    p = annotate.sensor_regulator_pairs(role_genes(spark, sf_dir), o, SENSORS, PAIRED)
    return p.select("pair_id", "analyte", "co_strand", F.array_join("hk_sensory_chemistries", "+").alias("chemistries"), "intergenic_distance_nt", r6("pair_score").alias("pair_score"))


@query("""
WITH s AS (SELECT l_orderkey, l_partkey, p_type, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS no
  FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT l_orderkey, p_type, min(no) AS f FROM s GROUP BY ALL), b AS (SELECT l_orderkey, p_brand, min(no) AS f FROM s GROUP BY ALL)
SELECT l_orderkey, (SELECT string_agg(p_type, '|' ORDER BY f) FROM t WHERE t.l_orderkey = o.l_orderkey) AS types, (SELECT string_agg(p_brand, '|' ORDER BY f) FROM b WHERE b.l_orderkey = o.l_orderkey) AS brands
FROM (SELECT DISTINCT l_orderkey FROM s) o
""")
def domain_lists(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = annotate.ordered_distinct(rows, ["l_orderkey"], order, ["p_type", "p_brand"])
    return out.select("l_orderkey", F.array_join("p_type", "|").alias("types"), F.array_join("p_brand", "|").alias("brands"))


# ---------------------------------------------------------------- scores

WEIGHTS = {"anchor_marker": 3.0, "accessory_marker": 1.0, "operon_integrity": 1.5, "homology_confidence": 1.0, "taxonomic_context": 0.5, "neighborhood_completeness": 0.5}
THRESHOLDS = {"high": 6.0, "medium": 3.5, "low": 1.5}
CANDIDATE_WEIGHTS = {"locus": 1.0, "regulator_domain": 1.5, "sensory_domain": 2.0, "proximity": 1.0, "archetype_conservation": 1.5, "enrichment": 2.0, "taxonomic_breadth": 0.5, "phylogenetic_profile": 1.25, "structural_plausibility": 0.0}
EXPECTED = {"BUILDING": ["heme"], "MACHINERY": ["cnmp", "flavin"]}
LOCI_SQL = """
lo AS (
  SELECT o_orderkey, c_mktsegment, c_name, c_nationkey, c_acctbal,
    3.0 * (o_orderstatus = 'F')::INT + least(len(string_split(o_orderpriority, ' ')), 3) * 1.0 + 1.5 * (o_orderkey % 5) / 4.0::DOUBLE
    + 1.0 + 0.5 * (c_nationkey % 2) + 0.5 * (o_orderkey % 3 <> 0)::INT AS locus_score
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def scored_loci(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    loci = o.select(
        F.col("o_orderkey").alias("locus_id"),
        F.col("c_mktsegment").alias("analyte"),
        F.col("c_name").alias("organism"),
        F.col("c_nationkey").alias("cluster_id"),
        F.lit("x").alias("anchor_family"),
        F.col("c_name").alias("anchor_accession"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")).alias("marker_genes_present"),
        F.split("o_orderpriority", " ").alias("accessory_genes_present"),
        ((F.col("o_orderkey") % 5) / 4.0).alias("operon_integrity_score"),
        (F.col("c_nationkey") % 2).cast("double").alias("taxonomic_context_score"),
        (F.col("o_orderkey") % 3 == 0).alias("is_boundary_truncated"),
    )
    return scoring.score_loci(loci, WEIGHTS, THRESHOLDS)


@query(f"WITH {LOCI_SQL} SELECT o_orderkey AS locus_id, round(locus_score, 6) AS locus_score, CASE WHEN locus_score >= 6 THEN 'high' WHEN locus_score >= 3.5 THEN 'medium' WHEN locus_score >= 1.5 THEN 'low' ELSE 'control' END AS locus_confidence FROM lo")
def locus_scores(spark, sf_dir):
    return scored_loci(spark, sf_dir).select("locus_id", r6("locus_score").alias("locus_score"), "locus_confidence")


ENRICH = [("regulator_class", "one_component", 4.0, 0.01), ("regulator_class", "two_component_rr", 16.0, 0.04), ("sensory_domain", "GAF", 1.5, 0.2), ("regulator_class", "sigma", float("inf"), 0.001)]
CANDIDATES_SQL = f"""
{ROLE_SQL}, {LOCI_SQL}, ca AS (
  SELECT *, no - 3 AS idx, (no - 3) * 900 AS a, CAST((no - 3) * 900 + l_quantity * 10 AS BIGINT) AS b,
    list_sort(list_distinct(list_concat(chem, CASE WHEN l_quantity > 40 THEN ['cnmp'] ELSE [] END))) AS ch,
    CASE c_mktsegment WHEN 'BUILDING' THEN ['heme'] WHEN 'MACHINERY' THEN ['cnmp', 'flavin'] ELSE [] END AS expected
  FROM rl JOIN lo ON o_orderkey = l_orderkey WHERE sensor_role IN ('regulator', 'both')
), cs AS (
  SELECT *, len(list_filter(ch, lambda x: list_contains(expected, x))) AS hits, list_filter(ch, lambda x: list_contains(expected, x)) AS hit_list,
    CASE WHEN {' OR '.join(_has(p) for p in PF if p in S.DNA_BINDING_CANDIDATE)} THEN 1.0 WHEN rcls IN ('two_component_rr', 'two_component_hk', 'sigma54_activator') THEN 0.75 ELSE 0.25 END AS dom_score,
    CASE rcls WHEN 'one_component' THEN 2.0 WHEN 'two_component_rr' THEN 3.0 WHEN 'sigma' THEN 3.0 ELSE 0.0 END AS enr
  FROM ca
), cf AS (
  SELECT *, CASE WHEN len(ch) = 0 THEN 0.0 WHEN hits > 0 THEN least(hits, 2) ELSE 0.25 END AS sens FROM cs
)
SELECT l_orderkey || '::' || gene AS candidate_id, CASE WHEN idx < 0 THEN 'upstream' WHEN idx > 0 THEN 'downstream' ELSE 'internal' END AS position, CAST(least(abs(a), abs(b)) AS BIGINT) AS distance_nt,
  CASE WHEN len(ch) = 0 THEN 'none' WHEN hits > 0 THEN hit_list[1] ELSE ch[1] END AS primary_sensory_chemistry,
  round(locus_score + 1.5 * dom_score + 2.0 * sens + 1.0::DOUBLE / (1 + abs(idx)) + 2.0 * enr, 6) AS candidate_score
FROM cf"""


def candidate_rows(spark, sf_dir):
    enrichment = spark.createDataFrame(ENRICH, "feature_type string, feature_name string, odds_ratio double, q_value double")
    return scoring.score_candidates(scored_loci(spark, sf_dir), role_genes(spark, sf_dir), CANDIDATE_WEIGHTS, SENSORS, PAIRED, EXPECTED, enrichment)


@query(f"WITH {CANDIDATES_SQL}")
def candidates(spark, sf_dir):
    return candidate_rows(spark, sf_dir).select("candidate_id", "position", "distance_nt", "primary_sensory_chemistry", r6("candidate_score").alias("candidate_score"))


_ENTROPY = "(SELECT sum(CASE WHEN v > 0 THEN -(v / n::DOUBLE) * log2(v / n::DOUBLE) ELSE 0 END) FROM unnest([{}]) u(v))"
CANDIDATE_ROWS_SQL = CANDIDATES_SQL[: CANDIDATES_SQL.index(", cs AS (")]


@query(f"""WITH {CANDIDATE_ROWS_SQL},
org AS (SELECT count(DISTINCT c_name) AS n FROM lo), m AS (SELECT c_mktsegment, count(DISTINCT c_name) AS mark FROM lo GROUP BY 1),
h AS (SELECT c_mktsegment, rcls, count(DISTINCT c_name) AS n11 FROM ca GROUP BY ALL),
x AS (SELECT c_mktsegment, rcls, n, n11, 0 AS n10, mark - n11 AS n01, n - mark AS n00 FROM h JOIN m USING (c_mktsegment), org),
e AS (SELECT *, {_ENTROPY.format('n11 + n10, n01 + n00')} AS hx, {_ENTROPY.format('n11 + n01, n10 + n00')} AS hy, {_ENTROPY.format('n11, n10, n01, n00')} AS hxy FROM x)
SELECT l_orderkey || '::' || gene AS candidate_id, round(CASE WHEN hx > 0 AND hy > 0 THEN greatest(0, least(1, (hx + hy - hxy) / least(hx, hy))) ELSE 0 END, 6) AS phylogenetic_profile_score
FROM ca JOIN e USING (c_mktsegment, rcls)""")
def candidate_profiles(spark, sf_dir):
    """Candidates with the mutual information of their class and their analyte over organisms, by bitmaps."""
    rows = candidate_rows(spark, sf_dir).select("candidate_id", "analyte", "regulator_class", "organism")
    scored = stats.profile_scores(rows, scored_loci(spark, sf_dir))
    return scored.select("candidate_id", r6("phylogenetic_profile_score").alias("phylogenetic_profile_score"))


@query(f"""WITH {LOCI_SQL} SELECT o_orderkey AS locus_id, round(greatest(0.001, least(0.999, 1.0::DOUBLE / (1 + exp(-(locus_score - 6) / 2)))), 6) AS logit FROM lo""")
def logit_scores(spark, sf_dir):
    return scored_loci(spark, sf_dir).select("locus_id", r6(S.logit_score(F.col("locus_score"))).alias("logit"))


# I_x(a, b) by its power series on the side of the mean where that converges fast; quantiles by bisection
_SERIES = "exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma(a + b) - lgamma({a} + 1) - lgamma({b})) * list_sum(list_transform(range(300), lambda n: exp(lgamma(a + b + n) - lgamma(a + b) - lgamma({a} + 1 + n) + lgamma({a} + 1) + n * ln({x}))))"
BANDS_SQL = f"""WITH RECURSIVE {LOCI_SQL}, s AS (SELECT round(locus_score, 6)::DOUBLE AS locus_score, count(*) AS n_loci FROM lo GROUP BY 1),
g AS (SELECT *, greatest(0.001, least(0.999, 1 / (1 + exp(-(locus_score - 6) / 2)))) AS p FROM s),
q(locus_score, n_loci, p, a, b, tail, low, high, k) AS (
  SELECT locus_score, n_loci, p, 24 * p, 24 * (1 - p), unnest([0.03::DOUBLE, 0.97::DOUBLE]), 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM g
  UNION ALL
  SELECT locus_score, n_loci, p, a, b, tail, CASE WHEN c < tail THEN x ELSE low END, CASE WHEN c < tail THEN high ELSE x END, k + 1 FROM (
    SELECT *, CASE WHEN x <= (a + 1) / (a + b + 2) THEN {_SERIES.format(a='a', b='b', x='x')} ELSE 1 - {_SERIES.format(a='b', b='a', x='(1 - x)')} END AS c
    FROM (SELECT *, (low + high) / 2 AS x FROM q WHERE k < 40)))
SELECT locus_score, any_value(n_loci) AS n_loci, round(any_value(p), 5) AS regulation_logit_score, round(max(low) FILTER (tail < 0.5), 5) AS score_band_low,
       round(max(low) FILTER (tail > 0.5), 5) AS score_band_high, 'logit_beta' AS score_band_model FROM q WHERE k = 40 GROUP BY locus_score"""


@query(BANDS_SQL)
def score_bands(spark, sf_dir):
    distinct = scored_loci(spark, sf_dir).groupBy(F.round("locus_score", 6).alias("locus_score")).agg(F.count("*").alias("n_loci"))
    bands = stats.score_bands(distinct, "locus_score")
    return bands.withColumns({c: F.round(c, 5) for c in ("regulation_logit_score", "score_band_low", "score_band_high")})


@query(f"""WITH {LOCI_SQL}, m AS (SELECT l_orderkey, max(l_quantity)::DOUBLE AS best FROM lineitem GROUP BY 1),
b AS (SELECT c_mktsegment AS analyte, o_orderkey, locus_score, c_nationkey, c_name, coalesce(best, 0) AS best FROM lo LEFT JOIN m ON l_orderkey = o_orderkey),
k AS (SELECT c_mktsegment AS analyte, c_nationkey, l_returnflag, count(*) AS n FROM lineitem JOIN lo ON l_orderkey = o_orderkey GROUP BY ALL),
t AS (SELECT analyte, c_nationkey, arg_min(l_returnflag, (-n, l_returnflag)) AS top FROM k GROUP BY ALL)
SELECT analyte, c_nationkey, count(*) AS n_loci, count(DISTINCT c_name) AS n_taxa, arg_min(o_orderkey, (-locus_score, o_orderkey)) AS representative, coalesce(any_value(top), 'none') AS dominant_class,
  round(avg(locus_score), 6) AS mean_locus_score, round(avg(best), 6) AS mean_candidate_score FROM b LEFT JOIN t USING (analyte, c_nationkey) GROUP BY ALL""")
def archetype_summary(spark, sf_dir):
    loci = scored_loci(spark, sf_dir).withColumn("c_nationkey", F.col("cluster_id"))
    genes = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("locus_id"), F.col("l_returnflag").alias("k"), F.col("l_quantity").cast("double").alias("s"))
    s = scoring.archetype_summary(loci, genes, ["analyte", "c_nationkey"], "locus_id", "locus_score", "organism", "k", "s")
    return s.select("analyte", "c_nationkey", "n_loci", "n_taxa", "representative", "dominant_class", r6("mean_locus_score").alias("mean_locus_score"), r6("mean_candidate_score").alias("mean_candidate_score"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS arch, c_mktsegment AS analyte, c_nationkey,
    CASE WHEN c_nationkey % 4 = 0 THEN '' ELSE n_name END AS genus, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE r_name END AS family, CAST(c_nationkey AS VARCHAR) AS phylum
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT arch, count(DISTINCT l_orderkey) AS n, count(DISTINCT nullif(genus, '')) AS gg, count(DISTINCT nullif(coalesce(family, ''), '')) AS gf, count(DISTINCT genus) AS g, count(DISTINCT coalesce(family, '')) AS f, count(DISTINCT phylum) AS p FROM c WHERE arch <> '' GROUP BY arch),
p AS (SELECT arch, analyte, l_linenumber, l_returnflag, count(*) AS hits FROM c WHERE arch <> '' GROUP BY ALL)
SELECT DISTINCT c.arch, c.analyte, c.l_linenumber, c.l_returnflag,
  round(CASE WHEN n >= 3 AND greatest(gg, gf) >= 3 THEN (least(1, g / n::DOUBLE) * least(1, f / n::DOUBLE) * least(1, hits / n::DOUBLE)) ** (1 / 3.0::DOUBLE) ELSE 0 END, 6) AS conservation,
  round(CASE WHEN n >= 3 AND greatest(gg, gf) >= 3 THEN least(1, p / 30.0::DOUBLE) ELSE 0 END, 6) AS breadth
FROM c LEFT JOIN s USING (arch) LEFT JOIN p USING (arch, analyte, l_linenumber, l_returnflag)
""")
def conservation(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    loci = o.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("arch"), F.col("c_mktsegment").alias("analyte"), F.when(F.col("c_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("genus"), F.when(F.col("c_nationkey") % 5 != 0, F.col("r_name")).alias("family"), F.col("c_nationkey").cast("string").alias("phylum"))
    cands = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").join(loci.select("l_orderkey", "arch", "analyte"), "l_orderkey")
    out = scoring.conservation(cands, loci.drop("arch", "analyte"), "l_orderkey", "arch", "analyte", "l_linenumber", "l_returnflag", "genus", "family", "phylum")
    return out.select("arch", "analyte", "l_linenumber", "l_returnflag", r6("archetype_conservation_score").alias("conservation"), r6("taxonomic_breadth_score").alias("breadth")).distinct()


# ---------------------------------------------------------------- statistics

ENRICHMENT_ROWS = "e AS (SELECT o_orderkey, c_mktsegment, n_name, l_returnflag || l_linestatus || (l_linenumber % 4) AS feature FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))"
COUNTS_SQL = f"""{ENRICHMENT_ROWS}, t AS (SELECT count(DISTINCT o_orderkey) FILTER (c_mktsegment = 'BUILDING') AS n1, count(DISTINCT o_orderkey) FILTER (c_mktsegment = 'MACHINERY') AS n0 FROM e),
k AS (SELECT feature, count(DISTINCT o_orderkey) FILTER (c_mktsegment = 'BUILDING') AS a, count(DISTINCT o_orderkey) FILTER (c_mktsegment = 'MACHINERY') AS c FROM e GROUP BY feature),
w AS (SELECT feature, a, n1 - a AS b, c, n0 - c AS d FROM k, t)"""


def enrichment_rows(spark, sf_dir):
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    n, m = tasks_for(spark, orders.count()), tasks_for(spark, lines.count())
    c = read(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).repartition(n, "c_custkey")
    o = orders.repartition(n, "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    feature = F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 4).cast("string"))
    o = o.select("o_orderkey", "c_mktsegment", "n_name", "o_totalprice").repartition(m, "o_orderkey")
    return lines.select("l_orderkey", feature.alias("feature")).repartition(m, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "c_mktsegment", "n_name", "o_totalprice", "feature")


def is_case() -> Column:
    return F.col("c_mktsegment") == "BUILDING"


@query(f"WITH {COUNTS_SQL} SELECT feature, a, b, c, d FROM w")
def enrichment_counts(spark, sf_dir):
    return stats.contingency(enrichment_rows(spark, sf_dir), ["feature"], "o_orderkey", is_case())


_LG = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
FISHER_SQL = f"""WITH {COUNTS_SQL}, x AS (
  SELECT feature, a, b, c, d, a + b AS r, c + d AS s, a + c AS m, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS i FROM w
), y AS (
  SELECT *, {_LG.format('r', 'i')} + {_LG.format('s', '(m - i)')} - {_LG.format('(r + s)', 'm')} AS lp, {_LG.format('r', 'a')} + {_LG.format('s', '(m - a)')} - {_LG.format('(r + s)', 'm')} AS here FROM x
), z AS (
  SELECT feature, a, b, c, d, least(1.0, sum(exp(lp)) FILTER (lp <= here + 1e-7)) AS p FROM y GROUP BY ALL
), q AS (
  SELECT *, p * count(*) OVER () / max(rk) OVER (PARTITION BY p) AS adj FROM (SELECT *, row_number() OVER (ORDER BY p) AS rk FROM z)
)
SELECT feature, round(a * d / (b * c)::DOUBLE, 6) AS odds_ratio, round(p, 6) AS p_value, round(least(1.0, min(adj) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM q"""


@query(FISHER_SQL)
def fisher_bh(spark, sf_dir):
    tested = stats.benjamini_hochberg(stats.fisher(stats.contingency(enrichment_rows(spark, sf_dir), ["feature"], "o_orderkey", is_case())))
    return tested.select("feature", r6("odds_ratio").alias("odds_ratio"), r6("p_value").alias("p_value"), r6("q_value").alias("q_value"))


STRATA_SQL = f"""{ENRICHMENT_ROWS}, t AS (SELECT n_name, count(DISTINCT o_orderkey) FILTER (c_mktsegment = 'BUILDING') AS n1, count(DISTINCT o_orderkey) FILTER (c_mktsegment = 'MACHINERY') AS n0 FROM e GROUP BY n_name),
k AS (SELECT feature, n_name, count(DISTINCT o_orderkey) FILTER (c_mktsegment = 'BUILDING') AS a, count(DISTINCT o_orderkey) FILTER (c_mktsegment = 'MACHINERY') AS c FROM e GROUP BY ALL),
w AS (SELECT f.feature, t.n_name, coalesce(a, 0) AS a, n1 - coalesce(a, 0) AS b, coalesce(c, 0) AS c, n0 - coalesce(c, 0) AS d FROM (SELECT DISTINCT feature FROM e) f CROSS JOIN t LEFT JOIN k ON k.feature = f.feature AND k.n_name = t.n_name),
v AS (SELECT feature, a + h AS a, b + h AS b, c + h AS c, d + h AS d, a + b + c + d + 4 * h AS n FROM (SELECT *, CASE WHEN a * b * c * d = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS h FROM w WHERE a + b + c + d > 0))"""


# a chi-square tail with one degree of freedom is the complementary error function: its continued fraction, evaluated from the end
_TAIL = "0.0"
for _k in range(60, 0, -1):
    _TAIL = f"({_k} / 2.0::DOUBLE / (z + {_TAIL}))"
CMH_BH_SQL = f"""WITH {STRATA_SQL}, m AS (
  SELECT feature, (abs(sum(a - (a + b) * (a + c) / n)) - 0.5) ** 2 / sum((a + b) * (a + c) * (b + d) * (c + d) / (n * n * (n - 1))) AS statistic, sum(a * d / n) / sum(b * c / n) AS odds_ratio FROM v GROUP BY feature
), i AS (SELECT *, sqrt(statistic / 2) AS z FROM m),
s AS (SELECT feature, z, unnest(range(0, 60)) AS k FROM i),
y AS (SELECT feature, sum(power(-1.0::DOUBLE, k) * power(z, 2 * k + 1) / ((2 * k + 1) * exp(lgamma(k + 1)))) * 2 / sqrt(pi()) AS erf FROM s GROUP BY feature),
p AS (SELECT feature, statistic, odds_ratio, CASE WHEN z < 2 THEN 1 - erf ELSE exp(-z * z) / sqrt(pi()) / (z + {_TAIL}) END AS p FROM i JOIN y USING (feature)),
q AS (SELECT *, p * count(*) OVER () / max(rk) OVER (PARTITION BY p) AS adj FROM (SELECT *, row_number() OVER (ORDER BY p) AS rk FROM p)),
w2 AS (SELECT *, least(1.0, min(adj) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM q)
SELECT feature, round(statistic, 6) AS statistic, round(odds_ratio, 6) AS odds_ratio, round(p, 6) AS p_value, round(q, 6) AS q_value, CASE WHEN q <= 0.05 THEN 'enriched' ELSE 'not_enriched' END AS interpretation FROM w2"""


@query(f"WITH {STRATA_SQL} SELECT feature, round((abs(sum(a - (a + b) * (a + c) / n)) - 0.5) ** 2 / sum((a + b) * (a + c) * (b + d) * (c + d) / (n * n * (n - 1))), 6) AS statistic, round(sum(a * d / n) / sum(b * c / n), 6) AS odds_ratio FROM v GROUP BY feature")
def cmh_stratified(spark, sf_dir):
    t = stats.stratified(enrichment_rows(spark, sf_dir), ["feature"], "o_orderkey", is_case(), ["n_name"])
    return t.select("feature", r6("statistic").alias("statistic"), r6("odds_ratio").alias("odds_ratio"))


@query(CMH_BH_SQL)
def cmh_bh(spark, sf_dir):
    t = stats.stratified(enrichment_rows(spark, sf_dir), ["feature"], "o_orderkey", is_case(), ["n_name"])
    return stats.benjamini_hochberg(t).select("feature", r6("statistic").alias("statistic"), r6("odds_ratio").alias("odds_ratio"), r6("p_value").alias("p_value"), r6("q_value").alias("q_value"), "interpretation")


@query("""
WITH e AS (SELECT o_orderkey, o_totalprice, c_mktsegment, n_name, l_returnflag || l_linestatus || (l_linenumber % 4) AS feature FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
o AS (SELECT o_orderkey FROM (SELECT DISTINCT o_orderkey, o_totalprice, c_mktsegment, n_name FROM e) QUALIFY row_number() OVER (PARTITION BY c_mktsegment, n_name ORDER BY o_totalprice DESC, o_orderkey) = 1),
p AS (SELECT 'none' AS policy, * FROM e UNION ALL SELECT 'one_per_genus', e.* FROM e JOIN o USING (o_orderkey))
SELECT policy, feature, count(DISTINCT o_orderkey) FILTER (c_mktsegment = 'BUILDING') AS n_case, count(DISTINCT o_orderkey) FILTER (c_mktsegment = 'MACHINERY') AS n_control FROM p GROUP BY ALL
""")
def robustness_counts(spark, sf_dir):
    rows = stats.under_policies(enrichment_rows(spark, sf_dir), "o_orderkey", "c_mktsegment", {"none": None, "one_per_genus": "n_name"}, "o_totalprice")
    one = rows.select("policy", "feature", "o_orderkey", "c_mktsegment").distinct()
    return one.groupBy("policy", "feature").agg(F.count_if(is_case()).alias("n_case"), F.count_if(~is_case()).alias("n_control"))


@query("""
WITH org AS (SELECT c_custkey, c_acctbal > 5000 AS m FROM customer), h AS (SELECT DISTINCT o_custkey AS c_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'),
k AS (SELECT o_orderpriority, count(*) FILTER (m) AS n11, count(*) FILTER (NOT m) AS n10 FROM h JOIN org USING (c_custkey) GROUP BY 1),
x AS (SELECT o_orderpriority, n11, n10, (SELECT count(*) FROM org WHERE m) - n11 AS n01, (SELECT count(*) FROM org) AS n FROM k), y AS (SELECT *, n - n11 - n10 - n01 AS n00 FROM x),
z AS (SELECT o_orderpriority, n11, n10, n01, n00, (SELECT sum(CASE WHEN v > 0 THEN -(v / n::DOUBLE) * log2(v / n::DOUBLE) ELSE 0 END) FROM unnest([n11 + n10, n01 + n00]) u(v)) AS hx,
  (SELECT sum(CASE WHEN v > 0 THEN -(v / n::DOUBLE) * log2(v / n::DOUBLE) ELSE 0 END) FROM unnest([n11 + n01, n10 + n00]) u(v)) AS hy,
  (SELECT sum(CASE WHEN v > 0 THEN -(v / n::DOUBLE) * log2(v / n::DOUBLE) ELSE 0 END) FROM unnest([n11, n10, n01, n00]) u(v)) AS hxy FROM y)
SELECT o_orderpriority, n11, n10, n01, n00, round(CASE WHEN hx > 0 AND hy > 0 THEN greatest(0, least(1, (hx + hy - hxy) / least(hx, hy))) ELSE 0 END, 6) AS mi FROM z
""")
def profile_mi(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    present = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").join(c.select("c_custkey"), "c_custkey", "left_semi")
    n = stats.presence_counts(c, present, c.where("c_acctbal > 5000"), "c_custkey", ["o_orderpriority"])
    return n.withColumn("mi", r6(stats.normalized_mutual_information(*(F.col(x) for x in ("n11", "n10", "n01", "n00")))))


@query("""WITH o AS (SELECT c_mktsegment, o_orderpriority, count(*)::DOUBLE AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
e AS (SELECT *, sum(o) OVER (PARTITION BY c_mktsegment) * sum(o) OVER (PARTITION BY o_orderpriority) / sum(o) OVER () AS e FROM o)
SELECT round(sum((o - e) ** 2 / e), 6) AS statistic, (count(DISTINCT c_mktsegment) - 1) * (count(DISTINCT o_orderpriority) - 1) AS dof FROM e""")
def chi_square(spark, sf_dir):
    n = partition_rows(spark, sf_dir)
    return stats.chi_square(n, "c_mktsegment", "o_orderpriority", "n").select(r6("statistic").alias("statistic"), F.col("dof").cast("long").alias("dof"))


def partition_rows(spark, sf_dir):
    return read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def partition_counts(spark, sf_dir):
    return partition_rows(spark, sf_dir)


@query("""
WITH c AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) - 1 AS k FROM orders WHERE o_totalprice > 400000),
p AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, floor((row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5('controls:' || o_orderkey), o_orderkey) - 1) / 3) AS k FROM orders WHERE o_totalprice < 200000)
SELECT p.o_orderkey, c.o_orderkey AS case_id FROM p JOIN c USING (o_orderstatus, o_orderpriority, k)
""")
def matched_controls(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return stats.matched_controls(o.where("o_totalprice < 200000"), o.where("o_totalprice > 400000"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", 3).select("o_orderkey", "case_id")


# ---------------------------------------------------------------- evaluation


@query("""
WITH t AS (SELECT n_nationkey AS id, n_name AS needle, CASE WHEN n_nationkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS segment, n_nationkey % 5 = 0 AS negative FROM nation),
h AS (SELECT c_mktsegment, 'x nation_' || (c_custkey % 17) || ' ' || c_name AS hay FROM customer),
r AS (SELECT id, negative, EXISTS (SELECT 1 FROM h WHERE (negative OR segment = c_mktsegment) AND contains(lower(hay), lower(needle))) AS recovered FROM t)
SELECT id, recovered, CASE WHEN negative THEN NOT recovered ELSE recovered END AS hit FROM r
""")
def benchmark_recovery(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    truth = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("needle"), F.when(F.col("n_nationkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("segment"), (F.col("n_nationkey") % 5 == 0).alias("negative"))
    hits = read(spark, sf_dir, "customer").select("c_mktsegment", F.concat(F.lit("x nation_"), (F.col("c_custkey") % 17).cast("string"), F.lit(" "), "c_name").alias("hay"))
    return evaluate.recovery(truth, hits, "id", ["needle"], "hay", [("segment", "c_mktsegment")], "negative").select("id", "recovered", "hit")


LABELLED = "l AS (SELECT doc_id, lang, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id))"


def labelled(spark, sf_dir):
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query(f"""WITH {LABELLED}, r AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM l)
SELECT round(avg(CASE WHEN toxic = 1 THEN (n_chars > 2000)::INT END), 6) AS positive_recall, round(avg(CASE WHEN toxic = 0 THEN (n_chars <= 2000)::INT END), 6) AS negative_fpr,
round(avg(CASE WHEN toxic = 1 THEN (rank <= 1)::INT END), 6) AS top_1_recall, round(avg(CASE WHEN toxic = 1 THEN (rank <= 5)::INT END), 6) AS top_5_recall, round(avg(CASE WHEN toxic = 1 THEN (rank <= 10)::INT END), 6) AS top_10_recall FROM r""")
def benchmark_summary(spark, sf_dir):
    rows = evaluate.ranks(labelled(spark, sf_dir), "n_chars", ["doc_id"])
    s = evaluate.summary(rows, F.col("toxic") == 1, F.col("n_chars") > 2000, F.col("rank"))
    return s.select(*(r6(c).alias(c) for c in s.columns))


@query(f"""WITH {LABELLED}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS rk FROM l),
s AS (SELECT lang, sum(rk) FILTER (toxic = 1) AS u, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS n FROM r GROUP BY lang)
SELECT lang, round((u - p * (p + 1) / 2.0::DOUBLE) / (p * n), 6) AS auroc FROM s""")
def auroc(spark, sf_dir):
    return evaluate.auroc(labelled(spark, sf_dir), "toxic", "n_chars", ["lang"]).select("lang", r6("auroc").alias("auroc"))


@query(f"""WITH {LABELLED}, r AS (SELECT *, row_number() OVER w AS rk, sum(toxic) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM l WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id))
SELECT lang, round(sum(CASE WHEN toxic = 1 THEN tp / rk::DOUBLE END) / count(*) FILTER (toxic = 1), 6) AS average_precision FROM r GROUP BY lang""")
def average_precision(spark, sf_dir):
    return evaluate.average_precision(labelled(spark, sf_dir), "toxic", "n_chars", ["doc_id"], ["lang"]).select("lang", r6("average_precision").alias("average_precision"))


@query("""WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT n FROM n ORDER BY n DESC, c_nationkey LIMIT 6)
SELECT CAST((SELECT sum(n) FROM t) AS BIGINT) AS top, CAST((SELECT sum(n) FROM n) AS BIGINT) AS total, round((SELECT sum(n) FROM t) / (SELECT sum(n) FROM n)::DOUBLE, 6) AS share""")
def caption_share(spark, sf_dir):
    n = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return evaluate.share_of_top(n, "n", [F.desc("n"), F.col("c_nationkey")], 6).withColumn("share", r6("share"))


# ---------------------------------------------------------------- sequences

DNA = "upper(regexp_replace(text, '[^acgtACGT]', '', 'g'))"


def dna(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^acgtACGT]", "")).alias("s"))


@query(f"SELECT item_id, translate(reverse({DNA}), 'ACGT', 'TGCA') AS rc FROM benchmark")
def revcomp(spark, sf_dir):
    return dna(spark, sf_dir).select("item_id", S.reverse_complement(F.col("s")).alias("rc"))


STRANDS = f"s AS (SELECT item_id, '+' AS strand, {DNA} AS s FROM benchmark UNION ALL SELECT item_id, '-', translate(reverse({DNA}), 'ACGT', 'TGCA') FROM benchmark)"


@query(f"""WITH {STRANDS}, i AS (SELECT item_id, strand, s, unnest(range(1, len(s) - 1)) AS i FROM s), m AS (SELECT item_id, strand, i, substr(s, i, 3) AS site FROM i)
SELECT item_id, strand, CAST(i AS INTEGER) AS "start", CAST(i + 2 AS INTEGER) AS "end", site FROM m WHERE site SIMILAR TO 'A[CT]G'""")
def iupac_scan(spark, sf_dir):
    return sequence.iupac_scan(dna(spark, sf_dir), ["item_id"], "s", "A-YG").select("item_id", "strand", "start", "end", "site")


PWM = [{"A": 0.7, "C": 0.1, "G": 0.1, "T": 0.1}, {"A": 0.05, "C": 0.05, "G": 0.05, "T": 0.85}, {"A": 0.25, "C": 0.5, "G": 0.25, "T": 0.0}]


def _pwm_case(k: int) -> str:
    return "CASE substr(site, {0}, 1) {1} END".format(k + 1, " ".join(f"WHEN '{b}' THEN log2({max(v, 1e-6)!r}::DOUBLE / 0.25::DOUBLE)" for b, v in PWM[k].items()))


@query(f"""WITH {STRANDS}, i AS (SELECT item_id, strand, s, unnest(range(1, len(s) - 1)) AS i FROM s WHERE len(s) >= 3), m AS (SELECT item_id, strand, i, substr(s, i, 3) AS site FROM i),
w AS (SELECT *, {' + '.join(_pwm_case(k) for k in range(3))} AS score FROM m)
SELECT item_id, strand, CAST(i AS INTEGER) AS "start", site, round(score, 6) AS score FROM w WHERE score >= 1.2""")
def pwm_scan(spark, sf_dir):
    return sequence.pwm_scan(dna(spark, sf_dir), ["item_id"], "s", PWM, 1.2).select("item_id", "strand", "start", "site", r6("score").alias("score"))


@query("""WITH c AS (SELECT i AS "column", substr(a, i, 1) AS r FROM (SELECT translate(lower(text), ' ', '-') AS a, unnest(range(1, len(text) + 1)) AS i FROM benchmark)),
m AS (SELECT "column", r, count(*) AS n FROM c WHERE r <> '-' GROUP BY "column", r), n AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS total FROM m)
SELECT CAST("column" AS INTEGER) AS "column", r AS residue, n AS n_residue, CAST(total AS BIGINT) AS n_residues, round(n / total::DOUBLE, 6) AS conservation FROM n QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, r) = 1""")
def msa_conservation(spark, sf_dir):
    a = read(spark, sf_dir, "benchmark").select(F.translate(F.lower("text"), " ", "-").alias("a"))
    return sequence.column_conservation(a, "a").select("column", "residue", "n_residue", "n_residues", r6("conservation").alias("conservation"))


RESCUE = """
s AS (SELECT 'f' || item_id AS family, text AS seed FROM benchmark), p AS (SELECT item_id, translate(text, 'gp', 'qk') AS q FROM benchmark),
j AS (SELECT item_id, family, q, seed, least(len(q), len(seed)) AS n FROM p CROSS JOIN s WHERE least(len(q), len(seed)) >= greatest(len(q), len(seed)) * 0.9),
m AS (SELECT item_id, family, q, (SELECT count(*) FROM unnest(range(1, n + 1)) u(i) WHERE substr(q, i, 1) = substr(seed, i, 1)) / n::DOUBLE AS identity, n / greatest(len(q), len(seed))::DOUBLE AS coverage FROM j)"""


def changed_items(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    seeds = b.select(F.lit("CO").alias("analyte"), F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("family"), F.col("text").alias("seed"))
    return b.select("item_id", F.translate("text", "gp", "qk").alias("q")), seeds


@query("""
WITH s(no, family, seed) AS (SELECT item_id, 'f' || item_id, text FROM benchmark), p AS (SELECT item_id, text AS q FROM benchmark),
j AS (SELECT item_id, family, no, q, seed, least(len(q), len(seed)) AS n FROM p CROSS JOIN s WHERE least(len(q), len(seed)) >= greatest(len(q), len(seed)) * 0.9)
SELECT item_id, family, round((SELECT count(*) FROM unnest(range(1, n + 1)) u(i) WHERE substr(q, i, 1) = substr(seed, i, 1)) / n::DOUBLE, 6) AS identity, round(n / greatest(len(q), len(seed))::DOUBLE, 6) AS coverage FROM j
""")
def seed_match(spark, sf_dir):
    """All pairs of like length, with their identity."""
    b = read(spark, sf_dir, "benchmark")
    p = b.select("item_id", F.col("text").alias("q"))
    seeds = b.select(F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("family"), F.col("text").alias("seed"))
    return anchors.seed_matches(p, seeds, "q", "seed", 0.0, 0.9).select("item_id", "family", r6("identity").alias("identity"), r6("coverage").alias("coverage"))


@query(f"""WITH {RESCUE} SELECT 'd' || (item_id % 3) AS dataset_name, 'CO' AS analyte, family AS anchor_family, CAST(item_id AS VARCHAR) AS protein_accession, round(identity, 6) AS identity, 'seed_back_confirmed' AS evidence_type
FROM m WHERE identity >= 0.95 AND (contains(lower(q), 'qe') OR contains(lower(q), 'the'))""")
def seed_rescue(spark, sf_dir):
    p, seeds = changed_items(spark, sf_dir)
    blank = F.lit(None).cast("string")
    p = p.select("q", F.format_string("d%d", F.col("item_id") % 3).alias("dataset_name"), F.col("item_id").cast("string").alias("protein_accession"), blank.alias("locus_tag"), blank.alias("gene"), F.col("q").alias("product"))
    terms = {r["family"]: ["qe", "the"] for r in seeds.select("family").toLocalIterator()}  # a configuration of guard terms
    out = anchors.seed_rescue(p, seeds, "q", "seed", ["product"], terms, 0.95, 0.9, "family")
    return out.select("dataset_name", "analyte", "anchor_family", "protein_accession", r6("identity").alias("identity"), "evidence_type")


@query("""
WITH s AS (SELECT item_id AS no, 'f' || item_id AS family, text AS seed FROM benchmark),
h AS (SELECT item_id, 'f' || (item_id - item_id % 2) AS family, text AS q FROM benchmark),
j AS (SELECT h.item_id, h.family, s.family AS best, s.no, least(len(q), len(seed)) AS n, least(len(q), len(seed)) / greatest(len(q), len(seed))::DOUBLE AS cov, q, seed FROM h CROSS JOIN s),
m AS (SELECT *, (SELECT count(*) FROM unnest(range(1, n + 1)) u(i) WHERE substr(q, i, 1) = substr(seed, i, 1)) / n::DOUBLE AS ident FROM j)
SELECT item_id, family, best AS best_family, round(ident, 6) AS identity, round(cov, 6) AS coverage, CASE WHEN best = family AND ident >= 0.95 AND cov >= 0.95 THEN 'seed_back_confirmed' ELSE 'profile_match' END AS evidence_type
FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ident DESC, cov DESC, no) = 1
""")
def back_confirm(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    seeds = b.select(F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("seed_family"), F.col("text").alias("seed"), F.col("item_id").alias("seed_no"))
    hits = b.select("item_id", F.concat(F.lit("f"), (F.col("item_id") - F.col("item_id") % 2).cast("string")).alias("family"), F.col("text").alias("q"))
    out = anchors.back_confirmed(hits, seeds, ["item_id"], "q", "seed", "family", "seed_family", "seed_no", 0.95, 0.95)
    return out.withColumn("identity", r6("identity")).withColumn("coverage", r6("coverage"))


@query("""
WITH RECURSIVE p AS MATERIALIZED (SELECT item_id, text AS a, substr(text, 5) AS b FROM benchmark),
m AS MATERIALIZED (
  SELECT item_id, 0 AS i, list_transform(range(length(b) + 1), lambda j: -2 * j) AS s FROM p
  UNION ALL
  SELECT item_id, CAST(i + 1 AS INTEGER), list(v ORDER BY j) FROM (
    SELECT item_id, i, j, max(best + 2 * j) OVER (PARTITION BY item_id ORDER BY j ROWS UNBOUNDED PRECEDING) - 2 * j AS v FROM (
      SELECT item_id, i, j, greatest(s[j + 1] - 2, CASE WHEN j > 0 THEN s[j] + CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN 2 ELSE -1 END END) AS best
      FROM (SELECT m.item_id, m.i, m.s, a, b, unnest(range(length(b) + 1)) AS j FROM m JOIN p USING (item_id) WHERE m.i < length(a)))) GROUP BY item_id, i),
t AS (
  SELECT item_id, CAST(length(a) AS BIGINT) AS i, CAST(length(b) AS BIGINT) AS j, 0 AS step, false AS pair FROM p
  UNION ALL
  SELECT item_id, i - (way > 0)::INT, j - (way <> 1)::INT, CAST(step + 1 AS INTEGER), way = 2 FROM (
    SELECT t.*, CASE WHEN t.i > 0 AND j > 0 AND x.s[j + 1] = y.s[j] + CASE WHEN substr(a, t.i, 1) = substr(b, j, 1) THEN 2 ELSE -1 END THEN 2
                     WHEN t.i > 0 AND x.s[j + 1] = y.s[j + 1] - 2 THEN 1 ELSE 0 END AS way
    FROM t JOIN p USING (item_id) JOIN m x ON x.item_id = t.item_id AND x.i = t.i LEFT JOIN m y ON y.item_id = t.item_id AND y.i = t.i - 1 WHERE t.i > 0 OR t.j > 0))
SELECT item_id, CAST(max(step) OVER (PARTITION BY item_id) - step + 1 AS INTEGER) AS alignment_index, CAST(i + 1 AS INTEGER) AS a_index, CAST(j + 1 AS INTEGER) AS b_index FROM t QUALIFY pair
""")
def residue_map(spark, sf_dir):
    p = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a"), F.expr("substring(text, 5)").alias("b"))
    return sequence.residue_map(p, ["item_id"], "a", "b")


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '#(.*)$', 1) AS fragment, 'p q+r' AS decoded, '2' AS kept FROM pages""")
def attribute_parse(spark, sf_dir):
    raw = F.concat(F.lit("scheme="), F.regexp_extract("url", "^([a-z]+)://", 1), F.lit(";a=1;fragment="), F.regexp_extract("url", "#(.*)$", 1), F.lit(";decoded=p%20q+r;a=2"))
    m = read(spark, sf_dir, "pages").select("page_id", S.attributes(raw).alias("m"))
    return m.select("page_id", *(F.col("m")[k].alias(k) for k in ("scheme", "fragment", "decoded")), F.col("m")["a"].alias("kept"))


@query("SELECT c_custkey, CASE WHEN contains(lower(c_name || ' ' || c_mktsegment), 'building') OR contains(lower(c_name || ' ' || c_mktsegment), '0000012') THEN true ELSE false END AS guarded FROM customer")
def family_guard(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", anchors.guard(["c_name", "c_mktsegment"], F.lit("x"), {"x": ["building", "0000012"]}).alias("guarded"))
