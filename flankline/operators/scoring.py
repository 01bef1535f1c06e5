"""Decomposable scores of loci and candidates, conservation, archetypes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flankline.functions import scalars as S
from flankline.operators import scans
from flankline.operators.annotate import once
from flankline.session import checkpoint_folder

LOCUS_COMPONENTS = {
    "anchor_marker": "anchor_marker_score",
    "accessory_marker": "accessory_marker_score",
    "operon_integrity": "operon_integrity_component_score",
    "homology_confidence": "homology_confidence_score",
    "taxonomic_context": "taxonomic_context_component_score",
    "neighborhood_completeness": "neighborhood_completeness_score",
}
CANDIDATE_COMPONENTS = {
    "locus": "locus_score",
    **{c: f"{c}_score" for c in ("regulator_domain", "sensory_domain", "proximity", "archetype_conservation", "enrichment", "taxonomic_breadth", "phylogenetic_profile", "structural_plausibility", "operator_motif", "embedding_similarity", "foldseek_similarity", "paired_sensor_evidence", "conservation_across_taxa")},
}


def score_loci(loci: DataFrame, weights: Mapping[str, float], thresholds: Mapping[str, float]) -> DataFrame:
    out = (
        loci.withColumn("anchor_marker_score", F.when(F.size("marker_genes_present") > 0, 1.0).otherwise(0.0))
        .withColumn("accessory_marker_score", F.least(F.size("accessory_genes_present").cast("double"), F.lit(3.0)))
        .withColumn("operon_integrity_component_score", F.col("operon_integrity_score").cast("double"))
        .withColumn("homology_confidence_score", F.when(F.length("anchor_accession") > 0, 1.0).otherwise(0.0))
        .withColumn("taxonomic_context_component_score", F.col("taxonomic_context_score").cast("double"))
        .withColumn("neighborhood_completeness_score", F.when(F.col("is_boundary_truncated"), 0.0).otherwise(1.0))
    )
    out = out.withColumn("locus_score", S.weighted_sum(weights, LOCUS_COMPONENTS, out.columns))
    ladder = F.when(F.col("locus_score") >= thresholds["high"], "high").when(F.col("locus_score") >= thresholds["medium"], "medium").when(F.col("locus_score") >= thresholds["low"], "low")
    return out.withColumn("locus_confidence", ladder.otherwise("control"))


def candidate_score(rows: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    return rows.withColumn("candidate_score", S.weighted_sum(weights, CANDIDATE_COMPONENTS, rows.columns))


def sensory_score(domains: Column, found: Column, expected: Column) -> tuple[Column, Column]:
    """(score, primary chemistry): expected chemistries count 1 each up to 2; only unexpected ones 0.25; none 0."""
    matches = F.array_intersect(found, expected)
    score = F.when(F.size(found) == 0, 0.0).when(F.size(matches) > 0, F.least(F.size(matches).cast("double"), F.lit(2.0))).otherwise(0.25)
    primary = F.when(F.size(found) == 0, "none").when(F.size(matches) > 0, F.get(matches, F.lit(0))).otherwise(F.get(found, F.lit(0)))
    return score, primary


def attach_enrichment(rows: DataFrame, key: str, features: Column, enrichment: DataFrame, cap: float, feature_key: Sequence[str] = ("feature_type", "feature_name")) -> DataFrame:
    """Best enrichment score and least q over a candidate's features (an array of structs with ``feature_key``). What is known of the features, a row
    for each, goes to the candidates as one map: they are looked up in their row and no candidate moves. ``key`` names the row."""
    scored = enrichment.select(*feature_key, S.enrichment_score(F.col("odds_ratio"), F.col("q_value"), cap).alias("__s"), "q_value")
    known = scored.dropna(subset=list(feature_key)).groupBy(*feature_key).agg(F.max("__s").alias("s"), F.min("q_value").alias("q"))
    entry = F.struct(F.struct(*feature_key), F.struct("s", "q"))
    one = known.agg(F.map_from_entries(F.collect_list(entry)).alias("__known"))  # one row
    asked = F.transform(features, lambda f: F.try_element_at(F.col("__known"), F.struct(*(f[c].alias(c) for c in feature_key))))
    out = once(rows.drop("enrichment_score", "candidate_score_q").crossJoin(F.broadcast(one)), __found=asked).drop("__known")
    least = F.array_min(F.transform("__found", lambda f: f["q"])).alias("candidate_score_q")
    best = F.coalesce(F.array_max(F.transform("__found", lambda f: f["s"])), F.lit(0.0)).alias("enrichment_score")
    return out.select("*", best, least).drop("__found")


def score_candidates(loci: DataFrame, genes: DataFrame, weights: Mapping[str, float], catalog: Sequence[Mapping] | None = None, rules: Sequence[Mapping] = (), expected: Mapping[str, Sequence[str]] | None = None, enrichment: DataFrame | None = None, cap: float = 3.0) -> DataFrame:
    """Regulator candidates near scored loci. A gene whose locus is missing is an error, found where the rows are used."""
    mine = genes.where("is_regulator_candidate")
    locus = loci.select("locus_id", "analyte", "organism", "cluster_id", "anchor_family", "locus_score", *(c for c in ("superkingdom",) if c in loci.columns))
    rows = mine.join(locus.withColumn("__known", F.lit(True)), "locus_id", "left")
    orphan = F.raise_error(F.concat(F.lit("no locus for candidate gene "), F.col("gene_accession"))).cast("boolean")
    rows = rows.where(F.when(F.col("__known"), True).otherwise(orphan)).drop("__known")
    domains, pfams = F.col("sensory_domains"), F.col("pfam_ids")
    if catalog is None or expected is None:
        score = F.least(F.size(domains).cast("double"), F.lit(2.0))
        primary = F.coalesce(F.get(domains, F.lit(0)), F.lit("none"))
    else:
        terms = S.evidence_terms(domains, F.col("pfam_descriptions"), F.col("interpro_descriptions"), F.array("product_description"))
        kingdom = F.col("superkingdom") if "superkingdom" in rows.columns else F.lit("")
        wanted = F.create_map(*(x for k, v in sorted(expected.items()) for x in (F.lit(k), S.strings(sorted(v))))) if expected else None
        mine_expected = F.coalesce(wanted[F.col("analyte")], S.strings([])) if wanted is not None else S.strings([])
        rows = once(rows, __found=S.chemistries(pfams, catalog, rules, domains, terms, kingdom), __expected=mine_expected)
        score, primary = sensory_score(domains, F.col("__found"), F.col("__expected"))
    rows = once(rows, sensory_domain_score=score, primary_sensory_chemistry=primary)
    rows = (
        rows.withColumn("candidate_id", F.concat_ws("::", "locus_id", "gene_accession"))
        .withColumn("distance_nt", S.distance_nt("relative_start", "relative_stop"))
        .withColumn("position", S.position("relative_index"))
        .withColumn("dna_binding_domains", S.only(pfams, S.DNA_BINDING_CANDIDATE))
        .withColumn("regulator_domain_score", S.regulator_domain_score(pfams, F.col("regulator_class")))
        .withColumn("proximity_score", S.proximity("relative_index"))
        .withColumn("archetype_id", F.lit(None).cast("string"))
        .withColumns({c: F.lit(0.0) for c in ("archetype_conservation_score", "taxonomic_breadth_score", "phylogenetic_profile_score")})
    )
    if enrichment is None:
        rows = rows.withColumn("enrichment_score", F.lit(0.0)).withColumn("candidate_score_q", F.lit(None).cast("double"))
    else:
        features = F.concat(
            F.array(F.struct(F.lit("regulator_class").alias("feature_type"), F.col("regulator_class").alias("feature_name"))),
            F.transform(domains, lambda d: F.struct(F.lit("sensory_domain").alias("feature_type"), d.alias("feature_name"))),
        )
        rows = attach_enrichment(rows, "candidate_id", features, enrichment, cap)
    rows = candidate_score(rows, weights)
    rows = rows.drop("__found", "__expected")
    text = F.format_string("%s regulator %s of %s locus; %d sensory domain(s); candidate score %.3f", "regulator_class", "position", "anchor_family", F.size(domains), "candidate_score")
    return rows.withColumn("rationale", text)


def candidate_token(index: Column, kind: Column, chemistries: Column, distance: Column) -> Column:
    return F.format_string("%+d:%s[%s]@%s", index, kind, S.sorted_label(chemistries), S.distance_bin(distance))


def parsed_architecture(text: Column) -> Column:
    """position -> label; of a position that occurs twice the last label stays. Entries look like ``+1:label``."""
    entries = F.transform(F.filter(F.split(text, ">"), lambda t: F.instr(t, ":") > 0), lambda t: F.struct(F.try_to_number(F.replace(F.substring_index(t, ":", 1), F.lit("+"), F.lit("")), F.lit("S999999")).cast("int").alias("k"), F.substr(t, F.instr(t, ":") + 1).alias("v")))
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"])))


def architecture_distance(a: Column, b: Column) -> Column:
    """Weighted share of positions whose labels differ, near positions counting more; 0 for two empty ones."""

    def share(pick) -> Column:
        return F.aggregate(F.array_union(F.map_keys(a), F.map_keys(b)), F.lit(0.0), lambda acc, p: acc + F.when(pick(p), F.lit(1.0) / (F.lit(1.0) + F.abs(p))).otherwise(0.0))

    total = share(lambda p: F.lit(True))
    return F.when(total > 0, share(lambda p: ~F.equal_null(F.try_element_at(a, p), F.try_element_at(b, p))) / total).otherwise(0.0)


def archetype_ids(loci: DataFrame, architecture: str, threshold: float = 0.0) -> DataFrame:
    """(architecture, archetype_no): leader clusters in order of the architecture strings.

    At threshold 0 a cluster is one architecture, numbered in order. Above it an architecture leads unless a leader before it
    is within the threshold, and follows the first such leader. Pairs within the threshold share labels of much
    weight, so they are found by an equality join on each side's rarest labels, those without which too little
    weight would be left to share. Leaders are settled in rounds: whoever has only settled followers before it leads, whoever
    has a leader before it follows. From a threshold of 1 on everything follows the first.
    """
    distinct = loci.select(F.col(architecture).alias("text")).distinct()
    if threshold <= 0:
        return scans.numbered(distinct, [], ["text"], "archetype_no").select(F.col("text").alias(architecture), F.col("archetype_no").cast("int").alias("archetype_no"))
    if threshold >= 1:
        return distinct.select(F.col("text").alias(architecture), F.lit(1).alias("archetype_no"))
    checkpoint_folder(loci.sparkSession)
    parsed = distinct.withColumn("m", parsed_architecture(F.col("text"))).checkpoint()
    labels = parsed.select("text", F.explode("m").alias("k", "v")).withColumn("w", F.lit(1.0) / (F.lit(1.0) + F.abs("k")))
    common = labels.groupBy("k", "v").agg(F.count("*").alias("n"))
    rare = Window.partitionBy("text").orderBy("n", "k", "v")
    ordered = labels.join(common, ["k", "v"]).withColumn("before", F.sum("w").over(rare.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w")).withColumn("all", F.sum("w").over(Window.partitionBy("text")))
    probes = ordered.where(F.col("all") - F.col("before") >= (1 - threshold) * F.col("all") - 1e-9).select("text", "k", "v")
    a, b = probes.select("k", "v", F.col("text").alias("one")), probes.select("k", "v", F.col("text").alias("two"))
    pairs = a.join(b, ["k", "v"]).where("one < two").select("one", "two").distinct()
    near = pairs.join(parsed.select(F.col("text").alias("one"), F.col("m").alias("x")), "one").join(parsed.select(F.col("text").alias("two"), F.col("m").alias("y")), "two")
    near = near.where(architecture_distance(F.col("x"), F.col("y")) <= threshold).select("one", "two")
    blank = parsed.where(F.size("m") == 0).select("text")  # texts without labels are at distance 0 of each other
    near = near.union(blank.agg(F.min("text").alias("one")).crossJoin(blank.select(F.col("text").alias("two"))).where("one < two")).checkpoint()
    state = parsed.select("text", F.lit(None).cast("boolean").alias("leads")).checkpoint()
    while not state.where("leads IS NULL").isEmpty():
        before = near.join(state.select(F.col("text").alias("one"), F.col("leads").alias("led")), "one").groupBy(F.col("two").alias("text")).agg(F.max(F.coalesce("led", F.lit(False))).alias("any"), F.max(F.col("led").isNull()).alias("open"))
        settled = F.when(F.coalesce("any", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = state.join(before, "text", "left").select("text", F.coalesce("leads", settled).alias("leads")).checkpoint()
    leaders = scans.numbered(state.where("leads").select("text"), [], ["text"], "archetype_no").withColumn("archetype_no", F.col("archetype_no").cast("int"))
    first = near.join(leaders.withColumnRenamed("text", "one"), "one").groupBy(F.col("two").alias("text")).agg(F.min("archetype_no").alias("followed"))
    return state.join(leaders, "text", "left").join(first, "text", "left").select(F.col("text").alias(architecture), F.coalesce("archetype_no", "followed").alias("archetype_no"))


def archetype_ids_in_order(texts: Sequence[str], threshold: float) -> dict[str, int]:
    """The same by hand, one text after the other: what tests compare with."""
    leaders: list[dict[int, str]] = []
    out = {}
    for text in sorted(texts):
        mine = dict((int(p), label) for p, _, label in (t.partition(":") for t in text.split(">") if ":" in t))
        for k, other in enumerate(leaders):
            places = mine.keys() | other.keys()
            total = sum(1 / (1 + abs(p)) for p in places)
            if not total or sum(1 / (1 + abs(p)) for p in places if mine.get(p) != other.get(p)) / total <= threshold + 1e-12:
                out[text] = k + 1
                break
        else:
            leaders.append(mine)
            out[text] = len(leaders)
    return out


def with_archetypes(candidates: DataFrame, archetypes: DataFrame, architecture: str = "architecture") -> DataFrame:
    """Candidates with the archetype of (analyte, architecture), else of ("", architecture), else the id that they have."""
    one = archetypes.groupBy("analyte", F.col("architecture_string").alias(architecture)).agg(F.min("archetype_id").alias("__id"))
    mine, any_ = one, one.where("analyte = ''").drop("analyte").withColumnRenamed("__id", "__any")
    joined = candidates.join(mine, ["analyte", architecture], "left").join(any_, architecture, "left")
    old = [F.col("archetype_id")] if "archetype_id" in candidates.columns else []
    return joined.withColumn("archetype_id", F.coalesce("__id", "__any", *old)).drop("__id", "__any")


def archetype_summary(loci: DataFrame, candidates: DataFrame, group: Sequence[str], locus: str, score: str, taxon: str, kind: str, candidate: str) -> DataFrame:
    """Loci, taxa, representative (highest score, least id), commonest class (least name on ties), mean scores."""
    best = candidates.groupBy(locus).agg(F.max(candidate).alias("__best"))
    base = loci.join(best, locus, "left")
    summary = base.groupBy(*group).agg(
        F.count_distinct(locus).alias("n_loci"),
        F.count_distinct(taxon).alias("n_taxa"),
        F.min(F.struct((-F.col(score)).alias("s"), F.col(locus).alias("id")))["id"].alias("representative"),
        F.avg(score).alias("mean_locus_score"),
        F.avg(F.coalesce("__best", F.lit(0.0))).alias("mean_candidate_score"),
    )
    kinds = candidates.join(loci.select(*{locus, *group}), locus).groupBy(*group, kind).count()
    top = kinds.groupBy(*group).agg(F.min(F.struct((-F.col("count")).alias("n"), F.col(kind).alias("k")))["k"].alias("dominant_class"))
    return summary.join(top, list(group), "left").withColumn("dominant_class", F.coalesce("dominant_class", F.lit("none")))


def conservation(candidates: DataFrame, loci: DataFrame, locus: str, architecture: str, analyte: str, index: str, kind: str, genus: str, family: str, phylum: str, least_loci: int = 3, least_taxa: int = 3) -> DataFrame:
    """Add archetype_conservation_score and taxonomic_breadth_score to candidates that carry their architecture.

    The gate counts genera and families without the empty string, the breadths count it as a value; loci without a
    value have the empty string. Architectures span analytes, positions are counted within one.
    """
    having = loci.join(candidates.where(F.col(architecture) != "").select(locus, architecture).distinct(), locus)
    shape = having.groupBy(architecture).agg(
        F.count_distinct(locus).alias("__n"),
        *(F.count_distinct(F.nullif(F.coalesce(c, F.lit("")), F.lit(""))).alias(f"__gate_{k}") for k, c in (("g", genus), ("f", family))),
        *(F.count_distinct(F.coalesce(c, F.lit(""))).alias(f"__{k}") for k, c in (("g", genus), ("f", family), ("p", phylum))),
    )
    places = candidates.where(F.col(architecture) != "").groupBy(architecture, analyte, index, kind).agg(F.count("*").alias("__at"))
    rows = candidates.join(shape, architecture, "left").join(places, [architecture, analyte, index, kind], "left")
    open_gate = (F.col("__n") >= least_loci) & (F.greatest("__gate_g", "__gate_f") >= least_taxa)

    def share(c: str) -> Column:
        return F.least(F.lit(1.0), F.col(c) / F.col("__n"))

    score = F.pow(share("__g") * share("__f") * share("__at"), F.lit(1.0 / 3.0))
    return (
        rows.withColumn("archetype_conservation_score", F.when(open_gate, score).otherwise(0.0))
        .withColumn("taxonomic_breadth_score", F.when(open_gate, F.least(F.lit(1.0), F.col("__p") / 30.0)).otherwise(0.0))
        .drop("__n", "__gate_g", "__gate_f", "__g", "__f", "__p", "__at")
    )
