"""Report tables, figure data and display strings. Everything is aggregated in Spark; only short results are printed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flankline.operators import scans
from flankline.operators.evaluate import joined_lists, selected, top_k

# fixed values: columns of the report tables
_CANDIDATES = ["candidate_id", "organism", "regulator_class", "sensory_domains", "regulation_logit_score", "score_band_low", "score_band_high", "phylogenetic_profile_score", "candidate_score", "candidate_score_q"]
TABLES: dict[str, Sequence[str]] = {
    "T0_benchmark_validation_summary": ["metric", "value", "n", "notes"],
    "T1_benchmark_recovery": ["benchmark_id", "analyte", "sensing_evidence_class", "is_negative_control", "verified_pmid", "protein_name", "organism", "hit", "rank", "regulation_logit_score", "candidate_score"],
    "T2_top30_co_candidates": _CANDIDATES,
    "T3_top30_cyd_control_candidates": _CANDIDATES,
    "T4_regulator_family_enrichment": ["analyte", "feature_type", "feature_name", "odds_ratio", "p_value", "q_value", "interpretation"],
    "T5_archetype_catalog": ["archetype_id", "analyte", "architecture_scope", "architecture_string", "n_loci", "n_taxa", "dominant_regulator_class"],
}
# end of fixed values


def table(rows: DataFrame, name: str) -> DataFrame:
    """The columns of a report table that ``rows`` have, lists as text."""
    return joined_lists(selected(rows, TABLES[name]))


def top_candidates(candidates: DataFrame, analyte: str, k: int = 30) -> DataFrame:
    return top_k(candidates.where(F.col("analyte") == analyte), ["analyte"], [F.desc_nulls_first("candidate_score"), F.col("candidate_id")], k)


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file; report tables are short."""
    joined_lists(rows).coalesce(1).write.mode("overwrite").csv(path, header=True)


def clean_label(value: Column, empty: str = "unknown") -> Column:
    text = F.replace(F.trim(F.coalesce(value, F.lit(""))), F.lit(" "), F.lit("_"))
    return F.when(text == "", empty).otherwise(text)


def display_architectures(loci: DataFrame, genes: DataFrame) -> DataFrame:
    """[-1:label][0:anchor][+1:label]... of all genes of each locus, in order."""
    sensors = F.coalesce(F.nullif(F.array_join("sensory_domains", "-"), F.lit("")), F.lit("none"))
    label = (
        F.when(F.col("relative_index") == 0, F.col("anchor_family"))
        .when(F.col("is_regulator_candidate"), F.concat(clean_label(F.col("regulator_class")), F.lit(":"), sensors))
        .otherwise(clean_label(F.col("functional_class")))
    )
    sign = F.when(F.col("relative_index") > 0, "+").otherwise("")
    token = F.concat(F.lit("["), sign, F.col("relative_index").cast("string"), F.lit(":"), label, F.lit("]"))
    named = loci.select("locus_id", "anchor_family").join(genes, "locus_id")
    listed = named.groupBy("locus_id").agg(F.array_sort(F.collect_list(F.struct("relative_index", "gene_accession", token.alias("t")))).alias("l"))
    return loci.select("locus_id").join(listed, "locus_id", "left").select("locus_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["t"]), ""), F.lit("")).alias("architecture_string"))


def recovery_figures(recovery: DataFrame) -> DataFrame:
    """Recovered and all positives by analyte, with the share."""
    positive = recovery.where(~F.col("is_negative_control")) if "is_negative_control" in recovery.columns else recovery
    return positive.groupBy("analyte").agg(F.count_if("hit").alias("recovered"), F.count("*").alias("total"), (100 * F.avg(F.col("hit").cast("int"))).alias("percent"))


def family_chemistry(candidates: DataFrame) -> DataFrame:
    """Candidates by analyte, regulator class and chemistry: the primary one, or the first domain, or none."""
    first = F.get("sensory_domains", F.lit(0))
    chemistry = F.coalesce(F.nullif(F.col("primary_sensory_chemistry"), F.lit("none")), first, F.lit("none"))
    return candidates.groupBy("analyte", "regulator_class", chemistry.alias("chemistry")).agg(F.count("*").alias("n")).orderBy("analyte", "regulator_class", "chemistry")


def locus_landscape(loci: DataFrame) -> DataFrame:
    """(place, analyte, locus_id, locus_score, locus_confidence): loci numbered by analyte and score, as points along an axis."""
    rows = loci.select("analyte", "locus_id", "locus_score", F.coalesce("locus_confidence", F.lit("low")).alias("locus_confidence"))
    return scans.numbered(rows, [], ["analyte", "locus_score", "locus_id"], "place").withColumn("place", F.col("place") - 1)


def archetype_atlas(archetypes: DataFrame, k: int = 12) -> DataFrame:
    """(label, n_loci) of the archetypes with the most loci, ties by id."""
    top = archetypes.orderBy(F.desc("n_loci"), "archetype_id", "analyte").limit(k)
    return top.select(F.format_string("%s (%s)", "archetype_id", "analyte").alias("label"), "n_loci")


def chemistry_partition(enrichment: DataFrame) -> DataFrame:
    """(label, odds_ratio, q_value, size): a point for each feature, larger for smaller q."""
    size = F.greatest(F.lit(30.0), (F.lit(1.0) - F.col("q_value")) * 180.0)
    return enrichment.select(F.concat_ws(" ", "analyte", "feature_name").alias("label"), "odds_ratio", "q_value", size.alias("size"))


def candidate_ranking(candidates: DataFrame, k: int = 30) -> DataFrame:
    """(candidate_id, score) of the first candidates by the logit score where there is one, ties by id."""
    score = "regulation_logit_score" if "regulation_logit_score" in candidates.columns else "candidate_score"
    return candidates.orderBy(F.desc_nulls_first(score), "candidate_id").limit(k).select("candidate_id", F.col(score).alias("score"))


def structure_hypotheses(candidates: DataFrame, k: int = 10) -> DataFrame:
    """(candidate_id, score) of the first candidates by structural plausibility; those without one are left out."""
    if "structural_plausibility_score" not in candidates.columns:
        return candidates.where("false").select("candidate_id", F.lit(0.0).alias("score"))
    scored = candidates.where(F.col("structural_plausibility_score").isNotNull())
    return scored.orderBy(F.desc("structural_plausibility_score"), "candidate_id").limit(k).select("candidate_id", F.col("structural_plausibility_score").alias("score"))


def figure_data(recovery: DataFrame, loci: DataFrame, archetypes: DataFrame, enrichment: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """What the six figures show."""
    return {
        "figure_1_workflow_and_recovery": recovery_figures(recovery),
        "figure_2_locus_landscape": locus_landscape(loci),
        "figure_3_archetype_atlas": archetype_atlas(archetypes),
        "figure_4_chemistry_partition": chemistry_partition(enrichment),
        "figure_5_candidate_ranking": candidate_ranking(candidates),
        "figure_6_structure_hypotheses": structure_hypotheses(candidates),
    }


def short_number(value: float | None, digits: int = 2) -> str:
    return "not scored" if value is None else f"{value:.{digits}g}"


def enrichment_caption(enrichment: DataFrame) -> str:
    """The feature of the least q value; ties by p value, then by name."""
    order = [F.asc_nulls_last(c) for c in ("q_value", "p_value", "feature_type", "feature_name")]
    best = enrichment.orderBy(*order).limit(1).collect()
    if not best:
        return "No feature was tested for enrichment."
    top = best[0]
    whose = f" in {top['analyte']}" if "analyte" in enrichment.columns else ""
    return f"The strongest enrichment{whose} is {top['feature_type']} {top['feature_name']} (odds ratio {short_number(top['odds_ratio'])}, q {short_number(top['q_value'])})."


def ranking_caption(candidates: DataFrame, least: float = 0.8) -> str:
    """How many candidates reach ``least`` (without logit scores: a q value of 0.05), and the first of all; ties by candidate_id."""
    logit = "regulation_logit_score" in candidates.columns
    score = "regulation_logit_score" if logit else "candidate_score"
    high = F.col(score) >= least if logit else F.col("candidate_score_q") <= 0.05 if "candidate_score_q" in candidates.columns else F.lit(False)
    first = F.min_by(F.struct("*"), F.struct(-F.coalesce(score, F.lit(float("-inf"))), "candidate_id"))
    got = candidates.agg(F.count_if(high).alias("n"), first.alias("top")).first()
    if got.top is None:
        return "There are no candidates."
    band = f", band {short_number(got.top['score_band_low'])} to {short_number(got.top['score_band_high'])}" if {"score_band_low", "score_band_high"} <= set(candidates.columns) else ""
    return f"{got.n} candidates score high; the first is {got.top['candidate_id']} of {got.top['organism']} ({short_number(got.top[score])}{band})."


def structure_caption(candidates: DataFrame, score: str = "structural_plausibility_score") -> str:
    """How many candidates have a structure score, and the best; ties by candidate_id."""
    if score in candidates.columns:
        got = candidates.where(F.col(score).isNotNull()).agg(F.count("*").alias("n"), F.min(F.struct((-F.col(score)).alias("s"), F.col("candidate_id").alias("id"))).alias("top")).first()
        if got.n:
            return f"{got.n} candidates have a structure score; the best is {got.top.id} ({short_number(-got.top.s)})."
    return "No candidate has a structure score."


def write_captions(texts: Mapping[str, str], spark: SparkSession, folder: str) -> None:
    """One table (figure, caption) as one file: six short rows."""
    spark.createDataFrame(sorted(texts.items()), "figure string, caption string").coalesce(1).write.mode("overwrite").csv(folder, header=True)


def captions(loci: DataFrame, archetypes: DataFrame, recovery: DataFrame, analytes: Sequence[str], enrichment: DataFrame | None = None, candidates: DataFrame | None = None) -> Mapping[str, str]:
    """Short sentences for figures from small aggregates; those on enrichment and candidates only where these are given."""
    counts = {r["analyte"]: r["count"] for r in loci.groupBy("analyte").count().collect()}
    strong = loci.agg(F.count_if(F.col("locus_confidence") == "high").alias("n")).first().n
    hits = recovery_figures(recovery).agg(F.sum("recovered").alias("r"), F.sum("total").alias("t")).first()
    kinds = archetypes.groupBy("analyte").agg(F.count("*").alias("n"), F.sum("n_loci").alias("all")).collect()
    top = {r["analyte"]: r["top"] for r in top_k(archetypes, ["analyte"], [F.desc("n_loci"), F.col("archetype_id")], 6).groupBy("analyte").agg(F.sum("n_loci").alias("top")).collect()}
    percent = lambda a, b: f"{100 * (a or 0) / b:.1f}%" if b else "0.0%"
    out = {
        "recovery": f"{hits.r or 0} of {hits.t or 0} benchmark rows are recovered ({percent(hits.r, hits.t)}).",
        "loci": ", ".join(f"{a}: {counts.get(a, 0)} loci" for a in analytes) + f"; {strong} with high confidence.",
        "archetypes": "; ".join(f"{r['analyte']}: {r['n']} archetypes, the six largest hold {percent(top.get(r['analyte']), r['all'])} of the loci" for r in sorted(kinds, key=lambda r: r["analyte"])) + ".",
    }
    if enrichment is not None:
        out["enrichment"] = enrichment_caption(enrichment)
    if candidates is not None:
        out |= {"ranking": ranking_caption(candidates), "structures": structure_caption(candidates)}
    return out



def fallback_benchmark(candidates: DataFrame) -> DataFrame:
    """One derived benchmark row: the best candidate."""
    score = "regulation_logit_score" if "regulation_logit_score" in candidates.columns else "candidate_score"
    best = candidates.orderBy(F.desc_nulls_last(score), "candidate_id").limit(1)
    return best.select(F.lit("derived_top_candidate").alias("benchmark_id"), "analyte", F.col("gene_accession").alias("protein_name"), "organism", F.lit(True).alias("hit"), F.lit(1).alias("rank"), F.col(score).alias("score"), "candidate_score")


def seed_for_family(records: DataFrame, family: str) -> str:
    """The seed sequence of a family: by gene symbol ``GN=``, then by name in the description, then the first record.
    Seed files hold some dozens of records."""
    symbol = F.lower(F.regexp_extract("description", r"(?:^|\s)GN=(\S+)", 1)) == family.lower()
    named = F.contains(F.lower("description"), F.lit(family.lower()))
    rank = F.when(symbol, 0).when(named, 1).otherwise(2)
    return records.withColumn("no", F.monotonically_increasing_id()).orderBy(rank, "no").first()["sequence"]
