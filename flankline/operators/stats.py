"""Enrichment statistics: counts by aggregation, tests on the few aggregated rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flankline.functions.numerics import beta_quantile_udf, chi_square_tail_udf, erfc_udf, fisher_p_udf
from flankline.functions.scalars import logit_score
from flankline.operators import scans
from flankline.session import checkpoint_folder, saved


#: Bits of one of Spark's bitmaps.
BITMAP_BITS = 4096 * 8


def contingency(rows: DataFrame, feature: Sequence[str], locus: str, is_case: Column, strata: Sequence[str] = ()) -> DataFrame:
    """a, b, c, d for each feature (and stratum): cases with, cases without, controls with, controls without.

    ``rows`` may repeat (locus, feature); a locus counts once. A stratum has rows for the features that occur in it. The totals of a side are its distinct loci, so loci
    without any feature (null) count as without.
    """
    # the stratum's totals first; a stratum where one side or a margin is empty stays in with its zeros
    marked = rows.withColumn("__case", is_case)
    totals = marked.select(locus, "__case", *strata).distinct().groupBy(*strata).agg(F.count_if("__case").alias("cases"), F.count_if(~F.col("__case")).alias("controls"))
    present = F.lit(True)
    for c in feature:
        present &= F.col(c).isNotNull()
    seen = marked.where(present).select(locus, "__case", *strata, *feature).distinct()
    counts = seen.groupBy(*strata, *feature).agg(F.count_if("__case").alias("a"), F.count_if(~F.col("__case")).alias("c"))
    # strata without the feature are left out: see ``stratified``, which accounts for them by their totals
    joined = counts.join(totals, list(strata)) if strata else counts.crossJoin(F.broadcast(totals))  # one row
    a, c = F.coalesce("a", F.lit(0)), F.coalesce("c", F.lit(0))
    return joined.select(*strata, *feature, a.alias("a"), (F.col("cases") - a).alias("b"), c.alias("c"), (F.col("controls") - c).alias("d"))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ad/bc; infinite if bc is 0, 0 if a margin is empty."""
    empty = ((a + b) == 0) | ((c + d) == 0) | ((a + c) == 0) | ((b + d) == 0)
    return F.when(empty, 0.0).when((b * c) == 0, F.lit(float("inf"))).otherwise((a * d) / (b * c))


def fisher(counts: DataFrame) -> DataFrame:
    cells = [F.col(x) for x in "abcd"]
    return counts.withColumn("odds_ratio", odds_ratio(*cells)).withColumn("p_value", fisher_p_udf(*cells))


def cmh(strata_counts: DataFrame, feature: Sequence[str]) -> DataFrame:
    """Cochran-Mantel-Haenszel over strata: statistic with continuity correction, pooled odds ratio, p.

    Strata without loci on either side drop out; 0.5 is added to all cells of a stratum that has a zero.
    """
    cells = {x: F.col(x).cast("double") for x in "abcd"}
    zero = (F.col("a") == 0) | (F.col("b") == 0) | (F.col("c") == 0) | (F.col("d") == 0)
    shift = F.when(zero, 0.5).otherwise(0.0)
    rows = strata_counts.where("a + b + c + d > 0")
    totals = rows.groupBy(*feature).agg(*(F.sum(x).alias(f"n_{x}") for x in "abcd"))
    a, b, c, d = (cells[x] + shift for x in "abcd")
    n = a + b + c + d
    sums = rows.groupBy(*feature).agg(
        F.sum(a - (a + b) * (a + c) / n).alias("__dev"),
        F.sum((a + b) * (a + c) * (b + d) * (c + d) / (n * n * (n - 1))).alias("__var"),
        F.sum(a * d / n).alias("__num"),
        F.sum(b * c / n).alias("__den"),
    )
    statistic = F.when(F.col("__var") > 0, F.pow(F.abs("__dev") - 0.5, 2) / F.col("__var")).otherwise(0.0)
    out = sums.join(totals, list(feature)).withColumn("statistic", statistic)
    out = out.withColumn("odds_ratio", F.when(F.col("__den") > 0, F.col("__num") / F.col("__den")).otherwise(0.0))
    return out.withColumn("p_value", erfc_udf(F.sqrt(F.col("statistic") / 2))).drop("__dev", "__var", "__num", "__den")


def stratified(rows: DataFrame, feature: Sequence[str], locus: str, is_case: Column, strata: Sequence[str]) -> DataFrame:
    """:func:`cmh` over every stratum of ``rows``, those without the feature included, without writing features x strata. A feature
    whose strata leave no variance (so that there is no statistic) is tested by Fisher's exact test on its totals.

    A stratum without the feature adds terms that depend on its totals alone. They are summed once over all strata; each
    feature takes that sum, less those of the strata where it occurs, plus its own terms there."""
    present = contingency(rows, feature, locus, is_case, strata)
    marked = rows.withColumn("__case", is_case)
    totals = marked.select(locus, "__case", *strata).distinct().groupBy(*strata).agg(F.count_if("__case").alias("cases"), F.count_if(~F.col("__case")).alias("controls"))

    def terms(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
        shift = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
        a, b, c, d = (x.cast("double") + shift for x in (a, b, c, d))
        n = a + b + c + d
        return {"dev": a - (a + b) * (a + c) / n, "var": (a + b) * (a + c) * (b + d) * (c + d) / (n * n * (n - 1)), "num": a * d / n, "den": b * c / n}

    zero = F.lit(0)
    absent = terms(zero, F.col("cases"), zero, F.col("controls"))
    everywhere = totals.agg(*(F.sum(v).alias(f"all_{k}") for k, v in absent.items()), F.sum("cases").alias("cases"), F.sum("controls").alias("controls"))
    here = terms(*(F.col(x) for x in "abcd"))
    instead = terms(zero, F.col("a") + F.col("b"), zero, F.col("c") + F.col("d"))
    sums = present.groupBy(*feature).agg(*(F.sum(here[k] - instead[k]).alias(k) for k in here), F.sum("a").alias("n_a"), F.sum("c").alias("n_c"))
    out = sums.crossJoin(F.broadcast(everywhere))  # one row
    dev, var, num, den = (F.col(k) + F.col(f"all_{k}") for k in ("dev", "var", "num", "den"))
    out = out.withColumn("statistic", F.when(var > 1e-12, F.pow(F.abs(dev) - 0.5, 2) / var).otherwise(0.0)).withColumn("odds_ratio", F.when(den > 1e-12, num / den).otherwise(0.0))
    out = out.withColumn("n_b", F.col("cases") - F.col("n_a")).withColumn("n_d", F.col("controls") - F.col("n_c"))
    defined = (var > 1e-12) & (den > 1e-12)
    cells = [F.col(f"n_{x}") for x in "abcd"]
    out = out.withColumn("p_value", F.when(defined, erfc_udf(F.sqrt(F.col("statistic") / 2))).otherwise(fisher_p_udf(*cells)))
    out = out.withColumn("odds_ratio", F.when(defined, F.col("odds_ratio")).otherwise(odds_ratio(*cells)))
    return out.select(*feature, "n_a", "n_b", "n_c", "n_d", "statistic", "odds_ratio", "p_value")


def enrichment(rows: DataFrame, feature: Sequence[str], locus: str, is_case: Column, strata: Sequence[str] = (), test: str = "fisher") -> DataFrame:
    """Counts, odds ratio, p and q of every feature: stratified where ``test`` is ``cmh`` and there are strata, Fisher's exact test
    otherwise. A column ``test`` says which."""
    if test == "cmh" and strata:
        tested = stratified(rows, feature, locus, is_case, strata)
    else:
        test = "fisher"
        tested = fisher(contingency(rows, feature, locus, is_case)).withColumnsRenamed({x: f"n_{x}" for x in "abcd"})
    return benjamini_hochberg(tested).withColumn("test", F.lit(test))


def robustness(rows: DataFrame, feature: Sequence[str], locus: str, side: str, case: str, policies: dict[str, str | None], score: str, strata: Sequence[str] = (), test: str = "cmh") -> DataFrame:
    """The test of every feature under each deduplication policy: deduplication_policy, stratum_column, test, odds ratio, p, q."""
    out = None
    for name, column in policies.items():
        thinned = under_policies(rows, locus, side, {name: column}, score)
        part = enrichment(thinned, feature, locus, F.col(side) == case, strata, test)
        part = part.withColumn("deduplication_policy", F.lit(name)).withColumn("stratum_column", F.lit(",".join(strata)))
        part = part.select("deduplication_policy", "stratum_column", "test", *feature, "n_a", "n_b", "n_c", "n_d", "odds_ratio", "p_value", "q_value", "interpretation")
        out = part if out is None else out.unionByName(part)
    return out


def benjamini_hochberg(rows: DataFrame, p: str = "p_value", run: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """q values and labels by run. p values are counted first, so ties are one row; ranks and the step-up minimum are scans over
    ranges of p, so neither many tests nor one large run is a single task. A null p has no q. Tests are saved first: computed twice,
    sums of floats may differ in their last bit, and q values are joined by p."""
    checkpoint_folder(rows.sparkSession)
    rows = rows.checkpoint()
    values = rows.where(F.col(p).isNotNull()).groupBy(*run, F.col(p).alias("__p_value")).agg(F.count("*").alias("__c"))
    sorted_ = scans.ranged(values, run, ["__p_value"])
    ranked = scans.running_sums(sorted_, run, ["__p_value"], {"__r": F.col("__c")})
    whole = rows.groupBy(*run).agg(F.count("*").alias("__n"))
    side = whole.select(*(F.col(c).alias(f"__w_{c}") for c in run), "__n")
    ranked = ranked.join(side, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__w_{c}")) for c in run))) if run else ranked.crossJoin(side)  # one row
    stepped = scans.later_minimum(ranked, run, ["__p_value"], F.col("__p_value") * F.col("__n") / F.col("__r"), "__q")
    told = stepped.select(*(F.col(c).alias(f"__t_{c}") for c in run), "__p_value", F.least(F.lit(1.0), F.col("__q")).alias("q_value"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__t_{c}")) for c in run), F.col(p) == F.col("__p_value"))
    out = rows.join(told, same, "left").drop("__p_value", *(f"__t_{c}" for c in run))
    return out.withColumn("interpretation", F.when(F.col("q_value") <= alpha, "enriched").otherwise("not_enriched"))


def one_per_group(rows: DataFrame, group: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """The highest-scoring locus of each group; ties by ``tie``."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc_nulls_last(score), *tie))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def under_policies(rows: DataFrame, locus: str, side: str, policies: dict[str, str | None], score: str) -> DataFrame:
    """``rows`` once for each policy (a column ``policy``), thinned to one locus for each value of the policy's column and side. The
    loci that are left are told their policies, and ``rows`` meet them once for all policies."""
    whole = [name for name, column in policies.items() if column is None]
    left = None
    for name, column in policies.items():
        if column is not None:
            loci = rows.select(locus, side, column, score).distinct()
            one = one_per_group(loci, [side, column], score, [locus]).select(F.col(locus).alias("__locus"), F.lit(name).alias("__policy"))
            left = one if left is None else left.unionByName(one)
    named = F.array(*map(F.lit, whole)).cast("array<string>")
    if left is None:
        return rows.withColumn("policy", F.explode(named))
    told = left.groupBy("__locus").agg(F.collect_set("__policy").alias("__policies"))
    met = rows.join(told, F.col(locus) == F.col("__locus"), "left" if whole else "inner")
    return met.select(*rows.columns, F.explode(F.concat(named, F.coalesce("__policies", F.array().cast("array<string>")))).alias("policy"))


def normalized_mutual_information(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Mutual information over the smaller entropy, within [0, 1]; 0 if an entropy is 0."""
    n = (n11 + n10 + n01 + n00).cast("double")

    def part(x: Column) -> Column:
        return F.when(x > 0, -(x / n) * F.log2(x / n)).otherwise(0.0)

    hx, hy = part(n11 + n10) + part(n01 + n00), part(n11 + n01) + part(n10 + n00)
    joint = part(n11) + part(n10) + part(n01) + part(n00)
    return F.when((hx > 0) & (hy > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (hx + hy - joint) / F.least(hx, hy)))).otherwise(0.0)


def numbered_bits(values: DataFrame, column: str, n: int) -> DataFrame:
    """(column, bucket, bit) of ``n`` distinct values: buckets by hash, so that none is counted in one task; a bucket that is over-full
    goes on in further ones."""
    many = max(1, -(-n // (BITMAP_BITS // 2)))
    dealt = values.select(column, F.pmod(F.xxhash64(column), F.lit(many)).alias("__b"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(column)) - 1
    return dealt.withColumn("__r", rank).select(column, F.struct(F.col("__b"), F.floor(F.col("__r") / BITMAP_BITS).alias("more")).alias("bucket"), (F.col("__r") % BITMAP_BITS).cast("long").alias("bit"))


def profile_scores(candidates: DataFrame, loci: DataFrame, key: Sequence[str] = ("analyte", "regulator_class"), within: str = "analyte", organism: str = "organism") -> DataFrame:
    """Candidates with ``phylogenetic_profile_score``: the normalised mutual information, over all organisms, of having a locus of
    the analyte and of having a candidate of the analyte and class.

    Organisms are bits. A profile is a few bitmaps of 4 KiB, one for each bucket of organisms where it has any; profiles meet
    by analyte and bucket, and the bits that both have are counted there. Rows without an organism count nowhere; with under two
    organisms there is no profile and the score is 0.
    """
    candidates, loci = saved(candidates), saved(loci.select(within, organism).distinct())  # each is read several times
    organisms = loci.select(organism).union(candidates.select(organism)).where(F.col(organism).isNotNull()).distinct()
    n = organisms.count()
    rows = candidates.drop("phylogenetic_profile_score")
    if n < 2:
        return rows.withColumn("phylogenetic_profile_score", F.lit(0.0))
    bits = numbered_bits(organisms, organism, n)
    have = candidates.select(*key, organism).distinct().join(bits, organism).groupBy(*key, "bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    mark = loci.select(within, organism).distinct().join(bits, organism).groupBy(within, "bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    marks = mark.groupBy(within).agg(F.sum(F.bitmap_count("map")).alias("mark_n"))
    other = mark.select(F.col(within).alias("__w"), F.col("bucket").alias("__bucket"), F.col("map").alias("__map"))
    met = have.join(other, F.col(within).eqNullSafe(F.col("__w")) & (F.col("bucket") == F.col("__bucket")), "left")
    pair = met.select(*key, F.bitmap_count("map").alias("own"), "bucket", F.explode(F.array("map", F.coalesce("__map", F.lit(bytes(BITMAP_BITS // 8))))).alias("map"))
    both = pair.groupBy(*key, "bucket", "own").agg(F.bitmap_count(F.bitmap_and_agg("map")).alias("n11"))
    counts = both.groupBy(*key).agg(F.sum("n11").alias("n11"), F.sum("own").alias("own"))
    counts = counts.join(marks.withColumnRenamed(within, "__w"), F.col(within).eqNullSafe(F.col("__w")), "left").drop("__w").withColumn("mark_n", F.coalesce("mark_n", F.lit(0)))
    n11, own, mark_n = F.col("n11"), F.col("own"), F.col("mark_n")
    scores = counts.select(*(F.col(k).alias(f"__{k}") for k in key), normalized_mutual_information(n11, own - n11, mark_n - n11, F.lit(n) - own - mark_n + n11).alias("__score"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return rows.join(F.broadcast(scores), on, "left").withColumn("phylogenetic_profile_score", F.coalesce("__score", F.lit(0.0))).drop("__score", *(f"__{k}" for k in key))


def presence_counts(organisms: DataFrame, present: DataFrame, marked: DataFrame, organism: str, feature: Sequence[str]) -> DataFrame:
    """n11, n10, n01, n00 of every feature's presence against a mark, over all organisms; from counts alone."""
    all_n = organisms.select(organism).distinct().count()
    marks = marked.select(organism).distinct()
    mark_n = marks.count()
    have = present.select(organism, *feature).distinct().join(marks.withColumn("__m", F.lit(1)), organism, "left")
    counts = have.groupBy(*feature).agg(F.count("__m").alias("n11"), F.count_if(F.col("__m").isNull()).alias("n10"))
    return counts.withColumn("n01", F.lit(mark_n) - F.col("n11")).withColumn("n00", F.lit(all_n) - F.col("n11") - F.col("n10") - F.col("n01"))


def chi_square(counts: DataFrame, row: str, column: str, n: str) -> DataFrame:
    """One row: statistic, degrees of freedom, p; Yates' correction with one degree of freedom. ``counts`` is the contingency
    table; its size is that of the two category sets. Under two levels on a side there is no test (p is 1)."""
    cells = counts.select(row).distinct().crossJoin(counts.select(column).distinct()).join(counts, [row, column], "left").withColumn("o", F.coalesce(n, F.lit(0)).cast("double"))
    by_row, by_col = Window.partitionBy(row), Window.partitionBy(column)
    everything = Window.partitionBy(F.lit(0))
    cells = cells.withColumn("e", F.sum("o").over(by_row) * F.sum("o").over(by_col) / F.sum("o").over(everything))
    shape = cells.agg(((F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)).alias("dof"))
    joined = cells.crossJoin(F.broadcast(shape))
    off = F.abs(F.col("o") - F.col("e"))
    shifted = F.when(F.col("dof") == 1, off - F.least(F.lit(0.5), off)).otherwise(off)
    out = joined.agg(F.sum(shifted * shifted / F.col("e")).alias("statistic"), F.max("dof").alias("dof"))
    return out.withColumn("p_value", F.when(F.col("dof") > 0, chi_square_tail_udf(F.col("statistic"), F.greatest(F.col("dof"), F.lit(1)).cast("double"))).otherwise(1.0))


def score_bands(rows: DataFrame, score: str, weight: float = 24.0, tails: tuple[float, float] = (0.03, 0.97)) -> DataFrame:
    s = logit_score(F.col(score))
    out = rows.withColumn("regulation_logit_score", s)
    a, b = F.col("regulation_logit_score") * weight, (F.lit(1.0) - F.col("regulation_logit_score")) * weight
    return (
        out.withColumn("score_band_low", beta_quantile_udf(F.lit(tails[0]), a, b))
        .withColumn("score_band_high", beta_quantile_udf(F.lit(tails[1]), a, b))
        .withColumn("score_band_model", F.lit("logit_beta"))
    )


def matched_controls(pool: DataFrame, cases: DataFrame, key: Sequence[str], locus: str, per_case: int, seed: str = "controls") -> DataFrame:
    """``per_case`` controls for each case from the same match key, none used twice, the same on every run.

    Pool rows stand in the order of a seeded digest; the k-th case of a key takes the k-th run of ``per_case`` of them. Both
    are numbered by scans over ranges, so that a match key of very many rows is not one task.
    """
    digest = F.md5(F.concat(F.lit(seed + ":"), F.col(locus).cast("string")))
    numbered = scans.numbered(cases.select(*key, F.col(locus).alias("case_id")), key, ["case_id"], "__k").withColumn("__k", F.col("__k") - 1)
    free = pool.join(cases.select(locus), locus, "left_anti").withColumn("__d", digest)
    free = scans.numbered(free, key, ["__d", locus], "__k").withColumn("__k", F.floor((F.col("__k") - 1) / per_case))
    return free.join(numbered, [*key, "__k"]).drop("__d", "__k").withColumn("locus_confidence", F.lit("control"))
