"""Benchmark recovery and ranking metrics, report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flankline.operators import scans, trigrams


def recovery(truth: DataFrame, hits: DataFrame, truth_id: str, needles: Sequence[str], haystack: str, same: Sequence[tuple[str, str]] = (), negative: str | None = None) -> DataFrame:
    """Each truth row and whether some hit holds one of its names. Names meet hits by equality of grams. Rows marked ``negative``
    are hits when nothing is found, and look at all hits."""
    mine = [a for a, _ in same]
    asked = truth.select(F.col(truth_id).alias("__id"), *(F.col(a).alias(f"__own_{a}") for a in mine), (F.col(negative) if negative else F.lit(False)).alias("__any"), F.explode(F.array(*needles)).alias("__name"))
    equal = F.lit(True)
    for a, b in same:
        equal &= F.col(f"__own_{a}") == F.col(b)
    seen = hits.select(haystack, *dict.fromkeys(b for _, b in same)).distinct()
    got = trigrams.matches(seen, asked, "__name", [haystack], wildcards=False).where(equal | F.col("__any"))
    got = got.select(F.col("__id").alias(truth_id)).distinct().withColumn("recovered", F.lit(True))
    out = truth.join(got, truth_id, "left").withColumn("recovered", F.coalesce("recovered", F.lit(False)))
    return out.withColumn("hit", F.when(F.col(negative), ~F.col("recovered")).otherwise(F.col("recovered"))) if negative else out.withColumn("hit", F.col("recovered"))


def first_candidates(truth: DataFrame, ranked: DataFrame, truth_id: str, name: str, accession: str = "gene_accession", rank: str = "rank") -> DataFrame:
    """For each truth row the best-ranked candidate whose accession holds its name, if any: rank, candidate_id and scores. A gene
    that is several candidates counts at its best rank. Names meet accessions by equality of grams."""
    best = ranked.groupBy(accession).agg(F.min_by(F.struct(*ranked.columns), rank).alias("__c")).select("__c.*")
    asked = truth.select(F.col(truth_id).alias("__id"), F.col(name).alias("__name"))
    found = trigrams.matches(best, asked, "__name", [accession], wildcards=False).where(F.contains(F.col(accession), F.col("__name")))
    shown = [c for c in (rank, "candidate_id", "candidate_score", "regulation_logit_score") if c in ranked.columns]
    first = found.groupBy(F.col("__id").alias(truth_id)).agg(F.min_by(F.struct(*shown), rank).alias("__c")).select(truth_id, "__c.*")
    return truth.join(first, truth_id, "left")


def metric_rows(summary_row: DataFrame, counts: Mapping[str, Column], rows: DataFrame, notes: Mapping[str, str] | None = None) -> DataFrame:
    """A one-row summary as (metric, value, n, notes); ``counts`` say over how many of ``rows`` each metric runs."""
    names = summary_row.columns
    sizes = rows.agg(*(F.count_if(counts[c]).alias(f"__{c}") if c in counts else F.count("*").alias(f"__{c}") for c in names))
    entries = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.col(f"__{c}").alias("n"), F.lit((notes or {}).get(c, "")).alias("notes")) for c in names))
    return summary_row.crossJoin(F.broadcast(sizes)).select(F.explode(entries).alias("e")).select("e.*")  # one row each


def ranks(rows: DataFrame, score: str, tie: Sequence[str], into: str = "rank") -> DataFrame:
    """1-based rank by score over everything, nulls last, by scans over ranges of the score."""
    order = [F.desc_nulls_last(score), *map(F.col, tie)]
    return scans.numbered(rows, [], order, into).withColumn(into, F.col(into).cast("int"))


def top_k(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def auroc(rows: DataFrame, label: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with averaged ranks of ties; null where one class is absent.

    Counted by distinct score first; how many negatives score less is a running sum over ranges of scores.
    """
    by = rows.groupBy(*group, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    summed = scans.running_sums(scans.ranged(by, group, [score]), group, [score], {"under": F.col("n")}, inclusive=False)
    total = summed.groupBy(*group).agg(F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(*group, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("auroc"))


def average_precision(rows: DataFrame, label: str, score: str, tie: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Mean over the positives of the precision at their rank; ranks and hits are running sums over ranges of the score."""
    order = [F.desc(score), *map(F.col, tie)]
    ranked = scans.running_sums(scans.ranged(rows, group, order), group, order, {"__rank": F.lit(1).cast("long"), "__hits": F.col(label).cast("long")})
    hit = F.col(label).cast("int") == 1
    return ranked.groupBy(*group).agg((F.sum(F.when(hit, F.col("__hits") / F.col("__rank"))) / F.count_if(hit)).alias("average_precision"))


def summary(rows: DataFrame, positive: Column, hit: Column, rank: Column, tops: Sequence[int] = (1, 5, 10), more: Mapping[str, Column] | None = None) -> DataFrame:
    """One row of metrics; an empty subset gives null. Top-k recall is over the positives that have a rank."""

    def share(of: Column, where: Column) -> Column:
        return F.avg(F.when(where, of.cast("double")))

    return rows.agg(
        share(hit, positive).alias("positive_recall"),
        share(~hit, ~positive).alias("negative_fpr"),
        *(share(rank <= k, positive & rank.isNotNull()).alias(f"top_{k}_recall") for k in tops),
        *(share(hit, positive & w).alias(name) for name, w in (more or {}).items()),
    )


def selected(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return rows.select(*(c for c in wanted if c in rows.columns))


def joined_lists(rows: DataFrame, mark: str = ";") -> DataFrame:
    """List columns as text, for CSV."""
    return rows.select(*(F.array_join(f.name, mark).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema.fields))


def share_of_top(rows: DataFrame, value: str, order: Sequence[Column], k: int) -> DataFrame:
    top = rows.orderBy(*order).limit(k).agg(F.sum(value).alias("top"))
    return rows.agg(F.sum(value).alias("total")).crossJoin(top).select("top", "total", (F.col("top") / F.col("total")).alias("share"))


def markdown(rows: DataFrame) -> str:
    """A report table as Markdown, all of its rows, read a partition at a time."""
    names = rows.columns
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in joined_lists(rows).toLocalIterator()]
    return "\n".join(["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |", *body])
