"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source the documents stand in one fixed order; each has the same expected number of copies
``e = target / size of the source``. The running sum of ``e`` after the i-th document is ``i * e``;
with one random offset ``u`` for the source a document is emitted once for every integer boundary
that lies between its predecessor's sum and its own: ``floor(i*e + u) - floor((i-1)*e + u)`` copies
(never over ``ceil(e)``, whatever doubles make of very large ``i``).
As the order runs through size classes, large and small documents are drawn in equal shares and the
words taken come near the target. Inside a class the order is that of a digest of id and text, so ids may be
of any type, repeat or be null.

Defined results: a null or blank text has size 0; a null source is a source of its own, the last;
repeated rows are separate documents; a source without words has target 0 and takes nothing; an empty
table gives an empty result. :func:`mixed` replaces columns named like its results; :func:`emitted` passes all columns
on as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, saved, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
MADE = ["size", "source_size", "target", "copies", "taken"]
#: Rows, about, for each slice that a size class is ranked in; a slice is the documents whose digest begins alike.
SLICE_ROWS = 1 << 16


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, source: str, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row for each source with its ``target``; ``sizes`` has columns ``source`` and ``source_size``.

    Resharing the excess until none is above its cap ends at ``min(cap, L * weight)`` for the one L
    that uses up the total. Taking the sources by cap/weight, L is the largest of
    (total - caps before) / (weights from here on).
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("ratio"), F.col("place"))
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    return (
        sizes.withColumn("place", place)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1).cast("double"))
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("level", F.max("level").over(everything))
        .select("__key", "source_size", F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target"))
    )


def digest(id_col: str, text: str) -> Column:
    """Sixteen hexadecimal digits that order the documents of a size class."""
    return F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))), 1, 16)


def sized(docs: DataFrame, id_col: str, text: str, source: str, more: list[Column] | None = None) -> DataFrame:
    """(id, source, size, digest) of every document: what a mix is planned from."""
    return docs.select(*(more or []), F.col(id_col).alias("id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), digest(id_col, text).alias("digest"))


def planned(rows: DataFrame, narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """``rows`` (source, size, digest and others) with source_size, target, copies and taken; ``narrow`` is a saved table of
    the same documents.

    Ranks come from three levels: counts by (source, size class, slice) give sums by (source, size class), whose running sum
    gives each class's first rank; the running sum inside a class gives each slice's; ``row_number`` ranks inside a slice.
    Only the classes of a source, some ninety for every factor of ten in size, meet by source.
    """
    digits = 0
    while narrow.count() > SLICE_ROWS * 16**digits:
        digits += 1
    group = ["__key", "__class", "__slice"]

    def grouped(df: DataFrame) -> DataFrame:
        zeros = F.greatest(F.length(F.col("size").cast("string")) - 2, F.lit(0))
        return (
            df.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
            .withColumn("__class", F.col("size") - F.col("size") % F.pow(F.lit(10), zeros).cast("long"))
            .withColumn("__slice", F.substring("digest", 1, 2 + digits))
        )

    counts = grouped(narrow).groupBy("source", *group).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    classes = counts.groupBy("source", "__key", "__class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    before = lambda by: F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = classes.select("__key", "__class", before(Window.partitionBy("__key").orderBy("__class")).alias("__start"))
    slices = counts.select(*group, before(Window.partitionBy("__key", "__class").orderBy("__slice")).alias("__before"))
    per_source = targets(classes.groupBy("source", "__key").agg(F.sum("words").alias("source_size")), "source", weights, share, cap)
    plan = slices.join(starts, ["__key", "__class"]).join(per_source, "__key").select(*group, (F.col("__start") + F.col("__before")).alias("__first"), "source_size", "target")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("digest", "size"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    i = F.col("__first") + F.col("__rank")
    crossed = F.floor(i * expected + offset) - F.floor((i - 1) * expected + offset)
    out = grouped(rows).withColumn("__rank", rank).join(plan, group)  # the rank has dealt the rows by these keys already
    out = out.withColumn("copies", F.least(crossed, F.ceil(expected)))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop(*group, "__rank", "__first")


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken."""
    names = [c for c in docs.columns if c.lower() not in MADE]
    narrow = saved(sized(docs, id_col, text, source), "sizes")
    rows = sized(docs, id_col, text, source, [F.struct(*docs.columns).alias("row")])
    return planned(rows, narrow, **options).select(*(F.col(f"row.`{c}`").alias(c) for c in names), *MADE)


def emitted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it has copies, with its columns as they are."""
    narrow = saved(sized(docs, id_col, text, source), "sizes")
    rows = sized(docs, id_col, text, source, [F.struct(*docs.columns).alias("row")])
    taken = planned(rows, narrow, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = saved(sized(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), "sizes")
    return planned(narrow, narrow).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 16) AS digest
  FROM documents
), c AS (
  SELECT *, size - size % (10 ** greatest(length(size::VARCHAR) - 2, 0))::BIGINT AS cls
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM c GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][(place % 3 + 1)::INT] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS most FROM s
), r AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, least(most, max(level) OVER () * weight) AS target,
         ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM r
), k AS (
  SELECT doc_id, size, source_size, target, u,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
         row_number() OVER (PARTITION BY c.source ORDER BY cls, digest, size) AS i
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(floor(i * e + u) - floor((i - 1) * e + u), ceil(e)) * size)::BIGINT AS taken
FROM k
"""
