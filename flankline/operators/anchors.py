"""Anchor detection over hit tables: thresholds, guards, seed confirmation, resolution to features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flankline.operators import scans
from flankline.operators.seeds import best_seeds, close_matches, like_lengths
from flankline.session import joining, saved, tasks_for, tasks_returning

#: So many hits, or datasets, of a target are a block: a row of either is sent once for each block of the other.
BLOCK = 512
HIT_KEYS = ["dataset_name", "analyte", "anchor_family", "protein_accession", "locus_tag"]


def proteins_with_features(proteins: DataFrame, features: DataFrame, key: str, product: str, description: str) -> DataFrame:
    """Left join; the product falls back to the protein's description."""
    return proteins.join(features, key, "left").withColumn(product, F.coalesce(product, description))


def guard(haystack: Sequence[str], family: Column, terms: Mapping[str, Sequence[str]]) -> Column:
    """Some guard term of the family stands in the joined columns; a family without terms is its own term."""
    text = F.lower(F.concat_ws(" ", *haystack))
    known = F.create_map(*(x for k, v in sorted(terms.items()) for x in (F.lit(k), F.array(*map(F.lit, v))))) if terms else None
    wanted = F.coalesce(known[family], F.array(F.lower(family))) if terms else F.array(F.lower(family))
    return F.exists(wanted, lambda t: F.contains(text, t))


def passing(hits: DataFrame, evalue: str, most: float, score: str | None = None, least: float | None = None) -> DataFrame:
    kept = hits.where(F.col(evalue) <= most)
    return kept if score is None or least is None else kept.where(F.col(score) >= least)


def best_hits(hits: DataFrame, query: str, order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    return hits.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def seed_matches(proteins: DataFrame, seeds: DataFrame, sequence: str, seed: str, identity: float = 0.95, coverage: float = 0.95) -> DataFrame:
    """Proteins with the seeds that they match position by position, found by unchanged segments (see :mod:`seeds`). At
    identity 0 all pairs of like length match."""
    if identity == 0:
        return like_lengths(proteins, seeds, sequence, seed, coverage)
    return close_matches(proteins, seeds, sequence, seed, identity, coverage)


def seed_rescue(proteins: DataFrame, seeds: DataFrame, sequence: str, seed: str, haystack: Sequence[str], terms: Mapping[str, Sequence[str]], identity: float = 0.95, coverage: float = 0.95, family: str = "anchor_family") -> DataFrame:
    """Anchor hits of proteins that match a family's seed and pass the family's guard. ``seeds``: analyte, ``family`` and the
    sequence; proteins: dataset_name, protein_accession, locus_tag, gene, product and the sequence. One row for each key, the best match."""
    found = close_matches(proteins, seeds.select("analyte", family, F.col(seed).alias("__seed_text")), sequence, "__seed_text", identity, coverage)
    found = found.where(guard(haystack, F.col(family), terms))
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("locus_tag", "gene", "product")]
    none = F.lit(None).cast("double")
    hits = found.select("dataset_name", "analyte", F.col(family).alias("anchor_family"), "protein_accession", *texts, none.alias("bitscore"), none.alias("e_value"), "identity", "coverage", F.lit("seed_back_confirmed").alias("evidence_type"))
    best = F.max(F.struct("identity", "coverage", "gene", "product")).alias("__b")
    return hits.groupBy(*HIT_KEYS, "bitscore", "e_value", "evidence_type").agg(best).select("dataset_name", "analyte", "anchor_family", "protein_accession", "locus_tag", "__b.gene", "__b.product", "bitscore", "e_value", "__b.identity", "__b.coverage", "evidence_type")


def back_confirmed(hits: DataFrame, seeds: DataFrame, key: Sequence[str], sequence: str, seed: str, family: str, seed_family: str, seed_no: str, identity: float, coverage: float, within: Sequence[str] = ()) -> DataFrame:
    """For each hit the best seed by (identity, coverage), earlier seeds first on ties, and whether it confirms the hit's family.
    ``key`` identifies hits; seeds compare with hits of the same values of ``within`` (the analyte, say)."""
    best = best_seeds(hits, seeds, key, sequence, seed, seed_family, seed_no, within)
    each = hits.groupBy(*key).agg(F.first(family).alias(family))
    on = [F.col(f"h.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    joined = each.alias("h").join(best.alias("b"), on).select("h.*", "b.best_family", "b.identity", "b.coverage")
    sure = (F.col("best_family") == F.col(family)) & (F.col("identity") >= identity) & (F.col("coverage") >= coverage)
    return joined.select(*key, family, "best_family", "identity", "coverage", F.when(sure, "seed_back_confirmed").otherwise("profile_match").alias("evidence_type"))


def hits_with_metadata(hits: DataFrame, metadata: DataFrame, target: str = "target_id", key: str = "protein_accession") -> DataFrame:
    """Each hit with its target's metadata, if there is any; a target that several datasets have gives a row for each.

    There may be very many rows for few targets. The hits and the datasets of a target are dealt into blocks of some ``BLOCK`` rows by their
    digests, each block of hits meets each block of datasets, and these pairs, not the targets, are dealt out to tasks, of which there are as
    many as the counted result asks for. A target without metadata meets an empty row. Hits (or datasets) alike in every column share a block.
    A pair goes dataset by dataset, so that what is written repeats itself and its files stay small.
    """
    spark = hits.sparkSession
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))  # noqa: E731  a null target has a name as well
    digest = lambda t: F.xxhash64(*(f"`{c}`" for c, kind in t.dtypes if "map<" not in kind))
    side = metadata.where(F.col(key).isNotNull())
    n_hits = hits.groupBy(name(target).alias("__t")).agg(F.count("*").alias("__hits"))
    n_sets = side.groupBy(name(key).alias("__t")).agg(F.count("*").alias("__found"))
    met = saved(n_hits.join(n_sets, "__t", "left").withColumn("__sets", F.greatest("__found", F.lit(1))))  # 1: the empty row
    met = met.withColumns({"__hs": F.ceil(F.col("__hits") / BLOCK), "__ds": F.ceil(F.col("__sets") / BLOCK)})
    total = {"few": F.count("*"), "n": F.sum(F.expr("__hits * __sets")), "h": F.sum("__hits"), "d": F.sum("__sets"), "hs": F.sum(F.expr("__hits * __ds")), "ds": F.sum(F.expr("__sets * __hs"))}
    count = {k: v or 0 for k, v in met.agg(*(v.alias(k) for k, v in total.items())).first().asDict().items()}
    met = joining(met, count["few"])
    tasks = tasks_returning(spark, count["n"])

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        """The rows in their blocks, once for each block of the other side."""
        if (n := count[f"{mine}s"]) > 2 * count[mine]:  # few rows, and so few tasks, would make many
            rows = rows.repartition(tasks_for(spark, n), "__t", "__digest")
        rows = rows.join(met, "__t").withColumn(f"__{mine}", F.pmod("__digest", F.col(f"__{mine}s")))
        rows = rows.withColumn(f"__{other}", F.explode(F.sequence(F.lit(0), F.col(f"__{other}s") - 1))).drop("__digest", *met.columns[1:])
        return rows if tasks == 1 else rows.repartition(tasks, "__t", "__h", "__d")

    empty = met.where(F.col("__found").isNull()).select("__t", F.lit(0).cast("long").alias("__digest"))
    sets = side.withColumns({"__t": name(key), "__digest": digest(side)}).drop(key).unionByName(empty, allowMissingColumns=True)
    left, right = dealt(sets, "d", "h").alias("d"), dealt(hits.withColumns({"__t": name(target), "__digest": digest(hits)}), "h", "d").alias("h")
    found = left.join(right.hint("merge"), [F.col(f"d.{c}") == F.col(f"h.{c}") for c in ("__t", "__h", "__d")])
    return found.select(*(f"h.`{c}`" for c in hits.columns), *(f"d.`{c}`" for c in metadata.columns if c != key)).withColumn(key, F.col(target))


def best_hits_with_metadata(best: DataFrame, metadata: DataFrame, order: Sequence[str] = ("dataset_name",), target: str = "target_id", key: str = "protein_accession") -> DataFrame:
    """Best hits that have metadata; of several rows of an accession the first by ``order`` is used."""
    one = best_hits(metadata, key, [F.col(c) for c in order])
    return best.join(one.withColumnRenamed(key, target), target).withColumn(key, F.col(target))


def shard_proteins(proteins: DataFrame, features: DataFrame, datasets: Sequence[str], phylum: str | None = None) -> DataFrame:
    """Proteins of some datasets with their features' columns, if any; the filters prune both tables' folders."""
    keys = ["dataset_name", "protein_accession"]
    some = lambda t: t.where(F.col("dataset_name").isin(*datasets) & (F.lit(True) if phylum is None else F.col("phylum") == phylum))
    more = [c for c in features.columns if c in keys or c not in proteins.columns]
    return some(proteins).join(some(features).select(*more), keys, "left")


def rescued(hits: DataFrame, metadata: DataFrame, order: Sequence[Column], evalue: float, haystack: Sequence[str] = (), terms: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Seed search hits to anchor hits: threshold, best hit of each query, metadata, the family's guard, one row for each key."""
    best = best_hits(passing(hits, "e_value", evalue), "query_id", order)
    found = best_hits_with_metadata(best, metadata)
    if haystack:
        found = found.where(guard(haystack, F.col("anchor_family"), terms or {}))
    keys = [c for c in HIT_KEYS if c in found.columns]
    return best_hits(found.withColumn("__all", F.concat_ws("|", *keys)), "__all", order).drop("__all")


def detect(mode: str, **runs) -> DataFrame:
    """Anchor hits by mode: ``smoke`` (term scan) or ``profile`` (also ``hmmer``; profile hits). ``runs`` are functions without
    arguments; only that of the mode is called."""
    name = {"hmmer": "profile"}.get(mode, mode)
    if name not in ("smoke", "profile") or name not in runs:
        raise NotImplementedError(f"anchor detection by {mode!r}")
    return runs[name]()


def numbered(hits: DataFrame) -> DataFrame:
    """``cluster_id``: 1-based place in the order of dataset, analyte, family, accession and locus tag, by scans over ranges."""
    return scans.numbered(hits, [], HIT_KEYS, "cluster_id").withColumn("cluster_id", F.col("cluster_id").cast("int"))


def resolve(anchors: DataFrame, features: DataFrame, key: str, by: Sequence[tuple[str, str]], within: Sequence[tuple[str, str]], order: Sequence[str]) -> DataFrame:
    """One feature for each anchor: by the first identifier that matches, then by ``order``.

    One equality join for each kind of identifier, united, instead of one join with OR; each can be hashed. Of the features that
    share an identifier only the first by ``order`` can be taken: the others go before the join, by a combined minimum, so that an
    anchor meets one feature for each kind however many share it.
    """
    found = None
    for rank, (mine, theirs) in enumerate(by):
        on = F.col(f"a.{mine}") == F.col(f"f.{theirs}")
        for x, y in within:
            on &= F.col(f"a.{x}") == F.col(f"f.{y}")
        first = F.min_by(F.struct(*features.columns), F.struct(*order)).alias("__first")
        one = features.groupBy(*dict.fromkeys([theirs, *(y for _, y in within)])).agg(first).select("__first.*")
        part = anchors.where(F.col(mine) != "").alias("a").join(one.alias("f"), on)
        part = part.select(F.col(f"a.{key}").alias(key), F.lit(rank).alias("match_rank"), *(F.col(f"f.{c}").alias(c) for c in features.columns if c != key))
        found = part if found is None else found.union(part)
    return best_hits(found, key, [F.col("match_rank"), *map(F.col, order)])


def require_all(anchors: DataFrame, resolved: DataFrame, key: str) -> None:
    missing = anchors.join(resolved, key, "left_anti").select(key).take(5)
    if missing:
        raise ValueError(f"anchors without a feature: {[r[0] for r in missing]}")
