"""Taxonomy trees as tables: depths and intervals by pointer jumping, ancestor closure, rank pivot, lookups.

*Pointer jumping*: in each round every row skips to where its successor skips to, and adds what that has counted. A list of m
steps takes log2(m) rounds of one equality join. On parent pointers it gives each node's depth, in log2(depth) rounds. Whoever
still has a pointer after log2(n) rounds is on a cycle or below one: that is how cycles are found, and no depth is taken for one.

*Counts below*: whoever points somewhere also hands on what it has counted itself. After k rounds a node has counted what is less
than 2^k steps below it, so log2(depth) rounds give the size of every subtree.

*Intervals*: in depth-first order a node stands behind its parent, after all that is below its elder siblings. A running sum
of sizes over siblings, by ranges of sorted rows, says how far; the sum of those steps up to the root is one more pointer jumping.
That gives every node ``pre`` (its number in depth-first order, from 1), ``last`` (the greatest number below it) and ``depth``. Then
"below this node" is ``pre BETWEEN``, and there are as many rows as nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flankline.operators import scans
from flankline.session import joining, saved

RANKS = ("superkingdom", "phylum", "class", "order", "family", "genus", "species")


def parents(nodes: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, up): the parent of each node; null for a root, which is its own parent, has none or has one that is no node."""
    pairs = nodes.select(F.col(child).alias("node"), F.col(parent).alias("up"))
    # parents are few beside nodes: only they are looked for
    known = saved(pairs.select("up").distinct().join(pairs.select(F.col("node").alias("up")).hint("merge"), "up", "left_semi").withColumn("__known", F.lit(True)))
    return pairs.join(joining(known, known.count()), "up", "left").select("node", F.when(F.col("__known") & (F.col("up") != F.col("node")), F.col("up")).alias("up"))


def jumped(steps: DataFrame, most: int, handed: Sequence[str] = ()) -> DataFrame:
    """(step, next, the sums from each step to its list's end) of (step, next and columns to sum), after at most ``most`` rounds;
    ``next`` is null unless the list has no end. Columns of ``handed`` are summed the other way: over a step and all whose lists
    lead through it. Rounds are saved, as are the rows that others point to, which are few where many point to one."""
    sums = [c for c in steps.columns if c not in ("step", "next", *handed)]
    now = saved(steps)
    for _ in range(most):
        asked = saved(now.where("next IS NOT NULL").groupBy("next").agg(F.lit(True).alias("__asked"), *(F.sum(c).alias(f"__{c}") for c in handed)))
        n = asked.count()
        if not n:
            break
        asked = joining(asked, n)
        came = asked.select(F.col("next").alias("step"), *(f"__{c}" for c in handed))
        ahead = saved(now.select(F.col("step").alias("next"), F.col("next").alias("__far"), *(F.col(c).alias(f"__{c}") for c in sums)).join(asked.select("next"), "next"))
        met = now.join(came, "step", "left") if handed else now
        met = met.join(joining(ahead, n), "next", "left")
        added = ((F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in (*sums, *handed))
        now = saved(met.select("step", F.col("__far").alias("next"), *added))
    return now


def sized(nodes: DataFrame, child: str, parent: str) -> tuple[DataFrame, int]:
    """(node, up, depth, below) of every node, and their number: roots are at depth 0, and a node is below itself. Cycles and nodes that are listed
    twice are errors."""
    tree = saved(parents(nodes, child, parent))
    n = tree.count()
    if tree.select("node").distinct().count() != n:
        raise ValueError("a node is listed twice")
    told = jumped(tree.select(F.col("node").alias("step"), F.col("up").alias("next"), F.col("up").isNotNull().cast("long").alias("depth"), F.lit(1).cast("long").alias("below")), ceil(log2(n + 1)) + 1, ["below"])
    if not told.where("next IS NOT NULL").isEmpty():
        raise ValueError("the taxonomy has a cycle")
    return tree.join(told.select(F.col("step").alias("node"), "depth", "below").hint("merge"), "node").select("node", "up", "depth", "below"), n


def depths(nodes: DataFrame, child: str = "taxon_id", parent: str = "parent_id") -> DataFrame:
    """(node, up, depth) of every node, roots at 0; cycles and nodes that are listed twice are errors."""
    return sized(nodes, child, parent)[0].drop("below")


def intervals(nodes: DataFrame, child: str = "taxon_id", parent: str = "parent_id") -> DataFrame:
    """(node, up, pre, last, depth): the nodes' intervals; children stand in order of their ids, and so do the trees of a forest."""
    tree, n = sized(nodes, child, parent)
    if not n:
        return tree.select("node", "up", F.col("depth").alias("pre"), F.col("depth").alias("last"), "depth")
    placed = scans.running_sums(scans.ranged(tree, ["up"], ["node"]), ["up"], ["node"], {"elder": F.col("below")}, inclusive=False).drop(scans.PART)
    placed = saved(placed)
    told = jumped(placed.select(F.col("node").alias("step"), F.col("up").alias("next"), (F.col("elder") + 1).alias("pre")), ceil(log2(n + 1)) + 1)
    met = placed.join(told.select(F.col("step").alias("node"), "pre").hint("merge"), "node")
    return met.select("node", "up", "pre", (F.col("pre") + F.col("below") - 1).alias("last"), "depth")


def below(placed: DataFrame, node) -> DataFrame:
    """The nodes below ``node``, itself first: a range of ``pre``, which a store in that order reads as a slice."""
    found = placed.where(F.col("node") == node).select("pre", "last").first()
    return placed.where(F.col("pre").between(found["pre"], found["last"])) if found else placed.where("false")


def ancestor_closure(nodes: DataFrame, child: str = "taxon_id", parent: str = "parent_id") -> DataFrame:
    """(node, ancestor, distance) for every node and each of its ancestors, itself at 0.

    Path lengths double with each join, so a tree of depth d takes log2(d) rounds. Depths come first, which find cycles."""
    placed = saved(depths(nodes, child, parent))
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    paths = placed.where("up IS NOT NULL").select("node", F.col("up").alias("ancestor"), F.lit(1).alias("distance"))
    reach = 1
    while reach < deepest:
        jump = paths.where(F.col("distance") == reach).select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"))
        longer = paths.join(jump, "ancestor").select("node", F.col("far").alias("ancestor"), (F.col("distance") + reach).alias("distance"))
        paths = saved(paths.union(longer))  # read by every later round; the plan must not double with it
        reach *= 2
    return placed.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")).union(paths)


def lineage_pivot(closure: DataFrame, names: DataFrame, ranks: Sequence[str], node: str = "node", rank: str = "rank", name: str = "name") -> DataFrame:
    """One row for each node: its own name and its ancestors' names by rank. ``names`` has ancestor, rank, name."""
    joined = closure.join(names, "ancestor")
    return joined.groupBy(node).agg(
        F.max(F.when(F.col("distance") == 0, F.col(name))).alias("organism"),
        *(F.max(F.when(F.col(rank) == r, F.col(name))).alias(r) for r in ranks),
    )


def lineages(placed: DataFrame, names: DataFrame, ranks: Sequence[str], size: int = 1 << 14) -> DataFrame:
    """(node, organism, a column for each rank): what :func:`lineage_pivot` makes of the closure, without writing that.

    Nodes are cut into ranges of ``size`` numbers in depth-first order. A range needs the ranked nodes whose intervals reach into it:
    those that hold all of it are one name for each rank, the others begin or end inside. ``names``: node, rank, name, one
    row for a node; of two ancestors of one rank the greatest name counts."""
    order = list(ranks)
    # names are as many as nodes: neither they nor what is collected of them may be sent to every task
    every = saved(placed.join(names.hint("merge"), "node", "left").withColumn("range", F.floor(F.col("pre") / size)))
    first, end = F.col("range") * size, (F.col("range") + 1) * size - 1
    reached = F.explode(F.sequence(F.col("range"), F.floor(F.col("last") / size)))
    ranked = every.where(F.col("rank").isin(*order) & F.col("name").isNotNull()).select("rank", "name", "pre", "last", reached.alias("range"))
    holds = (F.col("pre") <= first) & (F.col("last") >= end)
    around = ranked.where(holds).groupBy("range").agg(*(F.max(F.when(F.col("rank") == r, F.col("name"))).alias(f"r{k}") for k, r in enumerate(order)))
    inside = ranked.where(~holds).groupBy("range").agg(F.sort_array(F.collect_list(F.struct("pre", "last", "rank", "name"))).alias("inside"))
    nodes = every.groupBy("range").agg(F.sort_array(F.collect_list(F.struct("pre", "node", "name"))).alias("nodes"))

    def run(batches):
        for batch in batches:
            kind = batch.schema.field("nodes").type.value_type.field("node").type
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                waiting, reaching, out = iter(row["inside"] or []), [], []
                coming = next(waiting, None)
                for n in row["nodes"]:
                    while coming is not None and coming["pre"] <= n["pre"]:
                        reaching.append(coming)
                        coming = next(waiting, None)
                    reaching = [o for o in reaching if o["last"] >= n["pre"]]
                    values = [row[f"r{k}"] for k in range(len(order))]
                    for o in reaching:
                        k = order.index(o["rank"])
                        values[k] = o["name"] if values[k] is None else max(values[k], o["name"])
                    out.append((n["node"], n["name"], *values))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.string()) for c in columns[1:])], names=["node", "organism", *order])

    kind = placed.schema["node"].dataType.simpleString()
    met = nodes.join(inside.hint("merge"), "range", "left").join(around.hint("merge"), "range", "left")
    return met.mapInArrow(run, f"node {kind}, organism string, " + ", ".join(f"`{r}` string" for r in order))


def lookup_lineage(pivot: DataFrame, node: str, value) -> dict[str, str]:
    """The filled ranks of one node; nothing for an unknown one."""
    row = pivot.where(F.col(node) == value).first()
    return {k: v for k, v in row.asDict().items() if v} if row else {}


def taxonomy_value(rank: str, columns: Sequence[str], default: str) -> Column:
    """A rank's name, or what stands in for it: the organism's first word for genus, the taxon's number for family, and for
    phylum the analyte where ``default`` is empty; else ``default``."""
    given = F.nullif(F.trim(F.col(rank)), F.lit("")) if rank in columns else F.lit(None).cast("string")
    stand_in = F.lit(None).cast("string")
    if rank == "genus" and "organism" in columns:
        stand_in = F.nullif(F.substring_index(F.trim(F.col("organism")), " ", 1), F.lit(""))
    elif rank == "family" and "taxon_id" in columns:
        stand_in = F.col("taxon_id").cast("string")
    elif rank == "phylum" and "analyte" in columns and default == "":
        stand_in = F.nullif(F.col("analyte"), F.lit(""))
    return F.coalesce(given, stand_in, F.lit(default))


def fill_taxonomy(rows: DataFrame, lineage: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join of the columns that ``rows`` lacks; of several lineage rows of a key the least in those columns is used."""
    missing = [c for c in columns if c not in rows.columns]
    if not missing:
        return rows
    side = lineage.groupBy(key).agg(F.min(F.struct(*missing)).alias("__l")).select(key, "__l.*")
    return rows.join(side, key, "left")
