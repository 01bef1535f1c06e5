"""Audit of how sources differ within a language: two-dimensional tiles of group blocks over vocabulary chunks.

Terms are counted once, by group (language, source). A language's kept terms are dealt into chunks, and each group's counts
in a chunk are packed into one row. The groups of a language are dealt into blocks; a packed row is replicated to the tiles of
its block with every block, and a tile walks over its successive chunks, adding each chunk's part to its submatrix of pairs. A
tile's chunks are cut into spans of their own tasks, so neither a language nor a pair of blocks is one task.

Everything is integer arithmetic: a share is ``1 + floor(10^9 (count + 2) / (N + 2 V))``.

Defined results: null text, language and source are empty strings, and such a group counts like any other; a group without
terms has counts of zero; a language without kept terms gives pairs of value 0 and no terms; repeated rows count as often as
they stand; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import column, saved, table

#: A language keeps a term that stands in so many of its documents.
LEAST_DOCS = 10
TOP = 10
#: Groups of a block and terms of a chunk (both on average: they are dealt by hashes), chunks of a task.
BLOCK, CHUNK, SPAN = 32, 1024, 64
#: Terms that a task counts before it hands them on.
HELD = 200_000
SCALE = 10**9
#: Letters are A-Z, a-z and whatever is not ASCII; A-Z become a-z and the rest parts words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of ``text``, some ``size`` bytes at a time, so that a very long text is never a list of all its words."""
    body = text.translate(LETTERS)
    start = 0
    while start < len(body):
        end = body.find(b" ", start + size)
        end = len(body) if end < 0 else end
        yield body[start:end].split()
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of ``docs`` with columns lang, source and text; each occurring group has a row of the
    empty term besides."""

    def run(batches):
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def rows():
            for (lang, source), (n, docs) in counts.items():
                names = [b"", *n]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(names), pa.string()),
                        pa.array([source] * len(names), pa.string()),
                        pa.array(names, pa.binary()),
                        pa.array([0, *n.values()], pa.int64()),
                        pa.array([0, *(docs[t] for t in n)], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            for lang, source, text in zip(column(batch, "lang"), column(batch, "source"), batch.column(2), strict=True):
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in pieces(text.as_py()):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                held += len(n) - before
                if held > HELD:
                    yield from rows()
                    counts, held = {}, 0
        yield from rows()

    given = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = given.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (counts + 2) / total), by long division, so that nothing overflows below totals of 9 * 10^13; beyond them
    by Python's integers."""
    if total >= 9 * 10**13:
        return np.array([1 + SCALE * (int(c) + 2) // total for c in counts], np.int64)
    whole, rest = np.divmod(counts + 2, total)
    first, rest = np.divmod(rest * 10**5, total)
    return 1 + whole * SCALE + first * 10**4 + rest * 10**4 // total


def tile(rows) -> Iterator[tuple[str, str, str, int]]:
    """(lang, source, other, sum of f) of each pair in each tile and span. ``rows`` come sorted by tile, span and chunk, the two
    blocks' groups (chunk -1) first: ((lang, i, j, span), chunk, block, source, total, width, places, counts)."""
    key = None
    groups: dict[int, dict[str, int]] = {}
    totals: dict[int, list[int]] = {}
    sums: np.ndarray | None = None
    chunk, width, held = -1, 0, []

    def submatrix() -> np.ndarray:
        return np.zeros([len(groups.get(block, ())) for block in key[1:3]], np.int64) if sums is None else sums

    def added() -> np.ndarray:
        """The submatrix with the part of the chunk at hand."""
        out = submatrix()
        if not held or not out.size:
            return out
        own = {}
        for block in groups:
            absent = [shares(np.zeros(1, np.int64), t)[0] for t in totals[block]]
            own[block] = np.repeat(np.array(absent, np.int64), width).reshape(len(absent), width)
        for block, source, places, counts in held:
            at = groups[block][source]
            own[block][at, places] = shares(counts, totals[block][at])
        i, j = key[1], key[2]
        for a, mine in enumerate(own[i]):
            others = own[j][a + 1 :] if i == j else own[j]
            gap, both = others - mine, others + mine
            out[a, len(own[j]) - len(others) :] += (gap * gap // both).sum(axis=1)
        return out

    def pairs(values: np.ndarray):
        i, j = key[1], key[2]
        right = list(groups.get(j, ()))
        for a, source in enumerate(groups.get(i, ())):
            for b in range(a + 1 if i == j else 0, len(right)):
                yield key[0], source, right[b], int(values[a, b])

    for now, at, block, source, total, size, places, counts in rows:
        if now != key:
            if key is not None:
                yield from pairs(added())
            key, chunk, held, groups, totals, sums = now, -1, [], {}, {}, None
        if at < 0:
            groups.setdefault(block, {})[source] = len(groups.get(block, ()))
            totals.setdefault(block, []).append(total)
            continue
        if at != chunk:
            sums = added()
            chunk, width, held = at, size, []
        held.append((block, source, places, counts))
    if key is not None:
        yield from pairs(added())


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its other sources by divergence (part ``pair``), and the ten terms
    that set it most apart from its language (part ``term``)."""
    counts = saved(term_counts(docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))), "counts")
    kept = saved(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(f"docs >= {LEAST_DOCS}").drop("docs"), "kept")
    group_names = counts.where("term = ''").select("lang", "source")
    languages = (
        group_names.groupBy("lang")
        .agg(F.count("*").alias("groups"))
        .join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n")), "lang", "left")
        .select("lang", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("v", "lang_n")), F.ceil(F.col("groups") / BLOCK).cast("int").alias("blocks"))
    )
    languages = saved(languages.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("v") / CHUNK)).cast("int")), "languages")
    in_chunk = kept.join(languages.select("lang", "chunks"), "lang").groupBy("lang", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"))
    numbered = in_chunk.agg(F.collect_list(F.struct("term", "all")).alias("terms"))
    numbered = numbered.select("lang", "chunk", F.size("terms").alias("width"), F.posexplode("terms").alias("place", "t")).select("lang", "chunk", "width", "place", "t.term", "t.all")
    own = saved(counts.join(numbered, ["lang", "term"]).drop("docs"), "own")
    groups = group_names.join(own.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(languages, "lang")
    groups = groups.select("lang", "source", "v", "lang_n", "blocks", "chunks", F.coalesce("group_n", F.lit(0)).alias("group_n"), F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"))
    groups = saved(groups.withColumn("total", F.col("group_n") + 2 * F.col("v")), "groups")
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = [
        part.withColumn("rank", F.row_number().over(by_group)).where(keep).select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
        for name, part, keep in (("pair", pair_values(groups, own), "true"), ("term", term_values(groups, own), f"rank <= {TOP}"))
    ]
    return out[0].union(out[1])


def pair_values(groups: DataFrame, own: DataFrame) -> DataFrame:
    """(lang, source, item, value) for both directions of each pair of sources of a language."""
    packed = own.groupBy("lang", "source", "chunk", "width").agg(F.collect_list(F.struct("place", "n")).alias("counts"))
    packed = packed.join(groups, ["lang", "source"]).withColumn("span", F.floor(F.col("chunk") / SPAN).cast("int"))
    spans = F.sequence(F.lit(0), F.floor((F.col("chunks") - 1) / SPAN).cast("int"))
    listed = groups.select("*", F.lit(-1).alias("chunk"), F.lit(0).alias("width"), F.array().cast("array<struct<place:int,n:bigint>>").alias("counts"), F.explode(spans).alias("span"))
    fields = ["lang", "i", "j", "span", "chunk", "block", "source", "total", "width", "counts"]
    met = packed.unionByName(listed, allowMissingColumns=True).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *(c for c in fields if c not in "ij"))
    tiles = met.select(*fields).repartition("lang", "i", "j", "span").sortWithinPartitions("lang", "i", "j", "span", "chunk", "block", "source")

    def rows(batches):
        for batch in batches:
            lists = batch.column(9)
            places, counts = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("place", "n"))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            lang, i, j, span, chunk, block, source, total, width = (batch.column(k).to_pylist() for k in range(9))
            start = 0
            for k, end in enumerate(ends.tolist()):
                yield (lang[k], i[k], j[k], span[k]), chunk[k], block[k], source[k], total[k], width[k], places[start:end], counts[start:end]
                start = end

    def run(batches):
        held: list[tuple] = []
        for row in tile(rows(batches)):
            held.append(row)
            if len(held) >= 1 << 14:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema)

    names = ["lang", "source", "item", "value"]
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    sums = tiles.mapInArrow(run, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return sums.select("lang", "value", F.explode(both).alias("p")).select("lang", "p.source", "p.item", "value")


def term_values(groups: DataFrame, own: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has more often than its language."""
    share = "1 + (1000000000BD * ({} + 2)) div ({} + 2 * v)"
    both = own.join(groups, ["lang", "source"]).select("lang", "source", "term", F.expr(share.format("n", "group_n")).alias("p"), F.expr(share.format("all", "lang_n")).alias("q"))
    return both.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_count FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 10),
l AS (SELECT lang, count(*) AS v, sum(lang_count) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.n, 0) + 2 * l.v) AS p,
         1 + (1000000000 * (k.lang_count + 2)) // (l.n + 2 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""
