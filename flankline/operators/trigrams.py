"""A trigram index: substring search by equality joins on three-letter pieces, each candidate verified on the text itself.

``postings`` has a row for each gram of each text: the gram and the text's number, a hash of the searched columns, so that equal
texts are indexed once and no key is asked for; two texts of one number are both candidates, and only what holds the term stays.
Texts are lower-cased and stand between two end marks, so that a text of any length has grams and a term of one or two
letters is part of some gram. ``dictionary`` has each gram and in how many texts it stands. Both can be kept beside the
store (:func:`write_index`). A search joins a few of a term's rarest grams with the postings, by equality, and reads the text of
the rows that have them all.

A term of three letters or more has grams of its own. A shorter one stands for the grams that it is part of, which the dictionary
lists; without one it is compared with every row. So is a term without any letter between its wildcards, which asks for that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flankline.session import FEW, joining, saved

GRAM = 3
#: Of a term's grams, so many of the rarest are looked up.
LOOKED_UP = 3
#: End marks: they stand in no text and no term.
OPEN, CLOSE = "\u0002", "\u0003"


def grams_of(text: Column) -> Column:
    """The different grams of a text, its end marks included."""
    whole = F.concat(F.lit(OPEN * (GRAM - 1)), F.lower(text), F.lit(CLOSE * (GRAM - 1)))
    return F.array_distinct(windows(whole))


def windows(text: Column) -> Column:
    """All pieces of ``GRAM`` letters: letters once, then neighbours, instead of a substring for each place."""
    letters = F.split(text, "")
    return F.transform(F.sequence(F.lit(1), F.size(letters) - (GRAM - 1)), lambda i: F.concat(*(F.element_at(letters, (i + k).cast("int")) for k in range(GRAM))))


def text_id(columns: Sequence[str]) -> Column:
    return F.xxhash64(*columns)


def postings(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(gram, text_id): each gram that one of the columns has."""
    every = F.array_distinct(F.flatten(F.array(*(F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(grams_of(F.col(c))) for c in columns))))
    return rows.select(text_id(columns).alias("text_id"), F.explode(every).alias("gram"))


def dictionary(posted: DataFrame) -> DataFrame:
    """(gram, n_texts)."""
    return posted.groupBy("gram").agg(F.count("*").alias("n_texts"))


def write_index(rows: DataFrame, columns: Sequence[str], folder: str) -> None:
    """Keep the index of ``rows`` in ``folder``: postings in order of grams, so that a lookup reads few row groups."""
    spark = rows.sparkSession
    posted = postings(rows.select(*columns).distinct(), columns)
    posted.repartition("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/postings")
    dictionary(spark.read.parquet(f"{folder}/postings")).write.mode("overwrite").parquet(f"{folder}/dictionary")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/dictionary")


def pieces(term: Column, wildcards: bool) -> Column:
    """The strings that a text must hold for the term to match: the term itself, or what stands between its wildcards."""
    parts = F.split(F.lower(term), r"\\.|[%_]") if wildcards else F.array(F.lower(term))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def candidates(posted: DataFrame, known: DataFrame | None, terms: DataFrame, wildcards: bool = True) -> tuple[DataFrame, DataFrame]:
    """(term, text_id) of the texts that have the grams of a term, and the terms that must be compared with every text. ``terms``
    has a column term, each value once."""
    asked = terms.withColumn("pieces", pieces(F.col("term"), wildcards))
    long = asked.select("term", F.filter("pieces", lambda p: F.length(p) >= GRAM).alias("pieces")).where("size(pieces) > 0")
    wanted = long.select("term", F.explode(F.array_distinct(F.flatten(F.transform("pieces", windows)))).alias("gram"))
    rarity = F.lit(0)
    if known is not None:
        wanted, rarity = wanted.join(known, "gram", "left"), F.coalesce("n_texts", F.lit(0))
    few = wanted.groupBy("term").agg(F.slice(F.array_sort(F.collect_list(F.struct(rarity.alias("n"), "gram"))), 1, LOOKED_UP).alias("g"))
    looked_up = few.select("term", F.size("g").alias("of"), F.explode("g.gram").alias("gram"))
    # postings are many times the texts: they stay where they are and only grams that are looked up leave a task
    looked_up = joining(looked_up, LOOKED_UP * terms.limit(FEW).count())
    met = looked_up.join(posted, "gram").groupBy("term", "text_id").agg(F.count_distinct("gram").alias("n"), F.any_value("of").alias("of"))
    found = met.where("n = of").select("term", "text_id")
    short = asked.where(F.forall("pieces", lambda p: F.length(p) < GRAM))
    if known is None:
        return found, short.select("term")
    longest = short.where("size(pieces) > 0").select("term", F.array_max(F.transform("pieces", lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"].alias("piece"))
    parts = F.array_distinct(F.array(*(F.substring("gram", i + 1, n) for n in range(1, GRAM) for i in range(GRAM - n + 1))))
    stands_for = saved(longest.join(known.select("gram", F.explode(parts).alias("piece")).hint("merge"), "piece").select("term", "gram"))
    stands_for = joining(stands_for, stands_for.count())
    found = found.union(stands_for.join(posted, "gram").select("term", "text_id").distinct())
    return found, short.where("size(pieces) = 0").select("term")


def matches(rows: DataFrame, terms: DataFrame, term: str, columns: Sequence[str], index: tuple[DataFrame, DataFrame] | None = None, wildcards: bool = True) -> DataFrame:
    """Rows joined with the terms that one of their columns holds, case aside: what a nested loop over both would find, with
    ``%term%`` as a LIKE pattern or, without ``wildcards``, by containment (an empty term is then in no row). ``index`` is
    that of the rows' ``columns``; without it grams are made on the way, and only looked-up ones leave their task's join.
    Neither the rows nor their grams are ever sent to every task; the texts found are, if they are few."""
    posted, known = index or (postings(rows.select(*columns).distinct(), columns), None)
    each = terms.select(F.col(term).alias("term")).where("term IS NOT NULL" + ("" if wildcards else " AND term <> ''")).distinct()
    found, every = candidates(posted, known, each, wildcards)
    named = [F.col(c).alias(f"__{c}") for c in rows.columns]
    numbered = rows.select(*named, text_id(columns).alias("text_id"))
    found = saved(found)
    met = numbered.join(joining(found, found.count()), "text_id").select(*(f"__{c}" for c in rows.columns), "term")
    if not every.isEmpty():
        met = met.unionByName(numbered.drop("text_id").crossJoin(F.broadcast(every)))
    hit = F.lit(False)
    for c in columns:
        text, wanted = F.col(f"__{c}"), F.col("term")
        hit |= F.coalesce(F.ilike(text, F.concat(F.lit("%"), wanted, F.lit("%"))) if wildcards else F.contains(F.lower(text), F.lower(wanted)), F.lit(False))
    met = met.where(hit).select(*(F.col(f"__{c}").alias(c) for c in rows.columns), F.col("term").alias("__term"))
    return met.join(joining(terms.withColumn("__term", F.col(term)), terms.limit(FEW + 1).count()), "__term").drop("__term")
