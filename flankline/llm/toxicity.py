"""Toxicity: boosted trees over dense features, with isotonic calibration.

The features are densities of a learned lexicon (whole words and their beginnings, also after undoing
common letter substitutions), the weight of its strongest word, how near its words stand to second-person words, capitals, punctuation
and the rate of obfuscated words. They are learned from a bounded sample of labelled rows (``sample`` of each class), lexicon and
calibration by folds, so that neither sees the rows that it describes; scoring is one pass over whole texts.

Defined results: null and empty texts have all features zero and get the model's score for that;
equal texts get equal scores; null labels are ignored and contradicting labels of one id count as toxic;
with no usable labels every score is 0; an empty table gives an empty result; further columns are ignored, and a kept
column named like the result gives way to it (put rows into a struct to keep them whole).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .boosting import fit_steps, fit_trees
from .shared import bucket_of, clear_of, column, saved, some_rows, table

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 4000
#: Beginnings of words, so many letters long, that are terms beside the words.
STEMS = (4, 5)
FOLDS = 4
#: A term enters the lexicon if it stands in so many toxic documents and so many times the clean documents' share.
LEAST_DOCS, LEAST_RATIO, MOST_TERMS = 4, 8.0, 4000
#: ... and if the likelihood ratio against chance (G squared) is so large, or half of what the classes can give where they are
#: small: among very many rare words some stand in toxic documents only by chance.
LEAST_EVIDENCE = 24.0
MEMO = 400_000
NEAR = 4
FEATURES = ["log_words", "lexicon", "lexicon_weight", "stems", "undone", "hits", "distinct", "near_second", "second", "shouted", "capitals", "exclaimed", "asked", "symbols", "obfuscated", "digits", "strongest", "weight"]

# fixed values: second-person words of the languages at hand, and letter substitutions
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
SUBSTITUTED = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
# end of fixed values

_LETTERS = re.compile(r"[^\W\d_]+")
_EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»„“”‚‘’…–—¡¿"
HIT, STEMMED, UNDONE, SECOND, SHOUTED, OBFUSCATED = 1, 2, 4, 8, 16, 32


def terms(text: str) -> set[str]:
    """Words of a text in lower case and, marked by #, the beginnings of longer words."""
    words = set(_LETTERS.findall(text.lower()))
    return words.union(*({"#" + w[:k] for w in words if len(w) > k} for k in STEMS))


class Tokens(dict):
    """Flags of a token, worked out once; the memo is emptied when it grows beyond its bound."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        core = token.strip(_EDGES)
        word = core.lower()
        flags = SHOUTED if len(core) > 2 and core.isupper() else 0
        if word in SECOND_PERSON:
            flags |= SECOND
        if word.isalpha():
            flags |= HIT * (word in self.lexicon) | STEMMED * any("#" + word[:k] in self.lexicon for k in STEMS if len(word) > k)
        elif word:
            plain = "".join(_LETTERS.findall((core if core[-1:].isalnum() else token).lower().translate(SUBSTITUTED)))
            letters = sum(map(str.isalpha, word))
            if letters >= 2 and len(plain) > 2:
                flags |= OBFUSCATED | UNDONE * (plain in self.lexicon)
            flags |= HIT * any(w in self.lexicon for w in _LETTERS.findall(word))
        self[token] = flags
        return flags

    def weight(self, token: str) -> float:
        words = _LETTERS.findall(token.lower())
        found = self.lexicon.get
        return max((max(found(w, 0.0), *(found("#" + w[:k], 0.0) for k in STEMS)) for w in words), default=0.0)


def features(text: str | None, tokens: Tokens) -> list[float]:
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    flags = np.fromiter(map(tokens.__getitem__, words), np.uint8, n)
    marked = np.flatnonzero(flags)
    f = flags[marked]
    hits = marked[(f & (HIT | STEMMED | UNDONE)) > 0]
    second = marked[(f & SECOND) > 0]
    near = 0
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(hits - second[np.maximum(at - 1, 0)]))
        near = int((gap <= NEAR).sum())
    found = [words[i] for i in hits]
    weights = [tokens.weight(w) for w in found]
    chars = len(text)
    count = text.count
    capitals = sum(map(count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(count, "0123456789"))
    rate = lambda flag: float((f & flag > 0).sum()) / n
    return [
        np.log1p(n),
        rate(HIT),
        sum(weights) / n,
        rate(STEMMED),
        rate(UNDONE),
        np.log1p(len(hits)),
        np.log1p(len({w.strip(_EDGES).lower() for w in found})),
        near / n,
        len(second) / n,
        rate(SHOUTED),
        capitals / chars,
        count("!") / chars,
        count("?") / chars,
        sum(map(count, "*#$%&@^~")) / chars,
        rate(OBFUSCATED),
        digits / chars,
        max(weights, default=0.0),
        np.log1p(sum(weights)),
    ]


def sampled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text: str, sample: int, where) -> tuple[DataFrame, dict[int, int]]:
    """(id, text, y, fold) of at most ``sample`` labelled rows of each class, and how many rows each class has.
    Only the chosen ids are broadcast, so the documents are read once and not shuffled."""
    known = labels.where(where & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label)).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = some_rows(known.where("y = 1"), id_col, sample, 1).union(some_rows(known.where("y = 0"), id_col, sample, 1))
    rows = docs.select(id_col, F.col(text).alias("text")).join(F.broadcast(chosen), id_col)
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(FOLDS)).cast("int")), sizes


def learn_lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Terms that mark toxic documents, with their smoothed log-odds, from (text, y, fold): for each fold the
    lexicon of the other folds, and last that of all."""
    kinds = [(y, k) for y in (1, 0) for k in range(FOLDS)]
    names = [f"n{y}{k}" for y, k in kinds]

    def run(batches):
        seen = {kind: Counter() for kind in kinds}
        for batch in batches:
            for text, y, fold in zip(column(batch, "text"), column(batch, "y"), column(batch, "fold"), strict=True):
                seen[y, fold].update(terms(text or ""))
                seen[y, fold][""] += 1
        every = list(set().union(*seen.values()))
        for i in range(0, len(every), 10_000):
            some = every[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array([seen[kind][t] for t in some], pa.int64()) for kind in kinds)], names=["term", *names])

    schema = ", ".join(["term string", *(f"{n} long" for n in names)])
    counts = rows.select("text", "y", "fold").mapInArrow(run, schema).groupBy("term").agg(*(F.sum(n).alias(n) for n in names))
    totals = counts.where("term = ''").first()
    if totals is None:
        return [{}] * (FOLDS + 1)
    bad, good = (sum((F.col(f"n{y}{k}") for k in range(FOLDS)), F.lit(0)) for y in (1, 0))
    t = {kind: totals[n] for kind, n in zip(kinds, names, strict=True)}
    all_bad, all_good = (sum(t[y, k] for k in range(FOLDS)) for y in (1, 0))
    least = min(LEAST_DOCS, max(2, all_bad // 10))
    odds = F.log((bad + 0.5) / (all_bad + 1.0)) - F.log((good + 0.5) / (all_good + 1.0))
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / ((bad + good) * share))).otherwise(0.0)
    evidence = 2 * (part(bad, all_bad / (all_bad + all_good)) + part(good, all_good / (all_bad + all_good)))
    enough = min(LEAST_EVIDENCE, all_bad * float(np.log((all_bad + all_good) / max(all_bad, 1))))
    best = counts.where(F.col("term") != "").where((bad >= least) & (evidence >= enough)).withColumn("odds", odds).where(F.col("odds") >= float(np.log(LEAST_RATIO)))
    got = best.withColumn("evidence", evidence).orderBy(F.desc("evidence"), "term").limit(MOST_TERMS).collect()
    out = []
    for left in range(FOLDS + 1):
        use = [k for k in range(FOLDS) if k != left]
        nb, ng = (sum(t[y, k] for k in use) for y in (1, 0))
        lexicon = {}
        for r in got:
            b, g = (sum(r[f"n{y}{k}"] for k in use) for y in (1, 0))
            value = float(np.log((b + 0.5) / (nb + 1)) - np.log((g + 0.5) / (ng + 1)))
            if b >= max(2, least - (left < FOLDS)) and value >= np.log(LEAST_RATIO):
                lexicon[r["term"]] = value
        out.append(lexicon)
    return out


def fitted(docs: DataFrame, labels: DataFrame, where, label: str = "toxic", id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[dict[str, float], Callable[[np.ndarray], np.ndarray]]:
    """The lexicon and a function from features to calibrated scores. A row's features come from the lexicon of the
    other folds, and what the calibration sees of a row from trees of the other folds."""
    rows, sizes = sampled(docs, labels, label, id_col, text, sample, where)
    rows = saved(rows, "sample")  # read twice, and few
    lexicons = learn_lexicons(rows)

    def run(batches):
        tokens = [Tokens(x) for x in lexicons]
        for batch in batches:
            x = [features(t, tokens[k]) for t, k in zip(column(batch, "text"), column(batch, "fold"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "fold", "x"])

    kind = rows.schema[id_col].dataType.simpleString()
    got = rows.select(F.col(id_col).alias("id"), "y", "fold", "text").mapInArrow(run, f"id {kind}, y int, fold int, x array<double>").collect()
    got.sort(key=lambda r: (r["id"], r["x"]))
    y, fold = np.array([r["y"] for r in got], float), np.array([r["fold"] for r in got])
    if len(set(y.tolist())) < 2:
        return lexicons[-1], lambda x: np.zeros(len(x))
    x = np.array([r["x"] for r in got])
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    raw = np.zeros(len(y))
    for held in (fold < FOLDS // 2, fold >= FOLDS // 2):
        learn = ~held if len(set(y[~held].tolist())) == 2 else np.ones(len(y), bool)
        raw[held] = fit_trees(x[learn], y[learn], weight[learn]).raw(x[held])
    trees, steps = fit_trees(x, y, weight), fit_steps(raw, y, weight)
    return lexicons[-1], lambda x: np.clip(steps(trees.raw(x)), 0, 1)


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep: list[str], where=None, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``keep`` columns of ``docs`` and ``toxic_score``; ``where`` says which labelled rows may be learned from."""
    keep = [c for c in keep if c.lower() != "toxic_score"]
    (body,) = clear_of([*keep, "toxic_score"], "text")
    lexicon, model = fitted(docs, labels, F.lit(True) if where is None else where, id_col=id_col, text=text, sample=sample)

    def run(batches):
        tokens = Tokens(lexicon)
        for batch in batches:
            x = np.array([features(t, tokens) for t in column(batch, body)]).reshape(-1, len(FEATURES))
            rest = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(model(x))], names=[*keep, "toxic_score"])

    source = docs.select(*keep, F.col(text).alias(body))
    return source.mapInArrow(run, StructType([*source.schema.fields[:-1], StructField("toxic_score", DoubleType())]))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = toxicity_scores(docs, labels, ["doc_id"], bucket_of(F.col("doc_id"), 3) != 1)
    return scores.select("doc_id", (bucket_of(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"))
