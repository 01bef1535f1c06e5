"""Quality by co-training: a text-content and a page-metadata classifier teach each other.

Each view is fitted on a bounded sample of labelled rows. In every round both views score all unlabelled
documents, in tasks, from features that are computed once; each hands those it is confident of, by its calibrated
probability, to the other view as pseudo-labels. How many there are of either class counts over all documents; of the rows themselves a
bounded sample comes back, drawn source by source in turn so that a rare source has its share. In the end the two calibrated views are combined (their log-odds add, the prior
counts once), calibrated again, and score every document in one pass over whole texts.

Defined results: null and empty texts are scored by features of zero; null or unseen metadata count as the
overall rate; null labels are ignored, contradicting labels of one id count as low quality; with no
usable labels every score is 1 (nothing is rejected); repeated rows get equal scores; an empty table
gives an empty result; further columns are ignored, and a kept column named like a result gives way to it (put rows into
a struct to keep them whole).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .boosting import fit_logit, fit_steps, fit_trees
from .shared import clear_of, column, saved, some_rows, table

#: Most labelled rows of each class.
SAMPLE = 4000
#: Most pseudo-labelled rows of each class that a view is handed, and most of them from one value of the first metadata column.
PSEUDO, OF_SOURCE = 2000, 500
ROUNDS = 3
#: A view hands over documents whose calibrated probability is this near to 0 or 1.
CONFIDENT = 0.03
#: All pseudo-labels together weigh so much of what the labels weigh.
PSEUDO_WEIGHT = 0.5
FOLDS = 4
CONTENT = ["log_words", "word_length", "long_word", "distinct", "top_word", "repeats", "longest_repeat", "marked", "bars", "symbols", "digits", "capitals", "stops", "short_words", "line_words", "line_copies", "spaces"]
_SYMBOLS = "*#$%&@^~|<>{}[]=_\\/+"


def content(text: str | None) -> list[float]:
    """Dense features of a whole text."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(CONTENT)
    chars = len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    same = np.fromiter(map(str.__eq__, words, words[1:]), bool, n - 1)
    gaps = np.diff(np.flatnonzero(np.concatenate([[True], ~same, [True]])))
    lines = [x for x in text.split("\n") if x]
    of = lambda some: sum(map(text.count, some)) / chars
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float(np.log1p(lengths.max())),
        len(counts) / n**0.9,
        max(counts.values()) / n,
        float(same.sum()) / n,
        float(np.log1p(gaps.max())),
        sum(map(text.count, ("***", "###", "$$$", "%%%", "&&&", "@@@", "!!!", "???"))) / n,
        counts.get("|", 0) / n,
        of(_SYMBOLS),
        of("0123456789"),
        of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        of(".,;:!?"),
        float((lengths <= 3).sum()) / n,
        float(np.log1p(n / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)),
        1 - float(lengths.sum()) / chars,
    ]


@dataclass
class Metadata:
    """Smoothed shares of low quality by metadata value, beside the document's size."""

    overall: float
    rates: list[dict]

    @classmethod
    def of(cls, rows: list[tuple], y: np.ndarray, weight: np.ndarray) -> Metadata:
        overall = float((weight * (1 - y)).sum() / weight.sum())
        rates = []
        for k in range(len(rows[0]) - 1):
            total, low = Counter(), Counter()
            for row, label, w in zip(rows, y, weight, strict=True):
                total[row[k]] += w
                low[row[k]] += w * (1 - label)
            rates.append({v: (low[v] + 20 * overall) / (total[v] + 20) for v in total})
        return cls(overall, rates)

    def __call__(self, rows: list[tuple]) -> np.ndarray:
        size = np.array([np.log1p(max(r[-1] or 0, 0)) for r in rows])
        return np.column_stack([*([rate.get(r[k], self.overall) for r in rows] for k, rate in enumerate(self.rates)), size, (size - 7) ** 2])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Model:
    content: Callable[[np.ndarray], np.ndarray]
    metadata: Callable[[list[tuple]], np.ndarray]
    prior: float
    steps: Callable[[np.ndarray], np.ndarray]

    def __call__(self, x: np.ndarray, meta: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content(x), self.metadata(meta)
        return self.steps(_logit(a) + _logit(b) - _logit(np.array(self.prior))), a, b


@dataclass
class Rows:
    """Rows to fit on: features, metadata, labels (1 good, 0 low) and weights."""

    x: np.ndarray
    meta: list[tuple]
    y: np.ndarray
    weight: np.ndarray

    def and_(self, other: Rows | None) -> Rows:
        if other is None or not len(other.y):
            return self
        return Rows(np.concatenate([self.x, other.x]), self.meta + other.meta, np.concatenate([self.y, other.y]), np.concatenate([self.weight, other.weight]))

    def where(self, some: np.ndarray) -> Rows:
        return Rows(self.x[some], [self.meta[i] for i in np.flatnonzero(some)], self.y[some], self.weight[some])


def pseudo_labelled(counts: dict[int, int], picked: dict[int, tuple[np.ndarray, list[tuple]]], mass: float) -> Rows | None:
    """Rows of pseudo-labels: a class weighs by its count over all documents, ``mass`` together."""
    total = sum(counts.values())
    parts = [Rows(x, meta, np.full(len(x), float(label)), np.full(len(x), mass * counts[label] / total / len(x))) for label, (x, meta) in sorted(picked.items()) if len(x)]
    out = None
    for part in parts:
        out = part if out is None else out.and_(part)
    return out


def cotrained(rows: Rows, fold: np.ndarray, exchange: Callable, rounds: int = ROUNDS) -> Model:
    """The last fold of the labelled ``rows`` calibrates, the others are fitted on. ``exchange`` (views, mass) lets both views
    score the unlabelled documents and returns what each view is handed by the other."""
    held, fit = rows.where(fold == FOLDS - 1), rows.where(fold != FOLDS - 1)
    if len(set(held.y)) < 2 or len(set(fit.y)) < 2:
        held = fit = rows
    given: list[Rows | None] = [None, None]
    views: list[Callable] = []
    for r in range(rounds + 1):
        use = fit.and_(given[0])
        trees = fit_trees(use.x, use.y, use.weight, trees=40)
        steps = fit_steps(trees.raw(held.x), held.y, held.weight)
        use = fit.and_(given[1])
        encode = Metadata.of(use.meta, use.y, use.weight)
        logit = fit_logit(encode(use.meta), use.y, use.weight)
        steps2 = fit_steps(logit.raw(encode(held.meta)), held.y, held.weight)
        views = [lambda x, trees=trees, steps=steps: steps(trees.raw(x)), lambda m, logit=logit, steps=steps2, encode=encode: steps(logit.raw(encode(m)))]
        if r < rounds:
            given = exchange(views, PSEUDO_WEIGHT * float(fit.weight.sum()))
            if given == [None, None]:
                break
    prior = float((held.weight * held.y).sum() / held.weight.sum())
    model = Model(views[0], views[1], prior, lambda z: z)
    z, _, _ = model(held.x, held.meta)
    steps = fit_steps(z, held.y, held.weight)
    model.steps = lambda z: np.clip(steps(z), 0, 1)
    return model


def described(docs: DataFrame, id_col: str, text: str, metadata: list[str]) -> DataFrame:
    """(id, meta, x): the features of every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*(F.col(c).alias(f"m{i}") for i, c in enumerate(metadata))).alias("meta"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            x = pa.array([content(t) for t in column(batch, "text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], names=["id", "meta", "x"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"id {kinds['id']}, meta {kinds['meta']}, x array<double>")


def exchanged(unlabelled: DataFrame, views: list[Callable], mass: float) -> list[Rows | None]:
    """What the content view and the metadata view are handed: both score every row of ``unlabelled`` (id, meta, x)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(column(batch, "x"), float)
                p = views[0](x), views[1]([tuple(m.values()) for m in column(batch, "meta")])
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *map(pa.array, p)], names=["id", "meta", "x", "p0", "p1"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in unlabelled.schema.fields)
    scored = unlabelled.mapInArrow(run, f"{kinds}, p0 double, p1 double")
    teachers = F.array(*(F.struct(F.lit(k).alias("teacher"), F.col(f"p{k}").alias("p")) for k in (0, 1)))
    sure = scored.select("id", "meta", "x", F.explode(teachers).alias("t")).select("id", "meta", "x", "t.teacher", "t.p").where(f"p <= {CONFIDENT} OR p >= {1 - CONFIDENT}")
    sure = saved(sure.select("id", "meta", "x", "teacher", (F.col("p") > 0.5).cast("int").alias("label"), F.xxhash64(F.lit(3), "id", "x").alias("h")), "sure")
    counts: list[dict[int, int]] = [{}, {}]
    for r in sure.groupBy("teacher", "label").count().collect():
        counts[r["teacher"]][r["label"]] = r["count"]
    in_source = Window.partitionBy("teacher", "label", "meta.m0").orderBy("h", "x")
    in_class = Window.partitionBy("teacher", "label").orderBy("turn", "h", "x")
    picks = sure.withColumn("turn", F.row_number().over(in_source)).where(F.col("turn") <= OF_SOURCE).withColumn("place", F.row_number().over(in_class)).where(F.col("place") <= PSEUDO)
    picked: list[dict] = [{}, {}]
    for r in sorted(picks.select("teacher", "label", "place", "meta", "x").collect(), key=lambda r: (r["teacher"], r["label"], r["place"])):
        x, meta = picked[r["teacher"]].setdefault(r["label"], ([], []))
        x.append(r["x"])
        meta.append(tuple(r["meta"]))
    handed = [pseudo_labelled(counts[k], {label: (np.array(x), meta) for label, (x, meta) in picked[k].items()}, mass) for k in (0, 1)]
    return handed[::-1]  # what one view is sure of, the other is handed


def fitted(docs: DataFrame, labels: DataFrame, where, label: str, id_col: str, text: str, metadata: list[str], sample: int = SAMPLE) -> Model | None:
    known = labels.where(where & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label)).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return None
    rows = saved(described(docs, id_col, text, metadata).join(known, "id", "left"), "features")
    chosen = saved(some_rows(known.where("y = 1"), "id", sample, 2).union(some_rows(known.where("y = 0"), "id", sample, 2)).select("id"), "chosen")
    # a document whose id repeats counts once, whatever the number of its rows
    got = rows.join(F.broadcast(chosen), "id", "left_semi").groupBy("id").agg(F.min(F.struct("x", "meta")).alias("r"), F.first("y").alias("y"))
    got = got.select("id", "y", "r.x", "r.meta", F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(FOLDS)).cast("int").alias("fold")).collect()
    got.sort(key=lambda r: (r["id"], r["x"]))
    y = np.array([r["y"] for r in got], float)
    if len(set(y)) < 2:
        return None
    weight = np.where(y == 0, sizes[0] / (y == 0).sum(), sizes[1] / (y == 1).sum())
    labelled = Rows(np.array([r["x"] for r in got]), [tuple(r["meta"]) for r in got], y, weight / weight.mean())
    unlabelled = rows.where("y IS NULL").drop("y")
    return cotrained(labelled, np.array([r["fold"] for r in got]), lambda views, mass: exchanged(unlabelled, views, mass))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    keep: list[str],
    where=None,
    label: str = "quality",
    id_col: str = "doc_id",
    text: str = "text",
    metadata: tuple[str, ...] = ("source", "lang", "n_chars"),
    sample: int = SAMPLE,
) -> DataFrame:
    """``keep`` columns of ``docs``, ``quality_score`` (probability of good) and the calibrated views ``by_content`` and
    ``by_metadata``. The last column of ``metadata`` is a size, the others are categories."""
    model = fitted(docs, labels, F.lit(True) if where is None else where, label, id_col, text, list(metadata), sample)
    made = ["quality_score", "by_content", "by_metadata"]
    keep = [c for c in keep if c.lower() not in made]
    body, meta = clear_of([*keep, *made], "text", "meta")
    if model is None:
        return docs.select(*keep, *(F.lit(1.0).alias(c) for c in made))

    def run(batches):
        for batch in batches:
            x = np.array([content(t) for t in column(batch, body)]).reshape(-1, len(CONTENT))
            scores = model(x, [tuple(m.values()) for m in column(batch, meta)]) if len(x) else (np.empty(0),) * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *map(pa.array, scores)], names=[*keep, *made])

    source = docs.select(*keep, F.struct(*(F.col(c).alias(f"m{i}") for i, c in enumerate(metadata))).alias(meta), F.col(text).alias(body))
    return source.mapInArrow(run, StructType([*source.schema.fields[: len(keep)], *(StructField(c, DoubleType()) for c in made)]))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = quality_scores(docs, labels, ["doc_id"])
    return scores.select("doc_id", "quality_score", "by_content", "by_metadata", (F.col("quality_score") >= 0.5).alias("kept"))
