"""Spelling variants: words one edit apart, found by rolling-hash deletion keys.

Two words are near if exactly one code point is inserted, deleted or replaced. They then agree on some string with one code
point deleted, or one of them is such a string of the other. The keys of all deletions of a word come from the polynomial
hashes of its prefixes and suffixes, as integers, for all words of one length at once. Keys are dealt into radix partitions by
their upper bits, sorted in each, and runs of equal keys are verified on the deleted strings themselves.

A run has at most one word for each letter of the alphabet at each place, whatever the table; pairs are never listed: a run gives
each of its words the number of its near words and the best of them, and these are summed and compared by word. Words of over
``LONG`` letters would send their letters once for each letter; they send two hashes instead, and the few pairs that agree on
both are verified on the words.

Defined results: a null, empty or letterless text has no words; a null id is empty in the hash that picks the deleted letters;
repeated rows count as often as they stand; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import ceil, log2, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, saved, table

#: Code points of the shortest word, occurrences of the rarest.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as the word.
RATIO = 10
#: One run in so many (by its hash) loses a code point.
DELETED = 31
#: Longer words take the way of hashes.
LONG = 64
#: Keys of a radix partition, and words that a task keys or counts before it hands them on.
RADIX, KEYED, HELD = 1 << 17, 1 << 15, 200_000
#: Letters are at most U+00FF, so a word is one Latin-1 byte for each code point, in code-point order.
RUN = re.compile(rb"[A-Za-z\xc0-\xff]{%d,}" % LEAST_LENGTH)

_BASE = 0x9E3779B97F4A7C15
_OTHER = 0xD6E8FEB86659FD93


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of ``docs`` with columns id (text) and text."""

    def run(batches):
        counts: Counter = Counter()

        def rows():
            words = [w.decode("latin-1") for w in counts]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(column(batch, "id"), column(batch, "text"), strict=True):
                start = zlib.crc32(f"{doc or ''}:".encode())
                for word, n in Counter(RUN.findall((text or "").encode("latin-1", "replace").lower())).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % DELETED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield rows()
                    counts = Counter()
        yield rows()

    return docs.select("id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_hashes(letters: np.ndarray, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """For a matrix of words of one length: the hash of each word without each of its letters, and of the whole word.

    ``prefix[i]`` is the polynomial of the letters before i; the letters after i stand one power lower once i is gone."""
    n, length = letters.shape
    powers = np.ones(length + 1, np.uint64)
    with np.errstate(over="ignore"):
        powers[1:] = np.cumprod(np.full(length, base, np.uint64))
        terms = (letters.astype(np.uint64) + np.uint64(1)) * powers[:length]
        prefix = np.zeros((n, length + 1), np.uint64)
        np.cumsum(terms, axis=1, out=prefix[:, 1:])
        suffix = prefix[:, -1:] - prefix[:, 1:]
        return prefix[:, :-1] + suffix * np.uint64(pow(base, -1, 1 << 64)), prefix[:, -1]


def mixed(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of strings of ``length`` code points with even upper bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def matrix(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of letters."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def first_of_runs(letters: np.ndarray) -> np.ndarray:
    """Where a letter differs from the one before: deleting any other letter of a run gives the same string."""
    out = np.ones(letters.shape, bool)
    out[:, 1:] = letters[:, 1:] != letters[:, :-1]
    return out


def keyed(words: DataFrame, bits: int) -> DataFrame:
    """(part, lengths, places, counts, letters): the keys of all words of at most ``LONG`` letters by their upper ``bits``. Each key
    is a word and the place of the deleted letter, from 1, or 0 for the word itself."""

    def packed(words: list[bytes], counts: list[int]):
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        part, who, place = [], [], []
        for length, at in by_length.items():
            without, whole = deletion_hashes(matrix([words[k] for k in at]))
            keys = np.concatenate([mixed(whole, length)[:, None], mixed(without, length - 1)], axis=1)
            part.append((keys >> np.uint64(64 - bits)).astype(np.int32).ravel())
            who.append(np.repeat(np.array(at), length + 1))
            place.append(np.tile(np.arange(length + 1, dtype=np.uint8), len(at)))
        part, who, place = (np.concatenate(x) for x in (part, who, place))
        order = np.argsort(part, kind="stable")
        part, who, place = part[order], who[order], place[order]
        lengths = np.array([len(w) for w in words])
        counts = np.array(counts, np.int64)
        letters = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            some = who[s:e]
            size = lengths[some]
            spread = np.arange(size.sum()) + np.repeat(starts[some] - (np.cumsum(size) - size), size)
            yield int(part[s]), size.astype(np.uint8).tobytes(), place[s:e].tobytes(), counts[some].tobytes(), letters[spread].tobytes()

    def run(batches):
        words, counts = [], []

        def rows():
            parts = list(zip(*packed(words, counts), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int32()), *(pa.array(p, pa.binary()) for p in parts[1:])], names=["part", "lengths", "places", "counts", "letters"])

        for batch in batches:
            words += [w.encode("latin-1") for w in column(batch, "word")]
            counts += column(batch, "n")
            if len(words) >= KEYED:
                yield rows()
                words, counts = [], []
        if words:
            yield rows()

    return words.where(f"length(word) <= {LONG}").select("word", "n").mapInArrow(run, "part int, lengths binary, places binary, counts binary, letters binary")


def runs(keys: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Class of each row, rows being sorted by key: rows of a class have one key and, verified, one string."""
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    label = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    if (strings == strings[first[label]]).all():
        return label
    _, string = np.unique(strings, return_inverse=True)  # a key of several strings: classes by key and string
    _, label = np.unique(np.stack([label, string], axis=1), axis=0, return_inverse=True)
    return label.ravel()


def best_two(group: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: the size of its group, and the positions of the group's best and second best row (largest n, then least
    rank; -1: none)."""
    order = np.lexsort((rank, -n, group))
    sorted_group = group[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]]))
    size = np.diff(np.concatenate([start, [len(group)]]))
    label = np.repeat(np.arange(len(start)), size)
    second = np.where(size > 1, order[np.minimum(start + 1, len(order) - 1)], -1)
    out = np.empty((3, len(group)), np.int64)
    out[:, order] = size[label], order[start][label], second[label]
    return out[0], out[1], out[2]


def near_of_part(lengths: np.ndarray, places: np.ndarray, counts: np.ndarray, letters: np.ndarray):
    """(word, near words, best n, best word) of the keys of one radix partition."""
    starts = np.cumsum(lengths) - lengths
    keys = np.empty(len(lengths), np.uint64)
    canonical = np.ones(len(lengths), bool)
    words = np.zeros(len(lengths), f"S{LONG}")
    deleted = np.zeros(len(lengths), f"S{LONG}")
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        rows = letters[starts[at, None] + np.arange(length)]
        place = places[at].astype(np.int64)
        without, whole = deletion_hashes(rows)
        line = np.arange(len(at))
        gone = np.maximum(place - 1, 0)
        keys[at] = np.where(place > 0, mixed(without[line, gone], length - 1), mixed(whole, length))
        canonical[at] = first_of_runs(rows)[line, gone] | (place == 0)
        wide = np.zeros((len(at), LONG), np.uint8)
        wide[:, :length] = rows
        words[at] = wide.view(f"S{LONG}").ravel()
        shifted = np.where(np.arange(LONG) >= np.where(place > 0, gone, LONG)[:, None], np.concatenate([wide[:, 1:], np.zeros((len(at), 1), np.uint8)], axis=1), wide)
        deleted[at] = np.ascontiguousarray(shifted).view(f"S{LONG}").ravel()
    order = np.argsort(keys)
    key = keys[order]
    alone = np.ones(len(key), bool)
    alone[1:] &= key[1:] != key[:-1]
    alone[:-1] &= key[1:] != key[:-1]
    order = order[~alone]
    if not len(order):
        return None
    words, deleted, n, place, canonical = words[order], deleted[order], counts[order], places[order].astype(np.int64), canonical[order]
    label = runs(keys[order], deleted)
    names, rank = np.unique(words, return_inverse=True)
    near = np.zeros(len(names), np.int64)
    best = np.full(len(names), -1)
    of_rank = np.zeros(len(names), np.int64)
    of_rank[rank] = n

    def offered(to: np.ndarray, other: np.ndarray) -> None:
        """Words ``to`` have the near words ``other`` (ranks): keep the best, that with the largest n and then the least rank."""
        order = np.lexsort((other, -of_rank[other], to))
        to, other = to[order], other[order]
        first = np.concatenate([[True], to[1:] != to[:-1]]) if len(to) else np.zeros(0, bool)
        to, other = to[first], other[first]
        old = best[to]
        better = (old < 0) | (of_rank[other] > of_rank[old]) | ((of_rank[other] == of_rank[old]) & (other < old))
        best[to[better]] = other[better]

    replaced = np.flatnonzero(place > 0)
    size, first, second = best_two(label[replaced] * (LONG + 1) + place[replaced], n[replaced], rank[replaced])
    np.add.at(near, rank[replaced], size - 1)
    other = np.where(first == np.arange(len(replaced)), second, first)
    some = other >= 0
    offered(rank[replaced[some]], rank[replaced[other[some]]])
    whole = np.full(label.max() + 1, -1)
    whole[label[place == 0]] = np.flatnonzero(place == 0)
    longer = np.flatnonzero((place > 0) & canonical)
    longer = longer[whole[label[longer]] >= 0]
    shorter = whole[label[longer]]
    np.add.at(near, rank[longer], 1)
    np.add.at(near, rank[shorter], 1)
    offered(rank[longer], rank[shorter])
    offered(rank[shorter], rank[longer])
    told = np.flatnonzero(near)
    form = best[told]
    fits = (form >= 0) & (of_rank[form] >= RATIO * of_rank[told])
    text = [w.decode("latin-1") for w in names.tolist()]
    return (
        [text[k] for k in told.tolist()],
        near[told],
        pa.array(of_rank[form], pa.int64(), mask=~fits),
        pa.array([text[k] if f else None for k, f in zip(form.tolist(), fits.tolist(), strict=True)], pa.string()),
    )


def near_words(words: DataFrame, keys: int) -> DataFrame:
    """(word, near, form_n, form): parts of the answer for words of at most ``LONG`` letters, by radix partition."""
    bits = max(6, ceil(log2(max(1, keys) / RADIX)))
    parts = keyed(words, bits).groupBy("part").agg(F.collect_list(F.struct("lengths", "places", "counts", "letters")).alias("blobs"))

    def run(batches):
        for batch in batches:
            for blobs in batch.column(0):
                columns = [b"".join(b[c] for b in blobs.as_py()) for c in ("lengths", "places", "counts", "letters")]
                lengths, places, letters = (np.frombuffer(columns[k], np.uint8) for k in (0, 1, 3))
                found = near_of_part(lengths.astype(np.int64), places, np.frombuffer(columns[2], np.int64), letters)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1]), found[2], found[3]], names=["word", "near", "form_n", "form"])

    return parts.select("blobs").mapInArrow(run, "word string, near long, form_n long, form string")


def near_long_words(words: DataFrame) -> DataFrame:
    """The same for pairs whose longer word has over ``LONG`` letters: keys carry two hashes, words that agree on both meet, and
    the words themselves decide."""

    def run(batches):
        for batch in batches:
            for word in column(batch, "word"):
                letters = matrix([word.encode("latin-1")])
                length = letters.shape[1]
                one, two = ([mixed(x, length - k).ravel() for k, x in ((1, d), (0, w))] for d, w in (deletion_hashes(letters), deletion_hashes(letters, _OTHER)))
                places = np.arange(1, length + 1)
                canonical = first_of_runs(letters)[0]
                if length <= LONG:
                    places = places[:0]
                a, b = (np.concatenate([x[0][: len(places)], x[1]]).view(np.int64) for x in (one, two))
                columns = [a, b, np.append(places, 0), np.append(canonical[: len(places)], True)]
                for s in range(0, len(a), 1 << 14):
                    part = [pa.array(c[s : s + (1 << 14)]) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([word if length <= LONG else None] * len(part[0]), pa.string()), pa.array([hash_of(word)] * len(part[0]), pa.int64()), *part], names=["short", "id", "a", "b", "place", "canonical"])

    def hash_of(word: str) -> int:
        return int(mixed(deletion_hashes(matrix([word.encode("latin-1")]))[1], len(word)).view(np.int64)[0])

    keys = saved(words.where(f"length(word) >= {LONG}").select("word").mapInArrow(run, "short string, id long, a long, b long, place long, canonical boolean").drop("short"), "long")
    one, two = (keys.select("a", "b", *(F.col(c).alias(f"{c}{k}") for c in ("id", "place", "canonical"))) for k in (1, 2))
    ids = words.where(f"length(word) >= {LONG}")
    at = F.udf(hash_of, "long")
    ids = saved(ids.select(at("word").alias("id"), "word", "n"), "ids")
    replaced = "place1 = place2 and place1 > 0 and id1 <> id2"
    moved = "(place1 = 0 and place2 > 0 and canonical2) or (place2 = 0 and place1 > 0 and canonical1)"
    pairs = one.join(two, ["a", "b"]).where(f"({replaced}) or ({moved})").select("id1", "id2").distinct()
    met = pairs.join(ids.select(F.col("id").alias("id1"), "word", "n"), "id1").join(ids.select(F.col("id").alias("id2"), F.col("word").alias("form"), F.col("n").alias("form_n")), "id2")
    met = met.where((F.levenshtein("word", "form", 1) == 1) & (F.greatest(F.length("word"), F.length("form")) > LONG))
    fits = F.col("form_n") >= RATIO * F.col("n")
    return met.select("word", F.lit(1).cast("long").alias("near"), *(F.when(fits, F.col(c)).alias(c) for c in ("form_n", "form")))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word."""
    words = saved(word_counts(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))).where(f"n >= {LEAST_COUNT}"), "words")
    keys, longest, most = words.agg(F.sum(F.length("word") + 1), F.max(F.length("word")), F.max("n")).first()
    near = near_words(words, keys or 0)
    if (longest or 0) > LONG:
        near = near.unionByName(near_long_words(words))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    near = near.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    out = saved(out, "forms")
    roots = saved(out.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    steps = log10(max(1, (most or 1) / LEAST_COUNT))  # each form occurs RATIO times as often as the word before
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):  # paths of 2, 4, 8 ... forms
        roots = saved(roots.alias("a").join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE
byte AS MATERIALIZED (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS crc
  FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))),
run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run
  FROM documents),
seen AS MATERIALIZED (SELECT id, run, count(*) AS n FROM run GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(strlen(id || ':' || run)), lambda i: CAST(('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2)) AS BIGINT))),
    lambda c, x: xor(c // 256, crc[1 + xor(c % 256, x)]))) AS h
  FROM seen, byte),
word AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN word b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN word b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, (list(other ORDER BY m DESC, other))[1] AS other FROM near GROUP BY word),
form AS MATERIALIZED (
  SELECT word.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM word LEFT JOIN best USING (word)),
path AS (
  SELECT word, word AS root, 0 AS depth FROM form
  UNION ALL SELECT p.word, f.form, p.depth + 1 FROM path p JOIN form f ON p.root = f.word WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(root, depth) AS root FROM path GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM form JOIN root USING (word)
"""
