"""Language of every word by a linear-chain conditional random field.

A word's features are its affixes, its character n-grams and itself (the lexicon), each hashed into one
table of weights for each language; neighbouring labels interact through learned transitions. The
marginal probability of each word's label comes from forward-backward over the whole text. A document's
language is the one that most of its words' probability goes to.

Forward-backward is exact but works on blocks: the products of the transition steps inside all blocks
are taken side by side, then chained over each document's blocks, then every block is filled in.

The field is fitted on a bounded sample of labelled documents whose pieces are spliced together, so
that transitions between languages occur. Every word of a piece carries its document's language.

Defined results: null texts and texts without a letter are ``und`` with score 0; null labels are not learned
from; with no labels at all everything is ``und``; repeated rows get equal results; an empty table gives an
empty result; further columns are ignored, and a kept column named like a result gives way to it.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bucket_of, clear_of, column, saved, table

#: Most documents of a language, and most words of it, that the field is fitted on.
SAMPLE_DOCS, SAMPLE_WORDS = 300, 30_000
#: Languages that the full table of weights and the full sample are meant for; with more, each language gets
#: fewer table rows and sample words, so that memory stays bounded, but every language is learned.
FULL_LANGUAGES = 64
#: Words that a document too long for the sample is represented by, from a random place in it.
RUN_WORDS = 3_000
TABLE = 1 << 18
MEMO = 300_000
BLOCK = 32
EPOCHS = 12
#: Longer runs of letters are cut into successive words of so many.
LONGEST = 40
UNKNOWN = "und"
_ASCII = re.compile("[A-Za-z]+")
_KINDS = 10


def cores(token: str) -> list[str]:
    """A token's words: its runs of letters in lower case, long runs in successive pieces. Combining marks are dropped."""
    if token.isalpha():
        runs = [token.lower()]
    elif token.isascii():
        runs = _ASCII.findall(token.lower())
    else:  # letters are what str.isalpha says: fractions, superscripts and circled numbers are none
        plain = (c for c in token if unicodedata.category(c)[0] != "M")
        runs = "".join(c if c.isalpha() else " " for c in plain).lower().split()
    return [x[i : i + LONGEST] for x in runs for i in range(0, len(x), LONGEST)]


def core(token: str) -> str:
    """A token's letters in lower case, or nothing."""
    return "".join(cores(token))


def word_features(words: list[str], size: int = TABLE) -> np.ndarray:
    """Hashed features of words, one row each, unused places pointing at the last (empty) row of a table of ``size``."""
    width = max(4, max(map(len, words), default=1) + 2)
    codes = np.zeros((len(words), width + 2), np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.array(words, f"<U{width - 2}").view(np.uint32).reshape(len(words), width - 2)
    codes[:, 1 : width - 1] = flat  # zeros before and after stand for the edges
    mix = np.uint64(0x9E3779B97F4A7C15)

    def hashed(value: np.ndarray, kind: int) -> np.ndarray:
        x = (value + np.uint64(kind + 1)) * mix
        x ^= x >> np.uint64(29)
        return ((x * mix) >> np.uint64(40)).astype(np.int64) % (size - 1)

    at = np.arange(width)
    two = codes[:, :width] << np.uint64(21) | codes[:, 1 : width + 1]
    three = two[:, : width - 1] << np.uint64(21) | codes[:, 2 : width + 1]
    inside2 = at[None, :] <= lengths[:, None]
    inside3 = at[None, : width - 1] < lengths[:, None]
    out = [np.where(inside2, hashed(two, 0), size - 1), np.where(inside3, hashed(three, 1), size - 1)]
    affix = []
    prefix = np.zeros(len(words), np.uint64)
    for k in range(1, 4):
        prefix = prefix << np.uint64(21) | codes[:, min(k, width)]
        affix.append(np.where(lengths >= k, hashed(prefix, 1 + k), size - 1))
    ends = np.array([w[-3:].rjust(3, "\0") for w in words], "<U3").view(np.uint32).reshape(len(words), 3).astype(np.uint64) if words else np.zeros((0, 3), np.uint64)
    suffix = np.zeros(len(words), np.uint64)
    for k in range(1, 4):
        suffix = ends[:, 3 - k] << np.uint64(21 * (k - 1)) | suffix
        affix.append(np.where(lengths >= k, hashed(suffix, 4 + k), size - 1))
    whole = np.zeros(len(words), np.uint64)
    for k in range(1, width - 1):
        whole = np.where(codes[:, k] > 0, whole * np.uint64(1_000_003) + codes[:, k], whole)
    affix.append(np.where(lengths > 0, hashed(whole, 9), size - 1))
    return np.concatenate([*out, np.stack(affix, axis=1)], axis=1)


def marginals(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p[t, k]: probability of label k at word t; and the expected number of each label pair.

    ``emission`` has the log-scores of all words, sequence after sequence of the given lengths. Words are laid
    out in blocks of ``BLOCK``; a block never spans two sequences. Short blocks are filled with steps that do nothing.
    """
    width = emission.shape[1]
    lengths = lengths[lengths > 0]
    per = -(-lengths // BLOCK)
    n_blocks = int(per.sum())
    if not n_blocks:
        return np.zeros((0, width)), np.zeros((width, width))
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    word_in = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    block = np.repeat(first, lengths) + word_in // BLOCK
    slot = word_in % BLOCK
    real = np.zeros((n_blocks, BLOCK), bool)
    real[block, slot] = True
    e = np.ones((n_blocks, BLOCK, width))
    e[block, slot] = np.exp(emission - emission.max(axis=1, keepdims=True))
    opens = np.zeros(n_blocks, bool)
    opens[first] = True
    step = np.exp(transition - transition.max())
    eye, uniform = np.eye(width), np.full(width, 1 / width)
    # total[b] = product over the block of (transition, then emission); a sequence's first word has no transition
    total = np.tile(eye, (n_blocks, 1, 1))
    for t in range(BLOCK):
        moved = (total.reshape(-1, width) @ step).reshape(n_blocks, width, width)
        if t == 0:
            moved[opens] = total[opens]
        moved *= e[:, t, None, :]
        moved /= moved.sum(axis=(1, 2), keepdims=True)
        total = np.where(real[:, t, None, None], moved, total)
    # chain over the blocks of each sequence, all sequences side by side
    enter, leave = np.empty((n_blocks, width)), np.empty((n_blocks, width))
    order = np.argsort(-per, kind="stable")
    sorted_per, sorted_first = per[order], first[order]
    most = int(sorted_per[0])
    alive = [int(np.searchsorted(-sorted_per, -k, side="left")) for k in range(most)]  # sequences of more than k blocks
    state = np.tile(uniform, (len(per), 1))
    for k in range(most):
        b = sorted_first[: alive[k]] + k
        enter[b] = state[: alive[k]]
        after = np.einsum("si,sij->sj", state[: alive[k]], total[b])
        state[: alive[k]] = after / after.sum(axis=1, keepdims=True)
    state = np.ones((len(per), width))
    for k in range(most - 1, -1, -1):
        b = sorted_first[: alive[k]] + k
        leave[b] = state[: alive[k]]
        before = np.einsum("sij,sj->si", total[b], state[: alive[k]])
        state[: alive[k]] = before / before.sum(axis=1, keepdims=True)
    # fill in
    forward = np.empty((n_blocks, BLOCK, width))
    state = enter
    for t in range(BLOCK):
        moved = state @ step
        if t == 0:
            moved[opens] = uniform
        moved *= e[:, t]
        moved /= moved.sum(axis=1, keepdims=True)
        state = np.where(real[:, t, None], moved, state)
        forward[:, t] = state
    gamma = np.empty((n_blocks, BLOCK, width))
    pairs = np.zeros((width, width))
    back = leave
    for t in range(BLOCK - 1, -1, -1):
        g = forward[:, t] * back
        gamma[:, t] = g / g.sum(axis=1, keepdims=True)
        weighted = e[:, t] * back
        inner = real[:, t] & (~opens if t == 0 else True)
        before = forward[:, t - 1] if t else enter
        joint_norm = np.einsum("bi,ij,bj->b", before, step, weighted)
        scale = np.where(inner, 1 / np.maximum(joint_norm, 1e-300), 0)
        pairs += (before * scale[:, None]).T @ weighted * step
        moved = weighted @ step.T
        moved /= moved.sum(axis=1, keepdims=True)
        back = np.where(real[:, t, None], moved, back)
    return gamma[block, slot], pairs


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # features x languages; the last row is zero
    transition: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        for i in range(0, len(words), 4096):  # words of like length together
            some = order[i : i + 4096]
            out[some] = self.weights[word_features([words[k] for k in some], len(self.weights))].sum(axis=1)
        return out


def fit(sequences: list[tuple[list[str], list[int]]], languages: list[str], epochs: int = EPOCHS, rate: float = 0.15) -> Field:
    """Gradient ascent on the conditional likelihood with per-weight step sizes, some sequences at a time."""
    width = len(languages)
    size = TABLE >> max(0, -(-width // FULL_LANGUAGES) - 1).bit_length()
    model = Field(languages, np.zeros((size, width)), np.zeros((width, width)))
    squares, squares_t = np.full((size, width), 1e-3), np.full((width, width), 1e-1)
    together = max(1, min(200, 200 * FULL_LANGUAGES**2 // max(1, width) ** 2))  # sequences: blocks hold width x width products
    words = sorted({w for ws, _ in sequences for w in ws}, key=lambda w: (len(w), w))
    number = {w: i for i, w in enumerate(words)}
    cut = word_features(words, size) if words else np.zeros((0, 1), np.int64)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for i in range(0, len(order), together):
            some = [sequences[k] for k in order[i : i + together]]
            at = np.array([number[w] for ws, _ in some for w in ws])
            y = np.array([k for _, ks in some for k in ks])
            lengths = np.array([len(ws) for ws, _ in some])
            p, pairs = marginals(model.weights[cut[at]].sum(axis=1), lengths, model.transition)
            miss = -p
            miss[np.arange(len(y)), y] += 1
            inner = np.ones(len(y), bool)
            inner[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = False
            seen = np.zeros((width, width))
            np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
            kinds, back = np.unique(at, return_inverse=True)
            by_word = np.stack([np.bincount(back, miss[:, k], len(kinds)) for k in range(width)], axis=1)
            flat = cut[kinds]
            for k in range(width):  # one language at a time: the table is the largest thing held
                grad = np.bincount(flat.ravel(), np.repeat(by_word[:, k], flat.shape[1]), size)
                grad[-1] = 0
                squares[:, k] += grad**2
                model.weights[:, k] += rate * grad / np.sqrt(squares[:, k])
            grad_t = seen - pairs
            squares_t += grad_t**2
            model.transition += rate * grad_t / np.sqrt(squares_t)
    model.weights = model.weights.astype(np.float32)
    return model


def spliced(documents: list[tuple[str, list[str]]], languages: list[str]) -> list[tuple[list[str], list[int]]]:
    """Sequences of about a hundred words, made of runs of different documents, which may change language."""
    rng = np.random.default_rng(1)
    number = {x: i for i, x in enumerate(languages)}
    runs = []
    for lang, words in documents:
        i = 0
        while i < len(words):
            n = int(rng.integers(4, 40))
            runs.append((words[i : i + n], number[lang]))
            i += n
    out: list[tuple[list[str], list[int]]] = []
    for k in rng.permutation(len(runs)):
        words, lang = runs[k]
        if not out or len(out[-1][0]) > 100:
            out.append(([], []))
        out[-1][0].extend(words)
        out[-1][1].extend([lang] * len(words))
    return out


def fitted(docs: DataFrame, where, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> Field | None:
    known = docs.where(where & F.col(lang).isNotNull() & F.col(text).isNotNull())
    ids = saved(known.select(F.col(id_col).alias("__id"), F.col(lang).alias("__lang")), "known")
    languages = sorted(r[0] for r in ids.select("__lang").distinct().collect())
    if not languages:
        return None
    share = min(1, FULL_LANGUAGES / len(languages))
    sample, most_words = max(1, int(sample * share)), max(100, int(SAMPLE_WORDS * share))
    least = Window.partitionBy("__lang").orderBy(F.xxhash64(F.lit(5), F.col("__id")), F.col("__id"))
    # ids first, then only the chosen rows' texts; partitions cut their rows to ``sample`` before they meet by language
    chosen = ids.withColumn("__no", F.row_number().over(least)).where(F.col("__no") <= sample).drop("__no")

    def run(batches):
        for batch in batches:
            words = [list(chain.from_iterable(map(cores, t.split()))) for t in column(batch, "text")]
            size = [len(w) for w in words]
            for k, key in enumerate(batch.column(0).to_pylist()):
                if size[k] > most_words:
                    n = min(RUN_WORDS, most_words)
                    start = int(np.random.default_rng(zlib.crc32(str(key).encode())).integers(0, size[k] - n + 1))
                    words[k] = words[k][start : start + n]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string())), pa.array(size, pa.int64())], names=["id", "lang", "words", "n"])

    rows = known.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(chosen), (F.col("id") == F.col("__id")) & (F.col("lang") == F.col("__lang"))).select("id", "lang", "text")
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, lang string, words array<string>, n long").collect()
    found.sort(key=lambda r: (r["n"] > most_words, r["lang"], r["id"], r["words"]))  # runs of over-long documents last
    held: dict[str, int] = dict.fromkeys(languages, most_words)
    documents = []
    for r in found:
        if held[r["lang"]] >= len(r["words"]):  # whole documents while they fit
            documents.append((r["lang"], r["words"]))
            held[r["lang"]] -= len(r["words"])
    return fit(spliced(documents, languages), languages)


class Memo(dict):
    """token -> rows of the emission table, one for each of its words, filled in when asked for tokens not seen before."""

    def __init__(self, model: Field):
        super().__init__()
        self.model = model
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def rows(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all tokens' words, and each token's number of words."""
        new = list(dict.fromkeys(t for t in tokens if t not in self))
        if new and max(len(self), len(self.table)) + len(new) > MEMO:
            self.clear()
            self.table = self.table[:0]
            new = list(dict.fromkeys(tokens))
        if new:
            words = list(map(cores, new))
            kinds = list(dict.fromkeys(chain.from_iterable(words)))
            place = {w: len(self.table) + i for i, w in enumerate(kinds)}
            self.table = np.concatenate([self.table, self.model.emissions(kinds).astype(np.float32)])
            self.update(zip(new, (tuple(place[w] for w in ws) for ws in words), strict=True))
        found = list(map(self.__getitem__, tokens))
        many = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(many.sum())), many


def label_documents(texts: list[str | None], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Each text's expected share of words by language, and its number of words with letters."""
    width = len(memo.model.languages)
    tokens: list[str] = []
    lengths = []
    for t in texts:
        some = (t or "").split()
        tokens += some
        lengths.append(len(some))
    at, many = memo.rows(tokens)
    owner = np.repeat(np.repeat(np.arange(len(texts)), lengths), many)
    words = np.bincount(owner, minlength=len(texts))
    p, _ = marginals(memo.table[at].astype(np.float64), words, memo.model.transition)
    share = np.stack([np.bincount(owner, p[:, k], len(texts)) for k in range(width)], axis=1)
    return share / np.maximum(words, 1)[:, None], words


def languages_of(docs: DataFrame, model: Field | None, keep: list[str], text: str = "text", most_words: int = 400_000) -> DataFrame:
    """``keep`` columns, lang_pred and score for every row of ``docs``."""

    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    (body,) = clear_of([*keep, "lang_pred", "score"], "text")
    many = len(model.languages) if model else 0
    most_chars = 6 * most_words * FULL_LANGUAGES**2 // max(many, FULL_LANGUAGES) ** 2  # blocks hold products of languages x languages

    def run(batches):
        memo = Memo(model) if model else None
        for batch in batches:
            texts = column(batch, body)
            names, scores, i = [], [], 0
            while i < len(texts):  # so many documents at a time as bound the memory
                j, held = i, 0
                while j < len(texts) and (j == i or held < most_chars):
                    held += len(texts[j] or "")
                    j += 1
                if memo is None:
                    names += [UNKNOWN] * (j - i)
                    scores += [0.0] * (j - i)
                else:
                    share, words = label_documents(texts[i:j], memo)
                    best = share.argmax(axis=1)
                    names += [memo.model.languages[b] if n else UNKNOWN for b, n in zip(best, words, strict=True)]
                    scores += np.where(words > 0, np.clip(share.max(axis=1), 0, 1), 0).tolist()
                i = j
            rest = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    source = docs.select(*keep, F.col(text).alias(body))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fitted(docs, bucket_of(F.col("doc_id"), 4) != 2)
    found = languages_of(docs, model, ["doc_id"])
    return found.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
