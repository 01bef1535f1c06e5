"""Repeated passages by suffix sorting: every byte that a 200-byte string covers which starts elsewhere as well.

A suffix array of all bytes would be many times the corpus, so suffixes are sorted where they can matter. Each 200-byte window names
one of its positions, that of the least hash of ``GRAM`` bytes (leftmost among equals). Equal windows name the same position,
so a repeated window has an *anchor* whose gram stands at another anchor too. Around an anchor, the windows that hold it
lie within ``LEFT`` bytes before and ``WINDOW`` bytes after. Two anchors of one gram that agree on l bytes before and r bytes from it on
share a window if l + r >= 200; the union of what an anchor shares with all others is one interval around it.

* Anchors that agree on all of their surroundings with another are counted by their hash: all their windows are repeated.
* The other anchors of a gram are suffixes to sort: what follows them, and what precedes them read backwards. *Deep-shallow
  sorting* orders both: multikey quicksort on eight bytes at a time to ``SHALLOW`` bytes, all groups of a batch at once, then a blind trie
  for each run that is still tied, which compares a suffix with one leaf only. Longest common prefixes of neighbours
  cut both orders into classes at every depth, and two anchors that fall into one class of each share that window.
* Grams with over ``BLOCK`` different surroundings are never gathered: their windows are counted by 128-bit hashes.

Defined results: a null text is empty; texts of under 200 bytes lose nothing and repeat nothing; equal texts of 200 bytes or more
lose everything; repeated rows and ids are documents of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, table

WINDOW = 200
#: Bytes of a gram. Longer ones are rarer elsewhere by chance, and denser: about 2 in (WINDOW - GRAM + 2) bytes are anchors.
GRAM = 64
#: An anchor lies at most so far into its window.
LEFT = WINDOW - GRAM
#: Bytes that multikey quicksort orders before blind tries take over.
SHALLOW = 32
#: Different surroundings of one gram that are sorted in one task: some 1.4 MB.
BLOCK = 4096
#: Bytes whose hashes are held at once.
SLICE = 1 << 18
#: Surroundings that are sorted at once, and bytes of texts whose anchors are held at once.
SORTED, HELD = 1 << 14, 1 << 23

_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(SLICE + 2 * WINDOW, np.uint64)
_INVERSES = np.ones(SLICE + 2 * WINDOW, np.uint64)
with np.errstate(over="ignore"):
    _POWERS[1:] = np.cumprod(np.full(len(_POWERS) - 1, _BASE, np.uint64))
    _INVERSES[1:] = np.cumprod(np.full(len(_INVERSES) - 1, pow(_BASE, -1, 1 << 64), np.uint64))
_PLACE = np.uint64((1 << 20) - 1)


# ---- anchors


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each position on."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * _INVERSES[: len(data) - GRAM + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive values: the running minima of blocks from both sides."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    wide = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    wide[: len(values)] = values
    wide = wide.reshape(blocks, width)
    ahead = np.minimum.accumulate(wide, axis=1).ravel()
    behind = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: Sequence[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, positions, gram hashes) in order, a text possibly in several parts. Texts are cut into slices that share
    ``WINDOW`` - 1 bytes, and short ones are hashed together; a window across two texts names nothing."""
    held: list[tuple[int, int, int]] = []  # text, first byte, window starts
    size, last = 0, (-1, -1)

    def found():
        nonlocal last
        parts = [texts[t][s : s + n + WINDOW - 1] for t, s, n in held]
        data = np.frombuffer(b"".join(parts), np.uint8)
        grams = gram_hashes(data)
        least = least_of_windows((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), LEFT + 1)
        at = 0
        for (t, s, n), part in zip(held, parts, strict=True):
            chosen = (least[at : at + n] & _PLACE).astype(np.int64)
            chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
            position = chosen - at + s
            if last == (t, int(position[0])):  # the slice before ended with it
                chosen, position = chosen[1:], position[1:]
            if len(position):
                last = (t, int(position[-1]))
                yield t, position, grams[chosen]
            at += len(part)

    for t, text in enumerate(texts):
        for s in range(0, len(text) - WINDOW + 1, SLICE):
            n = min(SLICE, len(text) - WINDOW + 1 - s)
            if held and size + n + WINDOW > SLICE + 2 * WINDOW:
                yield from found()
                held, size = [], 0
            held.append((t, s, n))
            size += n + WINDOW - 1
    if held:
        yield from found()


def thinned(places: np.ndarray, grams: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Which anchors of a text to keep. Successive ones with one gram and one surroundings (a run of a letter, a short period) are
    wholly repeated whatever else there is; of those, the first, the last and one in every ``WINDOW`` bytes cover the same bytes."""
    fresh = np.ones(len(places), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (around[1:] != around[:-1])
    run = np.cumsum(fresh) - 1
    cell = (places - places[np.flatnonzero(fresh)][run]) // WINDOW
    keep = fresh.copy()
    keep[1:] |= cell[1:] != cell[:-1]
    keep[:-1] |= fresh[1:]
    keep[-1:] = True
    return np.flatnonzero(keep)


def anchored(docs: DataFrame) -> DataFrame:
    """(row, digest, places, grams, around) for each text of 200 bytes or more; ``around`` hashes an anchor's surroundings."""

    def parts(batches):
        """Batches of bounded bytes."""
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + HELD, "right")))
                yield batch.slice(start, end - start)
                start = end

    def run(batches):
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            out: dict[int, list] = {}
            for t, places, grams in anchors(texts):
                text = texts[t]
                around = [xxhash.xxh3_64_intdigest(text[max(0, p - LEFT) : p + WINDOW], min(p, LEFT)) for p in places.tolist()]
                out.setdefault(t, []).append((places, grams, np.array(around, np.uint64)))
            rows = sorted(out)
            whole = [[np.concatenate([x[k] for x in out[t]]) for k in range(3)] for t in rows]
            some = [thinned(*w) for w in whole]
            ends = np.cumsum([0] + [len(at) for at in some])
            flat = [np.concatenate([w[k][at] for w, at in zip(whole, some, strict=True)]) if rows else np.empty(0, np.uint64) for k in range(3)]
            lists = [pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(v)).cast(pa.list_(v.type)) for v in map(pa.array, (flat[0].astype(np.int64), flat[1].view(np.int64), flat[2].view(np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *lists], names=["digest", "places", "grams", "around"])

    long = docs.where(f"octet_length(text) >= {WINDOW}").select("digest", "text")
    return long.mapInArrow(run, "digest binary, places array<long>, grams array<long>, around array<long>").select(F.monotonically_increasing_id().alias("row"), "*")


# ---- deep-shallow sorting


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Positions in the order of ``strings`` (equal ones: by position), by a blind trie: inner nodes hold a depth and their
    children's letters only. A string goes down by its letters without comparing the rest, meets one leaf, is compared
    with that, and branches off at the depth where the two part; an end comes before any letter."""
    root: list = [None, 0]  # a leaf: (None, [positions]); an inner node: (depth, {letter: node})
    root[1] = [0]
    for k in range(1, len(strings)):
        s = strings[k]
        node = root
        while node[0] is not None:
            depth = node[0]
            letter = s[depth] if depth < len(s) else -1
            node = node[1].get(letter) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        n = min(len(s), len(other))
        if s[:n] == other[:n]:
            common = n
        else:
            apart = int.from_bytes(s[:n]) ^ int.from_bytes(other[:n])
            common = n - (apart.bit_length() + 7) // 8
        if common == len(s) == len(other):
            node[1].append(k)
            continue
        letter = s[common] if common < len(s) else -1
        node = root
        while node[0] is not None and node[0] < common:
            node = node[1][s[node[0]] if node[0] < len(s) else -1]
        if node[0] == common:
            node[1][letter] = [None, [k]]
        else:
            below = [node[0], node[1]]
            node[0], node[1] = common, {other[common] if common < len(other) else -1: below, letter: [None, [k]]}
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(group: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the order of the strings within their groups, and how many bytes each shares with the one before
    (-1: another group). Strings have at most ``width`` bytes; a prefix comes before what it begins."""
    n = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    wide = np.zeros((n, width + 8), np.uint8)
    wide[np.arange(width + 8) < lengths[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    order = np.argsort(group, kind="stable")
    label = np.concatenate([[0], np.cumsum(np.diff(group[order]) != 0)])  # class of each place in the order
    for depth in range(0, min(SHALLOW, width), 8):
        size = np.bincount(label)
        tied = np.flatnonzero(size[label] > 1)
        if not len(tied):
            break
        rows = order[tied]
        letters = np.ascontiguousarray(wide[rows, depth : depth + 8]).view(">u8").ravel().astype(np.uint64)
        short = np.minimum(lengths[rows] - depth, 8)  # an end is less than a zero byte
        by = np.lexsort((short, letters, label[tied]))
        order[tied] = rows[by]
        fresh = np.zeros(n, bool)
        fresh[1:] = label[1:] != label[:-1]
        part = np.flatnonzero((letters[by][1:] != letters[by][:-1]) | (short[by][1:] != short[by][:-1])) + 1
        fresh[tied[part]] = True
        label = np.cumsum(fresh)
    start = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    size = np.diff(np.concatenate([start, [n]]))
    for s, m in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        rows = order[s : s + m]
        order[s : s + m] = rows[blind_trie_order([strings[k][SHALLOW:] for k in rows.tolist()])]
    common = np.full(n, -1)
    if n > 1:
        a, b = order[:-1], order[1:]
        differ = wide[a, :width] != wide[b, :width]
        alike = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        alike = np.minimum(alike, np.minimum(lengths[a], lengths[b]))
        common[1:] = np.where(group[a] == group[b], alike, -1)
    return order, common


def shared_windows(group: np.ndarray, before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the least and the largest offset of it in a window that it shares with another of its group (largest -1: it
    shares none). ``before`` is read backwards from the anchor; ``after`` starts at it."""
    n = len(group)
    orders = [deep_shallow(group, before, LEFT), deep_shallow(group, after, WINDOW)]
    lengths = [np.fromiter(map(len, x), np.int64, n) for x in (before, after)]

    def classes(side: int, depth: int) -> np.ndarray:
        order, common = orders[side]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(common < depth)
        return out

    least, most = np.full(n, LEFT + 1), np.full(n, -1)
    for offset in range(LEFT + 1):
        rows = np.flatnonzero((lengths[0] >= offset) & (lengths[1] >= WINDOW - offset))
        both = classes(0, offset)[rows] * (n + 1) + classes(1, WINDOW - offset)[rows]
        order = np.argsort(both)
        equal = both[order[1:]] == both[order[:-1]]
        hit = np.zeros(len(rows), bool)
        hit[order[1:][equal]] = True
        hit[order[:-1][equal]] = True
        some = rows[hit]
        most[some] = offset
        least[some] = np.minimum(least[some], offset)
    return least, most


# ---- the operator


def surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, around, many, before, after) of the wanted anchors: (digest, list of (place, gram, around, many))."""

    def run(batches):
        last = None
        for batch in batches:
            out: list[tuple] = []
            for digest, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if digest == last:  # copies come one after another
                    continue
                last, body = digest, text.as_py()
                for w in places.as_py():
                    p = w["place"]
                    out.append((w["gram"], w["around"], w["many"], body[max(0, p - LEFT) : p][::-1], body[p : p + WINDOW]))
                if len(out) >= SORTED:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["gram", "around", "many", "before", "after"])

    return docs.join(wanted, "digest").select("digest", "text", "wanted").mapInArrow(run, "gram long, around long, many long, before binary, after binary")


def sorted_covers(contexts: DataFrame) -> DataFrame:
    """(gram, around, low, high): the bytes around an anchor that shared windows cover, for grams of bounded numbers of surroundings."""

    def run(batches):
        held: list[tuple] = []  # gram, around, before, after: whole grams, the last one still open

        def covers(rows: list[tuple]):
            gram, around, before, after = zip(*rows, strict=True)
            least, most = shared_windows(np.array(gram, np.int64), list(before), list(after))
            some = np.flatnonzero(most >= 0)
            if len(some):
                names = np.array(gram, np.int64)[some], np.array(around, np.int64)[some]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*names, -most[some], WINDOW - least[some])], names=["gram", "around", "low", "high"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and row[:2] == held[-1][:2]:
                    continue
                if len(held) >= SORTED and row[0] != held[-1][0]:
                    yield from covers(held)
                    held = []
                held.append(row)
        if held:
            yield from covers(held)

    rows = contexts.where(f"many <= {BLOCK}").select("gram", "around", "before", "after").repartition("gram").sortWithinPartitions("gram", "around")
    return rows.mapInArrow(run, "gram long, around long, low long, high long")


def counted_covers(contexts: DataFrame) -> DataFrame:
    """The same for the other grams: each of an anchor's windows is hashed, and hashes are counted."""

    def run(batches):
        for batch in batches:
            out = []
            for gram, around, before, after in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                text, at = before[::-1] + after, len(before)
                for offset in range(max(0, WINDOW - len(after)), at + 1):
                    h = xxhash.xxh3_128_intdigest(text[at - offset : at - offset + WINDOW])
                    out.append((gram, around, offset, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)))
                if len(out) >= 1 << 14:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    names = ["gram", "around", "offset", "a", "b"]
    rows = contexts.where(f"many > {BLOCK}").select("gram", "around", "before", "after").dropDuplicates(["gram", "around"])
    windows = saved(rows.mapInArrow(run, ", ".join(f"{c} long" for c in names)), "windows")
    window = ["gram", "offset", "a", "b"]  # a window has other anchors besides, so it counts once for each gram and offset
    shared = windows.groupBy(window).agg(F.count("*").alias("n")).where("n > 1")
    found = windows.join(shared, window).groupBy("gram", "around").agg((-F.max("offset")).alias("low"), (WINDOW - F.min("offset")).alias("high"))
    return found.select("gram", "around", "low", "high")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(digest, spans) of ``docs`` (digest, text): intervals of bytes around anchors, unsorted and overlapping."""
    texts = saved(anchored(docs), "anchors")
    of_texts = texts.select("row", F.explode(F.arrays_zip("places", "grams", "around")).alias("a")).select("row", F.col("a.places").alias("place"), F.col("a.grams").alias("gram"), F.col("a.around").alias("around"))
    again = saved(of_texts.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    points = saved(of_texts.join(again, "gram"), "points")
    kinds = saved(points.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one")), "kinds")
    many = saved(kinds.groupBy("gram").agg(F.count("*").alias("many"), F.min("n").alias("fewest")).where("many > 1 and fewest = 1").select("gram", "many"), "many")
    wanted = kinds.join(many, "gram").groupBy("one.row").agg(F.collect_list(F.struct("one.place", "gram", "around", "many")).alias("wanted"))
    wanted = wanted.join(texts.select("row", "digest"), "row").select("digest", "wanted")
    contexts = saved(surroundings(docs, wanted), "contexts")
    covers = sorted_covers(contexts)
    if many.where(f"many > {BLOCK}").limit(1).count():
        covers = covers.union(counted_covers(contexts))
    whole = kinds.where("n > 1").select("gram", "around", F.lit(-LEFT).cast("long").alias("low"), F.lit(WINDOW).cast("long").alias("high"))
    covers = saved(whole.union(covers), "covers")
    span = F.struct((F.col("place") + F.col("low")).alias("low"), (F.col("place") + F.col("high")).alias("high"))
    spans = points.join(covers, ["gram", "around"]).groupBy("row").agg(F.collect_list(span).alias("spans"))
    return spans.join(texts.select("row", "digest"), "row").groupBy("digest").agg(F.any_value("spans").alias("spans"))


def without(text: bytes, low: np.ndarray, high: np.ndarray) -> tuple[int, int, str]:
    """(bytes removed, maximal runs of them, digest of the rest)."""
    low, high = np.maximum(low, 0), np.minimum(high, len(text))
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    fresh = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    starts, ends = low[fresh], high[np.append(fresh[1:] - 1, len(high) - 1)]
    kept, at = hashlib.sha256(), 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.update(text[at:s])
        at = e
    kept.update(text[at:])
    return int((ends - starts).sum()), len(starts), kept.hexdigest()


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every document."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), body.alias("text"), F.unhex(F.sha2(body, 256)).alias("digest"))

    def run(batches):
        for batch in batches:
            spans = batch.column(1)
            out = []
            flat = spans.flatten()
            low, high = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
            end = 0
            for text, n in zip(batch.column(0), spans.value_lengths().to_pylist(), strict=True):
                if not n:
                    out.append((None, None, None))
                    continue
                start, end = end, end + n
                out.append(without(text.as_py(), low[start:end], high[start:end]))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(2, 5)), *columns], names=["id", "digest", "n_bytes", "n_removed", "n_spans", "kept"])

    met = rows.join(repeated_spans(rows.select("digest", "text")), "digest", "left")
    met = met.select(F.when(F.col("spans").isNotNull(), F.col("text")).alias("text"), "spans", "id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    kind = met.schema["id"].dataType.simpleString()
    done = met.mapInArrow(run, f"id {kind}, digest binary, n_bytes long, n_removed long, n_spans long, kept string")
    return done.select(F.col("id").alias(id_col), "n_bytes", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")), F.coalesce("kept", F.lower(F.hex("digest"))).alias("kept_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"))
