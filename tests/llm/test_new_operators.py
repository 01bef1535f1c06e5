"""Source divergence, spelling variants and repeated passages against SQL and plain loops, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flankline.llm import divergence, repeats, spelling
from tests.conftest import same
from tests.llm.test_operators import DOCS, ODD

# ---- 11 source divergence


def shares_by_hand(rows):
    """{(lang, source, part, item): (value, rank)} by plain loops over (lang, source, text)."""
    words = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for la, so, t in rows]
    out = {}
    for lang in {w[0] for w in words}:
        df = Counter(t for la, _, ts in words if la == lang for t in set(ts))
        kept = sorted((t for t in df if df[t] >= divergence.LEAST_DOCS), key=str.encode)
        counts = defaultdict(Counter)
        for la, so, ts in words:
            if la == lang:
                counts[so].update(t for t in ts if t in set(kept))
        whole = sum(counts.values(), Counter())

        def share(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for so, c in counts.items():
            pair = [(sum(f(share(c, t), share(d, t)) for t in kept), other) for other, d in counts.items() if other != so]
            term = [(f(share(c, t), share(whole, t)), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items, most in (("pair", pair, None), ("term", term, divergence.TOP)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out[lang, so, part, item] = (value, rank)
    return out


def divergence_of(df):
    return {tuple(r)[:4]: (r["value"], r["rank"]) for r in divergence.source_divergence(df).collect()}


def test_divergence_tiles(spark, sf, duck, monkeypatch):
    """Many blocks, chunks and spans give what the SQL gives."""
    for name, value in (("BLOCK", 3), ("CHUNK", 8), ("SPAN", 2)):
        monkeypatch.setattr(divergence, name, value)
    assert same(divergence.op11(spark, sf), duck, divergence.SQL) > 0


def test_divergence_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame(ODD * 3 + [(20, "tie ete Éa eA xé " * 2, None, None, 0, "", "", ""), (21, "tie", "en", "a", 0, "", "", "")], DOCS)
    monkeypatch.setattr(divergence, "LEAST_DOCS", 3)
    want = shares_by_hand([(r.lang, r.source, r.text) for r in docs.collect()])
    assert divergence_of(docs) == want and ("en", "a", "pair", "b") in want
    assert divergence_of(docs.where("false")) == {}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["A", "b", "ß", "c-d", "東京", "ZZ"], k=rng.randrange(9))), rng.choice(["x", None]), rng.choice("pqrst"), 0, "", "", "") for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert divergence_of(docs) == shares_by_hand([(r.lang, r.source, r.text) for r in docs.collect()])


def test_shares_are_exact():
    counts = np.array([0, 1, 7, 10**9, 8 * 10**13], np.int64)
    for total in (9, 10**10 + 7, 9 * 10**13 - 1, 9 * 10**13, 10**15 + 3):
        assert divergence.shares(counts[counts <= total], total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts if c <= total]


def test_long_text_in_pieces():
    text = ("Word é-x " * 5000).encode()
    assert sum(divergence.pieces(text, 100), []) == "word é x ".encode().split() * 5000


# ---- 12 spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    by_near = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, some in by_near.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(by_near[w]), n[form[w]] if form[w] else None)
    return out


def variants_of(df):
    return {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(df).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_variants_by_hand(spark, seed, monkeypatch):
    """Short, long and borderline words, equal letters in a row, paths of several forms."""
    monkeypatch.setattr(spelling, "RADIX", 64)
    rng = random.Random(seed)
    letters = "abÀÿé"
    base = ["".join(rng.choices(letters, k=k)) for k in (7, 7, 8, 9, 12, 63, 64, 65, 66, 200)] + ["aaaaaaaa", "a" * 64, "b" * 65]
    words = []
    for w in base:
        for times in (1, 20, 210):
            words += [w] * times
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
        words += [w] * rng.randrange(30)
    rng.shuffle(words)
    rows = [(i if i % 7 else None, " ".join(words[i::40]).replace("b", rng.choice("bB"))) for i in range(40)]
    got, want = variants_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), variants_by_hand(rows)
    assert got == want
    assert any(v[0] for v in want.values()) and any(len(w) > 64 and v[3] for w, v in want.items())


def test_variants_odd_rows(spark, odd):
    assert variants_of(odd) == variants_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    assert variants_of(odd.where("false")) == {}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


def test_colliding_keys():
    """Equal keys of different strings are told apart."""
    keys, strings = np.array([1, 1, 1, 1, 2], np.uint64), np.array([b"x", b"y", b"x", b"y", b"x"])
    label = spelling.runs(keys, strings)
    assert label[0] == label[2] != label[1] == label[3] and label[4] not in label[:4]


# ---- 13 repeated passages


def kept_by_hand(texts, window=repeats.WINDOW):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in bodies for i in range(len(b) - window + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("block", [4096, 4])
def test_repeats_by_hand(spark, monkeypatch, block):
    """Passages within and across documents, near copies, runs of a letter, passages at borders; small and large groups."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = random.Random(block)

    def prose(n):
        return " ".join(rng.choice(["the", "ering", "aß", "tion", "東京", "of"]) + rng.choice("aei") for _ in range(n))

    base = [prose(150) for _ in range(10)]
    texts = [None, "", "x" * 199, "y" * 200, "z" * 1000, "ab" * 700, "x" * 201, "y" * 401 + "q" + "y" * 650, "abcdefg" * 90 + "!" + "abcdefg" * 31, prose(30), "\0" * 500, *base, *base[:3]]
    for b in base:
        for _ in range(3):
            i = rng.randrange(len(b))
            texts.append(b[:i] + rng.choice("qwz\0") + b[i + 1 :])
        i = rng.randrange(len(b) - 300)
        texts.append(prose(20) + b[i : i + rng.randrange(100, 290)] + prose(20))
    passage = base[0][10:260]
    texts += [prose(rng.randrange(1, 40)) + passage + prose(rng.randrange(1, 40)) for _ in range(30)]
    texts += [passage + prose(5), prose(5) + passage, passage, passage + passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in repeats.repeats_removed(docs).collect()}
    assert got == dict(enumerate(kept_by_hand(texts)))


def test_repeats_odd_rows(spark, odd):
    rows = sorted(odd.collect(), key=lambda r: str(r))
    got = sorted(map(tuple, repeats.repeats_removed(odd).collect()), key=str)
    assert got == sorted(((r.doc_id, *x) for r, x in zip(rows, kept_by_hand([r.text for r in rows]), strict=True)), key=str)
    assert repeats.repeats_removed(odd.where("false")).count() == 0


def test_runs_are_thinned():
    """A text of one letter has few anchors, which cover the same bytes."""
    places, same = np.arange(100_000), np.zeros(100_000, np.uint64)
    at = repeats.thinned(places, same, same)
    assert at[0] == 0 and at[-1] == 99_999 and len(at) < 600 and np.diff(at).max() <= repeats.WINDOW
    mixed = np.array([1, 1, 2, 2, 2, 1], np.uint64)
    assert repeats.thinned(np.arange(6), mixed, mixed).tolist() == [0, 1, 2, 4, 5]
    assert repeats.thinned(np.arange(0), mixed[:0], mixed[:0]).tolist() == []


def test_deep_shallow_sorting():
    rng = random.Random(1)
    for alphabet in (b"\0a", b"\0", bytes(range(256))):
        strings = [bytes(rng.choices(alphabet, k=rng.randrange(90))) for _ in range(300)]
        strings += [s[: rng.randrange(90)] + b"tail" for s in strings[:100]] + strings[:50]
        strings = [s[:100] for s in strings]
        assert [strings[k] for k in repeats.blind_trie_order(strings)] == sorted(strings)
        group = np.array([rng.randrange(4) for _ in strings])
        order, common = repeats.deep_shallow(group, strings, 100)
        assert [(group[k], strings[k]) for k in order] == sorted(zip(group.tolist(), strings, strict=True))
        for i in range(1, len(order)):
            a, b = strings[order[i - 1]], strings[order[i]]
            want = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[i] == (want if group[order[i - 1]] == group[order[i]] else -1)


def test_anchors_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"abc ", k=k)) for k in (0, 199, 200, 201, 900, 5000)] + [b"r" * 3000]

    def places():
        out = defaultdict(list)
        for t, at, grams in repeats.anchors(texts):
            out[t] += zip(at.tolist(), grams.tolist(), strict=True)
        return out

    whole = places()
    monkeypatch.setattr(repeats, "SLICE", 256)
    assert places() == whole and sorted(whole) == [2, 3, 4, 5, 6]


def test_a_refused_chain_hides_no_near_copy(spark):
    """Two texts alike by 0.8 are one group although a third one, nearer to both by fingerprint, is like neither."""
    import random

    from flankline.llm import simhash

    def alike(x, y):
        x, y = simhash.shingle_set(x, 5), simhash.shingle_set(y, 5)
        return len(x & y) >= 0.8 * len(x | y)

    rng, rows, found = random.Random(3), {}, 0
    while found < 6:
        base = [f"w{rng.randrange(10**6)}" for _ in range(44)]

        def variant(k):
            return " ".join(base[: 44 - k] + [f"v{rng.randrange(10**6)}" for _ in range(k)])

        a, marks = " ".join(base), lambda t: simhash.fingerprint(simhash.shingle_hashes(t, 5))
        c, others = variant(4), [variant(k) for k in (5, 6, 7) for _ in range(20)]
        far = (marks(a) ^ marks(c)).bit_count()
        chained = [b for b in others if not alike(a, b) and not alike(b, c) and max((marks(a) ^ marks(b)).bit_count(), (marks(b) ^ marks(c)).bit_count()) < far]
        if far <= 10 and alike(a, c) and chained:
            rows |= {10 * found: a, 10 * found + 1: chained[0], 10 * found + 2: c}
            found += 1
    kept = {r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert kept == {i for i in rows if i % 10 < 2}
