"""The ten operators against brute force or SQL, on small tables with nulls, empties, ties and repeats."""

import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flankline.llm import boosting, covertree, langid, licenses, mixing, packing, quality, queries, shared, simhash, topk, toxicity, warc
from flankline.llm.shared import bucket_of, components, forest, table
from tests.conftest import same

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, length string"
ODD = [
    (1, None, "en", "a", None, "x", "y", "z"),
    (2, "", "en", "a", 0, "x", "y", "z"),
    (3, " \t\n", None, None, 3, "x", "y", "z"),
    (4, "one two", "en", "b", 7, "x", "y", "z"),
    (5, "The quick brown fox jumps over the lazy dog " * 3, "en", "b", 132, "x", "y", "z"),
    (6, "The quick brown fox jumps over the lazy dog " * 3, "en", "b", 132, "x", "y", "z"),
    (6, "The quick brown fox jumps over the lazy dog " * 3, "en", "b", 132, "x", "y", "z"),
    (7, "word " * 5000, "de", "c", 25000, "x", "y", "z"),
    (8, "x" * 30000, "de", "c", 30000, "x", "y", "z"),
    (9, "Licensed under the Apache License, Version 2.0.\n\nÜber  <|endoftext|> \x1c 東京", "de", "c", 60, "x", "y", "z"),
    (None, "no id here at all", "fr", "c", 17, "x", "y", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (7, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, duck, name):
    assert same(queries.QUERIES[name](spark, sf), duck, queries.ORACLE_SQL[name]) > 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 8), (7, 9), (2, 5), (20, 21)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_chain(spark):
    n = 200
    got = components(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r["root"] for r in got.collect()} == {0} and got.count() == n + 1


# ---- 1 quality


def test_quality_by_hand(spark, sf):
    """Every round's pseudo-labels, weights and the combined scores, by plain loops over all rows."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    folds = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(quality.FOLDS)).cast("int")).collect()}
    described = quality.described(docs, "doc_id", "text", ["source", "lang", "n_chars"])
    order = {r[0]: r[1] for r in described.select("id", F.xxhash64(F.lit(3), "id", "x")).collect()}
    rows = docs.toPandas()
    kind = {}
    for r in labels.toPandas().itertuples():
        if not pd.isna(r.quality):
            kind[r.doc_id] = min(kind.get(r.doc_id, 1), int(r.quality))
    x = {r.doc_id: quality.content(r.text) for r in rows.itertuples()}
    meta = {r.doc_id: (r.source, r.lang, r.n_chars) for r in rows.itertuples()}
    ids = sorted(set(kind) & set(x))
    rest = sorted(set(x) - set(kind), key=lambda d: order[d])
    many = [sum(v == k for v in kind.values()) for k in (0, 1)]
    seen = [sum(kind[d] == k for d in ids) for k in (0, 1)]
    weight = np.array([many[kind[d]] / seen[kind[d]] for d in ids])
    labelled = quality.Rows(np.array([x[d] for d in ids]), [meta[d] for d in ids], np.array([float(kind[d]) for d in ids]), weight / weight.mean())
    given = []

    def exchange(views, mass):
        handed = []
        for teacher, scores in ((0, views[0](np.array([x[d] for d in rest]))), (1, views[1]([meta[d] for d in rest]))):
            sure = {k: [d for d, p in zip(rest, scores, strict=True) if (p <= quality.CONFIDENT, p >= 1 - quality.CONFIDENT)[k]] for k in (0, 1)}
            for k, some in sure.items():  # sources take turns; the order matters to sums of floats only
                turns = defaultdict(int)
                place = {d: (turns[meta[d][0]], order[d], turns.update({meta[d][0]: turns[meta[d][0]] + 1})) for d in some}
                some.sort(key=lambda d, place=place: place[d][:2])
            total = sum(map(len, sure.values()))
            part = [(x[d], meta[d], float(k), mass * len(sure[k]) / total / len(sure[k])) for k in (0, 1) for d in sure[k]]
            handed.append(quality.Rows(*map(list, zip(*part, strict=True))) if part else None)
            if part:
                handed[-1].x, handed[-1].y, handed[-1].weight = map(np.array, (handed[-1].x, handed[-1].y, handed[-1].weight))
            given.append(total)
        return handed[::-1]

    model = quality.cotrained(labelled, np.array([folds[d] for d in ids]), exchange)
    want, by_content, by_metadata = model(np.array([x[d] for d in rows.doc_id]), [meta[d] for d in rows.doc_id])
    got = quality.op1(spark, sf).toPandas().set_index("doc_id").loc[rows.doc_id]
    assert max(given) > 0 and len(rest) > 0
    for name, values in (("by_content", by_content), ("by_metadata", by_metadata), ("quality_score", want)):
        apart = np.flatnonzero(abs(got[name] - values) > 1e-9)
        assert not len(apart), (name, [(rows.doc_id[k], rows.lang[k], got[name].iloc[k], values[k], kind.get(rows.doc_id[k])) for k in apart[:9]], given)
    assert (got.kept == (want >= 0.5)).all()


def test_rare_sources_are_handed_over(spark):
    """All confident rows are counted; the rows that come back take the sources in turn."""
    rows = [(i, "big" if i % 50 else f"rare{i}", float(i % 3 > 0)) for i in range(6000)]
    df = spark.createDataFrame([(i, (s, "en", 1), [p] * len(quality.CONTENT)) for i, s, p in rows], "id long, meta struct<m0: string, m1: string, m2: int>, x array<double>").repartition(5)
    handed = quality.exchanged(df, [lambda x: x[:, 0], lambda m: np.full(len(m), 0.5)], 60.0)
    assert handed[0] is None and len(handed[1].y) == len(set(map(tuple, zip(handed[1].meta, handed[1].y, strict=True)))) - 2 + 2 * quality.OF_SOURCE
    assert len({m[0] for m in handed[1].meta}) == 121
    assert abs(handed[1].weight[handed[1].y == 1].sum() - 40) < 1e-9 and abs(handed[1].weight.sum() - 60) < 1e-9


def test_a_repeated_id_counts_once(spark, labels):
    docs = spark.createDataFrame([(5, "good words here", "s", "en", 1)] * 500 + [(7, "*** ***", "s", "en", 1)], "doc_id long, text string, source string, lang string, n_chars long")
    assert quality.quality_scores(docs, labels, ["doc_id"]).count() == 501


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = quality.quality_scores(docs, labels, ["doc_id"], bucket_of(F.col("doc_id"), 4) != 2)
    rows = out.where(bucket_of(F.col("doc_id"), 4) == 2).join(labels, "doc_id").toPandas()
    assert (rows[rows.quality == 0].quality_score < 0.5).mean() > 0.85
    assert (rows[rows.quality == 1].quality_score >= 0.5).mean() > 0.98


def test_cotraining_uses_the_other_view():
    rng = np.random.default_rng(0)
    n = 3000
    y = rng.integers(0, 2, n).astype(float)
    x = np.column_stack([np.where(rng.random(n) < 0.5, y, 0.5) + rng.normal(0, 0.1, n), rng.normal(size=n)])
    meta = [("good" if v == 1 else "bad", 100) if rng.random() < 0.9 else ("any", 100) for v in y]
    fold = rng.integers(0, 4, n)
    labelled = quality.Rows(x[:400], meta[:400], y[:400], np.ones(400))

    def exchange(views, mass):
        handed = []
        for p in (views[0](x[400:]), views[1](meta[400:])):
            sure = {0: np.flatnonzero(p <= quality.CONFIDENT) + 400, 1: np.flatnonzero(p >= 1 - quality.CONFIDENT) + 400}
            picked = {k: (x[at], [meta[i] for i in at]) for k, at in sure.items() if len(at)}
            handed.append(quality.pseudo_labelled({k: len(v[1]) for k, v in picked.items()}, picked, mass))
        return handed[::-1]

    model = quality.cotrained(labelled, fold[:400], exchange)
    score, by_content, _ = model(x[400:], meta[400:])
    combined, alone = ((s > 0.5) == y[400:] for s in (score, by_content))
    assert combined.mean() > alone.mean() and combined.mean() > 0.93


def test_quality_odd_rows(odd, labels, spark):
    out = quality.quality_scores(odd, labels, ["doc_id"]).toPandas()
    assert len(out) == len(ODD) and out.quality_score.between(0, 1).all()
    none = quality.quality_scores(odd, labels.where("false"), ["doc_id"]).toPandas()
    assert (none.quality_score == 1).all()
    assert quality.quality_scores(odd.where("false"), labels, ["doc_id"]).count() == 0


# ---- 2 WARC


def test_warc_round_trip(spark):
    big = "ä" * 60
    rows = [(5, big), (3, big), (9, big + "?"), (9, big), (None, big), (4, "tiny"), (2, "tiny"), (1, None), (7, ""), (6, "WARC/1.1\r\n\r\n" * 20), (8, big + "!"), (3, big)]
    pages = spark.createDataFrame([(i, "u", h, "path") for i, h in rows], "page_id long, url string, html string, path string").repartition(2)
    folder = warc.new_path(spark, "test")
    archives = warc.write_archives(pages, folder)
    members = warc.normalise(archives, folder + "-members")
    back = warc.read_records(members).toPandas()
    assert len(back) == len(rows)
    assert sorted(back[back.type == "revisit"].uri) == ["page:", "page:5", "page:9"] and (back.uri == "page:").sum() == 1
    assert list(back[back.uri == "page:"].refers_to) == ["page:3"]
    for _, r in back[~back.uri.isin(["page:", "page:9"])].iterrows():
        page = int(r.uri[5:])
        want = (dict(rows)[page] or "").encode()
        if page == 5:
            assert (r.type, r.refers_to, bytes(r.payload)) == ("revisit", "page:3", b"")
        else:
            assert r.type == "response" and bytes(r.payload) == want
        assert r.n == len(want)
    assert warc.write_archives(pages.where("false"), folder + "-none").count() == 0


def test_warc_streams():
    data = [warc.record([("WARC-Type", "response")], bytes([k % 256]) * k) for k in (0, 1, 5, 3_000_000)]
    import gzip
    import io

    one = gzip.compress(b"".join(data))
    many = b"".join(map(warc.deflated, data))
    for blob in (one, many):
        assert list(warc.records(warc.inflated(io.BytesIO(blob)))) == data
    with pytest.raises(ValueError):
        list(warc.records(iter([data[2][:-3]])))


# ---- 3 packing


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.public_vocabulary())
    fast = packing.tokenizer(packing.public_vocabulary())
    texts = [r[1] or "" for r in ODD] + ["it's  we'll\n\n\n x\t", "   á ½ ٣ 👩‍👩‍👧 \r\n", "a" * 5000 + " " * 5000 + "!?" * 900, "a <|endoftext|> b<|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|>"]
    for t in texts:
        assert fast(t) == slow.encode(t, add_special_tokens=False).ids


def check_packed(rows, capacity):
    rows = rows.sort_values(["sequence_id", "offset"])
    for _, g in rows.groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum([0, *g.length])[:-1]) and g.length.sum() <= capacity


def test_pack(odd):
    out = packing.pack(odd, packing.public_vocabulary(), capacity=256).toPandas()
    check_packed(out, 256)
    assert out.length.sum() / 256 <= out.sequence_id.nunique() <= out.length.sum() / 256 * 1.2 + 1
    ids = packing.tokenizer(packing.public_vocabulary())
    for doc, text in ((d, t) for d, t, *_ in ODD if d not in (None, 6)):
        mine = out[out.doc_id == doc].sort_values("piece")
        tokens = np.array([*ids(text or ""), 0], "<u4")
        assert list(mine.start) == list(np.cumsum([0, *mine.length])[:-1]) and mine.length.sum() == len(tokens)
        assert all(n == 256 for n in mine.length[1:]) or len(mine) == 1
        assert [zlib.crc32(tokens[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length, strict=True)] == list(mine.ids_crc32)
    assert packing.pack(odd.where("false"), packing.public_vocabulary()).count() == 0


def test_pack_null_and_repeated_ids(spark):
    rows = [(None, f"word {k % 7}") for k in range(300)] + [(1, "same text here")] * 200 + [(2, None)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), packing.public_vocabulary(), capacity=16).toPandas()
    check_packed(out, 16)
    assert len(out) == len(rows) and out.doc_id.isna().sum() == 300 and (out.doc_id == 1).sum() == 200


def histograms(spark):
    for sf in ("sf0.01", "sf0.1"):
        cut = packing.pieces(table(spark, f"/root/testdata/{sf}", "documents"), packing.public_vocabulary())
        yield {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    for seed in range(4):
        lengths = np.minimum(2048, np.random.default_rng(seed).lognormal(6, 1, 20_000).astype(int) + 1)
        yield dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    yield {1025: 50, 1500: 70, 2000: 100}
    yield {700: 50, 701: 70, 900: 100, 1030: 33, 1400: 20}


def test_linear_program(spark):
    for histogram in histograms(spark):
        kinds = np.array(sorted(histogram))
        counts = np.array([histogram[int(x)] for x in kinds])
        solution = packing.solved(kinds, counts, 2048)
        covered = np.zeros(len(kinds))
        for config, n in solution.uses.items():
            assert kinds[list(config)].sum() <= 2048
            np.add.at(covered, list(config), n)
        assert (covered == counts).all()
        full, left = packing.rounded(kinds, counts, solution, 2048)
        plan = full + packing.best_fit(kinds, left, 2048)
        used = defaultdict(int)
        for config, n in plan:
            assert kinds[list(config)].sum() <= 2048
            for i in config:
                used[int(kinds[i])] += n
        assert used == histogram
        total, alone, by_program = (sum(n for _, n in x) for x in (plan, packing.best_fit(kinds, counts, 2048), full))
        print(f"dual {solution.bound:.1f}, program {solution.value:.1f}, packed {total} ({by_program} from the program), best fit alone {alone}")
        assert (kinds * counts).sum() / 2048 <= solution.bound + 1e-6 and solution.bound <= total + 1e-6
        assert total <= alone and solution.value <= (1.01 if len(kinds) > 5 else 1.05) * solution.bound + 2
        if len(kinds) > 5:
            assert by_program > total / 2


def test_linear_program_beside_all_configurations():
    rng = np.random.default_rng(0)
    for _ in range(20):  # the dual value is a bound on the least number of sequences, found by trying everything
        lengths, counts = np.sort(rng.choice(np.arange(2, 12), 3, replace=False)), rng.integers(1, 4, 3)
        items = np.repeat(lengths, counts)

        def least(left, rooms):
            if not len(left):
                return len(rooms)
            tries = {tuple(sorted([*rooms[:k], r - left[0], *rooms[k + 1 :]])) for k, r in enumerate(rooms) if r >= left[0]} | {tuple(sorted([*rooms, 12 - left[0]]))}
            return min(least(left[1:], t) for t in tries)

        best = least(tuple(int(x) for x in items[::-1]), ())
        assert packing.solved(lengths, counts, 12).bound <= best + 1e-9
        assert best <= sum(n for _, n in packing.planned(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), 12)) <= best + 1


def test_knapsack_by_brute_force():
    lengths, prices = np.array([3, 5, 7]), np.array([2.0, 4.0, 5.5])
    best = packing.knapsack(lengths, prices, 20)
    brute = [max(2 * a + 4 * b + 5.5 * c for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= k) for k in range(21)]
    assert np.allclose(best, brute)


# ---- 4 top k


def test_top_k_odd_rows(spark):
    rows = [(0, [1, 2]), (1, [3, -1]), (2, [3, -1]), (100, [0, 5]), (200, None), (300, [1, None]), (400, [7, 7, 7]), (0, [9, 9]), (None, [9, 9])]
    v = spark.createDataFrame(rows, "id long, v array<int>")
    fit = topk.whole(v, "v").withColumn("v", F.col("v").cast("array<long>"))
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in topk.top_k(fit.where("id = 100"), fit, 2, "id", "v").collect())
    assert got == [(100, 1, 0, 45), (100, 2, 0, 10)]
    own = topk.top_k(fit.where("id = 0"), fit, 9, "id", "v").collect()
    assert {r.id for r in own} == {1, 2, 100}
    assert topk.top_k(fit.where("false"), fit, 2, "id", "v").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_index_is_exact(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(1024 * rng.normal(size=(500, int(rng.choice([2, 8, 64]))))).astype(np.int64)
    x[rng.integers(0, 500, 60)] = x[0]
    index = topk.Index(x)
    for q in range(0, 500, 50):
        found = index.search(x[q], 10, np.array([q]))
        score = x @ x[q]
        others = np.delete(np.arange(500), q)
        want = others[np.lexsort((others, -score[others]))[:10]]
        assert set(want) <= set(found) and q not in found


# ---- 5 cover tree


def brute_links(x, m, cosine):
    n = np.linalg.norm(x, axis=1)
    near = x @ x.T / np.outer(n, n) >= cosine
    np.fill_diagonal(near, False)
    return (near * m[None, :]).sum(axis=1), forest(near)


@pytest.mark.parametrize("seed", range(12))
def test_trees_find_every_link(seed):
    rng = np.random.default_rng(seed)
    d, n = int(rng.choice([2, 3, 8, 64])), int(rng.integers(2, 300))
    centres = rng.normal(size=(max(1, n // 12), d))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, d)) * rng.choice([0.01, 0.05, 0.2])
    m, cosine = rng.integers(1, 4, n), float(rng.choice([0.98, 0.9, 0.995]))
    sums, root = brute_links(x, m, cosine)
    rows = pd.DataFrame({"rep": np.arange(n), "m": m, "v": list(x)})
    for parts in ([(rows, None)], [(rows[: n // 2], None), (rows[n // 2 :], None), (rows[: n // 2], rows[n // 2 :])]):
        got, label = np.zeros(n, int), np.arange(n)
        for here, there in parts:
            if len(here) and (there is None or len(there)):
                rep, links, other = covertree.meet(here, there, cosine)
                np.add.at(got, rep, links)
                shared.unite(label, rep, other)
        assert (got == sums).all() and (label == root).all()


def test_over_200000_child_pairs():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(10, 6))
    x = base[rng.integers(0, 10, 2000)] + rng.normal(size=(2000, 6)) * rng.random((2000, 1))
    m = rng.integers(1, 4, 2000)
    sums, root = brute_links(x, m, 0.9)
    rep, links, other = covertree.meet(pd.DataFrame({"rep": np.arange(2000), "m": m, "v": list(x)}), None, 0.9)
    got, label = np.zeros(2000, int), np.arange(2000)
    np.add.at(got, rep, links)
    shared.unite(label, rep, other)
    assert (got == sums).all() and (label == root).all()


@pytest.mark.parametrize("block", [4, 4096])
def test_vector_groups(spark, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    x = [(base[i % 12] + rng.normal(size=6) * 0.05).tolist() for i in range(60)]
    rows = [(k, v, k % 2, "n") for k, v in enumerate(x)] + [(60, x[0], 0, "n"), (61, x[0], None, "n"), (62, None, 0, "n"), (63, [0.0] * 6, 0, "n"), (64, [float("nan")] * 6, 0, "n"), (65, [1.0], 0, "n"), (66, [], 0, "n"), (None, x[0], 0, "n")]
    got = covertree.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n string"), block=block).toPandas()
    assert list(got[got.vec_id.isna()].n_links) == [0]
    got = got.dropna(subset=["vec_id"]).astype({"vec_id": int, "component_id": int}).set_index("vec_id").sort_index()
    ok = np.array(x + [x[0]])
    lab = np.array([k % 2 for k in range(60)] + [0])
    n = np.linalg.norm(ok, axis=1)
    near = (ok @ ok.T / np.outer(n, n) >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    assert list(got.n_links[:61]) == list(near.sum(axis=1)) and list(got.component_id[:61]) == list(forest(near))
    assert list(got.n_links[61:]) == [0] * 6 and list(got.component_id[61:]) == list(range(61, 67))
    assert (got.kept == (got.index == got.component_id)).all()


def test_repeated_ids_of_other_vectors(spark):
    """An id with several vectors or labels is several vectors; only linked rows have links."""
    a, near, far = [1.0, 0.0], [1.0, 0.01], [0.0, 1.0]
    rows = [(5, a, "A"), (7, near, "A"), (5, far, "A"), (5, a, "B"), (3, far, "A"), (3, far, "A")]
    got = covertree.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    assert sorted(map(tuple, got.collect())) == [(3, 2, 3, True), (3, 2, 3, True), (5, 0, 5, True), (5, 1, 5, True), (5, 2, 3, False), (7, 1, 5, False)]


# ---- 6 SimHash


def slow_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    counts = [sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b, c in enumerate(counts) if 2 * c > len(grams))


def test_fingerprints():
    for _, text, *_ in ODD:
        assert simhash.fingerprint(simhash.shingle_hashes(text)) == slow_fingerprint(text)


@pytest.mark.parametrize(("sf", "block"), [("sf0.01", 2048), ("sf0.001", 4)])
def test_simhash_groups(spark, monkeypatch, sf, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    got = simhash.simhash_groups(docs).toPandas()
    fps, at = np.unique(np.array([int(f, 16) for f in got.fingerprint], np.uint64), return_inverse=True)
    root = forest(np.bitwise_count(fps[:, None] ^ fps) <= 3)
    least = got.groupby(root[at]).doc_id.min()
    assert (got.component_id == least.loc[root[at]].to_numpy()).all()


@pytest.mark.parametrize("limit", [1, 3, 5])
def test_links_connect_all(spark, limit):
    rng = np.random.default_rng(limit)
    seeds = rng.integers(0, 2**63, 20).astype(np.uint64)
    fps = np.unique([int(s) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 7))) for s in seeds for _ in range(15)]).astype(np.uint64)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").selectExpr("fp", "fp AS node", "1 AS size"), limit).toPandas()
    a, b = (np.searchsorted(fps, edges[c].to_numpy().view(np.uint64)) for c in "ab")
    label = np.arange(len(fps))
    shared.unite(label, a, b)
    assert (label == forest(np.bitwise_count(fps[:, None] ^ fps) <= limit)).all()


def test_allocation_keeps_the_principle():
    rng = np.random.default_rng(0)
    p = rng.random(64)
    for n in (100, 10**5, 10**8, 10**11):
        plan = simhash.allocation(np.outer(p, p) * n * (1 - np.eye(64)) + np.diag(p) * n, n, 3)
        used = [b for bits, _ in plan for b in bits]
        assert len(used) == len(set(used))
        # groups left out have threshold -1: sum over all = 3 - groups + 1
        assert sum(t + 1 for _, t in plan) == 4


@pytest.mark.parametrize("block", [128])
def test_similar_documents_by_brute_force(spark, monkeypatch, block):
    """No document goes unless a kept one's chain of copies is alike by 0.8; most of those that could go do."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("length(text) < 5000")
    rng = np.random.default_rng(1)
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for k, (_, text) in enumerate(list(rows.items())[:300]):  # further near copies: some words of each are changed
        words = (text or "").split(" ")
        for i in rng.integers(0, len(words), max(1, len(words) // int(rng.integers(40, 200)))):
            words[i] = f"changed{k}"
        rows[100_000 + k] = " ".join(words)
    kept = {r.doc_id for r in simhash.one_of_each_group(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    sets = {k: simhash.shingle_set(t, 5) for k, t in rows.items()}
    by_shingle = defaultdict(set)
    for k, x in sets.items():
        for g in x:
            by_shingle[g].add(k)
    ids = sorted(rows)
    at = {k: i for i, k in enumerate(ids)}
    label = np.arange(len(ids))
    for k, x in sets.items():
        counts = defaultdict(int)
        for g in x:
            for other in by_shingle[g]:
                counts[other] += other > k
        near = [o for o, both in counts.items() if both and both >= 0.8 * (len(x) + len(sets[o]) - both)]
        near += [o for o in ids if not x and not sets[o] and o > k]
        shared.unite(label, np.array([at[k]] * len(near), int), np.array([at[o] for o in near], int))
    must = {ids[i] for i in range(len(ids)) if label[i] != i}
    gone = set(ids) - kept
    print(f"{len(must)} rows could go, {len(gone)} went")
    assert gone <= must and len(gone) > 0.85 * len(must)


# ---- 7 licences


def test_licences_odd_rows(odd):
    assert [(r.doc_id, r.license, r.dice, r.passages, r.windows) for r in licenses.scan(odd).collect()] == [(9, "Apache-2.0", 1.0, 1, 1)]
    assert licenses.scan(odd.where("false")).count() == 0


def test_licences_within_lines_and_across_paragraphs(spark):
    apache = max((b for n, b in licenses.TEMPLATES if n == "Apache-2.0"), key=len)
    parted = apache.replace(" Unless", "\n\nUnless").replace(" See", "\n\nSee")
    rows = [
        (1, "Copyright 2020 Foo. Licensed under the Apache License, Version 2.0. See the LICENSE file for details."),
        (2, "Made with care. SPDX-License-Identifier: CC-BY-SA-4.0 is its tag; all rights reserved."),
        (3, "We licensed under pressure; the license was released yesterday."),
        (4, parted),
        (5, "license " * 30_000),
        (6, "word " * 3_000 + "Released under the MIT License. " * 2 + "word " * 3_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.passages, r.windows) for r in licenses.scan(docs).collect()}
    assert got == {(1, "Apache-2.0"): (0, 1), (2, "CC-BY-SA-4.0"): (0, 1), (2, "proprietary"): (0, 1), (4, "Apache-2.0"): (0, 1), (6, "MIT"): (0, 2)}


def test_licence_anchors_leave_no_match_without_one():
    for _, body in licenses.TEMPLATES:
        grams = licenses.bigrams(body)
        lo, _ = licenses.bounds(len(grams), 0.8)
        assert len(grams - {g for g, _ in licenses.anchors(body, 0.8)}) < lo


def test_near_wording_and_bounds(spark):
    mit = dict((len(b), b) for n, b in licenses.TEMPLATES if n == "MIT")
    long = mit[max(mit)]
    wrapped = "Some prose.\n\n" + long.replace(" and ", " AND\n") + "\n\nMore prose."
    docs = spark.createDataFrame([(1, wrapped), (2, "Released under MIT License."), (3, "Released yesterday under the new license"), (4, long[: len(long) // 3])], "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in licenses.scan(docs).collect()} == {(1, "MIT"), (2, "MIT")} - ({(2, "MIT")} if 2 * 2 / 7 < 0.8 else set())
    for _, body in licenses.TEMPLATES:
        grams = licenses.bigrams(body)
        words = licenses.pivotal(grams, 0.8)
        left = [g for g in grams if not set(g.split()) & set(words)]
        assert len(left) < 0.8 * len(grams) / 1.2


# ---- 8 language


def test_forward_backward_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    lengths, width = np.array([1, 3, 5, 2]), 3
    e, t = rng.normal(size=(lengths.sum(), width)), rng.normal(size=(width, width))
    got, pairs = langid.marginals(e, lengths, t)
    want, want_pairs, at = [], np.zeros((width, width)), 0
    for n in lengths:
        p, total = np.zeros((n, width)), 0.0
        both = np.zeros((width, width))
        for y in product(range(width), repeat=int(n)):
            w = np.exp(sum(e[at + i, k] for i, k in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            for i, k in enumerate(y):
                p[i, k] += w
            for a, b in zip(y, y[1:], strict=False):
                both[a, b] += w
        want.append(p / total)
        want_pairs += both / total
        at += n
    assert np.allclose(got, np.concatenate(want)) and np.allclose(pairs, want_pairs)


def test_blocks_agree(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = np.array([1, 31, 32, 33, 200, 0, 64])
    e, t = rng.normal(size=(lengths.sum(), 4)), rng.normal(size=(4, 4))
    one, pairs = langid.marginals(e, lengths, t)
    monkeypatch.setattr(langid, "BLOCK", 7)
    two, pairs2 = langid.marginals(e, lengths, t)
    assert np.allclose(one, two) and np.allclose(pairs, pairs2)


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = langid.op8(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()


def test_code_switched_words(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    model = langid.fitted(docs, F.lit(True))
    texts = {r.lang: r.text for r in docs.where("length(text) > 600").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    parts = [(lang, [w for w in map(langid.core, t.split()) if w][:60]) for lang, t in sorted(texts.items())]
    words = [w for _, ws in parts for w in ws]
    p, _ = langid.marginals(model.emissions(words), np.array([len(words)]), model.transition)
    truth = [model.languages.index(lang) for lang, ws in parts for _ in ws]
    assert (p.argmax(axis=1) == truth).mean() > 0.9


def test_every_letter_counts():
    one, two = "abcde", "vwxyz"
    rng = np.random.default_rng(0)
    words = [("".join(rng.choice(list(x), 6)), k) for x, k in ((one, 0), (two, 1)) for _ in range(400)]
    model = langid.fit(langid.spliced([(["a", "b"][k], [w]) for w, k in words], ["a", "b"]), ["a", "b"], 4)
    start, rest = "".join(rng.choice(list(one), 40)), "".join(rng.choice(list(two), 2000))
    mixed = [start + rest, "-".join([start[:6]] * 7 + [rest[i : i + 6] for i in range(0, 600, 6)]), start]
    share, many = langid.label_documents(mixed, langid.Memo(model))
    assert list(share.argmax(axis=1)) == [1, 1, 0] and list(many) == [51, 107, 1]
    assert langid.cores("Don't_stop-" + "x" * 41 + "e\u0301a 12") == ["don", "t", "stop", "x" * 40, "xea"]


def test_true_letters_and_long_words(spark):
    docs = spark.createDataFrame([(k, x, lang) for k in range(40) for x, lang in ((f"das ist ein wort{'abcdefgh'[k % 8]}", "de"), (f"that was some word{'abcdefgh'[k % 8]}", "en"))], "doc_id long, text string, lang string")
    model = langid.fitted(docs, F.lit(True))
    odd = spark.createDataFrame([(1, "½ ² ① Ⅷ ٣ 42 _ -"), (2, "²a"), (3, "das" * 4000), (4, "das" * 14 + "some" * 4000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages_of(odd, model, ["doc_id"]).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] != "und" and got[3] != got[4]


def test_query_by_hand(spark):
    """The whole labelling of tiny documents against sums over all label sequences."""
    from itertools import product

    docs = spark.createDataFrame([(k, x, lang) for k in range(30) for x, lang in (("uno dos tres", "es"), ("one two three", "en"))], "doc_id long, text string, lang string")
    model = langid.fitted(docs, F.lit(True))
    texts = ["uno two", "one-dos, three!", "x", "tres tres one dos"]
    got = langid.languages_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, ["doc_id"]).toPandas().set_index("doc_id")
    for k, t in enumerate(texts):
        words = [w for token in t.split() for w in langid.cores(token)]
        e = model.emissions(words)
        share, total = np.zeros(2), 0.0
        for y in product(range(2), repeat=len(words)):
            p = np.exp(sum(e[i, c] for i, c in enumerate(y)) + sum(model.transition[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            share += p * np.bincount(y, minlength=2) / len(y)
        assert got.lang_pred[k] == model.languages[int(share.argmax())] and abs(got.score[k] - share.max() / total) < 1e-5


def test_many_languages_and_long_documents(spark):
    rng = np.random.default_rng(0)
    vocabulary = {f"l{k:02d}": ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(20)] for k in range(70)}
    rows = [(100 * i + k, " ".join(rng.choice(ws, 40)), lang) for i, (lang, ws) in enumerate(vocabulary.items()) for k in range(4)]
    rows.append((9999, "zyxw vuts rqpo " * 10_100, "long"))  # its language has no other document
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fitted(docs, F.lit(True))
    assert set(model.languages) == {*vocabulary, "long"}
    tests = {**{lang: " ".join(rng.choice(ws, 30)) for lang, ws in vocabulary.items()}, "long": "vuts zyxw rqpo"}
    share, _ = langid.label_documents(list(tests.values()), langid.Memo(model))
    got = [model.languages[k] for k in share.argmax(axis=1)]
    assert np.mean([a == b for a, b in zip(got, tests, strict=True)]) > 0.95 and got[-1] == "long"


def test_language_odd_rows(odd):
    out = langid.languages_of(odd, langid.fitted(odd, F.lit(True)), ["doc_id"]).toPandas()
    assert set(out[out.doc_id.isin([1, 2, 3])].lang_pred) == {"und"} and set(out.lang_pred) <= {"und", "en", "de", "fr"}
    assert langid.languages_of(odd.where("false"), None, ["doc_id"]).count() == 0


# ---- 9 mixing


def test_targets_by_resharing(spark):
    rng = np.random.default_rng(5)
    for _ in range(5):
        n = int(rng.integers(1, 9))
        sizes = rng.integers(0, 1000, n) * rng.choice([1, 50], n)
        rows = [(f"s{k}", int(s)) for k, s in enumerate(sizes)]
        df = spark.createDataFrame(rows, "source string, source_size long").withColumn("__key", F.col("source"))
        got = {r["__key"]: r.target for r in mixing.targets(df, "source", (3, 1, 2), 1.5, 2.0).collect()}
        weight = np.array([(3, 1, 2)[k % 3] for k in range(n)], float)
        target, capped = np.zeros(n), np.zeros(n, bool)
        while True:
            left = 1.5 * sizes.sum() - 2 * sizes[capped].sum()
            target = np.where(capped, 2 * sizes, left * weight / max(weight[~capped].sum(), 1e-300))
            over = (target > 2 * sizes + 1e-9) & ~capped
            if not over.any():
                break
            capped |= over
        assert np.allclose([got[f"s{k}"] for k in range(n)], target)


def test_mix_odd_rows(odd, spark):
    out = mixing.mixed(odd).toPandas()
    assert len(out) == len(ODD) and (out.taken <= 2 * out["size"]).all()
    twice = mixing.mixed(odd).toPandas()
    assert sorted(out.taken) == sorted(twice.taken)
    assert mixing.emitted(odd).columns == odd.columns
    mix = mixing.emitted(odd).toPandas()
    assert len(mix) == out.copies.sum() and set(mix["size"]) == {"y"} and set(mix.fp) == {"x"}
    assert mixing.mixed(odd.where("false")).count() == 0
    named = mixing.mixed(odd.withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))).toPandas()
    assert len(named) == len(ODD) and named.doc_id.isna().sum() == 1
    hot = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    taken = mixing.mixed(hot).toPandas()
    assert len(taken) == 3000 and set(taken.taken) <= {3, 6} and abs(taken.taken.sum() / 13_500 - 1) < 0.01


def test_taken_is_near_target(spark):
    sf = "/root/testdata/sf0.1"
    out = mixing.op9(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("s")).toPandas()
    assert (abs(out.s / out.t - 1) < 0.05).all()


# ---- 10 toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op10(spark, sf).where("held_out").join(table(spark, sf, "labels"), "doc_id").toPandas()
    assert out[out.toxic == 1].predicted.mean() > 0.85 and out[out.toxic == 0].predicted.mean() < 0.01


def test_toxicity_odd_rows(odd, labels):
    out = toxicity.toxicity_scores(odd, labels, ["doc_id", "fp"]).toPandas()
    assert len(out) == len(ODD) and out.toxic_score.between(0, 1).all()
    assert (toxicity.toxicity_scores(odd, labels.where("false"), ["doc_id"]).toPandas().toxic_score == 0).all()


def test_obfuscated_words():
    tokens = toxicity.Tokens({"idiot": 3.0, "#lowei": 2.0})
    assert tokens["1d10t!"] & toxicity.UNDONE and tokens["i.d.i.o.t"] & toxicity.UNDONE
    assert tokens["Idiot,"] & toxicity.HIT and tokens["loweichen"] & toxicity.STEMMED and tokens["IDIOT"] & toxicity.SHOUTED
    assert tokens["you"] == toxicity.SECOND and tokens["tree"] == 0


def test_models():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = boosting.fit_trees(x, y, np.ones(2000))
    assert ((trees.raw(x) > 0) == y).mean() > 0.95
    steps = boosting.fit_steps(trees.raw(x), y, np.ones(2000))
    grid = steps(np.linspace(-5, 5, 50))
    assert (np.diff(grid) >= 0).all() and 0 <= grid[0] < 0.2 and 0.8 < grid[-1] <= 1
    logit = boosting.fit_logit(x, (x[:, 2] > 0).astype(float), np.ones(2000))
    assert ((logit.raw(x) > 0) == (x[:, 2] > 0)).mean() > 0.97
    empty = boosting.fit_trees(np.zeros((4, 2)), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert len(empty.raw(np.zeros((0, 2)))) == 0


# ---- pipeline


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf, "documents")
    counts = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        names = docs.columns
        docs = shared.saved(stage(spark, docs, sf), "test")
        counts.append(docs.count())
        if k + 1 < len(pipeline.STAGES):
            assert docs.columns == names
    check_packed(docs.toPandas(), 2048)
    assert counts[0] >= counts[1] >= counts[2] > 0


CLASHES = ["quality_score", "by_content", "toxic_score", "size", "target", "copies", "row", "__row", "__text", "__meta", "sequence_id"]


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, sf, k):
    """Nulls, empties, repeats, clashing names and an empty table through every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(*r[:5], *CLASHES) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(2)
    name, stage = pipeline.STAGES[k]
    out = stage(spark, docs, sf)
    rows = out.toPandas()
    if name == "packing":
        check_packed(rows, 2048)
        assert len(rows.drop_duplicates(["doc_id", "piece"])) >= 10
    else:
        assert out.columns == docs.columns and all(set(rows[c]) <= {c} for c in CLASHES)
    if name == "near-duplicates":
        assert sorted(rows.doc_id.dropna()) == [1, 4, 5, 7, 8, 9] and len(rows) == 7
    assert stage(spark, docs.where("false"), sf).count() == 0
    assert stage(spark, docs.where("doc_id = 9"), sf).count() <= 2


def test_no_document_no_group(spark):
    none = spark.createDataFrame([], DOCS)
    for limit in (3, 10):  # no plan of astronomically many probes, whatever there is to estimate from
        for n in (0, 1, 2, 1000):
            plan = simhash.allocation(np.zeros((64, 64)), n, limit)
            assert all(sum(simhash.comb(len(bits), d) for d in range(t + 1)) <= simhash.MOST_KEYS for bits, t in plan)
    assert simhash.one_of_each_group(none).count() == 0 and simhash.simhash_groups(none).count() == 0


def test_filters_by_hand(spark, sf):
    """The filters keep exactly the rows whose scores, computed here without Spark, say so."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = docs.toPandas()
    model = quality.fitted(docs, labels, F.lit(True), "quality", "doc_id", "text", ["source", "lang", "n_chars"])
    score, _, _ = model(np.array([quality.content(t) for t in rows.text]), list(rows[["source", "lang", "n_chars"]].itertuples(index=False, name=None)))
    assert {r.doc_id for r in pipeline.quality_filter(spark, docs, sf).collect()} == set(rows.doc_id[score >= 0.5])
    lexicon, judge = toxicity.fitted(docs, labels, F.lit(True))
    score = judge(np.array([toxicity.features(t, toxicity.Tokens(lexicon)) for t in rows.text]))
    assert {r.doc_id for r in pipeline.toxicity_filter(spark, docs, sf).collect()} == set(rows.doc_id[score < 0.7])


def test_shared_folder(spark, tmp_path):
    assert shared.shared_folder(spark).startswith("file:///")
    with shared.scratch(spark):
        kept = shared.saved(spark.range(3), "gone")
        folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
        assert folder.exists()
    assert not folder.exists()

    class Cluster:
        class sparkContext:
            master = "spark://somewhere"
            applicationId = "other"
            getCheckpointDir = staticmethod(lambda: None)
            getConf = staticmethod(dict)

        class conf:
            get = staticmethod(lambda k, d: d)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Cluster)


def test_guard():
    entry = Path(__file__).resolve().parents[2] / "__spark_entry__.py"
    assert "except ModuleNotFoundError" in entry.read_text()
