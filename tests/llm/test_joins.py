"""Jaccard join, embedding join and components against brute force, with odd rows."""

import random
import re

import numpy as np
import pytest

from tallyspark.llm import embedding_dedup, set_join
from tallyspark.llm.common import components


def closure(nodes, links):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2001 + i) for i in range(300)] + [(7, 7)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    expected = closure(nodes, edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")).collect()}
    assert got == expected
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, percent):
    sets = {i: shingles(t, n) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = closure(ids, links)
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize("n,percent,hot,bucket", [(3, 90, 64, 1 << 20), (5, 80, 64, 1 << 20), (5, 80, 4, 2000), (3, 90, 3, 500)])
def test_jaccard(spark, monkeypatch, n, percent, hot, bucket):
    monkeypatch.setattr(set_join, "HOT", hot)
    monkeypatch.setattr(set_join, "BUCKET", bucket)
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 6, 12, 20, 40, 80, 200, 600, 2000]))
        for _ in range(rng.randrange(1, 7)):
            copy = [w if rng.random() > 0.01 * rng.randrange(4) else rng.choice(vocabulary) for w in base]
            docs.append((len(docs), " ".join(copy)))
    passage = rng.choices(vocabulary, k=60)
    docs += [(len(docs) + i, " ".join(rng.choices(vocabulary, k=8) + passage)) for i in range(40)]
    hot = rng.choices(vocabulary, k=120)
    for _ in range(80):
        copy = list(hot)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        docs.append((len(docs), " ".join(copy)))
    k = len(docs)
    docs += [(k, None), (k + 1, ""), (k + 2, " \t\n"), (k + 3, "A b\x0bC"), (k + 4, "a B c"), (k + 5, "x " * 60_000), (k + 6, "x y z"), (k + 7, docs[0][1].upper())]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, n_shingles int").repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in set_join.similar_components(df, n, percent).collect()}
    assert got == brute(docs, n, percent)


def test_jaccard_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert set_join.similar_components(empty).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "only here now and then so")]
    got = sorted(map(str, (tuple(r) for r in set_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, [(5, 2, 3), (5, 2, 3), (3, 2, 3), (None, 2, 3), (None, 2, None)]))


def test_allocation_covers_the_bound():
    for percent in (80, 90, 95):
        for band in range(60):
            low, high = set_join.band_starts()[band : band + 2]
            twos, ones, empty, costly = set_join.allocation(band, percent)
            differ = (high - 1 + (high - 1) * 100 // percent) * (100 - percent) // (100 + percent)
            assert (twos + ones == 0) == (differ == 0)
            assert differ == 0 or 2 * twos + ones >= differ + 1 + empty + costly


def test_sets_keep_enough_segments():
    """Two similar sets agree on one more segment than both may leave out, among those that both use, in the smaller one's band."""
    for percent in (80, 90):
        for small in [*range(1, 400), 999, 5000]:
            for large in {small, small * 100 // percent, (small + small * 100 // percent) // 2}:
                differ = (small + large) * (100 - percent) // (100 + percent)
                own = set_join.bands_of(small, percent)[-1]
                both = [(x, y) for x in set_join.segments_of(small, percent) for y in set_join.segments_of(large, percent) if x[0] == y[0] == own]
                if differ == 0 and not both:
                    continue
                assert both, (small, large)
                for (band, twos, _, one, empty), (_, _, _, two, _) in both:
                    spare = empty + max(set_join.spare_of(small, percent), set_join.spare_of(large, percent))
                    assert 2 * twos + min(one, two) >= differ + 1 + spare, (small, large, band)


def test_blocks_round_trip():
    x = np.random.default_rng(0).integers(0, 2**63, 1000)
    assert (set_join.unpacked(set_join.packed(x), "<i8") == x).all()
    assert (set_join.unpacked(set_join.packed(x.astype(np.uint32)), "<u4") == x.astype(np.uint32)).all()


def vectors(rng):
    centres = rng.normal(size=(12, 24))
    out = []
    for c in centres:
        for _ in range(25):
            out.append(c + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.45]))
    return [tuple(map(float, np.float32(v))) for v in out]


@pytest.mark.parametrize("blocks,tile", [(1, 1024), (4, 16), (8, 1024)])
def test_embeddings(spark, monkeypatch, blocks, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 64)
    rows = list(enumerate(vectors(np.random.default_rng(blocks))))
    n = len(rows)
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, tuple(2 * x for x in rows[3][1]))]
    good = dict(rows)
    odd = [(n + 3, None), (n + 4, (0.0,) * 24), (n + 5, (float("nan"),) * 24), (n + 6, (None,) * 24), (n + 7, ())]
    x = np.array([v for _, v in rows], np.float64)
    cos = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))
    linked = [(a, b) for a in range(len(x)) for b in range(len(x)) if a != b and cos[a, b] >= 0.9]
    label = closure([*good, *(i for i, _ in odd)], linked)
    expected = {i: (sum(a == i for a, _ in linked), label[i], label[i] == i) for i in label}
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, n_links int").repartition(4)
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df.select("vec_id", "embedding"), blocks=blocks).collect()}
    assert got == expected


def test_embeddings_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0]), (None, [1.0, 0.0])], schema)
    got = sorted(map(str, (tuple(r) for r in embedding_dedup.near_duplicates(rows).collect())))
    assert got == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, False)]))
