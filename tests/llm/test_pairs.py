"""Line dedup, MinHash and HNSW against brute force, with planted cases."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import hnsw, linedup, minhash
from folioflow.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string"


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n)]


def components(edges, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    r.shuffle(edges)
    ids = sorted({x for e in edges for x in e if e[0] != e[1]})
    got = {row.id: row.component for row in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == components(edges, ids)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Line dedup


def brute_lines(docs: dict[int, str | None], least: int) -> dict[int, list[str]]:
    """Lines that stay. A line begins a copy if its shortest run of `least` words came before without overlap; then the longest run from it that came before goes."""
    by = {i: [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")] for i, t in sorted(docs.items())}
    first: dict[tuple[str, ...], tuple[int, int]] = {}
    for i, s in by.items():
        for k in range(len(s)):
            for end in range(k + 1, len(s) + 1):
                first.setdefault(tuple(s[k:end]), (i, k))
    out = {}
    for i, s in by.items():
        gone: set[int] = set()
        for k in range(len(s)):
            n = next((n for n in range(1, len(s) - k + 1) if sum(len(x.split()) for x in s[k : k + n]) >= least), 0)
            d, at = first[tuple(s[k : k + n])] if n else (i, k)
            if (d, at) != (i, k) and (d != i or k - at >= n):
                gone |= {x for end in range(k + n, len(s) + 1) if first[tuple(s[k:end])] != (i, k) for x in range(k, end)}
        out[i] = [x for k, x in enumerate(s) if k not in gone]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_equals_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(words(r, n)) for n in (1, 2, 3, 4, 5, 12, 30)]
    docs: dict[int, str | None] = {i: "\n".join(r.choice([*pool, *pool[:3], "", "  "]) for _ in range(r.randint(0, 14))) for i in range(40)}
    docs[40], docs[41], docs[42] = docs[3], None, ""
    docs[43], docs[44] = "\n".join([pool[2]] * 30), "\n".join([pool[0], *[pool[4]] * 17, pool[1]])
    rows = [(i, t, "en", "s") for i, t in docs.items()]
    df = spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit(7), "rank": F.lit("x"), "_spans": F.lit(1), "d": F.lit(2), "k": F.lit(None).cast("int")})
    got = linedup.dedup_lines(df, 12)
    assert got.columns == [*df.columns, "n_lines_removed", "n_lines_left"]
    want = brute_lines(docs, 12)
    for row in got.collect():
        left = [x for x in (row.text or "").split("\n") if x.strip()]
        assert left == want[row.doc_id], row.doc_id
        assert row.n_lines_left == len(left)
        assert (row.text is None) == (docs[row.doc_id] is None)


def test_line_dedup_edges(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(5, f"own five\n{passage}\nend", None, None), (2, f"own two\n{passage}", None, None), (9, "short\nshort\nshort", None, None), (7, f"{passage} x", None, None), (2, f"own two\n{passage}", None, None), (None, passage, None, None)]
    got = {(r.doc_id, r.text, r.n_lines_removed) for r in linedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(5, "own five\nend", 1), (2, "own two", 1), (9, "short\nshort\nshort", 0), (7, f"{passage} x", 0), (None, passage, 0)}
    assert linedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_of_equal_lines_and_long_texts(spark):
    """What repeats itself keeps its first fifty words; a long text is cut as a whole."""
    line = " ".join("abcdefghijkl")
    long = "\n".join(f"{i} " + " ".join(f"w{i}x{j}" for j in range(9)) for i in range(3000))
    rows = [(1, "\n".join([line] * 8), None, None), (2, "\n".join(f"{x} {line}" for x in "abcabcabcabc"), None, None), (3, long, None, None), (4, "top\n" + long + "\nend", None, None), (5, "\n".join(["q" + line] * 20), None, None)]
    got = {r.doc_id: r for r in linedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].n_lines_left == 8
    assert got[2].n_lines_left == 6
    assert got[3].n_lines_removed == 0
    assert got[4].text == "top\nend"
    assert got[5].n_lines_left == 5


# MinHash


def weights(t: str | None) -> Counter:
    w = (t or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(docs: dict[int, str | None]) -> dict[int, int]:
    sets = {i: weights(t) for i, t in docs.items()}
    ids = sorted(docs)
    edges = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and (x & y).total() >= 0.8 * (x | y).total():
                edges.append((a, b))
    return components(edges, ids)


def test_signatures_estimate_weighted_similarity():
    r = random.Random(4)
    base = words(r, 400)
    for change in (0, 5, 20, 60):
        other = list(base)
        for i in r.sample(range(400), change):
            other[i] = "changed"
        docs = [[w.encode() for w in x] for x in (base, other)]
        sig = minhash.signatures(*minhash.cells(docs), 2)
        x, y = weights(" ".join(base)), weights(" ".join(other))
        true = (x & y).total() / (x | y).total()
        assert abs((sig[0] == sig[1]).mean() - true) < 0.12
    heavy = [b"a b c d e".split() * 50, b"a b c d e".split() * 60]
    sig = minhash.signatures(*minhash.cells(heavy), 2)
    assert abs((sig[0] == sig[1]).mean() - 246 / 296) < 0.12


def test_minhash_equals_brute_force(spark):
    r = random.Random(8)
    docs: dict[int, str | None] = {}
    shared = words(r, 40)
    for g in range(30):
        base = words(r, r.choice([3, 6, 30, 120, 400]))
        if g % 3 == 0:
            base += shared
        for c in range(r.choice([1, 1, 2, 3, 12])):
            w = list(base)
            if c:
                for i in r.sample(range(len(w)), max(0, int(len(w) * r.choice([0, 0.005, 0.01])))):
                    w[i] = words(r, 1)[0]
            docs[len(docs) * 3] = " ".join(w)
    docs |= {1001: None, 1002: "", 1003: " \n", 1004: docs[0]}
    rows = [(i, t, "en", "s") for i, t in docs.items()]
    df = spark.createDataFrame(rows, DOCS).withColumns({"content": F.lit(1), "bucket": F.lit(2)})
    got = {x.doc_id: x for x in minhash.near_duplicates(df).collect()}
    want = brute_classes(docs)
    assert {i: x.class_id for i, x in got.items()} == want
    assert all(x.kept == (x.doc_id == x.class_id) for x in got.values())
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_bucket_pairs_connect_groups():
    """In a bucket of any size similar members end up connected, by few pairs."""
    r = np.random.default_rng(1)
    for m in (5, 100, 600):
        base = r.integers(0, 256, (3, minhash.SKETCH)).astype(np.uint8)
        own = r.integers(0, 3, m)
        sk = base[own].copy()
        noise = r.random(sk.shape) < 0.08
        sk[noise] = r.integers(0, 256, noise.sum())
        pairs = minhash.link(np.arange(m), sk)
        assert len(pairs) <= 4 * m
        found = components(pairs, range(m))
        assert {(own[i], found[i]) for i in range(m)} == {(own[i], found[int(np.flatnonzero(own == own[i])[0])]) for i in range(m)}


# HNSW


def test_hnsw_equals_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(300, 16))
    near = base[r.integers(0, 60, 250)] + r.normal(size=(250, 16)) * r.choice([0.02, 0.08, 0.2], (250, 1))
    x = np.concatenate([base, near, np.repeat(base[:1], 40, 0), base[5:6] * 3]).astype(np.float32)
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [None] + [1.0] * 15), (9005, [float("nan")] * 16), (9006, [1.0, 2.0]), (9007, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "label": F.lit(0)})
    got = {a.vec_id: (a.n_links, a.component_id, a.kept) for a in hnsw.similar_vectors(df).collect()}
    d = x.astype(np.float64)
    unit = d / np.linalg.norm(d, axis=1)[:, None]
    links = unit @ unit.T >= 0.95
    comp = components([(int(a), int(b)) for a, b in zip(*np.nonzero(links), strict=True) if a < b], range(len(x)))
    want = {i: (int(links[i].sum()) - 1, comp[i], comp[i] == i) for i in range(len(x))}
    want |= {i: (0, i, True) for i in (9001, 9002, 9003, 9004, 9005)}
    want |= {9006: (1, 9006, True), 9007: (1, 9006, False)}
    assert got == want
    assert hnsw.similar_vectors(df.limit(0)).count() == 0


def test_graph_recall_and_round_trip():
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 24))
    x[700:] = x[r.integers(0, 100, 800)] + r.normal(size=(800, 24)) * 0.05
    g, ids = hnsw.Graph.build(np.arange(1500), x)
    g, ids, copies = hnsw.Graph.from_bytes(g.to_bytes(ids, np.ones(1500, int)))
    true = g.members @ g.members.T >= 0.95
    found = np.zeros(true.shape, bool)
    for i, j in g.links(g.members, g.x, g.norm, 0.95):
        found[i, j] = True
    np.fill_diagonal(true, False)
    assert (found & true).sum() >= 0.999 * true.sum()
    assert len(g.layers) > 1


@pytest.mark.parametrize("kind", ["scaled", "tight", "middling", "all near"])
def test_graph_of_a_crowd(kind):
    """A thousand vectors of one direction, or close to one another, neither hide the others nor one another."""
    r = np.random.default_rng(7)
    x = r.normal(size=(2500, 32))
    if kind == "scaled":
        x[:1000] = x[0] * r.uniform(0.1, 10, (1000, 1))
    elif kind == "all near":
        x = 1 + x * 0.1
    else:
        x[:1000] = x[0] + x[:1000] * (0.01 if kind == "tight" else 0.15)
    x[1000:1010] = x[1990:2000] + 0.02
    g, ids = hnsw.Graph.build(np.arange(2500), x.astype(np.float32).astype(float))
    unit = g.x / g.norm[:, None]
    true = unit @ unit.T >= 0.95
    found = np.zeros(true.shape, bool)
    for k in range(0, 2500, hnsw.BLOCK):
        for i, j in g.links(g.members[k : k + hnsw.BLOCK], g.x[k:], g.norm[k:], 0.95):
            found[i + k, j] = True
    assert not (found & ~true).any()
    np.fill_diagonal(true, False)
    share = ((found & true).sum(1) / np.maximum(true.sum(1), 1))[true.any(1)]
    assert share.mean() > 0.999 and g.recall >= hnsw.RECALL
    if kind == "scaled":
        assert len(g.unit) < 2500 and g.ef < 1000


def test_hnsw_recall_over_shards_and_repeated_ids(spark, tmp_path):
    """Every shard's audit passes, with vectors of the other shards among the probes; rows of one vec_id and several vectors are several."""
    r = np.random.default_rng(9)
    x = r.normal(size=(2400, 16))
    x[1200:] = x[r.integers(0, 400, 1200)] + r.normal(size=(1200, 16)) * 0.05
    x[2000:2300] = x[5] * r.uniform(1, 3, (300, 1))
    x = x.astype(np.float32).astype(float)
    ids = np.where(np.arange(2400) < 2390, np.arange(2400), 7)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    _, groups = hnsw.merged(df)
    for g in hnsw.build_graphs(groups, 4, tmp_path.as_uri()):
        assert g.recall >= hnsw.RECALL
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = unit @ unit.T >= 0.95
    comp = components([(int(a), int(b)) for a, b in zip(*np.nonzero(links), strict=True) if a < b], range(len(x)))
    least: dict[int, int] = {}
    for i, c in comp.items():
        least[c] = min(least.get(c, 1 << 60), int(ids[i]))
    want = Counter((int(ids[i]), int(links[i].sum()) - 1, least[comp[i]]) for i in range(len(x)))
    got = Counter((a.vec_id, a.n_links, a.component_id) for a in hnsw.similar_vectors(df).collect())
    assert sum((want - got).values()) <= 0.001 * len(x)


def test_hnsw_of_very_large_and_small_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e-200, 2e-200]), (3, [1e300, -1e300]), (4, [float("inf"), 1.0]), (5, [5e-324, 5e-324]), (6, [1.0, 0.0])]
    got = {a.vec_id: (a.n_links, a.component_id) for a in hnsw.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (0, 3), 4: (0, 4), 6: (0, 6)}
