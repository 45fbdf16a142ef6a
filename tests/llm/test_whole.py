"""Cases in which a first choice of pairs or a cut would lose a part of the result."""

from __future__ import annotations

import random

import numpy as np

from folioflow.llm import hnsw, langid, minhash

DOCS = "doc_id long, text string, lang string, source string"


def star(seed: int, copies: int, n: int = 288, edits: int = 5) -> list[str]:
    """A text and copies with words changed, each similar to it (0.84) and not to one another (0.70)."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(n)]
    out = [base]
    for c in range(copies):
        w = list(base)
        for k, i in enumerate(r.sample(range(5, n - 5, 5), edits)):
            w[i] = f"new{c}x{k}"
        out.append(w)
    return [" ".join(w) for w in out]


def classes(spark, texts: dict[int, str]) -> dict[int, int]:
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], DOCS)
    return {x.doc_id: x.class_id for x in minhash.near_duplicates(df).collect()}


def test_minhash_star_in_large_buckets(spark):
    texts = star(1, 2000)
    got = classes(spark, {(i + 700) % len(texts): t for i, t in enumerate(texts)})
    assert set(got.values()) == {0}


def test_minhash_links_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 100)
    texts = star(2, 1200)
    got = classes(spark, {(i + 700) % len(texts): t for i, t in enumerate(texts)})
    assert set(got.values()) == {0}


def test_minhash_star_in_small_buckets(spark):
    texts = star(2, 600, 186, 4)
    got = classes(spark, {(i + 70) % len(texts): t for i, t in enumerate(texts)})
    assert set(got.values()) == {0}


def test_audit_sees_small_groups_beside_a_hot_one():
    """Nodes that the graph does not lead to are found though a hot group's links are many, and those of vectors outside count too."""
    r = np.random.default_rng(6)
    hot = r.normal(size=24) + r.normal(size=(1200, 24)) * 0.01
    small = np.repeat(r.normal(size=(6, 24)), 2, 0) + r.normal(size=(12, 24)) * 0.01
    for others in (None, r.permutation(small[:1])):
        mine = small if others is None else small[1:2]
        g, ids = hnsw.Graph.build(np.arange(1200 + len(mine)), np.concatenate([hot, mine]))
        assert len(g.unit) == len(ids)
        lost = np.flatnonzero(ids >= 1200)
        g.layers = [np.where(np.isin(x, lost), -1, x) for x in g.layers]
        g.ef = hnsw.EF_START
        g.audit(**({} if others is None else {"others": others}))
        q = g.unit[lost] if others is None else g.unit[lost][:1]
        true = q @ g.unit.T >= 0.95
        assert len(g.near(q, 0.95)[0]) == true.sum()


def test_long_runs_of_letters_are_scored_whole():
    assert langid.grams("ab" * 40, 2)[-2:] == ["ab", "b$"]
    assert len(langid.grams("ab" * 40, 2)) == 81
    model = langid.Model([("de", "der", 5), ("en", "the", 5)], [("en", "e", 50), ("de", "e", 5), ("de", "u", 50), ("en", "u", 5)])
    assert model.predict("e" * 40 + "u" * 300)[0] == "de"
