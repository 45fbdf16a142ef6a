"""Operators that judge or transform rows: BPE, rules, quality, language, chat, WARC, mixing."""

from __future__ import annotations

import hashlib
import json
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import bpe, chat, langid, mixing, quality, rules, warc

DOCS = "doc_id long, text string, lang string, source string"
CLASH = {"key": "'x'", "size": "1", "n": "2", "g": "3", "score": "cast(null as int)"}


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.expr(v) for k, v in CLASH.items()})


# BPE


@pytest.fixture(scope="module")
def codec():
    path, pattern = bpe.default_vocabulary()
    with open(path, "rb") as f:
        return bpe.Codec(f.read(), pattern)


@pytest.fixture(scope="module")
def encoding(codec):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(t=st.text(max_size=300))
def test_bpe_equals_the_library(codec, encoding, t):
    t = t.encode("utf-8", "ignore").decode()
    raw = codec.encode_texts([t])[0]
    assert ids(raw) == encoding.encode_ordinary(t)
    assert codec.decode(raw) == t.encode()


def test_bpe_long_pieces_and_repeats(codec, encoding):
    r = random.Random(1)
    texts = ["a" * 5000, "!?" * 2000, " " * 900, "é漢🙂" * 300, "", "ab" * 33, "x" * 64, "y" * 65]
    texts += ["".join(r.choice("abc éß漢 \n\t!1") for _ in range(r.randint(0, 500))) for _ in range(200)]
    for got, want in zip(codec.encode_texts(texts * 2), encoding.encode_ordinary_batch(texts * 2), strict=True):
        assert ids(got) == want


def test_bpe_leaves_no_pieces_in_its_workers(spark):
    words = frame(spark, [(i, " ".join(f"w{i}x{k}" for k in range(200)), None, None) for i in range(40)]).repartition(2)
    assert bpe.encode_decode(words).count() == 40

    def held(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            yield pa.record_batch({"n": pa.array([sum(len(x.cache) for x in gc.get_objects() if isinstance(x, bpe.Codec))], pa.int64())})

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}


def test_bpe_operator(spark, encoding):
    texts = [None, "", "Hello world", "x" * 200_000, "<|endoftext|>"]
    df = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)] + [(2, "Hello world", "en", "s"), (None, "a", None, None)])
    out = bpe.encode_decode(df).collect()
    assert len(out) == 7
    for r in out:
        if r.doc_id is not None:
            t = texts[r.doc_id] or ""
            want = encoding.encode_ordinary(t)
            assert r.ids == want
            assert r.n_tokens == len(want)
            assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0)).count() == 0


# Rules


def brute_stats(t: str | None):
    import re

    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", "".join(words))), dup, len(covered), len(lines)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é漢", "#|", "\n", " ", "\t", "\r", "\x0b", "\x85", " ", "🙂"]), max_size=60))
def test_text_stats_equal_brute_force(parts):
    t = "".join(parts)
    assert rules.text_stats(t) == brute_stats(t)


def test_rules_reject_outliers_and_keep_the_rest(spark):
    r = random.Random(6)

    def prose(n):
        return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))

    rows = [(i, prose(r.randint(60, 400)), r.choice(["en", "de"]), r.choice(["a", "b", None])) for i in range(900)]
    rows += [(5000 + i, " ".join(w + "###" for w in prose(150).split()), "en", "a") for i in range(30)]
    rows += [(6000, None, "en", "a"), (6001, "", None, None), (6002, "x y " * 100, "en", "a"), (6003, prose(49), "en", "a"), (6004, prose(200), "xx", "rare"), (6005, prose(60_000), "en", "a")]
    rows += [rows[0]]
    df = frame(spark, rows)
    out = rules.judge(df).collect()
    assert len(out) == len(rows)
    got = {x.doc_id: x for x in out}
    assert all(got[i].kept for i in range(900))
    assert not any(got[5000 + i].kept for i in range(30))
    assert [got[i].base_failed for i in (6000, 6001, 6002, 6003)] == [True] * 4
    assert not any(got[i].kept for i in (6000, 6001, 6002, 6003))
    assert got[6004].kept
    kept = rules.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted([x.doc_id for x in out if x.kept])
    assert rules.judge(df.limit(0)).count() == 0


def brute_mcd(x: np.ndarray, prior) -> tuple[float, np.ndarray]:
    """Smallest log-determinant over many starts, concentrated over all rows, and the squared distances under that estimate."""
    r = np.random.default_rng(77)
    n, d = x.shape

    def estimate(rows):
        k = len(rows)
        mean = (k * rows.mean(0) + rules.PRIOR * np.array(prior[0])) / (k + rules.PRIOR)
        cov = (k * np.cov(rows.T, bias=True) + rules.PRIOR * np.diag(prior[1])) / (k + rules.PRIOR)
        cov[np.diag_indices(d)] = np.maximum(np.diag(cov), np.square(rules.FLOOR))
        return mean, cov

    def distances(mean, cov):
        return np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)

    best = (np.inf, None)
    for _ in range(300):
        mean, cov = estimate(x[r.permutation(n)[: d + 1]])
        for _ in range(30):
            mean, cov = estimate(x[np.argsort(distances(mean, cov))[: int(np.ceil(rules.H_SHARE * n))]])
        det = np.linalg.slogdet(cov)[1]
        if det < best[0]:
            best = det, distances(mean, cov)
    return best


def test_rules_find_the_minimum_covariance_determinant(spark):
    """Groups with a fifth to a quarter of outliers, in one clump: the determinant and the verdicts are those of a search over many starts."""
    r = np.random.default_rng(3)
    rows, want = [], {}
    for g, (n, bad) in enumerate([(160, 30), (90, 20), (40, 9), (3, 0)]):
        mix = np.eye(5) + 0.4 * r.normal(size=(5, 5))
        x = r.normal(size=(n, 5)) @ mix + r.normal(size=5) * 3
        x[:bad] = x.mean(0) + 25 + r.normal(size=(bad, 5)) * 0.3
        rows += [(str(g), g * 1000 + i, *map(float, v)) for i, v in enumerate(x)]
    names = ", ".join(f"x{i + 1} double" for i in range(5))
    fit = spark.createDataFrame(rows, f"g string, pick long, {names}")
    x = np.array([v[2:] for v in rows])
    q = np.quantile(x, [0.25, 0.5, 0.75], 0, method="inverted_cdf")
    prior = (list(q[1]), [max(f, (c - a) / 1.349) ** 2 for f, a, c in zip(rules.FLOOR, q[0], q[2], strict=True)])
    for m in rules.estimates(fit.withColumn("pick", F.xxhash64("pick"))).collect():
        own = np.array([v[2:] for v in rows if v[0] == m.g])
        det, d2 = brute_mcd(own, prior)
        assert m.log_det <= det + 0.05
        got = rules._apart(own, m.mean, m.w)
        assert m.stretch >= 1
        want[m.g] = ((d2 > rules.CUT) == (got > rules.CUT)).mean()
    assert want == {"0": 1.0, "1": 1.0, "2": 1.0, "3": 1.0}


def test_rules_of_many_models_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(rules, "BROADCAST_ROWS", 10)
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80)) + (" ##### #####" * 20 if i % 50 == 0 else ""), "en", f"s{i % 4 if i % 3 else 0}") for i in range(400)]
    got = {x.doc_id: x.kept for x in rules.judge(frame(spark, rows)).collect()}
    assert got == {i: i % 50 != 0 for i in range(400)}


# Quality


def test_quality_is_the_quadratic_discriminant():
    """Scores equal densities written out with inverses and determinants."""
    r = np.random.default_rng(4)
    rows = [r.normal(size=(n, quality.D)) @ r.normal(size=(quality.D, quality.D)) + r.normal(size=quality.D) for n in (60, 200)]
    sums = {k: (lambda m: m.T @ m)(np.column_stack([np.ones(len(x)), x])) for k, x in enumerate(rows)}
    got = quality.model_from_sums(sums).score(np.concatenate(rows))
    pooled = sum(np.cov(x.T, bias=True) * len(x) for x in rows) / 260
    scale = np.sqrt(np.diag(pooled))
    logs = []
    for x in rows:
        c = (0.85 * np.cov(x.T, bias=True) + 0.15 * pooled) / np.outer(scale, scale)
        c = 0.98 * c + 0.02 * np.trace(c) / quality.D * np.eye(quality.D)
        z = (np.concatenate(rows) - x.mean(0)) / scale
        logs.append(-0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(c), z) - 0.5 * np.linalg.slogdet(c)[1])
    odds = (logs[1] - logs[0]) / quality.TEMPERATURE + np.log(200 / 60)
    assert np.allclose(got, 1 / (1 + np.exp(-odds)), atol=1e-6)


def test_quality_of_very_long_text():
    t = "Some words, and 12 more! " * 60_000
    assert np.isfinite(quality.features(t)).all()


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_quality(docs, labels).join(labels, "doc_id").filter("held_out")
    right = got.select(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert right[1] > 500
    assert right[0] > 0.97


def test_quality_edges(spark):
    df = frame(spark, [(1, None, None, None), (2, "", None, None), (3, "a b c", None, None), (3, "a b c", None, None), (None, "x", None, None)])
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    out = quality.score_quality(df, none).collect()
    assert len(out) == 5
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
    one = spark.createDataFrame([(2, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    assert quality.score_quality(df, one).count() == 5
    assert quality.score_quality(df.limit(0), one).count() == 0


# Language


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.97


def test_language_backoff_and_edges(spark):
    model = langid.Model([("en", "the", 50), ("de", "der", 50), ("en", "house", 5)], [("en", "^th", 9), ("de", "sch", 9), ("de", "e", 30), ("en", "e", 3), ("en", "^t", 9)])
    assert model.predict("the THE")[0] == "en"
    assert model.predict("schule")[0] == "de"
    assert model.predict("thq")[0] == "en"
    assert model.predict("eqq")[0] == "de"
    for t in (None, "", "123 ²  !!"):
        assert model.predict(t) == ("und", 0.0)
    df = frame(spark, [(1, "hello there", None, None), (2, None, "en", None)])
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def brute_language(train: list[tuple[str, str]], text: str) -> tuple[str, float]:
    """The scorer written out from counts."""
    import math
    import re

    split = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    marked = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    langs = sorted({x for x, _ in train})
    words, gram = Counter(), {n: Counter() for n in range(1, 6)}
    for lang, t in train:
        for w in split(t):
            words[lang, w] += 1
            for n in range(1, 6):
                for g in marked(w, n):
                    gram[n][lang, g] += 1
    words = Counter({k: v for k, v in words.items() if v >= langid.LEAST_WORD})
    gram = {n: Counter({k: v for k, v in c.items() if v >= langid.LEAST_GRAM}) for n, c in gram.items()}

    def log(table, lang, item):
        items = {x for _, x in table}
        return math.log((table[lang, item] + 0.1) / (sum(v for (x, _), v in table.items() if x == lang) + 0.1 * len(items)))

    total = dict.fromkeys(langs, 0.0)
    for w in split(text):
        if any((x, w) in words for x in langs):
            for x in langs:
                total[x] += log(words, x, w)
            continue
        for n in range(5, 0, -1):
            own = [g for g in marked(w, n) if any((x, g) in gram[n] for x in langs)]
            if own:
                for x in langs:
                    total[x] += sum(log(gram[n], x, g) for g in own) / len(own)
                break
    best = max(langs, key=lambda x: total[x])
    return best, 1 / sum(math.exp(min(700, total[x] - total[best])) for x in langs)


def test_language_equals_brute_force(spark):
    r = random.Random(5)
    syllables = {"aa": ["ka", "lo", "mi", "tu", "e"], "bb": ["sch", "ei", "en", "rt", "lo"], "cc": ["qu", "ou", "é", "tu", "ka"]}
    text = lambda x, n: " ".join("".join(r.choice(syllables[x]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, text(x := r.choice("abc") * 2, r.randint(1, 12)), x, "s") for i in range(120)]
    rows += [(500 + i, text(r.choice("abc") * 2, 4) + " " + "kalo" * r.choice([1, 30]), None, None) for i in range(30)]
    rows += [rows[3], (700, "tu " * 30_000 + "x" * 5000, None, None)]
    train = [(x[2], x[1]) for x in rows if x[2] and zlib.crc32(str(x[0]).encode()) % 5]
    got = langid.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {x[0]: x[1] for x in rows}
    for x in got:
        if x.doc_id != 700:
            lang, score = brute_language(train, texts[x.doc_id])
            assert x.lang_pred == lang
            assert abs(x.score - score) < 1e-4
        assert 0 <= x.score <= 1


def test_marks_stay_in_words():
    assert langid.words_of("plain Ünd e1") == ["plain", "ünd", "e"]
    assert langid.words_of("हिन्दी में e\u0301te x1y \u0301") == ["हिन्दी", "में", "e\u0301te", "x", "y"]


# Chat


def brute_chat(turns):
    out, before = [], None
    for role, t in turns:
        t = t.replace("<|", "<||")
        if role == before:
            out.append("<|im_sep|>" + t)
        else:
            out.append(("<|im_end|>\n" if before is not None else "") + "<|im_start|>" + role.replace("<|", "<||").replace("\n", "<|nl|>") + "\n" + t)
        before = role
    return "".join(out) + "<|im_end|>\n"


def test_chat_reads_back(spark):
    r = random.Random(3)
    bits = ["<|", "|>", "<||", "im_end", "<|im_sep|>", "<|im_start|>assistant\n", "\n", "é🙂", "", "x", "<", "|", "\\"]
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant", "assistant", "system", "odd<|nl|>\nrole", None])
            text = r.choice([None, "".join(r.choice(bits) for _ in range(r.randint(0, 6)))])
            rows.append((c if c else None, t if r.random() < 0.9 else None, role, text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segments": F.lit(1), "chunk": F.lit(2)}).repartition(3)
    got = chat.format_chat(df)
    seen = {x.conv_id: x for x in got.collect()}
    for c, x in seen.items():
        own = sorted((((-1 if t is None else t), role or "", text or "") for conv, t, role, text in rows if conv == c))
        turns = [(role, text) for _, role, text in own]
        assert x.formatted == brute_chat(turns)
        raw = x.formatted.encode()
        assert [raw[s.start : s.start + s.length].decode() for s in x.loss] == [b.replace("<|", "<||") for a, b in turns if a == "assistant"]
    for x in chat.digest(got).collect():
        own = sorted((((-1 if t is None else t), role or "", text or "") for conv, t, role, text in rows if conv == x.conv_id))
        assert x.n_turns == len(own)
        assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        loss = "".join(b for _, a, b in own if a == "assistant")
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.format_chat(df.limit(0))).count() == 0


def test_chat_of_very_many_turns(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"é{i}<|x") for i in range(2000)] + [(2, 0, "assistant", "ab " * 400_000)]
    got = {x.conv_id: x for x in chat.digest(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    loss = "".join(t for c, _, r, t in rows if c == 1 and r == "assistant")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (2000, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].loss_chars == 1_200_000


def test_chat_is_native(spark):
    df = chat.digest(chat.format_chat(spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


# WARC


def test_warc_reads_back(spark, tmp_path):
    long = "<p>" + "ü" * 200
    rows = [(1, "http://a.example.net/x?q=1", long), (2, "http://b.example.net/", long), (3, None, None), (4, "http://a.example.net/x?q=1", "short"), (5, "not a url\n\tx", "short"), (2, "http://b.example.net/", long), (0, "http://z.org", ""), (-7, "http://a.example.net", "y" * 150), (8, "http://[bad", "y" * 150), (None, "http://n.org", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "file": F.lit("f")}).repartition(3)
    got = Counter(tuple(r) for r in warc.archive(df, "file://" + str(tmp_path)).collect())
    want = Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        first = min(same) if len(raw) >= 100 else page
        again = len(raw) >= 100 and page != first
        want[page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_index_finds_every_key(spark, tmp_path):
    n = 5000
    rows = spark.range(n).select(F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".com/"), F.col("id")).alias("url"), F.col("id").alias("page_id"), F.lit("f").alias("file"), F.col("id").alias("offset"), F.lit(1).cast("long").alias("length"))
    keys = F.udf(warc.url_key)
    folder = "file://" + str(tmp_path)
    shards = warc.build_index(rows.select(keys("url").alias("url_key"), "page_id", "file", "offset", "length").repartition(5), folder)
    index = warc.Index(folder, shards)
    for i in random.Random(1).sample(range(n), 300):
        assert index.captures(warc._sort_key(warc.url_key(f"http://h{i % 7}.com/{i}"), i)) == [("f", i, 1)]
    assert index.captures(b"zzz") == []
    assert index.captures(b"") == []
    assert warc.url_key("http://A.example.NET:81/p?q") == "net,example,a:81)/p?q"


# Mixing


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 400))
def test_fit_is_the_best_subset_sum(sizes, budget):
    lengths, counts = list(sizes), list(sizes.values())
    reach = {0}
    for a, n in sizes.items():
        reach = {x + a * k for x in reach for k in range(n + 1)}
    take = mixing.fit(lengths, counts, budget)
    assert all(0 <= t <= n for t, n in zip(take, counts, strict=True))
    assert sum(a * t for a, t in zip(lengths, take, strict=True)) == max(x for x in reach if x <= budget)


def test_fit_of_many_lengths():
    r = random.Random(1)
    sizes = {r.randrange(1, 30_000): r.randrange(1, 50) for _ in range(3000)} | {2_000_000: 1}
    total = sum(a * n for a, n in sizes.items())
    for budget in (total // 3, total - 12_345, 12_345_678):
        take = mixing.fit(list(sizes), list(sizes.values()), budget)
        assert sum(a * t for a, t in zip(sizes, take, strict=True)) == budget
        assert all(0 <= t <= n for t, n in zip(take, sizes.values(), strict=True))


def test_mixing_takes_some_of_repeated_rows(spark):
    """Of many repeats of a row as many are taken as the target needs."""
    rows = [(7, "one two three", "en", "a")] * 900 + [(8, "four five six", "en", "a")] * 40 + [(i, "x y z", "en", "b") for i in range(100, 400)]
    df = frame(spark, rows).repartition(5)
    by: dict = {}
    for x in mixing.allot(df).collect():
        t = by.setdefault("a" if x.doc_id < 100 else "b", [0, x.target])
        t[0] += x.taken
    assert all(abs(t[0] - t[1]) <= 3 for t in by.values()) and len(by) == 2
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() * 3 == sum(t[0] for t in by.values())


def test_shares():
    assert mixing.shares([100, 100], [5, 2], 300) == [200.0, 100.0]
    assert mixing.shares([10, 1000, 0], [5, 2, 1], 1515) == [20.0, 1495.0, 0.0]
    assert mixing.shares([], [], 0) == []


def test_mixing_reaches_targets(spark):
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), "en", r.choice(["b", "a", "é", None, "a"])) for i in range(3000)]
    rows += [(10_000 + i, "same text here", "en", "a") for i in range(2500)]
    rows += [(99_999, None, None, None)]
    df = frame(spark, rows)
    out = mixing.allot(df).collect()
    assert len(out) == len(rows)
    by = {}
    source, texts = {x[0]: x[3] for x in rows}, {x[0]: x[1] or "" for x in rows}
    for x in out:
        assert x.size == len(texts[x.doc_id].split())
        assert x.taken in (0, x.size, 2 * x.size)
        t = by.setdefault(source[x.doc_id], [0, x.target, x.source_size, 0])
        t[0] += x.taken
        t[3] += x.size
    for taken, target, source_size, size in by.values():
        assert size == source_size
        assert abs(taken - target) <= 2
    assert abs(sum(t[1] for t in by.values()) - 1.5 * sum(t[2] for t in by.values())) < 1e-6
    again = mixing.allot(df.repartition(7)).collect()
    assert {(x.doc_id, x.taken) for x in again} == {(x.doc_id, x.taken) for x in out}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    copies = Counter(x.doc_id for x in mixed.collect())
    assert all(copies[x.doc_id] * x.size == x.taken for x in out)
    assert mixing.allot(df.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline as p

    r = random.Random(12)

    def prose(n):
        return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))

    passage = prose(80)
    rows = [(i, prose(150) + "\n" + prose(100), "en", r.choice("ab")) for i in range(300)]
    rows += [(1000 + i, prose(120) + "\n" + passage, "en", "a") for i in range(10)]
    rows += [(2000 + i, rows[i][1], "en", "b") for i in range(5)]
    rows += [(3000 + i, rows[i][1].replace("\n", " ") + " more", "en", "b") for i in range(5)]
    rows += [(4000, "junk", "en", "a"), (4001, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.length("text").cast("long"))
    seen = {}
    for name, stage in p.STAGES:
        docs = p.staged(stage(spark, docs, ""), "test")
        seen[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {x.doc_id for x in seen["quality_rules"]} == {x[0] for x in rows if x[0] < 4000}
    cut = {x.doc_id: x for x in seen["line_dedup"]}
    assert sum(passage in x.text for x in cut.values()) == 1
    assert not any(2000 <= i < 3000 for i in cut)
    assert all(x.n_chars == len(x.text) for x in cut.values())
    left = {x.doc_id for x in seen["near_dedup"]}
    assert left == {x[0] for x in rows if x[0] < 2000}
    assert sum(len(x.text.split()) for x in seen["mix_sources"]) == pytest.approx(1.5 * sum(len(cut[i].text.split()) for i in left), rel=0.01)
    assert Counter(x.doc_id for x in seen["byte_bpe"]) == Counter(x.doc_id for x in seen["mix_sources"])
    assert json.dumps(seen["byte_bpe"][0].ids)


def test_pipeline_stages_on_nothing_and_on_repeats(spark):
    import corpus_pipeline as p

    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(120))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (1, text + " other", None, None), (2, None, "en", "a"), (2, "", None, "b"), (None, text.upper(), "en", None)]
    full = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    none, docs = full.limit(0), full
    for name, stage in p.STAGES:
        none, docs = p.staged(stage(spark, none, ""), "test"), p.staged(stage(spark, docs, ""), "test")
        assert none.count() == 0
        if name != "byte_bpe":
            assert none.columns == docs.columns == full.columns
    assert {x.doc_id for x in docs.collect()} == {1, None}


def test_maps_hand_on_small_parts(spark):
    """What Python makes of a batch, and the JVM's copy of it, is as small as the part; the rows and their order stay."""
    from folioflow.llm import common

    rows = [(i, "x" * (3000 if i % 7 else 0)) for i in range(6000)]

    def work(b):
        assert b.num_rows and b.nbytes <= 2 * common.PART_BYTES
        return pa.record_batch({"doc_id": b.column(0), "n": pa.array([b.num_rows] * b.num_rows, pa.int64())})

    out = common.map_columns(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), work, "doc_id long, n long").collect()
    assert [x.doc_id for x in out] == [x[0] for x in rows]
    assert max(x.n for x in out) < 2000
    wide = pa.record_batch({"t": ["x" * (3 * common.PART_BYTES)] * 3})
    assert [b.num_rows for b in common.parts(wide)] == [1, 1, 1]
    assert list(common.parts(wide.slice(0, 0))) == []
