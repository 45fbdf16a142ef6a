"""Near-duplicate documents by DartMinHash over weighted word shingles.

An element is a five-word shingle, its weight the number of times it occurs. Darts are thrown by
hash into an element's region (its weight times the rank axis), at a rate of one for each unit of
weight, rank and coordinate: from a unit cell of weight, ranks advance by hashed exponential steps, and
every dart has a hashed coordinate. Only darts below a rank limit of about (ln K + 2) / weight are
thrown, so a document costs K (ln K + 2) darts however long it is; a coordinate keeps the earliest. Should
one stay empty, the limit is doubled for that document. Two documents share a coordinate with the
probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, connected_components, content_key, give_back, join_hot, staged

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 7
K = BANDS * ROWS
SKETCH = 128
#: Estimated similarities (standard error 0.035) from which a pair is verified, and from which one member speaks for another.
LOW, HIGH = 0.68, 0.84
SMALL = 256
CHUNK = 20_000
#: Members on either side of a block, about, of a bucket that is compared in full.
BLOCK = 4096
#: Pairs that a member hands over from a bucket that is compared in full; where it has more, the bucket's members are verified in blocks of about so many cells.
FIRST = 8
BLOCK_CELLS = 1 << 20
BATCH_WORDS = 200_000
CACHED_WORDS = 400_000

_U = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    if len(_words) > CACHED_WORDS:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, words), _U, len(words))


def cells(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(document, cell): a hash for every unit of weight of every shingle, sorted by document. A text of fewer words than a shingle is one shingle."""
    lengths = np.array([len(d) for d in docs])
    h = _word_hashes([w for d in docs for w in d])
    owner = np.repeat(np.arange(len(docs)), lengths)
    parts, owners = [], []
    n = len(h) - SHINGLE + 1
    if n > 0:
        s = sum(h[j : j + n] * _MULT[j] for j in range(SHINGLE))
        inside = owner[:n] == owner[SHINGLE - 1 :]
        parts.append(s[inside])
        owners.append(owner[:n][inside])
    start = np.cumsum(lengths) - lengths
    for i in np.flatnonzero((lengths > 0) & (lengths < SHINGLE)):
        own = h[start[i] : start[i] + lengths[i]]
        parts.append(np.array([(own * _MULT[: len(own)]).sum() + _U(len(own))], _U))
        owners.append(np.array([i]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    s, o = _mix(np.concatenate(parts)), np.concatenate(owners)
    order = np.lexsort((s, o))
    s, o = s[order], o[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return o, _mix(s + nth.astype(_U) * _U(0x9E3779B97F4A7C15))


def signatures(owner: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """n x K earliest darts; rows of documents without cells are zero."""
    out = np.zeros((n, K), _U)
    weight = np.bincount(owner, minlength=n)
    with np.errstate(divide="ignore"):
        limit = (np.log(K) + 2) / weight
    todo = np.flatnonzero(weight)
    while len(todo):
        mine = np.isin(owner, todo) if len(todo) < n else slice(None)
        o, c = owner[mine], cell[mine]
        rank, most, step = np.zeros(len(c)), limit[o], 0
        keys, ranks, darts = [], [], []
        while len(c):
            step += 1
            x = _mix(c + _U(step * 0xD1342543DE82EF95 % 2**64))
            rank = rank - np.log(((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / K
            on = rank <= most
            o, c, rank, most, x = o[on], c[on], rank[on], most[on], x[on]
            dart = _mix(x ^ _U(0x5851F42D4C957F2D))
            keys.append(o * K + (dart % _U(K)).astype(np.int64))
            ranks.append(rank)
            darts.append(dart)
        key, dart = np.concatenate(keys), np.concatenate(darts)
        order = np.argsort(-np.concatenate(ranks), kind="stable")
        hit = np.zeros(n * K, bool)
        hit[key] = True
        flat = np.zeros(n * K, _U)
        flat[key[order]] = dart[order]  # of several the last, earliest, stays
        out[todo] = flat.reshape(n, K)[todo]
        todo = todo[~hit.reshape(n, K)[todo].all(1)]
        limit[todo] *= 2
    return out


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Word lists of a batch's last column, some documents at a time."""
    start, own, size = 0, [], 0
    for i, t in enumerate(b.column(b.num_columns - 1)):
        own.append((t.as_py() or "").encode().split())
        size += len(own[-1])
        if size > BATCH_WORDS:
            yield start, own
            start, own, size = i + 1, [], 0
    if own:
        yield start, own


def _content(words: list[bytes]) -> bytes:
    return md5(b" ".join(words), usedforsecurity=False).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, docs in _chunks(b):
            n = len(docs)
            sig = signatures(*cells(docs), n)
            bands = np.zeros((n, BANDS), _U)
            for r in range(ROWS):
                bands = _mix(bands * _U(3) + sig[:, r::ROWS])
            bands = _mix(bands + np.arange(BANDS, dtype=_U)).view(np.int64)
            some = np.array([bool(d) for d in docs])
            lists = pa.FixedSizeListArray.from_arrays(bands.ravel(), BANDS).cast(pa.list_(pa.int64()))
            sketch = sig[:, :SKETCH].astype(np.uint8)
            cols = [c.slice(start, n) for c in b.columns[:2]]
            cols += [pa.array([_content(d) for d in docs], pa.binary()), lists, pa.array([x.tobytes() for x in sketch], pa.binary())]
            yield pa.record_batch(cols, ["doc_id", "key", "content", "bands", "sketch"]).filter(pa.array(some))
    _words.clear()  # a worker process lives on for other stages
    give_back()


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, docs in _chunks(b):
            owner, cell = cells(docs)
            at = np.searchsorted(owner, np.arange(len(docs) + 1))
            own = [np.unique(cell[at[i] : at[i + 1]].astype(np.uint32)).tobytes() for i in range(len(docs))]
            same = pa.array([_content(d) == c for d, c in zip(docs, b.column(1).slice(start, len(docs)).to_pylist(), strict=True)])
            yield pa.record_batch([b.column(0).slice(start, len(docs)), pa.array(own, pa.binary())], ["id", "cells"]).filter(same)
    _words.clear()
    give_back()


def link(ids: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a bucket's members to verify first, fewer than three a member: enough to connect what is similar if all are verified.

    Up to SMALL members: a spanning forest of the highest estimates from LOW on, and each member's three best.
    In larger buckets a member speaks for those at HIGH or more to it; each speaker is also paired with the
    likeliest member of another group.
    """
    m = len(ids)
    if m <= SMALL:
        same = np.stack([(sketches == s).sum(1) for s in sketches]) / SKETCH
        np.fill_diagonal(same, 0)
        i, j = np.nonzero(np.triu(same >= LOW))
        order = np.argsort(-same[i, j], kind="stable")
        best = np.argsort(-same, axis=1, kind="stable")[:, :3]
        group, out = list(range(m)), set()

        def root(x: int) -> int:
            while group[x] != x:
                group[x] = group[group[x]]
                x = group[x]
            return x

        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                group[ra] = rb
                out.add((a, b))
        for a in range(m):
            out.update((min(a, b), max(a, b)) for b in best[a].tolist() if same[a, b] >= LOW and same[a, b] < 0.95)
        return [(int(ids[a]), int(ids[b])) for a, b in out]
    out, label = [], np.arange(m)
    free = np.ones(m, bool)
    for a in range(m):
        if not free[a]:
            continue
        same = (sketches == sketches[a]).sum(1) / SKETCH
        own = free & (same >= HIGH)
        own[a] = False
        free[a] = False
        free &= ~own
        label[own] = label[a]
        out += [(int(ids[a]), int(x)) for x in ids[own]]
        same[label == label[a]] = 0
        b = int(same.argmax())
        if same[b] >= LOW:
            out.append((int(ids[a]), int(ids[b])))
            label[label == label[b]] = label[a]
    return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs from rows (bucket, salt, id, sketch) that come sorted by bucket and salt."""
    left: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def pairs(keys: np.ndarray, ids: np.ndarray, sk: np.ndarray) -> pa.RecordBatch:
        ends = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True]) + 1
        starts = np.r_[0, ends[:-1]]
        two = starts[ends - starts == 2]
        near = two[(sk[two] == sk[two + 1]).sum(1) >= LOW * SKETCH]
        out = list(zip(ids[near].tolist(), ids[near + 1].tolist(), strict=True))
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            for k in range(s, e if e - s > 2 else s, CHUNK):
                out += link(ids[k : min(e, k + CHUNK)], sk[k : min(e, k + CHUNK)])
        out = list({(min(p), max(p)) for p in out if p[0] != p[1]})
        return pa.record_batch({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    for b in batches:
        if not b.num_rows:
            continue
        keys = _mix(np.asarray(b.column(0)).view(_U) + np.asarray(b.column(1)).astype(_U))
        sk = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH)
        now = (keys, np.asarray(b.column(2)), sk)
        now = now if left is None else tuple(np.concatenate(x) for x in zip(left, now, strict=True))
        last = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if (now[0] != now[0][-1]).any() else 0
        if last:
            yield pairs(*(x[:last] for x in now))
        left = tuple(x[last:] for x in now)
    if left is not None and len(left[0]):
        yield pairs(*left)


def unlike(ask: tuple[np.ndarray, ...], answer: tuple[np.ndarray, ...], most: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of different classes at LOW or more between (ids, classes, sketches) and others, `most` of the likeliest for each of the first; and whether any had more."""
    out, more = [], False
    for i, c, s in zip(*ask, strict=True):
        same = (answer[2] == s).sum(1)
        hit = np.flatnonzero((same >= LOW * SKETCH) & (answer[1] != c))
        if len(hit) > most:
            more = True
            hit = hit[np.argsort(-same[hit], kind="stable")[:most]]
        out += [(min(int(i), x), max(int(i), x)) for x in answer[0][hit].tolist()]
    return out, more


def _blocks(most: int):  # noqa: ANN202
    """From rows (bucket, i, j, asks, id, class, sketch) that come sorted by the first three: pairs (a, b), and a row with the bucket alone where a member had more than `most`."""

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        asks = np.asarray(t.column(3))
        sk = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint8).reshape(-1, SKETCH)
        cols = (np.asarray(t.column(4)), np.asarray(t.column(5)), sk)
        found, more = unlike(tuple(x[asks] for x in cols), tuple(x[~asks] for x in cols), most)
        found = list(set(found))
        a, b, at = [x for x, _ in found], [x for _, x in found], [None] * len(found)
        if more:
            a, b, at = [*a, None], [*b, None], [*at, t.column(0)[0].as_py()]
        return pa.record_batch([pa.array(x, pa.int64()) for x in (a, b, at)], ["a", "b", "bucket"])

    return lambda batches: _by_block(batches, block)


def _named(members: DataFrame, component: DataFrame) -> DataFrame:
    """bucket, id, c: the members' classes so far."""
    return staged(members.join(component, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c")), "dart-named")


def _laid(rows: DataFrame, sort: str) -> DataFrame:
    """`rows` (bucket, id, c, main, asking, asked, ...) in blocks: all outside a bucket's main class ask all of the bucket."""
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    ask = rows.filter("c <> main").select("bucket", part("asking").alias("i"), each("asked").alias("j"), F.lit(True).alias("asks"), "id", "c", sort)
    answer = rows.select("bucket", each("asking").alias("i"), part("asked").alias("j"), F.lit(False).alias("asks"), "id", "c", sort)
    return ask.unionByName(answer).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", F.xxhash64("id"))


def _open(named: DataFrame, weight: Column, block: int) -> DataFrame:
    """bucket, n, main, asking, asked: buckets whose members are of several classes, their largest class, and the blocks that the others and all make."""
    own = named.groupBy("bucket", "c").agg(F.count("*").alias("k"), F.sum(weight).alias("w"))
    own = own.groupBy("bucket").agg(F.max(F.struct("k", "c", "w")).alias("main"), F.sum("k").alias("n"), F.sum("w").alias("w")).filter("main.k < n")
    blocks = [F.greatest(F.ceil(x / block), F.lit(1)).cast("long") for x in (F.col("w") - F.col("main.w"), F.col("w"))]
    return staged(own.select("bucket", "n", F.col("main.c").alias("main"), blocks[0].alias("asking"), blocks[1].alias("asked")), "dart-open")


def _open_pairs(members: DataFrame, texts: DataFrame, component: DataFrame, total: int, most: int) -> DataFrame:
    """a, b, bucket, as of _blocks, from buckets whose members (bucket, id, n) are of several classes so far."""
    named = _named(members, component)
    rows = join_hot(named, _open(named, F.lit(1), BLOCK), ["bucket"], "n", max(total, 1) * BANDS).join(texts.select("id", "sketch"), "id")
    return staged(_laid(staged(rows, "dart-asking"), "sketch").mapInArrow(_blocks(most), "a long, b long, bucket long"), "dart-found")


def _proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (bucket, i, j, asks, id, class, cells) that come sorted by the first three: links (a, b) of each asking member, one to every other class that it has a verified link to."""

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        asks = np.asarray(t.column(3))
        ids, classes = np.asarray(t.column(4)), np.asarray(t.column(5))
        cells = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column(6)]
        size = np.array([len(x) for x in cells])
        to = np.flatnonzero(~asks)
        flat = np.concatenate([cells[k] for k in to]) if len(to) else np.zeros(0, np.uint32)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(to)), size[to])[order]
        out = []
        for k in np.flatnonzero(asks) if len(to) else ():
            start = np.searchsorted(flat, cells[k], "left")
            n = np.searchsorted(flat, cells[k], "right") - start
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(to))
            ok = (both >= SIMILAR * (size[k] + size[to] - both) - 1e-9) & (classes[to] != classes[k])
            hit = to[ok]
            _, one = np.unique(classes[hit], return_index=True)
            out += [(int(ids[k]), int(x)) for x in ids[hit[one]]]
        return pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    yield from _by_block(batches, block)


def _by_block(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """`block` of the rows of each (bucket, i, j), which come sorted by them."""
    rows, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([np.asarray(b.column(i)) for i in range(3)], 1)
        starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)].tolist()
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if rows and tuple(keys[s]) != key:
                yield block(rows)
                rows = []
            key = tuple(keys[s])
            rows.append(b.slice(s, e - s))
    if rows:
        yield block(rows)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose weighted Jaccard similarity is at least SIMILAR."""
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
            ok = min(len(x), len(y)) >= SIMILAR * max(len(x), len(y))
            if ok:
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok = both >= SIMILAR * (len(x) + len(y) - both) - 1e-9
            keep.append(ok)
        yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))


def _cell_sets(src: DataFrame, texts: DataFrame, wanted: DataFrame, known: DataFrame | None) -> DataFrame:
    """id, cells: `known` and those of the other texts of `wanted` (id). A text is read again from the first document that has it."""
    ids = wanted.select("id").distinct()
    if known is not None:
        ids = ids.join(known.select("id"), "id", "left_anti")
    ids = staged(ids.join(texts.select("id", "content", "doc"), "id"), "dart-ids")
    n = ids.count()
    if known is not None and not n:
        return known
    if n <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    again = src.join(ids, src["doc_id"] == ids["doc"]).select("id", "content", "text")
    sets = staged(again.mapInArrow(_cells_of, "id long, cells binary").dropDuplicates(["id"]), "dart-cells")
    return sets if known is None else known.unionByName(sets)


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("cells").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("cells").alias("y")), "b")
    return staged(both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), "dart-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept, key for every row: class_id is the smallest doc_id that verified links reach; kept where it is the row's own.

    Texts with equal words are one element of the search, whatever their number. Buckets give pairs
    through representatives first; between classes that stay apart all that may be similar are verified.
    Null and empty texts are classes of their own. Rows that share a doc_id and not the text are
    texts of their own, each in its class. A null doc_id counts as the smallest. Extra columns
    are ignored; an empty table gives no rows.
    """
    no_id = F.lit(-(2**63))
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("doc_id"), content_key(docs).alias("key"), "text")
    signed = staged(src.mapInArrow(_sign, "doc_id long, key long, content binary, bands array<long>, sketch binary"), "dart-signatures")
    total = signed.count()
    texts = signed.groupBy("content").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    texts = staged(texts.withColumn("id", F.xxhash64("content")), "dart-texts")
    rows = texts.select("id", F.explode("bands").alias("bucket"))
    full = staged(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "dart-buckets")
    members = staged(join_hot(rows, full, ["bucket"], "n", max(total, 1) * BANDS), "dart-members")
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK)).cast("long")
    laid = members.join(texts.select("id", "sketch"), "id").select("bucket", salt.alias("salt"), "id", "sketch")
    laid = laid.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.xxhash64("id"))
    found = laid.mapInArrow(_candidates, "a long, b long")
    # Chunks of a bucket meet through its smallest member.
    heads = members.filter(F.col("n") > CHUNK).groupBy("bucket").agg(F.min("id").alias("a"), F.max("n").alias("n"))
    meet = join_hot(members.filter(F.col("n") > CHUNK).select("bucket", "id"), heads, ["bucket"], "n", max(total, 1) * BANDS)
    pairs = staged(found.unionByName(meet.filter("a <> id").select("a", F.col("id").alias("b"))).distinct(), "dart-pairs")
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("id"))
    sets = _cell_sets(src, texts, ends(pairs), None)
    component = connected_components(_links(pairs, sets))

    def joined(links: DataFrame, component: DataFrame) -> DataFrame:
        if links.isEmpty():
            return component
        return connected_components(links.unionByName(component.select(F.col("id").alias("a"), F.col("component").alias("b"))))

    # What these pairs left apart is compared in full: in buckets where members have few possible partners pair by pair,
    found = _open_pairs(members.filter("n > 2"), texts, component, total, FIRST)
    again = staged(found.filter("b is not null").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "dart-pairs")
    if not again.isEmpty():
        sets = _cell_sets(src, texts, ends(again), sets)
        component = joined(_links(again, sets), component)
    # and in the others in blocks, which give only links.
    more = staged(found.filter("bucket is not null").select("bucket").distinct().join(full, "bucket"), "dart-buckets")
    if not more.isEmpty():
        named = _named(join_hot(members.drop("n"), more, ["bucket"], "n", max(total, 1) * BANDS), component)
        sets = _cell_sets(src, texts, named, sets)
        sized = staged(named.join(sets.select("id", (F.length("cells") / 4).cast("long").alias("w")), "id"), "dart-sized")
        rows = join_hot(sized.drop("w"), _open(sized, F.col("w"), BLOCK_CELLS), ["bucket"], "n", max(total, 1) * BANDS).join(sets, "id")
        links = _laid(rows, "cells").mapInArrow(_proven, "a long, b long")
        component = joined(staged(links, "dart-links"), component)
    classes = texts.join(component, "id", "left").select("content", "copies", "doc", F.coalesce("component", "id").alias("component"))
    classes = staged(classes, "dart-classes")
    least = staged(classes.groupBy("component").agg(F.min("doc").alias("class_id"), F.count("*").alias("n")), "dart-least")
    named = staged(join_hot(classes, least, ["component"], "n", max(total, 1)).select("content", "class_id", "copies"), "dart-classes")
    worded = join_hot(signed.select("doc_id", "key", "content"), named, ["content"], "copies", total).select("doc_id", "key", "class_id")
    wordless = src.filter(~F.rlike(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))).select("doc_id", "key", F.col("doc_id").alias("class_id"))
    out = worded.unionByName(wordless).withColumn("kept", F.col("doc_id") == F.col("class_id"))
    return out.select(F.when(F.col("doc_id") != no_id, F.col("doc_id")).alias("doc_id"), F.when(F.col("class_id") != no_id, F.col("class_id")).alias("class_id"), "kept", "key")


#: Every pair that shares a shingle, for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), c AS (SELECT doc_id, sh, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY ALL),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS n FROM c x JOIN c y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM both_ JOIN t x ON a = x.doc_id JOIN t y ON b = y.doc_id WHERE both_.n >= 0.8 * (x.n + y.n - both_.n)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
walk(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, w.c FROM walk w JOIN links l ON l.a = w.id)
SELECT id AS doc_id, min(c) AS class_id, id = min(c) AS kept FROM walk GROUP BY id
"""
