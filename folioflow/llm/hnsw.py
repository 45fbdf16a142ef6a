"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Equal vectors are merged first. The others are dealt over shards by hash and each shard builds a graph:
layers that thin out by a factor of M, nodes inserted in blocks, links chosen so that no two point the same way.
Vectors of a shard that are all but equal in direction are one node with its members, so that no knot of ties
hides the rest; nodes that the layers don't lead to are linked to their nearest node. An audit of each shard
compares its answers to some of its vectors and of others' with brute force and doubles the beam until they pass.
Every vector then queries every shard; a member near the limit is verified in double precision. A task returns
the number of links of each of its vectors and a spanning forest of them, never the links of a group one by one.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh_path, join_hot, staged, stars
from .warc import _Out

SIMILAR = 0.95
M = 12
EF_BUILD = 48
EF_START = 48
BLOCK = 256
SHARDS = 8
SHARD_ROWS = 100_000
#: Vectors of a searching task.
QUERY_ROWS = 20_000
#: Pairs that are looked at together.
PAIRS = 200_000
#: Directions that agree to so many decimals share a node.
DECIMALS = 3
AUDIT = 500
#: Share of the audited nodes' links that the graph must find.
RECALL = 0.999
#: Nodes this far below the limit are still walked through when links are gathered.
MARGIN = 0.05


class Graph:
    def __init__(self, x: np.ndarray, first: np.ndarray, layers: list[np.ndarray], ef: int = EF_START, recall: float = 1.0):
        """x: float64 rows by node in insertion order; node i has rows first[i] to first[i + 1], of which the first stands for it.

        layers: neighbours by node, -1 for none; layer 0 first, each over a prefix of the nodes. recall: as audited.
        """
        self.x, self.first, self.layers, self.ef, self.recall = x, first, layers, ef, recall
        self.norm = np.sqrt(np.square(x).sum(1))
        self.members = (x / self.norm[:, None]).astype(np.float32)
        self.unit = self.members[first[:-1]]
        node = np.repeat(np.arange(len(self.unit)), np.diff(first))
        self.back: tuple[np.ndarray, np.ndarray] | None = None
        #: The widest angle between a node and one of its members.
        self.slack = 2 * np.arcsin(min(1.0, float(np.sqrt(np.square(self.members - self.unit[node]).sum(1).max(initial=0))) / 2))

    def _beam(self, nbr: np.ndarray, n: int, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step over the first n nodes of a layer: ids and similarities, best first."""
        rows = np.arange(len(q))
        ids = np.full((len(q), ef), -1)
        sim = np.full((len(q), ef), -np.inf, np.float32)
        done = np.zeros((len(q), ef), bool)
        seen = np.zeros((len(q), n + 1), bool)
        ids[:, 0], sim[:, 0] = entry, np.einsum("qd,qd->q", self.unit[entry], q)
        seen[rows, entry] = seen[:, n] = True
        pick = min(max(4, ef // 16), ef)
        while len(rows):
            wait = np.where(done[rows] | (ids[rows] < 0), -np.inf, sim[rows])
            top = np.argpartition(-wait, pick - 1, axis=1)[:, :pick] if pick < ef else np.tile(np.arange(ef), (len(rows), 1))
            live = np.take_along_axis(wait, top, 1) > -np.inf
            on = live.any(1)
            rows, top, live = rows[on], top[on], live[on]
            if not len(rows):
                break
            r = rows[:, None]
            near = np.where(live[..., None], nbr[ids[r, top]], -1).reshape(len(rows), -1)
            done[r, top] = True
            near = np.where(near < 0, n, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near[seen[r, near]] = n
            seen[r, near] = True
            s = np.full(near.shape, -np.inf, np.float32)
            real = near < n
            s[real] = np.einsum("kd,kd->k", self.unit[near[real]], q[rows[np.nonzero(real)[0]]])
            all_s = np.concatenate([sim[rows], s], 1)
            best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            sim[rows] = np.take_along_axis(all_s, best, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(real, near, -1)], 1), best, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros_like(real)], 1), best, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)

    def _entry(self, q: np.ndarray, layer: int) -> np.ndarray:
        """The node that the layers above `layer` lead to."""
        at = np.zeros(len(q), np.int64)
        for up in range(len(self.layers) - 1, layer, -1):
            at = self._beam(self.layers[up], len(self.layers[up]), q, at, 4)[0][:, 0]
        return at

    def _choose(self, q: np.ndarray, ids: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Neighbours from candidates: the nearest first, without those nearer to a chosen one than to the node, which only fill what is left."""
        order = np.argsort(-sim, axis=1, kind="stable")[:, : 4 * most]
        ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
        x = self.unit[np.maximum(ids, 0)]
        among = np.matmul(x, x.transpose(0, 2, 1))
        taken = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            rival = np.where(taken, among[:, c], -np.inf).max(1)
            taken[:, c] = (ids[:, c] >= 0) & (taken.sum(1) < most) & (rival < sim[:, c])
        rank = np.where(taken, 0, np.where(ids >= 0, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, order, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _insert(self, nbr: np.ndarray, layer: int, start: int, end: int, ef: int) -> None:
        new = np.arange(start, end)
        q = self.unit[new]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        k = min(2 * M, len(new))
        best = np.argpartition(-own, k - 1, axis=1)[:, :k]
        ids, sim = best + start, np.take_along_axis(own, best, 1)
        if start:
            entry = self._entry(q, layer)
            far, far_sim = self._beam(nbr, start, q, np.where(entry < start, entry, 0), ef)
            ids, sim = np.concatenate([far, ids], 1), np.concatenate([far_sim, sim], 1)
        ids = np.where(sim > -np.inf, ids, -1)
        most = nbr.shape[1]
        nbr[new] = np.pad(self._choose(q, ids, sim, M), ((0, 0), (0, most - M)), constant_values=-1)
        a, col = np.nonzero(nbr[new] >= 0)
        to, back = nbr[new][a, col], a + start
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        wide = int(count.max(initial=0))
        if not wide:
            return
        added = np.full((len(nodes), wide), -1)
        at = np.arange(len(to)) - np.repeat(first, count)
        added[np.repeat(np.arange(len(nodes)), count), at] = back
        added[(added[:, :, None] == nbr[nodes][:, None, :]).any(2)] = -1
        both = np.concatenate([nbr[nodes], added], 1)
        full = (both >= 0).sum(1) > most
        easy = np.sort(-both[~full], axis=1)[:, :most]
        nbr[nodes[~full]] = np.where(easy <= 0, -easy, -1)
        hard, own = nodes[full], both[full]
        if len(hard):
            s = np.einsum("nkd,nd->nk", self.unit[np.maximum(own, 0)], self.unit[hard])
            nbr[hard] = self._choose(self.unit[hard], own, np.where(own >= 0, s, -np.inf), most)

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, others: np.ndarray | None = None) -> tuple[Graph, np.ndarray]:
        """The graph, audited with `others` too, and `ids` in the order of its rows."""
        unit = x / np.sqrt(np.square(x).sum(1))[:, None]
        _, node = np.unique(np.round(unit, DECIMALS) + 0.0, axis=0, return_inverse=True)
        node = node.ravel()
        h = _hash(ids)
        low = np.full(node.max() + 1, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(low, node, h)
        level = np.floor(-np.log(((low >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / np.log(M)).astype(int)
        place = np.empty(len(low), np.int64)
        place[np.lexsort((low, -level))] = np.arange(len(low))
        order = np.lexsort((h, place[node]))
        g = cls(x[order], np.searchsorted(place[node][order], np.arange(len(low) + 1)), [])
        sizes = [int((level >= at).sum()) for at in range(level.max() + 1)]
        g.layers = [np.zeros((0, 0), np.int64)] * len(sizes)
        for layer in range(len(sizes) - 1, -1, -1):
            n = sizes[layer]
            nbr = np.full((n, 2 * M if layer == 0 else M), -1)
            at = 0
            while at < n:
                end = min(n, at + max(16, min(BLOCK, at)))
                g._insert(nbr, layer, at, end, EF_BUILD)
                at = end
            g.layers[layer] = g._joined(nbr)
        g.audit(others=others)
        return g, ids[order]

    def _joined(self, nbr: np.ndarray) -> np.ndarray:
        """`nbr` with links to nodes that the first node does not lead to, from the nearest that it leads to."""
        n = len(nbr)
        seen = np.zeros(n + 1, bool)

        def walk(front: np.ndarray) -> None:
            while len(front):
                seen[front] = True
                near = np.unique(nbr[front])
                near = near[near >= 0]
                front = near[~seen[near]]

        walk(np.zeros(1, np.int64))
        while len(lost := np.flatnonzero(~seen[:n])):
            lost = lost[:: -(-len(lost) // BLOCK)]
            known = np.flatnonzero(seen[:n])
            to = known[(self.unit[lost] @ self.unit[known].T).argmax(1)]
            for node, at in zip(lost, to, strict=True):
                free = np.flatnonzero(nbr[at] < 0)
                if not len(free):
                    nbr = np.pad(nbr, ((0, 0), (0, 1)), constant_values=-1)
                    free = [nbr.shape[1] - 1]
                nbr[at, free[0]] = node
            walk(lost)
        return nbr

    def audit(self, limit: float = SIMILAR, others: np.ndarray | None = None) -> None:
        """Double the beam until each probe, a sample of the nodes and `others`, on average finds what brute force finds, itself not counted."""
        n = len(self.unit)
        probe = np.unique(np.linspace(0, n - 1, min(AUDIT, n)).astype(int))
        q, own = self.unit[probe], probe
        if others is not None and len(others):
            q = np.concatenate([q, (others / np.sqrt(np.square(others).sum(1))[:, None]).astype(np.float32)])
            own = np.r_[probe, np.full(len(others), -1)]
        while self.ef < n:
            self.recall = self._recall(q, own, limit)
            if self.recall >= RECALL:
                return
            self.ef *= 2
        self.ef, self.recall = n, 1.0

    def _recall(self, q: np.ndarray, own: np.ndarray, limit: float) -> float:
        """Mean share of its links that a query with links finds; own: its node, -1 for none."""
        shares = []
        for k in range(0, len(q), BLOCK):
            true = q[k : k + BLOCK] @ self.unit.T >= limit
            me = np.flatnonzero(own[k : k + BLOCK] >= 0)
            true[me, own[k : k + BLOCK][me]] = False
            found = np.zeros(true.shape, bool)
            found[self.near(q[k : k + BLOCK], limit)[:2]] = True
            some = true.any(1)
            shares.append((true & found).sum(1)[some] / true.sum(1)[some])
        shares = np.concatenate(shares)
        return float(shares.mean()) if len(shares) else 1.0

    def _around(self, nodes: np.ndarray) -> np.ndarray:
        """Nodes that these link to or that link to these."""
        if self.back is None:
            node, col = np.nonzero(self.layers[0] >= 0)
            to = self.layers[0][node, col]
            order = np.argsort(to, kind="stable")
            self.back = node[order], np.searchsorted(to[order], np.arange(len(self.unit) + 1))
        source, ends = self.back
        start, size = ends[nodes], ends[nodes + 1] - ends[nodes]
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.unique(np.concatenate([self.layers[0][nodes].ravel(), source[at]]))

    def near(self, q: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, similarity) for nodes of about `limit` or more: the beam, then on from hits to their neighbours; all nodes where the beam holds all."""
        n = len(self.unit)
        if self.ef >= n:
            s = q @ self.unit.T
            a, node = np.nonzero(s >= limit - 1e-5)
            return a, node, s[a, node]
        ids, sim = self._beam(self.layers[0], n, q, self._entry(q, 0), self.ef)
        # A beam full of hits may have cut some off: those queries walk the region around their hits together.
        full = (sim >= limit - MARGIN).sum(1) >= self.ef // 2
        a, c = np.nonzero((sim >= limit - 1e-5) & ~full[:, None])
        out = [(a, ids[a, c], sim[a, c])]
        if full.any():
            mine = np.flatnonzero(full)
            seen = np.zeros(n, bool)
            front = np.unique(ids[mine][sim[mine] >= limit - MARGIN])
            seen[front] = True
            while len(front):
                s = q[mine] @ self.unit[front].T
                a, c = np.nonzero(s >= limit - 1e-5)
                out.append((mine[a], front[c], s[a, c]))
                near = self._around(front[(s >= limit - MARGIN).any(0)])
                front = near[near >= 0]
                front = front[~seen[front]]
                seen[front] = True
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def links(self, q: np.ndarray, x: np.ndarray, norm: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) for every pair found whose cosine in double precision is `limit` or more; q: unit vectors of x."""
        a, node, near = self.near(q, float(np.cos(min(np.pi, np.arccos(limit) + self.slack))))
        size = self.first[node + 1] - self.first[node]
        ends = np.cumsum(size)
        for k in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            at = np.arange(k, min(k + PAIRS, int(ends[-1])))
            pair = np.searchsorted(ends, at, "right")
            i, j = a[pair], self.first[node[pair] + 1] - (ends[pair] - at)
            s = near[pair]
            more = np.flatnonzero(size[pair] > 1)
            s[more] = np.einsum("kd,kd->k", q[i[more]], self.members[j[more]])
            ok = s >= limit
            doubt = np.flatnonzero(np.abs(s - limit) < 1e-5)
            i2, j2 = i[doubt], j[doubt]
            ok[doubt] = np.einsum("kd,kd->k", x[i2], self.x[j2]) / (norm[i2] * self.norm[j2]) >= limit
            yield i[ok], j[ok]

    def to_bytes(self, ids: np.ndarray, copies: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=ids, copies=copies, x=self.x, first=self.first, ef=self.ef, recall=self.recall, **{f"layer{i}": a.astype(np.int32) for i, a in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[Graph, np.ndarray, np.ndarray]:
        z = np.load(io.BytesIO(data))
        layers = [z[f"layer{i}"].astype(np.int64) for i in range(len([k for k in z.files if k.startswith("layer")]))]
        return cls(z["x"], z["first"], layers, int(z["ef"]), float(z["recall"])), z["ids"], z["copies"]


def _hash(ids: np.ndarray) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


GRAPHS = "dim int, shard long, file string, rows long, nodes long, ef long, recall double"


def _builder(folder: str):  # noqa: ANN202
    def build(part: pd.DataFrame) -> pd.DataFrame:
        probe = part.probe.to_numpy()
        part, others = part[~probe], np.array(part.v[probe].tolist(), np.float64)
        row = []
        if len(part):
            ids = part.id.to_numpy()
            g, order = Graph.build(ids, np.array(part.v.tolist(), np.float64), others)
            by_id = np.argsort(ids)
            copies = part.copies.to_numpy()[by_id][np.searchsorted(ids[by_id], order)]
            out = _Out(folder, "graph")
            out.write(g.to_bytes(order, copies))
            out.close()
            row = [(int(part.dim.iloc[0]), int(part.shard.iloc[0]), out.name, len(order), len(g.unit), g.ef, g.recall)]
        return pd.DataFrame(row, columns=[x.split()[0] for x in GRAPHS.split(", ")]).astype({"dim": "int32", "shard": "int64", "file": str, "rows": "int64", "nodes": "int64", "ef": "int64", "recall": float})

    return build


def _search(folder: str, files: list[tuple[int, str]], limit: float):  # noqa: ANN202
    """From rows (id, v, dim) of a task: (id, n, null), the number of vectors linked to each, and (id, null, peer), a forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).combine_chunks()
        ids, dims = np.asarray(t.column(0)), np.asarray(t.column(2))
        flat, ends = np.asarray(t.column(1).chunk(0).flatten()), np.cumsum(dims)
        n = np.zeros(len(ids), np.int64)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fs, path = pafs.FileSystem.from_uri(folder)
        for dim, file in files:
            mine = np.flatnonzero(dims == dim)
            if not len(mine):
                continue
            with fs.open_input_file(f"{path}/{file}") as f:
                g, nodes, copies = Graph.from_bytes(f.read())
            for k in range(0, len(mine), BLOCK):
                own = mine[k : k + BLOCK]
                x = np.stack([flat[ends[i] - dim : ends[i]] for i in own])
                norm = np.sqrt(np.square(x).sum(1))
                for i, j in g.links((x / norm[:, None]).astype(np.float32), x, norm, limit):
                    other = ids[own[i]] != nodes[j]
                    i, j = i[other], j[other]
                    n[own] += np.bincount(i, copies[j], minlength=len(own)).astype(np.int64)
                    a, b = stars(np.concatenate([a, ids[own[i]]]), np.concatenate([b, nodes[j]]))
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("peer", pa.int64())])
        yield pa.record_batch([pa.array(ids), pa.array(n), pa.nulls(len(ids), pa.int64())], schema=schema)
        yield pa.record_batch([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(b)], schema=schema)

    return run


def build_graphs(groups: DataFrame, shards: int, folder: str) -> list:
    """A row (GRAPHS) for each graph that is built in `folder` from (id, v, dim, copies), with the recall of its audit."""
    shard = F.pmod(F.xxhash64("id"), F.lit(shards))
    dealt = groups.select("id", "v", "dim", "copies", shard.alias("shard"), F.lit(False).alias("probe"))
    rates = groups.groupBy("dim").agg((F.lit(AUDIT) / F.count("*")).alias("rate"))
    probes = groups.join(rates, "dim").filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    probes = probes.withColumn("own", shard).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    dealt = dealt.unionByName(probes.filter("shard <> own").select("id", "v", "dim", "copies", "shard", F.lit(True).alias("probe")))
    return dealt.groupBy("dim", "shard").applyInPandas(_builder(folder), GRAPHS).collect()


def merged(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): vec_id, sound and h1, h2 of every row; id, v, dim, copies, h1, h2, vec_id (the smallest) of every distinct sound vector.

    A vector whose largest component is very large or small is scaled by it, which leaves its cosines.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.withColumn("sound", F.coalesce(finite & F.exists("v", lambda c: c != 0) & F.col("vec_id").isNotNull(), F.lit(False)))
    most = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("v", F.when(F.col("sound"), F.when((most > 1e100) | (most < 1e-100), F.transform("v", lambda c: c / most)).otherwise(F.col("v"))))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    groups = rows.filter("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    groups = groups.withColumns({"dim": F.size("v"), "id": F.xxhash64("h1", "h2")})
    return rows.drop("v"), staged(groups, "hnsw-vectors")


def similar_vectors(vectors: DataFrame, limit: float = SIMILAR) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    A vector that is null, empty, zero or holds a null or non-finite component, or has no vec_id, links
    with nothing; vectors of different lengths don't link. Equal vectors link with each other and are
    searched once. Rows that repeat a vec_id are vectors of their own. Extra columns are ignored; an
    empty table gives no rows. A shard has at most about SHARD_ROWS vectors; a searching task holds
    about QUERY_ROWS vectors and one shard's graph at a time.
    """
    spark = vectors.sparkSession
    rows, groups = merged(vectors)
    total, distinct = rows.count(), groups.count()
    folder = fresh_path(spark, "hnsw-graphs")
    graphs = build_graphs(groups, max(SHARDS, -(-distinct // SHARD_ROWS)), folder)
    files = [(g["dim"], g["file"]) for g in graphs]
    queries = groups.select("id", "v", "dim").repartition(max(2 * spark.sparkContext.defaultParallelism, -(-distinct // QUERY_ROWS)), "id")
    found = staged(queries.mapInArrow(_search(folder, files, limit), "id long, n long, peer long"), "hnsw-found")
    links = found.filter("peer is not null").select(F.col("id").alias("a"), F.col("peer").alias("b"))
    known = groups.select("id", "h1", "h2", "vec_id", "copies").join(found.filter("peer is null").select("id", "n"), "id")
    known = known.join(connected_components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = staged(known, "hnsw-known")
    least = staged(known.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("k")), "hnsw-least")
    named = join_hot(known, least, ["component"], "k", distinct)
    named = staged(named.select("h1", "h2", "copies", (F.col("copies") - 1 + F.col("n")).alias("n_links"), "component_id"), "hnsw-components")
    sound = join_hot(rows.filter("sound").select("vec_id", "h1", "h2"), named, ["h1", "h2"], "copies", total).select("vec_id", "n_links", "component_id")
    rest = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return sound.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: Every pair, for small tables.
ORACLE_SQL = """
WITH RECURSIVE every AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sound AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM every
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95
), walk(id, c) AS (SELECT vec_id, vec_id FROM every UNION SELECT l.b, w.c FROM walk w JOIN links l ON l.a = w.id),
component AS (SELECT id, min(c) AS c FROM walk GROUP BY id), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM every JOIN component ON id = vec_id LEFT JOIN degree ON a = vec_id
"""
