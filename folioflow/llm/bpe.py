"""Byte-level BPE encoding and decoding.

Each match of the split pattern is encoded by itself. A segment tree over its byte positions
stores the leftmost minimum pair rank: a leaf holds rank * size + position of the pair that starts
there, an inner node the minimum of its children. A merge reads the root and updates three leaves
(the merged token, its live left neighbour, the vanished right one) and their paths. Trees of equal
size are laid in one matrix and worked in step; a piece of over 64 bytes gets a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

NONE = np.int32(2**31 - 1)
WIDEST = 64
CACHED = 200_000
CHUNK_CHARS = 600_000


class Codec:
    """Encoder and decoder for one rank file (lines of base64 token and rank) and split pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.split = regex.compile(pattern).findall
        top = max(self.ranks.values()) + 1
        self.token = [b""] * top
        for t, r in self.ranks.items():
            self.token[r] = t
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.key_rank = np.array([pairs[k] for k in sorted(pairs)], np.int32)
        self.first = np.full((256, 256), NONE, np.int32)
        for t, r in self.ranks.items():
            if len(t) == 2:
                self.first[t[0], t[1]] = r
        self.cache: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.key_rank[at], NONE)

    def _in_step(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Encode pieces of 2 to `size` bytes; `size` is a power of two."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        place = np.arange(size)
        token = self.byte[raw]
        alive = place < length[:, None]
        after = np.where(place + 1 < length[:, None], place + 1, size).astype(np.int32)
        before = np.broadcast_to((place - 1).astype(np.int32), (n, size)).copy()
        tree = np.full((n, 2 * size), NONE, np.int32)
        pair = np.full((n, size), NONE, np.int32)
        pair[:, :-1] = self.first[raw[:, :-1], raw[:, 1:]]
        pair[~alive | (after == size)] = NONE
        tree[:, size:] = np.where(pair == NONE, NONE, pair * size + place)
        for node in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        tree, token, after, before = tree.ravel(), token.ravel(), after.ravel(), before.ravel()
        alive = alive.ravel()
        rows = np.flatnonzero(tree[1 :: 2 * size] != NONE)

        def put(tops: np.ndarray, p: np.ndarray, ranks: np.ndarray) -> None:
            node = tops + p + size
            tree[node] = np.where(ranks == NONE, NONE, ranks * size + p)
            p = p + size
            for _ in range(size.bit_length() - 1):
                p >>= 1
                left = tops + 2 * p
                tree[tops + p] = np.minimum(tree.take(left), tree.take(left + 1))

        while len(rows):
            tops, base = rows * (2 * size), rows * size
            root = tree.take(tops + 1)
            p, merged = root & size - 1, root >> size.bit_length() - 1
            here = base + p
            gone = after.take(here)
            nxt = after.take(base + gone)
            token[here], alive[base + gone], after[here] = merged, False, nxt
            more = np.flatnonzero(nxt < size)
            before[base[more] + nxt[more]] = p[more]
            q = before.take(here)
            lefts = np.flatnonzero(q >= 0)
            ranks = self.rank(
                np.concatenate([merged[more], token.take(base[lefts] + q[lefts])]),
                np.concatenate([token.take(base[more] + nxt[more]), merged[lefts]]),
            )
            own = np.full(len(rows), NONE)
            own[more] = ranks[: len(more)]
            put(np.concatenate([tops, tops, tops[lefts]]), np.concatenate([gone, p, q[lefts]]), np.concatenate([np.full(len(rows), NONE), own, ranks[len(more) :]]))
            rows = rows[tree.take(tops + 1) != NONE]
        alive = alive.reshape(n, size)
        flat = token[alive.ravel()].astype("<u4").tobytes()
        ends = (np.cumsum(alive.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _alone(self, piece: bytes) -> bytes:
        n, none = len(piece), 1 << 62
        size = 1 << (n - 1).bit_length()
        token, pairs = self.byte[np.frombuffer(piece, np.uint8)].tolist(), self.pairs
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (r := pairs.get(token[i] << 32 | token[i + 1])) is not None:
                tree[size + i] = r * size + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(p: int, rank: int | None) -> None:
            node = p + size
            tree[node] = none if rank is None else rank * size + p
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] != none:
            merged, p = divmod(tree[1], size)
            gone = after[p]
            nxt = after[p] = after[gone]
            token[p], token[gone] = merged, -1
            put(gone, None)
            if nxt < n:
                before[nxt] = p
            put(p, pairs.get(merged << 32 | token[nxt]) if nxt < n else None)
            if before[p] >= 0:
                put(before[p], pairs.get(token[before[p]] << 32 | merged))
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out, todo = [b""] * len(pieces), {}
        for i, p in enumerate(pieces):
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(raw) > WIDEST:
                out[i] = self._alone(raw)
            elif raw:
                todo.setdefault(1 << (len(raw) - 1).bit_length(), []).append((i, raw))
        for size, own in todo.items():
            step = 1 << 16 - size.bit_length()
            for k in range(0, len(own), step):
                part = own[k : k + step]
                for (i, _), ids in zip(part, self._in_step([raw for _, raw in part], size), strict=True):
                    out[i] = ids
        return out

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Pieces seen before come from a bounded cache of short pieces."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        split = [self.split(t) for t in texts]
        new = list({p for own in split for p in own}.difference(self.cache))
        found = dict(zip(new, self.encode_pieces(new), strict=True))
        self.cache.update((p, ids) for p, ids in found.items() if len(p) <= WIDEST)
        get, rare = self.cache.__getitem__, {p: ids for p, ids in found.items() if len(p) > WIDEST}
        return [b"".join(map(get, own) if not rare else (rare[p] if p in rare else get(p) for p in own)) for own in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def encode_decode(docs: DataFrame, rank_path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids (array<int>) for every row.

    A map over rows without a shuffle, so a lost executor costs its own tasks only. The rank file
    (under a MB) is read once on the driver and broadcast; memory is bounded by PART_BYTES of rows at a time, CHUNK_CHARS, the
    piece cache, which a task drops at its end, and the longest text. Null and empty texts have no tokens. Repeated rows and null ids give a row each.
    Other columns, whatever their names, are ignored. An empty table gives no rows.
    """
    own = default_vocabulary()
    with open(rank_path or own[0], "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    pattern = pattern or own[1]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(shared.value, pattern)
        texts, ids, shas = batch.column(1), [], []
        chunk, size = [], 0

        def flush() -> None:
            for x in c.encode_texts(chunk):
                ids.append(x)
                shas.append((hashlib.sha256(x).hexdigest(), hashlib.sha256(c.decode(x)).hexdigest()))
            chunk.clear()

        for t in texts:
            t = t.as_py() or ""
            chunk.append(t)
            size += len(t)
            if size > CHUNK_CHARS:
                flush()
                size = 0
        flush()
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        out = {"doc_id": batch.column(0), "n_tokens": lengths, "ids_sha256": [a for a, _ in shas], "decoded_sha256": [b for _, b in shas]}
        if with_ids:
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), flat)
        return pa.record_batch(out)

    def done() -> None:
        codec(shared.value, pattern).cache.clear()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), work, schema, done)
