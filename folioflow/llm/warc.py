"""WARC archives with a two-level capture index.

Every task writes one archive of gzip members. Captures are then sorted by reversed-host URL key and
packed into compressed blocks; for each index file a sparse directory holds the first key of every
block. A lookup finds the index file, then the block, by binary search, reads that range, and
finds the capture in the block; the records are read by range.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, join_hot, staged

LEAST_SHARED = 100
BLOCK_LINES = 2000
LEVEL = 4
READ_AHEAD = 4 << 20
DATE = "1970-01-01T00:00:00Z"
FIRST_BROADCAST_ROWS = 200_000


def clean_url(url: str | None) -> str:
    """White space and control characters would break a header line."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: quote(m[0]), url or "")


def url_key(url: str | None) -> str:
    """Host parts in reverse, then port, path and query: http://a.example.net/x?y -> net,example,a)/x?y"""
    url = clean_url(url)
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    name = "" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if first is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean_url(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


class _Out:
    """A file that gets its name when complete; a task that is run again leaves another file."""

    def __init__(self, folder: str, kind: str):
        self.fs, path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = f"{kind}-{uuid.uuid4().hex}"
        self.part, self.whole = f"{path}/.{self.name}", f"{path}/{self.name}"
        self.stream, self.at = self.fs.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> int:
        at = self.at
        self.stream.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.whole)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for every row; captures (url_key, page_id, file, offset, length), staged.

    Of rows with equal payloads of LEAST_SHARED bytes or more, the one with the smallest page_id is
    the response. A null page_id comes after all others. Payloads are not shuffled unless the
    payloads that repeat are too many to broadcast; those that a thousandth of the rows share never are.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    narrow = rows.select("page_id", "digest", F.octet_length("payload").alias("size"))
    first = narrow.filter(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = staged(first.filter("n > 1 and first is not null"), "warc-first")
    if first.count() <= FIRST_BROADCAST_ROWS:
        rows = rows.join(F.broadcast(first), "digest", "left")
    else:
        rows = join_hot(rows, first, ["digest"], "n", rows.count(), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, found = None, []
        for b in batches:
            for page_id, url, data, digest, one in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                out = out or _Out(folder, "archive")
                member = _record(page_id, url, data, digest, None if one == page_id else one)
                found.append((url_key(url), page_id, out.write(member), len(member)))
        if out:
            out.close()
            n = len(found)
            yield pa.record_batch({"url_key": pa.array([x[0] for x in found], pa.string()), "page_id": pa.array([x[1] for x in found], pa.int64()), "file": pa.array([out.name] * n), "offset": pa.array([x[2] for x in found], pa.int64()), "length": pa.array([x[3] for x in found], pa.int64())})

    return staged(rows.select("page_id", "url", "payload", "digest", "first").mapInArrow(write, "url_key string, page_id long, file string, offset long, length long"), "warc-captures")


def _sort_key(url_key: str, page_id: int | None) -> bytes:
    """Bytes that sort by URL key, then page id."""
    return url_key.encode() + b" " + (b"" if page_id is None else (page_id + (1 << 63)).to_bytes(8, "big").hex().encode())


def build_index(captures: DataFrame, folder: str) -> list[tuple[bytes, str, str]]:
    """Sort captures into index files; (first key, block file, directory file) of each, in order.

    That list has a row for each range partition. A block's lines and one directory are what a reader holds.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, lines, directory, head = None, [], [], b""

        def flush() -> None:
            data = zlib.compress(b"\n".join(lines), LEVEL)
            directory.append(b"%s %d %d" % (lines[0].rsplit(b"\t", 3)[0], blocks.write(data), len(data)))
            lines.clear()

        for b in batches:
            for k, page_id, file, offset, length in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                key = _sort_key(k, page_id)
                if blocks is None:
                    blocks, head = _Out(folder, "index"), key
                lines.append(key + f"\t{file}\t{offset}\t{length}".encode())
                if len(lines) >= BLOCK_LINES:
                    flush()
        if blocks is not None:
            if lines:
                flush()
            blocks.close()
            sparse = _Out(folder, "directory")
            sparse.write(zlib.compress(b"\n".join(directory)))
            sparse.close()
            yield pa.record_batch({"head": [head], "blocks": [blocks.name], "directory": [sparse.name]})

    keys = ["url_key", "page_id", "file", "offset"]
    ordered = captures.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, "length")
    rows = ordered.mapInArrow(pack, "head binary, blocks string, directory string").collect()
    return sorted((bytes(r.head), r.blocks, r.directory) for r in rows)


class Index:
    """Reads captures of a key: two binary searches, one range read. Holds one directory and one block at a time."""

    def __init__(self, folder: str, shards: list[tuple[bytes, str, str]]):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.shards, self.heads = shards, [s[0] for s in shards]
        self.shard = self.block = None

    def _load(self, s: int) -> None:
        if self.shard != s:
            with self.fs.open_input_file(f"{self.path}/{self.shards[s][2]}") as f:
                rows = [x.rsplit(b" ", 2) for x in zlib.decompress(f.read()).split(b"\n")]
            self.firsts, self.spans = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
            self.shard, self.block = s, None

    def _lines(self, s: int, b: int) -> tuple[list[bytes], list[bytes]]:
        if self.block != b:
            with self.fs.open_input_file(f"{self.path}/{self.shards[s][1]}") as f:
                f.seek(self.spans[b][0])
                self.lines = zlib.decompress(f.read(self.spans[b][1])).split(b"\n")
            self.keys = [x.rsplit(b"\t", 3)[0] for x in self.lines]
            self.block = b
        return self.keys, self.lines

    def captures(self, key: bytes) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture with this key, which may go over block and file ends."""
        found = []
        s = max(bisect_left(self.heads, key) - 1, 0)
        while s < len(self.shards) and (s == 0 or self.heads[s] <= key):
            self._load(s)
            b = max(bisect_left(self.firsts, key) - 1, 0)
            while b < len(self.firsts) and self.firsts[b] <= key:
                keys, lines = self._lines(s, b)
                for line in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                    _, file, offset, length = line.rsplit(b"\t", 3)
                    found.append((file.decode(), int(offset), int(length)))
                b += 1
            s += 1
        return found


def locate(wanted: DataFrame, folder: str, shards: list[tuple[bytes, str, str]]) -> DataFrame:
    """file, offset, length of every capture of the (url, page_id) rows, each wanted pair once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = Index(folder, shards), None
        for b in batches:
            keys = sorted({_sort_key(url_key(u), p) for u, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)})
            found = [x for k in keys if k != last for x in index.captures(k)]
            last = keys[-1] if keys else last
            yield pa.record_batch({"file": pa.array([x[0] for x in found], pa.string()), "offset": pa.array([x[1] for x in found], pa.int64()), "length": pa.array([x[2] for x in found], pa.int64())})

    pairs = wanted.select(F.col("url").cast("string"), F.col("page_id").cast("long")).distinct()
    return pairs.repartitionByRange("url", "page_id").sortWithinPartitions("url", "page_id").mapInArrow(find, "file string, offset long, length long").distinct()


def read_records(spans: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records at `spans`, read in file order.

    A response's length and digest are those of the payload read and must equal its headers'; a revisit's are its headers'.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        name, handle, start, held = None, None, 0, b""
        for b in batches:
            out = []
            for file, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if file != name:
                    if handle:
                        handle.close()
                    name, handle, start, held = file, fs.open_input_file(f"{path}/{file}"), 0, b""
                if not start <= offset <= offset + length <= start + len(held):
                    handle.seek(offset)
                    start, held = offset, handle.read(max(length, READ_AHEAD))
                headers, payload = parse_record(held[offset - start : offset - start + length])
                page, kind, digest = headers["WARC-Record-ID"][10:-1], headers["WARC-Type"], headers["WARC-Payload-Digest"][7:]
                size = int(headers["WARC-Payload-Length"])
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"damaged record at {file}:{offset}")
                refers = headers.get("WARC-Refers-To")
                out.append((int(page) if page else None, size, digest, kind, int(refers[10:-1]) if refers else None))
            yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ordered = spans.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.select("file", "offset", "length").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `pages` to archives in `folder` (a URI; the shared scratch folder if none), index them, look every page up and read it back.

    One row for each row of `pages`: repeated rows are records of their own (those that share the
    smallest page_id are all responses). Null or empty html is an empty payload, always a response.
    Null urls have an empty key. Extra columns are ignored; an empty table gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    captures = write_archives(pages, folder)
    shards = build_index(captures, folder)
    return read_records(locate(pages, folder, shards), folder)


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
