"""Stream decoders and predictors. Each returns None where the data are not valid; limits raise."""

from __future__ import annotations

import re
import zlib
from itertools import accumulate

import numpy as np

from .limits import Options, limit

STEP = 65_536
DEFAULTS = Options()


def flate(data: bytes, options: Options = DEFAULTS, most: int | None = None) -> bytes | None:
    """zlib, gzip or raw deflate; the end must be reached, bytes after it don't matter. `most`: decoded bytes the document may still produce."""
    for wbits in (15, 31, -15):
        out, size, z = [], 0, zlib.decompressobj(wbits)
        left = bytes(data)
        try:
            while left and not z.eof:
                part = z.decompress(left, STEP)
                left = z.unconsumed_tail
                size += len(part)
                if size > options.maxStreamBytes:
                    raise limit("Flate stream exceeds maxStreamBytes.")
                if most is not None and size > most:
                    raise limit("Flate stream exceeds maxDecodedBytesTotal.")
                out.append(part)
            if z.eof:
                return b"".join(out)
        except zlib.error:
            continue
    return None


def flate_end(data: bytes, at: int, options: Options, work) -> int | None:  # noqa: ANN001
    """Where a zlib stream that begins at `at` ends."""
    z, left, size = zlib.decompressobj(), bytes(data[at:]), 0
    total = len(left)
    try:
        while left and not z.eof:
            part = z.decompress(left, STEP)
            size += len(part)
            if size > options.maxStreamBytes:
                raise limit("Inline image exceeds maxStreamBytes.")
            work(len(part))
            left = z.unconsumed_tail
    except zlib.error:
        return None
    return at + total - len(z.unused_data) if z.eof else None


def ascii_hex(data: bytes) -> bytes | None:
    raw = re.sub(rb"\s+", b"", data).rstrip(b">")
    try:
        return bytes.fromhex((raw + b"0" * (len(raw) % 2)).decode("ascii"))
    except ValueError:
        return None


def ascii85(data: bytes, options: Options = DEFAULTS) -> bytes | None:
    """`z` inside a group is invalid; characters outside the alphabet are passed over; values are taken modulo 2^32."""
    raw = re.sub(rb"\s+", b"", data).replace(b"~>", b"").replace(b"<~", b"")
    raw = raw.translate(None, bytes(c for c in range(256) if not 33 <= c <= 117 and c != 122))
    out = []
    size = 0
    for i, part in enumerate(raw.split(b"z")):
        if i:
            out.append(bytes(4))
        full = len(part) - len(part) % 5
        last = i == raw.count(b"z")
        if full != len(part) and not last:
            return None
        digits = np.frombuffer(part[:full], np.uint8).reshape(-1, 5).astype(np.uint64) - np.uint64(33)
        values = digits @ np.array([85**4, 85**3, 85**2, 85, 1], np.uint64) & np.uint64(0xFFFFFFFF)
        out.append(values.astype(">u4").tobytes())
        if rest := part[full:]:
            if len(rest) > 1:
                value = 0
                for c in rest.ljust(5, b"u"):
                    value = value * 85 + c - 33
                out.append((value & 0xFFFFFFFF).to_bytes(4, "big")[: len(rest) - 1])
        size += len(out[-1])
        if size > options.maxStreamBytes:
            raise limit("ASCII85 stream exceeds maxStreamBytes.")
    return b"".join(out)


CLEAR, EOD = 256, 257


def lzw(data: bytes, early: int = 1, options: Options = DEFAULTS, most: int | None = None) -> bytes | None:
    found = lzw_span(data, early, options, most)
    return None if found is None else found[0]


def _codes(data: bytes, bit: int, width: int, n: int) -> list[int]:
    """n codes of one width from a place in bits on."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-(bit % 8 + n * width) // 8), bit // 8))
    return (bits[bit % 8 : bit % 8 + n * width].reshape(n, width) @ (1 << np.arange(width - 1, -1, -1))).tolist()


def lzw_span(data: bytes, early: int = 1, options: Options = DEFAULTS, most: int | None = None) -> tuple[bytes, int | None] | None:
    """The decoded bytes and where the end-of-data code ends (None without one). Codes are cut out together as long as their width stays."""
    data = bytes(data)
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out = list(fresh), []
    size = bit = 0
    width, before = 9, b""
    allowed = options.maxStreamBytes if most is None else min(most, options.maxStreamBytes)
    while n := min((len(data) * 8 - bit) // width, max(1, (1 << width) - early - len(table)) if width < 12 else 4096):
        for code in _codes(data, bit, width, n):
            bit += width
            if code == EOD:
                return b"".join(out), -(-bit // 8)
            if code == CLEAR:
                table, width, before = list(fresh), 9, b""
                break
            if code < len(table) and (before or code < 256):
                entry = table[code]
            elif before and code == len(table) < 4096:
                entry = before + before[:1]
            else:
                return None
            out.append(entry)
            size += len(entry)
            if size > allowed:
                raise limit("LZW stream exceeds maxStreamBytes." if size > options.maxStreamBytes else "LZW stream exceeds maxDecodedBytesTotal.")
            if before and len(table) < 4096:
                table.append(before + entry[:1])
            before = entry
            if width < 12 and len(table) + early >= 1 << width:
                width += 1
                break
    return b"".join(out), None


def run_length(data: bytes, options: Options = DEFAULTS) -> bytes | None:
    out, at, size = [], 0, 0
    while at < len(data):
        n = data[at]
        at += 1
        if n == 128:
            break
        if n < 128:
            part = data[at : at + n + 1]
            if len(part) <= n:
                return None
            at += n + 1
        else:
            if at >= len(data):
                return None
            part = data[at : at + 1] * (257 - n)
            at += 1
        size += len(part)
        if size > options.maxStreamBytes:
            raise limit("RunLength stream exceeds maxStreamBytes.")
        out.append(bytes(part))
    return b"".join(out)


def run_length_end(data: bytes, at: int) -> int | None:
    while at < len(data):
        n = data[at]
        at += 1
        if n == 128:
            return at
        at += n + 1 if n < 128 else 1
    return None


def predict(data: bytes, predictor: int = 1, colors: int = 1, bits: int = 8, columns: int = 1, options: Options = DEFAULTS) -> bytes | None:
    """Undo a TIFF (2) or PNG (10 to 15) predictor."""
    if predictor <= 1:
        return data
    if len(data) > options.maxStreamBytes:
        raise limit("Predictor input exceeds maxStreamBytes.")
    if bits not in (1, 2, 4, 8, 16) or not 1 <= colors <= 65536 or not 1 <= columns <= 65536:
        return None
    row = (columns * colors * bits + 7) // 8
    if row > 65536:
        return None
    if predictor == 2:
        return _tiff(data, colors, bits, columns, row)
    return _png(data, max(1, colors * bits // 8), row) if 10 <= predictor <= 15 else None


def _tiff(data: bytes, colors: int, bits: int, columns: int, row: int) -> bytes | None:
    if len(data) % row:
        return None
    rows = np.frombuffer(data, np.uint8).reshape(-1, row)
    n = columns * colors
    if bits == 16:
        samples = rows.view(">u2").astype(np.uint32)
    elif bits == 8:
        samples = rows.astype(np.uint32)
    else:
        flat = np.unpackbits(rows, axis=1)[:, : n * bits].reshape(len(rows), n, bits)
        samples = flat.astype(np.uint32) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.uint32))
    whole = np.cumsum(samples.reshape(len(rows), columns, colors), axis=1, dtype=np.uint64).reshape(len(rows), n) & np.uint64((1 << bits) - 1)
    if bits == 16:
        return whole.astype(">u2").tobytes()
    if bits == 8:
        return whole.astype(np.uint8).tobytes()
    split = (whole[..., None].astype(np.uint32) >> np.arange(bits - 1, -1, -1, dtype=np.uint32) & 1).astype(np.uint8).reshape(len(rows), n * bits)
    packed = np.packbits(split, axis=1)
    if spare := row * 8 - n * bits:
        packed[:, -1] |= rows[:, -1] & (1 << spare) - 1
    return packed.tobytes()


#: Rows of a PNG predictor from this many bytes on are added up by numpy, shorter ones one by one.
WIDE = 128


def _png(data: bytes, unit: int, row: int) -> bytes | None:
    if len(data) % (row + 1):
        return None
    data = bytes(data)
    above, out = bytes(row), []
    for at in range(0, len(data), row + 1):
        tag = data[at]
        line = data[at + 1 : at + 1 + row]
        if tag == 1:
            now = bytearray(line)
            for k in range(min(unit, row)):
                if row < WIDE:
                    now[k::unit] = bytes([x & 255 for x in accumulate(line[k::unit])])
                else:
                    now[k::unit] = np.cumsum(np.frombuffer(line, np.uint8)[k::unit], dtype=np.uint64).astype(np.uint8).tobytes()
            line = bytes(now)
        elif tag == 2:
            line = bytes([x + y & 255 for x, y in zip(line, above, strict=True)]) if row < WIDE else (np.frombuffer(line, np.uint8) + np.frombuffer(above, np.uint8)).tobytes()
        elif tag == 3:
            now = [0] * unit  # what stands left of a row
            for i in range(row):
                now.append(line[i] + (now[i] + above[i] >> 1) & 255)
            line = bytes(now[unit:])
        elif tag == 4:
            now = [0] * unit
            for x, b, c in zip(line, above, (bytes(unit) + above)[:row], strict=True):
                a = now[-unit]
                p, q = b - c, a - c
                r = abs(p + q)
                p, q = abs(p), abs(q)
                now.append(x + (a if p <= q and p <= r else b if q <= r else c) & 255)
            line = bytes(now[unit:])
        elif tag > 4:
            return None
        out.append(line)
        above = line
    return b"".join(out)
