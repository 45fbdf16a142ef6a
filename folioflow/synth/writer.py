"""Writes small PDF files: for tests, and to turn table text into documents."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np

from ..kernel import crypto, security

Objects = dict[int, bytes]


def literal(data: bytes) -> bytes:
    return b"(" + data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def stream(data: bytes, entries: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n" % (len(data), entries) + data + b"\nendstream"


def lines_content(text: str, font: bytes = b"F1", encoding: str = "cp1252") -> bytes:
    """One line of text a text line."""
    rows = [literal(x.encode(encoding, "replace")) + b" Tj" for x in text.split("\n")]
    return b"BT /%s 12 Tf 14 TL 72 720 Td " % font + b" T*\n".join(rows) + b" ET"


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


def page_objects(contents: list[bytes], font: bytes = FONT, info: bytes | None = None) -> Objects:
    """1 catalog, 2 page tree, 3 font, 4 info if any, then a page and its contents each."""
    out: Objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: font}
    if info is not None:
        out[4] = info
    kids = []
    for i, data in enumerate(contents):
        page = 5 + 2 * i
        kids.append(b"%d 0 R" % page)
        out[page] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R >>" % (page + 1)
        out[page + 1] = data if data.startswith((b"<<", b"[")) else stream(data)
    out[2] = b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(kids), len(kids))
    return out


def _table(offsets: dict[int, tuple[int, int]], free: set[int] = frozenset()) -> bytes:
    rows = [b"xref\n"]
    ids = sorted({0, *offsets, *free})
    at = 0
    while at < len(ids):
        end = at
        while end + 1 < len(ids) and ids[end + 1] == ids[end] + 1:
            end += 1
        rows.append(b"%d %d\n" % (ids[at], end - at + 1))
        for i in ids[at : end + 1]:
            rows.append(b"%010d %05d n \n" % offsets[i] if i in offsets else b"0000000000 65535 f \n")
        at = end + 1
    return b"".join(rows)


def _lay(out: bytearray, objects: Objects, generations: dict[int, int] | None = None) -> dict[int, tuple[int, int]]:
    found = {}
    for i, body in objects.items():
        g = (generations or {}).get(i, 0)
        found[i] = (len(out), g)
        out += b"%d %d obj\n" % (i, g) + body + b"\nendobj\n"
    return found


def classic(objects: Objects, trailer: bytes = b"", xref: bool = True, version: bytes = b"1.7") -> bytes:
    """With a table; xref=False points nowhere, which makes readers search the file."""
    out = bytearray(b"%PDF-" + version + b"\n")
    offsets = _lay(out, objects)
    at = len(out)
    out += _table(offsets)
    out += b"trailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (max(objects) + 1, trailer, at if xref else 0)
    return bytes(out)


def _rows(kinds: dict[int, tuple[int, int, int]], size: int) -> bytes:
    return b"".join(k.to_bytes(1, "big") + a.to_bytes(4, "big") + b.to_bytes(2, "big") for k, a, b in (kinds.get(i, (0, 0, 0)) for i in range(size)))


def compressed(objects: Objects, trailer: bytes = b"", hybrid: bool = False, predictor: bool = False) -> bytes:
    """Objects without streams go to an object stream, placed by a cross-reference stream (hybrid: beside a table)."""
    inner = {i: b for i, b in objects.items() if b"stream" not in b}
    plain = {i: b for i, b in objects.items() if i not in inner}
    box, own = max(objects) + 1, max(objects) + 2
    head, body = [], bytearray()
    for i, b in inner.items():
        head.append(b"%d %d" % (i, len(body)))
        body += b + b"\n"
    first = b" ".join(head) + b" "
    packed = zlib.compress(first + bytes(body))
    plain[box] = stream(packed, b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(inner), len(first)))
    out = bytearray(b"%PDF-1.7\n")
    offsets = _lay(out, plain)
    kinds = {i: (1, o, g) for i, (o, g) in offsets.items()} | {i: (2, box, n) for n, i in enumerate(inner)}
    at = len(out)
    kinds[own] = (1, at, 0)
    data = _rows(kinds, own + 1)
    extra = b""
    if predictor:
        data = b"".join(b"\2" + bytes(x - y & 255 for x, y in zip(data[k : k + 7], data[k - 7 : k] if k else bytes(7), strict=True)) for k in range(0, len(data), 7))
        extra = b"/DecodeParms << /Predictor 12 /Columns 7 >>"
    root = b"/Root 1 0 R " + trailer
    out += b"%d 0 obj\n" % own + stream(zlib.compress(data), b"/Type /XRef /Size %d /W [1 4 2] /Filter /FlateDecode %s %s" % (own + 1, extra, b"" if hybrid else root)) + b"\nendobj\n"
    if hybrid:
        xref_stream, at = at, len(out)
        out += _table(offsets, set(inner)) + b"trailer\n<< /Size %d /XRefStm %d %s >>\n" % (own + 1, xref_stream, root)
    out += b"startxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def update(base: bytes, objects: Objects, free: set[int] = frozenset(), generations: dict[int, int] | None = None, trailer: bytes = b"") -> bytes:
    """An appended revision."""
    prev = int(base.rsplit(b"startxref", 1)[1].split()[0])
    out = bytearray(base)
    offsets = _lay(out, objects, generations)
    at = len(out)
    out += _table(offsets, free) + b"trailer\n<< /Size 100 /Root 1 0 R /Prev %d %s >>\nstartxref\n%d\n%%%%EOF\n" % (prev, trailer, at)
    return bytes(out)


def linearized(objects: Objects) -> bytes:
    """The table that startxref names stands first and has a /Prev further on."""
    half = sorted(objects)[: len(objects) // 2]
    width = len(_table(dict.fromkeys(half, (0, 0)))) + len(b"trailer\n<< /Size 100 /Root 1 0 R /Prev 0000000000 >>\nstartxref\n0\n%%EOF\n")
    out = bytearray(b"%PDF-1.7\n")
    start = len(out)
    out += bytes(width)
    offsets = _lay(out, objects)
    second = len(out)
    out += _table({i: o for i, o in offsets.items() if i not in half}) + b"trailer\n<< /Size 100 >>\nstartxref\n%d\n%%%%EOF\n" % start
    out[start : start + width] = _table({i: offsets[i] for i in half}) + b"trailer\n<< /Size 100 /Root 1 0 R /Prev %010d >>\nstartxref\n0\n%%%%EOF\n" % second
    return bytes(out)


@dataclass
class Lock:
    """Encrypts objects before they are laid out: `apply` to each, `trailer` for the file."""

    revision: int = 6
    user: bytes = b""
    owner: bytes = b"owner-secret"
    clear_metadata: bool = False
    stream_method: str | None = None
    string_method: str | None = None
    permissions: int = -44
    document_id: bytes = b"0123456789abcdef"
    key: bytes = b""
    entries: bytes = field(default=b"", init=False)

    def __post_init__(self) -> None:
        r = self.revision
        method = {2: "V2", 3: "V2", 4: "AESV2"}.get(r, "AESV3")
        self.stream_method, self.string_method = self.stream_method or method, self.string_method or method
        version = {2: 1, 3: 2, 4: 4}.get(r, 5)
        length = 5 if r == 2 else 16
        if r <= 4:
            pads = [(p + security.PADDING)[:32] for p in (self.user, self.owner)]
            okey = security.owner_key(pads[1], r, length)
            o = security.rc4_rounds(pads[0], okey, range(20) if r >= 3 else (0,))
            self.key = security.file_key(pads[0], o, self.permissions, self.document_id, r, length, self.clear_metadata)
            u = security.user_entry(self.key, self.document_id, r).ljust(32, b"\0")
            more = b""
        else:
            self.key = self.key or sha256(b"file key").digest()
            u, ue = self._wrap(self.user, b"")
            o, oe = self._wrap(self.owner, u)
            perms = (self.permissions & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff" * 4 + (b"F" if self.clear_metadata else b"T") + b"adb" + b"0000"
            perms = crypto.aes_cbc_encrypt(perms, self.key, bytes(16))
            more = b"/UE <%s> /OE <%s> /Perms <%s>" % tuple(x.hex().encode() for x in (ue, oe, perms))
        if r >= 4:
            names = {m: b"Identity" if m == "None" else m.encode() for m in (self.stream_method, self.string_method)}
            cf = b"".join(b"/%s << /CFM /%s >> " % (n, n) for n in sorted(set(names.values()) - {b"Identity"}))
            more += b" /CF << %s>> /StmF /%s /StrF /%s" % (cf, names[self.stream_method], names[self.string_method])
        if self.clear_metadata:
            more += b" /EncryptMetadata false"
        self.entries = b"<< /Filter /Standard /V %d /R %d /Length %d /P %d /O <%s> /U <%s> %s >>" % (version, r, 8 * length if r <= 4 else 256, self.permissions, o.hex().encode(), u.hex().encode(), more)

    def _wrap(self, password: bytes, user: bytes) -> tuple[bytes, bytes]:
        check, salt = sha256(b"check" + password).digest()[:8], sha256(b"salt" + password).digest()[:8]

        def digest(s: bytes) -> bytes:
            return sha256(password + s + user).digest() if self.revision == 5 else security.hash_r6(password, s, user)

        return digest(check) + check + salt, crypto.aes_cbc_encrypt(self.key, digest(salt), bytes(16))

    def encrypt(self, data: bytes, id_: int, method: str, generation: int = 0) -> bytes:
        if method == "None":
            return data
        key = self.key if method == "AESV3" else security.object_key(self.key, id_, generation, method == "AESV2")
        if method == "V2":
            return crypto.rc4(data, key)
        iv = sha256(b"iv%d" % id_ + data).digest()[:16]
        return iv + crypto.aes_cbc_encrypt(crypto.pad(data), key, iv)

    def stream(self, id_: int, data: bytes, entries: bytes = b"") -> bytes:
        return stream(self.encrypt(data, id_, self.stream_method), entries)

    def string(self, id_: int, data: bytes) -> bytes:
        return b"<" + self.encrypt(data, id_, self.string_method).hex().encode() + b">"

    def trailer(self, id_: int) -> bytes:
        """For an encryption dictionary that is object `id_`."""
        return b"/Encrypt %d 0 R /ID [<%s> <%s>]" % (id_, self.document_id.hex().encode(), self.document_id.hex().encode())


def encrypted(pages: list[bytes], lock: Lock, info: dict[str, bytes] | None = None) -> bytes:
    objects = page_objects(pages)
    for i in range(len(pages)):
        objects[6 + 2 * i] = lock.stream(6 + 2 * i, pages[i])
    extra = b""
    if info:
        objects[4] = b"<< " + b" ".join(b"/%s %s" % (k.encode(), lock.string(4, v)) for k, v in info.items()) + b" >>"
        extra = b"/Info 4 0 R "
    last = max(objects) + 1
    objects[last] = lock.entries
    return classic(objects, extra + lock.trailer(last))


# Encoders for the stream filters.


def hex_encode(data: bytes) -> bytes:
    return data.hex().upper().encode() + b">"


def ascii85_encode(data: bytes) -> bytes:
    full = len(data) // 4 * 4
    values = np.frombuffer(data, ">u4", full // 4).astype(np.uint32)
    digits = np.empty((len(values), 5), np.uint8)
    for k in range(4, -1, -1):
        values, rest = np.divmod(values, np.uint32(85))
        digits[:, k] = rest + 33
    out = [digits.tobytes()]
    if b"\0\0\0\0" in data:
        out = [b"z" if part == b"!!!!!" else part for part in (out[0][k : k + 5] for k in range(0, len(out[0]), 5))]
    if rest := data[full:]:
        value = int.from_bytes(rest.ljust(4, b"\0"), "big")
        out.append(bytes(value // 85**k % 85 + 33 for k in range(4, -1, -1))[: len(rest) + 1])
    return b"".join(out) + b"~>"


def run_length_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and data[at + run : at + run + 1] == data[at : at + 1]:
            run += 1
        if run > 2:
            out += bytes([257 - run]) + data[at : at + 1]
            at += run
        else:
            part = data[at : at + 128]
            out += bytes([len(part) - 1]) + part
            at += len(part)
    return bytes(out) + b"\x80"


def lzw_encode(data: bytes, early: int = 1) -> bytes:
    bits = held = 0
    out = bytearray()
    width = 9

    def put(code: int) -> None:
        nonlocal bits, held
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    table: dict[bytes, int] = {bytes([i]): i for i in range(256)}
    following = 258
    put(256)
    word = b""
    for byte in data:
        more = word + bytes([byte])
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = following
        following += 1
        if following + early > 1 << width and width < 12:
            width += 1
        if following >= 4094:
            put(256)
            table = {bytes([i]): i for i in range(256)}
            following, width = 258, 9
        word = bytes([byte])
    if word:
        put(table[word])
        following += 1
        if following + early > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def png_encode(data: bytes, row: int, unit: int = 1) -> bytes:
    """Rows take the tags 0 to 4 in turn; the last is filled up with line feeds. A guess takes plain bytes only, so all rows go at once."""
    data += b"\n" * (-len(data) % row)
    lines = np.frombuffer(data, np.uint8).reshape(-1, row).astype(np.int16)
    above = np.zeros_like(lines)
    above[1:] = lines[:-1]
    left, corner = np.zeros_like(lines), np.zeros_like(lines)
    if unit < row:
        left[:, unit:], corner[:, unit:] = lines[:, :-unit], above[:, :-unit]
    a, b, c = (np.abs(x) for x in (above - corner, left - corner, left + above - 2 * corner))
    nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
    out = np.empty((len(lines), row + 1), np.uint8)
    for tag, guess in enumerate((np.zeros_like(lines), left, above, left + above >> 1, nearest)):
        out[tag::5, 0] = tag
        out[tag::5, 1:] = (lines[tag::5] - guess[tag::5]) & 255
    return out.tobytes()


def tiff_encode(data: bytes, columns: int, colors: int = 1) -> bytes:
    row = columns * colors
    data += b"\n" * (-len(data) % row)
    out = bytearray()
    for at in range(0, len(data), row):
        line = data[at : at + row]
        out += bytes(x - y & 255 for x, y in zip(line, bytes(colors) + line[:-colors], strict=True))
    return bytes(out)


ENCODERS: dict[str, Callable[[bytes], bytes]] = {
    "FlateDecode": zlib.compress,
    "ASCIIHexDecode": hex_encode,
    "ASCII85Decode": ascii85_encode,
    "LZWDecode": lzw_encode,
    "RunLengthDecode": run_length_encode,
}
