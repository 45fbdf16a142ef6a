"""A document's objects: cross-reference index, object loading, streams, recovery, pages and resources."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from . import filters, fonts, security
from .lexer import BLANK, NOTHING, Lexer, Name, Ref, ends
from .limits import NO_PAGES, Budget, Options, PdfError, limit

HEADER = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj\b")
RECOVERED = re.compile(rb"(?:\A|[\r\n])(\d+)\s+(\d+)\s+obj\b")
TRAILER = re.compile(rb"\btrailer\s*(?=<<)")
TRUE_END = re.compile(rb"(?<![A-Za-z0-9_])endstream\s+endobj\b")
ENTRY = re.compile(rb"(\d{10})\s+(\d{5})\s+([nf])[^\r\n]*(?:\r\n|\r|\n|\Z)")
SUBSECTION = re.compile(rb"[ \t]*(\d+)[ \t]+(\d+)[ \t]*(?:\r\n|\r|\n|\Z)")
_GAP = rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)+"
INDIRECT_LENGTH = re.compile(rb"/Length" + _GAP + rb"\d+" + _GAP + rb"\d+" + _GAP + rb"R\b")
START = re.compile(rb"\s+(\d+)")
TABLE = re.compile(rb"\s*xref[ \t]*(?:\r\n|\r|\n)")
WHITE = re.compile(rb"\s*")
#: Entries as they should be, of 20 bytes each.
ENTRIES = re.compile(rb"(?:\d{10} \d{5} [nf] \n)*+")
PEEK = 4096
TAIL = 65_536
#: Bytes of an object or dictionary that is kept as it was read, as many documents have the same.
SMALL = 1024


@dataclass
class Object:
    id: int
    generation: int
    value: Any
    raw: bytes | None = None
    offset: int = 0
    inner: bool = False

    @property
    def entries(self) -> dict[str, Any]:
        return self.value if isinstance(self.value, dict) else {}


def whole(x: Any) -> int | None:
    """A plain integer that is not negative."""
    return x if isinstance(x, int) and not isinstance(x, bool) and x >= 0 else None


@lru_cache(maxsize=1024)
def _small_object(data: bytes, options: Options) -> tuple[int, int, Any, int] | None:
    """Id, generation and value, not to be changed, of an object without a stream, and where its endobj stands; None if there is none."""
    m = HEADER.match(data)
    found = m and Store(data, Budget(options))._body(data, m.end(), int(m[1]), int(m[2]), 0)
    return (found[0].id, found[0].generation, found[0].value, found[1]) if found else None


@lru_cache(maxsize=1024)
def _small_value(data: bytes, options: Options) -> Any:
    """A value that is not to be changed."""
    return Lexer(data, Budget(options)).value()


def _dictionary(data: bytes, at: int, budget: Budget) -> dict[str, Any]:
    """From two opening brackets. A small one without arrays, strings, comments or others inside ends at the first closing brackets."""
    end = data.find(b">>", at, at + SMALL)
    own = bytes(data[at : end + 2]) if end >= 0 else b""
    if own and own.count(b"<") == 2 and b"(" not in own and b"[" not in own and b"%" not in own and b"{" not in own:
        found = _small_value(own, budget.options)
        return found.copy()
    return Lexer(data, budget, at).dictionary()


@dataclass
class Section:
    offsets: dict[int, tuple[int, int]]
    inner: dict[int, tuple[int, int]]
    free: set[int]
    trailer: dict[str, Any]


class Store:
    """Objects by id, loaded when asked for (indexed) or all at once (recovered)."""

    def __init__(self, data: bytes, budget: Budget):
        self.data, self.budget, self.options = data, budget, budget.options
        self.objects: dict[int, Object] = {}
        self.offsets: dict[int, tuple[int, int, int]] = {}
        self.inner: dict[int, tuple[int, int]] = {}
        self.trailer: dict[str, Any] = {}
        self.root: int | None = None
        self.indexed = False
        self.handler: security.Handler | None = None
        self.encrypt_id: int | None = None
        self.expanded: set[int] = set()
        self.generations: dict[int, int] = {}
        self.resolving: set[int] = set()
        self.fonts: dict[int, fonts.Font] = {}
        self.streams: dict[int, bytes] = {}

    # Cross-reference index

    def read_index(self) -> bool:
        """Whether a usable index was found. Sections are taken newest first; the first word on an object counts, a free entry too."""
        data, n = self.data, len(self.data)
        at = data.rfind(b"startxref", max(0, n - TAIL))
        m = START.search(data[at + 9 : at + 73]) if at >= 0 else None
        if m is None:
            return False
        queue, seen, known, edges, places = [int(m[1])], set(), set(), {n}, set()
        while queue:
            self.budget.deadline()
            at = queue.pop(0)
            if at in seen or not 0 < at < n:
                continue
            seen.add(at)
            edges.add(at)
            table = data[at : at + 16].lstrip().startswith(b"xref")
            section = self._table(at) if table else self._stream_section(at)
            if section is None:
                return False
            self.budget.counts["xref_sections"] += 1
            if table and (extra := whole(section.trailer.get("XRefStm"))) is not None:
                hybrid = self._stream_section(extra)
                if hybrid is None:
                    return False
                edges.add(extra)
                self.budget.counts["xref_sections"] += 1
                section.offsets |= hybrid.offsets
                section.inner |= hybrid.inner
                section.free = section.free - hybrid.offsets.keys() - hybrid.inner.keys() | hybrid.free
                section.trailer = hybrid.trailer | section.trailer
            places |= {o for o, _ in section.offsets.values()}
            for i, (o, g) in section.offsets.items():
                if i not in known:
                    self.offsets[i] = (o, g, 0)
            new = known | section.offsets.keys()
            self.inner |= {i: x for i, x in section.inner.items() if i not in new}
            known = new | section.inner.keys() | section.free
            self.budget.objects(len(known - {0}))
            if max(len(seen), len(places)) > self.options.maxObjects:
                raise limit("Cross-reference history exceeds maxObjects.")
            self.trailer = section.trailer | self.trailer
            if self.root is None and isinstance(root := section.trailer.get("Root"), Ref):
                self.root = root.id
            if (prev := whole(section.trailer.get("Prev"))) is not None:
                queue.append(prev)
        if not self.offsets and not self.inner:
            return False
        line = sorted(edges | places)
        after = dict(zip(line, line[1:], strict=False))
        self.offsets = {i: (o, g, after.get(o, n)) for i, (o, g, _) in self.offsets.items()}
        self.budget.counts["objects_indexed"] = len(self.offsets) + len(self.inner)
        self.budget.objects(self.budget.counts["objects_indexed"])
        self.indexed = True
        return True

    def _table(self, at: int) -> Section | None:
        data, n = self.data, len(self.data)
        m = TABLE.match(data, at)
        if m is None:
            return None
        at, out = m.end(), Section({}, {}, set(), {})
        while True:
            at = WHITE.match(data, at).end()
            if data[at : at + 7] == b"trailer":
                at += 7
                break
            if at >= n:
                break
            if (m := SUBSECTION.match(data, at)) is None:
                return None
            at, start, count = m.end(), int(m[1]), int(m[2])
            self.budget.objects(len(out.offsets) + len(out.free) + max(0, count - (start == 0)))
            rows = ENTRIES.match(data, at, at + 20 * count)[0]
            even = len(rows) // 20
            for i, k in zip(range(start, start + even), range(0, len(rows), 20), strict=True):
                if rows[k + 17] == 0x66:
                    out.free.add(i)
                elif 0 < (o := int(rows[k : k + 10])) < n:
                    out.offsets[i] = (o, int(rows[k + 11 : k + 16]))
            at += len(rows)
            for i in range(start + even, start + count):
                if (m := ENTRY.match(data, at)) is None:
                    return None
                at = m.end()
                if m[3] == b"f":
                    out.free.add(i)
                elif 0 < int(m[1]) < n:
                    out.offsets[i] = (int(m[1]), int(m[2]))
            self.budget.deadline()
        if (at := data.find(b"<<", at, at + (1 << 20))) >= 0:
            out.trailer = _dictionary(data, at, self.budget)
        return out

    def _stream_section(self, at: int) -> Section | None:
        data, n = self.data, len(self.data)
        if (m := HEADER.match(data, at)) is None:
            return None
        found = self._body(data, m.end(), int(m[1]), int(m[2]), at)
        if found is None or found[0].raw is None:
            return None
        entries = found[0].entries
        plain = self.decode(Object(0, 0, entries, found[0].raw))
        widths = entries.get("W")
        if not plain or not isinstance(widths, list) or len(widths) != 3 or any(whole(w) is None for w in widths) or max(widths) > 8 or not sum(widths):
            return None
        index = entries.get("Index")
        index = [x for x in index if whole(x) is not None] if isinstance(index, list) else []
        ranges = list(zip(index[::2], index[1::2], strict=False)) or [(0, whole(entries.get("Size")) or 0)]
        out, at = Section({}, {}, set(), entries), 0
        ends_at = [widths[0], widths[0] + widths[1], sum(widths)]
        for start, count in ranges:
            self.budget.objects(len(out.offsets) + len(out.inner) + len(out.free) + max(0, count - (start == 0)))
            if at + count * ends_at[2] > len(plain):
                return None
            for i in range(start, start + count):
                row = plain[at : at + ends_at[2]]
                at += ends_at[2]
                kind = int.from_bytes(row[: ends_at[0]], "big") if widths[0] else 1
                a, b = int.from_bytes(row[ends_at[0] : ends_at[1]], "big"), int.from_bytes(row[ends_at[1] :], "big")
                if kind == 0:
                    out.free.add(i)
                elif kind == 1 and 0 < a < n:
                    out.offsets[i] = (a, b)
                elif kind == 2 and a > 0:
                    out.inner[i] = (a, b)
        return out

    # Objects

    def _body(self, data: bytes, at: int, id_: int, generation: int, offset: int) -> tuple[Object, int] | None:
        """The object whose content begins at `at`, and where its endobj stands."""
        lexer, value, raw, last = Lexer(data, self.budget, at), NOTHING, None, {}
        while True:
            lexer.blank()
            here = lexer.at
            if data[here : here + 6] == b"endobj" and ends(data, here + 6):
                break
            if data[here : here + 6] == b"stream" and ends(data, here + 6):
                span = self._span(data, here + 6, last)
                if span is None:
                    return None
                start, lexer.at = span
                if raw is None:
                    raw = self._cut(data[start : lexer.at - 9], last)
                continue
            item = lexer.value()
            if lexer.at <= here:
                return None
            if lexer.at - at > self.options.maxObjectBytes:
                raise limit("PDF object exceeds maxObjectBytes.")
            if isinstance(item, dict):
                last = item
            if value is NOTHING:
                value = item
        return Object(id_, generation, value, raw, offset), lexer.at

    def _length(self, entries: dict[str, Any]) -> int | None:
        """/Length, plain or through one reference to a loaded object."""
        n = entries.get("Length")
        if isinstance(n, Ref):
            n = self.objects[n.id].value if n.id in self.objects else None
        return whole(n)

    def _span(self, data: bytes, at: int, entries: dict[str, Any]) -> tuple[int, int] | None:
        """Where stream data begin and where `endstream` ends. /Length counts only if endstream follows."""
        at += data[at : at + 1] == b"\r"
        at += data[at : at + 1] == b"\n"
        n = self._length(entries)
        if n is not None:
            if n > self.options.maxStreamBytes:
                raise limit("Compressed PDF stream exceeds maxStreamBytes.")
            end = BLANK.match(data, at + n).end() if at + n <= len(data) else len(data)
            if data[end : end + 9] == b"endstream" and ends(data, end + 9):
                return at, end + 9
        m = TRUE_END.search(data, at)
        if m is None:
            return None
        if m.start() - at > self.options.maxStreamBytes:
            raise limit("Recovered stream exceeds maxStreamBytes.")
        return at, m.start() + 9

    def _cut(self, raw: bytes, entries: dict[str, Any]) -> bytes:
        n = self._length(entries)
        return bytes(raw[:n] if n is not None and n <= len(raw) else raw)

    def _is_image(self, data: bytes) -> bool:
        at = data.find(b"<<")
        if b"Image" not in data and b"#" not in data:
            return False
        try:
            return at >= 0 and Lexer(data, self.budget, at).dictionary().get("Subtype") == "Image"
        except PdfError:
            return False

    @staticmethod
    def _plain(data: bytes) -> bool:
        """Whether an object is small and its value lies in its bytes alone."""
        return len(data) <= SMALL and b"stream" not in data and b"/Length" not in data and b"#" not in data

    def get(self, id_: int, depth: int = 0) -> Object | None:
        """An object, loaded if need be. Images are not."""
        if (found := self.objects.get(id_)) is not None or not self.indexed:
            return found
        if depth > self.options.maxRecursionDepth:
            raise limit("Object reference nesting exceeds maxRecursionDepth.")
        self.budget.deadline()
        if id_ in self.inner:
            box = self.inner[id_][0]
            if self.get(box, depth + 1) is None:
                return None
            self.expanded.discard(box)
            self.expand(self.objects[box])
            return self.objects.get(id_)
        if id_ not in self.offsets:
            return None
        at, generation, end = self.offsets[id_]
        if end <= at:
            return None
        head = self.data[at : min(end, at + PEEK)]
        self.budget.counts["object_bytes_read"] += len(head)
        if self._is_image(head):
            return None
        if end - at > self.options.maxObjectBytes:
            raise limit("PDF object exceeds maxObjectBytes.")
        self.budget.counts["object_bytes_read"] += end - at - len(head)
        data = bytes(self.data[at:end])
        if self._plain(data) and (same := _small_object(data, self.options)) is not None and same[:2] == (id_, generation):
            self.objects[id_] = self.prepare(Object(id_, generation, same[2], None, at))
            self.budget.counts["objects_loaded"] += 1
            return self.objects[id_]
        m = HEADER.match(data)
        if m is None:
            return None
        if (int(m[1]), int(m[2])) != (id_, generation):
            self.budget.warn(f"Cross-reference object identity mismatch for object {id_}.")
            return None
        first = BLANK.match(data, m.end()).end()
        if data[first : first + 2] == b"<<" and (INDIRECT_LENGTH.search(head) or b"#" in head) and isinstance(n := Lexer(data, self.budget, first).dictionary().get("Length"), Ref):
            self.get(n.id, depth + 1)
        found = self._body(data, m.end(), id_, generation, at)
        if found is None:
            return None
        self.objects[id_] = self.prepare(found[0])
        self.budget.counts["objects_loaded"] += 1
        return self.objects[id_]

    def recover(self) -> None:
        """Every object in the file, a later definition in the place of an earlier one, up to the first that does not end."""
        data, at = self.data, 0
        while m := RECOVERED.search(data, at):
            self.budget.deadline()
            self._trailers(data[at : m.start()])
            id_ = int(m[1])
            found = self._next_small(m.start(1)) or self._body(data, m.end(), id_, int(m[2]), m.start(1))
            if found is None:
                break
            one, end = found
            at = end + 6
            if id_ <= 0:
                continue
            self.budget.objects(len(self.objects) + (id_ not in self.objects))
            if end - m.end() > self.options.maxObjectBytes:
                raise limit("PDF object exceeds maxObjectBytes.")
            if one.entries.get("Subtype") == "Image":
                continue
            if one.entries.get("Type") == "XRef":
                self.trailer |= one.entries
            self.objects[id_] = one
        self._trailers(data[at:])
        counts = self.budget.counts
        counts["objects_indexed"] = counts["objects_loaded"] = len(self.objects)
        counts["object_bytes_read"] = len(data)

    def _next_small(self, at: int) -> tuple[Object, int] | None:
        """A small object without strings or comments, and where its endobj stands; None if it has to be read for itself."""
        end = self.data.find(b"endobj", at, at + SMALL)
        own = bytes(self.data[at : end + 6]) if end >= 0 and ends(self.data, end + 6) else b""
        if not own or b"(" in own or b"%" in own or not self._plain(own) or (same := _small_object(own, self.options)) is None:
            return None
        return Object(same[0], same[1], same[2], None, at), at + same[3]

    def _trailers(self, data: bytes) -> None:
        for m in TRAILER.finditer(data):
            self.trailer |= _dictionary(data, m.end(), self.budget)

    def prepare(self, one: Object) -> Object:
        """Strings decrypted, unless the object came out of a stream."""
        self.generations[one.id] = one.generation
        if self.handler is None or one.inner or one.id == self.encrypt_id or one.entries.get("Type") == "XRef":
            return one

        def plain(x: Any) -> Any:
            if isinstance(x, dict):
                return {k: plain(v) for k, v in x.items()}
            if isinstance(x, list):
                return [plain(v) for v in x]
            if type(x) is not bytes:
                return x
            found = self.handler.decrypt(x, one.id, one.generation, self.handler.strings, self.budget)
            if found is None:
                self.budget.warn(f"String decryption failed on object {one.id}.")
            return found or b""

        one.value = plain(one.value)
        return one

    def expand(self, box: Object) -> None:
        """The members of an object stream; with an index only those it places here, and never over another."""
        if box.entries.get("Type") != "ObjStm" or box.id in self.expanded:
            return
        self.expanded.add(box.id)
        warn = self.budget.warn
        if box.raw is None:
            warn(f"Object stream {box.id} could not be read.")
            return
        plain = self.decode(box)
        if not plain:
            warn(f"Object stream {box.id} produced empty decoded data.")
            return
        n, first = whole(box.entries.get("N")), whole(box.entries.get("First"))
        if n is None or first is None:
            warn(f"Object stream {box.id} missing /N or /First.")
            return
        self.budget.objects(n)
        if first > len(plain):
            warn("Invalid object stream header length.")
            return
        head = re.match(rb"(?:\s*\d+)*", plain[:first])[0].split()[: 2 * n]
        if len(head) < 2 * n:
            warn(f"Object stream {box.id} index is shorter than expected.")
            return
        ids, starts = [int(x) for x in head[::2]], [int(x) for x in head[1::2]]
        body = plain[first:]
        for i, (id_, start, end) in enumerate(zip(ids, starts, [*starts[1:], len(body)], strict=True)):
            if (self.indexed and self.inner.get(id_) != (box.id, i)) or id_ in self.objects:
                continue
            part = body[start:end].strip(b" \t\r\n\0\x0b")
            if part:
                self.objects[id_] = Object(id_, 0, _small_value(part, self.options) if len(part) <= SMALL else Lexer(part, self.budget).value(), None, box.offset + start, True)
                self.budget.objects(len(self.objects))
                self.budget.counts["objects_loaded"] += 1

    def expand_all(self) -> None:
        for box in list(self.objects.values()):
            self.budget.deadline()
            self.expand(box)

    # Values and streams

    def resolve(self, x: Any) -> Any:
        """What a reference leads to, through further ones."""
        if not isinstance(x, Ref):
            return x
        most = self.options.maxRecursionDepth
        if x.id in self.resolving or len(self.resolving) >= most:
            raise limit("Indirect dictionary values exceed the resolution depth limit.")
        start, seen = x.id, set()
        self.resolving.add(start)
        try:
            while isinstance(x, Ref):
                if len(seen) > most:
                    raise limit("Indirect object nesting exceeds maxRecursionDepth.")
                if x.id in seen or (one := self.get(x.id)) is None:
                    return NOTHING
                seen.add(x.id)
                x = one.value
            return x
        finally:
            self.resolving.discard(start)

    def pipeline(self, entries: dict[str, Any]) -> list[tuple[str, dict[str, int]]]:
        names = self.resolve(entries.get("Filter"))
        if entries.get("Filter") is None or names is None:
            return []
        names = names if isinstance(names, list) else [names]
        given = self.resolve(entries.get("DecodeParms", entries.get("DP")))
        given = given if isinstance(given, list) else [given]
        out = []
        for i, name in enumerate(names):
            name = self.resolve(name)
            own = self.resolve(given[i]) if i < len(given) else {}
            own = own if isinstance(own, dict) else {}
            own = own | ({"BitsPerComponent": own["BPC"]} if "BPC" in own and "BitsPerComponent" not in own else {})
            numbers = {"Predictor": 1, "Colors": 1, "BitsPerComponent": 8, "Columns": 1, "EarlyChange": 1}
            for key in numbers:
                value = self.resolve(own.get(key))
                if isinstance(value, int) and not isinstance(value, bool):
                    numbers[key] = value
            out.append((str(name) if isinstance(name, Name) and name else "InvalidFilter", numbers))
        return out

    def decode(self, one: Object) -> bytes:
        """A stream's plain data; empty with a warning where a filter fails."""
        budget, options, data = self.budget, self.options, one.raw or b""
        budget.deadline()
        if len(data) > options.maxStreamBytes:
            raise limit("Compressed PDF stream exceeds maxStreamBytes.")
        if self.handler is not None and 0 < one.id != self.encrypt_id:
            found = self.handler.stream(data, one.id, self.generations.get(one.id, 0), one.entries, self.resolve, budget)
            if found is None:
                budget.warn(f"Stream decryption failed on object {one.id}.")
                return b""
            data = found
        steps = self.pipeline(one.entries)
        if not steps:
            budget.work(len(data))
        for name, p in steps:
            most = options.maxDecodedBytesTotal - budget.counts["decoded_work_bytes"]
            if name == "Crypt":
                found = data if self.handler is not None else None
            elif name in ("FlateDecode", "Fl"):
                found = filters.flate(data, options, most)
            elif name in ("ASCIIHexDecode", "AHx"):
                found = filters.ascii_hex(data)
            elif name in ("ASCII85Decode", "A85"):
                found = filters.ascii85(data, options)
            elif name in ("LZWDecode", "LZW"):
                found = filters.lzw(data, p["EarlyChange"], options, most)
            elif name in ("RunLengthDecode", "RL"):
                found = filters.run_length(data, options)
            else:
                found = None
            if found is None:
                budget.warn(f'Unsupported or failed stream filter "{name}" on object {one.id}.')
                return b""
            if len(found) > options.maxStreamBytes:
                raise limit("Decoded PDF stream exceeds maxStreamBytes.")
            budget.work(len(found))
            if name in ("FlateDecode", "Fl", "LZWDecode", "LZW") and p["Predictor"] > 1:
                found = filters.predict(found, p["Predictor"], p["Colors"], p["BitsPerComponent"], p["Columns"], options)
                if found is None:
                    budget.warn(f'Predictor decode failed for filter "{name}" on object {one.id}.')
                    return b""
            data = found
        budget.decoded(len(data))
        return data

    def start(self, password: bytes) -> bool:
        """Set up decryption; whether the document can be read."""
        given = self.trailer.get("Encrypt")
        if given is not None:
            if isinstance(given, Ref):
                self.encrypt_id = given.id
                one = self.get(given.id)
                given = one.value if one is not None and one.generation == given.generation else None
            ids = self.trailer.get("ID")
            first = ids[0] if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b""
            self.handler = security.authenticate(given, first, password, self.budget)
            if self.handler is None:
                self.budget.warn("Encrypted PDF detected. Extraction quality may be limited.")
                return False
        for i, one in list(self.objects.items()):
            self.objects[i] = self.prepare(one)
        if not self.indexed:
            self.expand_all()
        return True

    # Pages

    def _visit(self, id_: int, seen: set[int]) -> None:
        if id_ in seen:
            raise limit("Page tree contains a repeated object reference.")
        self.budget.objects(len(seen) + 1)
        seen.add(id_)

    def _kids(self, entries: dict[str, Any]) -> list[int]:
        kids = self.resolve(entries.get("Kids"))
        return [k.id for k in kids if isinstance(k, Ref)] if isinstance(kids, list) else []

    def page_ids(self, first: int, last: int | None) -> list[int]:
        """Ids of the pages first to last, in order."""
        if not self.indexed:
            return self._recovered_page_ids(first, last)
        catalog = self.get(self.root) if self.root is not None else None
        if catalog is None:
            raise PdfError(4, "No PDF objects found.")
        top = catalog.entries.get("Pages")
        if not isinstance(top, Ref):
            raise PdfError(NO_PAGES, "No page objects found.")
        seen: set[int] = set()
        out, found = [], 0
        todo: list[tuple[int, int, bool]] = [(top.id, 0, False)]
        while todo and (last is None or found < last):
            id_, depth, child = todo.pop()
            one = self.get(id_) if child else None
            count = whole(one.entries.get("Count")) if one is not None and one.entries.get("Type") == "Pages" else None
            if count and count < first - found:
                self._visit(id_, seen)
                found += count
                continue
            if depth > self.options.maxRecursionDepth:
                raise limit("Page tree exceeds maxRecursionDepth.")
            self.budget.deadline()
            self._visit(id_, seen)
            one = self.get(id_)
            kind = one.entries.get("Type") if one is not None else None
            if kind == "Page":
                found += 1
                if found >= first:
                    out.append(id_)
                    if len(out) > self.options.maxPages:
                        raise limit("Parsed page count exceeds maxPages.")
            elif kind == "Pages":
                todo += [(k, depth + 1, True) for k in reversed(self._kids(one.entries))]
        if not found:
            raise PdfError(NO_PAGES, "No page objects found.")
        return out

    def _recovered_page_ids(self, first: int, last: int | None) -> list[int]:
        most = last if last is not None else first + self.options.maxPages
        catalog = next((o for o in self.objects.values() if o.entries.get("Type") == "Catalog"), None)
        top = catalog.entries.get("Pages") if catalog is not None else None
        out: list[int] = []
        seen: set[int] = set()
        todo = [(top.id, 0)] if isinstance(top, Ref) else []
        while todo and len(out) < most:
            id_, depth = todo.pop()
            if depth > self.options.maxRecursionDepth:
                raise limit("Page tree exceeds maxRecursionDepth.")
            self.budget.deadline()
            self._visit(id_, seen)
            one = self.objects.get(id_)
            kind = one.entries.get("Type") if one is not None else None
            if kind == "Page":
                out.append(id_)
            elif kind == "Pages":
                todo += [(k, depth + 1) for k in reversed(self._kids(one.entries))]
        if not out:
            orphans = sorted((o.offset, o.id) for o in self.objects.values() if o.entries.get("Type") == "Page")
            out = [i for _, i in orphans[:most]]
        if not out:
            raise PdfError(NO_PAGES, "No page objects found.")
        out = out[first - 1 : last]
        if len(out) > self.options.maxPages:
            raise limit("Parsed page count exceeds maxPages.")
        return out

    def contents(self, page: Object) -> list[Object]:
        """A page's content streams. A path may not return to an object, but streams may repeat."""
        count = 0

        def walk(x: Any, path: frozenset[int], depth: int) -> Iterator[Object]:
            nonlocal count
            if isinstance(x, list):
                for item in x:
                    if isinstance(item, Ref):
                        yield from walk(item, path, depth)
                return
            if not isinstance(x, Ref):
                return
            self.budget.deadline()
            count += 1
            if count > self.options.maxArrayElements:
                raise limit("Page content references exceed maxArrayElements.")
            if depth > self.options.maxRecursionDepth:
                raise limit("Content reference nesting exceeds maxRecursionDepth.")
            if x.id in path or (one := self.get(x.id)) is None:
                return
            if one.raw is not None:
                yield one
            elif isinstance(one.value, (list, Ref)):
                yield from walk(one.value, path | {x.id}, depth + 1)

        return list(walk(page.entries.get("Contents"), frozenset(), 0))

    # Resources

    def resources(self, page: Object) -> dict[str, Any]:
        """The page's own resources or else its nearest ancestor's."""
        seen: set[int] = set()
        one: Object | None = page
        while one is not None and one.id not in seen:
            seen.add(one.id)
            found = self.resolve(one.entries.get("Resources"))
            if isinstance(found, dict):
                return found
            up = one.entries.get("Parent")
            one = self.get(up.id) if isinstance(up, Ref) else None
        return {}

    def named(self, resources: dict[str, Any], kind: str) -> dict[str, int]:
        """Name to object id of the entries that are references."""
        found = self.resolve(resources.get(kind))
        return {k: v.id for k, v in found.items() if isinstance(v, Ref)} if isinstance(found, dict) else {}

    def font_map(self, resources: dict[str, Any]) -> dict[str, fonts.Font]:
        out = {}
        for name, id_ in self.named(resources, "Font").items():
            if (font := self.font(id_)) is not None:
                out[name] = font
        return out

    def font(self, id_: int) -> fonts.Font | None:
        if id_ in self.fonts:
            return self.fonts[id_]
        one = self.get(id_)
        if one is None:
            return None
        font = self.fonts[id_] = fonts.font_of(one.entries, self.resolve)
        up = one.entries.get("ToUnicode")
        cmap = self.get(up.id) if isinstance(up, Ref) else None
        if cmap is not None and cmap.raw is not None and (plain := self.decode(cmap)):
            if len(plain) > self.options.maxCMapSize:
                self.budget.warn(f"ToUnicode CMap on object {id_} exceeds configured size — truncated for safety.")
            font.codes, longest = fonts.to_unicode(plain, self.budget)
            if font.codes:
                font.longest = max(font.longest, longest)
        return font

    def release(self, page_id: int) -> None:
        """After a page: its objects and all streams go; everything goes once the rest is over the cache limit."""
        self.objects.pop(page_id, None)
        for i, one in list(self.objects.items()):
            if one.raw is not None:
                del self.objects[i]
                self.expanded.discard(i)
        size = self.budget.cmap_bytes + sum(256 + 16 * len(repr(o.value)) // 16 for o in self.objects.values()) + sum(map(len, self.streams.values()))
        if size > self.options.maxCacheBytes:
            self.objects.clear()
            self.fonts.clear()
            self.streams.clear()
            self.expanded.clear()
            self.budget.cmap_bytes = size = 0
            self.budget.counts["cache_evictions"] += 1
        self.budget.counts["cache_bytes"] = size
