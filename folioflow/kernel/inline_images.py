"""Where the data of an inline image ends: one finder for each filter, from the image's first byte.

A finder returns the place after the data, or None where the data does not say.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from . import filters
from .lexer import BLANK, NAME_TOKEN, OPERATOR, ContentLexer, ends
from .limits import Budget, limit

MOST_KEYS = 64
MOST_SIDE = 1_000_000
DEPTHS = (1, 2, 4, 8, 16)
#: Channels by color space.
CHANNELS = {"G": 1, "DeviceGray": 1, "RGB": 3, "DeviceRGB": 3, "CMYK": 4, "DeviceCMYK": 4}
#: Abbreviated keys.
SHORT = {"Filter": "F", "Width": "W", "Height": "H", "ImageMask": "IM", "BitsPerComponent": "BPC", "ColorSpace": "CS"}
UNCERTAIN = "Unsupported or malformed inline image; remaining content stream skipped."
NO_DICTIONARY = "Malformed inline image dictionary; remaining content stream skipped."

_LINE_END = re.compile(rb"\r\n|[\0\t\n\x0c\r ]|")
_JPEG_MARK = re.compile(rb"\xff+([^\xff])", re.DOTALL)
#: JPEG markers without a segment (stuffed zero, TEM, restarts), start and end of image.
BARE, SOI, EOI = {0x00, 0x01, *range(0xD0, 0xD8)}, 0xD8, 0xD9

Finder = Callable[[bytes, int, Budget], "int | None"]


def after(mark: bytes) -> Finder:
    def find(data: bytes, at: int, budget: Budget) -> int | None:
        found = data.find(mark, at)
        return found + len(mark) if found >= 0 else None

    return find


def run_lengths(data: bytes, at: int, budget: Budget) -> int | None:
    return filters.run_length_end(data, at)


def lzw_codes(data: bytes, at: int, budget: Budget) -> int | None:
    span = filters.lzw_span(data[at:], 1, budget.options, budget.options.maxDecodedBytesTotal)
    return at + span[1] if span and span[1] is not None else None


def deflated(data: bytes, at: int, budget: Budget) -> int | None:
    return filters.flate_end(data, at, budget.options, budget.work)


def jpeg_segments(data: bytes, at: int, budget: Budget) -> int | None:
    """From marker to marker; a marker with a segment says how long that is, and entropy-coded data has none but bare ones."""
    if not data.startswith(bytes((0xFF, SOI)), at):
        return None
    here = at + 2
    while (mark := _JPEG_MARK.search(data, here)) is not None:
        budget.deadline()
        here, code = mark.end(), mark[1][0]
        if here - at > budget.options.maxStreamBytes:
            raise limit("Inline JPEG exceeds maxStreamBytes.")
        if code == EOI:
            return here
        if code in BARE:
            continue
        size = int.from_bytes(data[here : here + 2], "big")
        if code == SOI or size < 2 or here + size > len(data):
            return None
        here += size
    return None


#: Filter names and their short forms.
FINDERS: dict[str, Finder] = {
    "ASCIIHexDecode": after(b">"),
    "AHx": after(b">"),
    "ASCII85Decode": after(b"~>"),
    "A85": after(b"~>"),
    "RunLengthDecode": run_lengths,
    "RL": run_lengths,
    "LZWDecode": lzw_codes,
    "LZW": lzw_codes,
    "FlateDecode": deflated,
    "Fl": deflated,
    "DCTDecode": jpeg_segments,
    "DCT": jpeg_segments,
}


class Image:
    """The dictionary between BI and ID."""

    def __init__(self, entries: dict[str, Any]):
        self.entries = entries

    @classmethod
    def read(cls, lexer: ContentLexer) -> Image | None:
        entries: dict[str, Any] = {}
        for n in range(MOST_KEYS + 1):
            if lexer.at >= len(lexer.data):
                break
            token = lexer.token()
            if token == (OPERATOR, b"ID"):
                break
            if n == MOST_KEYS or token is None or token[0] != NAME_TOKEN:
                return None
            entries[token[1]] = lexer.token()
        return cls(entries)

    def value(self, name: str) -> Any:
        token = self.entries.get(SHORT[name]) or self.entries.get(name)
        return token[1] if token else None

    def number(self, name: str) -> int:
        value = self.value(name)
        return int(value) if isinstance(value, (int, float)) else 0

    def raw_bytes(self) -> int | None:
        """The size of unfiltered samples, rows padded to bytes."""
        bits, channels = self.number("BitsPerComponent"), CHANNELS.get(self.value("ColorSpace"), 0) if isinstance(self.value("ColorSpace"), str) else 0
        if self.value("ImageMask") == b"true":
            bits = channels = 1
        width, height = self.number("Width"), self.number("Height")
        if bits not in DEPTHS or not channels or not 0 < width <= MOST_SIDE or not 0 < height <= MOST_SIDE:
            return None
        return -(-width * bits * channels // 8) * height

    def end(self, data: bytes, at: int, budget: Budget) -> int | None:
        name = self.value("Filter")
        if isinstance(name, list):
            name = name[0][1] if name else None
        if name:
            finder = FINDERS.get(name) if isinstance(name, str) else None
            return finder(data, at, budget) if finder else None
        size = self.raw_bytes()
        if size is not None and size > budget.options.maxStreamBytes:
            raise limit("Inline image exceeds maxStreamBytes.")
        return None if size is None else at + size


def skip(lexer: ContentLexer, budget: Budget) -> None:
    """Past an inline image and its EI; past the whole stream, with a warning, where the end is not certain."""
    data, why = lexer.data, NO_DICTIONARY
    if (image := Image.read(lexer)) is not None:
        start, why = _LINE_END.match(data, lexer.at).end(), UNCERTAIN
        end = image.end(data, start, budget)
        if end is not None and end <= min(len(data), start + budget.options.maxStreamBytes):
            mark = BLANK.match(data, end).end()
            if data.startswith(b"EI", mark) and ends(data, mark + 2):
                lexer.at = mark + 2
                return
    budget.warn(why)
    lexer.at = len(data)
