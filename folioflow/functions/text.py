"""Column functions of built-in expressions only: no Python runs for a row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel.dates import SHAPES
from .stopwords import BASE

#: What a document's text drops at its ends.
WHITE = " \t\n\r\x00\x0b"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def trim_both(c: Column, chars: str) -> Column:
    return F.trim(c, F.lit(chars))


#: What `normalize_text` changes other than at the ends: a control character, tab or no-break space, a space before a blank or a line end, a second blank line.
UNEVEN = "[\\x00-\\x20\\u00A0\\u202F](?:(?<=[^\\n ])|(?<= )[ \\n]|(?<=\\n)\\n\\n)"


def normalize_text(c: Column) -> Column:
    """Line ends to LF, control characters out, no-break spaces to spaces, runs of blanks to one, none at line ends, at most one blank line.

    A text that is so already is only looked through once and trimmed."""
    even = _replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    even = _replace(even, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    even = _replace(even, "[ \\t\\u00A0\\u202F]+", " ")
    even = F.replace(even, F.lit(" \n"), F.lit("\n"))
    even = _replace(even, "\\n{3,}", "\n\n")
    return trim_both(F.when(F.regexp_like(c, F.lit(UNEVEN)), even).otherwise(c), " \t\n")


def document_text(pages: Column, first_pages: int | None = None) -> Column:
    """Texts of an array of page structs, trimmed, empty ones dropped, joined by a blank line; of the first pages only, if given."""
    if first_pages is not None:
        if first_pages <= 0:
            return F.lit("")
        pages = F.slice(pages, 1, first_pages)
    texts = F.filter(F.transform(pages, lambda p: trim_both(p["text"], WHITE)), lambda t: t != "")
    return trim_both(F.array_join(texts, "\n\n"), WHITE)


def text_pages(pages: Column) -> Column:
    """array<struct<index, text>> of the pages with text; index counts all pages from 0."""
    found = F.transform(pages, lambda p, i: F.struct(i.alias("index"), trim_both(p["text"], WHITE).alias("text")))
    return F.filter(found, lambda x: x["text"] != "")


def _tokens(c: Column, separator: str, words: Iterable[str]) -> Column:
    # Split first: lower-casing all of Unicode first could make ASCII letters out of others.
    tokens = F.transform(F.split(c, separator), lambda t: F.translate(t, UPPER, LOWER))
    return F.array_join(F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*sorted(words))), " ")


def stopword_filter(c: Column, exclude_numbers: bool = False, preserve_line_breaks: bool = False, extra_words: Iterable[str] = ()) -> Column:
    """Lower-case ASCII tokens of two or more characters that are no stopwords, joined by spaces; by line, if line breaks stay."""
    words = BASE | set(extra_words)
    separator = "[^a-zA-Z]+" if exclude_numbers else "[^a-zA-Z0-9]+"
    if not preserve_line_breaks:
        return _tokens(c, separator, words)
    lines = F.transform(F.split(_replace(c, "\r\n?", "\n"), "\n"), lambda x: _tokens(x, separator, words))
    return trim_both(_replace(F.array_join(lines, "\n"), "\\n{3,}", "\n\n"), "\n")


def pdf_date_to_iso(c: Column) -> Column:
    """A PDF date in ISO form without inventing a zone; anything that is no valid date stays as it is."""
    shapes = F.create_map(*[x for shape, n in SHAPES.items() for x in (F.lit(shape), F.lit(n))])
    n = F.try_element_at(shapes, F.translate(c, "0123456789", "9" * 10))
    digits = F.concat(F.substring(c, F.lit(3), n), F.substring(F.lit("00000101000000"), n + 1, F.lit(14)))
    zone = F.translate(F.substring(c, n + 3, F.lit(7)), "'", "")

    def part(at: int, size: int = 2) -> Column:
        return F.substring(digits, at, size)

    fields = [(1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2)]
    year, month, day, hour, minute, second = (part(*x).cast("int") for x in fields)
    real = F.try_make_timestamp_ntz(year, month, day, hour, minute, F.when(second < 60, second)).isNotNull() & (year >= 1)
    minutes = F.rpad(F.substring(zone, 4, 2), 2, "0")
    near = (F.length(zone) < 2) | ((F.substring(zone, 2, 2) <= "23") & (minutes <= "59"))
    shown = F.when(zone == "", "").when(zone == "Z", "+00:00").otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), minutes))
    iso = F.concat(part(1, 4), *[x for mark, f in zip("--T::", fields[1:], strict=True) for x in (F.lit(mark), part(*f))], shown)
    return F.when(n.isNotNull() & real & near, iso).otherwise(c)


def is_pdf(content: Column) -> Column:
    """Whether a binary column begins with the five header bytes."""
    return F.startswith(content, F.lit(b"%PDF-"))


def pdf_version(content: Column) -> Column:
    """The version in the first 16 bytes, or `unknown`."""
    found = F.regexp_extract(F.decode(F.substring(content, 1, 16), "ISO-8859-1"), "^%PDF-([0-9.]+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def ascii_hex_decode(c: Column) -> Column:
    """ASCIIHexDecode of a string column as binary; null where it isn't valid."""
    raw = F.rtrim(_replace(c, r"[\s\x0B]+", ""), F.lit(">"))
    return F.unhex(F.when(F.length(raw) % 2 == 1, F.concat(raw, F.lit("0"))).otherwise(raw))


def preview(c: Column, most: int = 102_400) -> tuple[Column, Column]:
    """(the first bytes of a text as binary, whether there are more)."""
    return F.substring(c.cast("binary"), 1, most), F.octet_length(c) > most


def cap_warnings(c: Column, most: int = 1000) -> Column:
    """At most so many warnings; if there are more, the last that stays says so."""
    return F.when(F.size(c) > most, F.array_append(F.slice(c, 1, most - 1), F.lit("Additional warnings truncated."))).otherwise(c)
