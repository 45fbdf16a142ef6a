"""Stream decoders as column functions over binary, in Arrow batches. Null in, or data that are not valid: null out."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel import filters, fonts
from ..kernel.limits import Budget, Options


def _column(fn: Callable[[bytes], bytes | None]) -> Callable[[Column], Column]:
    def run(data: pa.Array) -> pa.Array:
        return pa.array([None if (x := v.as_py()) is None else fn(x) for v in data], pa.binary())

    return lambda c: F.arrow_udf(run, "binary")(c.cast("binary"))  # made when used: workers import this module too


flate_decode = _column(filters.flate)
ascii85_decode = _column(filters.ascii85)
run_length_decode = _column(filters.run_length)
ascii_hex_decode_bytes = _column(filters.ascii_hex)


def lzw_decode(c: Column, early_change: int = 1) -> Column:
    return _column(lambda data: filters.lzw(data, early_change))(c)


def undo_predictor(c: Column, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> Column:
    return _column(lambda data: filters.predict(data, predictor, colors, bits, columns))(c)


def decode_stream(c: Column, steps: list[str]) -> Column:
    """Several filters, by their PDF names, in order."""
    known = {"FlateDecode": filters.flate, "ASCIIHexDecode": filters.ascii_hex, "ASCII85Decode": filters.ascii85, "LZWDecode": filters.lzw, "RunLengthDecode": filters.run_length}

    def run(data: bytes) -> bytes | None:
        for name in steps:
            if data is not None:
                data = known[name](data)
        return data

    return _column(run)(c)


def document_string(c: Column) -> Column:
    """A document's own string (UTF-16BE, UTF-8 or PDFDocEncoding) as text."""

    @F.arrow_udf("string")
    def run(data: pa.Array) -> pa.Array:
        return pa.array([None if (x := v.as_py()) is None else fonts.document_string(x) for v in data], pa.string())

    return run(c)


def parse_cmap(c: Column, max_entries: int = 100_000) -> Column:
    """A ToUnicode CMap's codes (upper-case hex) to text; null beyond `max_entries`."""

    @F.arrow_udf("map<string,string>")
    def run(data: pa.Array) -> pa.Array:
        rows = []
        for v in data:
            try:
                codes, _ = fonts.to_unicode(v.as_py() or b"", Budget(Options(maxCMapEntries=max_entries)))
                rows.append([(k.hex().upper(), t) for k, t in codes.items()])
            except Exception:  # noqa: BLE001  over the limit
                rows.append(None)
        return pa.array(rows, pa.map_(pa.string(), pa.string()))

    return run(c)


def decode_text(c: Column, base_font: str = "Helvetica", subtype: str = "Type1", encoding: str | None = None) -> Column:
    """Bytes shown in a font of that description, as text."""
    entries: dict = {"BaseFont": fonts.Name(base_font), "Subtype": fonts.Name(subtype)}
    if encoding:
        entries["Encoding"] = fonts.Name(encoding)
    font = fonts.font_of(entries, lambda x: x)

    @F.arrow_udf("string")
    def run(data: pa.Array) -> pa.Array:
        return pa.array([None if (x := v.as_py()) is None else fonts.show(x, font, Budget(Options())) for v in data], pa.string())

    return run(c)
