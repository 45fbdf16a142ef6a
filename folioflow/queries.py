"""The library's registered queries and their SQL.

Queries on PDF files write a table's texts as files of some kind, read them back, and are compared with plain SQL
over the texts, which knows nothing of PDF.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import decoders, text
from .functions.stopwords import BASE
from .kernel import fonts
from .operators import relations
from .plans import revisions
from .sources import pdf, sinks
from .sources.scratch import fresh_folder
from .streaming import ingest
from .synth import writer
from .synth.corpus import with_pdf, write_pdfs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lists of pages: conv_id, pages (page_number, text)."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct((F.col("turn") + 1).cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("text")).alias("p"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))


# SQL pieces

WHITE = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"


def sql_normal(x: str) -> str:
    for pattern, by in ((r"\r\n?", "chr(10)"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "''"), ("[\\x{00A0}\\x{202F}]", "' '"), (r"[ \t]+", "' '"), (r" +(\n|$)", r"'\1'"), (r"\n{3,}", "chr(10) || chr(10)")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return f"trim({x}, ' ' || chr(9) || chr(10))"


def sql_words(words: frozenset[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def sql_filter(x: str, pattern: str, words: frozenset[str] = BASE) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '{pattern}'), lambda t: lower(t)), lambda t: length(t) > 1 AND t NOT IN ({sql_words(words)})), ' ')"


def sql_filter_lines(x: str, pattern: str) -> str:
    lines = f"list_transform(string_split(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), chr(10)), lambda l: {sql_filter('l', pattern)})"
    return f"trim(regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"


WORDS, LETTERS = "[^a-zA-Z0-9]+", "[^a-zA-Z]+"
NORMAL_DOCS = f"SELECT doc_id, {sql_normal('text')} AS text FROM documents"
EXTRA = ("the", "of", "is")

# Keyword filter


def _keywords(sql: str, name: str, **how) -> None:  # noqa: ANN003
    @query(f"SELECT doc_id, {sql} AS keywords FROM documents", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return texts(spark, sf_dir).select("doc_id", text.stopword_filter(F.col("text"), **how).alias("keywords"))


_keywords(sql_filter("text", WORDS), "stopword_default")
_keywords(sql_filter("text", LETTERS), "stopword_no_numbers", exclude_numbers=True)
_keywords(sql_filter_lines("text", WORDS), "stopword_keep_lines", preserve_line_breaks=True)
_keywords(sql_filter_lines("text", LETTERS), "stopword_both", exclude_numbers=True, preserve_line_breaks=True)
_keywords(sql_filter("text", WORDS, BASE | frozenset(EXTRA)), "stopword_extra_words", extra_words=EXTRA)


@query(f"SELECT * FROM (SELECT conv_id, turn, {sql_filter('text', WORDS)} AS keywords FROM conversations) WHERE keywords <> ''")
def filter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.stopword_filter(F.col("text")).alias("keywords"))
    return rows.filter("keywords <> ''")


# Text, pages, dates

NOISE = r"replace(text, '. ', '.' || chr(13) || chr(10) || chr(9) || chr(160) || ' ' || chr(1) || chr(10) || chr(13) || chr(10) || chr(10) || chr(8239) || ' x ')"


@query(f"SELECT doc_id, {sql_normal(NOISE)} AS text FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = "." + "\r\n\t  \x01\n\r\n\n  x "
    return texts(spark, sf_dir).select("doc_id", text.normalize_text(F.replace("text", F.lit(". "), F.lit(noise))).alias("text"))


def _joined(where: str) -> str:
    return f"SELECT conv_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE t <> ''{where}), '') AS text FROM (SELECT conv_id, turn, trim(coalesce(text, ''), {WHITE}) AS t FROM conversations) GROUP BY conv_id"


@query(_joined(""))
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", text.document_text(F.col("pages")).alias("text"))


@query(_joined(" AND turn < 2"))
def document_text_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", text.document_text(F.col("pages"), 2).alias("text"))


@query(f"SELECT conv_id, CAST(turn AS INT) AS index, t AS text FROM (SELECT conv_id, turn, trim(coalesce(text, ''), {WHITE}) AS t FROM conversations) WHERE t <> ''")
def text_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("conv_id", F.explode(text.text_pages(F.col("pages"))).alias("p"))
    return rows.select("conv_id", "p.index", "p.text")


_DATE_CASES = (
    ("yyyyMMddHHmmss", "%Y%m%d%H%M%S", "+02''30''", "%Y-%m-%dT%H:%M:%S", "+02:30"),
    ("yyyyMMdd", "%Y%m%d", "", "%Y-%m-%dT00:00:00", ""),
    ("yyyyMM", "%Y%m", "Z", "%Y-%m-01T00:00:00", "+00:00"),
    ("yyyy", "%Y", "", "%Y-01-01T00:00:00", ""),
    ("yyyyMMddHHmm", "%Y%m%d%H%M", "-07", "%Y-%m-%dT%H:%M:00", "-07:00"),
)


@query(
    "SELECT o_orderkey, CASE o_orderkey % 7 "
    + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{iso}') || '{zone}'" for i, (_, _, _, iso, zone) in enumerate(_DATE_CASES))
    + " WHEN 5 THEN 'D:20230230' ELSE strftime(o_orderdate, 'D:%Y%m%d%H%M%S') || '+25''00''' END AS iso FROM orders"
)
def pdf_date_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, key = F.col("o_orderdate"), F.col("o_orderkey") % 7
    raw = F.when(key == 5, "D:20230230").when(key == 6, F.concat(F.date_format(day, "'D:'yyyyMMddHHmmss"), F.lit("+25'00'")))
    for i, (fmt, _, zone, _, _) in enumerate(_DATE_CASES):
        raw = raw.when(key == i, F.concat(F.lit("D:"), F.date_format(day, fmt), F.lit(zone.replace("''", "'"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.pdf_date_to_iso(raw).alias("iso"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("%PDF-"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("1."), F.col("doc_id") % 8)).otherwise("x"), F.lit("\n"), F.col("text")))
    return texts(spark, sf_dir).select("doc_id", head.cast("binary").alias("content"))


@query("SELECT doc_id, doc_id % 3 <> 0 AS is_pdf FROM documents")
def is_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heads(spark, sf_dir).select("doc_id", text.is_pdf(F.col("content")).alias("is_pdf"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN '1.' || (doc_id % 8) ELSE 'unknown' END AS version FROM documents")
def pdf_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heads(spark, sf_dir).select("doc_id", text.pdf_version(F.col("content")).alias("version"))


# Stream decoders


def _decoder(name: str, encode: Callable[[bytes], bytes], decode, columns: int = 0) -> None:  # noqa: ANN001
    @query("SELECT doc_id, text FROM documents" if not columns else f"SELECT doc_id, rpad(text, CAST(length(text) + ({columns} - octet_length(encode(text)) % {columns}) % {columns} AS INT), chr(10)) AS text FROM documents", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = with_pdf(texts(spark, sf_dir), lambda r: encode(r["text"].encode()))
        return made.select("doc_id", decode(F.col("content")).cast("string").alias("text"))


_decoder("decode_ascii_hex", writer.hex_encode, lambda c: text.ascii_hex_decode(c.cast("string")))
_decoder("decode_ascii85", writer.ascii85_encode, decoders.ascii85_decode)
_decoder("decode_flate", zlib.compress, decoders.flate_decode)
_decoder("decode_lzw", writer.lzw_encode, decoders.lzw_decode)
_decoder("decode_run_length", writer.run_length_encode, decoders.run_length_decode)
_decoder("decode_chain", lambda d: writer.hex_encode(writer.ascii85_encode(zlib.compress(d))), lambda c: decoders.decode_stream(c, ["ASCIIHexDecode", "ASCII85Decode", "FlateDecode"]))
_decoder("predictor_png", lambda d: writer.png_encode(d, 16, 2), lambda c: decoders.undo_predictor(c, 15, 2, 8, 8), 16)
_decoder("predictor_tiff", lambda d: writer.tiff_encode(d, 8, 2), lambda c: decoders.undo_predictor(c, 2, 2, 8, 8), 16)

# Round trips: one page of a document's text


def _round_trip(name: str, build: Callable[[dict], bytes], sql: str = NORMAL_DOCS, **how) -> None:  # noqa: ANN003
    @query(sql, name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = with_pdf(texts(spark, sf_dir), build)
        return relations.with_text(relations.documents(made, keep=["doc_id"], mode="FAILFAST", **how)).select("doc_id", "text")


def _pages(*contents: bytes, font: bytes = writer.FONT) -> writer.Objects:
    return writer.page_objects(list(contents), font)


def _content(r: dict) -> bytes:
    return writer.lines_content(r["text"])


def _lines(t: str) -> list[bytes]:
    return [writer.literal(x.encode("cp1252", "replace")) for x in t.split("\n")]


#: Words that one array of shown strings takes, well under the reader's limit of elements.
ARRAY_WORDS = 5000


def _kerned(r: dict) -> bytes:
    """A line is an array of its words with gaps between; a long line is several, each after the first beginning with the gap."""
    rows = []
    for x in r["text"].split("\n"):
        words = [writer.literal(w.encode("cp1252", "replace")) for w in x.split(" ")]
        parts = [b" -300 ".join(words[k : k + ARRAY_WORDS]) for k in range(0, len(words), ARRAY_WORDS)]
        rows.append(b"[" + b"] TJ [-300 ".join(parts) + b"] TJ")
    return b"BT /F1 9 Tf " + b" T* ".join(rows) + b" ET"


def _in_form(r: dict) -> bytes:
    objects = _pages(b"/Fm Do")
    objects[2] = objects[2].replace(b"/Resources <<", b"/Resources << /XObject << /Fm 90 0 R >>")
    objects[90] = writer.stream(_content(r), b"/Type /XObject /Subtype /Form")
    return writer.classic(objects)


def _with_image(r: dict) -> bytes:
    image = b"BI /W 3 /H 2 /BPC 8 /CS /RGB ID " + b"EI BT (no) Tj ET E" + b" EI "
    return writer.classic(_pages(image + _content(r)))


def _split(r: dict) -> bytes:
    data = _content(r)
    cut = data.find(b" Tj") + 1  # between an operand and its operator
    objects = _pages(b"[91 0 R 92 0 R]")
    objects[91], objects[92] = writer.stream(zlib.compress(data[:cut]), b"/Filter /FlateDecode"), writer.stream(data[cut:])
    return writer.classic(objects)


def _mapped(r: dict) -> bytes:
    """Two-byte codes of its own numbering, and a ToUnicode map."""
    letters = sorted(set(r["text"]) - {"\n"})
    code = {c: b"%04X" % (i + 1) for i, c in enumerate(letters)}
    rows = [b"<" + b"".join(code[c] for c in x) + b"> Tj" for x in r["text"].split("\n")]
    cmap = b"begincmap " + b"".join(b"1 beginbfchar <%s> <%s> endbfchar " % (code[c], c.encode("utf-16-be").hex().encode()) for c in letters)
    objects = _pages(b"BT /F1 9 Tf " + b" T* ".join(rows) + b" ET", font=b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode 93 0 R >>")
    objects[93] = writer.stream(cmap)
    return writer.classic(objects)


def _wide(r: dict) -> bytes:
    rows = [b"<" + x.encode("utf-16-be").hex().encode() + b"> Tj" for x in r["text"].split("\n")]
    return writer.classic(_pages(b"BT /F1 9 Tf " + b" T* ".join(rows) + b" ET", font=b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H >>"))


def _differing(r: dict) -> bytes:
    """e and a trade their codes."""
    font = b"<< /Type /Font /Subtype /TrueType /BaseFont /X /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [97 /e 101 /a] >> >>"
    return writer.classic(_pages(writer.lines_content(r["text"].translate({97: 101, 101: 97})), font=font))


def _mac(r: dict) -> bytes:
    font = b"<< /Type /Font /Subtype /TrueType /BaseFont /X /Encoding /MacRomanEncoding >>"
    return writer.classic(_pages(writer.lines_content(r["text"], encoding="mac_roman"), font=font))


def _revised(r: dict) -> bytes:
    base = writer.classic(_pages(b"BT /F1 9 Tf (old) Tj ET"))
    return writer.update(base, {6: writer.stream(_content(r))}, generations={6: 0})


def _orphan(r: dict) -> bytes:
    objects = _pages(_content(r))
    objects[1] = b"<< /Type /Catalog >>"
    objects[5] = objects[5].replace(b"/Parent 2 0 R", b"/Resources << /Font << /F1 3 0 R >> >>")
    return writer.classic(objects, xref=False)


def _filtered(r: dict) -> bytes:
    data = writer.png_encode(_content(r).replace(b"\n", b" "), 32)
    chain = b"/Filter [/ASCII85Decode /FlateDecode] /DecodeParms [null << /Predictor 15 /Columns 32 >>]"
    return writer.classic(_pages(writer.stream(writer.ascii85_encode(zlib.compress(data)), chain)))


def _join(rows: list[bytes], by: bytes) -> bytes:
    return b"BT /F1 9 Tf " + by.join(x + b" Tj" for x in rows) + b" ET"


_round_trip("round_trip", lambda r: writer.classic(_pages(_content(r))))
_round_trip("tj_kerning", lambda r: writer.classic(_pages(_kerned(r))))
_round_trip("td_newlines", lambda r: writer.classic(_pages(_join(_lines(r["text"]), b" 0 -14 Td "))))
_round_trip("tm_newlines", lambda r: writer.classic(_pages(_join(_lines(r["text"]), b" 1 0 0 1 0 0 Tm "))))
_round_trip("quote_ops", lambda r: writer.classic(_pages(b"BT /F1 9 Tf " + b" ".join(x + (b" '" if i % 2 else b' "') for i, x in enumerate(_lines(r["text"]))) + b" ET")))
_round_trip("form_xobject", _in_form)
_round_trip("inline_image", _with_image)
_round_trip("split_streams", _split)
_round_trip("to_unicode", _mapped)
_round_trip("identity_h", _wide)
_round_trip("differences", _differing)
_round_trip("mac_roman", _mac)
_round_trip("xref_stream", lambda r: writer.compressed(_pages(_content(r)), predictor=True))
_round_trip("hybrid_xref", lambda r: writer.compressed(_pages(_content(r)), hybrid=True))
_round_trip("incremental", _revised)
_round_trip("linearized", lambda r: writer.linearized(_pages(_content(r))))
_round_trip("recovery", lambda r: writer.classic(_pages(_content(r)), xref=False))
_round_trip("orphan_pages", _orphan)
_round_trip("filter_pipeline", _filtered)

# The other filters and malformed cases of inline images, encodings, maps, names, states, limits


def _image(head: bytes, data: bytes) -> Callable[[dict], bytes]:
    """The text, an inline image and a last word that is only read where the image's end is certain."""

    def build(r: dict) -> bytes:
        return writer.classic(_pages(_content(r) + b" BI /W 4 /H 4 " + head + b" ID " + data + b" EI BT /F1 9 Tf (after) Tj ET"))

    return build


SAMPLES = b"EI (x) Tj ET " * 20
JPEG = b"\xff\xd8\xff\xe0\x00\x06EI (\xff\xda\x00\x02" + b"EI \xff\x00 \xff\xd3 > ~> EI"
AFTER = f"SELECT doc_id, trim(text || chr(10) || 'after', ' ' || chr(10)) AS text FROM ({NORMAL_DOCS})"
for _name, _head, _data in (
    ("inline_jpeg", b"/F /DCT", JPEG + b"\xff\xd9"),
    ("inline_flate", b"/Filter /FlateDecode", zlib.compress(SAMPLES)),
    ("inline_lzw", b"/F [/LZW]", writer.lzw_encode(SAMPLES)),
    ("inline_run_length", b"/F /RL", writer.run_length_encode(SAMPLES)),
    ("inline_ascii_hex", b"/F /AHx", writer.hex_encode(SAMPLES)),
    ("inline_ascii85", b"/F /A85", writer.ascii85_encode(SAMPLES)),
    ("inline_mask", b"/IM true", b"EI (\n"),
):
    _round_trip(_name, _image(_head, _data), AFTER)
for _name, _data in (("inline_jpeg_short_segment", b"\xff\xd8\xff\xe0\x00\x01 \xff\xd9"), ("inline_jpeg_second_start", b"\xff\xd8 \xff\xd8 \xff\xd9"), ("inline_jpeg_long_segment", b"\xff\xd8\xff\xe0\xff\xf0 \xff\xd9")):
    _round_trip(_name, _image(b"/F /DCT", _data))


def _coded(name: str, font: bytes, table: list[str]) -> None:
    """The ASCII codes of the texts in a font that means something else by them."""
    own = [(chr(i), c) for i, c in enumerate(table) if 0x20 <= i < 0x7F and c != chr(i)]
    ascii_only = "regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')"
    plain, shown = ("".join(x[k] for x in own).replace("'", "''") for k in (0, 1))

    def build(r: dict) -> bytes:
        rows = [writer.literal(bytes(ord(c) if c < "\x80" else 63 for c in x)) for x in r["text"].split("\n")]
        return writer.classic(_pages(_join(rows, b" T* "), font=b"<< /Type /Font /Subtype /Type1 %s >>" % font))

    _round_trip(name, build, f"SELECT doc_id, {sql_normal(f"translate({ascii_only}, '{plain}', '{shown}')")} AS text FROM documents")


_coded("standard_encoding", b"/BaseFont /X", fonts.STANDARD)
_coded("symbol_encoding", b"/BaseFont /Symbol", fonts.SYMBOL)
_coded("dingbats_encoding", b"/BaseFont /ZapfDingbats", fonts.DINGBATS)


def _ranged(r: dict) -> bytes:
    """Two-byte codes that are the letters' own points, in a map of ranges: one counted up, one a list."""
    rows = [b"<" + x.encode("utf-16-be").hex().encode() + b"> Tj" for x in r["text"].split("\n")]
    cmap = b"begincmap 2 beginbfrange <0020> <006F> <0020> <0070> <0072> [<0070> <0071> <0072>] endbfrange 1 beginbfrange <0073> <017F> <0073> endbfrange"
    objects = _pages(b"BT /F1 9 Tf " + b" T* ".join(rows) + b" ET", font=b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode 93 0 R >>")
    objects[93] = writer.stream(cmap)
    return writer.classic(objects)


def _indirect_length(r: dict) -> bytes:
    objects = _pages(b"[95 0 R]")
    data = _content(r)
    objects[95] = b"<< /Length 96 0 R >>\nstream\n" + data + b"\nendstream"
    objects[96] = b"%d" % len(data)
    return writer.classic(objects)


def _hex_names(r: dict) -> bytes:
    return writer.classic({i: x.replace(b"/Contents", b"/Con#74ents") if isinstance(x, bytes) else x for i, x in _pages(_content(r)).items()})


def _states(r: dict) -> bytes:
    """q and Q around a font that isn't there, so its state would show."""
    return writer.classic(_pages(b"BT /F1 9 Tf q /Nope 9 Tf Q " + _content(r)[len(b"BT /F1 9 Tf ") :]))


def _operands(r: dict) -> bytes:
    """More operands than are kept, before the text."""
    return writer.classic(_pages(b"0 " * 1500 + b"re " + _content(r)))


_round_trip("bfrange", _ranged)
_round_trip("indirect_length", _indirect_length)
_round_trip("hex_names", _hex_names)
_round_trip("saved_states", _states)
_round_trip("many_operands", _operands)


def _limited(name: str, option: str, most: int, message: str) -> None:
    """A limit that every text meets, or none does."""
    code = 7

    @query(f"SELECT doc_id, CAST({code} AS INT) AS code, '{message}' AS message FROM documents", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = with_pdf(texts(spark, sf_dir), lambda r: writer.classic(_pages(_content(r))))
        found = relations.documents(made, keep=["doc_id"], options={option: most})
        return found.select("doc_id", "error.code", "error.message")


_limited("limit_input", "maxInputBytes", 100, "PDF input exceeds maxInputBytes.")
_limited("limit_operators", "maxContentOperators", 1, "Content operators exceed maxContentOperators.")


# Several pages


def _conversation_pdf(r: dict) -> bytes:
    return writer.classic(_pages(*(writer.lines_content(p["text"]) for p in r["pages"])))


def _conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pdf(turns(spark, sf_dir), _conversation_pdf)


PAGE_ROWS = f"SELECT conv_id, CAST(turn + 1 AS INT) AS page_number, {sql_normal('text')} AS text FROM conversations"


@query(f"{PAGE_ROWS} WHERE turn BETWEEN 1 AND 2")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.pages(_conversation_files(spark, sf_dir), first=2, last=3, keep=["conv_id"]).drop("object_id")


@query("SELECT conv_id, CAST(count(*) AS INT) AS page_count FROM conversations GROUP BY conv_id")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.documents(_conversation_files(spark, sf_dir), keep=["conv_id"]).select("conv_id", "page_count")


@query(f"SELECT conv_id, page_number, text, CAST(NULL AS INT) AS code FROM ({PAGE_ROWS}) WHERE conv_id % 3 <> 0 UNION ALL SELECT DISTINCT conv_id, NULL, NULL, 3 FROM conversations WHERE conv_id % 3 = 0")
def page_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a PDF header among others: a row that says so in place of pages."""
    made = with_pdf(turns(spark, sf_dir), lambda r: _conversation_pdf(r)[r["conv_id"] % 3 == 0 :])
    found = relations.pages(made, keep=["conv_id"], errors=True)
    return found.select("conv_id", "page_number", "text", "error.code")


@query(f"{PAGE_ROWS} WHERE turn BETWEEN 1 AND 2")
def page_range_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_pdf(turns(spark, sf_dir), lambda r: writer.classic(_pages(*(writer.lines_content(p["text"]) for p in r["pages"])), xref=False))
    return relations.pages(made, first=2, last=3, keep=["conv_id"]).drop("object_id")


@query(PAGE_ROWS)
def pages_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations.register(spark)
    _conversation_files(spark, sf_dir).select("conv_id", "content").createOrReplaceTempView("_conversation_files")
    rows = spark.sql("SELECT f.conv_id, p.page_number, p.text FROM _conversation_files f, LATERAL pdf_pages(f.content) p")
    return rows.withColumn("text", text.normalize_text(F.col("text")))


@query("SELECT conv_id, CAST(3 + 2 * count(*) AS BIGINT) AS objects, count(*) AS streams FROM conversations GROUP BY conv_id")
def object_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relations.objects(_conversation_files(spark, sf_dir), keep=["conv_id"])
    return found.groupBy("conv_id").agg(F.count("*").alias("objects"), F.count("stream_bytes").alias("streams"))


@query("SELECT conv_id, CAST(3 + 2 * count(*) AS BIGINT) AS entries, true AS in_order FROM conversations GROUP BY conv_id")
def xref_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relations.xref(_conversation_files(spark, sf_dir), keep=["conv_id"])
    return found.groupBy("conv_id").agg(F.count("*").alias("entries"), F.every(F.col("next_offset") > F.col("offset")).alias("in_order"))


@query("SELECT conv_id, CAST(turn + 1 AS INT) AS page_number, CAST(len(string_split(text, chr(10))) AS BIGINT) AS strings FROM conversations")
def token_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relations.tokens(_conversation_files(spark, sf_dir), keep=["conv_id"]).filter("type = 'string'")
    return found.groupBy("conv_id", "page_number").agg(F.count("*").alias("strings"))


# Security


def _locked(revision: int, name: str, table_name: str, key: str, user: bytes = b"", **how) -> None:  # noqa: ANN003
    def build(r: dict) -> bytes:
        lock = writer.Lock(revision, user, document_id=b"%016d" % r[key], **how)
        return writer.encrypted([writer.lines_content(r["text"])], lock, {"Title": b"No %d" % r[key]})

    @query(f"SELECT {key}, {sql_normal('text')} AS text, 'No ' || {key} AS title, false AS is_encrypted, true AS is_decrypted FROM {table_name}", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = with_pdf(table(spark, sf_dir, table_name).select(key, "text"), build).withColumn("secret", F.lit(user.decode()))
        found = relations.with_text(relations.documents(made, keep=[key], password="secret"))
        return found.select(key, "text", F.col("details")["Title"].alias("title"), "is_encrypted", "is_decrypted")


_locked(2, "encrypted_r2", "benchmark", "item_id", b"secret")
_locked(3, "encrypted_r3", "benchmark", "item_id")
_locked(4, "encrypted_r4", "benchmark", "item_id", b"secret")
_locked(4, "encrypted_r4_rc4", "benchmark", "item_id", stream_method="V2", string_method="V2")
_locked(4, "encrypted_r4_identity", "benchmark", "item_id", stream_method="None", clear_metadata=True)
_locked(5, "encrypted_r5", "benchmark", "item_id", b"secret")
_locked(6, "encrypted_r6", "benchmark", "item_id", b"secret")
_locked(4, "encrypted_r4_documents", "documents", "doc_id", b"secret")
_locked(6, "encrypted_r6_documents", "documents", "doc_id", b"secret")


@query("SELECT item_id, CAST(0 AS INT) AS page_count, true AS is_encrypted, 'Encrypted PDF detected. Extraction quality may be limited.' AS warning, CAST(0 AS INT) AS n_details FROM benchmark")
def wrong_password(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(r: dict) -> bytes:
        return writer.encrypted([writer.lines_content(r["text"])], writer.Lock(4, b"secret"), {"Title": b"hidden"})

    made = with_pdf(table(spark, sf_dir, "benchmark").select("item_id", "text"), build).withColumn("secret", F.lit("wrong"))
    found = relations.documents(made, keep=["item_id"], password="secret")
    return found.select("item_id", "page_count", "is_encrypted", F.col("warnings")[0].alias("warning"), F.size("details").alias("n_details"))


# Details, metrics, limits


@query("SELECT doc_id, source AS title, lang AS author, '2024-02-29T12:00:00+05:30' AS created, CAST(NULL AS VARCHAR) AS subject FROM documents")
def info_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(r: dict) -> bytes:
        info = b"<< /Title %s /Author <FEFF%s> /CreationDate (D:20240229120000+05'30') /Trapped /False >>" % (writer.literal(r["source"].encode()), r["lang"].encode("utf-16-be").hex().encode())
        return writer.classic(writer.page_objects([writer.lines_content(r["text"])], info=info), b"/Info 4 0 R")

    made = with_pdf(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), build)
    d = F.col("details")
    return relations.documents(made, keep=["doc_id"]).select("doc_id", d["Title"].alias("title"), d["Author"].alias("author"), d["CreationDate"].alias("created"), d["Subject"].alias("subject"))


@query("SELECT doc_id, '•™€ﬁ' || source AS title FROM documents")
def info_pdf_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title in the single-byte encoding of document strings."""

    def build(r: dict) -> bytes:
        return writer.classic(writer.page_objects([b""], info=b"<< /Title %s >>" % writer.literal(b"\x80\x92\xa0\x93" + r["source"].encode())), b"/Info 4 0 R")

    made = with_pdf(table(spark, sf_dir, "documents").select("doc_id", "source"), build)
    return relations.documents(made, keep=["doc_id"]).select("doc_id", F.col("details")["Title"].alias("title"))


def _hex_page(r: dict) -> bytes:
    """The text as one string, with a line end after it in 20 bytes of operators. The end of a text object ends no line where nothing
    was shown, so the string of an empty text is its line end."""
    shown = r["text"].encode("cp1252", "replace").hex().encode()
    return writer.classic(_pages(b"BT /F1 9 Tf <" + shown + b"> Tj ET" if shown else b"BT/F1 9 Tf <0A> Tj n"))


@query("SELECT doc_id, CAST(2 * length(text) + 20 AS BIGINT) AS decoded_bytes, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS generated_text_bytes, CAST(4 AS BIGINT) AS content_operators FROM documents")
def metrics_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metrics")
    found = relations.documents(with_pdf(texts(spark, sf_dir), _hex_page), keep=["doc_id"])
    return found.select("doc_id", m["decoded_bytes"].alias("decoded_bytes"), m["generated_text_bytes"].alias("generated_text_bytes"), m["content_operators"].alias("content_operators"))


@query(
    "SELECT doc_id, CASE WHEN bytes >= 1000 THEN 7 ELSE 0 END AS code, CASE WHEN n > 1000 THEN 'Text operand exceeds maxExtractedTextBytes.' "
    "WHEN bytes > 1000 THEN 'Extracted text exceeds maxExtractedTextBytes.' WHEN bytes = 1000 THEN 'Generated text exceeds maxExtractedTextBytes.' END AS message, "
    "CASE WHEN bytes >= 1000 THEN 0 ELSE 1 END AS page_count FROM (SELECT doc_id, length(text) AS n, octet_length(encode(text)) AS bytes FROM documents)"
)
def limit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text in bytes of its font, in UTF-8, and with a line end after it, against a limit of 1000."""
    found = relations.documents(with_pdf(texts(spark, sf_dir), _hex_page), keep=["doc_id"], options={"maxExtractedTextBytes": 1000})
    return found.select("doc_id", F.coalesce(F.col("error")["code"], F.lit(0)).alias("code"), F.col("error")["message"].alias("message"), "page_count")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 5 END AS code, CASE WHEN doc_id % 2 = 0 THEN 'Invalid PDF header.' ELSE 'No page objects found.' END AS message FROM documents")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(r: dict) -> bytes:
        return r["text"].encode() if r["doc_id"] % 2 == 0 else writer.classic({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [] /Count 0 >>"})

    found = relations.documents(with_pdf(texts(spark, sf_dir), build), keep=["doc_id"])
    return found.select("doc_id", "error.code", "error.message")


@query(
    "SELECT conv_id, CASE WHEN count(*) > 3 THEN list_append(list_slice(list(text ORDER BY turn), 1, 2), 'Additional warnings truncated.') ELSE list(text ORDER BY turn) END AS warnings "
    "FROM conversations GROUP BY conv_id"
)
def warnings_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", text.cap_warnings(F.transform("pages", lambda p: p["text"]), 3).alias("warnings"))


# Relational forms


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def xref_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("gone"))
    return revisions.latest_revision(log, ["user_id"], "event_id", "gone").drop("gone")


@query("SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_offset FROM (SELECT DISTINCT user_id, event_id FROM events)")
def xref_next_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.next_boundary(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


_TREE = """
SELECT n_regionkey AS tree, CAST(1000 + n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS parent, n_nationkey AS position, false AS is_page FROM nation
UNION ALL SELECT n_regionkey, CAST(100000 + c_custkey AS BIGINT), CAST(1000 + n_nationkey AS BIGINT), c_custkey, true FROM customer JOIN nation ON c_nationkey = n_nationkey
"""


@query(
    f"WITH RECURSIVE nodes AS ({_TREE}), walk(tree, id, path, is_page) AS (SELECT CAST(r_regionkey AS BIGINT), CAST(r_regionkey AS BIGINT), '', false FROM region UNION ALL "
    "SELECT n.tree, n.id, w.path || lpad(CAST(n.position AS VARCHAR), 8, '0'), n.is_page FROM walk w JOIN nodes n ON n.tree = w.tree AND n.parent = w.id) "
    "SELECT tree, id, CAST(row_number() OVER (PARTITION BY tree ORDER BY path) AS INT) AS page_number FROM walk WHERE is_page"
)
def page_tree_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer, region = (table(spark, sf_dir, name) for name in ("nation", "customer", "region"))
    row = lambda i, parent, position, leaf: [F.col("n_regionkey").cast("long").alias("tree"), i.cast("long").alias("id"), parent.cast("long").alias("parent"), position.cast("long").alias("position"), F.lit(leaf).alias("is_page")]
    box = F.col("n_nationkey") + 1000
    nodes = nation.select(*row(box, F.col("n_regionkey"), F.col("n_nationkey"), False))
    leaves = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(*row(F.col("c_custkey") + 100000, box, F.col("c_custkey"), True))
    key = F.col("r_regionkey").cast("long")
    return revisions.page_order(nodes.unionByName(leaves), region.select(key.alias("tree"), key.alias("id")))


# Files: source, stream, sinks


def _written(spark: SparkSession, sf_dir: str) -> str:
    folder = fresh_folder(spark, "pdf-files")
    write_pdfs(_conversation_files(spark, sf_dir), folder, "conv_id")
    return folder


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.regexp_extract("path", r"(-?\d+)\.pdf$", 1).cast("long").alias("conv_id"), "page_number", text.normalize_text(F.col("text")).alias("text"))


@query(PAGE_ROWS)
def pdf_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdf.register(spark)
    return _named(spark.read.format("pdf").load(_written(spark, sf_dir)).filter("error is null"))


@query("SELECT conv_id, CAST(7 AS INT) AS code FROM conversations GROUP BY conv_id")
def pdf_source_too_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit below every file's size, which is known before a file is read."""
    pdf.register(spark)
    rows = spark.read.format("pdf").option("maxInputBytes", 100).load(_written(spark, sf_dir))
    return rows.select(F.regexp_extract("path", r"(-?\d+)\.pdf$", 1).cast("long").alias("conv_id"), "error.code")


@query(PAGE_ROWS)
def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(relations.pages(pdf.pdf_files(spark, _written(spark, sf_dir), 1 << 28).select("path", "content")))


@query(PAGE_ROWS)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir)
    out = fresh_folder(spark, "pdf-pages")
    ingest.ingest(ingest.page_stream(spark, folder), out, fresh_folder(spark, "pdf-checkpoint")).awaitTermination()
    return _named(spark.read.parquet(out))


_KEYWORD_DOCS = f"SELECT conv_id, string_agg(t, ' ' ORDER BY turn) AS text FROM (SELECT conv_id, turn, {sql_filter('text', WORDS)} AS t FROM conversations) WHERE t <> '' GROUP BY conv_id"


@query(f"SELECT conv_id, text, CAST(octet_length(encode(text)) AS INT) AS text_bytes, left(text, 500) AS preview, octet_length(encode(text)) > 500 AS preview_truncated FROM ({_KEYWORD_DOCS})")
def text_sink_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations.pages(_conversation_files(spark, sf_dir), keep=["conv_id"])
    docs = sinks.keyword_documents(rows, "conv_id")
    head, more = text.preview(F.col("text"), 500)
    return docs.select("conv_id", "text", "text_bytes", head.cast("string").alias("preview"), more.alias("preview_truncated"))


@query(f"SELECT conv_id, text FROM ({_KEYWORD_DOCS})")
def text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sinks.keyword_documents(relations.pages(_conversation_files(spark, sf_dir), keep=["conv_id"]), "conv_id")
    out = fresh_folder(spark, "pdf-texts")
    sinks.write_text(docs.withColumn("text", F.concat_ws("\t", "conv_id", "text")), out)
    rows = spark.read.text(out, lineSep="\n\x0c\n")
    return rows.select(F.substring_index("value", "\t", 1).cast("long").alias("conv_id"), F.substring_index("value", "\t", -1).alias("text"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS page_count, '1.7' AS pdf_version FROM conversations GROUP BY conv_id")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_folder(spark, "pdf-metadata")
    sinks.write_metadata(relations.with_text(relations.documents(_conversation_files(spark, sf_dir), keep=["conv_id"])), out)
    return spark.read.json(out).select("conv_id", "page_count", "pdf_version")


FLAGSHIP_SQL = f"SELECT conv_id, string_agg(t, ' ' ORDER BY turn) AS keywords, count(*) AS n_pages FROM (SELECT conv_id, turn, {sql_filter('text', WORDS)} AS t FROM conversations) WHERE t <> '' GROUP BY conv_id"


@query(FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, pages, keyword filter, joined in page order: a document's row carries its pages, so nothing is shuffled after the scan."""
    found = relations.documents(_conversation_files(spark, sf_dir), keep=["conv_id"])
    pages = F.filter(F.transform("pages", lambda p: text.stopword_filter(p["text"])), lambda t: t != "")
    return found.select("conv_id", pages.alias("ts")).filter(F.size("ts") > 0).select("conv_id", F.array_join("ts", " ").alias("keywords"), F.size("ts").cast("long").alias("n_pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
