"""A corpus of PDF files as relations: documents, pages, objects, cross-reference entries, content tokens.

Input is any DataFrame with a binary column (spark.read.format("binaryFile"), or bytes from a table).
A document is the unit of work; batches are small because its rows are large. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import document_text, normalize_text
from ..kernel.document import Store
from ..kernel.lexer import ContentLexer
from ..kernel.limits import COUNTERS, READ_FAILED, Budget, Options, PdfError
from ..kernel.reader import BROKEN, Reader, check_range, error_of

ERROR = "error struct<code: int, message: string>"
PAGE = "page_number int, object_id int, text string"
METRICS = ", ".join([f"{n}: bigint" for n in COUNTERS] + ["streaming_path: boolean", "recovery_path: boolean", "first_page_ms: double", "duration_ms: double", "peak_memory_bytes: bigint"])
DOCUMENT = (
    f"pages array<struct<{PAGE.replace(' int', ': int').replace(' string', ': string')}>>, pdf_version string, is_encrypted boolean, is_decrypted boolean, "
    f"details map<string,string>, warnings array<string>, page_count int, metrics struct<{METRICS}>, error struct<code: int, message: string>"
)

#: Most rows of a batch that is given back, and about its most bytes.
ROWS, BYTES = 1000, 1 << 20


def _keep(df: DataFrame, content: str, password: str | None, keep: list[str] | None) -> tuple[DataFrame, list[str]]:
    names = [c for c in df.columns if c not in (content, password)] if keep is None else keep
    secret = F.col(password) if password else F.lit(None).cast("string")
    return df.select(*names, F.col(content).alias("_content"), secret.alias("_password")), names


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _weight(row: dict) -> int:
    """About the bytes that a row holds, its texts above all."""
    return 100 + sum(len(v) if isinstance(v, (str, bytes)) else sum(len(x["text"]) for x in v) if k == "pages" else 0 for k, v in row.items())


def _run(df: DataFrame, names: list[str], columns: str, each, options: Options) -> DataFrame:  # noqa: ANN001
    """`each(bytes, password)` gives the rows of a document as dicts; kept columns are repeated beside them. Rows of several
    documents share a batch, up to `ROWS` of them or `BYTES`."""
    out = StructType([df.schema[n] for n in names] + StructType.fromDDL(columns).fields)
    kept, own = _arrow(StructType([df.schema[n] for n in names])), _arrow(StructType.fromDDL(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents, secrets = b.column(len(names)), b.column(len(names) + 1)
            at: list[int] = []
            rows: list[dict] = []
            size = 0
            for i in range(b.num_rows):
                data = contents[i].as_py()
                if data is None:
                    continue
                for row in each(data, (secrets[i].as_py() or "").encode()):
                    at.append(i)
                    rows.append(row)
                    size += _weight(row)
                    if len(rows) >= ROWS or size >= BYTES:
                        yield _batch(b, at, rows)
                        at, rows, size = [], [], 0
            if rows:
                yield _batch(b, at, rows)

    def _batch(b: pa.RecordBatch, at: list[int], rows: list[dict]) -> pa.RecordBatch:
        index = pa.array(at, pa.int32())
        cols = [b.column(k).take(index).cast(kept.field(k).type) for k in range(len(names))]
        cols += [pa.array([r[f.name] for r in rows], f.type) for f in own]
        return pa.RecordBatch.from_arrays(cols, names=[*names, *own.names])

    return df.mapInArrow(run, out)


def documents(df: DataFrame, content: str = "content", first: int = 1, last: int | None = None, password: str | None = None, options: dict | None = None, mode: str = "PERMISSIVE", keep: list[str] | None = None) -> DataFrame:
    """One row a document: the kept columns of `df`, then pages, version, flags, details, warnings, metrics, error.

    password: a column that holds one (never a literal, which plans and logs would show). mode: PERMISSIVE records an error and leaves
    no pages; FAILFAST raises it. Null content gives no row.
    """
    limits = Options.of(options)
    check_range(first, last, limits)
    src, names = _keep(df, content, password, keep)

    def each(data: bytes, secret: bytes) -> Iterator[dict]:
        d = Reader(data, first, last, secret, limits).read(mode.upper() != "FAILFAST")
        error = None if d.error is None else {"code": d.error[0], "message": d.error[1]}
        yield {
            "pages": [vars(p) for p in d.pages],
            "pdf_version": d.pdf_version,
            "is_encrypted": d.is_encrypted,
            "is_decrypted": d.is_decrypted,
            "details": list(d.details.items()),
            "warnings": d.warnings,
            "page_count": d.page_count,
            "metrics": d.metrics,
            "error": error,
        }

    found = _run(src, names, DOCUMENT, each, limits)
    normal = F.transform("pages", lambda p: F.struct(p["page_number"].alias("page_number"), p["object_id"].alias("object_id"), normalize_text(p["text"]).alias("text")))
    return found.withColumn("pages", normal)


def with_text(docs: DataFrame, first_pages: int | None = None) -> DataFrame:
    """Document rows with their text: no shuffle, since the pages are there."""
    return docs.withColumn("text", document_text(F.col("pages"), first_pages))


def pages(df: DataFrame, content: str = "content", first: int = 1, last: int | None = None, password: str | None = None, options: dict | None = None, mode: str = "PERMISSIVE", keep: list[str] | None = None, errors: bool = False) -> DataFrame:
    """One row a page, read one by one: pages before an error stay (FAILFAST raises it).

    errors: a column error (code, message) is added, null beside a page; a document that fails has a row with it and no page.
    """
    limits = Options.of(options)
    check_range(first, last, limits)
    src, names = _keep(df, content, password, keep)

    def each(data: bytes, secret: bytes) -> Iterator[dict]:
        try:
            for p in Reader(data, first, last, secret, limits).pages():
                yield vars(p) | {"error": None}
        except BROKEN as e:
            if mode.upper() == "FAILFAST":
                raise
            if errors:
                yield {"page_number": None, "object_id": None, "text": None, "error": dict(zip(("code", "message"), error_of(e), strict=True))}

    found = _run(src, names, PAGE + (f", {ERROR}" if errors else ""), each, limits)
    return found.withColumn("text", normalize_text(F.col("text")))


def _kind(x: object) -> str:
    if isinstance(x, dict):
        return str(x.get("Type", "dictionary"))
    return type(x).__name__.lower()


def objects(df: DataFrame, content: str = "content", password: str | None = None, options: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row an indirect object that can be loaded (images are not): id, generation, type, offset, bytes of its stream, whether it came out of an object stream."""
    limits = Options.of(options)
    src, names = _keep(df, content, password, keep)

    def each(data: bytes, secret: bytes) -> Iterator[dict]:
        store = _store(data, secret, limits)
        if store is None:
            return
        for i in sorted({*store.objects, *store.offsets, *store.inner}):
            one = store.get(i)
            if one is not None:
                yield {"obj_id": i, "generation": one.generation, "type": _kind(one.value), "offset": one.offset, "stream_bytes": None if one.raw is None else len(one.raw), "from_object_stream": one.inner}

    return _run(src, names, "obj_id int, generation int, type string, offset bigint, stream_bytes bigint, from_object_stream boolean", each, limits)


def xref(df: DataFrame, content: str = "content", options: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row an entry of the merged cross-reference index: where the newest revision of each object is."""
    limits = Options.of(options)
    src, names = _keep(df, content, None, keep)

    def each(data: bytes, secret: bytes) -> Iterator[dict]:
        store = Store(data, Budget(limits))
        if data[:5] != b"%PDF-" or not store.read_index():
            return
        blank = dict.fromkeys(("offset", "generation", "next_offset", "stream_id", "idx"))
        for i, (at, g, after) in store.offsets.items():
            yield blank | {"obj_id": i, "kind": "offset", "offset": at, "generation": g, "next_offset": after}
        for i, (box, n) in store.inner.items():
            yield blank | {"obj_id": i, "kind": "compressed", "stream_id": box, "idx": n}

    return _run(src, names, "obj_id int, kind string, offset bigint, generation int, next_offset bigint, stream_id int, idx int", each, limits)


def tokens(df: DataFrame, content: str = "content", password: str | None = None, options: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row a top-level token of every page's content streams, for looking into them."""
    limits = Options.of(options)
    src, names = _keep(df, content, password, keep)
    kinds = ("string", "name", "number", "array", "operator")

    def each(data: bytes, secret: bytes) -> Iterator[dict]:
        store = _store(data, secret, limits)
        if store is None:
            return
        for page, id_ in enumerate(store.page_ids(1, None), 1):
            seq = 0
            one = store.get(id_)
            for s in store.contents(one) if one is not None else []:
                lexer = ContentLexer(store.decode(s), store.budget)
                while (t := lexer.token()) is not None:
                    store.budget.operand_bytes = 0
                    seq += 1
                    raw = t[1] if isinstance(t[1], bytes) else str(t[1]).encode()
                    yield {"page_number": page, "seq": seq, "type": kinds[t[0]], "value": bytes(raw)}

    return _run(src, names, "page_number int, seq int, type string, value binary", each, limits)


def _store(data: bytes, secret: bytes, limits: Options) -> Store | None:
    """Objects of a readable file; None if it isn't one or the password is wrong."""
    if data[:5] != b"%PDF-":
        return None
    store = Store(data, Budget(limits))
    if not store.read_index() or store.root is None:
        store = Store(data, Budget(limits))
        store.recover()
    try:
        if not store.start(secret):
            return None
    except PdfError:
        return None
    if not store.indexed:
        store.expand_all()
    return store


def register(spark) -> None:  # noqa: ANN001
    """SQL table function pdf_pages(content, first, last, password), for LATERAL joins."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=PAGE)
    class PdfPages:
        def eval(self, content: bytes, first: int = 1, last: int = None, password: str = ""):  # noqa: ANN201, RUF013
            if content is None:
                return
            for p in Reader(bytes(content), first, last, (password or "").encode()).pages():
                yield p.page_number, p.object_id, p.text

    spark.udtf.register("pdf_pages", PdfPages)


ERROR_TEXT = {1: "The PDF file could not be read."}


def user_message(error):  # noqa: ANN001, ANN201
    """What a user may see of an error struct: unreadable files get a general text."""
    return F.when(error["code"] == 1, ERROR_TEXT[1]).when(error["code"] == READ_FAILED, "The PDF file could not be processed.").otherwise(error["message"])

