"""`spark.read.format("pdf")`: pages of PDF files, and how files are found and read.

binaryFile with operators.relations is the way for corpora of millions of files, since Spark lists those itself. This
source lists them on the driver and takes files over binaryFile's 2 GB. Page bounds are options, firstPage and lastPage,
not pushed filters: Spark 4.1 keeps what was pushed for one query on a DataFrame for the next one on it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import is_pdf
from ..kernel.limits import Options, limit
from ..kernel.reader import BROKEN, Reader, check_range, error_of
from ..operators.relations import ERROR, PAGE

MIB = 1 << 20


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class PdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = dict(options)
        self.path = given.pop("path")
        self.first, last = int(given.pop("firstpage", 1)), given.pop("lastpage", None)
        self.last = int(last) if last else None
        self.password = given.pop("password", "").encode()
        self.mode = given.pop("mode", "PERMISSIVE").upper()
        self.bytes = int(given.pop("partitionbytes", 128 * MIB))
        self.options = Options.of(given)
        check_range(self.first, self.last, self.options)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        out, own, size = [], [], 0
        for f in sorted((f for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(".pdf")), key=lambda f: f.path):
            own.append((f.path, f.size))
            size += f.size
            if size >= self.bytes:
                out.append(Files(own))
                own, size = [], 0
        return out + [Files(own)] * bool(own)

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs as pafs

        if self.last is not None and self.last < self.first:
            return
        fs = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
        for path, size in partition.files:
            try:
                if size > self.options.maxInputBytes:
                    raise limit("PDF input exceeds maxInputBytes.")
                with fs.open_input_file(path) as f:
                    data = f.read()
                for p in Reader(data, self.first, self.last, self.password, self.options, size > self.options.streamingThreshold).pages():
                    yield path, p.page_number, p.object_id, p.text, None
            except BROKEN as e:
                if self.mode == "FAILFAST":
                    raise
                yield path, None, None, None, error_of(e)


class PdfSource(DataSource):
    """Options: path, firstPage, lastPage, password, mode, partitionBytes, and the limits by their names. Texts are raw; normalize_text makes them readable.

    A file that fails has a row without a page that holds the error (mode FAILFAST: raises it). One over maxInputBytes is not read.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return f"path string, {PAGE}, {ERROR}"

    def reader(self, schema) -> PdfReader:  # noqa: ANN001
        return PdfReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfSource)


def pdf_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """path, length, content of the *.pdf files below `path` that begin like PDF files; longer ones are not read at all (the length filter reaches the scan)."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    rows = rows.filter(F.col("length") > 0)
    if max_bytes is not None:
        rows = rows.filter(F.col("length") <= max_bytes)
    return rows.filter(is_pdf(F.col("content"))).select("path", "length", "content")


def byte_size(text: str | None) -> int | None:
    """`512M` and the like as bytes (K, M and G); None for none, -1 and what is no size; very large ones stop at 2^63 - 1."""
    import re

    m = re.fullmatch(r"\s*(\d+)\s*([kmgKMG]?)\s*", text or "")
    if m is None:
        return None
    return min(int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()], 2**63 - 1)
