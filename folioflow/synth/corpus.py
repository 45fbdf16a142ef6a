"""PDF files made of a table's texts, on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of a partition at most, about: their files, and batches of them, stay small however large the table is.
PART_ROWS = 2048


def spread(rows: DataFrame) -> DataFrame:
    """Rows that cost much each, dealt over all cores: a table's own partitions follow its few files and row groups, and some hold
    nothing. They are counted, since a file's size says little of what it holds when its texts repeat."""
    n = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(n, -(-rows.count() // PART_ROWS)))


def with_pdf(rows: DataFrame, build: Callable[[dict], bytes]) -> DataFrame:
    """`rows` with a column content: what `build` makes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                made = pa.array([build(r) for r in part.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "content"])

    return spread(rows).mapInArrow(run, rows.withColumn("content", F.lit(b"")).schema)


def write_pdfs(rows: DataFrame, folder: str, name: str = "id") -> int:
    """Write `content` to <folder>/<name>.pdf; the number of files. A file appears whole: written under another name, then renamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs as pafs

        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = f"{path}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as f:
                    f.write(data)
                fs.move(part, f"{path}/{key}.pdf")
            yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64())})

    return rows.select(F.col(name).cast("string"), "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
