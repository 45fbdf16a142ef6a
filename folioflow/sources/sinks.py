"""Results as text and JSON files. Spark's commit protocol makes a file appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview, stopword_filter


def keyword_documents(pages: DataFrame, key: str = "path", exclude_numbers: bool = False, preserve_line_breaks: bool = False, max_bytes: int | None = None) -> DataFrame:
    """`key`, text: every page filtered to keywords, empty ones dropped, joined in page order; text_bytes, preview, preview_truncated.

    The one shuffle is by `key`. A document over `max_bytes` fails the job.
    """
    joint = "\n\n" if preserve_line_breaks else " "
    rows = pages.select(key, "page_number", stopword_filter(F.col("text"), exclude_numbers, preserve_line_breaks).alias("t")).filter("t <> ''")
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_number", "t"))).alias("ps"))
    out = listed.select(key, F.array_join(F.transform("ps", lambda p: p["t"]), joint).alias("text"))
    if max_bytes is not None:
        whole = F.when(F.octet_length("text") <= max_bytes, F.col("text")).otherwise(F.raise_error(F.lit("Output exceeds the configured text limit.")))
        out = out.withColumn("text", whole)
    head, more = preview(F.col("text"))
    return out.withColumns({"text_bytes": F.octet_length("text"), "preview": head, "preview_truncated": more})


def write_text(docs: DataFrame, path: str, column: str = "text", mode: str = "errorifexists") -> None:
    docs.select(column).write.mode(mode).text(path, lineSep="\n\x0c\n")


def write_metadata(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON row a document: everything but its pages, with the length of its text in bytes and the time."""
    cols = [c for c in docs.columns if c not in ("pages", "text", "content")]
    size = [F.octet_length("text").alias("text_length")] if "text" in docs.columns else []
    docs.select(*cols, *size, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("extracted_at"), F.lit("folioflow").alias("engine")).write.mode(mode).json(path)
