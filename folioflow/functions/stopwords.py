"""Words that the keyword filter drops, and files of further ones."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# English and Malay conjunctions and particles.
ENGLISH = (
    "and but or nor for yet so after although as because before if once since than that though till unless until when where whereas whether "
    "while even provided both either neither not which who whom whose what how"
).split()
MALAY = (
    "dan atau tetapi serta lalu lagi malah bahkan sebaliknya kecuali bahawa agar supaya bagi demi untuk kerana sebab jika kalau sekiranya andai "
    "andainya andaikata walaupun meskipun sungguhpun biarpun kendatipun sebelum sesudah setelah semasa ketika apabila manakala sehingga hingga sejak "
    "sambil seraya seperti bagaikan ibarat seolah seolah-olah melainkan mahupun namun sedangkan padahal yang ini itu tersebut tadi begitu begini "
    "demikian juga pun lah kah tah"
).split()
BASE = frozenset(ENGLISH) | frozenset(MALAY)
#: Word files are small by nature; a longer one is refused, since the set becomes a literal of the plan.
MOST_WORDS = 100_000


def read_words(spark: SparkSession, path: str) -> frozenset[str]:
    """Lines of a word file in lower case (ASCII letters only); blank lines and those that begin with # don't count. A file that can't be read gives nothing."""
    trimmed = F.trim(F.translate("value", "\t\r\x00\x0b", "    "))
    try:
        rows = spark.read.text(path).select(F.translate(trimmed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("w"))
        words = {r.w for r in rows.filter("w <> '' and not startswith(w, '#')").distinct().limit(MOST_WORDS + 1).collect()}
    except Exception as e:  # noqa: BLE001  the source raises various classes for a missing file
        if "PATH_NOT_FOUND" in str(e) or "FileNotFound" in str(e):
            return frozenset()
        raise
    if len(words) > MOST_WORDS:
        raise ValueError(f"{path} has more than {MOST_WORDS} words")
    return frozenset(words)
