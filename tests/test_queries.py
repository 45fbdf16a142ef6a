"""Every registered query of the library against its SQL, on the smallest tables; and the DataFrame functions."""

from __future__ import annotations

import decimal
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow import queries
from folioflow.functions import decoders, text
from folioflow.functions.stopwords import read_words
from folioflow.kernel.reader import iso_date
from folioflow.operators import relations
from folioflow.plans import revisions
from folioflow.sources import pdf, scratch
from folioflow.synth import writer

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        return int(x)
    if isinstance(x, (bytearray, bytes)):
        return bytes(x)
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(plain(list(r))) for r in df.select(*cols).collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted(repr(plain(list(r))) for r in db.execute(f"SELECT {quoted} FROM ({queries.oracle_sql()[name]})").fetchall())
    assert got == want


def differences(spark, folder, name: str, texts: list[str]) -> tuple[list, list]:
    """Rows that only the query gives and rows that only its SQL gives, over documents of these texts."""
    path = f"{folder}/documents.parquet"
    duckdb.from_arrow(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})).write_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    df = queries.queries()[name](spark, str(folder))
    got = {repr(plain(list(r))) for r in df.collect()}
    want = {repr(plain(list(r))) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()}
    return sorted(got - want), sorted(want - got)


def test_kerned_lines_of_any_number_of_words(spark, tmp_path):
    texts = ["a b", "", " ".join(["word"] * 5000), " ".join(["word"] * 5001), "first\n" + " ".join(f"w{i}" for i in range(20_000)) + "\nlast"]
    assert differences(spark, tmp_path, "tj_kerning", texts) == ([], [])


@pytest.mark.parametrize("name", ["metrics_counters", "limit_codes"])
def test_counters_of_empty_and_blank_texts(spark, tmp_path, name):
    assert differences(spark, tmp_path, name, ["", " ", "\n", "a", "é" * 499 + "ab", "é" * 500, "x" * 1000, "x" * 1001]) == ([], [])


def test_keyword_filter_cases(spark):
    rows = spark.createDataFrame([("Invoice 2026\n\n\n\nand Batch42Code über café\r\nthe Room7 a",)], "t string")
    out = rows.select(
        text.stopword_filter(F.col("t")).alias("a"),
        text.stopword_filter(F.col("t"), exclude_numbers=True).alias("b"),
        text.stopword_filter(F.col("t"), preserve_line_breaks=True).alias("c"),
    ).first()
    assert out.a == "invoice 2026 batch42code ber caf the room7"
    assert out.b == "invoice batch code ber caf the room"
    assert out.c == "invoice 2026\n\nbatch42code ber caf\nthe room7"


def test_keyword_filter_needs_no_python_and_no_shuffle(spark):
    df = queries.queries()["stopword_default"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Python" not in plan
    assert "Arrow" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_word_files(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" # no\n Alpha \n\nBETA\n")
    assert read_words(spark, str(tmp_path / "w.txt")) == {"alpha", "beta"}
    assert read_words(spark, str(tmp_path / "none.txt")) == frozenset()


def test_relations_keep_columns_and_report_errors(spark):
    good, bad = writer.classic(writer.page_objects([b"BT (x) Tj ET"])), b"%PDF-junk"
    rows = spark.createDataFrame([(1, bytearray(good), "a"), (2, bytearray(bad), None), (3, None, "c")], "id int, content binary, text string")
    docs = {r.id: r for r in relations.documents(rows, keep=["id"]).collect()}
    assert docs[1].pages[0].text == "x"
    assert docs[2].error.code == 4
    assert set(docs) == {1, 2}
    assert [r.id for r in relations.pages(rows.drop("text")).collect()] == [1]
    with pytest.raises(Exception, match="No PDF objects found"):
        relations.documents(rows, keep=["id"], mode="FAILFAST").collect()
    assert relations.documents(rows.filter("id > 9"), keep=["id"]).count() == 0


def test_source_takes_page_bounds(spark, tmp_path):
    pdf.register(spark)
    (tmp_path / "a.pdf").write_bytes(writer.classic(writer.page_objects([b"BT (1) Tj ET", b"BT (2) Tj ET", b"BT (3) Tj ET"])))
    (tmp_path / "b.txt").write_bytes(b"no")
    df = spark.read.format("pdf").load(str(tmp_path))
    assert [r.text for r in df.filter("page_number = 2").collect()] == ["2"]
    assert df.count() == 3
    some = spark.read.format("pdf").option("firstPage", 2).option("lastPage", 3).load(str(tmp_path))
    assert [(r.page_number, r.text) for r in some.orderBy("page_number").collect()] == [(2, "2"), (3, "3")]
    with pytest.raises(Exception, match="page"):
        spark.read.format("pdf").option("firstPage", 0).load(str(tmp_path)).collect()


def test_source_reports_errors_and_reads_no_file_over_the_limit(spark, tmp_path):
    pdf.register(spark)
    (tmp_path / "a.pdf").write_bytes(writer.classic(writer.page_objects([b"BT (1) Tj ET"])))
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4" + b" " * 5000)
    rows = spark.read.format("pdf").option("maxInputBytes", 4000).load(str(tmp_path)).collect()
    assert {(r.path.rsplit("/", 1)[1], r.page_number, r.error and r.error.message) for r in rows} == {("a.pdf", 1, None), ("b.pdf", None, "Invalid PDF header."), ("c.pdf", None, "PDF input exceeds maxInputBytes.")}
    with pytest.raises(Exception, match="Invalid PDF header"):
        spark.read.format("pdf").option("maxInputBytes", 4000).option("mode", "FAILFAST").load(str(tmp_path)).collect()


def test_pages_with_errors(spark):
    rows = spark.createDataFrame([(1, bytearray(writer.classic(writer.page_objects([b"BT (x) Tj ET"])))), (2, bytearray(b"junk"))], "id int, content binary")
    got = [(r.id, r.page_number, r.error and r.error.code) for r in relations.pages(rows, errors=True).collect()]
    assert got == [(1, 1, None), (2, None, 3)]
    assert relations.pages(rows).columns == ["id", "page_number", "object_id", "text"]


def test_dates_in_columns_are_those_of_documents(spark):
    zones = ["", "Z", "+05", "-0530", "+05'30", "+0530'", "+05'30'", "+05'", "+24", "+0560"]
    days = ["2024", "202402", "20240229", "2024022913", "202402291314", "20240229131415", "20240229131460", "20230229", "0000", "202"]
    cases = ["D:" + d + z for d in days for z in zones] + ["", "D:", "2024", "D:२०२४", None]
    rows = spark.createDataFrame([(c,) for c in cases], "d string").select("d", text.pdf_date_to_iso(F.col("d")).alias("iso"))
    assert all(r.iso == (None if r.d is None else iso_date(r.d)) for r in rows.collect())


def test_page_order_of_deep_and_empty_trees(spark):
    nodes = [("t", i + 1, i, 5, False) for i in range(12)] + [("t", 100 + i, 12, 10**9 - i, True) for i in range(3)] + [("t", 200, 3, 4, True)]
    df = spark.createDataFrame(nodes, "tree string, id long, parent long, position long, is_page boolean")
    roots = spark.createDataFrame([("t", 0), ("u", 0)], "tree string, id long")
    assert [(r.id, r.page_number) for r in revisions.page_order(df, roots).orderBy("page_number").collect()] == [(200, 1), (102, 2), (101, 3), (100, 4)]
    assert revisions.page_order(df.limit(0), roots).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf(dict):
        pass

    class Context:
        master, applicationId = "yarn", "a"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session())


def test_sizes():
    assert [pdf.byte_size(x) for x in ("512M", "1k", "7", "-1", "x", None, "9" * 30 + "G")] == [512 << 20, 1024, 7, None, None, None, 2**63 - 1]


def test_decoder_columns(spark):
    rows = spark.createDataFrame([(bytearray(b"87cURD]j7BEbo7~>"),), (None,), (bytearray(b"8z7"),)], "b binary")
    got = [r[0] for r in rows.select(decoders.ascii85_decode(F.col("b"))).collect()]
    assert [None if x is None else bytes(x) for x in got] == [b"Hello world", None, None]
    shown = rows.limit(1).select(decoders.decode_text(F.lit(b"ab"), "Symbol"), decoders.document_string(F.lit(b"\xfe\xff\x00A")), decoders.parse_cmap(F.lit(b"1 beginbfchar <01> <0041> endbfchar"))).first()
    assert list(shown) == ["αβ", "A", {"01": "A"}]


def test_normalize_text_only_looks_through_even_texts(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("  \n\n\r\t  \x01\x0b\u0085abé") for _ in range(r.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(r.choice("  \nab") for _ in range(9)) for _ in range(1000)]

    def plain(x):
        x = re.sub("\r\n?", "\n", x)
        x = re.sub("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "", x).translate({0xA0: " ", 0x202F: " "})
        x = re.sub(" +(?=\n|\\Z)", "", re.sub("[ \t]+", " ", x))
        return re.sub("\n{3,}", "\n\n", x).strip(" \t\n")

    c = F.col("t")
    found = spark.createDataFrame([(x,) for x in texts], "t string").select("t", text.normalize_text(c).alias("n"), F.regexp_like(c, F.lit(text.UNEVEN)).alias("uneven")).collect()
    assert [x.n for x in found] == [plain(x.t) for x in found]
    assert all(x.uneven for x in found if x.n != x.t.strip(" \t\n"))
    assert any(not x.uneven and "\n\n" in x.n and " " in x.n for x in found)
