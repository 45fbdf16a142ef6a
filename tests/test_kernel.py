"""The document reader on small files made in code."""

from __future__ import annotations

import random
import re
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.kernel import crypto, filters, fonts
from folioflow.kernel.limits import TIMINGS, Budget, Options, PdfError
from folioflow.kernel.reader import Reader, iso_date, parse_content, parse_file, parse_file_pages
from folioflow.synth import writer as w

TWO = [w.lines_content("Hello (World)\nLine é two"), w.lines_content("Second")]
TEXTS = ["Hello (World)\nLine é two", "Second"]


def one(content: bytes, font: bytes = w.FONT, **how):
    return parse_content(w.classic(w.page_objects([content], font)), **how)


def text_of(content: bytes, font: bytes = w.FONT) -> str:
    return one(content, font).pages[0].text


def fails(data: bytes, code: int, message: str = "", **how) -> None:
    with pytest.raises(PdfError) as e:
        parse_content(data, **how)
    assert e.value.code == code
    assert message in e.value.message


@pytest.mark.parametrize(
    "data",
    [
        w.classic(w.page_objects(TWO)),
        w.classic(w.page_objects(TWO), xref=False),
        w.compressed(w.page_objects(TWO)),
        w.compressed(w.page_objects(TWO), predictor=True),
        w.compressed(w.page_objects(TWO), hybrid=True),
        w.linearized(w.page_objects(TWO)),
    ],
)
def test_layouts(data):
    d = parse_content(data)
    assert [p.text for p in d.pages] == TEXTS
    assert [p.page_number for p in d.pages] == [1, 2]
    assert d.pdf_version == "1.7"
    assert d.page_count == 2


def test_text_operators():
    got = text_of(rb"""BT (Invoice) Tj 20 0 Td (  No\040123) Tj 0 -14 Td (Row 1) Tj T* (Row 2) Tj (Row 3) ' 0 0 (Row 4) " 1 0 0 1 0 0 Tm [(Total) -300 (10)] TJ ET""")
    assert got == "Invoice  No 123\nRow 1\nRow 2\nRow 3\nRow 4\nTotal 10"
    assert text_of(b"BT (A) Tj T* T* T* (B) Tj ET") == "A\n\n\nB"
    assert text_of(b"BT [(a) -250 (b) -251 (c) [(no)] -9e2 (d)] TJ ET") == "ab c d"
    assert text_of(b"(out) Tj BT (in) Tj ET (out) Tj") == "in"
    assert text_of(b"BT /F1 9 Tf q /F2 9 Tf Q Q (a) Tj <</A 1>> Tj ET") == "a"


def test_strings_and_decoys():
    assert text_of(rb"BT (a\(b\)(c)\\\101\7\n\
d) Tj ET").replace("\x07", "!") == "a(b)(c)\\A!\nd"
    assert text_of(b"BT <41 4> Tj <zz> Tj ET") == "A@"
    objects = w.page_objects([b"BT (x) Tj ET"])
    objects[5] = b"<< /Type /Page /Note (/Contents 99 0 R) % /Contents 98 0 R\n /Sub << /Contents 97 0 R >> /Con#74ents 6 0 R /Parent 2 0 R >>"
    for xref in (True, False):
        assert parse_content(w.classic(objects, xref=xref)).pages[0].text == "x"


def test_stream_lengths():
    inner = b"BT (endstream endobj) Tj ET"
    assert text_of(inner) == "endstream endobj"
    objects = w.page_objects([inner])
    objects[6] = w.stream(inner).replace(b"/Length %d" % len(inner), b"/Length 60 0 R")
    objects[60] = b"%d" % len(inner)
    assert parse_content(w.classic(objects)).pages[0].text == "endstream endobj"


def test_revisions():
    base = w.classic(w.page_objects([b"BT (old) Tj ET"], info=b"<< /Title (T) >>"), b"/Info 4 0 R")
    assert parse_content(base).details == {"Title": "T"}
    assert parse_content(w.update(base, {6: w.stream(b"BT (new) Tj ET")})).pages[0].text == "new"
    gone = parse_content(w.update(base, {}, free={6}, trailer=b"/Info null"))
    assert gone.pages[0].text == ""
    assert gone.details == {}


def test_generation_mismatch_warns():
    base = w.classic(w.page_objects([b"BT (x) Tj ET"]))
    bad = base.replace(b"6 0 obj", b"7 0 obj")
    assert parse_content(bad).warnings == ["Cross-reference object identity mismatch for object 6."]


def test_page_order_and_ranges():
    objects = w.page_objects([b"BT (1) Tj ET", b"BT (2) Tj ET", b"BT (3) Tj ET"])
    objects[2] = objects[2].replace(b"[5 0 R 7 0 R 9 0 R]", b"70 0 R")
    objects[70] = b"[7 0 R 5 0 R 9 0 R]"
    data = w.classic(objects)
    assert [p.text for p in parse_content(data).pages] == ["2", "1", "3"]
    assert [(p.page_number, p.text) for p in parse_content(data, 2, 3).pages] == [(2, "1"), (3, "3")]
    assert parse_content(data, 9).pages == []
    fails(data, 6, first=0)
    fails(data, 6, first=2, last=1)
    fails(data, 7, "maxPages", options=Options(maxPages=2))


def test_page_tree_repeats_are_refused_quickly():
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    for i in range(30):
        objects[2 + i] = b"<< /Type /Pages /Kids [%d 0 R %d 0 R] >>" % (3 + i, 3 + i)
    objects[32] = b"<< /Type /Page >>"
    for xref in (True, False):
        fails(w.classic(objects, xref=xref), 7, "Page tree contains a repeated object reference.", options=Options(deadlineSeconds=5.0))


def test_errors():
    fails(b"no pdf", 3, "Invalid PDF header.")
    fails(b"%PDF-1.4\nnothing", 4, "No PDF objects found.")
    fails(w.classic({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [] >>"}), 5)
    with pytest.raises(PdfError) as e:
        parse_file("/nowhere.pdf")
    assert e.value.code == 1


@pytest.mark.parametrize(
    ("name", "value"),
    [("maxInputBytes", 10), ("maxObjects", 2), ("maxStreamBytes", 5), ("maxDecodedBytesTotal", 5), ("maxContentOperators", 1), ("maxContentTokens", 2), ("maxArrayElements", 1), ("maxExtractedTextBytes", 3), ("maxOperandBytes", 600), ("maxObjectBytes", 20), ("maxRecursionDepth", 1)],
)
def test_limits(name, value):
    data = w.classic(w.page_objects([b"q q BT [(Hello) (World)] TJ (a longer text) Tj ET"]))
    fails(data, 7, name, options=Options(**{name: value}))


def test_options_are_checked():
    for bad in ({"maxPages": 0}, {"deadlineSeconds": 0.0}, {"deadlineSeconds": float("inf")}, {"streamingThreshold": -1}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert Options.of({"MAXPAGES": "3"}).maxPages == 3
    with pytest.raises(ValueError):
        Options.of({"nonsense": "1"})


def test_warning_cap():
    b = Budget(Options(maxWarnings=2))
    for i in range(4):
        b.warn(str(i))
    assert b.warnings == ["0", "Additional warnings truncated."]


def test_forms_images_and_split_streams():
    objects = w.page_objects([b"BT (Before) Tj ET BI /W 2 /H 2 /BPC 8 /CS /RGB ID abEIabcdEFGH EI /Fm Do BT (After) Tj ET"])
    objects[2] = objects[2].replace(b"/Resources <<", b"/Resources << /XObject << /Fm 90 0 R /Im 91 0 R >>")
    objects[90] = w.stream(b"BT (Form) Tj ET /Fm Do", b"/Subtype /Form")
    objects[91] = w.stream(b"x" * 50_000, b"/Subtype /Image")
    d = parse_content(w.classic(objects))
    assert d.pages[0].text == "Before\nForm\nAfter"
    assert d.warnings == ["Recursive Form XObject reference detected at object 90."]
    assert d.metrics["object_bytes_read"] < 10_000
    assert one(b"BT (a) Tj ET BI /W 1 ID x EI BT (b) Tj ET").warnings == ["Unsupported or malformed inline image; remaining content stream skipped."]
    for data, name in ((zlib.compress(b"EI " * 9), b"Fl"), (w.run_length_encode(b"EI EI"), b"RL"), (w.lzw_encode(b"EI EI"), b"LZW"), (b"4549>", b"AHx"), (b"<~87cUR~>", b"A85"), (b"\xff\xd8\xff\xfe\x00\x04EIEI\xff\xd9", b"DCT")):
        assert text_of(b"BT (a) Tj ET BI /F /" + name + b" ID " + data + b" EI BT (b) Tj ET") == "a\nb", name


def test_same_stream_twice_and_failed_filter():
    objects = w.page_objects([b"BT (x) Tj ET"])
    objects[5] = objects[5].replace(b"/Contents 6 0 R", b"/Contents [6 0 R 6 0 R 60 0 R]")
    objects[60] = w.stream(b"junk", b"/Filter /FlateDecode")
    d = parse_content(w.classic(objects))
    assert d.pages[0].text == "x\nx"
    assert d.warnings == ['Unsupported or failed stream filter "FlateDecode" on object 60.']


def test_fonts():
    def font(extra: bytes) -> bytes:
        return b"<< /Type /Font " + extra + b" >>"

    assert text_of(b"BT /F1 9 Tf (ab) Tj ET", font(b"/Subtype /Type1 /BaseFont /Symbol")) == "αβ"
    assert text_of(b"BT /F1 9 Tf (!) Tj ET", font(b"/Subtype /Type1 /BaseFont /ZapfDingbats")) == "✁"
    assert text_of(b"BT /F1 9 Tf <AEAF27> Tj ET", font(b"/Subtype /Type1 /BaseFont /X")) == "ﬁﬂ’"
    assert text_of(b"BT /F1 9 Tf <0102> Tj ET", font(b"/Subtype /TrueType /Encoding << /Differences [1 /Eacute /f_i.alt] >>")) == "Éfi"
    assert text_of(b"BT /F1 9 Tf <D83DDE00D83D> Tj ET", font(b"/Subtype /Type0 /Encoding /Identity-H")) == "😀?"
    assert fonts.glyph("uni00410042") == "AB"
    assert fonts.glyph("u1F600") == "😀"
    assert fonts.glyph("SPACE") == " "
    assert fonts.glyph("lambda") == "λ"
    assert fonts.glyph("zero") == ""


def test_cmaps():
    b = Budget(Options())
    codes, longest = fonts.to_unicode(b"1 beginbfchar <01> <D83DDE00> <02> <D83D> endbfchar 2 beginbfrange <0010> <0012> <0041> <20> <22> [<0061> <0062>] endbfrange", b)
    assert codes == {b"\x01": "😀", b"\x00\x10": "A", b"\x00\x11": "B", b"\x00\x12": "C", b"\x20": "a", b"\x21": "b"}
    assert longest == 2
    with pytest.raises(PdfError):
        fonts.to_unicode(b"1 beginbfrange <00> <FF> <0041> endbfrange", Budget(Options(maxCMapEntries=1)))


def test_info_strings_and_dates():
    info = b"<< /Title <FEFF00E9> /Author (\\223x) /Subject <EFBBBFC3A9> /ModDate (D:2026) /Creator 5 >>"
    d = parse_content(w.classic(w.page_objects([b""], info=info), b"/Info 4 0 R"))
    assert d.details == {"Title": "é", "Author": "ﬁx", "Subject": "é", "ModDate": "2026-01-01T00:00:00"}
    for bad in ("D:20260230", "nonsense", "D:20240101120000+25'00'", "D:0000", "D:2024010112000", "D:20240101\n"):
        assert iso_date(bad) == bad
    assert iso_date("D:20240229120000-0730") == "2024-02-29T12:00:00-07:30"
    assert iso_date("D:2024Z") == "2024-01-01T00:00:00+00:00"


@pytest.mark.parametrize("revision", [2, 3, 4, 5, 6])
@pytest.mark.parametrize("user", [b"", b"secret"])
def test_security(revision, user):
    data = w.encrypted(TWO, w.Lock(revision, user), {"Title": b"Encrypted invoice", "Author": b"\xfe\xff" + "Author 😀".encode("utf-16-be")})
    for password in (user, b"owner-secret"):
        d = parse_content(data, password=password)
        assert [p.text for p in d.pages] == TEXTS
        assert d.details == {"Title": "Encrypted invoice", "Author": "Author 😀"}
        assert (d.is_encrypted, d.is_decrypted) == (False, True)
    if user:
        d = parse_content(data, password=b"wrong")
        assert d.pages == []
        assert d.is_encrypted
        assert d.warnings == ["Encrypted PDF detected. Extraction quality may be limited."]


def test_cipher_vectors():
    """FIPS 197 and well-known RC4 values."""
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, cipher in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        key = bytes(range(n))
        assert crypto.aes_cbc_encrypt(plain, key, bytes(16)).hex() == cipher
        assert crypto.aes_ecb_decrypt(bytes.fromhex(cipher), key) == plain
    assert crypto.rc4(b"Plaintext", b"Key").hex() == "bbf316e8d940af0ad3"
    assert crypto.rc4(b"Attack at dawn", b"Secret").hex() == "45a01f645fc35b383552544b9bf5"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_decoders_undo_encoders(data):
    assert filters.flate(zlib.compress(data)) == data
    assert filters.ascii_hex(w.hex_encode(data)) == data
    assert filters.ascii85(w.ascii85_encode(data)) == data
    assert filters.run_length(w.run_length_encode(data)) == data
    assert filters.lzw(w.lzw_encode(data)) == data
    assert filters.lzw(w.lzw_encode(data, 0), 0) == data
    full = data + b"\n" * (-len(data) % 12)
    assert filters.predict(w.png_encode(data, 12, 3), 15, 3, 8, 4) == full
    assert filters.predict(w.tiff_encode(data, 4, 3), 2, 3, 8, 4) == full


def test_decoder_vectors():
    assert filters.ascii85(b"87cURD]j7BEbo7~>") == b"Hello world"
    assert filters.ascii85(b"8z7") is None
    assert filters.ascii_hex(b"4 1 4>") == b"A@"
    assert filters.ascii_hex(b"4x") is None
    assert filters.lzw(bytes([0x80, 0x18, 0x4C, 0x50, 0x14, 0x02])) is not None
    assert filters.run_length(b"\x05ab") is None
    assert filters.flate(zlib.compress(b"abc")[:-5]) is None
    assert filters.flate(zlib.compress(b"abc") + b"rest") == b"abc"
    assert filters.predict(b"\x01\x01\x01", 2, 1, 8, 2) is None
    assert filters.predict(b"\x00\x01\x00\x02", 2, 1, 16, 2) == b"\x00\x01\x00\x03"
    assert filters.predict(b"\x11\x11", 2, 1, 4, 4) == b"\x12\x34"
    assert filters.predict(b"\x05\x00", 15, 1, 8, 1) is None


def test_files(tmp_path):
    path = tmp_path / "a.pdf"
    path.write_bytes(w.classic(w.page_objects(TWO)))
    assert [p.text for p in parse_file(str(path)).pages] == TEXTS
    d = parse_file(str(path), options=Options(streamingThreshold=0))
    assert d.metrics["streaming_path"]
    pages = parse_file_pages(str(path))
    assert next(pages).text == TEXTS[0]
    pages.close()
    assert Reader(b"").document.pdf_version == "unknown"


def test_damage_never_escapes_as_another_error():
    """Random changes give pages, a recorded error, or nothing; never an exception."""
    base = w.compressed(w.page_objects(TWO), hybrid=True)
    r = random.Random(5)
    for _ in range(300):
        data = bytearray(base)
        for _ in range(r.randint(1, 20)):
            data[r.randrange(5, len(data))] = r.randrange(256)
        d = Reader(bytes(data), options=Options(deadlineSeconds=10)).read()
        assert d.error is None or 1 <= d.error[0] <= 7


def test_operand_bytes_last_over_streams_and_end_with_the_operator():
    first, second = b"BT (%s)" % (b"x" * 400), b" Tj (%s) Tj ET" % (b"y" * 400)
    objects = w.page_objects([b"[60 0 R 61 0 R]"])
    objects[60], objects[61] = w.stream(first), w.stream(second)
    data = w.classic(objects)
    assert parse_content(data, options=Options(maxOperandBytes=2500)).pages[0].text == "x" * 400 + "y" * 400
    fails(data, 7, "maxOperandBytes", options=Options(maxOperandBytes=1300))


def test_reference_chains():
    objects = w.page_objects([b"BT (x) Tj ET"])
    objects[5] = objects[5].replace(b"/Contents 6 0 R", b"/Contents 60 0 R")
    objects[60], objects[61] = b"61 0 R", b"[6 0 R 60 0 R]"
    assert parse_content(w.classic(objects)).pages[0].text == "x"
    objects[2] = objects[2].replace(b"/Resources << /Font << /F1 3 0 R >> >>", b"/Resources 70 0 R")
    objects[70], objects[71] = b"71 0 R", b"70 0 R"
    assert parse_content(w.classic(objects)).pages[0].text == "x"


@pytest.mark.parametrize(
    "segments, found",
    [
        (b"\xff\xe0\x00\x04EI\xff\xda\x00\x02x\xff\x00y\xff\xd0z\xff\xff\xff\xd9", True),
        (b"\xff\x01\xff\xd7\xff\xd9", True),
        (b"\xff\xe0\x00\x01\xff\xd9", False),  # a segment is at least its own length field
        (b"\xff\xe0\x00\x00\xff\xd9", False),
        (b"\xff\xd8\xff\xd9", False),  # a second image
        (b"\xff\xe0\xff\xff\xff\xd9", False),  # a segment beyond the data
        (b"no marker", False),
        (b"\xff", False),
        (b"\xff\xe0", False),
    ],
)
def test_inline_jpeg_ends(segments, found):
    page = b"BT (a) Tj ET BI /F /DCT ID \xff\xd8" + segments + b" EI BT (b) Tj ET"
    d = parse_content(w.classic(w.page_objects([page])))
    assert d.pages[0].text.split() == (["a", "b"] if found else ["a"])
    assert [x for x in d.warnings if "inline image" in x] == ([] if found else ["Unsupported or malformed inline image; remaining content stream skipped."])


@pytest.mark.parametrize(
    "head, warning",
    [
        (b"/F /JBIG2 ID x", "Unsupported"),
        (b"/W 2 /H 2 /BPC 3 /CS /G ID xx", "Unsupported"),
        (b"/W 2 /H 2 /BPC 8 /CS /Indexed ID xxxx", "Unsupported"),
        (b"/W 2 /H 2 /BPC 8 /CS /G ID xx", "Unsupported"),
        (b"1 2 ID x", "Malformed"),
        (b"/K 1 " * 65 + b"ID x", "Malformed"),
        (b"/W 2.0 /H 2 /BPC 8 /CS /G ID xxxx", None),
        (b"/Width 9 /H 2 /IM true ID xxxx", None),
        (b"/F [] /W 1 /H 1 /BPC 16 /CS /CMYK ID xxxxxxxx", None),
    ],
)
def test_inline_images_of_other_kinds(head, warning):
    d = parse_content(w.classic(w.page_objects([b"BT (a) Tj ET BI " + head + b" EI BT (b) Tj ET"])))
    assert d.pages[0].text.split() == (["a"] if warning else ["a", "b"])
    assert [x.split()[0] for x in d.warnings] == ([warning] if warning else [])


def test_dates_of_every_shape():
    zones = {"": "", "Z": "+00:00", "+05": "+05:00", "-0530": "-05:30", "+05'30": "+05:30", "+0530'": "+05:30", "+05'30'": "+05:30"}
    for n, shown in ((4, "2024-01-01T00:00:00"), (6, "2024-02-01T00:00:00"), (8, "2024-02-29T00:00:00"), (10, "2024-02-29T13:00:00"), (12, "2024-02-29T13:14:00"), (14, "2024-02-29T13:14:15")):
        for zone, iso in zones.items():
            assert iso_date("D:" + "20240229131415"[:n] + zone) == shown + iso
    for bad in ("D:20230229", "D:0000", "D:20240229131460", "D:2024022924", "D:2024+24", "D:2024+0560", "D:2024+05'", "D:202", "2024", "D:2024z", "D:2024 ", "D:२०२४", "D:20241301"):
        assert iso_date(bad) == bad


def test_ciphers_agree_with_their_plain_forms():
    rng = random.Random(5)
    for size in (0, 16, 160, 4000):
        for width in (16, 32):
            data, key, iv = rng.randbytes(size), rng.randbytes(width), rng.randbytes(16)
            cipher = crypto._cbc_encrypt(data, key, iv)
            assert crypto.aes_cbc_encrypt(data, key, iv) == cipher
            assert crypto.aes_cbc_decrypt(cipher, key, iv) == data == (crypto._cbc_decrypt(cipher, key, iv) if size else b"")
        assert crypto.rc4(data, key[:5]) == crypto._rc4(data, key[:5])


def test_png_rows_of_any_width_come_back():
    rng = random.Random(6)
    for row, unit in ((1, 1), (6, 6), (16, 2), (127, 1), (128, 4), (300, 3)):
        data = rng.randbytes(row * 11)
        assert filters.predict(w.png_encode(data, row, unit), 15, unit, 8, row // unit) == data
    data = rng.randbytes(200_000)
    began = time.process_time()
    packed = w.ascii85_encode(w.png_encode(data, 32))
    assert time.process_time() - began < 0.1  # in arrays, not byte by byte
    assert filters.predict(filters.ascii85(packed), 15, 1, 8, 32) == data


def test_same_map_in_many_documents_is_read_once():
    cmap = b"begincmap 1 beginbfrange <0020> <007F> <0020> endbfrange %" + str(random.random()).encode()
    before = fonts._small_map.cache_info().hits
    spent = []
    for _ in range(3):
        budget = Budget(Options())
        assert fonts.to_unicode(cmap, budget)[0][b"\0A"] == "A"
        spent.append((budget.counts["cmap_entries"], budget.cmap_bytes))
    assert len(set(spent)) == 1
    assert spent[0][0] == 96
    assert fonts._small_map.cache_info().hits == before + 2
    with pytest.raises(PdfError, match="maxCMapEntries"):
        fonts.to_unicode(cmap, Budget(Options(maxCMapEntries=95)))


def test_strings_in_arrays_and_blanks_before_a_token():
    page = w.classic(w.page_objects([b"BT /F1 9 Tf [ %note\n (a)-300(b) [(no)] (c\\)(d)) .5 /N <65>] TJ%end\n\0\t\x0c(f)Tj ET   %"]))
    found = parse_content(page)
    assert found.pages[0].text == "a bc)(d)ef"
    assert found.metrics["content_tokens"] == 17


def test_what_documents_share_is_read_once_and_lines_in_one_step(monkeypatch):
    from folioflow.kernel import lexer

    lines = [f"line {i}" for i in range(100)]
    for how in ({}, {"xref": False}):
        made = [w.classic(w.page_objects([w.lines_content("\n".join([*lines, last]))]), **how) for last in ("a", "b")]
        assert parse_content(made[0]).pages[0].text.split() == " ".join([*lines, "a"]).split()
        calls = {"value": 0, "token": 0}
        with monkeypatch.context() as m:
            for cls, name in ((lexer.Lexer, "value"), (lexer.ContentLexer, "token")):
                m.setattr(cls, name, lambda self, *a, _own=getattr(cls, name), _name=name: (calls.update({_name: calls[_name] + 1}), _own(self, *a))[1])
            found = parse_content(made[1])
        assert found.pages[0].text.split() == " ".join([*lines, "b"]).split()
        assert found.metrics["content_tokens"] == 312
        assert calls["value"] <= 5 and calls["token"] <= 20


def test_many_lines_are_put_at_once_as_one_by_one(monkeypatch):
    from folioflow.kernel import content

    rng = random.Random(9)
    strings = [b"", b"", b"a", b"line of words", b"\xe9\x80", b"\xfe\xff", b"a\\)b", b"x\ny", b"w" * 300]
    steps = [b" Tj T*\n", b" Tj\nT* ", b" '\n", b' "\n', b" Tj 0 -14 Td ", b" Tj "]
    font = b"<< /Type /Font /Subtype /%b /BaseFont /X /Encoding %b >>"
    kinds = [(b"Type1", b"/WinAnsiEncoding"), (b"Type1", b"/StandardEncoding"), (b"Type0", b"/Identity-H"), (b"TrueType", b"<< /Differences [97 /f_i /nope] >>")]
    more = [{}, {}, {"maxContentTokens": 90}, {"maxContentOperators": 60}, {"maxExtractedTextBytes": 500}, {"maxOperandBytes": 4000}, {"maxStreamBytes": 2000}]
    never = re.compile(rb"(?!)()")
    taken = 0
    for k in range(600):
        body = b""
        while len(body) < 1500:
            step = rng.choice(steps)
            body += b"".join(b"(" + rng.choice(strings) + b")" + (step if rng.random() < 0.95 else rng.choice(steps)) for _ in range(rng.choice((1, 3, 40, 300))))
        page = w.classic(w.page_objects([b"BT (no font) Tj T* (none) Tj T* /F1 9 Tf " * (k % 2) + b"BT /F1 9 Tf " + body + b"ET"], font=font % kinds[k % 4]))
        options, found = Options(**rng.choice(more)), []
        for how in (content.LINES, never):
            monkeypatch.setattr(content, "LINES", how)
            d = Reader(page, options=options).read()
            found.append((d.pages, d.error, d.warnings, {k: v for k, v in d.metrics.items() if k not in TIMINGS}))
        monkeypatch.undo()
        assert found[0] == found[1]
        taken += bool(found[0][0])
    assert 300 < taken < 600
    calls = []
    monkeypatch.setattr(fonts, "show", lambda *a, _own=fonts.show: (calls.append(1), _own(*a))[1])
    lines = "\n".join(f"line {i}" for i in range(200))
    assert parse_content(w.classic(w.page_objects([w.lines_content(lines)]))).pages[0].text == lines
    assert parse_content(w.classic(w.page_objects([b"BT /F1 9 Tf " + b" ".join(b"(line %d) '" % i for i in range(200)) + b" ET"]))).pages[0].text == lines
    assert len(calls) <= 2
