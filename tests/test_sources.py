import io
import zipfile

import pytest

from stratalith.plans import text_jobs
from stratalith.sources import delimited as D
from stratalith.sources import files, formats, office, pdf
from stratalith.sources.html import decode_html, parse_html
from stratalith.sources.markdown import parse_markdown


def _kinds(tree):
    return [(n.kind, n.title or n.text, n.heading_path) for n in tree.nodes]


def test_markdown():
    text = "---\ntitle: Plan\n---\n# One\n\nA *b* [c](d).\n\nSub\n---\n- x\n- `y`\n\n```py\n  z\n```\n\n|a|b|\n|-|-|\n|1|2|\n\n<div>no</div>\n\n***\n\n> quoted\n"
    tree = parse_markdown(text, "f.md")
    assert _kinds(tree) == [
        ("document", "Plan", []), ("section", "One", ["One"]), ("paragraph", "A b c.", ["One"]), ("section", "Sub", ["One", "Sub"]),
        ("list", "- x\n- y", ["One", "Sub"]), ("code", "  z", ["One", "Sub"]), ("table", "ab12", ["One", "Sub"]), ("paragraph", "quoted", ["One", "Sub"]),
    ]
    assert tree.nodes[2].line_start == 6
    rows = tree.rows("s:f.md")
    assert rows[1][0] == "s:f.md#0.0" and rows[3][2] == "s:f.md#0.0" and [r[-1] for r in rows] == list(range(8))
    assert parse_markdown("", "empty.md").warnings[0][0] == "empty-file"
    assert parse_markdown("---\ntitle: x\nbad line\n---\n#\n\ntext", "x.md").warnings[0][0] == "frontmatter-invalid"


def test_html():
    page = "<title>T</title><nav>menu menu menu menu</nav><main><header>kept? <h1>Head</h1></header><p>a\n <b>b</b></p><ul><li>x<li>y</ul><table><tr><th>k</th><td>v</td></tr></table><pre>  c\n d</pre><script>s</script>bare</main>"
    tree = parse_html(page, "p.html")
    assert _kinds(tree) == [
        ("document", "T", []), ("section", "Head", ["Head"]), ("paragraph", "a b", ["Head"]), ("list", "- x\n- y", ["Head"]),
        ("table", "k | v", ["Head"]), ("code", "  c\n d", ["Head"]),
    ]
    assert tree.nodes[0].metadata["lost_characters"] == 9
    text, warned = decode_html("<meta charset=latin1>é".encode("latin-1"))
    assert text.endswith("é") and warned[0][0] == "html-declared-encoding"


def test_delimited():
    assert D.delimiter_of("a;b;c\n1;2;3\n") == ";" and D.delimiter_of("plain\n") == ","
    got = D.parse_delimited('id,id,z\n"1","x\ny",\n2,"say ""hi""",z,extra\n')
    assert got.columns == ["id", "id_2", "z", "column_4"]
    assert got.rows[0][:2] == ["1", "x\ny"] and got.rows[1][1] == 'say "hi"' and got.row_lines == [2, 4]
    assert "csv-ragged-row" in [w for w, _ in got.warnings]
    assert not D.parse_delimited("1,2\n3,4\n").has_header and D.parse_delimited("").warnings[0][0] == "empty-file"
    assert D.unique_headers(["a", "a", "a_2", ""])[0] == ["a", "a_3", "a_2", "column_4"]


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n"])
def test_delimiter_of_large_texts(end):
    assert D.delimiter_of(f"a;b,c;d{end}" + f"1;2;3{end}" * 200_000) == ";"
    cell = '"' + f"x, y{end}" * 60_000 + '"'
    assert D.delimiter_of(f"k;t;z{end}" + f"1;{cell};2{end}" * 5) == ";"


def test_parse_warnings_follow_the_path(spark, tmp_path):
    rows = [("wiki", p, "---\njust words\n---\ntext\n") for p in ("a.md", "b.txt", "c.rst")] + [("wiki", "d.txt", " ")]
    spark.createDataFrame(rows, "source string, relative_path string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.code: r.files for r in text_jobs.QUERIES["parse_warnings"](spark, str(tmp_path)).collect()}
    assert got == {"frontmatter-not-a-mapping": 1, "empty-file": 1}


def _xlsx():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = (
        '<row r="1"><c r="A1" t="inlineStr"><is><t>Report</t></is></c></row>'
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="C3" t="inlineStr"><is><t>day</t></is></c></row>'
        '<row r="4"><c r="A4" t="inlineStr"><is><t>eu</t></is></c><c r="B4"><v>2</v></c><c r="C4" s="1"><v>45000</v></c></row>'
        '<row r="5"><c r="A5" t="inlineStr"><is><t>us</t></is></c><c r="B5"><v>2.5</v></c></row>'
    )
    parts = {
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>region</t></si><si><r><t>co</t></r><r><t>st</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_xlsx():
    (_, table, warned), = office.sheets_of(_xlsx())
    assert table.columns == ["region", "cost", "day"] and table.types == ["text", "real", "date"]
    assert table.rows == [["eu", 2.0, "2023-03-15"], ["us", 2.5, None]] and table.cell_range == "A3:C5"
    assert warned[0][0] == "xlsx-preamble-skipped"
    assert office.parse_reference("AB12") == (12, 28) and office.column_letters(28) == "AB"
    assert office.serial_to_iso(1) == "1900-01-01" and office.serial_to_iso(0.5, True) == "1904-01-01T12:00:00"
    assert office.is_date_format(170, "yyyy") and not office.is_date_format(170, '0.0"days"')


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p>'
        '<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>one</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Odd"/></w:pPr><w:r><w:t>odd</w:t></w:r></w:p>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    tree = office.parse_docx(out.getvalue(), "d.docx")
    assert _kinds(tree)[1:] == [("section", "Top", ["Top"]), ("paragraph", "Text", ["Top"]), ("list", "- one", ["Top"]), ("paragraph", "odd", ["Top"])]
    assert tree.warnings == [("docx-unmapped-style", "styles read as plain text: Odd")]


def test_pdf_pages():
    assert office.pdf_page_paragraphs("ﬁrst line\nwell-\nknown\n\nnext") == ["first line well-known", "next"]
    assert [n.title for n in office.pdf_tree(["a", "", "b"], "x.pdf").nodes if n.kind == "section"] == ["Page 1", "Page 3"]
    with pytest.raises(ValueError):
        office.pdf_tree(["", ""], "x.pdf")


def test_formats(spark):
    assert formats.parser_for("a/README") == "text" and formats.parser_for("x.PY") == "code" and formats.parser_for("x.bin") is None
    rows = [("a.md", b"# hi"), ("b.txt", b"\0x"), ("c.txt", b"\xff\xfeh\0"), ("d.txt", b"\xc3("), ("e.xlsx", b"PK\0")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "relative_path string, content binary")
    from pyspark.sql import functions as F

    got = [r.k for r in df.select(formats.text_class(F.col("content"), formats.parser_of(F.col("relative_path"))).alias("k")).collect()]
    assert got == ["text", "binary", "utf-16", "invalid-utf8", "bytes"]


def test_broken_files_give_warnings(spark):
    df = spark.createDataFrame([("s:x.docx", "x.docx", "docx", bytearray(b"nope")), ("s:y.txt", "y.txt", "text", bytearray(b"fine"))], "artifact_id string, relative_path string, parser string, content binary")
    parsed = files.parse(df)
    assert [r.code for r in files.warnings_of(parsed).collect()] == ["parse-failed"]
    assert {r.kind for r in files.nodes_of(parsed).collect()} == {"document", "paragraph"}


def test_detect_delimiters(spark):
    rows = [("a", 1, "x;y;z"), ("a", 2, '"p;q";r;s'), ("b", 1, "x|y"), ("b", 2, "1|2"), ("c", 1, "plain"), ("c", 2, None), ("d", 1, "a,b;c"), ("d", 2, "1,2;3"), ("d", 2, "1,2;3")]
    df = spark.createDataFrame(rows, "file_path string, record_no int, raw_record string")
    assert {tuple(r) for r in D.detect_delimiters(df).collect()} == {("a", ";", 3), ("b", "|", 2), ("c", ",", 1), ("d", ",", 2)}
    assert D.detect_delimiters(df.where("false")).count() == 0


def test_an_unclosed_quote_loses_its_own_record_only():
    got = D.parse_delimited('a,b\n1,"open\n2,x\n3,"y"\n4,z\n')
    assert [r[0] for r in got.rows] == ["2", "3", "4"] or [r[0] for r in got.rows] == ["1", "4"]
    got = D.parse_delimited('a,b\n1,"open\n2,x\n3,y\n')
    assert got.rows == [["2", "x"], ["3", "y"]] and got.rejected == [2] and got.row_lines == [3, 4] and got.warnings[0][0] == "csv-unclosed-quote"
    assert D.parse_delimited('a,b\n1,"x""\n').rejected == [2] and D.parse_delimited('"').rejected == [1]
    assert D.parse_delimited("a,b\n" + '1,"x\n' * 2_001).rejected


def _pdf(*pages: bytes, font: bytes = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", flate: bool = True, extra: bytes = b"") -> bytes:
    import zlib

    n = len(pages)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (n, b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(n))), font]
    for i, page in enumerate(pages):
        data = zlib.compress(page) if flate else page
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * i))
        objects.append(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if flate else b"", data))
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))
    return b"%PDF-1.4\n" + body + extra + b"trailer\n<< /Root 1 0 R /Info << /Title (Made \\(by hand\\)) >> >>\n%%EOF"


def test_pdf_pages_become_sections():
    one = b"BT /F1 12 Tf 72 700 Td (A work\\336ow is a depart-) Tj 0 -14 Td (ment \\(of sorts\\).) Tj 0 -40 Td [(Sec) 20 (ond) -300 (para)] TJ ET"
    two = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm <4361666520> Tj (\\351t\\351) ' ET"
    for flate in (True, False):
        tree = pdf.parse_pdf(_pdf(one.replace(b"\\336", b"fl"), two, b"", flate=flate), "x.pdf")
        assert _kinds(tree) == [
            ("document", "Made (by hand)", []), ("section", "Page 1", ["Page 1"]), ("paragraph", "A workflow is a depart-ment (of sorts).", ["Page 1"]),
            ("paragraph", "Second para", ["Page 1"]), ("section", "Page 2", ["Page 2"]), ("paragraph", "Cafe été", ["Page 2"]),
        ]
        assert [w for w, _ in tree.warnings] == ["pdf-pages-without-text"] and tree.nodes[0].metadata["pages"] == 3
    got, tables = files.parse_bytes("pdf-text", _pdf(one), "x.pdf")
    assert len(got.nodes) == 4 and not tables


def test_pdf_fonts_with_maps_and_damaged_pages():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <FB01> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    extra = b"90 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    font = b"<< /Type /Font /Subtype /Type0 /ToUnicode 90 0 R >>"
    tree = pdf.parse_pdf(_pdf(b"BT /F1 9 Tf <00010010001100120002> Tj ET", font=font, extra=extra), "m.pdf")
    assert tree.nodes[2].text == "Habcfi"
    broken = _pdf(b"BT /F1 9 Tf (fine) Tj ET", b"BT (lost) Tj ET").replace(b"/Contents 7 0 R", b"/Contents 91 0 R")
    tree = pdf.parse_pdf(broken.replace(b"trailer", b"91 0 obj << /Filter /JPXDecode /Length 3 >> stream\nabc\nendstream endobj\ntrailer"), "d.pdf")
    assert {w for w, _ in tree.warnings} == {"pdf-page-unreadable", "pdf-pages-without-text"}
    for bad, why in ((_pdf(b""), "no page holds text"), (b"plain", "no PDF"), (_pdf(b"BT (x) Tj ET").replace(b"/Root", b"/Encrypt 9 0 R /Root"), "password")):
        with pytest.raises(ValueError, match=why):
            pdf.parse_pdf(bad, "x.pdf")


def test_front_matter_and_old_documents():
    assert parse_markdown("---\n- a\n- b\n---\n# T\n", "x.md").warnings[0][0] == "frontmatter-not-a-mapping"
    assert parse_markdown("---\njust words\n---\ntext", "x.md").warnings[0][0] == "frontmatter-not-a-mapping"
    with pytest.raises(ValueError, match="older .doc"):
        office.parse_docx(b"\xd0\xcf\x11\xe0rest", "x.docx")
