import io
import zipfile

from maskflow.plans import catalog
from maskflow.sources import files, html, office, sinks

SF = "/root/testdata/sf0.001"
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook():
    return zipped(
        {
            "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {S}><si><t>Acme</t></si></sst>",
            "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>1.5</v></c><c r="D1" s="1"><v>45000</v></c><c r="E1" t="b"><v>1</v></c><c r="F1"><f>SUM(C1)</f><v>2</v></c></row></sheetData></worksheet>',
        }
    )


def test_workbooks(spark):
    xml = b'<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet ss:Name="S"><Table><Row><Cell><Data ss:Type="Number">7</Data></Cell><Cell><Data ss:Type="String">x</Data></Cell></Row></Table></Worksheet></Workbook>'
    df = spark.createDataFrame([("a.xlsx", bytearray(workbook())), ("b.xls", bytearray(xml)), ("c.xlsx", bytearray(b"junk"))], "path string, content binary")
    cells = office.read_cells(df)
    got = {(r["path"], r["col"]): (r["cell_type"], r["s"], r["d"], r["b"], r["number_format"]) for r in cells.filter("error IS NULL").collect()}
    assert got[("a.xlsx", 0)][:2] == ("string", "Acme") and got[("a.xlsx", 2)][2] == 1.5
    assert got[("a.xlsx", 3)][4] == "mm-dd-yy" and got[("a.xlsx", 4)][3] is True and got[("a.xlsx", 5)][1] == "=SUM(C1)"
    assert got[("b.xls", 0)][2] == 7.0 and got[("b.xls", 1)][1] == "x"
    assert [r["path"] for r in office.failed(cells).collect()] == ["c.xlsx"]


def test_documents(spark):
    body = f'<w:document {W}><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    content = zipped({"word/document.xml": body, "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>"})
    df = spark.createDataFrame([("a.docx", bytearray(content))], "path string, content binary")
    rows = office.read_paragraphs(df).orderBy("frag_ord").collect()
    assert [(r["part"], r["text"]) for r in rows] == [("body", "One two"), ("table", "cell"), ("header", "head")]


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.txt").write_text("no")
    (tmp_path / "~$a.txt").write_text("no")
    (tmp_path / "b.exe").write_text("no")
    (tmp_path / "sub" / "a.TXT").write_bytes("电话\r\n一".encode("gb18030"))
    (tmp_path / "t.csv").write_bytes(b'a,"b ""q"", c"\r\n1,2,3\r\n')
    (tmp_path / "t.tsv").write_bytes(b"x\ty\n")
    listed = files.scan_folder(spark, str(tmp_path)).orderBy("file_ord").collect()
    assert [(r["relative"], r["extension"], r["file_ord"]) for r in listed] == [("sub/a.TXT", ".txt", 1), ("t.csv", ".csv", 2), ("t.tsv", ".tsv", 3)]
    assert [r["text"] for r in files.read_texts(spark, str(tmp_path)).filter("path LIKE '%sub%'").collect()] == ["电话\n一"]
    cells = files.read_csv_cells(spark, str(tmp_path))
    assert {(r["row"], r["col"]): r["cell"] for r in cells.filter("path LIKE '%csv'").collect()} == {(0, 0): "a", (0, 1): 'b "q", c', (1, 0): "1", (1, 1): "2", (1, 2): "3"}
    out = sinks.csv_contents(cells.withColumnRenamed("path", "output").filter("output LIKE '%csv'")).withColumn("output", __import__("pyspark").sql.functions.lit("o/t.csv"))
    done = sinks.write_files(out, str(tmp_path / "out")).collect()
    assert done[0]["error"] is None and (tmp_path / "out/o/t.csv").read_bytes() == b'a,"b ""q"", c"\r\n1,2,3\r\n'


def test_encodings():
    texts = {
        "gb18030": "本公司二〇二四年度财务报告,电话和地址见附件。",
        "big5": "本公司財務報告書,電話與地址請見附件說明。",
        "shift_jis": "これは会社の決算報告書です。電話番号は別紙のとおり。",
        "cp1252": "Résumé of naïve café invoices: 5 € für Müller",
    }
    for name, text in texts.items():
        data = text.encode(name)
        assert data.decode(files.guessed_encoding(data)) == text, name
    long = ("一二三" * 5000).encode("gb18030")
    assert files.guessed_encoding(long) == "gb18030"


def test_html_round_trip(spark):
    page = '<p>Mail <b>a@x.com</b></p><script>var t="</p>"; b@x.com</script><!-- c@x.com -->tail'
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")
    nodes = html.text_nodes(df)
    assert [r["text"] for r in nodes.orderBy("frag_ord").collect()] == ["Mail ", "a@x.com", " c@x.com ", "tail"]
    back = html.with_nodes(df, nodes.withColumn("sanitized", nodes["text"]))
    assert {r["page_id"]: r["sanitized"] for r in back.collect()}[1] == page


def test_html_parents_and_references(spark):
    pages = {
        1: "<pre>own<b>x@y.com</b>own<br>own</pre>out",
        2: "<code><span>in@code.com</span></code>",
        3: '<a title="a>b" href=\'x">\'>link</a>',
        4: "mail a&#64;x.com &amp; b&#x40;x.com 1 < 2 &lt;",
        5: "<pre>a<p>b</pre>c</p>d",
        6: "<PRE>x</PRE><Code/>y &#0; &unknown;",
    }
    df = spark.createDataFrame(list(pages.items()), "page_id int, html string")
    nodes = html.text_nodes(df)
    got = {}
    for r in nodes.orderBy("page_id", "frag_ord").collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got == {1: ["x@y.com", "out"], 2: ["in@code.com"], 3: ["link"], 4: ["mail a@x.com & b@x.com 1 < 2 <"], 5: ["b", "c", "d"], 6: ["y \ufffd &unknown;"]}
    upper = nodes.withColumn("sanitized", __import__("pyspark").sql.functions.upper("text"))
    back = {r["page_id"]: r["sanitized"] for r in html.with_nodes(df, upper).collect()}
    assert back[1] == "<pre>own<b>X@Y.COM</b>own<br>own</pre>OUT" and back[4] == "MAIL A@X.COM &amp; B@X.COM 1 &lt; 2 &lt;" and back[3] == '<a title="a>b" href=\'x">\'>LINK</a>'


def test_output_paths(spark):
    listed = spark.createDataFrame([("/root/x/Acme.xls", 1)], "path string, size bigint")
    parts = files.path_parts(files.manifest(listed, "/root"))
    out = files.joined_paths(parts.withColumnRenamed("text", "sanitized")).first()
    assert out["output"] == "x/Acme.xlsx"


def test_stream(spark, tmp_path):
    from maskflow.streaming.sanitize import mask_formed, sanitize_stream

    src = str(tmp_path / "src")
    spark.createDataFrame([(1, "a@x.com pay 6222021234567890123")], "doc_id int, text string").write.parquet(src)
    read = lambda: spark.readStream.schema("doc_id int, text string").parquet(src)
    q = sanitize_stream(read(), str(tmp_path / "map"), str(tmp_path / "out"), "doc_id").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).first()["sanitized"].startswith("user_01@example.com pay ")
    q = mask_formed(read()).writeStream.format("memory").queryName("masked").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("masked").first()["sanitized"].startswith("[email] pay ")


def test_queries_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem documents pages".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ("sanitized_emails", "spans_resolved", "map_company", "csv_cells", "html_text_nodes", "mask_iban", "dictionary_table_matches", "keyword_file_parse", "response_parse", "new_keywords", "indexed_documents"):
        got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
        rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
        assert rows(got) == rows(want), name
