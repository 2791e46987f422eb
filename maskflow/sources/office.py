"""Office files: workbooks and documents in zipped XML, and the Excel XML of 2003.

Readers turn each file's bytes, as Spark's binaryFile source gives them, into rows;
a file that can't be read gives a row with its error instead of failing the job.
Workbooks are written anew from their cells, with values, formulas and number
formats; documents are patched, so that all but the changed paragraphs stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = "path string, sheet_ord int, sheet string, row int, col int, cell_type string, s string, d double, b boolean, number_format string, error string"
PARAGRAPHS = "path string, part string, frag_ord int, text string, error string"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
XML2003 = "{urn:schemas-microsoft-com:office:spreadsheet}"
# Number formats that a workbook doesn't spell out, as far as they are dates or times.
BUILT_IN_DATES = {14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0"}


def column_number(reference: str) -> int:
    """0 for A, 1 for B, ... from a cell reference."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def workbook_cells(content: bytes):
    """(sheet_ord, sheet, row, col, cell_type, s, d, b, number_format) of every cell that has a value."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        read = lambda name: ET.fromstring(z.read(name)) if name in names else None
        shared = [] if (x := read("xl/sharedStrings.xml")) is None else ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in x.findall(f"{SHEET}si")]
        formats: list[str] = []
        if (styles := read("xl/styles.xml")) is not None:
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{SHEET}numFmt")}
            used = styles.find(f"{SHEET}cellXfs")
            formats = [own.get(k, BUILT_IN_DATES.get(k, "General")) for k in (int(f.get("numFmtId", 0)) for f in (used if used is not None else []))]
        links = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        for n, sheet in enumerate(read("xl/workbook.xml").iter(f"{SHEET}sheet")):
            target = links[sheet.get(f"{REL}id")].lstrip("/")
            root = read(target if target.startswith("xl/") else f"xl/{target}")
            for r, row in enumerate(root.iter(f"{SHEET}row")):
                number = int(row.get("r", r + 1)) - 1
                for c, cell in enumerate(row.findall(f"{SHEET}c")):
                    kind, value, formula = cell.get("t", "n"), cell.findtext(f"{SHEET}v"), cell.find(f"{SHEET}f")
                    col = column_number(cell.get("r")) if cell.get("r") else c
                    style = int(cell.get("s", 0))
                    shown = formats[style] if style < len(formats) else "General"
                    at = (n, sheet.get("name"), number, col)
                    if formula is not None:
                        yield (*at, "string", "=" + (formula.text or ""), None, None, shown)
                    elif kind == "inlineStr":
                        yield (*at, "string", "".join(t.text or "" for t in cell.iter(f"{SHEET}t")), None, None, shown)
                    elif value is None:
                        continue
                    elif kind == "s":
                        yield (*at, "string", shared[int(value)], None, None, shown)
                    elif kind == "b":
                        yield (*at, "boolean", None, None, value == "1", shown)
                    elif kind in ("str", "d"):
                        yield (*at, "string" if kind == "str" else "date", value, None, None, shown)
                    elif kind == "e":
                        yield (*at, "error", value, None, None, shown)
                    else:
                        yield (*at, "number", None, float(value), None, shown)


def xml_2003_cells(content: bytes):
    """The same for the XML of 2003; missing cells shift the rest left, as there is no index."""
    import xml.etree.ElementTree as ET

    for n, sheet in enumerate(ET.fromstring(content).iter(f"{XML2003}Worksheet")):
        for r, row in enumerate(sheet.iter(f"{XML2003}Row")):
            for c, cell in enumerate(row.findall(f"{XML2003}Cell")):
                data = cell.find(f"{XML2003}Data")
                if data is None or data.text is None:
                    continue
                kind, at = data.get(f"{XML2003}Type", "String"), (n, sheet.get(f"{XML2003}Name"), r, c)
                if kind == "Number":
                    yield (*at, "number", None, float(data.text), None, "General")
                elif kind == "Boolean":
                    yield (*at, "boolean", None, None, data.text == "1", "General")
                else:
                    yield (*at, "date" if kind == "DateTime" else "string", data.text, None, None, "General")


def _paragraphs(z):
    """(part's name, its root, part, paragraph) in the order in which they are worked on."""
    import re
    import xml.etree.ElementTree as ET

    root = ET.fromstring(z.read("word/document.xml"))
    body = root.find(f"{WORD}body")
    for p in body.findall(f"{WORD}p"):
        yield "word/document.xml", root, "body", p
    for table in body.findall(f"{WORD}tbl"):
        for row in table.findall(f"{WORD}tr"):
            for cell in row.findall(f"{WORD}tc"):
                for p in cell.findall(f"{WORD}p"):
                    yield "word/document.xml", root, "table", p
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", n)):
        root = ET.fromstring(z.read(name))
        for p in root.findall(f"{WORD}p"):
            yield name, root, name[5:11], p


def document_paragraphs(content: bytes):
    """(part, text) of body paragraphs, then those of top-level tables, then of headers and footers."""
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for _, _, part, p in _paragraphs(z):
            yield part, "".join(t.text or "" for r in p.findall(f"{WORD}r") for t in r.findall(f"{WORD}t"))


def patched_document(content: bytes, texts: dict[int, str]) -> bytes:
    """A document with some paragraphs' texts, by number, replaced: the first run has the text, the others none."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    changed, out = {}, io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for k, (name, root, _, p) in enumerate(_paragraphs(z)):
            places = [t for r in p.findall(f"{WORD}r") for t in r.findall(f"{WORD}t")]
            if k in texts and places:
                places[0].text = texts[k]
                places[0].set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                for t in places[1:]:
                    t.text = ""
                changed[name] = root
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
            for name in z.namelist():
                made.writestr(name, ET.tostring(changed[name], encoding="UTF-8", xml_declaration=True) if name in changed else z.read(name))
    return out.getvalue()


def column_letters(n: int) -> str:
    """A for 0, B for 1, ..., AA for 26."""
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def workbook_bytes(cells: list[dict]) -> bytes:
    """A workbook of cells (sheet_ord, sheet, row, col, cell_type, s, d, b, number_format), in any order."""
    import io
    import zipfile
    from xml.sax.saxutils import escape, quoteattr

    formats = sorted({c["number_format"] or "General" for c in cells} - {"General"})
    style = {f: k + 1 for k, f in enumerate(formats)} | {"General": 0}
    sheets: dict[tuple[int, str], list[dict]] = {}
    for c in sorted(cells, key=lambda c: (c["sheet_ord"], c["row"], c["col"])):
        sheets.setdefault((c["sheet_ord"], c["sheet"]), []).append(c)

    def body(c: dict) -> str:
        at = f'r="{column_letters(c["col"])}{c["row"] + 1}" s="{style[c["number_format"] or "General"]}"'
        kind, text = c["cell_type"], c["s"]
        if kind == "number":
            return f"<c {at}><v>{c['d']!r}</v></c>"
        if kind == "boolean":
            return f'<c {at} t="b"><v>{int(c["b"])}</v></c>'
        if kind == "error":
            return f'<c {at} t="e"><v>{escape(text)}</v></c>'
        if text.startswith("="):
            return f"<c {at}><f>{escape(text[1:])}</f></c>"
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    def rows(own: list[dict]) -> str:
        out, at = [], None
        for c in own:
            if c["row"] != at:
                out.append(("</row>" if out else "") + f'<row r="{c["row"] + 1}">')
                at = c["row"]
            out.append(body(c))
        return "".join(out) + ("</row>" if out else "")

    main, relations = SHEET[1:-1], REL[1:-1]
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    names = [(k + 1, name) for k, (_, name) in enumerate(sheets)]
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k, _ in names)
        + "</Types>",
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{relations}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{relations}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="r{k}"/>' for k, name in names) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships">'
        + "".join(f'<Relationship Id="r{k}" Type="{relations}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k, _ in names)
        + f'<Relationship Id="r0" Type="{relations}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{head}<styleSheet xmlns="{main}"><numFmts count="{len(formats)}">'
        + "".join(f'<numFmt numFmtId="{163 + style[f]}" formatCode={quoteattr(f)}/>' for f in formats)
        + '</numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        + f'<cellXfs count="{len(formats) + 1}"><xf numFmtId="0"/>' + "".join(f'<xf numFmtId="{163 + style[f]}" applyNumberFormat="1"/>' for f in formats) + "</cellXfs></styleSheet>",
    }
    if not formats:
        parts["xl/styles.xml"] = parts["xl/styles.xml"].replace('<numFmts count="0"></numFmts>', "")
    for (k, _), own in zip(names, sheets.values()):
        parts[f"xl/worksheets/sheet{k}.xml"] = f'{head}<worksheet xmlns="{main}"><sheetData>{rows(own)}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL string, made where the session is."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _looks_like_xml(content: bytes) -> bool:
    return content.lstrip(b"\xef\xbb\xbf \r\n\t")[:5] == b"<?xml"


def read_cells(files: DataFrame) -> DataFrame:
    """Cells of workbooks in (path, content); the XML of 2003 is known by its beginning."""

    schema = arrow_schema(CELLS)

    def run(batches):
        import pyarrow as pa

        names = schema.names
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    for cell in (xml_2003_cells if _looks_like_xml(content) else workbook_cells)(content):
                        rows.append(dict(zip(names, (path, *cell, None))))
                        if len(rows) == 50_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                except Exception as e:  # the file's own fault: the job goes on
                    rows.append(dict.fromkeys(names) | {"path": path, "error": f"{type(e).__name__}: {e}"})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, CELLS)


def read_paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs of documents in (path, content), in the order in which they are worked on."""

    schema = arrow_schema(PARAGRAPHS)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    rows = [{"path": path, "part": part, "frag_ord": k, "text": t, "error": None} for k, (part, t) in enumerate(document_paragraphs(content))]
                except Exception as e:
                    rows = [{"path": path, "part": None, "frag_ord": None, "text": None, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, PARAGRAPHS)


def failed(read: DataFrame) -> DataFrame:
    """(path, error) of the files that couldn't be read."""
    return read.filter(F.col("error").isNotNull()).select("path", "error").distinct()


def workbook_contents(cells: DataFrame) -> DataFrame:
    """(output, content): a workbook for each ``output``; a file's cells meet in one task, as they did when it was read."""
    import pyarrow as pa

    schema = pa.schema([("output", pa.string()), ("content", pa.binary())])

    def write(key, table):
        return pa.Table.from_pylist([{"output": key[0].as_py(), "content": workbook_bytes(table.to_pylist())}], schema=schema)

    columns = ("output", "sheet_ord", "sheet", "row", "col", "cell_type", "s", "d", "b", "number_format")
    return cells.select(*columns).groupBy("output").applyInArrow(write, "output string, content binary")


def document_contents(documents: DataFrame) -> DataFrame:
    """(output, content) of documents (output, content, paragraphs: array of frag_ord and text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [patched_document(content, {p["frag_ord"]: p["text"] for p in texts or []}) for content, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["output", "content"])

    return documents.select("output", "content", "paragraphs").mapInArrow(run, "output string, content binary")
