import io
import zipfile

import pytest

from maskflow.operators import folder
from maskflow.operators.store import Store
from maskflow.sources import office
from tests.test_sources import W, workbook, zipped


def make(root):
    (root / "Acme").mkdir(parents=True)
    (root / "Acme" / "a.txt").write_text("Acme wrote to x@y.com and z@y.com", encoding="utf-8")
    (root / "b.csv").write_bytes(b"name,total\r\nAcme,1000\r\nOther,2024\r\n")
    (root / "c.html").write_text("<p>x@y.com &amp; <b>Acme</b><pre>acme</pre></p>", encoding="utf-8")
    (root / "d.xlsx").write_bytes(workbook())
    body = f"<w:document {W}><w:body><w:p><w:r><w:t>By Acme, </w:t></w:r><w:r><w:t>1,500.00 paid</w:t></w:r></w:p><w:p><w:r><w:t>kept</w:t></w:r></w:p></w:body></w:document>"
    (root / "e.docx").write_bytes(zipped({"word/document.xml": body, "other.bin": "x"}))
    (root / "f.xlsx").write_bytes(b"junk")
    (root / "g.pdf").write_bytes(b"%PDF")


def read(path):
    return path.read_bytes()


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("job")
    make(root / "in")
    store = Store(spark, str(root / "store"))
    job = folder.FolderJob(spark, store, [("company", "acme")], unified=False, limits=(2.0, 2.0000001))
    return root, store, job, job.run(str(root / "in"))


def test_first_run(spark, ran):
    root, store, job, outcome = ran
    out = root / ("in" + folder.OUTPUT_SUFFIX)
    assert outcome.done == "full" and outcome.output == str(out)
    mapping = {r["original"]: r["replacement"] for r in store.read("mapping").collect()}
    # the path comes first, then texts from right to left
    assert mapping["Acme"] == "Company_A" and mapping["z@y.com"] == "user_01@example.com" and mapping["x@y.com"] == "user_02@example.com"
    assert (out / "Company_A" / "a.txt").read_text(encoding="utf-8") == "Company_A wrote to user_02@example.com and user_01@example.com"
    factors = {r["seed"]: r["factor"] for r in store.read("scale_factors").collect()}
    assert set(factors) == {"b.csv::data", "d.xlsx::One", "e.docx"}  # limits that aren't in order give the usual range
    total = int(1000 * factors["b.csv::data"] + (0.5 if factors["b.csv::data"] > 0 else 0))
    rows = read(out / "b.csv").decode().split("\r\n")
    assert rows[0] == "name,total" and rows[1].startswith("Company_A,") and abs(int(rows[1].split(",")[1]) - total) <= 1 and rows[2] == "Other,2024"
    assert (out / "c.html").read_text(encoding="utf-8") == "<p>user_02@example.com &amp; <b>Company_A</b><pre>acme</pre></p>"
    cells = {(c[3]): c for c in office.workbook_cells(read(out / "d.xlsx"))}
    assert cells[0][5] == "Company_A" and cells[2][6] == pytest.approx(1.5 * factors["d.xlsx::One"], rel=0.05) and cells[3][6] == 45000 and cells[3][8] == "mm-dd-yy"
    assert cells[4][7] is True and cells[5][5] == "=SUM(C1)"
    texts = [t for _, t in office.document_paragraphs(read(out / "e.docx"))]
    assert texts[0].startswith("By Company_A, ") and "1,500.00" not in texts[0] and texts[1] == "kept"
    assert zipfile.ZipFile(io.BytesIO(read(out / "e.docx"))).read("other.bin") == b"x"
    assert {r["relative"] for r in outcome.errors.collect()} == {"f.xlsx", "g.pdf"}
    counts = {(r["relative"], r["entity_type"]): r["n"] for r in outcome.counts.collect()}
    assert counts[("Acme/a.txt", "email")] == 2 and counts[("Acme/a.txt", "company")] == 2
    assert not list((root / "in").glob("*" + folder.OUTPUT_SUFFIX)) and (out / folder.REPORT).is_dir()


def test_incremental_runs(spark, ran):
    root, store, job, _ = ran
    source = str(root / "in")
    assert job.run(source, incremental=True).done == "nothing new"
    job.keywords.append(("person", "nobody here"))
    (root / "in" / "f.xlsx").unlink()
    (root / "in" / "g.pdf").unlink()
    assert job.run(source, incremental=True).done == "nothing affected"
    assert {r["keyword"] for r in store.read("keywords").collect()} == {"acme", "nobody here"}
    job.keywords.append(("person", "Other"))
    again = job.run(source, str(root / "again"), incremental=True)
    assert again.done == "incremental" and [r["output"] for r in again.written.collect()] == ["b.csv"]
    assert read(root / "again" / "b.csv").decode().split("\r\n")[2] == "Person_01,2024"
    with pytest.raises(ValueError):
        job.run(source, source + "/")


def test_names_from_a_recogniser(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Zoe\\E Ltd met Bob (x", encoding="utf-8")

    def recogniser(texts):
        return ['[{"text": "Zoe\\\\E Ltd", "type": "company"}, {"text": "Bob (x", "type": "person"}]'] * len(texts)

    job = folder.FolderJob(spark, Store(spark, str(tmp_path / "store")), recogniser=recogniser)
    job.run(str(tmp_path / "in"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.txt").read_text(encoding="utf-8") == "Company_A met Person_01"


def test_wide_tables_clashing_names_and_large_files(spark, tmp_path, monkeypatch):
    """20,000 columns come back cell by cell, files that would share an output path don't, one that is too large is listed."""
    from maskflow.sources import files

    root = tmp_path / "in"
    (root / "Acme").mkdir(parents=True)
    (root / "Company_A").mkdir()
    (root / "Acme" / "n.txt").write_text("one", encoding="utf-8")
    (root / "Company_A" / "n.txt").write_text("two", encoding="utf-8")
    wide = [["x@y.com" if c == 16384 else f"c{c}" for c in range(20_000)], ["y"] + ["keep this text exactly as it is"] * 3]
    (root / "wide.csv").write_text("\r\n".join(",".join(r) for r in wide) + "\r\n", encoding="utf-8", newline="")
    (root / "a.xlsx").write_bytes(workbook())
    xml = '<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet ss:Name="S"><Table><Row><Cell><Data ss:Type="String">old</Data></Cell></Row></Table></Worksheet></Workbook>'
    (root / "a.xls").write_text(xml, encoding="utf-8")
    (root / "large.txt").write_text("z" * 50_000, encoding="utf-8")
    monkeypatch.setattr(files.contents, "__kwdefaults__", {"largest": 40_000})
    monkeypatch.setattr(files.too_large, "__defaults__", (40_000,))
    job = folder.FolderJob(spark, Store(spark, str(tmp_path / "store")), [("company", "Acme")])
    outcome = job.run(str(root))
    out = tmp_path / ("in" + folder.OUTPUT_SUFFIX)
    want = [["user_01@example.com" if x == "x@y.com" else x for x in r] for r in wide]
    assert [r.split(",") for r in (out / "wide.csv").read_text(encoding="utf-8").split("\n")[:2]] == want
    assert {r["relative"] for r in outcome.errors.collect()} == {"large.txt"}
    texts = {p.name: p.read_text(encoding="utf-8") for p in (out / "Company_A").iterdir()}
    assert sorted(texts.values()) == ["one", "two"] and "n.txt" in texts
    books = sorted(p.name for p in out.glob("*.xlsx"))
    assert len(books) == 2 and "a.xlsx" in books
    cells = [[c[5] for c in office.workbook_cells(read(out / b))][:1] for b in books]
    assert sorted(cells) == [["Company_A"], ["old"]]
