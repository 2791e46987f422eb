"""CSV files cut anywhere, in every encoding, wide ones and ones with line ends in cells, against the csv module."""

import csv
import io
import random

import pytest

from maskflow.sources import csv_cells, files

TRICKY = 'a,"b\n1,2\n""q"", x",c\n\n"","\n\n",x"y,"p"q,"open\nand,""more\n",z\n1,,2\n"last\nnot closed'
PARTS = ["a", "b,", ",", '"', '""', "\n", "\n\n", '"x', 'y"', " ", "1,2"]


def plain(text, delimiter=","):
    """Cells under the csv module, which a whole text goes through."""
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    return {(r, c): cell for r, row in enumerate(rows) for c, cell in enumerate(row)}


def in_splits(lines, cuts):
    """Cells of lines that are cut before each of ``cuts``, as the jobs do it."""
    blocks = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)]) if a < b]  # a split without lines has no row
    inside, row, col, out = False, 0, 0, {}
    for k, block in enumerate(blocks):
        for r, c, cell, _ in csv_cells.placed(block, inside, row, col, k == len(blocks) - 1, ","):
            out[(r, c)] = out.get((r, c), "") + cell
        rows, ends_inside, ends_col = csv_cells.summed(block, inside, ",")
        inside, col, row = ends_inside, ends_col + (col if inside and rows == 0 else 0), row + rows
    return out


def test_every_cut_gives_the_same_cells():
    lines = TRICKY.split("\n")
    want = plain(TRICKY)
    for a in range(len(lines) + 1):
        for b in range(a, len(lines) + 1):
            assert in_splits(lines, [a, b]) == want, (a, b)
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 25)))
        lines = text.removesuffix("\n").split("\n")
        cuts = sorted(rng.randint(0, len(lines)) for _ in range(3))
        want = plain(text)
        if text.endswith("\n") and summed_inside(lines):
            last = max(want)
            want[last] = want[last].removesuffix("\n")  # a cell that isn't closed ends with its last line
        assert in_splits(lines, cuts) == want, (text, cuts)


def summed_inside(lines):
    return csv_cells.summed(lines, False, ",")[1]


@pytest.mark.parametrize("size", [2, 5, 20, 1000])
def test_files_in_many_tasks(spark, tmp_path, size):
    """Splits of a few bytes: the scan's own cutting."""
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "a+b %.csv").write_bytes(b"\xef\xbb\xbf" + TRICKY.replace("\n", "\r\n").encode())
    (tmp_path / "t.TSV").write_text("a\tb,c\n\"x\ny\"\tz\n", encoding="utf-8")
    (tmp_path / "gb.csv").write_bytes("名称,金额\n中国人民银行的一个客户名称,\"一\n二\"\n".encode("gb18030"))
    (tmp_path / "wide.csv").write_bytes("x,\"y\nz\"\n".encode("utf-16"))
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no,cells")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        cells = {}
        for r in files.read_csv_cells(spark, str(tmp_path)).collect():
            assert cells.setdefault((r["path"], r["row"], r["col"]), r["cell"]) is r["cell"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    of = lambda name: {(r, c): x for (p, r, c), x in cells.items() if p == str(tmp_path / name)}
    assert of("sub dir/a+b %.csv") == plain(TRICKY)
    assert of("t.TSV") == {(0, 0): "a", (0, 1): "b,c", (1, 0): "x\ny", (1, 1): "z"}
    assert of("gb.csv") == {(0, 0): "名称", (0, 1): "金额", (1, 0): "中国人民银行的一个客户名称", (1, 1): "一\n二"}
    assert of("wide.csv") == {(0, 0): "x", (0, 1): "y\nz"}
    assert len({p for p, _, _ in cells}) == 4


def test_only_own_files_are_read(spark, tmp_path):
    """A reader opens files of its kind up to its size and no others."""
    (tmp_path / "b.pdf").write_bytes(b"%PDF" * 1000)
    (tmp_path / "a.TXT").write_text("small", encoding="utf-8")
    (tmp_path / "large.txt").write_text("l" * 2000, encoding="utf-8")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1500)
    try:
        got = files.contents(spark, str(tmp_path), ".txt", largest=1500).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [(r["path"], bytes(r["content"])) for r in got] == [(str(tmp_path / "a.TXT"), b"small")]
    listed = files.scan_folder(spark, str(tmp_path))
    assert [(r["error"]) for r in files.too_large(listed.filter("extension = '.txt'"), 1500).collect()] == ["more than 1500 bytes: 2000"]
