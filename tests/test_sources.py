import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cairnkit.exceptions import DocumentLoadError, UnsupportedFileTypeError
from cairnkit.sources import files
from tests.conftest import rows

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    for name, raw in {"sample.txt": b"plain \xe4\xbd\xa0\xe5\xa5\xbd", "sample.md": b"\xef\xbb\xbf# head", "old.log": "中文日志".encode("gb18030"), "wide.cfg": "é=1".encode("utf-16"), "odd.ini": b"\xff\x81\xff", "code.PY": b"x = 1\n", "sample.docx": docx("one", "", "two"), "bad.docx": b"no zip", "page.pdf": b"%PDF-", "image.bin": b"\x00", "noext": b"x", "empty.txt": b""}.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_text("deep")
    return tmp_path


def test_files_load_by_type_and_faults_are_rows(spark, folder):
    # Spark lists no empty file, so that empty.txt has no row
    got = {r.source_path.rsplit("/", 1)[-1]: r for r in files.load(spark, str(folder)).collect()}
    assert {n: r.text for n, r in got.items() if r.error is None} == {"sample.txt": "plain 你好", "sample.md": "# head", "old.log": "中文日志", "wide.cfg": "é=1", "odd.ini": b"\xff\x81\xff".decode("latin-1"), "code.PY": "x = 1\n", "sample.docx": "one\ntwo"}
    assert got["code.PY"].file_type == "code" and got["sample.docx"].size_bytes == (folder / "sample.docx").stat().st_size and got["sample.txt"].source_path == str(folder / "sample.txt")
    assert got["image.bin"].error.startswith("UnsupportedFileTypeError") and got["noext"].file_type is None
    assert got["bad.docx"].error.startswith("BadZipFile") and got["page.pdf"].error


def test_one_document(spark, folder):
    assert files.load_one(spark, str(folder / "sample.docx")) == "one\ntwo"
    assert files.load_one(spark, str(folder / "sample.md"), normalize=True) == "# head"
    with pytest.raises(UnsupportedFileTypeError):
        files.load_one(spark, str(folder / "image.bin"))
    for missing in ("none.txt", "bad.docx"):
        with pytest.raises(DocumentLoadError):
            files.load_one(spark, str(folder / missing))


def test_scan_and_histogram(spark, folder):
    names = [r.source_path.rsplit("/", 1)[-1] for r in files.scan(spark, str(folder)).collect()]
    assert names == sorted(n for n in ("sample.txt", "sample.md", "old.log", "wide.cfg", "odd.ini", "code.PY", "sample.docx", "bad.docx", "page.pdf"))
    assert files.scan(spark, str(folder), [".TXT"], 1).count() == 1
    assert dict(rows(files.extension_histogram(files.scan(spark, str(folder)))))[".txt"] == 1


def test_tables(spark):
    data = [[["A", "B"], ["1", "2"]], [["x|y", None, " z "], ["a\nb"]], [], [["one"]]]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, c array<array<string>>")
    got = [r.m for r in df.select("i", files.markdown_table(F.col("c")).alias("m")).orderBy("i").collect()]
    assert got == [files.md_table(d) for d in data] and got[0] == "| A | B |\n| --- | --- |\n| 1 | 2 |"
