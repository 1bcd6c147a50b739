"""A folder of documents of all kinds, read by the source."""

import json

import pytest

from lodestar.sources import documents
from lodestar.sources import readers as r


@pytest.fixture
def folder(tmp_path):
    sub = tmp_path / "a" / "b"
    sub.mkdir(parents=True)
    files = {
        "one.txt": b"one\xfftwo",
        "a/two.MD": b"# head",
        "a/b/rows.csv": b'x,"y, z"\n\n1,2\n',
        "a/b/items.json": json.dumps([{"text": " "}, {"content": "body"}, {"text": "t"}]).encode(),
        "a/qa.json": json.dumps({"data": [{"question": "q1", "answer": "a1"}, {"question": "q2"}]}).encode(),
        "broken.json": b"{",
        "deep.json": b"[" * 100_000,
        "page.html": b"<!-- <p>no</p> --><p>a &lt; b</p>\n\n<b> c </b>",
        "d.docx": r.make_docx(["one", "two"]),
        "p.pptx": r.make_pptx(["s1", "s2"]),
        "x.xlsx": r.make_xlsx("First", [["1", "2"]]),
        "broken.docx": b"no zip",
        "film.mp4": b"0",
        "nosuffix": b"0",
        "empty.txt": b"",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    return tmp_path


EXPECTED = {
    ("one.txt", 1, "onetwo"),
    ("two.MD", 1, "# head"),
    ("rows.csv", 1, "x y, z\n1 2"),
    ("items.json", 2, "body"),
    ("items.json", 3, "t"),
    ("qa.json", 1, "Q: q1\nA: a1"),
    ("page.html", 1, "a < b\nc"),
    ("d.docx", 1, "one\ntwo"),
    ("p.pptx", 1, "s1"),
    ("p.pptx", 2, "s2"),
    ("x.xlsx", 1, "Sheet: First\n1 2"),
    ("empty.txt", 1, ""),
}


@pytest.mark.parametrize("tasks", [1, 7])
def test_each_page_once_whatever_the_tasks(spark, folder, tasks):
    documents.register(spark)
    found = spark.read.format("documents").option("tasks", str(tasks)).load(f"file://{folder}")
    assert found.rdd.getNumPartitions() == tasks
    rows = [(x.path.rsplit("/", 1)[-1], x.page, x.text) for x in found.collect()]
    assert len(rows) == len(EXPECTED) and set(rows) == EXPECTED


def test_the_driver_lists_nothing(folder, monkeypatch):
    monkeypatch.setattr(documents, "walk", lambda *a: pytest.fail("listed"))
    reader = documents.Documents({"path": str(folder)}).reader(None)
    assert [p.value for p in reader.partitions()] == [(k, documents.TASKS) for k in range(documents.TASKS)]


def test_an_empty_folder_has_no_pages(spark, tmp_path):
    documents.register(spark)
    assert spark.read.format("documents").load(str(tmp_path)).collect() == []
