"""Readers and sinks by round trips over small files."""

import base64
import json
import zipfile

from lodestar.sources import readers as r


def test_text_csv_json(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\xfftwo")
    assert r.read_text(spark, str(tmp_path / "a.txt")).first().text == "onetwo"
    (tmp_path / "b.csv").write_text('x,"y, z"\n1,2\n')
    assert r.read_csv_rows(spark, str(tmp_path / "b.csv")).first().text == "x y, z\n1 2"
    (tmp_path / "c.json").write_text(json.dumps([{"text": ""}, {"content": "body"}, {"text": "t"}]))
    assert [(x.page, x.text) for x in r.read_json_pages(spark, str(tmp_path / "c.json")).orderBy("page").collect()] == [(2, "body"), (3, "t")]
    assert {x.suffix for x in r.list_files(spark, str(tmp_path)).collect()} == {"txt", "csv", "json"}


def test_qa_and_jsonl(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"data": [{"question": "q1", "answer": "a1"}, {"question": "q2", "answer": ""}]}))
    assert [x.text for x in r.read_qa(spark, str(tmp_path / "q.json")).collect()] == ["Q: q1\nA: a1"]
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n\nbad\n{"id": 2}\n')
    assert sorted(x.id for x in r.read_jsonl(spark, str(tmp_path / "l.jsonl"), "id int").collect() if x.id) == [1, 2]


def test_ground_truth_fallbacks(spark, tmp_path):
    (tmp_path / "g.csv").write_text('query,query_id,relevance_json,expected_chunk_ids,expected_chunk_id\na,,"{""c1"": 2}",,\nb,q2,,c2;c3,\nc,,,,c4\n,q4,,c5,\n')
    queries, grades = r.read_ground_truth(spark, str(tmp_path / "g.csv"))
    assert {x.query_id for x in queries.collect()} == {"row_0", "q2", "row_2"}
    assert {(x.query_id, x.chunk_id, x.grade) for x in grades.collect()} == {("row_0", "c1", 2.0), ("q2", "c2", 1.0), ("q2", "c3", 1.0), ("row_2", "c4", 1.0)}


def test_office_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w"><w:p><w:t>one</w:t></w:p><w:p/><w:p><w:t>two</w:t></w:p></w:d>')
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<x:w xmlns:x="x"><x:sheet name="First"/></x:w>')
        z.writestr("xl/worksheets/sheet1.xml", '<x:w xmlns:x="x"><x:row><x:c><x:v>1</x:v></x:c><x:c><x:v>2</x:v></x:c></x:row></x:w>')
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    found = {x.path.rsplit("/", 1)[-1]: x.text for x in r.read_office(spark, str(tmp_path)).collect()}
    assert found == {"d.docx": "one\ntwo", "s.xlsx": "Sheet: First\n1 2"}


def test_html_and_images(spark):
    image = base64.b64encode(b"png").decode()
    pages = spark.createDataFrame([(1, f'<p>a &lt; b</p><img src="data:image/png;base64,{image}">')], "page_id int, html string")
    assert pages.select(r.html_text(pages.html).alias("t")).first().t == "a < b"
    assert bytes(r.embedded_images(pages).first().image) == b"png"


def test_sinks_and_vectors(spark, tmp_path):
    r.write_chunks(r.tiny_corpus(spark), str(tmp_path / "out"))
    r.write_chunks(r.tiny_corpus(spark), str(tmp_path / "out"), append=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 6
    v = r.synthetic_vectors(spark, 5, 8)
    assert all(abs(sum(x * x for x in row.embedding) - 1) < 1e-5 for row in v.collect())
