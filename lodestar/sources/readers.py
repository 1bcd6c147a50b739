"""Readers of files to pages of text, sinks, and their SQL forms over the tables."""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import builder, template
from ..operators.retrieval import gold
from ..plans.dialect import Dialect
from ..plans.store import checkpoint_folder

# fixed values: suffixes by kind
TEXT = ("txt", "md", "csv", "json", "html", "htm", "pdf", "docx", "xlsx", "xls", "pptx")
IMAGE, AUDIO, VIDEO = ("png", "jpg", "jpeg", "webp", "bmp"), ("mp3", "wav", "m4a", "flac"), ("mp4", "mov", "avi", "mkv")


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = TEXT) -> DataFrame:
    """(path, length, modificationTime, suffix) of the files with a known suffix, in no order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).drop("content")
    return files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("suffix").isin(*suffixes))


def modality(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin(*TEXT), "text").when(suffix.isin(*IMAGE), "image").when(suffix.isin(*AUDIO), "audio").when(suffix.isin(*VIDEO), "video").otherwise("unknown")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text): whole files as one page, undecodable bytes ignored."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.lit(1).alias("page"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\uFFFD", "").alias("text"))


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text): cells joined by a space, rows by a line end, in the order of the file."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a quoted cell may hold commas, quotes and line ends
            texts = ["\n".join(" ".join(r) for r in csv.reader(io.StringIO(t or "", newline="")) if r) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([1] * len(texts), pa.int32()), pa.array(texts, pa.string())], names=["path", "page", "text"])

    return raw.mapInArrow(run, "path string, page int, text string")


def read_json_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text): a list's items by the first that is not empty of text, content, page_content."""
    rows = spark.read.schema("text string, content string, page_content string").option("multiLine", "true").json(path).select("*", F.col("_metadata.file_path").alias("path"))
    page = F.row_number().over(Window.partitionBy("path").orderBy(F.monotonically_increasing_id()))
    filled = [F.when(F.trim(c) != "", F.col(c)) for c in ("text", "content", "page_content")]
    return rows.select("path", page.alias("page"), F.coalesce(*filled).alias("text")).where("text is not null")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): questions and answers, keys question/Q and answer/A, if both are there."""
    rows = spark.read.option("multiLine", "true").json(path)
    columns = {c.lower(): c for c in rows.columns}
    if "data" in columns:
        rows = rows.select(F.explode(columns["data"]).alias("d")).select("d.*")
        columns = {c.lower(): c for c in rows.columns}
    pick = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(columns[n])), F.lit("")) for n in names if n in columns), F.lit(None).cast("string"))
    return rows.select(pick("question", "q").alias("q"), pick("answer", "a").alias("a")).where("q is not null and a is not null").select(F.concat(F.lit("Q: "), "q", F.lit("\nA: "), "a").alias("text"))


def html_text(html: Column) -> Column:
    """Text nodes of a page by line: tags out, common entities read, blank lines out."""
    x = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"<[^>]*>", "\n")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(x, r"[ \t]*\n\s*", "\n"), r"^\s+|\s+$", "")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """queries(query_id, query) and qrels(query_id, chunk_id, grade) of a CSV with a header.

    Grades come from relevance_json, else from expected_chunk_ids (by ;), else from expected_chunk_id, and
    are 1 where unspecified; the default id is row_<i> over all rows.
    """
    rows = spark.read.option("header", "true").option("escape", '"').csv(path)
    for c in ("query_id", "relevance_json", "expected_chunk_ids", "expected_chunk_id"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1  # a file of queries, not a corpus
    rows = rows.withColumn("query_id", F.coalesce(F.nullif(F.trim("query_id"), F.lit("")), F.concat(F.lit("row_"), place))).where(F.trim("query") != "")
    graded = F.from_json("relevance_json", "map<string,double>")
    listed = F.filter(F.transform(F.split(F.coalesce(F.nullif(F.trim("expected_chunk_ids"), F.lit("")), "expected_chunk_id"), ";"), lambda x: F.trim(x)), lambda x: x != "")
    grades = F.coalesce(F.when(F.size(graded) > 0, graded), F.map_from_arrays(listed, F.transform(listed, lambda x: F.lit(1.0))))
    return rows.select("query_id", "query"), rows.select("query_id", F.explode(grades).alias("chunk_id", "grade"))


def _docx(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith("}p")]
    return ["\n".join(x for x in lines if x.strip())]


def _pptx(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        return ["\n".join(t.text for t in ElementTree.fromstring(z.read(n)).iter() if t.tag.endswith("}t") and t.text) for n in slides]


def _xlsx(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter() if t.tag.endswith("}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if s.tag.endswith("}sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        pages = []
        for title, name in zip(titles, sheets, strict=False):
            rows = []
            for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if r.tag.endswith("}row")):
                cells = [(c.get("t"), "".join(v.text or "" for v in c.iter() if v.tag.endswith("}v") or v.tag.endswith("}t"))) for c in row if c.tag.endswith("}c")]
                rows.append(" ".join(shared[int(v)] if kind == "s" else v for kind, v in cells if v))
            pages.append(f"Sheet: {title}\n" + "\n".join(r for r in rows if r))
    return pages


OFFICE = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}


def office_pages(files: DataFrame) -> DataFrame:
    """(path, page, text) of files (path, content): docx, pptx and xlsx; one that cannot be read has no pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(name, k, t) for k, t in enumerate(OFFICE[name.rsplit(".", 1)[-1].lower()](content), 1)]
                except (KeyError, TypeError, zipfile.BadZipFile, ElementTree.ParseError, ValueError, IndexError):
                    continue
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["path", "page", "text"])

    return files.select("path", "content").where("path is not null").mapInArrow(run, "path string, page int, text string")


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """office_pages of the files of a path."""
    return office_pages(spark.read.format("binaryFile").load(path))


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def make_docx(lines: list[str]) -> bytes:
    """The least docx with a paragraph a line."""
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
    return _zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'})


def make_pptx(slides: list[str]) -> bytes:
    return _zipped({f"ppt/slides/slide{k}.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><a:t>{escape(x)}</a:t></p:sld>' for k, x in enumerate(slides, 1)})


def make_xlsx(title: str, rows: list[list[str]]) -> bytes:
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in r) + "</row>" for r in rows)
    return _zipped({"xl/workbook.xml": f'<workbook xmlns="m"><sheets><sheet name="{escape(title)}"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f"<worksheet xmlns='m'><sheetData>{cells}</sheetData></worksheet>"})


def _nations(get, suffix: str, make) -> DataFrame:
    """Office files made of each region's nations, read again."""
    listed = get("nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f"region{k}.{suffix}", make(k, [(x["n_nationkey"], x["n_name"]) for x in n])) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "content"])

    return office_pages(listed.mapInArrow(files, "path string, content binary"))


def _rewritten(spark: SparkSession, df: DataFrame, write, read) -> DataFrame:
    """df, written to a folder of the shared checkpoint folder and read from there."""
    path = f"{checkpoint_folder(spark)}/sink-{uuid.uuid4().hex}"
    write(df, path)
    return read(path)


def embedded_images(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Columns of pages without the HTML, and one row for each base64 image: its place and bytes."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"data:image/[a-z]+;base64,([A-Za-z0-9+/=]+)"), F.lit(1))
    return pages.select(*(c for c in pages.columns if c != html_col), F.posexplode(found).alias("place", "base64")).withColumn("image", F.unbase64("base64")).drop("base64")


def write_chunks(chunks: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; Parquet is the better choice for anything that is read again."""
    chunks.write.mode("append" if append else "overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def synthetic_vectors(spark: SparkSession, n: int, dims: int = 64, seed: int = 42) -> DataFrame:
    """n unit vectors of seeded normal components."""
    raw = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*(F.randn(seed + k) for k in range(dims))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return raw.withColumn("n", norm).select("vec_id", F.transform("v", lambda x: (x / F.col("n")).cast("float")).alias("embedding"))


def tiny_corpus(spark: SparkSession) -> DataFrame:
    rows = [("doc1_c1", "doc1.pdf", "Retrieval finds passages that answer a question.", 30), ("doc2_c1", "doc2.pdf", "Fusion joins ranked lists into one.", 28), ("doc3_c1", "doc3.pdf", "Verification checks claims against evidence.", 25)]
    return spark.createDataFrame(rows, "chunk_id string, source string, content string, token_count int")


template("SRC03_csv_rows")(lambda d: f"select n_regionkey, {d.gather('cells', 'n_nationkey', 'chr(10)')} as page from (select n_regionkey, n_nationkey, concat_ws(' ', n_nationkey, n_name, n_regionkey) as cells from nation) r group by n_regionkey")
template("SRC04_json_items")(lambda d: f"select event_id, coalesce(nullif({d.json('props', 'text')}, ''), nullif({d.json('props', 'session')}, ''), event_type) as item from events")
template("SRC05_qa_pairs")(lambda d: "select q.conv_id, q.turn, 'Q: ' || q.text || chr(10) || 'A: ' || a.text as pair from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 where q.role = 'user' and a.role = 'assistant' and trim(q.text) <> '' and trim(a.text) <> ''")


@template("SRC06_html_text")
def _html(d: Dialect) -> str:
    x = d.sub(d.sub("html", r"(?s)<!--.*?-->", "''"), r"<[^>]*>", "chr(10)")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {d.text(name)}, {d.text(char)})"
    return f"select page_id, {d.strip(d.sub(x, r'[ \t]*\n\s*', 'chr(10)'))} as text from pages"


template("SRC12_dispatch")(lambda d: f"select page_id, case when suffix in ('html', 'htm') then 'html' when suffix in ('csv', 'json', 'pdf', 'docx', 'xlsx', 'pptx', 'txt', 'md') then suffix else 'unsupported' end as reader from (select page_id, lower({d.extract('url', r'\.([A-Za-z0-9]+)$', 1)}) as suffix from pages) s")
template("SRC13_jsonl_scan")(lambda d: f"select event_id, {d.json('props', 'session')} as session from events where props is not null and trim(props) <> '' and props like '{{%}}'")
template("SRC14_ground_truth")(lambda d: f"select g.query_id, g.doc_id as chunk_id, 1e0 as grade from ({gold(d)}) g join benchmark on item_id = g.query_id where trim(text) <> ''")
template("SRC15_graded_truth")(lambda d: f"select 'line_' || s.query_id as query_id, count(*) as n_gold, sum(case when full_.doc_id is not null then 2 else 1 end) as total_grade from ({gold(d, 40)}) s left join ({gold(d)}) full_ on full_.query_id = s.query_id and full_.doc_id = s.doc_id group by s.query_id")
template("SRC17_embedded_images")(lambda d: f"select page_id, {d.size(d.all('html', r'<img[^>]*>'))} as images, {d.size(d.all('html', r'data:image/[a-z]+;base64,([A-Za-z0-9+/=]+)', 1))} as inline_images from pages")
builder("SRC01_document_listing", "select source, doc_id from documents")(lambda spark, get: get("documents").select("source", "doc_id"))
builder("SRC02_whole_texts", "select doc_id, 1 as page, replace(text, chr(65533), '') as text from documents")(lambda spark, get: get("documents").select("doc_id", F.lit(1).alias("page"), F.regexp_replace("text", "�", "").alias("text")))
builder("SRC19_synthetic_vectors")(lambda spark, get: synthetic_vectors(spark, 1000))
builder("SRC20_tiny_corpus", "select 'doc' || k || '_c1' as chunk_id, 'doc' || k || '.pdf' as source, content, token_count from (values (1, 'Retrieval finds passages that answer a question.', 30), (2, 'Fusion joins ranked lists into one.', 28), (3, 'Verification checks claims against evidence.', 25)) v(k, content, token_count)")(lambda spark, get: tiny_corpus(spark))
builder("SRC08_docx", "select 'region' || n_regionkey || '.docx' as path, 1 as page, string_agg(n_name, chr(10) order by n_nationkey) as text from nation group by n_regionkey")(lambda spark, get: _nations(get, "docx", lambda k, n: make_docx([x for _, x in n])))
builder("SRC09_pptx", "select 'region' || n_regionkey || '.pptx' as path, cast(row_number() over (partition by n_regionkey order by n_nationkey) as int) as page, n_name as text from nation")(lambda spark, get: _nations(get, "pptx", lambda k, n: make_pptx([x for _, x in n])))
builder("SRC10_xlsx", "select 'region' || n_regionkey || '.xlsx' as path, 1 as page, 'Sheet: nations' || chr(10) || string_agg(n_nationkey || ' ' || n_name, chr(10) order by n_nationkey) as text from nation group by n_regionkey")(lambda spark, get: _nations(get, "xlsx", lambda k, n: make_xlsx("nations", [[str(i), x] for i, x in n])))
builder("SNK01_chunk_lines", "select doc_id, source, n_chars, text from documents")(lambda spark, get: _rewritten(spark, get("documents").select("doc_id", "source", "n_chars", "text"), write_chunks, lambda path: read_jsonl(spark, path, "doc_id long, source string, n_chars long, text string")))
builder("SNK06_vectors", "select vec_id, len(embedding) as dims, round(cast(embedding[1] as double), 6) as x1, label from embeddings")(lambda spark, get: _rewritten(spark, get("embeddings"), write_vectors, spark.read.parquet).selectExpr("vec_id", "cast(size(embedding) as bigint) as dims", "round(cast(embedding[0] as double), 6) as x1", "label"))
