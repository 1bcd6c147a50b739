"""Windows that know their place, and chunkers called from SQL."""

import pytest

from lodestar import catalog
from lodestar.functions import tables
from lodestar.operators import greedy
from lodestar.operators.anchored import anchored_windows, windows


def plain(text, size, overlap, least):
    """Windows by joining tokens and searching for the result in texts whose tokens are one space apart."""
    words, found, step = text.split(" "), [], size - overlap
    for k in range(0, len(words), step):
        if k and k - step + size >= len(words):
            break
        own = " ".join(words[k : k + size])
        said = greedy.strict_sentences(own)
        kept = " ".join(said[:-1]) if len(said) >= 2 and len(said[-1].split()) < least else own
        start = len(" ".join(words[:k])) + bool(k)
        found.append((k, len(kept.split()), start, start + len(kept)))
    return found


def test_windows_equal_the_plain_version():
    text = " ".join(f"Word {'and more ' * (i % 7)}number {i}." for i in range(60))
    for size, overlap in ((9, 3), (20, 0), (256, 64), (5, 4)):
        assert list(anchored_windows(text, size, overlap)) == plain(text, size, overlap, 6)
    assert any(n < 20 for _, n, _, _ in list(anchored_windows(text, 20, 0))[:-1])


def test_windows_of_odd_texts():
    assert list(anchored_windows("")) == list(anchored_windows(" \n\t ")) == []
    text = "  One sentence of quite a few words stands here.\n\n\tToo  short. "
    ((first, n, start, end),) = anchored_windows(text)
    assert (first, n, text[start:end]) == (0, 9, "One sentence of quite a few words stands here.")
    ((_, _, start, end),) = anchored_windows("é one. two")
    assert (start, end) == (0, 10)


def test_every_chunk_is_where_it_says(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows = catalog.queries()["CHK03_anchored_windows"](spark, data).collect()
    assert rows and all(texts[r.doc_id][r.char_start : r.char_end] == r.chunk and len(r.chunk.split()) == r.tokens for r in rows)
    assert {r.doc_id for r in rows} == {k for k, t in texts.items() if t and t.split()}
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b", 5), (1, "x " * 100_000, 5)], "doc_id long, text string, tokens int")
    found = windows(odd).collect()
    assert {r.doc_id for r in found} == {None, 1} and max(r.char_end for r in found) == 199_999
    assert windows(odd.limit(0)).collect() == []


@pytest.fixture
def docs(spark):
    rows = [(1, "A first sentence. And one more! " * 300, "a"), (2, "p\n\nq", "b"), (3, None, "c"), (4, "", "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    frame.createOrReplaceTempView("chunk_docs")
    tables.register(spark)
    yield frame
    spark.catalog.dropTempView("chunk_docs")


@pytest.mark.parametrize(("by", "chunker"), [("sentences", greedy.pack_sentences), ("paragraphs", greedy.pack_paragraphs), ("size", greedy.split_by_size)])
def test_lateral_calls_equal_chunked(spark, docs, by, chunker):
    called = spark.sql(f"select d.doc_id, c.* from chunk_docs d, lateral chunks(d.text, '{by}') c")
    assert sorted(called.collect()) == sorted(greedy.chunked(docs, chunker).collect())


def test_table_calls_keep_the_other_columns(spark, docs):
    found = spark.sql("select * from table_chunks(table(chunk_docs), 'text', 'windows')")
    assert found.columns == ["doc_id", "source", "place", "chunk", "tokens", "char_start", "char_end"]
    expected = [(r.doc_id, r.char_start, r.char_end, r.chunk) for r in windows(docs).collect()]
    assert sorted((r.doc_id, r.char_start, r.char_end, r.chunk) for r in found.collect()) == sorted(expected)
    with pytest.raises(Exception, match="chunks are by"):
        spark.sql("select * from chunks('a', 'lines')").collect()
    with pytest.raises(Exception, match="name of its column"):
        spark.sql("select * from table_chunks(table(chunk_docs), 'body', 'size')").collect()


def test_function_query_equals_packing(spark, data):
    both = [sorted(catalog.queries()[n](spark, data).collect()) for n in ("CHK06_chunk_function", "CHK06_sentence_packing")]
    assert both[0] == both[1]
