"""Each operator and stage on nulls, empties, long texts, ties, repeated rows, empty tables, clashing columns."""


import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestar.llm import bpe, hash_search, language, packing, quality, simhash, suffix_dedup, token_output, vector_dedup, word_paths

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor " * 20_000
PASSAGE = " ".join(f"shared{i}" for i in range(40))
#: names that the operators use inside; they must not get in the way
CLASH = "f long, g string, id string, node long, score string, block long, part string, key string, length string, piece string, more_0 string, _statistic_upper string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def row(i, text, lang="en"):
    return (i, text, lang, "s", len(text or ""), 1, "x", "id", 2, "s", 3, "p", "k", "l", "pc", "m", "u")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(1, "The quick brown fox and the lazy dog."), row(2, None), row(3, ""), row(4, " \t\n"), row(5, "42 !!!", None), row(6, LONG), row(7, LONG), row(8, f"a {PASSAGE} b"), row(9, f"c {PASSAGE} d"), row(9, f"c {PASSAGE} d"), row(None, f"e {PASSAGE}"), row(10, "é日本 <|endoftext|> ß", None), row(11, "Der Hund und die Katze sind hier.", "de"), row(12, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, None), (6, 0, 0), (7, 0, 1), (8, 1, 0), (None, 1, 1), (11, None, 0), (12, 0, 0)], "doc_id long, quality int, toxic int")


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


def test_quality(docs, none, labels):
    model = quality.fit_quality(docs, labels)
    out = quality.score_quality(docs, model).collect()
    assert len(out) == 14 and all(0 <= r.score <= 1 for r in out)
    assert quality.score_quality(none, model).count() == 0
    assert quality.fit_quality(none, labels).rules == ()
    kept = quality.keep_good(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == 14
    assert quality.keep_good(docs, model, 1.1).count() == 0


def test_language(docs, none):
    model = language.fit_languages(docs)
    out = {r.doc_id: r.lang_pred for r in language.predict_languages(docs, model).collect() if r.doc_id}
    assert all(out[i] == "und" for i in (2, 3, 4, 5)) and out[10] != "und"
    assert language.fit_languages(none).languages == ()
    assert {r.lang_pred for r in language.predict_languages(docs, language.fit_languages(none)).collect()} == {"und"}
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({2, 3, 4, 5})
    assert language.predict_languages(none, model).count() == 0


def test_simhash(docs, none):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == 14
    component = {r.doc_id: r.component_id for r in out}
    assert component[7] == 6 and component[3] == component[4] == 2 and component[12] == 12
    assert {r.f for r in out if r.doc_id in (2, 3, 4)} == {0}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one_of_each(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and 7 not in ids and 6 in ids and None in ids


def test_suffix_dedup(docs, none):
    out = suffix_dedup.remove_repeats(docs)
    rows = [r for r in out.collect() if r.doc_id == 9]
    assert len(rows) == 2 and rows[0].n_removed == rows[1].n_removed >= len(PASSAGE) and bytes(rows[0].kept) in (b"cd", b"c d", b"c")
    found = {r.doc_id: r for r in out.collect()}
    assert found[7].n_removed == found[7].n_bytes == len(LONG) and found[2].n_bytes == 0 and found[None].n_removed >= len(PASSAGE)
    assert found[6].n_removed > 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_word_paths(docs, none):
    out = {r.doc_id: r for r in word_paths.remove_repeated_words(docs).collect()}
    assert out[9].n_removed == 40 and out[9].kept == "c d" and out[9].spans == [[1, 41]] and out[8].n_removed == 0
    assert out[None].n_removed == 40 and out[7].n_removed == out[7].n_words == 60_000 and out[2].n_words == 0
    assert word_paths.remove_repeated_words(none).count() == 0
    kept = word_paths.without_repeats(docs)
    assert kept.schema.names == docs.schema.names or set(kept.columns) == set(docs.columns)
    texts = {r.doc_id: (r.text, r.n_chars, r.g) for r in kept.collect()}
    assert texts[9] == ("c d", 3, "x") and texts[2][0] is None and texts[4][0] == " \t\n" and texts[7][0] == ""
    assert word_paths.without_repeats(none).count() == 0


def test_bpe(docs, none):
    t = Tokenizer.from_file(BYTE)
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.encode_documents(docs, BYTE, lexicon_words=50).collect():
        ids = t.encode(want[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(none, BYTE).count() == 0


def test_token_output(docs, none, spark, tmp_path):
    t = Tokenizer.from_file(BYTE)
    rows = token_output.packed_rows(docs, BYTE, row_tokens=64)
    token_output.write_packed(rows, str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed"))
    for r in rows.collect():
        assert len(r.ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64 and r.resets == r.cu_seqlens[:-1]
    pieces = {}
    for r in token_output.unpack(rows).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [50256] for r in docs.where("doc_id is null or doc_id <> 9").collect()}
    for i, ids in want.items():
        assert [x for _, p in sorted(pieces[i]) for x in p] == ids
    assert token_output.packed_rows(none, BYTE).count() == 0


def test_packing(docs, none):
    out = packing.pack_documents(docs, WORD, capacity=50).collect()
    t = Tokenizer.from_file(WORD)
    lengths = [len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()]
    assert sum(r.length for r in out) == sum(lengths)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 50
    assert packing.pack_documents(none, WORD).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, node string, leaf string, b long, q long"


def vec(i, v, label=1):
    return (i, v, label, "a", "b", "c", "d", 1, 2)


@pytest.fixture(scope="module")
def vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [vec(0, [1.0, 0.0]), vec(1, [1.0, 0.0]), vec(2, [2.0, 0.1]), vec(3, [0.0, 1.0]), vec(4, None), vec(5, [0.0, 0.0]), vec(6, [nan, 1.0]), vec(7, [inf, 1.0]), vec(8, [1.0, None]), vec(9, [1.0, 0.0], None), vec(10, [1.0, 0.0], 2), vec(11, [1.0]), vec(None, [1.0, 0.0]), vec(3, [0.0, 1.0]), vec(20, [1.0, 0.05])]
    return spark.createDataFrame(rows, VECTORS)


def test_vector_dedup(vectors, spark):
    out = {r.id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(vectors).collect()}
    assert out[0] == (3, 0, True) and out[1] == (3, 0, False) and out[2] == (3, 0, False) and out[20] == (3, 0, False)
    assert all(out[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)) and None not in out
    assert vector_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_hash_search(vectors, spark):
    out = hash_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=3).collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out}
    assert got[0, 1][0] == 2 and got[0, 1][1] == pytest.approx(2.0) and got[0, 2] == (1, 1.0) and got[0, 3] == (9, 1.0)
    empty = spark.createDataFrame([], VECTORS)
    assert hash_search.nearest(empty, empty).count() == 0 and hash_search.nearest(vectors, empty).count() == 0


def test_pipeline_stages(docs, none, labels, tmp_path, spark):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            assert set(frame.columns) <= set(out.columns) or name == "packing"
            assert out.count() >= 0
    assert len(corpus_pipeline.STAGES) == 5
