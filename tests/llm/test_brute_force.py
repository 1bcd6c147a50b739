"""The dealt queries on a small folder against brute force, and held-out accuracy where there is no truth."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from lodestar.llm import packing, registry, simhash, vector_dedup
from lodestar.llm.bpe import Lexicon, vocabulary
from lodestar.llm.suffix_dedup import intervals, maximal_repeats

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    return {name: [r.asDict() for r in query(spark, DATA).collect()] for name, query in registry.queries().items()}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_oracles(results):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    for name, sql in registry.oracle_sql().items():
        found = con.execute(sql)
        names = [x[0] for x in found.description]
        got = sorted(repr([r[c] for c in sorted(r)]) for r in results[name])
        assert got == sorted(repr([row[names.index(c)] for c in sorted(names)]) for row in found.fetchall()), name


def test_quality_and_language_held_out(results, docs, spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    out = {r["doc_id"]: r for r in results["op1_quality_rules"]}
    assert len(out) == len(docs)
    right = [out[i]["predicted"] == q for i, q in labels.items() if q is not None and out[i]["held_out"]]
    assert sum(right) >= 0.8 * len(right)
    out = results["op3_language_mixture"]
    right = [r["lang_pred"] == docs[r["doc_id"]].lang for r in out if r["held_out"]]
    assert len(out) == len(docs) and sum(right) >= 0.9 * len(right)


def fingerprint(text):
    text = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(results, docs):
    ids = sorted(docs)
    f = np.array([fingerprint(docs[i].text) for i in ids], np.uint64)
    near = np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4)
    want = components(len(ids), near.tolist())
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in results["op5_simhash_pigeonhole"]}
    assert got == {i: (f"{int(f[k]):016x}", ids[want[k]]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("limit", [2, 4, 7, 10])
def test_pigeonhole_finds_every_link(spark, limit):
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 12), replace=False)) for _ in range(400)]
    f = np.unique(np.array([int(base[k % 40]) ^ x for k, x in enumerate(flips)], np.uint64))
    points = spark.createDataFrame([(int(x.astype(np.int64)), b"", k) for k, x in enumerate(f)], "f long, g binary, node long")
    got = components(len(f), [(r.u, r.v) for r in simhash.hamming_links(points, limit).collect()])
    assert got == components(len(f), np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= limit).tolist())


def test_stage_keeps_texts_that_are_no_copies(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(60):  # lone pairs of a Jaccard similarity of 0.7 to 0.78
        base = rng.integers(1 << 40, size=300).tolist()
        cut = int(rng.integers(37, 52))
        rows += [(2 * k, " ".join(map(str, base))), (2 * k + 1, " ".join(map(str, base[cut:] + rng.integers(1 << 40, size=cut).tolist())))]
    assert simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 120


def test_stage_links_by_shingle_similarity(spark):
    """Lone pairs, chains and dense groups around 0.8, and repeats: the components are those of brute-force Jaccard."""
    rng = np.random.default_rng(5)
    word = lambda: "w" + str(rng.integers(1 << 40))
    texts = []
    for k in range(240):
        base = [word() for _ in range(int(rng.integers(60, 400)))]
        texts.append(base)
        for _ in range([1, 1, 1, 5][k % 4]):
            base = list(base if k % 8 != 7 else texts[-1])
            n = len(base)
            share = rng.uniform(0.1, 0.5)  # so much of the text is another: Jaccard 1 - share and less
            cut = int(n * share / (1 + share))
            base[n - cut :] = [word() for _ in range(cut)]
            texts.append(base * (3 if k % 16 == 2 else 1))
    texts += [["one", "two", "three"], ["ONE", "two", "three"], ["one", "two", "four"]]
    sets = [{tuple(w.lower() for w in t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = components(len(texts), alike)
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs, **simhash.STAGE).collect()}
    assert len(set(want)) < len(texts) and [got[i] for i in range(len(texts))] == want
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == sorted(set(want))


def test_bpe(results, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in results["op6_bpe_transducer"]:
        ids = t.encode(docs[r["doc_id"]].text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_automaton_is_minimal_and_numbers_words(tmp_path):
    words = [b"tap", b"taps", b"top", b"tops", b"stop"]
    Lexicon.compile({w: [i, i + 1] for i, w in enumerate(words)}).save(str(tmp_path / "l"))
    lexicon = Lexicon.load(str(tmp_path / "l"))
    numbers = lexicon.find([*words, b"ta", b"tapss", b"", b"zz"])
    assert [lexicon.word_ids(n) for n in numbers[:5]] == [[i, i + 1] for i in range(5)] and (numbers[5:] == -1).all()
    assert len(lexicon.next) - 1 < len({w[:k] for w in words for k in range(len(w) + 1)})  # shared suffixes


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_merges_equal_the_library(name):
    path = public_tokenizers.path(name)
    t, rng = Tokenizer.from_file(path), np.random.default_rng(0)
    with open(path, "rb") as f:
        v = vocabulary(f.read())
    pool = ["a", "the", "'s", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "É", "ß", "İ", "Σ", "日本", "١", "½", "!", "<|endoftext|>", "é", "😀", "0", "K"]
    for text in ["".join(rng.choice(pool, rng.integers(0, 12))) for _ in range(1500)] + ["a" * 3000, "!?" * 800]:
        assert [i for w in v.words(text) for i in v.merge(w)] == t.encode(text, add_special_tokens=False).ids, text


def test_search_recall(results, spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in results["op7_multi_index_hashing"]:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    found = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = x @ x[k]
        score[k] = -np.inf
        best = set(ids[np.argsort(-score, kind="stable")[:20]].tolist())
        mine = sorted(got[int(ids[k])])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(s - score[np.flatnonzero(ids == i)[0]]) < 1e-12 for _, i, s in mine)
        found, total = found + len(best & {m[1] for m in mine}), total + 20
    assert found >= 0.9 * total


def test_forest_finds_planted_links(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 64))
    x = np.concatenate([centre, centre + 0.18 * rng.normal(size=(30, 64)), rng.normal(size=(300, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(len(x)) % 30 % 3
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    got = {r.id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(df).collect()}
    want = components(len(x), np.argwhere(linked).tolist())
    assert got == {i: (int(linked[i].sum()), want[i]) for i in range(len(x))} and linked.any()


def test_hot_anchors_give_the_same(spark, results, monkeypatch):
    from lodestar.llm import suffix_dedup, windows, word_paths

    monkeypatch.setattr(windows, "HOT", 1)
    for module, name in ((suffix_dedup, "op4_prefix_intervals"), (word_paths, "op10_word_paths")):
        assert sorted(map(repr, (r.asDict() for r in module.query(spark, DATA).collect()))) == sorted(map(repr, results[name]))


def test_interval_tree_of_suffixes():
    assert sorted((p, sorted(m)) for p, m in intervals([b"abab", b"abba", b"abab", b"b"], 1)) == [(2, [0, 1, 2]), (4, [0, 2])]
    found = maximal_repeats([(2, b"xxabcd"), (2, b"yxabcd"), (2, b"zzabce")], 4)
    assert (1, 4, [0, 1]) in [(a, b, sorted(m)) for a, b, m in found]


def test_packing(results, docs):
    rows = results["op9_genetic_packing"]
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 4096 for p in places.values())
    assert len(places) <= -(-sum(r["length"] for r in rows) // 4096) + 1 and {r["doc_id"] for r in rows} == set(docs)


def test_genetic_search_improves_on_best_fit():
    rng, items = np.random.default_rng(0), []
    for _ in range(40):  # triplets that fill a bin each
        x, y = rng.integers(200, 400, 2).tolist()
        items += [x, y, 1000 - x - y]
    best = packing.best_fit(sorted(items, reverse=True), 1000)
    found = packing.evolve(Counter(items), 1000, seed=1)
    assert len(found) < len(best) and all(sum(b) <= 1000 for b in found)
    assert sorted(x for b in found for x in b) == sorted(items)
    assert len(packing.evolve(Counter(items), 1000, 2, [found])) <= len(found)  # a migrant is never lost


def test_token_rows(results, docs):
    rows = results["op8_token_output"]
    assert {d for r in rows for d in r["doc_ids"]} == set(docs) and all(len(r["ids"]) == 8192 for r in rows)


def test_pipeline_keeps_one_of_each_and_no_repeats(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA).cache()
        assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name
    seen: set = set()
    for r in docs.orderBy("doc_id").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        for k in range(len(words) - 49):
            window = tuple(words[k : k + 50])
            assert window not in seen
            seen.add(window)
    assert corpus_pipeline.run(spark, DATA).count() >= docs.count()
