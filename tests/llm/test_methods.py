"""The dealt methods where the small folder does not reach them: depth, pruning, graphs, forged hashes, hot keys."""

import math
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import components as component_module
from lodestar.llm import hash_search, language, packing, quality, simhash, suffix_dedup, vector_dedup, windows, word_paths
from lodestar.llm.common import cut, salted_join

DATA = "/root/testdata/sf0.001"


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_a_star_and_a_chain(spark, monkeypatch):
    monkeypatch.setattr(component_module, "FILE_LINKS", 20_000)  # more files than one, so the stars are joined
    star = spark.range(1, 100_001).select(F.lit(7_000_000).alias("u"), F.col("id").alias("v"))
    chain = spark.range(200_000, 203_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = component_module.components(star.unionByName(chain).repartition(16))
    assert {r.component: r["count"] for r in found.groupBy("component").count().collect()} == {1: 100_001, 200_000: 3_001}


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(component_module, "FILE_LINKS", 50)
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 600, (450, 2))]
    want = components(600, pairs)
    got = {r.node: r.component for r in component_module.components(spark.createDataFrame([*pairs, (1, None)], "u long, v long")).collect()}
    assert got == {i: want[i] for p in pairs for i in p if p[0] != p[1]}


def test_salted_join_is_a_join(spark):
    left = cut(spark.range(3000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), F.col("id").alias("x")))
    right = spark.createDataFrame([(0, "a"), (3, "b"), (3, "c"), (9, "d")], "k long, y string")
    for how in ("inner", "left", "left_anti"):
        assert sorted(map(tuple, salted_join(left, right, ["k"], how).collect()), key=repr) == sorted(map(tuple, left.join(right, "k", how).collect()), key=repr)


def planted_vectors(spark, pairs=700, alone=600):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(pairs, 64))
    x = np.concatenate([centre, centre + 0.18 * rng.normal(size=(pairs, 64)), rng.normal(size=(alone, 64))])
    unit, label = x / np.linalg.norm(x, axis=1, keepdims=True), np.arange(len(x)) % pairs % 2
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int"), linked


@pytest.mark.parametrize("small", [vector_dedup.SMALL, 0])
def test_forest_of_many_levels_finds_the_links(spark, monkeypatch, small):
    """Leaves of 16 of some thousand vectors: over three levels, by broadcast and by joined splits; recall of links over 0.99."""
    monkeypatch.setattr(vector_dedup, "SMALL", small)
    depth = []
    compare = vector_dedup._compare
    monkeypatch.setattr(vector_dedup, "_compare", lambda state, threshold: depth.extend(len(bin(r.leaf & (1 << vector_dedup.PATH) - 1)) - 3 for r in state.select(F.explode("leaves").alias("leaf")).distinct().collect()) or compare(state, threshold))
    df, linked = planted_vectors(spark)
    got = {r.id: r for r in vector_dedup.near_vectors(df, leaf=16).collect()}
    assert max(depth) > 3 and len(depth) > 100
    assert all(r.n_links <= linked[i].sum() for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * linked.sum() > 1000


def test_forest_with_a_dense_leaf(spark):
    """Many vectors nearly alike cannot be split: their leaf is compared by blocks, and counts are exact."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=64) + 0.02 * rng.normal(size=(2500, 64))
    got = vector_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"), leaf=64)
    assert {(r.n_links, r.component_id) for r in got.collect()} == {(2499, 0)}


def test_vectors_of_every_length(spark):
    rows = [(i, [float(i % 3 + 1)] * (2 + i % 4), 1) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(df).collect()}
    assert got == {i: (9, i % 4) for i in range(40)}
    near = defaultdict(set)
    for r in hash_search.nearest(df, df.where("vec_id < 4"), k=20).collect():
        near[r.query_id].add(r.vec_id)
    assert near == {i: {j for j in range(40) if j % 4 == i % 4 and j != i} for i in range(4)}


def test_index_prunes_and_finds(spark):
    """12,000 vectors without clusters: the index is asked for a part of the codes, reranks under a tenth, and finds 0.95."""
    x = np.random.default_rng(1).normal(size=(12_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = hash_search.Hashing(x[:8192], len(x), 1.0, 20)
    index, codes = hash_search.SubstringIndex(model.candidates(x)), model.queries(x[:200])
    probed = np.mean([len(index.probe(c, model.radii)) for c in codes]) / len(x)
    reranked = np.mean([len(index.within(c, model.radius, model.radii)) for c in codes]) / len(x)
    for c in codes[:20]:  # pigeonhole: nothing within the radius is missed
        assert set(np.flatnonzero(index.distance(c, np.arange(len(x))) <= model.radius)) == set(index.within(c, model.radius, model.radii))
    assert reranked < 0.1 and probed < 0.35 and sum(model.radii) == model.radius - len(model.radii) + 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in hash_search.nearest(df, df.where("vec_id % 60 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    score = x[::60] @ x.T
    score[np.arange(200), np.arange(0, 12_000, 60)] = -2
    best = np.argsort(-score, axis=1)[:, :20]
    assert sum(len(set(b.tolist()) & got[60 * i]) for i, b in enumerate(best)) >= 0.95 * 20 * 200


def test_longer_vectors_are_nearer(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 16)) * np.exp(0.5 * rng.normal(size=(6000, 1)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in hash_search.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for k in range(0, 6000, 100):
        score = x @ x[k]
        score[k] = -np.inf
        hit += len(set(np.argsort(-score)[:20].tolist()) & got[k])
    assert hit >= 0.9 * 20 * 60


def test_language_rows_stand_alone(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit_languages(docs)
    one, many = (sorted(map(tuple, language.predict_languages(docs.repartition(n), model).collect())) for n in (1, 50))
    assert one == many


def plain_mixture(counts, p, rounds=12, still=2e-3):
    """The same inference for one document, written out."""
    n = max(1, counts.sum())

    def em(w, rounds):
        for _ in range(rounds):
            share = np.array([sum(c * w[k] * p[k][b] / max(1e-30, sum(w[j] * p[j][b] for j in range(len(p)))) for b, c in enumerate(counts) if c) for k in range(len(p))]) / n
            done = max(abs(share - w)) < still
            w = share
            if done:
                break
        return w

    free = em(np.full(len(p), 1 / len(p)), rounds)
    order = sorted(range(len(p)), key=lambda k: -free[k])
    best = (-math.inf, None)
    for size in range(1, len(p) + 1):
        w = np.array([free[k] + 1e-3 if k in order[:size] else 0 for k in range(len(p))])
        w = em(w / w.sum(), rounds // 2 if size > 1 else 0)
        value = sum(c * math.log(max(1e-30, sum(w[j] * p[j][b] for j in range(len(p))))) for b, c in enumerate(counts) if c) - 0.5 * (size - 1) * math.log(n)
        if value <= best[0]:
            break
        best = (value, w)
    return best[1] / best[1].sum()


def test_mixtures_equal_a_plain_version():
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.full(40, 0.3), 7)
    sizes = [1, 2, 3, 5, 6]
    counts = np.stack([rng.multinomial(4000, rng.dirichlet(np.full(k, 5.0)) @ p[rng.choice(7, k, replace=False)]) for k in sizes * 4])
    weights, chosen = language.infer_mixtures(counts, p, rounds=60)
    for c, w in zip(counts, weights, strict=True):
        assert np.allclose(w, plain_mixture(c, p, rounds=60), atol=1e-9)
    assert chosen.sum(1).max() >= 5  # sets of any size


def test_rules_fire_as_written(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    rows = quality.with_statistics(docs, "doc_id", "text")
    got = rows.select(*quality.STATISTICS, model.column().alias("score"), *(r.column().alias(f"r{k}") for k, r in enumerate(model.rules))).collect()
    assert model.rules
    x = np.array([[r[s] for s in quality.STATISTICS] for r in got])
    for row, score in zip(got, model.score(x), strict=True):
        total = model.intercept
        for k, (rule, weight) in enumerate(zip(model.rules, model.weights, strict=True)):
            fires = all((row[s] > t) if above else (row[s] <= t) for s, above, t in rule.conditions)
            assert row[f"r{k}"] == float(fires)
            total += weight * fires
        assert row.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9) == pytest.approx(score, abs=1e-9)


def test_statistics_of_a_text():
    data = np.frombuffer(b"Good good GOOD 12, x|\n", np.uint8)
    got = dict(zip(quality.STATISTICS, quality.statistics(data, np.array([0, len(data)]))[0], strict=True))
    assert got["n_words"] == 5 and got["max_word"] == 4 and got["n_bytes"] == 22 and got["distinct"] == 1.0
    assert got["digit"] == 2 / 22 and got["bar"] == got["line"] == 1 / 22 and got["capital_words"] == 1 / 5


def test_a_repeated_id_teaches_once(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e"), (2, "f")] * 30, "doc_id long, text string")
    assert quality.fit_quality(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), sample_rows=2, held_out=(1, 5)).rules == ()


def brute_repeats(strings, length):
    """(left, right, members) by comparing every pair: the maximal ones and all who share them."""
    def shared(i, j):
        (a, x), (b, y) = strings[i], strings[j]
        left = 0
        while left < min(a, b) and x[a - left - 1] == y[b - left - 1]:
            left += 1
        right = 0
        while right < min(len(x) - a, len(y) - b) and x[a + right] == y[b + right]:
            right += 1
        return left, right

    pairs = {(i, j): shared(i, j) for i in range(len(strings)) for j in range(i)}
    out = set()
    for left, right in set(pairs.values()):
        if left + right < length or right < 1:
            continue
        groups = components(len(strings), [p for p, (a, b) in pairs.items() if a >= left and b >= right])
        by = defaultdict(list)
        for i, g in enumerate(groups):
            by[g].append(i)
        for members in by.values():
            inside = [pairs[j, i] if (j, i) in pairs else pairs[i, j] for i in members for j in members if i < j]
            if inside and min(a for a, _ in inside) == left and min(b for _, b in inside) == right:
                out.add((left, right, tuple(members)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    strings = list({(int(a), bytes(rng.choice([97, 98], a).tolist()) + b"K" + bytes(rng.choice([97, 98], rng.integers(0, 7)).tolist())) for a in rng.integers(0, 6, 14)})
    got = suffix_dedup.maximal_repeats(strings, 4)
    assert len(got) == len({(a, b, tuple(sorted(m))) for a, b, m in got})
    assert {(a, b, tuple(sorted(m))) for a, b, m in got} == brute_repeats(strings, 4)


def test_left_diversity_is_tested():
    assert suffix_dedup.maximal_repeats([(1, b"xabcdeP"), (1, b"xabcdeQ")], 4) == [(1, 5, [0, 1])]


def test_repeat_groups_hold_all_occurrences(spark):
    rng = np.random.default_rng(8)
    filler = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage = filler(150)
    texts = {i: filler(int(rng.integers(20, 80))) + (passage if i % 3 else "") + filler(30) for i in range(12)}
    got = suffix_dedup.repeat_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5), length=60).collect()
    groups = defaultdict(set)
    for r in got:
        assert texts[r.doc][r.start : r.start + r.length] == texts[r.group_doc][r.group_start : r.group_start + r.length]
        groups[r.group_doc, r.length].add((r.doc, r.start))
    whole = {(i, t.index(passage)) for i, t in texts.items() if passage in t}
    assert groups[1, 150] == whole
    assert all(k[0] == min(d for d, _ in g) for k, g in groups.items())


def brute_paths(docs, k):
    where = defaultdict(list)
    for i, t in docs:
        w = t.split()
        for p in range(len(w) - k + 1):
            where[tuple(w[p : p + k])].append((i, p))
    edges = {e for e, places in where.items() if len(places) > 1}
    out, into = defaultdict(set), defaultdict(set)
    for e in edges:
        out[e[:-1]].add(e)
        into[e[1:]].add(e)
    after = {e: next(iter(out[e[1:]])) for e in edges if len(out[e[1:]]) == len(into[e[1:]]) == 1}
    paths, seen = set(), set()
    for e in edges - set(after.values()):
        words = list(e)
        seen.add(e)
        while e in after:
            e = after[e]
            seen.add(e)
            words.append(e[-1])
        paths.add(tuple(words))
    return paths, edges - seen  # what is left lies on rings


@pytest.mark.parametrize("seed", range(3))
def test_paths_equal_the_brute_force_graph(spark, seed):
    k, rng = 5, np.random.default_rng(seed)
    pool = [[f"p{j}w{x}" for x in range(rng.integers(6, 30))] for j in range(6)]
    docs = []
    for i in range(25):
        words = []
        for _ in range(rng.integers(1, 5)):
            a = int(rng.integers(0, 20))
            words += pool[rng.integers(6)][a : a + int(rng.integers(5, 30))] if rng.random() < 0.6 else [f"r{rng.integers(1 << 30)}" for _ in range(rng.integers(1, 9))]
        docs.append((i, " ".join(words)))
    if seed == 2:
        docs += [(100, "a b c d e f g h " * 4), (101, "x y"), (102, None)]
    want, rings = brute_paths([(i, t or "") for i, t in docs], k)
    texts, found = dict(docs), defaultdict(list)
    for r in word_paths.repeated_paths(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), length=k).collect():
        found[r.path].append((r.place, texts[r.doc].split()[r.start : r.start + r.n_words]))
    got = []
    for parts in found.values():
        words = []
        for _, part in sorted(parts):
            words += part[k - 1 :] if words else part
        got.append(tuple(words))
    assert want <= set(got) and len(got) == len(set(got))
    extra = set(got) - want
    assert sum(len(w) - k + 1 for w in extra) == len(rings) and bool(rings) == (seed == 2)


@pytest.mark.parametrize("words", [True, False])
def test_forged_hashes_remove_nothing(spark, words):
    """Answers that call different windows equal, as colliding hashes would: only what is equal goes."""
    spec = windows.Windows(6, 2, words) if words else windows.Windows(24, 8, words)
    rng = np.random.default_rng(9)
    base = [f"w{x:04d}" for x in rng.integers(0, 10_000, 400)]
    other = list(base)
    for k in range(0, 400, 45):
        other[k] = "z" + other[k][1:]
    texts = {1: " ".join(base), 2: " ".join(other)}
    source = windows.blocks(spark.createDataFrame([(1, texts[1]), (2, texts[2])], "doc_id long, text string").repartition(2, "doc_id"), "doc_id", "text")
    opened = {r.block: windows.Opened(r.block, bytes(r.body), spec) for r in source.collect()}
    (one, a), (two, b) = ((n, o) for want in (1, 2) for n, o in opened.items() if want in o.block.ids)
    s, order, begin = b.segments
    lead, row = order[begin], int(np.flatnonzero(a.block.ids == 1)[0])
    own = np.flatnonzero(b.block.ids[s.row[lead]] == 2)
    n = len(own)
    # every class of the second document is said to stand in the first one at the same place
    body = windows.pack(own, np.full(n, 1), s.place[lead[own]], np.full(n, one), np.full(n, row), np.zeros(n, np.uint8))
    answers = spark.createDataFrame([(two, 0, body)], windows.ANSWER)
    finish = word_paths._Finish(True) if words else suffix_dedup._Finish(True, spec.length)
    out = {r.id: r for r in windows.remove_verified(source, spec, answers, finish, finish.schema).collect()}
    assert out[1].n_removed == 0
    symbols = {i: t.split() if words else list(t) for i, t in texts.items()}
    equal = [x == y for x, y in zip(symbols[1], symbols[2], strict=True)]
    want = set()
    for k in range(len(equal) - spec.length + 1):
        if all(equal[k : k + spec.length]):
            want |= set(range(k, k + spec.length))
    got = {k for a, z in out[2].spans for k in range(a, z)}
    assert got == want and 0 < len(want) < len(equal)


def test_hot_probes_of_a_bucket_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    monkeypatch.setattr(simhash, "PROBING", 16)
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    f = np.unique(np.array([base ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 9), replace=False)) for _ in range(300)], np.uint64))
    points = spark.createDataFrame([(int(x.astype(np.int64)), b"", k) for k, x in enumerate(f)], "f long, g binary, node long")
    got = components(len(f), [(r.u, r.v) for r in simhash.hamming_links(points, 4).collect()])
    assert got == components(len(f), np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4).tolist())


def test_packed_pieces_equal_the_library(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        for k, lo in enumerate(range(0, len(ids), 128)):
            part = ids[lo : lo + 128]
            want[i, k] = (lo, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()), part)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=128, with_ids=True).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32, r.ids) for r in out} == want and len(out) == len(want)


def test_pack_replaces_its_own_columns(spark):
    pieces = spark.createDataFrame([(1, 5, "x", 9, 9), (2, 7, "y", 9, 9), (3, 3, None, 9, 9)], "_n long, length long, _shard string, sequence_id long, offset long")
    out = packing.pack(pieces, 10)
    assert out.columns == ["_n", "length", "_shard", "sequence_id", "offset"] and sorted(r._n for r in out.collect()) == [1, 2, 3]
    assert len({r.sequence_id for r in out.collect()}) == 2
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(spark.createDataFrame([(11,)], "length long"), 10).count()


def test_islands_run_where_best_fit_misses(spark):
    rng, items = np.random.default_rng(0), []
    for _ in range(40):  # triplets that fill a bin each
        x, y = rng.integers(200, 400, 2).tolist()
        items += [x, y, 1000 - x - y]
    best = packing.best_fit(sorted(items, reverse=True), 1000)
    out = packing.pack(spark.createDataFrame([(x,) for x in items], "length long"), 1000).collect()
    assert 40 <= len({r.sequence_id for r in out}) < len(best) and sorted(r.length for r in out) == sorted(items)


def test_pipeline_leaves_one_table_and_writes_ids(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA)
    rows = out.collect()
    assert rows and all(len(r.ids) == r.length and zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    folder = re.search(r"(/.*pipeline-[0-9a-f]{32})/", out.inputFiles()[0]).group(1) if out.inputFiles() else None
    if folder and os.path.isdir(folder):
        assert os.listdir(folder) == ["substrings"]


def test_similar_pairs_equal_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 16)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, 60)
    sets = [np.unique(np.where(rng.random(60) < rng.uniform(0, 0.25), rng.integers(0, 1 << 60, 60), base)[: rng.integers(40, 61)]) for _ in range(40)] + [np.zeros(0, np.int64)]
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    row, at, own, other = np.repeat(np.arange(41), sizes), np.arange(41) // 2, np.arange(0, 25), np.arange(15, 41)
    got = {frozenset((at[u], at[v])) for u, v in zip(*simhash.similar_pairs(flat, row, sizes, own, other, at, (4, 5)), strict=True)}
    want = {frozenset((at[i], at[j])) for i in own for j in other if at[i] != at[j] and len(np.intersect1d(sets[i], sets[j])) * 5 >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert got == want and want


def test_clusters_are_compared_by_blocks(spark, monkeypatch):
    """A cluster in which many proposed links fail: its components are those of brute-force Jaccard, in blocks of three."""
    monkeypatch.setattr(simhash, "TEXTS", 3)
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 250)]
    texts = []
    for _ in range(50):
        words = list(base)
        for _ in range(int(rng.integers(1, 10))):
            words[int(rng.integers(250))] = f"n{rng.integers(1 << 40)}"
        texts.append(words)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = components(50, [(a, b) for a in range(50) for b in range(a) if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs, **simhash.STAGE).collect()}
    assert [got[i] for i in range(50)] == want and 1 < len(set(want)) < 50


def test_fingerprints_link_alike_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    f = np.unique(np.array([base ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 9), replace=False)) for _ in range(300)], np.uint64))
    points = spark.createDataFrame([(int(x.astype(np.int64)), b"", k) for k, x in enumerate(f)], "f long, g binary, node long")
    want = components(len(f), np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4).tolist())
    swept = []
    for size in (simhash.BUCKET, 64):  # whole buckets, and buckets that are cut
        monkeypatch.setattr(simhash, "BUCKET", size)
        monkeypatch.setattr(simhash, "LEAST_ROUND", 200)  # some partitions alone have more rows
        monkeypatch.setattr(simhash, "ROUND", 1)
        monkeypatch.setattr(simhash, "sweep", lambda s: swept.append(s))
        assert components(len(f), [(r.u, r.v) for r in simhash.hamming_links(points, 4).collect()]) == want
        assert len(swept) > 2
        swept.clear()
    assert simhash._rounds([5, 5, 25, 1, 9], 10) == [([2], 0, 3), ([2], 1, 3), ([2], 2, 3), ([0, 1], 0, 1), ([3, 4], 0, 1)]


def test_stages_bound_their_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    assert language.BLOCK * language.BUCKETS * 8 <= 4 << 20  # a table of numbers of one block
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    own = spark.conf.getAll.get(key)
    try:
        spark.conf.unset(key)
        corpus_pipeline.known_language(spark, docs, DATA)
        assert spark.conf.get(key) == str(8 << 20)
        spark.conf.set(key, "1000000")  # the session's own size stays
        corpus_pipeline.known_language(spark, docs, DATA)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.set(key, own) if own else spark.conf.unset(key)


def test_buckets_are_compared_as_far_as_sizes_reach(monkeypatch):
    """All pairs of a bucket that may be alike, of the plain rows and with those that probe, and hardly any others."""
    rng = np.random.default_rng(8)
    own, rows = 900, 3000
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    f = base[rng.integers(0, 20, rows)] ^ (np.uint64(1) << rng.integers(0, 63, rows).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, rows).astype(np.uint64))
    n = np.exp(rng.uniform(3, 8, rows)).astype(np.int64)
    n[:own], n[own:] = np.sort(n[:own]), np.sort(n[own:])
    i, j = np.nonzero((np.bitwise_count(f[:own, None] ^ f[None, :]) <= 4) & (np.minimum(n[:own, None], n) * 5 >= np.maximum(n[:own, None], n) * 4))
    want, compared = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b}, []
    monkeypatch.setattr(simhash, "PAIRS", 500)
    count = np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: (compared.append(x.size), count(x))[1])
    got = [(a, b) for us, vs in simhash._near(f, n, own, 4, (4, 5)) for a, b in zip(us.tolist(), vs.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert max(compared) <= 500 and sum(compared) < own * rows / 8


def test_plans_of_many_texts_compare_few_pairs(spark):
    """2.4 million fingerprints had 62 keys each for a column and 265,000 comparisons."""
    sample = np.random.default_rng(9).integers(0, 1 << 63, 4096, dtype=np.uint64)
    probes = simhash._probes(simhash.choose_plan(sample, 2_400_000, 12, 0.13))
    sizes = [(2.4e6 / 2 ** mask.bit_count(), len(flips)) for _, mask, flips in probes]
    assert sum((flips + 1) / 2 for _, flips in sizes) < 40 and sum(plain * flips / 2 * 0.13 for plain, flips in sizes) < 40_000
    points = spark.createDataFrame([(5, b"", 1, 100), (5 ^ 3 << 20, b"", 2, 80), (5 ^ 1 << 40, b"", 3, 79)], "f long, g binary, node long, n long")
    assert {frozenset(r) for r in simhash.hamming_links(points, 4, least=(4, 5)).collect()} in ({frozenset((1, 2)), frozenset((2, 3))},)


def test_majorities_of_long_texts():
    rng = np.random.default_rng(10)
    n = np.asarray([0, 1, 2, 255, 256, 700, 0, 40_000, 3, 0])
    h = rng.integers(0, (1 << 64) - 1, int(n.sum()), dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    want = [sum(1 << k for k in np.flatnonzero(2 * part.sum(0, dtype=int) > len(part)).tolist()) for part in np.split(bits, np.cumsum(n)[:-1])]
    assert simhash.majorities(h, n)[:, 0].tolist() == want
