"""Token counts, the prefix trie and spelling variants: brute force, the methods where data do not reach them, edges."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestar.llm import prefix_trie, registry, spelling, token_counts
from lodestar.llm.common import checkpoint_folder

DATA = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor " * 20_000
CLASH = "n string, word string, digest string, id string, raw string, node long, rid long, part long, place long, s0 long, key string"


@pytest.fixture(scope="module")
def docs(spark):
    texts = {1: "The quick brown fox.", 2: None, 3: "", 4: " \t\n", 5: "THE  quick\nbrown fox. ", 6: LONG, 7: LONG, 8: "a <|endoftext|> b", 9: "a <|ENDOFTEXT|> b", 10: "é日本 ß  x\x1cy", 11: "é z"}
    rows = [*texts.items(), (1, "The quick brown fox."), (1, "another text"), (None, "no id"), (None, "no id")]
    return spark.createDataFrame([(i, t, *"nwdir", 1, 2, 3, 4, 5, "k") for i, t in rows], f"doc_id long, text string, {CLASH}")


def test_token_counts_equal_the_library(spark, docs):
    t = Tokenizer.from_file(WORD)
    cache = f"{checkpoint_folder(spark)}/counts-edges"
    out = token_counts.token_counts(docs, WORD, cache, limit=5)
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 5) for r in docs.collect())
    assert Counter(map(tuple, out.collect())) == want
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    # 1 and 5, 6 and 7, and what is empty, are one content each; special strings in upper case are none
    assert token_counts.stored_counts(spark, cache, token_counts.version(WORD)).count() == 9
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in whole.collect()}
    got = {r.doc_id: r for r in registry.queries()["op11_digest_counts"](spark, DATA).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == want and all(r.over_limit == (r.n_tokens > 2048) for r in got.values())


def test_stored_counts_are_used_and_misses_appended(spark, docs):
    cache, of = f"{checkpoint_folder(spark)}/counts-stored", token_counts.version(WORD)
    first = docs.where("doc_id in (1, 6)")
    token_counts.token_counts(first, WORD, cache).collect()
    before = {bytes(r.digest): r.n_tokens for r in token_counts.stored_counts(spark, cache, of).collect()}
    assert len(before) == 3
    # a count that no encoder would give shows where it comes from; a repeated append does no harm
    forged = spark.createDataFrame([(bytearray(d), 1_000_000) for d in before], "digest binary, n_tokens bigint")
    forged.write.mode("append").parquet(f"{cache}/version={of}")
    out = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_counts.token_counts(docs, WORD, cache).collect()}
    assert out[1, 20] == out[5, 22] == out[7, len(LONG)] == 1_000_000 and out[9, 17] == len(Tokenizer.from_file(WORD).encode("a <|ENDOFTEXT|> b", add_special_tokens=False).ids)
    assert token_counts.stored_counts(spark, cache, of).count() == 9
    # another version has counts of its own
    byte = public_tokenizers.path("byte_bpe_50k.json")
    own = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_counts.token_counts(docs, byte, cache).collect()}
    assert own[7, len(LONG)] == len(Tokenizer.from_file(byte).encode(LONG, add_special_tokens=False).ids)


def test_token_counts_of_nothing(spark, docs):
    cache = f"{checkpoint_folder(spark)}/counts-none"
    assert token_counts.token_counts(docs.limit(0), WORD, cache).count() == 0
    assert token_counts.stored_counts(spark, cache, token_counts.version(WORD)).count() == 0


def test_sentencepiece_counts(spark, docs):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    out = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_counts.token_counts(docs, model, f"{checkpoint_folder(spark)}/counts-pieces").collect()}
    assert out == {(r.doc_id, len((r.text or "").encode())): len(pieces.encode(r.text or "")) for r in docs.collect()}


def trie(rows, group, depths):
    """Nodes by brute force, from dictionaries of prefixes."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % depths
        rebuilt[c] = tuple(turns.get(c - c % group, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = {}
    for p in members:
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in members) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(rebuilt[c]) == len(p))))
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def nodes(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


CONVERSATION = f"conv_id long, turn long, role string, text string, {CLASH}"


@pytest.fixture(scope="module")
def turns():
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"é{min(k, 3)}" if c % 3 else f"turn {c % 4} {k}") for c in range(40) for k in range(c % 13)]
    rows += [(50, None, None, None), (50, 0, "user", "x"), (50, 0, "user", "x"), (50, 0, "a", "y"), (51, 3, "user", None), (None, 1, "user", "lost"), (52, 0, "u", "sera"), (53, 0, "us", "era"), (60, 0, "user", LONG)]
    return rows + [(k, 0, "user", "hot") for k in range(100, 180)] + [(200, k, "user", f"deep {k % 7}") for k in range(700)] + [(201, k, "user", f"deep {k % 7}") for k in range(690)]


@pytest.mark.parametrize(("group", "depths", "bits"), [(5, 9, 64), (1, 1, 64), (5, 9, 4)])
def test_trie_equals_brute_force(spark, turns, group, depths, bits):
    """Deep conversations cross the ranges' borders; few bits make collisions, which must be split."""
    rows = [r for r in turns if bits == 64 or (r[0] or 0) < 200]
    df = spark.createDataFrame([(*r, *"nwdir", 1, 2, 3, 4, 5, "k") for r in rows], CONVERSATION)
    assert nodes(prefix_trie.prefix_trie(df, group, depths, bits)) == trie(rows, group, depths)


def test_weak_fingerprints_collide(spark, turns):
    """The check of the check: one round of few bits is not enough, so the splitting above has run."""
    rows = [(*r, *"nwdir", 1, 2, 3, 4, 5, "k") for r in turns if (r[0] or 0) < 200]
    ranged = prefix_trie._ranged(spark.createDataFrame(rows, CONVERSATION))
    own = prefix_trie._scanned(ranged, 1, 4)
    _, prefixes = prefix_trie._rebuilt(own, 1, 4, 5, 9)
    least = prefixes.groupBy("depth", "f0").agg({"rid": "min"}).withColumnRenamed("min(rid)", "rep")
    assert not prefix_trie._agree(prefixes.join(least, ["depth", "f0"]), ranged)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATION), 5, 9).count() == 0
    alone = spark.createDataFrame([(3, 0, "user", "x", *"nwdir", 1, 2, 3, 4, 5, "k")], CONVERSATION)
    assert nodes(prefix_trie.prefix_trie(alone, 5, 9)) == trie([(3, 0, "user", "x")], 5, 9)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(rows, every=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out = {}
    for w, k in words.items():
        close = sorted((-words[x], x) for x in words if near(w, x))
        form = close[0][1] if close and -close[0][0] >= 2 * k else None
        out[w] = [form, None, k, len(close), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


def groups(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups(spelling.variant_groups(spelling.counted_words(small, every=7))) == variants(rows, 7)


def test_variants_edges(spark):
    chain = " ".join(["aaaaa"] * 64 + ["aaaab"] * 32 + ["aaabb"] * 16 + ["aabbb"] * 8 + ["abbbb"] * 4)
    rows = [(1, chain), (2, None), (3, ""), (None, "Élanée élanée élanée Élanée Élanée élanée"), (4, "colour color COLOR colour colour color xx×÷yy xx×÷yy xx×÷yy"), (5, "abcdef " * 20_000), (5, "abcdef " * 20_000), (6, "abcde abcde abcde bacde bacde bacde")]
    df = spark.createDataFrame([(*r, *"nwdir", 1, 2, 3, 4, 5, "k") for r in rows], f"doc_id long, text string, {CLASH}")
    found = groups(spelling.variant_groups(spelling.counted_words(df, every=0)))
    assert found == variants(rows, 0)
    assert found["abbbb"][:2] == ("aabbb", "aaaaa") and found["color"][0] is None and found["color"][3] == 1 and "xx×÷yy" in found
    assert groups(spelling.variant_groups(spelling.counted_words(df))) == variants(rows)
    assert spelling.variant_groups(spelling.counted_words(df.limit(0))).count() == 0


def test_one_band_and_one_half_stay(spark):
    """Every pair one edit apart meets, whatever the letters; and a bucket that is hot is cut."""
    words = sorted({w for base in ("absorb", "élévé", "zzzzzz", "aabbccdd") for w in [base, *(base[:i] + c + base[i:] for i in range(len(base) + 1) for c in "aéz"), *(base[:i] + c + base[i + 1 :] for i in range(len(base)) for c in "aéz")] if len(w) >= 5})
    text = spark.createDataFrame([(1, " ".join(words * 3))], "doc_id long, text string")
    found = spelling.near_words(spelling.counted_words(text, every=0)).select("word", "near").collect()
    assert sorted(map(tuple, found)) == sorted((a, b) for a in words for b in words if a < b and near(a, b))
