"""Alignments against all alignments, subsequences against the table of lengths."""

import random
import time
from itertools import combinations, permutations

import pytest

from lodestar import catalog
from lodestar.functions.alignment import align, longest_common, meteor
from lodestar.functions.stem import stem


def by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_longest_common_equals_the_table():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(70))] for _ in "ab")
        assert longest_common(a, b) == by_table(a, b) == longest_common(b, a)


def test_longest_common_of_long_texts():
    rng = random.Random(2)
    a = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    b = [t for t in a if rng.random() < 0.7]
    began = time.time()
    assert longest_common(a, b) == len(b)
    assert time.time() - began < 20


def every(a, b, fixed):
    """The best of all sets of links of equal free tokens, by the same order."""
    free_a, free_b = [i for i in range(len(a)) if i not in fixed], [j for j in range(len(b)) if j not in fixed.values()]
    inside = [i for i in free_a if any(a[i] == b[j] for j in free_b)]
    found = []
    for n in range(min(len(inside), len(free_b)), -1, -1):
        for rows in combinations(inside, n):
            for columns in permutations(free_b, n):
                if all(a[i] == b[j] for i, j in zip(rows, columns, strict=True)):
                    links = fixed | dict(zip(rows, columns, strict=True))
                    crossed = sum((i - k) * (j - m) < 0 for (i, j), (k, m) in combinations(links.items(), 2))
                    chunks = sum(links.get(i - 1, -2) != j - 1 for i, j in links.items())
                    found.append((crossed, chunks, tuple(links.get(i, -1) for i in inside), links))
        if found:
            return min(found, key=lambda x: x[:3])[3]
    return fixed


def test_alignments_equal_the_best_of_all():
    rng = random.Random(3)
    words = ["run", "runs", "running", "cat", "cats", "the"]
    for _ in range(250):
        a, b = ([rng.choice(words) for _ in range(rng.randrange(1, 7))] for _ in "ab")
        first = align(a, b, {})
        assert first == every(a, b, {})
        x, y = [stem(t) for t in a], [stem(t) for t in b]
        assert align(x, y, first) == every(x, y, first)


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [
        ("the cat sat on the mat", "the cat sat on the mat", 1 - 0.5 / 6**3),
        ("on the mat sat the cat", "the cat sat on the mat", 0.5),  # each "the" in order crosses least: six chunks
        ("cats", "cat", 0.5),
        ("dog", "cat", 0.0),
        ("", "cat", 0.0),
        ("a b", "a b c d", (0.5 / (0.9 + 0.05)) * (1 - 0.5 / 8)),
    ],
)
def test_meteor_by_hand(a, b, score):
    assert meteor(a.split(), b.split()) == pytest.approx(score)


def test_meteor_of_all_turns(spark, data):
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{data}/conversations.parquet").collect()}
    rows = catalog.queries()["EVL09_meteor"](spark, data).collect()
    pairs = [k for k in turns if (k[0], k[1] + 1) in turns]
    assert len(rows) == len(pairs)
    for r in rows[:40]:
        assert r.meteor == round(meteor(turns[r.conv_id, r.turn + 1].lower().split(), turns[r.conv_id, r.turn].lower().split()), 6)
