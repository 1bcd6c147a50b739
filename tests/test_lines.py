"""Lines that are alike, against comparing every pair, and headers against a plain version."""

import random
from collections import Counter

import pytest

from lodestar.operators import lines
from lodestar.operators.chunking import HEADER_CHARS


def every(rows):
    """(head, n, n_links, n_alike) by comparing all heads."""
    n = Counter(r[: lines.HEAD] for r in rows if r is not None)
    out = set()
    for a in n:
        near = [b for b in n if b != a and lines.alike(a, b)]
        out.add((a, n[a], len(near), n[a] + sum(n[b] for b in near)))
    return out


def made():
    rng = random.Random(1)
    words = ["page", "chapter", "of", "the", "annual", "report", "section", "größe", "日本", "number", "total"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(200)]
    out = []
    for b in base:
        for _ in range(rng.randint(1, 8)):
            x = list(b)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(x) + 1)
                kind = rng.random()
                if kind < 0.4:
                    x.insert(at, rng.choice("abé1"))
                elif x and at < len(x):
                    x[at : at + 1] = [] if kind < 0.7 else [rng.choice("xyz9")]
            out.append("".join(x))
    return out + [f"Page {i} of 100: the annual report of the company" for i in range(100)] + ["", "", None, "a", "a", "x" * 500, "x" * 59, "x" * 58, "x" * 56]


def test_two_thousand_lines(spark):
    rows = made()
    assert len(rows) > 900
    df = spark.createDataFrame([(r, "clash", 1) for r in rows], "line string, head string, id long")
    got = {tuple(r) for r in lines.alike_lines(df, []).select("head", "n", "n_links", "n_alike").collect()}
    want = every(rows)
    assert got == want and sum(w[2] for w in want) > 500


@pytest.mark.parametrize("n", range(1, 61))
def test_pieces_leave_one_whole(n):
    parts = lines.pieces(n)
    most = max(lines.left_over(n, b) for b in range(n, 61))
    assert (not parts and most == 0) or (len(parts) == most + 1 and all(a < b for a, b in parts) and parts[-1][1] == n)


def test_groups_stay_apart_and_nothing_gives_nothing(spark):
    df = spark.createDataFrame([(g, f"a line of more than twenty characters {i}") for g in ("x", "y", None) for i in range(3)], "g string, line string")
    assert [tuple(r)[2:] for r in lines.alike_lines(df, ["g"]).collect()] == [(1, 2, 3)] * 9
    assert lines.alike_lines(df.limit(0), ["g"]).count() == 0


def test_headers_with_page_numbers(spark):
    """No two first lines are equal, all are alike; equal lines alone would find no header."""
    pages = [("f", i, f"The Annual Report of the Company and its Branches, page {i:03d}\nbody {i}\n\nConfidential") for i in range(8)]
    pages += [("g", i, f"{w}\nbody") for i, w in enumerate(("first words of one", "other words", "third"))] + [("f", 8, None), ("h", 1, "only page\nx")]
    out = {(r.file, r.page): r for r in lines.strip_alike_headers(spark.createDataFrame(pages, "file string, page long, text string")).collect()}
    assert len(out) == len(pages)
    for i in range(8):
        r = out["f", i]
        assert r.header[:HEADER_CHARS] == "The Annual" and r.footer == "Confidential" and r.text == f"body {i}"
    assert out["g", 1].header is None and out["g", 1].text == "other words" and out["h", 1].text == "only page\nx"


def test_alike_lines_share_a_key_of_few():
    rng, met = random.Random(3), 0
    for _ in range(6000):
        a = "".join(rng.choice("abcd ") for _ in range(rng.choice((20, 25, 39, 41, 49, 52, 55, 56, 57, 58, 59, 60))))
        b = list(a)
        for _ in range(rng.randrange(6)):
            if rng.random() < 0.5:
                b.insert(rng.randrange(len(b) + 1), rng.choice("abcd "))
            elif b:
                b.pop(rng.randrange(len(b)))
        x, y = sorted((a, "".join(b)[: lines.HEAD]), key=len)
        if x != y and (lines.alike(x, y) or lines.alike(y, x)):
            met += 1
            assert {k for k, short in lines.keys_of(x) if short} & {k for k, short in lines.keys_of(y) if not short}
            assert (lines.sketch(x) % 2**64 ^ lines.sketch(y) % 2**64).bit_count() <= 15
    assert met > 500
    assert len(list(lines.keys_of("abcdefghij" * 6))) <= 40  # there were about 200, each with the line
