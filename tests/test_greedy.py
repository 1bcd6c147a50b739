"""Sequential operators by values worked out by hand, and their invariants."""

import numpy as np
import pandas as pd
import pytest

from lodestar.operators import greedy as g
from lodestar.operators.retrieval import RRF


def test_sentence_packing_keeps_the_overlap():
    text = " ".join(f"{'w ' * 9}s{i}." for i in range(10))
    chunks = g.pack_sentences(text, most=30, overlap=10)
    assert chunks[0].endswith("s2.") and chunks[1].startswith("w w") and "s2." in chunks[1]
    assert all(len(c.split()) <= 30 for c in chunks)
    assert g.pack_sentences("") == []


def test_paragraphs_and_sizes():
    assert g.pack_paragraphs("a b\n\n\nc d\n\ne", most=4) == ["a b\n\nc d", "e"]
    assert g.split_by_size("a b. c d. e f.", most=4) == ["a b. c d.", "e f."]
    assert g.trim_last("This is one whole sentence here. Too short.") == ["This is one whole sentence here."]


def test_marginal_relevance_avoids_copies():
    v = np.array([[1.0, 0], [1.0, 0.01], [0, 1.0], [-1.0, 0]])
    assert g.marginal_relevance(v, np.array([1.0, 0.6, 0.55, 0.0]), 2) == [0, 2]
    assert g.term_relevance(["a b c", "a b c", "x y z"], np.array([0.9, 0.8, 0.7]), 3)[:2] == [0, 2]


def test_context_stays_within_its_budget():
    pdf = pd.DataFrame({"query_id": 1, "doc_id": range(20), "source": "s", "score": np.linspace(1, 0, 20), "content": ["word " * 200] * 20})
    out = g.build_context(pdf)
    assert out.tokens[0] <= 1104 and out.context[0].startswith("[s#0]")


def test_scene_sampling_state():
    assert g.sample_scenes(np.array([0, 1, 5, 10.0]), np.array([0, 0, 50, 50.0]), 10, 30).tolist() == [True, False, True, False]


@pytest.mark.parametrize(("a", "b", "f"), [("a b c d", "a c d e", 0.75), ("", "a", 0.0), ("a", "a", 1.0)])
def test_rouge_l(a, b, f):
    assert g.rouge_l(a.split(), b.split()) == f


def test_bleu_of_equal_and_of_strange_texts():
    assert g.bleu("a b c d e".split(), "a b c d e".split()) == (1.0, 1.0, 1.0, 1.0)
    assert g.bleu("x".split(), "a b".split()) == (0.0, 0.0, 0.0, 0.0)


def test_rank_constant():
    assert round(2 / (RRF + 1), 10) == 0.0327868852
