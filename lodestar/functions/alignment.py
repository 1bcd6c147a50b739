"""Alignments of two token lists: the longest common subsequence by bits, and METEOR's alignment of unigrams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

from .stem import stem

# fixed values: the weight of precision, the penalty's exponent and its weight
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5
#: Open alignments that a stage follows; it is exact while no more are open.
BEAM = 256


def longest_common(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence. A bit stands for a token of the shorter list, and a token of the
    longer one is one addition of whole numbers."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = defaultdict(int)
    for i, token in enumerate(a):
        where[token] |= 1 << i
    every = (1 << len(a)) - 1
    row = every  # a zero bit is a place where the length grows
    for token in b:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def align(a: Sequence[str], b: Sequence[str], fixed: dict[int, int], beam: int = BEAM) -> dict[int, int]:
    """Links of equal tokens, place in a to place in b, added to those fixed by an earlier stage.

    As many as can be; of those the ones with the fewest crossings, then the most neighbours that stay neighbours,
    then the ones that come first. Equal tokens are linked in order, so an alignment's future depends on the places
    taken in b and on the last link only: those are the states.
    """
    free_a, free_b = [i for i in range(len(a)) if i not in fixed], set(range(len(b))) - set(fixed.values())
    places: dict[str, list[int]] = defaultdict(list)
    for j in sorted(free_b):
        places[b[j]].append(j)
    left: dict[str, int] = defaultdict(int)  # occurrences in a that are still to come
    for i in free_a:
        left[a[i]] += 1
    masks = {token: sum(1 << j for j in js) for token, js in places.items()}
    need = {token: min(len(js), left[token]) for token, js in places.items()}
    earlier, later = 0, sum(1 << j for j in fixed.values())
    states: dict[tuple[int, int], tuple[int, int, tuple[int, ...]]] = {(0, -2): (0, 0, ())}  # (taken, the place that the last token has): cost
    for i, token in enumerate(a):
        if i in fixed:
            earlier, later = earlier | 1 << fixed[i], later & ~(1 << fixed[i])
            states = _least(((taken, fixed[i]), cost) for (taken, _), cost in states.items())
            continue
        if token not in places:
            states = _least(((taken, -2), cost) for (taken, _), cost in states.items())
            continue
        left[token] -= 1
        after, js = fixed.get(i + 1, -2), places[token]
        opened = []
        for (taken, last), (crossings, apart, links) in states.items():
            mine = taken & masks[token]
            used = mine.bit_count()
            if need[token] - used <= left[token]:
                opened.append(((taken, -2), (crossings, apart, (*links, -1))))
            if used < need[token]:
                for j in js[: len(js) - (need[token] - used) + 1]:
                    if j < mine.bit_length():
                        continue
                    crossed = ((earlier | taken) >> (j + 1)).bit_count() + (later & ((1 << j) - 1)).bit_count()
                    beside = (last == j - 1) + (after == j + 1)
                    opened.append(((taken | 1 << j, j), (crossings + crossed, apart - beside, (*links, j))))
        states = _least(opened)
        if len(states) > beam:
            states = dict(sorted(states.items(), key=lambda s: s[1])[:beam])
    links = min(states.values())[2]
    return fixed | {i: j for i, j in zip((i for i in free_a if a[i] in places), links, strict=True) if j >= 0}


def _least(opened) -> dict:
    found: dict = {}
    for key, cost in opened:
        if key not in found or cost < found[key]:
            found[key] = cost
    return found


def meteor(candidate: Sequence[str], reference: Sequence[str], stages: Sequence[Callable[[str], str]] = (str, stem)) -> float:
    """METEOR of tokens: the weighted harmonic mean of unigram precision and recall, less a penalty for fragments.

    Each stage links what is left and equal after its function: the tokens themselves, then their stems; a function
    that names a token's class of synonyms may follow. Without a link the score is 0.
    """
    links: dict[int, int] = {}
    for same in stages:
        links = align([same(t) for t in candidate], [same(t) for t in reference], links)
    if not links:
        return 0.0
    precision, recall = len(links) / len(candidate), len(links) / len(reference)
    mean = precision * recall / (ALPHA * precision + (1 - ALPHA) * recall)
    chunks = sum(links.get(i - 1, -2) != j - 1 for i, j in links.items())
    return mean * (1 - GAMMA * (chunks / len(links)) ** BETA)
